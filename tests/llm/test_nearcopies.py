"""The near-duplicate stage against all exact Jaccard similarities."""

import numpy as np
import pytest

import corpus_pipeline
from strataloom.llm import nearcopies


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if (not a and not sets[j]) or (a and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.fixture(scope="module")
def texts():
    random = np.random.default_rng(5)
    out = [None, "", " \n ", "few words", "Few  words"]
    for n in range(12):
        words = [f"w{x}" for x in random.integers(0, 5000, 200)]
        out.append(" ".join(words))
        for changes in (0, 1, 2, 3, 4, 6, 12):
            copy = list(words)
            for at in random.integers(0, 200, changes):
                copy[at] = f"n{n}x{at}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("most", [nearcopies.MOST, 2])
def test_one_of_each_component(spark, texts, most):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in nearcopies.keep_one(docs, most=most).collect())
    assert got == sorted(set(components(texts))) and len(got) < len(texts) - 50


def test_stage_removes_near_copies(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_duplicates(spark, docs, "").count() == len(set(components(texts)))
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), "").count() == 0


def test_a_large_group_with_several_components(spark):
    """Chains of gradual change: parts, first classes and those that ask must leave no pair out."""
    random = np.random.default_rng(9)
    base = [f"w{x}" for x in random.integers(0, 5000, 120)]
    sets, texts = [], []
    for chain in range(6):
        words = list(base)
        for at in range(chain * 7):
            words[at] = f"c{chain}x{at}"
        for step in range(12):
            words[100 - step : 101 - step] = [f"s{chain}x{step}"] if step % 3 else words[100 - step : 101 - step]
            texts.append(" ".join(words))
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "__row long, text string")
    members = spark.createDataFrame([(i % 2, i, i, 100) for i in range(len(texts))], "component long, rep long, row long, bytes long")
    for most in (3, 1000):
        links = nearcopies.confirmed(members, rows, "text", 5, 0.8, most)
        found = {r.node: r.component for r in nearcopies.connected(links).collect()}
        for half in (0, 1):
            own = [i for i in range(len(texts)) if i % 2 == half]
            label = {i: i for i in own}
            for i in own:
                for j in own:
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                        low, high = sorted((label[i], label[j]))
                        label = {k: low if x == high else x for k, x in label.items()}
            assert len(set(label.values())) > 1 and {i: found.get(i, i) for i in own} == label
