"""The whole pipeline against a brute-force version on a small corpus."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string"


def corpus() -> list[tuple]:
    random = np.random.default_rng(11)
    vocabulary = ["".join(chr(97 + c) for c in random.integers(0, 26, 5)) for _ in range(4000)]
    text = lambda n: " ".join(random.choice(vocabulary, n))
    passage, texts = text(60), []
    for i in range(30):
        base = text(int(random.integers(15, 90)))
        texts.append(base)
        if i % 3 == 0:  # near copies: a few words replaced at one place
            words = base.split()
            words[5:6] = ["changed"]
            texts.append(" ".join(words))
        if i % 5 == 0:
            texts.append(base)
        if i % 4 == 0:
            texts.append(f"{text(20)} {passage} {text(70)}")
        if i % 6 == 0:
            texts.append(f"{text(20)} write to user{i}@mail{i}.example.org now {text(20)}")
    texts += [None, "", "too short", "again and again the same words here " * 10, text(2500)]
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, text(40)), (None, rows[7][1]), (500, rows[2][1].upper())]
    order = random.permutation(len(rows))
    return [(rows[i][0], rows[i][1], "en" if i % 3 else None, "s", len(rows[i][1] or ""), "extra") for i in order]


def key(row: tuple) -> tuple:
    return (row[0] is None, row[0] or 0)


def kept_by_rules(rows: list[tuple]) -> list[tuple]:
    out = []
    for r in rows:
        w = (r[1] or "").encode().split()
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        counts = Counter(windows)
        covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w):
            out.append(r)
    return out


def one_of_each_group(rows: list[tuple]) -> list[tuple]:
    sets = []
    for r in rows:
        w = r[1].lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for r, g in zip(rows, label, strict=True):
        groups[g].append(r)
    return [min(g, key=key) for g in groups.values()]


def without_repeats(rows: list[tuple]) -> list[tuple]:
    first = {}
    for r in sorted(rows, key=key):
        w = r[1].split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), key(r))
    out = []
    for r in rows:
        w = r[1].split()
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < key(r) for j in range(i, i + 13)}
        out.append((r[0], " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1], *r[2:]))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = without_repeats(one_of_each_group(kept_by_rules(rows)))
    assert 10 < len(want) < len(rows) - 10 and any(r[0] is None for r in want)
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {}
    for r in want:
        clean = re.sub(r"[a-z0-9]+@[a-z0-9.]+[a-z0-9]", "[EMAIL]", r[1])
        ids[r[0]] = [*tokenizer.encode(clean, add_special_tokens=False).ids, 1]
    found, windows = defaultdict(set), Counter()
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert not found[r.doc_id] & set(range(r.start, r.start + r.length))
        found[r.doc_id] |= set(range(r.start, r.start + r.length))
        windows[r.sequence_id] += r.length
    assert {d: len(x) for d, x in found.items()} == {d: len(x) for d, x in ids.items()}
    assert all(n == 2048 or n & (n - 1) == 0 for n in windows.values())


@pytest.mark.parametrize("number", range(len(corpus_pipeline.STAGES)))
def test_stages_of_an_empty_table(spark, tmp_path, number):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.STAGES[number][1](spark, docs, str(tmp_path))
    assert out.count() == 0 and (number == 4 or out.columns == docs.columns)
