"""Learned cutoffs of small strata, by planted symbols."""

import numpy as np
import pytest

from strataloom.llm import quality


def text(n, symbols):
    return " ".join(f"w{n}x{i}" for i in range(40)) + " " + "#" * symbols


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = [], []
    for lang, good, bad in (("de", 400, 30), ("fr", 400, 30), ("x", 150, 10), ("y", 150, 10), (None, 150, 10)):
        for i in range(good + bad):
            rows.append((len(rows), text(len(rows), 60 if i >= good else 0), lang))
            labels.append((len(labels), int(i < good)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_small_strata_have_cutoffs(tables):
    docs, labels = tables
    got = {(r.lang, r.quality): r.n for r in quality.judge(docs, labels).filter("kept").join(labels, "doc_id").groupBy("lang", "quality").count().withColumnRenamed("count", "n").collect()}
    assert got == {("de", 1): 400, ("fr", 1): 400, ("x", 1): 150, ("y", 1): 150, (None, 1): 150}
    assert quality.keep_good(docs, labels).count() == 1250


def test_too_few_labels_reject_nothing(tables):
    docs, labels = tables
    assert quality.judge(docs.filter("lang = 'x'"), labels).filter("kept").count() == 160


def test_bad_documents_like_good_ones_are_kept(tables):
    docs, labels = tables
    assert quality.judge(docs, labels.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")).filter("not kept").count() <= 0.02 * 1340


def test_columns_that_clash_with_statistics_pass_through(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "en", "x", 2.5), (2, "short", "en", "y", 0.5)], "doc_id long, text string, lang string, n_words string, symbol_ratio double")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [tuple(r) for r in quality.keep_good(docs, labels).collect()] == [(1, text, "en", "x", 2.5)]
    assert quality.keep_good(docs.filter("false"), labels).columns == docs.columns


def test_the_guarantee_holds_in_simulation():
    """Over 1,000 draws of labelled good documents, the share of all good documents that
    the chosen cutoffs reject is above the risk no more often than the level allows."""
    random = np.random.default_rng(2)
    share = np.array([0.001, 0.004, 0.006, 0.006, 0.01, 0.02, 0.05])  # rejected first by each cutoff of the sequence
    chances = np.append(share, 1 - share.sum())
    too_many = strict = 0
    for _ in range(1000):
        n = quality.accepted(random.multinomial(600, chances), risk=0.02, level=0.1)
        too_many += share[:n].sum() > 0.02
        strict += n > 0
    assert too_many <= 100 + 3 * 10 and strict > 900
