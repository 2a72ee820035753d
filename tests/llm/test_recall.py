"""Links of vectors near the threshold, and held-out languages, on more than a handful of rows."""

import numpy as np
from pyspark.sql import functions as F

from strataloom.llm import embeddings, langid
from strataloom.llm.common import table
from strataloom.llm.queries import held_out


def test_links_near_the_threshold_are_found(spark, monkeypatch):
    """4,000 planted pairs of cosine 0.90 to 0.93 among 10,000 vectors of 32 dimensions;
    small buckets, cells and more projections a key, as in larger tables."""
    monkeypatch.setattr(embeddings, "EXPECTED", 256)
    random = np.random.default_rng(5)
    x = random.standard_normal((10_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = random.standard_normal((4_000, 32))
    other -= (other * x[:4_000]).sum(1, keepdims=True) * x[:4_000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = random.uniform(0.9005, 0.93, (4_000, 1))
    x[4_000:8_000] = cosine * x[:4_000] + np.sqrt(1 - cosine**2) * other
    x = x.astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.9).sum(1) - 1
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embeddings.near_duplicates(data).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    recall = found.sum() / links.sum()
    print(f"links: recall {recall:.4f} of {links.sum() // 2}")
    assert links.sum() >= 8_000 and (found <= links).all() and recall >= 0.95
    assert all(got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i in range(len(x)))


def test_cells_of_a_large_bucket_count_each_link_once(spark):
    random = np.random.default_rng(6)
    x = (np.ones(16) + 0.05 * random.standard_normal((700, 16))).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, v array<float>").withColumn("w", F.lit(1).cast("long"))
    found = embeddings.linked(rows, most=100).groupBy("rep").agg(F.sum("n").alias("n")).collect()
    assert {r.rep: r.n for r in found} == dict.fromkeys(range(700), 699)


def test_languages_of_held_out_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").withColumn("held", held_out())
    model = langid.fit(docs, ~held_out())
    rows = langid.predict(docs.filter("held and lang is not null"), model, ["lang"]).filter("lang_pred <> 'und'").collect()
    share = np.mean([r.lang == r.lang_pred for r in rows])
    print(f"held-out accuracy {share:.4f} of {len(rows)}")
    assert len(rows) > 200 and share >= 0.97


def test_a_repeated_row_counts_once_in_the_sample(spark):
    docs = spark.createDataFrame([(1, "abc def", "x")] * 50 + [(2, "ghi jkl", "y"), (None, "mno", "y")], "doc_id long, text string, lang string")
    assert langid.sample_rows(docs, "doc_id", "text", "lang", 10).distinct().count() == 3
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs, F.lit(True)), ["doc_id"]).collect()} == {"x", "y"}
