"""Rows without an id and repeated rows."""

import pytest

from strataloom.llm import embeddings, nearcopies, simhash

A, B, C = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
ROWS = [(None, A), (3, A), (4, B), (4, B), (None, C), (None, C), (None, None), (7, "")]


@pytest.mark.parametrize("keep_one", [simhash.keep_one, nearcopies.keep_one])
def test_one_row_of_each_group(spark, keep_one):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, A), (4, B), (None, C), (7, "")], key=str)


def test_components_link_through_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, *_: docs.selectExpr(key, "case text when 'x' then 0L when 'y' then 15L else 255L end as fp"))
    docs = spark.createDataFrame([(1, "x"), (None, "y"), (2, "z")], "doc_id long, text string")
    assert {r.component_id for r in simhash.components(docs).collect()} == {1}


def test_vectors_without_id(spark):
    high = (1 << 60) + 1
    rows = [(None, [1.0, 0.0]), (high, [1.0, 0.1]), (high + 1, [1.0, 0.2]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (None, None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in embeddings.near_duplicates(docs).collect()]
    want = [(None, 2, high, False), (high, 2, high, True), (high + 1, 2, high, False), (None, 1, None, False), (None, 1, None, True), (None, 0, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
