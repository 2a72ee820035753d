"""The sample of tokens that weights are learned from."""

from collections import Counter

from strataloom.llm import pii


def test_equal_tokens_are_thinned(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(pii, "learn", lambda rows: taken.extend(rows))
    text = "a.b@c.org x " * 50 + "10.0.0.1 x " * 50
    docs = spark.createDataFrame([(i, text) for i in range(50)], "doc_id long, text string")
    pii.fit(docs, sample=40)
    kinds = Counter(y for _, _, y in taken)
    assert len(taken) == 40 and len(kinds) == 2 and min(kinds.values()) >= 8
