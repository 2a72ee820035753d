import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import suffixes as S


def common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00", min_size=0, max_size=40).map(str.encode), min_size=1, max_size=6), st.data())
def test_longest_previous_factors_match_a_quadratic_search(texts, data):
    docs = np.array(data.draw(st.lists(st.integers(0, 3), min_size=len(texts), max_size=len(texts))))
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    owner = np.repeat(np.arange(len(texts)), np.diff(begin))
    starts = np.arange(begin[-1])
    joined = b"".join(texts)
    order, common = S.suffix_order(np.frombuffer(joined, np.uint8), starts, begin[owner + 1])
    suffix = [joined[i : begin[owner[i] + 1]] for i in range(len(joined))]
    assert [suffix[i] for i in order] == sorted(suffix)
    assert list(common[1:]) == [common_prefix(suffix[a], suffix[b]) for a, b in zip(order, order[1:])]
    found = np.zeros(len(order), int)
    found[order] = S.previous_factors(docs[owner][order], common)
    wanted = [max([common_prefix(suffix[i], suffix[j]) for j in range(len(suffix)) if docs[owner[j]] < docs[owner[i]]], default=0) for i in range(len(suffix))]
    assert list(found) == wanted


def brute(texts: dict[int, bytes], length: int) -> dict[int, int]:
    first: dict[bytes, int] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - length + 1):
            first.setdefault(texts[d][i : i + length], d)
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = True
        out[d] = int(gone.sum())
    return out


def test_hot_parts_and_ties_lose_no_copy(spark):
    rng = np.random.default_rng(3)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(40)]
    passage = " ".join(words)
    texts = {i: (" ".join(rng.choice(words, 12)) + passage[i % 7 : 200 - i % 5] + "x" * (60 + i % 9)).encode() for i in range(60)}
    docs = spark.createDataFrame([(i, t.decode()) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    for hot in (1, 2000):
        found = {r["doc_id"]: r["n_removed"] for r in S.dedup(docs, hot=hot).collect()}
        assert found == brute(texts, 50)
