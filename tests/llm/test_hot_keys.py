"""What a bucket gets of a key that all documents hold."""

from collections import Counter

import numpy as np

from strataloom.llm import matching as M
from strataloom.llm import substrings, suffixes

KEY = np.uint64(0x123456789ABCDEF8)


def entries(rows, kind, bucket=None):
    return sum(len(r[4]) // 8 for r in rows if r[3] == kind and bucket in (None, r[0]))


def test_one_key_in_all_documents():
    buckets, own, homes, known = 64, 0, Counter(), 0
    at = int(M.bucket_of(np.array([KEY]), buckets)[0])
    for begin in range(0, 200_000, 4000):
        docs = np.arange(begin, begin + 4000)
        rows = suffixes._first_packets(docs, np.full(4000, KEY), buckets)
        own += entries(rows, M.ENTRY, at) + entries(rows, M.NOTE, at)
        known += entries(rows, M.KNOWN)
        homes.update({r[0]: len(r[4]) // 8 for r in rows if r[3] == M.KNOWN})
    assert own == 50 and known == 200_000  # an entry a task; all others go home
    assert max(homes.values()) < 2 * 200_000 / buckets


def test_few_documents_of_a_task_ask_the_bucket_whether_a_key_is_hot():
    docs = np.arange(M.CROWD)
    rows = suffixes._first_packets(docs, np.full(len(docs), KEY), 64)
    assert entries(rows, M.ENTRY) == 1 and entries(rows, M.NOTE) == M.CROWD and entries(rows, M.KNOWN) == 0


def test_entries_of_a_crowd_make_a_key_hot():
    (d, k), (_, _, many) = M.Shared.combine(np.arange(100), np.full(100, KEY), np.ones(100, bool))
    assert many.all() and len(d) == 1
    d, k, busy = M.Shared.match(np.concatenate([d, [500]]), np.concatenate([k, [KEY | np.uint64(1)]]), 1 << 40)
    assert busy.all() and set(k.tolist()) == {int(KEY)}


def shared_passage(spark, n):
    """Documents with one passage of over 50 bytes and 13 words, and copies of one text."""
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [f"begin{i} {passage} end{i} " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(n)] + [f"same {passage} text " * 4] * n
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6), texts


def test_hot_passages_in_both_ways(spark):
    docs, texts = shared_passage(spark, 150)
    lost = {r.doc_id: r.n_removed for r in substrings.dedup(docs).collect()}
    assert lost[0] == 0 and lost[1] == 14 and lost[149] == 14
    assert lost[200] == len(texts[200].split()) and lost[150] == 14 * 4
    for hot in (10, 1 << 40):
        rows = {r.doc_id: r for r in suffixes.dedup(docs, hot=hot).collect()}
        assert rows[0].n_removed == 0 and rows[299].n_removed == len(texts[299])
        assert 79 <= rows[1].n_removed <= 90
