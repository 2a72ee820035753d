"""Operators on all 200 documents of the smallest table, on empty tables and on clashing columns."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strataloom.llm import embeddings, langid, nearcopies, pii, quality, queries, simhash, substrings, suffixes, warc
from strataloom.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SMALL, "documents").collect()}


def test_bpe_matches_the_library(spark, texts):
    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for r in queries.op2_bpe(spark, SMALL).collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        told = (r.n_tokens, r.ids_sha256, r.decoded_sha256)
        decoded = t.decode(ids, skip_special_tokens=False)
        assert told == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())


def test_packing_holds_each_id_once(spark, texts):
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in texts.items()}
    found, windows = defaultdict(Counter), Counter()
    for r in queries.op10_packing(spark, SMALL).collect():
        part = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        found[r.doc_id].update(range(r.start, r.start + r.length))
        windows[r.sequence_id] += r.length
    assert {d: sorted(c.elements()) for d, c in found.items()} == {d: list(range(len(w))) for d, w in want.items()}
    assert sum(n < 2048 for n in windows.values()) <= 11


def test_quality_columns_by_brute_force(spark, texts):
    for r in queries.op9_quality(spark, SMALL).collect():
        text = texts[r.doc_id]
        w = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        counts = Counter(windows)
        repeats = len({j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 5)})
        want = (len(w), sum(len(x.decode()) for x in w), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeats)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 10 or 100 * repeats > 20 * len(w)) and (not r.kept or not r.base_failed)


def test_removed_bytes_and_words_by_brute_force(spark, texts):
    def removed(units: dict, width: int) -> dict:
        first: dict = {}
        for d in sorted(units):
            for i in range(len(units[d]) - width + 1):
                first.setdefault(units[d][i : i + width], d)
        out = {}
        for d, u in units.items():
            gone = np.zeros(len(u) + 1, np.int64)
            for i in range(len(u) - width + 1):
                if first[u[i : i + width]] < d:
                    gone[i] += 1
                    gone[i + width] -= 1
            out[d] = int((np.cumsum(gone) > 0).sum()) if len(u) else 0
        return out

    want = removed({d: x.encode() for d, x in texts.items()}, 50)
    assert {r.doc_id: r.n_removed for r in suffixes.dedup(table(spark, SMALL, "documents")).collect()} == want
    want = removed({d: tuple(x.encode().split()) for d, x in texts.items()}, 13)
    assert {r.doc_id: r.n_removed for r in substrings.dedup(table(spark, SMALL, "documents")).collect()} == want


def test_empty_tables(spark):
    docs = table(spark, SMALL, "documents").filter("false")
    assert embeddings.near_duplicates(table(spark, SMALL, "embeddings").filter("false")).count() == 0
    model = langid.fit(table(spark, SMALL, "documents"), F.lit(True))
    assert langid.predict(docs, model, ["doc_id"]).count() == 0
    assert pii.redact(docs, pii.fit(table(spark, SMALL, "documents"))).columns == docs.columns
    for keep in (simhash.keep_one, nearcopies.keep_one, substrings.strip):
        assert keep(docs).count() == 0
    assert quality.keep_good(table(spark, SMALL, "documents"), table(spark, SMALL, "labels").filter("false")).count() > 0


def test_clashing_columns(spark):
    """Columns named like those that operators make or use inside."""
    names = ("component_id", "fp", "rep", "node", "row", "cell", "part", "bucket", "kind", "digest", "w", "v", "n", "t", "own")
    docs = table(spark, SMALL, "documents").limit(60)
    more = docs.select("*", *(F.lit("x").alias(c) for c in names))
    for keep in (simhash.keep_one, nearcopies.keep_one, substrings.strip):
        a, b = keep(docs), keep(more)
        assert b.columns == more.columns and sorted(r.doc_id for r in a.collect()) == sorted(r.doc_id for r in b.collect())
    assert pii.redact(more, pii.fit(more)).columns == more.columns
    vectors = table(spark, SMALL, "embeddings").limit(50)
    clash = vectors.select("*", *(F.lit(1).alias(c) for c in names))
    assert sorted(map(tuple, embeddings.near_duplicates(clash).collect())) == sorted(map(tuple, embeddings.near_duplicates(vectors).collect()))
    pages = table(spark, SMALL, "pages").limit(20)
    assert warc.write(pages.select("*", *(F.lit("x").alias(c) for c in (*names, "offset", "archive")))).count() == 20
