"""Substring dedup of word sequences by fixed-block anchors.

A word is removed where a window of ``WINDOW`` words covers it whose words also
start in a document of smaller id. Any window that two documents share holds a
whole block of ``BLOCK`` = (WINDOW + 1) / 2 words that starts at a multiple of
``BLOCK`` in either document. So non-overlapping blocks of every document are
indexed, and every rolling block of every document probes them; a hit is a
block that another document indexes or probes too. Hits are extended to the
left and right, to each window that holds them; windows of equal words are
matched over all documents, and neighbouring windows with a smaller match join
to the maximal exact repeats that are removed.

A word counts as its 128-bit XXH3 hash. Blocks, which only prefilter, are
compared by 61 bits of a hash of their words; windows by 96 bits, so among n
different windows a false match is expected n^2 / 2^97 times.

Edge cases: a null text has no words; a text shorter than a window loses
nothing; repeated rows of one id remove nothing from each other; a null id
counts as larger than any other; further columns of any name are left alone by
``strip`` and unread by ``dedup``; a text of any length is read whole, in one
task; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from strataloom.llm import matching as M
from strataloom.llm.common import discard, mapped, slices, store, text_bytes

WINDOW = 13
BLOCK = (WINDOW + 1) // 2


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Two rows of 64-bit numbers: the halves of each word's hash."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2).T.copy()


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words, from one half of their hashes."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    odd, factor = np.uint64(0x9E3779B97F4A7C15), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(width):
            out += hashes[i : i + n] * factor
            factor *= odd
    return M.mixed(out)


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n positions lie in a run of ``width`` from one of ``starts``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change[:-1]) > 0


def _short(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(3)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _block_packets(docs: DataFrame, key: str, text: str, window: int, block: int, at: M.Layout) -> DataFrame:
    buckets = at.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], []]

        def flush() -> pa.RecordBatch:
            (d, k), (hd, hk, _) = M.Shared.combine(*(np.concatenate(c) for c in held))
            for c in held:
                c.clear()
            return M.packet_batch(M.packets(M.bucket_of(k, buckets), d, k, M.ENTRY) + M.known_packets(hd, hk, buckets))

        size = 0
        for batch in slices(batches):
            for doc, data in zip(M.ids(batch.column(0)), text_bytes(batch.column(1)), strict=True):
                words = data.split() if data else []
                if len(words) < window:
                    continue
                keys = rolling(word_hashes(words)[0], block)
                held[0].append(np.full(len(keys), doc))
                held[1].append(keys)
                held[2].append(np.arange(len(keys)) % block == 0)
                size += len(keys)
                if size >= M.FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = M.Outbox(buckets)
        for _, kind, rows in M.by_bucket(batches):
            d, k = M.unpacked(rows)
            if kind == M.ENTRY:
                d, k, _ = M.Shared.match(d, k, 1 << 60)
            yield from out.put(d, _short(k))
        yield from out.end()

    return mapped(M.sent(mapped(docs.select(key, text), run, M.PACKET_DDL), at), matched, M.PACKET_DDL)


def _window_packets(docs: DataFrame, hits: DataFrame, key: str, text: str, window: int, block: int, at: M.Layout) -> DataFrame:
    buckets = at.buckets

    def task() -> tuple:
        held: list[list] = [[], [], []]

        def add(rows: pa.RecordBatch, notes_of: Callable) -> Iterator[pa.RecordBatch]:
            for doc, data in zip(M.ids(rows.column(0)), text_bytes(rows.column(1)), strict=True):
                own = notes_of(doc)
                if not len(own) or not data:
                    continue
                hashes = word_hashes(data.split())
                if hashes.shape[1] < window:
                    continue
                hit = np.isin(_short(rolling(hashes[0], block)), own)
                inside = np.lib.stride_tricks.sliding_window_view(hit, window - block + 1).any(1)
                found = rolling(hashes[0], window)[inside]
                held[0].append(np.full(len(found), doc))
                held[1].append(found)
                held[2].append((rolling(hashes[1], window)[inside] >> np.uint64(32)).astype(np.uint32))
                if sum(map(len, held[1])) >= M.FLUSH:
                    yield from end()

        def end() -> Iterator[pa.RecordBatch]:
            if held[0]:
                (d, k, m), (ld, lk) = M.Earliest.combine(*(np.concatenate(c) for c in held))
                for c in held:
                    c.clear()
                yield M.packet_batch(M.packets(M.bucket_of(k, buckets), d, k, M.ENTRY, m) + M.known_packets(ld, lk, buckets))

        return add, end

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = M.Outbox(buckets)
        for _, kind, rows in M.by_bucket(batches):
            d, k = M.unpacked(rows)
            if kind == M.ENTRY:
                d, k = M.Earliest.combine(d, k, np.frombuffer(b"".join(r["more"] for r in rows), np.uint32))[1]
            yield from out.put(d, k)
        yield from out.end()

    packed = M.meet(docs.select(key, text), hits, key, task, np.uint32, M.PACKET_DDL, at)
    return mapped(M.sent(packed, at), matched, M.PACKET_DDL)


def repeats(docs: DataFrame, key: str, text: str, window: int, at: M.Layout) -> DataFrame:
    """Stored notes: hashes of the windows of each document that an earlier one holds."""
    block = (window + 1) // 2
    hits = store(_block_packets(docs, key, text, window, block, at), "blocks")
    found = store(_window_packets(docs, hits, key, text, window, block, at), "windows")
    discard(hits)
    return found


def removed_words(words: list[bytes], keys: np.ndarray, window: int) -> np.ndarray:
    if not len(keys) or len(words) < window:
        return np.zeros(len(words), bool)
    starts = np.flatnonzero(np.isin(rolling(word_hashes(words)[0], window), keys))
    return covered(starts, len(words), window)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: ``n_words, n_removed, kept_sha256``."""
    kind = docs.schema[key].dataType.simpleString()

    def run(rows: pa.RecordBatch, later: Callable) -> Iterator[pa.RecordBatch]:
        counts, lost, digests = [], [], []
        for doc, data in zip(M.ids(rows.column(0)), text_bytes(rows.column(1)), strict=True):
            words = data.split() if data else []
            out = removed_words(words, later(doc), window)
            counts.append(len(words))
            lost.append(int(out.sum()))
            kept = [w for w, o in zip(words, out.tolist(), strict=True) if not o] if lost[-1] else words
            digests.append(sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string())], names=[key, "n_words", "n_removed", "kept_sha256"])

    at = M.layout(docs, text)
    found = repeats(docs, key, text, window, at)
    schema = f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string"
    return M.meet(docs.select(key, text), found, key, M.each(run), np.uint64, schema, at)


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the repeated words. A text that loses words keeps the
    others joined by one space, and one that loses all becomes empty; any other
    text stays as it is."""
    names, at = docs.columns, docs.columns.index(text)
    where = docs.columns.index(key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(rows: pa.RecordBatch, later: Callable) -> Iterator[pa.RecordBatch]:
        texts = []
        for doc, data in zip(M.ids(rows.column(where)), text_bytes(rows.column(at)), strict=True):
            words = data.split() if data else []
            out = removed_words(words, later(doc), window)
            if out.any():
                data = b" ".join([w for w, o in zip(words, out.tolist(), strict=True) if not o])
            texts.append(None if data is None else data.decode())
        columns = list(rows.columns)
        columns[at] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, names=names)

    layout = M.layout(docs, text)
    found = repeats(docs, key, text, window, layout)
    return M.meet(docs, found, key, M.each(run), np.uint64, schema, layout)
