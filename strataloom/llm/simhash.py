"""SimHash fingerprints and near-duplicates by bit-sliced comparison.

Fingerprints of 64 bits are the majority bits of XXH64 hashes of word shingles.
Equal fingerprints form one class first. Two fingerprints within ``RADIUS``
bits agree on at least two of six blocks of bits, so each class goes to one
bucket per pair of blocks and no pair is missed. A bucket's fingerprints are
stored as vertical bit planes, 64 fingerprints to a word; each fingerprint is
compared with whole words at a time by carry-save counters over the planes, and
words in which every lane exceeds the radius are abandoned. Buckets leave only
a star per local component; components over all documents follow.

Edge cases: a null text has no words; a text without words has fingerprint
zero, linked like any other; a text of fewer words than a shingle is one
shingle; equal and repeated rows fall into one class; a row without an id links
like any other, and a component without any id has a null ``component_id``; a
text of any length is read whole, in one task; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import (
    connected,
    dealt,
    group_bounds,
    hot_join,
    least_labels,
    mapped,
    scratch,
    slices,
    store,
    text_bytes,
    whole_groups,
    work_dir,
)

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Widths of the blocks of bits, from bit 0; two must agree within RADIUS.
BLOCKS = (11, 11, 11, 11, 10, 10)
AGREE = 2
#: Classes of a bucket that one part of a cell holds.
MOST = 4096
#: (fingerprint, word) pairs compared at a time.
ITEMS = 1 << 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(data: bytes, width: int = SHINGLE) -> int:
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    text, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: -width]]]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 15):
        part = zip(starts[i : i + (1 << 15)], ends[i + width - 1 : i + width - 1 + (1 << 15)], strict=True)
        hashes = np.array([digest(text[a:b], SEED) for a, b in part], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    major = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(major, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """Rows ``(key, fp)``; ``fp`` holds the 64 bits as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t or b"", width) for t in text_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fp"])

    return mapped(docs.select(key, text), run, f"`{key}` {kind}, fp long")


def near(fps: np.ndarray, bounds: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b), a < b, in the same group and within ``radius`` bits,
    reduced to links that keep each group's components."""
    n = len(fps)
    padded = np.zeros(-(-n // 64) * 64, np.uint64)
    padded[:n] = fps
    planes = [
        np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)
        for b in range(64)
    ]
    end = np.repeat(bounds[1:], np.diff(bounds))
    first = np.arange(n) // 64
    count = np.where(end - np.arange(n) > 1, (end - 1) // 64 - first + 1, 0)
    labels = np.arange(n)
    done = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(done, done[at] + ITEMS, "right")) - 1)
        query = np.repeat(np.arange(at, stop), count[at:stop])
        word = first[query] + np.arange(len(query)) - np.repeat(done[at:stop] - done[at], count[at:stop])
        at = stop
        low = np.maximum(query + 1 - 64 * word, 0)
        high = np.minimum(end[query] - 64 * word, 64)
        some = high > low
        query, word, low, high = query[some], word[some], low[some], high[some]
        lanes = (_ALL >> (64 - (high - low)).astype(np.uint64)) << low.astype(np.uint64)
        query, word, match = compared(planes, fps, query, word, lanes, radius)
        bits = np.unpackbits(match.view(np.uint8), bitorder="little").reshape(-1, 64)
        item, lane = np.nonzero(bits)
        a, b = query[item], 64 * word[item] + lane
        apart = labels[a] != labels[b]
        if apart.any():
            more = least_labels(n, np.concatenate([np.arange(n), a[apart]]), np.concatenate([labels, b[apart]]))
            labels = more
    linked = np.flatnonzero(labels != np.arange(n))
    return labels[linked], linked


def compared(planes: list, fps: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray,
             radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items (query, word) with the lanes that lie within ``radius``."""
    counts = [np.zeros(len(query), np.uint64) for _ in range(max(3, radius.bit_length()))]
    over = np.zeros(len(query), np.uint64)
    values = fps[query]
    for b in range(64):
        x = planes[b][word] ^ (np.uint64(0) - ((values >> np.uint64(b)) & np.uint64(1)))
        for i, c in enumerate(counts):
            counts[i], x = c ^ x, c & x
        over = over | x
        if b % 8 == 7:
            beyond = over | _exceeds(counts, radius)
            lanes = lanes & ~beyond
            alive = lanes != 0
            if not alive.all():
                query, word, values, lanes, over = query[alive], word[alive], values[alive], lanes[alive], over[alive]
                counts = [c[alive] for c in counts]
    return query, word, lanes


def _exceeds(counts: list, radius: int) -> np.ndarray:
    """Lanes whose counter, of bits from the lowest, is greater than ``radius``."""
    greater, equal = np.zeros_like(counts[0]), np.full_like(counts[0], _ALL)
    for i in reversed(range(len(counts))):
        if radius >> i & 1:
            equal = equal & counts[i]
        else:
            greater, equal = greater | (equal & counts[i]), equal & ~counts[i]
    return greater


def bucket_keys() -> list:
    """One expression per pair of blocks: the pair's number and the bits of ``fp`` in it."""
    starts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    cut = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in zip(starts, BLOCKS, strict=True)]
    out = []
    for n, chosen in enumerate(combinations(range(len(BLOCKS)), AGREE)):
        value = F.lit(n).cast("long")
        for i in chosen:
            value = F.shiftleft(value, BLOCKS[i]).bitwiseOR(cut[i])
        out.append(value)
    return out


def links(classes: DataFrame, radius: int = RADIUS, most: int = MOST, keys: Column | None = None) -> DataFrame:
    """Links ``(u, v)`` that join the classes ``(rep, fp)`` within ``radius``,
    of those that share one of ``keys``, by default the pairs of blocks."""
    rows = classes.select("rep", "fp", F.explode(F.array(*bucket_keys()) if keys is None else keys).alias("key"))
    by = ["key", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by):
            fps = t.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            a, b = near(fps, group_bounds(t, by), radius)
            reps = t.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(reps[b]), pa.array(reps[a])], names=["u", "v"])

    met = dealt(rows, ["key"], "fp", most).select("key", "cell", "rep", "fp")
    return mapped(met.repartition(*by).sortWithinPartitions(*by), run, "u long, v long")


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
               radius: int = RADIUS) -> DataFrame:
    """Rows ``(key, fp, component_id)``, one per row of ``docs``."""
    prints, outer = store(fingerprints(docs, key, text, width), "simhash"), work_dir(docs.sparkSession)
    with scratch(docs.sparkSession):
        classes = store(prints.groupBy("fp").agg(F.min(key).cast("long").alias("key")), "simhash-classes")
        found = connected(links(classes.select(F.col("fp").alias("rep"), "fp"), radius))
        joined = classes.join(found, classes["fp"] == found["node"], "left")
        joined = store(joined.select("fp", "key", F.coalesce("component", "fp").alias("root")), "simhash-roots")
        least = joined.groupBy("root").agg(F.min("key").alias("component_id"))
        labels = store(hot_join(joined, least, "root", "fp").select("fp", "component_id"), "simhash-labels", outer)
    return hot_join(prints, labels, "fp", key).select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """``docs`` with one row, that of least key, of each component; rows are
    numbered once, so repeated rows and rows without a key count one by one."""
    rows = store(docs.withColumn("__row", F.monotonically_increasing_id()), "simhash-rows")
    found = components(rows, "__row", text, width)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row"))
    kept = rows.select(key, "__row").join(found, "__row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(kept.select(F.col("first.row").alias("__row")), "__row", "left_semi").select(*docs.columns)


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
