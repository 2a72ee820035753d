"""One document of each group of near copies, by exact Jaccard similarity.

A document is the set of its word shingles' XXH64 hashes; documents of equal
sets are one class. Classes meet in ``BANDS`` tables of buckets, by ``ROWS``
minima of hashed sets each, and the SimHash fingerprints of a bucket are
compared bit-sliced within ``RADIUS`` bits, which leaves groups of candidates.
In each group classes of ``SIMILARITY`` or more, by their whole sets, are
linked, and linked classes are one component. A group of up to ``MOST`` classes
is compared pair by pair. A larger one is dealt to parts of as many: first each
part is compared within itself, then one class of each component that was found,
and at last the classes outside the group's largest component with all classes
of every part. So no pair of different components is left out, while pairs
within the large component, as in thousands of copies of one text, are not all
compared, and their texts are sent once and not to pairs of parts.

A pair of similarity s meets with chance ``1 - (1 - s ** ROWS) ** BANDS``, 0.998
at 0.8; what meets is never linked below ``SIMILARITY``, up to equal hashes.

Edge cases: a null text has no words; texts without words are one class; a text
of fewer words than a shingle is one shingle; rows are numbered once, so of
repeated rows, and of rows without an id, one a component is kept like any
other, an id before none; all shingles of a text of any length count; further
columns stay as they are, but must not be named ``__row``, ``__rep``, ``__fp``
or ``__keys``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm import simhash
from strataloom.llm.common import connected, group_bounds, least_labels, mapped, scratch, slices, store, text_bytes, whole_groups, work_dir

SIMILARITY = 0.8
SHINGLE = 5
BANDS = 12
ROWS = 4
#: Bits that fingerprints of candidates differ in at most; at similarity 0.8 about 10 of 64 do.
RADIUS = 20
#: Classes, and bytes of text, of a part of a group of candidates.
MOST, PART_BYTES = 1024, 16 << 20
_RANDOM = np.random.default_rng(simhash.SEED)
_HASHED = _RANDOM.integers(1, 1 << 63, (BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_MIXED = _RANDOM.integers(1, 1 << 63, ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words of a text."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(text, simhash.SEED)], np.uint64)
    starts, digest = [0, *[e + 1 for e in ends[:-width]]], xxhash.xxh64_intdigest
    return np.unique(np.array([digest(text[a:b], simhash.SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64))


def described(found: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Number of a set's class, its fingerprint and its bucket keys."""
    ones, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(found), 4096):
        part = found[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        np.minimum(least, (part * _HASHED).min(1), out=least)
    major = np.packbits((2 * ones > len(found)).astype(np.uint8), bitorder="little").view(np.int64)[0]
    keys = (least.reshape(BANDS, ROWS) * _MIXED).sum(1, dtype=np.uint64) * np.uint64(31) + np.arange(BANDS, dtype=np.uint64)
    rep = xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED)
    return int(np.uint64(rep).view(np.int64)), int(major), keys.view(np.int64)


def alike(sets: list[np.ndarray], similarity: float = SIMILARITY, asking: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of sets of Jaccard ``similarity`` or more, reduced to
    links that keep the components of all such pairs; with ``asking``, of the
    pairs in which one set is asking and the other is not."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    labels, ends = np.arange(n), np.cumsum(sizes)
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(distinct), np.int64)
    for i in range(n) if asking is None else np.flatnonzero(asking).tolist():
        others = np.arange(i + 1, n) if asking is None else np.flatnonzero(~asking)
        fit = (labels[others] != labels[i]) & (np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]))
        fit &= sizes[others] > 0
        others = others[fit]
        if not len(others):
            continue
        own[ids[ends[i] - sizes[i] : ends[i]]] = 1
        first = ends[others[0]] - sizes[others[0]]
        seen = np.concatenate([[0], np.cumsum(own[ids[first : ends[others[-1]]]])])
        common = seen[ends[others] - first] - seen[ends[others] - sizes[others] - first]
        own[ids[ends[i] - sizes[i] : ends[i]]] = 0
        near = others[common >= similarity * (sizes[i] + sizes[others] - common) - 1e-9]
        if len(near):
            labels = least_labels(n, np.concatenate([np.arange(n), np.full(len(near), i)]), np.concatenate([labels, near]))
    moved = np.flatnonzero(labels != np.arange(n))
    return labels[moved], moved


def numbered(docs: DataFrame, text: str, width: int) -> DataFrame:
    """``docs`` with the number of each row and what ``described`` tells of it, written once."""
    names = [*docs.columns, "__row", "__rep", "__fp", "__keys"]
    source = docs.select("*", F.monotonically_increasing_id().alias("__row"), docs[text].alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            told = [described(shingles(t or b"", width)) for t in text_bytes(batch.column(batch.num_columns - 1))]
            more = [pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.int64()), pa.array([x[2] for x in told], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + more, names=names)

    return store(mapped(source, run, schema + ", __rep long, __fp long, __keys array<long>"), "near-rows")


def compared(members: DataFrame, rows: DataFrame, text: str, width: int, similarity: float) -> DataFrame:
    """Links ``(u, v)`` between the classes ``(rep, row)`` of each ``(component,
    part)``; where some are ``asking``, between those and the others."""
    by = ["component", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by, 256):
            reps, bounds, texts = t.column("rep").to_numpy(), group_bounds(t, by), t.column("text")
            asking = t.column("asking").to_numpy(zero_copy_only=False)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                own = texts.slice(a, b - a).cast(pa.binary()).to_pylist()
                some = asking[a:b]
                u, v = alike([shingles(x or b"", width) for x in own], similarity, some if some.any() else None)
                yield pa.RecordBatch.from_arrays([pa.array(reps[a:b][u]), pa.array(reps[a:b][v])], names=["u", "v"])

    # Members grow with the documents, so they are not broadcast at any size.
    met = members.hint("merge").join(rows.select(F.col("__row").alias("row"), F.col(text).alias("text")), "row").select(*by, "rep", "asking", "text")
    return mapped(met.repartition(*by).sortWithinPartitions(*by), run, "u long, v long")


def in_parts(members: DataFrame, most: int) -> DataFrame:
    """Members ``(component, rep, row, bytes)`` with the ``part`` of their group and the number of its ``parts``."""
    needed = F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("bytes") / PART_BYTES)).cast("int")
    # One row for ``most`` members or ``PART_BYTES`` at least, so the list may be broadcast.
    large = F.broadcast(members.groupBy("component").agg(needed.alias("__parts")).filter("__parts > 1"))
    parts = F.coalesce("__parts", F.lit(1)).alias("parts")
    joined = members.join(large, "component", "left").select("component", "rep", "row", "bytes", parts)
    return joined.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))


def confirmed(members: DataFrame, rows: DataFrame, text: str, width: int, similarity: float, most: int) -> DataFrame:
    """Links ``(u, v)`` between the classes ``(rep, row, bytes)`` of each candidate
    ``component`` that join all pairs of ``similarity`` or more."""
    asked = F.lit(False).alias("asking")
    dealt = store(in_parts(members, most), "near-parts")
    links = store(compared(dealt.select("*", asked), rows, text, width, similarity), "near-links")
    large = dealt.filter("parts > 1")
    if large.isEmpty():
        return links
    # One class of each component that a part has, and again in parts if there are many.
    first = rooted(large, links).filter("rep = root").select("component", "rep", "row", "bytes")
    more = store(compared(in_parts(first, most).select("*", asked), rows, text, width, similarity), "near-links")
    links = links.unionByName(more)
    # Classes outside the largest component of their group ask those of every part.
    now = store(rooted(large, links), "near-roots")
    sizes = now.groupBy("component", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("component").agg(F.max(F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    open_ = now.join(main.filter("roots > 1").select("component", F.col("main.root").alias("main")), "component")
    outside = F.col("root") != F.col("main")
    every = open_.select("component", "rep", "row", "part", asked)
    asks = open_.filter(outside).select("component", "rep", "row", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asking"))
    return links.unionByName(compared(every.unionByName(asks), rows, text, width, similarity))


def rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members with the ``root``, the least class that they are connected with."""
    found = connected(links).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    return members.join(found, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = SHINGLE,
             similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """``docs`` with one row, that of least key, of each component."""
    rows, outer = numbered(docs, text, width), work_dir(docs.sparkSession)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("__row").alias("row"))
    with scratch(docs.sparkSession):
        classes = rows.groupBy(F.col("__rep").alias("rep")).agg(F.min("__fp").alias("fp"), F.min("__keys").alias("keys"), F.min(order).alias("first"), F.max(F.octet_length(text)).alias("bytes"))
        classes = store(classes, "near-classes")
        groups = connected(simhash.links(classes, RADIUS, keys=F.col("keys")))
        groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
        members = store(groups.join(classes, F.col("node") == F.col("rep")).select("component", "rep", F.col("first.row").alias("row"), "bytes"), "near-members")
        found = connected(confirmed(members, rows, text, width, similarity, most))
        one = classes.join(found, F.col("rep") == F.col("node"), "left").groupBy(F.coalesce("component", "rep").alias("component"))
        kept = store(one.agg(F.min("first").alias("first")).select(F.col("first.row").alias("__row")), "near-kept", outer)
    return rows.join(kept.hint("merge"), "__row", "left_semi").select(*docs.columns)
