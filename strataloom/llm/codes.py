"""Codes of vector parts, by Lloyd's rounds that are kept up by differences.

Components become integers, vectors are cut to equal parts, and each part
position has a codebook of a few entries. Vectors are packed to blocks once, in
a table bucketed by block. A round reads them beside the assignments of the
round before, bucketed alike, so that their join moves no row. Its tasks write
new assignments, and for each block what changed: the parts that came to an
entry less those that left it, as a count and integer sums. Only these few rows
are shuffled, and added to running sums on the driver, which hold one number a
codebook component whatever the number of vectors. A round that changes nothing
ends the rounds, as all later ones would repeat it.

All arithmetic is exact: sums and distances are integers, products below 2^53
are taken in doubles and larger ones in 64-bit integers.

Edge cases: rows whose vector is null or holds a null or non-finite component
are dropped, zero vectors are kept; ids null come last among those that begin
the codebooks, rows of equal id by their vector; with fewer rows than entries
the codebooks are shorter; repeated rows count each; null labels are one label;
an empty table gives an empty result; further columns are unread. Vectors of
unequal length, of a length that the number of parts doesn't divide, or with a
component over 16384 in size, whose squares could leave 64 bits, raise an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import _TABLE, hot_join, mapped, remove_path, scratch, slices, store, work_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and blocks of a bucket.
BLOCK, BUCKET = 2048, 64
LARGEST = 1 << 26


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def integers(vectors: list, parts: int, scale: int = SCALE) -> np.ndarray:
    """Vectors as integers, an array (vector, part, component)."""
    length = len(vectors[0])
    if length % parts or any(len(v) != length for v in vectors):
        raise ValueError(f"vectors must have one length, a multiple of {parts}")
    x = np.floor(np.array(vectors, np.float64) * scale)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST / scale}")
    return x.astype(np.int32).reshape(len(x), parts, -1)


def nearest(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The nearest entry of each part, the first of equals."""
    widest = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    kind = np.float64 if 3 * x.shape[2] * widest**2 < 1 << 53 else np.int64
    x, books = x.astype(kind), books.astype(kind)
    out = np.empty(x.shape[:2], np.uint8)
    for p in range(x.shape[1]):
        out[:, p] = ((books[p] ** 2).sum(1) - 2 * (x[:, p] @ books[p].T)).argmin(1)
    return out


def errors(x: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of vectors from their entries, summed over parts."""
    apart = x - books[np.arange(x.shape[1]), codes]
    return (apart * apart).sum((1, 2))


def changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Plus and minus contributions by (part, entry): counts and sums of the
    parts that came, less those that left."""
    entries = np.arange(k)
    sign = (after[:, :, None] == entries).astype(np.int64)
    if before is not None:
        sign -= before[:, :, None] == entries
    return sign.sum(0), np.einsum("npk,npw->pkw", sign, x.astype(np.int64))


def blocks(vectors: DataFrame, parts: int, width: int) -> DataFrame:
    """Rows ``(block, ids, labels, ints)`` of usable vectors ``(id, label, v)``; ``ints`` are packed 32-bit integers."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = TaskContext.get().partitionId() << 32, []
        kinds = None

        def block() -> pa.RecordBatch:
            nonlocal at, held
            ids, labels, ints = (sum((h[i] for h in held), []) for i in range(3))
            at, held = at + 1, []
            columns = [pa.array([at]), pa.array([ids], pa.list_(kinds[0])), pa.array([labels], pa.list_(kinds[1])), pa.array([b"".join(ints)])]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "labels", "ints"])

        for b in slices(batches, BLOCK):
            if not b.num_rows:
                continue
            kinds = (b.schema.field("id").type, b.schema.field("label").type)
            x = integers(b.column(2).to_pylist(), parts)
            if x[0].size != width:
                raise ValueError(f"vectors must have one length, {width}")
            held.append((b.column(0).to_pylist(), b.column(1).to_pylist(), [x.astype("<i4").tobytes()]))
            if sum(len(h[0]) for h in held) >= BLOCK:
                yield block()
        if held:
            yield block()

    return mapped(vectors.select("id", "label", "v"), run, f"block long, ids array<{kinds['id']}>, labels array<{kinds['label']}>, ints binary")


class Bucketed:
    """Tables in the folder of intermediate tables that are bucketed by block,
    so that joins among them need no shuffle; ``drop`` deletes one."""

    def __init__(self, spark, count: int):
        self.spark, self.count = spark, count

    def write(self, df: DataFrame) -> tuple[str, DataFrame]:
        name = f"strataloom_{uuid.uuid4().hex}"
        path = f"{work_dir(self.spark)}/{name}"
        df.write.options(**_TABLE).bucketBy(self.count, "block").option("path", path).saveAsTable(name)
        return name, self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, f"{work_dir(self.spark)}/{name}")


_ROUND = "block long, codes binary, deltas array<struct<part:int, entry:int, n:long, sums:array<long>>>"


def round_of(both: DataFrame, books: np.ndarray) -> DataFrame:
    """New assignments of each block, and its contributions; ``codes`` holds the assignments before, or null."""
    parts, k, w = books.shape
    schema = pa.schema([
        ("block", pa.int64()), ("codes", pa.binary()),
        ("deltas", pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            if not b.num_rows:
                continue
            block, ints, before = (c[0].as_py() for c in b.columns)
            x = np.frombuffer(ints, "<i4").reshape(-1, parts, w)
            old = None if before is None else np.frombuffer(before, np.uint8).reshape(-1, parts)
            codes = nearest(x, books)
            moved = np.arange(len(x)) if old is None else np.flatnonzero((codes != old).any(1))
            n, sums = changes(x[moved], None if old is None else old[moved], codes[moved], k)
            some = np.argwhere((n != 0) | (sums != 0).any(2)).tolist()
            deltas = [{"part": p, "entry": e, "n": int(n[p, e]), "sums": sums[p, e].tolist()} for p, e in some]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([block], [codes.tobytes()], [deltas]), schema.types, strict=True)], schema=schema)

    return mapped(both.select("block", "ints", "codes"), run, _ROUND)


def contributions(assigned: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All contributions of a round: one row a codebook component comes to the driver."""
    deltas = assigned.select(F.explode("deltas").alias("d")).select("d.part", "d.entry", "d.n", F.posexplode("d.sums").alias("at", "x"))
    rows = deltas.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    counts, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for r in rows:
        counts[r["part"], r["entry"]] = r["n"]
        sums[r["part"], r["entry"], r["at"]] = r["x"]
    return counts, sums


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows ``(id, label, code, error)`` of packed blocks, by final codebooks."""
    parts, _, w = books.shape
    kinds = {c: vectors.schema[f"{c}s"].dataType.elementType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            if not b.num_rows:
                continue
            x = np.frombuffer(b.column(2)[0].as_py(), "<i4").reshape(-1, parts, w)
            codes = nearest(x, books)
            digits = codes.tobytes().hex()
            text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            yield pa.RecordBatch.from_arrays([b.column(0).flatten(), b.column(1).flatten(), pa.array(text, pa.string()), pa.array(errors(x, books, codes))], names=["id", "label", "code", "error"])

    return mapped(vectors.select("ids", "labels", "ints"), run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes ``(id, label, code, error)`` of usable vectors ``(id, label, v)``, and the codebooks."""
    spark = rows.sparkSession
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    books = integers([r["v"] for r in first], parts).astype(np.int64).transpose(1, 0, 2)
    outer = work_dir(spark)
    with scratch(spark):
        tables = Bucketed(spark, max(8, ceil(rows.count() / (BLOCK * BUCKET))))
        name, vectors = tables.write(blocks(rows, parts, books[:, 0].size).repartition(tables.count, "block"))
        counts, sums, before = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64), None
        for _ in range(rounds):
            both = vectors.withColumn("codes", F.lit(None).cast("binary")) if before is None else vectors.join(before[1].select("block", "codes"), "block")
            now = tables.write(round_of(both, books))
            plus, more = contributions(now[1], books.shape)
            if before:
                tables.drop(before[0])
            before, counts, sums = now, counts + plus, sums + more
            used = counts > 0
            books = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], books)
            if not plus.any() and not more.any():
                break
        tables.drop(before[0])
        codes = store(coded(vectors, books), "vector-codes", outer)
        tables.drop(name)
    return codes, books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per usable vector: its code, its error, its label's error and the digest of all codebooks."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(finite(F.col("v")))
    codes, books = train(rows, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    codes = codes.withColumn("same", F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    sums = codes.groupBy("same").agg(F.sum("error").alias("label_error"))
    told = hot_join(codes, sums, "same", "id")
    return told.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
