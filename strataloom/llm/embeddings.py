"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosines.

Equal vectors form one class first, with its number of rows. Normalised class
vectors are projected on Gaussian directions and quantised; ``k`` quantised
projections make a bucket key, and several tables of keys make it likely that
near vectors share a bucket. ``k`` follows the number of classes, so that a
bucket holds about ``EXPECTED`` unrelated vectors, and the number of tables
follows ``k``, so that a pair at the threshold is missed with chance ``MISS``
at most. In each bucket all cosines are computed in double precision, block by
block; a pair is counted in the first table in which it meets only, for which
the keys of linked vectors are derived again. Buckets emit counts and a star
per local component, never pairs.

A vector goes to each table once, with nothing but its number and weight: 12
tables up to 100,000 classes, 30 at 10^6, 73 at 10^7, 420 at 10^9.

Edge cases: a vector that is null, zero, or holds a null or non-finite
component links with nothing; vectors of unequal length never link; repeated
rows are links of each other; a row without an id links like any other, and
a component without any id has a null ``component_id`` and one kept row; an
empty table gives an empty result; further columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import connected, dealt, group_bounds, hot_join, least_labels, mapped, scratch, slices, store, whole_groups, work_dir

THRESHOLD = 0.9
WIDTH = 1.0
EXPECTED = 2048
MISS = 0.03
SEED = 7
#: Classes of a bucket that one part of a cell holds.
MOST = 2048


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised projection agrees at this distance."""
    r = width / distance
    return erf(r / sqrt(2)) - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Projections per key and number of tables for ``n`` vectors."""
    near, far = collision(sqrt(2 - 2 * threshold)), collision(sqrt(2))
    k = max(3, ceil(log(max(n, EXPECTED) / EXPECTED) / log(1 / far)))
    return k, ceil(log(MISS) / log(1 - near**k))


def usable(vector: Column) -> Column:
    def good(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return vector.isNotNull() & F.forall(vector, good) & F.exists(vector, lambda x: x != 0)


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@lru_cache(maxsize=4)
def directions(d: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Random lines and shifts; fewer of them are the first of more."""
    lines = np.random.default_rng((SEED, d)).standard_normal((count, d))
    return lines.T.copy(), np.random.default_rng((SEED, d, 1)).uniform(0, WIDTH, count)


def bucket_keys(vectors: np.ndarray, k: int, tables: int) -> np.ndarray:
    """A key per normalised vector and table, the same wherever it is derived."""
    lines, shifts = directions(vectors.shape[1], tables * k)
    mixed = np.random.default_rng(SEED + 1).integers(1, 1 << 62, k) | 1
    cells = np.floor((vectors @ lines + shifts) / WIDTH).astype(np.int64)
    with np.errstate(over="ignore"):
        return (cells.reshape(-1, tables, k) * mixed).sum(2) * 31 + vectors.shape[1]


def keyed(classes: DataFrame, k: int, tables: int, whole: bool = True) -> DataFrame:
    """A row per class and table: ``table``, ``key``, and if ``whole`` the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            vectors = batch.column(2).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            keys = np.zeros((len(vectors), tables), np.int64)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                keys[own] = bucket_keys(unit([vectors[i] for i in own]), k, tables)
            for t in range(tables):
                columns = [pa.array(np.full(len(vectors), t, np.int32)), pa.array(keys[:, t])]
                yield pa.RecordBatch.from_arrays(columns + batch.columns * whole, names=["table", "key"] + ["rep", "w", "v"] * whole)

    kind = classes.schema["v"].dataType.simpleString()
    return mapped(classes.select("rep", "w", "v"), run, "table int, key long" + f", rep long, w long, v {kind}" * whole)


def bucket_links(vectors: np.ndarray, k: int, table: int, parts: np.ndarray, weights: np.ndarray,
                 threshold: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links of each vector of one cell (rows of the other class count each)
    and the least position of its local component."""
    n = len(vectors)
    found, labels = np.zeros(n, np.int64), np.arange(n)
    keys, known = np.zeros((n, table), np.int64), np.zeros(n, bool)
    across = len(np.unique(parts)) > 1
    for i in range(0, n, block):
        for j in range(i, n, block):
            a, b = np.nonzero(vectors[i : i + block] @ vectors[j : j + block].T >= threshold - 1e-9)
            a, b = a + i, b + j
            keep = a < b
            if across:  # pairs of one part meet in the part's own cell
                keep &= parts[a] != parts[b]
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            exact = (vectors[a] * vectors[b]).sum(1) >= threshold
            a, b = a[exact], b[exact]
            if table and len(a):
                fresh = np.unique(np.concatenate([a, b]))
                fresh = fresh[~known[fresh]]
                if len(fresh):
                    keys[fresh], known[fresh] = bucket_keys(vectors[fresh], k, table), True
                new = np.ones(len(a), bool)
                for t in range(table):
                    new &= keys[a, t] != keys[b, t]
                a, b = a[new], b[new]
            found += np.bincount(a, weights[b], n).astype(np.int64) + np.bincount(b, weights[a], n).astype(np.int64)
            apart = labels[a] != labels[b]
            if apart.any():
                labels = least_labels(n, np.concatenate([np.arange(n), a[apart]]), np.concatenate([labels, b[apart]]))
    return found, labels


def linked(classes: DataFrame, threshold: float = THRESHOLD, most: int = MOST) -> DataFrame:
    """Rows ``(rep, n, root)``: ``n`` links found in one cell, and a class that
    ``rep`` is connected with."""
    k, tables = plan(classes.count(), threshold)
    by = ["table", "key", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by, 4096):
            bounds = group_bounds(t, by)
            table, reps, weights, parts = (t.column(c).to_numpy() for c in ("table", "rep", "w", "part"))
            out = [[], [], []]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a < 2:
                    continue
                vectors = t.column("v").slice(a, b - a).to_pylist()
                sizes = {len(v) for v in vectors}
                if len(sizes) > 1:  # a chance clash of keys between lengths; each length is compared alone
                    groups = [np.flatnonzero([len(v) == s for v in vectors]) for s in sizes]
                else:
                    groups = [np.arange(b - a)]
                for g in groups:
                    n, labels = bucket_links(unit([vectors[i] for i in g]), k, int(table[a]), parts[a:b][g], weights[a:b][g].astype(float), threshold)
                    some = np.flatnonzero(n)
                    out[0].append(reps[a:b][g][some])
                    out[1].append(n[some])
                    out[2].append(reps[a:b][g][labels[some]])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["rep", "n", "root"])

    met = dealt(keyed(classes, k, tables), ["table", "key"], "rep", most, keyed(classes, k, tables, False))
    met = met.select(*by, "part", "rep", "w", "v").repartition(*by).sortWithinPartitions(*by)
    return mapped(met, run, "rep long, n long, root long")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """Rows ``(key, n_links, component_id, kept)``, one per row of ``vectors``."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).withColumn("ok", F.coalesce(usable(F.col("v")), F.lit(False)))
    rows = store(rows.withColumn("v", F.when(F.col("ok"), F.col("v"))).withColumn("row", F.monotonically_increasing_id()), "vectors")
    outer = work_dir(vectors.sparkSession)
    with scratch(vectors.sparkSession):
        first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").cast("long").alias("id"), "row")).alias("first")
        classes = rows.filter("ok").groupBy("v").agg(first, F.count(F.lit(1)).alias("w"))
        classes = store(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
        found = store(linked(classes, threshold), "vector-links")
        labels = connected(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
        sums = found.groupBy("rep").agg(F.sum("n").alias("n"))
        told = (
            classes.join(sums, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
            .select("v", "rep", "first", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"), F.coalesce("component", "rep").alias("root"))
        )
        told = store(told, "vector-roots")
        least = told.groupBy("root").agg(F.min("first").alias("least"))
        told = store(hot_join(told, least, "root", "rep").select("v", "n", "least"), "vector-labels", outer)
    joined = hot_join(rows.filter("ok"), told, "v", "row")
    component = F.col("least.id")
    kept = F.when(F.col("least.none"), F.col("row") == F.col("least.row")).otherwise(F.coalesce(F.col("id") == component, F.lit(False)))
    names = (key, "n_links", "component_id", "kept")
    linked_rows = joined.select("id", F.col("n").cast("long"), component, kept).toDF(*names)
    others = rows.filter(~F.col("ok")).select("id", F.lit(0).cast("long"), F.col("id").cast("long"), F.lit(True)).toDF(*names)
    return linked_rows.unionByName(others)
