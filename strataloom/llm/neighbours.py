"""Nearest neighbours by largest inner product, over learned partitions.

The index is fitted on a sample of vectors, of bounded size: tasks make the
sample's neighbour graph by exact products, which is cut into balanced parts by
repeated bisection (an order from the slowest mode of a random walk, halved,
then swaps of nodes that lower the cut). A small network with one hidden layer
learns where the neighbours of a vector lie, as shares of the parts. It places
every vector of the table in its likeliest part, and sends a query to its
likeliest parts until their shares reach a mass. That mass is read from queries
of the sample that the network did not learn from, such that ``TARGET`` of
their true neighbours are in a part that they visit. Vectors of visited parts
are ranked by exact products in double precision.

Equal vectors are one class with its smallest ids, as many as a query can
return and one more for its own, so a common vector costs one row. Parts are
dealt to blocks of bounded rows; a task holds one block, and queries stream by.
Queries are routed as classes, too.

The number of parts follows the vectors, one for about ``PART_ROWS``, from 8 to
1,024 (all are one below 256); beyond two million vectors parts grow, and with them the work of a query.

Edge cases: vectors that are null, zero or hold a null or non-finite component
take no part; vectors of another length than most are searched whole, among
those of their own length; a row without an id is no query, and a candidate of
an id larger than any; rows of equal id are apart, each query row searches; ties
go to the smaller id, then to the row read first; repeated rows are neighbours
of each other; with fewer candidates all are returned; an empty table gives an
empty result; further columns are unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.llm.common import discard, hot_join, mapped, scratch, slices, store, work_dir
from strataloom.llm.embeddings import usable

NEAREST = 20
#: Vectors of a part, least and most parts, vectors of a block.
PART_ROWS, LEAST_PARTS, MOST_PARTS, BLOCK = 2048, 8, 1024, 4096
#: Vectors a part below which all are one part.
LEAST_ROWS = 32
#: Vectors of the sample: so many a part, and at least so many in all.
SAMPLE_A_PART, LEAST_SAMPLE = 64, 16_384
#: Neighbours in the graph; share of neighbours of fresh queries that must lie in visited parts.
DEGREE, TARGET = 20, 0.95
HIDDEN, EPOCHS, SEED = 128, 12, 11


@dataclass
class Router:
    """Places vectors of length ``d`` in parts; ``weights`` of a network with one hidden layer."""

    d: int
    parts: int
    scale: float = 1.0
    weights: tuple[np.ndarray, ...] = ()
    mass: float = 1.0

    def shares(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.ones((len(x), 1))
        return _shares(_hidden(x / self.scale, self.weights), self.weights)

    def part(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x).argmax(1)

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (vector, part), of each vector's likeliest parts up to the mass."""
        shares = self.shares(x)
        order = np.argsort(-shares, 1, kind="stable")
        return _where(order, _before(shares, order) < self.mass)


def _where(order: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wanted[:, 0] = True
    rows, at = np.nonzero(wanted)
    return rows, order[rows, at]


def _before(shares: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The mass of the parts that are likelier than each part, in ``order``."""
    sorted_shares = np.take_along_axis(shares, order, 1)
    return np.cumsum(sorted_shares, 1) - sorted_shares


def _hidden(x: np.ndarray, w: tuple) -> np.ndarray:
    return np.maximum(x @ w[0] + w[1], 0)


def _shares(hidden: np.ndarray, w: tuple) -> np.ndarray:
    z = hidden @ w[2] + w[3]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def bisect(u: np.ndarray, v: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Two sides of a graph of nodes below ``n``, of equal size give or take
    one, with few edges across; each edge is given in both directions."""
    degree = np.bincount(u, minlength=n) + 1e-9
    x = rng.standard_normal(n)
    for _ in range(60):
        x = (x + np.bincount(u, x[v], n) / degree) / 2
        x -= (x * degree).sum() / degree.sum()
        x /= np.sqrt((x * x).sum()) or 1
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[n // 2 :]] = True
    best, least = side, np.inf
    for _ in range(40):
        cut = (side[u] != side[v]).sum()
        if cut >= least:
            break
        best, least = side, cut
        sign = np.where(side, 1, -1)
        gain = -sign * np.bincount(u, sign[v], n)
        a, b = (np.flatnonzero(side == s) for s in (True, False))
        a, b = (s[np.argsort(-gain[s], kind="stable")][: n // 2] for s in (a, b))
        good = int((gain[a] + gain[b] > 0).sum())
        if not good:
            break
        side = side.copy()
        half = (good + 1) // 2
        side[a[:half]], side[b[:half]] = False, True
    return best


def balanced(near: np.ndarray, parts: int) -> np.ndarray:
    """A part, below ``parts`` (a power of two), of each node of a neighbour
    graph; their sizes differ by few. ``near`` holds a row of nodes a node."""
    n = len(near)
    u, v = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    label, rng = np.zeros(n, np.int64), np.random.default_rng(SEED)
    for _ in range(int(log2(parts))):
        inside = label[u] == label[v]
        u, v = u[inside], v[inside]
        order = np.argsort(label[u], kind="stable")
        u, v = u[order], v[order]
        ends = np.searchsorted(label[u], np.arange(label.max() + 2))
        following = label * 2
        place = np.empty(n, np.int64)
        for p in range(label.max() + 1):
            own = np.flatnonzero(label == p)
            place[own] = np.arange(len(own))
            a, b = ends[p], ends[p + 1]
            following[own] += bisect(place[u[a:b]], place[v[a:b]], len(own), rng)
        label = following
    return label


def learn(x: np.ndarray, targets: np.ndarray, epochs: int = EPOCHS, hidden: int = HIDDEN) -> tuple[np.ndarray, ...]:
    """Weights of a network that gives shares of parts (rows of ``targets``), by Adam on cross entropy."""
    rng = np.random.default_rng(SEED)
    d, parts = x.shape[1], targets.shape[1]
    w = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal((hidden, parts)) / np.sqrt(hidden), np.zeros(parts)]
    mean, square, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = _hidden(x[at], w)
            wrong = (_shares(h, w) - targets[at]) / len(at)
            back = (wrong @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[at].T @ back, back.sum(0), h.T @ wrong, wrong.sum(0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                step = mean[i] / (1 - 0.9**t) / (np.sqrt(square[i] / (1 - 0.99**t)) + 1e-9)
                w[i] = w[i] - 0.01 * 0.75**epoch * step
    return tuple(w)


def graph(spark: SparkSession, x: np.ndarray, degree: int) -> np.ndarray:
    """The nearest others of each vector of the sample, made in tasks from a broadcast of the sample."""
    shared = spark.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            own = b.column(0).to_numpy()
            products = x_of(shared)[own] @ x_of(shared).T
            products[np.arange(len(own)), own] = -np.inf
            top = np.argpartition(-products, degree - 1, 1)[:, :degree]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(products, top, 1), 1), 1)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(top.tolist(), pa.list_(pa.int32()))], names=["id", "near"])

    found = mapped(spark.range(0, len(x), 1, max(1, len(x) // 2048)), run, "id long, near array<int>").toArrow()
    shared.unpersist()
    near = np.empty((len(x), degree), np.int64)
    near[found.column("id").to_numpy()] = np.array(found.column("near").to_pylist())
    return near


def x_of(shared) -> np.ndarray:
    return shared.value


def parts_for(n: int, rows: int = PART_ROWS) -> int:
    """A power of two."""
    return min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, round(log2(max(n, 1) / rows)))))


def fit(classes: DataFrame, n: int, d: int, rows: int = PART_ROWS, target: float = TARGET, least: int = LEAST_SAMPLE) -> Router:
    """A router learned from a sample of ``n`` classes: about ``SAMPLE_A_PART``
    a part and ``least`` in all, chosen by a hash of the vector."""
    parts = parts_for(n, rows)
    if n < LEAST_ROWS * parts:
        return Router(d, 1)
    wanted = min(1.0, max(SAMPLE_A_PART * parts, least) / n)
    some = classes.filter((F.size("v") == d) & (F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(wanted * (1 << 20))))
    x = np.array(some.select("v").toArrow().column("v").to_pylist(), np.float64)
    x = x[np.lexsort(x.T[::-1])]
    scale = float(np.sqrt((x * x).sum(1).mean()))
    if len(x) < LEAST_ROWS * parts // 2 or not np.isfinite(scale) or not scale:
        return Router(d, 1)
    degree = min(DEGREE, len(x) - 1)
    near = graph(classes.sparkSession, x, degree)
    label = balanced(near, parts)
    targets = np.zeros((len(x), parts))
    for j in range(degree):
        targets[np.arange(len(x)), label[near[:, j]]] += 1
    targets[np.arange(len(x)), label] += 1
    fresh = np.random.default_rng(SEED).random(len(x)) < 0.125
    router = Router(d, parts, scale, learn(x[~fresh] / scale, targets[~fresh] / (degree + 1)))
    shares = router.shares(x)
    order = np.argsort(-shares, 1, kind="stable")
    before = np.empty_like(shares)
    np.put_along_axis(before, order, _before(shares, order), 1)
    own = shares.argmax(1)
    asked = np.flatnonzero(fresh)
    needed = before[asked[:, None], own[near[asked]]].ravel()
    # A part is visited where the mass of likelier ones is below the limit.
    router.mass = float(np.nextafter(np.quantile(needed, target, method="higher"), 2)) if len(needed) else 1.0
    return router


def _split(vectors: list, d: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    sizes = np.array([len(v) for v in vectors])
    return np.flatnonzero(sizes == d), {int(s): np.flatnonzero(sizes == s) for s in np.unique(sizes) if s != d}


def placed(classes: DataFrame, router: Router, blocks: dict[int, int] | None = None) -> DataFrame:
    """Classes with their part, and with a block of it where ``blocks`` of each
    part are known; else parts alone. Other lengths have a negative part each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            vectors = b.column("v").to_pylist()
            part = np.zeros(len(vectors), np.int32)
            usual, others = _split(vectors, router.d)
            if len(usual):
                part[usual] = router.part(np.array([vectors[i] for i in usual], np.float64))
            for size, rows in others.items():
                part[rows] = -size
            if blocks is None:
                yield pa.RecordBatch.from_arrays([pa.array(part)], names=["part"])
                continue
            block = b.column("cls").to_numpy() % np.array([blocks[p] for p in part.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(block.astype(np.int32)), b.column("v"), b.column("rows")], names=["part", "block", "v", "rows"])

    kind = classes.schema["v"].dataType.simpleString()
    if blocks is None:
        return mapped(classes.select("v"), run, "part int")
    rows = classes.schema["rows"].dataType.simpleString()
    return mapped(classes.select("cls", "v", "rows"), run, f"part int, block int, v {kind}, rows {rows}")


def routed(queries: DataFrame, router: Router, blocks: dict[int, int]) -> DataFrame:
    """A row per query class and block that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            vectors = b.column("v").to_pylist()
            usual, others = _split(vectors, router.d)
            visits = []
            if len(usual):
                rows, parts = router.visits(np.array([vectors[i] for i in usual], np.float64))
                visits += zip(usual[rows].tolist(), parts.tolist(), strict=True)
            visits += [(i, -size) for size, rows in others.items() for i in rows.tolist()]
            told = [(i, p, k) for i, p in visits for k in range(blocks.get(p, 0))]
            for at in range(0, len(told), 4096):
                row, part, block = zip(*told[at : at + 4096], strict=True)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int32()), b.column("query").take(row), b.column("v").take(row)], names=["part", "block", "query", "v"])

    kind = queries.schema["v"].dataType.simpleString()
    return mapped(queries.select("query", "v"), run, f"part int, block int, query long, v {kind}")


def best(queries: np.ndarray, block: np.ndarray, rows: list, most: int) -> list[list[dict]]:
    """The ``most`` best rows of a block for each query, by exact products."""
    rough = queries @ block.T
    k = min(most, len(block))
    least = np.partition(rough, len(block) - k, 1)[:, len(block) - k]
    slack = 1e-9 * np.sqrt((queries * queries).sum(1)) * np.sqrt((block * block).sum(1).max())
    out = []
    for q, row, limit in zip(queries, rough, least - slack, strict=True):
        some = np.flatnonzero(row >= limit)
        exact = (block[some] * q).sum(1)
        hits = [(0.0 - s, r["none"], r["id"] or 0, r["row"], r["id"]) for s, i in zip(exact.tolist(), some.tolist(), strict=True) for r in rows[i]]
        hits.sort()
        out.append([{"neg": s, "none": none, "id": i, "row": r} for s, none, _, r, i in hits[:most]])
    return out


_HITS = pa.list_(pa.struct([("neg", pa.float64()), ("none", pa.bool_()), ("id", pa.int64()), ("row", pa.int64())]))


def ranked(index: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """``(query, hits)`` of each query and block; a task holds one block and 256 queries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vectors, rows, matrix, waiting = None, [], [], None, []

        def answer() -> pa.RecordBatch:
            nonlocal matrix, waiting
            if matrix is None:
                matrix = np.array(vectors, np.float64)
            hits = best(np.array([v for _, v in waiting], np.float64), matrix, rows, most)
            made = pa.RecordBatch.from_arrays([pa.array([q for q, _ in waiting], pa.int64()), pa.array(hits, _HITS)], names=["query", "hits"])
            waiting = []
            return made

        for b in slices(batches, 256):
            for part, block, query, v, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (part, block) != key:
                    if waiting and vectors:
                        yield answer()
                    key, vectors, rows, matrix, waiting = (part, block), [], [], None, []
                if query is None:
                    vectors.append(v)
                    rows.append(own)
                    continue
                waiting.append((query, v))
                if len(waiting) == 256 and vectors:
                    yield answer()
        if waiting and vectors:
            yield answer()

    none = F.lit(None).cast(index.schema["rows"].dataType)
    both = index.select("part", "block", F.lit(None).cast("long").alias("query"), "v", "rows").unionByName(asked.select("part", "block", "query", "v", none.alias("rows")))
    both = both.repartition("part", "block").sortWithinPartitions("part", "block", F.col("query").asc_nulls_first())
    return mapped(both, run, "query long, hits array<struct<neg:double,none:boolean,id:long,row:long>>")


def nearest(vectors: DataFrame, every: int = 20, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding",
            rows_a_part: int = PART_ROWS, target: float = TARGET) -> DataFrame:
    """Rows ``(query_id, rank, vec_id, score)``: the ``k`` nearest of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    outer = work_dir(spark)
    with scratch(spark):
        rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.coalesce(usable(F.col(vector)), F.lit(False)))
        rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
        place = F.row_number().over(Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last(), "row"))
        few = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
        classes = few.groupBy("v").agg(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("rows"))
        classes = store(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
        asking = store(rows.filter(F.col("id") % every == 0), "query-rows")
        discard(rows)
        queries = store(asking.select("v").distinct().withColumn("query", F.monotonically_increasing_id()), "queries")
        usual = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        router = fit(classes, usual["count"], usual["d"], rows_a_part, target) if usual else Router(0, 1)
        sizes = placed(classes, router).groupBy("part").count().collect()  # a row a part
        blocks = {r["part"]: ceil(r["count"] / BLOCK) for r in sizes}
        hits = store(ranked(placed(classes, router, blocks), routed(queries, router, blocks), k + 1), "hits")
        whole = F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k + 1)
        told = hits.groupBy("query").agg(whole.alias("hits")).join(queries, "query")
        told = store(told.select("v", "hits"), "neighbours", outer)
        asking = store(asking, "query-rows", outer)
    found = hot_join(asking, told, "v", "row")
    others = F.slice(F.filter("hits", lambda h: h["row"] != F.col("row")), 1, k)
    out = found.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), (F.lit(0.0) - F.col("hit.neg")).alias("score"))
