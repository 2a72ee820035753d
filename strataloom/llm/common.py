"""Shared helpers of the training-data operators: durable tables, Arrow
mapping, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; ``bytes.split()`` uses this set.
WORD_SPACE = b" \t\n\x0b\x0c\r"
#: Rows, and about bytes, that one Arrow slice hands to Python code at a time.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20
#: Rows of one key that a join takes to one task; more are dealt to several.
HOT_ROWS = 200_000
#: Prefix of every intermediate table; see ``clean``.
PREFIX = "strataloom-"

#: How intermediate tables are written. In a local or mounted folder they get no
#: checksum files, which would double the files and the processes that set their
#: modes; other file systems don't know the setting.
_TABLE = {
    "compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true",
}

_own_dirs: dict[str, str] = {}
_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's setting.

    Where the setting is missing a session on one machine, as in tests, gets a
    temporary folder; a cluster must name a folder that all its nodes reach.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_dirs.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="shared-"))


def work_dir(spark: SparkSession) -> str:
    """Where intermediate tables go: the folder of the innermost ``scratch``, or the shared one."""
    return _scratch[-1] if _scratch else shared_dir(spark)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for all intermediate tables that are made
    inside the block; it is deleted at the end, so results must be written by then."""
    path = f"{shared_dir(spark)}/{PREFIX}run-{uuid.uuid4().hex}"
    _scratch.append(path)
    try:
        yield path
    finally:
        _scratch.remove(path)
        remove_path(spark, path)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def store(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back.

    The table cuts the lineage: what follows can be recomputed from files that
    outlive any executor. Shuffle files of the write go when it ends.
    The table is in ``folder``, by default ``work_dir``, until ``discard``
    removes it or its ``scratch`` ends.
    """
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{PREFIX}{name}-{uuid.uuid4().hex}"
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.options(**_TABLE).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``store``."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            remove_path(table.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables and archives in the shared folder.

    Results are lazy and may read such tables, so they are kept until this is
    called: after the results were written, with no operator running.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{PREFIX}*")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in system.globStatus(where) or []:
        system.delete(found.getPath(), True)


def mapped(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name, None) is None:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by rows and bytes, so that Python holds few texts at a time."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, null as None."""
    return column.cast(pa.binary()).to_pylist()


def dealt(rows: DataFrame, key: list[str], spread: str, most: int, counted: DataFrame | None = None) -> DataFrame:
    """Rows with ``part`` and ``cell``, such that rows of a key meet in cells.

    A key with up to ``most`` rows is one cell. A larger one is dealt by hash
    of ``spread`` to parts of about ``most`` rows, and each row goes to every
    cell (pair of parts) that its part belongs to, so every two rows of the key
    meet and no cell holds more than about ``2 * most`` rows. Only sizes of
    large keys are joined back, one row a key; ``counted`` has the same keys as
    ``rows`` where those are cheaper to make.
    """
    large = (rows if counted is None else counted).groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    large = large.select(*key, F.ceil(F.col("__n") / most).cast("int").alias("__parts"))
    joined = rows.join(large, key, "left")
    part = F.pmod(F.xxhash64(spread), F.col("__parts")).cast("int")
    joined = joined.withColumn("part", F.coalesce(part, F.lit(0)))
    others = F.transform(
        F.sequence(F.lit(0), F.col("__parts") - 1),
        lambda j: F.least("part", j) * F.col("__parts") + F.greatest("part", j),
    )
    cells = F.coalesce(others, F.array(F.lit(0)))
    return joined.withColumn("cell", F.explode(cells)).drop("__parts")


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Regroup sorted batches to tables of about ``rows`` rows or more that end
    where a group (equal values of ``by``) ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        change = _changes(table, by)
        if len(change):
            cut = int(change[-1])
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _changes(table: pa.Table, by: list[str]) -> np.ndarray:
    differs = np.zeros(table.num_rows - 1, bool)
    for c in by:
        x = table.column(c).to_numpy()
        differs |= x[1:] != x[:-1]
    return np.flatnonzero(differs) + 1


def group_bounds(table: pa.Table, by: list[str]) -> np.ndarray:
    """Starts of the groups of a sorted table, and its end."""
    return np.concatenate([[0], _changes(table, by), [table.num_rows]])


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of each number's component, for links a[i]-b[i]."""
    labels = np.arange(n)
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        np.minimum.at(labels, high, low)
        while True:
            following = labels[labels]
            if (following == labels).all():
                break
            labels = following
    return labels


def hot_join(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner", most: int = HOT_ROWS) -> DataFrame:
    """``left.join(right, key)`` for a ``right`` of one row a key: rows of a
    key with over ``most`` rows on the left are dealt by hash of ``spread`` to
    several tasks, and the key's row goes to each. The list of such keys has
    one row for ``most`` rows on the left, so it may be broadcast."""
    large = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    large = F.broadcast(large.select(key, F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    dealt_left = left.join(large, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__parts")
    dealt_right = right.join(large, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return dealt_left.join(dealt_right, [key, "__salt"], how).drop("__salt")


def connected(edges: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """Components of an undirected graph given as rows ``(u, v)``.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every
    step is a map-side combined minimum and a join, and each round is written
    to the shared folder. Edges of a hub over ``hot`` edges are dealt to several
    tasks. Returns ``(node, component)`` for each node that has an edge to
    another node; ``component`` is the smallest node of its component.
    """
    u, v = F.col("u"), F.col("v")
    current = store(
        edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges"
    )
    mark, hub = _mark(current)
    while True:
        joined = (lambda a, b: hot_join(a, b, "u", "v", most=hot)) if hub > hot else (lambda a, b: a.join(b, "u"))
        both = current.unionByName(current.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            joined(both, low).filter(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            joined(large, least).filter(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = store(small, "edges")
        after, hub = _mark(following)
        discard(current)
        current = following
        if after == mark:
            return current.select(u.alias("node"), v.alias("component"))
        mark = after


def _mark(edges: DataFrame) -> tuple[tuple, int]:
    """What tells one round's edges from another's, and the edges of the largest hub."""
    counts = edges.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"))
    total, mixed, hub = counts.agg(F.sum("n"), F.bit_xor("x"), F.max("n")).first()
    return (total, mixed), hub or 0
