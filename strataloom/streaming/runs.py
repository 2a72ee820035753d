"""Running streams: tables replayed in order of time, and durable results.

Checkpoints, state and results lie in the folder that driver and executors
share, so a lost executor or a restart goes on from the last trigger.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.session import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/strataloom-{name}-{uuid.uuid4().hex}"


def replay(spark: SparkSession, table: DataFrame, time: str = "ts", parts: int = 3, files: int = 8) -> DataFrame:
    """``table`` as a stream that brings it in order of ``time``, a part a trigger.

    Parts are written one after the other, as the file source goes by the age of
    files; each is ``files`` files, and so is a trigger. What a trigger holds is
    thus bounded by the number of parts, which the caller raises with the table.
    """
    folder = scratch_path(spark, "replay")
    # A watermark needs a time with a zone.
    rows = table.withColumn(time, F.col(time).cast("timestamp")) if table.schema[time].dataType.typeName() == "timestamp_ntz" else table
    cuts = rows.agg(F.percentile_approx(F.col(time).cast("double"), [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    bounds = [None, *cuts, None]
    for n, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False)):
        at = F.col(time).cast("double")
        some = rows.filter((at >= low if low is not None else F.lit(True)) & (at < high if high is not None else F.lit(True)) | (at.isNull() & F.lit(low is None)))
        some.repartition(files).write.parquet(f"{folder}/part={n}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/part=*")


def finished(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and read what it wrote.

    In ``append`` mode rows go to Parquet; in the other modes each trigger's rows
    go there with the trigger's number, as ``__trigger``, replacing what an
    earlier try of the trigger wrote, and those of the last trigger of a key
    stand for it: see ``latest``.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "stream")
    writer = rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{path}/rows").start().awaitTermination()
        return spark.read.schema(rows.schema).parquet(f"{path}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/__trigger={number}")

    writer.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(f"{_ddl(rows)}, `__trigger` long").parquet(f"{path}/rows")


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def latest(written: DataFrame, *key: str) -> DataFrame:
    """The row of the last trigger of each key, one for each; map-side combined."""
    others = [c for c in written.columns if c not in (*key, "__trigger")]
    newest = written.groupBy(*key).agg(F.max_by(F.struct(*others), "__trigger").alias("x"))
    return newest.select(*key, "x.*")
