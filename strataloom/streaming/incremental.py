"""Files that come in versions, analysed where their content changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Incremental:
    """Results of files by path, kept up with a stream of their versions.

    Each trigger appends the results of files whose content hash differs from the
    one known, under its number; the newest of a path stands. A trigger that is
    tried again sees the state before it and replaces what it wrote, so results
    don't depend on restarts. ``analyse`` gets the changed files ``(path, content)``
    and returns rows with ``path``.
    """

    def __init__(self, spark: SparkSession, folder: str, analyse: Callable[[DataFrame], DataFrame], schema: str):
        self.spark, self.folder, self.analyse = spark, folder, analyse
        self.schema = f"path string, hash string, {schema}, trigger long"

    def written(self) -> DataFrame:
        """All results so far, with the number of their trigger."""
        if not self._begun():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/results")

    def _begun(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/results")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def results(self) -> DataFrame:
        """One row per path, the newest."""
        rows = self.written()
        newest = rows.groupBy("path").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("path", "trigger"))), "trigger").alias("x"))
        return newest.select("path", "x.*")

    def upsert(self, batch: DataFrame, number: int) -> None:
        """Take in the files ``(path, version, content)`` of one trigger; of several versions the last counts."""
        last = batch.filter("path is not null").groupBy("path").agg(F.max_by("content", "version").alias("content"))
        last = last.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
        rows = self.written().filter(F.col("trigger") < number)
        known = rows.groupBy("path").agg(F.max_by("hash", "trigger").alias("known"))
        changed = last.join(known, "path", "left").filter(~F.col("hash").eqNullSafe(F.col("known")))
        told = self.analyse(changed.select("path", "hash", "content"))
        told.write.mode("overwrite").parquet(f"{self.folder}/results/trigger={number}")

    def run(self, versions: DataFrame) -> None:
        """Take in all that a stream of versions has, and stop; goes on where it stopped before."""
        writer = versions.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True)
        writer.foreachBatch(self.upsert).start().awaitTermination()
