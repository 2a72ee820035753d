"""Structured Streaming twins of the metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Metric events of a folder of Parquet files, with a time a watermark accepts."""
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Count and mean of each type and hour; rows later than ``late`` are left out."""
    keyed = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    out = keyed.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", "mean")


def error_rates(stream: DataFrame, bound: float = 0.3, late: str = "10 minutes") -> DataFrame:
    """Whether the share of errors of each hour breaks ``bound``."""
    keyed = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"))
    rate = F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    return keyed.agg(rate.alias("rate")).select(F.col("w.start").alias("hour"), "rate", (F.col("rate") > bound).alias("breach"))


def series(stream: DataFrame, kinds: dict[str, str], bounds: tuple[float, ...] = (10.0, 100.0)) -> DataFrame:
    """Each series of ``kinds`` as it stands: points, total and latest value, and
    for histograms the points up to each bound, else null.

    A counter's points are increments, so its value is the total; a gauge's is
    the latest. One row of partial aggregates is the state of a series.
    """
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    known = stream.filter(F.col("event_type").isin(*kinds) & F.col("value").isNotNull())
    out = known.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"),
        *(F.count_if(F.col("value") <= b).alias(f"up_to_{b:g}") for b in bounds),
    ).withColumn("kind", F.element_at(kind, F.col("event_type")))
    value = F.when(F.col("kind") == "gauge", F.col("latest")).when(F.col("kind") == "counter", F.col("total"))
    return out.select("event_type", "kind", "n", F.round(value, 4).alias("value"), *(F.when(F.col("kind") == "histogram", F.col(f"up_to_{b:g}")).alias(f"up_to_{b:g}") for b in bounds))


def run_once(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process all that is there, append to Parquet, and stop."""
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
