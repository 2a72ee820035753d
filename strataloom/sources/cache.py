"""Results kept as Parquet under a key of their inputs, for a limited time."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 24 * 3600


def cache_key(**inputs) -> str:
    """The first 16 hexadecimal digits of the SHA-256 of the inputs in order of their names."""
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame], ttl: float = DAY, now: float | None = None) -> DataFrame:
    """The newest result of ``key`` in ``folder`` that is at most ``ttl`` seconds
    old; where there is none, ``build()`` is written and read back.

    Every result gets a folder of its own, and is listed only once it is whole,
    so readers of an older one are not disturbed and a failed write is not read.
    ``folder`` must be shared by driver and executors.
    """
    now = time.time() if now is None else now
    try:
        listed = spark.read.schema("made double, path string").json(f"{folder}/{key}/index")
        newest = listed.filter((F.col("made") <= now) & (F.col("made") >= now - ttl)).agg(F.max_by("path", "made").alias("path")).first().path
    except AnalysisException:  # nothing is listed yet
        newest = None
    if newest is None:
        newest = f"{folder}/{key}/{uuid.uuid4().hex}"
        build().write.parquet(newest)
        spark.createDataFrame([(float(now), newest)], "made double, path string").write.mode("append").json(f"{folder}/{key}/index")
    return spark.read.parquet(newest)
