"""Exact order statistics of large groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins per doubling of a value.
BINS = 256


def magnitude_bin(value: Column) -> Column:
    """A whole number that never falls as ``value`` rises, the same for all data."""
    # Offset so that small positive values stay above zero.
    size = F.floor((F.log2(F.abs(value)) + 1100) * BINS)
    return F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")


def values_at(rows: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Per key, ``n`` and the values at places of the sorted group.

    ``places`` maps a column name to a function from ``n`` to a place counted
    from 0. Equal values are counted before they are sent, a histogram over
    fixed bins tells which bins hold the places, and only those are sorted, so
    no group is gathered in one task. Null keys and values are left out, and a
    place outside the group gives null.
    """
    known = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    counts = known.groupBy(key, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__bin", magnitude_bin(F.col("__v")))
    whole = Window.partitionBy(key)
    totals = counts.groupBy(key, "__bin").agg(F.sum("__c").alias("__t")).select(
        key, "__bin", "__t", F.sum("__t").over(whole).alias("n"), F.sum("__t").over(whole.orderBy("__bin")).alias("__end")
    )
    start = F.col("__end") - F.col("__t")
    wanted = F.lit(False)
    for place in places.values():
        at = place(F.col("n"))
        wanted = wanted | ((at >= start) & (at < F.col("__end")))
    bins = totals.filter(wanted).select(key, "__bin", "n", start.alias("__before"))
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(key, "__bin").orderBy("__v"))
    ranked = counts.join(bins, [key, "__bin"]).withColumn("__upto", upto)

    def held(place: Callable[[Column], Column]) -> Column:
        at = place(F.col("n"))
        return F.max(F.when((at >= F.col("__upto") - F.col("__c")) & (at < F.col("__upto")), F.col("__v")))

    return ranked.groupBy(key).agg(F.max("n").alias("n"), *(held(p).alias(name) for name, p in places.items()))
