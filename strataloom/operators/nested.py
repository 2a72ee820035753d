"""JSON of any depth: its leaves, their differences, a canonical form, and digests of tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DUPLICATES = "spark.sql.variant.allowDuplicateKeys"
_STRING = r'"(?:[^"\\]|\\.)*"'


def depth(text: Column) -> Column:
    """How deep a JSON text nests, from its brackets outside strings."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]", ""), "")
    step = lambda a, c: F.struct(
        (a["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now"),
        F.greatest(a["most"], a["now"] + F.when(c.isin("{", "["), 1).otherwise(0)).alias("most"),
    )
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def leaves(rows: DataFrame, text: str, *key: str) -> DataFrame:
    """Leaves of the JSON in ``text``: ``(*key, path, value)``, the value as JSON text.

    Paths read ``a/b[0]/c``; a text that is no container has the path ''. One
    aggregate tells how deep the texts nest, then one chain of generators, a
    level each, opens containers inside their row: no join and no shuffle.

    A null or broken text has no leaf, and neither has an empty list or object;
    a null value is the leaf ``null``; of repeated keys the last counts.
    """
    spark = rows.sparkSession
    levels = rows.agg(F.max(depth(F.col(text)))).first()[0] or 0
    before = spark.conf.get(_DUPLICATES, None)
    spark.conf.set(_DUPLICATES, "true")
    try:
        held = rows.select(*key, F.lit("").alias("__path"), F.try_parse_json(text).alias("__value")).filter("__value is not null")
        # The parser reads the setting when it is planned, at once, before it is set back.
        held.schema
        for _ in range(levels):
            opened = held.lateralJoin(spark.tvf.variant_explode_outer(F.col("__value").outer()))
            step = F.when(F.col("key").isNotNull(), F.concat(F.when(F.col("__path") == "", "").otherwise(F.concat("__path", F.lit("/"))), "key")).otherwise(F.concat("__path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
            inside = F.col("pos").isNotNull()
            held = opened.select(*(F.col(k) for k in key), F.when(inside, step).otherwise(F.col("__path")).alias("__path"), F.when(inside, F.col("value")).otherwise(F.col("__value")).alias("__value"))
    finally:
        spark.conf.unset(_DUPLICATES) if before is None else spark.conf.set(_DUPLICATES, before)
    told = held.select(*key, F.col("__path").alias("path"), F.to_json("__value").alias("value"))
    return told.filter(~F.col("value").isin("[]", "{}"))


def leaf_changes(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Leaves that two results don't share alike: ``(*key, path, left_value, right_value)``,
    where null says that a side has no such leaf."""
    a = left.select(*key, "path", F.col("value").alias("left_value"))
    b = right.select(*key, "path", F.col("value").alias("right_value"))
    return a.join(b, [*key, "path"], "full").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def _canonical(x) -> str:
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_canonical(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(sorted(map(_canonical, x))) + "]"
    return json.dumps(x, ensure_ascii=False)


def _canonical_text(text: str | None) -> str | None:
    try:
        return None if text is None else _canonical(json.loads(text))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """JSON with sorted keys at each level and lists in order of their items'
    canonical text; null for a null or broken text."""
    return text.map(_canonical_text, na_action="ignore").astype(object).where(text.notna(), None)


def digest(*texts: Column) -> list[Column]:
    """Aggregates that make an order-free digest of rows of texts: their number
    and sums of the four quarters of each row's SHA-256. Sums merge, so partial
    aggregates combine before the shuffle, and repeated rows count each."""
    whole = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), t), F.lit("-")) for t in texts)), 256)
    quarter = lambda i: F.conv(F.substring(whole, 16 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("rows"), *(F.sum(quarter(i)).alias(f"__q{i}") for i in range(4))]


def digest_text() -> Column:
    """The digest from the aggregates of ``digest``."""
    parts = [F.coalesce(F.col(f"__q{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *parts), 256)
