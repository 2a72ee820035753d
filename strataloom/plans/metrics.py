"""Queries over metric points, with ``events`` as their table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataloom.functions.scalars import level, share
from strataloom.operators.ranks import values_at
from strataloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def metric_latest(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))


@query("SELECT event_type, user_id, count(*)::BIGINT AS points, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5 GROUP BY ALL")
def last_n_points(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return _events(spark, sf_dir).withColumn("n", n).filter("n <= 5").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def hourly_average(spark, sf_dir):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return _events(spark, sf_dir).groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) FILTER (event_type = 'error')::DOUBLE / count(*) AS rate FROM events GROUP BY 1),
b AS (SELECT hour, rate > 0.3 AS breach, coalesce(lag(rate > 0.3) OVER (ORDER BY hour), false) AS before FROM h)
SELECT hour, CASE WHEN breach THEN 'triggered' ELSE 'resolved' END AS state FROM b WHERE breach <> before""")
def alert_transitions(spark, sf_dir):
    """Edges of an alert over hourly error rates. The window has no key, but
    its rows are hours, not events."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rate = share(F.count_if(F.col("event_type") == "error"), F.count(F.lit(1)))
    rows = _events(spark, sf_dir).groupBy(hour.alias("hour")).agg((rate > 0.3).alias("breach"))
    before = F.coalesce(F.lag("breach").over(Window.orderBy("hour")), F.lit(False))
    return rows.withColumn("before", before).filter("breach <> before").select("hour", F.when(F.col("breach"), "triggered").otherwise("resolved").alias("state"))


@query("""SELECT event_type, round(v[(floor(n * 0.95) + 1)::INT], 6) AS nearest, round((v[j] * (20 - d) + v[j + 1] * d) / 20, 6) AS exclusive, round(quantile, 6) AS linear FROM (SELECT *, 19 * (n + 1) - 20 * j AS d FROM (
SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n, quantile_cont(value, 0.95) AS quantile, greatest(1, least(count(*) - 1, (19 * (count(*) + 1)) // 20)) AS j FROM events GROUP BY 1))""")
def p95_variants(spark, sf_dir):
    """Three definitions of the 95th percentile, from values at single ranks."""
    low = lambda n: F.greatest(F.lit(1), F.least(n - 1, F.floor(19 * (n + 1) / 20)))
    places = {
        "nearest": lambda n: F.floor(n * 0.95), "below": lambda n: low(n) - 1, "above": low,
        "under": lambda n: F.floor((n - 1) * 0.95), "over": lambda n: F.ceil((n - 1) * 0.95),
    }
    out = values_at(_events(spark, sf_dir), "event_type", "value", places)
    n = F.col("n")
    d = 19 * (n + 1) - 20 * low(n)
    exclusive = F.when(n >= 2, (F.col("below") * (20 - d) + F.col("above") * d) / 20)
    part = (n - 1) * 0.95 - F.floor((n - 1) * 0.95)
    linear = F.col("under") + (F.col("over") - F.col("under")) * part
    return out.select("event_type", F.round("nearest", 6).alias("nearest"), F.round(exclusive, 6).alias("exclusive"), F.round(linear, 6).alias("linear"))


@query("SELECT event_type, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS middle, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def operation_stats(spark, sf_dir):
    rows = _events(spark, sf_dir)
    half = values_at(rows, "event_type", "value", {"under": lambda n: F.floor((n - 1) / 2), "over": lambda n: F.ceil((n - 1) / 2)})
    middle = half.select("event_type", F.round((F.col("under") + F.col("over")) / 2, 6).alias("middle"))
    out = rows.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return out.join(middle, "event_type", "left").select("event_type", "low", "high", "mean", "middle", "n", "users")


@query("SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS platform, count(*)::BIGINT AS submissions, round(count(*) FILTER (value > 50)::DOUBLE / count(*), 6) AS success_rate FROM events GROUP BY GROUPING SETS ((event_type), ())")
def platform_success_rate(spark, sf_dir):
    rows = _events(spark, sf_dir).rollup("event_type").agg(F.grouping("event_type").alias("g"), F.count(F.lit(1)).alias("submissions"), F.count_if(F.col("value") > 50).alias("won"))
    return rows.select(F.when(F.col("g") == 1, "all").otherwise(F.col("event_type")).alias("platform"), "submissions", F.round(share(F.col("won"), F.col("submissions")), 6).alias("success_rate"))


@query("""SELECT user_id, count(*)::BIGINT AS waits, round(avg(gap), 6) AS mean_hours, round(greatest(0, 1 - avg(gap) / 168), 6)::DOUBLE AS roi FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 3.6e9::DOUBLE AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1""")
def roi_scores(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = _events(spark, sf_dir).withColumn("gap", (us - F.lag(us).over(own)) / 3.6e9).filter("gap IS NOT NULL")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("waits"), F.round(F.avg("gap"), 6).alias("mean_hours"), F.round(F.greatest(F.lit(0.0), 1 - F.avg("gap") / 168), 6).alias("roi"))


@query("SELECT (json_extract(props, '$.k'))::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_leaves(spark, sf_dir):
    return _events(spark, sf_dir).groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*)::BIGINT AS applied FROM (SELECT *, min(level) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS now, min(level) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (
SELECT *, CASE WHEN value >= 75 THEN 4 WHEN value >= 50 THEN 3 WHEN value >= 25 THEN 2 ELSE 1 END AS level FROM events)) WHERE level < coalesce(before, 5) GROUP BY 1""")
def authority_fold(spark, sf_dir):
    """How often a running minimum falls."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = level(F.col("value"), [(75, "4"), (50, "3"), (25, "2")], "1").cast("int")
    rows = _events(spark, sf_dir).withColumn("level", step)
    before = F.min("level").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", before).filter(F.col("level") < F.coalesce("before", F.lit(5))).groupBy("user_id").agg(F.count(F.lit(1)).alias("applied"))
