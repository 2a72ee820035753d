"""Streams over ``events`` and ``conversations``, replayed in order of time in several triggers.

Windows are told once they are closed, 10 minutes behind the newest event, so
the twins leave out those that are open at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.sources.tables import table
from strataloom.streaming import runs
from strataloom.streaming.alerts import alerts
from strataloom.streaming.breaches import held
from strataloom.streaming.incremental import Incremental
from strataloom.streaming.metrics import hourly, series
from strataloom.streaming.operations import durations
from strataloom.streaming.retention import last_points

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _stream(spark, sf_dir: str, parts: int = 3) -> DataFrame:
    return runs.replay(spark, table(spark, sf_dir, "events"), parts=parts)


class _Rocks:
    """The state store that list state and timers need, for the streams started inside."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark):
        self.spark, self.before = spark, spark.conf.get(self.KEY, None)

    def __enter__(self):
        self.spark.conf.set(self.KEY, runs.ROCKS)

    def __exit__(self, *_):
        self.spark.conf.unset(self.KEY) if self.before is None else self.spark.conf.set(self.KEY, self.before)


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(f"""SELECT strftime(hour, '%Y-%m-%d %H') AS hour, event_type, n, mean FROM (
SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2) WHERE hour + INTERVAL 1 HOUR <= {_CLOSED}""")
def stream_hourly(spark, sf_dir):
    """Hourly counts and means, told once an hour is closed."""
    rows = hourly(_stream(spark, sf_dir))
    return runs.finished(rows.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("mean", 6).alias("mean")))


@query("""SELECT name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, state, count(*)::BIGINT AS n FROM (SELECT event_type AS name, ts, CASE WHEN value > 150 THEN 'triggered' ELSE 'resolved' END AS state,
 (value > 150) <> coalesce(lag(value > 150) OVER (PARTITION BY event_type ORDER BY ts, value), false) AS edge FROM events WHERE event_type IN ('error', 'purchase') AND value IS NOT NULL) WHERE edge GROUP BY 1, 2, 3""")
def stream_alerts(spark, sf_dir):
    """Edges of two alerts over event values as a stateful stream."""
    points = _stream(spark, sf_dir).select(F.col("event_type").alias("name"), "ts", "value")
    edges = runs.finished(alerts(points, {"error": 150.0, "purchase": 150.0}))
    return edges.groupBy("name", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT strftime(s, '%Y-%m-%d %H:%M') AS since, n::BIGINT AS n, round(errors / n::DOUBLE, 6) AS rate FROM (
SELECT s, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT event_type, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE]) AS s FROM events) GROUP BY 1)
WHERE n > 1 AND errors / n::DOUBLE > 0.3 AND s + INTERVAL 30 MINUTE <= {_CLOSED}""")
def stream_sliding(spark, sf_dir):
    """Windows of 30 minutes, one each 15, in which over 30 % of the events are errors, told once closed."""
    rows = _stream(spark, sf_dir).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "30 minutes", "15 minutes").alias("w"))
    rate = F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    out = rows.agg(F.count(F.lit(1)).alias("n"), rate.alias("rate")).filter("n > 1 and rate > 0.3")
    return runs.finished(out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("since"), "n", F.round("rate", 6).alias("rate")))


def _responses(spark, sf_dir, how: str) -> DataFrame:
    events = _stream(spark, sf_dir)
    kind = lambda kind, name: events.filter(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.col("ts").alias(f"{name}_at")).withWatermark(f"{name}_at", "10 minutes")
    sent, back = kind("signup", "submitted"), kind("purchase", "responded")
    near = (F.col("responded_at") > F.col("submitted_at")) & (F.col("responded_at") <= F.col("submitted_at") + F.expr("INTERVAL 2 HOURS"))
    rows = sent.join(back.withColumnRenamed("user_id", "other"), (F.col("user_id") == F.col("other")) & near, how)
    hours = (F.col("responded_at").cast("double") - F.col("submitted_at").cast("double")) / 3600
    return runs.finished(rows.select("user_id", "submitted", "responded", F.round(hours, 4).alias("hours")))


_ANSWERED = """SELECT s.user_id, s.event_id AS submitted, r.event_id AS responded, round((epoch(r.ts) - epoch(s.ts)) / 3600, 4)::DOUBLE AS hours FROM events s JOIN events r ON s.user_id = r.user_id
WHERE s.event_type = 'signup' AND r.event_type = 'purchase' AND r.ts > s.ts AND r.ts <= s.ts + INTERVAL 2 HOUR"""


@query(_ANSWERED)
def stream_responses(spark, sf_dir):
    """Responses within two hours of a submission, as a join of two streams whose state watermarks bound."""
    return _responses(spark, sf_dir, "inner")


_BEHIND = "(SELECT least(max(ts) FILTER (event_type = 'signup'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 10 MINUTE FROM events)"


@query(f"""WITH a AS ({_ANSWERED}), s AS (SELECT user_id, event_id AS submitted, ts FROM events WHERE event_type = 'signup'),
j AS (SELECT s.user_id, count(*)::BIGINT AS submissions, count(a.submitted)::BIGINT AS responses, count(DISTINCT a.submitted)::BIGINT AS answered, median(a.hours) AS median_hours
 FROM s LEFT JOIN a USING (submitted) WHERE a.submitted IS NOT NULL OR s.ts + INTERVAL 2 HOUR < {_BEHIND} GROUP BY 1)
SELECT user_id, (submissions - responses + answered)::BIGINT AS submissions, responses, answered, round(median_hours, 4)::DOUBLE AS median_hours, round(answered / (submissions - responses + answered)::DOUBLE, 6) AS returned FROM j""")
def stream_answers(spark, sf_dir):
    """Submissions, answered and not, of each user: a left outer join of two
    streams, which tells an unanswered one once, when the watermark has passed
    the two hours it could be answered in; with median latency and returns."""
    rows = _responses(spark, sf_dir, "left_outer")
    out = rows.groupBy("user_id").agg(
        F.countDistinct("submitted").alias("submissions"), F.count("responded").alias("responses"), F.countDistinct(F.when(F.col("responded").isNotNull(), F.col("submitted"))).alias("answered"),
        F.round(F.median("hours"), 4).alias("median_hours"),
    )
    return out.withColumn("returned", F.round(F.col("answered") / F.col("submissions"), 6))


#: Kinds of the event types taken as metric series.
SERIES = {"click": "counter", "error": "counter", "view": "gauge", "purchase": "histogram"}
_SERIES = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in SERIES.items()) + " END"


@query(f"""SELECT event_type, {_SERIES} AS kind, count(*)::BIGINT AS n, round(CASE {_SERIES} WHEN 'counter' THEN sum(value) WHEN 'gauge' THEN arg_max(value, (ts, event_id)) END, 4) AS value,
 CASE WHEN event_type = 'purchase' THEN count(*) FILTER (value <= 10) END::BIGINT AS up_to_10, CASE WHEN event_type = 'purchase' THEN count(*) FILTER (value <= 100) END::BIGINT AS up_to_100
FROM events WHERE event_type IN ('click', 'error', 'view', 'purchase') AND value IS NOT NULL GROUP BY 1""")
def stream_series(spark, sf_dir):
    """Counters, gauges and histograms as a stream; each trigger tells the series that it adds to."""
    return runs.latest(runs.finished(series(_stream(spark, sf_dir), SERIES), "update"), "event_type")


@query("""SELECT user_id::VARCHAR AS name, strftime(before, '%Y-%m-%d %H:%M:%S') AS began, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ended, round(epoch(ts) - epoch(before), 3)::DOUBLE AS seconds FROM (
SELECT user_id, ts, event_type, lag(event_type) OVER w AS previous, lag(ts) OVER w AS before FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type DESC))
WHERE event_type = 'purchase' AND previous = 'signup' AND ts - before < INTERVAL 60 DAY""")
def stream_operations(spark, sf_dir):
    """Time from each user's last sign-up to the next purchase, as a stateful stream."""
    rows = _stream(spark, sf_dir).filter(F.col("event_type").isin("signup", "purchase"))
    marks = rows.select(F.col("user_id").cast("string").alias("name"), "ts", (F.col("event_type") == "signup").alias("starts"))
    out = runs.finished(durations(marks, "60 days"))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("name", at("began"), at("ended"), F.round("seconds", 3).alias("seconds"))


_SERIES_POINTS = "SELECT event_type || '/' || user_id AS name, ts, event_id, value FROM events"


@query(f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS place FROM ({_SERIES_POINTS}))
SELECT name, count(*)::BIGINT AS points, round(avg(value), 6) AS mean, true AS live FROM p WHERE place <= 5 GROUP BY 1""")
def stream_last_points(spark, sf_dir):
    """The last five points of each series, kept in list state."""
    points = _stream(spark, sf_dir).select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("name"), "ts", F.col("event_id").alias("id"), "value")
    with _Rocks(spark):
        rows = runs.latest(runs.finished(last_points(points), "update"), "name")
    return rows.select("name", "points", F.round("mean", 6).alias("mean"), "live")


@query(f"""WITH g AS (SELECT *, coalesce(epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY name ORDER BY ts, event_id)) > 172800000, true)::INT AS fresh FROM ({_SERIES_POINTS})),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY name ORDER BY ts, event_id) AS session FROM g), l AS (SELECT *, max(session) OVER (PARTITION BY name) AS newest FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, event_id DESC) AS place FROM l WHERE session = newest),
x AS (SELECT name, least(count(*), 5)::BIGINT AS points, avg(value) FILTER (place <= 5) AS mean, epoch_ms(max(ts)) + 172800000 > epoch_ms({_CLOSED}) AS live FROM p GROUP BY 1)
SELECT name, CASE WHEN live THEN points ELSE 0 END::BIGINT AS points, CASE WHEN live THEN round(mean, 6) END AS mean, live FROM x""")
def stream_expiring(spark, sf_dir):
    """The last five points of each series that had one in the last two days; others expire and leave no state."""
    points = _stream(spark, sf_dir).select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("name"), "ts", F.col("event_id").alias("id"), "value")
    with _Rocks(spark):
        rows = runs.latest(runs.finished(last_points(points, keep="2 days"), "update"), "name")
    return rows.select("name", "points", F.round("mean", 6).alias("mean"), "live")


@query(f"""WITH h AS (SELECT event_type AS name, date_trunc('hour', ts)::TIMESTAMP AS s, avg(value) > 60 AS breach FROM events GROUP BY 1, 2 HAVING s + INTERVAL 1 HOUR <= {_CLOSED}),
b AS (SELECT name, s, s - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY name ORDER BY s) AS island FROM h WHERE breach),
i AS (SELECT name, min(s) AS since, max(s) + INTERVAL 1 HOUR AS until, count(*) AS n FROM b GROUP BY name, island HAVING count(*) >= 2), z AS (SELECT name, max(s) AS newest FROM h GROUP BY 1)
SELECT name, strftime(since, '%Y-%m-%d %H') AS since, strftime(since + INTERVAL 2 HOUR, '%Y-%m-%d %H') AS until, 'firing' AS state FROM i
UNION ALL SELECT name, strftime(since, '%Y-%m-%d %H'), strftime(until, '%Y-%m-%d %H'), 'resolved' FROM i JOIN z USING (name) WHERE newest >= until""")
def stream_breaches(spark, sf_dir):
    """Event types whose hourly mean exceeds a bound for two hours in a row, and until when."""
    points = _stream(spark, sf_dir).select(F.col("event_type").alias("name"), "ts", "value")
    with _Rocks(spark):
        rows = runs.finished(held(points, F.avg("value") > 60))
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH").alias(c)
    return rows.select("name", at("since"), at("until"), "state")


@query("""SELECT path, sha256(content) AS hash, length(content)::BIGINT AS chars, len(string_split(content, chr(10)))::BIGINT AS lines FROM (
SELECT conv_id || '/' || role AS path, coalesce(arg_max(text, turn), '') AS content FROM conversations GROUP BY 1)""")
def stream_incremental(spark, sf_dir):
    """Messages as versions of a file a conversation and role, analysed as they change."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("path"), F.col("turn").alias("version"), F.col("text").alias("content"))

    def analyse(files: DataFrame) -> DataFrame:
        content = F.coalesce("content", F.lit(""))
        return files.select("path", "hash", F.length(content).cast("long").alias("chars"), F.size(F.split(content, "\n")).cast("long").alias("lines"))

    state = Incremental(spark, runs.scratch_path(spark, "incremental"), analyse, "chars long, lines long")
    state.run(runs.replay(spark, rows, "version"))
    return state.results()
