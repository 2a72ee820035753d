"""Streams whose results don't depend on triggers, restarts or tries."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strataloom.streaming import runs
from strataloom.streaming.breaches import held
from strataloom.streaming.incremental import Incremental

START = datetime(2024, 1, 1)


def analyse(files):
    return files.select("path", "hash", F.length("content").cast("long").alias("chars"))


def test_incremental_files_over_restarts_and_tries(spark, tmp_path):
    parts = [[("a", 1, "one"), ("b", 1, "two"), (None, 1, "x")], [("a", 2, "one"), ("b", 2, "other"), ("c", 2, None)], [("a", 3, "1"), ("c", 3, ""), ("b", 4, "new"), ("b", 3, "old")]]
    schema, src, folder = "path string, version long, content string", f"{tmp_path}/in", f"{tmp_path}/state"
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{n}")
        # Each part comes to a new object, as after a restart.
        state = Incremental(spark, folder, analyse, "chars long")
        state.run(spark.readStream.schema(schema).parquet(f"{src}/*"))
    told = lambda: {(r.path, r.chars, r.trigger) for r in state.written().collect()}
    first = told()
    assert first == {("a", 3, 0), ("b", 3, 0), ("b", 5, 1), ("c", None, 1), ("a", 1, 2), ("b", 3, 2)}
    assert {r.path: r.chars for r in state.results().collect()} == {"a": 1, "b": 3, "c": None}
    for n in (1, 2):  # tried again, as after a failure before the commit
        state.upsert(spark.createDataFrame(parts[n], schema), n)
        assert told() == first


def points(spark):
    hours = {"a": [0, 1, 2, 4, 5, 9], "b": [1, 3, 5], "c": [6, 7]}  # hours in which the value is high
    rows = [(n, START + timedelta(hours=h, minutes=m), 100.0 if h in high else 1.0) for n, high in hours.items() for h in range(11) for m in (5, 35) if not (n == "c" and h == 8)]
    return spark.createDataFrame([*rows, ("z", START + timedelta(hours=20), 1.0), (None, START, 500.0), ("a", None, 5.0)], "name string, ts timestamp, value double")


@pytest.mark.parametrize("parts", [1, 3, 10])
def test_rules_that_hold_for_a_time(spark, parts):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, runs.ROCKS)
    try:
        rows = runs.finished(held(runs.replay(spark, points(spark), parts=parts, files=2), F.avg("value") > 50)).collect()
    finally:
        spark.conf.unset(key)
    hour = lambda t: (t - START).total_seconds() / 3600
    got = sorted((r.name, hour(r.since), hour(r.until), r.state) for r in rows)
    # c has no window after its gap but those that are low, which resolve it.
    assert got == [("a", 0, 2, "firing"), ("a", 0, 3, "resolved"), ("a", 4, 6, "firing"), ("a", 4, 6, "resolved"), ("c", 6, 8, "firing"), ("c", 6, 8, "resolved")]


def test_late_rows_are_left_out(spark, tmp_path):
    src, at = f"{tmp_path}/in", lambda h: START + timedelta(hours=h)
    for n, rows in enumerate([[("a", at(0), 100.0)], [("a", at(5), 1.0)], [("a", at(6), 1.0)], [("a", at(7), 1.0)], [("a", at(1), 100.0), ("a", at(8), 1.0)], [("a", at(9), 1.0)]]):
        spark.createDataFrame(rows, "name string, ts timestamp, value double").coalesce(1).write.parquet(f"{src}/{n}")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, runs.ROCKS)
    try:
        stream = spark.readStream.schema("name string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
        assert runs.finished(held(stream, F.avg("value") > 50)).collect() == []
    finally:
        spark.conf.unset(key)
