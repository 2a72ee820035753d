from datetime import datetime, timedelta

from strataloom.streaming.alerts import alerts
from strataloom.streaming.metrics import run_once

START = datetime(2024, 1, 1)


def points(spark, folder, rows):
    data = [(n, START + timedelta(minutes=m), v) for n, m, v in rows]
    spark.createDataFrame(data, "name string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(folder)


def test_edges_over_restarts(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def run():
        stream = spark.readStream.schema("name string, ts timestamp, value double").parquet(src)
        run_once(alerts(stream), out, cp)

    points(spark, src, [("error_rate", 2, 0.3), ("error_rate", 1, 0.05), ("error_rate", 3, 0.4), ("memory_percent", 1, 80.0), ("error_rate", 4, None), ("other", 1, 99.0)])
    run()
    points(spark, src, [("error_rate", 5, 0.2), ("error_rate", 6, 0.1), ("memory_percent", 2, 81.0)])
    run()
    got = {(r.name, (r.ts - START).total_seconds() / 60, r.state) for r in spark.read.parquet(out).collect()}
    assert got == {("error_rate", 2, "triggered"), ("error_rate", 6, "resolved"), ("memory_percent", 2, "triggered")}


def test_operations_over_triggers(spark, tmp_path):
    from strataloom.streaming.operations import durations

    at = lambda m: datetime(2024, 1, 1, 0, m)
    parts = [[("a", at(0), True), ("b", at(1), False)], [("a", at(2), True), ("c", at(3), True), ("c", at(4), False)], [("a", at(7), False), ("a", at(8), False), ("n", None, True)]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, "name string, ts timestamp, starts boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("name string, ts timestamp, starts boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run_once(durations(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.name, r.began.minute, r.seconds) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("a", 2, 300.0), ("c", 3, 60.0)]
