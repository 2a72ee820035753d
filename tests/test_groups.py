"""Series and operations that share a group, and so a call and a state, stay apart."""

from datetime import datetime, timedelta

from strataloom.streaming import runs
from strataloom.streaming.operations import durations
from strataloom.streaming.retention import last_points

START = datetime(2024, 1, 1)
KEY = "spark.sql.streaming.stateStore.providerClass"


def test_series_of_one_group(spark):
    data = [(f"s{n}", START + timedelta(minutes=m), m, float(n + m)) for n in range(30) for m in range(n + 1)] + [("late", START + timedelta(minutes=100), 1, 1.0)]
    stream = runs.replay(spark, spark.createDataFrame(data, "name string, ts timestamp, id long, value double"), parts=3, files=2)
    spark.conf.set(KEY, runs.ROCKS)
    try:
        rows = runs.latest(runs.finished(last_points(stream, 2, "75 minutes", groups=1), "update"), "name").collect()
    finally:
        spark.conf.unset(KEY)
    got = {r.name: (r.points, r.mean, r.live) for r in rows}
    want = {f"s{n}": (0, None, False) if n + 75 <= 90 and n < 15 else (min(n + 1, 2), 2.0 * n - (0.5 if n else 0), True) for n in range(30)}
    assert len(got) == 31 and got.pop("late") == (1, 1.0, True)
    assert {n: x for n, x in got.items() if n != "s15"} == {n: x for n, x in want.items() if n != "s15"}


def test_operations_of_one_group(spark):
    data = [(f"o{n}", START + timedelta(seconds=s + n), s == 0) for n in range(1, 20) for s in (0, 2400, 6000)]
    stream = runs.replay(spark, spark.createDataFrame(data, "name string, ts timestamp, starts boolean"), parts=3, files=2)
    rows = runs.finished(durations(stream, groups=1)).collect()
    assert sorted((r.name, r.seconds) for r in rows) == sorted((f"o{n}", 2400.0) for n in range(1, 20))
