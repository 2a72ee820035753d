"""Series and caches in streams: equal at any number of triggers, and no state left behind."""

from datetime import datetime, timedelta

import pytest

from strataloom.streaming import runs
from strataloom.streaming.retention import cached, last_points

START = datetime(2024, 1, 1)
ROWS = [("a", m, m, float(m)) for m in (1, 2, 3, 50, 51)] + [("b", 4, 9, 1.0), ("c", 60, 10, 2.0), ("c", 61, 11, None), ("late", 5000, 12, 1.0)]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", runs.ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def points(spark):
    data = [(n, START + timedelta(minutes=m), i, v) for n, m, i, v in ROWS]
    return spark.createDataFrame(data, "name string, ts timestamp, id long, value double")


@pytest.mark.parametrize("parts", [1, 3])
def test_last_points_at_any_number_of_triggers(rocks, parts):
    stream = runs.replay(rocks, points(rocks), parts=parts, files=2)
    got = {r.name: (r.points, r.mean, r.live) for r in runs.latest(runs.finished(last_points(stream, 3), "update"), "name").collect()}
    assert got == {"a": (3, (3 + 50 + 51) / 3, True), "b": (1, 1.0, True), "c": (1, 2.0, True), "late": (1, 1.0, True)}


@pytest.mark.parametrize("parts", [1, 4])
def test_expired_series_leave_no_state(rocks, parts):
    stream = runs.replay(rocks, points(rocks), parts=parts, files=2)
    got = {r.name: (r.points, r.live) for r in runs.latest(runs.finished(last_points(stream, 3, "30 minutes"), "update"), "name").collect()}
    assert got == {"a": (0, False), "b": (0, False), "c": (0, False), "late": (1, True)}


def test_a_gap_begins_a_series_anew(rocks):
    rows = points(rocks).filter("name = 'a'")
    got = [(r.points, r.mean) for r in runs.latest(runs.finished(last_points(runs.replay(rocks, rows, parts=1), 9, "30 minutes"), "update"), "name").collect()]
    assert got == [(2, 50.5)]


@pytest.mark.parametrize("parts", [1, 3])
def test_cache_lives_for_a_time(rocks, parts):
    stream = runs.replay(rocks, points(rocks), parts=parts, files=2)
    rows = runs.finished(cached(stream, "10 minutes"), "update").collect()
    total = lambda n: tuple(sum(r[c] for r in rows if r.name == n) for c in ("hits", "misses"))
    assert {n: total(n) for n in ("a", "b", "c", "late")} == {"a": (3, 2), "b": (0, 1), "c": (0, 1), "late": (0, 1)}
    assert {r.value for r in rows if r.name == "a"} <= {1.0, 50.0}
