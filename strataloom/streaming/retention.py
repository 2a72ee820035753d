"""Series that keep their last points and expire, and cached results with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

POINT = "name string, ts timestamp, id long, value double"
#: Groups that series are dealt to by their names; a group's series share a call and a timer a trigger.
GROUPS = 512


class LastPoints(StatefulProcessor):
    """List state of the newest points of a group's series, with a timer for the first that expires."""

    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep = most, pd.Timedelta(keep_ms, "ms")

    def init(self, handle) -> None:
        self.handle, self.points = handle, handle.getListState("points", POINT)

    def _newest(self, frame: pd.DataFrame) -> pd.DataFrame:
        """The last points of each series, newest first; a gap longer than a series is kept begins a new one."""
        frame = frame.sort_values(["name", "ts", "id"], ascending=[True, False, False], kind="stable")
        frame = frame[frame.groupby("name", sort=False).cumcount() < self.most]
        gap = frame.groupby("name", sort=False)["ts"].diff() < -self.keep
        return frame[~gap.groupby(frame["name"], sort=False).cummax()]

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.points.get()), columns=["name", "ts", "id", "value"]).astype({"ts": "datetime64[ns]", "id": "int64", "value": "float64"})

    def _hold(self, frame: pd.DataFrame) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if frame.empty:
            self.points.clear()
            return
        self.points.put(list(zip(frame["name"].tolist(), frame["ts"].dt.to_pydatetime(), frame["id"].tolist(), frame["value"].tolist(), strict=True)))
        self.handle.registerTimer(_ms(frame.groupby("name", sort=False)["ts"].first().min() + self.keep))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, fresh = self._held(), set()
        for frame in rows:
            fresh.update(frame["name"])
            held = self._newest(pd.concat([held, frame[held.columns].astype(held.dtypes)]) if len(held) else frame[held.columns].astype(held.dtypes))
        self._hold(held)
        told = held[held["name"].isin(fresh)].groupby("name", sort=False).agg(points=("id", "size"), mean=("value", "mean"), last=("ts", "max")).reset_index()
        yield told.assign(live=True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        last = held.groupby("name", sort=False)["ts"].transform("max")
        over = (last + self.keep).map(_ms) <= expiredTimerInfo.getExpiryTimeInMs()
        now = timerValues.getCurrentWatermarkInMs()
        over |= (last + self.keep).map(_ms) < now
        gone = held[over].groupby("name", sort=False)["ts"].max().reset_index(name="last")
        self._hold(held[~over])
        yield gone.assign(points=0, mean=float("nan"), live=False)[["name", "points", "mean", "last", "live"]]

    def close(self) -> None:
        pass


def _ms(at: pd.Timestamp) -> int:
    return at.value // 1_000_000


def last_points(points: DataFrame, most: int = 5, keep: str = "3650 days", late: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """The last ``most`` points of each series of ``points(name, ts, id, value)``,
    told at each trigger that adds to it: ``name, points, mean, last, live``.

    A task holds ``most`` points a series of one of ``groups``, however many a
    trigger brings, in any order; the caller raises ``groups`` with the number of
    series. A series without a point for ``keep`` expires once the watermark,
    ``late`` behind the newest point, has passed: a row that is not ``live`` tells
    of it, and its state is gone. A later point begins it anew, and so does a
    point after a gap longer than ``keep``, so results don't depend on triggers.
    Points with a null are left out. Needs the RocksDB state store.
    """
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    known = points.select("name", "ts", "id", "value").na.drop().withWatermark("ts", late)
    return known.withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups))).groupBy("group").transformWithStateInPandas(
        LastPoints(most, keep_ms), "name string, points long, mean double, last timestamp, live boolean", "Update", "EventTime"
    )


class Cache(StatefulProcessor):
    """Value state of a result and the time until which it answers, with a timer that drops it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.handle, self.result = handle, handle.getValueState("result", "value double, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, until = self.result.get() if self.result.exists() else (None, -1)
        before, hits, misses = until, 0, 0
        asked = sorted((int(t.timestamp() * 1000), i, v) for frame in rows for t, i, v in zip(frame["ts"], frame["id"], frame["value"], strict=True))
        for at, _, own in asked:
            if at <= until:
                hits += 1
            else:
                value, until, misses = float(own), at + self.ttl_ms, misses + 1
        if until != before:
            self.result.update((value, until))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(until)
        yield pd.DataFrame({"name": [key[0]], "value": [value], "hits": [hits], "misses": [misses]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.result.clear()
        yield pd.DataFrame({"name": [], "value": [], "hits": [], "misses": []}).astype({"name": "object", "value": "float64", "hits": "int64", "misses": "int64"})

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl: str = "1 day", late: str = "10 minutes") -> DataFrame:
    """Answers to ``requests(name, ts, id, value)``: a request finds the value of
    an earlier one up to ``ttl`` old, or brings its own, which answers others for
    as long; ``name, value, hits, misses`` a trigger. A value whose time has
    passed leaves no state. A task holds times and values of one name's requests
    of a trigger. Requests with a null are left out. Needs the RocksDB state store."""
    known = requests.select("name", "ts", "id", "value").na.drop().withWatermark("ts", late)
    return known.groupBy("name").transformWithStateInPandas(
        Cache(int(pd.Timedelta(ttl).total_seconds() * 1000)), "name string, value double, hits long, misses long", "Update", "EventTime"
    )
