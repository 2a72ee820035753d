"""Rules over windows of a stream that must hold for a time before they fire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


class Held(StatefulProcessor):
    """Value state: since when, until when, and how often in a row a rule was broken."""

    def __init__(self, windows: int, step_ms: int):
        self.windows, self.step_ms = windows, step_ms

    def init(self, handle) -> None:
        self.run = handle.getValueState("run", "since long, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, now = [], self.run.get() if self.run.exists() else None
        told = sorted((int(t.timestamp() * 1000), bool(b)) for frame in rows for t, b in zip(frame["start"], frame["breach"], strict=True))
        for start, breach in told:
            if now and (not breach or start != now[1]):
                if now[1] - now[0] >= self.windows * self.step_ms:
                    out.append((key[0], now[0], now[1], "resolved"))
                now = None
            if breach:
                now = (now[0] if now else start, start + self.step_ms)
                if now[1] - now[0] == self.windows * self.step_ms:
                    out.append((key[0], *now, "firing"))
        if now:
            self.run.update(now)
        elif self.run.exists():
            self.run.clear()
        frame = pd.DataFrame(out, columns=["name", "since", "until", "state"])
        for c in ("since", "until"):
            frame[c] = pd.to_datetime(frame[c].astype("int64"), unit="ms")
        yield frame

    def close(self) -> None:
        pass


def held(points: DataFrame, breach: Column, windows: int = 2, step: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Edges ``(name, since, until, state)`` of a rule over ``points(name, ts, …)``.

    ``breach``, an aggregate, is told for each window of ``step``; the rule fires
    once it is true for ``windows`` windows in a row, and is resolved by a window
    in which it isn't, or after a gap. Two stateful steps follow each other: windows
    close behind the watermark, and rows later than ``late`` are left out; then
    one pair of times is kept a name. Needs the RocksDB state store.
    """
    keyed = points.filter("name is not null").withWatermark("ts", late).groupBy(F.window("ts", step).alias("w"), "name").agg(breach.alias("breach"))
    told = keyed.select("name", F.col("w.start").alias("start"), F.coalesce("breach", F.lit(False)).alias("breach"), F.window_time("w").alias("at"))
    step_ms = int(pd.Timedelta(step).total_seconds() * 1000)
    return told.groupBy("name").transformWithStateInPandas(
        Held(windows, step_ms), "name string, since timestamp, until timestamp, state string", "Append", "EventTime"
    )
