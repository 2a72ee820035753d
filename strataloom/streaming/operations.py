"""Operations from their start to their completion, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups that operations are dealt to by their names; those of a group share a call and a state.
GROUPS = 512


def durations(marks: DataFrame, forget: str = "1 day", groups: int = GROUPS) -> DataFrame:
    """A row for each completion of a started operation, from ``marks(name, ts, starts)``.

    A start replaces an earlier one that was not completed, a completion without
    a start tells nothing. The state of an operation is the time of its start;
    it is dropped once the watermark (``forget`` behind the newest mark) has
    passed it, so operations that never complete don't stay. Marks of one
    micro-batch are taken in order of time, starts first, so a trigger's size
    bounds what a task holds, which is one of ``groups``; the caller raises them
    with the number of operations. Marks with a null are left out.
    """

    def emit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, mark = (dict(zip(*state.get, strict=True)) if state.exists else {}), state.getCurrentWatermarkMs()
        out = pd.DataFrame({"name": [], "began": [], "ended": [], "seconds": []})
        if not state.hasTimedOut:
            every = pd.concat(list(frames))
            before = pd.DataFrame({"name": list(held), "ts": pd.to_datetime(list(held.values()), unit="us"), "starts": True})
            before = before[before["name"].isin(every["name"])]
            old, every = len(before), pd.concat([before, every]) if len(before) else every
            # A start that is held comes before all marks of its operation.
            every = every.assign(fresh=[i >= old for i in range(len(every))]).sort_values(["name", "fresh", "ts", "starts"], ascending=[True, True, True, False], kind="stable").reset_index(drop=True)
            by = every.groupby("name", sort=False)
            begun = by["ts"].shift().where(by["starts"].shift(fill_value=False).astype(bool))
            done = ~every["starts"].astype(bool) & begun.notna()
            out = pd.DataFrame({"name": every["name"][done], "began": begun[done], "ended": every["ts"][done], "seconds": (every["ts"] - begun)[done] / pd.Timedelta(1, "us") / 1e6})
            last = by.tail(1)
            fresh = last[last["starts"].astype(bool)]
            touched = set(last["name"])
            held = {n: t for n, t in held.items() if n not in touched and t // 1000 >= mark} | {n: t.value // 1000 for n, t in zip(fresh["name"], fresh["ts"], strict=True)}
        else:
            held = {n: t for n, t in held.items() if t // 1000 >= mark}
        if held:
            state.update((list(held), list(held.values())))
            state.setTimeoutTimestamp(max(min(held.values()) // 1000, mark) + 1)
        elif state.exists:
            state.remove()
        yield out

    known = marks.filter(F.col("name").isNotNull() & F.col("ts").isNotNull() & F.col("starts").isNotNull()).select("name", "ts", "starts")
    return known.withWatermark("ts", forget).withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups))).groupBy("group").applyInPandasWithState(
        emit, "name string, began timestamp, ended timestamp, seconds double", "names array<string>, began array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
