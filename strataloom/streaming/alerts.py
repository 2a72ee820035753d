"""Alerts over metric points as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Metric and the bound above which its alert is on.
RULES = {"error_rate": 0.1, "memory_percent": 80.0, "failure_rate": 0.2, "average_seconds": 30.0}


def alerts(points: DataFrame, rules: dict[str, float] | None = None) -> DataFrame:
    """Edges of each rule's alert over ``points(name, ts, value)``.

    A row is emitted where a value first exceeds its bound (``triggered``) and
    where a value is first within it again (``resolved``); the state kept is
    one flag per metric. Points of a micro-batch are taken in order of time, so
    a trigger's size bounds what a task holds. Null values and metrics without
    a rule are left out.
    """
    bounds = dict(RULES if rules is None else rules)

    def edges(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, out = bool(state.get[0]) if state.exists else False, []
        every = pd.concat(list(frames)).sort_values(["ts", "value"])
        for ts, value in zip(every["ts"], every["value"], strict=True):
            if (value > bounds[key[0]]) != active:
                active = not active
                out.append((key[0], ts, value, "triggered" if active else "resolved"))
        state.update((active,))
        yield pd.DataFrame(out, columns=["name", "ts", "value", "state"])

    known = points.filter(F.col("name").isin(*bounds) & F.col("value").isNotNull()).select("name", "ts", "value")
    return known.groupBy("name").applyInPandasWithState(
        edges, "name string, ts timestamp, value double, state string", "active boolean", "append", GroupStateTimeout.NoTimeout
    )
