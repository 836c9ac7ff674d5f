"""Online loop and streak detection over an event stream (an extension: the batch form is operators.trajectory).

State is one small struct per trajectory, kept with a time-out, so a trajectory that ends is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "rid string, turn long, kill string"
#: A trajectory without an event for so long (in event time) is forgotten.
IDLE_MS = 30 * 24 * 3600 * 1000
STATE = "turn long, a1 string, a2 string, a3 string, streak int, killed boolean"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    turn, a1, a2, a3, streak, killed = state.get if state.exists else (0, None, None, None, 0, False)
    rows = pd.concat([*batches]).sort_values(["ts", "event_id"])
    found = []
    for action, nothing in zip(rows["action"], rows["nothing"], strict=True):
        turn += 1
        streak = streak + 1 if nothing else 0
        kill = "loop" if action == a1 == a2 or (action == a2 and a1 == a3 and action != a1 and a1 is not None) else "stuck" if streak >= 4 else None
        if kill and not killed:
            killed = True
            found.append((key[0], turn, kill))
        a1, a2, a3 = action, a1, a2
    state.update((turn, a1, a2, a3, streak, killed))
    state.setTimeoutTimestamp(max(int(rows["ts"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + IDLE_MS)
    yield pd.DataFrame(found, columns=["rid", "turn", "kill"])


def kills(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """rid, ts, event_id, action, nothing (stream) -> the first violation of each trajectory, as it happens."""
    return events.withWatermark("ts", late).groupBy("rid").applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_rates(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and errors by type in event-time windows, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
