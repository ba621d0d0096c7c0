"""Object state over a stream of events: an extension, as the batch analysis is a bounded fold over ordered events.

`current_state` keeps the last value of each (object, field) with event-time order and a watermark; `windows` counts by tumbling windows and drops late
rows; `sessions` groups bursts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, event_type string, value double, ts timestamp, version long"
STATE = "value double, micros long, event_id long, version long"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value, micros, last, version = state.get if state.exists else (float("nan"), -1, -1, 0)
    changed = False
    for pdf in batches:
        pdf = pdf.sort_values(["ts", "event_id"])
        for ts, event_id, v in zip(pdf["ts"], pdf["event_id"], pdf["value"]):
            at = int(pd.Timestamp(ts).value // 1000)
            version += 1
            if (at, int(event_id)) > (micros, last):  # an older event doesn't undo a newer one
                value, micros, last, changed = float(v), at, int(event_id), True
    state.update((value, micros, last, version))
    if changed:
        yield pd.DataFrame([{"user_id": int(key[0]), "event_type": str(key[1]), "value": value, "ts": pd.Timestamp(micros * 1000), "version": version}])


def current_state(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A row for each (user_id, event_type) that changed in a micro-batch: its value last in event time and its number of writes."""
    keyed = events.withWatermark("ts", delay).select("user_id", "event_type", "event_id", "ts", "value")
    return keyed.groupBy("user_id", "event_type").applyInPandasWithState(_fold, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windows(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
