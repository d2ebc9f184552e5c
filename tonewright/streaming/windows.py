"""Streaming twins of the rolling windows: state bounded by watermark and window, or one number for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rolling_activity(events: DataFrame, ts: str, key: str, value: str, length: str = "3 days", hop: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count, mean and maximum of sliding windows; rows later than `late` are dropped with their window's state."""
    stream = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = stream.groupBy(F.window("_ts", length, hop).alias("w"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("highest"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "highest")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a key without a pause longer than `gap`."""
    stream = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    out = stream.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def relative_contrast(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Change of each value against the last one of its key, across micro-batches; the state is one number for each key, for good, so keys must be bounded."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        change = rows[value] - rows[value].shift(1, fill_value=last if last is not None else rows[value].iloc[0])
        state.update((float(rows[value].iloc[-1]),))
        yield pd.DataFrame({key: keys[0], order: rows[order], "change": change})

    kinds = dict(events.dtypes)
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, change double", "last double", "append", GroupStateTimeout.NoTimeout)
