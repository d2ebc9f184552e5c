"""Runs, islands, merged intervals, rolling windows and boundary selection."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, flag: Column, track: str, order: str) -> DataFrame:
    """Rows where `flag` holds, with `island`: the number of their run of consecutive rows."""
    w = Window.partitionBy(track).orderBy(order)
    df = df.withColumn("_flag", flag.cast("int"))
    opens = F.when((F.col("_flag") == 1) & (F.coalesce(F.lag("_flag").over(w), F.lit(0)) == 0), 1).otherwise(0)
    df = df.withColumn("_opens", opens)
    return df.withColumn("island", F.sum("_opens").over(w)).where("_flag = 1").drop("_flag", "_opens")


def run_lengths(df: DataFrame, value: str, track: str, order: str) -> DataFrame:
    """(track, run, value, first, last, n) of consecutive equal values."""
    w = Window.partitionBy(track).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    numbered = df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w))
    return numbered.groupBy(track, "run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def merged_intervals(df: DataFrame, track: str, start: str, end: str, tolerance: float) -> DataFrame:
    """(track, part, start, end, n): intervals that overlap or lie within `tolerance` become one."""
    w = Window.partitionBy(track).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col(start) <= reach + tolerance, 0).otherwise(1)
    parts = df.withColumn("_apart", apart).withColumn("part", F.sum("_apart").over(w))
    return parts.groupBy(track, "part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def local_maxima(value: str, track: str, order: str) -> Column:
    """At least both neighbours; the ends never are."""
    w = Window.partitionBy(track).orderBy(order)
    return F.coalesce((F.col(value) >= F.lag(value).over(w)) & (F.col(value) >= F.lead(value).over(w)), F.lit(False))


def spaced_peaks(df: DataFrame, track: str, time: str, score: str, distance: float, last: str) -> DataFrame:
    """Greedy choice within each track: best score first, kept if no kept one, nor the start or the end (`last`), is nearer than `distance`; ties go to the earlier.

    Each pick depends on all picks before it, so a track is one group; it holds a track's candidate peaks, not its frames.
    Kept times stay sorted, so that a candidate is compared with its two neighbours only.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = [0.0, float(pdf[last].iloc[0])]
        chosen = []
        for i, t in pdf.sort_values([score, time], ascending=[False, True])[time].items():
            at = bisect.bisect(kept, t)
            if t - kept[max(at - 1, 0)] >= distance and kept[min(at, len(kept) - 1)] - t >= distance:
                kept.insert(at, t)
                chosen.append(i)
        return pdf.loc[sorted(chosen)]

    return df.groupBy(track).applyInPandas(pick, df.schema)


def rolling(df: DataFrame, ts: str, length: str, hop: str, *keys: str) -> DataFrame:
    """Rows with the start and end of each sliding window that holds them."""
    return df.withColumn("_w", F.window(F.col(ts).cast("timestamp"), length, hop)).withColumns({"start": F.col("_w.start"), "end": F.col("_w.end")}).drop("_w")


def split_long(df: DataFrame, track: str, start: str, end: str, limit: float) -> DataFrame:
    """Cut intervals longer than `limit` into equal parts that are not."""
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / limit), F.lit(1))
    parts = df.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    step = (F.col(end) - F.col(start)) / F.col("_n")
    return parts.withColumns({"part_start": F.col(start) + F.col("part") * step, "part_end": F.when(F.col("part") == F.col("_n") - 1, F.col(end)).otherwise(F.col(start) + (F.col("part") + 1) * step)}).drop("_n")
