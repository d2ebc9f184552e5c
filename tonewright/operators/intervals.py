"""Joins on intervals and nearest points, by equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / width), F.floor(end / width))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows with equal keys whose half-open intervals overlap.

    Each interval goes to the buckets of `width` that it touches, and a pair is taken in the first bucket
    that both touch, so that each comes once without a distinct. Hot buckets are split by Spark's skew join.
    """
    l = left.withColumn("_b", F.explode(_buckets(F.col(a[0]), F.col(a[1]), width)))
    r = right.withColumn("_b", F.explode(_buckets(F.col(b[0]), F.col(b[1]), width)))
    both = l.join(r, [*keys, "_b"])
    first = F.greatest(F.floor(F.col(a[0]) / width), F.floor(F.col(b[0]) / width))
    return both.where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (F.col("_b") == first)).drop("_b")


def range_lookup(points: DataFrame, ranges: DataFrame, keys: list[str], time: str, start: str, end: str, width: float) -> DataFrame:
    """Points with the ranges [start, end) that hold them."""
    p = points.withColumn("_b", F.floor(F.col(time) / width))
    r = ranges.withColumn("_b", F.explode(_buckets(F.col(start), F.col(end), width)))
    return p.join(r, [*keys, "_b"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("_b")


def nearest_before_and_after(points: DataFrame, marks: DataFrame, keys: list[str], time: str, mark: str) -> DataFrame:
    """Points with the nearest mark of the same keys, the earlier one on ties; one sort instead of a join.

    Both sides are laid in one time line, and each point takes the last mark before and the first mark behind it.
    """
    rows = points.withColumns({"_t": F.col(time), "_mark": F.lit(None).cast("double")}).unionByName(marks.select(*keys, F.col(mark).alias("_t"), F.col(mark).cast("double").alias("_mark")), allowMissingColumns=True)
    so_far = lambda order: Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    before = F.last("_mark", ignorenulls=True).over(so_far(F.asc("_t")))
    behind = F.last("_mark", ignorenulls=True).over(so_far(F.desc("_t")))  # a growing frame too, from the other end
    rows = rows.withColumns({"_before": before, "_behind": behind}).where(F.col("_mark").isNull())
    near = F.when(F.col("_before").isNull(), F.col("_behind")).when(F.col("_behind").isNull(), F.col("_before")).when(F.col("_t") - F.col("_before") <= F.col("_behind") - F.col("_t"), F.col("_before")).otherwise(F.col("_behind"))
    return rows.withColumn("nearest", near).drop("_t", "_mark", "_before", "_behind")
