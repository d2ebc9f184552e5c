"""Grouped summaries with fixed ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weighted_mean(value: str, support: str, floor: float = 0.05) -> Column:
    """Mean weighted by support, which counts as `floor` at least."""
    weight = F.greatest(F.lit(floor), F.col(support))
    return F.sum(F.col(value) * weight) / F.sum(weight)


def first_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, n): the most frequent value of each group, the one seen first on ties; two aggregations, no window."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("r"), "_first", F.col(value).alias("v"), "n")).alias("x"))
    return best.select(*keys, F.col("x.v").alias(value), F.col("x.n").alias("n"))


def term_summary(hits: DataFrame, term: str, row: str, weight: str, section: str, examples: int) -> DataFrame:
    """(term, n, weighted, sections, examples): counts of hits and the rows with the smallest ids."""
    counts = hits.groupBy(term).agg(F.count("*").alias("n"), F.sum(weight).cast("long").alias("weighted"), F.countDistinct(section).alias("sections"))
    # Ranks keep `examples` ids of each part, then of each term, so that no list grows with the input.
    part = F.pmod(F.xxhash64(row), F.lit(64))
    ids = hits.select(term, row, part.alias("_part")).distinct()
    for keys in ((term, "_part"), (term,)):
        ids = ids.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(row))).where(F.col("_k") <= examples)
    ids = ids.groupBy(term).agg(F.array_join(F.array_sort(F.collect_list(row)), ",").alias("examples"))
    return counts.join(ids, term)
