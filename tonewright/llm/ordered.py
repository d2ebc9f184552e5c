"""Running sums along groups of any length, with no group in one task.

Rows are dealt by ranges of (group, order), so that each partition holds whole stretches of the
groups. Nearly all groups lie in one partition; a partition begins and ends with at most one that
does not, so that the table of groups in several partitions has at most two rows for each, whatever
the data, and is sent to all tasks. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import release, stage_folder


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and later steps read only the columns that they use."""
    path = f"{stage_folder(df.sparkSession)}/rows"
    release(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by ranges of the key columns, nulls first, and written; `_part` tells each row's range.

    Rows that agree in all keys share a range, so the keys should tell apart whatever may come in bulk.
    """
    return written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))


def split_groups(df: DataFrame, group: str, value: Column) -> DataFrame:
    """_g, _p, _ahead, _total of the groups that lie in several parts: at most two rows a part."""
    parts = df.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.sum(value).alias("_sum"))
    along, whole = Window.partitionBy("_g").orderBy("_p"), Window.partitionBy("_g")
    summed = parts.select("_g", "_p", (F.sum("_sum").over(along) - F.col("_sum")).alias("_ahead"), F.sum("_sum").over(whole).alias("_all"), F.count("*").over(whole).alias("_n"))
    return summed.where("_n > 1").drop("_n")


def stretch(group: str, order: list[str]) -> WindowSpec:
    """A group's rows in one part, from the first to the row at hand."""
    return Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(df: DataFrame, group: str, order: list[str], value: Column) -> DataFrame:
    """df, as laid_out() gives it, with `_before` and `_total`, the sums of `value` before the row and over its group,
    and `_split`, whether the group lies in several parts. Groups may be null."""
    split = split_groups(df, group, value)
    joined = df.join(F.broadcast(split), df[group].eqNullSafe(split["_g"]) & (df["_part"] == split["_p"]), "left")
    total = F.coalesce("_all", F.sum(value).over(Window.partitionBy(group, "_part")))
    before = F.sum(value).over(stretch(group, order)) - value + F.coalesce("_ahead", F.lit(0))
    return joined.withColumns({"_before": before, "_total": total, "_split": F.col("_all").isNotNull()}).drop("_g", "_p", "_ahead", "_all")
