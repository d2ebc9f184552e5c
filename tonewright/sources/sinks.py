"""Sinks: layers as Parquet or JSON, and bounded Markdown reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def write_layer(df: DataFrame, root: str, name: str, kind: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write a layer under a safe name and say where; nothing else is changed."""
    safe = df.sparkSession.range(1).select(S.file_name(F.lit(name)).alias("x")).first()["x"]
    path = f"{root}/{safe}"
    writer = df.write.mode("overwrite").format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def _commits(spark: SparkSession, folder: str, layer: str) -> list[tuple[int, str]]:
    """The numbers and versions that a layer has had; one short row for each time it was replaced."""
    try:
        rows = spark.read.schema("n long, version string").json(f"{folder}/{layer}/commits/*").where("version IS NOT NULL").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((r["n"], r["version"]) for r in rows)


def upsert_layer(df: DataFrame, folder: str, layer: str) -> str:
    """Replace one layer in a folder of layers, and leave all others; says which version is the current one.

    A version is named by its rows and columns, whatever their order, and written whole before a commit names it; a reader
    sees the last version that a commit names. So a run that fails before that leaves the old layer, and one that
    is run again with the same rows changes nothing. Of two that commit at once, the one whose version sorts last counts.
    """
    spark = df.sparkSession
    row = F.xxhash64(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}))
    told = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias("t")).first()
    kinds = ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    version = spark.range(1).select(F.sha2(F.lit(f"{told['n']}:{told['s']}:{told['t']}:{kinds}"), 256).alias("v")).first()["v"][:32]
    past = _commits(spark, folder, layer)
    if past and past[-1][1] == version:
        return version
    if version not in {v for _, v in past}:
        df.write.mode("overwrite").parquet(f"{folder}/{layer}/versions/{version}")
    n = past[-1][0] + 1 if past else 0
    spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(version).alias("version")).coalesce(1).write.mode("overwrite").json(f"{folder}/{layer}/commits/{n:010d}-{version}")
    return version


def read_layer(spark: SparkSession, folder: str, layer: str) -> DataFrame | None:
    """The current version of a layer, or nothing."""
    past = _commits(spark, folder, layer)
    return spark.read.parquet(f"{folder}/{layer}/versions/{past[-1][1]}") if past else None


def read_layers(spark: SparkSession, folder: str, layers: list[str]) -> DataFrame:
    """The current versions of layers, one under the other, with their names; those that are not there are left out."""
    found = [(n, read_layer(spark, folder, n)) for n in layers]
    out = None
    for n, df in found:
        if df is not None:
            df = df.withColumn("layer", F.lit(n))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no layers in {folder}")
    return out


def markdown_lines(df: DataFrame, track: str, order: str, columns: list[str], limit: int = 80) -> DataFrame:
    """(track, report): one Markdown table for each track over its first `limit` rows, assembled by Spark."""
    cell = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    top = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    rank = F.row_number().over(Window.partitionBy(track).orderBy(order, cell))
    rows = df.select(track, cell.alias("line"), rank.alias("k")).where(F.col("k") <= limit)  # ranked before any list is made
    rows = rows.groupBy(track).agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("rs"))
    return rows.select(track, F.concat(F.lit(top + "\n"), F.array_join(F.transform("rs", lambda r: r["line"]), "\n")).alias("report"))
