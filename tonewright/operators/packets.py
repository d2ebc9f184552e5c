"""Nested packets of unknown depth, as VARIANT values: every object in them, their terms and entries, and fields by level of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

MOST_TERMS = 16


def parsed(df: DataFrame, text: str, value: str = "value") -> DataFrame:
    """Adds the JSON text as a VARIANT; text that is no JSON gives null, which holds nothing."""
    return df.withColumn(value, F.try_parse_json(F.col(text)))


def objects(df: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, path, depth, object): every object in the values, at any depth, in lists too.

    A path is that of a JSON pointer, so that no two places share one. One pass a level; a level holds only what can hold
    more, so that the passes end with the deepest object.
    """
    spark = df.sparkSession
    kind = F.schema_of_variant("object")
    holds = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    level = df.select(F.col(key).alias("_id"), F.lit("").alias("path"), F.lit(0).alias("depth"), F.col(value).alias("object")).where(F.col("object").isNotNull() & holds)
    level, found = stored(level.withColumn("is_object", kind.startswith("OBJECT"))), None
    while level.limit(1).count():
        found = level if found is None else found.unionByName(level)
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("object").outer())).select(
            "_id",
            F.concat("path", F.lit("/"), F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))).alias("path"),
            (F.col("depth") + 1).alias("depth"),
            F.col("value").alias("object"),
        )
        level = stored(inner.where(holds).withColumn("is_object", kind.startswith("OBJECT")))
    return (level if found is None else found).where("is_object").select(F.col("_id").alias(key), "path", "depth", "object")


def terms(found: DataFrame) -> DataFrame:
    """Objects with a `term` that is a text."""
    inside = F.try_variant_get("object", "$.term", "variant")
    return found.where(inside.isNotNull() & (F.schema_of_variant(inside) == "STRING")).withColumn("term", F.try_variant_get("object", "$.term", "string"))


def entries(found: DataFrame) -> DataFrame:
    """Objects with a `qualitative_value`, be it null."""
    inside = F.try_variant_get("object", "$.qualitative_value", "variant")
    return found.where(inside.isNotNull()).withColumn("qualitative_value", F.coalesce(F.try_variant_get("object", "$.qualitative_value", "string"), F.lit("")))


def term_counts(found: DataFrame, group: str, most: int = MOST_TERMS) -> DataFrame:
    """(group, term, n, rank): how often each term stands in the packets of a group, the most frequent; ties by the term."""
    counted = terms(found).groupBy(group, "term").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most)


def entry_score(found: DataFrame, key: str, weights: dict[str, float], otherwise: float = 0.2) -> DataFrame:
    """(key, score, n): mean weight of the entries' words; packets without entries are left out."""
    word = F.col("qualitative_value")
    weight = F.coalesce(*[F.when(word == w, F.lit(x)) for w, x in weights.items()], F.lit(otherwise))
    return entries(found).groupBy(key).agg(F.avg(weight).alias("score"), F.count("*").alias("n"))


# Fields by precedence


def told(value: Column) -> Column:
    """A text without blanks at its ends; empty ones are as if not told."""
    return F.nullif(F.trim(value, F.lit(" \t\n\r\x0b\x0c")), F.lit(""))


def preferred(keys: DataFrame, levels: list[tuple[str, DataFrame]], on: list[str], fields: list[str]) -> DataFrame:
    """keys with each field's first told value by the order of `levels`, and `<field>_from`, the level that told it.

    A level is a relation with the columns of `on` and any of the fields, as sparse as it likes; a null or empty field of a
    higher level does not hide a lower one's. A level has at most one row a key: the one that sorts first stands for the others.
    """
    df = keys
    for name, relation in levels:
        here = [f for f in fields if f in relation.columns]
        row = F.struct(*[told(F.col(f)).alias(f) for f in here])
        df = df.join(relation.groupBy(*on).agg(F.min(row).alias(f"_{name}")), on, "left")
    for f in fields:
        found = [(n, F.col(f"_{n}").getField(f)) for n, relation in levels if f in relation.columns]
        df = df.withColumns({f: F.coalesce(*[x for _, x in found], F.lit("")), f"{f}_from": F.coalesce(*[F.when(x.isNotNull(), n) for n, x in found])})
    return df.drop(*[f"_{n}" for n, _ in levels])


def by_middle(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """segments with the first span (by place) that holds their middle; spans (track, place, from_s, to_s, ..) are half open.

    They meet by the seconds that a span touches.
    """
    middle = (F.col("start_s") + F.col("end_s")) / 2
    long = spans.where("to_s > from_s").withColumn("_s", F.explode(F.sequence(F.floor("from_s").cast("long"), F.greatest(F.floor("from_s"), F.ceil("to_s") - 1).cast("long"))))
    met = segments.select("track", "segment", middle.alias("_m")).withColumn("_s", F.floor("_m").cast("long")).join(long, ["track", "_s"]).where("from_s <= _m AND _m < to_s")
    row = F.struct("place", *[c for c in spans.columns if c not in ("track", "place", "from_s", "to_s")])
    return met.groupBy("track", "segment").agg(F.min_by(row, "place").alias("_r")).select("track", "segment", "_r.*")


# Lookups on lists of keys


def looked_up(df: DataFrame, key: list[str], names: str, index: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """df with `found`: the index rows of a list's names, in the list's order; names that the index lacks are left out, repeats stay.

    The list is spread with its places, met with the index by name, and put together again by place.
    """
    spread = df.select(*key, F.posexplode(names).alias("_p", "_name"))
    rows = index.groupBy(name).agg(F.min(F.struct(*fields)).alias("_row")).withColumnRenamed(name, "_name")
    met = spread.join(rows, "_name").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_p", F.col("_name").alias(name), *[F.col(f"_row.{f}").alias(f) for f in fields]))).alias("_all"))
    out = F.transform("_all", lambda x: F.struct(x[name].alias(name), *[x[f].alias(f) for f in fields]))
    empty = F.array().cast("array<struct<" + ",".join([f"{name}:string", *[f"{f}:{dict(index.dtypes)[f]}" for f in fields]]) + ">>")
    return df.join(met.select(*key, out.alias("found")), key, "left").withColumn("found", F.coalesce("found", empty))


def phrase(found: Column, field: str, most: int = 5, otherwise: str = "professional term anchor unavailable") -> Column:
    """The first told fields of a list of rows, joined by semicolons."""
    some = F.filter(F.transform(found, lambda x: x[field]), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(some) > 0, F.array_join(F.slice(some, 1, most), "; ")).otherwise(otherwise)
