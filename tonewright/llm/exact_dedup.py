"""Exact duplicates by deterministic block naming.

A text is its UTF-8 bytes. Naming runs in rounds over fixed-size blocks:

* The head block and the byte length name every text first. A text whose pair of
  length and head no other text has is identified already and takes no further part.
* The blocks of the others are sorted and numbered. A block's integer name is made
  of its hash bucket and its place in that bucket's sorted order, so that equal
  blocks get one name, different blocks different names, and a repeated task the
  same names again.
* Adjacent names are paired, the distinct pairs sorted and named likewise, until
  one name stands for each text. With the length it is free of collisions.

All steps are DataFrame operations. Distinct blocks and pairs are counted out
before they are sorted, so a block that a third of all texts share is one row
there; the joins back to the texts are sort-merge joins, which Spark splits when
a key is hot. The number of rounds is the logarithm of the longest text's blocks.

Texts: null counts as empty, and empty texts are equal to each other. Of equal
texts the one with the largest id stays; where the id repeats on rows with the
same text, each row counts, and all rows with that id are marked as kept. Rows with
a null id are kept only if no row of the group has an id. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, thinned

BLOCK_BYTES = 4096
HEAD_BYTES = 64
BUCKETS = 1 << 16


def named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Number distinct keys: `_name` is unique, and depends on nothing but the set of keys."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    return distinct.withColumn("_bucket", bucket).withColumn("_name", F.col("_bucket") + F.lit(BUCKETS) * place).drop("_bucket")


def text_bytes(text_col: str, normalise: Callable[[Column], Column] | None) -> Column:
    """What is compared of a text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (normalise(text) if normalise else text).cast("binary")


def identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, _sha, _size, _name, _alone) of each row: rows with equal texts, and only those, agree in the last three."""
    base = df.select(F.col(id_col).alias("_id"), text_bytes(text_col, normalise).alias("_bytes")).select("_id", "_bytes", F.octet_length("_bytes").cast("long").alias("_size"), F.substring("_bytes", 1, HEAD_BYTES).alias("_head"))
    row_key = F.struct("_id", F.sha2("_bytes", 256).alias("_sha"))
    shared = base.groupBy("_size", "_head").agg(F.count("*").alias("_n")).where("_n > 1").select("_size", "_head")
    open_rows = base.join(shared, ["_size", "_head"], "left_semi")
    count = F.greatest(F.ceil(F.col("_size") / block_bytes), F.lit(1)).cast("int")
    blocks = open_rows.select(row_key.alias("_key"), "_size", "_bytes", count.alias("_blocks"))
    blocks = blocks.select("_key", "_size", "_blocks", "_bytes", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_at"))
    blocks = blocks.select("_key", "_size", "_blocks", "_at", F.expr(f"substring(_bytes, _at * {block_bytes} + 1, {block_bytes})").alias("_block"))
    blocks = checkpointed(blocks)
    names = named(blocks.select("_block").distinct(), "_block")
    level = checkpointed(blocks.join(names, "_block").select("_key", "_size", "_blocks", "_at", "_name"))
    done = [level.where("_blocks = 1")]
    while level.where("_blocks > 1").limit(1).count():
        half = F.expr("_at div 2")
        pairs = (
            level.where("_blocks > 1")
            .groupBy("_key", "_size", ((F.col("_blocks") + 1) / 2).cast("int").alias("_blocks"), half.alias("_at"))
            .agg(F.max(F.when(F.col("_at") % 2 == 0, F.col("_name"))).alias("_l"), F.coalesce(F.max(F.when(F.col("_at") % 2 == 1, F.col("_name"))), F.lit(0)).alias("_r"))
        )
        names = named(pairs.select("_l", "_r").distinct(), "_l", "_r")
        level = checkpointed(pairs.join(names, ["_l", "_r"]).select("_key", "_size", "_blocks", "_at", "_name"))
        done.append(level.where("_blocks = 1"))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    found = found.select("_key", "_name").distinct()
    rows = base.select(row_key.alias("_key"), "_size").join(found, "_key", "left")
    return rows.select(F.col("_key._id").alias(id_col), F.col("_key._sha").alias("_sha"), "_size", "_name", F.when(F.col("_name").isNull(), F.col("_key")).alias("_alone"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256."""
    rows = checkpointed(identities(df, id_col, text_col, normalise, block_bytes))
    group = rows.where("_name is not null").groupBy("_size", "_name").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    joined = rows.join(group, ["_size", "_name"], "left")
    keep = F.when(F.col("_name").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return joined.select(id_col, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of df that stay, one for each distinct text, with df's columns.

    A row goes by its id and text together: other texts under the same id, or under a null id, stay.
    """
    found = groups(df, id_col, text_col, normalise).select(id_col, "text_sha256", "kept")
    gone = found.where(~F.col("kept")).select(id_col, "text_sha256").distinct()
    repeated = found.where("kept").groupBy(id_col, "text_sha256").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return thinned(df, [F.col(id_col), F.sha2(text_bytes(text_col, normalise), 256)], gone, repeated)
