"""A corpus pipeline over the table `documents`, one operator a stage.

Each stage takes what its predecessor kept, decides over all of it, and hands on the rows
that stay with the columns of documents; the last one adds the ids of byte-level BPE and
the text that they decode to. Every stage is written as Parquet and read again, so that a
lost executor costs at most the stage that runs.

Toxicity learns from `labels` and the documents that reach the stage, exact duplicates keep
the row with the largest doc_id, near duplicates (five-word shingles, similarity 0.8 or
more) keep the smallest doc_id of each group, and documents that hold any stretch of ten
words of a benchmark item go.

Null texts count as empty: they pass toxicity by the score of no terms, and of all empty
texts one stays. A row goes by its id and text together, so that different texts under one
id, or under null ids, stay; rows that repeat an id and a text come down to one. Other
columns pass through all stages as they are, whatever their names: a stage sees a row's id and text, and the others in one
struct. Where documents has a column named like one that the last stage adds, the added one gets underscores behind its name. An empty table of documents gives an empty table; without
labels nothing is toxic, and without a benchmark nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm import bpe, decontaminate, exact_dedup, ngram_join, toxicity
from tonewright.llm.common import free, stage_folder

TOXIC_FROM = 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one struct, so that none of them can meet a column that an operator makes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("_row")] if others else []))


def _unpacked(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """packed rows with the columns of docs, in their order, and the columns that packed has beside doc_id, text and the struct."""
    own = [F.col(c) if c in ("doc_id", "text") else F.col("_row").getField(c).alias(c) for c in docs.columns]
    added = [F.col(c).alias(free(docs.columns, c)) for c in packed.columns if c not in ("doc_id", "text", "_row")]
    return packed.select(*own, *added)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.score(_packed(docs), model).where(F.col("score") < TOXIC_FROM).drop("score"), docs)


def _distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(exact_dedup.deduplicate(_packed(docs)), docs)


def _dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(ngram_join.one_of_each(_packed(docs), size=5, percent=80), docs)


def _unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(found.where(F.col("n_hit") == 0).select(*_packed(docs).columns), docs)


def _encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(_packed(docs))
    tokens = (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens")
    return _unpacked(out.select(*_packed(docs).columns, tokens, "ids_le", "decoded"), docs)


STAGES = [
    ("toxicity", _clean),
    ("exact_dedup", _distinct),
    ("ngram_jaccard_join", _dissimilar),
    ("decontamination", _unseen),
    ("bpe", _encoded),
]

#: The classifier and the tokenizer cannot be told in SQL; the tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written in the shared folder and read again."""
    folder = stage_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
