"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct words (ASCII letters lower-cased, split at ASCII
characters that are neither letters nor digits) and the beginnings of its longer
words, hashed into a fixed number of slots. A factorization machine learns a weight
for each slot and a short vector whose inner products weigh pairs of terms, so that
an insult that stands beside a mention of people counts for more than both weights
added up. Terms enter the model that the labels clearly depend on, by the chi-square
statistic, or that are frequent enough to be learned about in pairs; among rare terms
that are neither, chance would choose.

The model is fitted on a bounded sample of labelled rows: at most
`max_positive` toxic and `max_negative` other rows, those with the smallest hash
of doc_id. It has no more terms than there are slots, 2 ** SLOT_BITS, so that it can be
sent to all tasks.

Texts: null and empty texts have no terms and get the score of the bias alone;
very long texts count whole; repeated rows get the same score. Labels that are
null are not used; a document labelled more than once counts as toxic if any of
its labels says so. Without labels of both kinds all scores are the share of
toxic labels (0 without labels). Other columns pass through unless the score
column replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, byte_texts, slices

SLOT_BITS = 20
#: Bytes of a word's beginning that count as terms of their own, for inflected forms.
STEMS = (4, 6)


def term_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all texts one after another, distinct words once, and how many each text has."""
    terms = []
    for t in texts:
        words = set(t.translate(WORD_BYTES).split())
        terms.append(words.union(*[[b"^" + w[:k] for w in words if len(w) >= k] for k in STEMS]))
    sizes = np.fromiter(map(len, terms), np.int64, len(terms))
    slots = np.fromiter(map(crc32, chain.from_iterable(terms)), np.int64, int(sizes.sum()))
    return slots & ((1 << SLOT_BITS) - 1), sizes


def row_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; runs may be empty."""
    out = np.zeros((len(sizes), *values.shape[1:]))
    filled = np.flatnonzero(sizes)
    if len(filled):
        out[filled] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[filled], axis=0, dtype=np.float64)
    return out


@dataclass
class FactorizationMachine:
    """Term index by slot (-1: not in the model), bias, weights and factors."""

    index: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        v = self.factors[ids]
        s = row_sums(v, sizes)
        return self.bias + row_sums(self.weights[ids], sizes) + 0.5 * (s**2 - row_sums(v**2, sizes)).sum(axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        slots, sizes = term_slots(texts)
        ids = self.index[slots]
        known = ids >= 0
        owner = np.repeat(np.arange(len(sizes)), sizes)[known]
        z = self.logits(ids[known], np.bincount(owner, minlength=len(sizes)))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_arrays(slots: np.ndarray, sizes: np.ndarray, toxic: np.ndarray, prior: float, least_chi: float = 30.0, frequent: float = 0.3, rank: int = 4, rounds: int = 80, rate: float = 0.08, decay: float = 2e-4, seed: int = 7) -> FactorizationMachine:
    """Fit by Adam on whole-batch gradients of the log loss, with the rows of both kinds weighted to the prior."""
    width = 1 << SLOT_BITS
    index = np.full(width, -1, np.int32)
    if not toxic.any() or toxic.all():
        p = float(np.clip(prior, 1e-6, 1 - 1e-6))
        return FactorizationMachine(index, float(np.log(p / (1 - p))), np.zeros(1), np.zeros((1, rank)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n1, n = toxic.sum(), len(toxic)
    both = np.bincount(slots, minlength=width)
    hits = np.bincount(slots[toxic[owner]], minlength=width)
    expected = both * (n1 / n)
    chi = np.where(both >= 3, (hits - expected) ** 2 / np.maximum(expected * (1 - n1 / n) * (1 - both / (n + 1)), 1e-9), 0)
    told = (chi >= least_chi) | (both >= max(frequent * n, 50))
    chosen = np.flatnonzero(told)
    index[chosen] = np.arange(len(chosen))
    ids = index[slots]
    known = ids >= 0
    ids, owner = ids[known], owner[known].astype(np.int32)
    sizes = np.bincount(owner, minlength=n)
    by_term, term_sizes = owner[np.argsort(ids, kind="stable")], np.bincount(ids, minlength=len(chosen))
    del slots, known, owner, both, hits, expected, chi, told
    y = toxic.astype(float)
    row_weight = np.where(toxic, prior / n1, (1 - prior) / (n - n1)) * n
    rng = np.random.default_rng(seed)
    m = FactorizationMachine(index, float(np.log(prior / (1 - prior))), np.zeros(max(len(chosen), 1)), rng.normal(0, 0.02, (max(len(chosen), 1), rank)).astype(np.float32))
    if not len(chosen):
        return m
    momentum: list = [0.0, np.zeros_like(m.weights), np.zeros_like(m.factors)]
    scale: list = [0.0, np.zeros_like(m.weights), np.zeros_like(m.factors)]
    for t in range(1, rounds + 1):
        v = m.factors[ids]
        s = row_sums(v, sizes)
        z = m.bias + row_sums(m.weights[ids], sizes) + 0.5 * (s**2 - row_sums(v**2, sizes)).sum(axis=1)
        g = row_weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        of_term = row_sums(g[by_term], term_sizes)
        of_factor = row_sums((g[:, None] * s).astype(np.float32)[by_term], term_sizes) - of_term[:, None] * m.factors
        grads = [g.sum(), of_term + decay * m.weights, of_factor + decay * m.factors]
        steps = []
        for i, grad in enumerate(grads):
            momentum[i] = 0.9 * momentum[i] + 0.1 * grad
            scale[i] = 0.99 * scale[i] + 0.01 * grad**2
            steps.append(rate * (momentum[i] / (1 - 0.9**t)) / (np.sqrt(scale[i] / (1 - 0.99**t)) + 1e-8))
        m.bias -= float(steps[0])
        m.weights -= steps[1]
        m.factors -= steps[2].astype(np.float32)
    m.weights, m.factors = m.weights.astype(np.float32), m.factors.astype(np.float32)
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """The fold from whose rows no label is learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = 6_000, max_negative: int = 14_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> FactorizationMachine:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    rows = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    rows = rows.groupBy("_id").agg(F.max("_y").alias("_y")).where(~held_out("_id"))
    counts = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    pick = [rows.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(k) for y, k in ((1, max_positive), (0, max_negative))]
    sample = pick[0].unionByName(pick[1])  # at most max_positive + max_negative short rows
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id").select("_y", "_text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            slots, sizes = term_slots(byte_texts(b, "_text"))
            ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(slots, pa.int32()))], names=["_y", "slots"])

    got = texts.mapInArrow(hashed, "_y int, slots array<int>").toArrow()
    lists = got["slots"].combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    slots = np.asarray(lists.flatten(), np.int64)
    sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return fit_arrays(slots, sizes, np.asarray(got["_y"]) == 1, prior, **options)


def score(df: DataFrame, model: FactorizationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the score of each whole text."""
    kept = df.drop(*([score_col] if score_col != text_col else []))
    schema = T.StructType([*kept.schema.fields, T.StructField(score_col, T.DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for b in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(machine.scores(byte_texts(b, text_col)), pa.float64())], names=[*b.schema.names, score_col])

    return kept.mapInArrow(run, schema)
