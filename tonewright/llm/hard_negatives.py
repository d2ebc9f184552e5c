"""Hard negatives for contrastive training, found by inner products in a rotated basis.

Vectors become whole numbers (`floor(scale * x)`), so that every score is exact. An orthogonal
rotation onto the principal axes of all rows leaves inner products as they are and moves most of
their weight into the leading components. A task adds up the leading components' products of
a row with an anchor; the lengths of what is left of both bound the rest (Cauchy-Schwarz), and
a slack in proportion to both lengths covers rounding and the rotation's distance from an
orthogonal one. Pairs whose bounds miss what the anchor still looks for go early; those that
survive all cuts get their integer product, and only that one decides.

Anchors are a stated query set against all rows: they are sent to the tasks in blocks of at most
BLOCK_BYTES, for each of which the rows are passed through for positives and then for negatives.
A pass over the anchor rows alone comes before each and gives scores that the k-th best cannot
fall below, so that tasks discard from their first row on. A task keeps at most `positives` rows
an anchor and `negatives` rows an anchor and positive; nothing else leaves it.

Defined results:
* Null ids, labels or vectors and null or non-finite components (also after scaling): the row takes no part.
* Vectors of different lengths: what is missing counts as zero; empty vectors score 0.
* Ties: the smaller id first. Other rows are those with another id; rows that repeat an id each count,
  and equal anchor rows (id, label and vector) are one anchor.
* Products beyond 64 bits are worked out exactly, ordered by the end of the range that they pass, and given as that end.
* Anchors without a positive, positives without a negative and empty tables give no rows.
* Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Bytes of anchors, in whole and in rotated numbers, that go to the tasks at once.
BLOCK_BYTES = 32 << 20
#: Rows and anchors whose products a task holds at once, and pairs that it verifies at once.
ROWS, ANCHORS, PAIRS = 1024, 2048, 1 << 15
#: Shares of the squared length that the leading components of the first cuts hold.
CUTS = (0.5, 0.8)
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def _vectors(batch: pa.RecordBatch, size: int, scale: float) -> np.ndarray:
    """The batch's vectors as whole numbers in doubles, one a row, filled up with zeros."""
    column = batch.column(batch.schema.get_field_index("v"))
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.floor(scale * np.asarray(column.flatten(), np.float64))
    out = np.zeros((batch.num_rows, size))
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def _second_moments(size: int, scale: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            v = _vectors(b, size, scale)
            total += v.T @ v
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    return run


@dataclass
class Rotation:
    """Principal axes as columns, the components at which products are cut, and the relative slack."""

    axes: np.ndarray
    cuts: list[int]
    slack: float


def rotation(rows: DataFrame, size: int, scale: float) -> Rotation:
    """The axes of all rows' second moments; size * size numbers come to the driver."""
    sums = rows.select("v").mapInArrow(_second_moments(size, scale), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    m = np.zeros((size, size))
    m[np.asarray(sums["i"]), np.asarray(sums["j"])] = np.asarray(sums["s"])
    top = np.abs(m).max()
    m /= top if 0 < top < np.inf else 1.0
    if not np.isfinite(m).all():  # squares beyond doubles: any axes are right, these cut nothing early
        m = np.eye(size)
    values, axes = np.linalg.eigh(np.triu(m) + np.triu(m, 1).T)
    axes, share = axes[:, ::-1].copy(), np.cumsum(np.maximum(values[::-1], 0))
    cuts = sorted({int(np.searchsorted(share, c * share[-1])) + 1 for c in CUTS} - {size}) if share[-1] > 0 else []
    skew = np.linalg.norm(axes.T @ axes - np.eye(size))
    return Rotation(axes, [c for c in cuts if c < size], float(skew + 32 * size * np.finfo(float).eps))


@dataclass
class Points:
    """Some rows: whole-number vectors, rotated ones, and for each cut the length of what is left."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    turned: np.ndarray = field(init=False)
    rests: list[np.ndarray] = field(init=False)
    lengths: np.ndarray = field(init=False)

    def rotate(self, r: Rotation) -> Points:
        self.turned = self.whole @ r.axes
        self.lengths = np.linalg.norm(self.whole, axis=1)
        self.rests = [np.linalg.norm(self.turned[:, c:], axis=1) for c in r.cuts]
        return self

    def part(self, a: int, b: int) -> Points:
        p = Points(self.ids[a:b], self.labels[a:b], self.whole[a:b])
        p.turned, p.lengths, p.rests = self.turned[a:b], self.lengths[a:b], [x[a:b] for x in self.rests]
        return p


def _points(batch: pa.RecordBatch, size: int, scale: float, r: Rotation) -> Points:
    ids, labels = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("id", "label"))
    return Points(ids, labels, _vectors(batch, size, scale)).rotate(r)


def _products(a: np.ndarray, b: np.ndarray, far: float) -> np.ndarray:
    """Integer products of paired whole-number vectors; `far` bounds their size."""
    if far < 2.0**62:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    exact = [sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for p, q in zip(a, b, strict=True)]
    return np.array([min(max(x, LOWEST), HIGHEST) for x in exact], np.int64)


def _least(limits: np.ndarray) -> np.ndarray:
    """Lower limits as doubles; the lowest 64-bit number stands for all below it."""
    return np.where(limits == LOWEST, -np.inf, limits.astype(float))


def _most(limits: np.ndarray) -> np.ndarray:
    """Upper limits as doubles; the highest 64-bit number stands for all above it."""
    return np.where(limits == HIGHEST, np.inf, limits.astype(float))


def _survivors(rows: Points, anchors: Points, r: Rotation, alive: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor, integer score) of the living pairs whose score can lie from low to high."""
    i, j, done, partial = None, None, 0, None
    for cut, left, right in zip([*r.cuts, None], [*rows.rests, None], [*anchors.rests, None], strict=True):
        if i is None:  # the first components of all pairs at once
            partial = rows.turned[:, :cut] @ anchors.turned[:, :cut].T
            spare = r.slack * np.multiply.outer(rows.lengths, anchors.lengths)
            spare += np.multiply.outer(left, right) if cut else 0
            i, j = np.nonzero(alive & ~(partial + spare < low) & ~(partial - spare > high))
            partial = partial[i, j]
        else:  # further ones of the pairs that are left
            keep = np.ones(len(i), bool)
            for s in range(0, len(i), PAIRS):
                x, y = i[s : s + PAIRS], j[s : s + PAIRS]
                partial[s : s + PAIRS] += np.einsum("ij,ij->i", rows.turned[x, done:cut], anchors.turned[y, done:cut])
                spare = r.slack * rows.lengths[x] * anchors.lengths[y] + (left[x] * right[y] if cut else 0)
                keep[s : s + PAIRS] = ~(partial[s : s + PAIRS] + spare < low[y]) & ~(partial[s : s + PAIRS] - spare > high[y])
            i, j, partial = i[keep], j[keep], partial[keep]
        done = cut
    far = rows.lengths.max(initial=0) * anchors.lengths.max(initial=0)
    for s in range(0, len(i), PAIRS):
        x, y = i[s : s + PAIRS], j[s : s + PAIRS]
        yield x, y, _products(rows.whole[x], anchors.whole[y], far)


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, ~score, group))
    group, score, ids = group[order], score[order], ids[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
    rank = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
    return group[rank < k], score[rank < k], ids[rank < k]


class Best:
    """The first k candidates of each slot so far, and the score below which none can enter."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k = floors.copy(), k
        self.held = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(slots):
            return
        self.held = _first(*(np.r_[x, y] for x, y in zip(self.held, (slots, scores, ids), strict=True)), self.k)
        group, score, _ = self.held
        last = np.flatnonzero(np.r_[group[1:] != group[:-1], True])
        full = last[np.diff(np.r_[-1, last]) == self.k]
        self.floors[group[full]] = np.maximum(self.floors[group[full]], score[full])


@dataclass
class Block:
    """Some anchors and, for the negatives, their slots: one for each positive, in the anchors' order."""

    anchors: Points
    rotation: Rotation
    size: int
    scale: float
    floors: np.ndarray  # of anchors, or of slots where there are any
    k: int
    slot_anchor: np.ndarray | None = None
    slot_high: np.ndarray | None = None

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(self.floors, self.k)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                rows = _points(batch.slice(s, ROWS), self.size, self.scale, self.rotation)
                for t in range(0, len(self.anchors.ids), ANCHORS):
                    (self._positives if self.slot_anchor is None else self._negatives)(rows, t, best)
        slots, scores, ids = best.held
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(scores), pa.array(ids)], names=["slot", "score", "id"])

    def _positives(self, rows: Points, t: int, best: Best) -> None:
        part = self.anchors.part(t, t + ANCHORS)
        alive = (rows.labels[:, None] == part.labels) & (rows.ids[:, None] != part.ids)
        low = best.floors[t : t + ANCHORS]
        for i, j, score in _survivors(rows, part, self.rotation, alive, _least(low), np.full(len(low), np.inf)):
            fits = score >= low[j]
            best.add(j[fits] + t, score[fits], rows.ids[i[fits]])

    def _negatives(self, rows: Points, t: int, best: Best) -> None:
        part = self.anchors.part(t, t + ANCHORS)
        a, b = np.searchsorted(self.slot_anchor, [t, t + len(part.ids)])
        owner, high = self.slot_anchor[a:b] - t, self.slot_high[a:b]
        least, most = np.full(len(part.ids), np.inf), np.full(len(part.ids), -np.inf)
        np.minimum.at(least, owner, _least(best.floors[a:b]))
        np.maximum.at(most, owner, _most(high))
        first, count = np.searchsorted(owner, np.arange(len(part.ids))), np.bincount(owner, minlength=len(part.ids))
        alive = (rows.labels[:, None] != part.labels) & (least <= most)
        for i, j, score in _survivors(rows, part, self.rotation, alive, least, most):
            for nth in range(int(count.max(initial=0))):
                mine = count[j] > nth
                slot = first[j[mine]] + nth
                x, points = score[mine], i[mine]
                fits = (x >= best.floors[a + slot]) & (x <= high[slot])
                best.add(slot[fits] + a, x[fits], rows.ids[points[fits]])


def _search(rows: DataFrame, block: Block) -> DataFrame:
    """(slot, rank, score, id) of the block's first k rows in each slot."""
    found = rows.mapInArrow(block.search, "slot long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= block.k)


def _raised(floors: np.ndarray, seeds: DataFrame, k: int) -> np.ndarray:
    """Floors raised to the k-th score that the seeds reach."""
    got = seeds.where(F.col("rank") == k).select("slot", "score").toArrow()  # one row a slot of the block
    out = floors.copy()
    at = np.asarray(got["slot"])
    out[at] = np.maximum(out[at], np.asarray(got["score"]))
    return out


def _share(score: int, percent: int, up: bool) -> int:
    x = score * percent
    return min(max(-(-x // 100) if up else x // 100, LOWEST), HIGHEST)


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: float = 256.0, positives: int = 5, negatives: int = 5, lowest: int = 80, highest: int = 100,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` tells the anchor rows by the columns of `vectors`. A row's negatives score from `lowest`
    to `highest` per cent of the positive.
    """
    whole = F.col(vector_col)
    label = F.col("label") if label is None else label
    named = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"), anchor.alias("anchor"))
    kept = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    kept = kept.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < float("inf"))))
    spark = vectors.sparkSession
    rows = checkpointed(kept.repartition(4 * spark.sparkContext.defaultParallelism))
    queries = rows.where("anchor").select("id", "label", "v").distinct()
    size, n = rows.agg(F.max(F.size("v"))).first()[0], queries.count()
    out = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return out
    size = max(size, 1)
    r = rotation(rows, size, scale)
    blocks = -(-n * size * 16 // BLOCK_BYTES)
    dealt = F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks))
    everything, asked = rows.select("id", "label", "v"), rows.where("anchor").select("id", "label", "v")
    for b in range(blocks):
        got = pa.Table.from_batches(queries.where(dealt == b).toArrow().to_batches()).combine_chunks()
        if got.num_rows:
            out = out.unionByName(_of_block(got.to_batches()[0], asked, everything, r, size, scale, positives, negatives, lowest, highest))
    return out


def _of_block(batch: pa.RecordBatch, asked: DataFrame, rows: DataFrame, r: Rotation, size: int, scale: float, positives: int, negatives: int, lowest: int, highest: int) -> DataFrame:
    anchors = _points(batch, size, scale, r)
    floors = np.full(batch.num_rows, LOWEST, np.int64)
    seed = Block(anchors, r, size, scale, floors, positives)
    block = Block(anchors, r, size, scale, _raised(floors, _search(asked, seed), positives), positives)
    found = _search(rows, block).select("slot", "rank", "score", "id").toArrow().sort_by([("slot", "ascending"), ("rank", "ascending")])
    owner, score, ids = (np.asarray(found[c]) for c in ("slot", "score", "id"))
    low = np.array([_share(int(x), lowest, True) for x in score], np.int64)
    high = np.array([_share(int(x), highest, False) for x in score], np.int64)
    seed = Block(anchors, r, size, scale, low, negatives, owner, high)
    block = Block(anchors, r, size, scale, _raised(low, _search(asked, seed), negatives), negatives, owner, high)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.asarray(b.column(0))
            names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(anchors.ids[owner[at]]), pa.array(ids[at]), b.column(1), b.column(3), pa.array(score[at]), b.column(2)], names=names)

    return _search(rows, block).select("slot", "rank", "score", "id").mapInArrow(told, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
