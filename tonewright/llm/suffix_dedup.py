"""Removal of long repeated byte strings with a logarithmic family of suffix orders.

A byte goes if a string of `size` bytes (100) that covers it also starts earlier: in a
document with a smaller id, or earlier in the same document.

* Copies. Of equal texts, named by their SHA-256, all but the one with the smallest id
  lose everything; only that one takes part in what follows.
* Anchors. Of the 32-byte strings in each window of `size` bytes, the one with the least
  hash is the window's anchor. Equal windows have equal anchors at the same place, so a
  window whose anchor string stands nowhere else cannot repeat. Anchors are one position
  in thirty or so; their hashes are counted in Spark.
* Contexts. For anchors that stand elsewhere too, the stretch of text that holds all
  their windows is sent on, dealt out by a hash of 64 bytes that all those windows share,
  so that a line that very many documents share does not gather them in one task.
* Index family. A task takes its contexts in the order of that hash, batch by batch. Each
  batch gets a suffix array: its suffixes in the order of their bytes, to the depth of
  `size`, since only matches of that length count. It is merge-scanned against all existing
  levels, bytes with bytes; of equal suffixes the earliest stays in the index and the others
  are reported. Then the batch becomes a level, and levels of equal size merge, each twice as
  large as the one before. Contexts under different hashes cannot match, so that the family
  is let go where the hash changes and holds no more than the batches of one hash.
* Spans are merged for each document and cut from its bytes.

Null texts count as empty; texts shorter than `size` lose nothing; very long texts are
read whole. Ids are integers; rows with a null id come first, as the smallest. Rows that
repeat an id count as one document where their texts are equal; where they differ, a
string that stands in both is kept in one of them or in both. An empty table gives an
empty table. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_texts, checkpointed, marked, marks, release, slices

GRAM = 32
SHARED = 64
#: Bits of the hash that choose anchors; the others hold the position, so that the leftmost of equals is taken.
CHOICE_BITS = 36
SLICE = 2 << 20
#: Bytes of contexts that get one suffix array, and suffixes of a level that are compared at once.
BATCH = 1 << 20
SCAN = 1 << 16
NO_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The numbers of x shuffled, one to one, in their own place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = np.random.default_rng(4057).integers(1, 2**63, 256, np.uint64)
RADIX = 0x9E3779B97F4A7C15
INVERSE = pow(RADIX, -1, 1 << 64)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of RADIX and of its inverse, modulo 2 ** 64."""
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (RADIX, INVERSE))


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of byte codes times powers, from which strings() reads fingerprints."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * _powers(1 << len(data).bit_length())[0][: len(data)], out=out[1:])
    return out


def strings(total: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit fingerprints of the strings of `size` bytes that begin at each place, or at the places `at`."""
    inverse = _powers(1 << (len(total) - 1).bit_length())[1]
    if at is not None:
        return _mixed((total[at + size] - total[at]) * inverse[at])
    n = max(len(total) - size, 0)
    return _mixed((total[size:] - total[:n]) * inverse[:n])


def windows(total: np.ndarray, first: np.ndarray, length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of documents laid end to end, from their running sums: position, gram hash, first and last window."""
    grams = strings(total, GRAM)
    wide = size - GRAM + 1
    key = (grams >> np.uint64(64 - CHOICE_BITS) << np.uint64(64 - CHOICE_BITS)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < wide:
        key = np.minimum(key[: len(key) - (wide - span)], key[wide - span :])
    count = np.maximum(length - size + 1, 0)
    starts = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = (key[starts] & np.uint64((1 << (64 - CHOICE_BITS)) - 1)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.empty(0, np.int64)
    last = np.r_[new[1:] - 1, len(at) - 1] if len(at) else new
    return at[new], grams[at[new]], starts[new], starts[last]


def _laid(batch: pa.RecordBatch, text: str, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the documents that are long enough, their bytes end to end, where each begins, and its length."""
    ids = np.asarray(batch.column(0).fill_null(NO_ID), np.int64)
    texts = byte_texts(batch, text)
    long = np.array([len(t) >= size for t in texts], bool)
    kept = [t for t, x in zip(texts, long, strict=True) if x]
    length = np.array([len(t) for t in kept], np.int64)
    return ids[long], np.frombuffer(b"".join(kept), np.uint8), np.cumsum(length) - length, length


def _anchors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(d, h, f, twice): each anchor of a text, f, once for each text that a task reads.

    An anchor that stands twice in a slice is known to repeat: one of its rows goes by its
    hash to tell the other tasks, the others are spread, so that a hot one is a row for each slice.
    """
    seen: set[int] = set()
    for b in slices(batches, "_text", SLICE):
        fresh = [i for i, x in enumerate(b.column(0).to_pylist()) if not (x in seen or seen.add(x))]
        names, data, first, length = _laid(b.take(pa.array(fresh, pa.int64())), "_text", size)
        if not len(names):
            continue
        at, h, _, _ = windows(sums(data), first, length, size)
        f = names[np.searchsorted(first, at, side="right") - 1]
        order = np.argsort(h, kind="stable")
        h, f = h[order], f[order]
        new = np.r_[True, h[1:] != h[:-1]]
        twice = ~new | ~np.r_[new[1:], True]
        kept = new | np.r_[True, f[1:] != f[:-1]]
        spread = np.where(new, h, _mixed(h ^ f.view(np.uint64)))
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (spread.view(np.int64), h.view(np.int64), f, twice)], names=["d", "h", "f", "twice"])


def _flagged(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    """The rows whose last column the map may hold."""
    for b in batches:
        yield b.filter(pa.array(marked(table.value, np.asarray(b.column(2)))))


def _contexts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Stretches of text around anchors that stand elsewhere too; equal ones of a slice go out once."""
    for b in slices(batches, "_text", SLICE):
        ids, data, first, length = _laid(b, "_text", size)
        lists = b.column(2)
        twice = np.unique(np.asarray(lists.flatten(), np.int64))
        if not len(ids) or not len(twice):
            continue
        total = sums(data)
        at, gram, low, high = windows(total, first, length, size)
        hit = np.isin(gram.view(np.int64), twice)
        at, low, high = at[hit], low[hit], high[hit]
        owner = np.searchsorted(first, at, side="right") - 1
        common = lambda place: strings(total, SHARED, np.clip(place, 0, len(data) - SHARED)).view(np.int64)
        # Windows that begin far before the anchor share the 64 bytes around its start, the others those from it on.
        edge = at - (size - SHARED)
        before = low < edge
        after = high >= edge
        halves = [(owner[before], low[before], np.minimum(high, edge - 1)[before], common(at[before] - (SHARED - GRAM))), (owner[after], np.maximum(low, edge)[after], high[after], common(at[after]))]
        owner, low, high, key = (np.concatenate(x) for x in zip(*halves, strict=True))
        text = data.tobytes()
        seen: dict[bytes, int] = {}
        rows, spans = [], []
        for i in np.lexsort((low, ids[owner])).tolist():
            body = text[low[i] : high[i] + size]
            first_at = seen.get(body)
            if first_at is not None:
                if (ids[owner[i]], low[i] - first[owner[i]]) != (ids[owner[first_at]], low[first_at] - first[owner[first_at]]):
                    spans.append(i)
            else:
                seen[body] = i
                rows.append(i)
        settled = np.array(spans, np.int64)
        edges = np.zeros(len(data) + 1, np.int64)
        np.add.at(edges, low[settled], 1)
        np.add.at(edges, high[settled] + size, -1)
        covered = np.cumsum(edges[:-1]) > 0
        fresh = np.zeros(len(data), bool)
        fresh[first] = True
        start = np.flatnonzero(covered & (fresh | ~np.r_[False, covered[:-1]]))  # runs end with their document
        stop = np.flatnonzero(covered & (np.r_[fresh[1:], True] | ~np.r_[covered[1:], False])) + 1
        of = np.searchsorted(first, start, side="right") - 1
        both = np.array(rows, np.int64)
        begin = low[both] - first[owner[both]]
        yield pa.RecordBatch.from_arrays(
            [  # what is settled is spread, so that a hot key gets no more than its different contexts
                pa.array(np.r_[key[both], _mixed(ids[of].view(np.uint64) ^ _mixed(start.astype(np.uint64))).view(np.int64)]),
                pa.array(np.r_[ids[owner[both]], ids[of]]),
                pa.array(np.r_[begin, start - first[of]]),
                pa.array(np.r_[(high - low)[both] + size + begin, stop - first[of]]),
                pa.array([*seen, *[None] * len(start)], pa.binary()),
            ],
            names=["key", "_id", "start", "stop", "body"],
        )


class Level:
    """A suffix array: texts end to end, and the places of their different suffixes in the order of the first `size` bytes, each with the document and place where it stands earliest."""

    def __init__(self, text: np.ndarray, at: np.ndarray, ids: np.ndarray, place: np.ndarray):
        self.text, self.at, self.ids, self.place = text, at, ids, place


def suffixes(text: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The first `size` bytes of the suffixes at these places, as strings that NumPy orders by bytes."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, size)[at]).view(f"S{size}").ravel()


class IndexFamily:
    """Levels of suffix arrays of geometrically growing sizes; all comparisons are of bytes."""

    def __init__(self, size: int):
        self.size = size
        self.levels: list[Level] = []

    def scan(self, level: Level, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge-scan of sorted suffixes against a level, block by block: how many of the level's are smaller, and whether the next one is equal."""
        before, met = np.zeros(len(mine), np.int64), np.zeros(len(mine), bool)
        for start in range(0, len(level.at), SCAN):
            block = suffixes(level.text, level.at[start : start + SCAN], self.size)
            low, high = np.searchsorted(mine, block[0]), np.searchsorted(mine, block[-1], side="right")
            place = np.searchsorted(block, mine[low:high])
            before[low:high], before[high:] = start + place, start + len(block)
            met[low:high] = block[np.minimum(place, len(block) - 1)] == mine[low:high]
        return before, met

    def merged(self, a: Level, b: Level) -> Level:
        """One level of both, which share no suffix."""
        before, _ = self.scan(a, suffixes(b.text, b.at, self.size))
        put = lambda x, y: np.insert(x, before, y)
        return Level(np.r_[a.text, b.text], put(a.at, b.at + len(a.text)), put(a.ids, b.ids), put(a.place, b.place))

    def add(self, text: np.ndarray, at: np.ndarray, ids: np.ndarray, place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Index a batch of suffixes; the places (ids, positions) that turn out to be repeats."""
        order = np.lexsort((place, ids))
        order = order[np.argsort(suffixes(text, at[order], self.size), kind="stable")]  # of equal ones the earliest comes first
        at, ids, place = at[order], ids[order], place[order]
        mine = suffixes(text, at, self.size)
        again = np.r_[False, mine[1:] == mine[:-1]]
        head = np.flatnonzero(~again)[np.cumsum(~again) - 1]  # a row that repeats its own place is no repeat
        other = again & ((ids != ids[head]) | (place != place[head]))
        repeats = [(ids[other], place[other])]
        mine, at, ids, place = mine[~again], at[~again], ids[~again], place[~again]
        for level in self.levels:
            before, met = self.scan(level, mine)
            there, new = before[met], np.flatnonzero(met)
            earlier = (level.ids[there] < ids[new]) | (level.ids[there] == ids[new]) & (level.place[there] < place[new])
            later = (level.ids[there] > ids[new]) | (level.ids[there] == ids[new]) & (level.place[there] > place[new])
            repeats.append((ids[new[earlier]], place[new[earlier]]))
            old = there[later]
            repeats.append((level.ids[old], level.place[old]))
            level.ids[old], level.place[old] = ids[new[later]], place[new[later]]
            mine, at, ids, place = mine[~met], at[~met], ids[~met], place[~met]
        del mine
        if len(at):
            self.levels.append(Level(text, at, ids, place))
        while len(self.levels) > 1 and len(self.levels[-1].at) * 2 > len(self.levels[-2].at):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merged(a, b))
        return repeats


def _indexed(batch: pa.RecordBatch, family: IndexFamily) -> Iterator[pa.RecordBatch]:
    """Index the suffixes of a batch of contexts; spans of what repeats."""
    size = family.size
    length = np.asarray(pc.binary_length(batch.column(4)), np.int64)
    text = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8)
    count = length - size + 1
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(length) - length, count) + inner
    ids = np.repeat(np.asarray(batch.column(1), np.int64), count)
    place = np.repeat(np.asarray(batch.column(2), np.int64), count) + inner
    found = family.add(text, at, ids, place)
    ids, at = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    if not len(ids):
        return
    order = np.lexsort((at, ids))
    ids, at = ids[order], at[order]
    opens = np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + size)]
    starts = np.flatnonzero(opens)
    stops = np.r_[starts[1:] - 1, len(at) - 1]
    yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(at[starts]), pa.array(at[stops] + size)], names=["_id", "start", "stop"])


def _repeats(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows from contexts in the order of their keys; an index lives as long as its keys go on."""
    family, current, carry = IndexFamily(size), None, None
    for whole in batches:
        settled = whole.filter(whole.column(4).is_null())
        if settled.num_rows:
            yield pa.RecordBatch.from_arrays(settled.columns[1:4], names=["_id", "start", "stop"])
        for b in slices(iter([whole.filter(whole.column(4).is_valid())]), "body", BATCH):
            if carry is not None:
                b, carry = pa.concat_batches([carry, b]), None
            key = np.asarray(b.column(0))
            if current is not None:  # a key of several batches: they meet in the levels
                n = int(np.searchsorted(key, current, side="right"))
                if n:
                    yield from _indexed(b.slice(0, n), family)
                if n == len(key):
                    continue
                b, key, family, current = b.slice(n), key[n:], IndexFamily(size), None
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from _indexed(b.slice(0, last), IndexFamily(size))
            b = b.slice(last)
            if pc.sum(pc.binary_length(b.column(4))).as_py() >= BATCH:
                yield from _indexed(b, family)
                current = key[-1]
            else:
                carry = b
    if carry is not None:
        yield from _indexed(carry, family)


def joined(starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Spans that overlap or touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, stops, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "_text"):
        columns: list[list] = [[], [], []]
        for text, starts, stops in zip(byte_texts(b, "_text"), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            spans = joined(starts or [], stops or [])
            left, at = [], 0
            for x, y in spans:
                left.append(text[at:x])
                at = y
            left.append(text[at:])
            for c, x in zip(columns, (hashlib.sha256(text).hexdigest(), [{"start": x, "stop": y} for x, y in spans], b"".join(left)), strict=True):
                c.append(x)
        spans = pa.array(columns[1], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.string()), spans, pa.array(columns[2], pa.binary())], names=["_id", "text_sha256", "spans", "kept"])


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _sha, _f): _sha names the whole text, _f is a short name for grouping."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), text.alias("_text"), F.sha2(text.cast("binary"), 256).alias("_sha"), F.xxhash64(text).alias("_f"))


def spans(docs: DataFrame, firsts: DataFrame, size: int = 100) -> DataFrame:
    """(_id, start, stop) of bytes to remove from the first document of each text; spans of a document may overlap."""
    if size < SHARED + GRAM:
        raise ValueError(f"size must be {SHARED + GRAM} or more")
    anchors = docs.select("_f", "_text").mapInArrow(partial(_anchors, size=size), "d long, h long, f long, twice boolean")
    alike = Window.partitionBy("d")
    again = anchors.withColumns({"f0": F.min("f").over(alike), "f1": F.max("f").over(alike), "known": F.max("twice").over(alike)}).where("known or f0 <> f1")
    lists = checkpointed(again.groupBy(F.col("f").alias("_f")).agg(F.collect_set("h").alias("hs")))
    table = docs.sparkSession.sparkContext.broadcast(marks(lists.select("_f")))
    near = docs.select("_id", "_text", "_f").mapInArrow(partial(_flagged, table=table), "_id long, _text string, _f long")
    bodies = near.join(lists.join(firsts.select("_f", "_id"), "_f"), ["_f", "_id"]).select("_id", "_text", "hs")
    bodies = bodies.mapInArrow(partial(_contexts, size=size), "key long, _id long, start long, stop long, body binary")
    return bodies.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_repeats, size=size), "_id long, start long, stop long")


def cut(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """Of documents that lose bytes: id, text_sha256 (of the whole text), spans (removed, in bytes) and kept (the other bytes)."""
    docs = _texts(df, id_col, text_col)
    firsts = checkpointed(docs.groupBy("_sha", "_f").agg(F.min("_id").alias("_id")))
    gone = spans(docs, firsts, size).groupBy("_id").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    gone = checkpointed(gone)
    release(df.sparkSession)
    table = df.sparkSession.sparkContext.broadcast(marks(gone.select(F.xxhash64("_id"))))
    near = docs.select("_id", "_text", F.xxhash64("_id").alias("h")).mapInArrow(partial(_flagged, table=table), "_id long, _text string, h long")
    changed = near.join(gone, "_id").select("_id", "_text", "starts", "stops").mapInArrow(_cut, "_id long, text_sha256 string, spans array<struct<start:long,stop:long>>, kept binary")
    sized = docs.select("_id", "_sha", F.octet_length("_text").cast("long").alias("n")).where(F.col("n") >= size)
    copies = sized.join(firsts.select("_sha", F.col("_id").alias("first")), "_sha").where(F.col("_id") > F.col("first"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")))
    changed = changed.unionByName(copies.select("_id", F.col("_sha").alias("text_sha256"), whole.alias("spans"), F.lit(b"").alias("kept")))
    return changed.withColumn("_id", F.when(F.col("_id") != NO_ID, F.col("_id"))).withColumnRenamed("_id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 100) -> DataFrame:
    """One row for each row of df: id, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    changed = cut(df, id_col, text_col, size).select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("_kept"))
    changed = changed.dropDuplicates(["_id", "_sha"])
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("_whole"))
    both = rows.join(changed, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_whole") == F.col("_sha")), "left")
    zero = F.lit(0).cast("long")
    return both.select(id_col, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("_kept", "_whole").alias("kept_sha256"))
