"""Benchmark decontamination with an FM-index for each shard of the corpus.

Test items give phrases: each run of `window` consecutive words, or the whole item
where it has fewer. The items are sent to all tasks in blocks of bounded size, as
packed word numbers; each block makes one pass over the documents. A task reads its
documents shard by shard, and numbers a shard's words among themselves. The index is
the Burrows-Wheeler transform of the whole shard in a wavelet matrix, whatever the
phrases are; all phrases whose words the shard has are searched backward at once
through its ranks, occurrences are located by walking to sampled suffix positions,
and the located spans are merged for each document.

Words: UTF-8 text, ASCII letters lower-cased, split at ASCII characters that are
neither letters nor digits. Null and empty texts have no words, as documents and as
items; items with a null id count under the empty name. Items that repeat count
once for each id. Very long documents are searched whole; a document row that
repeats is searched again. An empty table of documents gives an empty table, an
empty benchmark leaves every document clean. Other columns pass through unless one
of the added columns replaces them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, byte_texts, free, slices

WINDOW = 10
SAMPLE_RATE = 8
#: Bytes of item text that are sent to all tasks at once, and bytes of documents that make a shard.
BLOCK_BYTES = 16 << 20
SHARD_BYTES = 4 << 20
#: Phrases that are searched at once.
SEARCHED = 1 << 18
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Phrases:
    """A block of items as packed word numbers; a phrase is a place in them, so that none is spelled out."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        number: dict[bytes, int] = {}
        names, rows = [], []
        for name, text in items:
            ids = [number.setdefault(w, len(number)) for w in (text or "").encode().translate(WORD_BYTES).split()]
            if ids:
                names.append(name)
                rows.append(np.array(ids, np.int32))
        length = np.array([len(x) for x in rows], np.int64)
        self.names = names
        self.vocabulary = b" ".join(number)
        self.words = np.concatenate(rows) if rows else np.empty(0, np.int32)
        size = np.minimum(length, window)
        count = length - size + 1
        first = np.cumsum(length) - length
        self.item = np.repeat(np.arange(len(rows), dtype=np.int32), count)
        self.size = np.repeat(size, count).astype(np.int32)
        self.start = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling."""
    n, step = len(s), 1
    rank = s.astype(np.int64) + 1
    while True:
        key = rank * (max(n, int(rank.max())) + 2)
        key[: max(n - step, 0)] += rank[step:]
        order = np.argsort(key)
        key = key[order]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.r_[1, key[1:] != key[:-1]])
        rank, step = fresh, step * 2
        if rank[order[-1]] == n or step >= 2 * n:
            return order


class FmIndex:
    """Backward search over a sequence of small numbers that ends in a 0 which is found nowhere else."""

    def __init__(self, s: np.ndarray):
        order = suffix_array(s)
        self.n = len(s)
        self.last = s[order - 1]
        self.below = np.r_[0, np.cumsum(np.bincount(s))]
        self.bits = max(1, int(s.max()).bit_length())
        self.levels, self.zeros = [], []
        row = self.last
        for level in reversed(range(self.bits)):
            bit = (row >> level) & 1
            self.levels.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            row = np.r_[row[bit == 0], row[bit == 1]]
        self.sampled = order % SAMPLE_RATE == 0
        self.place = (np.cumsum(self.sampled) - 1).astype(np.int32)
        self.positions = order[self.sampled]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each c stands in the transform before each i."""
        start = np.zeros_like(i)
        for depth, level in enumerate(reversed(range(self.bits))):
            ones, bit = self.levels[depth], (c >> level) & 1
            start = np.where(bit == 1, self.zeros[depth] + ones[start], start - ones[start])
            i = np.where(bit == 1, self.zeros[depth] + ones[i], i - ones[i])
        return i - start

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns, one in each row of words, those that occur, and their row ranges."""
        which = np.arange(len(words))
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n, np.int64)
        for k in reversed(range(words.shape[1])):
            c = words[which, k]
            low, high = self.below[c] + self.rank(c, low), self.below[c] + self.rank(c, high)
            left = high > low
            which, low, high = which[left], low[left], high[left]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows: walk back to a sampled one, and count the steps."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(todo):
            hit = self.sampled[rows]
            out[todo[hit]] = self.positions[self.place[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            c = self.last[rows]
            rows, steps = self.below[c] + self.rank(c, rows), steps + 1
        return out


class Shard:
    """Documents whose words are numbered among themselves, with an FM-index over all of them."""

    def __init__(self, texts: list[bytes]):
        words = [t.translate(WORD_BYTES).split() for t in texts]
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.firsts = np.cumsum(self.sizes + 1) - self.sizes - 1
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)), 2)}
        ids = np.ones(int(self.sizes.sum()) + len(words) + 1, np.int64)  # 1 is the border behind each document, 0 the end
        for f, w in zip(self.firsts.tolist(), words, strict=True):
            ids[f : f + len(w)] = np.fromiter(map(number.__getitem__, w), np.int64, len(w))
        ids[-1] = 0
        self.number, self.length = number, len(ids) - 1
        self.index = FmIndex(ids) if number else None

    def occurrences(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(position, phrase) of all occurrences."""
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        known = phrases.vocabulary.split(b" ") if phrases.vocabulary else []
        words = np.fromiter(map(self.number.get, known, repeat(0)), np.int64, len(known))[phrases.words]
        unknown = np.r_[0, np.cumsum(words == 0)]
        able = np.flatnonzero(unknown[phrases.start + phrases.size] == unknown[phrases.start])  # the shard has all their words
        for size in np.unique(phrases.size[able]).tolist():
            mine = able[phrases.size[able] == size]
            for k in range(0, len(mine), SEARCHED):
                part = mine[k : k + SEARCHED]
                hit, low, high = self.index.search(words[phrases.start[part][:, None] + np.arange(size)])
                n = high - low
                rows = np.repeat(low, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                found.append((self.index.locate(rows), np.repeat(part[hit], n)))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def runs(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, covered.astype(np.int8), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def scan(texts: list[bytes], phrases: Phrases) -> list[tuple[int, int, list[str], list[dict]]]:
    """Of each text: words, hit words, names of occurring items, merged spans in bytes."""
    shard = Shard(texts)
    at, which = shard.occurrences(phrases)
    out = [(n, 0, [], []) for n in shard.sizes.tolist()]
    if not len(at):
        return out
    edges = np.zeros(shard.length + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + phrases.size[which], -1)
    covered = np.cumsum(edges[:-1]) > 0
    owner = np.searchsorted(shard.firsts, at, side="right") - 1
    of_doc: dict[int, set[str]] = defaultdict(set)
    for d, i in np.unique(np.stack([owner, phrases.item[which]]), axis=1).T.tolist():
        of_doc[d].add(phrases.names[i])
    for d, names in of_doc.items():
        mine = covered[shard.firsts[d] : shard.firsts[d] + shard.sizes[d]]
        place = [m.span() for m in WORD.finditer(texts[d].translate(WORD_BYTES))]
        spans = [{"first": a, "stop": b, "start": place[a][0], "end": place[b - 1][1]} for a, b in runs(mine)]
        out[d] = (int(shard.sizes[d]), int(mine.sum()), sorted(names), spans)
    return out


SPAN = T.StructType([T.StructField(x, T.LongType()) for x in ("first", "stop", "start", "end")])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN))]
ARROW = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(x, pa.int64()) for x in SPAN.names])))])


def _pass(df: DataFrame, items: Iterable[tuple[str, str | None]], text_col: str, window: int) -> DataFrame:
    """Search one block of items in all documents."""
    sent = df.sparkSession.sparkContext.broadcast(Phrases(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for b in slices(batches, text_col, SHARD_BYTES):
            rows = scan(byte_texts(b, text_col), phrases)
            added = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *ARROW.names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *ADDED]))


def merged(spans: Column) -> Column:
    """Join spans that overlap or touch, in words."""

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["first"].alias("first"), F.greatest(last["stop"], x["stop"]).alias("stop"), last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        touches = (F.size(done) > 0) & (x["first"] <= last["stop"])
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(spans), F.array().cast(T.ArrayType(SPAN)), step)


def find(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add n_words, n_hit, item_ids (sorted as strings) and spans (merged; words first to stop, bytes start to end)."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.col(item_text_col).alias("item"))
    total = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    names = [f.name for f in ADDED]
    out = df.drop(*[x for x in names if x != text_col])
    held = {c: free([*df.columns, *names], f"_{c}") for c in ("spans", "item_ids")}  # names under which the finds of earlier blocks wait
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("name", "item"), F.lit(blocks)) == k)
        found = _pass(out, ((r["name"], r["item"]) for r in part.toLocalIterator()), text_col, window)
        if k:
            spans = merged(F.concat(held["spans"], "spans"))
            found = found.withColumn("spans", spans).withColumn("item_ids", F.array_sort(F.array_union(held["item_ids"], "item_ids")))
            found = found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"])).drop(*held.values())
        if k < blocks - 1:
            found = found.withColumnsRenamed(held).drop("n_words", "n_hit")
        out = found
    return out


def cut(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Take the spans out of the text."""
    bare = F.col(text_col).cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans_col, lambda s: s["end"]))
    ends = F.concat(F.transform(spans_col, lambda s: s["start"]), F.array(F.octet_length(bare).cast("long")))
    parts = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.substring(bare, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int")).cast("string"))
    return df.withColumn(text_col, F.when(F.size(spans_col) > 0, F.array_join(parts, "")).otherwise(F.col(text_col)))
