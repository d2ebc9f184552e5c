"""Language-model scores by context-tree weighting over binary-decomposed bytes.

Each byte is eight binary decisions. For every context of 0 to `depth` bytes before it
and every decision, the tree has a node with the counts of both outcomes over the whole
training corpus. A node predicts with the Krichevsky-Trofimov estimate; context-tree
weighting mixes, at each node, that estimate with the product of its children's weighted
probabilities, half and half, over the training data. The posterior share of the node's
own estimate is the weight with which a prediction stops there. A text's score is the
sum of the mixed log10 probabilities of its bytes and of an end mark; divided by its
bytes it is a code length.

Spark counts byte strings of depth + 1 in all texts, and how many of each are in training
texts: each task reduces its texts to distinct strings with counts before the shuffle. The
tree is built in groups that share the two bytes next to the predicted one, of which there
are 65,536 at most, and three where two are frequent; only the topmost levels, of proven size, are combined elsewhere and
sent to all groups. No node is left out: each group scores its own strings with its whole
part of the tree, which gives a table of log probabilities with a row for each different
string of the corpus. The `max_grams` most frequent strings go to all tasks as a cache; the
others of each document are joined to the table by a shuffle. Where a context has no node
because training texts do not have it, all that is left of the prediction stops at the
deepest node that it has; without any node it is one half.

The base score is an additive-smoothing word model: words split at ASCII white space,
ASCII letters lower-cased, and one end for each text, counted by Spark over the training
texts. Words' counts are joined to the documents' words by a shuffle.

Null and empty texts have no words and no bytes, only the end. Very long texts are scored
whole; repeated rows get equal scores. Without training texts every prediction is one
half and the base score is that of unknown tokens. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, checkpointed, slices, stage_folder
from .ngram_join import LOWER

DEPTH = 5
END = b"\xff"  # never in UTF-8
SLICE = 2 << 20
#: Frequent byte strings whose log probabilities are sent to all tasks, at 16 bytes each; others are joined.
MAX_GRAMS = 4_000_000
#: Byte strings of a pair of context bytes from which its group is split by a third byte.
SPLIT = 200_000
#: Scores of strings that a worker keeps from batch to batch.
REMEMBERED = 3_000_000


def gram_keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The last depth + 1 bytes up to each byte of the texts (zeros before the first), and the symbols of each text."""
    pad = b"\0" * depth
    data = np.frombuffer(b"".join([pad + t.translate(LOWER) + END for t in texts]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    key = np.zeros(len(data), np.int64)
    for i in range(depth + 1):
        key[depth - i :] |= data[: len(data) - (depth - i)].astype(np.int64) << (8 * (depth - i))
    ends = np.cumsum(size + depth)
    keep = np.ones(len(data), bool)
    first = ends - size - depth
    for i in range(depth):
        keep[first + i] = False
    return key[keep], size


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


_LOG_GAMMA = np.frompyfunc(math.lgamma, 1, 1)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability."""

    def lgamma(x: np.ndarray) -> np.ndarray:
        values, back = np.unique(x, return_inverse=True)
        return _LOG_GAMMA(values).astype(float)[back]

    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - lgamma(n0 + n1 + 1.0) - math.log(math.pi)


def bit_nodes(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node keys (context, then the byte's bits so far behind a leading 1) with counts of both outcomes, from sorted byte-string counts."""
    out = []
    for level in range(8):
        byte = keys & 255
        node = (keys >> 8 << 8) | (1 << level) | (byte >> (8 - level))
        one = (byte >> (7 - level)) & 1 == 1
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        out.append((node[starts], np.add.reduceat(np.where(one, 0, counts), starts), np.add.reduceat(np.where(one, counts, 0), starts)))
    node, n0, n1 = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(node, kind="stable")
    return node[order], n0[order], n1[order]


def parent(node: np.ndarray, depth: int) -> np.ndarray:
    """Key of the node with one byte less of context."""
    return ((node >> 8) & ((1 << (8 * (depth - 1))) - 1)) << 8 | (node & 255)


def weighted(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """(log of the weighted probability, share of the node's own estimate); below: sums of the children's logs by key."""
    own = kt_log(n0, n1)
    if below is None:
        return own, np.ones(len(node))
    children = below[1][np.searchsorted(below[0], node)]
    total = np.logaddexp(own, children) - math.log(2)
    return total, np.exp(own - math.log(2) - total)


def tree(keys: np.ndarray, counts: np.ndarray, depth: int, stop_at: int, below: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, node, n0, n1, own share, log weighted) of all levels from depth to stop_at, from byte-string counts of depth + 1."""
    out = []
    for d in range(depth, stop_at - 1, -1):
        keys, counts = summed(keys & ((1 << (8 * (d + 1))) - 1), counts)
        node, n0, n1 = bit_nodes(keys, counts)
        log, share = weighted(node, n0, n1, below)
        out.append((d, node, n0, n1, share, log))
        if d:
            sums = summed(parent(node, d), log)
            below = sums
    return out


@dataclass
class ContextTree:
    """Sorted node keys of each depth with the estimate of a 1 and the share with which predictions stop there."""

    depth: int
    nodes: list[np.ndarray]
    ones: list[np.ndarray]
    shares: list[np.ndarray]

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """Log10 probability of the last byte of each string after the others."""
        total = np.zeros(len(grams))
        byte = grams & 255
        for level in range(8):
            prefix = (1 << level) | (byte >> (8 - level))
            one = (byte >> (7 - level)) & 1 == 1
            p, rest = np.zeros(len(grams)), np.ones(len(grams))
            last = np.full(len(grams), 0.5)
            alive = np.arange(len(grams))
            for d in range(self.depth + 1):
                keys = self.nodes[d]
                want = ((grams[alive] >> 8) & ((1 << (8 * d)) - 1)) << 8 | prefix[alive]
                at = np.minimum(np.searchsorted(keys, want), len(keys) - 1) if len(keys) else np.zeros(len(want), np.int64)
                hit = keys[at] == want if len(keys) else np.zeros(len(want), bool)
                alive, at = alive[hit], at[hit]
                estimate = np.where(one[alive], self.ones[d][at], 1 - self.ones[d][at])
                share = self.shares[d][at]
                p[alive] += rest[alive] * share * estimate
                rest[alive] *= 1 - share
                last[alive] = estimate
            total += np.log10(p + rest * last)  # what is left stops at the deepest node that is there
        return total


class Scorer:
    """Sums of log10 probabilities; strings that were met before are not computed again."""

    def __init__(self, model: ContextTree):
        self.model = model
        self.keys, self.logs = np.empty(0, np.int64), np.empty(0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        keys, size = gram_keys(texts, self.model.depth)
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        logs = np.empty(len(distinct))
        logs[known] = self.logs[at[known]]
        logs[~known] = self.model.log10(distinct[~known])
        if len(self.keys) > REMEMBERED:
            self.keys, self.logs = distinct, logs
        else:
            both = np.r_[self.keys, distinct[~known]]
            order = np.argsort(both, kind="stable")
            self.keys, self.logs = both[order], np.r_[self.logs, logs[~known]][order]
        return np.add.reduceat(logs[back], np.cumsum(size) - size)


#: Words of the frequent part of the vocabulary that is sent to all tasks, at 16 bytes each; others are joined.
MAX_WORDS = 1 << 20
END_WORD = b""


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that no count is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words and the end of each text, and how many tokens each has."""
    from xxhash import xxh3_64_intdigest

    words = [t.translate(LOWER).split() for t in texts]
    for w in words:
        w.append(END_WORD)
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter((xxh3_64_intdigest(w) for row in words for w in row), np.uint64, int(size.sum()))
    return flat.view(np.int64), size


def _counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Distinct training words (kind 0) and byte strings (kind 1) of a task's texts with their counts n in training texts and m in all."""
    held: list[list] = [[np.empty(0, np.int64)] * 3 for _ in range(2)]

    def out(kind: int) -> pa.RecordBatch:
        keys, n, m = held[kind]
        held[kind] = [np.empty(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n), pa.array(m)], names=["kind", "key", "n", "m"])

    for b in slices(batches, "_text", 2 * SLICE):
        texts, learned = byte_texts(b, "_text"), b.column(b.schema.get_field_index("_learn")).to_pylist()
        for learn in (True, False):
            part = [t for t, x in zip(texts, learned, strict=True) if x == learn]
            if not part:
                continue
            for kind, keys in enumerate((word_hashes(part)[0] if learn else None, gram_keys(part, depth)[0])):
                if keys is None:
                    continue
                new, m = np.unique(keys, return_counts=True)
                both = [np.r_[x, y] for x, y in zip(held[kind], (new, m * learn, m), strict=True)]
                order = np.argsort(both[0], kind="stable")
                keys, n, m = (x[order] for x in both)
                starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                held[kind] = [keys[starts], np.add.reduceat(n, starts), np.add.reduceat(m, starts)]
                if len(starts) > 2_000_000:
                    yield out(kind)
    for kind in range(2):
        if len(held[kind][0]):
            yield out(kind)


def _shared(group: int) -> int:
    """How many context bytes the strings of a group share."""
    return 3 if group >> 24 else 2


def _sums(table: pa.Table, depth: int) -> pa.Table:
    """Of the byte strings that share two (three) context bytes: what they add to the nodes of depth 1 (2)."""
    shared = _shared(table["g"][0].as_py())
    keys, counts = summed(np.asarray(table["key"]), np.asarray(table["n"]))
    _, node, n0, n1, _, log = tree(keys, counts, depth, shared)[-1]
    order = np.argsort(up := parent(node, shared), kind="stable")
    starts = np.flatnonzero(np.r_[True, up[order][1:] != up[order][:-1]])
    return pa.table({"level": np.full(len(starts), shared - 1, np.int32), "node": up[order][starts], **{k: np.add.reduceat(x[order], starts) for k, x in (("n0", n0), ("n1", n1), ("log", log))}})


def _logs(table: pa.Table, depth: int, top) -> pa.Table:
    """Log10 probabilities of the byte strings of a group, by the whole tree below the bytes that they share and the levels above."""
    keys, n, m = (np.asarray(table[c]) for c in ("key", "n", "m"))
    shared = _shared(table["g"][0].as_py())
    levels = list(top.value[:shared])
    if (n > 0).any():
        levels += [(node, (n1 + 0.5) / (n0 + n1 + 1), share) for _, node, n0, n1, share, _ in tree(*summed(keys[n > 0], n[n > 0]), depth, shared)[::-1]]
    model = ContextTree(len(levels) - 1, *[[x[i] for x in levels] for i in range(3)])
    return pa.table({"key": keys, "m": m, "log": model.log10(keys)})


def _threshold(sizes: DataFrame, times: str, bound: int) -> int:
    """The least count such that at most `bound` entries have it or more; counts that differ are few."""
    total = 0
    for r in sizes.groupBy("n").agg(F.sum(times).alias("t")).orderBy(F.desc("n")).toLocalIterator():
        total += r["t"]
        if total > bound:
            return r["n"] + 1
    return 1


def _added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(node, n0, n1, log) of several parts, summed by node."""
    node, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(node, kind="stable")
    starts = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]]) if len(node) else np.empty(0, np.int64)
    return node[order][starts], *[np.add.reduceat(x[order], starts) if len(starts) else x for x in values]


def fit_top(grams: DataFrame, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, estimates of a 1, own shares) of depths 0, 1 and, for the pairs of bytes that are split, 2, from counts (g, key, n) of byte strings of depth + 1."""
    sums = grams.where("n > 0").groupBy("g").applyInArrow(lambda t: _sums(t, depth), "level int, node long, n0 long, n1 long, log double")
    # 256 * 255 rows of level 1 at most, and 255 of level 2 for each pair that is split, of which there are fewer than strings / SPLIT
    top = sums.groupBy("level", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("log")).toArrow()
    level = np.asarray(top["level"])
    held = {d: tuple(np.asarray(top[c])[level == d] for c in ("node", "n0", "n1", "log")) for d in (1, 2)}
    out, more = [], held[2]
    for d in (2, 1, 0):
        node, n0, n1, log = _added([more])
        total, share = weighted(node, n0, n1, (node, log))
        out.append((node, (n1 + 0.5) / (n0 + n1 + 1), share))
        if d:
            above = (parent(node, d), n0, n1, total)
            more = _added([above, held[1]]) if d == 2 else above
    return out[::-1]


def gram_logs(grams: DataFrame, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """(key, m, log) of each byte string of (key, n, m): its log10 probability by the whole tree of the strings that have n.

    A group holds the strings that share two context bytes; those of a pair with more than `split` strings share three.
    """
    grams = grams.withColumn("_pair", F.shiftright("key", 8).bitwiseAND(F.lit(65535)).cast("int"))
    if depth > 2:
        hot = grams.groupBy("_pair").agg(F.count("*").alias("_rows")).where(F.col("_rows") > split).select("_pair", F.lit(True).alias("_hot"))  # 65,536 rows at most
        grams = grams.join(F.broadcast(hot), "_pair", "left")
        three = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFFFF)).cast("int").bitwiseOR(F.lit(1 << 24))
        grams = grams.withColumn("g", F.when(F.col("_hot"), three).otherwise(F.col("_pair"))).drop("_hot")
    else:
        grams = grams.withColumn("g", F.col("_pair"))
    grams = grams.drop("_pair")
    top = grams.sparkSession.sparkContext.broadcast(fit_top(grams, depth))
    return checkpointed(grams.groupBy("g").applyInArrow(lambda t: _logs(t, depth, top), "key long, m long, log double"))


@dataclass
class WordModel:
    """Frequent words' hashes and counts, and the totals of the training corpus."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int

    def log10(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def _rest(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, key, how often) of different keys of each owner."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.empty(0, np.int64)
    return owner[starts], keys[starts], np.diff(np.r_[starts, len(keys)])


def _scored(batches: Iterator[pa.RecordBatch], depth: int, grams, words) -> Iterator[pa.RecordBatch]:
    """A row for each text (kind 0) with what frequent words and byte strings give; then one for each other word (1) and byte string (2) of it, with h."""
    from pyspark import TaskContext

    (frequent, logs), vocabulary = grams.value, words.value
    row = TaskContext.get().partitionId() << 33
    for b in slices(batches, "_text", SLICE):
        texts = byte_texts(b, "_text")
        keys, size = word_hashes(texts)
        n = len(texts)
        at = np.minimum(np.searchsorted(vocabulary.keys, keys), max(len(vocabulary.keys) - 1, 0))
        known = vocabulary.keys[at] == keys if len(vocabulary.keys) else np.zeros(len(keys), bool)
        owner = np.repeat(np.arange(n), size)
        base = np.bincount(owner[known], vocabulary.log10(vocabulary.counts[at[known]]) if known.any() else None, n)
        hits = np.bincount(owner[known], minlength=n)
        rest = [_rest(keys[~known], owner[~known])]
        strings, length = gram_keys(texts, depth)
        owner = np.repeat(np.arange(n), length)
        distinct, back = np.unique(strings, return_inverse=True)
        at = np.minimum(np.searchsorted(frequent, distinct), max(len(frequent) - 1, 0))
        known = frequent[at] == distinct if len(frequent) else np.zeros(len(distinct), bool)
        log = np.zeros(len(distinct))
        log[known] = logs[at[known]]
        score = np.bincount(owner, log[back], n)
        rest.append(_rest(strings[~known[back]], owner[~known[back]]))
        m = [len(x[0]) for x in rest]
        more = np.zeros(sum(m), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([b.column(0), pa.nulls(sum(m), b.schema.field(0).type)]),
                pa.array(row + np.r_[np.arange(n), rest[0][0], rest[1][0]]),
                pa.array(np.repeat(np.arange(3, dtype=np.int32), [n, *m])),
                pa.array(np.r_[np.zeros(n, np.int64), rest[0][1], rest[1][1]]),
                pa.array(np.r_[size, rest[0][2], rest[1][2]]),
                pa.array(np.r_[hits, more]),
                pa.array(np.r_[base, more].astype(float)),
                pa.array(np.r_[score, more].astype(float)),
                pa.array(np.r_[np.fromiter(map(len, texts), np.int64, n), more]),
            ],
            names=["_id", "row", "kind", "h", "n", "known", "base", "score", "bytes"],
        )
        row += n


def score(df: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, max_grams: int = MAX_GRAMS, max_words: int = MAX_WORDS, split: int = SPLIT) -> DataFrame:
    """One row for each row of df: id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte; learns from rows where `learn` holds."""
    from pyspark.sql import types as T

    spark = df.sparkSession
    learn = ~held_out(id_col) if learn is None else learn
    text = F.col(text_col).cast("string").alias("_text")
    counts = df.select(text, F.coalesce(learn, F.lit(False)).alias("_learn")).mapInArrow(partial(_counts, depth=depth), "kind int, key long, n long, m long")
    counts = checkpointed(counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    vocabulary = counts.where("kind = 0").select(F.col("key").alias("h"), F.col("n").alias("c"))
    totals = vocabulary.agg(F.sum("c").alias("tokens"), F.count("*").alias("distinct")).first()
    least = _threshold(vocabulary.select(F.col("c").alias("n"), F.lit(1).alias("times")), "times", max_words)
    often = vocabulary.where(F.col("c") >= least).toArrow()
    order = np.argsort(np.asarray(often["h"]), kind="stable")
    words = WordModel(np.asarray(often["h"])[order], np.asarray(often["c"])[order], totals["tokens"] or 0, totals["distinct"])
    logs = gram_logs(counts.where("kind = 1").select("key", "n", "m"), depth, split)
    least_m = _threshold(logs.select(F.col("m").alias("n"), F.lit(1).alias("times")), "times", max_grams)
    often = logs.where(F.col("m") >= least_m).select("key", "log").toArrow()  # max_grams rows at most
    order = np.argsort(np.asarray(often["key"]), kind="stable")
    frequent = np.asarray(often["key"])[order], np.asarray(often["log"])[order]
    del often
    sc = spark.sparkContext
    fields = [("row", T.LongType()), ("kind", T.IntegerType()), ("h", T.LongType()), ("n", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("bytes", T.LongType())]
    docs = df.select(F.col(id_col).alias("_id"), text)
    schema = T.StructType([docs.schema["_id"], *[T.StructField(a, b) for a, b in fields]])
    path = f"{stage_folder(spark)}/rows"  # as Parquet: there may be many rare strings
    docs.mapInArrow(partial(_scored, depth=depth, grams=sc.broadcast(frequent), words=sc.broadcast(words)), schema).write.parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    c = F.coalesce(F.col("c"), F.lit(0))
    log = F.log10((c + 0.1) / F.lit(words.tokens + 0.1 * (words.distinct + 1)))
    rare = rows.where("kind = 1").select("row", "h", "n").join(vocabulary.where(F.col("c") < least), "h", "left")
    rare = rare.select("row", (F.col("n") * log).alias("more"), F.when(c > 0, F.col("n")).otherwise(0).alias("also"), F.lit(0.0).alias("gram"))
    strings = rows.where("kind = 2").select("row", F.col("h").alias("key"), "n").join(logs.where(F.col("m") < least_m), "key")
    rare = rare.unionByName(strings.select("row", F.lit(0.0).alias("more"), F.lit(0).cast("long").alias("also"), (F.col("n") * F.col("log")).alias("gram")))
    rare = rare.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("more", "also", "gram")])
    total = F.col("score") + F.coalesce("gram", F.lit(0.0))
    out = rows.where("kind = 0").drop("kind", "h").join(rare, "row", "left")
    return out.select(
        F.col("_id").alias(id_col),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        total.alias("score"),
        F.col("bytes").alias("n_bytes"),
        (-total / math.log10(2) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
