"""N-gram Jaccard self-join by prefix filters under several global token orders.

A document's tokens are the 64-bit hashes of its distinct word shingles. In any total
order of all tokens, two sets that are similar enough share one of the first
n - ceil(t n) + 1 tokens of each. Several orders give several such tests:

* Order 0 puts rare tokens first. It generates candidates: sets that share a prefix
  token are compared by length and by the place of that token in both.
* Order 1 breaks ties between equally rare tokens otherwise, order 2 ignores
  frequency. A candidate pair must share prefix tokens under these as well. Under order
  2 the prefix is longer by `least_shared` - 1 tokens, and then as many must be shared.
* Only then is the whole intersection counted.

Frequencies come from a count-min sketch over all documents; its size is fixed, and it
only decides the orders, never which pairs are found. Equal sets are one node from the
start. In a group of near copies, each set is first verified against one leader; what is
linked then needs no further comparison within its component, so that only pairs from
different components are generated afterwards. No link between different components is
missed, and a large group costs a row for each member instead of all pairs. These are the
spanning links, which are enough for `groups`. `links` gives all links between different
sets, also those inside a component, and `link_counts` how many rows each row is linked
with. Their candidates come from the same prefixes; copies are one node with a weight. Their
number is that of the links, so it grows with the square of a group of near copies.

Words are split at ASCII white space and ASCII letters lower-cased. A text with fewer
words than a shingle has one token, the whole sequence; null texts, empty texts and texts
of white space have none and are linked with nothing. Rows with a null id take part, but
never name a component unless no row of it has an id. Repeated rows are linked with each
other and each returned. An empty table gives an empty table. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts, checkpointed, marked, marks, slices, thinned
from .graph import components

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SKETCH_BITS = 19
SKETCH_ROWS = 2
CHUNK = 1 << 14


def tokens_of(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        k = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            k = (k ^ (k >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i]
        k = (k ^ (k >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        k ^= k >> np.uint64(27)
    return np.unique(k)


def identity(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    from xxhash import xxh3_64_intdigest

    return int(np.uint64(xxh3_64_intdigest(tokens.tobytes(), len(tokens))).astype(np.int64))


def cells(tokens: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return [((tokens >> np.uint64(SKETCH_BITS * i)) & mask).astype(np.int64) for i in range(SKETCH_ROWS)]


def least_shared(n: int, percent: int) -> int:
    """How many tokens of its longer prefix under order 2 a set of n tokens shares with any that is similar enough."""
    return max(1, -(-percent * n // 100) // 2)


def prefix_size(n: int, percent: int, order: int) -> int:
    return n - -(-percent * n // 100) + (least_shared(n, percent) if order == 2 else 1)


def prefix(tokens: np.ndarray, sketch: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The tokens that come first under an order, as many as the threshold asks for."""
    size = prefix_size(len(tokens), percent, order)
    with np.errstate(over="ignore"):
        mixed = (tokens ^ np.uint64(0x5851F42D4C957F2D * order & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93 if order else 1)
    if order == 2:
        return tokens[np.argsort(mixed, kind="stable")[:size]]
    seen = np.minimum(*[sketch[i][c] for i, c in enumerate(cells(tokens))])
    rarity = (2 * np.log2(np.maximum(seen, 1))).astype(np.int64)
    return tokens[np.lexsort((mixed, rarity))[:size]]


def _summaries(batches: Iterator[pa.RecordBatch], size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Length and name of each set, and this task's part of the sketch."""
    sketch = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
    some = False
    for b in slices(batches, "_text"):
        sets = [tokens_of(t, size) for t in byte_texts(b, "_text")]
        every = np.concatenate(sets)
        for i, c in enumerate(cells(every)):
            sketch[i] += np.bincount(c, minlength=1 << SKETCH_BITS)
        some |= len(every) > 0
        n = len(sets)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int32()), pa.array(map(identity, sets), pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
    if some:
        parts = sketch.astype("<i4").reshape(-1, CHUNK)
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, schema.field(0).type), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], schema=schema)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the sketch's parts that this task holds."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            part = np.frombuffer(data, "<i8" if len(data) == 8 * CHUNK else "<i4").astype(np.int64)
            total[k] = total[k] + part if k in total else part
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total.values()], pa.binary())], names=["chunk", "data"])


def _postings(batches: Iterator[pa.RecordBatch], size: int, percent: int, sketch) -> Iterator[pa.RecordBatch]:
    """Prefix tokens under order 0, once for each set that a task reads."""
    seen: set[int] = set()
    for b in slices(batches, "_text"):
        out: list[list[np.ndarray]] = [[], [], [], []]
        for t in byte_texts(b, "_text"):
            tokens = tokens_of(t, size)
            if not len(tokens) or (name := identity(tokens)) in seen:
                continue
            seen.add(name)
            first = prefix(tokens, sketch.value, percent, 0)
            places = np.arange(len(first), dtype=np.int32)
            lone = np.minimum(*[sketch.value[i][c] for i, c in enumerate(cells(first))]) <= 1  # no other document has it
            first, places = first[~lone], places[~lone]
            for column, x in zip(out, (first.view(np.int64), np.full(len(first), name), np.full(len(first), len(tokens), np.int32), places), strict=True):
                column.append(x)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["token", "f", "n", "at"])


def _sets(batches: Iterator[pa.RecordBatch], size: int, percent: int, sketch, wanted, whole: bool) -> Iterator[pa.RecordBatch]:
    """Whole sets, or else prefixes under the other orders, of the documents whose hash is marked."""
    for b in batches:
        kept = np.flatnonzero(marked(wanted.value, np.asarray(b.column(1))))
        for part in slices(iter([b.take(pa.array(kept))]), "_text"):
            sets = [x for x in (tokens_of(t, size) for t in byte_texts(part, "_text")) if len(x)]
            if sets:
                columns = [sets] if whole else [[prefix(x, sketch.value, percent, order) for x in sets] for order in (1, 2)]
                if whole:
                    lists, least = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], []
                else:  # 16 of a token's bits do for a filter; tokens that agree in them count once
                    columns = [[np.unique(x.astype(np.uint16).view(np.int16)) for x in c] for c in columns]
                    lists = [pa.array(c, pa.list_(pa.int16())) for c in columns]
                    least = [pa.array([least_shared(len(x), percent) - (prefix_size(len(x), percent, 2) - len(c)) for x, c in zip(sets, columns[1], strict=True)], pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(map(identity, sets), pa.int64()), *lists, *least], names=["f", *(["tokens"] if whole else ["p1", "p2", "k"])])


def possible(na: Column, nb: Column, ia: Column, ib: Column, percent: int) -> Column:
    """Whether sets of these lengths that first meet at these places can be similar enough."""
    rest = F.least(na - ia, nb - ib)
    return 100 * rest >= percent * (na + nb - rest)


class NgramJoin:
    """One run of the join: `sets` has (id, n, f) of each row; `groups()`, `links()` and `link_counts()` do the rest."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80):
        self.spark, self.size, self.percent = df.sparkSession, size, percent
        self.docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        self.id_col = id_col
        id_type = self.docs.schema["_id"].dataType
        fields = [T.StructField("_id", id_type), T.StructField("n", T.IntegerType()), T.StructField("f", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("data", T.BinaryType())]
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType(fields))
        both = checkpointed(self.docs.mapInArrow(partial(_summaries, size=size, schema=schema), T.StructType(fields)))
        self.sets = both.where("chunk is null").select("_id", "n", "f")
        parts = both.where("chunk is not null").select("chunk", "data")
        parts = parts.mapInArrow(_added, "chunk int, data binary").repartition("chunk").mapInArrow(_added, "chunk int, data binary")
        sketch = np.zeros((SKETCH_ROWS << SKETCH_BITS) // CHUNK * CHUNK, np.int64)
        for r in parts.toLocalIterator():  # SKETCH_ROWS << SKETCH_BITS numbers, whatever the input
            sketch[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["data"], "<i8")
        self.sketch = self.spark.sparkContext.broadcast(sketch.reshape(SKETCH_ROWS, -1))
        self.nodes = self.sets.where("n > 0").groupBy("f").agg(F.min("_id").alias("rep"))

    def fetch(self, names: DataFrame, whole: bool) -> DataFrame:
        """(f, tokens), or else (f, p1, p2, k), of at least the named sets, each once."""
        ids = names.join(self.nodes, "f").select(F.xxhash64("rep").alias("h"))
        docs = self.docs.select("_id", F.xxhash64("_id").alias("h"), "_text")
        run = partial(_sets, size=self.size, percent=self.percent, sketch=self.sketch, wanted=self.spark.sparkContext.broadcast(marks(ids)), whole=whole)
        return docs.mapInArrow(run, "f long, tokens array<long>" if whole else "f long, p1 array<smallint>, p2 array<smallint>, k int").dropDuplicates(["f"])

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b), those that pass the other orders' filters and are similar enough."""
        side = lambda x, sets, *columns: sets.select(F.col("f").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
        names = lambda links: links.select(F.col("a").alias("f")).union(links.select(F.col("b").alias("f"))).distinct()
        pairs = checkpointed(pairs)
        first = checkpointed(self.fetch(names(pairs), whole=False))
        near = pairs.join(side("a", first, "p1", "p2", "k"), "a").join(side("b", first, "p1", "p2", "k"), "b")
        enough = F.size(F.array_intersect("p2_a", "p2_b")) >= F.least("k_a", "k_b")
        near = checkpointed(near.where(F.arrays_overlap("p1_a", "p1_b") & enough).select("a", "b"))
        sets = checkpointed(self.fetch(names(near), whole=True))  # whole sets move only for pairs that have passed
        full = near.join(side("a", sets, "tokens"), "a").join(side("b", sets, "tokens"), "b")
        met = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return checkpointed(full.where(100 * met >= self.percent * (F.size("tokens_a") + F.size("tokens_b") - met)).select("a", "b"))

    def hits(self) -> DataFrame:
        """(token, f, n, at) of the prefix tokens that several sets have."""
        run = partial(_postings, size=self.size, percent=self.percent, sketch=self.sketch)
        postings = self.docs.select("_text").mapInArrow(run, "token long, f long, n int, at int")
        shared = postings.groupBy("token").agg(F.min("f").alias("f0"), F.max("f").alias("f1")).where("f0 <> f1").select("token")
        return checkpointed(postings.join(shared, "token").dropDuplicates(["token", "f"]))

    def links(self) -> DataFrame:
        """All links (a, b), a < b, between different sets."""
        hits = self.hits()
        a, b = (hits.select("token", *[F.col(x).alias(f"{x}_{side}") for x in ("f", "n", "at")]) for side in "ab")
        fits = possible(F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b"), self.percent)
        pairs = a.join(b, "token").where((F.col("f_a") < F.col("f_b")) & fits)
        return self.verified(pairs.select(F.col("f_a").alias("a"), F.col("f_b").alias("b")).distinct())

    def link_counts(self) -> DataFrame:
        """One row for each document: id, n_shingles, n_links, the number of other rows that it is linked with, copies among them."""
        copies = self.sets.where("n > 0").groupBy("f").agg(F.count("*").alias("k"))
        links = self.links()
        ends = links.select(F.col("a").alias("to"), F.col("b").alias("f")).unionByName(links.select(F.col("b").alias("to"), F.col("a").alias("f")))
        more = ends.join(copies, "f").groupBy(F.col("to").alias("f")).agg(F.sum("k").alias("more"))
        out = self.sets.join(copies, "f", "left").join(more, "f", "left")
        n_links = F.coalesce(F.col("k") - 1, F.lit(0)) + F.coalesce("more", F.lit(0))
        return out.select(F.col("_id").alias(self.id_col), F.col("n").cast("long").alias("n_shingles"), n_links.cast("long").alias("n_links"))

    def spanning_links(self) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) between different sets that give the same components as all links, and (node, component)."""
        hits = self.hits()
        lead = hits.groupBy("token").agg(F.min(F.struct("at", "f", "n")).alias("l"))
        star = hits.join(lead, "token").where(F.col("f") != F.col("l.f")).where(possible(F.col("n"), F.col("l.n"), F.col("at"), F.col("l.at"), self.percent))
        star = star.groupBy("f", F.col("l.f").alias("b")).agg(F.count("*").alias("k")).groupBy("f").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
        first = self.verified(star.select(F.col("f").alias("a"), "b"))
        label = components(first).select(F.col("node").alias("f"), "component")
        hits = checkpointed(hits.join(label, "f", "left").withColumn("c", F.coalesce("component", "f")).drop("component"))
        mixed = hits.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min(F.struct("at", "f", "c"))["c"].alias("main")).where("c0 <> c1").select("token", "main")
        mixed = checkpointed(hits.join(mixed, "token"))
        a = mixed.where("c <> main").select("token", "main", *[F.col(x).alias(f"{x}_a") for x in ("f", "n", "at", "c")])
        b = mixed.select("token", *[F.col(x).alias(f"{x}_b") for x in ("f", "n", "at", "c")])
        met = F.col("c_a") != F.col("c_b")
        once = (F.col("c_b") == F.col("main")) | (F.col("f_a") < F.col("f_b"))
        fits = possible(F.col("n_a"), F.col("n_b"), F.col("at_a"), F.col("at_b"), self.percent)
        pairs = a.join(b, (a["token"] == b["token"]) & met & once & fits)
        pairs = pairs.select(F.least("f_a", "f_b").alias("a"), F.greatest("f_a", "f_b").alias("b")).distinct()
        links = first.unionByName(self.verified(pairs))
        return links, components(links)

    def groups(self) -> DataFrame:
        """One row for each document: id, n_shingles, component_id."""
        _, label = self.spanning_links()
        named = self.sets.join(label.select(F.col("node").alias("f"), "component"), "f", "left")
        # Nodes have 64-bit names of their own; documents without words stand alone.
        named = checkpointed(named.withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "f"))))
        least = named.where("component is not null").groupBy("component").agg(F.min("_id").alias("least"))
        out = named.join(least, "component", "left")
        return out.select(F.col("_id").alias(self.id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("_id")).otherwise(F.col("least")).alias("component_id"))


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents whose sets of `size`-word shingles have a Jaccard similarity of `percent` hundredths or more."""
    return NgramJoin(df, id_col, text_col, size, percent).groups()


def link_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """How many other rows each document is similar to, by all links and not only those that give the components."""
    return NgramJoin(df, id_col, text_col, size, percent).link_counts()


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of df, with its columns, of each component: that of the least id, and of its texts the one with the least hash; rows without words all stay.

    A row goes by its id and text together, so that other texts under the same id, or under a null id, are not lost with it.
    """
    hashed = F.xxhash64(F.col(text_col).cast("string"))
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), hashed.alias("h"))  # ids before nulls
    found = groups(df.select(row.alias("_row"), F.col(text_col).alias("_text")), "_row", "_text", size, percent)
    kept = F.col("_row") == F.col("component_id")
    gone = found.where(~kept).select("_row.id", "_row.h").distinct()
    repeated = found.where(kept & (F.col("n_shingles") > 0)).groupBy("_row").agg(F.count("*").alias("_n")).where("_n > 1").select("_row.id", "_row.h")
    return thinned(df, [F.col(id_col), hashed], gone, repeated)
