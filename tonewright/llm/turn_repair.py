"""Repair of conversations by the cheapest edits that give `(system? (user assistant)+)?`.

Every conversation is a lattice of (rows read, state of that grammar); keeping a row costs
nothing, giving it the role that comes next 2, deleting it 3, inserting an empty turn of the
role that comes next 2, and a truncated row that stays 1 more. Dijkstra's search pops the nodes
in order of (cost, audit), the audit being the edits' initials so far, and ends at the first node
with all rows read in a state in which a conversation may end. Nodes and edges are made as they are
reached. Among audits of one cost neither is the other's beginning (the rows read are as many,
and more insertions cost more), so that their order holds for all that follows from them.

Audits are paths in the tree of settled nodes; each node keeps its parent and one jump to an
ancestor, so that two of them are compared in logarithmic time and a conversation of n rows
takes memory in proportion to n, not to n * n as texts would.

What the search needs of a row is two characters. Rows are numbered along conversations by ranges
(`ordered.py`), these are put together by stretches and then by conversation, so
that a conversation with a large share of all rows comes to a task as a short text; its rows meet
their edits again by (conversation, number).

Faults, the first of which counts: blank (no character but blanks, tabs and line ends), duplicate (role and text
seen earlier in the conversation), truncated (the last such character is none of `.!?`). Blank and duplicate
rows must go.

Defined results:
* Null roles and texts count as one blank. Null conversations make one conversation of their own.
* Rows: by turn, nulls first; ties by role, then by text.
* Roles count by their first character; others than s, u and a (also empty ones) must be changed or go.
* Conversations whose rows all go have an empty text. An empty table gives no rows; other columns are not looked at.
* digests() writes a repaired conversation in one row, as a digest of it must; one of over 2 GB would not fit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import laid_out, running, written

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a conversation that are put together before all of it is.
PIECE = 4096
ROLES = {"u": "user", "a": "assistant"}

START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that comes next in each state, and the state after it.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ENDS = (START, ASSISTANT)


class Step:
    """A path of edits: the last one, the path before it, and a jump to an ancestor."""

    __slots__ = ("edit", "row", "state", "parent", "depth", "jump")

    def __init__(self, edit: str, row: int, state: int, parent: Step | None):
        self.edit, self.row, self.state, self.parent = edit, row, state, parent
        if parent is None:
            self.depth, self.jump = 0, self
        else:
            self.depth = parent.depth + 1
            up = parent.jump
            self.jump = up.jump if parent.depth - up.depth == up.depth - up.jump.depth else parent

    def at(self, depth: int) -> Step:
        step = self
        while step.depth > depth:
            step = step.jump if step.jump.depth >= depth else step.parent
        return step

    def __lt__(self, other: Step) -> bool:
        """Whether this audit comes before the other in ASCII order."""
        depth = min(self.depth, other.depth)
        a, b = self.at(depth), other.at(depth)
        if a is b:
            return self.depth < other.depth
        while a.parent is not b.parent:
            a, b = (a.jump, b.jump) if a.jump is not b.jump else (a.parent, b.parent)
        return a.edit < b.edit


def cheapest(rows: str) -> tuple[int, Step]:
    """Cost and last step of the edits for a conversation, given two characters a row (initial and fault)."""
    n = len(rows) // 2
    queue, settled = [(0, Step("", 0, START, None))], set()
    while True:
        cost, step = heapq.heappop(queue)
        node = (step.row, step.state)
        if node in settled:
            continue
        settled.add(node)
        row, state = node
        if row == n and state in ENDS:
            return cost, step
        role, after = NEXT[state]
        heapq.heappush(queue, (cost + INSERT, Step("I", row, after, step)))
        if row == n:
            continue
        initial, fault = rows[2 * row], rows[2 * row + 1]
        heapq.heappush(queue, (cost + DELETE, Step("D", row + 1, state, step)))
        if fault in "bd":
            continue
        more = TRUNCATED if fault == "t" else 0
        if initial == role or (initial == "s" and state == START):
            heapq.heappush(queue, (cost + more, Step("K", row + 1, after if initial == role else SYSTEM, step)))
        heapq.heappush(queue, (cost + REROLE + more, Step("R", row + 1, after, step)))


def path(step: Step) -> list[Step]:
    out = []
    while step.parent is not None:
        out.append(step)
        step = step.parent
    return out[::-1]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation a row numbered -1 with cost and audit, and one for each of its rows, and one for its end."""
    names = ["conv_id", "nth", "edit", "role", "before", "cost"]
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cost, last = cheapest(codes)
            steps = path(last)
            out = [(conv, -1, "".join(s.edit for s in steps), codes[::2], "", cost)]
            before = ""
            for s in steps:
                given = "a" if s.state == ASSISTANT else "u" if s.state == USER else None
                if s.edit == "I":
                    before += given
                else:
                    out.append((conv, s.row - 1, s.edit, ROLES[given] if s.edit == "R" else None, before, 0))
                    before = ""
            if before:
                out.append((conv, len(codes) // 2, "", None, before, 0))
            for k in range(0, len(out), 50_000):
                columns = list(zip(*out[k : k + 50_000], strict=True))
                types = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, nth and total (the conversation's rows) of every row, as a written table."""
    null = F.lit(" ")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", null).alias("role"), F.coalesce("text", null).alias("text"))
    rows = laid_out(rows.withColumn("_lead", F.substring("text", 1, 64)), ["conv_id", "turn", "role", "_lead"])
    rows = running(rows, "conv_id", ["turn", "role", "text"], F.lit(1).cast("long"))
    return written(rows.select("conv_id", "turn", "role", "text", F.col("_before").alias("nth"), F.col("_total").alias("total")))


def faulty(rows: DataFrame) -> DataFrame:
    """conv_id, turn, nth, total, initial and the three faults of numbered() rows; no text is shuffled."""
    solid = F.rtrim("text", F.lit(BLANKS))
    rows = rows.select("conv_id", "turn", "nth", "total", "role", F.sha2("text", 256).alias("_sha"), (solid == "").alias("blank"), (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("_open"))
    first = rows.groupBy("conv_id", "role", "_sha").agg(F.min("nth").alias("_n")).select(F.col("conv_id").alias("_c"), "_n")
    joined = rows.drop("_sha").join(first, rows["conv_id"].eqNullSafe(first["_c"]) & (rows["nth"] == first["_n"]), "left")
    initial, again = F.substring("role", 1, 1), F.col("_n").isNull()
    return joined.select(
        "conv_id", "turn", "nth", "total",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        "blank",
        (~F.col("blank") & again).alias("duplicate"),
        (~F.col("blank") & ~again & F.col("_open")).alias("truncated"),
    )


def _together(df: DataFrame, text: Column, between: str) -> DataFrame:
    """One text for each conversation out of its rows' texts; those of long ones by stretches first."""
    df = df.select("conv_id", "nth", text.alias("_text"), "total")

    def held(rows: DataFrame, *keys: Column) -> DataFrame:
        rows = rows.groupBy("conv_id", *keys).agg(F.min("nth").alias("nth"), F.sort_array(F.collect_list(F.struct("nth", "_text"))).alias("_held"))
        return rows.select("conv_id", "nth", F.array_join("_held._text", between).alias("_text"))

    long = held(df.where(F.col("total") > PIECE), F.floor(F.col("nth") / PIECE).alias("_piece"))
    return held(df.where(F.col("total") <= PIECE)).unionByName(held(long)).select("conv_id", "_text")


def edits(rows: DataFrame) -> DataFrame:
    """conv_id, nth, edit, role, before, cost, out of faulty() rows, as a written table.

    Row -1 of a conversation has its audit as edit, its cost and its rows' initials as role; the others
    say what becomes of row nth, its new role, and the initials of the turns that go in before it.
    """
    fault = F.when(F.col("blank"), "b").when(F.col("duplicate"), "d").when(F.col("truncated"), "t").otherwise("-")
    codes = _together(rows, F.concat("initial", fault), "").repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    kind = dict(rows.dtypes)["conv_id"]
    return written(codes.mapInArrow(_edits, f"conv_id {kind}, nth long, edit string, role string, before string, cost long"))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, nth, total, turns: what row nth of numbered() becomes, array<struct<role, text, edit>>; `nth` orders a conversation's rows."""
    found = found.where("nth >= 0").select(F.col("conv_id").alias("_c"), F.col("nth").alias("_n"), "edit", F.col("role").alias("given"), "before")
    joined = found.join(rows, rows["conv_id"].eqNullSafe(found["_c"]) & (rows["nth"] == found["_n"]), "left")
    initials = F.filter(F.split("before", ""), lambda x: x != "")
    put = F.transform(initials, lambda x: F.struct(F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit")))
    own = F.array(F.struct(F.coalesce("given", "role").alias("role"), "text", "edit"))
    turns = F.when(F.col("edit").isin("K", "R"), F.concat(put, own)).otherwise(put)
    return joined.select(F.col("_c").alias("conv_id"), F.col("_n").alias("nth"), F.coalesce("total", "_n").alias("total"), turns.alias("turns")).where(F.size("turns") > 0)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, edit: the repaired conversations; `turn` is a struct that orders a conversation's rows."""
    rows = numbered(conversations)
    out = repaired(rows, edits(faulty(rows))).select("conv_id", "nth", F.posexplode("turns").alias("k", "t"))
    return out.select("conv_id", F.struct("nth", "k").alias("turn"), "t.role", "t.text", "t.edit")


def digests(conversations: DataFrame) -> DataFrame:
    """Each conversation's faults, the cost and audit of its edits, and a digest of the repaired text."""
    rows = numbered(conversations)
    kinds = faulty(rows)
    found = edits(kinds)
    count = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    faults = kinds.groupBy("conv_id").agg(gaps.alias("gaps"), *map(count, ("blank", "duplicate", "truncated")))
    legal = F.regexp_count("role", F.lit("(?=su|ua|au)"))
    told = found.where("nth = -1").select(F.col("conv_id").alias("_a"), (F.length("role") - 1 - legal).cast("long").alias("illegal"), "cost", F.col("edit").alias("audit"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    texts = _together(repaired(rows, found), line, "\n").withColumnsRenamed({"conv_id": "_b"})
    out = faults.join(told, F.col("conv_id").eqNullSafe(F.col("_a"))).join(texts, F.col("conv_id").eqNullSafe(F.col("_b")), "left")
    digest = F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", digest.alias("repaired_sha256"))
