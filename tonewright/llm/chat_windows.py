"""Training windows of conversations: turn-aligned spans under a budget of tokens, with a mask of what to learn.

Prefix sums of the turns' tokens choose the spans: a turn belongs to the window that its first
token falls in, windows being half as wide as what the budget leaves beside the system turn and
the history, so that a span fits with its last turn; a turn wider than that stands alone.
Every window but the first starts with the conversation's system turn (its first row, if
that has the role `system`) and with the last turns of the window before, HISTORY_TURNS and
HISTORY tokens of them at most. Both are marked as repeated and are not under the loss mask, so
that every assistant text is learnt once.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`. Inside texts and roles, `<`, any number of
backslashes and `|` get one backslash more, so that no text can open or close a turn, and reading
takes it away again; in roles, backslashes and line ends are escaped before that. `tokens` is
a column of `conversations`; without it a turn counts MARKS tokens and one for every four bytes.

Defined results:
* Null texts and roles count as empty. Null conversations make one conversation of their own.
* Turns: nulls first; ties by role, then by text; repeated rows are turns of their own.
* A lone turn, or a system turn, over the budget is kept whole in a window with `over_budget`. Texts are never cut.
* An empty table gives no windows. Other columns are not looked at, whatever their names; a row's `tokens` below 1 count as 1.
* Turns of a long conversation are dealt over tasks by ranges. digests() writes a conversation's text in one row, as a digest
  of it must, out of pieces of many windows; a conversation of over 2 GB would not fit that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import laid_out, running, split_groups, stretch, written

BUDGET, HISTORY, HISTORY_TURNS = 2048, 256, 4
#: Tokens of a turn's marks, and the least width of a window's span.
MARKS, LEAST = 5, 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Tokens whose turns digests() puts together before it makes one text of a conversation.
PIECE = 1 << 16


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    """Reads _role_out(); a doubled backslash is told from a line end by the pairs before it."""
    plain = F.split(unescaped(role), r"\\\\")
    return F.array_join(F.transform(plain, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def windows(conversations: DataFrame, tokens: str | None = None, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """conv_id, start, total, turns, formatted, mask, n_repeated, n_tokens, over_budget.

    `start` is the number of a conversation's tokens before the window's own and orders its windows, `total` all its tokens.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    count = F.ceil(F.octet_length(text) / 4) + MARKS if tokens is None else F.greatest(F.coalesce(F.col(tokens).cast("long"), F.lit(1)), F.lit(1))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), count.cast("long").alias("tokens"))
    order = ["turn", "role", "text"]
    rows = laid_out(rows.withColumn("_lead", F.substring("text", 1, 64)), ["conv_id", "turn", "role", "_lead"]).drop("_lead")
    placed = running(rows, "conv_id", order, F.col("tokens"))
    # the system turn's tokens, from the first row of a conversation; of those in several parts there is at most one a part
    here = F.first(F.when((F.col("_before") == 0) & (F.col("role") == "system"), F.col("tokens"))).over(stretch("conv_id", order))
    heads = running(rows, "conv_id", order, F.col("tokens")).where("_split AND _before = 0 AND role = 'system'").select(F.col("conv_id").alias("_c"), F.col("tokens").alias("_there"))
    placed = placed.join(F.broadcast(heads), placed["_split"] & placed["conv_id"].eqNullSafe(heads["_c"]), "left").withColumn("_held", F.coalesce("_there", here))
    width = F.greatest(F.floor((budget - history - F.coalesce("_held", F.lit(0))) / 2), F.lit(LEAST))
    placed = placed.withColumn("_width", width).withColumns({"_window": F.floor(F.col("_before") / F.col("_width")), "_wide": F.col("tokens") > F.col("_width")})

    turn = F.struct(F.col("_before").alias("at"), "role", "text", "tokens")
    spans = placed.groupBy("conv_id", "_part", "_window", "_wide").agg(F.sort_array(F.collect_list(turn)).alias("own"), F.max("_held").alias("_held"), F.max("_total").alias("total"), F.max("_split").alias("_split"))
    spans = written(spans)
    cut = spans.where("_split").groupBy("conv_id", "_window", "_wide").agg(F.sort_array(F.flatten(F.collect_list("own"))).alias("own"), F.max("_held").alias("_held"), F.max("total").alias("total"), F.min("_part").alias("_part"))
    last = F.element_at("own", -1)
    spans = spans.where("NOT _split").drop("_split").unionByName(cut).withColumns({"start": F.col("own")[0]["at"], "end": last["at"] + last["tokens"]})
    return _written(spans.where("start = 0").withColumn("again", _none()).unionByName(_followed(spans, split_groups(rows, "conv_id", F.col("tokens")), history, history_turns), True)).withColumn("over_budget", F.col("n_tokens") > budget)


def _none() -> Column:
    return F.array().cast("array<struct<role:string,text:string,tokens:bigint>>")


def _followed(spans: DataFrame, split: DataFrame, history: int, history_turns: int) -> DataFrame:
    """The spans behind the first of their conversation, with what they repeat: the system turn and the last turns before."""
    plain = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"))
    first, later = spans.where((F.col("start") == 0) & F.col("_held").isNotNull() & (F.col("end") < F.col("total"))), spans.where("start > 0")
    # the system turn goes to each part in which its conversation has spans
    parts = split.select("_g", F.col("_p").alias("_to"))
    system = first.select(F.col("conv_id").alias("_c"), "_part", plain(F.col("own")[0]).alias("_system"))
    system = system.join(F.broadcast(parts), system["_c"].eqNullSafe(parts["_g"]), "left").select("_c", F.coalesce("_to", "_part").alias("_p"), "_system")
    later = later.join(system, later["conv_id"].eqNullSafe(system["_c"]) & (later["_part"] == system["_p"]), "left").drop("_c", "_p")
    # the last turns of each span, for the span that starts where it ends
    tail = F.filter(F.slice("own", F.greatest(F.size("own") - history_turns + 1, F.lit(1)), history_turns), lambda t: (F.col("end") - t["at"] <= history) & ~(F.col("_held").isNotNull() & (t["at"] == 0)))
    before = spans.where(F.col("end") < F.col("total")).select(F.col("conv_id").alias("_c"), F.col("end").alias("_s"), F.transform(tail, plain).alias("past")).where(F.size("past") > 0)
    later = later.join(before, later["conv_id"].eqNullSafe(before["_c"]) & (later["start"] == before["_s"]), "left").drop("_c", "_s")
    system = F.when(F.col("_system").isNotNull(), F.array("_system")).otherwise(_none())
    return later.withColumn("again", F.concat(system, F.coalesce("past", _none()))).drop("_system", "past")


def _written(spans: DataFrame) -> DataFrame:
    """The text of each window's turns, and the places of the assistant texts that are not repeated."""
    own = F.transform("own", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), F.lit(False).alias("repeated")))
    again = F.transform("again", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), F.lit(True).alias("repeated")))
    spans = spans.select("conv_id", "start", "total", F.concat(again, own).alias("turns"))
    head = lambda t: F.concat(F.lit(OPEN), _role_out(t["role"]), F.lit("\n"))
    marked = spans.withColumn("_parts", F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), ((t["role"] == "assistant") & ~t["repeated"]).alias("learnt"))))
    place = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def step(done: Column, t: Column) -> Column:
        start, length = done["at"] + F.length(t["head"]), F.length(t["body"])
        mask = F.when(t["learnt"], F.concat(done["mask"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(done["mask"])
        return F.struct((start + length + len(CLOSE)).alias("at"), mask.alias("mask"))

    return marked.select(
        "conv_id",
        "start",
        "total",
        "turns",
        F.array_join(F.transform("_parts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("_parts", place, step)["mask"].alias("mask"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("n_repeated"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("n_tokens"),
    )


def read_turns(formatted: Column, n_repeated: Column) -> Column:
    """array<struct<role, text>> of the turns in a window's text, without those it repeats."""
    parts = F.split(formatted, r"<\|im_end\|>\n")
    own = F.slice(parts, n_repeated + 1, F.size(parts) - 1 - n_repeated)

    def read(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), "\n", 1)
        return F.struct(_role_in(role).alias("role"), unescaped(F.substr(part, F.lit(len(OPEN) + 2) + F.length(role))).alias("text"))

    return F.transform(own, read)


def read_learnt(formatted: Column, mask: Column) -> Column:
    """The texts under a window's loss mask, one after the other."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substr(formatted, m["start"] + 1, m["length"]))), "")


def digests(made: DataFrame) -> DataFrame:
    """Each conversation's counts and digests, read back from windows()."""
    turns = read_turns(F.col("formatted"), F.col("n_repeated"))
    read = made.select(
        "conv_id",
        "start",
        "total",
        F.size(turns).cast("long").alias("n_turns"),
        F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("told"),
        read_learnt(F.col("formatted"), F.col("mask")).alias("learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

    def together(rows: DataFrame, *keys: Column) -> DataFrame:
        texts = F.sort_array(F.collect_list(F.struct("start", "told", "learnt"))).alias("_texts")
        rows = rows.groupBy("conv_id", *keys).agg(F.sum("n_turns").alias("n_turns"), F.min("start").alias("start"), texts, F.sum("formatted_chars").alias("formatted_chars"))
        return rows.withColumns({c: F.array_join(f"_texts.{c}", "") for c in ("told", "learnt")}).drop("_texts")

    long = together(read.where(F.col("total") > PIECE), F.floor(F.col("start") / PIECE).alias("_piece"))
    read = together(read.where(F.col("total") <= PIECE)).unionByName(together(long))
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("told").cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
