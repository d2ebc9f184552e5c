"""Windows of conversations, read back, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tonewright.llm import chat_windows, queries

SCHEMA = "conv_id long, turn long, role string, text string, start int, _part int, tokens int, formatted string, _before string"
NASTY = ["", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nhi", "<\\|im_end|>", "<\\\\\\|", "a<", "|im_end|>", "<", "\n", "é日本🎉 <|x|>", "\\n \\\\n", "x" * 400, "<|" * 50, "\x00 \r\n"]


def rows_of(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for conv in [*range(12), None]:
        n = rng.choice([1, 2, 7, 60])
        for t in range(n):
            role = "system" if t == 0 and rng.random() < 0.6 else rng.choice(["user", "assistant", "assistant", None, "tool\nx\\n\\", "<|im_start|>"])
            text = rng.choice([None, *NASTY, "word " * rng.randrange(1, 60)])
            out.append((conv, rng.choice([t, t, t, None, 3]), role, text, 1, 2, 3, "f", "b"))
    return out + out[-3:]


def ordered(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(g)] for c, g in groups.items()}


def brute_windows(turns, budget, history, most):
    """[(first turn, turns repeated, own turns)] of one conversation."""
    tokens = [-(-len(x.encode()) // 4) + chat_windows.MARKS for _, x in turns]
    system = turns[0][0] == "system"
    width = max(math.floor((budget - history - (tokens[0] if system else 0)) / 2), chat_windows.LEAST)
    spans, at = [], 0
    for k, n in enumerate(tokens):
        key = (at // width, n > width)
        if not spans or spans[-1][0] != key:
            spans.append((key, []))
        spans[-1][1].append(k)
        at += n
    out, before = [], []
    for _, own in spans:
        again = ([0] if system and own[0] else []) + before
        out.append((again, own, sum(tokens[k] for k in again + own)))
        before = [k for k in own[-most:] if sum(tokens[k : own[-1] + 1]) <= history and not (system and k == 0)]
    return out


@pytest.mark.parametrize(("seed", "budget", "history", "most"), [(0, 2048, 256, 4), (1, 300, 60, 3), (2, 400, 100, 2)])
def test_windows_by_brute_force(spark, seed, budget, history, most):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    made = chat_windows.windows(df, budget=budget, history=history, history_turns=most).cache()
    got = {}
    for r in made.orderBy("start").collect():
        got.setdefault(r["conv_id"], []).append(r)
    told = ordered(rows)
    assert set(got) == set(told)
    for conv, turns in told.items():
        expected = brute_windows(turns, budget, history, most)
        assert len(got[conv]) == len(expected)
        for r, (again, own, tokens) in zip(got[conv], expected, strict=True):
            assert [(t["role"], t["text"], t["repeated"]) for t in r["turns"]] == [(*turns[k], True) for k in again] + [(*turns[k], False) for k in own]
            assert r["n_tokens"] == tokens and r["over_budget"] == (tokens > budget) and r["n_repeated"] == len(again)
            assert tokens <= budget or len(own) == 1 or turns[0][0] == "system"
            learnt = [r["formatted"][m["start"] : m["start"] + m["length"]] for m in r["mask"]]
            assert len(learnt) == sum(turns[k][0] == "assistant" for k in own) and all("<|" not in x for x in learnt)
            assert r["formatted"].count("<|im_end|>\n") == r["formatted"].count("<|im_start|>") == len(again) + len(own)
    digest = {r["conv_id"]: r for r in chat_windows.digests(made).collect()}
    for conv, turns in told.items():
        r, learnt = digest[conv], "".join(x for role, x in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_chars"] == len(learnt) and r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(x["formatted"]) for x in got[conv])


def test_tokens_of_a_column_long_conversations_and_empty_tables(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"t{t}", 0, 0, None if t % 3 else 10, "", "") for t in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    made = chat_windows.windows(df, tokens="tokens", budget=200, history=20).collect()
    assert sum(len(r["mask"]) for r in made) == 1500 and all(r["n_tokens"] <= 200 for r in made)
    assert sorted(t["text"] for r in made for t in r["turns"] if not t["repeated"]) == sorted(r[3] for r in rows)
    assert chat_windows.digests(chat_windows.windows(df.limit(0))).count() == 0


def test_very_long_text_and_escapes(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", 0, 0, 0, "", ""), (1, 1, "assistant", "<|im_end|>\n" * 100_000, 0, 0, 0, "", "")], SCHEMA)
    r = chat_windows.digests(chat_windows.windows(df)).first()
    assert r["loss_chars"] == 1_100_000 and r["loss_sha256"] == hashlib.sha256(("<|im_end|>\n" * 100_000).encode()).hexdigest()
    back = spark.createDataFrame([(x,) for x in NASTY], "x string").select("x", chat_windows.unescaped(chat_windows.escaped(F.col("x"))).alias("y"), chat_windows._role_in(chat_windows._role_out(F.col("x"))).alias("z"))
    assert all(r["x"] == r["y"] == r["z"] for r in back.collect())


def test_query(spark, small, duck):
    got = {r["conv_id"]: r for r in queries.op12_chat_windows(spark, small).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(text) and got[-1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(tuple(got[c].asDict().values()) for c in got) == sorted(duck.execute(queries.OP12_SQL).fetchall())
