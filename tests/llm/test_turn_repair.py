"""Repaired conversations against a search over all edits, by plain Python."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from zlib import crc32

import pytest

from tonewright.llm import queries, turn_repair

BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """[(conv, turn, role, text)] with the damage that the contract names."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        solid = text.rstrip(BLANK)
        out.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def brute_edits(initials, faults):
    """(cost, audit) by dynamic programming over all edits, in texts."""
    n = len(initials)
    steps = {"": "u", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, state, put):
        found = []
        if i == n and state in ("", "a"):
            found.append((0, ""))
        if put < 2:  # two insertions in a row come back to the same state
            c, a = best(i, steps[state], put + 1)
            found.append((c + 2, "I" + a))
        if i < n:
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if faults[i] not in "bd":
                more = faults[i] == "t"
                if initials[i] == steps[state] or (initials[i] == "s" and state == ""):
                    c, a = best(i + 1, initials[i], 0)
                    found.append((c + more, "K" + a))
                c, a = best(i + 1, steps[state], 0)
                found.append((c + 2 + more, "R" + a))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def applied(turns, audit):
    out, i, state = [], 0, ""
    for e in audit:
        given = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        if e == "I":
            out.append((given, ""))
        elif e == "K":
            out.append(turns[i])
        elif e == "R":
            out.append((given, turns[i][1]))
        state = out[-1][0][0] if out else ""
        i += e != "I"
    return out


def brute(rows, groups=None):
    """The contract's columns for the conversations of rows that are damaged already."""
    held = {c: [] for c in (groups if groups is not None else {r[0] for r in rows})}
    for conv, turn, role, text in rows:
        held[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, g in held.items():
        g.sort()
        turns, kinds = [(r, t) for *_, r, t in g], faults([(r, t) for *_, r, t in g])
        cost, audit = brute_edits("".join(r[:1] or "o" for r, _ in turns), "".join(kinds))
        numbers = [n for real, n, *_ in g if real]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        text = "\n".join(f"{r}:{t}" for r, t in applied(turns, audit))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def rows_of(rng, n_conv, longest):
    texts = ["", " \t", None, "Hi.", "Hi!", "no end", "ok? \n", "x.\x0b", "same here.", "日本。", "É?"]
    rows = []
    for conv in [*range(n_conv), None]:
        for t in range(rng.randrange(1, longest)):
            turn = rng.choice([t, t, t, None, 2])
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Uhu"]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_by_brute_force(spark, seed, tmp_path):
    rng = random.Random(seed)
    rows = rows_of(rng, 40, 12) + [(99, None, "user", "only null turn.")]
    rows += rows[-4:]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, nth string, edit int").repartition(3).write.parquet(path)
    out = queries.op13_turn_repair(spark, str(tmp_path))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {t for c, t in out.dtypes[1:7]} == {"bigint"}
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute(damage(rows), {r[0] for r in rows})


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op13_turn_repair(spark, small).collect()}
    assert got == brute(damage(rows), {r[0] for r in rows})


def test_search_by_brute_force():
    rng = random.Random(7)
    for _ in range(3000):
        n = rng.randrange(9)
        codes = "".join(rng.choice("suao") + rng.choice("-----bdt") for _ in range(n))
        cost, step = turn_repair.cheapest(codes)
        assert (cost, "".join(s.edit for s in turn_repair.path(step))) == brute_edits(codes[::2], codes[1::2])


def test_long_conversations_and_pieces(spark, monkeypatch):
    """One conversation with most rows, by stretches of a few rows, and the search on a very long one."""
    monkeypatch.setattr(turn_repair, "PIECE", 7)
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", "again."])) for t in range(200)] + rows_of(rng, 3, 5)
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    got = {r[0]: tuple(r)[1:] for r in turn_repair.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()}
    assert got == brute(rows)
    cost, step = turn_repair.cheapest("".join(rng.choice("ua") + "-" for _ in range(50_000)))
    assert cost > 0 and step.row == 50_000


def test_repaired_rows_and_empty(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "  "), (1, 3, "user", "and"), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in turn_repair.repair(df).orderBy("conv_id", "turn").select("conv_id", "role", "text", "edit").collect()]
    assert got == [(1, "system", "Be kind.", "K"), (1, "user", "", "I"), (1, "assistant", "Hello.", "K")]
    assert turn_repair.digests(df.limit(0)).count() == 0 and turn_repair.repair(df.limit(0)).count() == 0
    assert {r["conv_id"]: r["audit"] for r in turn_repair.digests(df).collect()} == {1: "KIKDD", 2: "D"}  # D comes before KI at the same cost
