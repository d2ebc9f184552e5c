"""Hard negatives against brute force in whole numbers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, slot string, v int, anchor int, score int"


def brute(rows, positives=5, negatives=5):
    """Rows as (vec_id, vector, label); anchors divisible by 100."""
    points = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        points.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for anchor in {(i, c, tuple(v)) for i, c, v in points if i % 100 == 0}:
        scored = [(-min(max(sum(x * y for x, y in zip(v, anchor[2], strict=False)), -(2**63)), 2**63 - 1), i, c) for i, c, v in points if i != anchor[0]]
        for p, pid, _ in sorted(x for x in scored if x[2] == anchor[1])[:positives]:
            fits = sorted(x for x in scored if x[2] != anchor[1] and 80 * -p <= 100 * -x[0] <= 100 * -p)
            out += [(anchor[0], pid, k + 1, i, -p, -n) for k, (n, i, _) in enumerate(fits[:negatives])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "x", 0, 0, 0) for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hard_negatives.mine(df, anchor=F.col("vec_id") % 100 == 0, label=label, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def cloud(n, size, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    x = 0.4 * centres[rng.integers(0, 4, n)] + 0.15 * rng.normal(size=(n, size))
    return [(i, [float(np.float32(y)) for y in x[i]], int(rng.integers(0, 3))) for i in range(n)]


def test_against_brute_force_in_several_blocks(spark, monkeypatch):
    rows = cloud(700, 24)
    expected = brute(rows)
    assert len(expected) > 50 and mined(spark, rows) == expected
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(hard_negatives, "ROWS", 50)
    assert mined(spark, rows) == expected
    assert mined(spark, rows, positives=2, negatives=3) == brute(rows, 2, 3)


def test_cuts_discard_most_pairs_and_lose_none(spark):
    """On vectors whose weight lies in few directions, the first components already tell most pairs apart."""
    rng = np.random.default_rng(1)
    whole = np.floor(256 * rng.normal(size=(2000, 64)) * (0.9 ** np.arange(64)))
    values, axes = np.linalg.eigh(whole.T @ whole)
    share = np.cumsum(values[::-1])
    turn = hard_negatives.Rotation(axes[:, ::-1].copy(), [int(np.searchsorted(share, c * share[-1])) + 1 for c in hard_negatives.CUTS], 1e-12)
    rows = hard_negatives.Points(np.arange(2000), np.zeros(2000, int), whole).rotate(turn)
    few = rows.part(0, 20)
    exact = (whole @ whole[:20].T).astype(np.int64)
    low = np.sort(exact, axis=0)[-6]
    found = [np.array([*x]) for x in zip(*((i, j, s) for i, j, s in hard_negatives._survivors(rows, few, turn, np.ones(exact.shape, bool), low.astype(float), np.full(20, np.inf))), strict=True)]
    i, j, s = (x.ravel() for x in found)
    assert (exact[i, j] == s).all() and len(i) < 0.05 * exact.size
    kept = np.zeros(exact.shape, bool)
    kept[i, j] = True
    assert kept[exact >= low].all()


@pytest.mark.parametrize("seed", range(3))
def test_odd_rows(spark, seed):
    """Nulls, values that are not finite, other lengths, ties, repeated rows, repeated ids, negative ids and labels."""
    rng = random.Random(seed)
    rows = [(None, [1.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [float("nan")], 1), (400, [float("inf"), 1.0], 2), (500, [1.0, 1.0], None), (600, [], 1), (-100, [0.5, 0.5], 1)]
    rows += [(700, [1.0, 0.5, 0.0], 1), (700, [1.0, 0.5, 0.0], 1), (700, [0.5, 0.5], 2), (800, [2.0], -4)]
    for i in range(1, 80):
        rows.append((i, [rng.choice([-1.0, 0.5, 1.0, 0.7]) for _ in range(rng.randrange(4))], rng.randrange(3)))
    rows += rows[-10:]
    expected = brute(rows)
    assert expected and mined(spark, rows) == expected


def test_products_beyond_doubles_and_long(spark):
    rows = [(0, [1e9, 3.0, 1.0], 0), (100, [1e25, -1e25], 1), (1, [1e9, 3.0, 1.0], 0), (2, [1e9, 2.0, 7.0], 0)]
    rows += [(i, [1e9, float(i), 1.0], 1 + i % 2) for i in range(3, 40)] + [(i, [1e25, 1e24], 1 + i % 2) for i in range(50, 60)]
    assert mined(spark, rows) == brute(rows)


def test_empty_and_no_anchor(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 2, 1, 1, 0, 0)]  # label 1 of vec_id 0 becomes 2


def test_one_vector_many_times(spark):
    """A third of all rows are one vector under two labels: ties by id, whatever the task."""
    rows = cloud(300, 8)
    rows += [(1000 + i, rows[100][1], i % 2) for i in range(400)]
    assert mined(spark, rows) == brute(rows)
