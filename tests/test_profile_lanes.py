"""Lanes of a profile beside auditory evidence, against numbers worked out by hand and rules written out in Python."""

from __future__ import annotations

from statistics import fmean, pstdev

import pytest

from tonewright.operators import auditory, evidence
from tonewright.plans import evidence as plans
from tonewright.plans import rolling

NAMES = ["low", "pressure", "harmonic", "high", "percussive", "density", "motion", "mid", "m_contour", "m_spread", "envelopment", "m_decorrelation", "m_centroid", "side_ratio", "m_rms"]


@pytest.fixture(scope="module")
def lanes(spark, small):
    return {(r["track"], r["segment"], r["lane"]): r for r in rolling.QUERIES["x16_lanes"](spark, small).collect()}


def test_score_takes_in_auditory_support(spark):
    """.68 of the profile and .32 of what is heard, and active by that; a segment without frames keeps its own score."""
    df = spark.createDataFrame([(0, i, float(i), i + 1.0, *[0.5] * len(NAMES)) for i in range(2)], "track int, segment int, start_s double, end_s double, " + ", ".join(f"{n} double" for n in NAMES))
    heard = spark.createDataFrame([(0, 0, *[1.0] * 8)], "track int, segment int, " + ", ".join(f"{n} double" for n in evidence.LANES))
    got = {(r["segment"], r["lane"]): r for r in plans.lanes(df, heard).collect()}
    assert len(got) == 16 and got[0, "low_body_lane"]["score"] == pytest.approx(0.68 * 0.5 + 0.32)
    assert got[0, "low_body_lane"]["active"] and got[0, "pressure_peak_lane"]["active"] and not got[1, "low_body_lane"]["active"]
    assert got[1, "low_body_lane"]["auditory"] is None and got[1, "low_body_lane"]["score"] == pytest.approx(0.5)


def test_segment_aggregates(spark):
    """Means and highest values of a segment's own frames; transients against the track's highest; a short last segment counts."""
    columns = [*dict.fromkeys([*auditory.MEANS.values(), *auditory.HIGHEST.values()])]
    df = spark.createDataFrame([(0, i, *[x] * len(columns)) for i, x in enumerate([0.1, 0.3, 0.2, 0.8, 0.6])], "track int, frame_idx int, " + ", ".join(f"{c} double" for c in columns))
    got = {r["segment"]: r for r in auditory.segment_aggregates(df, 2).collect()}
    assert [got[i]["low_mid_sustained"] for i in range(3)] == pytest.approx([0.2, 0.5, 0.6])
    assert [got[i]["broadband_peak_energy"] for i in range(3)] == pytest.approx([0.3, 0.8, 0.6])
    assert [got[i]["transient_low"] for i in range(3)] == pytest.approx([0.375, 1.0, 0.75])


def test_lanes_of_all_segments_with_their_contrast(lanes):
    """Each lane holds its score against the track's own, what entered and what left, beside the score of profile and hearing."""
    tracks = {t for t, _, _ in lanes}
    assert len(lanes) == 8 * len({(t, s) for t, s, _ in lanes})
    for t in tracks:
        for lane in evidence.LANES:
            mine = [r for k, r in sorted(lanes.items()) if k[0] == t and k[2] == lane]
            mean, sd = fmean(r["v"] for r in mine), pstdev(r["v"] for r in mine)
            before = 0.0
            for r in mine:
                against = 0.5 + ((r["v"] - mean) / sd if sd > 0.0001 else 0.0) / 3
                assert r["relative"] == pytest.approx(min(max(against, 0.0), 1.0), abs=1e-3)
                assert (r["entry"], r["leave"]) == pytest.approx((max(0.0, r["v"] - before), max(0.0, before - r["v"])), abs=3e-6)
                assert r["score"] == pytest.approx(0.68 * r["v"] + 0.32 * r["auditory"], abs=3e-6)
                before = r["v"]


def test_status_of_lanes_that_take_in_what_is_heard(spark, small, lanes):
    """Support, coverage and status of each lane are those of its blended scores."""
    got = {(r["track"], r["lane"]): r for r in rolling.QUERIES["g23_lanes"](spark, small).collect()}
    assert set(got) == {(t, n) for t, _, n in lanes}
    for (t, n), r in got.items():
        scores = [x["score"] for k, x in lanes.items() if k[0] == t and k[2] == n]
        share = fmean(x["active"] for k, x in lanes.items() if k[0] == t and k[2] == n)
        assert (r["mean_support"], r["max_support"], r["coverage"]) == pytest.approx((fmean(scores), max(scores), share), abs=2e-6)
        assert r["status"] == ("background_continuous_support" if share >= 0.85 else "tracked" if share > 0 else "not_stably_tracked")


def test_states_of_lanes_that_take_in_what_is_heard(spark, small, lanes):
    """Counts, best lanes, signature, mixedness and state of each segment follow from its blended scores."""
    got = {(r["track"], r["segment"]): r for r in rolling.QUERIES["x18_states"](spark, small).collect()}
    assert set(got) == {(t, s) for t, s, _ in lanes}
    background = {(t, n) for t in {k[0] for k in lanes} for n in evidence.LANES if fmean(x["active"] for k, x in lanes.items() if k[0] == t and k[2] == n) >= 0.85}
    for (t, s), r in got.items():
        mine = [x for k, x in lanes.items() if k[:2] == (t, s)]
        best = [x["lane"] for x in sorted((x for x in mine if x["active"]), key=lambda x: (-x["score"], x["lane"]))]
        unsure = sum(x["unsure"] for x in mine)
        mixed = min(len(best) / 4 + unsure / 8, 1.0)
        state = "contrast_peak_zone" if len(best) >= 4 or mixed >= 0.86 else "mixed_arrangement_zone" if len(best) >= 2 or mixed >= 0.55 else "single_lane_focus" if best else "ambiguous_low_contrast_zone" if unsure else "reduced_arrangement_support"
        assert (r["n_active"], r["n_unsure"], r["mixedness"], r["state"]) == (len(best), unsure, pytest.approx(mixed), state)
        assert r["dominant"] == (",".join(best[:4]) or None)
        assert r["signature"] == (",".join(sorted(n for n in best[:4] if (t, n) not in background)) or None)
