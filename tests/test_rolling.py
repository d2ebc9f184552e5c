"""Rolling auditory windows, quantiles, display matrices and readable ranges against plain numpy and Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.operators import auditory, quantiles, ranges
from tonewright.operators import evidence as E
from tonewright.operators import scorers as S
from tonewright.plans import evidence as V

CENTRES = np.array([60.0, 180.0, 400.0, 900.0, 3000.0, 5000.0, 9000.0])


def tracks(frames=97, seed=4):
    """{track: (times, middle, side)}; one is silent, one has no side, one has one frame."""
    rng = np.random.default_rng(seed)
    out = {}
    for track, n in ((0, frames), (1, frames), (2, 40), (3, 40), (4, 1), (5, 11)):
        mid, side = rng.gamma(1.0, 2.0, (7, n)), rng.gamma(0.6, 1.0, (7, n))
        if track == 2:
            mid, side = mid * 0, side * 0
        if track == 3:
            side = side * 0
        out[track] = (np.arange(n) * 0.1, mid, side)
    return out


def matrix(spark, data):
    rows = [(k, i, float(t), c, float(CENTRES[c]), float(mid[c, i]), float(side[c, i])) for k, (times, mid, side) in data.items() for i, t in enumerate(times) for c in range(7)]
    return spark.createDataFrame(rows, "track int, frame_idx int, t double, channel int, centre double, mid double, side double").repartition(5)


def level(m):
    x = np.log1p(np.maximum(m, 0))
    q = np.percentile(x, 98)
    q = q if q > 1e-12 else x.max()
    return np.clip(x / q, 0, 1) if q > 1e-12 else x * 0


def brute_windows(times, mid, side, length, hop):
    mid, side = level(mid), level(side)
    band = lambda m, b: m[(CENTRES >= auditory.BROAD[b][0]) & (CENTRES < auditory.BROAD[b][1])].mean(axis=0)
    curve = {f"{b}_{n}": band(m, b) for n, m in (("mid", mid), ("side", side)) for b in auditory.BROAD}
    curve |= {"all_mid": mid.mean(axis=0), "all_side": side.mean(axis=0)}
    curve["total"] = np.clip(curve["all_mid"] + curve["all_side"], 0, 1)
    sums = {"broadband": curve["total"], **{b: np.clip(curve[f"{b}_mid"] + curve[f"{b}_side"], 0, 1) for b in ("low", "mid", "high")}}
    for b, x in sums.items():
        up = np.maximum(np.diff(x, prepend=x[:1]), 0)
        curve[f"rise_{b}"] = up / up.max() if up.max() > 1e-12 else up * 0
    out, start, duration = [], 0.0, times[-1]
    while start < duration:
        end = min(start + length, duration)
        inside = (times >= start - 1e-9) & (times < end - 1e-9)
        out.append({"start_s": start, "end_s": end, **{n: curve[c][inside].mean() for n, c in auditory.MEANS.items()}, **{n: curve[c][inside].max() for n, c in auditory.HIGHEST.items()}})
        start += hop
        if start + max(0.25, min(length, 1.0)) > duration + 1e-9:
            break
    return out


@pytest.mark.parametrize("stretch", [4096, 7])
def test_windows_against_numpy(spark, monkeypatch, stretch):
    monkeypatch.setattr(auditory, "STRETCH", stretch)
    data = tracks()
    got = S.applied(auditory.pane_windows(auditory.curves(auditory.levels(matrix(spark, data)))), [auditory.RATIOS, auditory.SUPPORT]).orderBy("track", "segment").collect()
    expected = [(k, i, w) for k, (t, m, s) in data.items() for i, w in enumerate(brute_windows(t, m, s, 3.0, 1.0))]
    assert [(r["track"], r["segment"]) for r in got] == [(k, i) for k, i, _ in expected] and {k for k, *_ in expected} == {0, 1, 2, 3, 5}
    for r, (_, _, w) in zip(got, expected, strict=True):
        assert {n: r[n] for n in w} == pytest.approx(w)
        ratio = w["broadband_side_energy"] / max(w["broadband_side_energy"] + w["broadband_mid_energy"], 1e-12)
        assert r["side_ratio_broadband"] == pytest.approx(ratio)
        assert r["spatial_spread_lane"] == pytest.approx(min(0.5 * ratio + 0.25 * w["mid_high_side_sustained"] + 0.25 * w["broadband_side_energy"], 1))
        assert r["foreground_contour_lane"] == pytest.approx(min(0.5 * w["mid_mid_sustained"] + 0.26 * r["center_focus_broadband"] + 0.24 * (1 - w["transient_broadband"]), 1))


def test_envelopes_of_middle_and_side(spark):
    """Antiphase channels have no middle, equal ones no side, silence neither."""
    rows = [(0, [1.0, 2.0, 3.0, 1.0], [1.0, 2.0, 3.0, 1.0]), (1, [1.0, 2.0, 3.0, 1.0], [-1.0, -2.0, -3.0, -1.0]), (2, [0.0] * 4, [0.0] * 4)]
    df = spark.createDataFrame(rows, "track int, l array<double>, r array<double>")
    got = auditory.mid_side_matrix(df, F.col("l"), F.col("r"), 4, 22050.0, channels=3).groupBy("track").agg(F.max("mid").alias("m"), F.max("side").alias("s")).orderBy("track").collect()
    assert got[0]["m"] == pytest.approx(got[1]["s"]) and got[0]["m"] > 0 and got[0]["s"] == got[1]["m"] == got[2]["m"] == got[2]["s"] == 0


def robust(x, low, high):
    a, b = np.percentile(x, low), np.percentile(x, high)
    if b <= a + 1e-12:
        a, b = x.min(), x.max()
    return np.clip((x - a) / (b - a), 0, 1) if b > a + 1e-12 else x * 0


@pytest.mark.parametrize("stretch", [4096, 10])
def test_display_against_numpy(spark, monkeypatch, stretch):
    monkeypatch.setattr(auditory, "STRETCH", stretch)
    data = tracks()
    shown = auditory.display(matrix(spark, data), "side")
    got = {(r["track"], r["frame_idx"], r["channel"]): r["shown"] for r in shown.collect()}
    bins = {(r["track"], r["channel"], r["bin"]): (r["t"], r["level"]) for r in auditory.display_bins(shown, 4, 0.25).collect()}
    for k, (times, _, side) in data.items():
        db = 10 * np.log10(np.maximum(side, 1e-12))
        ref = np.clip(0.68 * np.vstack([robust(x, 12, 96) for x in db]) + 0.32 * robust(db, 8, 98), 0, 1)
        assert [got[k, i, c] for i in range(len(times)) for c in range(7)] == pytest.approx(ref.T.ravel().tolist(), abs=1e-9)
        for c in range(7):
            padded = np.r_[0, 0, ref[c], 0]
            smooth = np.array([padded[i : i + 4].mean() for i in range(len(times))])
            place = np.floor(np.round((times - times[0]) / 0.25, 9)).astype(int)
            for b in np.unique(place):
                assert bins[k, c, b] == pytest.approx((times[0] + (b + 0.5) * 0.25, smooth[place == b].mean()), abs=1e-9)


def test_quantiles_of_large_and_small_groups(spark):
    """Exact beyond what a sketch holds, over several partitions, with ties, nulls and one value only."""
    rng = np.random.default_rng(2)
    groups = {"large": rng.normal(size=60_000), "tied": np.repeat(rng.normal(size=5), 9_000), "small": rng.normal(size=7), "one": np.array([3.0]), "same": np.full(50, 2.5)}
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [("small", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    wanted = {"q08": 0.08, "q50": 0.5, "q98": 0.98}
    for r in quantiles.quantiles(df, ["g"], "x", wanted).collect():
        assert [r[n] for n in wanted] == pytest.approx(np.quantile(groups[r["g"]], list(wanted.values())).tolist(), abs=1e-12)


def brute_merge(groups, most):
    """[(start, end, signature, states)] merged step by step, all ranges looked through each time."""
    groups = [list(g) for g in groups]
    while len(groups) > most and len(groups) > 1:
        size = [g[1] - g[0] for g in groups]
        i = size.index(min(size))
        t = 1 if i == 0 else i - 1 if i == len(groups) - 1 or size[i - 1] <= size[i + 1] else i + 1
        a, b = sorted((i, t))
        groups[a : b + 1] = [[min(groups[a][0], groups[b][0]), max(groups[a][1], groups[b][1]), groups[t][2], groups[a][3] + groups[b][3]]]
    return groups


@pytest.mark.parametrize("seed", range(4))
def test_readable_ranges_by_brute_force(spark, seed):
    """Ties in length, gaps and overlaps in time, tracks with few ranges."""
    rng = random.Random(seed)
    rows, told = [], {}
    for track, n in enumerate((1, 3, 12, 13, 80)):
        at, states = 0, []
        for i in range(n):
            end = at + rng.choice([1, 1, 2, 5])
            states.append((track, i, at, end, rng.choice("abc")))
            at = end + rng.choice([0, 0, 0, -1, 2]) if end > at + 1 else end
        rows += states
        runs = []
        for _, i, a, b, x in states:
            if runs and runs[-1][2] == x:
                runs[-1][1] = b
                runs[-1][3].append(i)
            else:
                runs.append([a, b, x, [i]])
        told[track] = [(a, b, x, i[len(i) // 2], len(i)) for a, b, x, i in brute_merge(runs, 6)]
    df = spark.createDataFrame(rows, "track int, segment int, start_s long, end_s long, signature string").repartition(3)
    got = {}
    for r in ranges.readable_ranges(ranges.signature_runs(df), most=6).orderBy("track", "part").collect():
        got.setdefault(r["track"], []).append((r["start"], r["end"], r["signature"], r["middle"], r["n"]))
    assert got == told


def test_long_tracks_of_ranges():
    rng = random.Random(1)
    ends = np.cumsum([rng.randrange(1, 50) for _ in range(200_000)]).tolist()
    parts = ranges.merge_shortest([0, *ends[:-1]], ends, 12)
    assert len(parts) == 12 and parts[0][0] == 0 and parts[-1][1] == 199_999 and all(b + 1 == c for (_, b, _), (c, _, _) in zip(parts, parts[1:], strict=False))


def test_rolling_lanes_and_events_by_hand(spark):
    """One lane rises, falls and comes back; all others rest at .3."""
    levels = [0.3, 0.9, 0.9, 0.3, 0.9]
    rows = [(0, i, float(i), float(i + 3), *[v if n == "harmonic_ridge_lane" else 0.3 for n in E.LANES]) for i, v in enumerate(levels)]
    df = spark.createDataFrame(rows, "track int, segment int, start_s double, end_s double, " + ", ".join(f"{n} double" for n in E.LANES))
    lanes = V.rolling(df)
    got = {r["segment"]: r for r in lanes.where("lane = 'harmonic_ridge_lane'").collect()}
    mean, sd = np.mean(levels), np.std(levels)
    before = [0, *levels[:-1]]
    for i, v in enumerate(levels):
        entry = max(0, v - before[i])
        assert [got[i][c] for c in ("relative", "entry", "leave")] == pytest.approx([np.clip(0.5 + (v - mean) / sd / 3, 0, 1), entry, max(0, before[i] - v)])
        assert got[i]["score"] == pytest.approx(0.4 * v + 0.42 * got[i]["relative"] + 0.18 * min(1, 2 * entry)) and got[i]["active"] == (got[i]["score"] >= 0.62)
    events = {(r["segment"], r["kind"]): r for r in V.events(lanes).where("lane = 'harmonic_ridge_lane' OR lane = 'multi_lane_contrast'").collect()}
    assert events[1, "lane_entry_or_growth"]["strength"] == pytest.approx(max(got[1]["score"], 0.6)) and events[3, "lane_exit_or_reduction"]["strength"] == pytest.approx(0.6)
    assert (4, "lane_entry_or_growth") in events and (4, "recurrence_of_prior_signature") in events and (2, "recurrence_of_prior_signature") not in events
    names = [r["event_id"] for r in V.events(lanes).orderBy("segment", "event_id").collect()]
    assert len(set(names)) == len(names) and all(x.rsplit("_", 1)[1].isdecimal() and len(x.rsplit("_", 1)[1]) == 3 for x in names)


def test_last_resort_events(spark):
    """A lane that is active without a clear entry or exit, in a track without any other event, is told by its first active range."""
    rows = [(k, i, float(i), float(i + 3), *[(0.33 if i == 0 else 0.2) * (k + 1) if n == "low_body_lane" else 0.0 for n in E.LANES]) for k in (0, 1) for i in range(7)]
    df = spark.createDataFrame(rows, "track int, segment int, start_s double, end_s double, " + ", ".join(f"{n} double" for n in E.LANES))
    lanes = V.rolling(df)
    got = [tuple(r) for r in V.events(lanes).where("track = 0").select("segment", "start_s", "end_s", "kind", "lane", "event_id").collect()]
    assert got == [(0, 0.0, 3.0, "lane_presence_without_clear_delta", "low_body_lane", "lane_presence_without_clear_delta_001")]
    assert {r["kind"] for r in V.events(lanes).where("track = 1").collect()} >= {"lane_entry_or_growth", "lane_exit_or_reduction"}


@pytest.mark.parametrize("stretch", [4096, 13])
def test_fields_and_regions_against_numpy(spark, monkeypatch, stretch):
    monkeypatch.setattr(auditory, "STRETCH", stretch)
    data = {k: v for k, v in tracks(60).items() if k in (0, 2, 3)}
    field = auditory.fields(auditory.curves(auditory.levels(matrix(spark, data)))).cache()
    ratios = {(r["track"], r["band"]): (r["mean_ratio"], r["max_ratio"], r["mean_total"]) for r in auditory.band_ratios(field).collect()}
    got = {}
    for r in auditory.regions(auditory.activities(field), 4).orderBy("rank").collect():
        got.setdefault((r["track"], r["list"]), []).append((r["kind"], r["start_s"], r["end_s"], r["mean"], r["highest"]))
    told = {}
    for k, (times, mid, side) in data.items():
        mid, side = level(mid), level(side)
        band = lambda m, b: m[(CENTRES >= auditory.BROAD[b][0]) & (CENTRES < auditory.BROAD[b][1])].mean(axis=0)
        wide, centred = [], []
        for b in auditory.BROAD:
            m, s = band(mid, b), band(side, b)
            ratio, whole = s / (m + s + 1e-12), np.clip(m + s, 0, 1)
            assert ratios[k, b] == pytest.approx((ratio.mean(), ratio.max(), whole.mean()))
            wide.append(np.clip((ratio - 0.45) / 0.55, 0, 1) * whole)
            centred.append(np.clip((0.55 - ratio) / 0.55, 0, 1) * m)

        def around(x, w):
            padded = np.r_[np.zeros(w // 2), x, np.zeros((w - 1) // 2)]
            return np.array([padded[i : i + w].mean() for i in range(len(x))])

        def runs(name, x, least):
            on = np.round(x, 9) >= least
            edges = np.flatnonzero(np.diff(np.r_[0, on, 0]))
            return [(name, times[a], times[b - 1], x[a:b].mean(), x[a:b].max()) for a, b in zip(edges[::2], edges[1::2], strict=True)]

        for n, m in (("mid", mid), ("side", side)):
            told[k, f"sustained_{n}"] = [r for b in ("low", "mid", "high") for r in runs(f"{b}_sustained_{n}", around(band(m, b), 9), 0.42)]
            rise = {b: np.maximum(np.diff(band(m, b), prepend=band(m, b)[:1]), 0) for b in ("low", "mid", "high")}
            told[k, f"transient_{n}"] = [r for b, x in rise.items() for r in runs(f"{b}_transient_{n}", x / x.max() if x.max() > 1e-12 else x, 0.55)]
        told[k, "wide"] = runs("side_heavy_wide_band_region", around(np.mean(wide, axis=0), 7), 0.34)
        told[k, "centred"] = runs("mid_focused_center_region", around(np.mean(centred, axis=0), 7), 0.34)
    assert set(got) == {key for key, x in told.items() if x}
    for key, rows in got.items():
        assert [r[0] for r in rows] == [r[0] for r in told[key][:4]]
        assert [x for r in rows for x in r[1:]] == pytest.approx([x for r in told[key][:4] for x in r[1:]])
