"""Templates scored over windows, against the rules written out in plain Python; notes, matches and boosts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tonewright.operators import auditory, priors
from tonewright.operators import evidence as E

LANES = list(E.LANES)
METRICS = [*auditory.MEANS, *auditory.HIGHEST]


def unit(x):
    return max(0.0, min(1.0, x))


def python_classes(v):
    """The score of every class, by the rules as they are said in words."""
    h, n, t, s, tail, p = v["harmonic"], v["noise"], v["transient"], v["sustained"], v["tail"], v["pressure"]
    high, near = v["high"], lambda x, y: unit(1 - abs(x - y))
    free = lambda *x: unit(0.5 + 0.25 * max(x))
    band = lambda a: {"variable": 0.72} | {c: unit(1 - abs(a - y) / 0.88) for c, y in (("weak", 0.08), ("limited", 0.25), ("moderate", 0.5), ("strong", 0.72), ("dominant", 0.88))}
    tonal = unit(0.82 * h + 0.18 * (1 - n))
    electric = unit(0.45 * n + 0.35 * high + 0.2 * t)
    return {
        "harmonic": {"mostly_harmonic": tonal, "quasi_harmonic": tonal, "inharmonic": unit(0.6 * n + 0.3 * t + 0.1 * (1 - h)), "noise_dominant": unit(0.78 * n + 0.22 * t), "mixed": unit(0.42 * h + 0.38 * n + 0.2 * t)},
        "low_band": band(v["low"]), "mid_band": band(v["mid"]), "high_band": band(high),
        "attack": {"impulsive": unit(0.7 * t + 0.3 * p), "fast": unit(0.82 * t + 0.18 * (1 - s)), "medium": near(t, 0.5), "slow": unit(0.72 * s + 0.28 * (1 - t)), "variable": free(t, s, p)},
        "decay": {"short": unit(0.62 * t + 0.38 * (1 - tail)), "medium": near((s + tail) / 2, 0.5), "long": unit(0.7 * tail + 0.3 * s), "sustained": s, "variable": free(t, s, tail)},
        "sustain": {"none": unit(0.68 * t + 0.32 * (1 - s)), "limited": near(s, 0.3), "moderate": near(s, 0.55), "high": unit(0.78 * s + 0.22 * tail), "continuous": unit(0.78 * s + 0.22 * tail), "variable": free(s, tail, t)},
        "rearticulation": {"single_hit": unit(0.72 * max(t, p) + 0.28 * (1 - s)), "repeated_attack": t, "legato": unit(0.78 * s + 0.22 * (1 - t)), "continuous": s, "variable": free(t, s, p)},
        "noise": {"none": unit(1 - n), "breath": unit(0.48 * n + 0.32 * high + 0.2 * h), "bow_noise": unit(0.4 * h + 0.35 * n + 0.25 * high), "pick_noise": unit(0.45 * t + 0.35 * h + 0.2 * high), "strike_noise": unit(0.72 * t + 0.28 * high),
                  "metallic_noise": electric, "broadband_noise": electric, "electronic_noise": electric, "variable": free(n, t, high, h)},
        "inharmonicity": {"low": unit(0.7 * h + 0.3 * (1 - n)), "moderate": near((n + t + high) / 3, 0.5), "high": unit(0.42 * n + 0.32 * high + 0.26 * t), "variable": free(n, t, high, h)},
    }


def python_evidence(w):
    lane = {n: unit(w[n]) for n in LANES}
    v = {
        "low": max(w["low_mid_sustained"], w["low_side_sustained"], 0.85 * lane["low_body_lane"]),
        "mid": max(w["mid_mid_sustained"], w["mid_side_sustained"], 0.85 * lane["foreground_contour_lane"]),
        "high": max(w["high_mid_sustained"], w["high_side_sustained"], w["mid_high_mid_sustained"], 0.85 * lane["noise_texture_lane"]),
        "harmonic": unit(max(lane["harmonic_ridge_lane"], 0.82 * lane["foreground_contour_lane"], w["mid_mid_sustained"], w["mid_high_mid_sustained"])),
        "transient": unit(max(lane["transient_plane_lane"], *[w[f"transient_{b}"] for b in ("broadband", "low", "mid", "high")])),
        "noise": unit(max(lane["noise_texture_lane"], w["high_mid_sustained"], w["high_side_sustained"], 0.85 * w["transient_high"])),
        "tail": lane["diffuse_tail_lane"],
        "pressure": lane["pressure_peak_lane"],
    }
    return v | {"sustained": unit(max(v["harmonic"], v["tail"], w["broadband_mid_energy"], w["mid_side_sustained"]))}


def python_score(w, t, pitches):
    classes = python_classes(python_evidence(w))
    of = lambda kind: classes[kind].get(t[kind], classes[kind][{"harmonic": "mixed"}.get(kind, "moderate" if kind.endswith("band") else "variable")])
    likely, helping, against = (t[k] or [] for k in ("likely", "supporting", "contradicting"))
    most, clash = max((w[n] for n in likely), default=0), max((w[n] for n in against), default=0)
    top = w["dominant"].split(",") if w["dominant"] else []
    lanes = unit(0.72 * most + 0.26 * (sum(w[n] for n in helping) / len(helping) if helping else 0) + 0.08 * len(set(likely) & set(top)) - 0.34 * clash)
    lanes = min(lanes, 0.2) if clash >= 0.62 and most < 0.25 else lanes
    status, pitch = "unresolved", 0.0
    if pitches and t["pitch_low"] is not None and t["pitch_high"] is not None:
        inside = sum(t["pitch_low"] <= p <= t["pitch_high"] for p in pitches) / len(pitches)
        core = sum(t["core_low"] <= p <= t["core_high"] for p in pitches) / len(pitches) if t["core_low"] is not None else 0
        pitch = unit(0.62 * inside + 0.38 * core)
        status = "matched" if inside >= 0.75 and core >= 0.25 else "partial" if inside > 0 else "contradicted"
    parts = [pitch, of("harmonic"), unit(0.34 * of("low_band") + 0.34 * of("mid_band") + 0.32 * of("high_band")), unit(0.32 * of("attack") + 0.24 * of("decay") + 0.24 * of("sustain") + 0.2 * of("rearticulation")), unit(0.58 * of("noise") + 0.42 * of("inharmonicity")), lanes]
    return min(unit(sum(a * b for a, b in zip(t["weights"], parts, strict=True))), 0.55 if status == "unresolved" else 0.68), status, parts


def cases(seed, n=12, m=20):
    rng = random.Random(seed)
    windows = [{c: rng.random() for c in [*METRICS, *LANES]} | {"dominant": rng.choice([None, "low_body_lane", "harmonic_ridge_lane,diffuse_tail_lane"])} for _ in range(n)]
    pitches = [rng.choice([None, [], [60.0], [59.0, 61.5, 64.0, 90.0]]) for _ in windows]
    some = lambda: rng.choice([None, [], rng.sample(LANES, 1), rng.sample(LANES, 3)])
    templates = []
    for i in range(m):
        t = {"instrument_id": f"i{i:02}", "family": rng.choice(priors.PRIOR_FAMILIES)} | {k: rng.choice([*names, "no such class"]) for k, names in priors.CLASSES.items()} | {k: some() for k in ("likely", "supporting", "contradicting")}
        low = rng.choice([None, 55.0, 60.0])
        t |= {"pitch_low": low, "pitch_high": low and low + 10, "core_low": low and low + 1, "core_high": low and low + 5, "weights": [rng.random() / 3 for _ in range(6)]}
        templates.append(t)
    return windows, pitches, templates


@pytest.mark.parametrize("seed", range(3))
def test_scores_against_the_rules(spark, seed):
    windows, pitches, templates = cases(seed)
    columns = [*METRICS, *LANES, "dominant"]
    rows = [(0, i, float(i), float(i + 1), p, *[w[c] for c in columns]) for i, (w, p) in enumerate(zip(windows, pitches, strict=True))]
    df = spark.createDataFrame(rows, "track int, segment int, start_s double, end_s double, pitches array<double>, " + ", ".join(f"{c} {'string' if c == 'dominant' else 'double'}" for c in columns))
    relation = spark.createDataFrame([tuple(t.values()) for t in templates], priors.TEMPLATE)
    found = priors.hypotheses(df, relation, most=5).cache()
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        scored = sorted(((*python_score(windows[r["segment"]], t, pitches[r["segment"]]), t) for t in templates), key=lambda x: (-round(x[0], 9), x[3]["instrument_id"]))
        expected = [x for x in scored if x[0] >= 0.25][:5]
        assert [h["instrument_id"] for h in r["ranked"]] == [x[3]["instrument_id"] for x in expected]
        for h, (score, status, parts, _) in zip(r["ranked"], expected, strict=True):
            assert h["score"] == pytest.approx(score) and h["pitch_status"] == status and list(h["parts"]) == pytest.approx(parts)
    broad = {}
    for r in priors.broad_families(found).collect():
        broad.setdefault(r["segment"], {})[r["family"]] = r["score"]
    for r in found.collect():
        held = {}
        for h in r["ranked"]:
            held.setdefault(h["family"], []).append(h["score"])
        told = {f: min(0.68, max(max(x) + 0.06, sum(sorted(x, reverse=True)[:3]) / len(x[:3]) + 0.08)) for f, x in held.items()}
        best = sorted(told, key=lambda f: (-round(told[f], 9), f))[:6]
        assert broad.get(r["segment"], {}) == pytest.approx({f: told[f] for f in best})


def test_empty_templates_and_windows(spark):
    windows, _, templates = cases(1, 2, 2)
    columns = [*METRICS, *LANES, "dominant"]
    schema = "track int, segment int, start_s double, end_s double, pitches array<double>, " + ", ".join(f"{c} {'string' if c == 'dominant' else 'double'}" for c in columns)
    df = spark.createDataFrame([(0, 0, 0.0, 1.0, None, *[windows[0][c] for c in columns])], schema)
    none = spark.createDataFrame([], priors.TEMPLATE)
    assert [len(r["ranked"]) for r in priors.hypotheses(df, none).collect()] == [0]
    assert priors.hypotheses(df.limit(0), spark.createDataFrame([tuple(t.values()) for t in templates], priors.TEMPLATE)).count() == 0


def test_notes_meet_windows_once(spark):
    """Notes over several seconds count once; ends that touch do not overlap; tracks without notes are told apart from windows without."""
    windows = spark.createDataFrame([(0, 0, 0.0, 3.0), (0, 1, 3.0, 6.0), (0, 2, 7.5, 7.75), (1, 0, 0.0, 3.0)], "track int, segment int, start_s double, end_s double")
    notes = spark.createDataFrame([(0, 0.5, 5.5, 60.0), (0, 2.0, 3.0, 61.0), (0, 2.0, 3.0, 61.0), (0, 6.0, 6.5, 62.0), (0, 1.0, 2.0, None)], "track int, start double, end double, pitch double")
    got = {(r["track"], r["segment"]): r["pitches"] for r in priors.local_pitches(windows, notes).collect()}
    assert got == {(0, 0): [60.0, 61.0, 61.0], (0, 1): [60.0], (0, 2): [], (1, 0): None}


def test_matches_and_boost(spark):
    lanes = {n: 0.0 for n in LANES} | {"foreground_contour_lane": 0.9, "diffuse_tail_lane": 0.8}
    windows = spark.createDataFrame([(0, 0, 0.0, 3.0, "foreground_contour_lane", *lanes.values()), (0, 1, 5.0, 8.0, None, *lanes.values())], "track int, segment int, start_s double, end_s double, dominant string, " + ", ".join(f"{n} double" for n in LANES))
    broad = spark.createDataFrame([(0, 0, "voice", 0.6), (0, 0, "percussion", 0.3)], "track int, segment int, family string, score double")
    got = {(r["segment"], r["family"]): r["match"] for r in priors.matches(windows, broad).collect()}
    assert got[0, "voice_like_foreground_line"] == pytest.approx(0.66 * 0.6 + 0.34 * (0.48 * 0.5 + 0.52 * 0.9))
    assert (1, "voice_like_foreground_line") not in got and (0, "brass_wind_like_sustained_lead_layer") not in got
    found = spark.createDataFrame([(0, "a", 0, 0.0, 3.0, 0.5), (0, "a", 1, 2.0, 5.0, 0.7), (0, "b", 1, 2.0, 5.0, 0.9)], "track int, family string, segment int, start_s double, end_s double, match double")
    support = spark.createDataFrame([(0, 0, 0.0, 2.0, "a", 0.4), (0, 1, 2.0, 5.0, "a", 0.95), (0, 2, 5.0, 6.0, "a", 0.1), (0, 0, 0.0, 2.0, "c", 0.2)], "track int, segment int, start_s double, end_s double, family string, support double")
    got = {(r["segment"], r["family"]): (r["boost"], r["support"]) for r in priors.boosted(support, found).collect()}
    assert got == {(0, "a"): pytest.approx((0.07, 0.47)), (1, "a"): pytest.approx((0.098, 1.0)), (2, "a"): (0.0, 0.1), (0, "c"): (0.0, 0.2)}
    ranked = priors.best_matches(found.withColumn("family", F.lit("a")), 2).collect()
    assert sorted((r["rank"], r["match"]) for r in ranked) == [(1, 0.9), (2, 0.7)]
