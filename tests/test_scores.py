"""Scores against numbers worked out by hand from the domain's formulas, not from the queries' SQL."""

from __future__ import annotations

import pytest

from tonewright.operators import evidence, scorers

SEGMENT = {
    "rms": 0.15, "peak_max": 0.5, "onset": 0.4, "side_ratio": 0.2, "phase": 0.5, "centroid": 2000.0, "balance": 0.2, "flatness": 0.3, "bandwidth": 2600.0, "lr_motion": 0.1, "dynamic": 0.05,
    "percussive": 0.6, "density": 0.25, "low": 0.3, "mid": 0.5, "high": 0.2, "harmonic": 0.7, "zcr": 0.1, "centroid_delta": 120.0, "low_delta": -0.1, "start_s": 0.0, "end_s": 10.0, "duration": 300.0,
}


@pytest.fixture(scope="module")
def row(spark):
    df = spark.createDataFrame([tuple(SEGMENT.values())], list(SEGMENT))
    stages = [*scorers.SEGMENT_STAGES, evidence.METRICS, {**evidence.LANES, **evidence.REGIONS}, evidence.FAMILY_TERMS, evidence.family_scores(), *evidence.PROXY_STAGES, evidence.DIMENSION_SCORES]
    return scorers.applied(df, stages).first().asDict()


def test_space(row):
    pressure = 0.55 * 0.5 + 0.25 * 0.5 / 0.95 + 0.2 * 0.4
    width = 0.7 * 0.4 + 0.3 * 0.25
    near = 0.85 * pressure - 0.45 * width - 0.15 * 0.3
    spread = 0.75 * width + 0.25 * 0.4
    assert [row[c] for c in ("pressure", "width", "height", "distance", "spread", "motion", "envelopment")] == pytest.approx([pressure, width, 200 / 2600, near, spread, 0.175 + 0.06, 0.65 * width + 0.35 * spread])


def test_objects(row):
    p, w = row["pressure"], row["width"]
    assert row["rhythm"] == pytest.approx(0.128 + 0.144 + 0.045 + 0.18 * p + 0.024)
    assert row["low_foundation"] == pytest.approx(0.174 + 0.22 * p + 0.2 * (1 - 2000 / 3500))
    assert row["harmonic_bed"] == pytest.approx(0.294 + 0.11 + 0.18 * w + 0.135)
    assert row["vocal_line"] == pytest.approx(0.21 + 0.125 + 0.15 * p + 0.105 + 0.1125)
    assert row["texture"] == pytest.approx(0.126 + 0.05 + 0.18 * w + 0.015)


def test_rules(row):
    assert row["relations"] == "grounds_or_thickens" if row["low_foundation"] > 0.4 else "no_strong_relation_detected"
    assert row["role"] == "intro_like" and row["tags"].startswith("harmonic-layered") and row["melody"] == "rising_contour"
    assert row["bass"] == "bass_drops_or_thickens" and row["note_density"] == "dense" and row["phrase"] == "dense_pulsed_phrase" and row["harmony"] == "brighter_release_or_upper_residue"
    assert row["directionality"] == "right-leaning" and row["emission_shape"] == "soft pulse layer"
    assert row["masking_risk"] == pytest.approx(0.21 + 0.175 + 0.15)


def test_lanes_and_families(row):
    assert row["m_centroid"] == pytest.approx(1500 / 5500) and row["m_decorrelation"] == pytest.approx(0.5) and row["m_contour"] == pytest.approx(0.9)
    assert row["low_body_lane"] == pytest.approx(0.46 * 0.3 + 0.25 * row["pressure"] + 0.17 * 0.7 + 0.12 * 0.8)
    assert row["transient_plane_region"] == pytest.approx(0.42 * 0.6 + 0.34 * 0.25 + 0.14 * row["motion"] + 0.1 * row["pressure"])
    rhythm = row["rhythm"] if row["rhythm"] > 0.38 else 0.0
    assert row["rhythmic_pulse_layer"] == pytest.approx(0.52 * row["rhythm"] + 0.18 * 0.25 + 0.22 * 0.6 + 0.04 + 0.04 * rhythm)
    vocal = row["vocal_line"] if row["vocal_line"] > 0.48 else 0.0
    assert row["voice_like_foreground_line"] == pytest.approx(0.52 * row["vocal_line"] + 0.14 * 0.5 + 0.18 * 0.7 + 0.08 + 0.08 * vocal)
    best = max(row[c] for c in scorers.OBJECTS)
    assert row["guitar_like_plucked_melodic_layer"] == pytest.approx(0.28 * 0.7 + 0.16 * 0.6 + 0.12 * 0.5 + 0.16 + 0.1 * best)


def test_larger_of_spread_and_width(row):
    """Lanes and regions take the larger of the two, whichever that is."""
    wide = max(row["spread"], row["width"])
    apart, around = row["m_decorrelation"], row["envelopment"]
    assert row["m_spread"] == pytest.approx(wide)
    assert row["spatial_spread_lane"] == row["spatial_spread_region"] == pytest.approx(0.3 * 0.2 + 0.28 * wide + 0.24 * apart + 0.18 * around)
    assert row["diffuse_tail_lane"] == pytest.approx(0.34 * wide + 0.25 * around + 0.22 * apart + 0.11 * 0.4 + 0.08 * 0.2)
    assert row["diffuse_tail_region"] == pytest.approx(0.34 * wide + 0.24 * around + 0.22 * apart + 0.12 * 0.4 + 0.08 * 0.2)
    assert row["noise_texture_lane"] == pytest.approx(0.35 * 0.2 + 0.22 * row["m_centroid"] + 0.2 * 0.3 + 0.13 * wide + 0.1 * apart)
    assert row["foreground_contour_region"] == pytest.approx(0.3 * 0.5 + 0.24 * 0.7 + 0.22 * 0.9 + 0.16 * row["pressure"] + 0.08 * (1 - wide))


@pytest.mark.parametrize(("spread", "width", "larger"), [(0.2, 0.7, 0.7), (0.6, 0.1, 0.6)])
def test_metrics_of_wide_and_spread_segments(spark, spread, width, larger):
    df = spark.createDataFrame([(1000.0, 0.1, 0.2, spread, width, "dense")], "centroid double, rms double, phase double, spread double, width double, note_density string")
    assert scorers.applied(df, [evidence.METRICS]).first()["m_spread"] == larger


CANDIDATE = {"active_mean": 0.9, "mean_support": 0.9, "max_support": 0.95, "coverage": 0.9, "longest": 6, "active": 6, "variation": 0.05, "hinted": True, "low_mean": 0.2, "mid_mean": 0.5, "high_mean": 0.3, "harmonic_mean": 0.7, "percussive_mean": 0.2, "width_mean": 0.3, "spread_mean": 0.5}


@pytest.mark.parametrize(
    ("group", "prior", "pitch", "packets", "external", "claim"),
    [
        (evidence.INSTRUMENT, True, False, 0, "reduced", "medium"),
        (evidence.EFFECT, True, False, 0, "restrained", "medium"),
        (evidence.FUNCTIONAL, True, False, 0, "reduced", "strong"),
        (evidence.INSTRUMENT, False, False, 0, "reduced", "strong"),
        (evidence.INSTRUMENT, True, True, 0, "reduced", "strong"),
        (evidence.INSTRUMENT, True, False, 1, "reduced", "strong"),
        (evidence.INSTRUMENT, True, False, 0, "moderate", "strong"),
    ],
)
def test_claims_are_capped_only_beside_priors_without_pitch_and_packets(spark, group, prior, pitch, packets, external, claim):
    told = CANDIDATE | {"family_group": group, "prior_available": prior, "pitch_matched": pitch, "packets": packets, "external_support": external}
    row = scorers.applied(spark.createDataFrame([tuple(told.values())], list(told)), evidence.CLAIMS).first()
    assert row["claim_score"] == pytest.approx(0.55 * 0.9 + 0.2 * 0.9 + 0.15 + 0.05 + 0.05)
    assert (row["raw_claim"], row["claim"], row["calibration"]) == ("strong", claim, "capped_without_pitch_or_external_evidence" if claim == "medium" else "not_capped")
    assert row["openness"] == 0.5


@pytest.mark.parametrize(
    ("openness", "lean", "pressure", "motion", "spatial"),
    [
        (0.6, 0.5, 0.7, 0.2, "wide_diffuse"),
        (0.1, -0.3, 0.7, 0.2, "side_opening"),
        (0.1, 0.1, 0.6, 0.2, "pressure_forward_center"),
        (0.1, 0.1, 0.1, 0.2, "motion_restrained"),
        (0.1, 0.1, 0.3, 0.9, "motion_restrained"),
        (0.3, 0.1, 0.1, 0.9, "motion_restrained"),
        (0.5, 0.1, 0.4, 0.1, "center_bound"),
    ],
)
def test_spatial_behaviour(spark, openness, lean, pressure, motion, spatial):
    df = spark.createDataFrame([(openness, lean, pressure, motion)], "openness double, left_right_mean double, pressure_mean double, motion_mean double")
    assert df.selectExpr(f"{evidence.BEHAVIOUR['spatial']} AS s").first()["s"] == spatial


def test_profile_lanes_are_their_scores(spark):
    """In a profile a lane's score is the plain score of its segment, and active from its own threshold on."""
    from tonewright.plans import evidence as plans

    names = ["low", "pressure", "harmonic", "high", "percussive", "density", "motion", "mid", "m_contour", "m_spread", "envelopment", "m_decorrelation", "m_centroid", "side_ratio", "m_rms"]
    df = spark.createDataFrame([(0, 0, 0.0, 1.0, *[0.9] * len(names)), (0, 1, 1.0, 2.0, *[0.5] * len(names))], "track int, segment int, start_s double, end_s double, " + ", ".join(f"{n} double" for n in names))
    got = {(r["segment"], r["lane"]): r for r in plans.lanes(df).collect()}
    assert got[0, "low_body_lane"]["score"] == pytest.approx(0.9 * 0.88 + 0.12 * 0.1) and got[0, "low_body_lane"]["active"]
    assert got[1, "low_body_lane"]["score"] == pytest.approx(0.5) and got[1, "low_body_lane"]["unsure"] and not got[1, "low_body_lane"]["active"]
    assert got[1, "pressure_peak_lane"]["unsure"] and not got[1, "pressure_peak_lane"]["active"]


def test_descriptors(row):
    height = (200 / 2600 + 1) / 2
    assert row["p_phase"] == pytest.approx(0.75) and row["p_height"] == pytest.approx(height) and row["p_stable"] == pytest.approx(0.8)
    assert row["d_bright"] == pytest.approx((height + max(height, 0.2) + 0.2) / 3) and row["d_focused"] == pytest.approx((row["p_mid_side"] + 0.75 + row["p_cue"]) / 3)
    assert row["p_mid_side"] == pytest.approx((0.8 + 0.8 + 0.75) / 3)


def test_source_objects_with_all_that_may_speak(spark):
    """Scores, caps and confusion of objects, by candidates, priors, behaviour, performance and recognised families."""
    from tonewright.plans import evidence as plans

    tracks = spark.createDataFrame([(0,), (1,)], "track int")
    kept = spark.createDataFrame([(0, "string_like_sustained_harmonic_layer", 0.60), (0, "harmonic_bed_layer", 0.9), (0, "bass_like_low_body_layer", 0.5), (1, "voice_like_foreground_line", 0.55)], "track int, family string, candidate_score double")
    plain = {(r["track"], r["object"]): r for r in plans.source_objects(tracks, kept).collect()}
    assert len(plain) == 18 and plain[0, "strings_bowed_object"]["raw_score"] == pytest.approx(0.72 * 0.9) and plain[0, "strings_bowed_object"]["visibility"] == "possible"
    assert plain[1, "drum_percussion_object"]["visibility"] == "not_supported" and plain[1, "voice_object"]["visibility"] == "possible"
    priors = spark.createDataFrame([(0, 0, "bowed_strings", 0.4), (0, 1, "bowed_strings", 0.66), (0, 1, "voice", 0.3), (1, 0, "percussion", 0.6)], "track int, segment int, family string, score double")
    behaviour = spark.createDataFrame([(0, "low_body_layer", "strong"), (1, "rhythmic_pulse_layer", "medium")], "track int, family string, claim string")
    performance = spark.createDataFrame([(1, "rhythmic_pulse_layer", "strong")], "track int, family string, claim string")
    verified = spark.createDataFrame([(1, "voice_like_foreground_line"), (0, "harmonic_bed_layer")], "track int, family string")
    unpitched = tracks.where("track = 0")
    full = {(r["track"], r["object"]): r for r in plans.source_objects(tracks, kept, priors, behaviour, performance, verified, unpitched).collect()}
    strings = full[0, "strings_bowed_object"]
    assert (strings["raw_visibility"], strings["visibility"], strings["confidence"], strings["capped"]) == ("likely_local", "possible", 0.54, True)
    assert full[0, "voice_object"]["prior_score"] == 0 and not full[0, "voice_object"]["has_prior"]
    assert full[0, "bass_low_register_object"]["raw_score"] == pytest.approx(0.68 * 0.82)
    assert full[1, "drum_percussion_object"]["raw_score"] == pytest.approx(max(0.84 * 0.6, 0.68 * 0.58, 0.62 * 0.82))
    assert full[1, "voice_object"]["verified"] and full[1, "voice_object"]["visibility"] == "externally_supported"
    assert [k for k, r in full.items() if r["verified"]] == [(1, "voice_object")]  # a family that only supports verifies nothing
    assert full[0, "keyboard_piano_object"]["confusion"] is None and full[0, "brass_wind_object"]["confusion"] == "strings_bowed_object"
