"""Scores of the evidence chain over segment profiles: lanes, regions, families, claims, behaviour, descriptors."""

from __future__ import annotations

from .scorers import OBJECTS, SOURCES, Stage, band, cases, clamp, listed, weighted

# Scales of the metrics that lanes and regions share.
METRICS: Stage = {
    "m_centroid": f"CASE WHEN centroid <= 0 THEN 0.0 ELSE {clamp('(centroid - 500) / 5500')} END",
    "m_rms": f"CASE WHEN rms > 1e-12 THEN {clamp('(20 * log10(rms) + 60) / 60')} ELSE 0.0 END",
    "m_decorrelation": f"CASE WHEN phase < 0 THEN {clamp('1 - (phase + 1) / 2')} ELSE {clamp('1 - phase')} END",
    "m_spread": clamp("greatest(spread, width)"),
    "m_contour": clamp("CAST(0.45 + 0.25 AS double) + CASE WHEN note_density IN ('medium', 'dense', 'high') THEN 0.20 WHEN note_density IN ('sparse', 'low') THEN 0.10 ELSE 0.0 END"),
}
# Weights of lanes and regions, and the scores from which they count as active or ambiguous.
LANES: Stage = {
    "low_body_lane": weighted("0.46 low, 0.25 pressure, 0.17 harmonic, 0.12 -high"),
    "transient_plane_lane": weighted("0.42 percussive, 0.33 density, 0.16 motion, 0.09 pressure"),
    "foreground_contour_lane": weighted("0.30 mid, 0.22 harmonic, 0.22 m_contour, 0.16 pressure, 0.10 -m_spread"),
    "harmonic_ridge_lane": weighted("0.48 harmonic, 0.24 mid, 0.16 -density, 0.12 -percussive"),
    "diffuse_tail_lane": weighted("0.34 m_spread, 0.25 envelopment, 0.22 m_decorrelation, 0.11 -percussive, 0.08 high"),
    "noise_texture_lane": weighted("0.35 high, 0.22 m_centroid, 0.20 -harmonic, 0.13 m_spread, 0.10 m_decorrelation"),
    "spatial_spread_lane": weighted("0.30 side_ratio, 0.28 m_spread, 0.24 m_decorrelation, 0.18 envelopment"),
    "pressure_peak_lane": weighted("0.35 pressure, 0.25 m_rms, 0.18 low, 0.14 density, 0.08 percussive"),
}
#: A profile lane's score beside auditory evidence of its segment; its own score where there is none.
BLENDED: Stage = {"score": f"CASE WHEN auditory IS NULL THEN v ELSE {clamp('0.68 * v + 0.32 * auditory')} END"}
LANE_LEAST = {
    "low_body_lane": (0.58, 0.44),
    "transient_plane_lane": (0.60, 0.46),
    "foreground_contour_lane": (0.62, 0.48),
    "harmonic_ridge_lane": (0.62, 0.48),
    "diffuse_tail_lane": (0.60, 0.46),
    "noise_texture_lane": (0.60, 0.46),
    "spatial_spread_lane": (0.60, 0.46),
    "pressure_peak_lane": (0.64, 0.50),
}
LANE_LABELS = {
    "low_body_lane": "low-frequency grounding/body support",
    "transient_plane_lane": "attacks, pulses, transient plane",
    "foreground_contour_lane": "mid-band foreground line or contour",
    "harmonic_ridge_lane": "sustained harmonic support",
    "diffuse_tail_lane": "decay/reverb-like diffuse field",
    "noise_texture_lane": "high-band texture/air/noise field",
    "spatial_spread_lane": "wide/decorrelated receiver-side spread",
    "pressure_peak_lane": "pressure-forward energy peak",
}
REGIONS: Stage = {
    "low_body_region": weighted("0.48 low, 0.24 pressure, 0.18 harmonic, 0.10 -high"),
    "transient_plane_region": weighted("0.42 percussive, 0.34 density, 0.14 motion, 0.10 pressure"),
    "foreground_contour_region": weighted("0.30 mid, 0.24 harmonic, 0.22 m_contour, 0.16 pressure, 0.08 -m_spread"),
    "harmonic_ridge_region": weighted("0.48 harmonic, 0.24 mid, 0.16 -density, 0.12 -percussive"),
    "diffuse_tail_region": weighted("0.34 m_spread, 0.24 envelopment, 0.22 m_decorrelation, 0.12 -percussive, 0.08 high"),
    "noise_texture_region": weighted("0.34 high, 0.22 m_centroid, 0.22 -harmonic, 0.12 m_spread, 0.10 m_decorrelation"),
    "spatial_spread_region": weighted("0.30 side_ratio, 0.28 m_spread, 0.24 m_decorrelation, 0.18 envelopment"),
    "pressure_peak_region": weighted("0.34 pressure, 0.26 m_rms, 0.18 low, 0.14 density, 0.08 percussive"),
}
REGION_LEAST = {
    "low_body_region": (0.62, 0.48),
    "transient_plane_region": (0.64, 0.50),
    "foreground_contour_region": (0.66, 0.52),
    "harmonic_ridge_region": (0.66, 0.52),
    "diffuse_tail_region": (0.64, 0.50),
    "noise_texture_region": (0.64, 0.50),
    "spatial_spread_region": (0.64, 0.50),
    "pressure_peak_region": (0.68, 0.54),
}
#: Least strength of a contrast event that counts as a major one, by kind.
MAJOR = {"lane_entry_or_growth": 0.60, "lane_exit_or_reduction": 0.30, "mixed_state_change": 0.60, "recurrence_of_prior_signature": 0.70}


def arrangement_state(active: str, ambiguous: str, mixedness: str) -> str:
    return cases(
        (f"{active} >= 4 OR {mixedness} >= 0.86", "contrast_peak_zone"),
        (f"{active} >= 2 OR {mixedness} >= 0.55", "mixed_arrangement_zone"),
        (f"{active} = 1", "single_lane_focus"),
        (f"{ambiguous} > 0", "ambiguous_low_contrast_zone"),
        otherwise="reduced_arrangement_support",
    )


# The candidate families with their group, the object score that they lean on, and the words that a source hypothesis shares with them.
FUNCTIONAL, INSTRUMENT, EFFECT = "functional_object_family", "instrument_like_timbre_family", "effect_like_texture_family"
FAMILIES: dict[str, tuple[str, str | None, str]] = {
    "voice_like_foreground_line": (FUNCTIONAL, "vocal_line", "vocal, voice, lead, foreground"),
    "low_body_layer": (FUNCTIONAL, "low_foundation", "bass, low, sub"),
    "rhythmic_pulse_layer": (FUNCTIONAL, "rhythm", "drum, percussive, pulse, rhythm, kick, snare, hat"),
    "harmonic_bed_layer": (FUNCTIONAL, "harmonic_bed", "harmonic, pad, synth, piano, guitar, string"),
    "diffuse_texture_layer": (FUNCTIONAL, "texture", "noise, texture, reverb, air, haze, fx"),
    "guitar_like_plucked_melodic_layer": (INSTRUMENT, None, "guitar, plucked, strum, picked"),
    "piano_like_percussive_harmonic_layer": (INSTRUMENT, None, "piano, keys, keyboard"),
    "bass_like_low_body_layer": (INSTRUMENT, "low_foundation", "bass, sub, low end, low-end"),
    "drum_like_transient_pulse_layer": (INSTRUMENT, "rhythm", "drum, kick, snare, hat, cymbal, percussion"),
    "synth_pad_like_sustained_harmonic_bed": (INSTRUMENT, "harmonic_bed", "synth, pad, keyboard, ambient"),
    "string_like_sustained_harmonic_layer": (INSTRUMENT, "harmonic_bed", "string, violin, cello, bowed, orchestral"),
    "brass_wind_like_sustained_lead_layer": (INSTRUMENT, None, "brass, horn, sax, trumpet, wind, flute"),
    "electronic_lead_like_melodic_layer": (INSTRUMENT, None, "lead, synth lead, electronic, arp, arpeggio"),
    "reverb_tail_like_diffuse_field": (EFFECT, "texture", "reverb, tail, decay, room, ambient"),
    "noise_riser_like_effect_flow": (EFFECT, "texture", "riser, sweep, noise, whoosh, fx, transition"),
    "impact_fx_like_transient_burst": (EFFECT, "rhythm", "impact, hit, boom, slam, fx, burst"),
    "glitch_grain_like_texture_layer": (EFFECT, "texture", "glitch, grain, granular, click, stutter, texture"),
}
FAMILY_WEIGHTS = {
    "voice_like_foreground_line": "0.52 object, 0.14 mid, 0.18 harmonic, 0.08 melodic, 0.08 hint",
    "low_body_layer": "0.58 object, 0.22 low, 0.12 pressure, 0.08 hint",
    "rhythmic_pulse_layer": "0.52 object, 0.18 density, 0.22 percussive, 0.04 dense, 0.04 hint",
    "harmonic_bed_layer": "0.50 object, 0.20 harmonic, 0.10 mid, 0.10 side_ratio, 0.05 sustained, 0.05 hint",
    "diffuse_texture_layer": "0.45 object, 0.14 high, 0.14 side_ratio, 0.14 apart, 0.08 noisy, 0.05 hint",
    "guitar_like_plucked_melodic_layer": "0.28 harmonic, 0.16 percussive, 0.12 mid, 0.16 melodic, 0.10 strongest, 0.08 hint, 0.10 external",
    "piano_like_percussive_harmonic_layer": "0.24 harmonic, 0.20 percussive, 0.12 density, 0.12 mid, 0.10 melodic, 0.10 hint, 0.12 external",
    "bass_like_low_body_layer": "0.34 object, 0.28 low, 0.14 pressure, 0.08 harmonic, 0.04 melodic, 0.06 hint, 0.06 external",
    "drum_like_transient_pulse_layer": "0.36 object, 0.24 percussive, 0.20 density, 0.06 dense, 0.08 hint, 0.06 external",
    "synth_pad_like_sustained_harmonic_bed": "0.30 object, 0.22 harmonic, 0.16 sustained, 0.12 side_ratio, 0.08 spread, 0.06 hint, 0.06 external",
    "string_like_sustained_harmonic_layer": "0.24 object, 0.26 harmonic, 0.18 sustained, 0.10 mid, 0.08 high, 0.04 melodic, 0.05 hint, 0.05 external",
    "brass_wind_like_sustained_lead_layer": "0.26 harmonic, 0.16 sustained, 0.14 mid, 0.14 melodic, 0.08 pressure, 0.10 hint, 0.12 external",
    "electronic_lead_like_melodic_layer": "0.22 harmonic, 0.16 bright, 0.18 melodic, 0.08 density, 0.08 motion, 0.12 hint, 0.16 external",
    "reverb_tail_like_diffuse_field": "0.28 object, 0.20 side_ratio, 0.16 spread, 0.16 apart, 0.08 sustained, 0.06 hint, 0.06 external",
    "noise_riser_like_effect_flow": "0.18 high, 0.16 side_ratio, 0.16 motion, 0.18 noisy, 0.08 density, 0.12 hint, 0.12 external",
    "impact_fx_like_transient_burst": "0.24 percussive, 0.22 density, 0.18 pressure, 0.08 low, 0.14 hint, 0.14 external",
    "glitch_grain_like_texture_layer": "0.16 percussive, 0.16 density, 0.14 high, 0.18 noisy, 0.14 apart, 0.12 hint, 0.10 external",
}
#: Families that need a higher support to be active.
CAREFUL = ["guitar_like_plucked_melodic_layer", "piano_like_percussive_harmonic_layer", "brass_wind_like_sustained_lead_layer", "electronic_lead_like_melodic_layer"]
FLOW = {
    "foreground_flow": "voice_like_foreground_line, brass_wind_like_sustained_lead_layer, electronic_lead_like_melodic_layer, guitar_like_plucked_melodic_layer, piano_like_percussive_harmonic_layer",
    "low_body_support": "low_body_layer, bass_like_low_body_layer",
    "harmonic_bed_support": "harmonic_bed_layer, synth_pad_like_sustained_harmonic_bed, string_like_sustained_harmonic_layer",
    "pulse_flow": "rhythmic_pulse_layer, drum_like_transient_pulse_layer",
    "transient_burst": "impact_fx_like_transient_burst",
    "diffuse_tail_flow": "reverb_tail_like_diffuse_field, diffuse_texture_layer",
    "texture_motion": "noise_riser_like_effect_flow, glitch_grain_like_texture_layer",
}
ROLE = {
    "foreground_carrier": FLOW["foreground_flow"],
    "grounding_body": FLOW["low_body_support"],
    "harmonic_support": FLOW["harmonic_bed_support"],
    "rhythmic_driver": FLOW["pulse_flow"],
    "transition_marker": "impact_fx_like_transient_burst, noise_riser_like_effect_flow",
    "tail_or_air_support": FLOW["diffuse_tail_flow"],
    "masking_texture": "glitch_grain_like_texture_layer",
}
FLOW_GROUP = {
    "foreground / lead-like behavior": "foreground_flow",
    "low-body / grounding behavior": "low_body_support",
    "harmonic-bed / sustained behavior": "harmonic_bed_support",
    "transient / pulse / impact behavior": "pulse_flow, transient_burst",
    "diffuse / tail / texture behavior": "diffuse_tail_flow, texture_motion",
}
FAMILY_LANES = {
    "voice_like_foreground_line": "foreground_contour_lane, harmonic_ridge_lane",
    "low_body_layer": "low_body_lane, pressure_peak_lane",
    "bass_like_low_body_layer": "low_body_lane, pressure_peak_lane",
    "harmonic_bed_layer": "harmonic_ridge_lane, diffuse_tail_lane",
    "synth_pad_like_sustained_harmonic_bed": "harmonic_ridge_lane, diffuse_tail_lane, spatial_spread_lane",
    "string_like_sustained_harmonic_layer": "harmonic_ridge_lane, foreground_contour_lane",
    "brass_wind_like_sustained_lead_layer": "foreground_contour_lane, harmonic_ridge_lane",
    "electronic_lead_like_melodic_layer": "foreground_contour_lane, harmonic_ridge_lane, transient_plane_lane",
    "guitar_like_plucked_melodic_layer": "foreground_contour_lane, harmonic_ridge_lane, transient_plane_lane",
    "piano_like_percussive_harmonic_layer": "foreground_contour_lane, harmonic_ridge_lane, transient_plane_lane",
    "rhythmic_pulse_layer": "transient_plane_lane, pressure_peak_lane",
    "drum_like_transient_pulse_layer": "transient_plane_lane, pressure_peak_lane",
    "impact_fx_like_transient_burst": "transient_plane_lane, pressure_peak_lane",
    "reverb_tail_like_diffuse_field": "diffuse_tail_lane, spatial_spread_lane",
    "diffuse_texture_layer": "diffuse_tail_lane, noise_texture_lane, spatial_spread_lane",
    "noise_riser_like_effect_flow": "noise_texture_lane, spatial_spread_lane, pressure_peak_lane",
    "glitch_grain_like_texture_layer": "noise_texture_lane, transient_plane_lane",
}


def member(column: str, groups: dict[str, str], otherwise: str) -> str:
    """The group that a name belongs to."""
    return cases(*[(f"{column} IN ({', '.join(repr(x) for x in names.split(', '))})", group) for group, names in groups.items()], otherwise=otherwise)


def source_name(score: str) -> str:
    _, names, _ = SOURCES[score]
    return f"'{names[0][1]}'" if len(names) == 1 else cases(*names[:-1], otherwise=names[-1][1])


def hint(words: str) -> str:
    """The strongest source hypothesis of a segment whose name or basis holds one of the words."""
    found = []
    for score, (least, names, basis) in SOURCES.items():
        tests = [test for test, name in names if any(w in f"{name} {basis}".lower() for w in words.split(", "))]
        if len(tests) == len(names):
            found.append(f"CASE WHEN {score} > {least} THEN {score} ELSE 0.0 END")
        elif tests:
            first = names[0][0]
            found.append(f"CASE WHEN {score} > {least} AND {first if tests == [first] else f'NOT ({first})'} THEN {score} ELSE 0.0 END")
    return f"greatest(0.0, {', '.join(found)})" if found else "0.0"


#: What the families' weights name beside the profile; no external packet is at hand here.
FAMILY_TERMS: Stage = {
    "melodic": "CASE WHEN melody = 'blurred_contour' THEN 0.0 ELSE 1.0 END",
    "sustained": "CASE WHEN phrase LIKE 'long%' THEN 1.0 ELSE 0.0 END",
    "dense": "CASE WHEN phrase LIKE '%dense%' THEN 1.0 ELSE 0.0 END",
    "bright": clamp("centroid / 3000"),
    "apart": f"1 - {clamp('(phase + 1) * 0.5')}",
    "noisy": clamp("1 - harmonic"),
    "strongest": f"greatest({', '.join(OBJECTS)})",
    "external": "0.0",
}


def family_scores() -> Stage:
    out: Stage = {}
    for name, (_, score, words) in FAMILIES.items():
        out[name] = weighted(FAMILY_WEIGHTS[name].replace(" object", f" {score}").replace(" hint", f" {hint(words)}"))
    return out


def family_hints() -> Stage:
    return {f"hint_{name}": hint(words) for name, (_, _, words) in FAMILIES.items()}


#: What a claim's cap asks of a track: whether a layer of priors stands beside it and matched a pitch, external packets, and the band of their support.
UNTOLD = {"prior_available": "false", "pitch_matched": "false", "packets": "0", "external_support": "'reduced'"}
#: Claims on a candidate with active_mean, coverage, longest (run), variation (of timbre), hinted, its group and the columns of UNTOLD.
CLAIMS: list[Stage] = [
    {
        "continuity": cases(("longest >= 4 OR coverage >= 0.62", "persistent_track_like"), ("longest >= 2 OR coverage >= 0.32", "intermittent_but_trackable"), ("active > 0", "local_or_fragmentary"), otherwise="not_trackable"),
        "timbre": cases(("active = 0", "insufficient"), ("variation <= 0.08", "stable_timbre_fingerprint"), ("variation <= 0.18", "moderately_stable_timbre"), otherwise="shifting_or_mixed_timbre"),
        "dominant_band": cases(("low_mean >= mid_mean AND low_mean >= high_mean", "low"), ("mid_mean >= high_mean", "mid"), otherwise="high"),
        "articulation": cases(
            ("harmonic_mean >= 0.68 AND percussive_mean >= 0.42", "plucked_or_articulated_harmonic_bias"),
            ("harmonic_mean >= 0.68", "sustained_harmonic_bias"),
            ("percussive_mean >= 0.52", "percussive_transient_bias"),
            ("high_mean >= 0.35 AND harmonic_mean < 0.55", "noisy_or_air_texture_bias"),
            otherwise="mixed_or_texture_bias",
        ),
        "claim_score": "0.55 * active_mean + 0.20 * coverage + 0.15 * least(1.0, longest / 4.0) + CASE WHEN active > 0 AND variation <= 0.18 THEN 0.05 ELSE 0.0 END + CASE WHEN hinted THEN 0.05 ELSE 0.0 END"
        f" - CASE WHEN family_group <> '{FUNCTIONAL}' AND NOT hinted THEN 0.08 ELSE 0.0 END",
    },
    {"raw_claim": cases(("claim_score >= 0.68", "strong"), ("claim_score >= 0.46", "medium"), otherwise="weak")},
    {"capped": f"raw_claim = 'strong' AND family_group <> '{FUNCTIONAL}' AND prior_available AND packets = 0 AND external_support NOT IN ('moderate', 'pronounced', 'dominant') AND NOT pitch_matched"},
    {
        "claim": "CASE WHEN capped THEN 'medium' ELSE raw_claim END",
        "calibration": cases(("capped", "capped_without_pitch_or_external_evidence"), otherwise="not_capped"),
        "support_band": band("mean_support"),
        "openness": "greatest(width_mean, spread_mean)",
    },
    {
        "candidate_score": clamp("greatest(CASE claim WHEN 'strong' THEN 0.82 WHEN 'medium' THEN 0.58 ELSE 0.30 END, 0.52 * active_mean + 0.28 * max_support + 0.20 * coverage)"),
        "claim_rank": "CASE claim WHEN 'strong' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END",
    },
]
# Source objects with the families that stand for them and those that only support them, and whether a sustained family needs pitch to be likely.
SOURCE_OBJECTS: dict[str, tuple[str, str, bool]] = {
    "voice_object": ("voice_like_foreground_line", "harmonic_bed_layer", False),
    "bass_low_register_object": ("bass_like_low_body_layer", "low_body_layer", False),
    "drum_percussion_object": ("drum_like_transient_pulse_layer", "rhythmic_pulse_layer, impact_fx_like_transient_burst", False),
    "guitar_plucked_object": ("guitar_like_plucked_melodic_layer", "harmonic_bed_layer, voice_like_foreground_line", False),
    "keyboard_piano_object": ("piano_like_percussive_harmonic_layer", "harmonic_bed_layer", False),
    "synth_pad_harmonic_object": ("synth_pad_like_sustained_harmonic_bed, electronic_lead_like_melodic_layer", "harmonic_bed_layer, diffuse_texture_layer", False),
    "fx_texture_tail_object": ("noise_riser_like_effect_flow, glitch_grain_like_texture_layer, reverb_tail_like_diffuse_field, impact_fx_like_transient_burst", "diffuse_texture_layer, rhythmic_pulse_layer", False),
    "strings_bowed_object": ("string_like_sustained_harmonic_layer", "harmonic_bed_layer", True),
    "brass_wind_object": ("brass_wind_like_sustained_lead_layer", "voice_like_foreground_line, harmonic_bed_layer", True),
}
CONFUSED = {
    "voice_object": "guitar_plucked_object, keyboard_piano_object, synth_pad_harmonic_object",
    "bass_low_register_object": "synth_pad_harmonic_object, drum_percussion_object",
    "drum_percussion_object": "fx_texture_tail_object, bass_low_register_object",
    "guitar_plucked_object": "keyboard_piano_object, synth_pad_harmonic_object, voice_object",
    "keyboard_piano_object": "guitar_plucked_object, synth_pad_harmonic_object",
    "synth_pad_harmonic_object": "keyboard_piano_object, strings_bowed_object, fx_texture_tail_object",
    "strings_bowed_object": "synth_pad_harmonic_object, brass_wind_object",
    "brass_wind_object": "voice_object, strings_bowed_object, synth_pad_harmonic_object",
    "fx_texture_tail_object": "drum_percussion_object, synth_pad_harmonic_object",
}
#: Families of priors that speak for each object.
OBJECT_PRIORS = {
    "voice_object": "voice",
    "bass_low_register_object": "low_register",
    "drum_percussion_object": "percussion",
    "guitar_plucked_object": "plucked_strings",
    "keyboard_piano_object": "keyboard",
    "synth_pad_harmonic_object": "electronic_fx, keyboard",
    "fx_texture_tail_object": "electronic_fx, percussion",
    "strings_bowed_object": "bowed_strings",
    "brass_wind_object": "brass, woodwinds",
}
#: Least score of a window's priors that counts for an object, and the cap of objects that need a pitch to be likely.
PRIOR_LEAST, UNPITCHED_CAP = 0.34, 0.54


def visible(score: str) -> str:
    return cases((f"{score} < 0.18", "not_supported"), (f"verified AND {score} >= 0.52", "externally_supported"), (f"has_primary AND has_prior AND {score} >= 0.56", "likely_local"), (f"{score} >= 0.42", "possible"), otherwise="weak_local")


#: A source object's score and visibility, out of the scores of what speaks for it, has_primary, has_prior, verified, needs_pitch and missing_pitch.
VISIBILITY: list[Stage] = [
    {"raw_score": clamp("greatest(primary_score, 0.72 * supporting_score, 0.84 * prior_score, 0.68 * behaviour_score, 0.62 * performance_score)")},
    {"raw_visibility": visible("raw_score")},
    {"capped": f"needs_pitch AND NOT verified AND missing_pitch AND raw_visibility = 'likely_local' AND raw_score > {UNPITCHED_CAP}"},
    {"confidence": f"CASE WHEN capped THEN {UNPITCHED_CAP} ELSE raw_score END"},
    {"visibility": f"CASE WHEN verified AND raw_visibility = 'externally_supported' THEN raw_visibility ELSE {visible('confidence')} END"},
]

BEHAVIOUR: Stage = {
    "entry": cases(
        ("active = 0", "unresolved"),
        ("first_start <= song_start + 0.25", "already_present"),
        ("coverage <= 0.28 OR longest <= 1 OR family = 'impact_fx_like_transient_burst'", "local_burst"),
        ("entry_strength >= 0.6", "immediate_entry"),
        otherwise="gradual_entry",
    ),
    "continuity_kind": cases(("continuity = 'persistent_track_like' OR coverage >= 0.68 OR longest >= 4", "persistent"), ("recurrences > 0 OR ranges >= 3", "recurrent"), ("longest <= 1 OR coverage <= 0.25", "local_fragment"), otherwise="intermittent"),
    "flow": member("family", FLOW, "mixed"),
    "support_role": member("family", ROLE, "unresolved"),
    "masking": cases(
        ("family = 'voice_like_foreground_line' AND active_mean >= 0.7 AND overlap_count <= 5", "unmasked"),
        ("family IN ('diffuse_texture_layer', 'glitch_grain_like_texture_layer', 'noise_riser_like_effect_flow') OR articulation LIKE '%noisy%'", "masking_other_layers"),
        ("overlap_count >= 7 OR dominant_band = 'low'", "partially_masked"),
        (f"family_group = '{FUNCTIONAL}'", "unmasked"),
        otherwise="unresolved",
    ),
    "pressure_relation": cases(("pressure_strength >= 0.6", "pressure_peak_event"), ("pressure_mean >= 0.58", "pressure_forward"), ("pressure_mean >= 0.38", "pressure_moderate"), otherwise="pressure_restrained"),
    "tail": cases(
        ("family IN ('reverb_tail_like_diffuse_field', 'diffuse_texture_layer') OR tail_events > 0", "diffuse_tail_attached"),
        ("spread_events > 0 OR openness >= 0.58", "long_tail_or_haze"),
        ("family IN ('impact_fx_like_transient_burst', 'rhythmic_pulse_layer', 'drum_like_transient_pulse_layer')", "short_tail"),
        otherwise="dry_or_detached",
    ),
    "release_shape": cases(("active = 0", "unresolved"), ("last_end >= song_end - 1.0", "continues_to_end"), ("family = 'impact_fx_like_transient_burst' OR coverage <= 0.25", "local_decay"), ("exits > 0", "clear_release"), otherwise="gradual_release"),
    "recurrence": cases(("recurrences > 0", "section_recurrent"), ("ranges >= 3", "repeated_return"), ("longest <= 1", "local_echo"), otherwise="single_pass"),
    # a word for restraint anywhere in the spatial sentence counts, be it of motion, pressure or width
    "spatial": cases(("openness >= 0.58", "wide_diffuse"), ("abs(left_right_mean) >= 0.25", "side_opening"), ("pressure_mean >= 0.58", "pressure_forward_center"), ("(motion_mean >= 0.18 AND motion_mean < 0.38) OR (pressure_mean >= 0.18 AND pressure_mean < 0.38) OR (openness >= 0.18 AND openness < 0.38)", "motion_restrained"), otherwise="center_bound"),
}


def mean(*parts: str) -> str:
    return f"({' + '.join(f'({x})' for x in parts)}) / {len(parts)}.0"


def half(x: str) -> str:
    """[-1, 1] onto [0, 1]."""
    return f"CASE WHEN abs({x}) <= 1 THEN ({x} + 1) / 2 ELSE {clamp(x)} END"


# Descriptor proxies, their dimensions and the objects that they may point to.
PROXY_STAGES: list[Stage] = [
    {
        "p_height": half("height"),
        "p_phase": half("phase"),
        "p_near": half("distance"),
        "p_stable": clamp(f"1 - abs(({half('left_right')}) - 0.5) * 2"),
        "p_low_body": "greatest(low_foundation, low)",
        "p_harmonic": "greatest(harmonic_bed, harmonic)",
        "p_melody": "CASE WHEN melody = 'blurred_contour' THEN 0.34 ELSE 0.62 END",
    },
    {
        "p_lead": "greatest(vocal_line, p_melody)",
        "p_edge": "greatest(p_height, high)",
        "p_direct": mean("p_near", "p_phase", "1 - spread", "p_stable"),
        "p_tail": mean("spread", "envelopment", "texture", "1 - p_phase"),
        "p_mid_side": mean("1 - side_ratio", "p_stable", "p_phase"),
        "p_rough": mean("flatness", "density", "texture"),
        "p_body": "greatest(p_low_body, mid * 0.5)",
    },
    {
        "p_clean": mean("p_edge", "1 - flatness"),
        "p_late": mean("p_tail", "spread", "envelopment"),
        "p_cue": mean("p_mid_side", "p_phase", "p_stable"),
        "p_early": mean("width", "p_phase", "percussive"),
        "p_ratio": clamp("p_tail / greatest(0.18, percussive + 0.08)"),
    },
    {"p_persist": mean("p_tail", "p_late")},
]
DIMENSIONS = {
    "warm_cold": {"cold": mean("p_height", "p_edge", "1 - p_body", "1 - p_harmonic"), "warm": mean("p_body", "p_harmonic", "1 - greatest(0.0, p_edge - 0.58)")},
    "bright_dark": {"dark": mean("1 - p_height", "1 - high"), "bright": mean("p_height", "greatest(p_edge, high)", "high"), "glassy": mean("p_height", "p_clean")},
    "rough_smooth": {"smooth": mean("1 - flatness", "p_harmonic", "1 - density"), "grainy": mean("flatness", "p_rough", "density"), "sandy": mean("flatness", "texture", "p_edge"), "metallic": mean("p_edge", "p_rough", "1 - p_phase")},
    "dry_wet": {"dry": mean("p_direct", "1 - p_late", "1 - p_tail"), "wet": mean("p_late", "p_tail", "1 - p_direct"), "reverberant": mean("p_late", "p_persist", "p_ratio")},
    "focus_diffuse": {"focused": mean("p_mid_side", "p_phase", "p_cue"), "diffuse": mean("side_ratio", "1 - p_phase", "spread"), "phase_colored": mean("1 - p_phase", "side_ratio", "p_rough")},
    "width_envelopment": {"narrow": mean("1 - width", "1 - side_ratio", "p_mid_side"), "wide": mean("width", "side_ratio", "spread"), "surrounding": mean("envelopment", "spread", "p_persist")},
}
DESCRIPTOR_LEAST = 0.58
DIMENSION_SCORES: Stage = {f"d_{name}": e for scores in DIMENSIONS.values() for name, e in scores.items()}


def has(name: str) -> str:
    """Whether a descriptor is among a segment's, be it chosen or the best of an ambiguous dimension."""
    scores = next(s for s in DIMENSIONS.values() if name in s)
    names = list(scores)
    earlier, later = names[: names.index(name)], names[names.index(name) + 1 :]
    best = " AND ".join([f"d_{name} > d_{x}" for x in earlier] + [f"d_{name} >= d_{x}" for x in later] + [f"d_{x} < {DESCRIPTOR_LEAST}" for x in names])
    return f"(d_{name} >= {DESCRIPTOR_LEAST} OR ({best}))"


SELECTED: Stage = {
    f"s_{dim}": listed(*[(f"d_{x} >= {DESCRIPTOR_LEAST}", x) for x in scores], *[(f"{has(x)} AND d_{x} < {DESCRIPTOR_LEAST}", f"ambiguous_{x}") for x in scores]) for dim, scores in DIMENSIONS.items()
}
#: Tests of each object, by the name of what they show; names behind an asterisk are mandatory.
INTERSECTIONS = {
    "voice_like_or_lead_like": {"*focused": has("focused"), "harmonic_continuity": "p_harmonic >= 0.38", "mid_band_body": "p_body >= 0.28", "*melodic_contour_possible": "(p_melody >= 0.34 OR p_lead >= 0.38)"},
    "guitar_like": {"harmonic_continuity": "p_harmonic >= 0.38", "medium_transient_edge": "(percussive >= 0.28 AND percussive <= 0.78)", "rough_or_string_texture_possible": f"(p_rough >= 0.38 OR {has('grainy')})", "*side_or_mid_side_support": "side_ratio >= 0.38"},
    "piano_like": {"*clear_attack": "percussive >= 0.48", "harmonic_decay": "(p_harmonic >= 0.38 AND p_late >= 0.28)", "broadband_body": "(p_body >= 0.28 AND p_edge >= 0.28)", "not_fully_sustained_pad": "percussive >= 0.38"},
    "pad_like": {"soft_attack": "percussive < 0.38", "sustain_high": "p_harmonic >= 0.38", "*wide_or_diffuse": f"({has('wide')} OR {has('diffuse')})", "harmonic_body_supported": "p_harmonic >= 0.38"},
    "bass_like": {"*low_body_high": "p_low_body >= 0.58", "sustain_supported": "(p_harmonic >= 0.38 AND percussive < 0.58)", "center_or_near_center": "p_mid_side >= 0.38"},
    "low_impact_like": {"low_body_supported": "p_low_body >= 0.38", "*transient_high": "(percussive >= 0.58 OR density >= 0.58)", "short_decay": "p_late < 0.58", "center_or_near_center": "p_mid_side >= 0.38"},
    "reverb_air_or_haze_like": {"*diffuse": f"({has('diffuse')} OR {has('phase_colored')})", "late_tail_or_high_edge": "(p_late >= 0.38 OR p_edge >= 0.58)", "low_localization_focus": "p_mid_side < 0.58", "*wide_environment": f"({has('wide')} OR {has('surrounding')})"},
}


def intersection(tests: dict[str, str]) -> tuple[str, str]:
    """(share of the tests that hold, status)."""
    count = "(" + " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in tests.values()) + ")"
    needed = " AND ".join(t for name, t in tests.items() if name.startswith("*"))
    share = f"{count} / {len(tests)}.0"
    status = cases((f"NOT ({needed}) AND {count} > 0", "blocked_missing_mandatory_evidence"), (f"{count} = 0", "unsupported"), (f"{share} >= 0.75", "supported"), (f"{share} >= 0.5", "possible"), otherwise="weak")
    return share, status


BANDS: Stage = {
    "brightness": cases(("height >= 0.45", "upper-weighted / bright"), ("height >= 0.18", "slightly upper-weighted"), ("height <= -0.45", "low-weighted / dark"), ("height <= -0.18", "slightly low-weighted"), otherwise="balanced spectral weight"),
    "nearness": cases(("distance >= 0.55", "close / strongly present"), ("distance >= 0.25", "near-to-mid presence"), ("distance <= -0.35", "recessed or distant"), otherwise="mid-field / neutral distance"),
    "coherence": cases(("phase <= -0.15", "decorrelated / phase-opposed"), ("phase < 0.25", "partly diffuse / weakly coherent"), ("phase < 0.65", "moderately coherent"), otherwise="coherent center support"),
    "lean": cases(("balance <= -0.45", "left-leaning"), ("balance <= -0.15", "slightly left-leaning"), ("balance >= 0.45", "right-leaning"), ("balance >= 0.15", "slightly right-leaning"), otherwise="centered / balanced"),
    "level": cases(("rms <= 1e-12 OR 20 * log10(rms) <= -90", "digital level unavailable or near silence"), ("20 * log10(rms) >= -6", "near-full-scale digital level"), ("20 * log10(rms) >= -14", "high digital level"), ("20 * log10(rms) >= -28", "moderate digital level"), otherwise="low digital level"),
    "position": cases(("left_right <= -0.25", "left-leaning"), ("left_right >= 0.25", "right-leaning"), otherwise="center-bound"),
    "opening": cases(("greatest(width, spread) >= 0.58", "wide / diffuse field binding"), ("greatest(width, spread) >= 0.38", "moderately open field binding"), ("greatest(width, spread) >= 0.18", "restrained lateral opening"), otherwise="center-concentrated / narrow field binding"),
    "presence": cases(("distance >= 0.45", "close / pressure-forward"), ("distance <= -0.25", "recessed / distant"), otherwise="mid-field / neutral presence"),
    "pressure_band": band("pressure"),
    "motion_band": band("motion"),
}
SENTENCE: Stage = {"sentence": "concat(position, ', ', opening, ', pressure ', pressure_band, ', motion ', motion_band, ', ', presence)"}
#: Weights of the words in a segment's descriptor score; other words weigh 0.2.
WORD_WEIGHTS = {
    "reduced": 0.05,
    "restrained": 0.18,
    "moderate": 0.35,
    "pronounced": 0.65,
    "dominant": 0.85,
    "close / strongly present": 0.75,
    "upper-weighted / bright": 0.55,
    "low-weighted / dark": 0.55,
    "decorrelated / phase-opposed": 0.60,
    "coherent center support": 0.55,
    "high digital level": 0.45,
    "near-full-scale digital level": 0.70,
}
