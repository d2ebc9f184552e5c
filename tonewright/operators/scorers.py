"""Segment scores as SQL expressions: each stage is a set of columns over those of the stages before.

The expressions are Catalyst columns on the main path; as they are plain SQL, the queries'
SQL is made of the same text. A weighted sum is written as a list of weights and terms,
with -x for 1 - x, and is held between 0 and 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stage = dict[str, str]


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def signed(x: str) -> str:
    return f"greatest(-1.0, least(1.0, {x}))"


def weighted(text: str) -> str:
    """SQL of "0.46 low, 0.12 -high": the sum of weights times terms, between 0 and 1."""
    parts = []
    for part in re.split(r", (?=[0-9.]+ )", text):
        weight, term = part.split(" ", 1)
        parts.append(f"{weight} * (1 - {term[1:]})" if term.startswith("-") else f"{weight} * {term}")
    return clamp(" + ".join(parts))


def cases(*steps: tuple[str, str], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for test, name in steps) + f" ELSE '{otherwise}' END"


def listed(*steps: tuple[str, str], otherwise: str = "") -> str:
    """The names whose tests hold, in order, joined by semicolons; the default where none does."""
    found = "concat_ws(';', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in steps) + ")"
    return f"coalesce(nullif({found}, ''), '{otherwise}')"


def quarters(x: str, *names: str) -> str:
    """One of four names by quarters of the unit."""
    return cases((f"{clamp(x)} < 0.25", names[0]), (f"{clamp(x)} < 0.5", names[1]), (f"{clamp(x)} < 0.75", names[2]), otherwise=names[3])


def band(x: str) -> str:
    return cases((f"{x} >= 0.78", "dominant"), (f"{x} >= 0.58", "pronounced"), (f"{x} >= 0.38", "moderate"), (f"{x} >= 0.18", "restrained"), otherwise="reduced")


def trend(x: str, small: float, up: str, down: str, stable: str) -> str:
    return cases((f"{x} > {small}", up), (f"{x} < -{small}", down), otherwise=stable)


def applied(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        df = df.withColumns({n: F.expr(e) for n, e in stage.items()})
    return df


def applied_sql(stages: list[Stage], source: str = "{source}") -> str:
    for stage in stages:
        source = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {source})"
    return f"SELECT * FROM {source}"


# Weights, scales, thresholds and names of the scores, in the domain's own terms.
SPACE = ["pressure", "width", "height", "distance", "spread", "motion", "envelopment"]
SPACE_STAGES: list[Stage] = [
    {
        "pressure": clamp("0.55 * rms / 0.30 + 0.25 * peak_max / 0.95 + 0.20 * onset"),
        "width": clamp(f"0.70 * side_ratio / 0.50 + 0.30 * (1 - {clamp('(phase + 1) / 2')})"),
        "height": signed("(centroid - 1800) / 2600"),
        "left_right": signed("balance"),
    },
    {
        "distance": signed("0.85 * pressure - 0.45 * width - 0.15 * flatness"),
        "spread": clamp("0.75 * width + 0.25 * bandwidth / 6500"),
        "motion": clamp("1.75 * lr_motion + 1.2 * dynamic"),
    },
    {"envelopment": weighted("0.65 width, 0.35 spread")},
]
EMISSION: Stage = {
    "emission_strength": clamp("rms / 0.30"),
    "directionality": cases(("abs(balance) < 0.12", "centered"), ("balance > 0", "right-leaning"), otherwise="left-leaning"),
    "emission_shape": quarters("0.55 * density + 0.45 * percussive", "sustained layer", "soft pulse layer", "recurring pulse", "dense transient mass"),
    "pressure_transfer": clamp("rms / 0.30"),
    "spread_transform": clamp("side_ratio / 0.50"),
    "temporal_continuity": weighted("0.55 harmonic, 0.45 -density"),
    "transient_transfer": weighted("0.65 onset, 0.35 percussive"),
    "masking_risk": weighted("1.4 rms, 0.35 mid, 0.25 percussive"),
}
OBJECTS = ["rhythm", "low_foundation", "harmonic_bed", "vocal_line", "texture"]
OBJECT_SCORES: Stage = {
    "rhythm": weighted("0.32 onset, 0.24 percussive, 0.18 density, 0.18 pressure, 0.08 low"),
    "low_foundation": weighted(f"0.58 low, 0.22 pressure, 0.20 -{clamp('centroid / 3500')}"),
    "harmonic_bed": weighted("0.42 harmonic, 0.22 mid, 0.18 width, 0.18 -density"),
    "vocal_line": weighted("0.30 harmonic, 0.25 mid, 0.15 pressure, 0.15 -flatness, 0.15 -density"),
    "texture": weighted("0.42 flatness, 0.25 high, 0.18 width, 0.15 zcr"),
}
RELATIONS = {
    "presses_forward_over": ("rhythm > 0.45 AND (harmonic_bed > 0.35 OR vocal_line > 0.35)", clamp("rhythm * pressure")),
    "grounds_or_thickens": ("low_foundation > 0.40", "low_foundation"),
    "surrounds_or_widens": ("width > 0.35 AND harmonic_bed > 0.38", clamp("width * harmonic_bed")),
    "fog_or_texture_masks_edges": ("texture > 0.45", "texture"),
}
RULES: Stage = {
    "relations": listed(*[(test, name) for name, (test, _) in RELATIONS.items()], otherwise="no_strong_relation_detected"),
    **{f"strength_of_{name}": f"CASE WHEN {test} THEN {e} ELSE 0.0 END" for name, (test, e) in RELATIONS.items()},
    "tags": listed(
        ("rhythm > 0.50", "rhythmic-forward / 节奏前推"),
        ("low_foundation > 0.45", "low-end-driven / 低频驱动"),
        ("harmonic_bed > 0.48", "harmonic-layered / 和声层明显"),
        ("vocal_line > 0.48", "vocal-contour-likely / 人声轮廓候选"),
        ("width > 0.38", "wide-stereo-field / 宽声场"),
        ("distance > 0.45", "near-pressure / 近场压力"),
        ("centroid > 3200", "bright-upper-texture / 上方明亮"),
        ("flatness > 0.38", "noisy-or-textural / 噪声或纹理感"),
        otherwise="balanced-field / 平衡声场",
    ),
    "role": cases(
        ("(start_s + end_s) / 2 / greatest(duration, 1e-12) < 0.10 AND harmonic_bed >= greatest(low_foundation, rhythm)", "intro_like"),
        ("(start_s + end_s) / 2 / greatest(duration, 1e-12) > 0.86 AND pressure < 0.45", "outro_like"),
        ("low_foundation > 0.72 AND pressure > 0.56 AND width < 0.28", "chorus_like"),
        ("vocal_line > harmonic_bed AND vocal_line > low_foundation", "verse_like"),
        ("pressure < 0.45 AND width > 0.45", "bridge_like"),
        ("rhythm > 0.42 AND low_foundation > 0.55", "breakdown_like"),
        otherwise="section_like",
    ),
    "role_confidence": clamp("0.35 + 0.35 * abs(pressure - 0.45) + 0.30 * greatest(low_foundation, harmonic_bed, vocal_line, rhythm)"),
}
SKELETON: Stage = {
    "melody": cases(("harmonic < 0.70 OR texture > 0.35", "blurred_contour"), ("centroid_delta > 90", "rising_contour"), ("centroid_delta < -90", "falling_contour"), otherwise="stable_or_reciting_contour"),
    "bass": cases(
        ("low < 0.25", "bass_light_or_absent"),
        ("low > 0.58 AND density > 0.09", "repeated_low_anchor"),
        ("low_delta > 0.05", "bass_rises_or_opens"),
        ("low_delta < -0.05", "bass_drops_or_thickens"),
        otherwise="low_anchor_stable",
    ),
    "note_density": quarters("1.8 * density + 0.9 * percussive", "sparse", "medium_sparse", "medium", "dense"),
    "phrase": cases(
        ("pressure > 0.58 AND width < 0.28", "compressed_center_phrase"),
        ("density > 0.13", "dense_pulsed_phrase"),
        ("pressure < 0.40 AND width > 0.45", "release_tail_phrase"),
        otherwise="long_sustained_phrase",
    ),
    "harmony": cases(
        ("low > 0.58 AND width < 0.28", "dark_compressed_low_block"),
        ("width > 0.55 AND harmonic > 0.80", "wide_sustained_harmonic_field"),
        ("centroid > 1200", "brighter_release_or_upper_residue"),
        otherwise="dark_stable_harmonic_block",
    ),
}
#: Source hypotheses: score, least score, names by test, and the basis in words.
SOURCES = {
    "vocal_line": (0.48, [("true", "vocals_or_vocal-like_lead")], "mid/harmonic continuous full-mix contour"),
    "low_foundation": (0.42, [("true", "bass_or_low_end_body")], "low-band energy and pressure"),
    "rhythm": (0.38, [("true", "drums_or_percussive_pulse")], "onset/percussive proxy"),
    "harmonic_bed": (0.48, [("centroid < 500 AND low > 0.45", "low_harmonic_layer_or_bass_harmony"), ("true", "other_harmonic_layer_or_synth_pad")], "harmonic/stereo layer evidence"),
}
STREAM_LEAST = {"vocal_line": 0.38, "low_foundation": 0.38, "rhythm": 0.38, "harmonic_bed": 0.34, "texture": 0.32}
STREAM_EVENTS: Stage = {
    "vocal_line": cases(("phrase LIKE '%dense%' OR note_density = 'dense'", "dense_vocal_or_lead_phrase"), ("phrase LIKE '%release%'", "released_foreground_phrase"), ("phrase LIKE '%compressed%'", "compressed_center_phrase"), otherwise="foreground_phrase"),
    "low_foundation": cases(
        ("bass = 'repeated_low_anchor'", "repeated_low_anchor_event"), ("bass LIKE '%drops%' OR bass LIKE '%thickens%'", "bass_drop_or_thickening_event"), ("bass LIKE '%rises%' OR bass LIKE '%opens%'", "bass_rise_or_opening_event"), otherwise="low_body_anchor_event"
    ),
    "rhythm": cases(("note_density = 'dense'", "dense_pulse_event"), ("note_density = 'sparse'", "sparse_time_marker"), otherwise="regular_pulse_event"),
    "harmonic_bed": cases(("harmony LIKE '%wide%'", "wide_harmonic_field_event"), ("harmony LIKE '%upper%' OR harmony LIKE '%brighter%'", "upper_residue_or_release_event"), otherwise="chordal_support_event"),
    "texture": cases(("flatness >= 0.42", "noise_texture_or_fx_event"), ("phrase LIKE '%release%'", "tail_or_release_event"), otherwise="diffuse_texture_event"),
}
#: Beats a minute from which a track counts as fast.
FAST_BPM = 105
STYLES: Stage = {
    "electronic_or_beat_driven": weighted("0.35 percussive, 0.30 onset, 0.22 low, 0.13 fast"),
    "rock_or_band_driven": weighted("0.32 mid, 0.23 percussive, 0.25 harmonic, 0.20 centroid / 4500"),
    "ambient_or_spatial": weighted("0.34 side_ratio, 0.26 -onset, 0.25 harmonic, 0.15 -low"),
    "vocal_song_candidate": weighted("0.38 mid, 0.30 harmonic, 0.20 -flatness, 0.12 rms"),
    "noise_texture_or_experimental": weighted("0.46 flatness, 0.20 high, 0.20 side_ratio, 0.14 -harmonic"),
}
SEGMENT_STAGES = [*SPACE_STAGES, OBJECT_SCORES, {**RULES, **SKELETON, **EMISSION}]

SPACE_SQL = applied_sql(SPACE_STAGES)
OBJECTS_SQL = f"""SELECT *, array_to_string(list_transform(list_slice(list_reverse_sort([{", ".join(f"{{{{'score': round({n}, 9), 'name': '{n}'}}}}" for n in OBJECTS)}]), 1, 3), lambda x: x.name), ',') AS dominant
    FROM ({applied_sql([OBJECT_SCORES])})"""
RULES_SQL = applied_sql([RULES])


def space(df: DataFrame) -> DataFrame:
    """Where and how large a segment sounds, from its features."""
    return applied(df, SPACE_STAGES)


def ranked(names: list[str], size: int) -> Column:
    """The names of the highest columns, best first."""
    order = F.sort_array(F.array(*[F.struct(F.round(n, 9).alias("score"), F.lit(n).alias("name")) for n in names]), asc=False)
    return F.array_join(F.transform(F.slice(order, 1, size), lambda x: x["name"]), ",")


def objects(df: DataFrame) -> DataFrame:
    """Support for five kinds of objects, and the three strongest, best first."""
    return applied(df, [OBJECT_SCORES]).withColumn("dominant", ranked(OBJECTS, 3))


def rules(df: DataFrame) -> DataFrame:
    """Relations with strengths, style tags, section role and its confidence; a default where no rule holds."""
    return applied(df, [RULES])
