"""Acoustic priors as relations: classes and templates are rows, and a window meets all of them in one row of its own.

A class row holds weights over a window's evidence; a template row names classes, lanes, registers and the
weights of its six parts; a cap row says how high a score may go while some evidence is missing. The three
relations are small by nature (a class for each word, a template for each instrument) and are sent to all tasks;
a window keeps its best few before any pair of window and template becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evidence import FAMILIES, LANES
from .scorers import Stage, clamp

# A window's evidence, out of its metrics and lanes.
EVIDENCE: list[Stage] = [
    {
        "e_low": "greatest(low_mid_sustained, low_side_sustained, 0.85 * low_body_lane)",
        "e_mid": "greatest(mid_mid_sustained, mid_side_sustained, 0.85 * foreground_contour_lane)",
        "e_high": "greatest(high_mid_sustained, high_side_sustained, mid_high_mid_sustained, 0.85 * noise_texture_lane)",
        "e_harmonic": clamp("greatest(harmonic_ridge_lane, 0.82 * foreground_contour_lane, mid_mid_sustained, mid_high_mid_sustained)"),
        "e_transient": clamp("greatest(transient_plane_lane, transient_broadband, transient_low, transient_mid, transient_high)"),
        "e_noise": clamp("greatest(noise_texture_lane, high_mid_sustained, high_side_sustained, 0.85 * transient_high)"),
        "e_tail": "diffuse_tail_lane",
        "e_pressure": "pressure_peak_lane",
    },
    {"e_sustained": clamp("greatest(e_harmonic, diffuse_tail_lane, broadband_mid_energy, mid_side_sustained)")},
    {
        "e_attack": "greatest(e_transient, e_sustained, e_pressure)",
        "e_decay": "greatest(e_transient, e_sustained, e_tail)",
        "e_any": "greatest(e_noise, e_transient, e_high, e_harmonic)",
        "e_strike": "greatest(e_transient, e_pressure)",
        "e_one": "1.0",
    },
]
VARIABLES = [n for stage in EVIDENCE for n in stage]

# Classes of each kind; a score is what the weights give, or, after a bar, how near that comes to a target (target / reach).
CLASSES: dict[str, dict[str, str]] = {
    "harmonic": {
        "mostly_harmonic": "0.82 harmonic, 0.18 one, -0.18 noise",
        "quasi_harmonic": "0.82 harmonic, 0.18 one, -0.18 noise",
        "inharmonic": "0.60 noise, 0.30 transient, 0.10 one, -0.10 harmonic",
        "noise_dominant": "0.78 noise, 0.22 transient",
        "mixed": "0.42 harmonic, 0.38 noise, 0.20 transient",
    },
    **{
        f"{b}_band": {"variable": "0.72 one", "weak": f"1 {b} | 0.08 / 0.88", "limited": f"1 {b} | 0.25 / 0.88", "moderate": f"1 {b} | 0.50 / 0.88", "strong": f"1 {b} | 0.72 / 0.88", "dominant": f"1 {b} | 0.88 / 0.88"}
        for b in ("low", "mid", "high")
    },
    "attack": {
        "impulsive": "0.70 transient, 0.30 pressure",
        "fast": "0.82 transient, 0.18 one, -0.18 sustained",
        "medium": "1 transient | 0.50 / 1",
        "slow": "0.72 sustained, 0.28 one, -0.28 transient",
        "variable": "0.50 one, 0.25 attack",
    },
    "decay": {
        "short": "0.62 transient, 0.38 one, -0.38 tail",
        "medium": "0.5 sustained, 0.5 tail | 0.50 / 1",
        "long": "0.70 tail, 0.30 sustained",
        "sustained": "1 sustained",
        "variable": "0.50 one, 0.25 decay",
    },
    "sustain": {
        "none": "0.68 transient, 0.32 one, -0.32 sustained",
        "limited": "1 sustained | 0.30 / 1",
        "moderate": "1 sustained | 0.55 / 1",
        "high": "0.78 sustained, 0.22 tail",
        "continuous": "0.78 sustained, 0.22 tail",
        "variable": "0.50 one, 0.25 decay",
    },
    "rearticulation": {
        "single_hit": "0.72 strike, 0.28 one, -0.28 sustained",
        "repeated_attack": "1 transient",
        "legato": "0.78 sustained, 0.22 one, -0.22 transient",
        "continuous": "1 sustained",
        "variable": "0.50 one, 0.25 attack",
    },
    "noise": {
        "none": "1 one, -1 noise",
        "breath": "0.48 noise, 0.32 high, 0.20 harmonic",
        "bow_noise": "0.40 harmonic, 0.35 noise, 0.25 high",
        "pick_noise": "0.45 transient, 0.35 harmonic, 0.20 high",
        "strike_noise": "0.72 transient, 0.28 high",
        "metallic_noise": "0.45 noise, 0.35 high, 0.20 transient",
        "broadband_noise": "0.45 noise, 0.35 high, 0.20 transient",
        "electronic_noise": "0.45 noise, 0.35 high, 0.20 transient",
        "variable": "0.50 one, 0.25 any",
    },
    "inharmonicity": {
        "low": "0.70 harmonic, 0.30 one, -0.30 noise",
        "moderate": "0.3333333333333333 noise, 0.3333333333333333 transient, 0.3333333333333333 high | 0.50 / 1",
        "high": "0.42 noise, 0.32 high, 0.26 transient",
        "variable": "0.50 one, 0.25 any",
    },
}
#: The class of a kind that a name not among its classes stands for.
DEFAULT = {"harmonic": "mixed", "low_band": "moderate", "mid_band": "moderate", "high_band": "moderate", **dict.fromkeys(["attack", "decay", "sustain", "rearticulation", "noise", "inharmonicity"], "variable")}
#: How the classes' scores make the parts of a template's score, beside its lanes and its register.
PARTS = {
    "harmonic": {"harmonic": 1.0},
    "spectral": {"low_band": 0.34, "mid_band": 0.34, "high_band": 0.32},
    "envelope": {"attack": 0.32, "decay": 0.24, "sustain": 0.24, "rearticulation": 0.20},
    "noise": {"noise": 0.58, "inharmonicity": 0.42},
}
WEIGHED = ["pitch", *PARTS, "lanes"]
CAPS = [("pitch", 0.55), ("external", 0.68)]
#: Least score of a hypothesis, and how many a window keeps.
LEAST, MOST, MOST_FAMILIES = 0.25, 8, 6

TEMPLATE = "instrument_id string, family string, " + ", ".join(f"{k} string" for k in CLASSES) + ", likely array<string>, supporting array<string>, contradicting array<string>, pitch_low double, pitch_high double, core_low double, core_high double, weights array<double>"
"""Columns of the relation of templates; `weights` follows WEIGHED."""


def parsed(text: str) -> tuple[list[float], float | None, float]:
    """Weights over VARIABLES, and the target and reach of a class that looks for nearness."""
    body, _, aim = text.partition(" | ")
    weights = dict.fromkeys(VARIABLES, 0.0)
    for part in body.split(", "):
        weight, name = part.split(" ")
        weights[f"e_{name}"] += float(weight)
    target, _, reach = aim.partition(" / ")
    return list(weights.values()), float(target) if aim else None, float(reach) if aim else 1.0


def classes(spark: SparkSession) -> DataFrame:
    """(name, weights, target, reach): a row for each class, named by kind and class."""
    rows = [(f"{kind}:{name}", *parsed(text)) for kind, names in CLASSES.items() for name, text in names.items()]
    return spark.createDataFrame(rows, "name string, weights array<double>, target double, reach double")


def caps(spark: SparkSession) -> DataFrame:
    """(missing, cap): how high a score may go without this evidence."""
    return spark.createDataFrame(CAPS, "missing string, cap double")


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _in_one(relation: DataFrame, name: str, order: str) -> DataFrame:
    """The rows of a small relation as one array, in one row."""
    return relation.agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in relation.columns if c != order]))).alias(name))


def local_pitches(windows: DataFrame, notes: DataFrame) -> DataFrame:
    """windows with `pitches`: those of the notes (track, start, end, pitch) that overlap them; null where no notes are told for the track.

    Windows and notes meet by the seconds that they touch; a window holds as many notes as its few seconds do.
    """
    spans = lambda a, b: F.explode(F.sequence(F.floor(a), F.greatest(F.floor(a), F.ceil(b) - 1)))
    w = windows.select("track", "segment", "start_s", "end_s").withColumn("_s", spans("start_s", "end_s"))
    n = notes.select("track", F.col("start").alias("_a"), F.col("end").alias("_b"), "pitch", F.monotonically_increasing_id().alias("_id")).withColumn("_s", spans("_a", "_b"))
    met = w.join(n, ["track", "_s"]).where("_a < end_s AND start_s < _b AND pitch IS NOT NULL")
    # a pair meets in every second that it shares; the first of them counts
    met = met.where(F.col("_s") == F.greatest(F.floor("start_s"), F.floor("_a")))
    found = met.groupBy("track", "segment").agg(F.sort_array(F.collect_list("pitch")).alias("pitches"))
    told = notes.select("track").distinct().withColumn("_told", F.lit(True))
    out = windows.join(found, ["track", "segment"], "left").join(told, "track", "left")
    return out.withColumn("pitches", F.when(F.col("_told"), F.coalesce("pitches", F.array().cast("array<double>")))).drop("_told")


def hypotheses(windows: DataFrame, templates: DataFrame, most: int = MOST, least: float = LEAST) -> DataFrame:
    """windows with `ranked`: the best templates of each, array<struct<instrument_id, family, score, pitch_status, lane_status, parts>>.

    A window has the metrics that EVIDENCE names, `dominant` (lanes, comma-joined, or null), one column for each lane, and
    `pitches`. Ties go to the smaller instrument_id.
    """
    spark = windows.sparkSession
    df = windows
    for stage in EVIDENCE:
        df = df.withColumns({n: F.expr(e) for n, e in stage.items()})
    told = _in_one(classes(spark), "_classes", "name").crossJoin(_in_one(templates, "_templates", "instrument_id")).crossJoin(_in_one(caps(spark), "_caps", "missing"))  # one row
    df = df.withColumns({"_e": F.array(*[F.col(v).cast("double") for v in VARIABLES]), "_lanes": F.map_from_arrays(F.array(*[F.lit(n) for n in LANES]), F.array(*LANES)), "_top": F.coalesce(F.split("dominant", ","), F.array().cast("array<string>"))})
    df = df.join(F.broadcast(told), F.lit(True))

    def class_score(c: Column) -> Column:
        x = F.aggregate(F.zip_with(c["weights"], "_e", lambda w, v: w * v), F.lit(0.0), lambda a, v: a + v)
        return F.struct(c["name"], _unit(F.when(c["target"].isNull(), x).otherwise(1 - F.abs(x - c["target"]) / c["reach"])))

    df = df.withColumn("_m", F.map_from_entries(F.transform("_classes", class_score)))

    def of(t: Column, kind: str) -> Column:
        named = F.try_element_at("_m", F.concat(F.lit(f"{kind}:"), t[kind]))
        return F.coalesce(named, F.try_element_at("_m", F.lit(f"{kind}:{DEFAULT[kind]}")))

    def lane_values(names: Column) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.coalesce(F.try_element_at("_lanes", n), F.lit(0.0)))

    def scored(t: Column) -> Column:
        parts = {k: _unit(sum((w * of(t, c) for c, w in names.items()), F.lit(0.0))) for k, names in PARTS.items()}
        likely, against = F.coalesce(F.array_max(lane_values(t["likely"])), F.lit(0.0)), F.coalesce(F.array_max(lane_values(t["contradicting"])), F.lit(0.0))
        some = lane_values(t["supporting"])
        mean = F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, v: a + v) / F.size(some)).otherwise(0.0)
        shared = F.size(F.array_intersect(F.coalesce(t["likely"], F.array().cast("array<string>")), "_top"))
        lanes = _unit(0.72 * likely + 0.26 * mean + 0.08 * shared - 0.34 * against)
        clash = (against >= 0.62) & (likely < 0.25)
        parts["lanes"] = F.when(clash, F.least(lanes, F.lit(0.20))).otherwise(lanes)
        within = lambda low, high: F.size(F.filter("pitches", lambda p: (p >= t[low]) & (p <= t[high]))) / F.size("pitches")
        known = (F.coalesce(F.size("pitches"), F.lit(0)) > 0) & t["pitch_low"].isNotNull() & t["pitch_high"].isNotNull()
        inside, core = within("pitch_low", "pitch_high"), F.coalesce(within("core_low", "core_high"), F.lit(0.0))
        parts["pitch"] = F.when(known, _unit(0.62 * inside + 0.38 * core)).otherwise(0.0)
        status = F.when(~known, "unresolved").when((inside >= 0.75) & (core >= 0.25), "matched").when(inside > 0, "partial").otherwise("contradicted")
        whole = _unit(sum((t["weights"][i] * parts[k] for i, k in enumerate(WEIGHED)), F.lit(0.0)))
        missing = F.filter("_caps", lambda c: (c["missing"] != "pitch") | (status == "unresolved"))
        score = F.least(whole, F.coalesce(F.array_min(F.transform(missing, lambda c: c["cap"])), F.lit(1.0)))
        lane_status = F.when(clash, "contradicted").when(lanes >= 0.66, "matched").when(lanes >= 0.34, "partial").when(lanes <= 0.16, "contradicted").otherwise("unresolved")
        return F.struct((-F.round(score, 9)).alias("_order"), t["instrument_id"].alias("instrument_id"), t["family"].alias("family"), score.alias("score"), status.alias("pitch_status"), lane_status.alias("lane_status"), F.struct(*[parts[k].alias(k) for k in WEIGHED]).alias("parts"))

    kept = F.filter(F.transform("_templates", scored), lambda h: h["score"] >= least)
    ranked = F.transform(F.slice(F.sort_array(kept), 1, most), lambda h: F.struct(*[h[c].alias(c) for c in ("instrument_id", "family", "score", "pitch_status", "lane_status", "parts")]))
    return df.withColumn("ranked", ranked).drop("_e", "_lanes", "_top", "_classes", "_templates", "_caps", "_m", *VARIABLES)


def broad_families(found: DataFrame, least: float = LEAST, most: int = MOST_FAMILIES) -> DataFrame:
    """(track, segment, family, top, n, score, rank): families of the windows' hypotheses, best first."""
    long = found.select("track", "segment", F.posexplode("ranked").alias("k", "h")).select("track", "segment", "k", "h.family", "h.score")
    w = Window.partitionBy("track", "segment", "family").orderBy(F.desc("score"), "k")
    long = long.withColumn("_n", F.row_number().over(w))
    df = long.groupBy("track", "segment", "family").agg(F.max("score").alias("top"), F.count("*").alias("n"), F.avg(F.when(F.col("_n") <= 3, F.col("score"))).alias("best_three"))
    cap = dict(CAPS)["external"]
    df = df.withColumn("score", F.least(F.lit(cap), F.greatest(F.col("top") + 0.06, F.col("best_three") + 0.08))).where(F.col("score") >= least).drop("best_three")
    rank = F.row_number().over(Window.partitionBy("track", "segment").orderBy(F.round("score", 9).desc(), "family"))
    return df.withColumn("rank", rank).where(F.col("rank") <= most)


# The families and lanes of priors that speak for each candidate family.
RULES: dict[str, tuple[str, str]] = {
    "voice_like_foreground_line": ("voice, plucked_strings, bowed_strings, keyboard, electronic_fx", "foreground_contour_lane, harmonic_ridge_lane"),
    "low_body_layer": ("low_register, percussion, electronic_fx", "low_body_lane, pressure_peak_lane"),
    "rhythmic_pulse_layer": ("percussion, electronic_fx", "transient_plane_lane, pressure_peak_lane"),
    "harmonic_bed_layer": ("plucked_strings, bowed_strings, keyboard, voice, brass, woodwinds, electronic_fx", "harmonic_ridge_lane, foreground_contour_lane, diffuse_tail_lane"),
    "diffuse_texture_layer": ("electronic_fx, percussion", "noise_texture_lane, diffuse_tail_lane, spatial_spread_lane"),
    "guitar_like_plucked_melodic_layer": ("plucked_strings", "foreground_contour_lane, harmonic_ridge_lane, transient_plane_lane"),
    "piano_like_percussive_harmonic_layer": ("keyboard", "harmonic_ridge_lane, foreground_contour_lane, transient_plane_lane"),
    "bass_like_low_body_layer": ("low_register", "low_body_lane, pressure_peak_lane"),
    "drum_like_transient_pulse_layer": ("percussion", "transient_plane_lane, pressure_peak_lane, noise_texture_lane"),
    "synth_pad_like_sustained_harmonic_bed": ("electronic_fx, keyboard", "harmonic_ridge_lane, diffuse_tail_lane, spatial_spread_lane"),
    "string_like_sustained_harmonic_layer": ("bowed_strings", "harmonic_ridge_lane, foreground_contour_lane"),
    "brass_wind_like_sustained_lead_layer": ("brass, woodwinds", "foreground_contour_lane, harmonic_ridge_lane, pressure_peak_lane"),
    "electronic_lead_like_melodic_layer": ("electronic_fx, keyboard", "foreground_contour_lane, harmonic_ridge_lane, noise_texture_lane"),
    "reverb_tail_like_diffuse_field": ("electronic_fx", "diffuse_tail_lane, spatial_spread_lane"),
    "noise_riser_like_effect_flow": ("electronic_fx, percussion", "noise_texture_lane, spatial_spread_lane, pressure_peak_lane, transient_plane_lane"),
    "impact_fx_like_transient_burst": ("electronic_fx, percussion", "transient_plane_lane, pressure_peak_lane, low_body_lane"),
    "glitch_grain_like_texture_layer": ("electronic_fx, percussion", "noise_texture_lane, transient_plane_lane"),
}
PRIOR_FAMILIES = "voice, plucked_strings, bowed_strings, keyboard, brass, woodwinds, percussion, low_register, electronic_fx".split(", ")
#: Families that a window speaks for a little without any hypothesis, the least match that counts, how much it adds, and windows that a candidate keeps.
UNHEARD, MATCHED, BOOST, MOST_MATCHES = {"reverb_tail_like_diffuse_field": 0.20}, 0.34, 0.14, 8


def rules(spark: SparkSession) -> DataFrame:
    """(family, families, lanes, unheard): a row for each candidate family."""
    return spark.createDataFrame([(f, a.split(", "), b.split(", "), UNHEARD.get(f, 0.0)) for f, (a, b) in RULES.items()], "family string, families array<string>, lanes array<string>, unheard double")


def matches(windows: DataFrame, broad: DataFrame) -> DataFrame:
    """(track, family, segment, start_s, end_s, match): windows whose priors and lanes speak for a candidate family, from MATCHED on.

    The families of a window come together in a map first, so that rules meet windows and not pairs.
    """
    spark = windows.sparkSession
    held = broad.groupBy("track", "segment").agg(F.map_from_entries(F.collect_list(F.struct("family", "score"))).alias("_b"))
    df = windows.join(held, ["track", "segment"], "left")
    df = df.withColumns({"_lanes": F.map_from_arrays(F.array(*[F.lit(n) for n in LANES]), F.array(*LANES)), "_top": F.coalesce(F.split("dominant", ","), F.array().cast("array<string>"))})
    df = df.join(F.broadcast(_in_one(rules(spark), "_rules", "family")), F.lit(True)).select("track", "segment", "start_s", "end_s", "_b", "_lanes", "_top", F.explode("_rules").alias("r"))
    heard = F.coalesce(F.array_max(F.transform("r.families", lambda f: F.coalesce(F.try_element_at("_b", f), F.lit(0.0)))), F.lit(0.0))
    heard = F.when(heard > 0, heard).otherwise(F.col("r.unheard"))
    lanes = 0.48 * F.size(F.array_intersect("_top", "r.lanes")) / F.size("r.lanes") + 0.52 * F.coalesce(F.array_max(F.transform("r.lanes", lambda n: F.try_element_at("_lanes", n))), F.lit(0.0))
    df = df.select("track", F.col("r.family").alias("family"), "segment", "start_s", "end_s", _unit(0.66 * heard + 0.34 * _unit(lanes)).alias("match"))
    return df.where(F.col("match") >= MATCHED)


def best_matches(found: DataFrame, most: int = MOST_MATCHES) -> DataFrame:
    """The best windows of each candidate family of a track; ties go to the earlier."""
    rank = F.row_number().over(Window.partitionBy("track", "family").orderBy(F.round("match", 9).desc(), "segment"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def boosted(support: DataFrame, found: DataFrame) -> DataFrame:
    """support (track, segment, start_s, end_s, family, support) with `boost`, from the best matching window that overlaps the segment, and the support raised by it.

    Segments and windows meet by the seconds that they touch.
    """
    spans = lambda a, b: F.explode(F.sequence(F.floor(a), F.greatest(F.floor(a), F.ceil(b) - 1)))
    w = found.select("track", "family", F.col("start_s").alias("_a"), F.col("end_s").alias("_b"), "match").withColumn("_s", spans("_a", "_b"))
    s = support.select("track", "segment", "family", "start_s", "end_s").withColumn("_s", spans("start_s", "end_s"))
    best = s.join(w, ["track", "family", "_s"]).where("_a < end_s AND start_s < _b").groupBy("track", "segment", "family").agg(F.max("match").alias("_match"))
    df = support.join(best, ["track", "segment", "family"], "left").withColumn("boost", BOOST * F.coalesce("_match", F.lit(0.0))).drop("_match")
    return df.withColumn("support", _unit(F.col("support") + F.col("boost")))


def object_windows(scores: DataFrame, broad: DataFrame, families: list[tuple[str, str]], least: float, most: int = 12) -> DataFrame:
    """(track, object, family, windows, top): the windows that speak most for an object, by its families of priors.

    scores: (track, segment, family, score) of hypotheses and broad families; broad: the latter alone; families: (object, family) pairs.
    """
    of = F.broadcast(scores.sparkSession.createDataFrame(families, "object string, family string"))
    best = scores.join(of, "family").groupBy("track", "object", "segment").agg(F.max("score").alias("_s")).where(F.col("_s") >= least)
    rank = F.row_number().over(Window.partitionBy("track", "object").orderBy(F.round("_s", 9).desc(), "segment"))
    best = best.withColumn("_k", rank).where(F.col("_k") <= most).select("track", "object", "segment")
    return best.join(broad, ["track", "segment"]).join(of, ["object", "family"]).groupBy("track", "object", "family").agg(F.count("*").alias("windows"), F.max("score").alias("top"))


assert set(RULES) == set(FAMILIES)
