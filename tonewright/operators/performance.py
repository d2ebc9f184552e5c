"""Performance cards: a gate for families that need recognition, evidence folded into functional families, and the behaviour that speaks for a card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import EFFECT, FAMILIES, FUNCTIONAL, INSTRUMENT, member

# Where the evidence of a family goes that is not recognised, the stream of each family, and the ways of playing by what its events say.
FALLBACK = {
    "guitar_like_plucked_melodic_layer": "harmonic_bed_layer",
    "piano_like_percussive_harmonic_layer": "harmonic_bed_layer",
    "synth_pad_like_sustained_harmonic_bed": "harmonic_bed_layer",
    "string_like_sustained_harmonic_layer": "harmonic_bed_layer",
    "brass_wind_like_sustained_lead_layer": "harmonic_bed_layer",
    "electronic_lead_like_melodic_layer": "harmonic_bed_layer",
    "bass_like_low_body_layer": "low_body_layer",
    "drum_like_transient_pulse_layer": "rhythmic_pulse_layer",
    "reverb_tail_like_diffuse_field": "diffuse_texture_layer",
    "noise_riser_like_effect_flow": "diffuse_texture_layer",
    "impact_fx_like_transient_burst": "rhythmic_pulse_layer",
    "glitch_grain_like_texture_layer": "diffuse_texture_layer",
}
SPECIFIC = [n for n, (group, _, _) in FAMILIES.items() if group in (INSTRUMENT, EFFECT)]
STREAM_OF = {
    "vocal_line": "voice_like_foreground_line",
    "low_foundation": "low_body_layer, bass_like_low_body_layer",
    "rhythm": "rhythmic_pulse_layer, drum_like_transient_pulse_layer, impact_fx_like_transient_burst",
    "texture": "diffuse_texture_layer, reverb_tail_like_diffuse_field, noise_riser_like_effect_flow, glitch_grain_like_texture_layer",
}
#: Ways of playing in their order: a word that the family's events must hold (or none), and the name.
MODES: dict[str, list[tuple[str | None, str]]] = {
    "voice_like_foreground_line": [("dense", "dense_pulsed_phrase"), ("compressed", "compressed_center_phrase"), ("release", "floating_release_phrase"), (None, "reciting_flow")],
    "low_body_layer": [("repeated_low_anchor", "repeated_low_anchor"), ("bass", "moving_low_body"), (None, "grounding_low_body")],
    "bass_like_low_body_layer": [("repeated_low_anchor", "repeated_low_anchor"), ("bass", "moving_bassline"), (None, "grounding_low_body")],
    "rhythmic_pulse_layer": [("sparse", "sparse_time_marker"), (None, "steady_pulse")],
    "drum_like_transient_pulse_layer": [("sparse", "sparse_time_marker"), (None, "impact_accent")],
    "harmonic_bed_layer": [("dark", "dark_stable_bed"), (None, "sustained_harmonic_field"), (None, "foreground_coupling")],
    "diffuse_texture_layer": [(None, "diffuse_tail"), ("release", "residual_air")],
    "guitar_like_plucked_melodic_layer": [(None, "plucked_melodic_flow"), ("dense", "riff_like_hook")],
    "piano_like_percussive_harmonic_layer": [(None, "key_struck_chordal_support"), ("rising|falling", "vocal_coupled_melody")],
    "synth_pad_like_sustained_harmonic_bed": [(None, "sustained_field")],
    "string_like_sustained_harmonic_layer": [(None, "sustained_field"), ("rising|falling", "counterline")],
    "brass_wind_like_sustained_lead_layer": [(None, "sustained_lead")],
    "electronic_lead_like_melodic_layer": [(None, "synth_lead_line"), ("rising", "bright_hook")],
    "reverb_tail_like_diffuse_field": [(None, "diffuse_tail")],
    "noise_riser_like_effect_flow": [(None, "transition_riser")],
    "impact_fx_like_transient_burst": [(None, "impact_burst")],
    "glitch_grain_like_texture_layer": [(None, "fragmented_texture_flow")],
}
STRENGTH = {"functional_fallback": 1, "weak": 1, "medium": 2, "strong": 3, "dominant": 4, "pronounced": 3, "moderate": 2, "external_supported": 3, "external_possible": 2}
CLAIM = {"weak": 1, "medium": 2, "strong": 3}
MOST_MATCHES, MOST_MODES = 8, 4
WORDS = sorted({w for steps in MODES.values() for words, _ in steps for w in (words or "").split("|") if w})

STREAM = member("family", STREAM_OF, "harmonic_bed")


def ranks(column: str, values: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{n}' THEN {x}" for n, x in values.items()) + " ELSE 0 END"


def modes_sql(joined: str) -> str:
    """The ways of playing of a family, out of columns that say whether its events hold a word."""
    cases = []
    for family, steps in MODES.items():
        names = ", ".join(f"CASE WHEN {' OR '.join(f'{joined}_{w}' for w in words.split('|'))} THEN '{n}' END" if words else f"'{n}'" for words, n in steps)
        cases.append(f"WHEN '{family}' THEN concat_ws(';', {names})")
    return f"CASE family {' '.join(cases)} END"


def gate_status(allowed: str) -> str:
    """What the gate says of a family, by a column that tells whether it is recognised."""
    names = ", ".join(repr(n) for n in SPECIFIC)
    return f"CASE WHEN family NOT IN ({names}) THEN 'functional_performance_allowed' WHEN {allowed} THEN 'allowed_by_external_strong_recognition' ELSE 'blocked_missing_external_strong_recognition' END"


def gated(candidates: DataFrame, recognised: DataFrame) -> DataFrame:
    """Candidates (track, family, rank, ..) that may be cards, and those that give their evidence to a functional family.

    Adds `status`, `candidate` (the family whose evidence it is) and `folded` (whether that went into another). Of the families
    that go into one, the best rank gives the evidence, whatever the order in which rows come; a functional family that
    is a candidate itself keeps its own card beside that.
    """
    told = recognised.select("track", "family").distinct().withColumn("_known", F.lit(True))
    df = candidates.join(told, ["track", "family"], "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    df = df.withColumns({"status": F.expr(gate_status("_known")), "candidate": F.col("family"), "folded": F.lit(False)})
    open_, shut = df.where("status NOT LIKE 'blocked%'"), df.where("status LIKE 'blocked%'")
    into = F.create_map(*[F.lit(x) for pair in FALLBACK.items() for x in pair])
    row = F.struct(*[c for c in df.columns if c not in ("track", "status", "folded", "_known")])
    first = shut.withColumn("_into", F.element_at(into, F.col("family"))).groupBy("track", "_into").agg(F.min_by(row, F.struct("rank", "family")).alias("_r"))
    kept = [c for c in candidates.columns if c not in ("track", "family", "claim")]
    folds = first.select("track", F.col("_into").alias("family"), *[F.col(f"_r.{c}").alias(c) for c in kept], F.lit("functional_fallback").alias("claim"), F.lit("functional_performance_allowed").alias("status"), F.col("_r.candidate").alias("candidate"), F.lit(True).alias("folded"))
    return open_.drop("_known").unionByName(folds.select(*open_.drop("_known").columns))


def suppressed(candidates: DataFrame, cards: DataFrame) -> DataFrame:
    """(track, family, folded_into, gives): candidates without a card of their own, and whether theirs is the evidence that was taken."""
    own = cards.where("NOT folded").select("track", "family")
    taken = cards.where("folded").select("track", F.col("candidate").alias("family"), F.lit(True).alias("gives"))
    into = F.create_map(*[F.lit(x) for pair in FALLBACK.items() for x in pair])
    df = candidates.select("track", "family").join(own, ["track", "family"], "left_anti").join(taken, ["track", "family"], "left")
    return df.select("track", "family", F.element_at(into, F.col("family")).alias("folded_into"), F.coalesce("gives", F.lit(False)).alias("gives"))


def targets() -> Column:
    """The families whose behaviour speaks for a card: its own, the one folded into it, and, for a functional family, all that would be."""
    under = {f: sorted(n for n, into in FALLBACK.items() if into == f) for f in FAMILIES if f not in SPECIFIC}
    more = F.coalesce(F.element_at(F.create_map(*[x for f, names in under.items() for x in (F.lit(f), F.array(*[F.lit(n) for n in names]).cast("array<string>"))]), F.col("family")), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array("family", "candidate"), more))


LOCALITY = "CASE WHEN continuity_kind = 'persistent' THEN 3 WHEN continuity_kind IN ('recurrent', 'intermittent') THEN 2 WHEN entry = 'local_burst' THEN 1 ELSE 0 END"


def behaviour_matches(cards: DataFrame, behaviour: DataFrame, most: int = MOST_MATCHES) -> DataFrame:
    """(track, family, folded, behaviour, by, rank, ..): the behaviour cards for each performance card, eight at most.

    A behaviour card (track, behaviour, claim, family_group, continuity_kind, entry, place) belongs to a card if it is of the
    same candidate or of a family that speaks for it: two joins on equality, the first of which counts where both hold.
    """
    mine = cards.select("track", "family", "folded", "candidate", targets().alias("_t"))
    by_id = mine.join(behaviour, (mine["track"] == behaviour["track"]) & (mine["candidate"] == behaviour["behaviour"])).select(mine["track"], "family", "folded", behaviour["behaviour"], F.lit(0).alias("by"))
    long = mine.withColumn("behaviour", F.explode("_t")).drop("_t", "candidate")
    by_family = long.join(behaviour.select("track", "behaviour"), ["track", "behaviour"]).select("track", "family", "folded", "behaviour", F.lit(1).alias("by"))
    pairs = by_id.unionByName(by_family).groupBy("track", "family", "folded", "behaviour").agg(F.min("by").alias("by"))
    df = pairs.join(behaviour, ["track", "behaviour"]).withColumns({"_claim": F.expr(ranks("claim", CLAIM)), "_near": F.expr(LOCALITY)})
    rank = F.row_number().over(Window.partitionBy("track", "family", "folded").orderBy(F.desc("_claim"), F.desc("_near"), "place"))
    return df.withColumn("rank", rank).where(F.col("rank") <= most).drop("_claim", "_near")


def primary_behaviour(found: DataFrame) -> DataFrame:
    """One behaviour for each card: functional families first, then claim, then whether it persists, then rank."""
    functional = (F.col("family_group") == FUNCTIONAL).cast("int")
    order = F.struct(-functional, -F.expr(ranks("claim", CLAIM)), -(F.col("continuity_kind") == "persistent").cast("int"), "rank")
    row = F.struct("behaviour", "by", "rank", "claim", "continuity_kind", "entry")
    return found.groupBy("track", "family", "folded").agg(F.min_by(row, order).alias("_r"), F.count("*").alias("matches")).select("track", "family", "folded", "matches", "_r.*")
