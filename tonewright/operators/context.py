"""What stands around windows and tracks: events beside windows, change words, gates of streams, identities out of nested answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least change that counts, and events that a window is told with.
CHANGE, MOST_EVENTS = 0.08, 6
# The descriptors (of the dimensions that it looks at) and objects that a stream may take up, those of which it needs one, and the fields of an answer.
COMPATIBLE = {
    "center_mid_lead": "focused, dark, bright, glassy, smooth, voice_like_or_lead_like".split(", "),
    "center_low_impact": "focused, grainy, sandy, low_impact_like".split(", "),
    "center_low_sustain": "warm, focused, bass_like".split(", "),
    "side_harmonic_space": "wide, diffuse, phase_colored, grainy, sandy, guitar_like, piano_like, pad_like".split(", "),
    "wide_diffuse_texture": "wet, reverberant, diffuse, phase_colored, wide, surrounding, grainy, sandy, reverb_air_or_haze_like, pad_like".split(", "),
    "residual_unassigned": [],
}
REQUIRED = {
    "center_mid_lead": ["voice_like_or_lead_like"],
    "center_low_impact": ["low_impact_like"],
    "center_low_sustain": ["bass_like"],
    "side_harmonic_space": "guitar_like, piano_like, pad_like, wide, diffuse, phase_colored".split(", "),
    "wide_diffuse_texture": "wet, reverberant, diffuse, phase_colored, wide, surrounding, reverb_air_or_haze_like".split(", "),
    "residual_unassigned": ["residual_runtime_required"],
}
DIRECT = {
    "title": ["title", "song_title", "recording_title"],
    "artist": ["artist", "artist_name", "recording_artist"],
    "album": ["album", "release"],
    "year": ["year", "release_year"],
    "match": ["confidence", "score", "match_score"],
}
#: Where the fields stand in an answer's first result, the nearer first.
NESTED = {
    "title": ["$.recordings[0].title", "$.title"],
    "artist": ["$.recordings[0].artists[0].name", "$.artist"],
    "album": ["$.recordings[0].releases[0].title", "$.album"],
    "year": ["$.recordings[0].releases[0].date", "$.year"],
    "match": ["$.score"],
}


def seconds(start: str, end: str) -> Column:
    """The seconds that a span touches, one a row; spans meet by them."""
    return F.explode(F.sequence(F.floor(start).cast("long"), F.greatest(F.floor(start), F.ceil(end) - 1).cast("long")))


def local_events(windows: DataFrame, events: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """(track, segment, n, events): events (track, start_s, end_s, event_id) that overlap a window, in their order; the first `most` by name."""
    w = windows.select("track", "segment", "start_s", "end_s").withColumn("_s", seconds("start_s", "end_s"))
    e = events.select("track", F.col("start_s").alias("_a"), F.col("end_s").alias("_b"), "event_id").withColumn("_s", seconds("_a", "_b"))
    met = w.join(e, ["track", "_s"]).where("_a < end_s AND start_s < _b AND _s = greatest(floor(start_s), floor(_a))")  # a pair counts in the first second that it shares
    rank = F.row_number().over(Window.partitionBy("track", "segment").orderBy("_a", "event_id"))
    met = met.withColumn("_k", rank).groupBy("track", "segment").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", "event_id"))))["event_id"].alias("_e"))
    out = windows.select("track", "segment").join(met, ["track", "segment"], "left")
    return out.select("track", "segment", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join("_e", ","), F.lit("")).alias("events"))


def changes(df: DataFrame, columns: list[str], track: str = "track", order: str = "segment", least: float = CHANGE) -> DataFrame:
    """Adds `<column>_change`: increases, decreases, stable, or none where nothing came before."""
    w = Window.partitionBy(track).orderBy(order)

    def word(c: str) -> Column:
        step = F.col(c) - F.lag(c).over(w)
        return F.when(step > least, "increases").when(step < -least, "decreases").when(F.lag(c).over(w).isNull(), "none").otherwise("stable")

    return df.withColumns({f"{c}_change": word(c) for c in columns})


def gated_streams(names: DataFrame) -> DataFrame:
    """(track, stream, before, passed, passed_targets, targets) out of a track's names (track, name), repeats and all.

    A stream takes up the names that it may; without one of those that it needs, it says only that more is required.
    """
    spark = names.sparkSession
    allowed = F.broadcast(spark.createDataFrame([(s, n, n in REQUIRED[s]) for s, some in COMPATIBLE.items() for n in some], "stream string, name string, required boolean"))
    names = names.distinct()
    hits = names.join(allowed, "name").groupBy("track", "stream").agg(F.array_sort(F.collect_list("name")).alias("_all"), F.array_sort(F.collect_list(F.when(F.col("required"), F.col("name")))).alias("_passed"))
    every = names.select("track").distinct().select("track", F.explode(F.array(*[F.lit(s) for s in COMPATIBLE])).alias("stream"))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    passed = F.coalesce(F.size("_passed") > 0, F.lit(False))
    return every.join(hits, ["track", "stream"], "left").select("track", "stream", joined("_all").alias("before"), passed.alias("passed"), joined("_passed").alias("passed_targets"), F.when(passed, joined("_all")).otherwise("stream_level_ome_required").alias("targets"))


def identities(df: DataFrame, text: str) -> DataFrame:
    """Adds DIRECT's fields and `direct`, out of a JSON answer of a lookup; what is no JSON holds nothing.

    An answer's own fields count if they tell a title or an artist, or if it has no results; else those of its first result.
    """
    value = F.try_parse_json(F.col(text))
    read = lambda v, path: F.try_variant_get(v, path, "string")
    told = lambda x: F.nullif(F.trim(x), F.lit(""))
    df = df.withColumns({"_v": value, "_b": F.try_variant_get(value, "$.results[0]", "variant")})
    own = {n: F.coalesce(*[told(read(F.col("_v"), f"$.{k}")) for k in keys]) for n, keys in DIRECT.items()}
    df = df.withColumns({f"_{n}": x for n, x in own.items()}).withColumn("direct", F.col("_title").isNotNull() | F.col("_artist").isNotNull() | F.col("_b").isNull())
    fields = {n: F.when(F.col("direct"), F.col(f"_{n}")).otherwise(F.coalesce(*[read(F.col("_b"), p) for p in NESTED[n]])) for n in DIRECT}
    return df.withColumns(fields).drop("_v", "_b", *[f"_{n}" for n in DIRECT])


# Notes, tags and fingerprints out of nested packets. The names under which a field may stand, the first told counts.
NOTE_FIELDS = {
    "start": ["start_seconds", "start_time", "start", "onset", "onset_seconds", "time"],
    "end": ["end_seconds", "end_time", "end", "offset", "offset_seconds"],
    "pitch": ["pitch", "midi_pitch", "note", "note_number"],
    "duration": ["duration", "duration_seconds"],
    "confidence": ["confidence", "probability", "score", "support"],
    "velocity": ["velocity", "amplitude", "loudness"],
}
NOTE_FAMILIES = ["track_family", "family_hint", "instrument_family", "instrument", "track_name"]
TAGS = {"title": ["title", "track"], "artist": ["artist", "performer"], "album_artist": ["album_artist", "albumartist"], "album": ["album"], "date": ["date", "year"], "year": ["year"]}
MOST_NOTES = 512


def number(value: Column, names: list[str]) -> Column:
    """The first of an object's fields that is a number, or a text that tells one."""
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", "double") for n in names])


def normal_notes(notes: DataFrame, key: str, note: str, confidence: float = 0.5, family: str = "unknown") -> DataFrame:
    """(key, family, start, end, pitch, velocity, confidence) of notes (key, note as VARIANT); what tells neither time nor pitch is no note.

    A note without an end lasts as long as it says, else not at all; without a confidence it takes the adapter's.
    """
    v = F.col(note)
    df = notes.select(key, *[number(v, names).alias(f"_{n}") for n, names in NOTE_FIELDS.items()], F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, f"$.{n}", "string")), F.lit("")) for n in NOTE_FAMILIES], F.lit(family)).alias("_f"))
    df = df.where("_start IS NOT NULL OR _end IS NOT NULL OR _pitch IS NOT NULL").withColumn("_start", F.coalesce("_start", F.lit(0.0)))
    end = F.coalesce("_end", F.col("_start") + F.coalesce("_duration", F.lit(0.0)))
    label = F.regexp_replace(F.lower(F.trim("_f")), "[ -]+", "_")
    return df.select(key, label.alias("family"), F.round("_start", 4).alias("start"), F.round(end, 4).alias("end"), F.round("_pitch", 4).alias("pitch"), F.round("_velocity", 4).alias("velocity"), F.round(F.coalesce("_confidence", F.lit(confidence)), 4).alias("confidence"))


def note_packets(normal: DataFrame, key: str) -> DataFrame:
    """(key, notes, status, families): what a packet of normal notes says of itself."""
    df = normal.groupBy(key).agg(F.count("*").alias("notes"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))
    return df.withColumn("status", F.lit("attached_transcription_notes"))


def metadata_tags(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds TAGS out of a VARIANT's `format.tags`, `tags` and the tags of its `streams`; later ones win, names fold case, blanks and dashes."""
    read = lambda path: F.try_variant_get(F.col(value), path, "map<string,string>")
    streams = F.coalesce(F.try_variant_get(F.col(value), "$.streams", "array<variant>"), F.array().cast("array<variant>"))
    maps = F.concat(F.array(read("$.format.tags"), read("$.tags")), F.transform(streams, lambda s: F.try_variant_get(s, "$.tags", "map<string,string>")))
    pairs = F.flatten(F.transform(maps, lambda m: F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>"))))
    named = F.transform(pairs, lambda e: F.struct(F.regexp_replace(F.lower(e["key"]), "[ -]", "_").alias("key"), e["value"].alias("value")))
    df = df.withColumn("_tags", named)
    last = lambda n: F.try_element_at(F.filter("_tags", lambda e: e["key"] == n)["value"], F.lit(-1))
    told = lambda n: F.nullif(F.trim(last(n)), F.lit(""))
    return df.withColumns({t: F.coalesce(*[told(n) for n in names]) for t, names in TAGS.items()}).drop("_tags")


def fingerprint(value: Column) -> Column:
    """status, duration and length of a fingerprint packet (a VARIANT, or null)."""
    text = F.coalesce(*[F.nullif(F.try_variant_get(value, f"$.{n}", "string"), F.lit("")) for n in ("fingerprint", "FINGERPRINT")])
    duration = F.coalesce(*[F.try_variant_get(value, f"$.{n}", "string") for n in ("duration", "DURATION")])
    status = F.when(value.isNull(), "not_attached").when(text.isNotNull(), "attached_fingerprint").otherwise("attached_without_fingerprint_field")
    return F.struct(status.alias("status"), duration.alias("duration"), F.coalesce(F.length(text), F.lit(0)).alias("length"))


# Words that a text for readers must not claim, and what it says instead, in their order.
SAFE_WORDS = {
    "source truth": "source certainty",
    "stem truth": "stem certainty",
    "original track": "original multitrack",
    "performer identity": "performer/person claim",
    "confirmed instrument": "settled instrument",
    "confirmed instruments": "settled instruments",
}


def safe_text(text: Column) -> Column:
    """A text without claims that it must not make, whatever their case; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for old, new in SAFE_WORDS.items():
        out = F.regexp_replace(out, f"(?i){old}", new)
    return out


def holds_claims(text: Column) -> Column:
    """Whether a text makes one of those claims."""
    return F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(SAFE_WORDS))


def behaviour_support(found: DataFrame, functional: str) -> DataFrame:
    """(track, family, folded, functional, candidates): the behaviour of a card that may shape its words, and that which only supports it, by rank."""
    names = lambda test: F.array_join(F.sort_array(F.collect_list(F.when(test, F.struct("rank", "behaviour"))))["behaviour"], ",")
    own = F.col("family_group") == functional
    return found.groupBy("track", "family", "folded").agg(names(own).alias("functional"), names(~own).alias("candidates"))


def stem_confidence(stem: Column, default: Column | float) -> Column:
    """The confidence of a separated stem: named voices, basses and drums at least .82, what is left over at most .62."""
    default = F.lit(default) if isinstance(default, (int, float)) else default
    return F.when(stem.isin("vocals", "vocal", "voice", "bass", "drums", "drum"), F.greatest(default, F.lit(0.82))).when(stem.isin("other", "accompaniment"), F.least(default, F.lit(0.62))).otherwise(default)
