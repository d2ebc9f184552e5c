"""Sources: WAV audio, JSON packets, JSON lines, notes, lyrics and stems, all read by Spark from any store."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

# Alias keys of packets, suffixes and tokens of stem files.
DETECTION_LISTS = ("detections", "tracks", "events", "time_ranges", "stems", "classes", "recognitions")
LABEL_KEYS = ("family_hint", "label", "family", "name", "class", "track_family", "instrument_family", "instrument", "stem", "source", "class_name", "tag")
TOP_LABEL_KEYS = ("family_hint", "track_family", "instrument_family", "instrument", "stem", "source", "class_name", "label")
CONFIDENCE_KEYS = ("confidence", "score", "probability", "support")
NOTE_LISTS = ("notes", "events", "tracks", "segments", "detections")
STEM_SUFFIXES = ("wav", "flac", "mp3", "ogg", "m4a", "aif", "aiff")
STEM_FAMILIES = {"vocals": "voice_like", "vocal": "voice_like", "voice": "voice_like", "drums": "drum_like", "drum": "drum_like", "bass": "bass_like", "guitar": "guitar_like", "piano": "piano_like", "keys": "piano_like", "other": "mixed_bed"}
#: Seconds of audio in a row; long files become many rows.
CHUNK_SECONDS = 30

WAV_SCHEMA = "path string, sample_rate int, channels int, sample_width int, total_frames long, chunk int, start_frame long, left array<float>, right array<float>, status string"


def decode_pcm(data: bytes, width: int, channels: int) -> np.ndarray:
    """Samples in [-1, 1], one row for each frame."""
    if width == 1:
        flat = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        flat = np.frombuffer(data, "<i2").astype(np.float32) / 32768
    elif width == 3:
        raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = (((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / 8388608
    else:
        flat = (np.frombuffer(data, "<i4").astype(np.float64) / 2147483648).astype(np.float32)
    return np.clip(flat, -1, 1).reshape(-1, channels)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows, reason = [], ""
            try:
                with wave.open(io.BytesIO(content)) as w:
                    rate, channels, width, total = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
                    if w.getcomptype() != "NONE" or channels not in (1, 2) or width not in (1, 2, 3, 4):
                        raise wave.Error("unsupported layout")
                    step = rate * CHUNK_SECONDS
                    for k in range(max(1, -(-total // step))):
                        x = decode_pcm(w.readframes(step), width, channels)
                        rows.append((path, rate, channels, width, total, k, k * step, x[:, 0].tolist(), x[:, channels - 1].tolist(), "ok"))
            except (wave.Error, EOFError, ValueError) as e:
                reason = f"unreadable: {e}"
            rows = rows or [(path, None, None, None, None, 0, 0, None, None, reason)]
            names = [x.split(" ")[0] for x in WAV_SCHEMA.split(", ")]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.string()]
            for row in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of PCM audio, mono doubled to both channels; files that cannot be read give one row with the reason."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(_decoded, WAV_SCHEMA)


def channel_diagnostics(chunks: DataFrame) -> DataFrame:
    """Per file: mid and side energy, their ratio, and whether both channels are the same or silent."""
    total = lambda f: F.aggregate(F.zip_with("left", "right", f), F.lit(0.0), lambda a, v: a + v)
    rows = chunks.where("status = 'ok'").select(
        "path", F.size("left").alias("n"), total(lambda l, r: ((l + r) / 2) * ((l + r) / 2)).alias("mid"), total(lambda l, r: ((l - r) / 2) * ((l - r) / 2)).alias("side"),
        F.array_max(F.zip_with("left", "right", lambda l, r: F.abs(l - r))).alias("gap"),
    )
    out = rows.groupBy("path").agg((F.sum("mid") / F.sum("n")).alias("mid_energy"), (F.sum("side") / F.sum("n")).alias("side_energy"), F.max("gap").alias("max_gap"))
    ratio = F.col("side_energy") / (F.col("mid_energy") + 1e-12)
    return out.withColumn("side_ratio", ratio).withColumn("identical", (ratio <= 1e-6) | (F.col("max_gap") <= 1e-7)).withColumn("near_zero_side", ratio <= 0.003)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): whole text files without a leading byte-order mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^\ufeff", "").alias("value"))


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """(path, packet variant): whole JSON files whose root is an object; a leading byte-order mark is ignored, other files are left out."""
    text = _whole(spark, path)
    packet = F.try_parse_json("value")
    return text.withColumn("packet", packet).where(F.schema_of_variant("packet").startswith("OBJECT")).select("path", "packet")


def read_optional(spark: SparkSession, path: str) -> DataFrame:
    """read_packets(), or no rows where nothing is at the path."""
    try:
        return read_packets(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, packet variant")


#: What a calibration profile says of a segment, and of a stretch of a track.
CALIBRATED = ("dominant_object", "important_hearing", "texture_keywords", "human_note")


def _words(value: Column) -> Column:
    """A text, or a list's texts joined by commas; blank ones are left out."""
    items = F.try_variant_get(value, "$", "array<string>")
    joined = F.array_join(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""), ", ")
    return F.nullif(F.coalesce(joined, F.trim(F.try_variant_get(value, "$", "string"))), F.lit(""))


def calibration(packets: DataFrame, level: str) -> DataFrame:
    """(path, segment_id, fields of CALIBRATED) of a calibration profile's `segment_overrides` or `segment_fallback_notes`; missing ones hold nothing."""
    held = F.coalesce(F.try_variant_get("packet", f"$.{level}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = packets.select("path", F.explode(held).alias("segment_id", "_v"))
    return rows.select("path", "segment_id", *[_words(F.try_variant_get("_v", f"$.{f}", "variant")).alias(f) for f in CALIBRATED])


def macro_sections(packets: DataFrame) -> DataFrame:
    """(path, place, from_s, to_s, dominant_object, important_hearing, texture_keywords) of a profile's stretches; those without both times that are numbers are left out."""
    rows = packets.select("path", F.posexplode(F.try_variant_get("packet", "$.macro_sections", "array<variant>")).alias("place", "_v"))
    time = lambda k: F.coalesce(F.try_variant_get("_v", f"$.{k}", "double"), F.when(F.try_variant_get("_v", f"$.{k}", "variant").isNull(), 0.0))
    names = {"dominant_object": "focus", "important_hearing": "note", "texture_keywords": "keywords"}
    out = rows.select("path", "place", time("start_seconds").alias("from_s"), time("end_seconds").alias("to_s"), *[_words(F.try_variant_get("_v", f"$.{k}", "variant")).alias(n) for n, k in names.items()])
    return out.where("from_s IS NOT NULL AND to_s IS NOT NULL")


def section_aliases(packets: DataFrame) -> DataFrame:
    """(path, label, alias): the first of a label's aliases that is told."""
    held = F.coalesce(F.try_variant_get("packet", "$.section_aliases", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = packets.select("path", F.explode(held).alias("label", "_v"))
    own = F.when(F.schema_of_variant("_v") == "STRING", F.trim(F.try_variant_get("_v", "$", "string")))
    alias = F.coalesce(F.try_element_at(F.try_variant_get("_v", "$", "array<string>"), F.lit(1)), own)
    return rows.select("path", "label", F.nullif(alias, F.lit("")).alias("alias")).where("alias IS NOT NULL")


#: Characters of a context file that are shown.
MOST_CONTEXT = 20_000


def context_files(spark: SparkSession, path: str, most: int = MOST_CONTEXT) -> DataFrame:
    """(path, kind, body, shortened): whole files as JSON or text, the first `most` characters for readers."""
    text = _whole(spark, path)
    packet = F.try_parse_json("value")
    kind = F.when(packet.isNotNull(), "json").otherwise("text")
    body = F.when(packet.isNotNull(), F.to_json(packet)).otherwise(F.trim("value", F.lit(" \t\n\r\x0b\x0c")))
    return text.select("path", kind.alias("kind"), body.alias("_b")).select("path", "kind", F.substring("_b", 1, most).alias("body"), (F.length("_b") > most).alias("shortened"))


#: Lists of a lyric alignment, and what its anchors may be called by.
ALIGNMENT_LISTS = ("anchors", "alignment", "lines", "segments", "events")


def lyric_anchors(packets: DataFrame) -> DataFrame:
    """(path, start_s, end_s, label, function) of alignments; the words themselves are never read."""
    parts = None
    for name in ALIGNMENT_LISTS:
        items = packets.select("path", F.explode(F.try_variant_get("packet", f"$.{name}", "array<variant>")).alias("_v"))
        parts = items if parts is None else parts.unionByName(items)
    parts = parts.where(F.schema_of_variant("_v").startswith("OBJECT"))
    v, pair = F.col("_v"), F.try_variant_get("_v", "$.time_range", "array<double>")
    start, end = first_field(v, ("start_seconds", "start", "from"), "double"), first_field(v, ("end_seconds", "end", "to"), "double")
    told = lambda *keys: F.coalesce(*[F.nullif(F.trim(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) for k in keys])
    none = start.isNull() & end.isNull()
    return parts.select(
        "path",
        F.when(none, F.try_element_at(pair, F.lit(1))).otherwise(start).alias("start_s"),
        F.when(none, F.try_element_at(pair, F.lit(2))).otherwise(end).alias("end_s"),
        F.coalesce(told("label", "line_id", "section"), F.lit("lyric_anchor")).alias("label"),
        F.coalesce(told("function", "role"), F.lit("lyric timing anchor")).alias("function"),
    )


def first_field(packet: Column, keys: tuple[str, ...], kind: str) -> Column:
    """The first of several alias keys that is there and casts."""
    return F.coalesce(*[F.try_variant_get(packet, f"$.{k}", kind) for k in keys])


def detections(packets: DataFrame) -> DataFrame:
    """(path, family, confidence, start_s, end_s) from all alias lists of adapter packets and their own top-level label.

    Without a confidence that is a number a detection counts as sure.
    """
    parts = None
    for name in DETECTION_LISTS:
        items = packets.select("path", F.explode(F.try_variant_get("packet", f"$.{name}", "array<variant>")).alias("item"))
        parts = items if parts is None else parts.unionByName(items)
    parts = parts.unionByName(packets.select("path", F.col("packet").alias("item")).where(first_field(F.col("item"), TOP_LABEL_KEYS, "string").isNotNull()))
    item = F.col("item")
    times = F.try_variant_get(item, "$.time_range", "array<double>")
    return parts.select(
        "path", S.label(first_field(item, LABEL_KEYS, "string")).alias("family"), S.clamp(F.coalesce(first_field(item, CONFIDENCE_KEYS, "double"), F.lit(1.0))).alias("confidence"),
        F.coalesce(F.try_element_at(times, F.lit(1)), F.try_variant_get(item, "$.start_seconds", "double")).alias("start_s"),
        F.coalesce(F.try_element_at(times, F.lit(2)), F.try_variant_get(item, "$.end_seconds", "double")).alias("end_s"),
    ).where("family is not null")


def retained(found: DataFrame, least: float = 0.55) -> DataFrame:
    """(family, best, mean, n, tier): families with enough confidence; 0.75 and more is strong."""
    out = found.where(F.col("confidence") >= least).groupBy("family").agg(F.max("confidence").alias("best"), F.avg("confidence").alias("mean"), F.count("*").alias("n"))
    return out.withColumn("tier", F.when(F.col("best") >= 0.75, "strong").otherwise("moderate"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """(pitch, start_s, end_s, confidence) from CSV notes with a header, under any of their usual column names."""
    raw = spark.read.option("header", "true").csv(path)
    pick = lambda *names: F.coalesce(*[F.col(n).try_cast("double") for n in names if n in raw.columns], F.lit(None).cast("double"))
    return raw.select(pick("pitch", "pitch_midi", "midi", "note").alias("pitch"), pick("start_s", "start_time_s", "start", "start_seconds").alias("start_s"), pick("end_s", "end_time_s", "end", "end_seconds").alias("end_s"), pick("confidence", "amplitude", "velocity").alias("confidence"))


def read_note_items(spark: SparkSession, path: str) -> DataFrame:
    """(path, item variant) from JSON notes: the objects of the first of the usual lists that is there, or of a root list, else a root object itself."""
    root = _whole(spark, path).select("path", F.try_parse_json("value").alias("root"))
    lists = [F.try_variant_get("root", f"$.{n}", "array<variant>") for n in NOTE_LISTS]
    own = F.when(F.schema_of_variant("root").startswith("OBJECT"), F.array("root"))
    items = root.select("path", F.explode(F.coalesce(*lists, F.try_variant_get("root", "$", "array<variant>"), own)).alias("item"))
    return items.where(F.schema_of_variant("item").startswith("OBJECT"))


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields map): the fields of a JSON object as texts, or the lines KEY=VALUE of a file that is no JSON; of repeated keys the last counts."""
    text = _whole(spark, path).select("path", F.trim("value").alias("value"))
    pairs = F.transform(F.filter(F.split("value", r"\R"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: F.array_position(F.slice(keys, i + 2, F.size(pairs)), p["key"]) == 0)
    kind = F.schema_of_variant(F.try_parse_json("value"))
    json = F.coalesce(F.when(kind.startswith("OBJECT"), F.from_json("value", "map<string,string>")), F.create_map().cast("map<string,string>"))
    return text.select("path", F.when(kind.isNotNull(), json).otherwise(F.map_from_entries(last)).alias("fields"))


def lyric_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, lines): lines that are not blank; their text is not kept."""
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.when(F.trim("value") != "", 1)).alias("lines"))


def stems(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, family): audio files by the first token of their name that stands for a family."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    base = F.lower(F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1))
    families = F.create_map(*[F.lit(x) for pair in STEM_FAMILIES.items() for x in pair])
    tokens = F.filter(F.transform(F.split(base, r"[-_ ]"), lambda t: F.try_element_at(families, t)), lambda x: x.isNotNull())
    kept = names.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*STEM_SUFFIXES))
    return kept.select("path", base.alias("stem"), F.try_element_at(tokens, F.lit(1)).alias("family")).where("family is not null").dropDuplicates(["stem", "family"])
