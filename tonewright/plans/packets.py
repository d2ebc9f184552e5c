"""Queries of nested packets, precedence of fields, lookups on lists and stored layers, with their SQL."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import packets as P
from ..operators import scorers as S
from ..session import table
from ..sources import sinks
from ..storage import shared_folder, stored
from . import bindings as B
from . import evidence as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# A segment's packet as text that both engines put together: bands as entries at several depths, in objects and lists, with terms from the segment's own labels.
_ENTRY = """'{{"term": "{0}", "qualitative_value": "', {0}, '"}}'"""
_PACKET = "concat(" + ", ".join([
    """'{"term": "', role, '", "space": {"brightness": '""", _ENTRY.format("brightness"), """', "nearness": '""", _ENTRY.format("nearness"),
    """'}, "motion": [[', '{"term": "', motion_band, '"}, 7, null], '""", _ENTRY.format("motion_band"), """', {"pressure": '""", _ENTRY.format("pressure_band"),
    """'}], "level": {"term": 3, "qualitative_value": null, "of": '""", _ENTRY.format("level"), """'}, "a/b": '""", """repeat('{"in": ', segment % 5)""", """'{"term": "', melody, '"}'""", "repeat('}', segment % 5)", "'}'",
]) + ")"
_BANDED = [E.BANDS]
PACKET_SQL = f", bd AS ({S.applied_sql(_BANDED, 'p')}), pk AS (SELECT track, segment, {_PACKET} AS packet FROM bd)"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.applied(stored(V.scored(spark, sf_dir)), _BANDED).select("track", "segment", F.expr(_PACKET).alias("packet"))
    return P.parsed(df.withColumn("key", F.struct("track", "segment")), "packet")


@query(V.on_scored(PACKET_SQL + f""", tr AS (SELECT track, json_extract_string(j.atom, '$') AS term FROM pk, json_tree(packet) j WHERE j.key = 'term' AND j.type = 'VARCHAR')
    SELECT track, term, count(*) AS n, CAST(row_number() OVER (PARTITION BY track ORDER BY count(*) DESC, term) AS INTEGER) AS rank FROM tr GROUP BY track, term QUALIFY rank <= {P.MOST_TERMS}"""))
def g32_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-32, F-26: the terms that stand most often in a track's packets, at any depth."""
    found = P.objects(packets(spark, sf_dir), "key").withColumn("track", F.col("key.track"))
    return P.term_counts(found, "track")


_WEIGHT = "CASE word " + " ".join(f"WHEN '{w}' THEN {x}" for w, x in E.WORD_WEIGHTS.items()) + " ELSE 0.2 END"


@query(V.on_scored(PACKET_SQL + f""", en AS (SELECT track, segment, coalesce(json_extract_string(j.value, '$'), '') AS word FROM pk, json_tree(packet) j WHERE j.key = 'qualitative_value')
    SELECT track, segment, round(CAST(avg({_WEIGHT}) AS DOUBLE), 6) AS score, count(*) AS n FROM en GROUP BY track, segment"""))
def f26_entry_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-26, G-34: the mean weight of the words in a segment's packet, at any depth."""
    out = P.entry_score(P.objects(packets(spark, sf_dir), "key"), "key", E.WORD_WEIGHTS)
    return out.select("key.track", "key.segment", F.round("score", 6).alias("score"), "n")


# Calibration: customers speak for segments, nations for stretches of tracks

FIELDS = ["dominant_object", "important_hearing", "texture_keywords", "human_note"]
_TOLD = {
    "dominant_object": "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '  ' ELSE concat(' object ', c_name) END",
    "important_hearing": "CASE WHEN c_custkey % 7 < 3 THEN concat('hearing ', c_name) END",
    "texture_keywords": "CASE WHEN c_custkey % 2 = 0 THEN concat('texture ', c_name) END",
    "human_note": "CASE WHEN c_custkey % 6 = 1 THEN concat('note ', c_name) END",
}
_PLACE = "c_custkey % 10 AS track, CAST(floor(c_custkey / 10) AS BIGINT) % 7 AS segment"
_SPAN = "n_nationkey % 10 AS track, n_nationkey AS place, CAST(n_regionkey AS DOUBLE) AS from_s, CAST(n_regionkey AS DOUBLE) + 1.5 AS to_s, concat('focus ', n_name) AS dominant_object, CASE WHEN n_nationkey % 2 = 0 THEN concat('macro ', n_name) END AS important_hearing, '' AS texture_keywords"


def _levels(spark: SparkSession, sf_dir: str, segments: DataFrame) -> list[tuple[str, DataFrame]]:
    told = lambda remainder, fields: table(spark, sf_dir, "customer").where(f"c_custkey % 4 = {remainder}").selectExpr(*_PLACE.split(", "), *[f"{_TOLD[f]} AS {f}" for f in fields])
    spans = table(spark, sf_dir, "nation").selectExpr(*[x.strip() for x in _SPAN.split(", ", 4)[:4]], "concat('focus ', n_name) AS dominant_object", "CASE WHEN n_nationkey % 2 = 0 THEN concat('macro ', n_name) END AS important_hearing", "'' AS texture_keywords")
    return [("override", told(0, FIELDS)), ("fallback", told(1, FIELDS)), ("macro", P.by_middle(segments, spans))]


def _min_row(name: str, remainder: int) -> str:
    fields = ", ".join(f"nullif(trim({_TOLD[f]}), '') AS {f}" for f in FIELDS)
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track, segment ORDER BY {", ".join(f"{f} NULLS FIRST" for f in FIELDS)}) AS k FROM (SELECT {_PLACE}, {fields} FROM customer WHERE c_custkey % 4 = {remainder})) WHERE k = 1)"""


_MACRO = ["dominant_object", "important_hearing", "texture_keywords"]
_CHOSEN = ", ".join(
    f"coalesce(o.{f}, b.{f}{f', nullif(trim(m.{f}), {chr(39) * 2})' if f in _MACRO else ''}, '') AS {f}, CASE WHEN o.{f} IS NOT NULL THEN 'override' WHEN b.{f} IS NOT NULL THEN 'fallback'{f' WHEN nullif(trim(m.{f}), {chr(39) * 2}) IS NOT NULL THEN {chr(39)}macro{chr(39)}' if f in _MACRO else ''} END AS {f}_from"
    for f in FIELDS
)


@query(V.on_scored(f""", {_min_row("ov_", 0)}, {_min_row("fb_", 1)}, sp_ AS (SELECT {_SPAN} FROM nation),
    ma_ AS (SELECT p.track, p.segment, sp_.* EXCLUDE (track) FROM p JOIN sp_ ON sp_.track = p.track AND from_s <= (start_s + end_s) / 2 AND (start_s + end_s) / 2 < to_s QUALIFY row_number() OVER (PARTITION BY p.track, p.segment ORDER BY place) = 1)
    SELECT p.track, p.segment, {_CHOSEN} FROM p LEFT JOIN ov_ o ON o.track = p.track AND o.segment = p.segment LEFT JOIN fb_ b ON b.track = p.track AND b.segment = p.segment LEFT JOIN ma_ m ON m.track = p.track AND m.segment = p.segment"""))
def j24_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-24, J-03, X-39: what people say of each segment, by field: for the segment, else as its fallback, else for the stretch that holds its middle."""
    segments = stored(B.segments(spark, sf_dir).select("track", "segment", "start_s", "end_s"))
    return P.preferred(segments.select("track", "segment"), _levels(spark, sf_dir, segments), ["track", "segment"], FIELDS)


# Lookups on lists of keys


@query("""WITH l AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), ['no such word', string_split(p_name, ' ')[1]]) AS keys FROM part),
    ix AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), wd AS (SELECT word, upper(word) AS term, length(word) AS letters FROM ix WHERE length(word) >= 5),
    m AS (SELECT p_partkey, string_agg(word || ':' || letters, ',' ORDER BY plc) AS found, string_agg(term, '; ' ORDER BY plc) FILTER (nth <= 2) AS phrase, count(*) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY plc) AS nth FROM (SELECT p_partkey, unnest(keys) AS word, generate_subscripts(keys, 1) AS plc FROM l) JOIN wd USING (word)) GROUP BY p_partkey)
    SELECT l.p_partkey, coalesce(found, '') AS found, coalesce(phrase, 'professional term anchor unavailable') AS phrase, CAST(coalesce(n, 0) AS INTEGER) AS n FROM l LEFT JOIN m USING (p_partkey)""")
def j13_term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-13, J-26, H-16: the terms of a list of keys in the list's order; keys without a term are left out, repeats stay."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    index = part.select(F.explode("w").alias("word")).distinct().where(F.length("word") >= 5).select("word", F.upper("word").alias("term"), F.length("word").alias("letters"))
    lists = part.select("p_partkey", F.concat("w", F.array(F.lit("no such word"), F.col("w")[0])).alias("keys"))
    df = P.looked_up(lists, ["p_partkey"], "keys", index, "word", ["term", "letters"])
    told = F.array_join(F.transform("found", lambda x: F.concat(x["word"], F.lit(":"), x["letters"].cast("string"))), ",")
    return df.select("p_partkey", told.alias("found"), P.phrase(F.col("found"), "term", 2).alias("phrase"), F.size("found").alias("n"))


# Layers


@query(V.on_scored(V.LANE_SQL + V.STATE_SQL + """SELECT 'lanes' AS layer, track, segment, lane AS name, round(score, 6) AS score FROM lane WHERE active
    UNION ALL SELECT 'states', track, segment, state, round(mixedness, 6) FROM state"""))
def k01_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-01, K-02: two layers, one of which replaces an earlier one of its name, written twice and read back."""
    lanes = stored(V.lanes(V.scored(spark, sf_dir)))
    states = V.states(lanes, V.lane_status(lanes))
    folder = f"{shared_folder(spark)}/layers-{spark.sparkContext.applicationId}-{crc32(sf_dir.encode())}"
    every = lanes.select("track", "segment", F.col("lane").alias("name"), F.round("score", 6).alias("score"), "active")
    sinks.upsert_layer(every.drop("active"), folder, "lanes")
    for _ in range(2):  # the second time changes nothing
        sinks.upsert_layer(every.where("active").drop("active"), folder, "lanes")
        sinks.upsert_layer(states.select("track", "segment", F.col("state").alias("name"), F.round("mixedness", 6).alias("score")), folder, "states")
    return sinks.read_layers(spark, folder, ["lanes", "states"])
