"""Queries of what stands around windows and tracks, with their SQL: outlines, events beside windows, change words, gates of streams, identities in nested answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import aggregates as G
from ..operators import context as C
from ..operators import evidence as E
from ..operators import scorers as S
from ..session import table
from ..storage import stored
from . import bindings as B
from . import evidence as V
from . import rolling as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Outline of a track

_COUNTS = ", ".join(f"count(*) FILTER ({s} >= {least}) AS {s}_events" for s, least in S.STREAM_LEAST.items())
_MODE = lambda c: f"(SELECT track, {c} AS most_{c} FROM (SELECT track, {c}, count(*) AS n, min(segment) AS first FROM p GROUP BY track, {c}) QUALIFY row_number() OVER (PARTITION BY track ORDER BY n DESC, first) = 1)"


@query(V.on_scored(f"""SELECT a.*, {", ".join(f"most_{c}" for c in S.SKELETON)} FROM (SELECT track, count(*) AS segments, {_COUNTS} FROM p GROUP BY track) a """ + " ".join(f"JOIN {_MODE(c)} m_{c} USING (track)" for c in S.SKELETON)))
def g14_symbolic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-14, G-20, G-37, Q5: events of each stream of a track, and the outline's most frequent labels, the one seen first on ties."""
    df = stored(V.scored(spark, sf_dir).select("track", "segment", *S.SKELETON, *S.STREAM_LEAST))
    out = df.groupBy("track").agg(F.count("*").alias("segments"), *[F.count_if(F.col(s) >= least).alias(f"{s}_events") for s, least in S.STREAM_LEAST.items()])
    for c in S.SKELETON:
        out = out.join(G.first_mode(df, ["track"], c, "segment").select("track", F.col(c).alias(f"most_{c}")), "track")
    return out


# Events beside windows


@query(B.with_sql("s", R.ROLLING_SQL + V.EVENT_SQL + """, mw AS (SELECT w.track, w.segment, e.event_id, row_number() OVER (PARTITION BY w.track, w.segment ORDER BY e.start_s, e.event_id) AS k, count(*) OVER (PARTITION BY w.track, w.segment) AS n
      FROM win w JOIN event e ON e.track = w.track AND e.start_s < w.end_s AND w.start_s < e.end_s)
    SELECT win.track, win.segment, coalesce(any_value(n), 0) AS n, coalesce(string_agg(event_id, ',' ORDER BY k) FILTER (k <= 6), '') AS events FROM win LEFT JOIN mw ON mw.track = win.track AND mw.segment = win.segment GROUP BY win.track, win.segment"""))
def j06_local_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-06: the first six contrast events that overlap each rolling window, and how many do."""
    lanes = R.rolling_lanes(spark, sf_dir)
    windows = lanes.select("track", "segment", "start_s", "end_s").distinct()
    return C.local_events(stored(windows), stored(V.events(lanes)))


# Change against the segment before

_CHANGES = ["pressure", "width", "spread", "motion", "envelopment", "distance", "height", "left_right"]


@query(V.on_scored("SELECT track, segment, " + ", ".join(f"CASE WHEN {c} - lag({c}) OVER o > {C.CHANGE} THEN 'increases' WHEN {c} - lag({c}) OVER o < -{C.CHANGE} THEN 'decreases' WHEN lag({c}) OVER o IS NULL THEN 'none' ELSE 'stable' END AS {c}_change" for c in _CHANGES) + " FROM p WINDOW o AS (PARTITION BY track ORDER BY segment)"))
def x32_relative_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-32: in words, how eight fields of a segment's space change against the segment before; the first has none before it."""
    return C.changes(V.scored(spark, sf_dir), _CHANGES).select("track", "segment", *[f"{c}_change" for c in _CHANGES])


# What streams may say

_SELECTED = " UNION ALL ".join(f"SELECT track, segment, unnest(string_split(replace({e}, 'ambiguous_', ''), ';')) AS name FROM d" for e in E.SELECTED.values())
_FOUND = " UNION ALL ".join(f"SELECT track, segment, '{n}' AS name FROM d WHERE {E.intersection(tests)[1]} IN ('supported', 'possible')" for n, tests in E.INTERSECTIONS.items())
_ALLOWED = ", ".join(f"('{s}', '{n}', {n in C.REQUIRED[s]})" for s, names in C.COMPATIBLE.items() for n in names)


@query(V.on_scored(f""", d AS (SELECT * FROM ({S.applied_sql([*E.PROXY_STAGES, E.DIMENSION_SCORES], "p")})), al(stream, name, required) AS (VALUES {_ALLOWED}), st(stream) AS (VALUES {", ".join(f"('{s}')" for s in C.COMPATIBLE)}),
    nm AS (SELECT track, name, count(*) AS n FROM ({_SELECTED} UNION ALL {_FOUND}) GROUP BY track, name),
    hi AS (SELECT track, stream, string_agg(name, ',' ORDER BY name) AS before, bool_or(required) AS passed, string_agg(name, ',' ORDER BY name) FILTER (required) AS passed_targets FROM nm JOIN al USING (name) GROUP BY track, stream)
    SELECT t.track, st.stream, coalesce(before, '') AS before, coalesce(passed, false) AS passed, coalesce(passed_targets, '') AS passed_targets, CASE WHEN passed THEN before ELSE 'stream_level_ome_required' END AS targets
    FROM (SELECT DISTINCT track FROM p) t CROSS JOIN st LEFT JOIN hi ON hi.track = t.track AND hi.stream = st.stream"""))
def p12_stream_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-12, J-25, U-04: which of a track's descriptors and objects a stream may take up, and whether it has the least evidence to say any."""
    df = stored(S.applied(V.scored(spark, sf_dir), [*E.PROXY_STAGES, E.DIMENSION_SCORES, E.SELECTED]))
    words = F.transform(F.split(F.concat_ws(";", *E.SELECTED), ";"), lambda w: F.regexp_replace(w, "^ambiguous_", ""))
    found = F.array_compact(F.array(*[F.when(F.expr(E.intersection(tests)[1]).isin("supported", "possible"), F.lit(n)) for n, tests in E.INTERSECTIONS.items()]))
    return C.gated_streams(df.select("track", F.explode(F.concat(words, found)).alias("name")))


# Identities

_ANSWER = """CASE WHEN c_custkey % 4 = 0 THEN concat('{"title": "', c_name, '", "artist_name": " ", "artist": "A', c_nationkey, '", "release_year": ', c_custkey, ', "score": 0.5}')
    WHEN c_custkey % 4 = 1 THEN concat('{"score": 1, "results": [{"score": 0.9, "title": "outer", "recordings": [{"title": "', c_name, '", "artists": [{"name": "N', c_nationkey, '"}], "releases": []}, {"title": "second"}]}]}')
    WHEN c_custkey % 4 = 2 THEN '{"results": [{"title": "only", "artist": "best", "year": 1999, "recordings": []}], "album": "direct"}' ELSE '{"album": "alone", "results": []}' END"""


@query(f"""WITH a AS (SELECT c_custkey, {_ANSWER} AS j FROM customer), x AS (SELECT *, json_extract(j, '$.results[0]') AS b, json_extract(j, '$.results[0].recordings[0]') AS r FROM a),
    d AS (SELECT *, {", ".join(f"coalesce({', '.join(f'nullif(trim(json_extract_string(j, {chr(39)}$.{k}{chr(39)})), {chr(39) * 2})' for k in keys)}) AS d_{n}" for n, keys in C.DIRECT.items())} FROM x),
    f AS (SELECT *, (d_title IS NOT NULL OR d_artist IS NOT NULL OR b IS NULL) AS direct FROM d)
    SELECT c_custkey, CASE WHEN direct THEN d_title ELSE coalesce(json_extract_string(r, '$.title'), json_extract_string(b, '$.title')) END AS title, CASE WHEN direct THEN d_artist ELSE coalesce(json_extract_string(r, '$.artists[0].name'), json_extract_string(b, '$.artist')) END AS artist,
      CASE WHEN direct THEN d_album ELSE coalesce(json_extract_string(r, '$.releases[0].title'), json_extract_string(b, '$.album')) END AS album, CASE WHEN direct THEN d_year ELSE coalesce(json_extract_string(r, '$.releases[0].date'), json_extract_string(b, '$.year')) END AS year,
      CASE WHEN direct THEN d_match ELSE json_extract_string(b, '$.score') END AS "match", direct FROM f""")
def f30_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-30, F-13: title, artist, album, year and confidence of an answer, from its own fields, else from its first result's first recording."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_ANSWER).alias("j"))
    return C.identities(df, "j").select("c_custkey", *C.DIRECT, "direct")


# Notes, tags, fingerprints

_NOTES = """concat('[', CASE WHEN c_custkey % 5 = 0 THEN '{"velocity": 3}' WHEN c_custkey % 5 = 1 THEN concat('{"onset": "', c_custkey % 97, '", "duration": 1.5, "note": ', c_nationkey + 40, '}') ELSE concat('{"start": ', c_custkey % 13, ', "offset_seconds": ', c_custkey % 13 + 2, ', "midi_pitch": 60.25, "instrument": " Lead-', c_nationkey % 3, ' x", "score": 0.75}') END,
    ', {"pitch": ', c_nationkey, '}, 7]')"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.try_parse_json(F.expr(_NOTES)).alias("v"))
    return C.normal_notes(df.select("c_custkey", F.explode(F.try_variant_get("v", "$", "array<variant>")).alias("n")), "c_custkey", "n")


def _note_sql() -> str:
    number = lambda names: f"coalesce({', '.join(f'TRY_CAST(json_extract_string(n, {chr(39)}$.{x}{chr(39)}) AS DOUBLE)' for x in names)})"
    family = ", ".join(f"nullif(trim(json_extract_string(n, '$.{x}')), '')" for x in C.NOTE_FAMILIES)
    fields = ", ".join(f"{number(names)} AS f_{k}" for k, names in C.NOTE_FIELDS.items())
    return f"""WITH a AS (SELECT c_custkey, unnest(json_extract({_NOTES}, '$[*]')) AS n FROM customer), b AS (SELECT c_custkey, {fields}, coalesce({family}, 'unknown') AS fam FROM a),
    c AS (SELECT *, coalesce(f_start, 0) AS s FROM b WHERE f_start IS NOT NULL OR f_end IS NOT NULL OR f_pitch IS NOT NULL),
    nn AS (SELECT c_custkey, regexp_replace(lower(trim(fam)), '[ -]+', '_', 'g') AS family, round(s, 4) AS start, round(coalesce(f_end, s + coalesce(f_duration, 0)), 4) AS "end", round(f_pitch, 4) AS pitch, round(f_velocity, 4) AS velocity, round(coalesce(f_confidence, 0.5), 4) AS confidence FROM c)"""


@query(_note_sql() + " SELECT * FROM nn")
def x36_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-36: notes of transcription packets with their times, pitch and confidence, by whichever names they come."""
    return _notes(spark, sf_dir)


@query(_note_sql() + " SELECT c_custkey, count(*) AS notes, string_agg(DISTINCT family, ',' ORDER BY family) AS families, 'attached_transcription_notes' AS status FROM nn GROUP BY c_custkey")
def x36_note_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-36: what a packet of notes says of itself."""
    return C.note_packets(_notes(spark, sf_dir), "c_custkey")


_TAGGED = """concat('{"format": {"tags": {"TITLE": "', c_name, '", "Album-Artist": "A', c_nationkey, '"}}, "tags": {"Title": "', CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE 'own' END, '", "performer": "P"}, "streams": [{"tags": {"year": "', c_custkey, '"}}, 5, {"tags": {"title": "stream', c_custkey % 2, '"}}], "fingerprint": "', repeat('x', CAST(c_custkey % 4 AS INT)), '", "DURATION": ', c_custkey, '}')"""


@query(f"""WITH a AS (SELECT c_custkey, {_TAGGED} AS j FROM customer)
    SELECT c_custkey, concat('stream', c_custkey % 2) AS title, 'P' AS artist, json_extract_string(j, '$.format.tags.Album-Artist') AS album_artist, NULL AS album, CAST(c_custkey AS VARCHAR) AS date, CAST(c_custkey AS VARCHAR) AS year,
      CASE WHEN json_extract_string(j, '$.fingerprint') = '' THEN 'attached_without_fingerprint_field' ELSE 'attached_fingerprint' END AS status, json_extract_string(j, '$.DURATION') AS duration, CAST(length(json_extract_string(j, '$.fingerprint')) AS INTEGER) AS length FROM a""")
def f29_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-29, F-31: tags of a recording out of its format, itself and its streams, the last of which wins, and its fingerprint."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.try_parse_json(F.expr(_TAGGED)).alias("v"))
    return C.metadata_tags(df, "c_custkey", "v").select("c_custkey", *C.TAGS, C.fingerprint(F.col("v")).alias("z")).select("c_custkey", *C.TAGS, "z.*")


# Texts for readers

_CLAIM = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' is the Source Truth, a STEM TRUTH' WHEN 1 THEN ' of confirmed Instruments and the original track' WHEN 2 THEN ' shows performer identity; confirmed instrument' ELSE '' END)"


def _safe_sql(text: str) -> str:
    for old, new in C.SAFE_WORDS.items():
        text = f"regexp_replace({text}, '{old}', '{new}', 'gi')"
    return text


@query(f"SELECT p_partkey, {_safe_sql(_CLAIM)} AS text, regexp_matches(lower({_CLAIM}), '{'|'.join(C.SAFE_WORDS)}') AS claimed FROM part")
def p17_safe_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-16, P-17: texts without claims that they must not make, and whether they made one."""
    text = F.expr(_CLAIM)
    return table(spark, sf_dir, "part").select("p_partkey", C.safe_text(text).alias("text"), C.holds_claims(text).alias("claimed"))


@query(V.on_scored("SELECT track, segment, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, role, round(role_confidence, 6) AS role_confidence, " + ", ".join(S.SKELETON) + " FROM p"))
def p03_section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-03: the outline of each segment with its place and role."""
    return B.rounded(V.scored(spark, sf_dir).select("track", "segment", "start_s", "end_s", "role", "role_confidence", *S.SKELETON))
