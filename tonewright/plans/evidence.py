"""Queries of the evidence chain over segment profiles, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import scorers as S
from ..storage import stored
from . import bindings as B
from . import signal

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in columns)  # no negative zeros


SCORED = [*S.SEGMENT_STAGES, E.METRICS]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment profiles with space, objects, rules, skeleton and metrics."""
    return S.applied(B.segments(spark, sf_dir), SCORED)


def on_scored(body: str) -> str:
    return B.with_sql("seg", f", p AS ({S.applied_sql(SCORED, 'seg')}) {body}")


def unpivoted(names: list[str], source: str, key: str, value: str) -> str:
    """SQL of a long table; the columns named stay in the source."""
    return " UNION ALL ".join(f"SELECT *, '{n}' AS {key}, {n} AS {value} FROM {source}" for n in names)


def pairs(names: list[str], key: str, value: str) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias(key), F.col(n).alias(value)) for n in names])).alias("z")


# Segment profile

EDGED = [f"{c}_{x}" for c in B.EDGES for x in ("start", "end", "delta")]
PROFILE = [*B.MEANS, *B.HIGHEST, *B.RANGES, *EDGED, "density"]


@query(B.with_sql("seg", f"SELECT track, segment, {_r(*PROFILE)} FROM seg"))
def g01_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-01 to G-03, Q1: the statistics of each segment."""
    return B.rounded(B.segments(spark, sf_dir).select("track", "segment", *PROFILE))


@query(B.with_sql("seg", f"""SELECT track, segment, round(20 * log10(rms), 6) AS rms_dbfs, {_r('centroid', 'low', 'mid', 'high', 'side_ratio', 'phase', 'density', 'percussive', 'harmonic')} FROM seg"""))
def p01_public_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-01, F-09: the projection of a segment that reports show."""
    return B.rounded(B.segments(spark, sf_dir).selectExpr("track", "segment", "20 * log10(rms) AS rms_dbfs", "centroid", "low", "mid", "high", "side_ratio", "phase", "density", "percussive", "harmonic"))


@query(on_scored("SELECT track, segment, round(emission_strength, 6) AS emission_strength, directionality, emission_shape, " + _r("pressure_transfer", "spread_transform", "temporal_continuity", "transient_transfer", "masking_risk") + " FROM p"))
def x02_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-02, X-03: strength, direction and shape of emission, and five transfer scores."""
    return B.rounded(scored(spark, sf_dir).select("track", "segment", *S.EMISSION))


@query(on_scored("SELECT track, segment, melody, bass, note_density, phrase, harmony FROM p"))
def x08_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-08, F-02, F-08: five labels of a segment's outline."""
    return scored(spark, sf_dir).select("track", "segment", *S.SKELETON)


_SOURCES = " UNION ALL ".join(f"SELECT track, segment, {E.source_name(score)} AS source, {score} AS support, '{basis}' AS basis FROM p WHERE {score} > {least}" for score, (least, _, basis) in S.SOURCES.items())


@query(on_scored(f"""SELECT track, segment, source, round(support, 6) AS support, basis, CAST(row_number() OVER (PARTITION BY track, segment ORDER BY round(support, 9) DESC, source) AS INTEGER) AS rank FROM ({_SOURCES})"""))
def x09_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-09, T-02: ranked source hypotheses of a segment, four at most."""
    made = F.array(*[F.when(F.expr(f"{score} > {least}"), F.struct(F.expr(E.source_name(score)).alias("source"), F.col(score).alias("support"), F.lit(basis).alias("basis"))) for score, (least, _, basis) in S.SOURCES.items()])
    df = scored(spark, sf_dir).select("track", "segment", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("z")).select("track", "segment", "z.*")
    rank = F.row_number().over(Window.partitionBy("track", "segment").orderBy(F.round("support", 9).desc(), "source"))
    return B.rounded(df.withColumn("rank", rank))


_EVENTS = " UNION ALL ".join(f"SELECT track, segment, start_s, end_s, '{s}' AS stream, {s} AS score, {e} AS event FROM p WHERE {s} >= {S.STREAM_LEAST[s]}" for s, e in S.STREAM_EVENTS.items())


@query(on_scored(f"""SELECT track, segment, stream, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(score, 6) AS score, event, lpad(CAST(row_number() OVER (PARTITION BY track ORDER BY segment, stream) AS VARCHAR), 4, '0') AS ordinal FROM ({_EVENTS})"""))
def x10_stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-04, X-10, H-12, W-17: a symbolic event for each stream that is strong enough in a segment, numbered along the track."""
    made = F.array(*[F.when(F.expr(f"{s} >= {S.STREAM_LEAST[s]}"), F.struct(F.lit(s).alias("stream"), F.col(s).alias("score"), F.expr(e).alias("event"))) for s, e in S.STREAM_EVENTS.items()])
    df = scored(spark, sf_dir).select("track", "segment", "start_s", "end_s", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("z")).select("track", "segment", "start_s", "end_s", "z.*")
    number = F.row_number().over(Window.partitionBy("track").orderBy("segment", "stream"))
    return B.rounded(df.withColumn("ordinal", F.lpad(number.cast("string"), 4, "0")))


@query(on_scored("""SELECT track, relation, count(*) AS n, round(max(strength), 6) AS strongest FROM (""" + " UNION ALL ".join(f"SELECT track, '{n}' AS relation, strength_of_{n} AS strength FROM p WHERE {t}" for n, (t, _) in S.RELATIONS.items()) + """) GROUP BY track, relation QUALIFY row_number() OVER (PARTITION BY track ORDER BY count(*) DESC, relation) <= 5"""))
def g11_relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-11, P-13: how often each relation holds in a track, the five most frequent."""
    made = F.array(*[F.when(F.expr(t), F.struct(F.lit(n).alias("relation"), F.col(f"strength_of_{n}").alias("strength"))) for n, (t, _) in S.RELATIONS.items()])
    df = scored(spark, sf_dir).select("track", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("z")).select("track", "z.*")
    out = df.groupBy("track", "relation").agg(F.count("*").alias("n"), F.max("strength").alias("strongest"))
    return B.rounded(out.withColumn("_k", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("n"), "relation"))).where("_k <= 5").drop("_k"))


@query(on_scored("""SELECT track, count(*) AS segments, string_agg(role, '>' ORDER BY segment) AS sequence, count(DISTINCT role) AS roles, string_agg(CAST(segment AS VARCHAR), ',' ORDER BY segment) FILTER (role_confidence >= 0.5) AS sure FROM p GROUP BY track"""))
def g04_role_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-04, P-02: roles of a track in order, and the segments where they are sure; a track's segments are few."""
    rows = F.sort_array(F.collect_list(F.struct("segment", "role", "role_confidence")))
    df = scored(spark, sf_dir).groupBy("track").agg(F.count("*").alias("segments"), rows.alias("z"), F.countDistinct("role").alias("roles"))
    sure = F.array_join(F.transform(F.filter("z", lambda x: x["role_confidence"] >= 0.5), lambda x: x["segment"].cast("string")), ",")
    return df.select("track", "segments", F.array_join(F.transform("z", lambda x: x["role"]), ">").alias("sequence"), "roles", F.nullif(sure, F.lit("")).alias("sure"))


_STYLE_MEANS = ["rms", "low", "mid", "high", "centroid", "side_ratio", "flatness", "onset", "harmonic", "percussive"]
_STYLED = f"(SELECT track, {', '.join(f'avg({c}) AS {c}' for c in _STYLE_MEANS)}, CASE WHEN any_value(snapped) >= {S.FAST_BPM} THEN 1.0 ELSE 0.0 END AS fast FROM ser LEFT JOIN ({signal.ORACLES['a16_tempo']}) tempo USING (track) GROUP BY track)"


@query(B.with_sql("ser", f"""SELECT track, style, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(score, 9) DESC, style) AS rank FROM ({unpivoted(list(S.STYLES), f"({S.applied_sql([S.STYLES], _STYLED)})", "style", "score")})) WHERE rank <= 3"""))
def g05_style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-05: three best of five styles from a track's mean features and its estimated tempo; without a tempo none is fast."""
    df = B.series(spark, sf_dir).groupBy("track").agg(*[F.avg(c).alias(c) for c in _STYLE_MEANS]).join(signal.a16_tempo(spark, sf_dir), "track", "left")
    df = df.withColumn("fast", F.when(F.col("snapped") >= S.FAST_BPM, 1.0).otherwise(0.0))
    long = S.applied(df, [S.STYLES]).select("track", pairs(list(S.STYLES), "style", "score")).select("track", "z.*")
    return B.rounded(long.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(F.round("score", 9).desc(), "style"))).where("rank <= 3"))


@query(on_scored("""SELECT track, string_agg(tag, ';' ORDER BY tag) AS tags, count(*) AS n FROM (SELECT DISTINCT track, unnest(string_split(tags, ';')) AS tag FROM p) GROUP BY track"""))
def u01_tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U-01: all style tags of a track, sorted."""
    df = scored(spark, sf_dir).select("track", F.explode(F.split("tags", ";")).alias("tag")).groupBy("track").agg(F.array_sort(F.collect_set("tag")).alias("z"))
    return df.select("track", F.array_join("z", ";").alias("tags"), F.size("z").cast("long").alias("n"))


@query(on_scored(f"SELECT track, segment, {', '.join(E.BANDS)}, sentence FROM ({S.applied_sql([E.BANDS, E.SENTENCE], 'p')})"))
def f05_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-03, F-05, F-06, F-28: bands and tendencies of a segment's space, and the sentence that they make."""
    return S.applied(scored(spark, sf_dir), [E.BANDS, E.SENTENCE]).select("track", "segment", *E.BANDS, "sentence")


_WORDS = ["brightness", "nearness", "coherence", "level", "pressure_band", "motion_band"]
_MOMENT: S.Stage = {"moment": E.mean(*[f"CASE {c} {' '.join(f'WHEN {chr(39)}{w}{chr(39)} THEN {x}' for w, x in E.WORD_WEIGHTS.items())} ELSE 0.2 END" for c in _WORDS])}


@query(on_scored(f""", k AS (SELECT track, segment, moment + CASE WHEN segment = min(segment) OVER w OR segment = max(segment) OVER w THEN 0.25 ELSE 0.0 END AS score FROM ({S.applied_sql([E.BANDS, _MOMENT], 'p')}) WINDOW w AS (PARTITION BY track))
    SELECT track, segment, round(score, 6) AS score FROM k QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(score, 9) DESC, segment) <= 3"""))
def t05_key_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-34, T-05, P-15: the segments of a track whose words weigh most, first and last preferred."""
    w = Window.partitionBy("track")
    df = S.applied(scored(spark, sf_dir), [E.BANDS, _MOMENT])
    ends = (F.col("segment") == F.min("segment").over(w)) | (F.col("segment") == F.max("segment").over(w))
    df = df.select("track", "segment", (F.col("moment") + F.when(ends, 0.25).otherwise(0.0)).alias("score"))
    return B.rounded(df.withColumn("_k", F.row_number().over(w.orderBy(F.round("score", 9).desc(), "segment"))).where("_k <= 3").drop("_k"))


# Arrangement lanes

_LEAST = " ".join(f"WHEN '{n}' THEN {a}" for n, (a, _) in E.LANE_LEAST.items())
_UNSURE = " ".join(f"WHEN '{n}' THEN {b}" for n, (_, b) in E.LANE_LEAST.items())
_FLAGS: S.Stage = {"active": f"score >= CASE lane {_LEAST} END", "unsure": f"score >= CASE lane {_UNSURE} END AND score < CASE lane {_LEAST} END"}
_CONTRAST: S.Stage = {"relative": S.clamp("0.5 + CASE WHEN sd > 0.0001 THEN (v - mean) / sd ELSE 0 END / 3"), "entry": "greatest(0.0, v - before)", "leave": "greatest(0.0, before - v)"}
_AGAINST: list[S.Stage] = [_CONTRAST, {"score": S.clamp("0.40 * v + 0.42 * relative + 0.18 * least(1.0, entry * 2)")}, _FLAGS]
LANE_SQL = f""", l AS (SELECT track, segment, start_s, end_s, lane, v, v AS score FROM ({unpivoted(list(E.LANES), f"({S.applied_sql([E.LANES], 'p')})", "lane", "v")})), lane AS ({S.applied_sql([_FLAGS], "l")})"""


def long_lanes(df: DataFrame) -> DataFrame:
    return df.select("track", "segment", "start_s", "end_s", pairs(list(E.LANES), "lane", "v")).select("track", "segment", "start_s", "end_s", "z.*")


def lanes(profile: DataFrame, auditory: DataFrame | None = None) -> DataFrame:
    """Eight lanes of each segment of a scored profile: score, and whether it is active or ambiguous.

    `auditory` has a row for each segment (track, segment) with its auditory support in a column for each lane; the score takes it in.
    """
    df = S.applied(profile, [E.LANES])
    if auditory is None:
        return S.applied(long_lanes(df).withColumn("score", F.col("v")), [_FLAGS])
    heard = auditory.select("track", "segment", *[F.col(n).alias(f"heard_{n}") for n in E.LANES])
    rows = F.array(*[F.struct(F.lit(n).alias("lane"), F.col(n).alias("v"), F.col(f"heard_{n}").alias("auditory")) for n in E.LANES])
    df = df.join(heard, ["track", "segment"], "left").select("track", "segment", "start_s", "end_s", F.explode(rows).alias("z")).select("track", "segment", "start_s", "end_s", "z.*")
    return S.applied(df, [E.BLENDED, _FLAGS])


def blended_sql(auditory: str) -> str:
    return f""", l AS (SELECT track, segment, start_s, end_s, lane, v, auditory FROM ({unpivoted(list(E.LANES), f"({S.applied_sql([E.LANES], 'p')})", "lane", "v")}) LEFT JOIN (SELECT track, segment, lane, auditory FROM ({unpivoted(list(E.LANES), auditory, "lane", "auditory")})) USING (track, segment, lane)),
    l1 AS (SELECT *, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS sd, lag(v, 1, 0.0) OVER (PARTITION BY track, lane ORDER BY segment) AS before FROM l WINDOW w AS (PARTITION BY track, lane)),
    lane AS ({S.applied_sql([_CONTRAST, E.BLENDED, _FLAGS], "l1")})"""


def rolling_sql(source: str) -> str:
    return f""", l AS (SELECT track, segment, start_s, end_s, lane, v FROM ({unpivoted(list(E.LANES), source, "lane", "v")})),
    l1 AS (SELECT *, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS sd, lag(v, 1, 0.0) OVER (PARTITION BY track, lane ORDER BY segment) AS before FROM l WINDOW w AS (PARTITION BY track, lane)),
    lane AS ({S.applied_sql(_AGAINST, "l1")})"""


def rolling(windows: DataFrame) -> DataFrame:
    """Lanes of rolling windows with a support column for each: support against the track's own, entry, exit, score, and whether it is active or ambiguous."""
    return S.applied(contrasted(long_lanes(windows)), _AGAINST[1:])


def contrasted(rows: DataFrame) -> DataFrame:
    """Lanes with their value against the track's own, their entry and their exit."""
    w = Window.partitionBy("track", "lane")
    df = rows.withColumns({"mean": F.avg("v").over(w), "sd": F.stddev_pop("v").over(w), "before": F.lag("v", 1, 0.0).over(w.orderBy("segment"))})
    return S.applied(df, [_CONTRAST])


LANE_STATUS_SQL = """, status AS (SELECT track, lane, avg(score) AS mean_support, max(score) AS max_support, avg(CASE WHEN active THEN 1.0 ELSE 0.0 END) AS coverage,
    CASE WHEN avg(CASE WHEN active THEN 1.0 ELSE 0.0 END) >= 0.85 THEN 'background_continuous_support' WHEN bool_or(active) THEN 'tracked' ELSE 'not_stably_tracked' END AS status FROM lane GROUP BY track, lane)"""


def lane_status(rows: DataFrame) -> DataFrame:
    coverage = F.avg(F.col("active").cast("double"))
    status = F.when(coverage >= 0.85, "background_continuous_support").when(F.bool_or("active"), "tracked").otherwise("not_stably_tracked")
    return rows.groupBy("track", "lane").agg(F.avg("score").alias("mean_support"), F.max("score").alias("max_support"), coverage.alias("coverage"), status.alias("status"))


STATE_SQL = f"""{LANE_STATUS_SQL}, s0 AS (SELECT track, segment, min(start_s) AS start_s, min(end_s) AS end_s, count(*) FILTER (active) AS n_active, count(*) FILTER (unsure) AS n_unsure,
      string_agg(lane, ',' ORDER BY round(score, 9) DESC, lane) FILTER (active AND place <= 4) AS dominant, string_agg(lane, ',' ORDER BY lane) FILTER (active AND place <= 4 AND status <> 'background_continuous_support') AS signature
      FROM (SELECT lane.*, status, row_number() OVER (PARTITION BY track, segment, active ORDER BY round(score, 9) DESC, lane) AS place FROM lane JOIN status USING (track, lane)) GROUP BY track, segment),
    s1 AS (SELECT *, {S.clamp("CAST(n_active AS double) / 4 + CAST(n_unsure AS double) / 8")} AS mixedness FROM s0),
    state AS (SELECT *, {E.arrangement_state("n_active", "n_unsure", "mixedness")} AS state FROM s1)"""


def states(rows: DataFrame, status: DataFrame) -> DataFrame:
    """The arrangement state of each segment, from how many lanes are active or ambiguous, with its lanes best first."""
    of = F.row_number().over(Window.partitionBy("track", "segment", "active").orderBy(F.round("score", 9).desc(), "lane"))
    df = rows.join(status.select("track", "lane", "status"), ["track", "lane"]).withColumn("place", of)
    top = F.col("active") & (F.col("place") <= 4)
    best = F.sort_array(F.collect_list(F.when(top, F.struct("place", "lane"))))
    mine = F.array_sort(F.collect_list(F.when(top & (F.col("status") != "background_continuous_support"), F.col("lane"))))
    df = df.groupBy("track", "segment").agg(F.min("start_s").alias("start_s"), F.min("end_s").alias("end_s"), F.count_if("active").alias("n_active"), F.count_if("unsure").alias("n_unsure"), best.alias("_b"), mine.alias("_m"))
    joined = lambda a: F.nullif(F.array_join(a, ","), F.lit(""))
    df = df.withColumns({"dominant": joined(F.col("_b.lane")), "signature": joined(F.col("_m"))}).drop("_b", "_m")
    return S.applied(df, [{"mixedness": S.clamp("CAST(n_active AS double) / 4 + CAST(n_unsure AS double) / 8")}, {"state": E.arrangement_state("n_active", "n_unsure", "mixedness")}])


_ORDER = " ".join(f"WHEN '{n}' THEN {2 * i}" for i, n in enumerate(E.LANES))
_CHANGED = "state <> state_before AND state IN ('mixed_arrangement_zone', 'contrast_peak_zone', 'single_lane_focus')"
_NAMED = "concat({}, '_', CASE WHEN n < 1000 THEN lpad(CAST(n AS string), 3, '0') ELSE CAST(n AS string) END)"
_RANGE_SQL = """rg AS (SELECT track, lane, min(segment) AS segment, min(start_s) AS start_s, max(end_s) AS end_s, avg(score) AS mean
      FROM (SELECT *, segment - row_number() OVER (PARTITION BY track, lane, active ORDER BY segment) AS island FROM lane) WHERE active GROUP BY track, lane, island)"""
EVENT_SQL = f"""{STATE_SQL}, c AS (SELECT *, lag(state) OVER (PARTITION BY track ORDER BY segment) AS state_before, lag(segment) OVER (PARTITION BY track, signature ORDER BY segment) AS seen FROM state),
    own AS (SELECT lane.* FROM lane JOIN status USING (track, lane) WHERE status <> 'background_continuous_support'), {_RANGE_SQL},
    ev0 AS (SELECT track, segment, start_s, end_s, 'lane_entry_or_growth' AS kind, lane, greatest(score, entry) AS strength, CASE lane {_ORDER} END AS ord FROM own WHERE entry >= 0.16 AND v >= 0.34
      UNION ALL SELECT track, segment, start_s, end_s, 'lane_exit_or_reduction', lane, leave, CASE lane {_ORDER} END + 1 FROM own WHERE leave >= 0.16
      UNION ALL SELECT track, segment, start_s, end_s, 'mixed_state_change', 'multi_lane_contrast', mixedness, 16 FROM c WHERE {_CHANGED}
      UNION ALL SELECT track, segment, start_s, end_s, 'recurrence_of_prior_signature', 'multi_lane_contrast', mixedness, 17 FROM c WHERE signature IS NOT NULL AND segment - seen > 1),
    ev1 AS (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY track ORDER BY segment, ord) AS n FROM ev0
      UNION ALL SELECT track, segment, start_s, end_s, 'lane_presence_without_clear_delta', lane, mean, row_number() OVER (PARTITION BY track ORDER BY CASE lane {_ORDER} END) FROM
        (SELECT rg.* FROM rg JOIN status USING (track, lane) WHERE status = 'tracked' AND track NOT IN (SELECT track FROM ev0) QUALIFY row_number() OVER (PARTITION BY track, lane ORDER BY segment) = 1)),
    event AS (SELECT *, {_NAMED.format("kind").replace("string", "VARCHAR")} AS event_id FROM ev1)"""


def active_ranges(rows: DataFrame) -> DataFrame:
    """Runs of segments in which a lane is active, with their mean score."""
    island = F.col("segment") - F.row_number().over(Window.partitionBy("track", "lane").orderBy("segment"))
    runs = rows.where("active").withColumn("island", island).groupBy("track", "lane", "island")
    return runs.agg(F.min("segment").alias("segment"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.avg("score").alias("mean")).drop("island")


def _made(df: DataFrame, kind: str, lane: str, strength: str, order: str) -> DataFrame:
    return df.selectExpr("track", "segment", "start_s", "end_s", f"{kind} AS kind", f"{lane} AS lane", f"{strength} AS strength", f"{order} AS ord")


def events(rows: DataFrame) -> DataFrame:
    """Contrast events of rolling lanes: lanes that enter or leave, changes of state, signatures that come back; where a track has none, the lanes that it tracks."""
    status = stored(lane_status(rows))
    own = rows.join(status.where("status <> 'background_continuous_support'").select("track", "lane"), ["track", "lane"])
    w = Window.partitionBy("track").orderBy("segment")
    c = stored(states(rows, status)).withColumns({"state_before": F.lag("state").over(w), "seen": F.lag("segment").over(Window.partitionBy("track", "signature").orderBy("segment"))})
    out = _made(own.where("entry >= 0.16 AND v >= 0.34"), "'lane_entry_or_growth'", "lane", "greatest(score, entry)", f"CASE lane {_ORDER} END")
    out = out.unionByName(_made(own.where("leave >= 0.16"), "'lane_exit_or_reduction'", "lane", "leave", f"CASE lane {_ORDER} END + 1"))
    out = out.unionByName(_made(c.where(_CHANGED), "'mixed_state_change'", "'multi_lane_contrast'", "mixedness", "16"))
    out = stored(out.unionByName(_made(c.where("signature IS NOT NULL AND segment - seen > 1"), "'recurrence_of_prior_signature'", "'multi_lane_contrast'", "mixedness", "17")))
    first = active_ranges(rows).join(status.where("status = 'tracked'").select("track", "lane"), ["track", "lane"]).join(out.select("track"), "track", "left_anti")
    first = first.withColumn("_k", F.row_number().over(Window.partitionBy("track", "lane").orderBy("segment"))).where("_k = 1")
    last = _made(first, "'lane_presence_without_clear_delta'", "lane", "mean", f"CASE lane {_ORDER} END").withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy("ord")))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy("segment", "ord"))).unionByName(last)
    return out.withColumn("event_id", F.expr(_NAMED.format("kind"))).drop("ord", "n")


@query(on_scored(LANE_SQL + STATE_SQL + f""", {_RANGE_SQL},
    pe AS (SELECT rg.*, 'lane_entry_or_presence' AS kind, mean AS strength, lane AS named, 'entry' AS word, 0 AS part, CASE lane {_ORDER} END AS ord FROM rg JOIN status USING (track, lane) WHERE status <> 'background_continuous_support'
      UNION ALL SELECT track, 'multi_lane_contrast', segment, start_s, end_s, mixedness, state, mixedness, 'mixed', 'state', 1, 0 FROM state WHERE state IN ('mixed_arrangement_zone', 'contrast_peak_zone')),
    pn AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY part, ord, segment) AS n FROM pe)
    SELECT track, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, kind, lane, round(strength, 6) AS strength, {_NAMED.format("named || '_' || word").replace("string", "VARCHAR")} AS event_id FROM pn"""))
def x19_profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-19 where no rolling windows are at hand: one event for each active range of a lane that is not in the background, and one for each mixed segment."""
    rows = stored(lanes(scored(spark, sf_dir)))
    status = lane_status(rows)
    kept = active_ranges(rows).join(status.where("status <> 'background_continuous_support'").select("track", "lane"), ["track", "lane"])
    out = _made(kept, "'lane_entry_or_presence'", "lane", "mean", f"CASE lane {_ORDER} END").withColumns({"name": F.concat("lane", F.lit("_entry")), "part": F.lit(0)})
    mixed = states(rows, status).where("state IN ('mixed_arrangement_zone', 'contrast_peak_zone')")
    out = out.unionByName(_made(mixed, "state", "'multi_lane_contrast'", "mixedness", "0").withColumns({"name": F.lit("mixed_state"), "part": F.lit(1)}))
    out = out.withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy("part", "ord", "segment")))
    return B.rounded(out.select("track", "start_s", "end_s", "kind", "lane", "strength", F.expr(_NAMED.format("name")).alias("event_id")))


# Listening regions

_LOCATED = " ".join(f"WHEN '{n}' THEN {a}" for n, (a, _) in E.REGION_LEAST.items())
_MAYBE = " ".join(f"WHEN '{n}' THEN {b}" for n, (_, b) in E.REGION_LEAST.items())
REGION_SQL = f""", r AS (SELECT track, segment, start_s, end_s, region, score FROM ({unpivoted(list(E.REGIONS), f"({S.applied_sql([E.REGIONS], 'p')})", "region", "score")}))"""


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = S.applied(scored(spark, sf_dir), [E.REGIONS])
    return df.select("track", "segment", "start_s", "end_s", pairs(list(E.REGIONS), "region", "score")).select("track", "segment", "start_s", "end_s", "z.*")


@query(on_scored(REGION_SQL + "SELECT track, segment, region, round(score, 6) AS score FROM r"))
def x20_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-20, J-10: scores of eight regions of listening for each segment."""
    return B.rounded(regions(spark, sf_dir).select("track", "segment", "region", "score"))


@query(on_scored(REGION_SQL + f""", f AS (SELECT *, score >= CASE region {_LOCATED} END AS located FROM r),
    g AS (SELECT *, segment - row_number() OVER (PARTITION BY track, region, located ORDER BY segment) AS island FROM f),
    h AS (SELECT track, region, min(segment) AS first, max(segment) AS last, count(*) AS n, avg(score) AS mean, max(score) AS best, sum(score) AS total FROM g WHERE located GROUP BY track, region, island),
    top AS (SELECT track, region, 'located' AS status, first, last, n, mean, best FROM h QUALIFY row_number() OVER (PARTITION BY track, region ORDER BY n DESC, round(total, 9) DESC, first) <= 3),
    one AS (SELECT track, region, CASE WHEN score >= CASE region {_MAYBE} END THEN 'ambiguous' ELSE 'not_located' END AS status, segment AS first, segment AS last, 1 AS n, score AS mean, score AS best FROM f
      WHERE (track, region) NOT IN (SELECT (track, region) FROM top) QUALIFY row_number() OVER (PARTITION BY track, region ORDER BY round(score, 9) DESC, segment) = 1)
    SELECT track, region, status, first, last, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(best, 6) AS best FROM (SELECT * FROM top UNION ALL SELECT * FROM one)"""))
def x21_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-21, W-08, G-39: up to three runs of segments where a region is located; else its best segment, ambiguous or not located."""
    df = regions(spark, sf_dir).withColumn("located", F.expr(f"score >= CASE region {_LOCATED} END"))
    island = F.col("segment") - F.row_number().over(Window.partitionBy("track", "region", "located").orderBy("segment"))
    runs = df.withColumn("island", island).where("located").groupBy("track", "region", "island")
    runs = runs.agg(F.min("segment").alias("first"), F.max("segment").alias("last"), F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("best"), F.sum("score").alias("total"))
    rank = F.row_number().over(Window.partitionBy("track", "region").orderBy(F.desc("n"), F.round("total", 9).desc(), "first"))
    top = runs.withColumn("_k", rank).where("_k <= 3").select("track", "region", F.lit("located").alias("status"), "first", "last", "n", "mean", "best")
    whole = df.groupBy("track", "region").agg(F.bool_or("located").alias("any"), F.min_by(F.struct("segment", "score"), F.struct(-F.round("score", 9), F.col("segment"))).alias("b")).where("NOT any")
    status = F.when(F.expr(f"b.score >= CASE region {_MAYBE} END"), "ambiguous").otherwise("not_located")
    one = whole.select("track", "region", status.alias("status"), F.col("b.segment").alias("first"), F.col("b.segment").alias("last"), F.lit(1).cast("long").alias("n"), F.col("b.score").alias("mean"), F.col("b.score").alias("best"))
    return B.rounded(top.unionByName(one))


# Candidate families

_NAMES = list(E.FAMILIES)
_CAREFUL = ", ".join(repr(x) for x in E.CAREFUL)
_GROUP = f"CASE {' '.join(f'WHEN family = {n!r} THEN {g!r}' for n, (g, _, _) in E.FAMILIES.items())} END"
_FAMILY_STAGES = [E.FAMILY_TERMS, {**E.family_scores(), **E.family_hints()}]
_KEPT = ["start_s", "end_s", "centroid", "low", "mid", "high", "harmonic", "percussive", "pressure", "motion", "left_right", "width", "spread"]
_VARY = "(" + " + ".join(f"(max({c}) FILTER (WHERE on_) - min({c}) FILTER (WHERE on_)) / {5000.0 if c == 'centroid' else 1.0}" for c in ("centroid", "low", "mid", "high", "harmonic", "percussive")) + ") / 6"
_AGGREGATES = {
    "mean_support": "avg(support)",
    "active_mean": "avg(support) FILTER (WHERE on_)",
    "max_support": "max(support)",
    "coverage": "avg(CASE WHEN on_ THEN CAST(1 AS double) ELSE CAST(0 AS double) END)",
    "active": "count(*) FILTER (WHERE on_)",
    "variation": _VARY,
    "hinted": "bool_or(on_ AND hint > 0)",
    "first_start": "min(start_s) FILTER (WHERE on_)",
    "last_end": "max(end_s) FILTER (WHERE on_)",
    "song_start": "min(start_s)",
    "song_end": "max(end_s)",
    **{f"{c}_mean": f"avg({c}) FILTER (WHERE on_)" for c in ("low", "mid", "high", "harmonic", "percussive")},
    **{n: f"sum(greatest(0.05, support) * {c}) FILTER (WHERE on_) / sum(greatest(0.05, support)) FILTER (WHERE on_)" for n, c in {"pressure_mean": "pressure", "motion_mean": "motion", "left_right_mean": "left_right", "width_mean": "width", "spread_mean": "spread"}.items()},
}
FAMILY_SQL = f""", fam AS ({" UNION ALL ".join(f"SELECT track, segment, {', '.join(_KEPT)}, '{n}' AS family, {n} AS support, hint_{n} AS hint FROM ff" for n in _NAMES)})""".replace(", fam AS", f", ff AS ({S.applied_sql(_FAMILY_STAGES, 'p')}), fam AS", 1) + f""",
    act AS (SELECT *, {_GROUP} AS family_group, strong OR (NOT bool_or(strong) OVER (PARTITION BY track, family) AND row_number() OVER (PARTITION BY track, family ORDER BY round(support, 9) DESC, segment) = 1) AS on_
      FROM (SELECT *, support >= CASE WHEN family IN ({_CAREFUL}) THEN 0.42 ELSE 0.38 END AS strong FROM fam)),
    isl AS (SELECT track, family, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM (SELECT *, segment - row_number() OVER (PARTITION BY track, family, on_ ORDER BY segment) AS island FROM act) WHERE on_ GROUP BY track, family, island),
    run AS (SELECT track, family, max(n) AS longest, count(*) AS ranges FROM isl GROUP BY track, family),
    base AS (SELECT track, family, any_value(family_group) AS family_group, {", ".join(f"{e} AS {n}" for n, e in (_AGGREGATES | E.UNTOLD).items())} FROM act GROUP BY track, family),
    cand AS ({S.applied_sql(E.CLAIMS, "(SELECT * FROM base JOIN run USING (track, family))")})"""


def families(profile: DataFrame, raised: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Support of each candidate family in each segment of a scored profile, and whether it counts as active; `raised` may add to the support before that."""
    df = S.applied(profile, _FAMILY_STAGES)
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias("support"), F.col(f"hint_{n}").alias("hint")) for n in _NAMES])
    df = df.select("track", "segment", *_KEPT, F.explode(rows).alias("z")).select("track", "segment", *_KEPT, "z.*")
    df = df if raised is None else raised(df)
    df = df.withColumns({"family_group": F.expr(_GROUP), "strong": F.expr(f"support >= CASE WHEN family IN ({_CAREFUL}) THEN 0.42 ELSE 0.38 END")})
    w = Window.partitionBy("track", "family")
    best = F.row_number().over(w.orderBy(F.round("support", 9).desc(), "segment")) == 1
    return df.withColumn("on_", F.col("strong") | (~F.bool_or("strong").over(w) & best))


def ranges(rows: DataFrame) -> DataFrame:
    """Runs of active segments of each family."""
    island = F.col("segment") - F.row_number().over(Window.partitionBy("track", "family").orderBy("segment"))
    return rows.where("on_").withColumn("island", island).groupBy("track", "family", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("n")).drop("island")


def candidates(rows: DataFrame, runs: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """One row for each family of a track: support, continuity, timbre, claim with its cap, and score.

    `told` has a row for each track with the columns of E.UNTOLD that are known; what is not told is as if no layer stood beside.
    """
    base = rows.groupBy("track", "family").agg(F.first("family_group").alias("family_group"), *[F.expr(e).alias(n) for n, e in _AGGREGATES.items()])
    longest = runs.groupBy("track", "family").agg(F.max("n").alias("longest"), F.count("*").alias("ranges"))
    df = base.join(longest, ["track", "family"])
    df = df if told is None else df.join(told, "track", "left")
    known = [] if told is None else told.columns
    df = df.withColumns({c: F.coalesce(F.col(c), F.expr(e)) if c in known else F.expr(e) for c, e in E.UNTOLD.items()})
    return S.applied(df, E.CLAIMS)


@query(on_scored(FAMILY_SQL + "SELECT track, segment, family, round(support, 6) AS support, round(hint, 6) AS hint, on_ AS active FROM act"))
def x12_family_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-12, J-09, P-05, H-17: support of 17 families in each segment."""
    return B.rounded(families(scored(spark, sf_dir)).select("track", "segment", "family", "support", "hint", F.col("on_").alias("active")))


CLAIMED = ["mean_support", "active_mean", "max_support", "coverage", "variation", "claim_score", "candidate_score"]
LABELS = ["support_band", "continuity", "timbre", "dominant_band", "articulation", "raw_claim", "claim", "calibration"]


@query(on_scored(FAMILY_SQL + f"SELECT track, family, family_group, {_r(*CLAIMED)}, longest, ranges, {', '.join(LABELS)}, CAST(row_number() OVER (PARTITION BY track ORDER BY claim_rank DESC, round(mean_support, 9) DESC, round(max_support, 9) DESC, family) AS INTEGER) AS rank FROM cand WHERE max_support >= 0.38 OR claim <> 'weak'"))
def x14_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-14, X-15, X-29, P-06, T-04, G-08, G-18, G-19, W-07, W-16, H-19, Q8: candidates that are kept, in the order of their claims."""
    rows = stored(families(scored(spark, sf_dir)))
    df = candidates(rows, ranges(rows)).where("max_support >= 0.38 OR claim <> 'weak'")
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("claim_rank"), F.round("mean_support", 9).desc(), F.round("max_support", 9).desc(), "family"))
    return B.rounded(df.select("track", "family", "family_group", *CLAIMED, "longest", "ranges", *LABELS, rank.alias("rank")))


LANE_OF = [(f, x) for f, names in E.FAMILY_LANES.items() for x in names.split(", ")]
EVENT_AGGREGATES = {
    "entry_strength": "coalesce(max(strength) FILTER (WHERE kind = 'lane_entry_or_growth'), 0.0)",
    "pressure_strength": "coalesce(max(strength) FILTER (WHERE lane = 'pressure_peak_lane'), 0.0)",
    "tail_events": "count(*) FILTER (WHERE lane = 'diffuse_tail_lane')",
    "spread_events": "count(*) FILTER (WHERE lane = 'spatial_spread_lane')",
    "exits": "count(*) FILTER (WHERE kind = 'lane_exit_or_reduction')",
    "recurrences": "count(*) FILTER (WHERE kind = 'recurrence_of_prior_signature')",
}
BEHAVIOUR = ["overlap_count", *E.BEHAVIOUR, "behaviour_group"]


OBJECT_OF = [(o, f, kind) for o, (main, more, _) in E.SOURCE_OBJECTS.items() for kind, names in (("primary", main), ("supporting", more)) for f in names.split(", ")]
PRIOR_OF = [(o, f) for o, names in E.OBJECT_PRIORS.items() for f in names.split(", ")]
RIVALS = [(o, x) for o, names in E.CONFUSED.items() for x in names.split(", ")]
_PITCHED = ", ".join(f"'{o}'" for o, (_, _, needs) in E.SOURCE_OBJECTS.items() if needs)
CLAIM_SCORE = "CASE claim WHEN 'strong' THEN 0.82 WHEN 'medium' THEN 0.58 WHEN 'weak' THEN 0.30 WHEN 'dominant' THEN 0.90 WHEN 'pronounced' THEN 0.78 WHEN 'moderate' THEN 0.55 ELSE 0.0 END"


def source_objects(tracks: DataFrame, kept: DataFrame, priors: DataFrame | None = None, behaviour: DataFrame | None = None, performance: DataFrame | None = None, verified: DataFrame | None = None, unpitched: DataFrame | None = None) -> DataFrame:
    """How visible each source object of a track is, and with which it may be confused (four at most).

    kept: candidates (track, family, candidate_score). What else may speak: priors (track, segment, family, score) of windows, behaviour and
    performance cards (track, family, claim), verified families (track, family), and the tracks in which a pitch is missing (track). What is
    not given is as if there were none.
    """
    spark = tracks.sparkSession
    of = F.broadcast(spark.createDataFrame(OBJECT_OF, "object string, family string, part string"))
    prior_of = F.broadcast(spark.createDataFrame(PRIOR_OF, "object string, family string"))
    every = F.explode(F.array(*[F.lit(o) for o in E.SOURCE_OBJECTS])).alias("object")
    df = tracks.select("track").distinct().select("track", every)
    part = lambda p: F.max(F.when(F.col("part") == p, F.col("candidate_score")))
    df = df.join(kept.join(of, "family").groupBy("track", "object").agg(part("primary").alias("primary_score"), part("supporting").alias("supporting_score")), ["track", "object"], "left")
    scored = F.lit(0.0)
    if priors is not None:
        found = priors.join(prior_of, "family").groupBy("track", "object").agg(F.max("score").alias("prior_score")).where(F.col("prior_score") >= E.PRIOR_LEAST)
        df = df.join(found, ["track", "object"], "left")
    for name, cards in (("behaviour_score", behaviour), ("performance_score", performance)):
        if cards is not None:
            df = df.join(cards.join(of, "family").groupBy("track", "object").agg(F.max(F.expr(CLAIM_SCORE)).alias(name)), ["track", "object"], "left")
    if verified is not None:
        df = df.join(verified.join(of, "family").where("part = 'primary'").select("track", "object", F.lit(True).alias("verified")).distinct(), ["track", "object"], "left")
    if unpitched is not None:
        df = df.join(unpitched.select("track", F.lit(True).alias("missing_pitch")).distinct(), "track", "left")
    df = df.withColumns({"has_primary": F.col("primary_score").isNotNull(), "has_prior": F.col("prior_score").isNotNull() if priors is not None else F.lit(False), "needs_pitch": F.col("object").isin(*[o for o, (_, _, needs) in E.SOURCE_OBJECTS.items() if needs])})
    numbers = ["primary_score", "supporting_score", "prior_score", "behaviour_score", "performance_score"]
    df = df.withColumns({n: F.coalesce(n, scored) if n in df.columns else scored for n in numbers} | {n: F.coalesce(n, F.lit(False)) if n in df.columns else F.lit(False) for n in ("verified", "missing_pitch")})
    df = stored(S.applied(df, E.VISIBILITY))
    other = df.select("track", F.col("object").alias("other"), F.greatest("primary_score", "prior_score").alias("theirs"))
    near = df.join(F.broadcast(spark.createDataFrame(RIVALS, "object string, other string")), "object").join(other, ["track", "other"]).where("theirs >= greatest(0.28, raw_score - 0.16)")
    best_first = F.slice(F.sort_array(F.collect_list(F.struct((-F.round("theirs", 9)).alias("k"), F.col("other"))))["other"], 1, 4)
    near = near.groupBy("track", "object").agg(F.array_join(best_first, ",").alias("confusion"))
    return df.join(near, ["track", "object"], "left")


def objects_sql(priors: str | None = None, behaviour: str | None = None, performance: str | None = None, verified: str | None = None, unpitched: str | None = None) -> str:
    """source_objects() as CTEs o1 and q over seg and kept; the arguments name relations with its columns."""
    value = lambda made, empty, given: made if given else empty
    card = lambda source, name: f"LEFT JOIN (SELECT track, object, CAST(max({CLAIM_SCORE}) AS DOUBLE) AS {name} FROM {source} JOIN (SELECT DISTINCT object, family FROM of_) o USING (family) GROUP BY track, object) x_{name} USING (track, object)" if source else ""
    return f""", of_(object, family, part) AS (VALUES {", ".join(str(x) for x in OBJECT_OF)}), rival(object, other) AS (VALUES {", ".join(str(x) for x in RIVALS)}), po(object, family) AS (VALUES {", ".join(str(x) for x in PRIOR_OF)}),
    ob AS (SELECT track, unnest([{", ".join(f"'{o}'" for o in E.SOURCE_OBJECTS)}]) AS object FROM (SELECT DISTINCT track FROM seg)),
    o0 AS (SELECT track, object, coalesce(primary_score, 0.0) AS primary_score, coalesce(supporting_score, 0.0) AS supporting_score, {value("coalesce(prior_score, 0.0)", "0.0", priors)} AS prior_score, {value("coalesce(behaviour_score, 0.0)", "CAST(0.0 AS DOUBLE)", behaviour)} AS behaviour_score,
      {value("coalesce(performance_score, 0.0)", "0.0", performance)} AS performance_score, primary_score IS NOT NULL AS has_primary, {value("prior_score IS NOT NULL", "false", priors)} AS has_prior, object IN ({_PITCHED}) AS needs_pitch,
      {value(f"(track, object) IN (SELECT (track, object) FROM {verified} JOIN of_ USING (family) WHERE part = 'primary')", "false", verified)} AS verified, {value(f"track IN (SELECT track FROM {unpitched})", "false", unpitched)} AS missing_pitch
      FROM ob LEFT JOIN (SELECT track, object, max(candidate_score) FILTER (part = 'primary') AS primary_score, max(candidate_score) FILTER (part = 'supporting') AS supporting_score FROM kept JOIN of_ USING (family) GROUP BY track, object) c USING (track, object)
      {f"LEFT JOIN (SELECT track, object, max(score) AS prior_score FROM {priors} JOIN po USING (family) GROUP BY track, object HAVING max(score) >= {E.PRIOR_LEAST}) x USING (track, object)" if priors else ""} {card(behaviour, "behaviour_score")} {card(performance, "performance_score")}),
    o1 AS ({S.applied_sql(E.VISIBILITY, "o0")}),
    q AS (SELECT track, object, array_to_string(list(other ORDER BY round(theirs, 9) DESC, other)[:4], ',') AS confusion FROM (SELECT a.track, a.object, b.object AS other, greatest(b.primary_score, b.prior_score) AS theirs, a.raw_score
      FROM o1 a JOIN rival USING (object) JOIN o1 b ON a.track = b.track AND b.object = rival.other) WHERE theirs >= greatest(0.28, raw_score - 0.16) GROUP BY track, object)"""


KEPT_SQL = ", kept AS (SELECT * FROM cand WHERE max_support >= 0.38 OR claim <> 'weak')"


@query(on_scored(FAMILY_SQL + KEPT_SQL + objects_sql() + f""" SELECT track, object, {_r("primary_score", "supporting_score", "raw_score")}, visibility, confusion FROM o1 LEFT JOIN q USING (track, object)"""))
def x28_source_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-28, J-14, J-16, G-27, Q22: how visible each source object of a track is by its candidates alone, and with which it may be confused."""
    rows = stored(families(scored(spark, sf_dir)))
    kept = candidates(rows, ranges(rows)).where("max_support >= 0.38 OR claim <> 'weak'").select("track", "family", "candidate_score")
    return B.rounded(source_objects(rows, kept).select("track", "object", "primary_score", "supporting_score", "raw_score", "visibility", "confusion"))


# Descriptors

_PROXIES = [n for stage in E.PROXY_STAGES for n in stage]
_PROXY_SQL = f"({S.applied_sql([*E.PROXY_STAGES, E.DIMENSION_SCORES], 'p')})"


@query(on_scored(f"SELECT track, segment, {_r(*_PROXIES)} FROM {_PROXY_SQL}"))
def x30_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-30, F-11: descriptor proxies of each segment."""
    return B.rounded(S.applied(scored(spark, sf_dir), E.PROXY_STAGES).select("track", "segment", *_PROXIES))


@query(on_scored(f"SELECT track, segment, {_r(*E.DIMENSION_SCORES)}, {', '.join(f'{e} AS {n}' for n, e in E.SELECTED.items())} FROM {_PROXY_SQL}"))
def x30_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-30: scores of six descriptor dimensions and the descriptors chosen, or the best as an ambiguous one."""
    df = S.applied(scored(spark, sf_dir), [*E.PROXY_STAGES, E.DIMENSION_SCORES, E.SELECTED])
    return B.rounded(df.select("track", "segment", *E.DIMENSION_SCORES, *E.SELECTED))


_CROSSED = {n: E.intersection(tests) for n, tests in E.INTERSECTIONS.items()}


@query(on_scored(", d AS (SELECT * FROM " + _PROXY_SQL + ") " + " UNION ALL ".join(f"SELECT track, segment, '{n}' AS object, round({share}, 6) AS support, {status} AS status FROM d" for n, (share, status) in _CROSSED.items())))
def x31_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-31: which objects a segment's descriptors may point to."""
    df = S.applied(scored(spark, sf_dir), [*E.PROXY_STAGES, E.DIMENSION_SCORES])
    rows = F.array(*[F.struct(F.lit(n).alias("object"), F.expr(share).cast("double").alias("support"), F.expr(status).alias("status")) for n, (share, status) in _CROSSED.items()])
    return B.rounded(df.select("track", "segment", F.explode(rows).alias("z")).select("track", "segment", "z.*"))


@query(on_scored(", d AS (SELECT * FROM " + _PROXY_SQL + "), sel AS (" + " UNION ALL ".join(f"SELECT track, unnest(string_split(replace({e}, 'ambiguous_', ''), ';')) AS descriptor FROM d" for e in E.SELECTED.values()) + ") SELECT track, descriptor, count(*) AS n FROM sel GROUP BY track, descriptor"))
def g31_descriptor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-31: how often each descriptor stands in a track, ambiguous ones too."""
    df = S.applied(scored(spark, sf_dir), [*E.PROXY_STAGES, E.DIMENSION_SCORES, E.SELECTED])
    words = F.explode(F.split(F.concat_ws(";", *E.SELECTED), ";"))
    return df.select("track", words.alias("w")).groupBy("track", F.regexp_replace("w", "^ambiguous_", "").alias("descriptor")).agg(F.count("*").alias("n"))
