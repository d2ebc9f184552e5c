"""Queries of acoustic priors over rolling windows, with their SQL. Templates come from the brands of parts, notes from loud frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import priors as P
from ..operators import scorers as S
from ..session import table
from ..storage import stored
from . import bindings as B
from . import evidence as V
from . import rolling as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LANES = list(E.LANES)
WEIGHTS = [0.20, 0.15, 0.20, 0.15, 0.10, 0.20]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling windows with their metrics, a score for each lane, and the lanes that dominate: the active ones, else up to four of .45 or more."""
    df = stored(R.rolling_windows(spark, sf_dir))
    lanes = stored(V.rolling(df))
    wide = lanes.groupBy("track", "segment").agg(*[F.max(F.when(F.col("lane") == n, F.col("score"))).alias(n) for n in LANES])
    state = V.states(lanes, V.lane_status(lanes)).select("track", "segment", "dominant")
    best = F.slice(F.sort_array(F.array(*[F.when(F.col(n) >= 0.45, F.struct((-F.round(n, 9)).alias("k"), F.lit(n).alias("n"))) for n in LANES])), 1, 8)
    some = F.slice(F.filter(best, lambda x: x.isNotNull())["n"], 1, 4)
    out = df.drop(*LANES).join(wide, ["track", "segment"]).join(state, ["track", "segment"])
    return stored(out.withColumn("dominant", F.coalesce("dominant", F.nullif(F.array_join(some, ","), F.lit("")))))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template for each brand of parts, of which there are a few dozen at every scale; its number and its parts' least size say which classes it names."""
    b = F.substring("p_brand", 7, 9).cast("int")
    df = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("s")).select(F.col("p_brand").alias("instrument_id"), b.alias("b"), "s")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    named = {"family": pick(P.PRIOR_FAMILIES, F.col("b"))} | {kind: pick(list(P.CLASSES[kind]), F.col("b") + F.col("s") + i) for i, kind in enumerate(P.CLASSES)}
    lane = lambda k: pick(LANES, F.col("b") + k)
    low = (100 + F.col("b") % 6).cast("double")
    return df.select(
        "instrument_id", *[e.alias(n) for n, e in named.items()], F.array(lane(0), lane(3)).alias("likely"), F.array(lane(1)).alias("supporting"), F.array(lane(5)).alias("contradicting"),
        low.alias("pitch_low"), (low + 8).alias("pitch_high"), (low + 2).alias("core_low"), (low + 5).alias("core_high"), F.array(*[F.lit(w) for w in WEIGHTS]).alias("weights"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each frame with an onset of .5 or more, in tracks with an even number, at the pitch of the frame's centroid."""
    df = B.series(spark, sf_dir).where("onset >= 0.5 AND track % 2 = 0")
    pitch = F.round(69 + 12 * F.log2(F.col("centroid") / 440), 3)
    return df.select("track", F.col("t").alias("start"), (F.col("t") + 0.3).alias("end"), pitch.alias("pitch"))


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _class_sql(kind: str, name: str) -> str:
    weights, target, reach = P.parsed(P.CLASSES[kind][name])
    x = " + ".join(f"{w!r} * {v}" for w, v in zip(weights, P.VARIABLES, strict=True) if w)
    return S.clamp(x) if target is None else S.clamp(f"1 - abs({x} - {target}) / {reach}")


_TEMPLATE_SQL = f"""tp0 AS (SELECT p_brand AS instrument_id, CAST(substr(p_brand, 7) AS INTEGER) AS b, min(p_size) AS s FROM part GROUP BY p_brand),
    tp AS (SELECT instrument_id, {_list(P.PRIOR_FAMILIES)}[b % {len(P.PRIOR_FAMILIES)} + 1] AS family, {", ".join(f"{_list(list(P.CLASSES[k]))}[(b + s + {i}) % {len(P.CLASSES[k])} + 1] AS t_{k}" for i, k in enumerate(P.CLASSES))},
      [{_list(LANES)}[b % 8 + 1], {_list(LANES)}[(b + 3) % 8 + 1]] AS likely, [{_list(LANES)}[(b + 1) % 8 + 1]] AS supporting, [{_list(LANES)}[(b + 5) % 8 + 1]] AS contradicting, 100 + b % 6 AS low FROM tp0)"""
WINDOW_SQL = f"""{R.ROLLING_SQL}{V.STATE_SQL}, ww AS (SELECT win.* EXCLUDE ({", ".join(LANES)}), {", ".join(f"z.{n}" for n in LANES)}, coalesce(dominant, nullif(array_to_string(list_transform(list_sort(list_filter([{", ".join(f"{{'k': CASE WHEN z.{n} >= 0.45 THEN -round(z.{n}, 9) END, 'n': '{n}'}}" for n in LANES)}], lambda x: x.k IS NOT NULL))[:4], lambda x: x.n), ','), '')) AS dominant
      FROM win JOIN (SELECT track, segment, {", ".join(f"max(score) FILTER (lane = '{n}') AS {n}" for n in LANES)} FROM lane GROUP BY track, segment) z USING (track, segment) JOIN (SELECT track, segment, dominant FROM state) st USING (track, segment)),
    ew AS ({S.applied_sql(P.EVIDENCE, "ww")})"""
_LANE_VALUE = "CASE n " + " ".join(f"WHEN '{n}' THEN {n}" for n in LANES) + " END"
_OF = {k: f"CASE t_{k} " + " ".join(f"WHEN '{c}' THEN {_class_sql(k, c)}" for c in P.CLASSES[k]) + " END" for k in P.CLASSES}
_PARTS_SQL = ", ".join(f"{S.clamp(' + '.join(f'{w} * ({_OF[c]})' for c, w in names.items()))} AS p_{k}" for k, names in P.PARTS.items())
_VALUES = lambda names: f"list_transform({names}, lambda n: {_LANE_VALUE})"
HYPOTHESIS_SQL = f"""{WINDOW_SQL}, {_TEMPLATE_SQL},
    nt AS (SELECT track, t AS a, t + 0.3 AS z, round(69 + 12 * log2(centroid / 440), 3) AS pitch FROM ser WHERE onset >= 0.5 AND track % 2 = 0),
    pw AS (SELECT ew.track, ew.segment, list(pitch) AS pitches FROM ew JOIN nt ON nt.track = ew.track AND a < end_s AND start_s < z GROUP BY ew.track, ew.segment),
    h0 AS (SELECT ew.*, tp.*, pitches, coalesce(len(pitches), 0) > 0 AS known, {_PARTS_SQL}, coalesce(list_max({_VALUES("likely")}), 0) AS likes, coalesce(list_max({_VALUES("contradicting")}), 0) AS against, coalesce(list_avg({_VALUES("supporting")}), 0) AS helped,
      len(list_intersect(likely, string_split(coalesce(dominant, ''), ','))) AS shared, len(list_filter(pitches, lambda p: p >= low AND p <= low + 8)) / len(pitches) AS inside, len(list_filter(pitches, lambda p: p >= low + 2 AND p <= low + 5)) / len(pitches) AS core
      FROM ew LEFT JOIN pw USING (track, segment), tp),
    h1 AS (SELECT *, {S.clamp("0.72 * likes + 0.26 * helped + 0.08 * shared - 0.34 * against")} AS lanes0, against >= 0.62 AND likes < 0.25 AS clash, CASE WHEN known THEN {S.clamp("0.62 * inside + 0.38 * core")} ELSE 0 END AS p_pitch,
      CASE WHEN NOT known THEN 'unresolved' WHEN inside >= 0.75 AND core >= 0.25 THEN 'matched' WHEN inside > 0 THEN 'partial' ELSE 'contradicted' END AS pitch_status FROM h0),
    h2 AS (SELECT *, CASE WHEN clash THEN least(lanes0, 0.20) ELSE lanes0 END AS p_lanes, CASE WHEN clash THEN 'contradicted' WHEN lanes0 >= 0.66 THEN 'matched' WHEN lanes0 >= 0.34 THEN 'partial' WHEN lanes0 <= 0.16 THEN 'contradicted' ELSE 'unresolved' END AS lane_status FROM h1),
    h3 AS (SELECT *, least({S.clamp(" + ".join(f"{w} * p_{k}" for k, w in zip(P.WEIGHED, WEIGHTS, strict=True)))}, CASE WHEN pitch_status = 'unresolved' THEN 0.55 ELSE 0.68 END) AS score FROM h2),
    hy AS (SELECT *, row_number() OVER (PARTITION BY track, segment ORDER BY round(score, 9) DESC, instrument_id) AS rank FROM h3 WHERE score >= {P.LEAST} QUALIFY rank <= {P.MOST})"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(P.hypotheses(P.local_pitches(windows(spark, sf_dir), notes(spark, sf_dir)), templates(spark, sf_dir)))


@query(B.with_sql("ser", HYPOTHESIS_SQL + " SELECT track, segment, CAST(rank AS INTEGER) AS rank, instrument_id, family, round(score, 8) AS score, pitch_status, lane_status, " + ", ".join(f"round(p_{k}, 8) AS {k}" for k in P.WEIGHED) + " FROM hy"))
def x22_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-22 to X-25, J-08, H-37, H-38, Q20: the eight templates that a window's lanes, register, bands, envelope and noise speak for most."""
    df = ranked(spark, sf_dir).select("track", "segment", F.posexplode("ranked").alias("k", "h"))
    return df.select("track", "segment", (F.col("k") + 1).alias("rank"), "h.instrument_id", "h.family", F.round("h.score", 8).alias("score"), "h.pitch_status", "h.lane_status", *[F.round(f"h.parts.{k}", 8).alias(k) for k in P.WEIGHED])


BROAD_SQL = f"""{HYPOTHESIS_SQL}, bf0 AS (SELECT track, segment, family, max(score) AS top, count(*) AS n, least(0.68, greatest(max(score) + 0.06, avg(score) FILTER (k <= 3) + 0.08)) AS score
      FROM (SELECT *, row_number() OVER (PARTITION BY track, segment, family ORDER BY score DESC, rank) AS k FROM hy) GROUP BY track, segment, family),
    bf AS (SELECT *, row_number() OVER (PARTITION BY track, segment ORDER BY round(score, 9) DESC, family) AS rank FROM bf0 WHERE score >= {P.LEAST} QUALIFY rank <= {P.MOST_FAMILIES})"""


@query(B.with_sql("ser", BROAD_SQL + " SELECT track, segment, family, round(top, 5) AS top, n, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM bf"))
def g15_window_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-15: broad families of each window's hypotheses."""
    return B.rounded(P.broad_families(ranked(spark, sf_dir)), 5)


@query(B.with_sql("ser", BROAD_SQL + """, fc AS (SELECT track, family, count(*) AS windows FROM bf WHERE rank <= 2 GROUP BY track, family)
    SELECT track, family, windows, CAST(row_number() OVER (PARTITION BY track ORDER BY windows DESC, family) AS INTEGER) AS rank, (SELECT count(*) FROM hy WHERE hy.track = fc.track) AS hypotheses FROM fc"""))
def g16_family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-16: how many windows of a track a family leads (first or second), and how many hypotheses its windows keep."""
    found = ranked(spark, sf_dir)
    df = P.broad_families(found).where("rank <= 2").groupBy("track", "family").agg(F.count("*").alias("windows"))
    kept = found.groupBy("track").agg(F.sum(F.size("ranked")).cast("long").alias("hypotheses"))
    return df.join(kept, "track").withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("windows"), "family")))


def _target_sql() -> str:
    rows = ", ".join(f"('{f}', {_list(a.split(', '))}, {_list(b.split(', '))}, {P.UNHEARD.get(f, 0.0)})" for f, (a, b) in P.RULES.items())
    return f"ru(family, families, wanted, unheard) AS (VALUES {rows})"


MATCH_SQL = f"""{BROAD_SQL}, {_target_sql()},
    hd AS (SELECT ww.track, ww.segment, ru.family, max(bf.score) AS heard FROM ww, ru JOIN bf ON bf.track = ww.track AND bf.segment = ww.segment AND list_contains(ru.families, bf.family) GROUP BY ALL),
    mt0 AS (SELECT ww.track, ww.segment, start_s, end_s, ru.family, coalesce(heard, unheard) AS heard, {S.clamp(f"0.48 * len(list_intersect(wanted, string_split(coalesce(dominant, ''), ','))) / len(wanted) + 0.52 * coalesce(list_max({_VALUES('wanted')}), 0)")} AS lanes
      FROM ww CROSS JOIN ru LEFT JOIN hd ON hd.track = ww.track AND hd.segment = ww.segment AND hd.family = ru.family),
    mt AS (SELECT *, {S.clamp("0.66 * heard + 0.34 * lanes")} AS match FROM mt0 WHERE {S.clamp("0.66 * heard + 0.34 * lanes")} >= {P.MATCHED})"""


@query(B.with_sql("ser", MATCH_SQL + f""" SELECT track, family, segment, round(match, 5) AS match, CAST(row_number() OVER best AS INTEGER) AS rank FROM mt WINDOW best AS (PARTITION BY track, family ORDER BY round(match, 9) DESC, segment) QUALIFY row_number() OVER best <= {P.MOST_MATCHES}"""))
def j12_prior_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-12, X-13: the eight windows whose priors and lanes speak most for each candidate family."""
    found = ranked(spark, sf_dir)
    return P.best_matches(P.matches(found, P.broad_families(found))).select("track", "family", "segment", F.round("match", 5).alias("match"), "rank")


def boosted_families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Families with their support raised by priors, and what the cap of claims asks of each track."""
    found = ranked(spark, sf_dir)
    near = stored(P.matches(found, P.broad_families(found)))
    rows = stored(V.families(V.scored(spark, sf_dir), lambda df: P.boosted(df, near)))
    pitched = F.exists("ranked", lambda h: h["pitch_status"].isin("matched", "partial"))
    told = found.groupBy("track").agg(F.lit(True).alias("prior_available"), F.bool_or(pitched).alias("pitch_matched"))
    return rows, told


BOOSTED_SQL = MATCH_SQL + (
    V.FAMILY_SQL.replace("act AS (SELECT", f"""fq AS (SELECT fam.* EXCLUDE (support), {S.clamp(f"support + {P.BOOST} * coalesce(best, 0)")} AS support, {P.BOOST} * coalesce(best, 0) AS boost
      FROM fam LEFT JOIN (SELECT fam.track, fam.segment, fam.family, max(match) AS best FROM fam JOIN mt ON mt.track = fam.track AND mt.family = fam.family AND mt.start_s < fam.end_s AND fam.start_s < mt.end_s GROUP BY ALL) USING (track, segment, family)),
    act AS (SELECT""", 1)
    .replace("FROM fam)", "FROM fq)")
    .replace("false AS prior_available", "true AS prior_available")
    .replace("false AS pitch_matched", "bool_or(track IN (SELECT track FROM hy WHERE pitch_status IN ('matched', 'partial'))) AS pitch_matched")
)


@query(V.on_scored(BOOSTED_SQL + "SELECT track, segment, family, round(boost, 5) AS boost, round(support, 5) AS support, on_ AS active FROM act"))
def j11_boosted_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-11, X-13: support of candidate families raised by the best matching window that overlaps the segment."""
    rows, _ = boosted_families(spark, sf_dir)
    return rows.select("track", "segment", "family", F.round("boost", 5).alias("boost"), F.round("support", 5).alias("support"), F.col("on_").alias("active"))


@query(V.on_scored(BOOSTED_SQL + f"SELECT track, family, family_group, {', '.join(f'round({c}, 5) AS {c}' for c in V.CLAIMED)}, longest, ranges, {', '.join(V.LABELS)}, CAST(row_number() OVER (PARTITION BY track ORDER BY claim_rank DESC, round(mean_support, 9) DESC, round(max_support, 9) DESC, family) AS INTEGER) AS rank FROM cand WHERE max_support >= 0.38 OR claim <> 'weak'"))
def x15_capped_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-13 to X-15 beside priors: candidates with raised support, whose strong claims are capped in tracks without a matched pitch."""
    rows, told = boosted_families(spark, sf_dir)
    df = V.candidates(rows, V.ranges(rows), told).where("max_support >= 0.38 OR claim <> 'weak'")
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("claim_rank"), F.round("mean_support", 9).desc(), F.round("max_support", 9).desc(), "family"))
    return df.select("track", "family", "family_group", *[F.round(c, 5).alias(c) for c in V.CLAIMED], "longest", "ranges", *V.LABELS, rank.alias("rank"))


_OBJECT_SQL = BOOSTED_SQL + V.KEPT_SQL + """, pf AS (SELECT track, segment, family, score FROM hy UNION ALL SELECT track, segment, family, score FROM bf), up AS (SELECT DISTINCT track FROM hy WHERE pitch_status = 'unresolved'),
    rk AS (SELECT DISTINCT CAST(s_suppkey % 10 AS INTEGER) AS track, [""" + ", ".join(f"'{n}'" for n in E.FAMILIES) + f"][s_suppkey % {len(E.FAMILIES)} + 1] AS family FROM supplier WHERE (CAST(s_acctbal AS DOUBLE) + 1000) / 11000 >= 0.97)" + V.objects_sql(priors="pf", behaviour="kept", verified="rk", unpitched="up")


@query(V.on_scored(_OBJECT_SQL + " SELECT track, object, round(prior_score, 5) AS prior_score, round(behaviour_score, 5) AS behaviour_score, round(raw_score, 5) AS raw_score, round(confidence, 5) AS confidence, raw_visibility, visibility, capped, verified, missing_pitch, confusion FROM o1 LEFT JOIN q USING (track, object)"))
def x28_verified_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-28, J-15, G-29: source objects by candidates, prior windows, claims and recognised families, and their cap where no pitch is at hand."""
    from .performance import recognised

    found = ranked(spark, sf_dir)
    broad = stored(P.broad_families(found))
    near = stored(P.matches(found, broad))
    rows = stored(V.families(V.scored(spark, sf_dir), lambda df: P.boosted(df, near)))
    status = F.transform("ranked", lambda h: h["pitch_status"])
    told = found.groupBy("track").agg(F.lit(True).alias("prior_available"), F.bool_or(F.arrays_overlap(status, F.array(F.lit("matched"), F.lit("partial")))).alias("pitch_matched"))
    kept = stored(V.candidates(rows, V.ranges(rows), told).where("max_support >= 0.38 OR claim <> 'weak'"))
    exact = found.select("track", "segment", F.explode("ranked").alias("h")).select("track", "segment", "h.family", "h.score")
    unpitched = found.where(F.array_contains(status, "unresolved")).select("track").distinct()
    df = V.source_objects(rows, kept, priors=exact.unionByName(broad.select("track", "segment", "family", "score")), behaviour=kept.select("track", "family", "claim"), verified=recognised(spark, sf_dir), unpitched=unpitched)
    return df.select("track", "object", *[F.round(c, 5).alias(c) for c in ("prior_score", "behaviour_score", "raw_score", "confidence")], "raw_visibility", "visibility", "capped", "verified", "missing_pitch", "confusion")


@query(V.on_scored(BOOSTED_SQL + f""", po(object, family) AS (VALUES {", ".join(str(x) for x in V.PRIOR_OF)}), ws AS (SELECT track, segment, family, max(score) AS score FROM (SELECT track, segment, family, score FROM hy UNION ALL SELECT track, segment, family, score FROM bf) GROUP BY ALL),
    ow AS (SELECT * FROM (SELECT track, object, segment, max(score) AS score FROM ws JOIN po USING (family) GROUP BY track, object, segment) WHERE score >= {E.PRIOR_LEAST} QUALIFY row_number() OVER (PARTITION BY track, object ORDER BY round(score, 9) DESC, segment) <= 12)
    SELECT ow.track, ow.object, bf.family, count(*) AS windows, round(max(bf.score), 5) AS top FROM ow JOIN bf ON bf.track = ow.track AND bf.segment = ow.segment JOIN po ON po.object = ow.object AND po.family = bf.family GROUP BY ow.track, ow.object, bf.family"""))
def g29_prior_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-29, J-15: of the twelve windows that speak most for a source object, how many each of its families has, and its best score."""
    found = ranked(spark, sf_dir)
    broad = stored(P.broad_families(found).select("track", "segment", "family", "score"))
    exact = found.select("track", "segment", F.explode("ranked").alias("h")).select("track", "segment", "h.family", "h.score")
    return B.rounded(P.object_windows(exact.unionByName(broad), broad, V.PRIOR_OF, E.PRIOR_LEAST), 5)


@query(B.with_sql("ser", MATCH_SQL + f""", bm_ AS (SELECT track, family, segment FROM mt QUALIFY row_number() OVER (PARTITION BY track, family ORDER BY round(match, 9) DESC, segment) <= {P.MOST_MATCHES})
    SELECT m.track, m.family, bf.family AS prior_family, count(*) AS windows FROM bm_ m JOIN bf ON bf.track = m.track AND bf.segment = m.segment AND bf.rank <= 4 GROUP BY m.track, m.family, bf.family"""))
def g17_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-17: in how many of its best windows a candidate family meets each family of priors."""
    found = ranked(spark, sf_dir)
    broad = stored(P.broad_families(found))
    best = P.best_matches(P.matches(found, broad)).select("track", "family", "segment")
    return best.join(broad.where("rank <= 4").select("track", "segment", F.col("family").alias("prior_family")), ["track", "segment"]).groupBy("track", "family", "prior_family").agg(F.count("*").alias("windows"))
