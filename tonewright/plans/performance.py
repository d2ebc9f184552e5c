"""Queries of performance cards over candidates and their behaviour, with their SQL. Suppliers stand for packets of recognised families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import evidence as E
from ..operators import performance as P
from ..operators import scorers as S
from ..session import table
from ..storage import stored
from . import evidence as V
from . import rolling as R

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FAMILIES = list(E.FAMILIES)
#: Confidence from which a recognised family is kept.
RETAINED = 0.97


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, family) of packets with enough confidence: each supplier speaks for one family in one track, as sure as its balance is high."""
    df = table(spark, sf_dir, "supplier").where((F.col("s_acctbal").cast("double") + 1000) / 11000 >= RETAINED)
    name = F.element_at(F.array(*[F.lit(n) for n in FAMILIES]), (F.col("s_suppkey") % len(FAMILIES) + 1).cast("int"))
    return df.select((F.col("s_suppkey") % 10).cast("int").alias("track"), name.alias("family")).distinct()


_KNOWN_SQL = f"""rk AS (SELECT DISTINCT CAST(s_suppkey % 10 AS INTEGER) AS track, [{", ".join(f"'{n}'" for n in FAMILIES)}][s_suppkey % {len(FAMILIES)} + 1] AS family FROM supplier WHERE (CAST(s_acctbal AS DOUBLE) + 1000) / 11000 >= {RETAINED})"""
_INTO = "CASE family " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.FALLBACK.items()) + " END"
GATE_SQL = f"""{R.BEHAVIOUR_SQL}, {_KNOWN_SQL},
    cd AS (SELECT beh.*, row_number() OVER (PARTITION BY track ORDER BY claim_rank DESC, round(mean_support, 9) DESC, round(max_support, 9) DESC, family) AS rank FROM beh),
    gt AS (SELECT cd.*, {P.gate_status("(track, family) IN (SELECT (track, family) FROM rk)")} AS status FROM cd),
    fo AS (SELECT *, {_INTO} AS folded_into, row_number() OVER (PARTITION BY track, {_INTO} ORDER BY rank, family) = 1 AS gives FROM gt WHERE status LIKE 'blocked%'),
    card AS (SELECT track, family, status, family AS candidate, false AS folded, claim, rank, active_mean, mean_support FROM gt WHERE status NOT LIKE 'blocked%'
      UNION ALL SELECT track, folded_into, 'functional_performance_allowed', family, true, 'functional_fallback', rank, active_mean, mean_support FROM fo WHERE gives)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("track").orderBy(F.desc("claim_rank"), F.round("mean_support", 9).desc(), F.round("max_support", 9).desc(), "family")
    return stored(R.behaviours(spark, sf_dir).withColumn("rank", F.row_number().over(order)))


def _cards(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    return stored(P.gated(ranked.select("track", "family", "claim", "rank", "active_mean", "mean_support"), recognised(spark, sf_dir)))


@query(V.on_scored(GATE_SQL + " SELECT track, family, status, candidate, folded, claim, CAST(rank AS INTEGER) AS rank FROM card"))
def p09_gated_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-09, P-10, H-24: families that may be performance cards; those that are not recognised give their evidence to functional ones."""
    return _cards(spark, sf_dir, _ranked(spark, sf_dir)).select("track", "family", "status", "candidate", "folded", "claim", "rank")


@query(V.on_scored(GATE_SQL + " SELECT track, family, folded_into, gives FROM fo"))
def p09_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-09: families without a card of their own, the functional family that they go into, and whether theirs is the evidence that it takes."""
    ranked = _ranked(spark, sf_dir)
    return P.suppressed(ranked, _cards(spark, sf_dir, ranked))


_TARGETS = ", ".join(f"('{into}', '{f}')" for f, into in P.FALLBACK.items())
MATCH_SQL = f"""{GATE_SQL}, un(family, target) AS (VALUES {_TARGETS}),
    bc AS (SELECT track, family AS behaviour, claim, family_group, continuity_kind, entry, row_number() OVER (PARTITION BY track ORDER BY {P.ranks("claim", P.CLAIM)} DESC, round(active_mean, 9) DESC, rank) AS place FROM cd),
    bp AS (SELECT card.track, card.family, folded, bc.behaviour, min(CASE WHEN candidate = bc.behaviour THEN 0 ELSE 1 END) AS "by" FROM card JOIN bc ON bc.track = card.track
      AND (bc.behaviour = candidate OR bc.behaviour = card.family OR (card.family, bc.behaviour) IN (SELECT (family, target) FROM un)) GROUP BY ALL),
    bm AS (SELECT bp.*, claim, family_group, continuity_kind, entry, row_number() OVER (PARTITION BY bp.track, bp.family, folded ORDER BY {P.ranks("claim", P.CLAIM)} DESC, {P.LOCALITY} DESC, place) AS rank FROM bp JOIN bc USING (track, behaviour) QUALIFY rank <= {P.MOST_MATCHES})"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("track").orderBy(F.expr(P.ranks("claim", P.CLAIM)).desc(), F.round("active_mean", 9).desc(), "rank"))
    behaviour = ranked.select("track", F.col("family").alias("behaviour"), "claim", "family_group", "continuity_kind", "entry", place.alias("place"))
    return P.behaviour_matches(_cards(spark, sf_dir, ranked), behaviour)


@query(V.on_scored(MATCH_SQL + ' SELECT track, family, folded, behaviour, CAST("by" AS INTEGER) AS "by", CAST(rank AS INTEGER) AS rank FROM bm'))
def j19_behaviour_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-19, T-07: behaviour that speaks for each card, of the same candidate or of a family under it, eight at most."""
    return _matches(spark, sf_dir).select("track", "family", "folded", "behaviour", "by", "rank")


@query(V.on_scored(MATCH_SQL + f""" SELECT track, family, folded, count(*) OVER (PARTITION BY track, family, folded) AS matches, behaviour, claim, continuity_kind, entry FROM bm
    QUALIFY row_number() OVER (PARTITION BY track, family, folded ORDER BY CASE WHEN family_group = '{E.FUNCTIONAL}' THEN 0 ELSE 1 END, {P.ranks("claim", P.CLAIM)} DESC, CASE WHEN continuity_kind = 'persistent' THEN 0 ELSE 1 END, rank) = 1"""))
def t09_primary_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-09: the behaviour that a card is told by."""
    return P.primary_behaviour(_matches(spark, sf_dir)).select("track", "family", "folded", "matches", "behaviour", "claim", "continuity_kind", "entry")


_JOINED = "concat_ws(' ', event, phrase, note_density, melody, bass, harmony)"
_EVENTS = " UNION ALL ".join(f"SELECT track, '{s}' AS stream, {_JOINED.replace('event', f'({e})', 1)} AS said FROM p WHERE {s} >= {S.STREAM_LEAST[s]}" for s, e in S.STREAM_EVENTS.items())
_SAID = ", ".join(f"bool_or(contains(said, '{w}')) AS said_{w}" for w in P.WORDS)


@query(V.on_scored(GATE_SQL + f""", se AS ({_EVENTS}), sw AS (SELECT track, stream, count(*) AS events, {_SAID} FROM se GROUP BY track, stream),
    cs AS (SELECT card.*, coalesce(events, 0) AS events, {", ".join(f"coalesce(said_{w}, false) AS said_{w}" for w in P.WORDS)} FROM (SELECT *, {P.STREAM} AS stream FROM card) card LEFT JOIN sw USING (track, stream))
    SELECT track, family, folded, claim, events, array_to_string(string_split({P.modes_sql("said")}, ';')[:{P.MOST_MODES}], ';') AS modes, CAST(row_number() OVER (PARTITION BY track ORDER BY {P.ranks("claim", P.STRENGTH)} DESC, round(active_mean, 9) DESC, events DESC, family, folded) AS INTEGER) AS place FROM cs"""))
def t06_performance_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-27, T-06, H-26, Q10: ways of playing of each card, from the words of its stream's events, and the cards in their order."""
    cards = _cards(spark, sf_dir, _ranked(spark, sf_dir)).withColumn("stream", F.expr(P.STREAM))
    made = F.array(*[F.when(F.expr(f"{s} >= {S.STREAM_LEAST[s]}"), F.struct(F.lit(s).alias("stream"), F.expr(_JOINED.replace("event", f"({e})", 1)).alias("said"))) for s, e in S.STREAM_EVENTS.items()])
    said = V.scored(spark, sf_dir).select("track", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("z")).select("track", "z.*")
    said = said.groupBy("track", "stream").agg(F.count("*").alias("events"), *[F.bool_or(F.col("said").contains(w)).alias(f"said_{w}") for w in P.WORDS])
    df = cards.join(said, ["track", "stream"], "left").fillna(0, ["events"]).fillna(False, [f"said_{w}" for w in P.WORDS])
    modes = F.array_join(F.slice(F.split(F.expr(P.modes_sql("said")), ";"), 1, P.MOST_MODES), ";")
    order = Window.partitionBy("track").orderBy(F.expr(P.ranks("claim", P.STRENGTH)).desc(), F.round("active_mean", 9).desc(), F.desc("events"), "family", "folded")
    return df.select("track", "family", "folded", "claim", "events", modes.alias("modes"), F.row_number().over(order).alias("place"))


@query(V.on_scored(MATCH_SQL + f""" SELECT track, family, folded, coalesce(string_agg(behaviour, ',' ORDER BY rank) FILTER (family_group = '{E.FUNCTIONAL}'), '') AS functional, coalesce(string_agg(behaviour, ',' ORDER BY rank) FILTER (family_group <> '{E.FUNCTIONAL}'), '') AS candidates FROM bm GROUP BY track, family, folded"""))
def g38_behaviour_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-38: the behaviour of a card that may shape its words, and that which only supports it."""
    return C.behaviour_support(_matches(spark, sf_dir), E.FUNCTIONAL)
