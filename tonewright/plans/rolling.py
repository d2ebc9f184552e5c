"""Queries of rolling auditory windows, with their SQL: envelopes of two channels, display matrices, lane support, lanes and contrast events in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import auditory as A
from ..operators import evidence as E
from ..operators import ranges as R
from ..operators import scorers as S
from ..session import table
from ..storage import stored
from . import bindings as B
from . import evidence as V

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Seconds of a pane, and panes of a window; the reading of a display.
PANE, PANES = 1.0, 3
SMOOTH, BIN = 3, 0.5
HALF = B.BINS // 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of middle and side; every other value of a vector stands for the left spectrum, the rest for the right."""
    even, odd = F.filter("samples", lambda v, i: i % 2 == 0), F.filter("samples", lambda v, i: i % 2 == 1)
    df = B.frames(spark, sf_dir)
    return A.mid_side_matrix(df, even, odd, HALF, B.RATE).select("track", "frame_idx", "t", "channel", "centre", "mid", "side")


MATRIX_SQL = f""", pr AS (SELECT a.track, a.frame_idx, a.k // 2 AS j, power((a.v + b.v) / 2, 2) AS pm, power((a.v - b.v) / 2, 2) AS ps FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.k = a.k + 1 WHERE a.k % 2 = 0),
    cn AS (SELECT i AS channel, (power(10, (21.4 * log10(1 + 0.00437 * 50) + (21.4 * log10(1 + 0.00437 * 8000) - 21.4 * log10(1 + 0.00437 * 50)) * i / 15) / 21.4) - 1) / 0.00437 AS centre FROM range(16) t(i)),
    wt AS (SELECT channel, centre, j, CASE WHEN f <= 0 THEN 0 ELSE 1 / (1 + power((f - centre) / (1.5 * 24.7 * (4.37 * centre / 1000 + 1)), 4)) END AS w FROM cn, (SELECT j, j * {B.RATE / 2} / {HALF - 1} AS f FROM range({HALF}) t(j))),
    mat AS (SELECT track, frame_idx, CAST(frame_idx AS DOUBLE) * 0.1 AS t, channel, centre, sum(w * pm) / sum(w) AS mid, sum(w * ps) / sum(w) AS side FROM pr JOIN wt USING (j) GROUP BY track, frame_idx, channel, centre)"""


def _display_sql(value: str) -> str:
    def robust(x: str, window: str, low: float, high: float) -> str:
        lo, hi = f"quantile_cont(db, {low}) OVER {window}", f"quantile_cont(db, {high}) OVER {window}"
        a, b = (f"CASE WHEN {hi} <= {lo} + 1e-12 THEN {e}(db) OVER {window} ELSE {q} END" for e, q in (("min", lo), ("max", hi)))
        return f"{a} AS a{x}, {b} AS b{x}"

    part = lambda x: f"CASE WHEN b{x} <= a{x} + 1e-12 THEN 0 ELSE {S.clamp(f'(db - a{x}) / (b{x} - a{x})')} END"
    return f""", dbs AS (SELECT *, 10 * log10(greatest({value}, 1e-12)) AS db FROM mat),
    rb AS (SELECT *, {robust('w', 'wt', *A.WHOLE_RANGE)}, {robust('b', 'bd', *A.BAND_RANGE)} FROM dbs WINDOW wt AS (PARTITION BY track), bd AS (PARTITION BY track, channel)),
    shown AS (SELECT *, {S.clamp(f"{A.BAND_SHARE} * {part('b')} + {A.WHOLE_SHARE} * {part('w')}")} AS shown FROM rb)"""


@query(B.with_sql("s", MATRIX_SQL + _display_sql("mid") + "SELECT track, CAST(frame_idx AS INTEGER) AS frame_idx, CAST(channel AS INTEGER) AS channel, round(shown, 5) AS shown FROM shown"))
def a30_display_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-30: the middle channel's envelopes as a display shows them, against quantiles of their band and of their track."""
    return A.display(stored(matrix(spark, sf_dir)), "mid").select("track", "frame_idx", "channel", F.round("shown", 5).alias("shown"))


@query(B.with_sql("s", MATRIX_SQL + _display_sql("side") + f""", sm AS (SELECT track, channel, t, min(t) OVER (PARTITION BY track) AS t0, sum(shown) OVER (PARTITION BY track, channel ORDER BY frame_idx ROWS BETWEEN {SMOOTH // 2} PRECEDING AND {(SMOOTH - 1) // 2} FOLLOWING) / {SMOOTH} AS x FROM shown)
    SELECT track, CAST(channel AS INTEGER) AS channel, bin, round(any_value(t0) + (bin + 0.5) * {BIN}, 6) AS t, round(avg(x), 5) AS level FROM (SELECT *, CAST(floor(round((t - t0) / {BIN}, 9)) AS INTEGER) AS bin FROM sm) GROUP BY track, channel, bin"""))
def a30_display_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-30: the side's display, smoothed in time and averaged over half seconds."""
    df = A.display_bins(A.display(stored(matrix(spark, sf_dir)), "side"), SMOOTH, BIN)
    return df.select("track", "channel", "bin", F.round("t", 6).alias("t"), F.round("level", 5).alias("level"))


# Rolling windows

_LEVEL = lambda c: f"CASE WHEN q{c} > 1e-12 THEN least(x{c} / q{c}, 1) WHEN m{c} > 1e-12 THEN least(x{c} / m{c}, 1) ELSE 0 END AS {'mid' if c == 'm' else 'side'}"
_BANDS = ", ".join(f"coalesce(avg({c}) FILTER (centre >= {low} AND centre < {high}), 0) AS {b}_{c}" for c in ("mid", "side") for b, (low, high) in A.BROAD.items())
_SUMS = {"broadband": "total", **{b: S.clamp(f"{b}_mid + {b}_side") for b in ("low", "mid", "high")}}
CURVE_SQL = f"""{MATRIX_SQL}, lg AS (SELECT *, ln(1 + greatest(mid, 0)) AS xm, ln(1 + greatest(side, 0)) AS xs FROM mat),
    lq AS (SELECT *, quantile_cont(xm, 0.98) OVER tr AS qm, max(xm) OVER tr AS mm, quantile_cont(xs, 0.98) OVER tr AS qs, max(xs) OVER tr AS ms FROM lg WINDOW tr AS (PARTITION BY track)),
    lv AS (SELECT track, frame_idx, t, channel, round(centre, 6) AS centre, {_LEVEL("m")}, {_LEVEL("s")} FROM lq),
    cv0 AS (SELECT track, frame_idx, t, {_BANDS}, avg(mid) AS all_mid, avg(side) AS all_side, {S.clamp("avg(mid) + avg(side)")} AS total FROM lv GROUP BY track, frame_idx, t),
    cv AS (SELECT *, {", ".join(f"greatest(coalesce({e} - lag({e}) OVER o, 0), 0) AS rise_{b}" for b, e in _SUMS.items())} FROM cv0 WINDOW o AS (PARTITION BY track ORDER BY frame_idx)),
    ed AS (SELECT track, max(t) AS over, {", ".join(f"max(rise_{b}) AS top_{b}" for b in A.RISING)} FROM cv GROUP BY track)"""
_AGGREGATED = ", ".join([f"avg({c}) AS {n}" for n, c in A.MEANS.items()] + [f"max({c})" + (f" / CASE WHEN any_value(top_{n[10:]}) > 1e-12 THEN any_value(top_{n[10:]}) ELSE 1e300 END" if n.startswith("transient_") else "") + f" AS {n}" for n, c in A.HIGHEST.items()])
WINDOW_SQL = f"""{CURVE_SQL},
    wk AS (SELECT track, over, CAST(k AS INTEGER) AS segment, CAST(k AS DOUBLE) * {PANE} AS start_s, least(CAST(k AS DOUBLE) * {PANE} + {PANES * PANE}, over) AS end_s FROM ed, range(100000) r(k) WHERE k * {PANE} < over AND (k = 0 OR round(k * {PANE} + {max(A.LEAST_REST, min(PANES * PANE, 1.0))} - over, 9) <= 0)),
    win0 AS (SELECT wk.track, segment, start_s, end_s, {_AGGREGATED}
      FROM wk JOIN cv ON cv.track = wk.track AND round(t - start_s, 9) >= 0 AND round(t - end_s, 9) < 0 JOIN ed ON ed.track = wk.track GROUP BY wk.track, segment, start_s, end_s),
    win AS ({S.applied_sql([A.RATIOS, A.SUPPORT], "win0")})"""


def stored_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(A.curves(A.levels(stored(matrix(spark, sf_dir)))))  # each is read several times


def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates, ratios and lane support of each rolling window."""
    return S.applied(A.pane_windows(stored_curves(spark, sf_dir), PANES, PANE), [A.RATIOS, A.SUPPORT])


_METRICS = [*A.MEANS, *A.HIGHEST, *A.RATIOS]


@query(B.with_sql("s", WINDOW_SQL + "SELECT track, segment, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, " + ", ".join(f"round({c}, 5) AS {c}" for c in [*_METRICS, *A.SUPPORT]) + " FROM win"))
def x17_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-17, H-31, W-09: 16 aggregates, five ratios and the support for eight lanes of each window of three seconds, a second apart."""
    df = rolling_windows(spark, sf_dir)
    return df.select("track", "segment", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), *[F.round(c, 5).alias(c) for c in [*_METRICS, *A.SUPPORT]])


ROLLING_SQL = WINDOW_SQL + V.rolling_sql("win")


def rolling_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of rolling windows, worked out once for all that starts from them."""
    return stored(V.rolling(rolling_windows(spark, sf_dir)))


@query(B.with_sql("s", ROLLING_SQL + "SELECT track, segment, lane, " + ", ".join(f"round({c}, 5) AS {c}" for c in ("v", "relative", "entry", "leave", "score")) + ", active, unsure FROM lane"))
def w11_rolling_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-11, X-16: lanes of each rolling window against their track's own."""
    return rolling_lanes(spark, sf_dir).select("track", "segment", "lane", *[F.round(c, 5).alias(c) for c in ("v", "relative", "entry", "leave", "score")], "active", "unsure")


# Lanes of the profile beside auditory evidence of its segments

PROFILE_SQL = f"""{CURVE_SQL}, au0 AS (SELECT track, CAST(floor(frame_idx / {B.SEGMENT_FRAMES}) AS INTEGER) AS segment, {_AGGREGATED} FROM cv JOIN ed USING (track) GROUP BY ALL),
    au AS ({S.applied_sql([A.RATIOS, A.SUPPORT], "au0")}){V.blended_sql("au")}"""


def profile_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes of each segment of the profile, whose scores take in the segment's auditory support."""
    auditory = S.applied(A.segment_aggregates(stored_curves(spark, sf_dir), B.SEGMENT_FRAMES), [A.RATIOS, A.SUPPORT])
    return V.lanes(V.scored(spark, sf_dir), auditory)


_PARTS = ["v", "auditory", "relative", "entry", "leave", "score"]


@query(V.on_scored(PROFILE_SQL + f"SELECT track, segment, lane, {V._r(*_PARTS)}, active, unsure FROM lane"))
def x16_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-16, J-10, F-10, H-28, H-29, W-11: lanes of each segment of the profile: its own score, auditory support, its own score against the track's, entry, exit, and the score of both."""
    return B.rounded(V.contrasted(profile_lanes(spark, sf_dir)).select("track", "segment", "lane", *_PARTS, "active", "unsure"))


@query(V.on_scored(PROFILE_SQL + V.LANE_STATUS_SQL + f" SELECT track, lane, {V._r('mean_support', 'max_support', 'coverage')}, status FROM status"))
def g23_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-23, G-30: support, coverage and status of each lane of a track's profile beside auditory evidence."""
    return B.rounded(V.lane_status(profile_lanes(spark, sf_dir)))


@query(V.on_scored(PROFILE_SQL + V.STATE_SQL + "SELECT track, segment, n_active, n_unsure, dominant, signature, round(mixedness, 6) AS mixedness, state FROM state"))
def x18_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-18, G-24, H-30: mixedness and state of the arrangement in each segment of the profile beside auditory evidence."""
    rows = stored(profile_lanes(spark, sf_dir))
    return B.rounded(V.states(rows, V.lane_status(rows)).drop("start_s", "end_s"))


_NEW = " + ".join(f"abs({c} - lag({c}) OVER o)" for c in A.SUPPORT)
_SIGN = " || ".join(f"CASE WHEN {c} >= 0.5 THEN '1' ELSE '0' END" for c in A.SUPPORT)


@query(B.with_sql("s", WINDOW_SQL + f""", sg AS (SELECT *, {_SIGN} AS sign FROM win)
    SELECT track, segment, round(coalesce(({_NEW}) / 8, 0), 5) AS novelty, round(coalesce(greatest(0, {", ".join(f"{c} - lag({c}) OVER o" for c in A.SUPPORT)}), 0), 5) AS entry,
      round(coalesce(greatest(0, {", ".join(f"lag({c}) OVER o - {c}" for c in A.SUPPORT)}), 0), 5) AS leave, coalesce(sign = lag(sign) OVER o AND sign LIKE '%1%', false) AS recurs FROM sg WINDOW o AS (PARTITION BY track ORDER BY segment)"""))
def w10_window_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-10: how each rolling window differs from the one before, and whether its signature is the same."""
    w = Window.partitionBy("track").orderBy("segment")
    df = rolling_windows(spark, sf_dir).withColumn("sign", F.expr(f"concat({_SIGN.replace(' || ', ', ')})"))
    change = {c: F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)) for c in A.SUPPORT}
    df = df.withColumns({f"d_{c}": x for c, x in change.items()} | {"_b": F.lag("sign").over(w)})
    novelty = sum((F.abs(f"d_{c}") for c in A.SUPPORT), F.lit(0.0)) / len(A.SUPPORT)
    entry, leave = (F.greatest(F.lit(0.0), *[F.col(f"d_{c}") * x for c in A.SUPPORT]) for x in (1, -1))
    recurs = F.coalesce((F.col("sign") == F.col("_b")) & F.col("sign").contains("1"), F.lit(False))
    return df.select("track", "segment", F.round(novelty, 5).alias("novelty"), F.round(entry, 5).alias("entry"), F.round(leave, 5).alias("leave"), recurs.alias("recurs"))


@query(B.with_sql("s", ROLLING_SQL + V.LANE_STATUS_SQL + " SELECT track, lane, round(mean_support, 5) AS mean_support, round(max_support, 5) AS max_support, round(coverage, 5) AS coverage, status FROM status"))
def g23_rolling_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-23, G-30: support, coverage and status of each lane over rolling windows."""
    return B.rounded(V.lane_status(rolling_lanes(spark, sf_dir)), 5)


@query(B.with_sql("s", ROLLING_SQL + V.EVENT_SQL + "SELECT track, segment, kind, lane, round(strength, 5) AS strength, event_id FROM event"))
def x19_contrast_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-19, W-12, W-13, T-14: contrast events of rolling windows, in the order of their time and name."""
    return V.events(rolling_lanes(spark, sf_dir)).select("track", "segment", "kind", "lane", F.round("strength", 5).alias("strength"), "event_id")


_MAJOR = " ".join(f"WHEN '{k}' THEN {x}" for k, x in E.MAJOR.items())


@query(B.with_sql("s", ROLLING_SQL + V.EVENT_SQL + f"SELECT track, segment, kind, lane, round(strength, 5) AS strength, event_id FROM event WHERE strength >= CASE kind {_MAJOR} END QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(strength, 9) DESC, start_s, event_id) <= 24"))
def p14_major_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-14: events above the threshold of their kind, the 24 strongest of a track; kinds without a threshold are none of them."""
    df = V.events(rolling_lanes(spark, sf_dir)).where(f"strength >= CASE kind {_MAJOR} END")
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.round("strength", 9).desc(), "start_s", "event_id"))
    return df.withColumn("_k", rank).where("_k <= 24").select("track", "segment", "kind", "lane", F.round("strength", 5).alias("strength"), "event_id")


BEHAVIOUR_SQL = ROLLING_SQL + V.EVENT_SQL + V.FAMILY_SQL + f""", of(family, lane) AS (VALUES {", ".join(f"('{f}', '{x}')" for f, x in V.LANE_OF)}),
    near AS (SELECT DISTINCT isl.track, isl.family, kind, event.lane, event.start_s, event_id, strength FROM isl JOIN of USING (family) JOIN event ON event.track = isl.track AND event.lane = of.lane AND event.start_s < isl.end_s AND isl.start_s < event.end_s),
    ev AS (SELECT track, family, {", ".join(f"{e} AS {n}" for n, e in V.EVENT_AGGREGATES.items())} FROM (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY track, family ORDER BY round(strength, 9) DESC, start_s, event_id) <= 16) GROUP BY track, family),
    kept AS (SELECT * FROM cand WHERE max_support >= 0.38 OR claim <> 'weak'),
    ov AS (SELECT a.track, a.family, count(DISTINCT b.family) AS overlap_count FROM isl a JOIN isl b ON a.track = b.track AND a.family <> b.family AND a.start_s < b.end_s AND b.start_s < a.end_s
      WHERE (a.track, a.family) IN (SELECT (track, family) FROM kept) AND (b.track, b.family) IN (SELECT (track, family) FROM kept) GROUP BY a.track, a.family),
    beh AS ({S.applied_sql([E.BEHAVIOUR, {"behaviour_group": E.member("flow", E.FLOW_GROUP, "other")}], f"(SELECT kept.*, coalesce(ov.overlap_count, 0) AS overlap_count, {', '.join(f'coalesce({n}, 0) AS {n}' for n in V.EVENT_AGGREGATES)} FROM kept LEFT JOIN ev USING (track, family) LEFT JOIN ov USING (track, family))")})"""


def behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are kept, with how each enters, goes on, masks, presses, decays and recurs; a track's runs and events are few, and meet by track and lane."""
    rows = stored(V.families(V.scored(spark, sf_dir)))
    runs = stored(V.ranges(rows))
    kept = stored(V.candidates(rows, runs).where("max_support >= 0.38 OR claim <> 'weak'"))
    of = spark.createDataFrame(V.LANE_OF, "family string, lane string")  # a fixed table of a few dozen rows
    found = V.events(rolling_lanes(spark, sf_dir)).withColumnsRenamed({"start_s": "a", "end_s": "z"})
    near = runs.join(F.broadcast(of), "family").join(found, ["track", "lane"]).where("a < end_s AND start_s < z").select("track", "family", "kind", "lane", "a", "event_id", "strength").distinct()
    rank = F.row_number().over(Window.partitionBy("track", "family").orderBy(F.round("strength", 9).desc(), "a", "event_id"))
    ev = near.withColumn("_k", rank).where("_k <= 16").groupBy("track", "family").agg(*[F.expr(e).alias(n) for n, e in V.EVENT_AGGREGATES.items()])
    mine = runs.join(kept.select("track", "family"), ["track", "family"], "left_semi")
    other = mine.select("track", F.col("family").alias("other"), F.col("start_s").alias("a"), F.col("end_s").alias("z"))
    ov = mine.join(other, "track").where("family <> other AND start_s < z AND a < end_s").groupBy("track", "family").agg(F.countDistinct("other").alias("overlap_count"))
    df = kept.join(ev, ["track", "family"], "left").join(ov, ["track", "family"], "left").fillna(0, ["overlap_count", "tail_events", "spread_events", "exits", "recurrences"]).fillna(0.0, ["entry_strength", "pressure_strength"])
    return S.applied(df, [E.BEHAVIOUR, {"behaviour_group": E.member("flow", E.FLOW_GROUP, "other")}])


@query(V.on_scored(BEHAVIOUR_SQL + " SELECT track, family, " + ", ".join(V.BEHAVIOUR) + " FROM beh"))
def x26_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-26, J-17, J-18, G-26, Q21: how each candidate enters, goes on, masks, presses, decays and recurs."""
    return behaviours(spark, sf_dir).select("track", "family", *V.BEHAVIOUR)


# Fields and regions of the two channels

_RATIOS = ", ".join(f"{b}_side / ({b}_mid + {b}_side + 1e-12) AS ratio_{b}, least({b}_mid + {b}_side, 1) AS sum_{b}" for b in A.BROAD)
_UNIT = S.clamp
_FIELDS = f"""({" + ".join(f"{_UNIT(f'(ratio_{b} - 0.45) / 0.55')} * sum_{b}" for b in A.BROAD)}) / 4 AS wide, ({" + ".join(f"{_UNIT(f'(0.55 - ratio_{b}) / 0.55')} * {b}_mid" for b in A.BROAD)}) / 4 AS centred"""
_CB = [(c, b) for c in ("mid", "side") for b in ("low", "mid", "high")]
_AROUND = lambda c, k: f"sum({c}) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN {k // 2} PRECEDING AND {(k - 1) // 2} FOLLOWING) / {k}"
FIELD_SQL = WINDOW_SQL + f""", fd AS (SELECT *, {_FIELDS} FROM (SELECT *, {_RATIOS} FROM cv0)),
    rz AS (SELECT *, {", ".join(f"greatest(coalesce({b}_{c} - lag({b}_{c}) OVER (PARTITION BY track ORDER BY frame_idx), 0), 0) AS r_{b}_{c}, {_AROUND(f'{b}_{c}', A.SUSTAINED_WIDTH)} AS s_{b}_{c}" for c, b in _CB)}, {_AROUND("wide", A.FIELD_WIDTH)} AS s_wide, {_AROUND("centred", A.FIELD_WIDTH)} AS s_centred FROM fd),
    av AS ({" UNION ALL ".join([f"SELECT track, frame_idx, t, 'sustained_{c}' AS list, {i} AS place, '{b}_sustained_{c}' AS kind, s_{b}_{c} AS activity, {A.SUSTAINED_LEAST} AS least FROM rz UNION ALL SELECT track, frame_idx, t, 'transient_{c}', {i}, '{b}_transient_{c}', CASE WHEN max(r_{b}_{c}) OVER (PARTITION BY track) > 1e-12 THEN r_{b}_{c} / max(r_{b}_{c}) OVER (PARTITION BY track) ELSE 0 END, {A.RISING_LEAST} FROM rz" for c in ("mid", "side") for i, b in enumerate(("low", "mid", "high"))])}
      UNION ALL SELECT track, frame_idx, t, 'wide', 0, 'side_heavy_wide_band_region', s_wide, {A.FIELD_LEAST} FROM rz UNION ALL SELECT track, frame_idx, t, 'centred', 0, 'mid_focused_center_region', s_centred, {A.FIELD_LEAST} FROM rz)"""


@query(B.with_sql("s", FIELD_SQL + " UNION ALL ".join(f"SELECT track, '{b}' AS band, round(avg(ratio_{b}), 5) AS mean_ratio, round(max(ratio_{b}), 5) AS max_ratio, round(avg(sum_{b}), 5) AS mean_total FROM fd GROUP BY track" for b in A.BROAD)))
def a33_band_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-33: the side's share in four broad bands of each track."""
    return B.rounded(A.band_ratios(A.fields(A.curves(A.levels(stored(matrix(spark, sf_dir)))))), 5)


@query(B.with_sql("s", FIELD_SQL + f""", ri AS (SELECT track, list, place, kind, min(t) AS start_s, max(t) AS end_s, avg(activity) AS mean, max(activity) AS highest
      FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY track, kind ORDER BY frame_idx) AS island FROM av WHERE round(activity, 9) >= least) GROUP BY track, list, place, kind, island)
    SELECT track, list, CAST(row_number() OVER o AS INTEGER) AS rank, kind, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, round(mean, 5) AS mean, round(highest, 5) AS highest FROM ri WINDOW o AS (PARTITION BY track, list ORDER BY place, start_s) QUALIFY row_number() OVER o <= {A.MOST_REGIONS}"""))
def a33_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-33, H-36: where bands of the middle and the side sustain or rise, and where the field is wide or centred; ten of each list."""
    df = A.regions(A.activities(stored(A.fields(A.curves(A.levels(stored(matrix(spark, sf_dir))))))))
    return df.select("track", "list", "rank", "kind", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), F.round("mean", 5).alias("mean"), F.round("highest", 5).alias("highest"))


# Readable ranges

_LABEL = "CASE {} " + " ".join(f"WHEN '{n}' THEN '{x}'" for n, x in E.LANE_LABELS.items()) + " ELSE {} END"
#: States of rolling windows with their signature: the first three active lanes, else the two that score highest.
READABLE_SQL = V.STATE_SQL + f""", rs AS (SELECT state.track, state.segment, state.start_s, state.end_s, row_number() OVER (PARTITION BY state.track ORDER BY state.segment) - 1 AS place,
      CASE WHEN dominant IS NULL THEN two ELSE array_to_string(string_split(dominant, ',')[:3], ',') END AS signature
      FROM state JOIN (SELECT track, segment, string_agg(lane, ',' ORDER BY round(score, 9) DESC, lane) AS two FROM (SELECT * FROM lane QUALIFY row_number() OVER (PARTITION BY track, segment ORDER BY round(score, 9) DESC, lane) <= 2) GROUP BY track, segment) USING (track, segment)),
    rn AS (SELECT track, min(start_s) AS start, max(end_s) AS "end", signature, min(place) AS first, count(*) AS n FROM (SELECT *, place - row_number() OVER (PARTITION BY track, signature ORDER BY place) AS island FROM rs) GROUP BY track, signature, island)"""


def described(signature: Column) -> Column:
    """What a signature says: its lanes' labels, up to three."""
    labels = F.transform(F.slice(F.split(signature, ","), 1, 3), lambda x: F.coalesce(*[F.when(x == n, F.lit(label)) for n, label in E.LANE_LABELS.items()], x))
    return F.when(F.size(labels) == 1, F.concat(F.lit("mostly "), labels[0])).otherwise(F.concat(F.lit("mixed support: "), F.array_join(labels, "; ")))


@query(B.with_sql("s", ROLLING_SQL + READABLE_SQL + ", " + R.merged_sql("rn", 4) + f""" SELECT mr.track, part, round(r.s, 6) AS start_s, round(r.e, 6) AS end_s, r.sig AS signature, r.n AS n,
    CASE WHEN len(w) = 1 THEN 'mostly ' || w[1] ELSE 'mixed support: ' || array_to_string(w, '; ') END AS description
    FROM mr JOIN (SELECT track, place, list_transform(string_split(signature, ','), lambda x: {_LABEL.format("x", "x")}) AS w FROM rs) d ON d.track = mr.track AND d.place = r.f + r.n // 2""").replace("WITH ", "WITH RECURSIVE ", 1))
def w14_readable_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-14, H-32: runs of rolling windows with one signature, merged until four ranges are left, with what their middle window shows."""
    lanes = rolling_lanes(spark, sf_dir)
    two = F.slice(F.sort_array(F.collect_list(F.struct((-F.round("score", 9)).alias("k"), "lane"))), 1, 2)["lane"]
    df = V.states(lanes, V.lane_status(lanes)).join(lanes.groupBy("track", "segment").agg(two.alias("_two")), ["track", "segment"])
    named = F.when(F.col("dominant").isNull(), F.array_join("_two", ",")).otherwise(F.array_join(F.slice(F.split("dominant", ","), 1, 3), ","))
    df = stored(df.withColumns({"signature": named, "place": F.row_number().over(Window.partitionBy("track").orderBy("segment")) - 1}).select("track", "segment", "place", "start_s", "end_s", "signature"))
    out = R.readable_ranges(R.signature_runs(df), most=4).join(df.select("track", F.col("place").cast("long").alias("middle"), described(F.col("signature")).alias("description")), ["track", "middle"])
    return out.select("track", "part", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "signature", "n", "description")


@query(f"""WITH RECURSIVE ev AS (SELECT user_id AS track, event_type AS signature, epoch_us(ts) AS begun, event_id, coalesce(lead(epoch_us(ts)) OVER o, epoch_us(ts)) AS till, row_number() OVER o - 1 AS place FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
    rn AS (SELECT track, min(begun) AS start, max(till) AS "end", signature, min(place) AS first, count(*) AS n FROM (SELECT *, place - row_number() OVER (PARTITION BY track, signature ORDER BY place) AS island FROM ev) GROUP BY track, signature, island),
    {R.merged_sql("rn")} SELECT track AS user_id, part, r.s AS start_us, r.e AS end_us, r.sig AS signature, r.n AS n FROM mr""")
def w14_user_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-14: a user's events as ranges of one kind, merged until twelve are left."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    df = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("signature"), at.alias("start_s"), F.coalesce(F.lead(at).over(w), at).alias("end_s"), F.row_number().over(w).alias("segment"))
    out = R.readable_ranges(R.signature_runs(df, "user_id"), "user_id")
    return out.select("user_id", "part", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "signature", "n")
