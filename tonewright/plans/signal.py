"""Queries over frames and segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import scorers, spectral, windows
from . import bindings as B

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
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


SHAPE = ["rms", "peak", "zcr", "centroid", "bandwidth", "rolloff", "flatness", "low", "mid", "high"]


@query(B.with_sql("shape", f"SELECT track, CAST(frame_idx AS INTEGER) AS frame_idx, {_r(*SHAPE)} FROM level JOIN shape USING (vec_id) JOIN roll USING (vec_id)"))
def a05_spectral_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-03 to A-08: levels, crossings, centroid, bandwidth, roll-off, flatness and coarse bands of each frame."""
    df = spectral.spectral_features(spectral.level_features(B.frames(spark, sf_dir), "samples"), "samples", B.BINS, B.RATE)
    return B.rounded(df.select("track", "frame_idx", *SHAPE))


@query(B.with_sql("ms", f"SELECT vec_id, {_r('side_ratio', 'balance', 'phase')} FROM ms"))
def a09_mid_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rounded(B.features(spark, sf_dir).select("vec_id", "side_ratio", "balance", "phase"))


@query(B.with_sql("ser", f"SELECT vec_id, {_r('flux', 'onset', 'percussive', 'harmonic')} FROM ser"))
def a12_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-10 to A-12: flux, whole-track normalisation and composite series."""
    return B.rounded(B.series(spark, sf_dir).select("vec_id", "flux", "onset", "percussive", "harmonic"))


@query(B.with_sql("ser", "SELECT vec_id, round(novelty, 6) AS novelty, round(sum(novelty) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM ser"))
def a13_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-13, A-14: novelty and its zero-padded moving average."""
    df = B.series(spark, sf_dir)
    return B.rounded(df.select("vec_id", "novelty", spectral.moving_average("novelty", 5, "track", "frame_idx").alias("smooth")))


@query(B.with_sql("ser", """, c AS (SELECT track, frame_idx, onset - avg(onset) OVER (PARTITION BY track) AS x FROM ser),
    r AS (SELECT a.track, b.frame_idx - a.frame_idx AS lag, sum(a.x * b.x) AS r FROM c a JOIN c b ON a.track = b.track AND b.frame_idx - a.frame_idx BETWEEN 0 AND 20 GROUP BY ALL)
    SELECT track, CAST(lag AS INTEGER) AS lag, round(r / first_value(r) OVER (PARTITION BY track ORDER BY lag), 6) AS corr FROM r"""))
def a15_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-15: autocorrelation of the centred onset series, relative to lag 0; lags by leads, without a self-join."""
    return B.rounded(a15_unrounded(spark, sf_dir).where("corr is not null"))


def a15_unrounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, o = Window.partitionBy("track"), Window.partitionBy("track").orderBy("frame_idx")
    df = B.series(spark, sf_dir).withColumn("x", F.col("onset") - F.avg("onset").over(w))
    df = df.select("track", *[(F.col("x") * F.lead("x", k).over(o)).alias(f"r{k}") for k in range(21)])
    sums = df.groupBy("track").agg(*[F.sum(f"r{k}").alias(f"r{k}") for k in range(21)])
    return sums.select("track", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"r{k}") / F.col("r0")).alias("corr")) for k in range(21)])).alias("z")).select("track", "z.lag", "z.corr")


@query(B.with_sql("ser", """, c AS (SELECT track, frame_idx, onset - avg(onset) OVER (PARTITION BY track) AS x FROM ser),
    r AS (SELECT a.track, b.frame_idx - a.frame_idx AS lag, sum(a.x * b.x) AS r FROM c a JOIN c b ON a.track = b.track AND b.frame_idx - a.frame_idx BETWEEN 0 AND 20 GROUP BY ALL),
    q AS (SELECT track, lag, r / first_value(r) OVER (PARTITION BY track ORDER BY lag) AS corr FROM r),
    b AS (SELECT track, lag, corr, max(corr) OVER (PARTITION BY track) AS best, row_number() OVER (PARTITION BY track ORDER BY round(corr, 9) DESC, lag) AS rn FROM q WHERE lag BETWEEN 3 AND 15)
    SELECT track, CAST(lag AS INTEGER) AS lag, round(600.0 / lag, 6) AS bpm, CASE WHEN abs(600.0 / lag - round(600.0 / lag)) < 0.35 THEN round(600.0 / lag) ELSE round(600.0 / lag, 6) END AS snapped, round(greatest(corr, 0), 6) AS confidence FROM b WHERE rn = 1"""))
def a16_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-16, A-17: the lag with the highest autocorrelation between 40 and 200 beats a minute, and its snapped tempo."""
    df = a15_unrounded(spark, sf_dir).where("lag between 3 and 15")
    best = df.withColumn("rn", F.row_number().over(Window.partitionBy("track").orderBy(F.round("corr", 9).desc(), "lag"))).where("rn = 1")
    bpm = F.lit(600.0) / F.col("lag")
    return B.rounded(best.select("track", "lag", bpm.alias("bpm"), F.when(F.abs(bpm - F.round(bpm)) < 0.35, F.round(bpm)).otherwise(bpm).alias("snapped"), F.greatest("corr", F.lit(0.0)).alias("confidence")))


@query(B.with_sql("ser", """, q AS (SELECT track, greatest(avg(onset), quantile_cont(onset, 0.7)) AS least, max(t) AS last FROM ser GROUP BY track),
    f AS (SELECT ser.track, min(t) FILTER (onset >= least AND t <= least_t) AS first_beat, any_value(last) AS last FROM ser JOIN (SELECT *, least(last, 1.0) AS least_t FROM q) USING (track) GROUP BY ser.track),
    b AS (SELECT track, coalesce(first_beat, 0) AS first_beat, last, unnest(range(0, CAST(floor((last - coalesce(first_beat, 0)) / 0.5 + 1e-9) AS BIGINT) + 1)) AS i FROM f)
    SELECT track, CAST(i AS INTEGER) AS beat, round(CAST(first_beat + i * 0.5 AS DOUBLE), 6) AS t, i % 4 = 0 AS is_bar FROM b"""))
def a19_beat_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-18, A-19: first strong onset within a second, and the grid of beats at 120 a minute from it; every fourth opens a bar."""
    df = B.series(spark, sf_dir).select("track", "t", "onset")
    least = df.groupBy("track").agg(F.greatest(F.avg("onset"), F.percentile("onset", F.lit(0.7))).alias("least"), F.max("t").alias("last"))
    first = df.join(least, "track").groupBy("track").agg(F.min(F.when((F.col("onset") >= F.col("least")) & (F.col("t") <= F.least("last", F.lit(1.0))), F.col("t"))).alias("first"), F.first("last").alias("last"))
    first = first.withColumn("first", F.coalesce("first", F.lit(0.0)))
    beats = first.select("track", "first", F.posexplode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / 0.5 + 1e-9).cast("int"))).alias("p", "beat"))
    return B.rounded(beats.select("track", "beat", (F.col("first") + F.col("beat") * 0.5).alias("t"), (F.col("beat") % 4 == 0).alias("is_bar")))


@query(B.with_sql("s", """, c AS (SELECT i AS channel, (power(10, (21.4 * log10(1 + 0.00437 * 50) + (21.4 * log10(1 + 0.00437 * 8000) - 21.4 * log10(1 + 0.00437 * 50)) * i / 15) / 21.4) - 1) / 0.00437 AS centre FROM range(16) t(i)),
    w AS (SELECT channel, centre, k, 1 / (1 + power((f - centre) / (1.5 * 24.7 * (4.37 * centre / 1000 + 1)), 4)) AS w FROM c, (SELECT DISTINCT k, f FROM s))
    SELECT vec_id, CAST(channel AS INTEGER) AS channel, round(any_value(centre), 6) AS centre, round(sum(CASE WHEN f <= 0 THEN 0 ELSE w END * p) / sum(CASE WHEN f <= 0 THEN 0 ELSE w END), 9) AS envelope FROM s JOIN w USING (k) GROUP BY vec_id, channel"""))
def a28_erb_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-27, A-28: auditory bank of 16 channels and its envelopes, by array folds in each row."""
    df = spectral.erb_envelopes(B.frames(spark, sf_dir), "samples", B.BINS, B.RATE)
    return df.select("vec_id", "channel", F.round("centre", 6).alias("centre"), F.round("envelope", 9).alias("envelope"))


@query(B.with_sql("ser", """, f AS (SELECT *, onset >= 0.5 AS on_ FROM ser), g AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY track, on_ ORDER BY frame_idx) AS grp FROM f)
    SELECT track, CAST(min(frame_idx) AS INTEGER) AS first, CAST(max(frame_idx) AS INTEGER) AS last, count(*) AS frames, round(avg(onset), 6) AS mean, round(max(onset), 6) AS highest FROM g WHERE on_ GROUP BY track, grp"""))
def a32_activity_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-32, W-07, W-08: maximal runs of frames with onset of 0.5 or more."""
    runs = windows.islands(B.series(spark, sf_dir), F.col("onset") >= 0.5, "track", "frame_idx")
    return B.rounded(runs.groupBy("track", "island").agg(F.min("frame_idx").alias("first"), F.max("frame_idx").alias("last"), F.count("*").alias("frames"), F.avg("onset").alias("mean"), F.max("onset").alias("highest")).drop("island"))


@query(B.with_sql("ser", """, r AS (SELECT *, CAST(floor(frame_idx / 10) AS INTEGER) AS segment FROM ser), n AS (SELECT *, row_number() OVER (PARTITION BY track, segment ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY track, segment) AS n FROM r)
    SELECT track, segment, round(avg(rms), 6) AS mean, round(min(rms), 6) AS lowest, round(max(rms), 6) AS highest, round(avg(rms) FILTER (i <= greatest(1, ceil(n * 0.2))), 6) AS head,
      round(avg(rms) FILTER (i > n - greatest(1, ceil(n * 0.2))), 6) AS tail, round(avg(CASE WHEN onset > greatest(0.45, q) THEN 1.0 ELSE 0 END), 6) AS density
    FROM n JOIN (SELECT track, segment, quantile_cont(onset, 0.75) AS q FROM r GROUP BY ALL) USING (track, segment) GROUP BY track, segment"""))
def g01_segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-01 to G-03: mean, extremes, edge means over a fifth of the frames, and onset density against the segment's own quartile."""
    w = Window.partitionBy("track", "segment")
    df = B.series(spark, sf_dir).withColumn("segment", F.floor(F.col("frame_idx") / B.SEGMENT_FRAMES).cast("int"))
    df = df.withColumns({"i": F.row_number().over(w.orderBy("frame_idx")), "n": F.count("*").over(w), "q": F.percentile("onset", F.lit(0.75)).over(w)})
    edge = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.2))
    out = df.groupBy("track", "segment").agg(
        F.avg("rms").alias("mean"), F.min("rms").alias("lowest"), F.max("rms").alias("highest"),
        F.avg(F.when(F.col("i") <= edge, F.col("rms"))).alias("head"), F.avg(F.when(F.col("i") > F.col("n") - edge, F.col("rms"))).alias("tail"),
        F.avg((F.col("onset") > F.greatest(F.lit(0.45), F.col("q"))).cast("double")).alias("density"),
    )
    return B.rounded(out)


@query(B.with_sql("seg", f""", x AS ({scorers.SPACE_SQL.format(source="seg")}) SELECT track, segment, {_r(*scorers.SPACE)} FROM x"""))
def x01_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-01: pressure, width, height, distance, spread, motion and envelopment of each segment."""
    return B.rounded(scorers.space(B.segments(spark, sf_dir)).select("track", "segment", *scorers.SPACE))


@query(B.with_sql("seg", f""", x AS ({scorers.SPACE_SQL.format(source="seg")}), o AS ({scorers.OBJECTS_SQL.format(source="x")}) SELECT track, segment, {_r(*scorers.OBJECTS)}, dominant FROM o"""))
def x04_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-04, T-01: five object scores and the three strongest."""
    return B.rounded(scorers.objects(scorers.space(B.segments(spark, sf_dir))).select("track", "segment", *scorers.OBJECTS, "dominant"))


@query(B.with_sql("seg", f""", x AS ({scorers.SPACE_SQL.format(source="seg")}), o AS ({scorers.OBJECTS_SQL.format(source="x")}), l AS (UNPIVOT (SELECT track, segment, {", ".join(scorers.OBJECTS)} FROM o) ON {", ".join(scorers.OBJECTS)} INTO NAME stream VALUE support)
    SELECT track, stream, round(avg(support), 6) AS mean, round(max(support), 6) AS highest, round(avg(CASE WHEN support >= 0.38 THEN 1.0 ELSE 0 END), 6) AS coverage,
      CASE WHEN avg(support) >= 0.78 THEN 'dominant' WHEN avg(support) >= 0.58 THEN 'pronounced' WHEN avg(support) >= 0.38 THEN 'moderate' WHEN avg(support) >= 0.18 THEN 'restrained' ELSE 'reduced' END AS band FROM l GROUP BY track, stream"""))
def g08_stream_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-08, F-03: mean, maximum, coverage and band of each stream of a track; the flagship query."""
    long = scorers.objects(scorers.space(B.segments(spark, sf_dir))).unpivot(["track", "segment"], scorers.OBJECTS, "stream", "support")
    out = long.groupBy("track", "stream").agg(F.avg("support").alias("mean"), F.max("support").alias("highest"), F.avg((F.col("support") >= 0.38).cast("double")).alias("coverage"))
    return B.rounded(out.withColumn("band", S.band(F.col("mean"), S.SUPPORT_BANDS)))


@query(B.with_sql("seg", f""", x AS ({scorers.SPACE_SQL.format(source="seg")}), b AS (SELECT track, segment, CASE WHEN pressure >= 0.78 THEN 'dominant' WHEN pressure >= 0.58 THEN 'pronounced' WHEN pressure >= 0.38 THEN 'moderate' WHEN pressure >= 0.18 THEN 'restrained' ELSE 'reduced' END AS band FROM x),
    c AS (SELECT *, sum(ch) OVER (PARTITION BY track ORDER BY segment) AS run FROM (SELECT *, CASE WHEN lag(band) OVER (PARTITION BY track ORDER BY segment) IS NOT DISTINCT FROM band THEN 0 ELSE 1 END AS ch FROM b))
    SELECT track, CAST(run AS BIGINT) AS run, band, min(segment) AS first, max(segment) AS last, count(*) AS n FROM c GROUP BY ALL"""))
def w06_run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-06: runs of segments with the same pressure band."""
    df = scorers.space(B.segments(spark, sf_dir)).withColumn("band", S.band(F.col("pressure"), S.SUPPORT_BANDS))
    return windows.run_lengths(df, "band", "track", "segment")


@query(B.with_sql("seg", f""", x AS ({scorers.SPACE_SQL.format(source="seg")}) SELECT track, segment, {", ".join(f"round({c} - lag({c}) OVER (PARTITION BY track ORDER BY segment), 6) AS d_{c}" for c in scorers.SPACE)} FROM x"""))
def w01_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-01: change of the space scores against the segment before."""
    w = Window.partitionBy("track").orderBy("segment")
    df = scorers.space(B.segments(spark, sf_dir))
    return B.rounded(df.select("track", "segment", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in scorers.SPACE]))


@query(B.with_sql("ser", """, m AS (SELECT track, frame_idx, onset, lag(onset) OVER o AS b, lead(onset) OVER o AS a FROM ser WINDOW o AS (PARTITION BY track ORDER BY frame_idx)),
    p AS (SELECT track, frame_idx, onset, row_number() OVER (PARTITION BY track ORDER BY round(onset, 9) DESC, frame_idx) AS rank FROM m WHERE onset >= a AND onset >= b) SELECT track, CAST(frame_idx AS INTEGER) AS frame_idx, round(onset, 6) AS onset, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 16"""))
def w02_local_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-02, A-21: frames at least as strong as both neighbours, the sixteen strongest of a track."""
    df = B.series(spark, sf_dir)
    peaks = df.where("true").withColumn("_peak", windows.local_maxima("onset", "track", "frame_idx")).where("_peak")
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.round("onset", 9).desc(), "frame_idx"))
    return B.rounded(peaks.select("track", "frame_idx", "onset", rank.alias("rank")).where("rank <= 16"))


@query("WITH RECURSIVE" + B.with_sql("ser", f""", m AS (SELECT track, frame_idx, t, sum(novelty) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) / 15 AS ma FROM ser),
    n AS (SELECT *, {B.norm_sql("ma")} AS nov, max(t) OVER tr + 0.1 AS duration FROM m WINDOW tr AS (PARTITION BY track)),
    q AS (SELECT *, quantile_cont(nov, 0.82) OVER (PARTITION BY track) AS q82, lag(nov) OVER o AS a, lead(nov) OVER o AS b FROM n WINDOW o AS (PARTITION BY track ORDER BY frame_idx)),
    c AS (SELECT track, frame_idx, t, duration, nov, row_number() OVER (PARTITION BY track ORDER BY round(nov, 9) DESC, t) AS i FROM q WHERE nov >= a AND nov >= b AND nov >= greatest(0.38, q82)),
    g AS (SELECT DISTINCT track, CAST(0 AS BIGINT) AS i, [0.0::DOUBLE, duration] AS kept FROM c UNION ALL
      SELECT g.track, c.i, CASE WHEN list_min(list_transform(kept, lambda x: abs(x - c.t))) >= 0.8 THEN list_append(kept, c.t) ELSE kept END FROM g JOIN c ON c.track = g.track AND c.i = g.i + 1)
    SELECT c.track, CAST(c.frame_idx AS INTEGER) AS frame_idx, round(c.t, 6) AS t, round(nov, 6) AS score FROM c JOIN (SELECT track, kept FROM g QUALIFY row_number() OVER (PARTITION BY track ORDER BY i DESC) = 1) l ON l.track = c.track AND list_contains(l.kept, c.t)""").removeprefix("WITH"))
def w03_spaced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-02, W-03, H-01: peaks of the smoothed, normalised novelty from max(0.38, its 82 % quantile), thinned to at least 0.8 s from each other and both ends."""
    track = Window.partitionBy("track")
    df = B.series(spark, sf_dir).select("track", "frame_idx", "t", spectral.moving_average("novelty", 15, "track", "frame_idx").alias("_ma"), (F.max("t").over(track) + B.HOP).alias("duration"))
    df = df.withColumn("score", spectral.normalised(F.col("_ma"), "track"))
    df = df.withColumn("_least", F.greatest(F.lit(0.38), F.percentile("score", F.lit(0.82)).over(track)))
    peaks = df.withColumn("_peak", windows.local_maxima("score", "track", "frame_idx")).where("_peak AND score >= _least")
    peaks = peaks.select("track", "frame_idx", "t", F.round("score", 9).alias("score"), "duration")
    return B.rounded(windows.spaced_peaks(peaks, "track", "t", "score", 0.8, "duration").drop("duration"))


@query(B.with_sql("ser", "SELECT track, round(quantile_cont(d, 0.5), 6) AS hop FROM (SELECT track, t - lag(t) OVER (PARTITION BY track ORDER BY frame_idx) AS d FROM ser) GROUP BY track"))
def a35_median_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = B.frames(spark, sf_dir).withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("track").orderBy("frame_idx")))
    return B.rounded(df.groupBy("track").agg(F.percentile("d", F.lit(0.5)).alias("hop")))


_STRENGTHS = [f"strength_of_{n}" for n in scorers.RELATIONS]


@query(B.with_sql("seg", f""", x AS ({scorers.applied_sql([*scorers.SPACE_STAGES, scorers.OBJECT_SCORES, scorers.RULES], "seg")}) SELECT track, segment, relations, {_r(*_STRENGTHS)}, tags, role, round(role_confidence, 6) AS role_confidence FROM x"""))
def x07_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-05 to X-07: relations with strengths, style tags, section role and its confidence."""
    df = scorers.rules(scorers.objects(scorers.space(B.segments(spark, sf_dir))))
    return B.rounded(df.select("track", "segment", "relations", *_STRENGTHS, "tags", "role", "role_confidence"))


@query(B.with_sql("seg", f""", x AS ({scorers.SPACE_SQL.format(source="seg")}), o AS ({scorers.OBJECTS_SQL.format(source="x")}), l AS (UNPIVOT (SELECT track, segment, {", ".join(scorers.OBJECTS)} FROM o) ON {", ".join(scorers.OBJECTS)} INTO NAME lane VALUE v),
    z AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd, lag(v, 1, 0.0) OVER (PARTITION BY track, lane ORDER BY segment) AS b FROM l WINDOW w AS (PARTITION BY track, lane))
    SELECT track, segment, lane, round(r, 6) AS relative, round(greatest(v - b, 0), 6) AS entry, round(greatest(b - v, 0), 6) AS leave, round(greatest(0, least(1, 0.40 * v + 0.42 * r + 0.18 * least(1, 2 * greatest(v - b, 0)))), 6) AS score
    FROM (SELECT *, greatest(0, least(1, 0.5 + CASE WHEN sd > 1e-9 THEN (v - m) / sd ELSE 0 END / 3)) AS r FROM z)"""))
def w11_lane_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-11, G-25: a lane's level against the track's own mean and deviation, with entries and exits."""
    long = scorers.objects(scorers.space(B.segments(spark, sf_dir))).unpivot(["track", "segment"], scorers.OBJECTS, "lane", "v")
    w = Window.partitionBy("track", "lane")
    before = F.lag("v", 1, 0.0).over(w.orderBy("segment"))
    sd = F.stddev_pop("v").over(w)
    z = F.when(sd > 1e-9, (F.col("v") - F.avg("v").over(w)) / sd).otherwise(0.0)
    df = long.withColumns({"relative": S.clamp(0.5 + z / 3), "entry": F.greatest(F.col("v") - before, F.lit(0.0)), "leave": F.greatest(before - F.col("v"), F.lit(0.0))})
    score = S.clamp(0.40 * F.col("v") + 0.42 * F.col("relative") + 0.18 * F.least(F.lit(1.0), 2 * F.col("entry")))
    return B.rounded(df.select("track", "segment", "lane", "relative", "entry", "leave", score.alias("score")))
