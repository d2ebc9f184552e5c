"""Queries from framing to the segment grid, with their SQL. Vectors of one label, end to end, stand for a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audio, spectral
from ..session import table
from . import bindings as B
from . import signal

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Pseudo samples of a frame and from frame to frame, and the seconds and tempo range that the series of a label are read with.
SIZE, STEP = 48, 40
HOP, LEAST_BPM, MOST_BPM = 0.05, 50.0, 200.0
LOW, HIGH = 6, 24


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(B.with_sql("s", f"""SELECT track, i AS frame_idx, i * {STEP} AS first_sample, CAST(count(*) AS INTEGER) AS n, round(sqrt(avg(p)), 6) AS rms
    FROM (SELECT track, p, g, last, CAST(floor(g / {STEP}) AS BIGINT) - b AS i FROM (SELECT track, p, frame_idx * 64 + k AS g, count(*) OVER (PARTITION BY track) AS last FROM s), (VALUES (0), (1)) d(b))
    WHERE i >= 0 AND g - i * {STEP} < {SIZE} AND i < ceil(greatest(1, last - {SIZE}) / {STEP}) + 1 GROUP BY track, i"""))
def a01_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-01: overlapping frames of a recording that is kept in chunks."""
    chunks = B.frames(spark, sf_dir).select("track", (F.col("frame_idx") * B.BINS).cast("long").alias("start"), F.transform("samples", lambda v: v.cast("float")).alias("x"))
    chunks = chunks.withColumn("last", F.sum(F.size("x")).over(Window.partitionBy("track")))
    df = audio.framed(chunks, "track", "start", "last", ["x"], F.lit(SIZE), F.lit(STEP))
    level = F.sqrt(spectral.total(spectral.power("x")) / F.size("x"))
    return B.rounded(df.select("track", "frame_idx", "first_sample", F.size("x").alias("n"), level.alias("rms")))


@query(B.with_sql("s", """SELECT vec_id, CAST(b AS INTEGER) AS bin, round(sqrt(power(sum(x * cos(2 * pi() * k * b / 64)), 2) + power(sum(x * sin(2 * pi() * k * b / 64)), 2)), 6) AS magnitude
    FROM (SELECT vec_id, k, v * (0.5 - 0.5 * cos(2 * pi() * k / 63)) AS x FROM s), range(33) t(b) GROUP BY vec_id, b"""))
def a02_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-02: magnitudes of each vector's samples under a Hann window."""
    x = F.transform("samples", lambda v: v.cast("float"))
    df = B.frames(spark, sf_dir).select("vec_id", x.alias("x")).select("vec_id", audio.magnitudes("x", F.size("x")).alias("m"))
    return df.select("vec_id", F.posexplode("m").alias("bin", "m")).select("vec_id", "bin", F.round("m", 6).alias("magnitude"))


_N = B.norm_sql
ENVELOPE_SQL = f"""t1 AS (SELECT track, frame_idx, flux, greatest(rms - sum(rms) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 0) AS up FROM ser),
    t2 AS (SELECT track, frame_idx, 0.85 * {_N("flux")} + 0.15 * {_N("up")} AS x FROM t1 WINDOW tr AS (PARTITION BY track)),
    t3 AS (SELECT track, frame_idx, greatest(x - sum(x) OVER (PARTITION BY track ORDER BY frame_idx ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) / 31, 0) AS x FROM t2),
    t4 AS (SELECT track, frame_idx, {_N("x")} AS x FROM t3 WINDOW tr AS (PARTITION BY track)),
    env AS (SELECT track, frame_idx, x - avg(x) OVER (PARTITION BY track) AS envelope FROM t4)"""


def _envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.onset_envelope(B.series(spark, sf_dir), "flux", "rms", "track", "frame_idx")


@query(B.with_sql("ser", f", {ENVELOPE_SQL} SELECT track, CAST(frame_idx AS INTEGER) AS frame_idx, round(envelope, 6) AS envelope FROM env"))
def a20_onset_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-20: transients with slow swells taken off, centred."""
    return B.rounded(_envelope(spark, sf_dir).select("track", "frame_idx", "envelope"))


@query(B.with_sql("ser", f""", {ENVELOPE_SQL}, z AS (SELECT track, count(*) AS n, max(abs(envelope)) AS top FROM env GROUP BY track),
    r AS (SELECT a.track, b.frame_idx - a.frame_idx AS lag, sum(a.envelope * b.envelope) AS r FROM env a JOIN env b ON a.track = b.track AND b.frame_idx - a.frame_idx BETWEEN 0 AND {HIGH + 1} GROUP BY ALL),
    c AS (SELECT track, lag, 60 / (lag * {HOP}) AS bpm, round(r / first_value(r) OVER w, 9) AS c, lag(lag) OVER w AS l FROM r WINDOW w AS (PARTITION BY track ORDER BY lag)),
    nb AS (SELECT *, lag(c) OVER w AS c0, lead(c) OVER w AS c1 FROM c WINDOW w AS (PARTITION BY track ORDER BY lag)),
    p0 AS (SELECT *, lag > {LOW} AND lag < {HIGH} AND c >= c0 AND c >= c1 AS peak FROM nb WHERE lag BETWEEN {LOW} AND {HIGH}),
    p AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY c DESC, lag) AS rn, max(c) OVER (PARTITION BY track) AS high FROM (SELECT *, max(CASE WHEN peak THEN 1 ELSE 0 END) OVER (PARTITION BY track) AS any_peak, max(c) OVER (PARTITION BY track) AS top FROM p0) WHERE peak OR any_peak = 0),
    hi AS (SELECT track, max(c) AS high FROM c WHERE lag BETWEEN {LOW} AND {HIGH} GROUP BY track),
    b AS (SELECT track, lag, bpm, c FROM p WHERE rn = 1),
    calm AS (SELECT track, arg_min(lag, rn) AS lag, max(c) AS c FROM p WHERE rn <= 16 AND bpm BETWEEN 70 AND 145 GROUP BY track),
    ch AS (SELECT b.track, b.bpm AS raw, hi.high, CASE WHEN b.bpm <= 150 THEN b.lag WHEN h.bpm BETWEEN {LEAST_BPM} AND {MOST_BPM} AND h.c >= b.c * CASE WHEN b.bpm >= 165 THEN 0.35 ELSE 0.5 END THEN h.lag WHEN calm.c >= 0.55 * b.c THEN calm.lag ELSE b.lag END AS lag
      FROM b JOIN hi USING (track) LEFT JOIN c h ON h.track = b.track AND h.lag = 2 * b.lag LEFT JOIN calm ON calm.track = b.track),
    d AS (SELECT ch.*, c.bpm, c.c FROM ch JOIN c USING (track, lag)),
    o AS (SELECT track, CASE WHEN abs(raw - round_even(raw, 0)) < 0.35 THEN round_even(raw, 0) ELSE raw END AS raw_bpm, CASE WHEN abs(bpm - round_even(bpm, 0)) < 0.35 THEN round_even(bpm, 0) ELSE bpm END AS bpm, abs(bpm - raw) > 1 AS folded, greatest(0, least(1, c / (high + 1e-12))) AS confidence FROM d),
    fb AS (SELECT track, min(frame_idx) * {HOP} AS first_beat FROM (SELECT *, greatest(avg(envelope) OVER (PARTITION BY track), quantile_cont(envelope, 0.7) OVER (PARTITION BY track)) AS th FROM (
      SELECT env.* FROM env JOIN o USING (track) JOIN z USING (track) WHERE frame_idx < greatest(1, round_even(least(greatest(90 / bpm, 1.0), n * {HOP}) / {HOP}, 0)))) WHERE round(envelope, 9) >= round(th, 9) GROUP BY track)
    SELECT z.track, CASE WHEN ok THEN round(raw_bpm, 6) END AS raw_bpm, CASE WHEN ok THEN round(bpm, 6) END AS bpm, CASE WHEN ok THEN folded END AS folded, CASE WHEN ok THEN round(confidence, 6) ELSE 0 END AS confidence, CASE WHEN ok THEN round(CAST(first_beat AS DOUBLE), 6) END AS first_beat
    FROM (SELECT *, n >= 16 AND top > 1e-12 AND n > {HIGH} AS ok FROM z) z LEFT JOIN o USING (track) LEFT JOIN fb USING (track)"""))
def a23_refined_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-21 to A-23: lags of the highest peaks, folded to a slower pulse where that is sound, with confidence and first beat."""
    return B.rounded(audio.refined_tempo(_envelope(spark, sf_dir), "track", "frame_idx", HOP, LEAST_BPM, MOST_BPM))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.erb_envelopes(B.frames(spark, sf_dir), "samples", B.BINS, B.RATE).select("track", "frame_idx", "vec_id", "channel", "centre", "envelope")


#: Each channel's envelope, by the SQL of a28_erb_envelopes.
_CHANNELS_SQL = signal.ORACLES["a28_erb_envelopes"]


@query(f"""WITH m AS ({_CHANNELS_SQL}), l AS (SELECT label AS track, m.vec_id, channel, ln(1 + greatest(envelope, 0)) AS x FROM m JOIN embeddings e ON e.vec_id = m.vec_id)
    SELECT vec_id, channel, round(CASE WHEN q > 1e-12 THEN least(x / q, 1) ELSE 0 END, 4) AS level FROM (SELECT *, quantile_cont(x, 0.98) OVER (PARTITION BY track) AS q FROM l)""")
def a29_matrix_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-29: auditory envelopes on a logarithmic scale against their track's 98 % quantile."""
    df = _channels(spark, sf_dir).withColumn("envelope", F.round("envelope", 9))
    return df.select("vec_id", "channel", F.round(audio.matrix_level("envelope", "track"), 4).alias("level"))


@query(f"""WITH m AS ({_CHANNELS_SQL}), o AS (SELECT label AS track, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx FROM embeddings),
    a AS (SELECT track, frame_idx, band, avg(envelope) AS activity FROM m JOIN o USING (vec_id) JOIN (VALUES ('low', 20, 250), ('mid', 250, 4000), ('high', 4000, 20000), ('mid_high', 500, 12000)) b(band, lo, hi) ON centre >= lo AND centre < hi GROUP BY ALL),
    r AS (SELECT *, coalesce(greatest(activity - lag(activity) OVER (PARTITION BY track, band ORDER BY frame_idx), 0), 0) AS rise FROM a)
    SELECT track, band, CAST(frame_idx AS INTEGER) AS frame_idx, round(activity, 5) AS activity, round(CASE WHEN max(rise) OVER (PARTITION BY track, band) > 1e-12 THEN rise / max(rise) OVER (PARTITION BY track, band) ELSE 0 END, 5) AS transient FROM r""")
def a31_band_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-31: activity of four broad bands and its transients."""
    # Edges of the broad bands in hertz.
    bands = (("low", 20.0, 250.0), ("mid", 250.0, 4000.0), ("high", 4000.0, 20000.0), ("mid_high", 500.0, 12000.0))
    centre, level = F.round("centre", 6), F.round("envelope", 9)
    means = [F.avg(F.when((centre >= low) & (centre < high), level)).alias(name) for name, low, high in bands]
    long = _channels(spark, sf_dir).groupBy("track", "frame_idx").agg(*means).unpivot(["track", "frame_idx"], [b[0] for b in bands], "band", "activity").where("activity is not null")
    df = audio.transients(long.withColumn("_key", F.struct("track", "band")), "activity", "_key", "frame_idx")
    return df.select("track", "band", "frame_idx", F.round("activity", 5).alias("activity"), F.round("transient", 5).alias("transient"))


@query("""WITH n AS (SELECT label AS track, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
    SELECT DISTINCT track, vec_id FROM n, range(20) t(j) WHERE n <= 20 OR i = (j * (n - 1)) // 19""")
def a34_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-34: at most twenty evenly spread frames of each track."""
    df = B.frames(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("track")))
    return df.where(audio.in_preview("frame_idx", F.col("n"), 20)).select("track", "vec_id")


LEAST_SECONDS, MOST_SECONDS = 0.8, 4.5
_CHANGED = f"""list_filter(f, lambda x: x.t >= a + {LEAST_SECONDS} AND x.t <= z - {LEAST_SECONDS})"""
_MIDDLE = f"""list_filter(br, lambda x: x >= a + {LEAST_SECONDS} AND x <= z - {LEAST_SECONDS})"""
_HALVES = "unnest([{'a': a, 'z': c}, {'a': c, 'z': z}]) AS x"
_GRID_SQL = f"""ends AS (SELECT track, unnest([0.0::DOUBLE, max(t) + 0.1]) AS t FROM ser GROUP BY track),
    fr AS (SELECT track, list({{'t': t, 'n': novelty}} ORDER BY t) AS f FROM ser GROUP BY track),
    brs AS (SELECT track, list(t ORDER BY t) AS br FROM ({signal.ORACLES["a19_beat_grid"]}) WHERE is_bar GROUP BY track),
    b0 AS (SELECT track, list_sort(list_distinct(list(round(t, 3)))) AS b FROM (SELECT track, t FROM ends UNION ALL SELECT track, t FROM ({signal.ORACLES["w03_spaced_boundaries"]})) GROUP BY track),
    sp AS (SELECT track, b[i] AS a, b[i + 1] AS z FROM b0, range(1, 100000) r(i) WHERE i < len(b)
      UNION ALL SELECT track, x.a, x.z FROM (SELECT track, {_HALVES} FROM (SELECT *, round(CASE WHEN len(ins) > 0 THEN ins[list_position(list_transform(ins, lambda x: x.n), list_max(list_transform(ins, lambda x: x.n)))].t ELSE (a + z) / 2 END, 3) AS c
        FROM (SELECT track, a, z, {_CHANGED} AS ins FROM sp JOIN fr USING (track) WHERE z - a > {MOST_SECONDS})) WHERE c - a >= {LEAST_SECONDS} - 1e-9 AND z - c >= {LEAST_SECONDS} - 1e-9 AND a < c AND c < z)),
    k0 AS (SELECT track, list_sort(list_distinct(list_concat(list(a), list(z)))) AS b FROM sp GROUP BY track),
    kp AS (SELECT track, 2 AS i, [b[1], b[len(b)]] AS kept FROM k0 JOIN brs USING (track) WHERE len(b) > 2
      UNION ALL SELECT track, i + 1, CASE WHEN x - b[1] >= {LEAST_SECONDS} AND b[len(b)] - x >= {LEAST_SECONDS} AND list_min(list_transform(kept, lambda y: abs(x - y))) >= {0.75 * LEAST_SECONDS} THEN list_append(kept, x) ELSE kept END
        FROM (SELECT *, CASE WHEN abs(near - b[i]) <= {min(2.0, max(0.75, 0.2 * LEAST_SECONDS))} THEN near ELSE b[i] END AS x FROM (SELECT kp.*, b, br[list_position(list_transform(br, lambda v: abs(v - b[i])), list_min(list_transform(br, lambda v: abs(v - b[i]))))] AS near FROM kp JOIN k0 USING (track) JOIN brs USING (track) WHERE i < len(b)))),
    b2 AS (SELECT track, true AS snapped, list_sort(list_distinct(list_transform(kept, lambda x: round(x, 3)))) AS b FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY i DESC) AS k FROM kp) WHERE k = 1
      UNION ALL SELECT track, false, b FROM k0 WHERE track NOT IN (SELECT track FROM kp)),
    mp AS (SELECT track, snapped, b[i] AS a, b[i + 1] AS z FROM b2, range(1, 100000) r(i) WHERE i < len(b)
      UNION ALL SELECT track, true, x.a, x.z FROM (SELECT track, {_HALVES} FROM (SELECT *, round(CASE WHEN len(ins) > 0 THEN ins[list_position(list_transform(ins, lambda x: abs(x - (a + z) / 2)), list_min(list_transform(ins, lambda x: abs(x - (a + z) / 2))))] ELSE (a + z) / 2 END, 3) AS c
        FROM (SELECT track, a, z, {_MIDDLE} AS ins FROM mp JOIN brs USING (track) WHERE snapped AND z - a > {MOST_SECONDS})) WHERE a < c AND c < z)),
    bf AS (SELECT DISTINCT track, unnest([a, z]) AS t FROM mp)"""


@query(B.with_sql("ser", f""", {_GRID_SQL}
    SELECT track, CAST(row_number() OVER o - 1 AS BIGINT) AS segment, round(t, 6) AS start_s, round(lead(t) OVER o, 6) AS end_s FROM bf WINDOW o AS (PARTITION BY track ORDER BY t) QUALIFY lead(t) OVER o IS NOT NULL""").replace("WITH ", "WITH RECURSIVE ", 1))
def w05_segment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W-04, W-05: spaced boundaries, long stretches cut, moved to near bars; the SQL cuts and moves by recursion over lists."""
    ser = B.series(spark, sf_dir)
    ends = ser.groupBy("track").agg(F.explode(F.array(F.lit(0.0), F.max("t") + B.HOP)).alias("t"))
    inner = signal.w03_spaced_boundaries(spark, sf_dir).select("track", "t")
    bars = signal.a19_beat_grid(spark, sf_dir).where("is_bar").select("track", F.lit("bar").alias("kind"), "t")
    marks = ends.unionByName(inner).select("track", F.lit("boundary").alias("kind"), "t").unionByName(bars)
    return B.rounded(audio.split_and_snap(ser, marks, LEAST_SECONDS, MOST_SECONDS)).withColumn("segment", F.col("segment").cast("long"))


def _case(x: str, above, below, between: str) -> str:
    return "CASE " + " ".join([f"WHEN {x} >= {v} THEN '{n}'" for v, n in above] + [f"WHEN {x} <= {v} THEN '{n}'" for v, n in below]) + f" ELSE '{between}' END"


@query(f"""WITH x AS (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 10000 AS x FROM customer) SELECT c_custkey,
    {_case("x", S.BRIGHTNESS_ABOVE, S.BRIGHTNESS_BELOW, "balanced spectral weight")} AS brightness, {_case("x", S.DISTANCE_ABOVE, S.DISTANCE_BELOW, "mid-field / neutral distance")} AS distance,
    {_case("x", S.LATERAL_ABOVE, S.LATERAL_BELOW, "centered / balanced")} AS lateral, {_case("x", S.PHASE_ABOVE, S.PHASE_BELOW, "partly diffuse / weakly coherent")} AS phase,
    {_case("(x * 100 - 100)", S.LEVEL_ABOVE, S.LEVEL_BELOW, "low digital level")} AS level FROM x""")
def f05_signed_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-05: bands of brightness, distance, balance, phase and level, of account balances scaled to about [-0.1, 1]."""
    x = F.col("c_acctbal").cast("double") / 10000
    return table(spark, sf_dir, "customer").select("c_custkey", S.brightness_band(x).alias("brightness"), S.distance_band(x).alias("distance"), S.lateral_band(x).alias("lateral"), S.phase_band(x).alias("phase"), S.level_band(x * 100 - 100).alias("level"))
