"""Queries of the spatial frame bank and its streams, with their SQL: a Fourier transform written out over samples and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scorers as S
from ..operators import spatial as P
from ..storage import stored
from . import bindings as B

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Samples a second and samples of a padded frame, at which 32 samples of a channel reach all bands.
RATE, SIZE = 9000.0, 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial evidence of each frame; every other value of a vector is a sample of the left channel, the rest of the right."""
    left, right = F.filter("samples", lambda v, i: i % 2 == 0), F.filter("samples", lambda v, i: i % 2 == 1)
    return P.frame_bank(B.frames(spark, sf_dir), left, right, SIZE, RATE)


def _phase_sql(where: str) -> str:
    whole = f"coalesce(sum(c){where}, 0)"
    return f"CASE WHEN {whole} > 1e-12 THEN {S.clamp(f'sum(abs(atan2(ci, cr)) / pi() * c){where} / ({whole} + 1e-12)')} ELSE 0 END"


def _bands_sql() -> str:
    out = []
    for n, (low, high) in P.BANDS.items():
        where = f" FILTER (f >= {low}" + (f" AND f < {high})" if high is not None else ")")
        out += [
            f"coalesce(sum(p){where}, 0) / (sum(p) + 1e-12) AS {n}_ratio",
            f"CASE WHEN count(*){where} = 0 THEN 0 ELSE {S.signed(f'sum(cr){where} / (sqrt(sum(lr * lr + li * li){where} * sum(rr * rr + ri * ri){where}) + 1e-12)')} END AS {n}_corr",
            f"{_phase_sql(where)} AS {n}_phase",
        ]
    return ", ".join(out)


_SPANS = ", ".join(f"CASE WHEN max({c}) OVER tr - min({c}) OVER tr > 1e-12 THEN ({c} - min({c}) OVER tr) / (max({c}) OVER tr - min({c}) OVER tr) ELSE 0 END AS {n}" for n, c in P.SPANNED.items())
BANK_SQL = f""", smp AS (SELECT track, frame_idx, k // 2 AS n, max(v) FILTER (k % 2 = 0) AS l, max(v) FILTER (k % 2 = 1) AS r FROM s GROUP BY ALL),
    hn AS (SELECT *, l * (0.5 - 0.5 * cos(2 * pi() * n / {SIZE - 1})) AS lw, r * (0.5 - 0.5 * cos(2 * pi() * n / {SIZE - 1})) AS rw FROM smp),
    ft AS (SELECT track, frame_idx, b, sum(lw * cos(2 * pi() * b * n / {SIZE})) AS lr, -sum(lw * sin(2 * pi() * b * n / {SIZE})) AS li, sum(rw * cos(2 * pi() * b * n / {SIZE})) AS rr, -sum(rw * sin(2 * pi() * b * n / {SIZE})) AS ri
      FROM hn, range({SIZE // 2 + 1}) t(b) GROUP BY track, frame_idx, b),
    sp0 AS (SELECT *, b * {RATE} / {SIZE} AS f, (power(lr + rr, 2) + power(li + ri, 2)) / 4 AS p, (power(lr - rr, 2) + power(li - ri, 2)) / 4 AS q, lr * rr + li * ri AS cr, li * rr - lr * ri AS ci FROM ft),
    sp AS (SELECT *, sqrt(cr * cr + ci * ci) AS c, greatest(sqrt(p) - lag(sqrt(p)) OVER (PARTITION BY track, b ORDER BY frame_idx), 0) AS up FROM sp0),
    tm AS (SELECT track, frame_idx, sqrt((avg(l * l) + avg(r * r)) / 2) AS level, {S.signed("CASE WHEN var_pop(l) * var_pop(r) * 1024 > 1e-24 THEN covar_pop(l, r) / sqrt(var_pop(l) * var_pop(r)) ELSE 0 END")} AS co FROM smp GROUP BY track, frame_idx),
    fr AS (SELECT track, frame_idx, sum(p) AS whole, sum(q) AS side, exp(avg(ln(p + 1e-12))) / (avg(p) + 1e-12) AS flatness, {_phase_sql("")} AS phase, coalesce(sqrt(avg(up * up)), 0) AS flux, {_bands_sql()} FROM sp GROUP BY track, frame_idx),
    fb0 AS (SELECT fr.*, CAST(frame_idx AS DOUBLE) * 0.1 AS t, level, (co + 1) / 2 AS correlation, side / (whole + 1e-12) / (side / (whole + 1e-12) + 1) AS side_ratio FROM fr JOIN tm USING (track, frame_idx)),
    fb1 AS (SELECT *, {S.clamp("whole / (whole + side + 1e-12) * correlation")} AS primary_share, {S.clamp("side_ratio * (1 - correlation) + phase / 2")} AS ambient_share, {_SPANS} FROM fb0 WINDOW tr AS (PARTITION BY track)),
    fb AS ({S.applied_sql([*P.SUPPORTS, P.STREAMS], "fb1")})"""


@query(B.with_sql("s", BANK_SQL + "SELECT track, CAST(frame_idx AS INTEGER) AS frame_idx, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in P.BANK) + " FROM fb"))
def a24_frame_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-24, A-25: levels, correlation, coherence and phase difference of each frame, whole and in seven bands, and the supports made of them."""
    return bank(spark, sf_dir).select("track", "frame_idx", *[(F.round(c, 5) + 0.0).alias(c) for c in P.BANK])


@query(B.with_sql("s", BANK_SQL + "SELECT track, CAST(frame_idx AS INTEGER) AS frame_idx, " + ", ".join(f"round({c}, 5) AS {c}" for c in P.STREAMS) + " FROM fb"))
def a26_stream_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A-26: soft support of each frame for six streams; what is left over is the weaker, the stronger any other support is."""
    return bank(spark, sf_dir).select("track", "frame_idx", *[F.round(c, 5).alias(c) for c in P.STREAMS])


def segments(frames: DataFrame) -> DataFrame:
    """Stretches of SEGMENT_FRAMES frames as segments."""
    df = frames.withColumn("segment", F.floor(F.col("frame_idx") / B.SEGMENT_FRAMES).cast("int"))
    return df.groupBy("track", "segment").agg(F.min("t").alias("start_s"), ((F.max("frame_idx") + 1) * B.HOP).alias("end_s"))


_LONG = " UNION ALL ".join(f"SELECT *, '{n}' AS stream, {n} AS support FROM fb" for n in P.STREAMS)
STREAM_SQL = f"""{BANK_SQL}, ls AS ({_LONG}), sup AS (SELECT track, CAST(floor(frame_idx / {B.SEGMENT_FRAMES}) AS INTEGER) AS segment, stream, avg(support) AS mean, max(support) AS highest FROM ls GROUP BY ALL)"""


@query(B.with_sql("s", STREAM_SQL + f"SELECT track, segment, stream, round(mean, 5) AS mean, round(highest, 5) AS highest, {S.band('mean')} AS band FROM sup"))
def q7_segment_supports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-01, H-33, A-26: support of each stream in each segment; a segment without frames takes the nearest."""
    df = stored(bank(spark, sf_dir))
    out = P.segment_supports(df, segments(df))
    return out.select("track", "segment", "stream", F.round("mean", 5).alias("mean"), F.round("highest", 5).alias("highest"), F.expr(S.band("mean")).alias("band"))


_PACKED = ["status", "support_band", "targets", "focus_diffuse", "width_band", "stability_band", "attack_sustain", "weight", "strongest"]
_W = ", ".join(f"sum({c} * greatest(support, 0.05)) / (sum(greatest(support, 0.05)) + 1e-12) AS w_{c}" for c in P.WEIGHED)


@query(B.with_sql("s", STREAM_SQL + f""", wm AS (SELECT track, stream, avg(support) AS mean_support, max(support) AS max_support, {_W} FROM ls GROUP BY track, stream),
    st AS (SELECT track, stream, avg(CASE WHEN mean >= {P.ACTIVE} THEN 1.0 ELSE 0.0 END)::DOUBLE AS coverage, string_agg(CAST(segment AS VARCHAR), ',' ORDER BY k) FILTER (k <= 6) AS strongest
      FROM (SELECT *, row_number() OVER (PARTITION BY track, stream ORDER BY round(mean, 9) DESC, segment) AS k FROM sup) GROUP BY track, stream)
    SELECT track, stream, round(mean_support, 5) AS mean_support, round(max_support, 5) AS max_support, round(coverage, 5) AS coverage, {", ".join(f"round(w_{c}, 5) AS w_{c}" for c in P.WEIGHED)}, {", ".join(_PACKED)} FROM ({S.applied_sql(P.PACKET, "(SELECT * FROM wm JOIN st USING (track, stream))")})"""))
def q7_stream_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7, X-11, T-03: support, coverage, weighted means, labels and strongest segments of six streams of a track."""
    df = stored(bank(spark, sf_dir))
    out = P.stream_packets(df, P.segment_supports(df, segments(df)))
    numbers = ["mean_support", "max_support", "coverage", *[f"w_{c}" for c in P.WEIGHED]]
    return out.select("track", "stream", *[F.round(c, 5).alias(c) for c in numbers], *_PACKED)
