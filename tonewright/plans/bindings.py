"""The domain's relations over the test tables: frames, signals, segments, intervals, comments, taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import spectral
from ..session import table

#: Pseudo sample rate and bins of the vectors that stand for spectra, and seconds from frame to frame.
RATE, BINS, HOP = 22050.0, 64, 0.1
SEGMENT_FRAMES = 10


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame_idx, t, vec_id, samples: one row for each vector, in order within its label."""
    order = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("track"), order.alias("frame_idx"), "vec_id", F.col("embedding").alias("samples"))
    return rows.withColumn("t", F.col("frame_idx") * HOP)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with level, spectral, mid/side and flux features."""
    df = spectral.spectral_features(spectral.level_features(frames(spark, sf_dir), "samples"), "samples", BINS, RATE)
    even = F.filter("samples", lambda v, i: i % 2 == 0)
    odd = F.filter("samples", lambda v, i: i % 2 == 1)
    cast = lambda a: F.transform(a, lambda v: v.cast("double"))
    df = spectral.mid_side(df, cast(even), cast(odd))
    return spectral.flux(df, "samples", "track", "frame_idx").drop("samples")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with the composite series onset, percussive and harmonic, and novelty."""
    df = features(spark, sf_dir)
    n = lambda c: spectral.normalised(F.col(c), "track")
    df = df.withColumns({"onset": 0.7 * n("flux") + 0.3 * n("rms"), "percussive": 0.65 * n("flux") + 0.35 * n("peak"), "harmonic": 1 - n("flatness")})
    return spectral.novelty(df, ["rms", "centroid", "bandwidth", "flatness", "low", "mid", "high", "side_ratio", "onset"], "track", "frame_idx")


MEANS = ["rms", "peak", "zcr", "centroid", "bandwidth", "rolloff", "flatness", "low", "mid", "high", "side_ratio", "balance", "phase", "flux", "onset", "percussive", "harmonic", "novelty"]
HIGHEST = {"rms_max": "rms", "peak_max": "peak", "side_max": "side_ratio", "flux_max": "flux", "onset_max": "onset"}
RANGES = {"dynamic": "rms", "lr_motion": "balance"}
#: Features whose means over the first and last fifth of a segment are kept.
EDGES = ["rms", "centroid", "low"]


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of each stretch of SEGMENT_FRAMES frames: means, extremes, edges and their change, onset density, and its track's duration.

    One pass: a segment's few edge values are kept as a sorted list, which a segment's length bounds.
    """
    df = series(spark, sf_dir).withColumn("segment", F.floor(F.col("frame_idx") / SEGMENT_FRAMES).cast("int"))
    listed = F.sort_array(F.collect_list(F.struct("frame_idx", *EDGES, "onset")))
    out = df.groupBy("track", "segment").agg(
        F.min("t").alias("start_s"), (F.max("t") + HOP).alias("end_s"), F.count("*").alias("frames"), *[F.avg(c).alias(c) for c in MEANS],
        *[F.max(c).alias(n) for n, c in HIGHEST.items()], *[(F.max(c) - F.min(c)).alias(n) for n, c in RANGES.items()],
        F.percentile("onset", F.lit(0.75)).alias("_q"), listed.alias("_f"),
    )
    edge = F.greatest(F.lit(1), F.ceil(F.col("frames") * 0.2).cast("int"))
    mean = lambda part, c: F.aggregate(part, F.lit(0.0), lambda s, x: s + x[c]) / F.size(part)
    out = out.withColumns({"_a": F.slice("_f", F.lit(1), edge), "_b": F.slice("_f", -edge, edge)})
    out = out.withColumns({f"{c}_start": mean("_a", c) for c in EDGES} | {f"{c}_end": mean("_b", c) for c in EDGES})
    out = out.withColumns({f"{c}_delta": F.col(f"{c}_end") - F.col(f"{c}_start") for c in EDGES})
    dense = F.size(F.filter("_f", lambda x: x["onset"] > F.greatest(F.lit(0.45), F.col("_q")))) / F.col("frames")
    return out.withColumn("density", dense).withColumn("duration", F.max("end_s").over(Window.partitionBy("track"))).drop("_q", "_f", "_a", "_b")


#: The same relations for the SQL of the queries.
SQL = {
    "e": "e AS (SELECT label AS track, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, embedding FROM embeddings)",
    "s": """s AS (SELECT track, vec_id, frame_idx, k - 1 AS k, CAST(v AS DOUBLE) AS v, (k - 1) * 11025.0 / 63 AS f, CAST(v AS DOUBLE) * CAST(v AS DOUBLE) AS p
        FROM (SELECT track, vec_id, frame_idx, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM e))""",
    "level": """level AS (SELECT track, frame_idx, vec_id, sqrt(avg(p)) AS rms, max(abs(v)) AS peak, sum(flip) / 63.0 AS zcr FROM (
        SELECT *, CASE WHEN k > 0 AND (v < 0) <> (lag(v) OVER (PARTITION BY vec_id ORDER BY k) < 0) THEN 1 ELSE 0 END AS flip FROM s) GROUP BY ALL)""",
    "shape": """tot AS (SELECT vec_id, sum(p) + 1e-12 AS total, sum(f * p) / (sum(p) + 1e-12) AS centroid FROM s GROUP BY vec_id),
        roll AS (SELECT vec_id, min(f) FILTER (run >= 0.85 * total) AS rolloff FROM (SELECT s.vec_id, f, total, sum(p) OVER (PARTITION BY s.vec_id ORDER BY k) AS run FROM s JOIN tot USING (vec_id)) GROUP BY vec_id),
        shape AS (SELECT s.vec_id, any_value(centroid) AS centroid, sqrt(sum((f - centroid) * (f - centroid) * p) / any_value(total)) AS bandwidth,
          exp(sum(ln(p + 1e-12)) / 64) / (any_value(total) / 64 + 1e-12) AS flatness, coalesce(sum(p) FILTER (f < 250), 0) / any_value(total) AS low,
          coalesce(sum(p) FILTER (f >= 250 AND f < 4000), 0) / any_value(total) AS mid, coalesce(sum(p) FILTER (f >= 4000), 0) / any_value(total) AS high FROM s JOIN tot USING (vec_id) GROUP BY s.vec_id)""",
    "ms": """pair AS (SELECT a.vec_id, a.v AS l, b.v AS r FROM s a JOIN s b ON a.vec_id = b.vec_id AND b.k = a.k + 1 WHERE a.k % 2 = 0),
        ms AS (SELECT vec_id, sum((l - r) * (l - r) / 4) / (sum((l + r) * (l + r) / 4) + 1e-12) AS side_ratio, (sum(r * r) - sum(l * l)) / (sum(r * r) + sum(l * l) + 1e-12) AS balance,
          CASE WHEN sqrt(sum(l * l) * sum(r * r)) > 1e-12 THEN sum(l * r) / sqrt(sum(l * l) * sum(r * r)) ELSE 0 END AS phase FROM pair GROUP BY vec_id)""",
    "fl": """fl AS (SELECT vec_id, sqrt(sum(CASE WHEN b IS NULL THEN 0 ELSE greatest(a - b, 0) * greatest(a - b, 0) END) / 64) AS flux FROM (
        SELECT vec_id, abs(v) AS a, lag(abs(v)) OVER (PARTITION BY track, k ORDER BY frame_idx) AS b FROM s) GROUP BY vec_id)""",
    "feat": "feat AS (SELECT level.*, CAST(level.frame_idx AS DOUBLE) * 0.1 AS t, shape.* EXCLUDE (vec_id), ms.* EXCLUDE (vec_id), flux FROM level JOIN shape USING (vec_id) JOIN ms USING (vec_id) JOIN fl USING (vec_id))",
}


def norm_sql(column: str) -> str:
    return f"CASE WHEN max({column}) OVER tr - min({column}) OVER tr > 1e-12 THEN ({column} - min({column}) OVER tr) / (max({column}) OVER tr - min({column}) OVER tr) ELSE 0 END"


_NOVEL = ["rms", "centroid", "bandwidth", "flatness", "low", "mid", "high", "side_ratio", "onset"]
SQL["ser"] = f"""ser0 AS (SELECT *, 0.7 * {norm_sql("flux")} + 0.3 * {norm_sql("rms")} AS onset, 0.65 * {norm_sql("flux")} + 0.35 * {norm_sql("peak")} AS percussive, 1 - {norm_sql("flatness")} AS harmonic
        FROM feat WINDOW tr AS (PARTITION BY track)),
    ser1 AS (SELECT *, {", ".join(f"{norm_sql(c)} AS n_{c}" for c in _NOVEL)} FROM ser0 WINDOW tr AS (PARTITION BY track)),
    ser AS (SELECT * EXCLUDE ({", ".join(f"n_{c}" for c in _NOVEL)}), coalesce(({" + ".join(f"abs(n_{c} - lag(n_{c}) OVER o)" for c in _NOVEL)}) / 9, 0) AS novelty FROM ser1 WINDOW o AS (PARTITION BY track ORDER BY frame_idx))"""
_KEPT = ", ".join([f"avg({c}) AS {c}" for c in MEANS] + [f"max({c}) AS {n}" for n, c in HIGHEST.items()] + [f"max({c}) - min({c}) AS {n}" for n, c in RANGES.items()])
_EDGED = ", ".join(f"avg({c}) FILTER (i <= e) AS {c}_start, avg({c}) FILTER (i > n - e) AS {c}_end" for c in EDGES)
SQL["seg"] = f"""cut AS (SELECT ser.*, rolloff, CAST(floor(frame_idx / 10) AS INTEGER) AS segment FROM ser JOIN roll USING (vec_id)),
    edged AS (SELECT *, greatest(1, ceil(n * 0.2)) AS e FROM (SELECT *, row_number() OVER (PARTITION BY track, segment ORDER BY frame_idx) AS i, count(*) OVER (PARTITION BY track, segment) AS n, quantile_cont(onset, 0.75) OVER (PARTITION BY track, segment) AS q FROM cut)),
    seg0 AS (SELECT track, segment, min(t) AS start_s, max(t) + 0.1 AS end_s, count(*) AS frames, {_KEPT}, {_EDGED}, avg(CASE WHEN onset > greatest(0.45, q) THEN 1.0 ELSE 0.0 END) AS density FROM edged GROUP BY track, segment),
    seg AS (SELECT *, {", ".join(f"{c}_end - {c}_start AS {c}_delta" for c in EDGES)}, max(end_s) OVER (PARTITION BY track) AS duration FROM seg0)"""
CHAIN = ["e", "s", "level", "shape", "ms", "fl", "feat", "ser", "seg"]


def with_sql(last: str, body: str) -> str:
    """SQL with the relations up to `last` before the body."""
    return "WITH " + ",\n".join(SQL[c] for c in CHAIN[: CHAIN.index(last) + 1]) + "\n" + body


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
