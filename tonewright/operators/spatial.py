"""Spatial evidence of two-channel frames: cross-spectra, coherence and phase by band, soft support for six streams.

Phase lives only between the two spectra of one frame, which Arrow batches of frames work out
together; all that looks across frames is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .auditory import STRETCH
from .quantiles import spread_back
from .scorers import Stage, band, clamp

EPS = 1e-12
# Frame and hop in seconds, the smallest frame, and the edges of the bands in hertz (the last is open).
FRAME_SECONDS, HOP_SECONDS, LEAST_FRAME = 0.092, 0.046, 512
BANDS: dict[str, tuple[float, float | None]] = {
    "sub_low": (20.0, 80.0),
    "low_impact": (20.0, 150.0),
    "low_sustain": (80.0, 250.0),
    "low_mid": (150.0, 500.0),
    "mid": (250.0, 4000.0),
    "presence": (1000.0, 4000.0),
    "high": (4000.0, None),
}
WHOLE = ["level", "flatness", "side_ratio", "correlation", "phase", "primary_share", "ambient_share"]
BY_BAND = [f"{b}_{x}" for b in BANDS for x in ("ratio", "corr", "phase")]


def _clip(x: np.ndarray, low: float = 0.0) -> np.ndarray:
    return np.clip(x, low, 1.0)


def _phase(cross: np.ndarray) -> np.ndarray:
    """Mean distance of the phases, in half turns, weighted by the cross-spectrum's size."""
    weight = np.abs(cross)
    whole = weight.sum(axis=1)
    return np.where(whole > EPS, _clip((np.abs(np.angle(cross)) / np.pi * weight).sum(axis=1) / (whole + EPS)), 0.0)


def frame_evidence(left: np.ndarray, right: np.ndarray, size: int, rate: float) -> dict[str, np.ndarray]:
    """Evidence of frames with equally many samples, one a row, padded with zeros to `size` under a Hann window."""
    n = left.shape[1]
    window = np.hanning(size)[:n]
    ls, rs = (np.fft.rfft(x * window, size, axis=1) for x in (left, right))
    mono, apart = np.abs(ls + rs) / 2, np.abs(ls - rs) / 2
    power = mono**2
    whole, side = power.sum(axis=1), (apart**2).sum(axis=1)
    centred = [x - x.mean(axis=1, keepdims=True) if n else x for x in (left, right)]
    scale = np.linalg.norm(centred[0], axis=1) * np.linalg.norm(centred[1], axis=1)
    corr = np.where(scale > EPS, np.clip((centred[0] * centred[1]).sum(axis=1) / np.where(scale > EPS, scale, 1), -1, 1), 0.0)
    cross = ls * np.conj(rs)
    phase, ratio = _phase(cross), side / (whole + EPS)
    soft = ratio / (ratio + 1)
    out = {
        "level": np.sqrt(((left**2).mean(axis=1) + (right**2).mean(axis=1)) / 2) if n else np.zeros(len(left)),
        "flatness": np.exp(np.log(power + EPS).mean(axis=1)) / (power.mean(axis=1) + EPS),
        "side_ratio": soft,
        "correlation": (corr + 1) / 2,
        "phase": phase,
        "primary_share": _clip(whole / (whole + side + EPS) * (corr + 1) / 2),
        "ambient_share": _clip(soft * (1 - (corr + 1) / 2) + phase / 2),
    }
    at = np.fft.rfftfreq(size, 1 / rate)
    for name, (low, high) in BANDS.items():
        mask = (at >= low) & ((at < high) if high is not None else True)
        here = cross[:, mask]
        apiece = np.sqrt((np.abs(ls[:, mask]) ** 2).sum(axis=1) * (np.abs(rs[:, mask]) ** 2).sum(axis=1)) + EPS
        out[f"{name}_ratio"] = power[:, mask].sum(axis=1) / (whole + EPS)
        out[f"{name}_corr"] = np.clip(here.real.sum(axis=1) / apiece, -1, 1)
        out[f"{name}_phase"] = _phase(here)
    return out | {"mono": mono}


def _evidence_udf(size: int, rate: float):
    fields = [StructField(n, DoubleType()) for n in [*WHOLE, *BY_BAND]] + [StructField("mono", ArrayType(DoubleType()))]

    @F.pandas_udf(StructType(fields))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for left, right in batches:
            parts = []
            for n, rows in left.groupby(left.str.len()):
                stacked = [np.array(x.loc[rows.index].tolist(), float).reshape(len(rows), n) for x in (left, right)]
                found = frame_evidence(*stacked, size, rate)
                parts.append(pd.DataFrame({c: list(v) if c == "mono" else v for c, v in found.items()}, index=rows.index))
            yield pd.concat(parts).loc[left.index] if parts else pd.DataFrame({f.name: [] for f in fields})

    return run


# Weights of the supports that streams are made of, and the parts of each stream.
SUPPORTS: list[Stage] = [
    {"transient": clamp("0.75 * flux_level + 0.25 * loudness"), "harmonicity": clamp("1 - flatness")},
    {
        "sustain": clamp("0.45 * loudness + 0.35 * harmonicity + 0.20 * (1 - transient)"),
        "diffuse": clamp("0.35 * side_ratio + 0.35 * (1 - correlation) + 0.30 * phase"),
        "focus": clamp("0.45 * correlation + 0.35 * primary_share + 0.20 * (1 - side_ratio)"),
    },
]


def _mean(*parts: str) -> str:
    return clamp(f"({' + '.join(f'({x})' for x in parts)}) / {len(parts)}.0")


_REST = ["focus", "n_low_impact", "n_low_sustain", "n_mid", "side_ratio", "diffuse", "transient", "sustain"]
STREAMS: Stage = {
    "center_mid_lead": _mean("n_mid", "n_presence", "focus", "0.7 * harmonicity + 0.3 * sustain", "primary_share"),
    "center_low_impact": _mean("n_low_impact", "transient", "focus", "primary_share", "1 - diffuse"),
    "center_low_sustain": _mean("n_low_sustain", "sustain", "focus", "harmonicity", "primary_share"),
    "side_harmonic_space": _mean("side_ratio", "harmonicity", "sustain", "n_mid", "0.45 * diffuse + 0.55 * ambient_share"),
    "wide_diffuse_texture": _mean("diffuse", "ambient_share", "0.5 * n_high + 0.5 * flatness", "side_ratio", "1 - focus"),
    "residual_unassigned": clamp(f"(1 - greatest({', '.join(_REST)})) * ({' + '.join(_REST)}) / {len(_REST)}.0"),
}
#: Columns that are put between 0 and 1 by their track's extremes.
SPANNED = {"loudness": "level", "flux_level": "flux", **{f"n_{b}": f"{b}_ratio" for b in ("low_impact", "low_sustain", "mid", "presence", "high")}}
BANK = [*WHOLE, *BY_BAND, "flux", *SPANNED, *[n for stage in SUPPORTS for n in stage]]


def frame_bank(frames: DataFrame, left: Column, right: Column, size: int, rate: float) -> DataFrame:
    """Adds BANK and STREAMS to frames (track, frame_idx, t) with arrays of samples of both channels, `size` at most.

    frame_idx counts on without gaps; the spectrum of the frame before comes from the same stretch or its halo.
    """
    both = [F.transform(x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0))) for x in (left, right)]
    df = frames.select("track", "frame_idx", "t", _evidence_udf(size, rate)(*both).alias("z")).select("track", "frame_idx", "t", "z.*")
    part = F.floor(F.col("frame_idx") / STRETCH)
    edge = df.where(F.col("frame_idx") % STRETCH == STRETCH - 1).withColumns({"_part": part + 1, "_halo": F.lit(True)})
    rows = df.withColumns({"_part": part, "_halo": F.lit(False)}).unionByName(edge)
    rows = rows.withColumn("_before", F.lag("mono").over(Window.partitionBy("track", "_part").orderBy("frame_idx"))).where("NOT _halo")
    rise = F.zip_with("mono", "_before", lambda a, b: F.pow(F.greatest(a - b, F.lit(0.0)), F.lit(2)))
    flux = F.when(F.col("_before").isNull(), 0.0).otherwise(F.sqrt(F.aggregate(rise, F.lit(0.0), lambda s, x: s + x) / F.size("mono")))
    rows = rows.withColumn("flux", flux).drop("mono", "_before", "_part", "_halo")
    ends = rows.groupBy("track").agg(*[f(c).alias(f"_{x}_{n}") for n, c in SPANNED.items() for x, f in (("a", F.min), ("b", F.max))])
    rows = spread_back(rows, ends, ["track"], F.col("frame_idx"))
    spanned = {n: F.when(F.col(f"_b_{n}") - F.col(f"_a_{n}") > EPS, (F.col(c) - F.col(f"_a_{n}")) / (F.col(f"_b_{n}") - F.col(f"_a_{n}"))).otherwise(0.0) for n, c in SPANNED.items()}
    rows = rows.withColumns(spanned).drop(*[f"_{x}_{n}" for n in SPANNED for x in "ab"])
    for stage in [*SUPPORTS, STREAMS]:
        rows = rows.withColumns({n: F.expr(e) for n, e in stage.items()})
    return rows


#: What a stream's weighted means are taken of, and the least support from which a segment counts as active.
WEIGHED = ["side_ratio", "correlation", "phase", "primary_share", "ambient_share", "focus", "diffuse", "transient", "sustain", "harmonicity", "low_impact_ratio", "low_sustain_ratio", "mid_ratio", "presence_ratio", "high_ratio", "flatness"]
ACTIVE, FAINT = 0.38, 0.18


def long_streams(bank: DataFrame) -> DataFrame:
    """A row for each frame and stream, with its support."""
    return bank.withColumn("_z", F.explode(F.array(*[F.struct(F.lit(n).alias("stream"), F.col(n).alias("support")) for n in STREAMS]))).withColumns({"stream": F.col("_z.stream"), "support": F.col("_z.support")}).drop("_z")


def segment_supports(bank: DataFrame, segments: DataFrame) -> DataFrame:
    """(track, segment, stream, start_s, end_s, mean, highest): support of each stream in each segment (track, segment, start_s, end_s).

    A segment without frames takes the frame nearest to its middle, the earlier of two. Segments and frames meet by
    seconds: a segment is listed under each second that it touches.
    """
    span = F.sequence(F.floor("start_s"), F.greatest(F.floor("start_s"), F.ceil("end_s") - 1))
    seconds = segments.withColumn("_s", F.explode(span))
    rows = bank.withColumn("_s", F.floor(F.col("t"))).join(seconds, ["track", "_s"]).where("t >= start_s AND t < end_s")
    long = long_streams(rows)
    found = long.groupBy("track", "segment", "stream").agg(F.avg("support").alias("mean"), F.max("support").alias("highest"))
    # segments in which no frame lies: the nearest frames on both sides, by one running look over frames and middles
    bare = segments.join(found.select("track", "segment").distinct(), ["track", "segment"], "left_anti")
    middle = bare.select("track", ((F.col("start_s") + F.col("end_s")) / 2).alias("t"), F.col("segment").alias("_of"), F.lit(None).cast("struct<t:double,streams:array<double>>").alias("_f"))
    frame = F.struct(F.col("t"), F.array(*STREAMS).alias("streams"))
    looked = bank.join(bare.select("track").distinct(), "track", "left_semi").select("track", "t", F.lit(None).cast(dict(segments.dtypes)["segment"]).alias("_of"), frame.alias("_f")).unionByName(middle)
    w = Window.partitionBy("track").orderBy("t")
    near = looked.withColumns({"_a": F.last("_f", True).over(w), "_b": F.first("_f", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))}).where("_of IS NOT NULL")
    best = F.when(F.col("_b").isNull() | (F.col("t") - F.col("_a.t") <= F.col("_b.t") - F.col("t")), F.col("_a")).otherwise(F.col("_b"))
    lone = near.select("track", F.col("_of").alias("segment"), F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in STREAMS]).alias("stream"), best["streams"].alias("mean"))).alias("z"))
    lone = lone.select("track", "segment", "z.stream", "z.mean", F.col("z.mean").alias("highest"))
    return segments.select("track", "segment", "start_s", "end_s").join(found.unionByName(lone), ["track", "segment"])


def stream_packets(bank: DataFrame, supports: DataFrame, most: int = 6) -> DataFrame:
    """One row for each track and stream: support, coverage, status, weighted means, what it points to, and its strongest segments.

    Weights are the support, 0.05 at least.
    """
    weight = F.greatest(F.col("support"), F.lit(0.05))
    means = [(F.sum(F.col(c) * weight) / (F.sum(weight) + EPS)).alias(f"w_{c}") for c in WEIGHED]
    whole = long_streams(bank).groupBy("track", "stream").agg(F.avg("support").alias("mean_support"), F.max("support").alias("max_support"), *means)
    rank = F.row_number().over(Window.partitionBy("track", "stream").orderBy(F.round("mean", 9).desc(), "segment"))
    top = supports.withColumn("_k", rank)
    parts = top.groupBy("track", "stream").agg(F.avg((F.col("mean") >= ACTIVE).cast("double")).alias("coverage"), F.sort_array(F.collect_list(F.when(F.col("_k") <= most, F.struct("_k", F.col("segment").cast("string").alias("s")))))["s"].alias("_top"))
    df = whole.join(parts, ["track", "stream"], "left").withColumns({"coverage": F.coalesce("coverage", F.lit(0.0)), "strongest": F.array_join(F.coalesce("_top", F.array().cast("array<string>")), ",")}).drop("_top")
    for stage in PACKET:
        df = df.withColumns({n: F.expr(e) for n, e in stage.items()})
    return df


def _targets() -> str:
    def some(*steps: tuple[str, str]) -> str:
        return "coalesce(nullif(concat_ws(';', " + ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in steps) + "), ''), 'stream_level_ome_required')"

    # What the streams point to, by their weighted means.
    by_stream = {
        "center_mid_lead": some(("w_focus >= w_diffuse", "focused"), ("w_focus < w_diffuse", "stream_level_ome_required"), ("mean_support >= 0.38", "voice_like_or_lead_like"), ("w_high_ratio >= 0.45", "bright")),
        "center_low_impact": some(("w_transient >= 0.38 AND low >= 0.25", "focused;low_impact_like")),
        "center_low_sustain": some(("w_sustain >= 0.38 AND low >= 0.25 AND low >= w_high_ratio", "focused;bass_like;warm"), ("w_sustain >= 0.38 AND low >= 0.25 AND low < w_high_ratio", "focused;bass_like;dark")),
        "side_harmonic_space": some(("w_side_ratio >= 0.25 OR w_diffuse >= 0.35", "wide;diffuse"), ("w_sustain >= 0.35", "pad_like")),
        "wide_diffuse_texture": some(("w_diffuse >= 0.30", "diffuse;wide"), ("w_flatness >= 0.35 OR w_high_ratio >= 0.35", "reverb_air_or_haze_like"), ("w_ambient_share >= 0.35", "surrounding")),
        "residual_unassigned": some(("mean_support >= 0.18", "mixed_or_weak_residual_evidence")),
    }
    return f"CASE WHEN max_support < {FAINT} THEN 'stream_level_ome_required' " + " ".join(f"WHEN stream = '{n}' THEN {e}" for n, e in by_stream.items()) + " END"


PACKET: list[Stage] = [
    {"low": "greatest(w_low_impact_ratio, w_low_sustain_ratio)"},
    {
        "status": f"CASE WHEN coverage <= 0 AND max_support < {ACTIVE} THEN 'weak_or_inactive' ELSE 'runtime' END",
        "support_band": band("mean_support"),
        "targets": _targets(),
        "focus_diffuse": "CASE WHEN w_focus >= w_diffuse + 0.12 THEN 'focused' WHEN w_diffuse >= w_focus + 0.12 THEN 'diffuse' ELSE 'mixed_focus_diffuse' END",
        "width_band": band("greatest(w_side_ratio, w_diffuse)"),
        "stability_band": band("1 - w_phase"),
        "attack_sustain": "CASE WHEN w_transient > w_sustain THEN 'attack_forward' ELSE 'sustained' END",
        "weight": "CASE WHEN low > w_high_ratio THEN 'low_weighted' ELSE 'upper_weighted' END",
    },
]
