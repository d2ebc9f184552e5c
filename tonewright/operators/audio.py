"""From decoded audio to frames, spectra, tempo and a segment grid.

Long recordings are rows of chunks; a frame belongs to the chunk in which it starts and takes
what it lacks from the head of the next one, so that no file is put together whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import spectral
from .spectral import EPS, total

# Frame and hop in seconds, the smallest frame, weights of the tempo envelope, and the limits of tempo folding.
FRAME_SECONDS, HOP_SECONDS, LEAST_FRAME = 0.093, 0.1, 256
FLUX_WEIGHT, LEVEL_WEIGHT, LEVEL_WIDTH, ENVELOPE_WIDTH = 0.85, 0.15, 9, 31
FAST_BPM, VERY_FAST_BPM, TACTUS_BPM = 150.0, 165.0, (70.0, 145.0)
HALF_RATIO, VERY_FAST_HALF_RATIO, TACTUS_RATIO, SNAP_BPM = 0.50, 0.35, 0.55, 0.35
MOST_PEAKS, LEAST_FRAMES = 16, 16
PREVIEW_BINS, MATRIX_QUANTILE = 360, 0.98


def frame_size(rate: Column, seconds: float = FRAME_SECONDS, least: int = LEAST_FRAME) -> Column:
    """Samples of a frame at this rate, made even."""
    n = F.greatest(F.lit(least), F.bround(rate * seconds).cast("int"))
    return n + n % 2


def hop_size(rate: Column, seconds: float = HOP_SECONDS) -> Column:
    return F.greatest(F.lit(1), F.bround(rate * seconds).cast("int"))


def framed(chunks: DataFrame, track: str, start: str, last: str, samples: list[str], size: Column, hop: Column) -> DataFrame:
    """One row for each frame: its number, first sample, and its part of each array of samples, short at the end of a track.

    `start` is a chunk's first sample, `last` the samples of the whole track. Chunks are at least as long as a frame.
    A frame starts at each hop until one reaches the end; a track without samples has no frames.
    """
    w = Window.partitionBy(track).orderBy(start)
    df = chunks.withColumns({"_size": size, "_hop": hop})
    df = df.withColumns({f"_{c}": F.concat(c, F.coalesce(F.lead(F.slice(c, F.lit(1), F.col("_size"))).over(w), F.array().cast("array<float>"))) for c in samples})
    df = df.withColumn("_end", F.col(start) + F.size(samples[0]))
    count = F.ceil(F.greatest(F.lit(1), F.col(last) - F.col("_size")) / F.col("_hop")) + 1
    first = F.ceil(F.col(start) / F.col("_hop"))
    final = F.least(F.ceil(F.col("_end") / F.col("_hop")), count) - 1
    df = df.where(final >= first).withColumn("frame_idx", F.explode(F.sequence(first, final)))
    at = F.col("frame_idx") * F.col("_hop")
    cut = {c: F.slice(f"_{c}", (at - F.col(start) + 1).cast("int"), F.col("_size")) for c in samples}
    return df.withColumns(cut | {"first_sample": at, "frame_size": F.col("_size")}).drop("_size", "_hop", "_end", *[f"_{c}" for c in samples])


@F.pandas_udf(ArrayType(DoubleType()))
def magnitudes(samples: pd.Series, size: pd.Series) -> pd.Series:
    """Magnitudes of the real Fourier transform of each row's samples, padded with zeros to `size`, under a Hann window."""
    out: list = [None] * len(samples)
    for n, rows in size.groupby(size):
        block = np.zeros((len(rows), int(n)))
        for k, at in enumerate(rows.index):
            block[k, : len(samples[at])] = samples[at]
        found = np.abs(np.fft.rfft(block * np.hanning(int(n)), axis=1))
        for k, at in enumerate(rows.index):
            out[at] = found[k]
    return pd.Series(out)


def mono(left: str, right: str) -> Column:
    """The mean of both channels."""
    return F.zip_with(left, right, lambda a, b: ((a + b) / 2).cast("float"))


def audio_features(chunks: DataFrame) -> DataFrame:
    """Frame features of `read_wav` chunks: (track, frame_idx, t, level, spectral and mid/side features, flux).

    Levels are of both channels over the samples that are there; crossings and spectra of the padded mean of both.
    """
    usable = chunks.where("status = 'ok' AND total_frames > 0").withColumnRenamed("path", "track")
    df = framed(usable, "track", "start_frame", "total_frames", ["left", "right"], frame_size(F.col("sample_rate")), hop_size(F.col("sample_rate")))
    n = F.size("left")
    df = df.withColumn("t", (F.col("first_sample") + n * 0.5) / F.col("sample_rate")).withColumn("_mono", mono("left", "right"))
    padded = F.concat("_mono", F.array_repeat(F.lit(0.0).cast("float"), F.col("frame_size") - n))
    df = spectral.level_features(df.withColumn("_padded", padded), "_padded")
    squares = total(spectral.power("left")) + total(spectral.power("right"))
    highest = F.array_max(F.transform(F.concat("left", "right"), lambda v: F.abs(v.cast("double"))))
    df = df.withColumns({"rms": F.sqrt(squares / (2 * n)), "peak": highest, "magnitudes": magnitudes("_mono", "frame_size")})
    doubles = lambda c: F.transform(c, lambda v: v.cast("double"))
    df = spectral.mid_side(df, doubles("left"), doubles("right")).drop("left", "right", "_mono", "_padded")
    df = spectral.spectral_features(df, "magnitudes", F.size("magnitudes"), F.col("sample_rate"))
    return spectral.flux(df, "magnitudes", "track", "frame_idx").drop("magnitudes")


def onset_envelope(df: DataFrame, flux: str, level: str, track: str, order: str) -> DataFrame:
    """Adds `envelope`: transients above their surroundings, centred on 0."""
    df = df.withColumn("_ma", spectral.moving_average(level, LEVEL_WIDTH, track, order))
    df = df.withColumn("_up", F.greatest(F.col(level) - F.col("_ma"), F.lit(0.0)))
    df = df.withColumn("_e", FLUX_WEIGHT * spectral.normalised(F.col(flux), track) + LEVEL_WEIGHT * spectral.normalised(F.col("_up"), track))
    df = df.withColumn("_ma", spectral.moving_average("_e", ENVELOPE_WIDTH, track, order))
    df = df.withColumn("_e", F.greatest(F.col("_e") - F.col("_ma"), F.lit(0.0)))
    df = df.withColumn("_e", spectral.normalised(F.col("_e"), track))
    return df.withColumn("envelope", F.col("_e") - F.avg("_e").over(Window.partitionBy(track))).drop("_ma", "_up", "_e")


def refined_tempo(df: DataFrame, track: str, order: str, hop: float, least_bpm: float, most_bpm: float) -> DataFrame:
    """(track, raw_bpm, bpm, folded, confidence, first_beat) from `envelope`; without 16 frames or any onset, nulls and confidence 0.

    The peaks of the autocorrelation within the lags searched are few, so they stay in one array a track.
    A pulse above 150 a minute gives way to half of it, or to the best peak between 70 and 145, where that is strong enough.
    """
    low, high = max(1, round(60 / most_bpm / hop)), round(60 / least_bpm / hop)
    o = Window.partitionBy(track).orderBy(order)
    products = df.select(track, "envelope", *[(F.col("envelope") * F.lead("envelope", k).over(o)).alias(f"r{k}") for k in range(high + 2)])
    sums = products.groupBy(track).agg(F.count("*").alias("n"), F.max(F.abs("envelope")).alias("top"), F.array(*[F.coalesce(F.sum(f"r{k}"), F.lit(0.0)) for k in range(high + 2)]).alias("r"))
    sound = (F.col("n") >= LEAST_FRAMES) & (F.col("top") > EPS) & (F.col("n") > high)
    rows = sums.withColumn("c", F.transform("r", lambda v: F.round(F.when(F.col("r")[0] > EPS, v / F.col("r")[0]).otherwise(v), 9)))
    lag = lambda k: F.struct((-F.col("c")[k]).alias("s"), k.alias("lag"))
    peaks = F.filter(F.sequence(F.lit(low + 1), F.lit(high - 1)), lambda k: (F.col("c")[k] >= F.col("c")[k - 1]) & (F.col("c")[k] >= F.col("c")[k + 1]))
    best = F.array(F.array_min(F.transform(F.sequence(F.lit(low), F.lit(high)), lag)))
    rows = rows.withColumn("_p", F.slice(F.array_sort(F.transform(peaks, lag)), 1, MOST_PEAKS)).withColumn("_p", F.when(F.size("_p") > 0, F.col("_p")).otherwise(best))
    rows = rows.withColumns({"raw": F.col("_p")[0]["lag"], "score": -F.col("_p")[0]["s"]})
    bpm = lambda k: F.lit(60.0) / (k * hop)
    half = F.col("raw") * 2
    ratio = F.when(bpm(F.col("raw")) >= VERY_FAST_BPM, VERY_FAST_HALF_RATIO).otherwise(HALF_RATIO)
    halved = (half < F.least(F.col("n"), F.lit(high + 2))) & bpm(half).between(least_bpm, most_bpm) & (F.try_element_at("c", half + 1) >= F.col("score") * ratio)
    calm = F.try_element_at(F.filter("_p", lambda p: bpm(p["lag"]).between(*TACTUS_BPM)), F.lit(1))
    chosen = F.when(bpm(F.col("raw")) <= FAST_BPM, F.col("raw")).when(halved, half).when(-calm["s"] >= F.col("score") * TACTUS_RATIO, calm["lag"]).otherwise(F.col("raw"))
    rows = rows.withColumn("lag", F.when(sound, chosen))
    snapped = lambda x: F.when(F.abs(x - F.bround(x)) < SNAP_BPM, F.bround(x)).otherwise(x)
    search = F.array_max(F.slice("c", low + 1, high - low + 1))
    rows = rows.select(
        track, "n", F.when(sound, snapped(bpm(F.col("raw")))).alias("raw_bpm"), snapped(bpm(F.col("lag"))).alias("bpm"), (F.abs(bpm(F.col("lag")) - bpm(F.col("raw"))) > 1).alias("folded"),
        F.when(sound, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c")[F.col("lag")] / (search + EPS)))).otherwise(0.0).alias("confidence"),
    )
    span = F.least(F.greatest(F.lit(90.0) / F.col("bpm"), F.lit(1.0)), F.col("n") * hop)
    heads = df.select(track, order, "envelope").join(rows.select(track, F.greatest(F.lit(1), F.bround(span / hop)).alias("_limit")), track).where(F.col(order) < F.col("_limit"))
    w = Window.partitionBy(track)
    least = F.greatest(F.avg("envelope").over(w), F.percentile("envelope", F.lit(0.7)).over(w))
    firsts = heads.withColumn("_least", least).where(F.round("envelope", 9) >= F.round("_least", 9)).groupBy(track).agg((F.min(order) * hop).alias("first_beat"))
    return rows.drop("n").join(firsts, track, "left")


def split_and_snap(frames: DataFrame, marks: DataFrame, least: float, most: float) -> DataFrame:
    """(track, segment, start_s, end_s) from frames (track, t, novelty) and marks (track, kind, t) of kinds `boundary` and `bar`.

    Boundaries include both ends of a track. A stretch longer than `most` is cut where its frames change most, at least
    `least` from its ends, or else in the middle; then each inner boundary moves to the nearest bar, if one is near
    enough, and is left out if it comes too close to another; what is too long after that is cut at the bar nearest to its
    middle. Every cut depends on the cuts before it, so a track is one group of its frames' two numbers.
    """
    schema = f"track {dict(frames.dtypes)['track']}, segment int, start_s double, end_s double"

    def cuts(start: float, end: float, place) -> list[float]:
        """Places between start and end, until no part is too long or has a place left."""
        if end - start <= most:
            return []
        at = place(start, end)
        return [] if at is None or not start < at < end else [*cuts(start, at, place), at, *cuts(at, end, place)]

    def one(key: tuple, pdf: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        times, change = pdf["t"].to_numpy(), pdf["novelty"].to_numpy()
        bars = np.sort(near.loc[near["kind"] == "bar", "t"].to_numpy())
        bounds = sorted(near.loc[near["kind"] == "boundary", "t"].round(3).unique())

        def most_changed(start: float, end: float) -> float | None:
            inside = np.flatnonzero((times >= start + least) & (times <= end - least))
            at = round(float(times[inside[np.argmax(change[inside])]]) if len(inside) else (start + end) / 2, 3)
            return at if at - start >= least - 1e-9 and end - at >= least - 1e-9 else None

        def middle_bar(start: float, end: float) -> float:
            inside, middle = bars[(bars >= start + least) & (bars <= end - least)], (start + end) / 2
            return round(float(inside[np.argmin(np.abs(inside - middle))]) if len(inside) else middle, 3)

        def refined(values: list[float], place) -> list[float]:
            return sorted({*values, *(x for a, b in zip(values, values[1:], strict=False) for x in cuts(a, b, place))})

        bounds = refined(bounds, most_changed)
        if len(bars) and len(bounds) > 2:
            first, last = bounds[0], bounds[-1]
            kept, reach = [first, last], min(2.0, max(0.75, 0.2 * least))
            for x in bounds[1:-1]:
                bar = float(bars[np.argmin(np.abs(bars - x))])
                x = bar if abs(bar - x) <= reach else x
                if x - first >= least and last - x >= least and min(abs(x - y) for y in kept) >= 0.75 * least:
                    kept.append(x)
            bounds = refined(sorted({round(x, 3) for x in kept}), middle_bar)
        return pd.DataFrame({"track": key[0], "segment": range(len(bounds) - 1), "start_s": bounds[:-1], "end_s": bounds[1:]})

    # New names, as both sides may come from one table.
    marks = marks.select(F.col("track").alias("_of"), F.col("kind").alias("kind"), F.col("t").alias("t"))
    return frames.select("track", "t", "novelty").groupBy("track").cogroup(marks.groupBy("_of")).applyInPandas(one, schema)


def matrix_level(value: str, track: str) -> Column:
    """Values of a track's matrix on a logarithmic scale, against their 98 % quantile (or their highest, if that is 0), at most 1."""
    w = Window.partitionBy(track)
    x = F.log1p(F.greatest(F.col(value), F.lit(0.0)))
    high = F.percentile(x, F.lit(MATRIX_QUANTILE)).over(w)
    scale = F.when(high > EPS, high).otherwise(F.max(x).over(w))
    return F.when(scale > EPS, F.least(x / scale, F.lit(1.0))).otherwise(0.0)


def transients(df: DataFrame, value: str, track: str, order: str) -> DataFrame:
    """Adds `transient`: what rises against the frame before, relative to the track's highest rise; 0 where nothing rises."""
    rise = F.greatest(F.col(value) - F.lag(value).over(Window.partitionBy(track).orderBy(order)), F.lit(0.0))
    df = df.withColumn("_rise", F.coalesce(rise, F.lit(0.0)))
    high = F.max("_rise").over(Window.partitionBy(track))
    return df.withColumn("transient", F.when(high > EPS, F.col("_rise") / high).otherwise(0.0)).drop("_rise")


def in_preview(number: str, count: Column, bins: int = PREVIEW_BINS) -> Column:
    """Whether the frame of this number, from 0, is among `bins` evenly spread ones of `count`; all are where there are no more."""
    i, steps = F.col(number).cast("long"), count - 1
    nearest = F.floor((i * (bins - 1) + steps - 1) / steps)
    return F.coalesce((count <= bins) | (F.floor(nearest * steps / (bins - 1)) == i), F.lit(True))
