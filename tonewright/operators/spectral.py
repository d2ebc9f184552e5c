"""Frame features from arrays of samples or magnitudes. Rows stay where they are: arrays are folded in place, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
# Edges of the coarse bands in hertz.
COARSE_BANDS = (("low", 0.0, 250.0), ("mid", 250.0, 4000.0), ("high", 4000.0, None))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def frequencies(size: int, rate: float) -> Column:
    """Centre frequencies of `size` bins up to half the rate."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: k * F.lit(rate / 2) / (size - 1))


def power(samples: str) -> Column:
    return F.transform(samples, lambda v: v.cast("double") * v.cast("double"))


def _inside(low: float, high: float | None) -> Callable[[Column, Column], Column]:
    """Power of a bin in [low, high), 0 elsewhere."""
    return lambda f, p: F.when((f >= low) & ((f < high) if high is not None else F.lit(True)), p).otherwise(0.0)


def level_features(df: DataFrame, samples: str) -> DataFrame:
    """rms, peak and zero-crossing rate of each row's samples."""
    x = F.transform(samples, lambda v: v.cast("double"))
    n = F.size(samples)
    signs = F.transform(samples, lambda v: (v < 0).cast("int"))
    flips = F.zip_with(F.slice(signs, 1, n - 1), F.slice(signs, 2, n - 1), lambda a, b: F.abs(a - b))
    return df.withColumns({"rms": F.sqrt(total(power(samples)) / n), "peak": F.array_max(F.transform(x, F.abs)), "zcr": F.aggregate(flips, F.lit(0), lambda a, v: a + v) / (n - 1)})


def spectral_features(df: DataFrame, magnitudes: str, size: int, rate: float) -> DataFrame:
    """centroid, bandwidth, rolloff, flatness and coarse band ratios of each row's spectrum."""
    df = df.withColumn("_p", power(magnitudes)).withColumn("_f", frequencies(size, rate)).withColumn("_sum", total(F.col("_p")) + EPS)
    df = df.withColumn("centroid", total(F.zip_with("_f", "_p", lambda f, p: f * p)) / F.col("_sum"))
    spread = total(F.zip_with("_f", "_p", lambda f, p: (f - F.col("centroid")) * (f - F.col("centroid")) * p))
    # The first bin at which the running power reaches 85 percent.
    start = F.struct(F.lit(0.0).alias("run"), F.lit(-1).alias("at"), F.lit(0).alias("k"))

    def reach(a: Column, p: Column) -> Column:
        run = a["run"] + p
        return F.struct(run.alias("run"), F.when((a["at"] < 0) & (run >= 0.85 * F.col("_sum")), a["k"]).otherwise(a["at"]).alias("at"), (a["k"] + 1).alias("k"))

    at = F.aggregate("_p", start, reach)["at"]
    logs = total(F.transform("_p", lambda p: F.log(p + EPS))) / size
    out = {"bandwidth": F.sqrt(spread / F.col("_sum")), "rolloff": F.try_element_at("_f", F.when(at >= 0, at + 1).otherwise(size)), "flatness": F.exp(logs) / (F.col("_sum") / size + EPS)}
    for name, low, high in COARSE_BANDS:
        out[name] = total(F.zip_with("_f", "_p", _inside(low, high))) / F.col("_sum")
    return df.withColumns(out).drop("_p", "_f", "_sum")


def mid_side(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Side ratio, left-right balance and phase correlation of two arrays of samples."""
    df = df.withColumns({"_l": left, "_r": right})
    mid = total(F.zip_with("_l", "_r", lambda a, b: (a + b) * (a + b) / 4))
    side = total(F.zip_with("_l", "_r", lambda a, b: (a - b) * (a - b) / 4))
    el, er = total(F.transform("_l", lambda v: v * v)), total(F.transform("_r", lambda v: v * v))
    cross, norm = total(F.zip_with("_l", "_r", lambda a, b: a * b)), F.sqrt(el * er)
    return df.withColumns({"side_ratio": side / (mid + EPS), "balance": (er - el) / (er + el + EPS), "phase": F.when(norm > EPS, cross / norm).otherwise(0.0)}).drop("_l", "_r")


def flux(df: DataFrame, magnitudes: str, track: str, order: str) -> DataFrame:
    """Root mean square of what rises against the frame before; 0 at the first frame."""
    before = F.lag(magnitudes).over(Window.partitionBy(track).orderBy(order))
    rise = F.zip_with(F.transform(magnitudes, lambda v: F.abs(v.cast("double"))), F.transform("_before", lambda v: F.abs(v.cast("double"))), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    df = df.withColumn("_before", before)
    value = F.sqrt(total(F.transform(rise, lambda v: v * v)) / F.size(magnitudes))
    return df.withColumn("flux", F.when(F.col("_before").isNull(), 0.0).otherwise(value)).drop("_before")


def normalised(value: Column, track: str) -> Column:
    """Min-max over the whole track; 0 where it is constant."""
    w = Window.partitionBy(track)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low > EPS, (value - low) / (high - low)).otherwise(0.0)


def novelty(df: DataFrame, features: list[str], track: str, order: str) -> DataFrame:
    """Mean absolute change of normalised features; 0 at the first frame."""
    w = Window.partitionBy(track).orderBy(order)
    df = df.withColumns({f"_n_{f}": normalised(F.col(f), track) for f in features})
    change = sum((F.abs(F.col(f"_n_{f}") - F.lag(f"_n_{f}").over(w)) for f in features), F.lit(0.0)) / len(features)
    return df.withColumn("novelty", F.coalesce(change, F.lit(0.0))).drop(*[f"_n_{f}" for f in features])


def moving_average(value: str, width: int, track: str, order: str) -> Column:
    """Average over `width` frames around each, with zeros beyond both ends."""
    w = Window.partitionBy(track).orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2)
    return F.sum(value).over(w) / width


def erb_bank(channels: int, low: float, high: float) -> Column:
    """Array of (channel, centre, bandwidth) with equal steps on the auditory scale."""
    scale = lambda f: 21.4 * F.log10(1 + 0.00437 * f)
    a, b = scale(F.lit(low)), scale(F.lit(high))
    def one(c: Column) -> Column:
        centre = (F.pow(F.lit(10.0), (a + (b - a) * c / (channels - 1)) / 21.4) - 1) / 0.00437
        return F.struct(c.alias("channel"), centre.alias("centre"), (24.7 * (4.37 * centre / 1000 + 1)).alias("bandwidth"))
    return F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), one)


def erb_envelopes(df: DataFrame, magnitudes: str, size: int, rate: float, channels: int = 16, low: float = 50.0, high: float = 8000.0) -> DataFrame:
    """Rows (.., channel, centre, envelope): power weighted by 1 / (1 + (distance / 1.5 bandwidths) ** 4), weights of a channel summing to one.

    The bin at 0 Hz has no weight; a channel without any weight takes the bin nearest to its centre.
    """
    df = df.withColumn("_p", power(magnitudes)).withColumn("_f", frequencies(size, rate)).withColumn("_c", F.explode(erb_bank(channels, low, high)))
    weight = F.transform("_f", lambda f: F.when(f <= 0, 0.0).otherwise(1 / (1 + F.pow((f - F.col("_c.centre")) / (1.5 * F.col("_c.bandwidth")), F.lit(4)))))
    df = df.withColumn("_w", weight)
    away = F.transform("_f", lambda f: F.abs(f - F.col("_c.centre")))
    nearest = F.transform("_f", lambda f: F.when(F.abs(f - F.col("_c.centre")) == F.array_min(away), 1.0).otherwise(0.0))
    df = df.withColumn("_w", F.when(total(F.col("_w")) > EPS, F.col("_w")).otherwise(nearest))
    envelope = total(F.zip_with("_w", "_p", lambda w, p: w * p)) / total(F.col("_w"))
    return df.withColumns({"channel": F.col("_c.channel"), "centre": F.col("_c.centre"), "envelope": envelope}).drop("_p", "_f", "_c", "_w")


def erb_envelope_pairs(df: DataFrame, spectra: dict[str, str], size: int, rate: float, channels: int = 16, low: float = 50.0, high: float = 8000.0) -> DataFrame:
    """erb_envelopes() of several spectra at once: a column for each name in `spectra`, with the weights worked out once a row and channel."""
    df = df.withColumns({f"_p_{n}": power(c) for n, c in spectra.items()}).withColumn("_f", frequencies(size, rate)).withColumn("_c", F.explode(erb_bank(channels, low, high)))
    weight = F.transform("_f", lambda f: F.when(f <= 0, 0.0).otherwise(1 / (1 + F.pow((f - F.col("_c.centre")) / (1.5 * F.col("_c.bandwidth")), F.lit(4)))))
    away = F.transform("_f", lambda f: F.abs(f - F.col("_c.centre")))
    nearest = F.transform("_f", lambda f: F.when(F.abs(f - F.col("_c.centre")) == F.array_min(away), 1.0).otherwise(0.0))
    df = df.withColumn("_w", weight).withColumn("_w", F.when(total(F.col("_w")) > EPS, F.col("_w")).otherwise(nearest))
    sums = {n: total(F.zip_with("_w", f"_p_{n}", lambda w, p: w * p)) / total(F.col("_w")) for n in spectra}
    return df.withColumns({"channel": F.col("_c.channel"), "centre": F.col("_c.centre"), **sums}).drop("_f", "_c", "_w", *[f"_p_{n}" for n in spectra])
