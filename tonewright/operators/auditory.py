"""Auditory evidence of two channels: envelopes of middle and side, their levels, curves, rolling windows and display matrices.

A matrix is long: one row for each frame and auditory channel, with the power of the middle (half the sum)
and of the side (half the difference).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spectral
from .quantiles import merged, quantiles, settled, sketches, spread_back
from .scorers import Stage, clamp, weighted

EPS = 1e-12
# Edges of the broad bands in hertz, the quantile that levels are held against, and the display's quantiles and shares.
BROAD = {"low": (20.0, 250.0), "mid": (250.0, 4000.0), "high": (4000.0, 20000.0), "mid_high": (500.0, 12000.0)}
LEVEL_QUANTILE = 0.98
WHOLE_RANGE, BAND_RANGE, BAND_SHARE, WHOLE_SHARE = (0.08, 0.98), (0.12, 0.96), 0.68, 0.32
#: A window is left out if less than this, or than itself up to a second, is left of the track; the first always stays.
LEAST_REST = 0.25


def mid_side_matrix(frames: DataFrame, left: Column, right: Column, size: int, rate: float, channels: int = 16, low: float = 50.0, high: float = 8000.0) -> DataFrame:
    """Adds channel, centre, mid and side: envelopes of the spectra of (left + right) / 2 and (left - right) / 2, given as arrays of `size` magnitudes."""
    double = lambda a: F.transform(a, lambda v: v.cast("double"))
    df = frames.withColumns({"_m": F.zip_with(double(left), double(right), lambda a, b: (a + b) / 2), "_s": F.zip_with(double(left), double(right), lambda a, b: (a - b) / 2)})
    return spectral.erb_envelope_pairs(df, {"mid": "_m", "side": "_s"}, size, rate, channels, low, high).drop("_m", "_s")


def levels(matrix: DataFrame, track: str = "track") -> DataFrame:
    """mid and side on a logarithmic scale, each against its track's 98 % quantile (its highest, if that is 0), at most 1."""
    logs = matrix.withColumns({c: F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in ("mid", "side")})
    scales = None
    for c in ("mid", "side"):
        found = quantiles(logs, [track], c, {"q": LEVEL_QUANTILE}).select(track, F.when(F.col("q") > EPS, F.col("q")).otherwise(F.col("_most")).alias(f"_of_{c}"))
        scales = found if scales is None else scales.join(found, track)
    joined = spread_back(logs, scales, [track], F.col("frame_idx"))
    return joined.withColumns({c: F.when(F.col(f"_of_{c}") > EPS, F.least(F.col(c) / F.col(f"_of_{c}"), F.lit(1.0))).otherwise(0.0) for c in ("mid", "side")}).drop("_of_mid", "_of_side")


SUSTAINED = [f"{b}_{c}" for c in ("mid", "side") for b in BROAD]
RISING = {"broadband": "total", "low": "low", "mid": "mid", "high": "high"}


def curves(level: DataFrame) -> DataFrame:
    """One row a frame: mean level of middle and side in four broad bands and in all, their sum, and what rises (not yet against the track's highest).

    A frame's rise needs the frame before it: stretches of frames are cut and take one frame from the stretch before.
    """
    band = lambda c, low, high: F.coalesce(F.avg(F.when((F.round("centre", 6) >= low) & (F.round("centre", 6) < high), F.col(c))), F.lit(0.0))
    means = [band(c, *edges).alias(f"{b}_{c}") for c in ("mid", "side") for b, edges in BROAD.items()]
    df = level.groupBy("track", "frame_idx", "t").agg(*means, F.avg("mid").alias("all_mid"), F.avg("side").alias("all_side"))
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    df = df.withColumns({"total": unit(F.col("all_mid") + F.col("all_side")), **{f"_sum_{b}": unit(F.col(f"{b}_mid") + F.col(f"{b}_side")) for b in ("low", "mid", "high")}})
    df = df.withColumn("_sum_broadband", F.col("total"))
    return rises(df, {f"rise_{b}": f"_sum_{b}" for b in RISING}).drop(*[f"_sum_{b}" for b in RISING])


#: Frames of a stretch in which neighbours are looked for.
STRETCH = 4096


def rises(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Adds for each name how much its column rises against the frame before; the first frame of a track rises by 0.

    frame_idx counts on without gaps, so that a stretch of frames needs only the last one of the stretch before.
    """
    part = F.floor(F.col("frame_idx") / STRETCH)
    edge = df.where(F.col("frame_idx") % STRETCH == STRETCH - 1).withColumns({"_part": part + 1, "_halo": F.lit(True)})
    rows = df.withColumns({"_part": part, "_halo": F.lit(False)}).unionByName(edge)
    w = Window.partitionBy("track", "_part").orderBy("frame_idx")
    change = {n: F.greatest(F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)), F.lit(0.0)) for n, c in wanted.items()}
    return rows.withColumns(change).where("NOT _halo").drop("_part", "_halo")


MEANS = {**{f"{x}_sustained": x for x in SUSTAINED}, "broadband_mid_energy": "all_mid", "broadband_side_energy": "all_side", "broadband_total_energy": "total"}
HIGHEST = {"broadband_peak_energy": "total", **{f"transient_{b}": f"rise_{b}" for b in RISING}}


def pane_windows(curve: DataFrame, length: int = 3, hop: float = 1.0) -> DataFrame:
    """16 aggregates of each window of `length` panes of `hop` seconds, a pane apart, from frames with curves().

    Frames are put together by panes once; a window adds up panes. A track lasts until its last frame, which
    no window holds, and the last windows end there.
    """
    edges = curve.groupBy("track").agg(F.max("t").alias("_end"), *[F.max(f"rise_{b}").alias(f"_top_{b}") for b in RISING])
    pane = F.floor(F.round(F.col("t") / hop, 9)).cast("int")
    sums = [F.sum(c).alias(f"_sum_{n}") for n, c in MEANS.items()]
    panes = spread_back(curve, edges.select("track", "_end"), ["track"], F.col("frame_idx")).where("t < _end").groupBy("track", pane.alias("pane")).agg(F.count("*").alias("_n"), *sums, *[F.max(c).alias(n) for n, c in HIGHEST.items()])
    panes = panes.withColumn("segment", F.explode(F.sequence(F.greatest(F.col("pane") - (length - 1), F.lit(0)), F.col("pane"))))
    found = panes.groupBy("track", "segment").agg(*[(F.sum(f"_sum_{n}") / F.sum("_n")).alias(n) for n in MEANS], *[F.max(n).alias(n) for n in HIGHEST])
    found = found.join(edges, "track").withColumn("start_s", F.col("segment") * F.lit(float(hop)))
    rest = max(LEAST_REST, min(length * hop, 1.0))
    found = found.where((F.col("start_s") < F.col("_end")) & ((F.col("segment") == 0) | (F.round(F.col("start_s") + rest - F.col("_end"), 9) <= 0)))
    found = found.withColumns({"end_s": F.least(F.col("start_s") + length * hop, F.col("_end")), **_relative()})
    return found.select("track", "segment", "start_s", "end_s", *MEANS, *HIGHEST)


def _relative() -> dict[str, Column]:
    """Transients against the highest rise of their track."""
    return {f"transient_{b}": F.when(F.col(f"_top_{b}") > EPS, F.col(f"transient_{b}") / F.col(f"_top_{b}")).otherwise(0.0) for b in RISING}


def segment_aggregates(curve: DataFrame, frames: int) -> DataFrame:
    """The same 16 aggregates over each stretch of `frames` frames of a profile, the track's last one too."""
    segment = F.floor(F.col("frame_idx") / frames).cast("int").alias("segment")
    found = curve.groupBy("track", segment).agg(*[F.avg(c).alias(n) for n, c in MEANS.items()], *[F.max(c).alias(n) for n, c in HIGHEST.items()])
    tops = found.groupBy("track").agg(*[F.max(f"transient_{b}").alias(f"_top_{b}") for b in RISING])
    return found.join(tops, "track").withColumns(_relative()).select("track", "segment", *MEANS, *HIGHEST)


def share(part: str, *others: str) -> str:
    return clamp(f"{part} / greatest({' + '.join([part, *others])}, 1e-12)")


# Five ratios of a window, and the weights of its support for eight lanes.
RATIOS: Stage = {
    **{f"side_ratio_{b}": share(f"{b}_side_sustained", f"{b}_mid_sustained") for b in ("low", "mid", "high")},
    "side_ratio_broadband": share("broadband_side_energy", "broadband_mid_energy"),
    "center_focus_broadband": share("broadband_mid_energy", "broadband_side_energy"),
}
SUPPORT: Stage = {
    "low_body_lane": weighted("0.54 low_mid_sustained, 0.24 low_side_sustained, 0.22 center_focus_broadband"),
    "transient_plane_lane": weighted("0.55 transient_broadband, 0.15 transient_low, 0.15 transient_mid, 0.15 transient_high"),
    "foreground_contour_lane": weighted("0.50 mid_mid_sustained, 0.26 center_focus_broadband, 0.24 -transient_broadband"),
    "harmonic_ridge_lane": weighted("0.56 mid_high_mid_sustained, 0.24 mid_mid_sustained, 0.20 -transient_broadband"),
    "diffuse_tail_lane": weighted("0.35 mid_high_side_sustained, 0.30 side_ratio_high, 0.20 side_ratio_mid, 0.15 -transient_broadband"),
    "noise_texture_lane": weighted("0.42 high_side_sustained, 0.30 high_mid_sustained, 0.18 transient_high, 0.10 side_ratio_high"),
    "spatial_spread_lane": weighted("0.50 side_ratio_broadband, 0.25 mid_high_side_sustained, 0.25 broadband_side_energy"),
    "pressure_peak_lane": weighted("0.55 broadband_peak_energy, 0.25 broadband_total_energy, 0.20 transient_broadband"),
}


def display(matrix: DataFrame, value: str) -> DataFrame:
    """Adds `shown`: decibels between two quantiles of the channel (.68) and of the whole track (.32), from 0 to 1.

    The sketches of a track are merged from those of its channels.
    """
    db = matrix.withColumn("_db", 10 * F.log10(F.greatest(F.col(value), F.lit(EPS))))
    names = lambda x, r: {f"_lo{x}": r[0], f"_hi{x}": r[1]}
    bands = sketches(db, ["track", "channel"], "_db")
    whole = settled(db, merged(bands, ["track"]), ["track"], "_db", names("w", WHOLE_RANGE)).withColumnsRenamed({"_least": "_leastw", "_most": "_mostw"})
    band = settled(db, bands, ["track", "channel"], "_db", names("b", BAND_RANGE)).withColumnsRenamed({"_least": "_leastb", "_most": "_mostb"})
    joined = spread_back(db, band.join(whole, "track"), ["track", "channel"], F.col("frame_idx"))

    def robust(x: str) -> Column:
        narrow = F.col(f"_hi{x}") <= F.col(f"_lo{x}") + EPS
        low, high = F.when(narrow, F.col(f"_least{x}")).otherwise(F.col(f"_lo{x}")), F.when(narrow, F.col(f"_most{x}")).otherwise(F.col(f"_hi{x}"))
        return F.when(high <= low + EPS, 0.0).otherwise(F.least(F.greatest((F.col("_db") - low) / (high - low), F.lit(0.0)), F.lit(1.0)))

    shown = BAND_SHARE * robust("b") + WHOLE_SHARE * robust("w")
    return joined.withColumn("shown", F.least(F.greatest(shown, F.lit(0.0)), F.lit(1.0))).select(*matrix.columns, "shown")


def display_bins(shown: DataFrame, smooth: int, seconds: float) -> DataFrame:
    """(track, channel, bin, t, level): averages over `smooth` frames around each, with zeros beyond both ends, then over bins of time from the first frame on.

    A stretch of frames takes what the average reaches beyond it from its neighbours.
    """
    before, behind = smooth // 2, (smooth - 1) // 2
    part = F.floor(F.col("frame_idx") / STRETCH)
    rows = shown.withColumn("_part", F.explode(F.array_distinct(F.array(F.floor((F.col("frame_idx") - behind) / STRETCH), part, F.floor((F.col("frame_idx") + before) / STRETCH)))))
    w = Window.partitionBy("track", "channel", "_part").orderBy("frame_idx").rowsBetween(-before, behind)
    rows = rows.withColumn("_level", F.sum("shown").over(w) / smooth).where(F.col("_part") == part)
    first = shown.groupBy("track").agg(F.min("t").alias("_t0"))
    rows = spread_back(rows.select("track", "channel", "frame_idx", "t", "_level"), first, ["track"], F.col("frame_idx"))
    place = F.floor(F.round((F.col("t") - F.col("_t0")) / seconds, 9)).cast("int")
    out = rows.groupBy("track", "channel", place.alias("bin"), "_t0").agg(F.avg("_level").alias("level"))
    return out.select("track", "channel", "bin", (F.col("_t0") + (F.col("bin") + 0.5) * seconds).alias("t"), "level")


# Widths of the averages, and the activity from which frames count, of sustained, rising, wide and centred sound.
SUSTAINED_WIDTH, SUSTAINED_LEAST, RISING_LEAST, FIELD_WIDTH, FIELD_LEAST = 9, 0.42, 0.55, 7, 0.34
MOST_REGIONS = 10


def smoothed(df: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """Adds averages of columns over so many frames around each, with zeros beyond both ends; stretches take what they need from their neighbours."""
    reach = max(w for _, w in wanted.values())
    part = F.floor(F.col("frame_idx") / STRETCH)
    places = F.array_distinct(F.array(F.floor((F.col("frame_idx") - reach) / STRETCH), part, F.floor((F.col("frame_idx") + reach) / STRETCH)))
    rows = df.withColumn("_part", F.explode(places))
    w = Window.partitionBy("track", "_part").orderBy("frame_idx")
    rows = rows.withColumns({n: F.sum(c).over(w.rowsBetween(-(k // 2), (k - 1) // 2)) / k for n, (c, k) in wanted.items()})
    return rows.where(F.col("_part") == part).drop("_part")


def fields(curve: DataFrame) -> DataFrame:
    """Adds the side's share and the sum of each broad band, and how wide and how centred a frame is."""
    ratio = {b: F.col(f"{b}_side") / (F.col(f"{b}_mid") + F.col(f"{b}_side") + EPS) for b in BROAD}
    df = curve.withColumns({f"ratio_{b}": x for b, x in ratio.items()} | {f"sum_{b}": F.least(F.col(f"{b}_mid") + F.col(f"{b}_side"), F.lit(1.0)) for b in BROAD})
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    wide = sum((unit((F.col(f"ratio_{b}") - 0.45) / 0.55) * F.col(f"sum_{b}") for b in BROAD), F.lit(0.0)) / len(BROAD)
    centred = sum((unit((0.55 - F.col(f"ratio_{b}")) / 0.55) * F.col(f"{b}_mid") for b in BROAD), F.lit(0.0)) / len(BROAD)
    return df.withColumns({"wide": wide, "centred": centred})


def band_ratios(field: DataFrame) -> DataFrame:
    """(track, band, mean_ratio, max_ratio, mean_total): the side's share in each broad band of a track."""
    found = field.groupBy("track").agg(*[f(c).alias(f"{n}_{b}") for b in BROAD for n, f, c in (("a", F.avg, f"ratio_{b}"), ("b", F.max, f"ratio_{b}"), ("c", F.avg, f"sum_{b}"))])
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.col(f"a_{b}").alias("mean_ratio"), F.col(f"b_{b}").alias("max_ratio"), F.col(f"c_{b}").alias("mean_total")) for b in BROAD])
    return found.select("track", F.explode(rows).alias("z")).select("track", "z.*")


def activities(field: DataFrame) -> DataFrame:
    """(track, frame_idx, t, kind, place, activity, least): the activities in which regions are looked for, in the order of their lists."""
    bands = [(c, b) for c in ("mid", "side") for b in ("low", "mid", "high")]
    rising = rises(field, {f"_r_{b}_{c}": f"{b}_{c}" for c, b in bands})
    tops = rising.groupBy("track").agg(*[F.max(f"_r_{b}_{c}").alias(f"_t_{b}_{c}") for c, b in bands])
    df = spread_back(rising, tops, ["track"], F.col("frame_idx"))
    df = df.withColumns({f"_r_{b}_{c}": F.when(F.col(f"_t_{b}_{c}") > EPS, F.col(f"_r_{b}_{c}") / F.col(f"_t_{b}_{c}")).otherwise(0.0) for c, b in bands})
    df = smoothed(df, {f"_s_{b}_{c}": (f"{b}_{c}", SUSTAINED_WIDTH) for c, b in bands} | {"_wide": ("wide", FIELD_WIDTH), "_centred": ("centred", FIELD_WIDTH)})
    kinds = [(f"sustained_{c}", i, f"{b}_sustained_{c}", f"_s_{b}_{c}", SUSTAINED_LEAST) for c in ("mid", "side") for i, b in enumerate(("low", "mid", "high"))]
    kinds += [(f"transient_{c}", i, f"{b}_transient_{c}", f"_r_{b}_{c}", RISING_LEAST) for c in ("mid", "side") for i, b in enumerate(("low", "mid", "high"))]
    kinds += [("wide", 0, "side_heavy_wide_band_region", "_wide", FIELD_LEAST), ("centred", 0, "mid_focused_center_region", "_centred", FIELD_LEAST)]
    rows = F.array(*[F.struct(F.lit(g).alias("list"), F.lit(i).alias("place"), F.lit(n).alias("kind"), F.col(c).alias("activity"), F.lit(x).alias("least")) for g, i, n, c, x in kinds])
    return df.select("track", "frame_idx", "t", F.explode(rows).alias("z")).select("track", "frame_idx", "t", "z.*")


def regions(activity: DataFrame, most: int = MOST_REGIONS) -> DataFrame:
    """(track, list, rank, kind, start_s, end_s, mean, highest): maximal runs of frames at or above their least activity; the first of each list."""
    on = activity.where(F.round("activity", 9) >= F.col("least"))
    island = F.col("frame_idx") - F.row_number().over(Window.partitionBy("track", "kind").orderBy("frame_idx"))
    runs = on.withColumn("_i", island).groupBy("track", "list", "place", "kind", "_i").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"), F.avg("activity").alias("mean"), F.max("activity").alias("highest"))
    rank = F.row_number().over(Window.partitionBy("track", "list").orderBy("place", "start_s"))
    return runs.withColumn("rank", rank).where(F.col("rank") <= most).drop("place", "_i")
