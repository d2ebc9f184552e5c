"""Scalar column functions: clamps, bands, scales, formats. All are native expressions; null in, null out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and names of the bands.
SUPPORT_BANDS = ((0.78, "dominant"), (0.58, "pronounced"), (0.38, "moderate"), (0.18, "restrained"), (None, "reduced"))
QUARTER_STATES = ((0.75, "very_high"), (0.5, "high"), (0.25, "moderate"), (None, "low"))
EXTERNAL_CONFIDENCE = ((0.85, "very_high"), (0.75, "high"), (0.55, "medium"), (0.35, "low"), (None, "very_low"))
PRIOR_CONFIDENCE = ((0.60, "strong"), (0.36, "moderate"), (None, "weak"))
REPORT_CONFIDENCE = ((0.72, "high"), (0.48, "medium"), (0.28, "low"), (None, "trace"))
# Bands of signed measures; of two steps with one sign the outer one comes first.
BRIGHTNESS_ABOVE = ((0.45, "upper-weighted / bright"), (0.18, "slightly upper-weighted"))
BRIGHTNESS_BELOW = ((-0.45, "low-weighted / dark"), (-0.18, "slightly low-weighted"))
DISTANCE_ABOVE, DISTANCE_BELOW = ((0.55, "close / strongly present"), (0.25, "near-to-mid presence")), ((-0.35, "recessed or distant"),)
LATERAL_ABOVE, LATERAL_BELOW = ((0.45, "right-leaning"), (0.15, "slightly right-leaning")), ((-0.45, "left-leaning"), (-0.15, "slightly left-leaning"))
PHASE_ABOVE, PHASE_BELOW = ((0.65, "coherent center support"), (0.25, "moderately coherent")), ((-0.15, "decorrelated / phase-opposed"),)
LEVEL_ABOVE = ((-6.0, "near-full-scale digital level"), (-14.0, "high digital level"), (-28.0, "moderate digital level"))
LEVEL_BELOW = ((-90.0, "digital level unavailable or near silence"),)
NOTE_DENSITY = ((4.0, "dense"), (1.0, "medium"), (None, "sparse"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def signed_clamp(x: Column) -> Column:
    return clamp(x, -1.0, 1.0)


def band(x: Column, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Name of the first step whose threshold the value reaches; null has no band."""
    out = None
    for least, name in steps:
        if least is None:
            return F.when(x.isNull(), F.lit(None)).otherwise(out.otherwise(name))
        out = F.when(x >= least, name) if out is None else out.when(x >= least, name)
    return out


def signed_band(x: Column, above: Sequence[tuple[float, str]], below: Sequence[tuple[float, str]], between: str) -> Column:
    """Name of the first step that the value reaches upwards or downwards, else the name between them; null has no band."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for least, name in above:
        out = out.when(x >= least, name)
    for most, name in below:
        out = out.when(x <= most, name)
    return out.otherwise(between)


def brightness_band(x: Column) -> Column:
    return signed_band(x, BRIGHTNESS_ABOVE, BRIGHTNESS_BELOW, "balanced spectral weight")


def distance_band(x: Column) -> Column:
    return signed_band(x, DISTANCE_ABOVE, DISTANCE_BELOW, "mid-field / neutral distance")


def lateral_band(x: Column) -> Column:
    return signed_band(x, LATERAL_ABOVE, LATERAL_BELOW, "centered / balanced")


def phase_band(x: Column) -> Column:
    return signed_band(x, PHASE_ABOVE, PHASE_BELOW, "partly diffuse / weakly coherent")


def level_band(x: Column) -> Column:
    return signed_band(x, LEVEL_ABOVE, LEVEL_BELOW, "low digital level")


def comparative_band(delta: Column, step: float = 0.12) -> Column:
    return F.when(delta >= step, "higher").when(delta <= -step, "lower").when(delta.isNotNull(), "similar")


def trend(delta: Column, small: float) -> Column:
    return F.when(delta > small, "rising").when(delta < -small, "falling").when(delta.isNotNull(), "stable")


def decibel(x: Column) -> Column:
    """20 log10 of an amplitude; null at silence."""
    return F.when(x > 1e-12, 20 * F.log10(x))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def soft_ratio(x: Column) -> Column:
    return x / (1 + x)


def norm_signed(x: Column) -> Column:
    """[-1, 1] onto [0, 1]; other values are taken to be in [0, 1] already."""
    return F.when(F.abs(x) <= 1, (x + 1) / 2).otherwise(clamp(x))


def minute_label(seconds: Column) -> Column:
    """MM:SS.ss."""
    whole = F.floor(F.round(seconds * 100))
    return F.concat(F.lpad(F.floor(whole / 6000).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(whole / 100) % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))


def parse_clock(text: Column) -> Column:
    """Seconds of s, m:s or h:m:s; null where it is none of these."""
    parts = F.transform(F.split(F.regexp_replace(F.trim(text), "s$", ""), ":"), lambda p: p.try_cast("double"))
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p)
    return F.when(F.size(parts) <= 3, total)


def first_nonempty(*columns: Column) -> Column:
    """First value that is not blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


def label(text: Column) -> Column:
    """Lower case, without outer blanks, with _ and - as blanks."""
    return F.trim(F.translate(F.lower(text), "_-", "  "))


def shortened(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def file_name(text: Column, default: str = "audio") -> Column:
    """Letters, digits and -_. stay, all else becomes _, outer _ go."""
    safe = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\-_.]", "_"), "^_+|_+$", "")
    return F.when(safe == "", default).otherwise(safe)


def midi_hertz(note: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (note - 69) / 12)


def without_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals as a share of the shorter one."""
    return clamp((F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(0.001), F.least(a1 - a0, b1 - b0)))
