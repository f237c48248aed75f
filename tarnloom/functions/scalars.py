"""Scalar expressions over clips: rates, times, paths, boxes, indices, schedules."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import LongType


def wps(words: Column, seconds: Column) -> Column:
    """Words per second with float semantics: x/0 is infinite, 0/0 is NaN (Spark
    would raise or give null); null where either side is null."""
    inf = F.lit(math.inf)
    return (
        F.when(words.isNull() | seconds.isNull(), F.lit(None).cast("double"))
        .when((seconds == 0) & (words > 0), inf)
        .when((seconds == 0) & (words < 0), -inf)
        .when(seconds == 0, F.lit(math.nan))
        .otherwise(words.cast("double") / F.nullif(seconds, F.lit(0.0)))
    )


def guarded_wps(words: Column, seconds: Column) -> Column:
    """Null unless both sides are positive."""
    return F.when((seconds > 0) & (words > 0), words / seconds)


def hms_seconds(t: Column) -> Column:
    """``HH:MM:SS.mmm`` or plain seconds; null where neither can be parsed."""
    part = F.split(F.trim(t), ":")
    num = lambda i: F.get(part, F.lit(i)).try_cast("double")
    return F.when(t.contains(":"), num(0) * 3600 + num(1) * 60 + num(2)).otherwise(F.trim(t).try_cast("double"))


def clip_length(start: Column, end: Column, least: float = 0.1) -> Column:
    return F.greatest(end - start, F.lit(least))


def safe_name(vid: Column, to: str = ".") -> Column:
    return F.replace(vid, F.lit(":"), F.lit(to))


def clip_path(source: Column, vid: Column, split: Column, roots: dict[str, str] | None = None, colons_stay: str = "how2sign") -> Column:
    """Where a clip lies: below the root of its source, in its split's folder.  The
    source ``colons_stay`` keeps its ids as file names, every other source has
    ``:`` made ``.`` and takes the last root."""
    roots = roots or {"how2sign": "clips/how2sign", "": "clips/openasl"}
    other = list(roots.values())[-1]
    root = F.lit(other)
    for name, path in list(roots.items())[:-1]:
        root = F.when(source == name, F.lit(path)).otherwise(root)
    name = F.when(source == colons_stay, vid).otherwise(safe_name(vid))
    return F.concat(F.concat_ws("/", root, split, name), F.lit(".mp4"))


def remapped_path(path: Column, root: str) -> Column:
    """A path of the form drive, folder, source, split, file put below ``root``,
    where the source's folder stands twice.  Backslashes count as slashes; with
    fewer than four parts after the drive the path stays as it is."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & ~p.contains(":"))
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(F.size(parts) >= 4, F.concat_ws("/", F.lit(root), at(1), at(1), at(2), at(3))).otherwise(path)


def stem(path: Column, fallback: Column) -> Column:
    """The file name without its last suffix; else the first 11 characters of
    ``fallback``."""
    got = F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    return F.coalesce(F.nullif(got, F.lit("")), F.substring(fallback, 1, 11))


def padded_box(x1: Column, x2: Column, pad: float = 0.03) -> tuple[Column, Column]:
    """Both ends moved out by ``pad`` of the width and kept in [0, 1]."""
    width = x2 - x1
    return F.greatest(x1 - width * pad, F.lit(0.0)), F.least(x2 + width * pad, F.lit(1.0))


def rescaled(v: Column, old: Column, new: Column) -> Column:
    """A pixel position at another resolution, rounded half to even."""
    return F.bround(v * new / F.greatest(old, F.lit(1))).cast("int")


def snapped(lo: Column, hi: Column, align: int = 32) -> tuple[Column, Column]:
    """A span cut down to a multiple of ``align``, centred; at least ``align``."""
    size = F.greatest(F.floor((hi - lo) / align) * align, F.lit(align))
    trim = F.floor((hi - lo - size) / 2)
    return (lo + trim).cast("int"), (lo + trim + size).cast("int")


def sample_indices(n: Column, step: Column) -> Column:
    """0, step, 2 step, ... below n, and the last index; empty for n < 1."""
    base = F.sequence(F.lit(0), n - 1, step)
    whole = F.when((n - 1) % step == 0, base).otherwise(F.concat(base, F.array(n - 1)))
    return F.when(n >= 1, whole).otherwise(F.array().cast("array<int>"))


def frame_step(fps: Column, target: int = 20) -> Column:
    """Frames to go on by, so that at most ``target`` a second are kept; 4 where
    the rate is unknown."""
    return F.when(fps > 0, F.greatest(F.ceil(fps / target), F.lit(1))).otherwise(F.lit(4)).cast("int")


@F.pandas_udf(LongType())
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    """Greatest common divisor, by whole columns; null if either is null."""
    both = a.notna() & b.notna()
    out = pd.Series([pd.NA] * len(a), dtype="Int64")
    if both.any():
        import numpy as np

        out[both] = np.gcd(a[both].astype("int64").to_numpy(), b[both].astype("int64").to_numpy())
    return out


def aspect(w: Column, h: Column) -> Column:
    g = F.greatest(gcd(w.cast("long"), h.cast("long")), F.lit(1))
    return F.concat_ws(":", (w / g).cast("long").cast("string"), (h / g).cast("long").cast("string"))


def rational(text: Column) -> Column:
    """``num/den`` to four digits; null for a zero denominator or bad text."""
    part = F.split(text, "/")
    den = F.coalesce(F.get(part, F.lit(1)).try_cast("double"), F.lit(1.0))
    return F.round(F.try_divide(F.get(part, F.lit(0)).try_cast("double"), F.nullif(den, F.lit(0.0))), 4)


def trim_status(found: Column, planned: Column, actual: Column, tolerance: float = 2.0) -> Column:
    """How a cut clip compares with its plan: six labels (fixed values)."""
    diff = actual - planned
    return (
        F.when(~found, "MISSING")
        .when(actual.isNull(), "FFPROBE_ERROR")
        .when(planned.isNull(), "BAD_TSV_TIMING")
        .when(F.abs(diff) <= tolerance, "ALREADY_TRIMMED")
        .when(diff > tolerance, "NEEDS_TRIM")
        .otherwise("CLIP_TOO_SHORT")
    )


def in_range(x: Column, lo: float = 1.3, hi: float = 8.0) -> Column:
    return F.when(x.isNull() | F.isnan(x), "").when(x.between(lo, hi), "YES").otherwise("NO")


def percent(part: Column, whole: Column) -> Column:
    return part * 100.0 / F.greatest(whole, F.lit(1))


def spoken_duration(seconds: Column) -> Column:
    """``1d 2h 3m 4s`` without leading zero parts."""
    s = F.floor(seconds).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(d > 0, F.format_string("%dd %dh %dm %ds", d, h, m, s % 60))
        .when(h > 0, F.format_string("%dh %dm %ds", h, m, s % 60))
        .when(m > 0, F.format_string("%dm %ds", m, s % 60))
        .otherwise(F.format_string("%ds", s % 60))
    )


def perplexity(loss: Column, cap: float = 10.0) -> Column:
    return F.exp(F.least(loss, F.lit(cap)))


def warmup_cosine(step: Column, total: int, warmup_share: float, floor: float = 0.0) -> Column:
    """Linear to 1 over the first share of the steps, then half a cosine down to
    ``floor`` of the peak."""
    warmup = max(int(warmup_share * total), 1)
    progress = F.least(F.greatest((step - warmup) / max(total - warmup, 1), F.lit(0.0)), F.lit(1.0))
    cosine = 0.5 * (1 + F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, F.greatest((step + 1) / warmup, F.lit(1e-8))).otherwise(floor + (1 - floor) * cosine)


def phase(epoch: Column, first_epochs: int, names: tuple[str, str] = ("openasl", "how2sign")) -> Column:
    """The phase of an epoch (from 1), and the epoch within the phase."""
    early = epoch <= first_epochs
    return F.struct(
        F.when(early, names[0]).otherwise(names[1]).alias("phase"),
        F.when(early, epoch).otherwise(epoch - first_epochs).alias("epoch_in_phase"),
    )


def resample_indices(n: Column, new: Column) -> Column:
    """``new`` indices evenly from 0 to n - 1, cut to whole numbers."""
    even = F.transform(F.sequence(F.lit(0), new - 1), lambda i: F.floor(i * (n - 1) / F.greatest(new - 1, F.lit(1))).cast("int"))
    return F.when((n >= 1) & (new >= 1), even).otherwise(F.array().cast("array<int>"))


def fitted(values: Column, size: Column) -> Column:
    """An array cut or padded with its last element to ``size``."""
    missing = F.greatest(size - F.size(values), F.lit(0))
    return F.slice(F.concat(values, F.array_repeat(F.element_at(values, -1), missing)), F.lit(1), size)


def shifted(values: Column, by: int, edge: bool = True) -> Column:
    """An array moved right by ``by`` (left if negative); the gap takes the edge
    value, or zero."""
    n, k = F.size(values), abs(by)
    fill = (F.element_at(values, 1) if by > 0 else F.element_at(values, -1)) if edge else F.lit(0).cast("double")
    gap = F.array_repeat(fill, F.least(F.lit(k), n))
    kept = F.greatest(n - k, F.lit(0))
    out = F.concat(gap, F.slice(values, F.lit(1), kept)) if by > 0 else F.concat(F.slice(values, F.lit(k + 1), kept), gap)
    return F.when(n > 0, out).otherwise(values) if by else values


def missing_if_not_positive(x: Column, factor: float = 1.0) -> Column:
    return F.when(x > 0, x * factor)


def last_index(values: Column, x) -> Column:
    """The last place (from 0) of ``x``; -1 if it is not there."""
    back = F.array_position(F.reverse(values), x)
    return F.when(back > 0, F.size(values) - back).otherwise(-1).cast("int")


def masked_before(values: Column, upto: Column, mask) -> Column:
    """Everything before index ``upto`` replaced by ``mask``."""
    return F.transform(values, lambda v, i: F.when(i < upto, F.lit(mask)).otherwise(v))
