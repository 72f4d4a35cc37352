"""Scalar expressions over samples, intervals and features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite: engines order NaN above all numbers, numpy compares it false."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def all_finite(values: Column) -> Column:
    """True when every component of an array is a finite number."""
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Length common to two half-open intervals, 0 when they only touch."""
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def hull_iou(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Overlap over the hull of both intervals; an empty hull counts as 1."""
    hull = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return overlap(start_a, end_a, start_b, end_b) / F.when(hull == 0, 1).otherwise(hull)


def lag_bucket(lag: Column) -> Column:
    """``nan`` without a lag, ``early`` below 0, ``late`` above 0.4, else ``ok`` (both ends included)."""
    missing = lag.isNull() | F.isnan(lag)
    return F.when(missing, "nan").when(lag < 0, "early").when(lag > 0.4, "late").otherwise("ok")


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """Population z-score; a deviation under 1e-12 counts as 1."""
    return (x - mean) / F.when(std < 1e-12, 1.0).otherwise(std)


def to_radians(values: Column, largest: Column) -> Column:
    """Degrees to radians when the recording's largest absolute angle is over a full turn."""
    return F.when(largest > 2 * math.pi, F.radians(values)).otherwise(values)


def number_or_null(x: Column) -> Column:
    """A finite number as it is, anything else null."""
    return finite(x)


def rounded(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` places as SQL engines round doubles: the scaled double to the whole number nearest it, halves away from zero, and the sign kept, so that
    what is a little below zero gives -0.0. Spark's ``round`` goes by the shortest decimal text and knows no -0.0.
    """
    scale = 10.0**digits
    y = F.abs(x * scale)
    whole = F.when(y < 2.0**52, F.floor(y) + F.floor((y - F.floor(y)) * 2)).otherwise(y)
    return F.when(F.isnan(y) | (y == float("inf")), x).otherwise(F.signum(x) * whole / scale)


def clean_label(label: Column, invalid: Column) -> Column:
    """Trimmed label; empty when the clip is invalid or has none."""
    return F.when(invalid, "").otherwise(F.trim(F.coalesce(label, F.lit(""))))


def cube_limits(xs: Column, ys: Column, zs: Column, margin: float = 0.05) -> Column:
    """Per axis (low, high) of the cube that holds all points with a margin; a zero span counts as 1."""
    lows, highs = [F.array_min(a) for a in (xs, ys, zs)], [F.array_max(a) for a in (xs, ys, zs)]
    span = F.greatest(*[h - l for h, l in zip(highs, lows, strict=True)])
    half = F.when(span == 0, 1.0).otherwise(span) * (0.5 + margin)
    return F.array(*[F.struct(((l + h) / 2 - half).alias("low"), ((l + h) / 2 + half).alias("high")) for l, h in zip(lows, highs, strict=True)])


def centred(points: Column, roots: list[int]) -> Column:
    """Points (arrays of coordinates) less the mean of the points at ``roots``."""
    mean = lambda axis: sum((F.get(F.get(points, r), axis) for r in roots), F.lit(0.0)) / len(roots)
    return F.transform(points, lambda p: F.transform(p, lambda x, axis: x - F.when(axis == 0, mean(0)).when(axis == 1, mean(1)).otherwise(mean(2))))


def trajectory(frames: Column, kind: str) -> Column:
    """``raw`` frames, frames less the first (``centered``), or their differences (``velocity``)."""
    minus = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    if kind == "centered":
        return F.transform(frames, lambda f: minus(f, F.get(frames, 0)))
    if kind == "velocity":
        later = F.slice(frames, F.lit(2), F.greatest(F.size(frames) - 1, F.lit(0)))
        return F.transform(later, lambda f, i: minus(f, F.get(frames, i)))
    return frames
