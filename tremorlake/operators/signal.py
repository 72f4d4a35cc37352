"""Operators on sampled signals: rows of a recording's key, a sample index and values.

Every operator takes the names of its columns. Windows partition by recording and order by sample, so consecutive
operators on the same recording share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.scalars import MAD_SCALE, finite

KEY, ORDER = "rec", "i"
OTSU_BINS = 256


def signal_view(events: DataFrame) -> DataFrame:
    """``rec, i, v, k`` of an event table: one recording a user, samples numbered by time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("rec"), (F.row_number().over(order) - 1).cast("long").alias("i"), finite(F.col("value")).alias("v"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def _by(key: str = KEY, order: str = ORDER) -> Window:
    return Window.partitionBy(key).orderBy(order)


def _all(key: str = KEY) -> Window:
    return Window.partitionBy(key)


def by_recording(df: DataFrame, key: str = KEY) -> DataFrame:
    """``df`` dealt by recording to the session's shuffle partitions, for grouped Python: its cost is not in the bytes that adaptive execution would join partitions by."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def box(value: Column, size: int, key: str = KEY, order: str = ORDER) -> Column:
    """Centred mean over ``size`` samples; beyond the ends the first and last values go on.

    Samples are consecutive from 0. A window that holds a missing value gives null.
    """
    before, after = size // 2, size - size // 2 - 1
    at, n = F.row_number().over(_by(key, order)) - 1, F.count(F.lit(1)).over(_all(key))
    frame = _by(key, order).rowsBetween(-before, after)
    whole = _by(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, high = F.greatest(F.lit(0), before - at), F.greatest(F.lit(0), at + after - n + 1)
    ends = F.coalesce(low * F.first(value).over(whole), F.lit(0.0)) + F.coalesce(high * F.last(value).over(whole), F.lit(0.0))  # a missing end lies in its windows and is counted there
    total = F.sum(value).over(frame) + ends
    missing = F.count(F.when(value.isNull(), 1)).over(frame)
    return F.when(missing == 0, total / size)


def box_smooth(df: DataFrame, size: int, value: str = "v", out: str = "smooth", key: str = KEY, order: str = ORDER) -> DataFrame:
    return df.withColumn(out, box(F.col(value), size, key, order))


def envelope(df: DataFrame, channels: Sequence[str], size: int, out: str = "env", key: str = KEY, order: str = ORDER) -> DataFrame:
    """Root mean square over channels, each less its median, smoothed."""
    centred = [F.col(c) - F.percentile(c, F.lit(0.5)).over(_all(key)) for c in channels]
    raw = F.sqrt(sum((c * c for c in centred), F.lit(0.0)) / len(channels))
    return df.withColumn("__raw", raw).withColumn(out, box(F.col("__raw"), size, key, order)).drop("__raw")


def speed(df: DataFrame, channels: Sequence[str], fs: float, size: int, out: str = "spd", key: str = KEY, order: str = ORDER) -> DataFrame:
    """Length of the step from the sample before, times ``fs``, smoothed; the first sample takes the second's, a lone one 0."""
    steps = [F.col(c) - F.lag(c).over(_by(key, order)) for c in channels]
    raw = df.withColumn("__step", F.sqrt(sum((s * s for s in steps), F.lit(0.0))) * fs).withColumn("__n", F.count(F.lit(1)).over(_all(key)))
    first = F.row_number().over(_by(key, order)) == 1
    step = F.when(F.col("__n") < 2, 0.0).when(first, F.lead("__step").over(_by(key, order))).otherwise(F.col("__step"))
    return raw.withColumn("__first", step).withColumn(out, box(F.col("__first"), size, key, order)).drop("__step", "__n", "__first")


def speed_by_time(df: DataFrame, channels: Sequence[str], size: int, time: str = "t", out: str = "spd", key: str = KEY, order: str = ORDER) -> DataFrame:
    """Speed over real time steps (bad steps take the median one), missing values 0, zero-padded smoothing."""
    w = _by(key, order)
    step = F.col(time) - F.lag(time).over(w)
    df = df.withColumn("__dt", F.when(step > 0, step))
    df = df.withColumn("__dt", F.coalesce("__dt", F.percentile("__dt", F.lit(0.5)).over(_all(key))))
    steps = [F.col(c) - F.lag(c).over(w) for c in channels]
    df = df.withColumn("__v", F.coalesce(F.sqrt(sum((s * s for s in steps), F.lit(0.0))) / F.col("__dt"), F.lit(0.0)))
    frame = w.rowsBetween(-(size // 2), size - size // 2 - 1)
    return df.withColumn(out, F.sum("__v").over(frame) / size).drop("__dt", "__v")


def robust_threshold(df: DataFrame, percent: float, k: float, value: str = "v", key: str = KEY) -> DataFrame:
    """Per recording the larger of a percentile and median + k robust deviations, over finite values; 0 without any."""
    x = df.select(key, finite(F.col(value)).alias("x")).withColumn("m", F.percentile("x", F.lit(0.5)).over(_all(key)))
    agg = x.groupBy(key).agg(
        F.percentile("x", F.lit(percent / 100)).alias("p"), F.first("m").alias("m"), F.percentile(F.abs(F.col("x") - F.col("m")), F.lit(0.5)).alias("mad")
    )
    return agg.select(key, F.coalesce(F.greatest(F.col("p"), F.col("m") + k * MAD_SCALE * F.col("mad")), F.lit(0.0)).alias("threshold"))


def otsu_threshold(df: DataFrame, value: str = "v", key: str = KEY, bins: int = OTSU_BINS) -> DataFrame:
    """Per recording the centre of the bin after which the two sides differ most; a constant signal's own value.

    Variances are rounded before they are ranked, so that the first of equal ones wins whatever the order of sums.
    """
    x = df.select(key, finite(F.col(value)).alias("x")).where("x is not null")
    x = x.withColumn("lo", F.min("x").over(_all(key))).withColumn("hi", F.max("x").over(_all(key)))
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    hist = x.withColumn("bin", bin_).groupBy(key, "bin").agg(F.count("*").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    hist = hist.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    share = F.col("c") / F.sum("c").over(_all(key))
    hist = hist.withColumn("p", share).withColumn("px", share * F.col("centre"))
    up_to = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("w", F.sum("p").over(up_to)).withColumn("m", F.sum("px").over(up_to)).withColumn("t", F.sum("px").over(_all(key)))
    apart = F.when(F.col("w") * (1 - F.col("w")) <= 1e-12, 1e-12).otherwise(F.col("w") * (1 - F.col("w")))
    hist = hist.withColumn("between", F.round((F.col("t") * F.col("w") - F.col("m")) ** 2 / apart, 6))
    best = F.min_by("centre", F.struct(-F.col("between"), F.col("bin")))
    return hist.groupBy(key).agg(F.when(F.first("hi") > F.first("lo"), best).otherwise(F.first("hi")).alias("otsu"))


def bimodal_thresholds(df: DataFrame, enter_k: float = 0.8, exit_k: float = 0.4, value: str = "v", key: str = KEY) -> DataFrame:
    """``enter`` and ``exit`` between the median of the resting values and Otsu's valley; robust ones where these coincide."""
    x = df.select(key, finite(F.col(value)).alias("x")).where("x is not null").join(otsu_threshold(df, value, key), key)
    x = x.withColumn("med", F.percentile("x", F.lit(0.5)).over(_all(key)))
    agg = x.groupBy(key).agg(
        F.first("otsu").alias("t"), F.percentile(F.when(F.col("x") <= F.col("otsu"), F.col("x")), F.lit(0.5)).alias("rest"), F.min("x").alias("low"),
        F.first("med").alias("med"), (MAD_SCALE * F.percentile(F.abs(F.col("x") - F.col("med")), F.lit(0.5))).alias("sigma"),
    ).withColumn("rest", F.coalesce("rest", "low"))
    span = F.col("t") - F.col("rest")
    agg = agg.withColumn("span", span).withColumn("enter", F.col("rest") + enter_k * span).withColumn("exit", F.col("rest") + exit_k * span)
    robust = ((F.col("enter") <= F.col("exit")) | (F.col("span") <= 0)) & (F.col("sigma") > 0)
    return agg.select(
        key, F.when(robust, F.col("med") + 1.2 * F.col("sigma")).otherwise(F.col("enter")).alias("enter"), F.when(robust, F.col("med") + 0.5 * F.col("sigma")).otherwise(F.col("exit")).alias("exit")
    )


def move_thresholds(df: DataFrame, percent: float, k: float, fraction: float, fixed: tuple[float, float], value: str = "spd", key: str = KEY) -> DataFrame:
    """``enter`` at the robust threshold and ``exit`` a fraction of it; the fixed pair where that isn't positive."""
    t = robust_threshold(df, percent, k, value, key)
    good = F.col("threshold") > 0
    return t.select(key, F.when(good, F.col("threshold")).otherwise(fixed[0]).alias("enter"), F.when(good, fraction * F.col("threshold")).otherwise(fixed[1]).alias("exit"))


def gap_fill(df: DataFrame, value: str = "v", max_gap: int | None = None, edges: bool = False, out: str = "filled", key: str = KEY, order: str = ORDER) -> DataFrame:
    """Linear fill of missing values between known ones.

    Gaps longer than ``max_gap`` samples stay open; so do the ends, unless ``edges`` repeats the nearest value there (0
    where nothing is known).
    """
    return gaps_filled(df, {out: value}, max_gap, edges, key, order)


def gaps_filled(df: DataFrame, names: dict[str, str], max_gap: int | None = None, edges: bool = False, key: str = KEY, order: str = ORDER) -> DataFrame:
    """``gap_fill`` of several columns (``names``: result to source) with one pass forward and one backward.

    The known value ahead is found by a window in descending order: a frame that reaches to the end of the recording
    would be gone through again for every sample.
    """
    forward = _by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    known = {f"__k{k}": F.when(finite(F.col(c)).isNotNull(), F.struct(finite(F.col(c)).alias("v"), F.col(order).alias("p"))) for k, c in enumerate(names.values())}
    df = df.withColumns(known).withColumns({f"__b{k}": F.last(f"__k{k}", True).over(forward) for k in range(len(names))})
    df = df.withColumns({f"__a{k}": F.last(f"__k{k}", True).over(backward) for k in range(len(names))})
    out = {}
    for k, name in enumerate(names):
        v0, v1, p0, p1 = (F.col(f"__{side}{k}.{f}") for f, side in (("v", "b"), ("v", "a"), ("p", "b"), ("p", "a")))
        inside = v0.isNotNull() & v1.isNotNull()
        if max_gap is not None:
            inside = inside & (p1 - p0 - 1 <= max_gap)
        filled = F.when(F.col(f"__k{k}").isNotNull(), F.col(f"__k{k}.v")).when(inside, v0 + (v1 - v0) * (F.col(order) - p0) / (p1 - p0))
        out[name] = F.coalesce(filled, F.when(v0.isNull() | v1.isNull(), F.coalesce(v0, v1, F.lit(0.0)))) if edges else filled
    return df.withColumns(out).drop(*[f"__{side}{k}" for side in "kba" for k in range(len(names))])


def resample(values: Column, length: int) -> Column:
    """An array read at ``length`` even places from first to last, linearly between samples."""
    last = F.size(values) - 1

    def at(k: Column) -> Column:
        place = k * last / (length - 1) if length > 1 else F.lit(0.0)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, last)
        return F.get(values, low) + (F.get(values, high) - F.get(values, low)) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def excursion(df: DataFrame, channels: Sequence[str], key: str | Sequence[str] = KEY, min_finite: float = 0.5) -> DataFrame:
    """Per recording (or per ``key`` columns) the norm of the channels' ranges over known values; null when too few samples are whole."""
    keys = [key] if isinstance(key, str) else list(key)
    whole = sum((F.col(c).isNull().cast("int") for c in channels), F.lit(0)) == 0
    ranges = [F.max(c) - F.min(c) for c in channels]
    norm = F.sqrt(sum((r * r for r in ranges), F.lit(0.0)))
    return df.groupBy(*keys).agg(F.avg(whole.cast("double")).alias("whole_share"), norm.alias("range")).select(
        *keys, "whole_share", F.when(F.col("whole_share") >= min_finite, F.col("range")).alias("pose_range")
    )


def lag_scan(df: DataFrame, a: str, b: str, max_lag: int, step: int = 1, min_corr: float = 0.05, key: str = KEY, order: str = ORDER) -> DataFrame:
    """``lag`` (samples of the thinned grid that ``a`` leads ``b`` by) and ``corr`` of the best shift, the first of equal ones.

    Both signals are z-scored as a whole (missing ones count as 0) and their products averaged over each overlap of ten
    samples or more. No lag below ``min_corr`` or for constant signals. Only the thinned samples are shuffled; a
    recording's shifts are products of array slices in one Arrow group of its thinned samples.
    """
    x = df.where(F.col(order) % step == 0).select(key, F.floor(F.col(order) / step).alias("g"), finite(F.col(a)).alias("a"), finite(F.col(b)).alias("b"))

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        g = rows["g"].to_numpy()
        place, n = g - g.min(), int(g.max() - g.min()) + 1
        there, signals = np.zeros(n), []
        there[place] = 1
        for c in "ab":
            v = rows[c].to_numpy(float)
            flat = not np.isfinite(v).any() or np.nanstd(v) <= 1e-12
            z = np.zeros(n)
            if not flat:
                z[place] = np.nan_to_num((v - np.nanmean(v)) / np.nanstd(v), nan=0.0)
            signals.append(None if flat else z)
        lag, corr = None, 0.0
        if signals[0] is not None and signals[1] is not None:
            for shift in range(-max_lag, max_lag + 1):
                low, high = max(0, -shift), min(n, n - shift)
                count = there[low:high] @ there[low + shift : high + shift] if high > low else 0
                if count >= 10:
                    c = round(float(signals[0][low:high] @ signals[1][low + shift : high + shift] / count), 9)
                    if lag is None or c > corr:
                        lag, corr = shift, c
        found = lag is not None and corr >= min_corr
        return pd.DataFrame({key: rows[key].iloc[:1], "lag": pd.array([lag if found else None], "Int64"), "corr": [max(corr, 0.0)]})

    kind = df.schema[key].dataType.simpleString()
    every = df.select(key).distinct()
    best = by_recording(x, key).groupBy(key).applyInPandas(scan, f"{key} {kind}, lag long, corr double")
    return every.join(best, key, "left").select(key, "lag", F.coalesce("corr", F.lit(0.0)).alias("corr"))


def decimate(df: DataFrame, step: int, order: str = ORDER) -> DataFrame:
    return df.where(F.col(order) % step == 0)


def frame_step(n: Column, fs: float, rate: float = 15.0, most: int = 3000) -> Column:
    """Samples from one shown frame to the next: ``rate`` a second, wider where more than ``most`` frames would come."""
    return F.greatest(F.lit(max(1, round(fs / rate))), F.ceil(n / most)).cast("int")


def keyframes(start: Column, apex: Column, end: Column) -> Column:
    """Start, a third, apex, two thirds and end of a gesture."""
    n = end - start
    return F.array(start, (start + F.floor(n / 3)).cast("long"), apex, (start + F.floor(2 * n / 3)).cast("long"), end - 1)
