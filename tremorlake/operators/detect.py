"""The move-then-hold detector: a machine whose state depends on its own run, and what is built on it.

The machine is a fold over a recording's samples inside the JVM. Peak rules and the whole detector run as one grouped Arrow
function a recording, on whole arrays; ``detect_long`` composes the detector of column operators instead.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlake.functions.scalars import MAD_SCALE, finite
from tremorlake.operators import signal

RUNS = "array<struct<s:bigint,e:bigint>>"


@dataclass(frozen=True)
class Settings:
    """Fixed default values, in seconds, samples per second and radians."""

    fs: float = 2000
    smooth_ms: float = 150
    min_action_s: float = 0.4
    min_rest_gap_s: float = 0.2
    enter_thresh: float | None = None
    exit_thresh: float | None = None
    emg_enter_k: float = 0.8
    emg_exit_k: float = 0.4
    pose_smooth_ms: float = 250
    pose_pct: float = 35
    pose_mad: float = 1.5
    min_static_s: float = 0.35
    min_motion_s: float = 0.20
    pose_min_range: float = float(np.radians(15))
    pose_long_seg_s: float = 2.5
    move_enter: float = float(np.radians(60))
    move_exit: float = float(np.radians(25))
    settle_frac: float = 0.25
    move_exit_frac: float = 0.5
    auto_move_thresh: bool = True
    enable_r2: bool = True
    enable_r7: bool = False
    max_hold_s: float = 4.0
    snap_window_s: float = 0.15
    nan_max_gap_s: float = 0.20
    min_finite_frac: float = 0.5

    def samples(self, seconds: float) -> int:
        return int(round(seconds * self.fs))


def motion_machine(df: DataFrame, enter: float | Column, leave: float | Column, settle: float, min_static: int, min_motion: int, value: str = "v", key: str = "rec", order: str = "i") -> DataFrame:
    """Motion runs ``s, e``: on at ``value >= enter``; off when ``min_static`` samples in a row are settled.

    Settled is at or under min(0.9 enter, max(leave, settle x the run's peak)). A run ends with its first settled sample
    and counts from ``min_motion`` samples on; one still open ends with the signal. Missing values neither start a run
    nor settle one. ``enter`` and ``leave`` may be columns with one value a recording. A recording's samples are one
    array of 16 bytes each while its runs are found.
    """
    column = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    arrays = df.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("x"), F.first(column(enter)).alias("__enter"), F.first(column(leave)).alias("__leave")
    )
    enter, leave = F.col("__enter"), F.col("__leave")
    start = F.struct(F.lit(0).cast("long").alias("t"), F.lit(-1).cast("long").alias("on"), F.lit(0).cast("long").alias("quiet"), F.lit(0.0).alias("peak"), F.array().cast(RUNS).alias("runs"))

    def step(a, v):
        moving, known = a["on"] >= 0, v.isNotNull() & ~F.isnan(v)
        begins = ~moving & F.coalesce(known & (v >= enter), F.lit(False))
        peak = F.when(begins, v).when(moving & F.coalesce(known & (v > a["peak"]), F.lit(False)), v).otherwise(a["peak"])
        low = F.coalesce(known & (v <= F.least(0.9 * enter, F.greatest(leave, settle * peak))), F.lit(False))
        quiet = F.when(moving & low, a["quiet"] + 1).otherwise(F.lit(0).cast("long"))
        ends = moving & (quiet >= min_static)
        end = a["t"] - quiet + 1
        run = F.array(F.struct(a["on"].alias("s"), end.alias("e")))
        runs = F.when(ends & (end - a["on"] >= min_motion), F.concat(a["runs"], run)).otherwise(a["runs"])
        on = F.when(begins, a["t"]).when(ends, F.lit(-1).cast("long")).otherwise(a["on"])
        return F.struct((a["t"] + 1).alias("t"), on.alias("on"), F.when(ends, F.lit(0).cast("long")).otherwise(quiet).alias("quiet"), peak.alias("peak"), runs.alias("runs"))

    def finish(a):
        last = F.array(F.struct(a["on"].alias("s"), a["t"].alias("e")))
        return F.when((a["on"] >= 0) & (a["t"] - a["on"] >= min_motion), F.concat(a["runs"], last)).otherwise(a["runs"])

    return arrays.select(key, F.inline(F.aggregate("x", start, step, finish)))


# Peak rules on arrays of one recording.


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """How far each peak stands above the higher of the two lowest values on its way to higher samples, or to the ends.

    One pass over the local maxima each way with a stack of those not yet passed by a higher one.
    """
    edges = np.flatnonzero(np.diff(x) != 0)
    tops = np.unique(np.concatenate([[0], (np.append(0, edges + 1) + np.append(edges, len(x) - 1)) // 2, peaks, [len(x) - 1]]))
    rise, fall = np.append(True, x[tops[1:]] >= x[tops[:-1]]), np.append(x[tops[:-1]] >= x[tops[1:]], True)
    tops = tops[(rise & fall) | np.isin(tops, [0, len(x) - 1])]
    between = np.minimum.reduceat(x, tops)[:-1]
    lowest = []
    for heights, gaps in ((x[tops], between), (x[tops][::-1], between[::-1])):
        stack, found = [], []
        for k, h in enumerate(heights):
            low = h if k == 0 else min(gaps[k - 1], h)
            while stack and stack[-1][0] <= h:
                low = min(low, stack.pop()[1])
            stack.append((h, low))
            found.append(low)
        lowest.append(np.array(found))
    base = np.maximum(lowest[0], lowest[1][::-1])
    return x[peaks] - base[np.searchsorted(tops, peaks)]


def find_peaks(x: np.ndarray, height: float, distance: int, prominence: float) -> np.ndarray:
    """Local maxima (middles of plateaus) of at least ``height``, thinned tallest first to ``distance`` apart, that stand out by ``prominence``."""
    n = len(x)
    edges = np.flatnonzero(np.diff(x) != 0)
    first, last = np.append(0, edges + 1), np.append(edges, n - 1)
    inner = (first > 0) & (last < n - 1)
    first, last = first[inner], last[inner]
    top = (x[first - 1] < x[first]) & (x[last + 1] < x[last]) if len(first) else np.zeros(0, bool)
    peaks = (first[top] + last[top]) // 2
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), bool)
    near = np.searchsorted(peaks, peaks - distance, side="right"), np.searchsorted(peaks, peaks + distance, side="left")
    for k in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[k]:
            keep[near[0][k] : near[1][k]] = False
            keep[k] = True
    peaks = peaks[keep]
    return peaks[prominences(x, peaks) >= prominence] if len(peaks) else peaks


def valley_cuts(x: np.ndarray, peaks: np.ndarray) -> list[int]:
    """The least sample between each two neighbouring peaks, the first of equal ones."""
    return [int(p + np.argmin(x[p : q + 1])) for p, q in zip(peaks[:-1], peaks[1:], strict=True)]


def valley_split(df: DataFrame, enter: float, distance: int, value: str = "v", key: str = "rec", order: str = "i") -> DataFrame:
    """``cut`` samples of every recording: valleys between peaks over ``enter`` that stand out by half of it."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(g.sort_values(order)[value].to_numpy(float), nan=0.0)
        cuts = valley_cuts(x, find_peaks(x, enter, distance, 0.5 * enter))
        return pd.DataFrame({key: g[key].iloc[0], "cut": np.array(cuts, np.int64)})

    return signal.by_recording(df.select(key, order, value), key).groupBy(key).applyInPandas(run, f"{key} long, cut long")


def peak_segments(df: DataFrame, detect: float, bound_frac: float, prominence_k: float, distance: int, merge_gap: int, value: str = "v", key: str = "rec", order: str = "i") -> DataFrame:
    """One segment for each peak of speed: runs over the lower bound, cut at the valleys between their peaks; ``apex`` is the peak."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.nan_to_num(g.sort_values(order)[value].to_numpy(float), nan=0.0)
        median = np.median(x)
        peaks = find_peaks(x, detect, max(1, distance), max(prominence_k * MAD_SCALE * np.median(np.abs(x - median)), 1e-9))
        on = np.diff(np.concatenate([[0], (x > bound_frac * detect).astype(int), [0]]))
        runs: list[list[int]] = []
        for a, b in zip(np.flatnonzero(on == 1), np.flatnonzero(on == -1), strict=True):
            if runs and a - runs[-1][1] <= merge_gap:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        rows = []
        for a, b in runs:
            own = peaks[(peaks >= a) & (peaks < b)]
            bounds = [a, *valley_cuts(x, own), b] if len(own) else []
            rows += [(s, e, p) for s, e, p in zip(bounds[:-1], bounds[1:], own, strict=True) if e - s >= distance]
        out = np.array(rows, np.int64).reshape(-1, 3)
        return pd.DataFrame({key: g[key].iloc[0], "s": out[:, 0], "e": out[:, 1], "apex": out[:, 2]})

    return signal.by_recording(df.select(key, order, value), key).groupBy(key).applyInPandas(run, f"{key} long, s long, e long, apex long")


ACTION_FIELDS = "s long, e long, motion_s long, motion_e long, hold_s long, hold_e long, apex long, fusion_type string, review_flag string"


# The detector on the arrays of one recording.


def _mask_runs(mask: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true values, a row each."""
    turns = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.stack([np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)], 1)


def _moving_mean(x: np.ndarray, size: int) -> np.ndarray:
    """Centred mean with the ends repeated; a missing value spoils only the windows that hold it."""
    size = max(1, size)
    if not len(x):
        return x
    padded = np.pad(x, (size // 2, size - size // 2 - 1), mode="edge")
    bad = np.isnan(padded)
    window = lambda v: np.subtract(*(np.concatenate([[0], np.cumsum(v)])[k] for k in (slice(size, None), slice(None, -size))))
    return np.where(window(bad) > 0, np.nan, window(np.where(bad, 0.0, padded)) / size)


def _bridged(x: np.ndarray, most: int) -> np.ndarray:
    """Missing values between known ones filled linearly in gaps of up to ``most`` samples."""
    known = np.flatnonzero(~np.isnan(x))
    if len(known) < 2:
        return x
    at = np.arange(len(x))
    right = np.searchsorted(known, at)
    inside = (right > 0) & (right < len(known))
    gap = np.zeros(len(x), np.int64)
    gap[inside] = known[right[inside]] - known[right[inside] - 1] - 1
    return np.where(np.isnan(x) & inside & (gap <= most), np.interp(at, known, x[known]), x)


def _two_levels(x: np.ndarray, enter_k: float, exit_k: float) -> tuple[float, float]:
    """Enter and exit levels between the resting median and the valley of a two-sided histogram; robust ones where these coincide."""
    x = x[~np.isnan(x)]
    if not len(x):
        return 0.0, 0.0
    low, high, middle = x.min(), x.max(), np.median(x)
    valley = high
    if high > low:
        count = np.bincount(np.minimum((x - low) / (high - low) * signal.OTSU_BINS, signal.OTSU_BINS - 1).astype(int), minlength=signal.OTSU_BINS)
        centre = low + (np.arange(signal.OTSU_BINS) + 0.5) * (high - low) / signal.OTSU_BINS
        share, mass = np.cumsum(count) / len(x), np.cumsum(count * centre) / len(x)
        apart = np.round((mass[-1] * share - mass) ** 2 / np.maximum(share * (1 - share), 1e-12), 6)
        valley = centre[np.argmax(np.where(count > 0, apart, -1.0))]
    rest = np.median(x[x <= valley]) if (x <= valley).any() else low
    sigma = MAD_SCALE * np.median(np.abs(x - middle))
    levels = rest + enter_k * (valley - rest), rest + exit_k * (valley - rest)
    return levels if levels[0] > levels[1] or sigma <= 0 else (middle + 1.2 * sigma, middle + 0.5 * sigma)


def _latched(x: np.ndarray, enter: float, leave: float, min_gap: int, min_length: int) -> np.ndarray:
    """Bursts by a two-threshold latch, near ones merged, then short ones dropped."""
    decides = np.where(x >= enter, 1, np.where(x < leave, 0, -1))
    last = np.maximum.accumulate(np.where(decides >= 0, np.arange(len(x)), -1))
    raw = _mask_runs((last >= 0) & (decides[last] == 1))
    begins = np.append(True, raw[1:, 0] - raw[:-1, 1] >= min_gap)[: len(raw)]
    merged = np.stack([raw[begins, 0], raw[np.append(begins[1:], True)[: len(raw)], 1]], 1)
    return merged[merged[:, 1] - merged[:, 0] >= min_length]


def _machine_runs(x: np.ndarray, enter: float, leave: float, settle: float, min_static: int, min_motion: int) -> np.ndarray:
    """The runs of ``motion_machine``: each is read ahead in growing blocks, with the peak so far as a running maximum."""
    starts, runs, at, n = np.flatnonzero(x >= enter), [], 0, len(x)
    while (k := np.searchsorted(starts, at)) < len(starts):
        on, block, end = starts[k], 4 * max(1, min_static), None
        while end is None:
            v = x[on : on + block]
            peak = np.fmax.accumulate(v)
            settled = v <= np.minimum(0.9 * enter, np.maximum(leave, settle * peak))
            quiet = _mask_runs(settled)
            long_enough = quiet[quiet[:, 1] - quiet[:, 0] >= min_static]
            if len(long_enough):
                end = on + long_enough[0, 0]
                at = end + min_static
            elif on + block >= n:
                end = at = n
            block *= 2
        if end - on >= min_motion:
            runs.append((on, end))
    return np.array(runs, np.int64).reshape(-1, 2)


def _first_least(x: np.ndarray, a: int, b: int) -> int:
    return a + int(np.argmin(np.where(np.isnan(x[a:b]), np.inf, x[a:b])))


def recording_actions(emg: np.ndarray, pose: np.ndarray, c: Settings) -> dict[str, np.ndarray]:
    """Columns of ``ACTION_FIELDS`` of one recording (rows are samples, missing ones NaN); nothing where there is no action."""
    n, near = len(emg), c.samples(c.snap_window_s)
    names = [x.split()[0] for x in ACTION_FIELDS.split(", ")]
    pose = np.stack([_bridged(p, c.samples(c.nan_max_gap_s)) for p in pose.T], 1)
    whole = ~np.isnan(pose).any(1)

    def moving(a: int, b: int) -> bool:
        """Whether enough samples are whole and the channels' ranges reach the least excursion."""
        if b <= a or whole[a:b].mean() < c.min_finite_frac or not whole[a:b].any():
            return False
        return bool(np.sqrt(np.nansum((np.nanmax(pose[a:b], 0) - np.nanmin(pose[a:b], 0)) ** 2)) >= c.pose_min_range)

    if not n or not moving(0, n):
        return {}
    steps = np.sqrt(((pose[1:] - pose[:-1]) ** 2).sum(1)) * c.fs
    speed = _moving_mean(np.append(steps[:1], steps) if n > 1 else np.zeros(1), c.samples(c.pose_smooth_ms / 1000))
    some = ~np.isnan(emg).all(0)
    centres = np.full(emg.shape[1], np.nan)
    centres[some] = np.nanmedian(emg[:, some], 0)
    env = _moving_mean(np.sqrt(((emg - centres) ** 2).mean(1)), c.samples(c.smooth_ms / 1000))
    given = c.enter_thresh is not None and c.exit_thresh is not None
    enter, leave = (c.enter_thresh, c.exit_thresh) if given else _two_levels(env, c.emg_enter_k, c.emg_exit_k)
    rest_gap = c.samples(c.min_rest_gap_s)
    bursts = _latched(env, enter, leave, rest_gap, c.samples(c.min_action_s)) if enter > leave else np.empty((0, 2), np.int64)
    middles = bursts.sum(1) // 2

    known = speed[~np.isnan(speed)]
    go, still = c.move_enter, c.move_exit
    if c.auto_move_thresh and len(known):
        middle = np.median(known)
        level = max(np.percentile(known, c.pose_pct), middle + c.pose_mad * MAD_SCALE * np.median(np.abs(known - middle)))
        go, still = (level, c.move_exit_frac * level) if level > 0 else (go, still)
    runs = _machine_runs(speed, go, still, c.settle_frac, c.samples(c.min_static_s), c.samples(c.min_motion_s))

    def slowest(at: int) -> int:
        return _first_least(speed, max(0, at - near), at + near + 1)

    begun = [(a, b) for a, b in runs.tolist() if moving(a, b)]
    onsets = {a for a, _ in begun}
    for a, b in begun if c.enable_r2 else []:
        if (b - a) / c.fs > c.pose_long_seg_s:  # never settles: cut at clean rests between its bursts, else at valleys of speed
            inner = bursts[(a <= middles) & (middles < b)]
            rests = [(p, q) for p, q in zip(inner[:-1, 1], inner[1:, 0], strict=True) if q - p >= rest_gap and (env[p:q] < leave).all()]
            if rests:
                onsets |= {x for x in (slowest(_first_least(env, p, q)) for p, q in rests) if moving(x, b)}
            else:
                v = np.nan_to_num(speed[a:b], nan=0.0)
                onsets |= {a + x for x in valley_cuts(v, find_peaks(v, go, max(1, c.samples(0.25)), 0.5 * go))}
    if c.enable_r7 and begun:  # holds of usual length around a whole burst with rest on both sides
        for a, b in zip(runs[:, 1], np.append(runs[1:, 0], n), strict=True):
            if (b - a) / c.fs <= c.pose_long_seg_s:
                for p, q in bursts[(a <= middles) & (middles < b)]:
                    if (env[max(0, p - rest_gap) : p] < leave).any() and (env[q : q + rest_gap] < leave).any():
                        onsets.add(slowest(_first_least(env, p, q)))
    feet = set()
    for x in onsets:
        left = max(0, x - near)
        low = np.flatnonzero(speed[left : x + 1] <= still)
        feet.add(left + int(low[-1]) if len(low) else left)
    if not feet:
        return {}

    s = np.array(sorted(feet), np.int64)
    e = np.append(s[1:], n)
    k = np.searchsorted(runs[:, 1], s, side="right")  # the first run that ends after the start
    held = k < len(runs)
    held[held] &= runs[k[held], 0] < e[held]
    m = np.maximum(s + 1, np.minimum(s + c.samples(c.min_motion_s), e - 1))
    m[held] = np.minimum(np.maximum(s + 1, runs[np.minimum(k, len(runs) - 1), 1])[held], (e - 1)[held])
    rest = np.nanmedian(pose, 0)
    watch = np.where(e - m >= 2, m, s)
    far = lambda a, b: _moving_mean(np.sqrt(((pose[a:b] - rest) ** 2).sum(1)), c.samples(0.05))
    apex = [a + int(np.argmax(np.nan_to_num(np.round(far(a, b), 9), nan=-np.inf))) for a, b in zip(watch, e, strict=True)]
    first = np.searchsorted(bursts[:, 1], s, side="right")
    active = (first < len(bursts)) & (m > s)
    active[active] &= bursts[first[active], 0] < m[active]
    moved, stays = (m - s) / c.fs, (e - m) / c.fs
    flag = np.select([moved > c.pose_long_seg_s, stays < c.min_static_s, ~active, stays > c.max_hold_s], ["long", "nohold", "slow", "long_static"], "")
    columns = (s, e, s, m, m, e, np.array(apex, np.int64), np.where(active, "both", "pose_only"), flag)
    return dict(zip(names, columns, strict=True))


def detect_actions(df: DataFrame, emg: list[str], pose: list[str], settings: Settings | None = None, key: str = "rec", order: str = "i") -> DataFrame:
    """Move-then-hold actions of every recording: ``ACTION_FIELDS``, tiling its samples from the first onset to the end.

    One shuffle; a recording is one Arrow group (two minutes at 2 kHz with 36 channels: about 70 MB). Recordings too large
    for a task go through ``detect_long.detect_actions``, which gives the same rows. A recording that never moves far
    enough, begins no motion or has only missing values gives no rows; infinite values count as missing.
    """
    values = asdict(settings or Settings())

    kinds = {n: pa.string() if t == "string" else pa.int64() for n, t in (x.split() for x in ACTION_FIELDS.split(", "))}

    def run(keys: tuple, group: pa.Table) -> pa.Table:
        at = np.argsort(group["__i"].to_numpy(), kind="stable")
        signals = [np.array([group[f"__{p}{k}"].to_numpy()[at] for k in range(len(names))], float).T for p, names in (("e", emg), ("p", pose))]
        found = recording_actions(*signals, Settings(**values))
        columns = [pa.array(found.get(n, ()), t) for n, t in kinds.items()]
        return pa.Table.from_arrays([pa.array([keys[0].as_py()] * len(columns[0]), group[key].type), *columns], [key, *kinds])

    own = [finite(F.col(n)).alias(f"__{p}{k}") for p, names in (("e", emg), ("p", pose)) for k, n in enumerate(names)]
    x = signal.by_recording(df.select(key, F.col(order).alias("__i"), *own), key)
    return x.groupBy(key).applyInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {ACTION_FIELDS}")
