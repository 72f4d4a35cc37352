"""The move-then-hold detector for recordings of any length: a composition of the operators on signals and intervals.

Samples and intervals meet in cells, so no task needs a whole recording as arrays, but for the fold of the motion machine
and the peak rules of one long run. It shuffles the signals many times; for recordings that fit a task use ``detect``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake import storage
from tremorlake.functions.scalars import finite
from tremorlake.operators import intervals, signal
from tremorlake.operators.detect import Settings, find_peaks, motion_machine, valley_cuts


def _signals(df: DataFrame, emg: list[str], pose: list[str], c: Settings, key: str, order: str) -> tuple[DataFrame, list[str]]:
    """``key, i``, the filled pose, ``env`` and ``spd`` of every sample, and the pose columns' names; samples count from 0."""
    own = {f"e{k}": finite(F.col(n)) for k, n in enumerate(emg)} | {f"q{k}": finite(F.col(n)) for k, n in enumerate(pose)}
    number = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    x = df.select(key, number.cast("long").alias("i"), *[v.alias(n) for n, v in own.items()])
    filled = [f"p{k}" for k in range(len(pose))]
    x = signal.gaps_filled(x, {f"p{k}": f"q{k}" for k in range(len(pose))}, c.samples(c.nan_max_gap_s), key=key, order="i")
    x = signal.speed(x, filled, c.fs, max(1, c.samples(c.pose_smooth_ms / 1000)), key=key, order="i")
    x = signal.envelope(x, [f"e{k}" for k in range(len(emg))], max(1, c.samples(c.smooth_ms / 1000)), key=key, order="i")
    return x.select(key, "i", *filled, "env", "spd"), filled


def _least_at(spans: DataFrame, x: DataFrame, value: str, a: str, b: str, key: str) -> DataFrame:
    """``anchor``: the first sample of least ``value`` in ``[a, b)`` of each span."""
    inside = intervals.samples_in(spans, x, {"__v": F.col(value)}, F.col(a), F.col(b), key, "i")
    return inside.groupBy(*spans.columns).agg(F.min_by("__i", F.struct(F.col("__v").isNull(), F.col("__v"), F.col("__i"))).alias("anchor"))


def _cuts_of_long_runs(runs: DataFrame, bursts: DataFrame, x: DataFrame, limits: DataFrame, moving, c: Settings, key: str) -> DataFrame:
    """``anchor`` samples that cut runs ``a, b`` which never settle: at clean rests between their bursts, else at valleys of speed."""
    inner = intervals.centre_in(bursts, runs, key).select(key, "a", "b", "s", "e", "exit")
    rests = intervals.clean_rest_gaps(inner, x, F.col("exit"), c.samples(c.min_rest_gap_s), "env", key, "i", ["a", "b"])
    lows = _least_at(rests, x, "env", "gs", "ge", key)
    slow = intervals.snap_to_minimum(lows.select(key, "anchor").distinct(), x, c.samples(c.snap_window_s), "spd", key, "i")
    cuts = lows.join(slow, [key, "anchor"]).select(key, F.col("snapped").alias("s"), F.col("b").alias("e"))
    at_rests = moving(cuts).select(key, F.col("s").alias("anchor"))
    bare = runs.join(rests.select(key, "a", "b").distinct(), [key, "a", "b"], "left_anti").join(limits, key)
    speeds = intervals.samples_in(bare.select(key, "a", "b", "enter"), x, {"v": F.col("spd")}, F.col("a"), F.col("b"), key, "i")
    distance = c.samples(0.25)

    def valleys(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("__i")
        v, enter = np.nan_to_num(g["v"].to_numpy(float), nan=0.0), float(g["enter"].iloc[0])
        at = np.array(valley_cuts(v, find_peaks(v, enter, max(1, distance), 0.5 * enter)), np.int64)
        return pd.DataFrame({key: g[key].iloc[0], "anchor": g["a"].iloc[0] + at})

    kind = runs.schema[key].dataType.simpleString()
    return at_rests.unionByName(speeds.groupBy(key, "a", "b").applyInPandas(valleys, f"{key} {kind}, anchor long"))


def _cuts_of_holds(runs: DataFrame, bursts: DataFrame, x: DataFrame, lengths: DataFrame, c: Settings, key: str) -> DataFrame:
    """``anchor`` samples in holds of usual length that contain a whole burst with rest on both sides."""
    span = c.samples(c.min_rest_gap_s)
    holds = runs.join(lengths, key).select(key, F.col("e").alias("a"), F.coalesce(F.lead("s").over(Window.partitionBy(key).orderBy("s")), F.col("n")).alias("b"))
    inside = intervals.centre_in(bursts, holds.where((F.col("b") - F.col("a")) / c.fs <= c.pose_long_seg_s), key).where(F.col("e") - F.col("s") >= c.samples(c.min_action_s))
    inside = inside.select(key, "s", "e", "exit")
    for place, before in (("s", True), ("e", False)):
        near = intervals.rest_near(inside.select(key, F.col(place).alias("idx"), "exit").distinct(), x, F.col("exit"), span, before, "env", key, "i").where("rest")
        inside = inside.join(near.select(key, F.col("idx").alias(place)), [key, place], "left_semi")
    lows = _least_at(inside.select(key, "s", "e"), x, "env", "s", "e", key).select(key, "anchor").distinct()
    return intervals.snap_to_minimum(lows, x, c.samples(c.snap_window_s), "spd", key, "i").select(key, F.col("snapped").alias("anchor"))


def detect_actions(df: DataFrame, emg: list[str], pose: list[str], settings: Settings | None = None, key: str = "rec", order: str = "i") -> DataFrame:
    """The actions of ``detect.detect_actions``, tiling its samples from the first onset to the end.

    A composition of the operators on signals and intervals; the signals and the runs are written once and read by the
    steps after. A recording that never moves far enough, is empty or has only missing values gives no rows.
    """
    c = settings or Settings()
    x, channels = _signals(df, emg, pose, c, key, order)
    x = storage.materialize(x, "signals")
    lengths = x.groupBy(key).agg(F.count("*").alias("n"))

    def moving(spans: DataFrame) -> DataFrame:
        """Spans ``s, e`` with enough whole samples in which the pose moves far enough."""
        inside = intervals.samples_in(spans.select(key, "s", "e").distinct(), x, {p: F.col(p) for p in channels}, key=key, order="i")
        far = signal.excursion(inside, channels, [key, "s", "e"], c.min_finite_frac).where(F.col("pose_range") >= c.pose_min_range)
        return spans.join(far.select(key, "s", "e"), [key, "s", "e"], "left_semi")

    if c.enter_thresh is not None and c.exit_thresh is not None:
        levels = lengths.select(key, F.lit(float(c.enter_thresh)).alias("enter"), F.lit(float(c.exit_thresh)).alias("exit"))
    else:
        levels = signal.bimodal_thresholds(x, c.emg_enter_k, c.emg_exit_k, "env", key)
    latched = intervals.latch(x.join(levels.where(F.col("enter") > F.col("exit")), key), F.col("enter"), F.col("exit"), "env", key, "i")
    bursts = intervals.merge_then_drop(latched, c.samples(c.min_rest_gap_s), c.samples(c.min_action_s), key).join(levels.select(key, "exit"), key)
    bursts = storage.materialize(bursts, "bursts")

    if c.auto_move_thresh:
        limits = signal.move_thresholds(x, c.pose_pct, c.pose_mad, c.move_exit_frac, (c.move_enter, c.move_exit), "spd", key)
    else:
        limits = lengths.select(key, F.lit(float(c.move_enter)).alias("enter"), F.lit(float(c.move_exit)).alias("exit"))
    awake = signal.excursion(x, channels, key, c.min_finite_frac).where(F.col("pose_range") >= c.pose_min_range).select(key)
    limits = storage.materialize(limits.join(awake, key), "limits")
    runs = motion_machine(x.join(limits, key), F.col("enter"), F.col("exit"), c.settle_frac, c.samples(c.min_static_s), c.samples(c.min_motion_s), "spd", key, "i")
    runs = storage.materialize(runs, "runs")

    begun = storage.materialize(moving(runs), "onsets")
    onsets = begun.select(key, F.col("s").alias("anchor"))
    if c.enable_r2:
        long_runs = begun.where((F.col("e") - F.col("s")) / c.fs > c.pose_long_seg_s).select(key, F.col("s").alias("a"), F.col("e").alias("b"))
        onsets = onsets.unionByName(_cuts_of_long_runs(long_runs, bursts, x, limits, moving, c, key))
    if c.enable_r7:
        onsets = onsets.unionByName(_cuts_of_holds(runs, bursts, x, lengths, c, key).join(begun.select(key).distinct(), key, "left_semi"))
    feet = intervals.snap_to_foot(onsets.distinct().join(limits, key), x, F.col("exit"), c.samples(c.snap_window_s), "spd", key, "i")
    starts = storage.materialize(feet.select(key, F.col("snapped").cast("long").alias("s")).distinct(), "starts")

    actions = starts.join(lengths, key).withColumn("e", F.coalesce(F.lead("s").over(Window.partitionBy(key).orderBy("s")), F.col("n"))).drop("n")
    actions = storage.materialize(intervals.motion_end(actions, runs, c.samples(c.min_motion_s), key), "actions")
    watched = actions.withColumn("a", F.when(F.col("e") - F.col("motion_e") >= 2, F.col("motion_e")).otherwise(F.col("s")))
    apexes = intervals.apex(watched.select(key, F.col("a").alias("s"), "e"), x, channels, max(1, c.samples(0.05)), key, "i").select(key, F.col("s").alias("a"), "e", "apex_sample")
    active = intervals.overlap_counts(actions.select(key, "s", F.col("motion_e").alias("e")), bursts, "s", key)
    out = watched.join(apexes, [key, "a", "e"]).join(active, [key, "s"])
    moved, held, both = (F.col("motion_e") - F.col("s")) / c.fs, (F.col("e") - F.col("motion_e")) / c.fs, (F.col("n_overlaps") > 0) & (F.col("motion_e") > F.col("s"))
    flag = F.when(moved > c.pose_long_seg_s, "long").when(held < c.min_static_s, "nohold").when(~both, "slow").when(held > c.max_hold_s, "long_static").otherwise("")
    return out.select(
        key, "s", "e", F.col("s").alias("motion_s"), "motion_e", F.col("motion_e").alias("hold_s"), F.col("e").alias("hold_e"), F.col("apex_sample").alias("apex"),
        F.when(both, "both").otherwise("pose_only").alias("fusion_type"), flag.alias("review_flag"),
    )
