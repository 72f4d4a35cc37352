"""Reports over recordings, segments and landmark positions: counts of an index, diagnostics, errors, older statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.scalars import finite
from tremorlake.operators import intervals


def index_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n_rows, n_recordings`` of every table of an index."""
    counted = [df.agg(F.lit(n).alias("table_name"), F.count("*").alias("n_rows"), F.countDistinct("source_file").alias("n_recordings")) for n, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def status_counts(catalog: DataFrame, done: DataFrame, dropped: DataFrame, key: str = "rec_key") -> DataFrame:
    """One row: recordings in the catalogue, those complete, dropped, and still to do."""
    marks = {"__done": done, "__gone": dropped}
    for name, df in marks.items():
        catalog = catalog.join(df.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    return catalog.agg(
        F.count("*").alias("n_recordings"), F.count_if(is_("__done")).alias("n_done"), F.count_if(is_("__gone")).alias("n_dropped"), F.count_if(~is_("__done") & ~is_("__gone")).alias("n_open")
    )


def diagnostics(actions: DataFrame, fs: float, min_static_s: float, key: str = "rec") -> DataFrame:
    """One row over actions ``s, e, motion_e, apex, review_flag``: their number, the holds' median seconds and share of long enough ones, the share whose apex lies in
    the hold, whether every action begins where the one before ends, and the counts of flags, sorted by name.
    """
    hold = (F.col("e") - F.col("motion_e")) / fs
    after = F.lead("s").over(Window.partitionBy(key).orderBy("s"))
    x = actions.withColumn("__hold", hold).withColumn("__next", after)
    inside = ((F.col("motion_e") <= F.col("apex")) & (F.col("apex") < F.col("e"))).cast("double")
    one = x.agg(
        F.count("*").alias("n_actions"), F.countDistinct(key).alias("n_recordings"), F.percentile("__hold", F.lit(0.5)).alias("hold_median_s"),
        F.avg((F.col("__hold") >= min_static_s).cast("double")).alias("held_share"), F.avg(inside).alias("apex_in_hold_share"),
        F.coalesce(F.bool_and(F.coalesce(F.col("__next") == F.col("e"), F.lit(True))), F.lit(True)).alias("seamless"),
    )
    flags = x.groupBy("review_flag").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("review_flag", "n"))).alias("f"))
    named = F.transform("f", lambda r: F.concat_ws("=", r["review_flag"], r["n"].cast("string")))
    return one.join(flags.select(F.array_join(named, ",").alias("flags")))


def segment_statistics(runs: DataFrame, samples: DataFrame, emg: list[str], pose: list[str], speed: str, key: str = "rec", order: str = "i") -> DataFrame:
    """Per interval the mean and largest speed, the RMS of the muscle channels and the mean of each pose channel, over known values.

    Means add up in the samples' order, so that the way in which rows arrive moves no last digit. A running sum holds one value, however long the interval.
    """
    inside = intervals.samples_in(runs.select(key, "s", "e"), samples, {c: F.col(c) for c in dict.fromkeys([*emg, *pose, speed])}, key=key, order=order)
    square = sum((F.col(c) * F.col(c) for c in emg), F.lit(0.0)) / len(emg)
    in_order = Window.partitionBy(key, "s", "e").orderBy("__i")
    mean = lambda c: F.avg(c).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    largest = F.max(speed).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    so_far = inside.select(
        key, "s", "e", mean(F.col(speed)).alias("mean_speed"), largest.alias("max_speed"), F.sqrt(mean(square)).alias("emg_rms"), F.array(*[mean(F.col(c)) for c in pose]).alias("mean_pose"),
        F.lead(F.lit(True), 1, False).over(in_order).alias("__more"),
    )
    return so_far.where("not __more").drop("__more")


def _summary(value: Column, names: str) -> list[Column]:
    x = finite(value)
    return [F.avg(x).alias(f"mean_{names}"), F.percentile(x, F.lit(0.5)).alias(f"median_{names}"), F.stddev_pop(x).alias(f"std_{names}"), F.max(x).alias(f"max_{names}")]


def position_errors(joints: DataFrame, tips: list[int], finger: Column) -> DataFrame:
    """One row over joints ``joint, x0, y0, z0`` (true) and ``x1, y1, z1``: distances' mean, median, deviation and maximum, their mean over the fingers' tips, and over
    each finger, by name.
    """
    d = F.sqrt(sum(((F.col(f"{a}1") - F.col(f"{a}0")) ** 2 for a in "xyz"), F.lit(0.0)))
    x = joints.withColumn("__d", finite(d)).withColumn("__finger", finger)
    per = x.where("__finger is not null").groupBy("__finger").agg(F.avg("__d").alias("mean")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__finger", "mean")))).alias("finger_means"))
    return x.agg(*_summary(F.col("__d"), "error"), F.avg(F.when(F.col("joint").isin(*tips), F.col("__d"))).alias("tip_mean")).join(per)


def angle_errors(angles: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row over pairs of angles in radians: mean, median, deviation and maximum of the absolute difference in degrees."""
    return angles.agg(*_summary(F.degrees(F.abs(F.col(a) - F.col(b))), "degrees"))


def mirrored(landmarks: DataFrame, hand: str = "hand") -> DataFrame:
    """Landmarks ``x, y, z`` of left hands as they are, of right hands with x negated."""
    return landmarks.withColumn("x", F.when(F.lower(hand) == "right", -F.col("x")).otherwise(F.col("x")))
