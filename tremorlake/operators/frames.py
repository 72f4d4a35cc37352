"""Frames and times: as-of reads, interpolation joins, time-valued intervals, skeletons, and the data behind the views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.operators import labels, signal

KEY = "rec"


def _seen(value: Column, key: str, *order) -> Column:
    """The last known value so far in an order; what lies ahead is what was seen in the descending one, so every window is one pass."""
    return F.last(value, True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def nearest_frame(asked: DataFrame, frames: DataFrame, key: str = KEY) -> DataFrame:
    """``frame`` of every asked ``t``: the frame whose ``ft`` is nearest, the earlier of equal ones.

    Asked times and frames are ordered together once; each time looks at the frame before and the one after.
    """
    both = asked.select(key, F.col("t").alias("x"), F.lit(None).cast("long").alias("frame")).unionByName(frames.select(key, F.col("ft").alias("x"), "frame"))
    seen, asks = F.when(F.col("frame").isNotNull(), F.struct("x", "frame")), F.col("frame").isNull()
    both = both.withColumn("b", _seen(seen, key, "x", asks)).withColumn("a", _seen(seen, key, F.desc("x"), asks))
    after = F.col("b").isNull() | (F.col("a.x") - F.col("x") < F.col("x") - F.col("b.x"))
    found = both.where("frame is null").select(key, F.col("x").alias("t"), F.when(after & F.col("a").isNotNull(), F.col("a.frame")).otherwise(F.col("b.frame")).alias("frame"))
    return found


def interpolate_onto(grid: DataFrame, known: DataFrame, columns: list[str], time: str = "t", key: str = KEY) -> DataFrame:
    """``columns`` of ``known`` read at the grid's times, linearly between samples and constant beyond the ends."""
    empty = [F.lit(None).cast("double").alias(c) for c in columns]
    both = grid.select(key, time, *empty, F.lit(True).alias("__grid")).unionByName(known.select(key, time, *columns, F.lit(False).alias("__grid")))
    sample = F.when(~F.col("__grid"), F.struct(time, *columns))
    both = both.withColumn("__b", _seen(sample, key, time, "__grid")).withColumn("__a", _seen(sample, key, F.desc(time), "__grid"))
    b, a = (lambda c: F.col(f"__b.{c}")), (lambda c: F.col(f"__a.{c}"))
    share = (F.col(time) - b(time)) / (a(time) - b(time))
    line = lambda c: F.when(F.col("__b").isNull(), a(c)).when(F.col("__a").isNull() | (a(time) == b(time)), b(c)).otherwise(b(c) + (a(c) - b(c)) * share)
    return both.where("__grid").select(key, time, *[line(c).alias(c) for c in columns])


def time_to_index(intervals: DataFrame, samples: DataFrame, key: str = KEY) -> DataFrame:
    """``s, e`` sample numbers of intervals in time ``t0 <= t <= t1``, one sample at least.

    Samples and the intervals' ends are ordered together once and the samples before each are counted; no interval meets
    the whole recording. A recording without samples has no rows.
    """
    ends = intervals.select(key, "t0", "t1").distinct()
    rows = [samples.select(key, F.col("t").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("t0"), F.lit(None).cast("double").alias("t1"))]
    for c, kind in (("t0", 0), ("t1", 2)):  # starts count what is before them, ends also what is at them
        rows.append(ends.select(key, F.col(c).alias("x"), F.lit(kind).alias("kind"), F.col("t0").cast("double").alias("t0"), F.col("t1").cast("double").alias("t1")))
    order = Window.partitionBy(key).orderBy("x", "kind")
    both = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("n", F.count_if(F.col("kind") == 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("known", F.count_if(F.col("kind") == 1).over(Window.partitionBy(key))).where("kind <> 1 and known > 0")
    counts = both.groupBy(key, "t0", "t1").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("s"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("e"))
    return counts.withColumn("e", F.greatest("e", F.col("s") + 1))


def time_intervals(samples: DataFrame, mask: Column, min_length: float, merge_gap: float, key: str = KEY) -> DataFrame:
    """``t0, t1`` of runs for which ``mask`` holds, from first to last time: short ones go, then close ones merge."""
    order = Window.partitionBy(key).orderBy("t")
    x = samples.select(key, "t", F.coalesce(mask, F.lit(False)).alias("m")).withColumn("n", F.row_number().over(order)).where("m")
    x = x.withColumn("g", F.col("n") - F.row_number().over(order))
    runs = x.groupBy(key, "g").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where(F.col("t1") - F.col("t0") >= min_length)
    w = Window.partitionBy(key).orderBy("t0")
    runs = runs.withColumn("new", (F.col("t0") - F.lag("t1").over(w) > merge_gap) | F.lag("t1").over(w).isNull())
    runs = runs.withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")


def motion_score(points: DataFrame, key: str = KEY) -> DataFrame:
    """Per recording of joint rows ``rec, frame, joint, x, y, z``: mean distance of joints from start to end, and the 95th percentile of mean displacement from frame to frame."""
    far = lambda a, b: F.sqrt(sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    place = F.struct("x", "y", "z")
    ends = points.groupBy(key, "joint").agg(F.min_by(place, "frame").alias("a"), F.max_by(place, "frame").alias("b"))
    total = ends.groupBy(key).agg(F.avg(far("a", "b")).alias("start_to_end"))
    steps = points.withColumn("b", place).withColumn("a", F.lag("b").over(Window.partitionBy(key, "joint").orderBy("frame"))).where("a is not null")
    per_frame = steps.groupBy(key, "frame").agg(F.avg(far("a", "b")).alias("d"))
    return total.join(per_frame.groupBy(key).agg(F.percentile("d", F.lit(0.95)).alias("p95_step")), key, "left")


def quaternion_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of quaternions (w, x, y, z), the last axis theirs."""
    aw, av, bw, bv = a[..., :1], a[..., 1:], b[..., :1], b[..., 1:]
    return np.concatenate([aw * bw - (av * bv).sum(-1, keepdims=True), aw * bv + bw * av + np.cross(av, bv)], -1)


def rotated(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Vectors turned by quaternions; zero quaternions turn nothing."""
    size = np.linalg.norm(q, axis=-1, keepdims=True)
    q = np.where(size > 1e-12, q / np.where(size > 1e-12, size, 1), np.array([1.0, 0, 0, 0]))
    w, u = q[..., :1], q[..., 1:]
    turn = 2 * np.cross(u, v)
    return v + w * turn + np.cross(u, turn)


def chain_positions(local: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Joint positions (frames, joints, 3) of a chain from local rotations (frames, joints, 4) and bone offsets (joints, 3)."""
    world, at, out = local[:, 0], np.zeros((len(local), 3)), []
    for j in range(local.shape[1]):
        world = local[:, 0] if j == 0 else quaternion_product(world, local[:, j])
        at = at + rotated(world, np.broadcast_to(offsets[j], at.shape))
        out.append(at)
    return np.stack(out, 1)


def forward_kinematics(frames: DataFrame, offsets: list[list[float]], key: str = KEY) -> DataFrame:
    """``rec, frame, joint, x, y, z`` of chains from rows of ``frame`` and ``q`` (an array of four numbers for each joint)."""
    bones = np.array(offsets, float)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame")
        p = chain_positions(np.array([[list(q) for q in row] for row in g["q"]], float), bones)
        n, m = p.shape[:2]
        return pd.DataFrame({key: g[key].iloc[0], "frame": np.repeat(g["frame"].to_numpy(), m), "joint": np.tile(np.arange(m), n), "x": p[..., 0].ravel(), "y": p[..., 1].ravel(), "z": p[..., 2].ravel()})

    return frames.groupBy(key).applyInPandas(run, f"{key} long, frame long, joint long, x double, y double, z double")


def natural_order(label: Column) -> list[Column]:
    """Sort keys of labels with a number at their end: the text before it, then the number."""
    return [F.regexp_extract(label, r"^(.*?)\d*$", 1), F.coalesce(F.nullif(F.regexp_extract(label, r"(\d+)$", 1), F.lit("")).cast("long"), F.lit(-1))]


# Data behind the views.


def filter_recordings(rows: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """``all``, ``todo``, ``review`` or ``done`` recordings whose file or subject contains a text; those to review come first."""
    kinds = {"all": F.lit(True), "todo": ~F.col("done"), "done": F.col("done"), "review": F.col("n_review") > 0}
    has = F.lower(F.concat_ws(" ", "source_file", "subject")).contains(text.lower())
    return rows.where(kinds[kind] & has).orderBy((F.col("n_review") == 0).cast("int"), "source_file")


def curves(samples: DataFrame, channels: list[str], pose: list[str], size: int, fs: float, most: int = 2000, key: str = KEY, order: str = "i") -> DataFrame:
    """Envelope and speed of every recording, thinned to about ``most`` points each."""
    x = signal.speed(signal.envelope(samples, channels, size, key=key, order=order), pose, fs, size, key=key, order=order)
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(key)) / most))
    return x.withColumn("__step", step).where(F.col(order) % F.col("__step") == 0).select(key, order, "env", "spd")


def numbered_clips(clips: DataFrame, annotations: DataFrame) -> DataFrame:
    """Clips of each recording in time order, named s1, s2, ..., with their labels and marks."""
    own = lambda kind, name: labels.get_annotations(annotations, "clip", kind).select("source_file", "clip_id", F.col("value").alias(name))
    out = clips.join(own("label", "label"), ["source_file", "clip_id"], "left").join(own("invalid", "__invalid"), ["source_file", "clip_id"], "left")
    number = F.row_number().over(Window.partitionBy("source_file").orderBy("start_sample", "clip_id"))
    return out.withColumn("name", F.concat(F.lit("s"), number.cast("string"))).withColumn("invalid", F.col("__invalid").isNotNull()).drop("__invalid")
