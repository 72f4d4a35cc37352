"""Operators on half-open sample intervals ``[s, e)``: islands, complements and interval joins, all within a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions.scalars import hull_iou, overlap

KEY, ORDER = "rec", "i"
#: Samples to a cell. Intervals and samples of a recording meet in cells, so a long recording is neither one hot key nor a product of all with all.
CELL = 4096


def _by(*keys: str, order=("s", "e")) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _runs(df: DataFrame, begins: Column, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``run``: how many rows so far begin one."""
    return df.withColumn("run", F.sum(begins.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def latch(df: DataFrame, enter: Column, leave: Column, value: str = "v", key: str = KEY, order: str = ORDER) -> DataFrame:
    """Intervals of a two-threshold latch: on from ``value >= enter``, off before ``value < leave``; one still on ends with the signal.

    Missing values change nothing. ``enter`` and ``leave`` may be columns of ``df``.
    """
    w = Window.partitionBy(key).orderBy(order)
    state = F.when(F.col(value) >= enter, 1).when(F.col(value) < leave, 0)
    df = df.withColumn("__on", F.coalesce(F.last(state, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return islands(df, F.col("__on") == 1, key, order)


def islands(df: DataFrame, mask: Column, key: str = KEY, order: str = ORDER) -> DataFrame:
    """``s, e`` of the longest runs of consecutive samples for which ``mask`` holds (null counts as false)."""
    w = Window.partitionBy(key).orderBy(order)
    df = df.select(key, F.col(order).cast("long").alias("__i"), F.coalesce(mask, F.lit(False)).alias("__m"))
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("__i"))).where("__m")
    df = df.withColumn("__g", F.col("__n") - F.row_number().over(Window.partitionBy(key).orderBy("__i")))
    return df.groupBy(key, "__g").agg(F.min("__i").alias("s"), (F.max("__i") + 1).alias("e")).drop("__g")


def merged(runs: DataFrame, max_gap: int, inclusive: bool, key: str = KEY) -> DataFrame:
    """Neighbours joined when the gap between them is under ``max_gap``, or at it if ``inclusive``."""
    gap = F.col("s") - F.max("e").over(_by(key).rowsBetween(Window.unboundedPreceding, -1))
    apart = gap.isNull() | ((gap > max_gap) if inclusive else (gap >= max_gap))
    runs = _runs(runs.withColumn("__apart", apart), F.col("__apart"), [key], ["s", "e"])
    return runs.groupBy(key, "run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def merge_then_drop(runs: DataFrame, min_gap: int, min_length: int, key: str = KEY) -> DataFrame:
    """Gaps under ``min_gap`` close first; what is then shorter than ``min_length`` goes."""
    return merged(runs, min_gap, False, key).where(F.col("e") - F.col("s") >= min_length)


def drop_then_merge(runs: DataFrame, min_length: int, merge_gap: int, key: str = KEY) -> DataFrame:
    """Runs shorter than ``min_length`` go first; gaps up to ``merge_gap`` then close."""
    return merged(runs.where(F.col("e") - F.col("s") >= min_length), merge_gap, True, key)


def complement(runs: DataFrame, lengths: DataFrame, key: str = KEY) -> DataFrame:
    """What runs leave of ``[0, n)``; ``lengths`` has ``n`` for every recording, those without runs are left whole."""
    reach = F.coalesce(F.max("e").over(_by(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gaps = runs.select(key, reach.alias("a"), F.col("s").alias("b"))
    tails = lengths.join(runs.groupBy(key).agg(F.max("e").alias("last")), key, "left").select(key, F.coalesce("last", F.lit(0)).alias("a"), F.col("n").alias("b"))
    return gaps.unionByName(tails).where("b > a").select(key, F.col("a").cast("long").alias("s"), F.col("b").cast("long").alias("e"))


def static_motion(df: DataFrame, threshold: Column, min_static: int, min_motion: int, merge_gap: int, value: str = "spd", key: str = KEY, order: str = ORDER) -> DataFrame:
    """``s, e, kind``: ``static`` where the speed stays at or under the threshold, ``motion`` in what is left and long enough."""
    static = drop_then_merge(islands(df, F.col(value) <= threshold, key, order), min_static, merge_gap, key)
    lengths = df.groupBy(key).agg(F.count("*").alias("n"))
    motion = complement(static, lengths, key).where(F.col("e") - F.col("s") >= min_motion)
    return static.withColumn("kind", F.lit("static")).unionByName(motion.withColumn("kind", F.lit("motion")))


def hold_windows(runs: DataFrame, lengths: DataFrame, tail: int, key: str = KEY) -> DataFrame:
    """``hold_end`` of every run: the next one's start, for the last ``tail`` samples more, within the signal."""
    runs = runs.join(lengths.select(key, "n"), key)
    return runs.withColumn("hold_end", F.coalesce(F.lead("s").over(_by(key)), F.least("n", F.col("e") + tail))).drop("n")


def numbered(runs: DataFrame, name: str, key: str = KEY) -> DataFrame:
    return runs.withColumn(name, (F.row_number().over(_by(key)) - 1).cast("long"))


def _cells(s: Column, e: Column, width: int) -> Column:
    """Numbers of the cells that ``[s, e)`` touches, a row each."""
    return F.explode(F.sequence(F.floor(s / width), F.floor(F.greatest(e - 1, s) / width)))


def interval_pairs(left: DataFrame, right: DataFrame, key: str = KEY, width: int = CELL) -> DataFrame:
    """Overlapping pairs of ``l_s, l_e`` and ``r_s, r_e`` of equal ``key``.

    Intervals are cut into cells of ``width`` samples and meet in cells, so a recording of very many intervals isn't
    compared all with all; a pair counts in the cell where the later of the two begins.
    """
    meets = (F.col("l_s") < F.col("r_e")) & (F.col("r_s") < F.col("l_e"))
    own = lambda p: _cells(F.col(f"{p}_s"), F.col(f"{p}_e"), width)
    pairs = left.withColumn("__cell", own("l")).join(right.withColumn("__cell", own("r")), [key, "__cell"]).where(meets)
    return pairs.where(F.col("__cell") == F.floor(F.greatest("l_s", "r_s") / width)).drop("__cell")


def samples_in(spans: DataFrame, samples: DataFrame, columns: dict[str, Column], s: Column | None = None, e: Column | None = None, key: str = KEY, order: str = ORDER, width: int = CELL) -> DataFrame:
    """Rows of ``spans`` with every sample ``s <= __i < e`` (default: their columns ``s, e``) and its ``columns``.

    A sample lies in one cell and a span in those that it touches, so each pair is made once and no span meets the whole
    recording.
    """
    s, e = F.col("s") if s is None else s, F.col("e") if e is None else e
    spans = spans.withColumn("__from", s).withColumn("__to", e).where("__to > __from")
    spans = spans.withColumn("__cell", _cells(F.col("__from"), F.col("__to"), width))
    x = samples.select(key, F.col(order).alias("__i"), F.floor(F.col(order) / width).alias("__cell"), *[c.alias(n) for n, c in columns.items()])
    return spans.join(x, [key, "__cell"]).where("__from <= __i and __i < __to").drop("__cell", "__from", "__to")


def max_overlap_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, key: str = KEY, width: int = CELL) -> DataFrame:
    """For every left interval the right one with most overlap, the lowest id of equal ones, -1 where none overlaps."""
    a = left.select(key, left_id, F.col("s").alias("l_s"), F.col("e").alias("l_e"))
    b = right.select(key, right_id, F.col("s").alias("r_s"), F.col("e").alias("r_e"))
    common = overlap(F.col("l_s"), F.col("l_e"), F.col("r_s"), F.col("r_e"))
    best = interval_pairs(a, b, key, width).withColumn("common", common).where("common > 0").groupBy(key, left_id)
    best = best.agg(F.min_by(right_id, F.struct(-F.col("common"), F.col(right_id))).alias("matched"))
    return left.join(best, [key, left_id], "left").withColumn("matched", F.coalesce("matched", F.lit(-1)).cast("long"))


def iou_remap(old: DataFrame, new: DataFrame, min_overlap: float = 0.5, key: str = KEY, width: int = CELL) -> DataFrame:
    """``new_id, iou, status`` for every ``old_id``: the new interval with the largest overlap over hull, lowest id of equal ones.

    All rows are decided at once from the old state, so chains of renames lose nothing. ``collision`` marks new intervals
    that several old ones claim, all but the best; ``lost`` those without a new interval; ``unchanged`` equal ids.
    """
    a = old.select(key, "old_id", F.col("s").alias("l_s"), F.col("e").alias("l_e"))
    b = new.select(key, "new_id", F.col("s").alias("r_s"), F.col("e").alias("r_e"))
    pairs = interval_pairs(a, b, key, width).withColumn("iou", F.round(hull_iou(F.col("l_s"), F.col("l_e"), F.col("r_s"), F.col("r_e")), 9))
    best = pairs.groupBy(key, "old_id").agg(F.min_by(F.struct("new_id", "iou"), F.struct(-F.col("iou"), F.col("new_id"))).alias("b"))
    out = old.join(best, [key, "old_id"], "left").select(key, "old_id", F.col("b.new_id").alias("new_id"), F.coalesce("b.iou", F.lit(0.0)).alias("iou"))
    out = out.withColumn("new_id", F.when(F.col("iou") >= min_overlap, F.col("new_id")))
    rank = F.row_number().over(Window.partitionBy(key, "new_id").orderBy(F.desc("iou"), "old_id"))
    status = F.when(F.col("new_id").isNull(), "lost").when(rank > 1, "collision").when(F.col("new_id") == F.col("old_id"), "unchanged").otherwise("moved")
    return out.withColumn("status", status)


def centre_in(points: DataFrame, within: DataFrame, key: str = KEY, width: int = CELL) -> DataFrame:
    """Pairs of ``points`` (``s, e``) whose middle sample lies in an interval ``a <= middle < b`` of ``within``; they meet in the middle's cell."""
    middle = F.floor((F.col("s") + F.col("e")) / 2).cast("long")
    points = points.withColumn("middle", middle).withColumn("__cell", F.floor(F.col("middle") / width))
    return points.join(within.withColumn("__cell", _cells(F.col("a"), F.col("b"), width)), [key, "__cell"]).where("a <= middle and middle < b").drop("__cell")


def overlap_counts(left: DataFrame, right: DataFrame, left_id: str, key: str = KEY, width: int = CELL) -> DataFrame:
    """``n_overlaps`` of every left interval: how many right ones overlap it, 0 included."""
    a = left.select(key, left_id, F.col("s").alias("l_s"), F.col("e").alias("l_e"))
    b = right.select(key, F.col("s").alias("r_s"), F.col("e").alias("r_e"))
    counts = interval_pairs(a, b, key, width).groupBy(key, left_id).agg(F.count("*").alias("__count"))
    return a.select(key, left_id).join(counts, [key, left_id], "left").select(key, left_id, F.coalesce("__count", F.lit(0)).alias("n_overlaps"))


def any_overlap(left: DataFrame, right: DataFrame, left_id: str, key: str = KEY) -> DataFrame:
    """``left`` with ``fusion_type``: ``both`` when some right interval overlaps, else ``pose_only``."""
    hit = overlap_counts(left, right, left_id, key).select(key, left_id, F.when(F.col("n_overlaps") > 0, "both").otherwise("pose_only").alias("fusion_type"))
    return left.join(hit, [key, left_id])


def adjacent_triples(parts: DataFrame, key: str = KEY) -> DataFrame:
    """Static, motion, static in immediate succession: ``s`` of the first to ``e`` of the last, with the motion's bounds."""
    w = _by(key)
    near = {"k0": F.lag("kind").over(w), "k2": F.lead("kind").over(w), "s0": F.lag("s").over(w), "e2": F.lead("e").over(w)}
    hit = parts.withColumns(near).where("k0 = 'static' and kind = 'motion' and k2 = 'static'")
    return hit.select(key, F.col("s0").alias("s"), F.col("s").alias("motion_s"), F.col("e").alias("motion_e"), F.col("e2").alias("e"))


def clean_rest_gaps(bursts: DataFrame, samples: DataFrame, leave: Column, span: int, value: str = "v", key: str = KEY, order: str = ORDER, within: list[str] | None = None) -> DataFrame:
    """Gaps of ``span`` or more between consecutive bursts (of equal ``within``) in which every value is under ``leave``, a column of ``bursts`` or a literal."""
    within = [key, *(within or [])]
    gaps = bursts.withColumn("gs", F.col("e")).withColumn("ge", F.lead("s").over(_by(*within))).withColumn("__leave", leave).where(F.col("ge") - F.col("gs") >= span)
    joined = samples_in(gaps.select(*within, "gs", "ge", "__leave"), samples, {"__v": F.col(value)}, F.col("gs"), F.col("ge"), key, order)
    clean = F.bool_and(F.coalesce(F.col("__v") < F.col("__leave"), F.lit(False)))
    return joined.groupBy(*within, "gs", "ge").agg(clean.alias("clean")).where("clean").drop("clean")


def snap_to_minimum(anchors: DataFrame, samples: DataFrame, window: int, value: str = "spd", key: str = KEY, order: str = ORDER) -> DataFrame:
    """``snapped``: the first sample of least value within ``window`` of ``anchor``; missing values are never least."""
    near = samples_in(anchors.select(key, "anchor"), samples, {"__v": F.col(value)}, F.col("anchor") - window, F.col("anchor") + window + 1, key, order)
    return near.groupBy(key, "anchor").agg(F.min_by("__i", F.struct(F.col("__v").isNull(), F.col("__v"), F.col("__i"))).alias("snapped"))


def snap_to_foot(anchors: DataFrame, samples: DataFrame, leave: Column, window: int, value: str = "spd", key: str = KEY, order: str = ORDER) -> DataFrame:
    """``snapped``: the last sample at or under ``leave`` (a literal or a column of ``anchors``) within ``window`` before ``anchor``; the window's left end if there is none."""
    anchors = anchors.withColumn("__leave", leave).select(key, "anchor", "__leave")
    near = samples_in(anchors, samples, {"__v": F.col(value)}, F.col("anchor") - window, F.col("anchor") + 1, key, order)
    left = F.greatest(F.lit(0), F.col("anchor") - window)
    return near.groupBy(key, "anchor").agg(F.coalesce(F.max(F.when(F.col("__v") <= F.col("__leave"), F.col("__i"))), left).alias("snapped"))


def rest_near(at: DataFrame, samples: DataFrame, leave: Column, span: int, before: bool, value: str = "v", key: str = KEY, order: str = ORDER) -> DataFrame:
    """``at`` with ``rest``: whether some value within ``span`` samples before (or from) ``idx`` is under ``leave``, a literal or a column of ``at``."""
    first, end = (F.col("idx") - span, F.col("idx")) if before else (F.col("idx"), F.col("idx") + span)
    near = samples_in(at.withColumn("__leave", leave).select(key, "idx", "__leave"), samples, {"__v": F.col(value)}, first, end, key, order)
    found = near.groupBy(key, "idx").agg(F.bool_or(F.col("__v") < F.col("__leave")).alias("rest"))
    return at.join(found, [key, "idx"], "left").withColumn("rest", F.coalesce("rest", F.lit(False)))


def motion_end(actions: DataFrame, runs: DataFrame, min_motion: int, key: str = KEY, width: int = CELL) -> DataFrame:
    """``motion_e`` of actions ``s, e``: the least end of the runs that overlap the action, kept inside it; where none does, ``min_motion`` samples on."""
    a = actions.select(key, F.col("s").alias("l_s"), F.col("e").alias("l_e"))
    r = runs.select(key, F.col("s").alias("r_s"), F.col("e").alias("r_e"))
    ends = interval_pairs(a, r, key, width).groupBy(key, F.col("l_s").alias("s"), F.col("l_e").alias("e")).agg(F.min("r_e").alias("__end"))
    first, last = F.col("s") + 1, F.col("e") - 1
    # A found end may lie on an action of one sample's start; a nominal one lies after the start always.
    found, nominal = F.least(F.greatest(first, F.col("__end")), last), F.greatest(first, F.least(F.col("s") + min_motion, last))
    return actions.join(ends, [key, "s", "e"], "left").withColumn("motion_e", F.when(F.col("__end").isNotNull(), found).otherwise(nominal)).drop("__end")


def interval_quality(runs: DataFrame, samples: DataFrame, channels: list[str], envelope: str, speed: str, fs: float, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Per interval: duration, RMS of all channels, envelope peak, mean and largest speed, norm of the channels' ranges.

    A missing value in a channel makes that range and so the norm missing; an interval without samples gives zeros.
    """
    inside = samples_in(runs.select(key, "s", "e"), samples, {c: F.col(c) for c in dict.fromkeys([*channels, envelope, speed])}, key=key, order=order)
    square = sum((F.col(c) * F.col(c) for c in channels), F.lit(0.0)) / len(channels)
    ranges = [F.when(F.count(c) == F.count(F.lit(1)), F.max(c) - F.min(c)) for c in channels]
    norm = F.sqrt(sum((r * r for r in ranges), F.lit(0.0)))
    agg = inside.groupBy(key, "s", "e").agg(
        F.count("*").alias("__n"), F.sqrt(F.avg(square)).alias("emg_rms"), F.max(envelope).alias("envelope_peak"), F.avg(speed).alias("mean_pose_speed"),
        F.max(speed).alias("max_pose_speed"), norm.alias("pose_range"),
    )
    out = runs.join(agg, [key, "s", "e"], "left").withColumn("duration_s", (F.col("e") - F.col("s")) / fs)
    names = ["emg_rms", "envelope_peak", "mean_pose_speed", "max_pose_speed", "pose_range"]
    return out.withColumns({c: F.when(F.col("__n").isNull(), 0.0).otherwise(F.col(c)) for c in names}).drop("__n")


def apex(runs: DataFrame, samples: DataFrame, channels: list[str], size: int, key: str = KEY, order: str = ORDER) -> DataFrame:
    """``apex_sample``: the first sample of an interval where its smoothed distance from the channels' medians is largest.

    Smoothing begins anew in every interval. Missing distances are never largest.
    """
    medians = samples.groupBy(key).agg(*[F.percentile(c, F.lit(0.5)).alias(f"__m_{c}") for c in channels])
    inside = samples_in(runs.select(key, "s", "e"), samples, {c: F.col(c) for c in channels}, key=key, order=order).join(medians, key)
    far = F.sqrt(sum(((F.col(c) - F.col(f"__m_{c}")) ** 2 for c in channels), F.lit(0.0)))
    inside = inside.select(key, "s", "e", "__i", far.alias("__d"))
    w = Window.partitionBy(key, "s", "e").orderBy("__i")
    whole, before, after = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), size // 2, size - size // 2 - 1
    at, n = F.col("__i") - F.col("s"), F.count(F.lit(1)).over(Window.partitionBy(key, "s", "e"))
    frame = w.rowsBetween(-before, after)
    ends = [F.greatest(F.lit(0), before - at) * F.first("__d").over(whole), F.greatest(F.lit(0), at + after - n + 1) * F.last("__d").over(whole)]
    total = F.sum("__d").over(frame) + sum((F.coalesce(x, F.lit(0.0)) for x in ends), F.lit(0.0))
    smooth = F.when(F.count(F.when(F.col("__d").isNull(), 1)).over(frame) == 0, F.round(total / size, 9))
    best = inside.withColumn("__x", smooth).groupBy(key, "s", "e").agg(F.min_by("__i", F.struct(F.col("__x").isNull(), -F.col("__x"), F.col("__i"))).alias("apex_sample"))
    return runs.join(best, [key, "s", "e"], "left")


def apex_feature(apexes: DataFrame, samples: DataFrame, channels: list[str], reach: int, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Medians of the channels within ``reach`` samples of ``apex_sample``, over known values."""
    at = F.col("apex_sample")
    near = samples_in(apexes.select(key, "s", "e", "apex_sample"), samples, {c: F.col(c) for c in channels}, at - reach, at + reach + 1, key, order)
    return near.groupBy(key, "s", "e", "apex_sample").agg(*[F.percentile(c, F.lit(0.5)).alias(f"{c}_apex") for c in channels])
