"""Queries on signals and intervals: one recording a user of ``events``, with channels ``v`` (value) and ``k``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions import scalars
from tremorlake.operators import detect, detect_long, frames, intervals, signal
from tremorlake.plans.registry import query

#: Parameters in samples: recordings have at most about a hundred.
BOX, ENTER, LEAVE, MIN_GAP, MIN_LENGTH = 5, 80.0, 20.0, 3, 2
STILL, MIN_STATIC, MIN_MOTION, MERGE_GAP, TAIL = 50.0, 2, 2, 1, 4

SIG = """sig AS (
  SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


def _box(source: str, value: str, size: int, out: str) -> str:
    before, after = size // 2, size - size // 2 - 1
    whole = "OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"""SELECT *, (sum({value}) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)
      + greatest(0, {before} - i) * first_value({value}) {whole} + greatest(0, i + {after} - n + 1) * last_value({value}) {whole}) / {size} AS {out}
    FROM (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM {source})"""


def _islands(source: str, mask: str) -> str:
    return f"""SELECT rec, min(i) AS s, max(i) + 1 AS e FROM (
      SELECT rec, i, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS g FROM {source} WHERE {mask}) GROUP BY rec, g"""


def _merged(source: str, apart: str) -> str:
    return f"""SELECT rec, min(s) AS s, max(e) AS e FROM (
      SELECT *, sum(CASE WHEN gap IS NULL OR {apart} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT *, s - max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM {source})) GROUP BY rec, run"""


LATCHED = f"""latched AS (
  SELECT rec, i, coalesce(last_value(CASE WHEN v >= {ENTER} THEN 1 WHEN v < {LEAVE} THEN 0 END IGNORE NULLS) OVER (
    PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS up FROM sig),
raw AS ({_islands("latched", "up = 1")})"""
BURST = f"{LATCHED}, merged AS ({_merged('raw', f'gap >= {MIN_GAP}')}), burst AS (SELECT * FROM merged WHERE e - s >= {MIN_LENGTH})"
STATIC = f"""still AS ({_islands("sig", f"k <= {STILL}")}),
static AS ({_merged(f"(SELECT * FROM still WHERE e - s >= {MIN_STATIC})", f"gap > {MERGE_GAP}")}),
len AS (SELECT rec, count(*) AS n FROM sig GROUP BY rec),
free AS (
  SELECT rec, coalesce(max(e) OVER (PARTITION BY rec ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, s AS b FROM static
  UNION ALL SELECT len.rec, coalesce(max(e), 0), any_value(n) FROM len LEFT JOIN static USING (rec) GROUP BY len.rec),
rest AS (SELECT rec, a AS s, b AS e FROM free WHERE b > a),
motion AS (SELECT * FROM rest WHERE e - s >= {MIN_MOTION}),
parts AS (SELECT *, 'static' AS kind FROM static UNION ALL SELECT *, 'motion' FROM motion)"""
CLIP = "clip AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY s, e) - 1 AS clip_id, s, e FROM motion)"
NUMBERED = "nb AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY s, e) - 1 AS burst_idx, s, e FROM burst)"


def sig(t) -> DataFrame:
    return signal.signal_view(t("events"))


def raw(t) -> DataFrame:
    return intervals.latch(sig(t), F.lit(ENTER), F.lit(LEAVE))


def bursts(t) -> DataFrame:
    return intervals.merge_then_drop(raw(t), MIN_GAP, MIN_LENGTH)


def lengths(t) -> DataFrame:
    return t("events").groupBy(F.col("user_id").alias("rec")).agg(F.count("*").alias("n"))


def static(t) -> DataFrame:
    return intervals.drop_then_merge(intervals.islands(sig(t), F.col("k") <= STILL), MIN_STATIC, MERGE_GAP)


def parts(t) -> DataFrame:
    return intervals.static_motion(sig(t), F.lit(STILL), MIN_STATIC, MIN_MOTION, MERGE_GAP, "k")


def clips(t) -> DataFrame:
    return intervals.numbered(parts(t).where("kind = 'motion'").drop("kind"), "clip_id")


def numbered_bursts(t) -> DataFrame:
    return intervals.numbered(bursts(t), "burst_idx")


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query(f"WITH {SIG} SELECT * FROM sig")
def signal_index(t):
    return sig(t)


@query(f"WITH {SIG} SELECT rec, i, round(smooth, 6) AS smooth FROM ({_box('sig', 'v', BOX, 'smooth')})")
def box_smooth(t):
    return signal.box_smooth(sig(t), BOX).select("rec", "i", r("smooth"))


_ENV = f"""{SIG}, med AS (SELECT rec, median(v) AS mv, median(k) AS mk FROM sig GROUP BY rec),
q AS (SELECT rec, i, sqrt(((v - mv) ** 2 + (k - mk) ** 2) / 2) AS raw FROM sig JOIN med USING (rec))"""


@query(f"WITH {_ENV} SELECT rec, i, round(env, 6) AS env FROM ({_box('q', 'raw', BOX, 'env')})")
def multi_channel_envelope(t):
    return signal.envelope(sig(t), ["v", "k"], BOX).select("rec", "i", r("env"))


_SPD = f"""{SIG}, a AS (SELECT rec, i, sqrt((v - lag(v) OVER w) ** 2 + (k - lag(k) OVER w) ** 2) * 10 AS step, count(*) OVER (PARTITION BY rec) AS m FROM sig WINDOW w AS (PARTITION BY rec ORDER BY i)),
b AS (SELECT rec, i, CASE WHEN m < 2 THEN 0 WHEN i = 0 THEN lead(step) OVER (PARTITION BY rec ORDER BY i) ELSE step END AS raw FROM a)"""


@query(f"WITH {_SPD} SELECT rec, i, round(spd, 6) AS spd FROM ({_box('b', 'raw', BOX, 'spd')})")
def multi_channel_speed(t):
    return signal.speed(sig(t), ["v", "k"], 10, BOX).select("rec", "i", r("spd"))


@query(f"""WITH {SIG}, m AS (SELECT rec, median(v) AS m, quantile_cont(v, 0.35) AS p FROM sig GROUP BY rec)
SELECT rec, round(greatest(any_value(p), any_value(m) + 1.5 * 1.4826 * median(abs(v - m))), 4) AS threshold FROM sig JOIN m USING (rec) GROUP BY rec""")
def robust_threshold(t):
    return signal.robust_threshold(sig(t), 35, 1.5).select("rec", r("threshold", 4))


_OTSU = f"""{SIG}, x AS (SELECT rec, v, min(v) OVER (PARTITION BY rec) AS lo, max(v) OVER (PARTITION BY rec) AS hi FROM sig),
h AS (SELECT rec, CASE WHEN hi > lo THEN least(255, floor((v - lo) / (hi - lo) * 256)) ELSE 0 END AS bin, count(*) AS c, any_value(lo) AS lo, any_value(hi) AS hi FROM x GROUP BY 1, 2),
p AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 256 AS centre, c / sum(c) OVER (PARTITION BY rec) AS p FROM h),
q AS (SELECT *, sum(p) OVER w AS w, sum(p * centre) OVER w AS m, sum(p * centre) OVER (PARTITION BY rec) AS t FROM p WINDOW w AS (PARTITION BY rec ORDER BY bin)),
z AS (SELECT *, round((t * w - m) ** 2 / CASE WHEN w * (1 - w) <= 1e-12 THEN 1e-12 ELSE w * (1 - w) END, 6) AS bv FROM q),
otsu AS (SELECT rec, CASE WHEN any_value(hi) > any_value(lo) THEN first(centre ORDER BY bv DESC, bin) ELSE any_value(hi) END AS otsu FROM z GROUP BY rec)"""


@query(f"WITH {_OTSU} SELECT rec, round(otsu, 6) AS otsu FROM otsu")
def otsu_threshold(t):
    return signal.otsu_threshold(sig(t)).select("rec", r("otsu"))


_BIMODAL = f"""{_OTSU}, md AS (SELECT rec, median(v) AS med FROM sig GROUP BY rec),
g AS (SELECT rec, any_value(otsu) AS t, coalesce(median(v) FILTER (WHERE v <= otsu), min(v)) AS rest, any_value(med) AS med, 1.4826 * median(abs(v - med)) AS sigma
  FROM sig JOIN otsu USING (rec) JOIN md USING (rec) GROUP BY rec),
e AS (SELECT *, rest + 0.8 * (t - rest) AS en, rest + 0.4 * (t - rest) AS ex FROM g)"""


@query(f"""WITH {_BIMODAL} SELECT rec, round(CASE WHEN (en <= ex OR t - rest <= 0) AND sigma > 0 THEN med + 1.2 * sigma ELSE en END, 6) AS enter,
  round(CASE WHEN (en <= ex OR t - rest <= 0) AND sigma > 0 THEN med + 0.5 * sigma ELSE ex END, 6) AS "exit" FROM e""")
def bimodal_thresholds(t):
    return signal.bimodal_thresholds(sig(t)).select("rec", r("enter"), r("exit"))


_HOLES = f"""{SIG}, o AS (SELECT rec, i, CASE WHEN i % 7 IN (3, 4) OR i % 11 = 0 THEN NULL ELSE v END AS v FROM sig),
b AS (
  SELECT rec, i, v, last_value(v IGNORE NULLS) OVER back AS v0, first_value(v IGNORE NULLS) OVER ahead AS v1,
    last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER back AS p0, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER ahead AS p1
  FROM o WINDOW back AS (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
_LINE = "v0 + (v1 - v0) * (i - p0) / (p1 - p0)"


def holed(t) -> DataFrame:
    return sig(t).withColumn("v", F.when((F.col("i") % 7).isin(3, 4) | (F.col("i") % 11 == 0), None).otherwise(F.col("v")))


@query(f"WITH {_HOLES} SELECT rec, i, round(CASE WHEN v IS NOT NULL THEN v WHEN p1 - p0 - 1 <= 2 THEN {_LINE} END, 6) AS filled FROM b")
def gap_fill(t):
    return signal.gap_fill(holed(t), max_gap=2).select("rec", "i", r("filled"))


@query(f"WITH {_HOLES} SELECT rec, i, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NOT NULL AND v1 IS NOT NULL THEN {_LINE} ELSE coalesce(v0, v1, 0) END, 6) AS filled FROM b")
def full_fill(t):
    return signal.gap_fill(holed(t), edges=True).select("rec", "i", r("filled"))


@query(f"""WITH {SIG}, a AS (SELECT rec, list(v ORDER BY i) AS x, count(*) - 1 AS last FROM sig GROUP BY rec),
g AS (SELECT rec, k, x, last, k * last / 7 AS place FROM a, range(8) AS t(k)),
p AS (SELECT rec, k, x[floor(place)::BIGINT + 1] AS low, x[least(floor(place)::BIGINT + 1, last) + 1] AS high, place - floor(place) AS part FROM g)
SELECT rec, k AS frame, round(low + (high - low) * part, 6) AS x FROM p""")
def resample_interval(t):
    arrays = sig(t).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("x"))
    frames = arrays.select("rec", F.posexplode(signal.resample(F.col("x"), 8)).alias("frame", "x"))
    return frames.select("rec", F.col("frame").cast("long").alias("frame"), r("x"))


_LAG = f"""{SIG}, st AS (SELECT rec, avg(v) AS mv, stddev_pop(v) AS sv, avg(k) AS mk, stddev_pop(k) AS sk FROM sig GROUP BY rec),
z AS (SELECT rec, i, (v - mv) / sv AS a, (k - mk) / sk AS b FROM sig JOIN st USING (rec) WHERE sv > 1e-12 AND sk > 1e-12),
pr AS (SELECT x.rec, s.lag, count(*) AS n, round(avg(x.a * y.b), 9) AS c FROM z x, range(-8, 9) AS s(lag), z y WHERE x.rec = y.rec AND y.i = x.i + s.lag GROUP BY 1, 2 HAVING count(*) >= 10),
be AS (SELECT rec, first(lag ORDER BY c DESC, lag) AS lag, first(c ORDER BY c DESC, lag) AS c FROM pr GROUP BY rec),
lags AS (SELECT sig.rec, CASE WHEN any_value(c) >= 0.05 THEN any_value(lag) END AS lag, greatest(coalesce(any_value(c), 0), 0) AS corr FROM sig LEFT JOIN be USING (rec) GROUP BY sig.rec)"""


def lags(t) -> DataFrame:
    return signal.lag_scan(sig(t), "v", "k", 8)


@query(f"WITH {_LAG} SELECT rec, lag, round(corr, 6) AS corr FROM lags")
def lag_scan(t):
    return lags(t).select("rec", "lag", r("corr"))


@query(f"WITH {_LAG} SELECT rec, CASE WHEN lag IS NULL THEN 'nan' WHEN lag < 0 THEN 'early' WHEN lag / 10.0 > 0.4 THEN 'late' ELSE 'ok' END AS lag_flag FROM lags")
def lag_bucket(t):
    return lags(t).select("rec", scalars.lag_bucket(F.col("lag") / 10.0).alias("lag_flag"))


@query(f"WITH {SIG} SELECT rec, 1.0::DOUBLE AS whole_share, round(sqrt((max(v) - min(v)) ** 2 + (max(k) - min(k)) ** 2), 6) AS pose_range FROM sig GROUP BY rec")
def excursion_gate(t):
    return signal.excursion(sig(t), ["v", "k"]).select("rec", "whole_share", r("pose_range"))


@query(f"WITH {SIG} SELECT rec, i, v FROM sig WHERE i % 4 = 0")
def decimate(t):
    return signal.decimate(sig(t), 4).select("rec", "i", "v")


@query(f"WITH {SIG}, {LATCHED} SELECT * FROM raw")
def latch_segments(t):
    return raw(t)


@query(f"WITH {SIG}, {BURST} SELECT * FROM burst")
def merge_then_drop(t):
    return bursts(t)


@query(f"WITH {SIG}, still AS ({_islands('sig', f'k <= {STILL}')}) SELECT * FROM ({_merged(f'(SELECT * FROM still WHERE e - s >= {MIN_STATIC})', f'gap > {MERGE_GAP}')})")
def drop_then_merge(t):
    return static(t)


@query(f"WITH {SIG}, {STATIC} SELECT * FROM parts")
def static_motion_partition(t):
    return parts(t)


@query(f"WITH {SIG}, {STATIC} SELECT * FROM rest")
def complement_runs(t):
    return intervals.complement(static(t), lengths(t))


@query(f"""WITH {SIG}, {BURST}, n AS (SELECT rec, count(*) AS n FROM sig GROUP BY rec)
SELECT rec, s, e, coalesce(lead(s) OVER (PARTITION BY rec ORDER BY s, e), least(n, e + {TAIL})) AS hold_end FROM burst JOIN n USING (rec)""")
def hold_windows(t):
    return intervals.hold_windows(bursts(t), lengths(t), TAIL)




def _machine(source: str, min_static: int, min_motion: int) -> str:
    """The motion machine over ``source`` (``rec, i, v, enter, leave``), a sample a step: its runs are ``run``."""
    return f"""m AS (
  SELECT rec, -1::BIGINT AS t, -1::BIGINT AS up, 0::BIGINT AS quiet, 0::DOUBLE AS peak, NULL::BIGINT AS s, NULL::BIGINT AS e FROM {source} GROUP BY rec
  UNION ALL
  SELECT rec, t, CASE WHEN begins THEN t WHEN ends THEN -1 ELSE up END, CASE WHEN ends THEN 0 ELSE quiet END, peak, CASE WHEN ends THEN up END, CASE WHEN ends THEN t - quiet + 1 END
  FROM (
    SELECT *, up >= 0 AND quiet >= {min_static} AS ends FROM (
      SELECT rec, t, up, begins, peak, CASE WHEN up >= 0 AND v <= least(0.9 * enter, greatest(leave, 0.25 * peak)) THEN quiet + 1 ELSE 0 END AS quiet FROM (
        SELECT m.rec, x.i AS t, m.up, m.quiet, x.v, x.enter, x.leave, m.up < 0 AND x.v >= x.enter AS begins,
          CASE WHEN m.up < 0 AND x.v >= x.enter THEN x.v WHEN m.up >= 0 AND x.v > m.peak THEN x.v ELSE m.peak END AS peak
        FROM m JOIN {source} x ON x.rec = m.rec AND x.i = m.t + 1)))),
run AS (SELECT rec, s, e FROM m WHERE s IS NOT NULL AND e - s >= {min_motion}
  UNION ALL SELECT rec, up, t + 1 FROM (SELECT *, max(t) OVER (PARTITION BY rec) AS last FROM m) WHERE t = last AND up >= 0 AND t + 1 - up >= {min_motion})"""


_MACHINE = f"""WITH RECURSIVE {SIG}, lim AS (SELECT rec, i, v, {ENTER}::DOUBLE AS enter, {LEAVE}::DOUBLE AS leave FROM sig), {_machine("lim", 2, 2)} SELECT * FROM run"""


@query(_MACHINE)
def motion_machine(t):
    return detect.motion_machine(sig(t), ENTER, LEAVE, 0.25, 2, 2)


_QC = f"""{SIG}, {BURST}, env AS ({_box("sig", "v", BOX, "env")}), spd AS ({_box("env", "k", BOX, "spd").replace("SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM env", "SELECT * FROM env")})"""


def smoothed(t) -> DataFrame:
    return signal.box_smooth(signal.box_smooth(sig(t), BOX, "v", "env"), BOX, "k", "spd")


@query(f"""WITH {_QC} SELECT b.rec, s, e, (e - s) / 10.0 AS duration_s, round(sqrt(avg((v * v + k * k) / 2)), 6) AS emg_rms, round(max(env), 6) AS envelope_peak, round(avg(spd), 6) AS mean_pose_speed,
  round(max(spd), 6) AS max_pose_speed, round(sqrt((max(v) - min(v)) ** 2 + (max(k) - min(k)) ** 2), 6) AS pose_range FROM burst b JOIN spd x ON x.rec = b.rec AND x.i >= s AND x.i < e GROUP BY ALL""")
def interval_qc(t):
    out = intervals.interval_quality(bursts(t), smoothed(t), ["v", "k"], "env", "spd", 10.0)
    return out.select("rec", "s", "e", "duration_s", *[r(c) for c in ("emg_rms", "envelope_peak", "mean_pose_speed", "max_pose_speed", "pose_range")])


@query(f"""WITH {_QC}, th AS (SELECT rec, median(env) AS t FROM spd GROUP BY rec)
SELECT rec, s, e, round(max(env), 6) AS peak, round(any_value(t), 6) AS level, count(*) AS n FROM burst JOIN spd USING (rec) JOIN th USING (rec) WHERE i >= s AND i < e GROUP BY rec, s, e""")
def activity_bursts(t):
    """Which activity bursts occur per entity: the flagship."""
    x = signal.box_smooth(sig(t), BOX, "v", "env")
    level = x.groupBy("rec").agg(F.percentile("env", F.lit(0.5)).alias("level"))
    inside = intervals.samples_in(bursts(t), x, {"env": F.col("env")}).join(level, "rec")
    return inside.groupBy("rec", "s", "e").agg(F.round(F.max("env"), 6).alias("peak"), F.round(F.first("level"), 6).alias("level"), F.count("*").alias("n"))


_APEX = f"""{SIG}, {BURST}, med AS (SELECT rec, median(v) AS mv, median(k) AS mk FROM sig GROUP BY rec),
d AS (SELECT b.rec, s, e, i, sqrt((v - mv) ** 2 + (k - mk) ** 2) AS d FROM burst b JOIN sig x ON x.rec = b.rec AND i >= s AND i < e JOIN med m ON m.rec = b.rec),
sm AS (
  SELECT rec, s, e, i, round((sum(d) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + greatest(0, 1 - (i - s)) * d0 + greatest(0, i - s + 1 - (e - s) + 1) * d1) / 3, 9) AS x
  FROM (SELECT *, first_value(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d0, last_value(d) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS d1
    FROM d WINDOW w AS (PARTITION BY rec, s, e ORDER BY i)) WINDOW w AS (PARTITION BY rec, s, e ORDER BY i)),
apex AS (SELECT rec, s, e, first(i ORDER BY x DESC, i) AS apex_sample FROM sm GROUP BY rec, s, e)"""


def apexes(t) -> DataFrame:
    return intervals.apex(bursts(t), sig(t), ["v", "k"], 3)


@query(f"WITH {_APEX} SELECT * FROM apex")
def apex_sample(t):
    return apexes(t)


@query(f"""WITH {_APEX} SELECT a.rec, s, e, apex_sample, round(median(v), 6) AS v_apex, round(median(k), 6) AS k_apex
FROM apex a JOIN sig x ON x.rec = a.rec AND abs(i - apex_sample) <= 2 GROUP BY ALL""")
def apex_feature(t):
    return intervals.apex_feature(apexes(t), sig(t), ["v", "k"], 2).select("rec", "s", "e", "apex_sample", r("v_apex"), r("k_apex"))


_BOTH = f"{SIG}, {BURST}, {STATIC}, {CLIP}, {NUMBERED}"
_COMMON = "least(b.e, c.e) - greatest(b.s, c.s)"
_B2C = f"""b2c AS (SELECT b.rec, b.burst_idx, b.s, b.e, coalesce(first(c.clip_id ORDER BY {_COMMON} DESC, c.clip_id) FILTER (WHERE c.rec IS NOT NULL), -1) AS matched
FROM nb b LEFT JOIN clip c ON c.rec = b.rec AND b.s < c.e AND c.s < b.e GROUP BY ALL)"""
_C2B = f"""c2b AS (SELECT c.rec, c.clip_id, c.s, c.e, coalesce(first(b.burst_idx ORDER BY {_COMMON} DESC, b.burst_idx) FILTER (WHERE b.rec IS NOT NULL), -1) AS matched
FROM clip c LEFT JOIN nb b ON c.rec = b.rec AND b.s < c.e AND c.s < b.e GROUP BY ALL)"""


@query(f"WITH {_BOTH}, {_B2C} SELECT * FROM b2c")
def burst_to_clip(t):
    return intervals.max_overlap_match(numbered_bursts(t), clips(t), "burst_idx", "clip_id").select("rec", "burst_idx", "s", "e", "matched")


@query(f"WITH {_BOTH}, {_C2B} SELECT * FROM c2b")
def clip_to_burst(t):
    return intervals.max_overlap_match(clips(t), numbered_bursts(t), "clip_id", "burst_idx", width=16).select("rec", "clip_id", "s", "e", "matched")


@query(f"""WITH {_BOTH}, {_B2C}, {_C2B}, u AS (SELECT rec, 1 AS b, 0 AS c FROM b2c WHERE matched = -1 UNION ALL SELECT rec, 0, 1 FROM c2b WHERE matched = -1)
SELECT rec, sum(b)::BIGINT AS n_burst_only, sum(c)::BIGINT AS n_clip_only FROM u GROUP BY rec""")
def disagreement_counts(t):
    one = burst_to_clip(t).where("matched = -1").select("rec", F.lit(1).alias("b"), F.lit(0).alias("c"))
    two = clip_to_burst(t).where("matched = -1").select("rec", F.lit(0).alias("b"), F.lit(1).alias("c"))
    return one.unionByName(two).groupBy("rec").agg(F.sum("b").alias("n_burst_only"), F.sum("c").alias("n_clip_only"))


@query(f"""WITH {_BOTH}, o AS (SELECT c.rec, c.clip_id, count(b.rec) AS n_overlaps FROM clip c LEFT JOIN nb b ON c.rec = b.rec AND b.s < c.e AND c.s < b.e GROUP BY 1, 2)
SELECT n_overlaps, count(*) AS n_clips FROM o GROUP BY 1""")
def overlap_histogram(t):
    return intervals.overlap_counts(clips(t), bursts(t), "clip_id").groupBy("n_overlaps").agg(F.count("*").alias("n_clips"))


@query(f"WITH {_BOTH} SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM nb b WHERE b.rec = c.rec AND b.s < c.e AND c.s < b.e) THEN 'both' ELSE 'pose_only' END AS fusion_type FROM clip c")
def fusion_type(t):
    return intervals.any_overlap(clips(t), bursts(t), "clip_id").select("rec", "clip_id", "s", "e", "fusion_type")


@query(f"WITH {_BOTH} SELECT b.rec, b.burst_idx, c.clip_id FROM nb b JOIN clip c ON b.rec = c.rec AND c.s <= (b.s + b.e) // 2 AND (b.s + b.e) // 2 < c.e")
def centre_in_interval(t):
    within = clips(t).select("rec", "clip_id", F.col("s").alias("a"), F.col("e").alias("b"))
    return intervals.centre_in(numbered_bursts(t), within).select("rec", "burst_idx", "clip_id")


@query(f"""WITH {SIG}, {STATIC}, w AS (SELECT *, lag(kind) OVER o AS k0, lead(kind) OVER o AS k2, lag(s) OVER o AS s0, lead(e) OVER o AS e2 FROM parts WINDOW o AS (PARTITION BY rec ORDER BY s, e))
SELECT rec, s0 AS s, s AS motion_s, e AS motion_e, e2 AS e FROM w WHERE k0 = 'static' AND kind = 'motion' AND k2 = 'static'""")
def adjacent_triples(t):
    return intervals.adjacent_triples(parts(t))


@query(f"""WITH {SIG}, {BURST}, g AS (SELECT rec, e AS gs, lead(s) OVER (PARTITION BY rec ORDER BY s, e) AS ge FROM burst)
SELECT g.rec, gs, ge FROM g JOIN sig x ON x.rec = g.rec AND x.i >= gs AND x.i < ge WHERE ge - gs >= 3 GROUP BY ALL HAVING bool_and(v < {ENTER / 2})""")
def clean_rest_gaps(t):
    return intervals.clean_rest_gaps(bursts(t), sig(t), F.lit(ENTER / 2), 3)


@query(f"""WITH {SIG}, {BURST} SELECT b.rec, b.s AS anchor, first(x.i ORDER BY x.v, x.i) AS snapped FROM burst b JOIN sig x ON x.rec = b.rec AND abs(x.i - b.s) <= 3 GROUP BY 1, 2""")
def snap_to_minimum(t):
    return intervals.snap_to_minimum(bursts(t).select("rec", F.col("s").alias("anchor")), sig(t), 3, "v")


@query(f"""WITH {SIG}, {BURST} SELECT b.rec, b.s AS anchor, coalesce(max(x.i) FILTER (WHERE x.v <= {LEAVE}), greatest(0, b.s - 3)) AS snapped
FROM burst b JOIN sig x ON x.rec = b.rec AND x.i <= b.s AND x.i >= b.s - 3 GROUP BY 1, 2""")
def snap_to_foot(t):
    return intervals.snap_to_foot(bursts(t).select("rec", F.col("s").alias("anchor")), sig(t), F.lit(LEAVE), 3, "v")


@query(f"""WITH {SIG}, {BURST} SELECT b.rec, b.s AS idx, coalesce(bool_or(x.v < {LEAVE}), false) AS rest FROM burst b LEFT JOIN sig x ON x.rec = b.rec AND x.i BETWEEN b.s - 4 AND b.s - 1 GROUP BY 1, 2""")
def rest_nearby(t):
    return intervals.rest_near(bursts(t).select("rec", F.col("s").alias("idx")), sig(t), F.lit(LEAVE), 4, True).select("rec", "idx", "rest")


_ONSETS = f"""{SIG}, {BURST}, {STATIC}, n AS (SELECT rec, count(*) AS n FROM sig GROUP BY rec),
act AS (SELECT rec, s, coalesce(lead(s) OVER (PARTITION BY rec ORDER BY s), n) AS e FROM burst JOIN n USING (rec))"""


@query(f"""WITH {_ONSETS}, f AS (SELECT a.rec, a.s, a.e, min(m.e) AS me FROM act a LEFT JOIN motion m ON m.rec = a.rec AND m.e > a.s AND m.s < a.e GROUP BY ALL)
SELECT rec, s, e, CASE WHEN me IS NOT NULL THEN least(greatest(s + 1, me), e - 1) ELSE least(greatest(s + 1, s + 2), greatest(s + 1, e - 1)) END AS motion_e FROM f""")
def motion_end(t):
    b = bursts(t).join(lengths(t), "rec")
    actions = b.select("rec", "s", F.coalesce(F.lead("s").over(Window.partitionBy("rec").orderBy("s")), F.col("n")).alias("e"))
    return intervals.motion_end(actions, parts(t).where("kind = 'motion'"), 2)


def _peaks(distance: int) -> str:
    """Peaks ``peak`` and the valleys ``valley`` between them in ``src`` (``rec, part, i, x`` without nulls, ``h`` least height, ``pr`` least prominence)."""
    return f"""flat AS (SELECT rec, part, min(i) AS a, max(i) AS b, any_value(x) AS x, any_value(h) AS h, any_value(pr) AS pr FROM (
  SELECT *, sum(turn) OVER (PARTITION BY rec, part ORDER BY i) AS g FROM (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY rec, part ORDER BY i) THEN 0 ELSE 1 END AS turn FROM src)) GROUP BY rec, part, g),
top AS (SELECT rec, part, (a + b) // 2 AS p, x, pr FROM (SELECT *, lag(x) OVER o AS x0, lead(x) OVER o AS x2 FROM flat WINDOW o AS (PARTITION BY rec, part ORDER BY a)) WHERE x > x0 AND x > x2 AND x >= h),
thin AS (
  SELECT rec, part, NULL::BIGINT AS p, list(p ORDER BY x DESC, p DESC) AS others FROM top GROUP BY rec, part
  UNION ALL SELECT rec, part, others[1], list_filter(others[2:], lambda q: abs(q - others[1]) >= {distance}) FROM thin WHERE len(others) > 0),
side AS (SELECT t.rec, t.part, t.p, any_value(t.x) AS height, any_value(t.pr) AS least, coalesce(max(y.i) FILTER (WHERE y.i < t.p AND y.x > t.x), -1) AS l,
    coalesce(min(y.i) FILTER (WHERE y.i > t.p AND y.x > t.x), 9223372036854775807) AS r
  FROM thin k JOIN top t ON t.rec = k.rec AND t.part = k.part AND t.p = k.p JOIN src y ON y.rec = t.rec AND y.part = t.part GROUP BY 1, 2, 3),
peak AS (SELECT s.rec, s.part, s.p FROM side s JOIN src y ON y.rec = s.rec AND y.part = s.part GROUP BY 1, 2, 3
  HAVING any_value(height) - greatest(min(y.x) FILTER (WHERE y.i > l AND y.i <= p), min(y.x) FILTER (WHERE y.i >= p AND y.i < r)) >= any_value(least)),
valley AS (SELECT k.rec, k.part, k.p, k.q, first(y.i ORDER BY y.x, y.i) AS cut FROM (SELECT *, lead(p) OVER (PARTITION BY rec, part ORDER BY p) AS q FROM peak) k
  JOIN src y ON y.rec = k.rec AND y.part = k.part AND y.i BETWEEN k.p AND k.q GROUP BY 1, 2, 3, 4)"""


@query(f"WITH RECURSIVE {SIG}, src AS (SELECT rec, 0 AS part, i, coalesce(v, 0) AS x, 100::DOUBLE AS h, 50::DOUBLE AS pr FROM sig), {_peaks(3)} SELECT rec, cut FROM valley")
def valley_split(t):
    return detect.valley_split(sig(t), 100.0, 3)


@query(f"""WITH RECURSIVE {SIG}, md AS (SELECT rec, median(coalesce(v, 0)) AS med FROM sig GROUP BY rec),
dev AS (SELECT rec, median(abs(coalesce(v, 0) - med)) AS mad FROM sig JOIN md USING (rec) GROUP BY rec),
src AS (SELECT rec, 0 AS part, i, coalesce(v, 0) AS x, 100::DOUBLE AS h, greatest(0.5 * 1.4826 * mad, 1e-9) AS pr FROM sig JOIN dev USING (rec)), {_peaks(2)},
high AS ({_islands("src", "x > 50")}), near AS ({_merged("high", "gap > 1")}),
own AS (SELECT n.rec, n.s, n.e, p, lag(p) OVER w AS p0, lead(p) OVER w AS p2 FROM near n JOIN peak k ON k.rec = n.rec AND p >= s AND p < e WINDOW w AS (PARTITION BY n.rec, n.s ORDER BY p)),
cut AS (SELECT o.rec, coalesce(a.cut, s) AS s, coalesce(b.cut, e) AS e, o.p AS apex FROM own o
  LEFT JOIN valley a ON a.rec = o.rec AND a.p = p0 AND a.q = o.p LEFT JOIN valley b ON b.rec = o.rec AND b.p = o.p AND b.q = p2)
SELECT rec, s, e, apex FROM cut WHERE e - s >= 2""")
def peak_segments(t):
    return detect.peak_segments(sig(t), 100.0, 0.5, 0.5, 2, 1)


DETECTOR = detect.Settings(fs=10, smooth_ms=300, pose_smooth_ms=300, pose_min_range=1.0, min_action_s=0.2, pose_long_seg_s=1.0)
_MOVING = "GROUP BY ALL HAVING max(x.k) - min(x.k) >= 1.0"
#: The detector with ``DETECTOR``: 3 samples to smooth, 2 for a burst, a rest, a motion, a snap and between peaks, 4 to settle, over 10 for a long run.
_ACTIONS = f"""WITH RECURSIVE {SIG}, awake AS (SELECT rec, count(*) AS n, median(k) AS mid FROM sig x GROUP BY rec HAVING max(k) - min(k) >= 1.0),
jump AS (SELECT rec, i, abs(k - lag(k) OVER (PARTITION BY rec ORDER BY i)) * 10 AS step FROM sig),
jumps AS (SELECT rec, i, coalesce(step, lead(step) OVER (PARTITION BY rec ORDER BY i), 0) AS raw FROM jump),
spd AS (SELECT rec, i, v FROM ({_box("jumps", "raw", 3, "v")})),
mids AS (SELECT rec, median(v) AS mv, median(k) AS mk FROM sig GROUP BY rec),
away AS (SELECT rec, i, sqrt(((v - mv) ** 2 + (k - mk) ** 2) / 2) AS raw FROM sig JOIN mids USING (rec)),
env AS (SELECT rec, i, v FROM ({_box("away", "raw", 3, "v")})),
{_BIMODAL.replace(SIG + ", ", "").replace("FROM sig", "FROM env")},
lv AS (SELECT rec, CASE WHEN en <= ex AND sigma > 0 THEN med + 1.2 * sigma ELSE en END AS up, CASE WHEN en <= ex AND sigma > 0 THEN med + 0.5 * sigma ELSE ex END AS down FROM e),
latched AS (SELECT rec, i, coalesce(last_value(CASE WHEN v >= up THEN 1 WHEN v < down THEN 0 END IGNORE NULLS) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS up
  FROM env JOIN lv USING (rec) WHERE up > down),
raw AS ({_islands("latched", "up = 1")}), merged AS ({_merged("raw", "gap >= 2")}), burst AS (SELECT * FROM merged WHERE e - s >= 2),
sm AS (SELECT rec, median(v) AS med, quantile_cont(v, 0.35) AS low FROM spd GROUP BY rec),
lvl AS (SELECT rec, greatest(any_value(low), any_value(med) + 1.5 * 1.4826 * median(abs(v - med))) AS level FROM spd JOIN sm USING (rec) GROUP BY rec),
go AS (SELECT rec, i, v, CASE WHEN level > 0 THEN level ELSE radians(60) END AS enter, CASE WHEN level > 0 THEN 0.5 * level ELSE radians(25) END AS leave FROM spd JOIN lvl USING (rec) JOIN awake USING (rec)),
{_machine("go", 4, 2)},
begun AS (SELECT r.rec, r.s, r.e FROM run r JOIN sig x ON x.rec = r.rec AND x.i >= r.s AND x.i < r.e {_MOVING}),
far AS (SELECT rec, s AS a, e AS b FROM begun WHERE e - s > 10),
inner_ AS (SELECT f.rec, a, b, e AS p, lead(s) OVER (PARTITION BY f.rec, a ORDER BY s) AS q FROM far f JOIN burst u ON u.rec = f.rec AND a <= (s + e) // 2 AND (s + e) // 2 < b),
rests AS (SELECT r.rec, a, b, first(y.i ORDER BY y.v, y.i) AS low FROM inner_ r JOIN env y ON y.rec = r.rec AND y.i >= p AND y.i < q JOIN lv ON lv.rec = r.rec WHERE q - p >= 2 GROUP BY r.rec, a, b, p, q HAVING bool_and(y.v < down)),
slow AS (SELECT r.rec, b, low, first(y.i ORDER BY y.v, y.i) AS s FROM rests r JOIN spd y ON y.rec = r.rec AND y.i BETWEEN low - 2 AND low + 2 GROUP BY r.rec, b, low),
fit AS (SELECT w.rec, w.s, w.b FROM (SELECT DISTINCT rec, s, b FROM slow) w JOIN sig x ON x.rec = w.rec AND x.i >= w.s AND x.i < w.b {_MOVING}),
src AS (SELECT f.rec, f.a AS part, g.i, g.v AS x, g.enter AS h, 0.5 * g.enter AS pr FROM far f ANTI JOIN rests r ON r.rec = f.rec AND r.a = f.a JOIN go g ON g.rec = f.rec AND g.i >= f.a AND g.i < f.b),
{_peaks(2)},
onset AS (SELECT rec, s AS o FROM begun UNION SELECT rec, s FROM fit UNION SELECT rec, cut FROM valley),
foot AS (SELECT DISTINCT rec, s FROM (SELECT o.rec, o, coalesce(max(g.i) FILTER (WHERE g.v <= g.leave), greatest(0, o - 2)) AS s FROM onset o JOIN go g ON g.rec = o.rec AND g.i BETWEEN o - 2 AND o GROUP BY 1, 2)),
act AS (SELECT rec, s, coalesce(lead(s) OVER (PARTITION BY rec ORDER BY s), n) AS e, mid FROM foot JOIN awake USING (rec)),
ends AS (SELECT a.rec, a.s, a.e, a.mid, min(r.e) AS re FROM act a LEFT JOIN run r ON r.rec = a.rec AND r.e > a.s AND r.s < a.e GROUP BY ALL),
moved AS (SELECT rec, s, e, mid, CASE WHEN re IS NOT NULL THEN least(greatest(s + 1, re), e - 1) ELSE greatest(s + 1, least(s + 2, e - 1)) END AS m FROM ends),
apexes AS (SELECT w.rec, s, e, m, first(x.i ORDER BY round(abs(x.k - mid), 9) DESC, x.i) AS apex FROM moved w JOIN sig x ON x.rec = w.rec AND x.i >= CASE WHEN e - m >= 2 THEN m ELSE s END AND x.i < e GROUP BY w.rec, s, e, m),
found AS (SELECT *, m > s AND EXISTS (SELECT 1 FROM burst b WHERE b.rec = a.rec AND b.e > a.s AND b.s < a.m) AS active FROM apexes a)
SELECT rec, s, e, s AS motion_s, m AS motion_e, m AS hold_s, e AS hold_e, apex, CASE WHEN active THEN 'both' ELSE 'pose_only' END AS fusion_type,
  CASE WHEN (m - s) / 10.0 > 1.0 THEN 'long' WHEN (e - m) / 10.0 < 0.35 THEN 'nohold' WHEN NOT active THEN 'slow' WHEN (e - m) / 10.0 > 4.0 THEN 'long_static' ELSE '' END AS review_flag FROM found"""


@query(_ACTIONS)
def detect_actions(t):
    return detect.detect_actions(sig(t), ["v", "k"], ["k"], DETECTOR)


@query(_ACTIONS)
def detect_actions_long(t):
    return detect_long.detect_actions(sig(t), ["v", "k"], ["k"], DETECTOR)


_TIMES = f"{SIG}, ft AS (SELECT rec, i AS frame, i * 0.1::DOUBLE + (i % 3) * 0.01::DOUBLE AS ft FROM sig WHERE i % 4 = 0), asked AS (SELECT rec, i * 0.1::DOUBLE AS t FROM sig WHERE i % 5 = 2)"


@query(f"WITH {_TIMES} SELECT a.rec, a.t, first(frame ORDER BY round(abs(ft - t), 9), ft) AS frame FROM asked a JOIN ft f USING (rec) GROUP BY 1, 2")
def nearest_frame(t):
    from_frames = sig(t).where("i % 4 = 0").select("rec", F.col("i").alias("frame"), (F.col("i") * 0.1 + (F.col("i") % 3) * 0.01).alias("ft"))
    return frames.nearest_frame(sig(t).where("i % 5 = 2").select("rec", (F.col("i") * 0.1).alias("t")), from_frames)


@query(f"""WITH {SIG}, kn AS (SELECT rec, i::DOUBLE AS t, v FROM sig WHERE i % 3 = 1), gr AS (SELECT rec, i::DOUBLE AS t FROM sig WHERE i % 3 <> 1),
b AS (SELECT g.rec, g.t, max(k.t) FILTER (WHERE k.t < g.t) AS t0, min(k.t) FILTER (WHERE k.t > g.t) AS t1, max_by(v, k.t) FILTER (WHERE k.t < g.t) AS v0, min_by(v, k.t) FILTER (WHERE k.t > g.t) AS v1 FROM gr g JOIN kn k USING (rec) GROUP BY 1, 2)
SELECT rec, t, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS v FROM b""")
def interpolate_onto(t):
    x = sig(t).withColumn("t", F.col("i").cast("double"))
    return frames.interpolate_onto(x.where("i % 3 <> 1").select("rec", "t"), x.where("i % 3 = 1"), ["v"]).select("rec", "t", r("v"))


@query(f"""WITH {SIG}, {BURST}, iv AS (SELECT rec, s * 1.0::DOUBLE + 0.5 AS t0, e * 1.0::DOUBLE AS t1 FROM burst)
SELECT iv.rec, t0, t1, count(*) FILTER (WHERE i < t0) AS s, greatest(count(*) FILTER (WHERE i <= t1), count(*) FILTER (WHERE i < t0) + 1) AS e FROM iv JOIN sig USING (rec) GROUP BY 1, 2, 3""")
def time_to_index(t):
    iv = bursts(t).select("rec", (F.col("s") + 0.5).cast("double").alias("t0"), F.col("e").cast("double").alias("t1"))
    return frames.time_to_index(iv, sig(t).withColumn("t", F.col("i").cast("double")))


@query(f"""WITH {SIG}, still AS ({_islands("sig", f"k <= {STILL}")}), u AS (SELECT rec, s::DOUBLE AS t0, (e - 1)::DOUBLE AS t1 FROM still WHERE e - 1 - s >= 1),
g AS (SELECT *, CASE WHEN t0 - lag(t1) OVER w > 2 OR lag(t1) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM u WINDOW w AS (PARTITION BY rec ORDER BY t0)),
h AS (SELECT *, sum(b) OVER (PARTITION BY rec ORDER BY t0 ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT rec, min(t0) AS t0, max(t1) AS t1 FROM h GROUP BY rec, run""")
def time_intervals(t):
    return frames.time_intervals(sig(t).withColumn("t", F.col("i").cast("double")), F.col("k") <= STILL, 1.0, 2.0)


@query(f"""WITH {SIG}, p AS (SELECT rec, i AS frame, 0 AS joint, v AS x, k AS y, 0.0 AS z FROM sig UNION ALL SELECT rec, i, 1, k, v, 1.0 FROM sig),
e AS (SELECT rec, joint, sqrt((max_by(x, frame) - min_by(x, frame)) ** 2 + (max_by(y, frame) - min_by(y, frame)) ** 2) AS d FROM p GROUP BY 1, 2),
s AS (SELECT rec, frame, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM p WINDOW w AS (PARTITION BY rec, joint ORDER BY frame)),
f AS (SELECT rec, frame, avg(d) AS d FROM s WHERE d IS NOT NULL GROUP BY 1, 2)
SELECT rec, round(any_value(a), 6) AS start_to_end, round(quantile_cont(d, 0.95), 6) AS p95_step FROM f JOIN (SELECT rec, avg(d) AS a FROM e GROUP BY rec) USING (rec) GROUP BY rec""")
def motion_score(t):
    x = sig(t)
    one = x.select("rec", F.col("i").alias("frame"), F.lit(0).alias("joint"), F.col("v").alias("x"), F.col("k").alias("y"), F.lit(0.0).alias("z"))
    two = x.select("rec", F.col("i").alias("frame"), F.lit(1).alias("joint"), F.col("k").alias("x"), F.col("v").alias("y"), F.lit(1.0).alias("z"))
    return frames.motion_score(one.unionByName(two)).select("rec", r("start_to_end"), r("p95_step"))


@query(f"WITH {_SPD}, sp AS ({_box('b', 'raw', BOX, 'spd')}), q2 AS (SELECT rec, i, sqrt(((v - mv) ** 2 + (k - mk) ** 2) / 2) AS raw FROM sig JOIN (SELECT rec, median(v) AS mv, median(k) AS mk FROM sig GROUP BY rec) USING (rec)), en AS ({_box('q2', 'raw', BOX, 'env')}) SELECT rec, i, round(env, 6) AS env, round(spd, 6) AS spd FROM sp JOIN en USING (rec, i) WHERE i % greatest(1, sp.n // 20) = 0")
def view_curves(t):
    return frames.curves(sig(t), ["v", "k"], ["v", "k"], BOX, 10, 20).select("rec", "i", r("env"), r("spd"))
