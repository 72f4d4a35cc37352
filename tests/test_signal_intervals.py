import numpy as np
from pyspark.sql import functions as F

from tremorlake.operators import detect, detect_long, frames, intervals, signal


def frame(spark, *signals, names=("v",)):
    rows = [(r, i, *[None if x is None or np.isnan(x) else float(x) for x in values]) for r, columns in enumerate(signals) for i, values in enumerate(zip(*np.atleast_2d(np.array(columns, float))))]
    return spark.createDataFrame(rows, "rec long, i long, " + ", ".join(f"{n} double" for n in names))


def values(df, column):
    return [r[column] for r in df.orderBy("rec", "i").collect()]


def pairs(df):
    return sorted((r["rec"], r["s"], r["e"]) for r in df.collect())


def test_box_equals_padded_mean_and_spares_the_rest_of_a_hole(spark):
    x = np.random.default_rng(0).normal(size=50)
    for size in (1, 4, 5):
        padded = np.pad(x, (size // 2, size - size // 2 - 1), mode="edge")
        assert np.allclose(values(signal.box_smooth(frame(spark, x), size), "smooth"), np.convolve(padded, np.ones(size) / size, "valid"))
        assert np.allclose(detect._moving_mean(x, size), np.convolve(padded, np.ones(size) / size, "valid"))
    x[20] = x[0] = np.nan
    got = values(signal.box_smooth(frame(spark, x), 5), "smooth")
    assert [k for k, v in enumerate(got) if v is None] == [0, 1, 2, 18, 19, 20, 21, 22]
    assert np.isnan(detect._moving_mean(x, 5)).nonzero()[0].tolist() == [0, 1, 2, 18, 19, 20, 21, 22]


def test_speed_and_envelope(spark):
    a, b = [0.0, 3.0, 3.0], [0.0, 4.0, 4.0]
    assert values(signal.speed(frame(spark, [a, b], names=("a", "b")), ["a", "b"], 10, 1), "spd") == [50.0, 50.0, 0.0]
    assert values(signal.speed(frame(spark, [[1.0]]), ["v"], 10, 1), "spd") == [0.0]
    one = values(signal.envelope(frame(spark, [[1.0, 5.0, 1.0]]), ["v"], 1), "env")
    moved = values(signal.envelope(frame(spark, [[101.0, 105.0, 101.0]]), ["v"], 1), "env")
    assert one == moved == [0.0, 4.0, 0.0]


def test_thresholds(spark):
    two = [0.0] * 50 + [10.0] * 50
    df = frame(spark, two, [3.0] * 20, [None] * 5 + [1.0, 2.0])
    otsu = {r["rec"]: r["otsu"] for r in signal.otsu_threshold(df).collect()}
    assert 0 <= otsu[0] < 10 and otsu[1] == 3.0
    both = {r["rec"]: (r["enter"], r["exit"]) for r in signal.bimodal_thresholds(df).collect()}
    assert both[1] == (3.0, 3.0) and both[0][0] > both[0][1]
    robust = {r["rec"]: r["threshold"] for r in signal.robust_threshold(frame(spark, [1.0, 2.0, 3.0, 4.0, 100.0], [None, None]), 35, 1.5).collect()}
    assert robust == {0: 3.0 + 1.5 * 1.4826 * 1.0, 1: 0.0}
    moves = signal.move_thresholds(frame(spark, [0.0, 0.0], names=("spd",)), 35, 1.5, 0.5, (7.0, 3.0)).first()
    assert (moves["enter"], moves["exit"]) == (7.0, 3.0)


def test_gap_fill(spark):
    x = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    assert values(signal.gap_fill(frame(spark, x), max_gap=2), "filled") == [None, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, None]
    assert values(signal.gap_fill(frame(spark, x), edges=True), "filled") == [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 8.0]
    assert values(signal.gap_fill(frame(spark, [None, None]), edges=True), "filled") == [0.0, 0.0]


def test_latch_with_open_end_and_holes(spark):
    x = [0, 0, 5, 5, 5, 0, 0, 5, 5, 0]
    assert pairs(intervals.latch(frame(spark, x, [5, 2, None, 2], [0, 0]), F.lit(3), F.lit(1))) == [(0, 2, 5), (0, 7, 9), (1, 0, 4)]


def runs(spark, *rows):
    return spark.createDataFrame([(0, s, e) for s, e in rows], "rec long, s long, e long")


def test_merge_and_drop_orders_differ(spark):
    df = runs(spark, (0, 2), (3, 5), (20, 21), (30, 36))
    assert pairs(intervals.merge_then_drop(df, 2, 4)) == [(0, 0, 5), (0, 30, 36)]
    assert pairs(intervals.drop_then_merge(df, 4, 2)) == [(0, 30, 36)]
    touching = runs(spark, (0, 5), (7, 12))
    assert len(pairs(intervals.merge_then_drop(touching, 2, 1))) == 2 and len(pairs(intervals.drop_then_merge(touching, 1, 2))) == 1


def test_complement_and_holds(spark):
    n = spark.createDataFrame([(0, 20), (1, 5)], "rec long, n long")
    df = runs(spark, (3, 6), (4, 10), (15, 20))
    assert pairs(intervals.complement(df, n)) == [(0, 0, 3), (0, 10, 15), (1, 0, 5)]
    assert [r["hold_end"] for r in intervals.hold_windows(runs(spark, (1, 3), (8, 10)), n, 4).orderBy("s").collect()] == [8, 14]


def test_matches_take_the_first_of_equal_overlaps(spark):
    b = spark.createDataFrame([(0, 0, 4, 8), (0, 1, 20, 25), (0, 2, 30, 40)], "rec long, b long, s long, e long")
    c = spark.createDataFrame([(0, 0, 0, 6), (0, 1, 6, 20), (0, 2, 28, 60)], "rec long, c long, s long, e long")
    for width in (4096, 5, 1):
        got = {r["b"]: r["matched"] for r in intervals.max_overlap_match(b, c, "b", "c", width=width).collect()}
        assert got == {0: 0, 1: -1, 2: 2}
    assert {r["c"]: r["n_overlaps"] for r in intervals.overlap_counts(c, b, "c").collect()} == {0: 1, 1: 1, 2: 1}


def test_remap_keeps_chains(spark):
    old = spark.createDataFrame([(0, 0, 0, 10), (0, 1, 10, 20), (0, 2, 90, 99)], "rec long, old_id long, s long, e long")
    new = spark.createDataFrame([(0, 1, 0, 10), (0, 2, 10, 20)], "rec long, new_id long, s long, e long")
    got = {r["old_id"]: (r["new_id"], r["status"]) for r in intervals.iou_remap(old, new).collect()}
    assert got == {0: (1, "moved"), 1: (2, "moved"), 2: (None, "lost")}


def test_lag_of_shifted_pulses(spark):
    rng = np.random.default_rng(0)
    base = np.zeros(400)
    base[rng.choice(380, 12, replace=False)] = 5
    base = np.convolve(base, np.ones(5), "same")
    df = frame(spark, [base, np.roll(base, 6)], [base, np.roll(base, -4)], [base, np.zeros(400)], names=("a", "b"))
    got = {r["rec"]: r["lag"] for r in signal.lag_scan(df, "a", "b", 10).collect()}
    assert got == {0: 6, 1: -4, 2: None}


def machine_by_samples(x, enter, leave, settle, min_static, min_motion):
    """The machine's definition, a sample at a time."""
    found, on, quiet, peak = [], -1, 0, 0.0
    for t, v in enumerate([*x, None]):
        if v is None:
            found += [(on, t)] * (on >= 0 and t - on >= min_motion)
        elif on < 0:
            if v >= enter:
                on, quiet, peak = t, 0, v
        elif not np.isnan(v):
            peak = max(peak, v)
            quiet = quiet + 1 if v <= min(0.9 * enter, max(leave, settle * peak)) else 0
            if quiet == min_static:
                found += [(on, t - quiet + 1)] * (t - quiet + 1 - on >= min_motion)
                on = -1
        else:
            quiet = 0
    return found


def test_motion_machine_equals_a_loop(spark):
    rng = np.random.default_rng(1)
    signals = [np.where(rng.random(120) < 0.05, np.nan, np.abs(np.cumsum(rng.normal(size=120)))) for _ in range(12)]
    want = [[(s, e) for s, e in machine_by_samples(x, 4.0, 1.0, 0.25, 3, 2)] for x in signals]
    assert pairs(detect.motion_machine(frame(spark, *signals), 4.0, 1.0, 0.25, 3, 2)) == sorted((k, s, e) for k, rows in enumerate(want) for s, e in rows) and any(want)
    assert [list(map(tuple, detect._machine_runs(x, 4.0, 1.0, 0.25, 3, 2).tolist())) for x in signals] == want
    levels = frame(spark, *signals).withColumn("hi", F.lit(4.0)).withColumn("lo", F.when(F.col("rec") >= 0, 1.0))
    assert pairs(detect.motion_machine(levels, F.col("hi"), F.col("lo"), 0.25, 3, 2)) == sorted((k, s, e) for k, rows in enumerate(want) for s, e in rows)


def test_prominence_equals_its_definition():
    rng = np.random.default_rng(2)
    for _ in range(60):
        x = np.round(np.abs(np.cumsum(rng.normal(size=rng.integers(3, 80)))), int(rng.integers(0, 3)))
        peaks = detect.find_peaks(x, -1, 1, -1)
        want = []
        for p in peaks:
            left = [k for k in range(p) if x[k] > x[p]]
            right = [k for k in range(p, len(x)) if x[k] > x[p]]
            want.append(x[p] - max(x[left[-1] + 1 if left else 0 : p + 1].min(), x[p : right[0] if right else len(x)].min()))
        assert np.allclose(detect.prominences(x, peaks), want) if len(peaks) else True


def test_cells_join_like_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.random(100_000)
    starts = np.sort(rng.choice(99_000, 1000, replace=False))
    ends = starts + rng.integers(1, 900, 1000)
    samples = spark.range(100_000).select(F.lit(7).cast("long").alias("rec"), F.col("id").alias("i"), (F.hash("id") % 1000).cast("double").alias("v"))
    spans = spark.createDataFrame([(7, int(k), int(s), int(e)) for k, (s, e) in enumerate(zip(starts, ends, strict=True))], "rec long, k long, s long, e long")
    inside = intervals.samples_in(spans, samples, {"v": F.col("v")})
    got = {r["k"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy("k").agg(F.count("*").alias("n"), F.min("__i").alias("lo"), F.max("__i").alias("hi")).collect()}
    assert got == {k: (int(min(e, 100_000) - s), int(s), int(min(e, 100_000) - 1)) for k, (s, e) in enumerate(zip(starts, ends, strict=True))} and len(x) == 100_000
    counts = {r["k"]: r["n_overlaps"] for r in intervals.overlap_counts(spans, spans, "k").collect()}
    want = ((starts[:, None] < ends) & (starts < ends[:, None])).sum(1)
    assert counts == dict(enumerate(want.tolist()))
    plan = intervals.overlap_counts(spans, spans, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "__cell" in plan and "Join Cross" not in plan


def test_peaks(spark):
    x = np.array([0, 2, 0, 5, 5, 5, 0, 4, 3.5, 4.5, 0, 1], float)
    assert detect.find_peaks(x, 1, 1, 0).tolist() == [1, 4, 7, 9]
    assert detect.find_peaks(x, 1, 3, 0).tolist() == [1, 4, 9] and detect.find_peaks(x, 1, 1, 1).tolist() == [1, 4, 9]
    assert detect.find_peaks(np.ones(5), 0, 1, 0).tolist() == [] and detect.valley_cuts(x, np.array([4, 9])) == [6]
    got = detect.peak_segments(frame(spark, x), 3, 0.5, 0.0, 1, 0).orderBy("s").collect()
    assert [(r["s"], r["e"], r["apex"]) for r in got] == [(3, 6, 4), (7, 8, 7), (8, 10, 9)]


def gestures(fs, rng):
    n = 5 * fs
    pose, emg = np.zeros((n, 3)), rng.normal(0, 0.02, (n, 4))
    for g in range(4):
        a, b = g * fs + fs // 2, g * fs + fs // 2 + int(0.4 * fs)
        pose[a:b, g % 3] += np.linspace(0, 1.2, b - a)
        pose[b:, g % 3] += 1.2
        emg[a:b] += rng.normal(0, 0.3, (b - a, 4))
    return emg, pose


def test_detector_tiles_from_the_first_onset(spark):
    fs = 200
    emg, pose = gestures(fs, np.random.default_rng(0))
    n = len(emg)
    names = [f"e{k}" for k in range(4)] + [f"p{k}" for k in range(3)]
    still = np.concatenate([emg, np.zeros((n, 3))], 1).T
    df = frame(spark, np.concatenate([emg, pose], 1).T, still, names=names)
    for module in (detect, detect_long):
        got = module.detect_actions(df, names[:4], names[4:], detect.Settings(fs=fs)).orderBy("rec", "s").collect()
        assert {r["rec"] for r in got} == {0} and 3 <= len(got) <= 5
        assert [r["e"] for r in got[:-1]] == [r["s"] for r in got[1:]] and got[-1]["e"] == n
        assert all(r["hold_s"] <= r["apex"] < r["hold_e"] for r in got)


def test_detector_stands_recordings_without_onsets_or_values(spark):
    c = detect.Settings(fs=10, smooth_ms=300, pose_smooth_ms=300, pose_min_range=1.0, min_action_s=0.2, pose_long_seg_s=1.0, auto_move_thresh=False, move_enter=1e6, move_exit=1.0)
    moving = np.arange(40.0)
    rows = [[moving, moving], [[np.nan] * 40, [np.nan] * 40], [[1.0], [2.0]], [moving, [np.nan] * 40], [moving, np.where(moving % 2, np.inf, moving)]]
    df = frame(spark, *rows, names=("a", "b"))
    for module in (detect, detect_long):
        out = module.detect_actions(df, ["a"], ["b"], c)
        assert out.columns[:3] == ["rec", "s", "e"] and out.collect() == []
        assert module.detect_actions(df.limit(0), ["a"], ["b"], c).collect() == []


def test_both_forms_of_the_detector_agree(spark):
    rng = np.random.default_rng(4)
    signals = [np.abs(np.cumsum(rng.normal(0, 8, (2, int(rng.integers(30, 90)))), 1)) for _ in range(25)]
    signals = [np.where(rng.random(x.shape) < 0.04, np.nan, x) for x in signals]
    df = frame(spark, *signals, names=("v", "k"))
    for more in ({"enable_r7": True, "pose_long_seg_s": 0.5},):
        c = detect.Settings(**({"fs": 10, "smooth_ms": 300, "pose_smooth_ms": 300, "pose_min_range": 1.0, "min_action_s": 0.2, "pose_long_seg_s": 1.0} | more))
        one, two = (sorted(map(tuple, m.detect_actions(df, ["v", "k"], ["k"], c).collect())) for m in (detect, detect_long))
        assert one == two and len(one) > 25


def test_quaternions_and_chains(spark):
    half = np.sqrt(0.5)
    turn = np.array([half, 0, 0, half])  # a quarter turn about z
    assert np.allclose(frames.rotated(turn, np.array([1.0, 0, 0])), [0, 1, 0]) and np.allclose(frames.rotated(np.zeros(4), np.array([1.0, 2, 3])), [1, 2, 3])
    assert np.allclose(frames.rotated(frames.quaternion_product(turn, turn), np.array([1.0, 0, 0])), [-1, 0, 0])
    rows = [(0, 0, [[1.0, 0.0, 0.0, 0.0], turn.tolist(), turn.tolist()])]
    got = frames.forward_kinematics(spark.createDataFrame(rows, "rec long, frame long, q array<array<double>>"), [[1.0, 0, 0]] * 3).orderBy("joint").collect()
    assert np.allclose([[r["x"], r["y"], r["z"]] for r in got], [[1, 0, 0], [1, 1, 0], [0, 1, 0]])


def test_labels_sort_by_their_number(spark):
    df = spark.createDataFrame([("g10",), ("g9",), ("a",), ("g",)], "l string")
    assert [r["l"] for r in df.orderBy(*frames.natural_order(F.col("l"))).collect()] == ["a", "g", "g9", "g10"]
