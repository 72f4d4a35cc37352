import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tremorlake import schema
from tremorlake.sources import catalog, npz, sinks
from tremorlake.streaming import latch


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(0)
    emg = rng.normal(size=(2000, 16)).astype(np.float32)
    np.savez(tmp_path / "ab-1__20260503-left__t1.npz", emg=emg, joint_angles=np.ones((2000, 20), np.float32))
    t = np.linspace(0, 1, 2100)
    raw = np.stack([90 * np.sin(t), 90 * np.cos(t)], 1).astype(np.float32)
    np.savez(tmp_path / "ab-1__20260503-right__t2.npz", emg=emg, manus_left_ergonomics=raw, manus_right_ergonomics=raw * 0, record_t0=0.0, record_t1=1.0)
    np.savez(tmp_path / "bad.npz", emg=emg, joint_angles=np.ones((5, 20), np.float32))
    np.savez(tmp_path / "pickled.npz", emg=np.array([{}], dtype=object))
    return tmp_path


def test_npz_source_and_binary_reader_agree(spark, folder):
    npz.register(spark)
    df = spark.read.format("recording_npz").option("hand", "left").option("chunk", 600).load(str(folder))
    binary = npz.recordings_from_binary(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(str(folder)), "left", 600)
    for x in (df, binary):
        rows = npz.samples(x).groupBy("path").agg(F.count("*").alias("n"), F.max("i").alias("last")).collect()
        assert sorted((r["n"], r["last"]) for r in rows) == [(2000, 1999), (2000, 1999)]
        assert x.where("error is not null").count() == 2
    pose = npz.samples(df).where("path like '%t2.npz'").orderBy("i").select("pose").collect()
    want = np.radians(90 * np.sin(np.linspace(0, 1, 2000)))
    assert np.abs(np.array([r["pose"][0] for r in pose]) - want).max() < 0.01
    assert spark.read.format("recording_npz").load(str(folder / "none")).count() == 0


def test_hand_keys_clocks_and_skeletons():
    emg = np.zeros((1000, 2), np.float32)
    archive = {"emg": emg, "manus_left_ergonomics": np.ones((10, 2)), "manus_right_ergonomics": np.full((10, 2), 2.0)}
    assert npz.read_recording(archive, "right")[1].max() == 2 and npz.read_recording(archive)[1].max() == 1
    epoch = archive | {"manus_timestamps_raw": 1.7e9 + np.linspace(0, 0.5, 10), "manus_left_ergonomics": np.linspace(0, 1, 10)[:, None].repeat(2, 1)}
    assert np.ptp(npz.read_recording(epoch, "left")[1]) > 0.9
    assert npz.read_skeleton(archive) is None
    with pytest.raises(ValueError):
        npz.read_skeleton(archive | {"manus_left_skeleton": np.ones((5, 3, 3))})
    assert npz.read_skeleton(archive | {"manus_left_skeleton": np.ones((50, 25, 7))}).shape == (1000, 25, 3)
    assert npz._duration({"duration": 3.0, "record_t0": 0, "record_t1": 5}, True) == 3 and npz._duration({"duration": 3.0, "record_t0": 0, "record_t1": 5}, False) == 5


def test_catalogues(spark, folder):
    got = {r["stem"]: (r["subject"], r["hand"]) for r in catalog.listed(spark, str(folder)).collect()}
    assert got["ab-1__20260503-left__t1"] == ("ab-1", "left") and got["bad"] == (None, None)
    rows = spark.createDataFrame([("d/s1.npz", "ab-1", "both", ""), ("d/s2_20260101.npz", "", "left", "id2"), (" ", "x", "left", "")], "sample_path string, subject_id string, side string, sample_id string")
    cat = catalog.from_table(rows)
    assert sorted((r["stem"], r["hand"], r["grp"], r["date"]) for r in cat.collect()) == [("id2", "left", "id2", "20260101"), ("s1", "left", "ab-1-left", ""), ("s1", "right", "ab-1-right", "")]
    assert cat.select("rec_key").distinct().count() == 3
    recs = spark.createDataFrame([("a.npz", "/p/a.npz"), ("b.npz", "nan"), ("c.npz", None)], "source_file string, source_path string")
    present = spark.createDataFrame([("/p/a.npz",), ("in/b.npz",), ("in/a.npz",)], "path string")
    assert {r["source_file"]: r["resolved"] for r in catalog.resolved(recs, present, "in/").collect()} == {"a.npz": "/p/a.npz", "b.npz": "in/b.npz", "c.npz": None}


def test_shards_count_once_committed(spark, tmp_path):
    for name, done in (("a", True), ("b", False)):
        (tmp_path / "shards" / name).mkdir(parents=True)
        (tmp_path / "shards" / name / "clips.csv").write_text("source_file,clip_id\n" + f"{name},1\n")
        if done:
            (tmp_path / "shards" / name / "recording.csv").write_text(f"source_file\n{name}\n")
    got = catalog.shards(spark, str(tmp_path), "clips", "source_file string, clip_id long").collect()
    assert [tuple(r) for r in got] == [("a", 1)]


def test_recordings_are_replaced_and_committed_last(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "rec_key string, x long")
    sinks.write_recordings({"recordings": make([("a", 1), ("b", 1)]), "clips": make([("a", 1), ("b", 1)])}, str(tmp_path))
    sinks.write_recordings({"recordings": make([("b", 2)]), "clips": make([("b", 2), ("b", 3)])}, str(tmp_path))
    tables = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in ("recordings", "clips")}
    assert sorted((r["rec_key"], r["x"]) for r in tables["clips"].collect()) == [("a", 1), ("b", 2), ("b", 3)]
    half = sinks.committed({"recordings": tables["recordings"].where("rec_key = 'a'"), "clips": tables["clips"]})
    assert half["clips"].count() == 1


def test_labelled_clips_hold_their_samples(spark, tmp_path):
    clips = spark.createDataFrame([("f.npz", "s", "left", 3, 1, 4, 10.0, "fist"), ("f.npz", "s", "left", 4, 4, 6, 10.0, " ")], "source_file string, subject string, hand string, clip_id long, start_sample long, end_sample long, fs double, gesture_label string")
    samples = spark.createDataFrame([("f.npz", h, i, [float(i)], [0.0]) for i in range(8) for h in ("left", "right")], "source_file string, hand string, i long, emg array<double>, pose array<double>")
    out = sinks.labelled_clips(clips, samples)
    for _ in range(2):
        sinks.write_labelled(out, str(tmp_path / "x"))
    rows = spark.read.parquet(str(tmp_path / "x")).collect()
    assert [(r["name"], r["emg"], r["gesture_label"]) for r in rows] == [("fist__s-left__f__clip0003", [[1.0], [2.0], [3.0]], "fist")]


def test_schema_tables(spark):
    for columns in schema.TABLES.values():
        assert spark.createDataFrame([], columns).count() == 0


def test_runs_are_saved_and_replaced(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("f.npz", i, i % 2) for i in range(n)], "source_file string, clip_id long, cluster_id long")
    for run, channel, k, n in (("r1", "emg", 2, 4), ("r2", "emg", 2, 3), ("r1", "pose", 5, 2)):
        sinks.save_run(run, channel, {"k": k}, rows(n), str(tmp_path), "2026-01-01")
    got = spark.read.parquet(f"{tmp_path}/cluster_assignments").groupBy("run_id").count().collect()
    assert sorted((r["run_id"], r["count"]) for r in got) == [("r1", 2), ("r2", 3)]
    runs = spark.read.parquet(f"{tmp_path}/cluster_runs").collect()
    assert sorted((r["run_id"], r["channel"], r["params_json"]) for r in runs) == [("r1", "pose", '{"k": 5}'), ("r2", "emg", '{"k": 2}')]


def test_labels_are_written_merged_and_by_folder(spark, tmp_path):
    rows = [("/d/a b/x.npz", 1, "fist"), ("/d/a-b/y.npz", 2, "wave"), ("/d/A-b/z.npz", 3, "fist, wave"), (None, 4, "none")]
    df = spark.createDataFrame(rows, "source_path string, clip_id long, gesture_label string")
    for _ in range(2):
        sinks.write_label_export(df, str(tmp_path))
    read = lambda part: spark.read.option("header", True).csv(f"{tmp_path}/{part}")
    assert sorted((r["source_path"] or "", r["clip_id"], r["gesture_label"]) for r in read("merged").collect()) == sorted((p or "", str(i), g) for p, i, g in rows)
    named = {r["clip_id"]: r["folder_name"] for r in read("by_folder").collect()}
    want = {str(r["clip_id"]): r["folder_name"] or None for r in sinks.label_export(df).collect()}
    assert named == want and len(set(named.values())) == 4


def test_tables_are_created_once(spark, tmp_path):
    spark.sql(f"CREATE DATABASE made LOCATION '{tmp_path}/made'")
    try:
        for _ in range(2):
            schema.create_tables(spark, "made")
        assert {t.name for t in spark.catalog.listTables("made")} == set(schema.TABLES)
        for name, columns in schema.TABLES.items():
            assert set(spark.table(f"made.{name}").dtypes) == set(spark.createDataFrame([], columns).dtypes)
    finally:
        spark.sql("DROP DATABASE made CASCADE")


def test_streaming_latch_equals_batch(spark, tmp_path):
    rows = [(0, i, float(v)) for i, v in enumerate([0, 0, 5, 5, 0, 5, 5, 0, 0])]
    source = tmp_path / "in"
    for k in range(0, len(rows), 3):
        spark.createDataFrame(rows[k : k + 3], "rec long, i long, v double").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("rec long, i long, v double").option("maxFilesPerTrigger", 1).parquet(str(source))
    query = latch.stream_latch(stream, 3, 1).writeStream.format("memory").queryName("latched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    until = time.time() + 120  # the time-out makes the stream go on with empty batches after its last file
    while time.time() < until and sum(p["numInputRows"] for p in query.recentProgress) < len(rows):
        time.sleep(0.2)
    query.stop()
    assert sorted((r["s"], r["e"]) for r in spark.table("latched").collect()) == [(2, 4), (5, 7)]


def test_latch_state_carries_over_batches():
    class Samples:
        def groupBy(self, _):
            return self

        def applyInPandasWithState(self, run, *_):
            return run

    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutDuration(self, _):
            pass

    v = np.random.default_rng(6).choice([0, 1, 2, 3, 5, np.nan], 300)
    run, state, got = latch.stream_latch(Samples(), 3, 1), State(), []
    parts = [pd.DataFrame({"rec": 7, "i": np.arange(a, min(a + 7, 300)), "v": v[a : a + 7]}).sample(frac=1, random_state=1) for a in range(0, 300, 7)]
    for k in range(0, len(parts), 3):
        for out in run((7,), iter([*parts[k : k + 3], parts[0][:0]]), state):
            got += [tuple(r) for r in out.itertuples(index=False)]
    want, start = [], -1
    for i, x in enumerate(v):
        if start < 0 and x >= 3:
            start = i
        elif start >= 0 and x < 1:
            want.append((7, start, i))
            start = -1
    assert got == want and len(want) > 20 and state.get == (start, 299)
