import numpy as np

from tremorlake import storage
from tremorlake.functions import names
from tremorlake.operators import learn, reports, select
from tremorlake.sources import catalog, npz


def test_a_recording_is_cached_whole_or_not(spark):
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "source_file string, clip_id long")
    hit, miss = catalog.cached_features(asked, asked.where("source_file = 'b' or clip_id = 1"), ["source_file", "clip_id"])
    assert [tuple(r) for r in hit.collect()] == [("b", 1)] and sorted(tuple(r) for r in miss.collect()) == [("a", 1), ("a", 2)]
    assert catalog.cached_features(asked.limit(0), asked, ["source_file", "clip_id"])[0].count() == 0


def test_walk_sorts_by_number_and_skips_others(spark):
    paths = ["r/C10/p/s-left-3/a.npz", "r/C2/p/s-left/b.npz", "r/C2/p/s-left/deep/c.npz", "r/C2/p/d.npz", "r/Cx/p/s/e.npz"]
    got = [(r["camp"], r["batch"], r["path"][-5:]) for r in catalog.walked(spark.createDataFrame([(p,) for p in paths], "path string")).collect()]
    assert got == [(2, 1, "b.npz"), (2, 1, "c.npz"), (10, 3, "a.npz")]


def test_hand_comes_from_the_path_when_none_is_given(tmp_path):
    assert [npz.hand_in(p) for p in ("a/20260101-left/x-right.npz", "a/20260101-LEFT-2/x.npz", "a/bright/x.npz", "left/a/b/x.npz")] == ["right", "left", None, None]
    path = str(tmp_path / "20260101-right__t.npz")
    np.savez(path, emg=np.zeros((20, 2)), manus_left_ergonomics=np.zeros((20, 2)), manus_right_ergonomics=np.ones((20, 2)))
    batch = next(npz._batches(path, path, None, 100, False))
    assert batch.column("hand")[0].as_py() == "right" and batch.column("pose")[0].as_py()[0] == [1.0, 1.0]


def test_common_prefix(spark):
    rows = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = [names.common_prefix(rows(*p)).first()["prefix"] for p in (("a/b/x", "a/b/y"), ("a/bc/x", "a/bd/y"), ("x", "y"), ("a/b/x",), ("/a/x", "/a/x"))]
    assert got == ["a/b/", "a/", "", "a/b/", "/a/"]
    assert names.common_prefix(rows("x").limit(0)).first()["prefix"] == ""


def test_palette_is_chosen_or_counted(spark):
    ann = spark.createDataFrame([("clip", "label", "b"), ("clip", "label", "b"), ("clip", "label", "a"), ("clip", "invalid", "1")], "scope string, kind string, value string")
    labels = lambda chosen: [r["label"] for r in select.palette_or_top(chosen, ann).orderBy("position").collect()]
    assert labels([" x", "y", "x"]) == ["x", "y"] and labels({"labels": ["z"]}) == ["z"] and labels(None) == ["b", "a"] and labels({}) == ["b", "a"]


def test_diagnostics_of_nothing(spark):
    empty = spark.createDataFrame([], "rec long, s long, e long, motion_e long, apex long, review_flag string")
    got = reports.diagnostics(empty, 10.0, 0.3).first()
    assert (got["n_actions"], got["hold_median_s"], got["seamless"], got["flags"]) == (0, None, True, "")


def test_groups_are_clustered_apart_with_ids_of_their_own(spark):
    rng = np.random.default_rng(0)
    rows = [(g * 100 + k, g, k % 2, (rng.normal(0, 0.1, 3) + 9 * (k % 2)).tolist()) for g in range(2) for k in range(12)] + [(999, 0, 0, [float("nan"), 0.0, 0.0])]
    v = spark.createDataFrame(rows, "key long, grp long, subject long, embedding array<double>")
    got = learn.apex_clusters(v, 2, 2, "none").collect()
    assert len(got) == 24 and {r["k"] for r in got} == {2} and len({r["cluster_id"] for r in got}) == 4
    assert len({(r["cluster_id"], r["key"] % 100 % 2) for r in got}) == 4
    marked = learn.grouped_trajectory_clusters(v.where("key < 999"), 2, 2).collect()
    assert sum(r["medoid"] for r in marked) == len({r["cluster_id"] for r in marked}) == 4


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    try:
        storage.shared_dir(Session())
    except ValueError as e:
        assert "spark.checkpoint.dir" in str(e)
    else:
        raise AssertionError("a machine's own folder was taken")


def test_segment_means_add_in_the_samples_order(spark):
    """The values add to 0 in their order and to 1 or more in others; samples may arrive in any."""
    values = [1.0, 1e16, -1e16, 0.0, 1.0, 1e16, -1e16, 0.0]
    x = spark.createDataFrame([("a", i, v, float(i)) for i, v in reversed(list(enumerate(values)))] + [("a", 8, None, None), ("a", 9, 7.0, 1.0)], "rec string, i long, v double, k double")
    runs = spark.createDataFrame([("a", 0, 9), ("a", 9, 10), ("a", 10, 12)], "rec string, s long, e long")
    for arriving in (x.coalesce(1), x.repartition(5)):
        got = {r["s"]: tuple(r)[2:] for r in reports.segment_statistics(runs, arriving, ["k"], ["v", "k"], "v").collect()}
        assert got == {0: (9, 0.0, 1e16, 17.5**0.5, [0.0, 3.5]), 9: (10, 7.0, 7.0, 1.0, [7.0, 1.0])}
