import itertools

import pytest
from pyspark.sql import functions as F

from tremorlake.operators import labels, learn, score, select


@pytest.fixture(scope="module")
def clips(spark):
    rows = [(f"{s}__{d}-{h}__t{n}.npz", c, s, h, d, f"{s}__{d}-{h}__t{n}") for n, (s, h, d) in enumerate([("ab-1", "left", "20260503"), ("AB1", "Right", "20260504"), ("cd-2", "left", "")]) for c in range(2)]
    return spark.createDataFrame(rows, "source_file string, clip_id long, subject string, hand string, date string, stem string")


@pytest.mark.parametrize(
    ("selector", "kept"),
    [({}, 6), ({"subjects": "ab1"}, 4), ({"hand": "RIGHT"}, 2), ({"hand": "right", "exact_hand": True}, 0), ({"dates": ["202605"]}, 4), ({"date_from": "20260504"}, 2), ({"date_to": "20260503"}, 2),
     ({"sessions": "20260503-left"}, 2), ({"recordings": "cd-2__-left__t2"}, 2), ({"recordings": "cd-2__-left__t2.npz,nope"}, 2), ({"subjects": "ab-1", "hand": "left"}, 2)],
)
def test_selectors(clips, selector, kept):
    assert select.select_clips(clips, select.Selector(**selector))[0].count() == kept


def test_scope_and_processing(spark, clips):
    s = select.scope_summary(clips).first()
    assert (s["n_clips"], s["n_recordings"], s["n_subjects"], s["date_min"], s["date_max"]) == (6, 3, 2, "20260503", "20260504")
    cat = spark.createDataFrame([("a", "x/Force_Data/f"), ("b", "x/f"), ("c", "x/f")], "rec_key string, path string")
    assert select.without_paths(cat).count() == 2
    done = cat.where("rec_key = 'c'").select("rec_key")
    gone = cat.where("rec_key = 'a'").select("rec_key")
    assert [r[0] for r in select.to_process(cat, gone, done).select("rec_key").collect()] == ["b"] and select.to_process(cat, gone, done, force=True).count() == 2


@pytest.fixture(scope="module")
def annotations(spark):
    rows = [("r1", 0, "clip", "label", "fist", "v1"), ("r1", 1, "clip", "label", "wave", "v0"), ("r1", 2, "clip", "invalid", "1", "v1"), ("r2", -1, "recording", "invalid", "1", "v1"), ("r2", 0, "clip", "label", " ", "v1")]
    return spark.createDataFrame(rows, "source_file string, clip_id long, scope string, kind string, value string, seg_version string")


def test_labelled_view_excludes_and_checks_versions(spark, annotations):
    clips = spark.createDataFrame([(r, c, "v1") for r, c in itertools.product(["r1", "r2", "r3", "r4"], range(3))], "source_file string, clip_id long, seg_version string")
    tombs = spark.createDataFrame([("r3",)], "source_file string")
    got = {(r["source_file"], r["clip_id"]): r["gesture_label"] for r in labels.labelled_view(clips, annotations, tombs).collect()}
    assert got == {("r1", 0): "fist", ("r1", 1): None, ("r4", 0): None, ("r4", 1): None, ("r4", 2): None}
    loose = labels.labelled_view(clips, annotations, tombs, same_version=False)
    assert {r["gesture_label"] for r in loose.collect()} == {"fist", "wave", None}
    progress = {r["source_file"]: (r["n_labeled"], r["n_invalid"], r["rec_invalid"]) for r in labels.progress(clips.select("source_file").distinct(), annotations).collect()}
    assert progress == {"r1": (2, 1, False), "r2": (0, 0, True), "r3": (0, 0, False), "r4": (0, 0, False)}


def test_changes_and_latest(spark):
    rows = spark.createDataFrame([("r", 0, " a ", False), ("r", 1, "b", True), ("r", 2, "", False)], "source_file string, clip_id long, value string, invalid boolean")
    log = labels.annotation_changes(rows).withColumn("at", F.lit(1))
    now = labels.latest(log, labels.ANNOTATION_KEY, ["at"], "deleted")
    assert sorted((r["clip_id"], r["kind"], r["value"]) for r in now.collect()) == [(0, "label", "a"), (1, "invalid", "1")]
    later = log.unionByName(labels.annotation_changes(rows.where("clip_id = 1").withColumn("invalid", F.lit(False))).withColumn("at", F.lit(2)))
    assert sorted((r["clip_id"], r["kind"]) for r in labels.latest(later, labels.ANNOTATION_KEY, ["at"], "deleted").collect()) == [(0, "label"), (1, "label")]


def test_drop_and_prune(spark, annotations):
    gone = spark.createDataFrame([("r1", "now", "")], "source_file string, dropped_at string, note string")
    once = labels.drop_recording({"annotations": annotations, "cluster_runs": annotations}, gone.limit(0), gone)
    assert once["annotations"].count() == 2 and once["cluster_runs"].count() == 5
    assert labels.drop_recording(once, once["tombstones"], gone)["tombstones"].count() == 1
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "run_id string")
    assert [r[0] for r in labels.orphan_runs(ids("a", "b"), ids("b", "c"), ids("a", "b")).collect()] == ["c"]


def test_scores_of_equal_and_trivial_partitions(spark):
    rows = spark.createDataFrame([(i, i // 5, "xyz"[i // 5], i % 2) for i in range(15)], "key long, cluster long, label string, subject long")
    assert score.purity(rows).first()[0] == score.adjusted_rand(rows).first()[0] == 1 and abs(score.normalised_mi(rows).first()[0] - 1) < 1e-12
    lone = rows.withColumn("cluster", F.lit(0)).withColumn("label", F.lit("a"))
    assert score.adjusted_rand(lone).first()[0] == score.normalised_mi(lone).first()[0] == 1.0
    m = score.label_metrics(lone, "cluster", "label").first()
    assert (m["n_labeled"], m["n_classes"], m["ari"]) == (15, 1, None)
    assert score.contamination(rows.withColumn("subject", F.lit(1))).first()["n_over_77"] == 3


def test_clusters_of_blobs(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(k * 15 + i, k % 2, [float(x) for x in rng.normal(8 * k, 0.3, 2)]) for k in range(3) for i in range(15)]
    df = spark.createDataFrame(rows, "key long, subject long, embedding array<double>")
    k, out = learn.kmeans_scan(df, 2, 4)
    assert k == 3 and {r["key"] // 15: 0 for r in out.collect()} == {0: 0, 1: 0, 2: 0}
    assert score.silhouette(out).agg(F.min("silhouette")).first()[0] > 0.8
    assert learn.kmeans(df.limit(1), 5).select("cluster").first()[0] == 0 and learn.clamp_k(30, 6) == 5 and learn.clamp_k(1, 9) == 2
    weighted = learn.zscored_vectors(df, weights=[1.0, 0.0])
    assert all(r["z"][1] == 0 for r in weighted.collect())
    assert learn.loso_transfer(df, 2).count() == 2


def _silhouettes(rows):
    """``(key, cluster)`` to silhouette over all pairs, the plain way."""
    import math

    out = {}
    for key, cluster, v in rows:
        by = {}
        for k, c, w in rows:
            if k != key:
                by.setdefault(c, []).append(math.dist(v, w) if v is not None and w is not None else None)
        mean = {c: sum(d) / len(d) for c, d in ((c, [x for x in d if x is not None]) for c, d in by.items()) if d}
        a, b = mean.get(cluster), min((m for c, m in mean.items() if c != cluster), default=None)
        out[key, cluster] = 0.0 if a is None or b is None or max(a, b) == 0 else (b - a) / max(a, b)
    return out


def test_silhouette_takes_all_rows_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(4)), [float(x) for x in rng.normal(100, 1, 3)]) for i in range(150)]
    rows += [(200 + i, i % 2, [5.0, 5.0, 5.0]) for i in range(20)] + [(300, 9, [1.0, 2.0, 3.0]), (301, 1, None)]
    df = spark.createDataFrame(rows, "key long, cluster long, embedding array<double>")
    monkeypatch.setattr(score, "BLOCKS_A_TASK", 3)
    for size in (20, 4096):
        monkeypatch.setattr(score, "BLOCK_ROWS", size)
        got = {(r["key"], r["cluster"]): r["silhouette"] for r in score.silhouette(df).collect()}
        want = _silhouettes(rows)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    same = spark.createDataFrame([(i, i % 2, [0.1, 0.7]) for i in range(6)], df.schema)
    assert {r["silhouette"] for r in score.silhouette(same).collect()} == {0.0}
    assert score.silhouette(df, 50).count() == 50 and score.silhouette(df.limit(0)).count() == 0


def test_silhouette_drops_no_row(spark):
    many = spark.range(10_300).selectExpr("id AS key", "id % 3 AS cluster", "array(double(id % 3) * 5, double(id % 101) / 101) AS embedding")
    got = score.silhouette(many)
    assert got.count() == 10_300 and got.where("silhouette > 0.9").count() == 10_300
