"""Queries on catalogues, caches, labels of recordings, reports and vectors, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions import names, scalars
from tremorlake.operators import frames, intervals, labels, learn, reports, score, select, signal
from tremorlake.plans.registry import query
from tremorlake.plans.signals import BURST, SIG, bursts, r, sig
from tremorlake.plans.tables import _ANN, _CAT, _FEAT, _REVIEW, assigned, catalogued, doc_annotations, doc_clips, doc_tombstones, features, paths, reviewed
from tremorlake.sources import catalog, sinks

# Catalogues and caches.


@query(f"WITH {_CAT} SELECT path FROM catalog WHERE id % 6 <> 1")
def legacy_invalid(t):
    bad = paths(t).where("id % 6 = 1").select("path")
    listed = catalog.with_names(bad).select("source_file")
    return catalog.without_listed(catalogued(t), listed).select("path")


@query("""SELECT 'data/C' || c_custkey % 12 || '/p' || c_custkey % 5 || '/20260101-left' || CASE WHEN c_custkey % 3 = 0 THEN '-' || c_custkey % 4 + 2 ELSE '' END || '/x' || c_custkey || '.npz' AS path,
  (c_custkey % 12)::BIGINT AS camp, 'p' || c_custkey % 5 AS person, '20260101-left' || CASE WHEN c_custkey % 3 = 0 THEN '-' || c_custkey % 4 + 2 ELSE '' END AS session,
  CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 + 2 ELSE 1 END::BIGINT AS batch FROM customer WHERE c_custkey % 7 <> 0""")
def dataset_walk(t):
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    session = F.concat(F.lit("20260101-left"), F.when(k % 3 == 0, F.concat(F.lit("-"), text(k % 4 + 2))).otherwise(""))
    path = F.concat(F.when(k % 7 == 0, "data/other").otherwise(F.concat(F.lit("data/C"), text(k % 12))), F.lit("/p"), text(k % 5), F.lit("/"), session, F.lit("/x"), text(k), F.lit(".npz"))
    return catalog.walked(t("customer").select(path.alias("path")))


@query("SELECT c_custkey::VARCHAR AS name, CASE WHEN c_custkey % 4 = 0 THEN '?' ELSE c_mktsegment END AS label, c_nationkey::VARCHAR AS hand, '?' AS fs FROM customer")
def clip_metadata(t):
    k = F.col("c_custkey")
    rows = t("customer").select(k.cast("string").alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("label"), F.col("c_nationkey").alias("hand"))
    return catalog.clip_metadata(rows, ["label", "hand", "fs"])


_CACHED = """w AS (SELECT o_custkey AS source_file, o_orderkey AS clip_id, o_orderstatus <> 'P' AS here FROM orders),
h AS (SELECT source_file, bool_and(here) AS whole FROM w GROUP BY 1)"""


@query(f"WITH {_CACHED} SELECT source_file, clip_id, whole AS hit FROM w JOIN h USING (source_file)")
def feature_cache(t):
    asked = t("orders").select(F.col("o_custkey").alias("source_file"), F.col("o_orderkey").alias("clip_id"))
    cache = t("orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("source_file"), F.col("o_orderkey").alias("clip_id"))
    hit, miss = catalog.cached_features(asked, cache, ["source_file", "clip_id"])
    return hit.withColumn("hit", F.lit(True)).unionByName(miss.withColumn("hit", F.lit(False)))


@query("""WITH w AS (SELECT l_orderkey AS source_file, l_linenumber AS clip_id, l_returnflag AS repr, bool_or(l_quantity > 2) AS here FROM lineitem GROUP BY ALL),
h AS (SELECT repr, source_file, bool_and(here) AS whole FROM w GROUP BY ALL) SELECT repr, count(*) FILTER (WHERE whole) AS n_hits, count(*) FILTER (WHERE NOT whole) AS n_misses FROM w JOIN h USING (repr, source_file) GROUP BY 1""")
def trajectory_cache(t):
    rows = t("lineitem").select(F.col("l_returnflag").alias("repr"), F.col("l_orderkey").alias("source_file"), F.col("l_linenumber").alias("clip_id"), (F.col("l_quantity") > 2).alias("here"))
    key = ["repr", "source_file", "clip_id"]
    hit, miss = catalog.cached_features(rows.select(*key).distinct(), rows.where("here").select(*key).distinct(), key)
    both = hit.withColumn("n", F.lit(1)).unionByName(miss.withColumn("n", F.lit(0)))
    return both.groupBy("repr").agg(F.count_if(F.col("n") == 1).alias("n_hits"), F.count_if(F.col("n") == 0).alias("n_misses"))


@query(f"""WITH {_CAT} SELECT source_file, CASE WHEN id % 3 = 0 THEN path WHEN id % 3 = 1 THEN 'in/' || source_file WHEN id % 2 = 0 THEN source_file END AS resolved FROM catalog""")
def resolved_paths(t):
    cat = paths(t).join(catalogued(t), "path")
    there = F.when(F.col("id") % 3 == 0, F.col("path")).when(F.col("id") % 3 == 1, F.concat(F.lit("in/"), "source_file")).when(F.col("id") % 2 == 0, F.col("source_file"))
    present = cat.select(there.alias("path")).where("path is not null")
    return catalog.resolved(cat.select("source_file", F.when(F.col("id") % 2 == 0, F.col("path")).when(F.col("id") % 3 == 0, F.col("path")).otherwise("NaN").alias("source_path")), present, "in/").select("source_file", "resolved")


@query(f"""WITH {_CAT} SELECT count(*) AS n_recordings, count(*) FILTER (WHERE id % 3 = 0) AS n_done, count(*) FILTER (WHERE id % 5 = 0) AS n_dropped, count(*) FILTER (WHERE id % 3 <> 0 AND id % 5 <> 0) AS n_open FROM catalog""")
def status_counts(t):
    cat = paths(t).join(catalogued(t), "path")
    return reports.status_counts(cat, cat.where("id % 3 = 0").select("rec_key"), cat.where("id % 5 = 0").select("rec_key"))


@query("SELECT 'data/' AS prefix")
def common_prefix(t):
    return names.common_prefix(paths(t).where("id % 4 < 2"))


@query(f"""WITH {_CAT} SELECT rec_key FROM catalog WHERE (date LIKE '202604%' OR date LIKE '20260611%') AND coalesce(hand, '') <> 'left'""")
def select_dates(t):
    kept = select.select_clips(catalogued(t), select.Selector(dates="202604, 20260611"))[0]
    return kept.where(F.coalesce("hand", F.lit("")) != "left").select("rec_key")


@query(f"WITH {_CAT} SELECT rec_key FROM catalog WHERE id IN (3, 4, 8)")
def select_recordings(t):
    wanted = ["x3.v2", "ab-0004__20260505-left__t4.npz", "ab-0008__20260909-left__t8"]
    return select.select_clips(catalogued(t), select.Selector(recordings=wanted))[0].select("rec_key")


@query(f"WITH {_CAT} SELECT rec_key, grp AS g0, coalesce(string_split(grp, '-')[-1], '') AS g1, 'all' AS g2, regexp_replace(source_file, '\\.npz$', '') AS bare FROM catalog")
def group_remap(t):
    by = {"g0": "subject-hand", "g1": "hand", "g2": "all"}
    return catalogued(t).select("rec_key", *[names.remap_group(F.col("grp"), how).alias(c) for c, how in by.items()], names.without_npz(F.col("source_file")).alias("bare"))


@query("SELECT c_custkey AS id, 'g' || (c_custkey % 23)::VARCHAR AS label, (c_custkey % 23)::BIGINT AS place FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 23 ORDER BY c_custkey) <= 3")
def gallery_order(t):
    k = F.col("c_custkey")
    rows = select.first_per(t("customer").select(k.alias("id"), F.concat(F.lit("g"), (k % 23).cast("string")).alias("label")), ["label"], [F.col("id")], 3)
    prefix, number = frames.natural_order(F.col("label"))
    return rows.select("id", "label", F.when(prefix == "g", number).alias("place"))


# Labels and runs.


def doc_recordings(t) -> DataFrame:
    return t("documents").select(F.col("source").alias("source_file"), F.concat(F.lit("d/"), "source").alias("source_path")).distinct()


@query(f"WITH {_ANN} SELECT 'clips' AS table_name, count(*) AS n_rows, count(DISTINCT source_file) AS n_recordings FROM clips UNION ALL SELECT 'annotations', count(*), count(DISTINCT source_file) FROM ann UNION ALL SELECT 'tombstones', count(*), count(DISTINCT source_file) FROM tomb")
def index_counts(t):
    return reports.index_counts({"clips": doc_clips(t), "annotations": doc_annotations(t), "tombstones": doc_tombstones(t)})


@query(f"WITH {_ANN} SELECT source_file, 'd/' || source_file AS source_path, clip_id, n_chars, seg_version FROM clips")
def dump_with_path(t):
    return sinks.with_path(doc_clips(t), doc_recordings(t))


_LIST = f"""{_ANN}, c AS (SELECT source_file, count(*) AS n_clips, count(*) FILTER (WHERE clip_id % 3 = 0) AS n_review FROM clips GROUP BY 1),
g AS (SELECT source_file, count(*) FILTER (WHERE scope = 'clip' AND kind = 'label') AS n_labeled, count(*) FILTER (WHERE scope = 'clip' AND kind = 'invalid') AS n_invalid, bool_or(scope = 'recording') AS rec_invalid FROM ann GROUP BY 1),
rl AS (SELECT 'd/' || c.source_file AS source_path, c.source_file, n_clips, n_review, n_labeled, n_invalid, rec_invalid, rec_invalid OR n_labeled + n_invalid >= n_clips AS done FROM c JOIN g USING (source_file))"""


def listed_recordings(t) -> DataFrame:
    clips = doc_clips(t).withColumns({"hand": F.lit("left"), "subject": F.lit("AB-1"), "group": F.lit("AB-1-left"), "matched_burst_idx": F.when(F.col("clip_id") % 3 == 0, -1).otherwise(0)})
    return labels.recording_list(clips, doc_recordings(t), doc_annotations(t))


@query(f"WITH {_LIST} SELECT * FROM rl")
def recording_list(t):
    return listed_recordings(t).drop("hand", "subject", "group")


@query(f"WITH {_LIST} SELECT source_file, n_review FROM rl WHERE NOT done AND source_file LIKE '%c1%'")
def recording_filter(t):
    return frames.filter_recordings(listed_recordings(t), "todo", "C1").select("source_file", "n_review")


@query(f"""WITH {_ANN} SELECT c.source_file, c.clip_id, 's' || row_number() OVER (PARTITION BY c.source_file ORDER BY c.n_chars, c.clip_id) AS name, a.value AS label, x.value IS NOT NULL AS invalid FROM clips c
LEFT JOIN ann a ON a.source_file = c.source_file AND a.clip_id = c.clip_id AND a.scope = 'clip' AND a.kind = 'label' LEFT JOIN ann x ON x.source_file = c.source_file AND x.clip_id = c.clip_id AND x.scope = 'clip' AND x.kind = 'invalid'""")
def numbered_clips(t):
    return frames.numbered_clips(doc_clips(t).withColumnRenamed("n_chars", "start_sample"), doc_annotations(t)).select("source_file", "clip_id", "name", "label", "invalid")


@query(f"""WITH {_ANN} SELECT c.source_file, c.clip_id, (c.clip_id % 4)::BIGINT AS cluster_id, a.value AS gesture_label, c.n_chars FROM clips c LEFT JOIN ann a ON a.source_file = c.source_file AND a.clip_id = c.clip_id AND a.scope = 'clip' AND a.kind = 'label'
WHERE c.clip_id % 2 = 0""")
def clusters_with_labels(t):
    clips = doc_clips(t)
    runs = F.when(F.col("clip_id") % 2 == 0, "r1").otherwise("r2")
    given = clips.select("source_file", "clip_id", runs.alias("run_id"), (F.col("clip_id") % 4).alias("cluster_id"))
    return labels.clusters_with_labels(given, doc_annotations(t), clips.drop("seg_version"), "r1").drop("run_id")


@query(f"WITH {_ANN} SELECT clip_id, 'r' || (clip_id % 5) AS run_id FROM clips WHERE clip_id % 5 NOT IN (1, 3)")
def drop_runs(t):
    given = doc_clips(t).select("clip_id", F.concat(F.lit("r"), (F.col("clip_id") % 5).cast("string")).alias("run_id"))
    return labels.drop_runs(given, given.where("clip_id % 5 in (1, 3)").select("run_id").distinct())


@query("""SELECT DISTINCT source AS source_file, (-1)::BIGINT AS clip_id, 'recording' AS scope, 'invalid' AS kind, '1' AS value, source NOT IN ('src1', 'src2') AS deleted FROM documents""")
def recording_changes(t):
    rows = t("documents").select(F.col("source").alias("source_file")).distinct()
    return labels.recording_changes(rows.withColumn("invalid", F.col("source_file").isin("src1", "src2")))


@query("SELECT l_shipdate::DATE::VARCHAR AS label, row_number() OVER (ORDER BY count(*) DESC, l_shipdate::DATE::VARCHAR) - 1 AS position FROM lineitem GROUP BY 1 ORDER BY 2 LIMIT 5")
def palette_fallback(t):
    ann = t("lineitem").select(F.lit("clip").alias("scope"), F.lit("label").alias("kind"), F.to_date("l_shipdate").cast("string").alias("value"))
    return select.palette_or_top({"labels": []}, ann, 5)


@query("SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal / 1000000 < 0.004")
def quality_passed(t):
    flag = F.when(F.col("c_mktsegment") == "BUILDING", "ok").otherwise("late")
    return select.quality_passed(t("customer").select(F.col("c_custkey").alias("id"), flag.alias("lag_flag"), (F.col("c_acctbal") / 1000000).alias("pose_nan_frac")), 0.004).select("id")


@query(f"""WITH {_REVIEW} SELECT source_path, clip_id, lower(regexp_replace(regexp_replace(source_path, '/[^/]*$', ''), '[^A-Za-z0-9._-]', '_', 'g')) AS place FROM o JOIN (SELECT id, path AS source_path FROM catalog) USING (id) WHERE matched < 0""")
def review_clips(t):
    o = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("clip_id"), F.col("o_orderstatus").alias("s")).where("s = 'O'")
    place = F.lower(F.regexp_replace(names.folder_of(F.col("path")), "[^A-Za-z0-9._-]", "_"))
    return o.join(paths(t), "id").select(F.col("path").alias("source_path"), "clip_id", place.alias("place"))


# Reports.


@query(f"""WITH {SIG}, {BURST}, a AS (SELECT rec, s, e, s + greatest(1, (e - s) // 2) AS motion_e, s + (rec + s) % (e - s) AS apex, CASE WHEN e - s > 4 THEN 'long' WHEN e - s < 3 THEN 'nohold' ELSE '' END AS review_flag FROM burst),
b AS (SELECT *, (e - motion_e) / 10.0::DOUBLE AS hold, lead(s) OVER (PARTITION BY rec ORDER BY s) AS nx FROM a)
SELECT count(*) AS n_actions, count(DISTINCT rec) AS n_recordings, round(median(hold), 6) AS hold_median_s, round(avg((hold >= 0.2)::INT), 6) AS held_share, round(avg((motion_e <= apex AND apex < e)::INT), 6) AS apex_in_hold_share,
  bool_and(coalesce(nx = e, true)) AS seamless, (SELECT string_agg(review_flag || '=' || n, ',' ORDER BY review_flag) FROM (SELECT review_flag, count(*) AS n FROM b GROUP BY 1)) AS flags FROM b""")
def diagnostics(t):
    n = F.col("e") - F.col("s")
    flag = F.when(n > 4, "long").when(n < 3, "nohold").otherwise("")
    actions = bursts(t).withColumns({"motion_e": F.col("s") + F.greatest(F.lit(1), F.floor(n / 2)), "apex": F.col("s") + (F.col("rec") + F.col("s")) % n, "review_flag": flag})
    out = reports.diagnostics(actions, 10.0, 0.2)
    return out.select("n_actions", "n_recordings", *[r(c) for c in ("hold_median_s", "held_share", "apex_in_hold_share")], "seamless", "flags")


@query(f"""WITH {SIG}, {BURST} SELECT b.rec, s, e, round(avg(k), 6) AS mean_speed, max(k) AS max_speed, round(sqrt(avg((v * v + k * k) / 2)), 6) AS emg_rms, [round(avg(v), 6), round(avg(k), 6)] AS mean_pose
FROM burst b JOIN sig x ON x.rec = b.rec AND x.i >= s AND x.i < e GROUP BY ALL""")
def segment_statistics(t):
    out = reports.segment_statistics(bursts(t), sig(t), ["v", "k"], ["v", "k"], "k")
    of = lambda x: scalars.rounded(x, 6)
    return out.select("rec", "s", "e", of(F.col("mean_speed")).alias("mean_speed"), "max_speed", of(F.col("emg_rms")).alias("emg_rms"), F.transform("mean_pose", of).alias("mean_pose"))


@query(f"""WITH {SIG}, d AS (SELECT i % 21 AS joint, sqrt((v - k) ** 2 + (k - i) ** 2) AS d FROM sig)
SELECT round(avg(d), 6) AS mean_error, round(median(d), 6) AS median_error, round(stddev_pop(d), 6) AS std_error, round(max(d), 6) AS max_error, round(avg(d) FILTER (WHERE joint IN (4, 8, 12, 16, 20)), 6) AS tip_mean,
  round(avg(d) FILTER (WHERE joint BETWEEN 1 AND 4), 6) AS finger_0, round(avg(d) FILTER (WHERE joint BETWEEN 17 AND 20), 6) AS finger_4 FROM d""")
def position_errors(t):
    x = sig(t).select((F.col("i") % 21).alias("joint"), F.col("v").alias("x0"), F.col("k").alias("x1"), F.col("k").alias("y0"), F.col("i").cast("double").alias("y1"), F.lit(0.0).alias("z0"), F.lit(0.0).alias("z1"))
    out = reports.position_errors(x, [4, 8, 12, 16, 20], F.when(F.col("joint") > 0, F.floor((F.col("joint") - 1) / 4)))
    means = [F.round(F.col("finger_means")[F.lit(f).cast("long")], 6).alias(f"finger_{f}") for f in (0, 4)]
    return out.select(*[r(c) for c in ("mean_error", "median_error", "std_error", "max_error", "tip_mean")], *means)


@query(f"""WITH {SIG}, d AS (SELECT degrees(abs(v / 100 - k / 100)) AS d FROM sig) SELECT round(avg(d), 6) AS mean_degrees, round(median(d), 6) AS median_degrees, round(stddev_pop(d), 6) AS std_degrees, round(max(d), 6) AS max_degrees FROM d""")
def angle_errors(t):
    out = reports.angle_errors(sig(t).select((F.col("v") / 100).alias("a"), (F.col("k") / 100).alias("b")))
    return out.select(*[r(f"{c}_degrees") for c in ("mean", "median", "std", "max")])


@query(f"WITH {SIG} SELECT rec, i, CASE WHEN rec % 2 = 0 THEN -v ELSE v END AS x, k AS y FROM sig")
def mirrored(t):
    x = sig(t).withColumns({"x": F.col("v"), "y": F.col("k"), "z": F.lit(0.0), "hand": F.when(F.col("rec") % 2 == 0, "Right").otherwise("left")})
    return reports.mirrored(x).select("rec", "i", "x", "y")


# Signals and vectors.


@query(f"""WITH {SIG}, a AS (SELECT rec, i, (i + (i % 3) * 0.25)::DOUBLE AS t, v, k FROM sig),
b AS (SELECT *, t - lag(t) OVER w AS dt, sqrt((v - lag(v) OVER w) ** 2 + (k - lag(k) OVER w) ** 2) AS step FROM a WINDOW w AS (PARTITION BY rec ORDER BY i)),
c AS (SELECT rec, i, coalesce(step / dt, 0) AS raw FROM b) SELECT rec, i, round(sum(raw) OVER (PARTITION BY rec ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS spd FROM c""")
def speed_by_time(t):
    x = sig(t).withColumn("t", F.col("i") + (F.col("i") % 3) * 0.25)
    return signal.speed_by_time(x, ["v", "k"], 5).select("rec", "i", r("spd"))


@query(f"""WITH {SIG}, m AS (SELECT rec, median(v) AS m, quantile_cont(v, 0.35) AS p FROM sig GROUP BY rec), t AS (SELECT rec, greatest(any_value(p), any_value(m) + 1.5 * 1.4826 * median(abs(v - m))) AS t FROM sig JOIN m USING (rec) GROUP BY rec)
SELECT rec, round(CASE WHEN t > 0 THEN t ELSE 7 END, 4) AS enter, round(CASE WHEN t > 0 THEN 0.5 * t ELSE 3 END, 4) AS "exit" FROM t""")
def move_thresholds(t):
    return signal.move_thresholds(sig(t), 35, 1.5, 0.5, (7.0, 3.0), "v").select("rec", r("enter", 4), r("exit", 4))


@query(f"WITH {SIG}, n AS (SELECT rec, count(*) AS n FROM sig GROUP BY rec) SELECT rec, greatest(2, ceil(n / 20))::INT AS step FROM n")
def frame_step(t):
    n = sig(t).groupBy("rec").agg(F.count("*").alias("n"))
    return n.select("rec", signal.frame_step(F.col("n"), 30.0, 15.0, 20).alias("step"))


@query(f"WITH {SIG}, {BURST} SELECT rec, s, e, [s, s + (e - s) // 3, (s + e) // 2, s + 2 * (e - s) // 3, e - 1] AS frames FROM burst")
def keyframes(t):
    middle = F.floor((F.col("s") + F.col("e")) / 2).cast("long")
    return bursts(t).select("rec", "s", "e", signal.keyframes(F.col("s"), middle, F.col("e")).alias("frames"))


@query(f"WITH {SIG}, m AS (SELECT rec, max(abs(k)) AS m FROM sig GROUP BY rec) SELECT rec, i, round(CASE WHEN m > 2 * pi() THEN radians(k) ELSE k END, 9) AS angle FROM sig JOIN m USING (rec)")
def degrees_to_radians(t):
    x = sig(t)
    largest = x.groupBy("rec").agg(F.max(F.abs("k")).alias("largest"))
    return x.join(largest, "rec").select("rec", "i", F.round(scalars.to_radians(F.col("k"), F.col("largest")), 9).alias("angle"))


@query("SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x, CASE WHEN event_id % 3 = 0 THEN '' ELSE trim(event_type) END AS label FROM events")
def cleaned_values(t):
    k = F.col("event_id")
    raw = F.when(k % 10 == 0, float("nan")).when(k % 5 == 0, float("inf")).otherwise(F.col("value"))
    label = scalars.clean_label(F.concat(F.lit(" "), "event_type"), k % 3 == 0)
    return t("events").select(k.alias("id"), scalars.number_or_null(raw).alias("x"), label.alias("label"))


@query("SELECT vec_id AS key FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 5 <> 0")
def finite_rows(t):
    bad = F.when(F.col("vec_id") % 7 == 0, float("nan")).when(F.col("vec_id") % 5 == 0, F.lit(None)).otherwise(0.0)
    return select.finite_rows(t("embeddings").withColumn("x", F.concat(F.col("embedding").cast("array<double>"), F.array(bad))), "x").select(F.col("vec_id").alias("key"))


_TRAJ = "x AS (SELECT vec_id AS key, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings), f AS (SELECT key, k, e[k * 16 + 1:k * 16 + 16] AS f FROM x, range(4) AS t(k))"


@query(f"""WITH {_TRAJ} SELECT a.key, a.k::INT AS frame, list_transform(list_zip(a.f, b.f), lambda p: round(p[1] - p[2], 6)) AS centred, CASE WHEN c.f IS NULL THEN NULL ELSE list_transform(list_zip(c.f, a.f), lambda p: round(p[1] - p[2], 6)) END AS velocity
FROM f a JOIN f b ON a.key = b.key AND b.k = 0 LEFT JOIN f c ON c.key = a.key AND c.k = a.k + 1""")
def trajectories(t):
    parts = F.array(*[F.slice(F.col("embedding").cast("array<double>"), 16 * k + 1, 16) for k in range(4)])
    rows = t("embeddings").select(F.col("vec_id").alias("key"), scalars.trajectory(parts, "centered").alias("c"), scalars.trajectory(parts, "velocity").alias("v"))
    rounded = lambda a: F.transform(a, lambda x: scalars.rounded(x, 6))
    return rows.select("key", F.posexplode("c").alias("frame", "f"), "v").select("key", "frame", rounded(F.col("f")).alias("centred"), rounded(F.get("v", F.col("frame"))).alias("velocity"))


@query("""WITH x AS (SELECT vec_id AS key, list_transform(embedding, lambda e: e::DOUBLE) AS e FROM embeddings), p AS (SELECT key, j, e[3 * j + 1] AS x, e[3 * j + 2] AS y, e[3 * j + 3] AS z FROM x, range(20) AS t(j)),
m AS (SELECT key, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p WHERE j IN (0, 5, 10, 15) GROUP BY key), l AS (SELECT key, max(x) - min(x) AS a, max(y) - min(y) AS b, max(z) - min(z) AS c, min(x) + max(x) AS cx FROM p GROUP BY key)
SELECT p.key, round(sum(abs(x - mx) + abs(y - my) + abs(z - mz)), 5) AS spread, round(any_value(cx / 2 - greatest(a, b, c) * 0.55), 6) AS x_low, round(any_value(cx / 2 + greatest(a, b, c) * 0.55), 6) AS x_high FROM p JOIN m USING (key) JOIN l USING (key) GROUP BY p.key""")
def skeleton_view(t):
    e = F.col("embedding").cast("array<double>")
    points = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda j: F.slice(e, 3 * j + 1, F.lit(3)))
    axis = lambda p, k: F.transform(p, lambda q: F.get(q, k))
    rows = t("embeddings").select(F.col("vec_id").alias("key"), points.alias("p")).withColumn("c", scalars.centred(F.col("p"), [0, 5, 10, 15]))
    spread = F.aggregate("c", F.lit(0.0), lambda a, q: a + F.aggregate(q, F.lit(0.0), lambda b, v: b + F.abs(v)))
    x = F.get(scalars.cube_limits(*[axis(F.col("p"), k) for k in range(3)]), 0)
    return rows.select("key", F.round(spread, 5).alias("spread"), F.round(x["low"], 6).alias("x_low"), F.round(x["high"], 6).alias("x_high"))


@query(f"""WITH {_FEAT}, f AS (SELECT feat.*, key % 5 AS subject FROM feat), s AS (SELECT dim, subject, avg(x) AS m FROM f GROUP BY 1, 2) SELECT key, dim::INT AS dim, round(x - m, 5) AS z FROM f JOIN s USING (dim, subject)""")
def subject_centred(t):
    return score.subject_normalised(features(t).withColumn("subject", F.col("key") % 5), "center").select("key", "dim", r("z", 5))


@query(f"""WITH {_FEAT}, c AS (SELECT key, dim, x, avg(x) OVER (PARTITION BY dim) AS m, stddev_pop(x) OVER (PARTITION BY dim) AS d FROM feat), z AS (SELECT key, list(round((x - m) / d * sqrt(dim % 3), 5) + 0.0 ORDER BY dim) AS z FROM c GROUP BY key) SELECT * FROM z""")
def weighted_vectors(t):
    rows = t("embeddings").select(F.col("vec_id").alias("key"), "embedding")
    out = learn.zscored_vectors(rows, weights=[float(k % 3) for k in range(64)])
    return out.select("key", F.transform("z", lambda x: F.round(x, 5) + F.lit(0.0)).alias("z"))


@query("""WITH a AS (SELECT vec_id AS key, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::BIGINT AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.key, a.cluster, b.cluster AS c2, avg(list_distance(a.v, b.v)) AS d FROM a JOIN a b ON a.key <> b.key GROUP BY ALL),
p AS (SELECT key, cluster, max(d) FILTER (WHERE c2 = cluster) AS a, min(d) FILTER (WHERE c2 <> cluster) AS b FROM d GROUP BY 1, 2)
SELECT cluster, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS mean_silhouette, count(*) AS n FROM p GROUP BY 1""")
def silhouette_means(t):
    return score.silhouette_means(score.silhouette(assigned(t))).select("cluster", r("mean_silhouette", 5), "n")


@query(f"""WITH {SIG}, {BURST}, act AS (SELECT rec, s, e FROM burst) SELECT b.rec, b.s AS anchor, coalesce(bool_or(x.v < 20.0), false) AS rest FROM act b LEFT JOIN sig x ON x.rec = b.rec AND x.i BETWEEN b.e AND b.e + 3 GROUP BY 1, 2, b.e""")
def rest_after(t):
    at = bursts(t).select("rec", "s", F.col("e").alias("idx"))
    return intervals.rest_near(at, sig(t), F.lit(20.0), 4, False).select("rec", F.col("s").alias("anchor"), "rest")


@query(f"""WITH {SIG}, {BURST}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s) AS number FROM burst) SELECT rec, s, e, 's' || number AS name, (SELECT max(v) FROM sig x WHERE x.rec = n.rec AND x.i >= n.s AND x.i < n.e) AS peak FROM n""")
def recording_view(t):
    """The segments of a recording's view, numbered, with what its curves reach in them."""
    b = bursts(t).withColumn("name", F.concat(F.lit("s"), F.row_number().over(Window.partitionBy("rec").orderBy("s")).cast("string")))
    return intervals.samples_in(b, sig(t), {"v": F.col("v")}).groupBy("rec", "s", "e", "name").agg(F.max("v").alias("peak"))


@query()
def apex_clusters(t):
    v = t("embeddings").select(F.col("vec_id").alias("key"), (F.col("vec_id") % 3).alias("grp"), (F.col("vec_id") % 5).alias("subject"), F.col("embedding").cast("array<double>").alias("embedding"))
    return learn.apex_clusters(v, 3, 3)


@query()
def trajectory_clusters(t):
    v = t("embeddings").select(F.col("vec_id").alias("key"), (F.col("vec_id") % 2).alias("grp"), F.col("embedding").cast("array<double>").alias("embedding"))
    return learn.grouped_trajectory_clusters(v, 4, 10)
