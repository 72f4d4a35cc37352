"""Queries on names, labels, runs and scores over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions import names
from tremorlake.operators import intervals, labels, learn, score, select
from tremorlake.plans.registry import query
from tremorlake.sources import catalog, sinks

# Recordings: one a customer, named by the layouts in turn.

_PATHS = """paths AS (
  SELECT c_custkey AS id, CASE c_custkey % 4
    WHEN 0 THEN 'data/ab-' || lpad((c_custkey % 37)::VARCHAR, 4, '0') || '__2026' || lpad((c_custkey % 12 + 1)::VARCHAR, 2, '0') || lpad((c_custkey % 28 + 1)::VARCHAR, 2, '0') || '-left__t' || c_custkey || '.npz'
    WHEN 1 THEN 'data/cd-' || lpad((c_custkey % 37)::VARCHAR, 4, '0') || '/20260' || (c_custkey % 9 + 1) || '15-Right-2/t' || c_custkey || '.npz'
    WHEN 2 THEN 'pool/efg' || lpad((c_custkey % 37)::VARCHAR, 4, '0') || '_0502_both/20260611' || c_custkey || '.npz'
    ELSE 'other/force_data/x' || c_custkey || '.v2.npz' END AS path FROM customer)"""


def paths(t) -> DataFrame:
    k = F.col("c_custkey")
    two = lambda c, n=2: F.lpad(c.cast("string"), n, "0")
    own = k.cast("string")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("data/ab-"), two(k % 37, 4), F.lit("__2026"), two(k % 12 + 1), two(k % 28 + 1), F.lit("-left__t"), own, F.lit(".npz")))
        .when(k % 4 == 1, F.concat(F.lit("data/cd-"), two(k % 37, 4), F.lit("/20260"), (k % 9 + 1).cast("string"), F.lit("15-Right-2/t"), own, F.lit(".npz")))
        .when(k % 4 == 2, F.concat(F.lit("pool/efg"), two(k % 37, 4), F.lit("_0502_both/20260611"), own, F.lit(".npz")))
        .otherwise(F.concat(F.lit("other/force_data/x"), own, F.lit(".v2.npz")))
    )
    return t("customer").select(k.alias("id"), path.alias("path"))


_CAT = f"""{_PATHS}, f AS (SELECT *, regexp_replace(string_split(path, '/')[-1], '\\.npz$', '') AS file, string_split(path, '/')[-2] AS folder, string_split(path, '/')[-3] AS above FROM paths),
cat AS (
  SELECT id, path, CASE id % 4 WHEN 0 THEN file WHEN 1 THEN above || '__' || folder || '__' || file WHEN 2 THEN 'efg-' || substr(folder, 4, 4) || '__' || folder || '__' || file ELSE file END AS stem,
    CASE id % 4 WHEN 0 THEN string_split(file, '__')[1] WHEN 1 THEN above WHEN 2 THEN 'efg-' || substr(folder, 4, 4) END AS subject,
    CASE id % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'both' END AS hand,
    CASE id % 4 WHEN 0 THEN substr(string_split(file, '__')[2], 1, 8) WHEN 1 THEN substr(folder, 1, 8) WHEN 2 THEN '20260611' ELSE '' END AS date, id % 4 < 3 AS parsed FROM f),
catalog AS (SELECT *, CASE WHEN parsed THEN subject || '-' || hand ELSE stem END AS grp, stem || '.npz' AS source_file, stem || '.npz#' || coalesce(hand, '') AS rec_key FROM cat)"""


def catalogued(t) -> DataFrame:
    return catalog.with_names(paths(t).select("path"))


@query(f"WITH {_CAT} SELECT path, stem, subject, hand, grp, date, parsed, source_file, rec_key FROM catalog")
def name_parse(t):
    return catalogued(t)


@query(f"WITH {_CAT} SELECT path, regexp_replace(lower(coalesce(subject, '')), '[^a-z0-9]', '', 'g') AS subject_norm FROM catalog")
def subject_normalise(t):
    return catalogued(t).select("path", names.normalise_subject(F.col("subject")).alias("subject_norm"))


_SELECTED = f"""{_CAT}, sel AS (SELECT * FROM catalog WHERE regexp_replace(lower(coalesce(subject, '')), '[^a-z0-9]', '', 'g') IN ('ab0004', 'ab0012', 'cd0009', 'efg0010')
  AND date <> '' AND date BETWEEN '20260201' AND '20261031')"""
SELECTOR = select.Selector(subjects="ab-0004, AB0012,cd-0009,efg0010", date_from="20260201", date_to="20261031")


@query(f"WITH {_SELECTED} SELECT rec_key, subject, hand, date FROM sel")
def select_subset(t):
    return select.select_clips(catalogued(t), SELECTOR)[0].select("rec_key", "subject", "hand", "date")


@query(f"WITH {_CAT} SELECT rec_key FROM catalog WHERE string_split(stem, '__')[2] LIKE '202604%' AND lower(hand) = 'right' AND len(string_split(stem, '__')) >= 3")
def select_sessions(t):
    return select.select_clips(catalogued(t), select.Selector(sessions="202604", hand="RIGHT"))[0].select("rec_key")


@query(f"""WITH {_CAT} SELECT count(*) AS n_clips, count(DISTINCT source_file) AS n_recordings, count(DISTINCT regexp_replace(lower(subject), '[^a-z0-9]', '', 'g')) AS n_subjects,
  list_sort(list(DISTINCT string_split(stem, '__')[2]) FILTER (WHERE len(string_split(stem, '__')) >= 3)) AS sessions, min(date) FILTER (WHERE date <> '') AS date_min, max(date) FILTER (WHERE date <> '') AS date_max FROM catalog""")
def scope_summary(t):
    return select.scope_summary(catalogued(t))


@query(f"WITH {_CAT} SELECT rec_key FROM catalog WHERE NOT contains(lower(path), '/force_data/') AND id % 5 <> 0 AND id % 3 <> 0")
def to_process(t):
    cat = select.without_paths(catalogued(t))
    number = F.regexp_extract("path", r"t?(\d+)(?:\.v2)?\.npz$", 1).cast("long")
    key = F.when(cat["path"].startswith("pool"), F.regexp_extract("path", r"20260611(\d+)\.npz$", 1).cast("long")).otherwise(number)
    keyed = cat.withColumn("id", key)
    return select.to_process(keyed, keyed.where("id % 5 = 0").select("rec_key"), keyed.where("id % 3 = 0").select("rec_key")).select("rec_key")


_META = "(SELECT c_custkey, 'd/s' || c_custkey || '.npz' AS sample_path, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'ab-' || c_custkey % 9 END AS subject_id, CASE c_custkey % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'Left' WHEN 2 THEN 'right' ELSE 'x' END AS side FROM customer)"


@query(f"""WITH m AS {_META}, e AS (SELECT sample_path AS path, 's' || c_custkey AS stem, nullif(subject_id, '') AS subject, unnest(CASE lower(side) WHEN 'both' THEN ['left', 'right'] WHEN 'left' THEN ['left'] WHEN 'right' THEN ['right'] ELSE [NULL] END) AS hand FROM m)
SELECT path, stem, subject, hand, CASE WHEN subject IS NOT NULL AND hand IS NOT NULL THEN subject || '-' || hand ELSE stem END AS grp FROM e""")
def catalog_expand(t):
    k = F.col("c_custkey")
    rows = t("customer").select(
        F.concat(F.lit("d/s"), k.cast("string"), F.lit(".npz")).alias("sample_path"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("ab-"), (k % 9).cast("string"))).alias("subject_id"),
        F.when(k % 4 == 0, "both").when(k % 4 == 1, "Left").when(k % 4 == 2, "right").otherwise("x").alias("side"),
    )
    return catalog.from_table(rows).select("path", "stem", "subject", "hand", "grp")


@query(f"WITH {_CAT} SELECT path, lpad(id::VARCHAR, 4, '0') AS number, stem || '__c' || lpad((id % 10)::VARCHAR, 4, '0') AS clip_key, CASE WHEN lower(grp) LIKE '%right%' THEN 'right' WHEN lower(grp) LIKE '%left%' THEN 'left' ELSE 'left' END AS side, coalesce(string_split(grp, '-')[-1], '') AS hand_group FROM catalog")
def clip_names(t):
    keyed = paths(t).withColumn("__n", names.parse_path(F.col("path"))).select("id", "path", "__n.*")
    return keyed.select(
        "path", F.lpad(F.col("id").cast("string"), 4, "0").alias("number"), names.clip_key(F.col("stem"), F.col("id") % 10).alias("clip_key"),
        names.side_of(F.lit(None).cast("string"), F.col("grp")).alias("side"), names.group_hand(F.col("grp")).alias("hand_group"),
    )


# Labels: clips are documents, recordings their sources; quality labels them, toxic ones are invalid.

_ANN = """clips AS (SELECT source AS source_file, doc_id AS clip_id, n_chars, CASE WHEN doc_id % 10 = 0 THEN 'v2' ELSE 'v1' END AS seg_version FROM documents),
ann AS (
  SELECT source AS source_file, doc_id AS clip_id, 'clip' AS scope, 'label' AS kind, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS value, 'v1' AS seg_version FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT source, doc_id, 'clip', 'invalid', '1', 'v1' FROM labels JOIN documents USING (doc_id) WHERE toxic = 1
  UNION ALL SELECT DISTINCT source, -1, 'recording', 'invalid', '1', 'v1' FROM documents WHERE source IN ('src3', 'src5')),
tomb AS (SELECT DISTINCT source AS source_file FROM documents WHERE source IN ('src5', 'src9')),
excl AS (SELECT source_file FROM ann WHERE scope = 'recording' AND kind = 'invalid' UNION SELECT source_file FROM tomb)"""


def doc_clips(t) -> DataFrame:
    d = t("documents")
    return d.select(F.col("source").alias("source_file"), F.col("doc_id").alias("clip_id"), "n_chars", F.when(d.doc_id % 10 == 0, "v2").otherwise("v1").alias("seg_version"))


def doc_annotations(t) -> DataFrame:
    d = t("documents").select("doc_id", "source")
    own = t("labels").join(d, "doc_id")
    row = lambda df, clip, scope, kind, value: df.select(F.col("source").alias("source_file"), clip.cast("long").alias("clip_id"), F.lit(scope).alias("scope"), F.lit(kind).alias("kind"), value.alias("value"), F.lit("v1").alias("seg_version"))
    given = row(own, F.col("doc_id"), "clip", "label", F.when(F.col("quality") == 1, "good").otherwise("poor"))
    toxic = row(own.where("toxic = 1"), F.col("doc_id"), "clip", "invalid", F.lit("1"))
    whole = row(d.where(F.col("source").isin("src3", "src5")).select("source").distinct(), F.lit(-1), "recording", "invalid", F.lit("1"))
    return given.unionByName(toxic).unionByName(whole)


def doc_tombstones(t) -> DataFrame:
    return t("documents").where(F.col("source").isin("src5", "src9")).select(F.col("source").alias("source_file")).distinct()


@query(f"""WITH {_ANN} SELECT c.*, CASE WHEN c.seg_version = a.seg_version THEN a.value END AS gesture_label FROM clips c LEFT JOIN ann a ON a.source_file = c.source_file AND a.clip_id = c.clip_id AND a.scope = 'clip' AND a.kind = 'label'
WHERE c.source_file NOT IN (SELECT source_file FROM excl) AND NOT EXISTS (SELECT 1 FROM ann x WHERE x.source_file = c.source_file AND x.clip_id = c.clip_id AND x.scope = 'clip' AND x.kind = 'invalid')""")
def labelled_view(t):
    return labels.labelled_view(doc_clips(t), doc_annotations(t), doc_tombstones(t))


@query(f"WITH {_ANN} SELECT * FROM excl")
def excluded_entities(t):
    return labels.excluded_recordings(doc_annotations(t), doc_tombstones(t))


@query(f"""WITH {_ANN} SELECT r.source_file, count(*) FILTER (WHERE a.scope = 'clip' AND kind = 'label') AS n_labeled, count(*) FILTER (WHERE a.scope = 'clip' AND kind = 'invalid') AS n_invalid,
  coalesce(bool_or(a.scope = 'recording'), false) AS rec_invalid FROM (SELECT DISTINCT source_file FROM clips) r LEFT JOIN ann a USING (source_file) GROUP BY 1""")
def label_progress(t):
    return labels.progress(doc_clips(t).select("source_file").distinct(), doc_annotations(t))


@query("SELECT l_shipdate::DATE::VARCHAR AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def label_top20(t):
    ann = t("lineitem").select(F.lit("clip").alias("scope"), F.lit("label").alias("kind"), F.to_date("l_shipdate").cast("string").alias("value"))
    return labels.top_labels(ann)


@query(f"""WITH {_ANN} SELECT (SELECT count(*) FROM clips) AS n_clips, count(*) FILTER (WHERE scope = 'clip' AND kind = 'label') AS n_labeled, count(*) FILTER (WHERE scope = 'clip' AND kind = 'invalid') AS n_invalid,
  count(*) FILTER (WHERE scope = 'recording') AS n_rec_invalid, list_sort(list(DISTINCT value) FILTER (WHERE scope = 'clip' AND kind = 'label')) AS labels FROM ann""")
def library_totals(t):
    return labels.library_totals(doc_clips(t), doc_annotations(t))


_LOG = "log AS (SELECT o_custkey AS clip_id, o_orderpriority AS value, o_orderstatus = 'F' AS deleted, o_orderdate AS made_at, o_orderkey FROM orders)"


@query(f"WITH {_LOG} SELECT clip_id, value FROM log QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY made_at DESC, o_orderkey DESC) = 1 AND NOT deleted")
def annotation_latest(t):
    o = t("orders")
    log = o.select(o.o_custkey.alias("clip_id"), o.o_orderpriority.alias("value"), (o.o_orderstatus == "F").alias("deleted"), o.o_orderdate.alias("made_at"), "o_orderkey")
    return labels.latest(log, ["clip_id"], ["made_at", "o_orderkey"], "deleted").select("clip_id", "value")


@query("""WITH c AS (SELECT doc_id AS clip_id, source AS source_file, CASE WHEN quality = 1 THEN ' good ' END AS label, toxic = 1 AS invalid FROM labels JOIN documents USING (doc_id))
SELECT source_file, clip_id, 'clip' AS scope, 'label' AS kind, trim(coalesce(label, '')) AS value, invalid OR label IS NULL AS deleted FROM c
UNION ALL SELECT source_file, clip_id, 'clip', 'invalid', '1', NOT invalid FROM c""")
def annotation_changes(t):
    own = t("labels").join(t("documents").select("doc_id", "source"), "doc_id")
    rows = own.select(F.col("source").alias("source_file"), F.col("doc_id").alias("clip_id"), F.when(F.col("quality") == 1, " good ").alias("value"), (F.col("toxic") == 1).alias("invalid"))
    return labels.annotation_changes(rows)


@query(f"WITH {_ANN} SELECT c.* FROM clips c WHERE source_file NOT IN ('src1', 'src2')")
def drop_recording(t):
    gone = t("documents").where(F.col("source").isin("src1", "src2")).select(F.col("source").alias("source_file"), F.lit("20260101").alias("dropped_at"), F.lit("").alias("note")).distinct()
    return labels.drop_recording({"clips": doc_clips(t)}, gone.limit(0), gone)["clips"]


@query(f"WITH {_ANN} SELECT source_file, clip_id, n_chars, seg_version FROM clips WHERE source_file <> 'src4' UNION ALL SELECT source_file, clip_id + 1000000, n_chars, 'v3' FROM clips WHERE source_file = 'src4'")
def replace_recordings(t):
    clips = doc_clips(t)
    new = clips.where("source_file = 'src4'").withColumn("clip_id", F.col("clip_id") + 1000000).withColumn("seg_version", F.lit("v3"))
    return labels.replace_recordings(clips, new)


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderkey % 3 <> 0")
def orphan_runs(t):
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"))
    return labels.orphan_runs(runs.where("run_id % 2 = 0"), runs, runs.where("run_id % 3 = 0"))


@query("SELECT o_orderkey AS run_id, o_orderdate AS created_at, o_orderpriority AS channel FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_run(t):
    o = t("orders")
    return labels.latest_run(o.select(o.o_orderkey.alias("run_id"), o.o_orderdate.alias("created_at"), o.o_orderpriority.alias("channel")), "1-URGENT")


@query("""SELECT n_nationkey::VARCHAR AS run_id, lpad(n_nationkey::VARCHAR, 3, '0') AS created_at, 'apex/centered/zscore' AS method, n_nationkey::BIGINT * 10 AS n_clips,
  CASE WHEN n_regionkey = 2 THEN '20260101' ELSE '20260101-2026020' || n_regionkey END AS dates, n_regionkey / 10.0 AS ari, NULL::DOUBLE AS nmi, 0.5::DOUBLE AS purity FROM nation""")
def run_table(t):
    k, g = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    last = F.when(g == "2", "20260101").otherwise(F.concat(F.lit("2026020"), g))
    resolved = F.struct((k * 10).alias("n_clips"), F.lit("20260101").alias("date_min"), last.alias("date_max"))
    params = F.to_json(F.struct(F.lit("centered").alias("repr"), F.lit("zscore").alias("subject_norm"), F.struct(resolved.alias("resolved")).alias("scope")))
    runs = t("nation").select(k.cast("string").alias("run_id"), F.lpad(k.cast("string"), 3, "0").alias("created_at"), F.lit("apex").alias("channel"), params.alias("params_json"))
    scores = F.to_json(F.struct(F.struct((F.col("n_regionkey") / 10).alias("ari"), F.lit(0.5).alias("purity")).alias("label_driven")))
    return labels.run_table(runs, t("nation").select(k.cast("string").alias("run_id"), scores.alias("metrics_json")))


@query("""SELECT conv_id, turn, role FROM conversations WHERE role <> 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1""")
def next_untriaged(t):
    c = t("conversations").withColumn("label", F.when(F.col("role") == "assistant", "x")).withColumn("invalid", F.lit(False))
    return labels.next_untriaged(c, ["turn", "role", "text"], ["conv_id"]).select("conv_id", "turn", "role")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def first_per_folder(t):
    return select.first_per(t("orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("""WITH l AS (SELECT trim(' ' || o_orderpriority || ' ') AS label, o_orderkey AS position FROM orders) SELECT label, min(position) AS position FROM l GROUP BY 1 ORDER BY 2 LIMIT 3""")
def palette(t):
    o = t("orders")
    return select.palette(o.select(F.concat(F.lit(" "), o.o_orderpriority, F.lit(" ")).alias("label"), o.o_orderkey.alias("position")), 3)


_REVIEW = f"""{_CAT}, o AS (SELECT o_custkey AS id, o_orderkey AS clip_id, CASE WHEN o_orderstatus = 'O' THEN -1 ELSE 1 END AS matched FROM orders),
rv AS (SELECT path AS source_path, first(source_file ORDER BY clip_id) AS source_file, first(hand ORDER BY clip_id) AS hand, first(subject ORDER BY clip_id) AS subject, first(grp ORDER BY clip_id) AS "group",
  count(*) AS n_clips, count(*) FILTER (WHERE matched < 0) AS n_review FROM o JOIN catalog USING (id) GROUP BY path)"""


def reviewed(t) -> DataFrame:
    o = t("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("clip_id"), F.when(F.col("o_orderstatus") == "O", -1).otherwise(1).alias("matched_burst_idx"))
    cat = catalogued(t).select("path", "source_file", "hand", "subject", F.col("grp").alias("group"))
    own = paths(t).join(cat, "path").withColumnRenamed("path", "source_path")
    return labels.review_counts(o.join(own, "id"))


@query(f"WITH {_REVIEW} SELECT * FROM rv")
def review_counts(t):
    return reviewed(t)


@query(f"""WITH {_REVIEW} SELECT regexp_replace(source_path, '/[^/]*$', '') AS folder, count(*) AS n_recordings, sum(n_review)::BIGINT AS n_labeled, 0::BIGINT AS n_invalid, sum(n_review)::BIGINT AS n_review, bool_and(n_review >= n_clips) AS all_done FROM rv GROUP BY 1""")
def folder_rollup(t):
    rows = reviewed(t).withColumn("n_labeled", F.col("n_review")).withColumn("n_invalid", F.lit(0)).withColumn("rec_invalid", F.lit(False))
    return labels.folder_rollup(rows, names.folder_of(F.col("source_path")))


@query(f"""WITH {_CAT}, n AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS folder, regexp_replace(concat_ws('__', above, folder), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM (SELECT path, coalesce(folder, '') AS folder, above FROM f)),
d AS (SELECT folder, name, row_number() OVER (PARTITION BY name ORDER BY folder) - 1 AS k FROM (SELECT DISTINCT folder, name FROM n))
SELECT n.path AS source_path, CASE WHEN k > 0 THEN d.name || '_' || k ELSE d.name END AS folder_name FROM n JOIN d USING (folder)""")
def label_export(t):
    return sinks.label_export(paths(t).select(F.col("path").alias("source_path")))


_IVL = """ivl AS (SELECT o_custkey AS rec, o_orderkey AS id, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS s, datediff('day', DATE '1990-01-01', max(l_shipdate)::DATE) + 1 AS e
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderdate HAVING max(l_shipdate) >= o_orderdate)"""


def order_intervals(t) -> DataFrame:
    last = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    day = lambda c: F.datediff(F.to_date(c), F.lit("1990-01-01").cast("date")).cast("long")
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderdate").join(last, "o_orderkey").where("last >= o_orderdate")
    return o.select(F.col("o_custkey").alias("rec"), F.col("o_orderkey").alias("id"), day("o_orderdate").alias("s"), (day("last") + 1).alias("e"))


@query(f"""WITH {_IVL}, sh AS (SELECT rec, id + 1 AS new_id, s + 2 AS s, e + CASE WHEN id % 3 = 0 THEN 60 ELSE 2 END AS e FROM ivl WHERE id % 7 <> 0),
p AS (SELECT a.rec, a.id AS old_id, b.new_id, round((least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)), 9) AS iou FROM ivl a JOIN sh b ON a.rec = b.rec AND a.s < b.e AND b.s < a.e),
b AS (SELECT rec, old_id, first(new_id ORDER BY iou DESC, new_id) AS new_id, max(iou) AS iou FROM p GROUP BY 1, 2),
o AS (SELECT i.rec, i.id AS old_id, CASE WHEN iou >= 0.5 THEN new_id END AS new_id, coalesce(iou, 0) AS iou FROM ivl i LEFT JOIN b ON b.rec = i.rec AND b.old_id = i.id),
k AS (SELECT *, row_number() OVER (PARTITION BY rec, new_id ORDER BY iou DESC, old_id) AS rk FROM o)
SELECT rec, old_id, new_id, iou, CASE WHEN new_id IS NULL THEN 'lost' WHEN rk > 1 THEN 'collision' WHEN new_id = old_id THEN 'unchanged' ELSE 'moved' END AS status FROM k""")
def iou_remap(t):
    old = order_intervals(t)
    new = old.where("id % 7 <> 0").select("rec", (F.col("id") + 1).alias("new_id"), (F.col("s") + 2).alias("s"), (F.col("e") + F.when(F.col("id") % 3 == 0, 60).otherwise(2)).alias("e"))
    return intervals.iou_remap(old.withColumnRenamed("id", "old_id"), new, width=128)


@query(f"""WITH {_IVL} SELECT a.rec, a.id, count(b.id) AS n_overlaps FROM ivl a LEFT JOIN ivl b ON a.rec = b.rec AND a.s < b.e AND b.s < a.e GROUP BY 1, 2""")
def order_overlaps(t):
    x = order_intervals(t)
    return intervals.overlap_counts(x, x.select("rec", "s", "e"), "id")


# Scores: features are embeddings, clusters the largest of their first ten dimensions.

_FEAT = """feat AS (SELECT vec_id AS key, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
assign AS (SELECT vec_id AS key, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::BIGINT AS cluster, label, vec_id % 5 AS subject FROM embeddings)"""


def assigned(t) -> DataFrame:
    first = F.slice("embedding", 1, 10)
    return t("embeddings").select(F.col("vec_id").alias("key"), (F.array_position(first, F.array_max(first)) - 1).alias("cluster"), "label", (F.col("vec_id") % 5).alias("subject"), "embedding")


def features(t) -> DataFrame:
    return score.features_view(t("embeddings"))


def assignment(t) -> DataFrame:
    return assigned(t).select("key", "cluster")


def r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query(f"WITH {_FEAT}, s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM feat GROUP BY dim) SELECT key, dim::INT AS dim, round((x - m) / CASE WHEN d < 1e-12 THEN 1 ELSE d END, 5) AS z FROM feat JOIN s USING (dim)")
def zscore_features(t):
    return score.standardised(features(t)).select("key", "dim", r("z", 5))


@query(f"""WITH {_FEAT}, f AS (SELECT feat.*, key % 5 AS subject FROM feat), s AS (SELECT dim, subject, avg(x) AS m, stddev_pop(x) AS d FROM f GROUP BY 1, 2)
SELECT key, dim::INT AS dim, round((x - m) / CASE WHEN d < 1e-12 THEN 1 ELSE d END, 5) AS z FROM f JOIN s USING (dim, subject)""")
def per_subject_norm(t):
    return score.standardised(features(t).withColumn("subject", F.col("key") % 5), ["subject"]).select("key", "dim", r("z", 5))


@query(f"WITH {_FEAT} SELECT cluster, dim::INT AS dim, round(avg(x), 5) AS centre, count(*) AS n FROM feat JOIN assign USING (key) GROUP BY 1, 2")
def centroids(t):
    return score.centroids(features(t), assignment(t)).select("cluster", "dim", r("centre", 5), "n")


@query(f"""WITH {_FEAT}, c AS (SELECT cluster, dim, avg(x) AS m FROM feat JOIN assign USING (key) GROUP BY 1, 2),
d AS (SELECT cluster, key, round(sqrt(sum((x - m) ** 2)), 9) AS d FROM feat JOIN assign USING (key) JOIN c USING (cluster, dim) GROUP BY 1, 2)
SELECT cluster, first(key ORDER BY d, key) AS medoid, round(min(d), 5) AS distance, count(*) AS size FROM d GROUP BY 1""")
def medoids(t):
    return score.medoids(features(t), assignment(t)).select("cluster", "medoid", r("distance", 5), "size")


_TABLE = f"{_FEAT}, n AS (SELECT cluster AS c, label AS y, count(*)::DOUBLE AS n FROM assign GROUP BY 1, 2)"


@query(f"WITH {_TABLE} SELECT round(sum(top) / sum(n), 6) AS purity FROM (SELECT max(n) AS top, sum(n) AS n FROM n GROUP BY c)")
def purity(t):
    return score.purity(assigned(t)).select(r("purity"))


_ARI = f"""{_TABLE}, a AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS b, (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM n GROUP BY c)) AS sc,
  (SELECT sum(s * (s - 1) / 2) FROM (SELECT sum(n) AS s FROM n GROUP BY y)) AS sy, (SELECT sum(n) FROM n) AS t)"""


@query(f"WITH {_ARI} SELECT round((b - sc * sy / (t * (t - 1) / 2)) / ((sc + sy) / 2 - sc * sy / (t * (t - 1) / 2)), 6) AS ari FROM a")
def adjusted_rand(t):
    return score.adjusted_rand(assigned(t)).select(r("ari"))


_NMI = f"""{_TABLE}, w AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY c) AS nc, sum(n) OVER (PARTITION BY y) AS ny FROM n)"""


@query(f"WITH {_NMI} SELECT round(sum(n / t * ln(n * t / (nc * ny))) / ((sum(-n / t * ln(nc / t)) + sum(-n / t * ln(ny / t))) / 2), 6) AS nmi FROM w")
def normalised_mi(t):
    return score.normalised_mi(assigned(t)).select(r("nmi"))


@query(f"""WITH {_FEAT}, p AS (SELECT cluster, max(n) / sum(n) AS share FROM (SELECT cluster, subject, count(*) AS n FROM assign GROUP BY 1, 2) GROUP BY 1)
SELECT round(avg(share), 6) AS mean_share, count(*) FILTER (WHERE share > 0.5) AS n_over_50, count(*) FILTER (WHERE share > 0.77) AS n_over_77 FROM p""")
def contamination(t):
    return score.contamination(assigned(t)).select(r("mean_share"), "n_over_50", "n_over_77")


@query("""WITH a AS (SELECT vec_id AS key, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::BIGINT AS cluster, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
d AS (SELECT a.key, a.cluster, b.cluster AS c2, avg(list_distance(a.v, b.v)) AS d FROM a JOIN a b ON a.key <> b.key GROUP BY ALL),
p AS (SELECT key, cluster, max(d) FILTER (WHERE c2 = cluster) AS a, min(d) FILTER (WHERE c2 <> cluster) AS b FROM d GROUP BY 1, 2)
SELECT key, cluster, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 5) AS silhouette FROM p""")
def silhouette_exact(t):
    return score.silhouette(assigned(t)).select("key", "cluster", r("silhouette", 5))


@query(f"WITH {_FEAT} SELECT key, subject, cluster, dense_rank() OVER (ORDER BY subject, cluster) - 1 AS cluster_id FROM assign")
def global_cluster_ids(t):
    return score.global_ids(assigned(t).select("key", "subject", "cluster"), "subject", "cluster").select("key", "subject", "cluster", "cluster_id")


def vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("key"), (F.col("vec_id") % 5).alias("subject"), "embedding")


@query()
def kmeans_scan(t):
    k, out = learn.kmeans_scan(vectors(t), 9, 11)
    return out.select("key", F.col("cluster").cast("long").alias("cluster"), F.lit(k).alias("k"))


@query()
def pca_project(t):
    return learn.pca(learn.zscored_vectors(vectors(t)), 2).select("key", "pc")


@query()
def loso_transfer(t):
    return learn.loso_transfer(vectors(t), 10)


@query()
def subject_leakage(t):
    return learn.subject_leakage(learn.zscored_vectors(vectors(t)).withColumn("subject", F.col("key") % 5))
