"""Labels, exclusions and clustering runs as tables: views over them and changes to them.

Changes are rows of a log; the latest one of a key counts. Nothing is rewritten to record a label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANNOTATION_KEY = ["source_file", "clip_id", "scope", "kind"]
#: Tables that hold rows of a recording.
RECORDING_TABLES = ("recordings", "bursts", "clips", "annotations", "cluster_assignments")


def has_label(value: str = "value") -> Column:
    return F.trim(F.coalesce(F.col(value), F.lit(""))) != ""


def get_annotations(annotations: DataFrame, scope: str | None = None, kind: str | None = None) -> DataFrame:
    for name, wanted in (("scope", scope), ("kind", kind)):
        if wanted is not None:
            annotations = annotations.where(F.col(name) == wanted)
    return annotations


def excluded_recordings(annotations: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Recordings marked invalid or dropped for good."""
    invalid = get_annotations(annotations, "recording", "invalid").select("source_file")
    return invalid.union(tombstones.select("source_file")).distinct()


def labelled_view(clips: DataFrame, annotations: DataFrame, tombstones: DataFrame, same_version: bool = True) -> DataFrame:
    """Clips that are not excluded, each with its ``gesture_label`` or null.

    A label counts only for the segmentation it was given to, unless ``same_version`` is off.
    """
    labels = get_annotations(annotations, "clip", "label").select("source_file", "clip_id", F.col("value").alias("gesture_label"), F.col("seg_version").alias("__version"))
    invalid = get_annotations(annotations, "clip", "invalid").select("source_file", "clip_id")
    kept = clips.join(excluded_recordings(annotations, tombstones), "source_file", "left_anti").join(invalid, ["source_file", "clip_id"], "left_anti")
    joined = kept.join(labels, ["source_file", "clip_id"], "left")
    if same_version:
        joined = joined.withColumn("gesture_label", F.when(F.col("__version").eqNullSafe(F.col("seg_version")), F.col("gesture_label")))
    return joined.drop("__version")


def progress(recordings: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per recording: labelled and invalid clips, and whether it is invalid itself."""
    mine = annotations.groupBy("source_file").agg(
        F.count_if((F.col("scope") == "clip") & (F.col("kind") == "label") & has_label()).alias("n_labeled"),
        F.count_if((F.col("scope") == "clip") & (F.col("kind") == "invalid")).alias("n_invalid"),
        F.count_if((F.col("scope") == "recording") & (F.col("kind") == "invalid")).alias("__rec"),
    )
    out = recordings.join(mine, "source_file", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("n_labeled", "n_invalid")}
    return out.withColumns(counts | {"rec_invalid": F.coalesce(F.col("__rec") > 0, F.lit(False))}).drop("__rec")


def top_labels(annotations: DataFrame, most: int = 20) -> DataFrame:
    labels = get_annotations(annotations, "clip", "label").where(has_label())
    return labels.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)


def library_totals(clips: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: clips, labelled clips, invalid ones, invalid recordings, and the sorted labels."""
    mine = lambda scope, kind: (F.col("scope") == scope) & (F.col("kind") == kind)
    label = mine("clip", "label") & has_label()
    return annotations.agg(
        F.count_if(label).alias("n_labeled"), F.count_if(mine("clip", "invalid")).alias("n_invalid"), F.count_if(mine("recording", "invalid")).alias("n_rec_invalid"),
        F.array_sort(F.collect_set(F.when(label, F.col("value")))).alias("labels"),
    ).join(clips.agg(F.count("*").alias("n_clips")))


def review_counts(clips: DataFrame, group: str = "source_path") -> DataFrame:
    """Per recording: its names (those of the first clip), clips, and clips without a burst."""
    first = {c: F.min_by(c, "clip_id") for c in ("source_file", "hand", "subject", "group")}
    return clips.groupBy(group).agg(*[v.alias(k) for k, v in first.items()], F.count("*").alias("n_clips"), F.count_if(F.col("matched_burst_idx") < 0).alias("n_review"))


def folder_rollup(recordings: DataFrame, folder: Column) -> DataFrame:
    """Sums of recordings by folder; done when every recording is invalid or has all clips decided."""
    done = F.col("rec_invalid") | (F.col("n_labeled") + F.col("n_invalid") >= F.col("n_clips"))
    return recordings.groupBy(folder.alias("folder")).agg(
        F.count("*").alias("n_recordings"), F.sum("n_labeled").alias("n_labeled"), F.sum("n_invalid").alias("n_invalid"), F.sum("n_review").alias("n_review"), F.bool_and(done).alias("all_done")
    )


def next_untriaged(clips: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """The first clip of each recording that has no label and isn't invalid."""
    open_ = clips.where(~has_label("label") & ~F.coalesce(F.col("invalid"), F.lit(False)))
    return open_.withColumn("__r", F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where("__r = 1").drop("__r")


def latest(log: DataFrame, key: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last row of every key; keys whose last row is a deletion are gone."""
    rest = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*key, "__last.*")
    return last if deleted is None else last.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def annotation_changes(rows: DataFrame) -> DataFrame:
    """Log rows of label decisions ``source_file, clip_id, value, invalid``: a label and a mark as invalid exclude each other; neither clears both."""
    label = F.trim(F.coalesce(F.col("value"), F.lit("")))
    changes = F.array(
        F.struct(F.lit("label").alias("kind"), label.alias("value"), (F.col("invalid") | (label == "")).alias("deleted")),
        F.struct(F.lit("invalid").alias("kind"), F.lit("1").alias("value"), (~F.col("invalid")).alias("deleted")),
    )
    rest = [c for c in rows.columns if c not in ("value", "invalid")]
    return rows.select(*rest, F.lit("clip").alias("scope"), F.inline(changes))


def recording_changes(rows: DataFrame) -> DataFrame:
    """Log rows of decisions ``source_file, invalid`` about whole recordings: setting or taking back the soft exclusion."""
    rest = [c for c in rows.columns if c != "invalid"]
    return rows.select(*rest, F.lit(-1).cast("long").alias("clip_id"), F.lit("recording").alias("scope"), F.lit("invalid").alias("kind"), F.lit("1").alias("value"), (~F.col("invalid")).alias("deleted"))


def drop_recording(tables: dict[str, DataFrame], tombstones: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of ``gone`` (``source_file, dropped_at, note``), which join the tombstones."""
    out = {n: df.join(gone.select("source_file"), "source_file", "left_anti") if n in RECORDING_TABLES else df for n, df in tables.items()}
    kept = tombstones.join(gone.select("source_file"), "source_file", "left_anti")
    return out | {"tombstones": kept.unionByName(gone)}


def replace_recordings(table: DataFrame, new: DataFrame) -> DataFrame:
    """An index table with the rows of the recordings in ``new`` exchanged."""
    return table.join(new.select("source_file").distinct(), "source_file", "left_anti").unionByName(new, allowMissingColumns=True)


def latest_run(runs: DataFrame, channel: str | None = None) -> DataFrame:
    runs = runs if channel is None else runs.where(F.col("channel") == channel)
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(1)


def clusters_with_labels(assignments: DataFrame, annotations: DataFrame, clips: DataFrame, run_id: str) -> DataFrame:
    """Assignments of one run with labels and clip columns, where there are any."""
    labels = get_annotations(annotations, "clip", "label").select("source_file", "clip_id", F.col("value").alias("gesture_label"))
    key = ["source_file", "clip_id"]
    return assignments.where(F.col("run_id") == run_id).join(labels, key, "left").join(clips, key, "left")


def orphan_runs(runs: DataFrame, assignments: DataFrame, present: DataFrame) -> DataFrame:
    """Run ids that a table knows and no folder holds."""
    return runs.select("run_id").union(assignments.select("run_id")).distinct().join(present.select("run_id"), "run_id", "left_anti")


def drop_runs(df: DataFrame, gone: DataFrame) -> DataFrame:
    return df.join(gone.select("run_id"), "run_id", "left_anti")


def recording_list(clips: DataFrame, recordings: DataFrame, annotations: DataFrame) -> DataFrame:
    """A row per recording: names, clips, clips to review, labelled and invalid ones, whether all are decided."""
    counts = review_counts(clips.join(recordings.select("source_file", "source_path"), "source_file", "left"))
    out = progress(counts, annotations)
    return out.withColumn("done", F.col("rec_invalid") | (F.col("n_labeled") + F.col("n_invalid") >= F.col("n_clips")))


def run_table(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Runs with their parameters and scores side by side, by time."""
    p = lambda path: F.get_json_object("params_json", f"$.{path}")
    m = lambda path: F.get_json_object("metrics_json", f"$.{path}")
    dates = F.when(p("scope.resolved.date_min") == p("scope.resolved.date_max"), p("scope.resolved.date_min")).otherwise(
        F.concat_ws("-", p("scope.resolved.date_min"), p("scope.resolved.date_max"))
    )
    method = F.concat_ws("/", "channel", p("repr"), p("subject_norm"))
    joined = runs.join(metrics, "run_id", "left").orderBy("created_at", "run_id")
    scores = [m(f"label_driven.{c}").cast("double").alias(c) for c in ("ari", "nmi", "purity")]
    return joined.select("run_id", "created_at", method.alias("method"), p("scope.resolved.n_clips").cast("long").alias("n_clips"), dates.alias("dates"), *scores)
