"""Writing tables, labelled clips and label exports. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.functions import names


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_recordings(tables: dict[str, DataFrame], root: str, key: str = "rec_key") -> None:
    """Replace the recordings that the tables hold, table by table; ``recordings`` goes last and commits the others."""
    for name in sorted(tables, key=lambda n: n == "recordings"):
        writer = tables[name].write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(key).parquet(f"{root}/{name}")


def committed(tables: dict[str, DataFrame], key: str = "rec_key") -> dict[str, DataFrame]:
    """Tables without recordings whose last write did not finish."""
    done = tables["recordings"].select(key).distinct()
    return {n: df if n == "recordings" else df.join(done, key, "left_semi") for n, df in tables.items()}


def with_path(table: DataFrame, recordings: DataFrame) -> DataFrame:
    """The convenience dump of a table: the recording's path comes second."""
    joined = table.join(recordings.select("source_file", "source_path"), "source_file", "left")
    rest = [c for c in table.columns if c != "source_file"]
    return joined.select("source_file", "source_path", *rest)


def save_run(run_id: str, channel: str, parameters: dict, assignments: DataFrame, root: str, created_at: str) -> None:
    """One clustering run: its parameters and its clusters, replacing an earlier run of the same id."""
    spark = assignments.sparkSession
    runs = spark.createDataFrame([(run_id, created_at, channel, json.dumps(parameters, sort_keys=True))], "run_id string, created_at string, channel string, params_json string")
    for name, df in (("cluster_assignments", assignments.withColumn("run_id", F.lit(run_id))), ("cluster_runs", runs)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}")


def metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("metrics_json"))


def labelled_clips(clips: DataFrame, samples: DataFrame) -> DataFrame:
    """Labelled clips with their slices: names, seven scalar fields and the two signals, ready to be written by label.

    ``samples`` has ``source_file, hand, i, emg, pose``. A clip's samples meet in one row, as they do in an archive.
    """
    own = clips.where(F.trim(F.coalesce("gesture_label", F.lit(""))) != "")
    inside = own.join(samples, ["source_file", "hand"]).where("start_sample <= i and i < end_sample")
    rows = F.array_sort(F.collect_list(F.struct("i", "emg", "pose")))
    keys = ["gesture_label", "source_file", "subject", "hand", "clip_id", "start_sample", "end_sample", "fs"]
    out = inside.groupBy(*keys).agg(rows.alias("r"))
    name = names.export_name(F.col("gesture_label"), F.col("subject"), F.col("hand"), names.without_npz(F.col("source_file")), F.col("clip_id"))
    return out.select(*keys, name.alias("name"), F.transform("r", lambda x: x["emg"]).alias("emg"), F.transform("r", lambda x: x["pose"]).alias("pose"))


def write_labelled(clips: DataFrame, path: str, force: bool = False) -> None:
    """Clips in one folder a label; those that are there already are skipped unless forced."""
    spark = clips.sparkSession
    if not force:
        try:
            present = spark.read.parquet(path).select("name")
        except Exception as e:  # nothing has been exported yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            clips = clips.join(present, "name", "left_anti")
    clips.write.mode("overwrite" if force else "append").partitionBy("gesture_label").parquet(path)


def label_export(rows: DataFrame, path: str = "source_path") -> DataFrame:
    """Rows with ``folder_name``: a safe name of their folder; folders whose safe names are equal get ``_1``, ``_2`` after it. A null path lies in no folder."""
    placed = rows.withColumn("__folder", F.coalesce(names.folder_of(F.col(path)), F.lit("")))
    folders = placed.select("__folder", F.coalesce(names.folder_key(F.col(path)), F.lit("")).alias("__name")).distinct()
    again = F.row_number().over(Window.partitionBy("__name").orderBy("__folder")) - 1
    named = folders.withColumn("folder_name", F.when(again > 0, F.concat_ws("_", "__name", again.cast("string"))).otherwise(F.col("__name")))
    return placed.join(named.select("__folder", "folder_name"), "__folder").drop("__folder")


def write_label_export(rows: DataFrame, root: str, path: str = "source_path") -> None:
    """The labels as CSV: ``merged`` holds all of them, ``by_folder`` those of each folder under its safe name."""
    write_csv(rows, f"{root}/merged")
    label_export(rows, path).write.mode("overwrite").option("header", True).partitionBy("folder_name").csv(f"{root}/by_folder")
