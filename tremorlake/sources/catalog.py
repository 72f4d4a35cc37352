"""Catalogues of recordings: listed files, catalogue tables, index shards, and what is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.functions import names


def listed(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """Archives under a folder with their parsed names; contents are not read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", str(recursive).lower())
    return with_names(reader.load(root).select("path"))


def with_names(paths: DataFrame) -> DataFrame:
    out = paths.withColumn("__n", names.parse_path(F.col("path"))).select("path", "__n.*")
    out = out.withColumn("source_file", F.concat("stem", F.lit(".npz")))
    return out.withColumn("rec_key", names.rec_key(F.col("source_file"), F.col("hand")))


def from_table(rows: DataFrame) -> DataFrame:
    """A catalogue of ``sample_path, subject_id, side`` (and ``sample_id``, ``date``) rows; blank paths are skipped, both hands make two rows."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) if c in rows.columns else F.lit("")
    side, path = F.lower(text("side")), text("sample_path")
    stem = F.coalesce(F.nullif(text("sample_id"), F.lit("")), names.stem_of(path))
    hands = F.when(side == "both", F.array(F.lit("left"), F.lit("right"))).when(side.isin("left", "right"), F.array(side)).otherwise(F.array(F.lit(None).cast("string")))
    out = rows.where(path != "").select(
        path.alias("path"), stem.alias("stem"), F.nullif(text("subject_id"), F.lit("")).alias("subject"),
        F.coalesce(F.nullif(text("date"), F.lit("")), names.first_date(stem, path)).alias("date"), F.explode(hands).alias("hand"),
    )
    group = F.when(F.col("subject").isNotNull() & F.col("hand").isNotNull(), F.concat_ws("-", "subject", "hand")).otherwise(F.col("stem"))
    out = out.withColumn("grp", group).withColumn("parsed", F.lit(True)).withColumn("source_file", F.concat("stem", F.lit(".npz")))
    return out.withColumn("rec_key", names.rec_key(F.col("source_file"), F.col("hand")))


def resolved(recordings: DataFrame, present: DataFrame, input_dir: str) -> DataFrame:
    """``resolved`` path of every recording: its own path, the input folder's file, or the bare name, the first that is ``present``."""
    own = F.when(~F.lower(F.coalesce("source_path", F.lit(""))).isin("", "nan", "none"), F.col("source_path"))
    choices = F.array_compact(F.array(own, F.concat(F.lit(input_dir.rstrip("/") + "/"), "source_file"), F.col("source_file")))
    tried = recordings.withColumn("__id", F.monotonically_increasing_id()).select("__id", "source_file", F.posexplode(choices).alias("k", "path"))
    found = tried.join(present.select("path"), "path", "left_semi").groupBy("source_file").agg(F.min_by("path", "k").alias("resolved"))
    return recordings.join(found, "source_file", "left")


def shards(spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
    """Rows of one table over all shards whose ``recording.csv`` is there; that file is written last and commits a shard."""
    read = lambda name, s: spark.read.schema(s).option("header", True).csv(f"{root}/shards/*/{name}.csv").withColumn("__shard", F.element_at(F.split(F.input_file_name(), "/"), -2))
    committed = read("recording", "source_file string").select("__shard").distinct()
    return read(table, schema).join(committed, "__shard", "left_semi").drop("__shard")


def cached_features(requested: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requested rows of the recordings that the cache holds whole, and those of all others, which are still to be made.

    ``key`` begins with the recording's columns and ends with the clip's; a recording of which one clip is missing is no hit.
    """
    recording = key[:-1]
    missing = requested.join(cache, key, "left_anti").select(*recording).distinct()
    return requested.join(missing, recording, "left_anti").join(cache, key), requested.join(missing, recording, "left_semi")


def without_listed(catalog: DataFrame, listed: DataFrame | None, key: str = "source_file") -> DataFrame:
    """The catalogue without the recordings of an older list of invalid ones; without a list (null) all stay."""
    return catalog if listed is None else catalog.join(listed.select(key), key, "left_anti")


def walked(paths: DataFrame) -> DataFrame:
    """``path, camp, person, session, batch`` of archives under ``C<n>/person/session/``, to be sorted by ``camp``, a number; without a batch in the session's name it is 1."""
    parts = F.regexp_extract("path", r"(?:^|/)C(\d+)/([^/]+)/([^/]+)/(?:.*/)?[^/]+\.npz$", 0)
    part = lambda k: F.regexp_extract("path", r"(?:^|/)C(\d+)/([^/]+)/([^/]+)/(?:.*/)?[^/]+\.npz$", k)
    batch = F.coalesce(F.nullif(F.regexp_extract(part(3), r"-(\d+)$", 1), F.lit("")).cast("long"), F.lit(1))
    out = paths.where(parts != "").select("path", part(1).cast("long").alias("camp"), part(2).alias("person"), part(3).alias("session"), batch.cast("long").alias("batch"))
    return out.orderBy("camp", "person", "session", "path")


def clip_metadata(exported: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of exported clips as texts, ``?`` where one is missing or null."""
    return exported.select("name", *[(F.coalesce(F.col(c).cast("string"), F.lit("?")) if c in exported.columns else F.lit("?")).alias(c) for c in columns])
