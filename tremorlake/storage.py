"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no folder, which only a local master may leave out.
LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, seen by the driver and all executors.

    A session off this machine must name it: what executors write to folders of their own is lost to the others.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors share (master {sc.master})")
        sc.setCheckpointDir(named or LOCAL_DIR)
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there and lost executors lose nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tremorlake-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that is read no more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tremorlake-" in folder:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
