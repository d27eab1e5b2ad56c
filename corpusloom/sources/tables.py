"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process (tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's file system closes."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    return path


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Give a finished folder its name; an error if there is one already."""
    at, files = _files(spark, old)
    to = spark._jvm.org.apache.hadoop.fs.Path(new)
    if files.exists(to) or not files.rename(at, to):
        files.delete(at, True)
        raise FileExistsError(new)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs a reread and no later step sees
    other rows. The table is deleted by discard(), or when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, files = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored() tables that no later step reads."""
    for t in tables:
        at, files = _files(t.sparkSession, t.stored_at)
        files.delete(at, True)
