"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def cut(df: DataFrame) -> DataFrame:
    """Store a frame in the checkpoint folder the session names, so that a lost executor loses nothing and plans stay short.

    A local session that names none gets a temporary folder; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="evalloom-"))
    return df.checkpoint()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a local session that names none gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not named and spark.sparkContext.applicationId not in _local:
        _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="evalloom-")
    return f"{(named or _local[spark.sparkContext.applicationId]).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as a table to the shared folder and read it back: what is costly is computed once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tables/" in folder:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Shuffle files of what has been stored are deleted now, not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
