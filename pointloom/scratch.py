"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A folder of our own only where that is unset and all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table and read it again: cuts lineage in loops and survives lost executors. The table goes with drop() or the session."""
    path = f"{root(df.sparkSession)}/pointloom/{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _made[path] = out.sparkSession
    out._scratch = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the table that cut() made, once a newer state has taken its place and nothing reads it. Other frames stay."""
    path = getattr(df, "_scratch", None)
    if path and (spark := _made.pop(path, None)):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def register(path: str, spark: SparkSession) -> None:
    """A table that goes with the session, unless keep() is called for it."""
    _made[path] = spark


def keep(path: str) -> None:
    """The table outlives the session."""
    _made.pop(path, None)


def delete(spark: SparkSession, path: str) -> None:
    _made.pop(path, None)
    _delete(spark, path)


def found(spark: SparkSession, pattern: str) -> list:
    """The statuses of files that a pattern of the shared folder's file system finds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return list(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def cleanup() -> None:
    """Delete all tables made so far. Call it when no result that reads them is needed any more; it runs at exit."""
    while _made:
        path, spark = _made.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder goes with the cluster's shared folder
            pass


atexit.register(cleanup)
