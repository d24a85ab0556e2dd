"""Helpers that the corpus operators share: scratch tables, text measures, deterministic order."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of bytes other than these: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A folder of our own only where that is unset and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def cleanup(spark: SparkSession | None = None) -> None:
    """Delete the scratch tables written so far. Call it when no result that reads them is needed any more."""
    while _made:
        owner, path = _made.pop()
        try:
            _delete(spark or owner, path)
        except Exception:  # the session has ended: the folder goes with the cluster's shared folder
            pass


atexit.register(cleanup)


def made() -> set[str]:
    """The paths of the scratch tables that are there now."""
    return {path for _, path in _made}


def discard(paths: set[str]) -> None:
    """Delete these scratch tables: those of a stage whose result has been written elsewhere."""
    for item in [x for x in _made if x[1] in paths]:
        _delete(*item)
        _made.remove(item)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/pointloom/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the scratch tables that df reads directly, once nothing needs them."""
    files = {f.rsplit("/", 1)[0].removeprefix("file:") for f in df.inputFiles()}
    for item in [x for x in _made if x[1].removeprefix("file:").replace("//", "/") in {f.replace("//", "/") for f in files}]:
        _delete(*item)
        _made.remove(item)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. For pure ASCII, lower() does just that and is vectorised."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Words of the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
