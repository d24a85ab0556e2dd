"""Clouds carried by the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_N = "sqrt({5} * {5} + {6} * {6} + {7} * {7})"
#: Expressions of cloud E over the components of an embedding, {0} to {63}.
CLOUD_E = {
    "x": "10 * {0}", "y": "10 * {1}", "z": "10 * {2}", "intensity": "{3}", "t": "{4} + 1",
    "nx": "{5} / " + _N, "ny": "{6} / " + _N, "nz": "{7} / " + _N,
    "c00": "0.1 + {8} * {8}", "c01": "{8} * {9}", "c02": "{8} * {10}", "c11": "0.1 + {9} * {9}", "c12": "{9} * {10}", "c22": "0.1 + {10} * {10}",
}


def _components(first: int) -> list[str]:
    return [f"CAST(embedding[{i + first}] AS DOUBLE)" for i in range(64)]


def cloud_e_sql() -> str:
    """The same cloud as a common table expression for an engine whose lists start at 1."""
    return "e AS (SELECT vec_id AS point_id, CAST(label AS BIGINT) AS frame_id, " + ", ".join(f"{v.format(*_components(1))} AS {k}" for k, v in CLOUD_E.items()) + " FROM embeddings)"


def cloud_e(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """embeddings: point_id, frame_id, x, y, z, intensity, t, normals and covariances; or only the columns named."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    made = [F.col("vec_id").alias("point_id"), F.col("label").cast("long").alias("frame_id"), *[F.expr(v.format(*_components(0))).alias(k) for k, v in CLOUD_E.items()]]
    out = df.select(*made)
    return out.select(*columns) if columns else out


def features_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("f"))


CLOUD_T_SQL = (
    "t AS (SELECT event_id AS point_id, user_id AS frame_id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) / 1000000.0 AS t, "
    "value / 10 AS x, CAST(event_id % 97 AS DOUBLE) AS y, CAST(user_id % 53 AS DOUBLE) AS z, value AS intensity FROM events)"
)


def cloud_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: point_id, frame_id (user), t (seconds since the first), x, y, z, intensity."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    start = df.agg(F.min("ts")).select(F.unix_micros(F.col("min(ts)").cast("timestamp")).alias("start"))
    df = df.crossJoin(F.broadcast(start))  # one row
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("start")) / F.lit(1000000.0)
    return df.select(F.col("event_id").alias("point_id"), F.col("user_id").alias("frame_id"), seconds.alias("t"), (F.col("value") / 10).alias("x"), (F.col("event_id") % 97).cast("double").alias("y"), (F.col("user_id") % 53).cast("double").alias("z"), F.col("value").alias("intensity"))


CLOUD_L_SQL = "l AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, 100 * l_discount AS z, CAST(l_suppkey % 5 AS BIGINT) AS frame_id, l_tax AS intensity FROM lineitem)"


def cloud_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: x, y, z, frame_id, intensity; its rows have no key."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return df.select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (100 * F.col("l_discount")).alias("z"), (F.col("l_suppkey") % 5).cast("long").alias("frame_id"), F.col("l_tax").alias("intensity"))
