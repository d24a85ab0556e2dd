"""Statistics of clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import XYZ, require_columns
from .neighbors import as_queries, knn
from ..scratch import cut


def minmax_distance(d: DataFrame) -> DataFrame:
    """(min_dist, max_dist) of a column dist; (0, 0) for none."""
    return d.agg(F.coalesce(F.min("dist"), F.lit(0.0)).alias("min_dist"), F.coalesce(F.max("dist"), F.lit(0.0)).alias("max_dist"))


def upper_median(df: DataFrame, column: str, ranges: int = 1024) -> float | None:
    """The value at place n // 2 of the sorted column, exactly: a histogram finds the range, and only that is sorted."""
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).head()
    if not n:
        return None
    place, values = n // 2, df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    while True:
        width = (hi - lo) / ranges
        inside = values.where((F.col("v") >= lo) & (F.col("v") <= hi))
        if width <= 0 or inside.count() <= 10_000:
            return inside.orderBy("v").offset(place).head()[0]
        counts = inside.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(ranges - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        for r in sorted(counts.collect()):  # at most `ranges` rows
            if place < r.n:
                lo, hi = r.lo, r.hi
                break
            place -= r.n


def median_distance(d: DataFrame) -> DataFrame:
    """(median_dist): the upper median of column dist, not interpolated; 0 for none."""
    value = upper_median(d, "dist")
    return d.sparkSession.range(1).select(F.lit(0.0 if value is None else float(value)).alias("median_dist"))


def running_statistics(df: DataFrame, column: str) -> DataFrame:
    """(n, mean, var, std, min, max) with population variance; partial results merge."""
    c = F.col(column)
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.var_pop(c).alias("var"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))


def bbox_diagonal(df: DataFrame) -> DataFrame:
    sides = [F.max(c) - F.min(c) for c in XYZ]
    return df.agg(F.sqrt(sum((s * s for s in sides[1:]), sides[0] * sides[0])).alias("diagonal"))


def neighbor_distance(df: DataFrame, k: int = 10) -> DataFrame:
    """(point_id, mean_dist): mean distance to the k nearest including the point itself, over those found."""
    near = knn(as_queries(df), df, k)
    return near.groupBy("qid").agg(F.avg(F.sqrt("d2")).alias("mean_dist")).withColumnRenamed("qid", "point_id")


def find_inliers(df: DataFrame, k: int = 10, std_factor: float = 1.0) -> DataFrame:
    """(point_id, mean_dist) of points with mean_dist below mean + std_factor * std (population)."""
    d = cut(neighbor_distance(df, k), "distances")
    limit = d.agg((F.avg("mean_dist") + F.lit(std_factor) * F.stddev_pop("mean_dist")).alias("limit"))
    return d.crossJoin(F.broadcast(limit)).where("mean_dist < limit").select("point_id", "mean_dist")  # limit is one row


def remove_outliers(df: DataFrame, k: int = 10, std_factor: float = 1.0) -> DataFrame:
    return df.join(find_inliers(df, k, std_factor).select("point_id"), "point_id", "left_semi")


def rmse_nn(source: DataFrame, target: DataFrame) -> DataFrame:
    """(rmse): of each source point's distance to the nearest target point."""
    return knn(as_queries(source), target, 1).agg(F.sqrt(F.avg("d2")).alias("rmse"))


def imu_means(imu: DataFrame) -> DataFrame:
    """Mean acceleration and angular rate of imu(ax, ay, az, wx, wy, wz)."""
    names = ("ax", "ay", "az", "wx", "wy", "wz")
    require_columns(imu, *names)
    return imu.agg(*[F.avg(c).alias(f"mean_{c}") for c in names])


def stamp_gaps(df: DataFrame, stamp: str = "ts", key: str | None = None) -> DataFrame:
    """df with dt to the stamp before (null first) and anomaly: dt below half or above twice the upper median of all."""
    if key is None:  # ranges of time, each with the last stamp of the ranges before it
        return _stamp_gaps_in_ranges(df, stamp)
    order = W.partitionBy(key).orderBy(stamp)
    gaps = cut(df.withColumn("dt", F.col(stamp) - F.lag(stamp).over(order)), "gaps")
    return _judge_gaps(gaps)


def _stamp_gaps_in_ranges(df: DataFrame, stamp: str) -> DataFrame:
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, stamp).withColumn("_r", F.spark_partition_id()), "ranges")
    # one row a range: as many as there are partitions
    last = placed.groupBy("_r").agg(F.max(stamp).alias("_hi")).select("_r", F.max("_hi").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    before = F.coalesce(F.lag(stamp).over(W.partitionBy("_r").orderBy(stamp)), "_before")
    return _judge_gaps(cut(placed.join(F.broadcast(last), "_r").withColumn("dt", F.col(stamp) - before).drop("_r", "_before"), "gaps"))


def _judge_gaps(gaps: DataFrame) -> DataFrame:
    m = upper_median(gaps, "dt")
    odd = F.lit(False) if m is None else F.coalesce((F.col("dt") < 0.5 * m) | (F.col("dt") > 2 * m), F.lit(False))
    return gaps.withColumn("anomaly", odd)


def distribution(df: DataFrame, key: str) -> DataFrame:
    """(key, n, means, covariance) of the points of each key; cov is the population one. merge_distributions() joins them."""
    sums = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in XYZ], *[F.avg(F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in PAIRS])
    return sums.select(key, "n", "mx", "my", "mz", *[(F.col(f"s{a}{b}") - F.col(f"m{a}") * F.col(f"m{b}")).alias(n) for (a, b), n in zip(PAIRS, ("c00", "c01", "c02", "c11", "c12", "c22"), strict=True)])


PAIRS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def merge_distributions(parts: DataFrame) -> DataFrame:
    """One row: the distribution of all keys' points from their own ones."""
    names = dict(zip(PAIRS, ("c00", "c01", "c02", "c11", "c12", "c22"), strict=True))
    total = F.sum("n")
    mean = {c: F.sum(F.col(f"m{c}") * F.col("n")) / total for c in XYZ}
    second = {p: F.sum((F.col(n) + F.col(f"m{p[0]}") * F.col(f"m{p[1]}")) * F.col("n")) / total for p, n in names.items()}
    out = parts.agg(total.alias("n"), *[mean[c].alias(f"m{c}") for c in XYZ], *[second[p].alias(f"s{n}") for p, n in names.items()])
    return out.select("n", "mx", "my", "mz", *[(F.col(f"s{n}") - F.col(f"m{p[0]}") * F.col(f"m{p[1]}")).alias(n) for p, n in names.items()])
