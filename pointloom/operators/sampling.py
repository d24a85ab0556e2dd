"""Down-sampling of clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import expr as E
from ..schema import XYZ, require_columns
from ..scratch import cut

#: Rates from here on return the cloud itself.
FULL_RATE = 0.99


def draw(key: Column, seed: int = 0) -> Column:
    """A seeded order of integer ids that other engines can compute too: multiplicative hashing to 32 bits."""
    return ((key + F.lit(seed)) % 1_000_003 * 2_654_435_761) % 4_294_967_296


def voxelgrid_sampling(df: DataFrame, resolution: float) -> DataFrame:
    """One row per voxel: vkey, n and the mean of every double column. Non-finite and out-of-range points are dropped; columns of other types too."""
    require_columns(df, *XYZ)
    doubles = [c for c, t in df.dtypes if t == "double"]
    keyed = df.select(F.expr(E.voxel_key(resolution)).alias("vkey"), *doubles).where("vkey is not null")
    return keyed.groupBy("vkey").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in doubles])


def randomgrid_sampling(df: DataFrame, resolution: float, rate: float, seed: int = 0) -> DataFrame:
    """Whole rows: per voxel at most ceil(rate * N / voxels) of them in seeded order, over all at most 1.2 * rate * N. From FULL_RATE on, the cloud."""
    require_columns(df, "point_id", *XYZ)
    if rate >= FULL_RATE:
        return df
    keyed = df.withColumn("vkey", F.expr(E.voxel_key(resolution))).where("vkey is not null")
    # voxels are counted after a partial aggregation; two numbers reach the driver
    n, voxels = keyed.groupBy("vkey").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).head()
    if not n:
        return df.limit(0)
    quota, cap = -int(-rate * n // voxels), int(1.2 * rate * n)
    place = F.row_number().over(W.partitionBy("vkey").orderBy(draw(F.col("point_id"), seed), "point_id"))
    kept = cut(keyed.withColumn("_place", place).where(F.col("_place") <= quota).drop("_place", "vkey"), "quota")
    return first_drawn(kept, cap, seed)


def first_drawn(df: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """The first so many rows in seeded order, or all if they are fewer.

    The hash below which that many rows lie is found from a histogram of 4096 ranges, so only the range at
    the boundary is ordered.
    """
    keyed = df.withColumn("_draw", draw(F.col("point_id"), seed)).withColumn("_range", F.shiftright("_draw", 20))
    counts = sorted((r[0], r[1]) for r in keyed.groupBy("_range").count().collect())  # 4096 rows at most
    left, edge = most, -1
    for edge, c in counts:
        if c > left:
            break
        left -= c
    else:
        return df
    tail = keyed.where(F.col("_range") == edge).orderBy("_draw", "point_id").limit(left)
    return keyed.where(F.col("_range") < edge).unionByName(tail).drop("_draw", "_range")


def random_sampling(df: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """Exactly floor(N * rate) rows without replacement, the first in seeded order. From FULL_RATE on, the cloud."""
    require_columns(df, "point_id")
    if rate >= FULL_RATE:
        return df
    return first_drawn(df, int(df.count() * rate), seed)
