"""Voxel maps: grouping by cell, and the joins on cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..schema import COV, XYZ, has, require_columns
from .rows import Matrix, transform


def with_voxel(df: DataFrame, resolution: float) -> DataFrame:
    """df with vx, vy, vz and vkey, without points that have none."""
    require_columns(df, *XYZ)
    cells = [F.expr(E.voxel(c, resolution)).alias(f"v{c}") for c in XYZ]
    out = df.where(F.expr(E.finite(*XYZ))).select("*", *cells).withColumn("vkey", F.expr(E.pack("vx", "vy", "vz")))
    return out.where("vkey is not null")


def gaussian_voxelmap(df: DataFrame, resolution: float) -> DataFrame:
    """voxels(vx, vy, vz, vkey, n, mx, my, mz[, c00..c22], intensity): means of points and of their covariances, the greatest intensity (0 by default)."""
    means = [F.avg(c).alias(f"m{c}") for c in XYZ] + ([F.avg(c).alias(c) for c in COV] if has(df, *COV) else [])
    intensity = F.max("intensity") if has(df, "intensity") else F.lit(0.0)
    return with_voxel(df, resolution).groupBy("vx", "vy", "vz", "vkey").agg(F.count(F.lit(1)).alias("n"), *means, F.coalesce(intensity, F.lit(0.0)).alias("intensity"))


def merge_voxelmaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two maps of one resolution as the map of both clouds: means weigh by their counts."""
    means = [c for c in (*(f"m{x}" for x in XYZ), *COV) if c in a.columns and c in b.columns]
    both = a.unionByName(b, allowMissingColumns=True)
    weighted = [(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in means]
    return both.groupBy("vx", "vy", "vz", "vkey").agg(F.sum("n").alias("n"), *weighted, F.max("intensity").alias("intensity"))


def poses_table(df_like: DataFrame, poses: dict[int, Matrix]) -> DataFrame:
    """poses(frame_id, m00..m23) from a small dict."""
    rows = [(int(k), *[float(m[i][j]) for i in range(3) for j in range(4)]) for k, m in poses.items()]
    return df_like.sparkSession.createDataFrame(rows, "frame_id long, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(4)))


#: So many poses (104 bytes each) are sent to every task; more are joined by frame.
BROADCAST_POSES = 100_000
#: So many poses are applied to a cloud in one pass.
POSES_A_PASS = 1_000


def _placed(df: DataFrame, poses: DataFrame, out: Sequence[str] = XYZ) -> DataFrame:
    """df joined with its frame's pose, moved into columns `out`."""
    moved = [F.expr(" + ".join([f"m{i}{j} * {XYZ[j]}" for j in range(3)] + [f"m{i}3"])).alias(out[i]) for i in range(3)]
    joined = df.join(poses, "frame_id")
    if has(df, *COV):
        s = E.symmetric(COV)
        turned = [F.expr(" + ".join(f"m{i}{k} * m{j}{n} * {s[k][n]}" for k in range(3) for n in range(3))).alias(f"w{COV[a]}") for a, (i, j) in enumerate(((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)))]
        return joined.select("*", *moved, *turned)
    return joined.select("*", *moved)


def voxel_contents(df: DataFrame, resolution: float, contents: dict[str, Column]) -> DataFrame:
    """(vkey, one column for each of contents): what a voxel holds is any aggregate of its points."""
    return with_voxel(df, resolution).groupBy("vkey").agg(*[c.alias(n) for n, c in contents.items()])


def merge_frames(df: DataFrame, poses: dict[int, Matrix], resolution: float) -> DataFrame:
    """All frames as one cloud: points are placed by their frames' poses, grouped by the voxels of the first pose's own frame, and averaged in the world.

    Poses are broadcast if there are no more than BROADCAST_POSES. Points out of range are dropped, as are other attributes than covariances and the greatest intensity.
    """
    import numpy as np

    require_columns(df, "frame_id", *XYZ)
    first = np.linalg.inv(np.vstack([np.asarray(next(iter(poses.values())), float)[:3], [0, 0, 0, 1]]))
    table = poses_table(df, poses)
    world = _placed(df, F.broadcast(table) if len(poses) <= BROADCAST_POSES else table, ("wx", "wy", "wz"))
    local = E.moved(first, ("wx", "wy", "wz"))
    world = world.withColumn("vkey", F.expr(f"CASE WHEN {E.finite('wx', 'wy', 'wz')} THEN {E.pack(*[E.voxel(c, resolution) for c in local])} END"))
    means = [F.avg(f"w{c}").alias(c) for c in XYZ] + ([F.avg(f"w{c}").alias(c) for c in COV] if has(df, *COV) else [])
    extra = [F.max("intensity").alias("intensity")] if has(df, "intensity") else []
    # points without a voxel go after the grouping: a filter before it would be pushed into the join, all arithmetic with it, beyond what compiles
    out = world.groupBy("vkey").agg(F.count(F.lit(1)).alias("n"), *means, *extra, F.max("vkey").alias("_key"))
    return out.where("_key is not null").drop("_key")


def occupancy(df: DataFrame, resolution: float) -> DataFrame:
    """The distinct occupied cells: vkey."""
    return with_voxel(df, resolution).select("vkey").distinct()


def num_occupied(df: DataFrame, resolution: float) -> DataFrame:
    return with_voxel(df, resolution).agg(F.count_distinct("vkey").alias("cells"))


def voxel_lookup(source: DataFrame, voxels: DataFrame, resolution: float, how: str = "left") -> DataFrame:
    """Each source point with the voxel that contains it; Spark broadcasts the map if it is small."""
    keyed = source.withColumn("vkey", F.expr(E.voxel_key(resolution)))
    return keyed.join(voxels, "vkey", how)


def overlap(source: DataFrame, voxels: DataFrame, resolution: float, m: Matrix | None = None) -> DataFrame:
    """(n, hits, rate): source points (moved by m) in occupied voxels; the rate of an empty cloud is NaN."""
    moved = transform(source.select(*XYZ), m) if m is not None else source.select(*XYZ)
    keyed = moved.select(F.expr(E.voxel_key(resolution)).alias("vkey"))
    cells = voxels.select("vkey", F.lit(1).alias("hit")).distinct()
    out = keyed.join(cells, "vkey", "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    return out.select("n", "hits", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(float("nan"))).alias("rate"))


def overlap_flags(source: DataFrame, cells: DataFrame, resolution: float) -> DataFrame:
    """Each source point with hit 0 or 1."""
    keyed = source.withColumn("vkey", F.expr(E.voxel_key(resolution)))
    return keyed.join(cells.select("vkey", F.lit(1).alias("hit")), "vkey", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def overlap_multi(source: DataFrame, voxels: DataFrame, poses: dict[int, Matrix], resolution: float) -> DataFrame:
    """(n, hits, rate): points that hit any of voxels(map_id, vkey) under that map's own pose count once.

    A point has a place for each pose, as each map has a frame of its own; a pass sends POSES_A_PASS poses to the points' tasks, whatever their number.
    """
    n = source.agg(F.count(F.lit(1)).alias("n"))
    cells, known = voxels.select("map_id", "vkey").distinct(), sorted(poses)
    moved = [F.expr(" + ".join([f"m{i}{j} * {XYZ[j]}" for j in range(3)] + [f"m{i}3"])).alias(c) for i, c in enumerate(XYZ)]
    found = source.select("point_id").limit(0)
    for at in range(0, len(known), POSES_A_PASS):
        table = poses_table(source, {k: poses[k] for k in known[at : at + POSES_A_PASS]}).withColumnRenamed("frame_id", "map_id")
        placed = source.select("point_id", *XYZ).crossJoin(F.broadcast(table))
        keyed = placed.select("map_id", "point_id", *moved).select("map_id", "point_id", F.expr(E.voxel_key(resolution)).alias("vkey"))
        found = found.unionByName(keyed.join(cells, ["map_id", "vkey"], "left_semi").select("point_id").distinct())
    hits = found.agg(F.count_distinct("point_id").alias("hits"))
    return n.crossJoin(hits).select("n", "hits", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(F.lit(float("nan"))).alias("rate"))


def overlap_pairs(source: DataFrame, voxels: DataFrame, resolution: float) -> DataFrame:
    """(source_id, map_id, hits, n, rate) of all frames against all maps in one job: source(frame_id, point), voxels(map_id, vkey)."""
    keyed = source.select(F.col("frame_id").alias("source_id"), F.expr(E.voxel_key(resolution)).alias("vkey"))
    counts = keyed.groupBy("source_id", "vkey").agg(F.count(F.lit(1)).alias("k"))
    hits = counts.join(voxels.select("map_id", "vkey").distinct(), "vkey").groupBy("source_id", "map_id").agg(F.sum("k").alias("hits"))
    return hits.join(keyed.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")), "source_id").withColumn("rate", F.col("hits") / F.col("n"))
