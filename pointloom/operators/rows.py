"""Rows and columns of clouds: attributes, selection, motion, validation, rays."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import expr as E
from ..schema import COV, NORMAL, XYZ, has, require_columns

Matrix = Sequence[Sequence[float]]


def add_attribute(df: DataFrame, values: DataFrame, key: str = "point_id") -> DataFrame:
    """Attach the columns of values(key, ...) as doubles where they are numbers; rows without a value get null."""
    require_columns(values, key)
    numbers = {"float", "int", "bigint", "smallint", "tinyint"}
    cast = [F.col(c).cast("double").alias(c) if t in numbers or t.startswith("decimal") else F.col(c) for c, t in values.dtypes if c != key]
    return df.join(values.select(key, *cast), key, "left")


def attribute(df: DataFrame, name: str) -> Column:
    require_columns(df, name)
    return df[name]


def sample(df: DataFrame, indices: DataFrame) -> DataFrame:
    """The rows that indices(pos, point_id) names, repeats allowed, with pos for their order."""
    require_columns(indices, "pos", "point_id")
    return indices.join(df, "point_id")


def where(df: DataFrame, condition: Column | str) -> DataFrame:
    """Points on whose coordinates or any attribute the condition holds."""
    return df.where(condition)


def transform(df: DataFrame, m: Matrix, affine: bool = False) -> DataFrame:
    """Points by the 3x4 part of m, normals and covariances by its linear part; normals of an affine map by the inverse transpose, not renormalised."""
    require_columns(df, *XYZ)
    linear = np.asarray(m, float)[:3, :3]
    turn = np.linalg.inv(linear).T if affine else linear
    new = dict(zip(XYZ, map(F.expr, E.moved(m, XYZ)), strict=True))
    if has(df, *NORMAL):
        new |= dict(zip(NORMAL, map(F.expr, E.moved(turn, NORMAL, shift=False)), strict=True))
    if has(df, *COV):
        new |= dict(zip(COV, map(F.expr, E.rotated_cov(linear)), strict=True))
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def distances(df: DataFrame, max_scan: int) -> DataFrame:
    """(point_id, dist) of every step-th point: step 1 below max_scan points, else the integer quotient."""
    n = df.count()
    step = 1 if n < max_scan else n // max_scan
    return df.where(F.col("point_id") % step == 0).select("point_id", F.expr(f"sqrt({E.norm2(XYZ)})").alias("dist"))


def sort_by_time(df: DataFrame) -> DataFrame:
    require_columns(df, "t")
    return df.orderBy("t", "point_id")


def concatenate(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def compact_cov(df: DataFrame) -> DataFrame:
    """The six covariance terms as floats."""
    require_columns(df, *COV)
    return df.select(*[F.col(c).cast("float").alias(c) if c in COV else F.col(c) for c in df.columns])


def uncompact_cov(df: DataFrame) -> DataFrame:
    """The nine terms of the matrix from the six, as doubles."""
    names = E.symmetric([f"CAST({c} AS DOUBLE)" for c in COV])
    return df.drop(*COV).select("*") if not has(df, *COV) else df.select(*[c for c in df.columns if c not in COV], *[F.expr(names[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


def composite_index(voxel_id: Column, slot: Column) -> Column:
    """A voxel's number in the high 32 bits, a point's place in it in the low."""
    return F.shiftleft(voxel_id.cast("long"), 32).bitwiseOR(slot.cast("long"))


def split_index(index: Column) -> tuple[Column, Column]:
    return F.shiftright(index, 32), index.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def facing_away(m: Matrix, limit: float = 0.174) -> str:
    """Surface validation: the moved normal points away from the sensor by more than the limit allows; such points are rejected."""
    p, n = E.moved(m, XYZ), E.moved(m, NORMAL, shift=False)
    return f"({E.dot(p, n)} / sqrt({E.norm2(p)}) > {limit!r})"


def scan_angle(prefix: str = "") -> str:
    """The elevation of a point, in radians."""
    x, y, z = (prefix + c for c in XYZ)
    return f"atan2({z}, sqrt({x} * {x} + {y} * {y}))"


def raycast(rays: DataFrame, size: float) -> DataFrame:
    """(ray_id, step, vx, vy, vz) of the voxels on rays(ray_id, sx, sy, sz, ex, ey, ez), from the start's to before the end's.

    Every crossing of a voxel wall is a time in [0, 1] on its axis; in the order of all three axes' times each crossing
    moves one step, so a ray's voxels are running sums of its moves. Rays that share a ray_id are rays of their own.
    """
    require_columns(rays, "ray_id", "sx", "sy", "sz", "ex", "ey", "ez")
    axes = "xyz"
    cells = rays.select("*", *[F.expr(E.voxel(f"s{a}", size)).alias(f"v{a}") for a in axes], *[F.expr(E.voxel(f"e{a}", size)).alias(f"w{a}") for a in axes])
    crossings = []
    for k, a in enumerate(axes):
        wall = f"CASE WHEN w{a} > v{a} THEN transform(sequence(v{a} + 1, w{a}), i -> i) WHEN w{a} < v{a} THEN transform(sequence(w{a} + 1, v{a}), i -> i) ELSE array() END"
        crossings.append(f"transform({wall}, i -> named_struct('t', (i * {size!r} - s{a}) / (e{a} - s{a}), 'axis', {k}, 'move', CAST(sign(w{a} - v{a}) AS BIGINT)))")
    order = F.expr(f"array_sort(concat({', '.join(crossings)}))")
    steps = cells.select("ray_id", "vx", "vy", "vz", order.alias("crossings"))
    rows = steps.withColumn("_ray", F.monotonically_increasing_id()).select("ray_id", "_ray", "vx", "vy", "vz", F.posexplode("crossings").alias("step", "c"))
    before = W.partitionBy("ray_id", "_ray").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    moved = lambda k: F.coalesce(F.sum(F.when(F.col("c.axis") == k, F.col("c.move"))).over(before), F.lit(0))
    return rows.select("ray_id", F.col("step").cast("long").alias("step"), *[(F.col(f"v{a}") + moved(k)).alias(f"v{a}") for k, a in enumerate(axes)])


# The factors of a voxel's three coordinates in the xor hash.
XOR_FACTORS = (9132043225175502913, 7277549399757405689, 6673468629021231217)


def xor_hash(vx: str = "vx", vy: str = "vy", vz: str = "vz") -> str:
    """The products of coordinates and large factors, modulo 2**64, combined by exclusive or; as a signed 64-bit integer."""
    whole = 1 << 64

    def product(v: str, p: int) -> str:
        d = f"pmod(CAST({v} AS DECIMAL(18, 0)) * CAST({p} AS DECIMAL(20, 0)), CAST({whole} AS DECIMAL(38, 0)))"
        return f"CAST(CASE WHEN {d} >= {whole // 2} THEN {d} - {whole} ELSE {d} END AS BIGINT)"

    return "(" + " ^ ".join(product(v, p) for v, p in zip((vx, vy, vz), XOR_FACTORS, strict=True)) + ")"


def spatial_hash(vx: str = "vx", vy: str = "vy", vz: str = "vz") -> Column:
    """A hash of voxel coordinates; joins hash their keys themselves, this is for seeds."""
    return F.xxhash64(vx, vy, vz)


def memory_usage(df: DataFrame) -> DataFrame:
    """(column, bytes) that the fixed-width columns of a cloud take in memory."""
    width = {"double": 8, "bigint": 8, "float": 4, "int": 4, "boolean": 1}
    n = df.agg(F.count(F.lit(1)).alias("n"))
    fixed = [(c, width[t]) for c, t in df.dtypes if t in width]
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col("n") * w).alias("bytes")) for c, w in fixed])).alias("r")).select("r.*")


def ordered_unique(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key."""
    from pyspark.sql import Window as W

    return df.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_place = 1").drop("_place")


def rays_of(points: pd.DataFrame) -> pd.DataFrame:
    """Rays from the origin to points, for raycast()."""
    return pd.DataFrame({"ray_id": points.point_id, "sx": 0.0, "sy": 0.0, "sz": 0.0, "ex": points.x, "ey": points.y, "ez": points.z})
