"""Scan-matching factors as residual rows: correspondences by a join, residuals and weights as columns.

Every function takes the source cloud, the target and a motion m (source to target), and returns rows for linearize:
factor_id, r0..r2, p0..p2, w00..w22 and the ids that matched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import lie
from ..operators.neighbors import as_queries, radius_search
from ..operators.rows import Matrix, scan_angle, transform
from ..schema import COV, NORMAL, XYZ, require_columns
from ..scratch import cut
from .linearize import IDENTITY_WEIGHT, P, R, WEIGHT

SOURCE_COV, TARGET_COV = tuple(f"s{c}" for c in COV), tuple(f"t{c}" for c in COV)
BOTH_COV = [f"({s} + {t})" for s, t in zip(SOURCE_COV, TARGET_COV, strict=True)]


def moved(source: DataFrame, m: Matrix, extra: tuple[str, ...] = ()) -> DataFrame:
    """src_id, p0..p2 and, where there are any, covariances (turned) and normals."""
    out = transform(source, m)
    columns = [F.col("point_id").alias("src_id"), *[F.col(c).alias(p) for c, p in zip(XYZ, P, strict=True)]]
    if all(c in out.columns for c in COV):
        columns += [F.col(c).alias(f"s{c}") for c in COV]
    return out.select(*columns, *extra)


#: A search takes queries(qid, qx, qy, qz), points(point_id, x, y, z), a distance and k, and returns (qid, point_id, d2, rank).
Search = Callable[[DataFrame, DataFrame, float, int], DataFrame]


def nearest(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float, k: int = 1, search: Search = radius_search) -> DataFrame:
    """(src_id, tgt_id, rank) after the motion; the target keeps its own cells over all motions, so it can be cached."""
    placed = as_queries(transform(source.select("point_id", *XYZ), m))
    near = search(placed, target.select("point_id", *XYZ), max_distance, k)
    return near.select(F.col("qid").alias("src_id"), F.col("point_id").alias("tgt_id"), "rank")


def _matched(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float, columns: tuple[str, ...], extra: tuple[str, ...] = (), search: Search = radius_search) -> DataFrame:
    goal = target.select(F.col("point_id").alias("tgt_id"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(XYZ)], *[F.col(c).alias(f"t{c}") for c in columns])
    # both are clouds: they meet by shuffles, whatever their size, and not by way of the driver
    return nearest(source, target, m, max_distance, search=search).join(goal.hint("merge"), "tgt_id").join(moved(source, m, extra).hint("merge"), "src_id")


def _rows(df: DataFrame, residual: list[str], weight: tuple[str, ...] | list[str], factor_id: int, keep: tuple[str, ...] = ("src_id",)) -> DataFrame:
    made = df.select(*keep, *P, *[F.expr(e).alias(n) for n, e in zip(R, residual, strict=True)], *[F.expr(e).cast("double").alias(n) for n, e in zip(WEIGHT, weight, strict=True)])
    return made.withColumn("factor_id", F.lit(factor_id).cast("long"))


DIFFERENCE = [f"(q{i} - p{i})" for i in range(3)]


def icp(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float = 1.0, factor_id: int = 0, search: Search = radius_search) -> DataFrame:
    return _rows(_matched(source, target, m, max_distance, (), search=search), DIFFERENCE, IDENTITY_WEIGHT, factor_id, ("src_id", "tgt_id"))


def icp_plane(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float = 1.0, factor_id: int = 0) -> DataFrame:
    """The residual times the target's normal, element by element: the weight is the normal's squares."""
    require_columns(target, *NORMAL)
    w = ("tnx * tnx", "0.0", "0.0", "tny * tny", "0.0", "tnz * tnz")
    return _rows(_matched(source, target, m, max_distance, NORMAL), DIFFERENCE, w, factor_id, ("src_id", "tgt_id"))


#: How a GICP weight is kept between linearisations: as it is, in single precision, or not at all (made anew, which is what a plan does).
WEIGHT_CACHES = ("full", "compact", "none")


def gicp(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float = 1.0, factor_id: int = 0, cache: str = "full", search: Search = radius_search) -> DataFrame:
    """Distribution to distribution: the weight is the inverse of both covariances' sum. All WEIGHT_CACHES give the same but for rounding."""
    if cache not in WEIGHT_CACHES:
        raise ValueError(f"cache must be one of {WEIGHT_CACHES}")
    require_columns(source, *COV)
    require_columns(target, *COV)
    weight = E.inverse(BOTH_COV)
    if cache == "compact":
        weight = [f"CAST({w} AS FLOAT)" for w in weight]
    return _rows(_matched(source, target, m, max_distance, COV, search=search), DIFFERENCE, weight, factor_id, ("src_id", "tgt_id"))


def vgicp(source: DataFrame, voxels: DataFrame, resolution: float, m: Matrix, factor_id: int = 0, surface_validation: bool = False) -> DataFrame:
    """Distribution to the voxel it falls into: one hash join, no neighbour search. With surface_validation, points whose moved normal faces away do not count."""
    from ..operators.rows import facing_away

    require_columns(source, *COV)
    require_columns(voxels, "vkey", "mx", "my", "mz", *COV)
    chosen = source.where(~F.expr(facing_away(m))) if surface_validation else source
    placed = moved(chosen, m).withColumn("vkey", F.expr(E.voxel_key(resolution, *P)))
    goal = voxels.select("vkey", *[F.col(f"m{c}").alias(f"q{i}") for i, c in enumerate(XYZ)], *[F.col(c).alias(f"t{c}") for c in COV])
    both = [f"({s} + {t})" for s, t in zip(SOURCE_COV, TARGET_COV, strict=True)]
    return _rows(placed.join(goal, "vkey"), DIFFERENCE, E.inverse(both), factor_id, ("src_id", "vkey"))


def motions_table(spark, motions: dict[int, Matrix]) -> DataFrame:
    """factor_id, m00..m23 of each factor's motion: one row a factor."""
    rows = [(int(k), *[float(m[i][j]) for i in range(3) for j in range(4)]) for k, m in motions.items()]
    return spark.createDataFrame(rows, "factor_id long, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(4)))


#: So many motions (104 bytes each) are sent to every task; beyond it they are joined by factor.
BROADCAST_MOTIONS = 100_000


def vgicp_batch(source: DataFrame, voxels: DataFrame, motions: dict[int, Matrix], resolution: float) -> DataFrame:
    """All factors in one table and one plan, however many they are: source(factor_id, point_id, x.., c00..) and voxels with a
    factor_id, or without one if all factors share their target. Each source point is moved by its factor's motion, a column of a join;
    which points are inliers is decided anew for the motions of each call."""
    require_columns(source, "factor_id", "point_id", *XYZ, *COV)
    require_columns(voxels, "vkey", "mx", "my", "mz", *COV)
    table = motions_table(source.sparkSession, motions)
    joined = source.join(F.broadcast(table) if len(motions) <= BROADCAST_MOTIONS else table, "factor_id")
    place = [F.expr(" + ".join([f"m{i}{j} * {XYZ[j]}" for j in range(3)] + [f"m{i}3"])).alias(P[i]) for i in range(3)]
    c = E.symmetric(COV)
    at = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    turned = [F.expr(" + ".join(f"m{i}{k} * m{j}{n} * {c[k][n]}" for k in range(3) for n in range(3))).alias(SOURCE_COV[x]) for x, (i, j) in enumerate(at)]
    placed = joined.select("factor_id", F.col("point_id").alias("src_id"), *place, *turned).withColumn("vkey", F.expr(E.voxel_key(resolution, *P)))
    keys = ["factor_id", "vkey"] if "factor_id" in voxels.columns else ["vkey"]
    goal = voxels.select(*keys, *[F.col(f"m{x}").alias(f"q{i}") for i, x in enumerate(XYZ)], *[F.col(x).alias(f"t{x}") for x in COV])
    both = [f"({s} + {t})" for s, t in zip(SOURCE_COV, TARGET_COV, strict=True)]
    made = placed.join(goal, keys)
    return made.select("factor_id", "src_id", "vkey", *P, *[F.expr(e).alias(n) for n, e in zip(R, DIFFERENCE, strict=True)], *[F.expr(e).alias(n) for n, e in zip(WEIGHT, E.inverse(both), strict=True)])


def _several(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float, k: int) -> DataFrame:
    """Sources with all of their k nearest targets within the distance: src_id, p, and a_i_x.. of the i-th target."""
    near = nearest(source, target, m, max_distance, k)
    goal = near.join(target.select(F.col("point_id").alias("tgt_id"), *XYZ), "tgt_id")
    pivot = [F.max(F.when(F.col("rank") == i + 1, F.col(c))).alias(f"a{i}{c}") for i in range(k) for c in XYZ]
    return goal.groupBy("src_id").agg(F.count(F.lit(1)).alias("n"), *pivot).where(F.col("n") == k).join(moved(source, m), "src_id")


def loam_edge(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float = 1.0, factor_id: int = 0, validate: bool = False) -> DataFrame:
    """Point to the line of the two nearest edge points: the offset from the line, a vector. With validate, both may not lie on one scan line (0.1 degrees)."""
    found = _several(source, target, m, max_distance, 2)
    if validate:
        found = found.where(F.expr(f"abs({scan_angle('a0')} - {scan_angle('a1')}) >= {0.1 * np.pi / 180!r}"))
    line = E.minus([f"a1{c}" for c in XYZ], [f"a0{c}" for c in XYZ])
    found = found.select("*", *[F.expr(e).alias(f"l{i}") for i, e in enumerate(line)]).withColumn("ll", F.expr(E.norm2(["l0", "l1", "l2"]))).where("ll > 0")
    off = [f"(a0{c} - p{i})" for i, c in enumerate(XYZ)]
    along = f"({E.dot(off, ['l0', 'l1', 'l2'])} / ll)"
    # the residual loses what is along the line; its weight projects the Jacobian likewise
    weight = [f"({'1.0' if i == j else '0.0'} - l{i} * l{j} / ll)" for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
    return _rows(found, [f"({off[i]} - {along} * l{i})" for i in range(3)], weight, factor_id)


def loam_plane(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float = 1.0, factor_id: int = 0, validate: bool = False) -> DataFrame:
    """Point to the plane of the three nearest: the residual times the plane's normal, element by element."""
    found = _several(source, target, m, max_distance, 3)
    if validate:
        same = [f"abs({scan_angle(f'a{i}')} - {scan_angle(f'a{j}')}) < {0.1 * np.pi / 180!r}" for i, j in ((0, 1), (0, 2))]
        found = found.where(~F.expr(" AND ".join(same)))
    n = E.cross(E.minus([f"a1{c}" for c in XYZ], [f"a0{c}" for c in XYZ]), E.minus([f"a2{c}" for c in XYZ], [f"a0{c}" for c in XYZ]))
    found = found.select("*", *[F.expr(e).alias(f"n{i}") for i, e in enumerate(n)]).withColumn("nn", F.expr(E.norm2(["n0", "n1", "n2"]))).where("nn > 0")
    w = ("n0 * n0 / nn", "0.0", "0.0", "n1 * n1 / nn", "0.0", "n2 * n2 / nn")
    return _rows(found, [f"(a0{c} - p{i})" for i, c in enumerate(XYZ)], w, factor_id)


def loam(edges: tuple[DataFrame, DataFrame], planes: tuple[DataFrame, DataFrame], m: Matrix, max_distance: float = 1.0, factor_id: int = 0) -> DataFrame:
    return loam_edge(*edges, m, max_distance, factor_id).unionByName(loam_plane(*planes, m, max_distance, factor_id))


def color_consistency(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float = 1.0, factor_id: int = 0, weight: float = 1.0) -> DataFrame:
    """The target's intensity carried along its gradient to the source point's projection, less the source's intensity.

    As a row for linearize: the scalar e with Jacobian -g (projected) is a residual along g of weight 1 / |g|^2 outer products.
    """
    require_columns(target, *_COLOR)
    return _color_rows(_matched(source, target, m, max_distance, _COLOR, ("intensity",)), factor_id, weight)


#: What color consistency takes of a target point.
_COLOR = (*NORMAL, "intensity", "gx", "gy", "gz")


def _color_rows(found: DataFrame, factor_id: int, weight: float) -> DataFrame:
    d = [f"(p{i} - q{i})" for i in range(3)]
    n, g = ("tnx", "tny", "tnz"), ("tgx", "tgy", "tgz")
    found = found.withColumn("along", F.expr(E.dot(d, n)))
    proj = [f"({d[i]} - along * {n[i]})" for i in range(3)]
    found = found.withColumn("e", F.expr(f"tintensity + {E.dot(g, proj)} - intensity"))
    # gradient in the tangent plane: what a move of the point changes
    found = found.withColumn("gn", F.expr(E.dot(g, n))).select("*", *[F.expr(f"{g[i]} - gn * {n[i]}").alias(f"h{i}") for i in range(3)]).withColumn("hh", F.expr(E.norm2(["h0", "h1", "h2"])))
    found = found.where("hh > 1e-12")
    outer = [f"({weight!r} * h{i} * h{j})" for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
    return _rows(found, [f"(-e * h{i} / hh)" for i in range(3)], outer, factor_id, ("src_id", "tgt_id"))


def colored_gicp(source: DataFrame, target: DataFrame, m: Matrix, max_distance: float = 1.0, factor_id: int = 0, photometric: float = 0.25) -> DataFrame:
    """(1 - w) of GICP and w of color consistency; both are of the same matches, which are sought once."""
    require_columns(source, *COV)
    require_columns(target, *COV, *_COLOR)
    found = cut(_matched(source, target, m, max_distance, (*COV, *_COLOR), ("intensity",)), "matches")
    shape = _rows(found, DIFFERENCE, E.inverse(BOTH_COV), factor_id)
    shape = shape.select(*[(F.col(c) * (1 - photometric)).alias(c) if c in WEIGHT else F.col(c) for c in shape.columns])
    return shape.unionByName(_color_rows(found, factor_id, photometric).drop("tgt_id"))


def time_buckets(times: np.ndarray, gap: float = 1e-3) -> np.ndarray:
    """The bucket of each of the sorted times: a new one starts more than gap after the bucket's first."""
    out, anchor, bucket = np.zeros(len(times), int), None, -1
    for i, t in enumerate(times):
        if anchor is None or t - anchor > gap:
            anchor, bucket = t, bucket + 1
        out[i] = bucket
    return out


def time_table(df: DataFrame, gap: float = 1e-3) -> DataFrame:
    """(frame_id, point_id, bucket, t): anchored buckets of each frame's sorted times, t divided by the frame's last. A frame is one scan of bounded length."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "point_id"])
        last = pdf.t.iloc[-1]
        return pd.DataFrame({"frame_id": pdf.frame_id, "point_id": pdf.point_id, "bucket": time_buckets(pdf.t.to_numpy(), gap), "t": pdf.t / last if last else 0.0})

    return df.select("frame_id", "point_id", "t").groupBy("frame_id").applyInPandas(run, "frame_id long, point_id long, bucket long, t double")


def stamps_of(buckets: int) -> list[float]:
    return [(b + 0.5) / buckets for b in range(buckets)]


def deskew(source: DataFrame, m0: np.ndarray, m1: np.ndarray, stamps: list[float] | None = None) -> DataFrame:
    """source(point_id, x, y, z, t in 0..1) placed by the pose of its time between m0 and m1, with a column `bucket`: the number of the
    stamp nearest to t. Poses are made for each of the stamps (64 by default; a scan's distinct times for a pose each) and joined."""
    stamps = stamps or stamps_of(64)
    poses = [lie.interpolate(np.asarray(m0, float), np.asarray(m1, float), t) for t in stamps]
    table = source.sparkSession.createDataFrame([(b, *[float(p[i][j]) for i in range(3) for j in range(4)]) for b, p in enumerate(poses)], "bucket int, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(4)))
    # the walls between neighbouring stamps, in order
    walls = F.array(*[F.lit((a + b) / 2) for a, b in zip(stamps, stamps[1:], strict=False)]).cast("array<double>")
    bucket = F.size(F.filter(walls, lambda w: w <= F.col("t"))) if len(stamps) <= 256 else F.call_function("width_bucket", F.col("t"), F.lit(float(stamps[0])), F.lit(float(stamps[-1])), F.lit(len(stamps))).cast("int") - 1
    keyed = source.withColumn("bucket", F.greatest(F.lit(0), F.least(bucket, F.lit(len(stamps) - 1))).cast("int")).join(F.broadcast(table), "bucket")
    new = {c: F.expr(" + ".join([f"m{i}{j} * {XYZ[j]}" for j in range(3)] + [f"m{i}3"])) for i, c in enumerate(XYZ)}
    turn = {}
    if all(c in source.columns for c in COV):
        s, at = E.symmetric(COV), ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
        turn = {COV[x]: F.expr(" + ".join(f"m{i}{k} * m{j}{n} * {s[k][n]}" for k in range(3) for n in range(3))) for x, (i, j) in enumerate(at)}
    new |= turn
    return keyed.select(*[new[c].alias(c) if c in new else F.col(c) for c in source.columns], "bucket")


def ct_icp(source: DataFrame, target: DataFrame, m0: np.ndarray, m1: np.ndarray, max_distance: float = 1.0, factor_id: int = 0, stamps: list[float] | None = None) -> DataFrame:
    """Continuous-time ICP: the distance along the target's normal of each point placed by its time; src_t is that time, bucket the
    number of its stamp. optimize.ContinuousFactor carries the buckets' systems to both poses."""
    require_columns(source, "t")
    require_columns(target, *NORMAL)
    placed = deskew(source, m0, m1, stamps)
    found = _matched(placed, target, np.eye(4), max_distance, NORMAL, ("t", "bucket")).withColumnRenamed("t", "src_t")
    w = [f"(tn{a} * tn{b})" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    return _rows(found, DIFFERENCE, w, factor_id, ("src_id", "tgt_id", "src_t", "bucket"))


def ct_gicp(source: DataFrame, target: DataFrame, m0: np.ndarray, m1: np.ndarray, max_distance: float = 1.0, factor_id: int = 0, stamps: list[float] | None = None) -> DataFrame:
    """The same with distributions: the source's covariances turn with the pose of their time."""
    require_columns(source, "t", *COV)
    placed = deskew(source, m0, m1, stamps)
    both = [f"({s} + {t})" for s, t in zip(SOURCE_COV, TARGET_COV, strict=True)]
    found = _matched(placed, target, np.eye(4), max_distance, COV, ("t", "bucket")).withColumnRenamed("t", "src_t")
    return _rows(found, DIFFERENCE, E.inverse(both), factor_id, ("src_id", "tgt_id", "src_t", "bucket"))
