"""Queries of the engine's own operators over the carrier tables, with the SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import expr as E
from .operators import features, metric, neighbors, occupancy, rows, sampling, stats, voxels
from .plans import factors, linearize
from .schema import COV, NORMAL, XYZ
from .scratch import cut
from .sources.tables import CLOUD_L_SQL, CLOUD_T_SQL, cloud_e, cloud_e_sql, cloud_l, cloud_t, features_e

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTE = f"WITH {cloud_e_sql()}, {CLOUD_T_SQL}, {CLOUD_L_SQL}"


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; sql is what follows the common table expressions e, t and l (starting with a comma or SELECT)."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"{CTE}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
        return f

    return put


def r6(*names: str, digits: int = 6) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in names]


def q6(*pairs: tuple[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({e}, {digits}) AS {n}" for n, e in pairs)


# Fixed poses of the queries.
C, S = math.cos(0.3), math.sin(0.3)
POSE = [[C, -S, 0.0, 0.25], [S, C, 0.0, -0.4], [0.0, 0.0, 1.0, 0.15]]
SHEAR = [[1.5, 0.25, 0.0, 0.5], [0.0, 0.75, 0.125, -1.0], [0.25, 0.0, 2.0, 0.25]]
POSES = {k: [[1.0, 0.0, 0.0, 0.3 * k], [0.0, 1.0, 0.0, -0.2 * k], [0.0, 0.0, 1.0, 0.1 * k]] for k in range(10)}
RES, FINE = 0.5, 1.0


def moved_sql(m, table: str = "e", extra: str = "") -> str:
    columns = ", ".join(f"{x} AS {c}" for x, c in zip(E.moved(m, XYZ), XYZ, strict=True))
    return f"SELECT point_id, {columns}{extra} FROM {table}"


# --- scans and rows -------------------------------------------------------------------------------------------------


@query("io11_arange_timestamps", "SELECT round(i * 0.25, 6) AS stamp FROM range(0, 41) g(i) UNION ALL SELECT 10.1")
def io11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.trajectory import arange_timestamps

    return arange_timestamps(spark, 0.0, 10.1, 0.25).select(*r6("stamp"))


@query("io11_arange_of_a_trajectory", "SELECT round(f + i * 3600.0, 6) AS stamp FROM (SELECT 0.0 AS f, max(t) AS l FROM t), range(0, 100000) g(i) WHERE f + i * 3600.0 <= l UNION ALL SELECT round(max(t), 6) FROM t")
def io11_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative ends are the first and last stamps given."""
    from .plans.trajectory import arange_timestamps

    lo, hi = cloud_t(spark, sf_dir).agg(F.min("t"), F.max("t")).head()
    return arange_timestamps(spark, -1.0, -1.0, 3600.0, (lo, hi)).select(*r6("stamp"))


@query("io13_memory_usage", "SELECT c AS \"column\", count(*) * 8 AS bytes FROM e, (VALUES ('point_id'), ('x'), ('y'), ('z')) v(c) GROUP BY c")
def io13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.memory_usage(cloud_e(spark, sf_dir, "point_id", *XYZ))


@query("p1_add_attribute", f"SELECT point_id, {q6(('x', 'x'), ('nx', 'nx'), ('intensity', 'intensity'))} FROM e")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir)
    return rows.add_attribute(df.select("point_id", "x"), df.select("point_id", "nx", "intensity")).select("point_id", *r6("x", "nx", "intensity"))


@query("p2_aux_attribute", f"SELECT point_id, {q6(('aux', 'x * 2'))} FROM e")
def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir).withColumn("aux", F.col("x") * 2)
    return df.select("point_id", F.round(rows.attribute(df, "aux"), 6).alias("aux"))


@query("p3_clone", f"SELECT point_id, frame_id, {q6(*[(c, c) for c in XYZ])} FROM e")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ).select("point_id", "frame_id", *r6(*XYZ))


@query("p4_sample", f", i AS (SELECT g AS pos, (g * 7) % 100 AS point_id FROM range(0, 150) r(g)) SELECT pos, point_id, {q6(('x', 'x'))} FROM i JOIN e USING (point_id)")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    indices = spark.range(150).select(F.col("id").alias("pos"), (F.col("id") * 7 % 100).alias("point_id"))
    return rows.sample(cloud_e(spark, sf_dir, "point_id", "x"), indices).select("pos", "point_id", *r6("x"))


@query("p5_filter", f"SELECT point_id, {q6(('x', 'x'))} FROM e WHERE x > 0.5 AND z < 1.0")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.where(cloud_e(spark, sf_dir), "x > 0.5 AND z < 1.0").select("point_id", *r6("x"))


@query("p6_filter_by_index", f"SELECT point_id, {q6(('x', 'x'))} FROM e WHERE point_id % 3 = 0 AND intensity > 0")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.where(cloud_e(spark, sf_dir), (F.col("point_id") % 3 == 0) & (F.col("intensity") > 0)).select("point_id", *r6("x"))


def _transform(m, affine: bool) -> tuple[Callable, str]:
    import numpy as np

    turn = np.linalg.inv(np.array(m)[:, :3]).T if affine else np.array(m)[:, :3]
    named = [*zip(XYZ, E.moved(m, XYZ), strict=True), *zip(NORMAL, E.moved(turn, NORMAL, shift=False), strict=True), *zip(COV, E.rotated_cov(np.array(m)[:, :3]), strict=True)]
    return lambda spark, sf_dir: rows.transform(cloud_e(spark, sf_dir), m, affine).select("point_id", *r6(*XYZ, *NORMAL, *COV)), f"SELECT point_id, {q6(*named)} FROM e"


for _name, _m, _affine in (("p7_transform", POSE, False), ("p8_transform_affine", SHEAR, True), ("p9_transform_inplace", POSE, False)):
    _f, _sql = _transform(_m, _affine)
    query(_name, _sql)(_f)


@query("p11_voxel_coord", f"SELECT point_id, {', '.join(f'{E.voxel(c, RES)} AS v{c}' for c in XYZ)} FROM e")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_e(spark, sf_dir).select("point_id", *[F.expr(E.voxel(c, RES)).alias(f"v{c}") for c in XYZ])


@query("p12_voxel_key", f"SELECT point_id, {E.voxel_key(RES)} AS vkey FROM e")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_e(spark, sf_dir).select("point_id", F.expr(E.voxel_key(RES)).alias("vkey"))


def _wrapped_sql(v: str, p: int) -> str:
    d = f"((({v})::HUGEINT * {p}) % {1 << 64} + {1 << 64}) % {1 << 64}"
    return f"CAST(CASE WHEN {d} >= {1 << 63} THEN {d} - {1 << 64} ELSE {d} END AS BIGINT)"


@query("p13_spatial_hash", f"SELECT point_id, xor(xor({_wrapped_sql(E.voxel('x', RES), rows.XOR_FACTORS[0])}, {_wrapped_sql(E.voxel('y', RES), rows.XOR_FACTORS[1])}), {_wrapped_sql(E.voxel('z', RES), rows.XOR_FACTORS[2])}) AS hash FROM e")
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_e(spark, sf_dir).select("point_id", F.expr(rows.xor_hash(*[E.voxel(c, RES) for c in XYZ])).alias("hash"))


@query("p14_distances", f", s AS (SELECT CASE WHEN count(*) < 100 THEN 1 ELSE count(*) // 100 END AS step FROM e) SELECT point_id, {q6(('dist', 'sqrt(x * x + y * y + z * z)'))} FROM e, s WHERE point_id % step = 0")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.distances(cloud_e(spark, sf_dir, "point_id", *XYZ), 100).select("point_id", *r6("dist"))


@query("p15_compact_cov", f"SELECT point_id, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 6) AS {c}' for c in COV)} FROM e")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.compact_cov(cloud_e(spark, sf_dir, "point_id", *COV)).select("point_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in COV])


@query("p18_surface_validation", f"SELECT point_id FROM e WHERE NOT {rows.facing_away(POSE)}")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_e(spark, sf_dir).where(~F.expr(rows.facing_away(POSE))).select("point_id")


@query("p19_scan_angle", f"SELECT point_id, {q6(('angle', rows.scan_angle()))} FROM e")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_e(spark, sf_dir, "point_id", *XYZ).select("point_id", F.round(F.expr(rows.scan_angle()), 6).alias("angle"))


def _raycast_sql() -> str:
    size, start = 0.25, 0.05
    v = E.voxel(repr(start), size)
    walls = " UNION ALL ".join(
        f"SELECT point_id AS ray_id, {k} AS axis, CASE WHEN w{c} > {v} THEN 1 ELSE -1 END AS move, (i.i * {size!r} - {start!r}) / ({c} - {start!r}) AS s "
        f"FROM c, unnest(range(least(w{c}, {v}) + 1, greatest(w{c}, {v}) + 1)) AS i(i)"
        for k, c in enumerate(XYZ)
    )
    at = ", ".join(f"CAST({v} + coalesce(sum(CASE WHEN axis = {k} THEN move END) OVER (PARTITION BY ray_id ORDER BY s, axis ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v{c}" for k, c in enumerate(XYZ))
    return f", c AS (SELECT point_id, {', '.join(XYZ)}, {', '.join(f'{E.voxel(c, size)} AS w{c}' for c in XYZ)} FROM e), w AS ({walls}) SELECT ray_id, row_number() OVER (PARTITION BY ray_id ORDER BY s, axis) - 1 AS step, {at} FROM w"


@query("p20_voxel_raycast", _raycast_sql())
def p20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rays = cloud_e(spark, sf_dir, "point_id", *XYZ).select(F.col("point_id").alias("ray_id"), *[F.lit(0.05).alias(f"s{c}") for c in XYZ], *[F.col(c).alias(f"e{c}") for c in XYZ])
    return rows.raycast(rays, 0.25)


@query("p23_calc_index", "SELECT point_id, (frame_id << 32) + point_id AS idx, frame_id AS voxel_id, point_id AS slot FROM e")
def p23(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", "frame_id").withColumn("idx", rows.composite_index(F.col("frame_id"), F.col("point_id")))
    a, b = rows.split_index(F.col("idx"))
    return df.select("point_id", "idx", a.alias("voxel_id"), b.alias("slot"))


# --- neighbour joins ------------------------------------------------------------------------------------------------

PAIR_D2 = "(q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) + (q.z - p.z) * (q.z - p.z)"


def near_sql(where: str, k: int | None, d2: str = PAIR_D2, q: str = "e", p: str = "e", name: str = "n") -> str:
    """name(qid, point_id, d2, rank) by brute force."""
    rank = "" if k is None else f" QUALIFY rank <= {k}"
    return f", {name} AS (SELECT q.point_id AS qid, p.point_id AS point_id, {d2} AS d2, row_number() OVER (PARTITION BY q.point_id ORDER BY {d2}, p.point_id) AS rank FROM {q} q, {p} p WHERE {where}{rank})"


NEAR_OUT = "SELECT qid, point_id, round(d2, 6) AS d2, CAST(rank AS INT) AS rank FROM n"


def near_out(df: DataFrame) -> DataFrame:
    return df.select("qid", "point_id", *r6("d2"), F.col("rank").cast("int").alias("rank"))


@query("j1_knn", near_sql("TRUE", 5) + NEAR_OUT)
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    return near_out(neighbors.knn(neighbors.as_queries(df), df, 5))


@query("j1_knn_bounded", near_sql(f"{PAIR_D2} < 1.21", 7) + NEAR_OUT)
def j1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    return near_out(neighbors.knn(neighbors.as_queries(df), df, 7, max_sq_dist=1.21))


@query("j3_radius_search", near_sql(f"{PAIR_D2} < 1.0", None) + NEAR_OUT)
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    return near_out(neighbors.radius_search(neighbors.as_queries(df), df, 1.0))


@query("j3_radius_search_top", near_sql(f"{PAIR_D2} < 1.0", 5) + NEAR_OUT)
def j3b(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    return near_out(neighbors.radius_search(neighbors.as_queries(df), df, 1.0, 5))


FEATURE_D2 = "list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda v: (CAST(v[1] AS DOUBLE) - v[2]) * (CAST(v[1] AS DOUBLE) - v[2])))"


@query("j4_knn_feature", f", d AS (SELECT q.vec_id AS qid, p.vec_id AS point_id, {FEATURE_D2} AS d2 FROM embeddings q, embeddings p), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, point_id) AS rank FROM d QUALIFY rank <= 3) " + NEAR_OUT)
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features_e(spark, sf_dir)
    return near_out(metric.knn_feature(f.select(F.col("point_id").alias("qid"), "f"), f, 3))


@query("j4_knn_feature_index", f", d AS (SELECT q.vec_id AS qid, p.vec_id AS point_id, {FEATURE_D2} AS d2 FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, point_id) AS rank FROM d QUALIFY rank <= 10) " + NEAR_OUT)
def j4_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all, through an index of many small partitions."""
    f = features_e(spark, sf_dir)
    index = metric.build_index(f, rows_a_pivot=64)
    return near_out(metric.search(index, f.where("point_id % 100 = 0").select(F.col("point_id").alias("qid"), "f"), 10))


XYZI = PAIR_D2 + " + (q.intensity - p.intensity * 2.0) * (q.intensity - p.intensity * 2.0)"


@query("j5_knn_xyzi", near_sql(f"{XYZI} < 1.0", 4, XYZI) + NEAR_OUT)
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ, "intensity")
    q = df.select(F.col("point_id").alias("qid"), *[F.col(c).alias(f"q{c}") for c in XYZ], F.col("intensity").alias("qi"))
    return near_out(neighbors.knn_xyzi(q, df, 4, 2.0, 1.0, 1.0))


def _cells(n: int) -> str:
    d = " + ".join(f"abs({E.voxel('q.' + c, FINE)} - {E.voxel('p.' + c, FINE)})" for c in XYZ)
    ring = " AND ".join(f"abs({E.voxel('q.' + c, FINE)} - {E.voxel('p.' + c, FINE)}) <= 1" for c in XYZ)
    return {7: f"{d} <= 1", 27: ring}[n]


@query("j6_knn_voxel", near_sql(_cells(7), 5) + NEAR_OUT)
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    return near_out(neighbors.knn_voxel(neighbors.as_queries(df), df, 5, FINE))


@query("j7_knn_valid", near_sql(f"{_cells(27)} AND p.intensity > 0", 5) + NEAR_OUT)
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ, "intensity")
    return near_out(neighbors.knn_voxel(neighbors.as_queries(df), df, 5, FINE, 27, valid=F.col("intensity") > 0))


MAP_SQL = f", v AS (SELECT {E.voxel_key(FINE)} AS vkey, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {', '.join(f'avg({c}) AS {c}' for c in COV)}, max(intensity) AS intensity FROM e WHERE frame_id < 5 GROUP BY 1)"


def target_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.gaussian_voxelmap(cloud_e(spark, sf_dir).where("frame_id < 5"), FINE)


@query("j8_voxel_lookup", MAP_SQL + f", s AS (SELECT point_id, {E.voxel_key(FINE)} AS vkey FROM e) SELECT s.point_id, s.vkey, coalesce(v.n, 0) AS n FROM s LEFT JOIN v USING (vkey)")
def j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.voxel_lookup(cloud_e(spark, sf_dir, "point_id", *XYZ), target_map(spark, sf_dir).select("vkey", "n"), FINE).select("point_id", "vkey", F.coalesce("n", F.lit(0)).alias("n"))


def hits_sql(m, where: str = "frame_id >= 5") -> str:
    return f", s AS ({moved_sql(m, 'e', ', frame_id')}), k AS (SELECT point_id, {E.voxel_key(FINE)} AS vkey FROM s WHERE {where})"


@query("j9_overlap", MAP_SQL + hits_sql(POSE) + " SELECT count(*) AS n, count(v.vkey) AS hits, round(count(v.vkey) / count(*), 6) AS rate FROM k LEFT JOIN v USING (vkey)")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = cloud_e(spark, sf_dir).where("frame_id >= 5")
    return voxels.overlap(source, target_map(spark, sf_dir), FINE, POSE).select("n", "hits", *r6("rate"))


MULTI_SQL = f", m AS (SELECT DISTINCT frame_id AS map_id, {E.voxel_key(FINE)} AS vkey FROM e WHERE frame_id < 5), p AS ({' UNION ALL '.join(f'SELECT {k} AS map_id, {0.3 * k!r} AS dx, {-0.2 * k!r} AS dy, {0.1 * k!r} AS dz' for k in range(5))}), s AS (SELECT map_id, point_id, x + dx AS x, y + dy AS y, z + dz AS z FROM e, p WHERE frame_id >= 5), k AS (SELECT map_id, point_id, {E.voxel_key(FINE)} AS vkey FROM s), h AS (SELECT count(DISTINCT point_id) AS hits FROM k JOIN m USING (map_id, vkey))"


@query("j10_overlap_multi", MULTI_SQL + " SELECT count(*) AS n, any_value(hits) AS hits, round(any_value(hits) / count(*), 6) AS rate FROM e, h WHERE frame_id >= 5")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir)
    maps = voxels.with_voxel(df.where("frame_id < 5"), FINE).select(F.col("frame_id").alias("map_id"), "vkey")
    return voxels.overlap_multi(df.where("frame_id >= 5"), maps, {k: POSES[k] for k in range(5)}, FINE).select("n", "hits", *r6("rate"))


@query("j11_overlap_pairs", f", m AS (SELECT DISTINCT frame_id AS map_id, {E.voxel_key(FINE)} AS vkey FROM e), s AS (SELECT frame_id AS source_id, {E.voxel_key(FINE)} AS vkey FROM e), c AS (SELECT source_id, count(*) AS n FROM s GROUP BY 1) SELECT source_id, map_id, count(*) AS hits, any_value(n) AS n, round(count(*) / any_value(n), 6) AS rate FROM s JOIN m USING (vkey) JOIN c USING (source_id) GROUP BY 1, 2")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    maps = voxels.with_voxel(df, FINE).select(F.col("frame_id").alias("map_id"), "vkey")
    return voxels.overlap_pairs(df, maps, FINE).select("source_id", "map_id", "hits", "n", *r6("rate"))


@query("j12_occupancy_overlap", f", o AS (SELECT DISTINCT {E.voxel_key(FINE)} AS vkey FROM e WHERE frame_id < 5), s AS (SELECT point_id, {E.voxel_key(FINE)} AS vkey FROM e WHERE frame_id >= 5) SELECT point_id, CAST(o.vkey IS NOT NULL AS INT) AS hit FROM s LEFT JOIN o USING (vkey)")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    return voxels.overlap_flags(df.where("frame_id >= 5"), voxels.occupancy(df.where("frame_id < 5"), FINE), FINE).select("point_id", "hit")


def corr_sql(k: int, distance: float) -> str:
    """n for source frames 5.. against target frames 0..4."""
    return f", src AS (SELECT * FROM e WHERE frame_id >= 5), tgt AS (SELECT * FROM e WHERE frame_id < 5)" + near_sql(f"{PAIR_D2} < {distance * distance!r}", k, q="src", p="tgt")


@query("j13_corr_1nn", corr_sql(1, 1.1) + " SELECT src.point_id AS src_id, coalesce(n.point_id, -1) AS tgt_0, round(coalesce(d2, -1), 6) AS d2_0 FROM src LEFT JOIN n ON src.point_id = n.qid")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    return neighbors.correspondences(df.where("frame_id >= 5"), df.where("frame_id < 5"), 1.1).select("src_id", F.coalesce("tgt_0", F.lit(-1)).alias("tgt_0"), F.round(F.coalesce("d2_0", F.lit(-1.0)), 6).alias("d2_0"))


@query("j14_corr_3nn", corr_sql(3, 1.1) + " SELECT qid AS src_id, max(CASE WHEN rank = 1 THEN point_id END) AS tgt_0, max(CASE WHEN rank = 2 THEN point_id END) AS tgt_1, max(CASE WHEN rank = 3 THEN point_id END) AS tgt_2 FROM n GROUP BY qid HAVING count(*) = 3")
def j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    return neighbors.correspondences(df.where("frame_id >= 5"), df.where("frame_id < 5"), 1.1, 3).where("n = 3").select("src_id", "tgt_0", "tgt_1", "tgt_2")


@query("j15_corr_reciprocal", f", d AS (SELECT q.vec_id AS a_id, p.vec_id AS b_id, {FEATURE_D2} AS d2 FROM embeddings q, embeddings p WHERE q.label < 5 AND p.label >= 5), f AS (SELECT a_id, b_id FROM d QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY d2, b_id) = 1), b AS (SELECT a_id, b_id FROM d QUALIFY row_number() OVER (PARTITION BY b_id ORDER BY d2, a_id) = 1) SELECT a_id, b_id FROM f JOIN b USING (a_id, b_id)")
def j15(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("f"), "label")
    return metric.reciprocal(emb.where("label < 5").select("point_id", "f"), emb.where("label >= 5").select("point_id", "f"))


@query("j17_nearest_stamp", ", k AS (SELECT DISTINCT t AS stamp FROM t WHERE z < 5), a AS (SELECT point_id AS qid, t.t AS qt, k.stamp AS prev FROM t ASOF LEFT JOIN k ON t.t >= k.stamp), b AS (SELECT a.*, k.stamp AS next FROM a ASOF LEFT JOIN k ON a.qt <= k.stamp) SELECT qid, round(CASE WHEN prev IS NULL THEN next WHEN next IS NULL OR qt - prev <= next - qt THEN prev ELSE next END, 6) AS stamp FROM b")
def j17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points' stamps against those of one sensor (the points of z below 5)."""
    t = cloud_t(spark, sf_dir)
    return neighbors.nearest_stamp(t.select(F.col("point_id").alias("qid"), "t"), t.where("z < 5").select(F.col("t").alias("stamp")), 3600.0).select("qid", *r6("stamp"))


FAR = (500_000.0, 4_000_000.0, 100.0)


@query("j1_knn_far", f", f AS (SELECT point_id, {', '.join(f'{c} + {v!r} AS {c}' for c, v in zip(XYZ, FAR, strict=True))} FROM e)" + near_sql("TRUE", 5, q="f", p="f") + "SELECT qid, point_id, round(d2, 4) AS d2, CAST(rank AS INT) AS rank FROM n")
def j1_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cloud where map coordinates put it, far from the origin."""
    df = cloud_e(spark, sf_dir, "point_id", *XYZ).select("point_id", *[(F.col(c) + v).alias(c) for c, v in zip(XYZ, FAR, strict=True)])
    return neighbors.knn(neighbors.as_queries(df), df, 5).select("qid", "point_id", *r6("d2", digits=4), F.col("rank").cast("int").alias("rank"))


@query("j3_radius_search_far", f", f AS (SELECT point_id, {', '.join(f'{c} + {v!r} AS {c}' for c, v in zip(XYZ, FAR, strict=True))} FROM e)" + near_sql(f"{PAIR_D2} < 0.25", None, q="f", p="f") + "SELECT qid, point_id, round(d2, 4) AS d2, CAST(rank AS INT) AS rank FROM n")
def j3_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ).select("point_id", *[(F.col(c) + v).alias(c) for c, v in zip(XYZ, FAR, strict=True)])
    return neighbors.radius_search(neighbors.as_queries(df), df, 0.5).select("qid", "point_id", *r6("d2", digits=4), F.col("rank").cast("int").alias("rank"))


# --- aggregations ---------------------------------------------------------------------------------------------------


@query("a1_voxelgrid_sampling", f"SELECT {E.voxel_key(RES)} AS vkey, count(*) AS n, {q6(*[(c, f'avg({c})') for c in (*XYZ, 'intensity', 't', *NORMAL)])} FROM e GROUP BY 1")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.voxelgrid_sampling(cloud_e(spark, sf_dir), RES).select("vkey", "n", *r6(*XYZ, "intensity", "t", *NORMAL))


@query("a1_voxelgrid_large", f"SELECT {E.voxel_key(5.0)} AS vkey, count(*) AS n, {q6(*[(c, f'avg({c})') for c in (*XYZ, 'intensity')], digits=3)} FROM l GROUP BY 1")
def a1_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.voxelgrid_sampling(cloud_l(spark, sf_dir), 5.0).select("vkey", "n", *r6(*XYZ, "intensity", digits=3))


DRAW = "(((point_id + 0) % 1000003 * 2654435761) % 4294967296)"


@query("a2_randomgrid_sampling", f", k AS (SELECT point_id, {E.voxel_key(2.0)} AS vkey FROM e), c AS (SELECT count(*) AS n, count(DISTINCT vkey) AS v FROM k), r AS (SELECT point_id, row_number() OVER (PARTITION BY vkey ORDER BY {DRAW}, point_id) AS place FROM k), o AS (SELECT point_id, row_number() OVER (ORDER BY {DRAW}, point_id) AS o, n FROM r, c WHERE place <= ceil(0.25 * n / v)) SELECT point_id FROM o WHERE o <= floor(1.2 * 0.25 * n)")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.randomgrid_sampling(cloud_e(spark, sf_dir, "point_id", *XYZ), 2.0, 0.25).select("point_id")


@query("a3_random_sampling", f", o AS (SELECT point_id, row_number() OVER (ORDER BY {DRAW}, point_id) AS o, count(*) OVER () AS n FROM t) SELECT point_id FROM o WHERE o <= floor(n * 0.3)")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_sampling(cloud_t(spark, sf_dir), 0.3).select("point_id")


@query("a4_gaussian_voxelmap", f"SELECT {E.voxel_key(FINE)} AS vkey, count(*) AS n, {q6(*[(f'm{c}', f'avg({c})') for c in XYZ], *[(c, f'avg({c})') for c in COV], ('intensity', 'max(intensity)'))} FROM e GROUP BY 1")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.gaussian_voxelmap(cloud_e(spark, sf_dir), FINE).select("vkey", "n", *r6("mx", "my", "mz", *COV, "intensity"))


@query("a4_voxelmap_merge", f"SELECT {E.voxel_key(FINE)} AS vkey, count(*) AS n, {q6(*[(f'm{c}', f'avg({c})') for c in XYZ], ('intensity', 'max(intensity)'))} FROM e GROUP BY 1")
def a4_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir)
    a, b = (voxels.gaussian_voxelmap(df.where(c), FINE) for c in ("frame_id < 5", "frame_id >= 5"))
    return voxels.merge_voxelmaps(a, b).select("vkey", "n", *r6("mx", "my", "mz", "intensity"))


FRAMES_SQL = f", p AS ({' UNION ALL '.join(f'SELECT {k} AS frame_id, {0.3 * k!r} AS dx, {-0.2 * k!r} AS dy, {0.1 * k!r} AS dz' for k in range(10))})"


@query("a6_merge_frames", FRAMES_SQL + f", w AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, c00, c11, intensity FROM e JOIN p USING (frame_id)) SELECT {E.voxel_key(FINE)} AS vkey, count(*) AS n, {q6(*[(c, f'avg({c})') for c in (*XYZ, 'c00', 'c11')], ('intensity', 'max(intensity)'))} FROM w GROUP BY 1")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.merge_frames(cloud_e(spark, sf_dir), POSES, FINE).select("vkey", "n", *r6(*XYZ, "c00", "c11", "intensity"))


@query("a6_merge_frames_large", FRAMES_SQL + f", w AS (SELECT x + dx AS x, y + dy AS y, z + dz AS z, intensity FROM l JOIN p USING (frame_id)) SELECT {E.voxel_key(5.0)} AS vkey, count(*) AS n, {q6(*[(c, f'avg({c})') for c in XYZ], ('intensity', 'max(intensity)'), digits=3)} FROM w GROUP BY 1")
def a6_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.merge_frames(cloud_l(spark, sf_dir), POSES, 5.0).select("vkey", "n", *r6(*XYZ, "intensity", digits=3))


@query("a7_occupied_cells", f"SELECT count(DISTINCT {E.voxel_key(FINE)}) AS cells FROM e")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.num_occupied(cloud_e(spark, sf_dir, *XYZ), FINE)


@query("a7_occupancy_blocks", f", c AS (SELECT DISTINCT {', '.join(f'{E.voxel(c, FINE)} AS v{c}' for c in XYZ)} FROM l) SELECT count(*) AS cells, count(DISTINCT (vx >> 3, vy >> 3, vz >> 3)) AS blocks FROM c")
def a7_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a large cloud as bits: two grids merged into one."""
    df = cloud_l(spark, sf_dir)
    parts = [occupancy.occupancy_blocks(df.where(c), FINE) for c in ("frame_id < 2", "frame_id >= 2")]
    return occupancy.count_cells(occupancy.merge_blocks(*parts))


@query("j12_occupancy_blocks", f", o AS (SELECT DISTINCT {', '.join(f'{E.voxel(c, FINE)} AS v{c}' for c in XYZ)} FROM e WHERE frame_id < 5), s AS (SELECT point_id, {', '.join(f'{E.voxel(c, FINE)} AS v{c}' for c in XYZ)} FROM e WHERE frame_id >= 5) SELECT point_id, o.vx IS NOT NULL AS hit, (SELECT count(*) FROM (SELECT DISTINCT vx, vy, vz FROM s) JOIN o USING (vx, vy, vz)) AS common FROM s LEFT JOIN o USING (vx, vy, vz)")
def j12_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which points of a source lie in a target's cells, and how many cells both have."""
    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    source, target = df.where("frame_id >= 5"), occupancy.occupancy_blocks(df.where("frame_id < 5"), FINE)
    common = occupancy.common_cells(occupancy.occupancy_blocks(source, FINE), target).withColumnRenamed("cells", "common")
    return occupancy.lies_in(source, target, FINE).select("point_id", "hit").join(F.broadcast(common))


DIST = "sqrt(x * x + y * y + z * z)"


@query("a8_minmax_distance", f"SELECT {q6(('min_dist', f'coalesce(min({DIST}), 0)'), ('max_dist', f'coalesce(max({DIST}), 0)'))} FROM e")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.minmax_distance(rows.distances(cloud_e(spark, sf_dir, "point_id", *XYZ), 1 << 40)).select(*r6("min_dist", "max_dist"))


@query("a9_median_distance", f", o AS (SELECT {DIST} AS d, row_number() OVER (ORDER BY {DIST}) AS r, count(*) OVER () AS n FROM e) SELECT round(d, 6) AS median_dist FROM o WHERE r = n // 2 + 1")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.median_distance(rows.distances(cloud_e(spark, sf_dir, "point_id", *XYZ), 1 << 40)).select(*r6("median_dist"))


@query("a10_remove_outliers", near_sql("TRUE", 6) + ", m AS (SELECT qid AS point_id, avg(sqrt(d2)) AS d FROM n GROUP BY 1), s AS (SELECT avg(d) + 0.8 * stddev_pop(d) AS lim FROM m) SELECT point_id, round(d, 6) AS mean_dist FROM m, s WHERE d < lim")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.find_inliers(cloud_e(spark, sf_dir, "point_id", *XYZ), 6, 0.8).select("point_id", *r6("mean_dist"))


MOMENT = {c: f"(sum({a} * {b}) - sum({a}) / count(*) * sum({b})) / count(*)" for c, (a, b) in zip(COV, stats.PAIRS, strict=True)}
MOMENTS_SQL = near_sql("TRUE", 10) + f", m AS (SELECT qid, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {', '.join(f'{v} AS {c}' for c, v in MOMENT.items())} FROM n JOIN e USING (point_id) GROUP BY qid)"


@query("a11_covariance_moments", MOMENTS_SQL + f" SELECT qid, n, {q6(*[(c, c) for c in ('mx', 'my', 'mz', *COV)])} FROM m")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    return features.neighbor_moments(neighbors.knn(neighbors.as_queries(df), df, 10), df).select("qid", "n", *r6("mx", "my", "mz", *COV))


@query("a11_eigenvalues", MOMENTS_SQL + f" SELECT qid, {q6(*[(f'l{i}', x) for i, x in enumerate(E.eigenvalues(COV))], digits=5)} FROM m")
def a11_eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    m = features.neighbor_moments(neighbors.knn(neighbors.as_queries(df), df, 10), df)
    return m.select("qid", *[F.round(F.expr(x), 5).alias(f"l{i}") for i, x in enumerate(E.eigenvalues(COV))])


def least_projection(l0: str, l1: str, l2: str) -> list[str]:
    """The upper triangle of u u' for the least eigenvalue's eigenvector u of COV: a polynomial of the matrix."""
    c = E.symmetric(COV)
    shifted = lambda v: [[f"({c[i][j]} - {v})" if i == j else c[i][j] for j in range(3)] for i in range(3)]
    a, b = shifted(l1), shifted(l2)
    return [f"(({' + '.join(f'{a[i][k]} * {b[k][j]}' for k in range(3))}) / (({l0} - {l1}) * ({l0} - {l2})))" for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


PROJECTED_SQL = MOMENTS_SQL + f", v AS (SELECT *, {', '.join(f'{x} AS l{i}' for i, x in enumerate(E.eigenvalues(COV)))} FROM m), u AS (SELECT qid AS point_id, n, {', '.join(f'{x} AS u{c[1:]}' for c, x in zip(COV, least_projection('l0', 'l1', 'l2'), strict=True))} FROM v)"


@query("a11_covariances", PROJECTED_SQL + f" SELECT point_id, {q6(*[(c, f'{1.0 if c[1] == c[2] else 0.0} - 0.999 * u{c[1:]}') for c in COV], digits=4)} FROM u")
def a11_eig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.covariances(cloud_e(spark, sf_dir, "point_id", *XYZ)).select("point_id", *r6(*COV, digits=4))


@query("a12_running_statistics", f"SELECT count(value) AS n, {q6(('mean', 'avg(value)'), ('var', 'var_pop(value)'), ('std', 'stddev_pop(value)'), ('min', 'min(value)'), ('max', 'max(value)'), digits=4)} FROM events")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.running_statistics(cloud_t(spark, sf_dir), "intensity").select("n", *r6("mean", "var", "std", "min", "max", digits=4))


@query("a18_normals", PROJECTED_SQL + f" SELECT point_id, {q6(*[(f'u{c[1:]}', f'u{c[1:]}') for c in COV], digits=4)}, FALSE AS away FROM u")
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An eigenvector's sign is open where the limit does not set it, so normals are compared by their products; none may face away beyond the limit."""
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    n = dict(zip("012", NORMAL, strict=True))
    out = features.normals(df).join(df, "point_id")
    return out.select("point_id", *[F.round(F.col(n[c[1]]) * F.col(n[c[2]]), 4).alias(f"u{c[1:]}") for c in COV], F.expr(f"{E.dot(XYZ, NORMAL)} > 1.0").alias("away"))


def pair_sql(edges: str, keys: tuple[str, ...]) -> str:
    """f(keys, theta, alpha, phi, dist) of edges(keys, i, j): angles between the oriented points i and j of the cloud."""
    k = ", ".join(keys)
    d, a, b = (["dx", "dy", "dz"], ["nax", "nay", "naz"], ["nbx", "nby", "nbz"])
    both = ", ".join([f"p.{c} - q.{c} AS d{c}" for c in XYZ] + [f"q.n{c} AS na{c}" for c in XYZ] + [f"p.n{c} AS nb{c}" for c in XYZ])
    pick = ", ".join([f"CASE WHEN s THEN nb{c} ELSE na{c} END AS u{c}" for c in XYZ] + [f"CASE WHEN s THEN na{c} ELSE nb{c} END AS w{c}" for c in XYZ] + [f"CASE WHEN s THEN -d{c} ELSE d{c} END AS e{c}" for c in XYZ])
    u, w, e, v = ([f"{n}{c}" for c in XYZ] for n in "uwev")
    unit = [f"({c} / vn)" for c in v]
    ok = "len > 0 AND vn > 0"
    return (
        f", f1 AS (SELECT {k}, {both} FROM {edges} g JOIN e q ON g.i = q.point_id JOIN e p ON g.j = p.point_id), f2 AS (SELECT *, sqrt({E.norm2(d)}) AS len FROM f1)"
        f", f3 AS (SELECT *, {E.dot(a, d)} / len AS aa, {E.dot(b, d)} / len AS bb, abs({E.dot(a, d)} / len) < abs({E.dot(b, d)} / len) AS s FROM f2)"
        f", f4 AS (SELECT {k}, len, CASE WHEN s THEN -bb ELSE aa END AS ph, {pick} FROM f3), f5 AS (SELECT *, {', '.join(f'{x} AS {n}' for n, x in zip(v, E.cross(e, u), strict=True))} FROM f4)"
        f", f6 AS (SELECT *, sqrt({E.norm2(v)}) AS vn FROM f5), f AS (SELECT {k}, CASE WHEN {ok} THEN {E.dot(unit, w)} ELSE 0 END AS alpha, CASE WHEN {ok} THEN atan2({E.dot(E.cross(u, unit), w)}, {E.dot(u, w)}) ELSE 0 END AS theta"
        f", CASE WHEN {ok} THEN ph ELSE 0 END AS phi, CASE WHEN {ok} THEN len ELSE 0 END AS dist FROM f6)"
    )


def bin_sql(n: int) -> list[str]:
    return [f"CAST(least(greatest(floor({n} * ({x})), 0), {n - 1}) AS INT)" for x in ("(theta + pi()) / (2 * pi())", "(alpha + 1.0) / 2.0", "(phi + 1.0) / 2.0")]


NEAR8 = near_sql(f"{PAIR_D2} < {0.8 * 0.8!r}", None)
PFH_SQL = NEAR8 + ", g AS (SELECT x.qid, x.point_id AS i, y.point_id AS j FROM n x JOIN n y USING (qid) WHERE x.point_id > y.point_id)" + pair_sql("g", ("qid",)) + f", c AS (SELECT qid, {bin_sql(5)[0]} * 25 + {bin_sql(5)[1]} * 5 + {bin_sql(5)[2]} AS bin, count(*) AS k FROM f GROUP BY 1, 2), m AS (SELECT qid, count(*) AS n FROM n GROUP BY qid) SELECT qid AS point_id, bin, round(k * 100.0 / (n * (n - 1) / 2), 6) AS value FROM c JOIN m USING (qid)"
_BIN11 = bin_sql(11)
FPFH_SQL = (
    NEAR8 + ", g AS (SELECT qid, qid AS i, point_id AS j FROM n WHERE qid <> point_id)" + pair_sql("g", ("qid",))
    + f", b AS (SELECT qid, {_BIN11[0]} AS bin FROM f UNION ALL SELECT qid, {_BIN11[1]} + 11 FROM f UNION ALL SELECT qid, {_BIN11[2]} + 22 FROM f)"
    + ", m AS (SELECT qid, count(*) AS n FROM g GROUP BY qid), s AS (SELECT qid AS j, bin, count(*) * 100.0 / any_value(n) AS value FROM b JOIN m USING (qid) GROUP BY qid, bin)"
    + ", w AS (SELECT n.qid, bin, sum(value / d2) AS v FROM n JOIN s ON n.point_id = s.j WHERE d2 > 0 GROUP BY 1, 2), z AS (SELECT qid, 100.0 / sum(v) AS s FROM w WHERE bin < 11 GROUP BY qid)"
    + " SELECT qid AS point_id, bin, round(v * s, 6) AS value FROM w JOIN z USING (qid)"
)


@query("a15_pfh", PFH_SQL)
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pfh(cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL), 0.8).select("point_id", "bin", *r6("value"))


@query("a16_fpfh", FPFH_SQL)
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.fpfh(cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL), 0.8).select("point_id", "bin", *r6("value"))


@query("a17_pair_features", NEAR8 + ", g AS (SELECT qid, point_id AS j, qid AS i FROM n WHERE qid < point_id)" + pair_sql("g", ("qid", "j")).replace("SELECT qid, j, p.x", "SELECT g.qid, g.j, p.x", 1) + f" SELECT qid, j, {q6(('f_theta', 'theta'), ('f_phi', 'phi'), ('f_alpha', 'alpha'), ('f_dist', 'dist'))} FROM f")
def a17(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL)
    return features.near_pair_features(df, 0.8).select("qid", "j", *r6("f_theta", "f_phi", "f_alpha", "f_dist"))


GRAD_AT = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
GRAD_INV = E.symmetric(E.inverse(COV))


def gradient_sql(table: str) -> str:
    """gr(point_id, gx, gy, gz) of a table's points by their ten nearest in it."""
    d = E.minus([f"p.{c}" for c in XYZ], [f"q.{c}" for c in XYZ])
    flat = [f"({d[i]} - along * q.{NORMAL[i]})" for i in range(3)]
    return (
        near_sql("TRUE", 10, q=table, p=table, name="gn")
        + f", go AS (SELECT gn.qid, {E.dot(d, [f'q.{c}' for c in NORMAL])} AS along, gn.point_id AS pid FROM gn JOIN {table} p ON gn.point_id = p.point_id JOIN {table} q ON gn.qid = q.point_id WHERE gn.qid <> gn.point_id)"
        + f", ga AS (SELECT go.qid, {', '.join(f'{x} AS a{i}' for i, x in enumerate(flat))}, p.intensity - q.intensity AS b FROM go JOIN {table} p ON go.pid = p.point_id JOIN {table} q ON go.qid = q.point_id)"
        + f", gs AS (SELECT qid, {', '.join(f'sum(a{i} * a{j}) AS {c}' for c, (i, j) in zip(COV, GRAD_AT, strict=True))}, {', '.join(f'sum(a{i} * b) AS r{i}' for i in range(3))} FROM ga GROUP BY qid)"
        + f", gf AS (SELECT gs.qid, r0, r1, r2, {', '.join(f'gs.{c} + x.{NORMAL[i]} * x.{NORMAL[j]} AS {c}' for c, (i, j) in zip(COV, GRAD_AT, strict=True))} FROM gs JOIN {table} x ON gs.qid = x.point_id)"
        + f", gr AS (SELECT qid AS point_id, {', '.join(' + '.join(f'{GRAD_INV[i][j]} * r{j}' for j in range(3)) + f' AS g{c}' for i, c in enumerate(XYZ))} FROM gf)"
    )


GRADIENT_SQL = gradient_sql("e") + f" SELECT point_id, {q6(*[(f'g{c}', f'g{c}') for c in XYZ], digits=5)} FROM gr"


@query("a19_intensity_gradients", GRADIENT_SQL)
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.intensity_gradients(cloud_e(spark, sf_dir)).select("point_id", *r6("gx", "gy", "gz", digits=5))


@query("a20_alignment_sums", corr_sql(1, 1.1) + f", m AS (SELECT p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM n JOIN e p ON n.qid = p.point_id JOIN e q ON n.point_id = q.point_id) SELECT count(*) AS n, {q6(*[(f'sp{c}', f'sum(p{c})') for c in XYZ], *[(f'sq{c}', f'sum(q{c})') for c in XYZ], *[(f's{a}{b}', f'sum(p{a} * q{b})') for a in XYZ for b in XYZ], digits=5)} FROM m")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.registration import alignment_sums

    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    near = neighbors.correspondences(df.where("frame_id >= 5"), df.where("frame_id < 5"), 1.1).where("n = 1")
    side = lambda p, key: df.select(F.col("point_id").alias(key), *[F.col(c).alias(f"{p}{c}") for c in XYZ])
    out = alignment_sums(near.join(side("p", "src_id"), "src_id").join(side("q", "tgt_0"), "tgt_0"))
    return out.select("n", *r6(*[c for c in out.columns if c not in ("n", "sw")], digits=5))


@query("a21_frame_distribution", f"SELECT frame_id, count(*) AS n, {q6(*[(f'm{c}', f'avg({c})') for c in XYZ], *[(c, f'avg({a} * {b}) - avg({a}) * avg({b})') for c, (a, b) in zip(COV, stats.PAIRS, strict=True)])} FROM e GROUP BY frame_id")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(cloud_e(spark, sf_dir), "frame_id").select("frame_id", "n", *r6("mx", "my", "mz", *COV))


@query("a21_global_distribution", f"SELECT count(*) AS n, {q6(*[(f'm{c}', f'avg({c})') for c in XYZ], *[(c, f'avg({a} * {b}) - avg({a}) * avg({b})') for c, (a, b) in zip(COV, stats.PAIRS, strict=True)])} FROM e")
def a21_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.merge_distributions(stats.distribution(cloud_e(spark, sf_dir), "frame_id")).select("n", *r6("mx", "my", "mz", *COV))


@query("a23_imu_means", f"SELECT {q6(*[(f'mean_{n}', f'avg({c})') for n, c in zip(('ax', 'ay', 'az', 'wx', 'wy', 'wz'), (*XYZ, *NORMAL), strict=True)])} FROM e")
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ax", "ay", "az", "wx", "wy", "wz")
    imu = cloud_e(spark, sf_dir).select(*[F.col(c).alias(n) for n, c in zip(names, (*XYZ, *NORMAL), strict=True)])
    return stats.imu_means(imu).select(*r6(*[f"mean_{n}" for n in names]))


@query("a24_bbox_diagonal", f"SELECT {q6(('diagonal', 'sqrt(' + ' + '.join(f'(max({c}) - min({c})) * (max({c}) - min({c}))' for c in XYZ) + ')'))} FROM e")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bbox_diagonal(cloud_e(spark, sf_dir)).select(*r6("diagonal"))


@query("a25_rmse_nn", ", src AS (SELECT * FROM e WHERE frame_id >= 5), tgt AS (SELECT * FROM e WHERE frame_id < 5)" + near_sql("TRUE", 1, q="src", p="tgt") + " SELECT round(sqrt(avg(d2)), 6) AS rmse FROM n")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    return stats.rmse_nn(df.where("frame_id >= 5"), df.where("frame_id < 5")).select(*r6("rmse"))


# --- order and sets -------------------------------------------------------------------------------------------------


@query("w2_sort_by_time", f"SELECT point_id, {q6(('t', 't'))} FROM t ORDER BY t, point_id")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.sort_by_time(cloud_t(spark, sf_dir)).select("point_id", *r6("t"))


W8_SQL = ", g AS (SELECT point_id, frame_id, t - lag(t) OVER ({0}) AS dt FROM t), o AS (SELECT dt, row_number() OVER (ORDER BY dt) AS r, count(*) OVER () AS n FROM g WHERE dt IS NOT NULL), m AS (SELECT dt AS m FROM o WHERE r = n // 2 + 1) SELECT {1}round(dt, 6) AS dt, coalesce(dt < 0.5 * m OR dt > 2 * m, FALSE) AS anomaly FROM g LEFT JOIN m ON TRUE"


@query("w8_stamp_gaps", W8_SQL.format("PARTITION BY frame_id ORDER BY t", "frame_id, "))
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stamp_gaps(cloud_t(spark, sf_dir), "t", "frame_id").select("frame_id", *r6("dt"), "anomaly")


@query("w8_stamp_gaps_one", W8_SQL.format("ORDER BY t", ""))
def w8_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stamps as one sequence."""
    return stats.stamp_gaps(cloud_t(spark, sf_dir), "t").select(*r6("dt"), "anomaly")


@query("w9_unique_by_source", "SELECT frame_id, min(point_id) AS point_id FROM e GROUP BY frame_id")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.ordered_unique(cloud_e(spark, sf_dir, "frame_id", "point_id"), "frame_id", "point_id")


@query("w10_union", f"SELECT point_id, {q6(('x', 'x'))} FROM e UNION ALL SELECT point_id, {q6(('x', 'y'))} FROM e")
def w10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cloud_e(spark, sf_dir, "point_id", "x", "y")
    return rows.concatenate(df.select("point_id", "x"), df.select("point_id", F.col("y").alias("x"))).select("point_id", *r6("x"))


# --- factors --------------------------------------------------------------------------------------------------------


def pair_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    df = cloud_e(spark, sf_dir)
    return df.where("frame_id >= 5"), df.where("frame_id < 5")


def residual_out(df: DataFrame) -> DataFrame:
    return linearize.errors(df).select("n_inliers", *r6("error", digits=4))


_ROT = E.rotated_cov([r[:3] for r in POSE])
FACTOR_SQL = (
    f", tgt AS (SELECT * FROM e WHERE frame_id < 5), src AS (SELECT point_id, {', '.join(f'{a} AS {c}' for a, c in zip(E.moved(POSE, XYZ), XYZ, strict=True))}, {', '.join(f'{a} AS {c}' for a, c in zip(_ROT, COV, strict=True))}, intensity FROM e WHERE frame_id >= 5)"
    + near_sql(f"{PAIR_D2} < 1.21", 1, q="src", p="tgt")
    + f", m AS (SELECT {', '.join(f't.{c} - s.{c} AS r{i}' for i, c in enumerate(XYZ))}, {', '.join(f's.{c} + t.{c} AS {c}' for c in COV)}, t.nx, t.ny, t.nz FROM n JOIN src s ON n.qid = s.point_id JOIN tgt t ON n.point_id = t.point_id)"
)
_W = E.symmetric(E.inverse(COV))
MAHALANOBIS = " + ".join(f"r{i} * r{j} * {_W[i][j]}" for i in range(3) for j in range(3))


@query("g5_icp_error", FACTOR_SQL + " SELECT count(*) AS n_inliers, round(sum(r0 * r0 + r1 * r1 + r2 * r2), 4) AS error FROM m")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_out(factors.icp(*pair_of(spark, sf_dir), POSE, 1.1))


@query("g5_icp_plane_error", FACTOR_SQL + " SELECT count(*) AS n_inliers, round(sum(r0 * r0 * nx * nx + r1 * r1 * ny * ny + r2 * r2 * nz * nz), 4) AS error FROM m")
def g5_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_out(factors.icp_plane(*pair_of(spark, sf_dir), POSE, 1.1))


@query("g6_gicp_error", FACTOR_SQL + f" SELECT count(*) AS n_inliers, round(sum({MAHALANOBIS}), 4) AS error FROM m")
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_out(factors.gicp(*pair_of(spark, sf_dir), POSE, 1.1))


VG_SQL = MAP_SQL + f", src AS (SELECT point_id, {', '.join(f'{a} AS {c}' for a, c in zip(E.moved(POSE, XYZ), XYZ, strict=True))}, {', '.join(f'{a} AS {c}' for a, c in zip(_ROT, COV, strict=True))} FROM e WHERE frame_id >= 5), k AS (SELECT *, {E.voxel_key(FINE)} AS vkey FROM src), m AS (SELECT {', '.join(f'v.m{c} - k.{c} AS r{i}' for i, c in enumerate(XYZ))}, {', '.join(f'v.{c} + k.{c} AS {c}' for c in COV)} FROM k JOIN v USING (vkey))"


@query("g7_vgicp_error", VG_SQL + f" SELECT count(*) AS n_inliers, round(sum({MAHALANOBIS}), 4) AS error FROM m")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, _ = pair_of(spark, sf_dir)
    return residual_out(factors.vgicp(source, target_map(spark, sf_dir), FINE, POSE))


#: One factor for each source frame 5 to 9, each with a motion of its own: a shift.
BATCH_SQL = MAP_SQL + f", p AS ({' UNION ALL '.join(f'SELECT {k} AS frame_id, {POSES[k - 5][0][3]!r} AS dx, {POSES[k - 5][1][3]!r} AS dy, {POSES[k - 5][2][3]!r} AS dz' for k in range(5, 10))})" + f", src AS (SELECT frame_id, {', '.join(f'{c} + d{c} AS {c}' for c in XYZ)}, {', '.join(COV)} FROM e JOIN p USING (frame_id)), k AS (SELECT *, {E.voxel_key(FINE)} AS vkey FROM src), m AS (SELECT CAST(frame_id AS BIGINT) AS factor_id, {', '.join(f'k.{c} AS p{i}, v.m{c} - k.{c} AS r{i}' for i, c in enumerate(XYZ))}, {', '.join(f'v.{c} + k.{c} AS {c}' for c in COV)} FROM k JOIN v USING (vkey))"


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = cloud_e(spark, sf_dir).where("frame_id >= 5").withColumn("factor_id", F.col("frame_id"))
    return factors.vgicp_batch(source, target_map(spark, sf_dir), {k: POSES[k - 5] for k in range(5, 10)}, FINE)


@query("g8_vgicp_batch", BATCH_SQL + f" SELECT factor_id, count(*) AS n_inliers, round(sum({MAHALANOBIS}), 4) AS error FROM m GROUP BY factor_id")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linearize.errors(_batch(spark, sf_dir)).select("factor_id", "n_inliers", *r6("error", digits=4))


#: The Jacobian of the residual by rotation and translation of the moved point, as three rows of six.
_J = [["0.0", "-p2", "p1", "-1.0", "0.0", "0.0"], ["p2", "0.0", "-p0", "0.0", "-1.0", "0.0"], ["-p1", "p0", "0.0", "0.0", "0.0", "-1.0"]]


def normal_sql(row: int, col: int | None) -> str:
    """An entry of J'WJ, or of J'Wr without a column."""
    right = [_J[j][col] if col is not None else f"r{j}" for j in range(3)]
    return "sum(" + " + ".join(f"({_J[i][row]}) * {_W[i][j]} * ({right[j]})" for i in range(3) for j in range(3)) + ")"


@query("a13_linearize", BATCH_SQL + f" SELECT factor_id, count(*) AS n_inliers, {q6(*[(f'h{i}{j}', normal_sql(i, j)) for i in range(6) for j in range(i, 6)], *[(f'b{i}', normal_sql(i, None)) for i in range(6)], ('error', f'sum({MAHALANOBIS})'), digits=3)} FROM m GROUP BY factor_id")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linearize.linearized(_batch(spark, sf_dir))
    return out.select("factor_id", "n_inliers", *r6(*[c for c in out.columns if c not in ("factor_id", "n_inliers")], digits=3))


@query("a14_inlier_fraction", VG_SQL + " SELECT round(count(*) / (SELECT count(*) FROM src), 6) AS fraction FROM m")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, _ = pair_of(spark, sf_dir)
    return linearize.inlier_fraction(factors.vgicp(source, target_map(spark, sf_dir), FINE, POSE), source.count()).select(*r6("fraction"))


def several_sql(k: int) -> str:
    """s(x, y, z, a0x..): moved source points with all of their k nearest targets."""
    pivot = ", ".join(f"max(CASE WHEN rank = {i + 1} THEN t.{c} END) AS a{i}{c}" for i in range(k) for c in XYZ)
    near = FACTOR_SQL[: FACTOR_SQL.index(", n AS")] + near_sql(f"{PAIR_D2} < {1.1 * 1.1!r}", k, q="src", p="tgt")
    return near + f", h AS (SELECT qid, count(*) AS k, {pivot} FROM n JOIN tgt t ON n.point_id = t.point_id GROUP BY qid), s AS (SELECT h.*, src.x, src.y, src.z FROM h JOIN src ON h.qid = src.point_id WHERE k = {k})"


_A = [[f"a{i}{c}" for c in XYZ] for i in range(3)]
_OFF = E.minus(_A[0], XYZ)
_LINE, _FLAT = E.minus(_A[1], _A[0]), E.cross(E.minus(_A[1], _A[0]), E.minus(_A[2], _A[0]))
EDGE_SQL = several_sql(2) + f", r AS (SELECT {E.norm2(_OFF)} AS oo, {E.dot(_OFF, _LINE)} AS al, {E.norm2(_LINE)} AS ll FROM s) SELECT count(*) AS n_inliers, round(sum(oo - al * al / ll), 4) AS error FROM r WHERE ll > 0"
PLANE_SQL = several_sql(3) + f", r AS (SELECT {', '.join(f'{x} AS o{i}' for i, x in enumerate(_OFF))}, {', '.join(f'{x} AS n{i}' for i, x in enumerate(_FLAT))} FROM s), q AS (SELECT *, n0 * n0 + n1 * n1 + n2 * n2 AS nn FROM r) SELECT count(*) AS n_inliers, round(sum((o0 * o0 * n0 * n0 + o1 * o1 * n1 * n1 + o2 * o2 * n2 * n2) / nn), 4) AS error FROM q WHERE nn > 0"
_G, _N, _D = ["g.gx", "g.gy", "g.gz"], [f"t.{c}" for c in NORMAL], [f"(s.{c} - t.{c})" for c in XYZ]
_PROJ = [f"({_D[i]} - {E.dot(_D, _N)} * {_N[i]})" for i in range(3)]
_TANGENT = [f"({_G[i]} - {E.dot(_G, _N)} * {_N[i]})" for i in range(3)]
COLOR_CTE = gradient_sql("tgt") + f", k AS (SELECT t.intensity + {E.dot(_G, _PROJ)} - s.intensity AS d, {E.norm2(_TANGENT)} AS hh FROM n JOIN src s ON n.qid = s.point_id JOIN tgt t ON n.point_id = t.point_id JOIN gr g ON n.point_id = g.point_id)"
COLOR_SQL = FACTOR_SQL + COLOR_CTE + " SELECT count(*) AS n_inliers, round(sum(d * d), 4) AS error FROM k WHERE hh > 1e-12"
COLORED_SQL = FACTOR_SQL + COLOR_CTE + f", x AS (SELECT 0.75 * ({MAHALANOBIS}) AS e FROM m UNION ALL SELECT 0.25 * d * d FROM k WHERE hh > 1e-12) SELECT count(*) AS n_inliers, round(sum(e), 4) AS error FROM x"
_CT_T = "((least(greatest(floor(t / 2 * 64), 0), 63) + 0.5) / 64)"
CT_SQL = (
    f", tgt AS (SELECT * FROM e WHERE frame_id < 5), src AS (SELECT point_id, {', '.join(f'{c} + {POSES[1][i][3]!r} * {_CT_T} AS {c}' for i, c in enumerate(XYZ))}, {', '.join(COV)} FROM e WHERE frame_id >= 5)"
    + near_sql(f"{PAIR_D2} < {1.1 * 1.1!r}", 1, q="src", p="tgt")
    + f", m AS (SELECT {', '.join(f't.{c} - s.{c} AS r{i}' for i, c in enumerate(XYZ))}, {', '.join(f's.{c} + t.{c} AS {c}' for c in COV)}, t.nx, t.ny, t.nz FROM n JOIN src s ON n.qid = s.point_id JOIN tgt t ON n.point_id = t.point_id)"
)
for _name, _sql, _f in (
    ("g9_loam_edge", EDGE_SQL, lambda s, d: residual_out(factors.loam_edge(*pair_of(s, d), POSE, 1.1))),
    ("g9_loam_plane", PLANE_SQL, lambda s, d: residual_out(factors.loam_plane(*pair_of(s, d), POSE, 1.1))),
    ("g10_color_consistency", COLOR_SQL, lambda s, d: residual_out(_colored(s, d, factors.color_consistency))),
    ("g11_colored_gicp", COLORED_SQL, lambda s, d: residual_out(_colored(s, d, factors.colored_gicp))),
    ("g12_ct_icp", CT_SQL + " SELECT count(*) AS n_inliers, round(sum((r0 * nx + r1 * ny + r2 * nz) * (r0 * nx + r1 * ny + r2 * nz)), 4) AS error FROM m", lambda s, d: residual_out(_continuous(s, d, factors.ct_icp))),
    ("g13_ct_gicp", CT_SQL + f" SELECT count(*) AS n_inliers, round(sum({MAHALANOBIS}), 4) AS error FROM m", lambda s, d: residual_out(_continuous(s, d, factors.ct_gicp))),
):
    query(_name, _sql)(_f)


_APART = "abs(atan2(a0z, sqrt(a0x * a0x + a0y * a0y)) - atan2(a1z, sqrt(a1x * a1x + a1y * a1y)))"


@query("p19_scan_line_validation", EDGE_SQL.replace(" FROM s) SELECT", f" FROM s WHERE {_APART} >= {0.1 * math.pi / 180!r}) SELECT"))
def p19_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose two points may not lie on one scan line."""
    return residual_out(factors.loam_edge(*pair_of(spark, sf_dir), POSE, 1.1, validate=True))


@query("g6_gicp_compact", FACTOR_SQL + f" SELECT count(*) AS n_inliers, round(sum({MAHALANOBIS}), 1) AS error FROM m")
def g6_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights in single precision agree with full ones."""
    return linearize.errors(factors.gicp(*pair_of(spark, sf_dir), POSE, 1.1, cache="compact")).select("n_inliers", *r6("error", digits=1))


@query("u_voxel_contents", f"SELECT {E.voxel_key(FINE)} AS vkey, max(intensity) - min(intensity) AS spread, count(DISTINCT frame_id) AS frames FROM e GROUP BY 1")
def u_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels with contents of the user's own."""
    return voxels.voxel_contents(cloud_e(spark, sf_dir), FINE, {"spread": F.max("intensity") - F.min("intensity"), "frames": F.count_distinct("frame_id")})


@query("u_custom_search", FACTOR_SQL.replace(f"{PAIR_D2} < 1.21", f"{PAIR_D2} < 1.21 AND {_cells(7)}") + " SELECT count(*) AS n_inliers, round(sum(r0 * r0 + r1 * r1 + r2 * r2), 4) AS error FROM m")
def u_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correspondences by a search of the user's own: seven voxels instead of the whole ball."""
    search = lambda q, p, d, k: neighbors.knn_voxel(q, p, k, FINE, 7, max_sq_dist=1.21)
    return residual_out(factors.icp(*pair_of(spark, sf_dir), POSE, 1.1, search=search))


@query("u_index_transform", near_sql(f"{PAIR_D2} < 1.0", 3) + "SELECT qid, (f.frame_id << 32) + n.point_id AS idx, CAST(rank AS INT) AS rank FROM n JOIN e f ON n.point_id = f.point_id")
def u_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by a composite index of frame and point."""
    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    near = neighbors.radius_search(neighbors.as_queries(df), df, 1.0, 3).join(df.select("point_id", "frame_id"), "point_id")
    return neighbors.with_index(near, rows.composite_index(F.col("frame_id"), F.col("point_id"))).select("qid", F.col("point_id").alias("idx"), F.col("rank").cast("int").alias("rank"))


def _continuous(spark: SparkSession, sf_dir: str, factor: Callable) -> DataFrame:
    source, target = pair_of(spark, sf_dir)
    return factor(source.withColumn("t", F.col("t") / 2), target, _square(POSES[0]), _square(POSES[1]), 1.1)


def _square(m):
    import numpy as np

    return np.vstack([np.array(m), [0, 0, 0, 1]])


def _colored(spark: SparkSession, sf_dir: str, factor: Callable) -> DataFrame:
    source, target = pair_of(spark, sf_dir)
    # a table, as every round of the search reads it
    target = cut(target.join(features.intensity_gradients(target).hint("merge"), "point_id"), "gradients")
    return factor(source, target, POSE, 1.1)


# --- files ----------------------------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    import uuid

    from .scratch import root

    return f"{root(spark)}/pointloom/files-{uuid.uuid4().hex}"


_POSE7 = [("tx", "x"), ("ty", "y"), ("tz", "z"), ("qx", "nx * sin(0.15)"), ("qy", "ny * sin(0.15)"), ("qz", "nz * sin(0.15)"), ("qw", "cos(0.15)")]


def _stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_e(spark, sf_dir).select((F.col("point_id") * 0.5).alias("ts"), *[F.expr(x).alias(c) for c, x in _POSE7])


@query("io9_tum_round_trip", f"SELECT point_id * 0.5 AS ts, {q6(*_POSE7)} FROM e")
def io9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trajectory written as text and read again, in the six digits of its format."""
    from .sources import files

    path = _folder(spark)
    files.write_tum(_stamped(spark, sf_dir), path)
    return files.read_tum(spark, path).select("ts", *r6(*[c for c, _ in _POSE7]))


@query("io12_imu_round_trip", f"SELECT point_id * 0.5 AS ts, {q6(('ax', 'x'), ('ay', 'y'), ('az', 'z'), ('wx', 'nx'), ('wy', 'ny'), ('wz', 'nz'))} FROM e")
def io12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import files

    path, names = _folder(spark), ("ax", "ay", "az", "wx", "wy", "wz")
    files.write_imu(cloud_e(spark, sf_dir).select((F.col("point_id") * 0.5).alias("ts"), *[F.col(c).alias(n) for n, c in zip(names, (*XYZ, *NORMAL), strict=True)]), path)
    back = spark.read.csv(path, sep=" ", schema=", ".join(f"{c} double" for c in ("ts", *names)))
    return back.select("ts", *r6(*names))


@query("io10_timestamps", "SELECT point_id * 0.5 AS ts FROM e")
def io10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import files

    path = _folder(spark)
    _stamped(spark, sf_dir).select(F.format_string("%.9f", "ts").alias("value")).write.text(path)
    return files.read_timestamps(spark, path)


@query("io8_read_graph", f"SELECT point_id AS frame_id, {q6(*_POSE7)} FROM e")
def io8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import files

    path = _folder(spark)
    lines = cloud_e(spark, sf_dir).select("point_id", *[F.expr(x).alias(c) for c, x in _POSE7])
    lines.select(F.format_string("v%d" + " %.6f" * 7, "point_id", *[c for c, _ in _POSE7]).alias("value")).write.text(path)
    return files.read_graph(spark, path).select("frame_id", *r6(*[c for c, _ in _POSE7]))


def _packed(spark: SparkSession, sf_dir: str, columns: tuple[str, ...], path: str) -> str:
    """The cloud's columns as one file of float32 numbers, in the order of point_id."""
    from .sources.files import created

    found = cloud_e(spark, sf_dir, "point_id", *columns).orderBy("point_id").toPandas()  # one scan
    with created(spark, f"{path}/cloud.bin") as write:
        write(found[list(columns)].to_numpy().astype("<f4").tobytes())
    return f"{path}/cloud.bin"


for _name, _reader, _columns in (("io1_read_points", "read_points", XYZ), ("io2_read_points4", "read_points4", (*XYZ, "intensity")), ("io3_read_times", "read_times", ("t",))):

    @query(_name, f"SELECT row_number() OVER (ORDER BY point_id) - 1 AS point_id, {', '.join(f'round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 5) AS {c}' for c in _columns)} FROM e")
    def _read(spark: SparkSession, sf_dir: str, reader: str = _reader, columns: tuple[str, ...] = _columns) -> DataFrame:
        from .sources import files

        return getattr(files, reader)(spark, _packed(spark, sf_dir, columns, _folder(spark))).select("point_id", *r6(*columns, digits=5))


_FRAME_COLUMNS = (*XYZ, "t", *NORMAL, *COV, "intensity")
for _name, _compact in (("io5_frame_round_trip", False), ("io6_compact_frame_round_trip", True)):

    @query(_name, f"SELECT row_number() OVER (ORDER BY point_id) - 1 AS point_id, {q6(*[(c, f'CAST(CAST({c} AS FLOAT) AS DOUBLE)' if _compact else c) for c in _FRAME_COLUMNS], digits=5)} FROM e")
    def _frame(spark: SparkSession, sf_dir: str, compact: bool = _compact) -> DataFrame:
        """A frame folder written and read again (also IO4)."""
        from .sources import files

        path = _folder(spark) + "/frame"
        files.save_frame(cloud_e(spark, sf_dir), path, compact)
        return files.load_frame(spark, path).select("point_id", *r6(*_FRAME_COLUMNS, digits=5))


for _name, _compact in (("io5_frame_folders", False), ("io6_compact_frame_folders", True)):

    @query(_name, f"SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY point_id) - 1 AS point_id, {q6(*[(c, f'CAST(CAST({c} AS FLOAT) AS DOUBLE)' if _compact else c) for c in _FRAME_COLUMNS], digits=5)} FROM e")
    def _frames(spark: SparkSession, sf_dir: str, compact: bool = _compact) -> DataFrame:
        """A folder for each frame, written and read by ranges of points (also IO4)."""
        from .sources import frames

        path = _folder(spark)
        frames.save_frames(cloud_e(spark, sf_dir), path, compact)
        return frames.load_frames(spark, path, points=100).select("frame_id", "point_id", *r6(*_FRAME_COLUMNS, digits=5))


@query("io7_voxelmap_round_trip", f"SELECT {E.voxel_key(FINE)} AS vkey, count(*) AS n, {q6(*[(f'm{c}', f'CAST(CAST(avg({c}) AS FLOAT) AS DOUBLE)') for c in XYZ], *[(c, f'CAST(CAST(avg({c}) AS FLOAT) AS DOUBLE)') for c in COV], ('intensity', 'CAST(CAST(max(intensity) AS FLOAT) AS DOUBLE)'), digits=4)} FROM e GROUP BY 1")
def io7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sources import files

    path = _folder(spark) + "/map.bin"
    files.save_voxelmap(voxels.gaussian_voxelmap(cloud_e(spark, sf_dir), FINE), path, FINE)
    back, _ = files.load_voxelmap(spark, path)
    return back.select("vkey", "n", *r6("mx", "my", "mz", *COV, "intensity", digits=4))


# --- segmentation and trajectories ----------------------------------------------------------------------------------

REGION_SQL = (
    near_sql(f"{PAIR_D2} < 2.25 AND q.point_id <> p.point_id AND q.nx * p.nx + q.ny * p.ny + q.nz * p.nz >= {math.cos(math.radians(60))!r}", None)
    + ", s AS (SELECT point_id FROM e ORDER BY (x - 0.0) * (x - 0.0) + (y - 0.0) * (y - 0.0) + (z - 0.0) * (z - 0.0), point_id LIMIT 1)"
)


@query("g3_region_growing", REGION_SQL + ", g AS (SELECT point_id FROM s UNION SELECT n.point_id FROM g JOIN n ON n.qid = g.point_id) SELECT point_id FROM g")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.segmentation import RegionParams, region_growing

    df = cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL)
    return region_growing(df, (0.0, 0.0, 0.0), RegionParams(distance=1.5, angle=math.radians(60)), dilate=False)


@query("g3_all_regions", REGION_SQL + ", g AS (SELECT point_id AS region, point_id FROM e UNION SELECT g.region, n.point_id FROM g JOIN n ON n.qid = g.point_id), r AS (SELECT point_id, min(region) AS region FROM g GROUP BY point_id) SELECT point_id, region, count(*) OVER (PARTITION BY region) AS size FROM r")
def g3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.segmentation import RegionParams, all_regions

    return all_regions(cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL), RegionParams(distance=1.5, angle=math.radians(60)))


ORACLES["g3_all_regions"] = ORACLES["g3_all_regions"].replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["g3_region_growing"] = ORACLES["g3_region_growing"].replace("WITH ", "WITH RECURSIVE ", 1)

CUT_ANGLE = "acos(least(1.0, abs(q.nx * p.nx + q.ny * p.ny + q.nz * p.nz)))"


@query("g4_min_cut_edges", near_sql("TRUE", 8) + f" SELECT n.qid, n.point_id, round(exp(-d2 / 4.0) * exp(-{CUT_ANGLE} * {CUT_ANGLE} / 1.0), 6) AS weight FROM n JOIN e q ON n.qid = q.point_id JOIN e p ON n.point_id = p.point_id WHERE n.qid <> n.point_id")
def g4_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.segmentation import CutParams, cut_edges

    df = cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL)
    return cut_edges(df, CutParams(k=8, distance_sigma=2.0, angle_sigma=1.0)).select("qid", "point_id", *r6("weight"))


@query("g4_min_cut")
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.segmentation import CutParams, min_cut

    df = cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL)
    seeds = df.where("point_id < 3").select(F.col("point_id").alias("seed_id"), *[F.col(c).alias(f"s{c}") for c in XYZ])
    return min_cut(df, seeds, CutParams(k=8, distance_sigma=2.0, angle_sigma=1.0, background=2.0))


def _spline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cloud's points as knots, half a second apart, and a query in each interval."""
    df = cloud_e(spark, sf_dir)
    knots = df.select(F.col("point_id").alias("knot"), *[F.col(c).alias(f"t{c}") for c in XYZ])
    return df.select(F.col("point_id").alias("qid"), (F.col("point_id") * 0.5 + 0.11).alias("t")), knots


def _spline_sql(basis: tuple[str, str, str], out: str, scale: float, base: bool) -> str:
    from .plans.trajectory import _blend

    k = ", ".join(f"k{j}.{c} AS k{j}{c}" for j in range(4) for c in XYZ)
    joins = " ".join(f"JOIN e k{j} ON k{j}.point_id = a.i - 1 + {j}" for j in range(4))
    return (
        ", a AS (SELECT point_id AS qid, point_id * 0.5 + 0.11 AS t FROM e), b AS (SELECT qid, CAST(floor((t - 0.0) / 0.5) AS BIGINT) + 1 AS i, (t - 0.0) / 0.5 - floor((t - 0.0) / 0.5) AS u FROM a)"
        + f", c AS (SELECT qid, u, {k} FROM b a {joins}) SELECT qid, {q6(*[(f'{out}{c}', _blend(basis, c, scale, base)) for c in XYZ], digits=5)} FROM c"
    )


def _register_splines() -> None:
    from .plans import trajectory as T

    for name, basis, out, scale, make in (
        ("t1_bspline_translation", T.BETA, "p", 1.0, T.spline_translation),
        ("t2_bspline_velocity", T.BETA1, "v", 1 / 0.5, lambda df: T.spline_velocity(df, 0.5)),
        ("t2_bspline_acceleration", T.BETA2, "a", 1 / 0.25, lambda df: T.spline_acceleration(df, 0.5)),
    ):

        def run(spark: SparkSession, sf_dir: str, make=make, out=out) -> DataFrame:
            queries, knots = _spline(spark, sf_dir)
            found = T.with_knots(queries, knots, 0.0, 0.5).where("k3x IS NOT NULL")
            return make(found).select("qid", *r6(*[f"{out}{c}" for c in XYZ], digits=5))

        query(name, _spline_sql(basis, out, scale, out == "p"))(run)

    @query("t3_knot_ids", f"SELECT point_id, {T.knot_id('t', 0.0, 3600.0)} AS knot, {q6(('stamp', T.knot_stamp(T.knot_id('t', 0.0, 3600.0), 0.0, 3600.0)))} FROM t")
    def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = cloud_t(spark, sf_dir).withColumn("knot", F.expr(T.knot_id("t", 0.0, 3600.0)))
        return df.select("point_id", "knot", F.round(F.expr(T.knot_stamp("knot", 0.0, 3600.0)), 6).alias("stamp"))


_register_splines()


# --- incremental maps, bundles, trajectories as jobs ----------------------------------------------------------------


@query("s1_voxel_points_all", f"SELECT {E.voxel_key(FINE)} AS vkey, point_id, {q6(*[(c, c) for c in XYZ])} FROM e")
def s1_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without limits on distance and number, three batches keep every point in its voxel."""
    from .streaming.maps import VoxelPoints

    df, target = cloud_e(spark, sf_dir, "point_id", *XYZ), VoxelPoints(spark, FINE, least_distance=0.0, most_points=1 << 40)
    for k in range(3):
        target.insert(df.where(F.col("point_id") % 3 == k))
    return target.state.select("vkey", "point_id", *r6(*XYZ))


@query("s2_covariance_map_all", near_sql(_cells(27), 20) + f", m AS (SELECT qid, count(*) AS k, {', '.join(f'{v} AS {c}' for c, v in MOMENT.items())} FROM n JOIN e USING (point_id) GROUP BY qid) SELECT qid AS point_id, CAST(1 AS BIGINT) AS birth, {q6(*[(c, c) for c in COV])} FROM m WHERE k >= 5")
def s2_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch without limits: the covariances of all points that have neighbours enough."""
    from .streaming.maps import CovarianceMap, VoxelPoints

    target = CovarianceMap(VoxelPoints(spark, FINE, least_distance=0.0, most_points=1 << 40), enough=1 << 40).insert(cloud_e(spark, sf_dir, "point_id", *XYZ))
    return target.valid().select("point_id", "birth", *r6(*COV))


def folded_sql(batches: int, least: float, most: int, name: str) -> str:
    """name(vkey, point_id, x, y, z): the points that voxels keep, one by one: not too near to one kept before, and no more than fit."""
    d2 = " + ".join(f"(o.{c} - q[1].{c}) * (o.{c} - q[1].{c})" for c in XYZ)
    keep = f"list_reduce(list_transform(pts, lambda p: [p]), lambda kept, q: CASE WHEN len(kept) < {most} AND len(list_filter(kept, lambda o: {d2} < {least * least!r})) = 0 THEN kept || q ELSE kept END)"
    members = ", ".join(f"'{c}': {c}" for c in ("point_id", *XYZ))
    return (
        f", {name}g AS (SELECT vkey, list({{{members}}} ORDER BY point_id % {batches}, point_id) AS pts FROM (SELECT *, {E.voxel_key(FINE)} AS vkey FROM e) WHERE vkey IS NOT NULL GROUP BY vkey)"
        + f", {name} AS (SELECT vkey, p.* FROM (SELECT vkey, unnest({keep}) AS p FROM {name}g))"
    )


@query("s1_voxel_points", folded_sql(3, 0.1, 20, "k") + f" SELECT vkey, point_id, {q6(*[(c, c) for c in XYZ])} FROM k")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.maps import VoxelPoints

    df, target = cloud_e(spark, sf_dir, "point_id", *XYZ), VoxelPoints(spark, FINE)
    for k in range(3):
        target.insert(df.where(F.col("point_id") % 3 == k))
    return target.state.select("vkey", "point_id", *r6(*XYZ))


def _grown_sql() -> str:
    """Covariances of all points kept after two batches, of those with eigenvalues within a deviation of the mean of both batches' if they are many."""
    judged = lambda k: f", m{k} AS (SELECT qid, count(*) AS k, {', '.join(f'{v} AS {c}' for c, v in MOMENT.items())} FROM n{k} JOIN k{k} USING (point_id) GROUP BY qid HAVING count(*) >= 5)"
    values = ", ".join(f"{v} AS l{i}" for i, v in enumerate(E.eigenvalues(COV)))
    spread = ", ".join(f"avg(l{i}) AS a{i}, sqrt(greatest(avg(l{i} * l{i}) - avg(l{i}) * avg(l{i}), 0)) AS d{i}" for i in range(3))
    within = " AND ".join(f"l{i} BETWEEN a{i} - d{i} AND a{i} + d{i}" for i in range(3))
    return (
        folded_sql(2, 0.1, 20, "k2") + ", k1 AS (SELECT * FROM k2 WHERE point_id % 2 = 0)"
        + "".join(near_sql(_cells(27), 20, q=f"k{k}", p=f"k{k}", name=f"n{k}") + judged(k) for k in (1, 2))
        + f", lv AS (SELECT 1 AS b, *, {values} FROM m1 UNION ALL SELECT 2, *, {values} FROM m2), s AS (SELECT count(*) AS n, {spread} FROM lv)"
        + f" SELECT qid AS point_id, CAST(1 + qid % 2 AS BIGINT) AS birth, {q6(*[(c, c) for c in COV])} FROM lv, s WHERE b = 2 AND (n <= 1024 OR ({within}))"
    )


@query("s2_covariance_map", _grown_sql())
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.maps import CovarianceMap, VoxelPoints

    df, target = cloud_e(spark, sf_dir, "point_id", *XYZ), CovarianceMap(VoxelPoints(spark, FINE))
    for k in range(2):
        target.insert(df.where(F.col("point_id") % 2 == k))
    return target.valid().select("point_id", "birth", *r6(*COV))


@query("s3_streamed_voxelmap", f"SELECT {E.voxel_key(FINE)} AS vkey, count(*) AS n, {q6(*[(f'm{c}', f'avg({c})') for c in XYZ], ('intensity', 'max(intensity)'))} FROM e GROUP BY 1")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.maps import StreamedVoxelMap

    df, target = cloud_e(spark, sf_dir), StreamedVoxelMap(FINE)
    for k in range(3):
        target.insert(df.where(F.col("point_id") % 3 == k))
    return target.state.select("vkey", "n", *r6("mx", "my", "mz", "intensity"))


_EV = E.eigenvalues(COV)
POOLED_SQL = f", p AS (SELECT {', '.join(f'avg({a} * {b}) - avg({a}) * avg({b}) AS {c}' for c, (a, b) in zip(COV, stats.PAIRS, strict=True))} FROM e)"


@query("g14_plane_evm", POOLED_SQL + f" SELECT round({_EV[0]}, 5) AS error FROM p")
def g14_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.bundle import plane_evm

    return plane_evm(cloud_e(spark, sf_dir)).select(*r6("error", digits=5))


@query("g14_edge_evm", POOLED_SQL + f" SELECT round({_EV[0]} + {_EV[1]}, 5) AS error FROM p")
def g14_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.bundle import edge_evm

    return edge_evm(cloud_e(spark, sf_dir)).select(*r6("error", digits=5))


@query("g16_imu_reintegration")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.bundle import preintegrate_segments

    names = ("ax", "ay", "az", "wx", "wy", "wz")
    imu = cloud_e(spark, sf_dir).select(F.col("frame_id").alias("segment"), F.col("point_id").alias("seq"), *[F.col(c).alias(n) for n, c in zip(names, (*XYZ, *NORMAL), strict=True)], F.lit(0.01).alias("dt"))
    return preintegrate_segments(imu)


W7_SQL = ", d AS (SELECT DISTINCT frame_id, t FROM t), x AS (SELECT d.frame_id, d.t, min(n.t) AS next FROM d JOIN d n ON d.frame_id = n.frame_id AND n.t - d.t > 3600.0 GROUP BY 1, 2), a AS (SELECT frame_id, min(t) AS t, CAST(0 AS BIGINT) AS bucket FROM d GROUP BY frame_id UNION ALL SELECT x.frame_id, x.next, bucket + 1 FROM a JOIN x ON a.frame_id = x.frame_id AND a.t = x.t), la AS (SELECT frame_id, max(t) AS last FROM d GROUP BY frame_id) SELECT t.frame_id, t.point_id, max(a.bucket) AS bucket, round(CASE WHEN any_value(last) = 0 THEN 0 ELSE any_value(t.t) / any_value(last) END, 6) AS t FROM t JOIN a ON t.frame_id = a.frame_id AND t.t >= a.t JOIN la ON t.frame_id = la.frame_id GROUP BY 1, 2"


@query("w7_time_table", W7_SQL)
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.time_table(cloud_t(spark, sf_dir).select("frame_id", "point_id", "t"), 3600.0).select("frame_id", "point_id", "bucket", *r6("t"))


ORACLES["w7_time_table"] = ORACLES["w7_time_table"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("t5_pose_interpolator")
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    from .functions import lie
    from .plans.trajectory import arange_timestamps, fit_knots

    rows_ = cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL).where("point_id < 40").orderBy("point_id").collect()  # a trajectory of 40 poses
    poses = [lie.pose(lie.so3_exp(0.3 * np.array([r.nx, r.ny, r.nz])), np.array([r.x, r.y, r.z])) for r in rows_]
    traj = fit_knots(np.arange(len(poses)) * 0.5, poses, 0.5)
    return traj.evaluate(arange_timestamps(spark, 0.5, 19.0, 0.1).withColumnRenamed("stamp", "ts"))


@query("g5_icp_batch", FRAMES_SQL + f", s AS (SELECT point_id, frame_id, {', '.join(f'{c} + d{c} AS {c}' for c in XYZ)} FROM e JOIN p USING (frame_id) WHERE frame_id >= 5), o AS (SELECT * FROM e WHERE frame_id < 5)" + near_sql(f"{PAIR_D2} < 1.0", 1, q="s", p="o") + " SELECT frame_id AS factor_id, count(*) AS n_inliers, round(sum(d2), 4) AS error FROM n JOIN s ON s.point_id = n.qid GROUP BY frame_id")
def g5_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor for each frame, all in one job."""
    from .plans.matching import MatchedGroup

    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    group = MatchedGroup("icp", df.where("frame_id >= 5").withColumnRenamed("frame_id", "factor_id"), df.where("frame_id < 5").drop("frame_id"))
    return linearize.errors(group.rows({k: POSES[k] for k in range(5, 10)})).select("factor_id", "n_inliers", *r6("error", digits=4))


@query("o1_vgicp_alignment", "SELECT TRUE AS converged, 0.0 AS metres_off, 0.0 AS radians_off")
def o1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud pushed off itself comes back: how far from its true pose, in hundredths, the alignment by ever smaller voxels ends."""
    import numpy as np

    from .functions import lie
    from .plans.optimize import LMParams, coarse_to_fine

    df = cloud_e(spark, sf_dir).cache()
    start = np.eye(4)
    start[:3, 3] = 0.05, -0.05, 0.03
    params = LMParams(max_iterations=12, relative_error=1e-3)
    pose, status = coarse_to_fine(df, df, (0.5, 0.25), start, params)
    off = float(np.linalg.norm(pose[:3, 3])), float(np.linalg.norm(lie.so3_log(pose[:3, :3])))
    df.unpersist()
    return spark.createDataFrame([(status.converged, round(off[0], 2), round(off[1], 2))], "converged boolean, metres_off double, radians_off double")


def _rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(float(x) if not isinstance(x, (int, str)) else x for x in v) for v in values], schema)


def _trajectory_sql() -> str:
    """b: the motion between each pose and the next: its rotation r00.. and translation t0.., with the first pose's own a00.. and x, y, z.

    The pose of a point has the rotation of 0.3 times its normal (an angle of 0.3) and the point as its place.
    """
    sin, one = math.sin(0.3), 1 - math.cos(0.3)
    n = list(NORMAL)
    hat = [["0.0", f"-{n[2]}", n[1]], [n[2], "0.0", f"-{n[0]}"], [f"-{n[1]}", n[0], "0.0"]]
    turn = [f"{1.0 if i == j else 0.0} + {sin!r} * ({hat[i][j]}) + {one!r} * ({n[i]} * {n[j]} - {1.0 if i == j else 0.0})" for i in range(3) for j in range(3)]
    poses = f", s AS (SELECT point_id, {', '.join(XYZ)}, {', '.join(f'{x} AS a{i // 3}{i % 3}' for i, x in enumerate(turn))} FROM e)"
    rel = ", ".join(" + ".join(f"p.a{k}{i} * q.a{k}{j}" for k in range(3)) + f" AS r{i}{j}" for i in range(3) for j in range(3))
    place = ", ".join(" + ".join(f"p.a{k}{i} * (q.{c} - p.{c})" for k, c in enumerate(XYZ)) + f" AS t{i}" for i in range(3))
    between = f", b AS (SELECT p.point_id, {', '.join(f'p.{c}' for c in XYZ)}, {', '.join(f'p.a{i}{j}' for i in range(3) for j in range(3))}, {rel}, {place} FROM s p JOIN s q ON q.point_id = p.point_id + 1)"
    log = ", c AS (SELECT *, acos(least(1.0, greatest(-1.0, (r00 + r11 + r22 - 1) / 2))) AS g FROM b), w AS (SELECT *, CASE WHEN g < 1e-6 THEN 0.5 ELSE g / (2 * sin(g)) END AS f FROM c), v AS (SELECT *, f * (r21 - r12) AS w0, f * (r02 - r20) AS w1, f * (r10 - r01) AS w2 FROM w)"
    w, t = ["w0", "w1", "w2"], ["t0", "t1", "t2"]
    once = E.cross(w, t)
    twice = E.cross(w, once)
    k = "CASE WHEN g < 1e-6 THEN 0.0 ELSE 1 / (g * g) - (1 + cos(g)) / (2 * g * sin(g)) END"
    return poses + between + log + f", lg AS (SELECT *, {', '.join(f't{i} - 0.5 * {once[i]} + ({k}) * {twice[i]} AS v{i}' for i in range(3))} FROM v)"


def motions(spark: SparkSession, sf_dir: str, out: Callable, schema: str) -> DataFrame:
    """out(poses, next poses) of the poses of the trajectory and the next ones, as stacks of a batch's rows."""
    import numpy as np
    import pandas as pd

    from .functions import lie

    df = cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL)
    names = (*XYZ, *NORMAL)
    both = df.join(df.select((F.col("point_id") - 1).alias("point_id"), *[F.col(c).alias(f"b{c}") for c in names]), "point_id")

    def run(batches):
        for pdf in batches:
            rows_ = pdf[[*names, *[f"b{c}" for c in names]]].to_numpy()
            of = lambda r: lie.pose(lie.so3_exp(0.3 * r[:, 3:6]), r[:, :3])
            made = np.asarray(out(of(rows_[:, :6]), of(rows_[:, 6:]))).reshape(len(pdf), -1)
            yield pd.DataFrame({"point_id": pdf.point_id} | {c.split()[0]: made[:, i] for i, c in enumerate(schema.split(", "))})

    return both.mapInPandas(run, f"point_id long, {schema}")


@query("p16_se3_log_exp", _trajectory_sql() + f" SELECT point_id, {q6(*[(f'w{i}', f'w{i}') for i in range(3)], *[(f'v{i}', f'v{i}') for i in range(3)], digits=5)} FROM lg")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import lie

    out = motions(spark, sf_dir, lambda a, b: lie.se3_log(lie.between(a, b)), "w0 double, w1 double, w2 double, v0 double, v1 double, v2 double")
    return out.select("point_id", *r6("w0", "w1", "w2", "v0", "v1", "v2", digits=5))


def _interpolated_sql(s: float) -> str:
    w, v = [f"({s!r} * w{i})" for i in range(3)], [f"({s!r} * v{i})" for i in range(3)]
    once = E.cross(w, v)
    twice = E.cross(w, once)
    g = f"({s!r} * g)"
    step = [f"{v[i]} + (1 - cos({g})) / ({g} * {g}) * {once[i]} + ({g} - sin({g})) / ({g} * {g} * {g}) * {twice[i]}" for i in range(3)]
    return f", u AS (SELECT *, {', '.join(f'{x} AS d{i}' for i, x in enumerate(step))} FROM lg) SELECT point_id, {q6(*[(f't{c}', f'{c} + ' + ' + '.join(f'a{i}{j} * d{j}' for j in range(3))) for i, c in enumerate(XYZ)], digits=5)} FROM u"


@query("p17_interpolate_pose", _trajectory_sql() + _interpolated_sql(0.3))
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place three tenths of the way from each pose to the next."""
    from .functions import lie

    return motions(spark, sf_dir, lambda a, b: lie.interpolate(a, b, 0.3)[..., :3, 3], "tx double, ty double, tz double").select("point_id", *r6("tx", "ty", "tz", digits=5))


@query("p21_voxel_points", f"SELECT {E.voxel_key(FINE)} AS vkey, point_id, {q6(*[(c, c) for c in XYZ])} FROM e")
def p21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.with_voxel(cloud_e(spark, sf_dir, "point_id", *XYZ), FINE).select("vkey", "point_id", *r6(*XYZ))


@query("w1_sort", f"SELECT point_id, {q6(('intensity', 'intensity'))} FROM e ORDER BY intensity DESC, point_id")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_e(spark, sf_dir, "point_id", "intensity").orderBy(F.desc("intensity"), "point_id").select("point_id", *r6("intensity"))


@query("w11_dilation", f"SELECT DISTINCT p.point_id FROM e q, e p WHERE q.frame_id = 0 AND {PAIR_D2} < 0.81")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region (frame 0) grows by its surroundings in the whole cloud."""
    from .plans.segmentation import RegionParams, region_dilation

    df = cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ)
    return region_dilation(df, df.where("frame_id = 0").select("point_id"), RegionParams(dilation=0.9))


_POOLED_MEAN = POOLED_SQL.replace(" FROM e)", f", {', '.join(f'avg({c}) AS m{c}' for c in XYZ)}, count(*) AS k FROM e)")
A22_SQL = _POOLED_MEAN + f", v AS (SELECT *, {', '.join(f'{x} AS l{i}' for i, x in enumerate(E.eigenvalues(COV)))} FROM p), u AS (SELECT *, {', '.join(f'{x} AS u{c[1:]}' for c, x in zip(COV, least_projection('l0', 'l1', 'l2'), strict=True))} FROM v)"
_U = E.symmetric([f"u{c[1:]}" for c in COV])


@query("a22_eigen_derivatives", A22_SQL + f" SELECT point_id, {q6(('value', 'l0'), *[(f'd{c}', '2.0 / k * (' + ' + '.join(f'{_U[i][j]} * ({b} - m{b})' for j, b in enumerate(XYZ)) + ')') for i, c in enumerate(XYZ)])} FROM e, u")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the least eigenvalue of the whole cloud's covariance changes with each point."""
    from .plans.bundle import eigen_gradients

    return eigen_gradients(cloud_e(spark, sf_dir, "point_id", "frame_id", *XYZ), 0).select("point_id", *r6("value", "dx", "dy", "dz"))


#: Factors on the motion from pose a (null: fixed) to pose b.
LINKS = [(5, None, 0), (6, 0, 1), (7, 1, 2), (8, 2, 3), (9, 0, 3)]
BLOCKS_SQL = (
    BATCH_SQL + f", s AS (SELECT factor_id, {', '.join(f'{normal_sql(i, j)} AS h{i}{j}' for i in range(6) for j in range(6))} FROM m GROUP BY factor_id)"
    + f", h AS ({' UNION ALL '.join(f'SELECT factor_id, {i} AS row, {j} AS col, h{i}{j} AS value FROM s' for i in range(6) for j in range(6))})"
    + f", lk AS (SELECT * FROM (VALUES {', '.join(f'({f}, {chr(78) + chr(85) + chr(76) + chr(76) if a is None else a}, {b})' for f, a, b in LINKS)}) t(factor_id, a, b))"
    + ", x AS (SELECT b AS i, b AS j, row, col, value FROM h JOIN lk USING (factor_id) UNION ALL SELECT a, a, row, col, value FROM h JOIN lk USING (factor_id) WHERE a IS NOT NULL"
    + " UNION ALL SELECT a, b, row, col, -value FROM h JOIN lk USING (factor_id) WHERE a IS NOT NULL UNION ALL SELECT b, a, row, col, -value FROM h JOIN lk USING (factor_id) WHERE a IS NOT NULL)"
    + " SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, row, col, round(sum(value), 3) AS value FROM x GROUP BY 1, 2, 3, 4"
)


@query("a26_system_blocks", BLOCKS_SQL)
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame(LINKS, "factor_id long, a long, b long")
    return linearize.system_blocks(linearize.linearized(_batch(spark, sf_dir)), keys).select("i", "j", "row", "col", *r6("value", digits=3))


#: The solution that the system is made for: of each point, its coordinates and its normal.
SOLUTION = (*XYZ, *NORMAL)


@query("a26_solved_system", f"SELECT point_id AS i, {q6(*[(f'x{k}', c) for k, c in enumerate(SOLUTION)], digits=4)}, TRUE AS exact FROM e")
def a26_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of all points with loops of ten, weighted by their covariances: the system is made to have the points' own values for its solution."""
    from .plans import elimination

    df = cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL, *COV)
    part = E.symmetric(COV)
    h = [F.col(part[r % 3][c % 3]) if r // 3 == c // 3 else F.lit(0.0) for r in range(6) for c in range(6)]
    linear = df.select(F.col("point_id").alias("factor_id"), *[h[6 * r + c].alias(f"h{r}{c}") for r in range(6) for c in range(r, 6)])
    n = df.count()
    step = lambda k: df.where(F.col("point_id") + k < n).select(F.col("point_id").alias("factor_id"), F.col("point_id").alias("a"), (F.col("point_id") + k).alias("b"))
    held = df.where("point_id = 0").select(F.col("point_id").alias("factor_id"), F.lit(None).cast("long").alias("a"), F.col("point_id").alias("b"))
    entries = linearize.system_blocks(linear, step(1).unionByName(step(10).where("factor_id % 10 = 0")).unionByName(held))
    blocks = cut(elimination.block_table(entries, 6), "blocks")  # tables: the solution and its check read both again
    truth = df.select(F.col("point_id").alias("i"), F.array(*SOLUTION).alias("x"))
    side = cut(elimination.product(blocks, truth, 6), "side")
    x = elimination.solve(blocks, side, 6)
    exact = elimination.residual(blocks, side, x, 6) < 1e-8
    return x.select("i", *[F.round(F.col("x")[k], 4).alias(f"x{k}") for k in range(6)], F.lit(exact).alias("exact"))


def _registration(spark: SparkSession, sf_dir: str):
    """A cloud and the same one moved; features are the embeddings."""
    df = cloud_e(spark, sf_dir, "point_id", *XYZ)
    f = features_e(spark, sf_dir)
    return rows.transform(df, POSE), df, f, f


def _found(spark: SparkSession, found) -> DataFrame:
    import numpy as np

    m = [(*[float(x) for x in np.asarray(found.motion)[:3].ravel()], bool(found.inlier_rate > 0.99))]
    names = [f"m{i}{j}" for i in range(3) for j in range(4)]
    return spark.createDataFrame(m, ", ".join(f"{c} double" for c in names) + ", inliers boolean").select(*r6(*names, digits=4), "inliers")


MOTION_SQL = "SELECT " + ", ".join(f"round({POSE[i][j]!r}, 4) AS m{i}{j}" for i in range(3) for j in range(4)) + ", TRUE AS inliers"


@query("g1_ransac", MOTION_SQL)
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motion between a cloud and the same one moved."""
    from .plans.registration import RansacParams, ransac

    return _found(spark, ransac(*_registration(spark, sf_dir), RansacParams(resolution=RES)))


@query("g2_gnc", MOTION_SQL)
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.registration import gnc

    return _found(spark, gnc(*_registration(spark, sf_dir)))


@query("g15_lsq_bundle", POOLED_SQL + f" SELECT round({_EV[0]} * (SELECT count(*) FROM e), 4) AS error FROM p")
def g15(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    from .plans.bundle import PlaneFactor, frame_parts

    parts = frame_parts(cloud_e(spark, sf_dir))
    error, _, _ = PlaneFactor(tuple(parts), list(parts.values())).linearize(dict.fromkeys(parts, np.eye(4)))
    return _rows(spark, [(round(error, 4),)], "error double")


_TURN, _SHIFT = "(w0 * w0 + w1 * w1 + w2 * w2)", "(v0 * v0 + v1 * v1 + v2 * v2)"


@query("g17_small_factors", _trajectory_sql() + f" SELECT point_id, {q6(('interpolation', f'0.25 * ({_TURN} + {_SHIFT})'), ('calibration', f'{_TURN} + {_SHIFT}'), ('similarity', f'{_TURN} + 0.25 * {_SHIFT}'), digits=4)} FROM lg")
def g17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared residuals at each pose and the next: of the next pose against that half way, of a motion of nothing seen from a sensor in the body's place, and of a similarity of scale two."""
    import numpy as np

    from .plans import bundle

    def out(a, b):
        still = np.broadcast_to(np.eye(4), a.shape)
        parts = bundle.interpolation_residual(a, b, b, 0.5), bundle.calibration_residual(a, b, still, still), bundle.similarity_residual(2.0, a, b, still)
        return np.stack([(p * p).sum(-1) for p in parts], -1)

    names = ("interpolation", "calibration", "similarity")
    return motions(spark, sf_dir, out, ", ".join(f"{c} double" for c in names)).select("point_id", *r6(*names, digits=4))


def _chain(spark: SparkSession, sf_dir: str):
    """The cloud's points as a trajectory: a prior on the first pose and the motion from each to the next. A graph's poses are the driver's."""
    from .functions import lie
    from .plans.optimize import BetweenFactor, PriorFactor

    found = cloud_e(spark, sf_dir, "point_id", *XYZ, *NORMAL).orderBy("point_id").collect()  # one row a pose of the graph
    poses = [lie.pose(lie.so3_exp(0.3 * np_array([r.nx, r.ny, r.nz])), np_array([r.x, r.y, r.z])) for r in found]
    return poses, [PriorFactor(0, poses[0]), *[BetweenFactor(k, k + 1, lie.between(a, b)) for k, (a, b) in enumerate(zip(poses, poses[1:], strict=False))]]


def np_array(values: list[float]):
    import numpy as np

    return np.array(values)


def _values(spark: SparkSession, values: dict) -> DataFrame:
    return _rows(spark, [(int(k), *m[:3, 3]) for k, m in sorted(values.items())], "key long, tx double, ty double, tz double").select("key", *r6("tx", "ty", "tz", digits=3))


CHAIN_SQL = f"SELECT point_id AS key, {q6(*[(f't{c}', c) for c in XYZ], digits=3)} FROM e"
for _name, _where in (("o2_incremental_smoother", ""), ("o3_dogleg", ""), ("o4_fixed_lag_smoother", " WHERE point_id >= (SELECT max(point_id) - 4 FROM e)"), ("o5_fixed_lag_with_fallback", " WHERE point_id >= (SELECT max(point_id) - 4 FROM e)")):

    @query(_name, CHAIN_SQL + _where)
    def _smooth(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        """The poses that a consistent chain of motions has, each started at the one before it."""
        from .plans.optimize import FixedLagSmoother, Graph, IncrementalSmoother, LMParams, dogleg

        poses, chain = _chain(spark, sf_dir)
        if name == "o3_dogleg":
            return _values(spark, dogleg(Graph(chain), {k: poses[max(k - 1, 0)] for k in range(len(poses))}, radius=10.0)[0])
        if name.startswith("o2"):
            smoother = IncrementalSmoother()
            for k, factor in enumerate(chain):
                out = smoother.update([factor], {k: poses[max(k - 1, 0)]})
            return _values(spark, out)
        smoother = FixedLagSmoother(4.5, fallback=name.startswith("o5"))
        for k, factor in enumerate(chain):
            out = smoother.update([factor], {k: poses[max(k - 1, 0)]}, {k: float(k)}, LMParams(absolute_error=1e-12, relative_error=1e-12))
        return _values(spark, out)
