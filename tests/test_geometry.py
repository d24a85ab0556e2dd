"""Operators against numpy on small scenes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import expr as E
from pointloom.functions import lie
from pointloom.operators import features, neighbors, rows, sampling, stats, voxels
from pointloom.plans import bundle, factors, linearize
from pointloom.plans.optimize import (
    HOOKS, BetweenFactor, ContinuousFactor, FixedLagSmoother, Graph, IncrementalSmoother, LMParams, PriorFactor, ResidualFactor, ScanFactor, dogleg, levenberg_marquardt, numerical_hessian, retract,
)
from pointloom.plans.registration import GncParams, RansacParams, align_points, gnc, ransac
from pointloom.plans.segmentation import CutParams, RegionParams, min_cut, region_growing
from pointloom.plans.trajectory import ContinuousTrajectory, fit_knots
from pointloom.schema import COV, XYZ
from pointloom.sources import files
from pointloom.streaming.maps import CovarianceMap, SlidingWindow, StreamedVoxelMap, VoxelPoints, streaming_voxelmap


def cloud(spark, xyz, **columns):
    data = [(i, *map(float, p), *[float(v[i]) for v in columns.values()]) for i, p in enumerate(np.asarray(xyz))]
    return spark.createDataFrame(data, "point_id long, x double, y double, z double" + "".join(f", {c} double" for c in columns))


def corner(n=120, seed=0):
    """Three orthogonal planes with their normals."""
    rng = np.random.default_rng(seed)
    points, normals = [], []
    for axis in range(3):
        p = rng.uniform(0, 4, (n, 3))
        p[:, axis] = rng.normal(0, 0.005, n)
        points.append(p)
        normals.append(np.tile(np.eye(3)[axis], (n, 1)))
    return np.concatenate(points), np.concatenate(normals)


def with_cov(spark, xyz, normals):
    covs = np.array([np.eye(3) - (1 - 1e-3) * np.outer(n, n) for n in normals])
    at = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    return cloud(spark, xyz, **{c: covs[:, i, j] for c, (i, j) in zip(COV, at)}, **{f"n{a}": normals[:, k] for k, a in enumerate(XYZ)})


def matrix(df, *columns):
    return np.array(df.orderBy(df.columns[0]).select(*columns).collect(), float)


def test_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.uniform(-100, 100, (150, 3)), rng.uniform(0, 1, (50, 3))])
    q = rng.uniform(-200, 200, (30, 3))
    queries = cloud(spark, q).select(F.col("point_id").alias("qid"), *[F.col(c).alias(f"q{c}") for c in XYZ])
    got = neighbors.knn(queries, cloud(spark, p), 5).toPandas().sort_values(["qid", "rank"])
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    assert np.allclose(got.d2.to_numpy().reshape(30, 5), np.sort(d2, 1)[:, :5])


def test_searches_far_from_the_origin(spark):
    """Points along a line where map coordinates put them, and a crowd of copies of one place."""
    line = np.array([[500_000 + 0.2 * i, 4_000_000 + 0.1 * i, 5.0] for i in range(20)])
    p, d2 = cloud(spark, line), ((line[:, None] - line[None]) ** 2).sum(2)
    got = neighbors.radius_search(neighbors.as_queries(p), p, 0.35).toPandas()
    assert len(got) == (d2 < 0.35**2).sum() and len(neighbors.knn(neighbors.as_queries(p), p, 3, max_sq_dist=0.35**2).toPandas()) > 20
    got = neighbors.knn(neighbors.as_queries(p), p, 3).toPandas().sort_values(["qid", "rank"])
    assert np.allclose(got.d2.to_numpy().reshape(20, 3), np.sort(d2, 1)[:, :3], atol=1e-6)
    crowd = np.concatenate([np.tile([[1.0, 2.0, 3.0]], (400, 1)), np.random.default_rng(2).uniform(0, 9, (40, 3))])
    c = cloud(spark, crowd)
    got = neighbors.knn(neighbors.as_queries(c), c, 4).toPandas().sort_values(["qid", "rank"])
    d2 = ((crowd[:, None] - crowd[None]) ** 2).sum(2)
    assert np.allclose(got.d2.to_numpy().reshape(440, 4), np.sort(d2, 1)[:, :4])
    assert got[got.qid < 400].groupby("qid").point_id.apply(list).map(tuple).unique().tolist() == [(0, 1, 2, 3)]


def test_nearest_stamp_is_complete(spark):
    """Over gaps of many buckets, before the first and after the last stamp, with ties and a null time."""
    stamps = [0.0, 1.0, 1.0, 5000.0, 5001.0]
    asked = [-900.0, 0.5, 0.6, 2000.0, 2500.5, 2501.0, 9e6, None]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "qid long, t double")
    s = spark.createDataFrame([(x,) for x in stamps], "stamp double")
    got = {r.qid: r.stamp for r in neighbors.nearest_stamp(q, s, 1.0).collect()}
    assert got == {i: None if t is None else min(stamps, key=lambda x: (abs(x - t), x)) for i, t in enumerate(asked)}
    assert [r.stamp for r in neighbors.nearest_stamp(q, s.limit(0), 1.0).collect()] == [None] * len(asked)


def test_search_edge_cases(spark):
    p = cloud(spark, [[0, 0, 0], [0, 0, 0], [1, 0, 0], [np.nan, 0, 0], [np.inf, 0, 0]])
    q = neighbors.as_queries(p.where("point_id = 0"))
    assert neighbors.radius_search(q, p, 0.0).count() == 0
    assert neighbors.radius_search(q, p, 1.0, 0).count() == 0
    assert neighbors.radius_search(q, p, 1.0).count() == 2  # strictly closer
    assert neighbors.knn(q, p, 10).count() == 3
    assert neighbors.knn(q, p.limit(0), 3).count() == 0


def test_transform_inverts(spark):
    m = lie.se3_exp(np.array([0.3, -0.2, 0.5, 1, 2, 3]))
    xyz, normals = corner(5)
    df = with_cov(spark, xyz, normals)
    back = rows.transform(rows.transform(df, m), lie.inverse(m))
    assert np.allclose(matrix(back, *XYZ, *COV), matrix(df, *XYZ, *COV), atol=1e-9)


def test_raycast_matches_marching(spark):
    rng = np.random.default_rng(2)
    s, e = rng.uniform(-3, 3, (20, 3)), rng.uniform(-3, 3, (20, 3))
    e[0] = s[0] + 1e-6
    rays = spark.createDataFrame([(i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(s, e))], "ray_id long, sx double, sy double, sz double, ex double, ey double, ez double")
    got = rows.raycast(rays, 0.5).toPandas()
    assert 0 not in set(got.ray_id)
    for i in range(1, 20):
        mine = {tuple(r) for r in got[got.ray_id == i][["vx", "vy", "vz"]].to_numpy()}
        t = np.linspace(0, 1, 20001)[:, None]
        want = {tuple(v) for v in np.floor((s[i] + t * (e[i] - s[i])) / 0.5).astype(int)}
        end = tuple(np.floor(e[i] / 0.5).astype(int))
        assert end not in mine and want - {end} <= mine and len(mine - want) <= 1


def test_voxelgrid_drops_bad_points(spark):
    df = cloud(spark, [[0.1, 0.1, 0.1], [0.2, 0.2, 0.2], [np.nan, 0, 0], [1e12, 0, 0]])
    assert [r.n for r in sampling.voxelgrid_sampling(df, 1.0).collect()] == [2]


def test_random_sampling_is_exact(spark):
    df = cloud(spark, np.random.default_rng(3).normal(size=(333, 3)))
    assert sampling.random_sampling(df, 0.5).count() == 166
    assert sampling.random_sampling(df, 0.995).count() == 333


def test_overlap_of_nothing(spark):
    df = cloud(spark, [[0, 0, 0.0]])
    assert np.isnan(voxels.overlap(df.limit(0), voxels.occupancy(df, 1.0), 1.0).head().rate)


def test_eigenvalues_closed_form(spark):
    a = np.random.default_rng(4).normal(size=(20, 3, 3))
    c = a @ a.transpose(0, 2, 1)
    at = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    df = cloud(spark, np.zeros((20, 3)), **{n: c[:, i, j] for n, (i, j) in zip(COV, at)})
    got = matrix(df.select("point_id", *[F.expr(x).alias(f"l{i}") for i, x in enumerate(E.eigenvalues(COV))]), "l0", "l1", "l2")
    assert np.allclose(got, np.linalg.eigvalsh(c), atol=1e-8)


def test_normals_and_covariances_of_a_plane(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(-1, 1, (100, 3))
    p[:, 2] = 2.0
    df = cloud(spark, p)
    assert np.allclose(np.abs(matrix(features.normals(df), "nz")), 1, atol=1e-6)
    c = matrix(features.covariances(df), *COV)
    assert np.allclose(c[:, 5], 1e-3, atol=1e-6) and np.allclose(c[:, 0] + c[:, 3], 2, atol=1e-6)


def test_fpfh_sums(spark):
    xyz, normals = corner(40)
    df = cloud(spark, xyz, nx=normals[:, 0], ny=normals[:, 1], nz=normals[:, 2])
    f = matrix(features.dense(features.fpfh(df, 1.0), 33), "f").reshape(-1, 33)
    assert np.allclose(f[:, :11].sum(1), 100) and np.allclose(f[:, 11:22].sum(1), 100, atol=1e-6)


def test_outliers(spark):
    p = np.concatenate([np.random.default_rng(6).normal(0, 0.1, (80, 3)), [[9, 9, 9]]])
    assert 80 not in {r.point_id for r in stats.remove_outliers(cloud(spark, p), 5).collect()}


def test_upper_median(spark):
    df = cloud(spark, np.zeros((4, 3)), v=np.array([4.0, 1, 3, 2]))
    assert stats.upper_median(df, "v") == 3.0


def numeric_linear(rows_of, m):
    e = lambda d: linearize.errors(rows_of(lie.se3_exp(d) @ m)).head().error
    h = 1e-5
    return np.array([(e(h * d) - e(-h * d)) / (2 * h) for d in np.eye(6)]) / 2


@pytest.mark.parametrize("factor", ["icp", "gicp", "icp_plane"])
def test_gradient_is_the_derivative(spark, factor):
    xyz, normals = corner(30)
    target, m = with_cov(spark, xyz, normals), lie.se3_exp(np.array([0.01, -0.02, 0.015, 0.02, 0.01, -0.02]))
    source = rows.transform(target, lie.inverse(m)).where("point_id % 3 = 0")
    f = lambda x: getattr(factors, factor)(source, target, x, 0.5)
    start = lie.se3_exp(np.array([0.002, 0.001, 0, 0.001, 0, 0])) @ m
    linear = linearize.collect(f(start))[0]
    if factor == "gicp":  # the weight turns with the pose too, which a Gauss-Newton step leaves out
        assert np.all(np.linalg.eigvalsh(linear.h) > 0)
    else:
        assert np.allclose(linear.b, numeric_linear(f, start), atol=1e-3 * max(1, np.abs(linear.b).max()))


@pytest.mark.parametrize("kind", ["gicp", "vgicp"])
def test_alignment_converges(spark, kind):
    xyz, normals = corner(150)
    target = with_cov(spark, xyz, normals).cache()
    truth = lie.se3_exp(np.array([0.02, -0.03, 0.04, 0.1, -0.05, 0.08]))
    source = rows.transform(target, lie.inverse(truth)).cache()
    cells = voxels.gaussian_voxelmap(target, 1.0).cache()
    make = (lambda m, i: factors.gicp(source, target, m, 1.0, i)) if kind == "gicp" else (lambda m, i: factors.vgicp(source, cells, 1.0, m, i))
    values, _ = levenberg_marquardt(Graph([ScanFactor(make, 0)]), {0: np.eye(4)}, LMParams(max_iterations=12))
    off = lie.se3_log(lie.between(truth, values[0]))
    assert np.abs(off[:3]).max() < 0.015 and np.abs(off[3:]).max() < 0.15


def loop_graph():
    step = lie.se3_exp(np.array([0, 0, np.pi / 4, 1, 0, 0]))
    return step, Graph([PriorFactor(0, np.eye(4)), *[BetweenFactor(i, (i + 1) % 8, step) for i in range(8)]])


@pytest.mark.parametrize("method", [levenberg_marquardt, dogleg])
def test_pose_graph(method):
    step, graph = loop_graph()
    rng = np.random.default_rng(7)
    truth = {0: np.eye(4)}
    for i in range(7):
        truth[i + 1] = truth[i] @ step
    noisy = {k: lie.se3_exp(rng.normal(0, 0.05, 6)) @ v for k, v in truth.items()}
    values, _ = method(graph, noisy)
    # a regular octagon of unit chords does not close exactly; all edges share what is left
    assert graph.error(values) < 0.05 * graph.error(noisy)


def chain(n, loops=0, seed=8):
    """A trajectory of n poses as a graph with some loops, its truth and a noisy start."""
    rng = np.random.default_rng(seed)
    truth = {0: np.eye(4)}
    for k in range(1, n):
        truth[k] = truth[k - 1] @ lie.se3_exp(np.array([*rng.normal(0, 0.05, 3), 1, 0, 0]))
    links = [(k, k + 1) for k in range(n - 1)] + [tuple(sorted(rng.choice(n, 2, replace=False))) for _ in range(loops)]
    factors_ = [PriorFactor(0, truth[0]), *[BetweenFactor(int(a), int(b), lie.between(truth[a], truth[b])) for a, b in links]]
    return truth, Graph(factors_), {k: lie.se3_exp(rng.normal(0, 0.02, 6)) @ v for k, v in truth.items()}


def test_solvers_agree():
    _, graph, noisy = chain(12, 5)
    system = graph.linearize(noisy)
    h, b = system.dense(), system.vector(system.b)
    want = -np.linalg.solve(h + 0.1 * np.diag(np.diag(h)), b)
    for solve in (system.solve, system.solve_cg, system.solve_dense):
        assert np.allclose(system.vector(solve(0.1)), want, atol=1e-6)
    assert np.allclose(system.times(want), h @ want) and np.allclose(system.inverse_block(5), np.linalg.inv(h)[30:36, 30:36])


def test_a_graph_of_a_thousand_poses_stays_sparse():
    truth, graph, noisy = chain(1000, 20)
    system = graph.linearize(noisy)
    assert sum(len(row) for row in system.blocks.values()) <= 1000 + 999 + 20
    values, status = levenberg_marquardt(graph, noisy, LMParams(max_iterations=10, absolute_error=1e-12, relative_error=1e-12))
    assert status.error < 1e-6 and max(np.abs(values[k] - truth[k]).max() for k in truth) < 0.02


@pytest.mark.parametrize("adapt", ["search_each", "search_reduce", "one_step"])
def test_dogleg_modes(adapt):
    truth, graph, noisy = chain(10, 2)
    values, _ = dogleg(graph, noisy, radius=0.5, adapt=adapt)
    assert max(np.abs(values[k] - truth[k]).max() for k in truth) < 1e-3


def test_incremental_smoothing_works_on_what_changes():
    truth, graph, _ = chain(40)
    smoother = IncrementalSmoother()
    for k in range(40):
        out = smoother.update([graph.factors[k]], {k: truth[k] if k == 0 else out[k - 1] @ lie.between(truth[k - 1], truth[k])})
        assert smoother.relinearized <= 3 and smoother.recalculated <= 4
    assert max(np.abs(out[k] - truth[k]).max() for k in truth) < 1e-6
    closing = BetweenFactor(20, 39, lie.between(truth[20], truth[39]) @ lie.se3_exp(np.array([0, 0, 0, 0.3, 0, 0])))
    out = smoother.update([closing], {})
    assert 1 < smoother.relinearized < len(smoother.factors) * 5 and smoother.recalculated % 20 < 40
    batch, _ = levenberg_marquardt(Graph(smoother.factors), truth, LMParams(absolute_error=1e-14, relative_error=1e-14))
    assert max(np.abs(out[k] - batch[k]).max() for k in truth) < 1e-3
    # the poses before the loop did not have to be eliminated again
    smoother.update([BetweenFactor(38, 39, lie.between(out[38], out[39]))], {})
    assert smoother.recalculated <= 4


def test_jacobian_of_the_relative_motion():
    rng = np.random.default_rng(4)
    for scale in (0.1, 0.4, 2.0):
        x, y = lie.se3_exp(rng.normal(0, 1, 6)), lie.se3_exp(rng.normal(0, scale, 6))
        f = BetweenFactor(0, 1, lie.between(x, y) @ lie.se3_exp(rng.normal(0, scale / 4, 6)))
        want = ResidualFactor((0, 1), f.residual).linearize({0: x, 1: y})
        assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(f.linearize({0: x, 1: y}), want))


def test_linearisation_hook():
    _, graph, noisy = chain(5)
    calls = []

    def hook(found, values):
        calls.append(len(found))
        return [f.linearize(values) for f in found]

    plain = graph.linearize(noisy).dense()
    HOOKS.register(BetweenFactor, hook)
    try:
        assert np.allclose(graph.linearize(noisy).dense(), plain) and calls == [4]
    finally:
        HOOKS.remove(BetweenFactor)


@pytest.mark.parametrize("kind", ["plane", "edge", "least squares"])
def test_bundle_factors_follow_their_error(kind):
    """Gradient and curvature of the spread over poses against differences; and poses pushed apart come back."""
    rng = np.random.default_rng(3)
    parts = []
    for _ in range(3):
        p = rng.normal(0, (1, 0.05 if kind == "edge" else 1, 0.02), (50, 3))
        parts.append((len(p), p.mean(0), np.cov(p.T, bias=True)))
    keys = (0, 1, 2)
    poses = {k: lie.se3_exp(rng.normal(0, 0.02, 6)) for k in keys}
    factor = bundle.PlaneFactor(keys, parts) if kind == "least squares" else bundle.SpreadFactor(keys, parts, kind)

    def error(d):
        at = [lie.se3_exp(d[6 * k : 6 * k + 6]) @ poses[k] for k in keys]
        if kind == "least squares":
            return bundle.lsq_error(parts, at)
        return factor.error(at)

    e, h, b = factor.linearize(poses)
    assert np.isclose(e, error(np.zeros(18)))
    gradient = np.array([(error(1e-6 * v) - error(-1e-6 * v)) / 2e-6 for v in np.eye(18)])
    assert np.allclose(2 * b, gradient, atol=1e-5 * max(1, np.abs(gradient).max()))
    if kind != "least squares":
        assert np.allclose(2 * h, numerical_hessian(error, 18), atol=0.1 * np.abs(h).max())
    values, status = levenberg_marquardt(Graph([PriorFactor(0, poses[0]), factor]), poses, LMParams(max_iterations=30, absolute_error=1e-9))
    assert status.error < 0.8 * status.history[0] if kind != "edge" else status.error <= status.history[0]


def test_inertial_factor_in_a_graph():
    """Two states from samples at rest but for a turn: the second is found from the first."""
    samples = np.array([[0, 0, 9.80665, 0, 0, 0.2, 0.01]] * 100)
    values = {0: np.eye(4), 1: np.zeros(3), 2: lie.se3_exp(np.array([0.05, 0, 0.1, 0.2, 0, 0])), 3: np.array([0.1, 0, 0]), 4: np.zeros(6)}
    hold = lambda k, at: ResidualFactor((k,), lambda v: v - at, 1e6)
    graph = Graph([PriorFactor(0, np.eye(4)), hold(1, np.zeros(3)), hold(4, np.zeros(6)), bundle.InertialFactor((0, 1, 2, 3, 4), samples)])
    out, status = levenberg_marquardt(graph, values, LMParams(absolute_error=1e-14))
    assert status.error < 1e-10 and np.allclose(out[2], lie.pose(lie.so3_exp(np.array([0, 0, 0.2])), np.zeros(3)), atol=1e-5)
    j = bundle.bias_jacobian(samples, np.zeros(3), np.zeros(3))
    assert np.allclose(j[3:6, :3], -np.array([[np.sin(0.2) / 0.2, -(1 - np.cos(0.2)) / 0.2, 0], [(1 - np.cos(0.2)) / 0.2, np.sin(0.2) / 0.2, 0], [0, 0, 1]]), atol=2e-3)


def test_small_factors_in_a_graph():
    a, b = np.eye(4), lie.se3_exp(np.array([0.1, 0.2, 0.3, 1, 2, 3]))
    half = lie.interpolate(a, b, 0.5)
    start = {0: a, 1: b, 2: half @ lie.se3_exp(np.full(6, 0.05)), 3: np.array([0.2]), 4: b @ lie.se3_exp(np.full(6, 0.02))}
    graph = Graph([PriorFactor(0, a), PriorFactor(1, b), bundle.interpolation_factor(0, 1, 2, 0.5), bundle.similarity_factor(3, 0, 4, lie.between(a, b)), bundle.expression_factor((4,), lambda x: x, b), bundle.rotate_vector_factor(4, np.array([0, 0, 1.0]), b[:3, 2])])
    out, status = levenberg_marquardt(graph, start, LMParams(absolute_error=1e-16, relative_error=1e-16))
    assert status.error < 1e-10 and np.allclose(out[2], half, atol=1e-4) and abs(out[3][0]) < 1e-3
    assert retract({0: np.zeros(2)}, {0: np.ones(2)})[0].tolist() == [1, 1]


@pytest.mark.parametrize("kind", ["icp", "gicp"])
def test_continuous_time_alignment(spark, kind):
    """A scan taken while the sensor moved: both end poses are found, to the reference's tolerance of a few centimetres."""
    xyz, normals = corner(150)
    target = with_cov(spark, xyz, normals).cache()
    truth = lie.se3_exp(np.array([0.0, 0.0, 0.03, 0.05, -0.02, 0.03]))
    t = np.random.default_rng(5).uniform(0, 1, len(xyz))
    back = [lie.inverse(lie.interpolate(np.eye(4), truth, s)) for s in t]
    moved = np.array([m[:3, :3] @ p + m[:3, 3] for m, p in zip(back, xyz)])
    turned = np.array([m[:3, :3] @ n for m, n in zip(back, normals)])
    covs = np.array([np.eye(3) - (1 - 1e-3) * np.outer(n, n) for n in turned])
    at = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    source = cloud(spark, moved, t=t, **{c: covs[:, i, j] for c, (i, j) in zip(COV, at)}).cache()
    stamps = factors.stamps_of(16)
    make = {"icp": factors.ct_icp, "gicp": factors.ct_gicp}[kind]
    graph = Graph([ContinuousFactor(lambda a, b, i: make(source, target, a, b, 1.0, i, stamps), 0, 1, stamps)])
    values, status = levenberg_marquardt(graph, {0: np.eye(4), 1: np.eye(4)}, LMParams(max_iterations=6))
    assert status.error < 0.2 * status.history[0]
    for key, want in ((0, np.eye(4)), (1, truth)):
        off = lie.se3_log(lie.between(want, values[key]))
        assert np.abs(off[:3]).max() < 0.01 and np.abs(off[3:]).max() < 0.05


def test_fixed_lag_equals_batch():
    step = lie.se3_exp(np.array([0, 0, 0.1, 1, 0, 0]))
    lag, batch, guess = FixedLagSmoother(2.5), IncrementalSmoother(), np.eye(4)
    for k in range(7):
        new = [PriorFactor(0, np.eye(4))] if k == 0 else [BetweenFactor(k - 1, k, step)]
        out, whole = lag.update(new, {k: guess}, {k: float(k)}), batch.update(new, {k: guess})
        guess = guess @ step
    assert set(out) == {4, 5, 6} and np.allclose(out[6], whole[6], atol=1e-6)
    assert np.all(np.linalg.eigvalsh(batch.marginal_covariance(6)) > 0)
    with pytest.raises(KeyError):
        lag.update([BetweenFactor(0, 7, step)], {7: guess}, {7: 7.0})


@pytest.mark.parametrize("yaw_only", [False, True])
def test_closed_form_alignment(yaw_only):
    rng = np.random.default_rng(9)
    m = lie.pose(lie.so3_exp(np.array([0, 0, 1.2] if yaw_only else [0.3, -1, 0.7])), np.array([1, 2, 3.0]))
    p = rng.uniform(-1, 1, (10, 3))
    got = align_points(p, p @ m[:3, :3].T + m[:3, 3], rng.uniform(1e-3, 1, 10), yaw_only)
    assert np.allclose(got, m, atol=1e-9)


def test_global_registration(spark):
    xyz, _ = corner(40)
    xyz = xyz + np.array([1.0, 0.4, 0.0]) * (xyz[:, :1] > 2)
    m = lie.pose(lie.so3_exp(np.array([0, 0, np.pi / 2])), np.array([20, 5, 1.0]))
    target, source = cloud(spark, xyz @ m[:3, :3].T + m[:3, 3]).cache(), cloud(spark, xyz).cache()
    f = np.random.default_rng(10).normal(size=(len(xyz), 8))
    table = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(f)], "point_id long, f array<double>").cache()
    a = gnc(target, source, table, table, GncParams())
    b = ransac(target, source, table, table, RansacParams(iterations=64, chunk=64, resolution=0.5))
    for got in (a, b):
        off = lie.se3_log(lie.between(m, got.motion))
        assert np.abs(off[3:]).max() < 0.5 and np.abs(off[:3]).max() < 0.1 and got.inlier_rate > 0.8


def test_region_growing_and_cut(spark):
    xyz, normals = corner(200)
    df = cloud(spark, xyz, nx=normals[:, 0], ny=normals[:, 1], nz=normals[:, 2]).cache()
    got = {r.point_id for r in region_growing(df, (2, 2, 0), RegionParams(distance=0.8), dilate=False).collect()}
    assert got <= set(range(400, 600)) and len(got) > 150
    seeds = spark.createDataFrame([(0, 1.0, 1.0, 0.0)], "seed_id long, sx double, sy double, sz double")
    assert min_cut(df, seeds, CutParams(k=8, background=2.0)).count() > 0


def test_spline_fit():
    t = np.arange(0, 9.51, 0.5)
    poses = [lie.pose(lie.so3_exp(np.array([0.1 * np.sin(x), 0, 0.05 * x])), np.array([x, np.sin(x / 2), 0])) for x in t]
    traj = fit_knots(t, poses, 0.5, smoothness=1e-4)
    for x, p in list(zip(t, poses))[2:-2]:
        assert np.linalg.norm(traj.pose(x)[:3, 3] - p[:3, 3]) < 0.02
        assert np.linalg.norm(lie.so3_log(traj.pose(x)[:3, :3].T @ p[:3, :3])) < 0.05


def test_spline_imu():
    k = np.arange(12) * 0.5
    traj = ContinuousTrajectory(0.0, 0.5, np.array([lie.so3_exp(np.array([0, 0, 0.2 * x])) for x in k]), np.array([[0.5 * 2 * x * x, 0, 0] for x in k]))
    a = traj.imu(2.2)
    assert np.allclose(a[5], 0.2, atol=1e-9) and np.allclose(traj.pose(2.2)[:3, :3] @ a[:3], [2, 0, 9.80665], atol=1e-6)


def test_eigen_derivatives():
    p = np.random.default_rng(11).normal(size=(8, 3)) * [0.1, 0.4, 1]
    value, grad, hess = bundle.eigen_derivatives(p, 0)
    f = lambda x: np.linalg.eigvalsh(np.cov(x.reshape(-1, 3).T, bias=True))[0]
    h = 1e-5
    assert np.isclose(value, f(p.ravel()))
    assert np.allclose(grad, [(f(p.ravel() + h * e) - f(p.ravel() - h * e)) / (2 * h) for e in np.eye(24)], atol=1e-5)
    num = np.array([(bundle.eigen_derivatives((p.ravel() + h * e).reshape(-1, 3), 0)[1] - bundle.eigen_derivatives((p.ravel() - h * e).reshape(-1, 3), 0)[1]) / (2 * h) for e in np.eye(24)])
    assert np.allclose(hess, num, atol=1e-3)


def test_preintegration_of_constant_turn():
    samples = np.array([[0, 0, 0, 0, 0, 0.5, 0.01]] * 100)
    assert np.allclose(lie.so3_log(bundle.preintegrate(samples).rotation), [0, 0, 0.5], atol=1e-9)


def test_frame_files(spark, tmp_path):
    xyz, normals = corner(10)
    df = with_cov(spark, xyz, normals).withColumn("t", F.col("point_id") * 0.1).withColumn("intensity", F.col("x")).withColumn("tag_one", F.encode(F.lpad(F.col("point_id").cast("string"), 4, "0"), "utf-8"))
    for compact, atol in ((False, 0), (True, 1e-5)):
        path = str(tmp_path / f"frame{compact}")
        files.save_frame(df, path, compact)
        back = files.load_frame(spark, path)
        names = [*XYZ, "nx", "ny", "nz", *COV, "t", "intensity"]
        assert np.allclose(matrix(back, *names), matrix(df, *names), atol=atol)
        assert back.where("cast(cast(tag_one as string) as int) = point_id").count() == 30


def test_raw_and_text_files(spark, tmp_path):
    a = np.arange(12, dtype="<f4")
    a.tofile(tmp_path / "p.bin")
    assert np.allclose(matrix(files.read_points(spark, str(tmp_path / "p.bin")).drop("path"), *XYZ), a.reshape(4, 3))
    assert files.read_points4(spark, str(tmp_path / "p.bin")).count() == 3 and files.read_times(spark, str(tmp_path / "p.bin")).count() == 12
    (tmp_path / "graph.txt").write_text("v0 1 2 3 0 0 0 1\nv12 4 5 6 0 0 0 1\nnote\n")
    assert [r.frame_id for r in files.read_graph(spark, str(tmp_path / "graph.txt")).orderBy("frame_id").collect()] == [0, 12]
    traj = spark.createDataFrame([(0.5, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)], "ts double, tx double, ty double, tz double, qx double, qy double, qz double, qw double")
    files.write_tum(traj, str(tmp_path / "tum"))
    assert files.read_tum(spark, str(tmp_path / "tum")).head() == traj.head()


def test_voxelmap_file(spark, tmp_path):
    xyz, normals = corner(20)
    m = voxels.gaussian_voxelmap(with_cov(spark, xyz, normals), 1.0)
    files.save_voxelmap(m, str(tmp_path / "map.bin"), 0.75)
    back, resolution = files.load_voxelmap(spark, str(tmp_path / "map.bin"))
    assert resolution == 0.75
    assert np.allclose(np.array(back.orderBy("vkey").select("vkey", "n", "mx", *COV).collect(), float), np.array(m.orderBy("vkey").select("vkey", "n", "mx", *COV).collect(), float), atol=1e-5)


def test_incremental_maps(spark, tmp_path):
    rng = np.random.default_rng(12)
    df = cloud(spark, rng.uniform(0, 3, (300, 3))).cache()
    one, three = StreamedVoxelMap(1.0).insert(df), StreamedVoxelMap(1.0)
    target = VoxelPoints(spark, 1.0, most_points=5, clear_cycle=2, horizon=0)
    for k in range(3):
        three.insert(df.where(F.col("point_id") % 3 == k))
    key = lambda m: np.array(m.state.orderBy("vkey").select("vkey", "n", "mx", "my", "mz").collect(), float)
    assert np.allclose(key(one), key(three))
    target.insert(df)
    assert target.state.groupBy("vkey").count().agg({"count": "max"}).head()[0] <= 5
    target.insert(cloud(spark, [[0.5, 0.5, 0.5]]))
    assert target.state.select("vkey").distinct().count() == 1  # all others were not touched
    grown = CovarianceMap(VoxelPoints(spark, 1.0, least_distance=0.0, most_points=100)).insert(df)
    assert grown.valid().count() > 200
    df.write.parquet(str(tmp_path / "in"))
    stream = streaming_voxelmap(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 1.0)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("voxels_out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM voxels_out").head()[0] == 300


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    """A stream of two files: the batches are applied once, also when one is given again or by an object that was just made."""
    from pointloom.streaming.maps import apply_batch, voxel_points_stream

    rng = np.random.default_rng(13)
    a, b = cloud(spark, rng.uniform(0, 3, (100, 3))), cloud(spark, rng.uniform(0, 3, (100, 3)))
    folder = f"file://{tmp_path}/map"
    make = lambda: VoxelPoints(spark, 1.0, least_distance=0.0)
    first = make()
    assert apply_batch(first, a, 0, folder) and apply_batch(first, b, 1, folder)
    want = sorted(map(str, first.state.collect()))
    again = make()
    assert not apply_batch(again, b, 1, folder) and sorted(map(str, again.state.collect())) == want and again.inserts == 2
    before = dict(again.tables)
    again.insert(cloud(spark, [[0.5, 0.5, 0.5]]))
    assert len([k for k in again.tables if again.tables[k] != before.get(k)]) == 1  # one part is rewritten
    a.write.parquet(str(tmp_path / "in"))
    target = make()
    q = voxel_points_stream(spark.readStream.schema(a.schema).parquet(str(tmp_path / "in")), target, f"file://{tmp_path}/stream").start()
    q.processAllAvailable()
    q.stop()
    assert target.state.count() > 50 and make().restore(f"file://{tmp_path}/stream/map") == 0


def test_interpolation_command(spark, tmp_path):
    """A smooth trajectory sampled at 10 Hz comes back at 20 Hz, with the inertial values of its motion."""
    from pointloom.interpolate import main

    t = np.arange(0, 5.05, 0.1)
    lines = [f"{x:.9f} {np.sin(x):.9f} {np.cos(x):.9f} 0 0 0 {np.sin(x / 4):.9f} {np.cos(x / 4):.9f}" for x in t]
    (tmp_path / "in.txt").write_text("# t x y z qx qy qz qw\n" + "\n".join(lines) + "\n")
    main([str(tmp_path / "in.txt"), str(tmp_path / "poses"), str(tmp_path / "imu"), "--step", "0.05", "--smoothness", "1e-5"])
    got = files.read_tum(spark, str(tmp_path / "poses")).orderBy("ts").toPandas()
    inner = got[(got.ts > 0.5) & (got.ts < 4.5)]
    assert abs(got.ts.iloc[0] - t[0]) < 1e-6 and abs(got.ts.iloc[-1] - t[-1]) < 1e-6 and len(got) == 101
    assert np.abs(inner.tx - np.sin(inner.ts)).max() < 1e-3 and np.abs(inner.qz - np.sin(inner.ts / 4)).max() < 1e-3
    imu = spark.read.csv(str(tmp_path / "imu"), sep=" ", schema="ts double, ax double, ay double, az double, wx double, wy double, wz double").where("ts > 0.5 and ts < 4.5").toPandas()
    assert np.abs(imu.wz - 0.5).max() < 0.01 and np.abs(imu.az - 9.80665).max() < 0.01


def test_sliding_window():
    w = SlidingWindow()
    for x in "abc":
        w.append(x)
    w.erase(0)
    assert w[1] == "b" and len(w) == 2
    with pytest.raises(IndexError):
        w[0]


def test_time_buckets_are_anchored():
    assert factors.time_buckets(np.array([0, 0.4, 0.8, 1.2, 1.6, 2.4]), 1.0).tolist() == [0, 0, 0, 1, 1, 2]
