"""Queries on clouds of more points than the small tables have."""

import numpy as np
import pandas as pd
import pytest

from pointloom import catalog


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """A folder with 1,500 embeddings: more points than the covariance map needs before it judges them."""
    import pandas as pd

    rng, folder = np.random.default_rng(4), tmp_path_factory.mktemp("crowd")
    e = rng.normal(0, 0.12, (1_500, 64)).astype("float32")
    pd.DataFrame({"vec_id": np.arange(len(e)), "embedding": list(e), "label": rng.integers(0, 10, len(e)).astype("int32")}).to_parquet(folder / "embeddings.parquet")
    return str(folder)


def cloud(spark, folder):
    return catalog.cloud_e(spark, folder, "point_id", "x", "y", "z", "intensity").orderBy("point_id").toPandas()


def test_covariance_map_without_limits_keeps_all_points_of_a_larger_cloud(spark, crowd):
    xyz = cloud(spark, crowd)[["x", "y", "z"]].to_numpy()
    cells = np.floor(xyz)
    around = np.array([(np.abs(cells - c).max(1) <= 1).sum() for c in cells])
    got = catalog.QUERIES["s2_covariance_map_all"](spark, crowd).toPandas()
    assert len(xyz) > 1_024 and set(got.point_id) == set(np.flatnonzero(around >= 5))


class Short:
    """(x - 3)^2 with a model ten times too steep: its steps are a tenth of what they should be."""

    keys = (0,)

    def linearize(self, values):
        r = values[0] - 3.0
        return float(r @ r), 10.0 * np.eye(1), r


def test_alignment_lengthens_short_steps_and_says_how_it_ended():
    from pointloom.plans.optimize import Graph, LMParams, levenberg_marquardt

    start, p = {0: np.zeros(1)}, {"relative_error": 1e-9, "absolute_error": 1e-9}
    values, status = levenberg_marquardt(Graph([Short()]), start, LMParams(max_iterations=12, **p))
    assert not status.converged and abs(values[0][0] - 3) > 0.1
    values, status = levenberg_marquardt(Graph([Short()]), start, LMParams(max_iterations=12, doublings=6, **p))
    assert status.converged and abs(values[0][0] - 3) < 1e-3
    done = levenberg_marquardt(Graph([Short()]), start, LMParams(max_iterations=status.iterations, doublings=6, **p))[1]
    assert done.converged and done.iterations == status.iterations


def loop(n):
    """n poses in a chain of known motions with large steps, and the graph's factors in the order in which they come."""
    from pointloom.functions import lie
    from pointloom.plans.optimize import BetweenFactor, PriorFactor

    rng = np.random.default_rng(7)
    poses = [lie.pose(lie.so3_exp(rng.normal(0, 0.3, 3)), rng.normal(0, 1.2, 3)) for _ in range(n)]
    return poses, [PriorFactor(0, poses[0]), *[BetweenFactor(k, k + 1, lie.between(a, b)) for k, (a, b) in enumerate(zip(poses, poses[1:], strict=False))]]


def test_an_update_of_a_long_chain_solves_only_what_it_changes():
    from pointloom.plans.optimize import IncrementalSmoother

    poses, factors = loop(300)
    smoother, solved = IncrementalSmoother(), 0
    resolve = smoother.system.resolve

    def counted():
        nonlocal solved
        out = resolve()
        solved += len(out[2])
        return out

    smoother.system.resolve = counted
    for k, factor in enumerate(factors):
        out = smoother.update([factor], {k: poses[max(k - 1, 0)]})
    assert solved < 300 * 20  # a solution of all poses at each update would be 45,000 at the least
    assert max(np.abs(out[k] - p).max() for k, p in enumerate(poses)) < 1e-6


def test_stacks_of_factors_are_linearised_as_one_by_one():
    from pointloom.functions import lie
    from pointloom.plans.optimize import BetweenFactor, Graph, between_stack

    rng = np.random.default_rng(8)
    pose = lambda: lie.pose(lie.so3_exp(rng.normal(0, 0.25, 3)), rng.normal(0, 1.2, 3))
    values = {k: pose() for k in range(12)}
    factors = [BetweenFactor(k, (k + 5) % 12, pose(), 1.0 + k) for k in range(12)]
    for f, (error, h, b) in zip(factors, between_stack(factors, values), strict=True):
        e0, h0, b0 = f.linearize(values)
        assert np.isclose(error, e0) and np.allclose(h, h0, atol=1e-6) and np.allclose(b, b0, atol=1e-6)
    assert np.isclose(Graph(factors).error(values), sum(f.linearize(values)[0] for f in factors))


def test_crowded_voxels_are_searched_by_smaller_cells(spark, crowd, monkeypatch):
    """The nearest within voxels equal brute force where voxels are crowded, and no round looks at all pairs of those voxels."""
    from pointloom.operators import neighbors

    monkeypatch.setattr(neighbors, "CROWD", 8)
    monkeypatch.setattr(neighbors, "DENSE", 2)
    seen, plain = [], neighbors.cell_pairs

    def cell_pairs(queries, points, cell, *more):
        seen.append((queries.count(), cell))
        return plain(queries, points, cell, *more)

    monkeypatch.setattr(neighbors, "cell_pairs", cell_pairs)
    pdf = cloud(spark, crowd)
    xyz, intensity = pdf[["x", "y", "z"]].to_numpy(), pdf.intensity.to_numpy()
    cells = np.abs(np.floor(xyz)[:, None] - np.floor(xyz)[None])
    square = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    whole = square + (intensity[:, None] - 2 * intensity[None]) ** 2
    cases = {
        "j6_knn_voxel": (square, cells.sum(2) <= 1, 5),
        "j7_knn_valid": (square, (cells.max(2) <= 1) & (intensity > 0)[None], 5),
        "j5_knn_xyzi": (whole, whole < 1.0, 4),
    }
    for name, (d2, ok, k) in cases.items():
        seen.clear()
        got = catalog.QUERIES[name](spark, crowd).toPandas()
        want = {(q, p, r + 1) for q in range(len(xyz)) for r, p in enumerate(sorted(np.flatnonzero(ok[q]), key=lambda p: (d2[q, p], p))[:k])}
        assert set(zip(got.qid, got.point_id, got["rank"], strict=True)) == want, name
        assert seen[0][1] < 1.0 and seen[-1][0] < len(xyz), name


def plan(df):
    return df._jdf.queryExecution().toString()


def test_all_pairs_within_a_radius_are_ranked_where_they_are_made(spark, crowd, monkeypatch):
    """Rows and ranks equal brute force where blocks are divided, ties and copies included, and pairs are neither shuffled nor sorted for a window."""
    from pointloom.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK", 16)
    df = catalog.cloud_e(spark, crowd, "point_id", "x", "y", "z")
    df = df.unionByName(df.where("point_id < 20").withColumn("point_id", df.point_id + 5_000))
    pdf = df.orderBy("point_id").toPandas()
    out = neighbors.radius_search(neighbors.as_queries(df), df, 0.9)
    assert "Window" not in plan(out)
    xyz, ids = pdf[["x", "y", "z"]].to_numpy(), pdf.point_id.to_numpy()
    d = xyz[:, None] - xyz[None]
    d2 = d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2]
    want = {(ids[q], ids[p], d2[q, p], r + 1) for q in range(len(ids)) for r, p in enumerate(sorted(np.flatnonzero(d2[q] < 0.9 * 0.9), key=lambda p: (d2[q, p], p)))}
    got = out.toPandas()
    assert len(got) == len(want) and set(zip(got.qid, got.point_id, got.d2, got["rank"], strict=True)) == want


def written(monkeypatch, features):
    """The names of the tables that features write."""
    names, plain = [], features.cut

    def cut(df, name="cut"):
        names.append(name)
        return plain(df, name)

    monkeypatch.setattr(features, "cut", cut)
    return names


def same_histograms(got, want):
    a, b = (df.toPandas().sort_values(["point_id", "bin"]).reset_index(drop=True) for df in (got, want))
    assert len(a) == len(b) and (a[["point_id", "bin"]] == b[["point_id", "bin"]]).all().all() and np.allclose(a.value, b.value, rtol=1e-9, atol=1e-9)


def test_pfh_finds_each_pairs_bin_once_and_writes_no_pairs(spark, crowd, monkeypatch):
    """Histograms equal those made from a table of all neighbours, where blocks and strips are divided."""
    import pyarrow as pa

    from pointloom.operators import features, neighbors

    df = catalog.cloud_e(spark, crowd, "point_id", *features._POINT).where("point_id < 500").cache()
    near = neighbors.radius_search(neighbors.as_queries(df), df, 0.8)
    want = features.pfh(df, 0.8, near)
    names = written(monkeypatch, features)
    monkeypatch.setattr(features, "PAIR_BLOCK", 8)
    same_histograms(features.pfh(df, 0.8), want)
    assert "near" not in names
    # the work of one task with all points, some strips of pairs at a time
    monkeypatch.setattr(features, "STRIP", 10_000)
    seen, plain = [], features._pair_bins
    monkeypatch.setattr(features, "_pair_bins", lambda p, rows, reach: seen.append(len(rows)) or plain(p, rows, reach))
    pdf = df.toPandas()
    tables = pa.table({"qid": pdf.point_id, **{f"q{c}": pdf[c] for c in features._POINT}}), pa.table({"point_id": pdf.point_id, **{c: pdf[c] for c in features._POINT}})
    parts = [x.to_pandas() for x in features._pfh(0.8, "point_id long, bin int, k long")(*tables)]
    k = np.zeros((500, 125))
    for x in parts:
        np.add.at(k, (x.point_id, x.bin), x.k)
    assert len(seen) > 10 and sum(seen) == 500
    sums = {(r.point_id, r.bin): r.value for r in want.collect()}
    got = {(int(i), int(b)): k[i, b] * 100 / k[i].sum() for i, b in np.argwhere(k)}
    assert got.keys() == sums.keys() and all(np.isclose(v, sums[x]) for x, v in got.items())


def test_pair_features_are_made_where_points_meet(spark, crowd):
    """The features equal those of the expressions, and no neighbour table is joined with the points again."""
    from pointloom.operators import features, neighbors

    df = catalog.cloud_e(spark, crowd, "point_id", *features._POINT)
    out = catalog.QUERIES["a17_pair_features"](spark, crowd)
    assert plan(out).count("mapInArrow") + plan(out).count("MapInArrow") > 0 and "a_nx" not in plan(out)
    edges = neighbors.radius_search(neighbors.as_queries(df), df, 0.8).where("qid < point_id").select("qid", neighbors.F.col("point_id").alias("j"))
    want = features.pair_features(features._oriented(edges, df, "qid", "j")).toPandas().sort_values(["qid", "j"])
    got = out.toPandas().sort_values(["qid", "j"])
    columns = ["qid", "j", "f_theta", "f_phi", "f_alpha", "f_dist"]
    assert len(got) == len(want) and np.allclose(got[columns], want[columns], atol=2e-6)


def test_fpfh_writes_no_pairs(spark, crowd, monkeypatch):
    """Histograms equal those made from a table of all neighbours; copies of a place weigh nothing in each other's sums."""
    from pointloom.operators import features, neighbors

    df = catalog.cloud_e(spark, crowd, "point_id", *features._POINT)
    df = df.unionByName(df.where("point_id < 20").withColumn("point_id", df.point_id + 5_000)).cache()
    want = features.fpfh(df, 0.8, neighbors.radius_search(neighbors.as_queries(df), df, 0.8))
    names = written(monkeypatch, features)
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    same_histograms(features.fpfh(df, 0.8), want)
    assert names == ["spfh"]


def test_colored_gicp_seeks_its_matches_once_and_broadcasts_no_cloud(spark, crowd, monkeypatch):
    """Its rows are those of both parts; the matches are one search, and what rounds of a search found is read without joins."""
    from pointloom.operators import neighbors
    from pointloom.plans import factors

    monkeypatch.setattr(neighbors, "CROWD", 8)
    df = catalog.cloud_e(spark, crowd).withColumn("gx", neighbors.F.lit(0.5)).withColumn("gy", neighbors.F.lit(-0.25)).withColumn("gz", neighbors.F.lit(1.0))
    source, target = df.where("frame_id >= 5"), df.where("frame_id < 5")
    shape = factors.gicp(source, target, catalog.POSE, 1.1).drop("tgt_id").toPandas()
    color = factors.color_consistency(source, target, catalog.POSE, 1.1, weight=0.25).drop("tgt_id").toPandas()
    shape[list(factors.WEIGHT)] *= 0.75
    searches, plain = [], factors.nearest
    monkeypatch.setattr(factors, "nearest", lambda *a, **k: searches.append(1) or plain(*a, **k))
    got = factors.colored_gicp(source, target, catalog.POSE, 1.1).toPandas()
    assert len(searches) == 1
    want = pd.concat([shape, color])[got.columns].to_numpy(float)
    key = lambda x: x[np.lexsort(np.round(x, 6).T)]
    assert len(got) == len(want) and np.allclose(key(got.to_numpy(float)), key(want), atol=1e-9)
    assert "Join" not in plan(neighbors.knn(neighbors.as_queries(source), target, 3))
    assert "SortMergeJoin [tgt_id" in (joined := plan(factors._matched(source, target, catalog.POSE, 1.1, ()))) and "SortMergeJoin [src_id" in joined


def test_batches_of_matches_are_sought_by_smaller_cells(spark, crowd, monkeypatch):
    """Matches within each factor's own target equal brute force, copies of a place included; no round looks at all pairs of crowded cells."""
    from pointloom.operators import neighbors
    from pointloom.plans.matching import MatchedGroup

    monkeypatch.setattr(neighbors, "CROWD", 8)
    monkeypatch.setattr(neighbors, "DENSE", 2)
    seen, plain = [], neighbors.cell_pairs

    def cell_pairs(queries, points, cell, *more):
        seen.append((queries.count(), cell))
        return plain(queries, points, cell, *more)

    monkeypatch.setattr(neighbors, "cell_pairs", cell_pairs)
    df = catalog.cloud_e(spark, crowd, "point_id", "x", "y", "z").withColumn("factor_id", neighbors.F.col("point_id") % 3)
    copies = df.where("point_id < 30").withColumn("point_id", df.point_id + 3_000)
    target = df.where("point_id < 900").unionByName(copies).unionByName(copies.withColumn("point_id", neighbors.F.col("point_id") + 3_000))
    group = MatchedGroup("icp", df.where("point_id >= 600"), target)
    motions = {k: catalog.POSES[k] for k in range(3)}
    got = group.rows(motions).toPandas()
    q, p = df.where("point_id >= 600").toPandas(), target.toPandas().sort_values("point_id")
    want = set()
    for k in range(3):
        a, b = q[q.factor_id == k], p[p.factor_id == k]
        at = a[["x", "y", "z"]].to_numpy() + np.array(catalog.POSES[k])[:, 3]
        d2 = ((at[:, None] - b[["x", "y", "z"]].to_numpy()[None]) ** 2).sum(2)
        want |= {(k, i, b.point_id.iloc[row.argmin()]) for i, row in zip(a.point_id, d2, strict=True) if row.min() < 1.0}
    assert len(got) == len(want) and set(zip(got.factor_id, got.src_id, got.tgt_id, strict=True)) == want
    assert seen[0][1] < 1.0 and seen[-1][0] < len(q)
    group.release()


@pytest.mark.parametrize("every", [1, 40])
def test_feature_search_ships_a_query_once_for_each_block_however_many_partitions(spark, monkeypatch, every):
    """Where nothing can be pruned a query visits all of 200 partitions, but these are few blocks; results equal brute force."""
    from pointloom.operators import metric

    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (4_000, 16)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, f array<float>")
    shipped, plain = [], metric._answers
    monkeypatch.setattr(metric, "_answers", lambda index, visits, k: shipped.append(visits.count()) or plain(index, visits, k))
    monkeypatch.setattr(metric, "STRIP", 7)
    index = metric.build_index(df, rows_a_pivot=20)
    assert len(index.pivots) == 200 and dict(index.rows.dtypes)["f"] == "array<float>"
    got = metric.search(index, df.where(f"point_id % {every} = 0").withColumnRenamed("point_id", "qid"), 4).toPandas()
    d2 = ((x[::every, None].astype(float) - x[None].astype(float)) ** 2).sum(2)
    want = {(every * q, p, r + 1) for q, row in enumerate(d2) for r, p in enumerate(np.lexsort((np.arange(len(x)), row))[:4])}
    assert set(zip(got.qid, got.point_id, got["rank"], strict=True)) == want
    assert sum(shipped) < len(d2) * (10 if every == 1 else 30)
    index.release()


def test_a_chain_with_loops_is_eliminated_by_ranges_of_keys(spark, monkeypatch):
    """Keys of either sign with gaps: the solution equals numpy's, and two rounds leave what many did before."""
    from pointloom.plans import elimination

    names = written(monkeypatch, elimination)
    monkeypatch.setattr(elimination, "RANGE", 60)
    rng, n = np.random.default_rng(6), 900
    h = np.zeros((2 * n, 2 * n))
    for a, b in [(0, 0), *[(k, k + 1) for k in range(n - 1)], *[(k, k + 10) for k in range(0, n - 10, 10)]]:
        j = np.zeros((2, 2 * n))
        j[:, 2 * a : 2 * a + 2] = rng.normal(0, 1, (2, 2))
        j[:, 2 * b : 2 * b + 2] += np.eye(2) * 2
        h += j.T @ j
    h += np.eye(2 * n) * 0.1
    x = rng.normal(0, 1, 2 * n)
    key = lambda k: (k - 300) * 3
    tiles = h.reshape(n, 2, n, 2).transpose(0, 2, 1, 3)
    blocks = spark.createDataFrame([(key(int(i)), key(int(j)), tiles[i, j].ravel().tolist()) for i, j in np.argwhere(np.abs(tiles).sum((2, 3)) > 0)], "i long, j long, h array<double>")
    side = spark.createDataFrame([(key(i), b.tolist()) for i, b in enumerate((h @ x).reshape(n, 2))], "i long, b array<double>")
    got = elimination.solve(blocks, side, 2, last=60).toPandas().sort_values("i")
    assert got.i.tolist() == [key(i) for i in range(n)] and np.allclose(np.stack(got.x.to_list()).ravel(), x, atol=1e-8)
    assert 1 <= names.count("eliminated") <= 3


def test_a_search_of_the_users_own_looks_at_smaller_cells_first(spark, crowd, monkeypatch):
    """u_custom_search, where voxels are crowded, gives the same as with one join of all pairs of those voxels."""
    from pointloom.operators import neighbors

    want = catalog.QUERIES["u_custom_search"](spark, crowd).collect()
    monkeypatch.setattr(neighbors, "CROWD", 8)
    monkeypatch.setattr(neighbors, "DENSE", 2)
    seen, plain = [], neighbors.cell_pairs
    monkeypatch.setattr(neighbors, "cell_pairs", lambda queries, points, cell, *more: seen.append(cell) or plain(queries, points, cell, *more))
    assert catalog.QUERIES["u_custom_search"](spark, crowd).collect() == want and want[0].n_inliers > 0
    assert len(seen) > 1 and seen[0] < catalog.FINE


def test_searches_within_voxels_ask_copies_of_a_place_once(spark, crowd, tmp_path, monkeypatch):
    """30 copies of 100 points: results equal brute force, and no round asks, or looks at, more rows than there are places for the wanted neighbours."""
    from pointloom.operators import neighbors

    few = pd.read_parquet(f"{crowd}/embeddings.parquet").head(100)
    copies = pd.concat([few.assign(vec_id=few.vec_id + 1_000 * i) for i in range(30)])
    copies.to_parquet(tmp_path / "embeddings.parquet")
    pdf = cloud(spark, tmp_path)
    xyz, intensity, ids = pdf[["x", "y", "z"]].to_numpy(), pdf.intensity.to_numpy(), pdf.point_id.to_numpy()
    want = catalog.QUERIES["u_custom_search"](spark, str(tmp_path)).collect()
    monkeypatch.setattr(neighbors, "CROWD", 8)
    monkeypatch.setattr(neighbors, "DENSE", 2)
    seen, plain = [], neighbors.cell_pairs

    def cell_pairs(queries, points, cell, *more):
        seen.append((queries.count(), points.count()))
        return plain(queries, points, cell, *more)

    monkeypatch.setattr(neighbors, "cell_pairs", cell_pairs)
    assert catalog.QUERIES["u_custom_search"](spark, str(tmp_path)).collect() == want and want[0].n_inliers > 0
    assert seen and max(max(s) for s in seen) <= 100
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    cells = np.abs(np.floor(xyz)[:, None] - np.floor(xyz)[None])
    whole = d2 + (intensity[:, None] - 2 * intensity[None]) ** 2
    for name, (d, ok, k) in {"j6_knn_voxel": (d2, cells.sum(2) <= 1, 5), "j5_knn_xyzi": (whole, whole < 1.0, 4)}.items():
        seen.clear()
        got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()
        order = [(q, np.flatnonzero(ok[q])) for q in range(len(ids))]
        assert set(zip(got.qid, got.point_id, got["rank"], strict=True)) == {(ids[q], ids[p], r + 1) for q, near in order for r, p in enumerate(near[np.lexsort((ids[near], d[q, near]))][:k])}, name
        assert seen and max(s[0] for s in seen) <= 100 and max(s[1] for s in seen) <= 100 * k, name


def test_queries_that_are_replicated_to_cells_are_not_broadcast(spark):
    from pointloom.operators.neighbors import cell_pairs

    q = spark.range(3).selectExpr("id AS qid", "0.1D * id AS qx", "0.0D AS qy", "0.0D AS qz")
    p = spark.range(40).selectExpr("id AS point_id", "0.1D * id AS x", "0.0D AS y", "0.0D AS z")
    pairs = cell_pairs(q, p, 1.0)
    assert pairs.count() == 60 and "Broadcast" not in plan(pairs)


def test_windows_have_the_systems_of_their_factors(monkeypatch):
    """Links both ways and twice, priors and quadratics of several keys, dense and as stacks of blocks: as factor by factor."""
    from pointloom.functions import lie
    from pointloom.plans import optimize, sparse
    from pointloom.plans.optimize import BetweenFactor, Graph, MarginalFactor, PriorFactor, Window, each_linear
    from pointloom.plans.sparse import System

    rng = np.random.default_rng(11)
    pose = lambda: lie.pose(lie.so3_exp(rng.normal(0, 0.3, 3)), rng.normal(0, 1.2, 3))
    values = {3 * k: pose() for k in range(14)}
    root = rng.normal(size=(18, 18))
    factors = [BetweenFactor(3 * a, 3 * b, pose(), 1.0 + a) for a, b in [*((k, k + 1) for k in range(13)), (9, 2), (2, 9), (0, 5), (0, 7)]]
    factors += [PriorFactor(0, pose(), 3.0), PriorFactor(6, pose()), MarginalFactor((12, 3, 30), {k: pose() for k in (12, 3, 30)}, root @ root.T, rng.normal(size=18))]
    want = System(dict.fromkeys(values, 6))
    for one in each_linear(factors, values):
        want.add(*one)
    step = want.solve(0.1)
    for small, many in ((96, 2_048), (0, 8)):
        monkeypatch.setattr(optimize, "SMALL", small)
        monkeypatch.setattr(optimize, "MANY", many)
        monkeypatch.setattr(sparse, "MANY", many)
        monkeypatch.setattr(sparse, "LAST", 3)
        window = Window.of(factors, values)
        got = window.linearize(values)
        assert np.allclose(got.dense(), want.dense(), rtol=1e-9) and np.allclose(got.vector(got.b), want.vector(want.b), rtol=1e-9)
        assert np.isclose(got.error, want.error) and np.isclose(window.error(values), sum(f.linearize(values)[0] for f in factors))
        assert all(np.allclose(got.solve(0.1)[k], step[k], rtol=1e-6, atol=1e-9) for k in values)
        assert np.isclose(got.model(step), want.model(step)) and np.isclose(Graph(factors).linearize(values).error, want.error)
        with pytest.raises(np.linalg.LinAlgError):
            Window.of(factors[:13], values).linearize(values).solve()


def test_a_long_chain_is_solved_in_few_calls(monkeypatch):
    from pointloom.plans.optimize import Graph, dogleg

    poses, factors = loop(3_000)
    seen, root = [], np.linalg.cholesky
    monkeypatch.setattr(np.linalg, "cholesky", lambda x: seen.append(len(x)) or root(x))
    out, status = dogleg(Graph(factors), {k: poses[max(k - 1, 0)] for k in range(len(poses))}, radius=10.0)
    assert max(np.abs(out[k] - p).max() for k, p in enumerate(poses)) < 1e-6
    assert len(seen) < 40 * status.iterations  # one call a key would be 3,000


def test_an_update_of_a_window_takes_few_calls(monkeypatch):
    from pointloom.functions import lie
    from pointloom.plans.optimize import FixedLagSmoother, LMParams

    poses, factors = loop(60)
    seen, log, lag = [], lie.se3_log, FixedLagSmoother(4.5)
    monkeypatch.setattr(lie, "se3_log", lambda m: seen.append(1) or log(m))
    for k, factor in enumerate(factors):
        out = lag.update([factor], {k: poses[max(k - 1, 0)]}, {k: float(k)}, LMParams(absolute_error=1e-12, relative_error=1e-12))
    assert max(np.abs(out[k] - poses[k]).max() for k in out) < 1e-6
    assert len(seen) < 10 * len(factors)


def test_regions_write_no_more_links_than_points_round_blocks(spark, crowd, monkeypatch):
    """Crowded cells, divided among blocks: the regions of all links, and tables in proportion to the points and not to the pairs."""
    from pointloom.plans import segmentation

    df = catalog.cloud_e(spark, crowd, "point_id", "x", "y", "z", "nx", "ny", "nz")
    pdf = df.orderBy("point_id").toPandas()
    xyz, normal = pdf[["x", "y", "z"]].to_numpy(), pdf[["nx", "ny", "nz"]].to_numpy()
    for block, params in ((1 << 16, segmentation.RegionParams(1.5, np.radians(60))), (7, segmentation.RegionParams(0.4, np.radians(25)))):
        monkeypatch.setattr(segmentation, "REGION_BLOCK", block)
        link = (((xyz[:, None] - xyz[None]) ** 2).sum(2) < params.distance**2) & (normal @ normal.T >= np.cos(params.angle))
        label = np.arange(len(xyz))
        while (lower := np.where(link, label[None], len(label)).min(1)).tolist() != label.tolist():
            label = np.minimum(label, lower)
        got = {r.point_id: (r.region, r.size) for r in segmentation.all_regions(df, params).collect()}
        assert got == {i: (x, (label == x).sum()) for i, x in enumerate(label.tolist())}
        grown = {r.point_id for r in segmentation.region_growing(df, (0.0, 0.0, 0.0), params, dilate=False).collect()}
        seed = (xyz**2).sum(1).argmin()
        assert grown == set(np.flatnonzero(label == label[seed]).tolist())
        if block > 7:
            links = segmentation.region_links(df, params).count()
            assert links < 2 * 14 * len(xyz) < link.sum() / 2
