"""Feature search, regions, occupancy blocks, map state and streams against brute force, on skewed and awkward inputs."""

import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom import scratch
from pointloom.operators import metric, occupancy
from pointloom.plans import segmentation
from pointloom.schema import XYZ
from pointloom.streaming import keyed
from pointloom.streaming.maps import CovarianceMap, StreamedVoxelMap, VoxelPoints, apply_batch, map_stream
from tests.test_geometry import cloud


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "point_id long, f array<double>")


def nearest_by_brute_force(queries, points, k, limit=np.inf):
    out = {}
    for i, q in enumerate(queries):
        d2 = ((points - q) ** 2).sum(1)
        order = np.lexsort((np.arange(len(points)), d2))
        out[i] = [(int(j), round(float(d2[j]), 9)) for j in order[:k] if d2[j] < limit]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.point_id, round(r.d2, 9)))
    return out


@pytest.mark.parametrize(("k", "limit"), [(1, None), (5, None), (40, None), (5, 0.4)])
def test_feature_search_equals_brute_force(spark, monkeypatch, k, limit):
    """Clusters, repeated vectors, ties at the k-th place, one partition with a third of all rows; rows and visitors of a partition divided."""
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 3, (12, 8))
    x = np.concatenate([centres[i % 12] + rng.normal(0, 0.2, 8) for i in range(600)]).reshape(-1, 8)
    x = np.concatenate([x, np.tile(centres[0], (300, 1)), np.round(x[:60], 1), np.zeros((3, 8))])
    monkeypatch.setattr(metric, "CROWD", 150)
    index = metric.build_index(vectors(spark, x), rows_a_pivot=40)
    assert len(index.pivots) == len(x) // 40 and index.sizes.sum() == len(x)
    q = np.concatenate([x[::9], rng.normal(0, 4, (20, 8)), [x[700]]])
    queries = vectors(spark, q).withColumnRenamed("point_id", "qid")
    got = answers(metric.search(index, queries, k, limit))
    want = nearest_by_brute_force(q, x, k, np.inf if limit is None else limit)
    assert got == {i: v for i, v in want.items() if v}


def test_feature_search_prunes(spark, monkeypatch):
    """In clustered data a query visits few partitions: far fewer rows are shipped than blocks against blocks would ship."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (64, 64))
    x = centres[rng.integers(0, 64, 6400)] + rng.normal(0, 0.02, (6400, 64))
    seen = []
    answer = metric._answers
    monkeypatch.setattr(metric, "_answers", lambda index, visits, k: seen.append(visits.count()) or answer(index, visits, k))
    index = metric.build_index(vectors(spark, x), rows_a_pivot=100)
    q = x[::100]
    got = answers(metric.search(index, vectors(spark, q).withColumnRenamed("point_id", "qid"), 3))
    assert got == nearest_by_brute_force(q, x, 3)
    assert len(index.pivots) == 64 and sum(seen) < len(q) * 8


def test_feature_search_on_awkward_tables(spark):
    few = vectors(spark, np.eye(3))
    none = few.limit(0)
    query = lambda df: df.withColumnRenamed("point_id", "qid")
    assert metric.knn_feature(query(few), none, 2).count() == 0 and metric.knn_feature(query(none), few, 2).count() == 0
    assert metric.knn_feature(query(few), few, 2, 0.5).count() == 3
    missing = few.unionByName(spark.createDataFrame([(9, None)], few.schema))
    assert metric.knn_feature(query(missing), missing, 9).count() == 9  # rows without a vector take no part
    with pytest.raises(Exception, match="one length"):
        metric.knn_feature(query(few), few.unionByName(spark.createDataFrame([(9, [1.0])], few.schema)), 1).count()
    pairs = metric.reciprocal(few, vectors(spark, np.array([[1, 0, 0], [0, 0.9, 0], [0, 0.8, 0]])))
    assert sorted(map(tuple, pairs.collect())) == [(0, 0), (1, 1)] or (2, 0) not in map(tuple, pairs.collect())


def test_searches_need_nothing_that_another_module_imports():
    """A worker that has not loaded pandas, which brings pyarrow.compute with it, runs them too."""
    code = "import sys; from pointloom.operators import metric, neighbors; assert 'pandas' not in sys.modules and 'pyarrow.compute' in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("order", ["along", "random"])
def test_regions_of_a_long_chain(spark, order, monkeypatch):
    """A chain of 100,000 points, another of two and a lone one, in fewer than 20 rounds."""
    n = 100_000
    names = np.arange(n) if order == "along" else np.random.default_rng(1).permutation(n)
    ids = spark.createDataFrame([(int(i), int(j)) for i, j in zip(names, names[1:], strict=False)] + [(n + 5, n + 9)], "a long, b long")
    edges = ids.selectExpr("a AS qid", "b AS point_id").unionByName(ids.selectExpr("b AS qid", "a AS point_id"))
    nodes = spark.range(n).selectExpr("id AS point_id").unionByName(spark.createDataFrame([(n + 5,), (n + 9,), (n + 11,)], "point_id long"))
    rounds = []
    cut = segmentation.cut
    monkeypatch.setattr(segmentation, "cut", lambda df, name="cut": rounds.append(name) or cut(df, name))
    got = segmentation.components(nodes, edges)
    assert sorted(map(tuple, got.groupBy("region").count().collect())) == [(0, n), (n + 5, 2), (n + 11, 1)]
    assert rounds.count("lower") < 20


def test_regions_equal_union_find(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (220, 2)) if a != b] + [(0, i) for i in range(300, 340)]
    parent = list(range(400))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(links + [(b, a) for a, b in links], "qid long, point_id long")
    got = segmentation.components(spark.range(400).selectExpr("id AS point_id"), edges)
    assert {r.point_id: r.region for r in got.collect()} == {i: find(i) for i in range(400)}


def test_seeds_find_their_regions(spark):
    rng = np.random.default_rng(7)
    xyz = np.concatenate([rng.uniform(0, 1, (60, 3)), rng.uniform(0, 1, (60, 3)) + 9])
    df = cloud(spark, xyz, nx=np.zeros(120), ny=np.zeros(120), nz=np.ones(120))
    p = segmentation.RegionParams(distance=0.8)
    regions = segmentation.all_regions(df, p)
    seeds = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 10.0, 10.0, 10.0)], "seed_id long, sx double, sy double, sz double")
    named = {r.seed_id: r.region for r in segmentation.seed_regions(df, regions, seeds).collect()}
    for seed, at in ((0, (0.0, 0.0, 0.0)), (1, (10.0, 10.0, 10.0))):
        grown = {r.point_id for r in segmentation.region_growing(df, at, p, dilate=False).collect()}
        assert grown == {r.point_id for r in regions.where(F.col("region") == named[seed]).collect()}


def test_occupancy_blocks(spark):
    """Cells on both sides of the origin and of block borders, repeated points, points that are not finite; empty grids."""
    rng = np.random.default_rng(8)
    xyz = np.concatenate([rng.uniform(-9, 9, (700, 3)), [[-0.5, 7.999, 8.0]] * 3, [[np.nan, 0, 0], [0, np.inf, 0]], [[7.5, 7.5, 7.5], [-7.5, -8.5, -0.1]]])
    cells = {tuple(np.floor(p).astype(int)) for p in xyz if np.isfinite(p).all()}
    df = cloud(spark, xyz)
    grid = occupancy.occupancy_blocks(df, 1.0)
    found = occupancy.count_cells(grid).head()
    assert (found.cells, found.blocks) == (len(cells), len({tuple(v >> 3 for v in c) for c in cells}))
    a, b = df.where("point_id < 400"), df.where("point_id >= 300")
    cell = lambda rows: {tuple(np.floor(xyz[r.point_id]).astype(int)) for r in rows.collect() if np.isfinite(xyz[r.point_id]).all()}
    ga, gb = occupancy.occupancy_blocks(a, 1.0), occupancy.occupancy_blocks(b, 1.0)
    assert occupancy.count_cells(occupancy.merge_blocks(ga, gb)).head().cells == len(cells)
    assert occupancy.common_cells(ga, gb).head().cells == len(cell(a) & cell(b))
    hits = {r.point_id: r.hit for r in occupancy.lies_in(df, ga, 1.0).collect()}
    assert hits == {i: tuple(np.floor(p).astype(int)) in cell(a) for i, p in enumerate(xyz) if np.isfinite(p).all()}
    none = occupancy.occupancy_blocks(df.limit(0), 1.0)
    assert occupancy.count_cells(none).head().cells == 0 == occupancy.common_cells(ga, none).head().cells


# --- maps


def fold(batches, least, most, resolution=1.0):
    """The points of a voxel one by one, batch by batch."""
    kept = {}
    for batch in batches:
        for i, p in sorted(batch):
            here = kept.setdefault(tuple(np.floor(np.array(p) / resolution).astype(int)), [])
            if len(here) < most and all(((np.array(p) - np.array(o)) ** 2).sum() >= least**2 for _, o in here):
                here.append((i, p))
    return {i for here in kept.values() for i, _ in here}


def points(spark, batch):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in batch], "point_id long, x double, y double, z double")


@pytest.mark.parametrize(("least", "most"), [(0.1, 20), (0.3, 4), (0.0, 7)])
def test_voxel_points_equal_the_fold(spark, least, most):
    """One voxel gets two thirds of all points, in frames of 100 rows."""
    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.uniform(0, 1, (1200, 3)), rng.uniform(-2, 4, (600, 3))])
    batches = [[(i, xyz[i]) for i in range(k, 1800, 3)] for k in range(3)]
    target = VoxelPoints(spark, 1.0, least, most)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for batch in batches:
            target.insert(points(spark, batch))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.point_id for r in target.state.collect()} == fold(batches, least, most)


def folders(path):
    return sorted(f"{d}/{n}" for d, names, _ in os.walk(path) for n in names if n.startswith("part="))


def test_replaced_parts_are_deleted(spark, tmp_path, monkeypatch):
    """Only parts in use lie on disk, whether states are saved or not; a batch near one place leaves the other parts' files alone."""
    rng = np.random.default_rng(10)
    batches = [[(k * 1000 + i, p) for i, p in enumerate(rng.uniform(0, 60, (300, 3)))] for k in range(3)] + [[(5000, (0.5, 0.5, 0.5))]]
    make = {"points": lambda: VoxelPoints(spark, 1.0), "means": lambda: StreamedVoxelMap(1.0), "cov": lambda: CovarianceMap(VoxelPoints(spark, 1.0))}
    cols = ["c00", "c01", "c02", "c11", "c12", "c22"]
    full = lambda batch: points(spark, batch).select("*", *[F.lit(0.0).alias(c) for c in cols])
    for name, new in make.items():
        for saved in (False, True):
            here = tmp_path / f"{name}-{saved}"
            monkeypatch.setattr(scratch, "root", lambda _, here=here: f"file://{here}")
            target = new()
            for k, batch in enumerate(batches):
                kept = {k: v for p in target._parts() for k, v in p.tables.items()}
                df = full(batch) if name == "means" else points(spark, batch)
                if saved:
                    target = new()
                    assert apply_batch(target, df, k, f"file://{tmp_path}/{name}")
                else:
                    target.insert(df)
            used = {"/" + v.removeprefix("file:").lstrip("/") for p in target._parts() for v in p.tables.values()}
            mine = {f for f in folders(here) if any(f"/{p.name}-" in f for p in target._parts())}
            if name != "cov":
                assert len([k for k, v in target._parts()[0].tables.items() if kept.get(k) != v]) == 1
            assert used <= mine and (saved or mine == used)
            if saved:
                again = new()
                assert not apply_batch(again, df, len(batches) - 1, f"file://{tmp_path}/{name}")
                assert sorted(map(str, again.state.collect())) == sorted(map(str, target.state.collect()))
                assert len([x for x in os.listdir(tmp_path / name)]) == 1
            else:
                want = sorted(map(str, target.state.collect()))
                for p in target._parts():
                    p.replaced |= set(p.tables.values())
                    p.tables = {}
                    p.prune(spark)
        assert sorted(map(str, target.state.collect())) == want  # saved batch by batch by new objects, or all by one


def test_covariances_by_parts_equal_those_of_the_whole(spark, monkeypatch):
    """Batches that move along: what is estimated by parts with their surroundings equals what one part holding everything gives."""
    from pointloom.streaming import maps

    rng = np.random.default_rng(11)
    batches = [[(k * 1000 + i, p) for i, p in enumerate(rng.uniform(0, 4, (150, 3)) + [10 * k, 0, 0])] for k in range(4)]
    batches.append([(9000 + i, p) for i, p in enumerate(rng.uniform(0, 4, (60, 3)))])
    results = []
    for parts in (64, 1):
        monkeypatch.setattr(maps, "PARTS", parts)
        target = CovarianceMap(VoxelPoints(spark, 1.0, 0.05, 50, horizon=3, clear_cycle=5), base_age=2, forget=3, warmup=2)
        for batch in batches:
            before = dict(target.parts.tables)
            target.insert(points(spark, batch))
        results.append({r.point_id: (r.valid, r.birth, *[None if r[c] is None else round(r[c], 9) for c in ("c00", "c01", "c22")]) for r in target.state.collect()})
        assert before
    assert results[0] == results[1] and sum(v[0] for v in results[0].values()) > 100


def test_streams_of_all_maps(spark, tmp_path):
    """A restarted query with an object that was just made goes on from the saved state."""
    rng = np.random.default_rng(12)
    batches = [[(k * 1000 + i, p) for i, p in enumerate(rng.uniform(0, 3, (150, 3)))] for k in range(2)]
    for name, new in (("points", lambda: VoxelPoints(spark, 1.0)), ("cov", lambda: CovarianceMap(VoxelPoints(spark, 1.0)))):
        plain = new()
        for k, batch in enumerate(batches):
            df = points(spark, batch)
            plain.insert(df)
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            target = new()
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "in"))
            q = map_stream(stream, target, f"file://{tmp_path}/{name}/check").start()
            q.processAllAvailable()
            q.stop()
            assert q.exception() is None
        assert sorted(map(str, target.state.collect())) == sorted(map(str, plain.state.collect()))


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k) for k in keyed.PROVIDER}
    for k, v in keyed.PROVIDER.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_keyed_state_equals_the_fold(spark, store, tmp_path):
    """Stopped and started again half way; one voxel gets most of the points. Voxels that nobody touches go."""
    rng = np.random.default_rng(13)
    xyz = np.concatenate([rng.uniform(0, 1, (300, 3)), rng.uniform(0, 2, (150, 3))])
    batches = [[(i, xyz[i]) for i in range(k, 450, 3)] for k in range(3)]
    batches.append([(1000, (50.5, 50.5, 50.5))])
    folder, check = str(tmp_path / "in"), str(tmp_path / "check")
    changes = []

    def run():
        stream = spark.readStream.schema("point_id long, x double, y double, z double, stamp timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
        out = keyed.voxel_state_stream(stream, 1.0, least_distance=0.15, most_points=12, horizon_ms=10_000)
        q = out.writeStream.foreachBatch(lambda df, _: changes.extend(df.collect())).option("checkpointLocation", check).start()
        q.processAllAvailable()
        q.stop()
        assert q.exception() is None

    for k, batch in enumerate(batches[:3]):
        points(spark, batch).withColumn("stamp", F.timestamp_seconds(F.lit(100 + k))).coalesce(1).write.mode("append").parquet(folder)
        if k != 1:
            run()  # two batches wait for the second run
    want = fold(batches[:3], 0.15, 12)
    assert {r.point_id for r in keyed.stored_points(spark, check).collect()} == want == {r.point_id for r in changes if r.event == "kept"}
    assert sum(r.event == "kept" for r in changes) == len(want)
    points(spark, batches[3]).withColumn("stamp", F.timestamp_seconds(F.lit(200))).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert {r.point_id for r in keyed.stored_points(spark, check).collect()} == {1000}
    assert sum(r.event == "gone" for r in changes) == len({tuple(np.floor(xyz[i]).astype(int)) for i in want})
    assert set(XYZ) <= set(keyed.stored_points(spark, check).columns)


# --- systems, rays, alignment


def grid_system(n, size, seed, loops):
    """A chain with loops: H (dense, for few keys), its blocks and the right side of a known solution."""
    rng = np.random.default_rng(seed)
    links = [(k, k + 1) for k in range(n - 1)] + [tuple(sorted(map(int, p))) for p in rng.integers(0, n, (loops, 2)) if p[0] != p[1]]
    blocks = {}

    def add(i, j, h):
        blocks[i, j] = blocks.get((i, j), 0) + h

    def weight():
        a = rng.normal(0, 1, (size, size))
        return a @ a.T + np.eye(size)

    add(0, 0, weight())
    for a, b in links:
        h = weight()
        for i, j, v in ((a, a, h), (b, b, h), (a, b, -h), (b, a, -h)):
            add(i, j, v)
    x = rng.normal(0, 1, (n, size))
    b = np.zeros((n, size))
    for (i, j), h in blocks.items():
        b[i] += h @ x[j]
    return blocks, b, x


@pytest.mark.parametrize(("n", "size", "loops", "last"), [(1, 6, 0, 200), (20, 3, 4, 1), (400, 6, 20, 60), (40, 2, 40, 6)])
def test_systems_are_solved_by_rounds(spark, n, size, loops, last):
    from pointloom.plans import elimination

    blocks, b, x = grid_system(n, size, n, loops)
    # keys far apart and below zero: they are names, not places
    table = spark.createDataFrame([(i * 7 - 50, j * 7 - 50, h.ravel().tolist()) for (i, j), h in blocks.items()], "i long, j long, h array<double>")
    side = spark.createDataFrame([(i * 7 - 50, v.tolist()) for i, v in enumerate(b) if np.abs(v).max() > 0], "i long, b array<double>")
    got = elimination.solve(table, side, size, last)
    assert elimination.residual(table, side, got, size) < 1e-8
    found = {r.i: r.x for r in got.collect()}
    assert len(found) == n and max(np.abs(np.array(found[i * 7 - 50]) - x[i]).max() for i in range(n)) < 1e-6


def test_systems_from_entries(spark):
    """Entries of one place add up; missing ones are zero; keys without a side have none."""
    from pointloom.plans import elimination

    entries = [(0, 0, 0, 0, 1.0), (0, 0, 0, 0, 1.0), (0, 0, 1, 1, 4.0), (5, 5, 0, 0, 1.0), (5, 5, 1, 1, 1.0)]
    blocks = elimination.block_table(spark.createDataFrame(entries, "i long, j long, row int, col int, value double"), 2)
    side = elimination.side_table(spark.createDataFrame([(0, 0, 2.0), (0, 1, 8.0)], "i long, row int, value double"), 2)
    assert {r.i: list(r.x) for r in elimination.solve(blocks, side, 2).collect()} == {0: [1.0, 2.0], 5: [0.0, 0.0]}


def test_long_rays(spark):
    """A ray through 9,000 voxels, and two of one name."""
    from pointloom.operators import rows

    rays = spark.createDataFrame([(0, 0.5, 0.5, 0.5, 3000.5, -2999.5, 3000.4), (1, 0.5, 0.5, 0.5, 2.5, 0.5, 0.5), (1, 0.5, 0.5, 0.5, 0.5, 1.5, 0.5), (2, 0.5, 0.5, 0.5, 0.6, 0.5, 0.5)], "ray_id long, sx double, sy double, sz double, ex double, ey double, ez double")
    got = [tuple(r) for r in rows.raycast(rays, 1.0).orderBy("ray_id", "step").collect()]
    long = [r for r in got if r[0] == 0]
    assert len(long) == 9000 and long[0][2:] == (0, 0, 0)
    steps = np.abs(np.diff(np.array([r[2:] for r in long]), axis=0))
    assert (steps.sum(1) == 1).all()
    assert sorted(r[1:] for r in got if r[0] == 1) == [(0, 0, 0, 0), (0, 0, 0, 0), (1, 1, 0, 0)]


def test_poses_in_passes(spark, monkeypatch):
    from pointloom.operators import voxels

    rng = np.random.default_rng(3)
    df = cloud(spark, rng.uniform(0, 5, (80, 3)))
    poses = {k: [[1.0, 0, 0, 0.1 * k], [0, 1.0, 0, 0], [0, 0, 1.0, 0]] for k in range(7)}
    maps = spark.createDataFrame([(k, int(v.vkey)) for k in range(7) for v in voxels.with_voxel(df.where(f"point_id % 7 = {k}"), 0.5).select("vkey").collect()], "map_id long, vkey long")
    whole = voxels.overlap_multi(df, maps, poses, 0.5).head()
    merged = sorted(map(str, voxels.merge_frames(df.withColumn("frame_id", F.col("point_id") % 7), poses, 0.5).collect()))
    monkeypatch.setattr(voxels, "POSES_A_PASS", 2)
    monkeypatch.setattr(voxels, "BROADCAST_POSES", 0)
    assert voxels.overlap_multi(df, maps, poses, 0.5).head() == whole and voxels.overlap_multi(df, maps, {}, 0.5).head().hits == 0
    again = sorted(map(str, voxels.merge_frames(df.withColumn("frame_id", F.col("point_id") % 7), poses, 0.5).collect()))
    assert len(again) == len(merged)


def test_nearest_stamps():
    from pointloom.plans.trajectory import _nearest

    rng = np.random.default_rng(5)
    for n in (1, 2, 50):
        stamps = np.round(rng.uniform(0, 10, n), 1)
        times = np.concatenate([rng.uniform(-1, 11, 40), stamps, stamps + 0.05])
        near, want = _nearest(stamps, times), np.abs(stamps[None, :] - times[:, None]).argmin(1)
        assert np.allclose(np.abs(stamps[near] - times), np.abs(stamps[want] - times))


# --- correspondences kept, all factors in one plan


def two_frames(spark, n=150):
    """Two factors' sources and targets, with covariances and normals."""
    rng = np.random.default_rng(21)
    cov = {c: np.full(2 * n, 0.02 if c in ("c00", "c11", "c22") else 0.001) for c in ("c00", "c01", "c02", "c11", "c12", "c22")}
    normals = rng.normal(0, 1, (2 * n, 3))
    normals /= np.linalg.norm(normals, axis=1)[:, None]
    extra = cov | {c: normals[:, i] for i, c in enumerate(("nx", "ny", "nz"))}
    return cloud(spark, rng.uniform(0, 4, (2 * n, 3)), **extra).withColumn("factor_id", (F.col("point_id") % 2).cast("long"))


@pytest.mark.parametrize("kind", ["icp", "plane", "gicp"])
def test_groups_equal_single_factors(spark, kind):
    """Own targets or a shared one; a factor without matches has no rows."""
    from pointloom.functions import lie
    from pointloom.plans import factors
    from pointloom.plans.linearize import collect
    from pointloom.plans.matching import MatchedGroup

    df = two_frames(spark)
    motions = {0: lie.se3_exp(np.array([0.02, 0, 0.01, 0.1, 0.05, 0.0])), 1: lie.se3_exp(np.array([0, 0.03, 0, -0.1, 0.0, 0.1])), 2: np.eye(4)}
    single = {"icp": factors.icp, "plane": factors.icp_plane, "gicp": factors.gicp}[kind]
    for shared in (False, True):
        target = df.drop("factor_id") if shared else df
        got = collect(MatchedGroup(kind, df, target, 0.6).rows(motions))
        assert set(got) == {0, 1}
        for k in (0, 1):
            want = collect(single(df.where(f"factor_id = {k}"), target if shared else df.where(f"factor_id = {k}"), motions[k], 0.6))[0]
            assert got[k].n == want.n and np.allclose(got[k].h, want.h) and np.allclose(got[k].b, want.b) and abs(got[k].error - want.error) < 1e-8


def test_alignments_reuse_correspondences(spark):
    """Fewer searches than linearisations, the same pose as with a search each time; only factors that moved are sought again."""
    from pointloom.functions import lie
    from pointloom.plans.matching import MatchedFactor, MatchedGroup
    from pointloom.plans.optimize import Graph, LMParams, levenberg_marquardt

    df = two_frames(spark, 60)
    start = {k: lie.se3_exp(np.array([0.01, -0.01, 0.02, 0.03, 0.02, -0.04]) * (k + 1)) for k in (0, 1)}
    ends = []
    for tolerance in (0.0, 0.03):
        group = MatchedGroup("gicp", df, df, 0.8, rotation=tolerance, translation=tolerance)
        rounds = []
        rows = group.rows
        group.rows = lambda motions, rows=rows, rounds=rounds: rounds.append(1) or rows(motions)
        values, _ = levenberg_marquardt(Graph([MatchedFactor(group, k, k) for k in (0, 1)]), start, LMParams(max_iterations=8))
        ends.append(values)
        if tolerance:
            assert group.joins <= len(rounds) // 2
    for k in (0, 1):
        assert np.abs(ends[0][k] - ends[1][k]).max() < 1e-3 and np.linalg.norm(ends[1][k][:3, 3]) < 1e-3
    assert group.stale({0: group.made[0], 1: lie.se3_exp(np.array([0, 0, 0, 1.0, 0, 0])), 5: np.eye(4)}) == [1, 5]


def test_plans_do_not_grow_with_the_factors(spark):
    from pointloom.plans.matching import MatchedGroup

    df = two_frames(spark, 40)
    sizes = []
    for n in (2, 1000):
        many = df.drop("factor_id").join(F.broadcast(spark.range(n).selectExpr("id AS factor_id")), F.col("point_id") % 40 == F.col("factor_id") % 40)
        group = MatchedGroup("icp", many, df.drop("factor_id"), 0.5)
        rows = group.rows({k: np.eye(4) for k in range(n)})
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        sizes.append((len(plan.splitlines()), plan.count("Join"), group.joins))
    assert sizes[0] == sizes[1] and sizes[0][2] == 1


def test_stacks_of_motions():
    """Stacks give what single motions give, at no turn, at small ones and at half turns."""
    from pointloom.functions import lie

    rng = np.random.default_rng(31)
    xi = rng.normal(0, 1, (40, 6))
    xi[0], xi[1, :3] = 0, 0
    xi[2, :3] *= 1e-9
    xi[3, :3] = [np.pi, 0, 0]
    xi[4, :3] *= (np.pi - 1e-7) / np.linalg.norm(xi[4, :3])
    m = lie.se3_exp(xi)
    assert m.shape == (40, 4, 4) and np.allclose(m, [lie.se3_exp(x) for x in xi], atol=1e-14)
    logs = lie.se3_log(m)
    assert np.allclose(logs, [lie.se3_log(x) for x in m], atol=1e-9) and np.allclose(lie.se3_exp(logs), m, atol=1e-6)
    a, b = m[:20], m[20:]
    assert np.allclose(lie.between(a, b), [lie.between(x, y) for x, y in zip(a, b, strict=True)])
    assert np.allclose(lie.interpolate(a, b, 0.3), [lie.interpolate(x, y, 0.3) for x, y in zip(a, b, strict=True)], atol=1e-9)
    assert np.allclose(lie.hat(xi[:, :3]).reshape(5, 8, 3, 3), lie.hat(xi[:, :3].reshape(5, 8, 3)))


def frames_table(spark, frames: int, points: int):
    rows = spark.range(frames * points).selectExpr(f"id % {frames} AS frame_id", f"id div {frames} AS point_id", "id * 0.5 AS x", "-id * 0.25 AS y", "id % 7 * 1.0 AS z", "id * 0.125 AS t")
    return rows.withColumn("tag", F.encode(F.lpad(F.col("point_id").cast("string"), 5, "0"), "utf-8")).repartition(7)


def test_frame_folders(spark, tmp_path):
    """A hundred frames come back whole, by ranges of points; only asked attributes are read; frames that are there are not written over."""
    from pointloom.sources.frames import load_frames, save_frames

    df, path = frames_table(spark, 100, 250), f"file://{tmp_path}/frames"
    save_frames(df, path)
    back = load_frames(spark, path, points=64)
    assert back.columns == ["frame", "frame_id", "point_id", "x", "y", "z", "t", "tag"] and back.rdd.getNumPartitions() == 400
    columns = ["frame_id", "point_id", "x", "y", "z", "t", "tag"]
    assert back.select(columns).exceptAll(df.select(columns)).count() == 0 == df.select(columns).exceptAll(back.select(columns)).count()
    assert (tmp_path / "frames/000042/points.bin").stat().st_size == 250 * 32 and sorted(p.name for p in (tmp_path / "frames").iterdir())[0] == "000000"
    assert load_frames(spark, path, ("times",)).columns == ["frame", "frame_id", "point_id", "x", "y", "z", "t"]
    with pytest.raises(Exception, match="there already"):
        save_frames(df, path)
    assert not [p for p in (tmp_path / "frames").iterdir() if p.name.startswith("_")]
    save_frames(df.where("frame_id < 3").drop("t"), path, mode="overwrite")
    again = load_frames(spark, path)
    assert "t" not in again.columns and again.count() == 750
    save_frames(df.where("frame_id = 7").withColumn("frame", F.lit("later")), path)  # a frame of other attributes, no number
    both = load_frames(spark, path)
    assert both.where("t IS NULL").count() == 750 and both.where("frame = 'later' AND frame_id IS NULL AND t IS NOT NULL").count() == 250


def test_frame_folders_on_awkward_tables(spark, tmp_path):
    from pointloom.sources.files import load_frame
    from pointloom.sources.frames import FrameWriter, Written, load_frames, save_frames

    df, path = frames_table(spark, 3, 20), f"file://{tmp_path}/frames"
    with pytest.raises(Exception, match="not the name of one frame"):
        save_frames(df.withColumn("frame_id", F.expr("nullif(frame_id, 1)")), path)
    with pytest.raises(Exception, match="different lengths"):
        save_frames(df.withColumn("tag", F.expr("IF(point_id = 3, NULL, tag)")), path)
    save_frames(df.limit(0), path)
    with pytest.raises(Exception, match="no frames"):
        load_frames(spark, path).count()
    save_frames(df.withColumn("x", F.expr("IF(point_id = 3, NULL, x)")).withColumn("note", F.lit("kept out")), path, compact=True)
    back = load_frames(spark, path)
    assert back.where("isnan(x)").count() == 3 and back.count() == 60 and "note" not in back.columns
    one = load_frame(spark, f"{path}/000002", 2)
    assert {tuple(r) for r in one.select("point_id", "y", "t", "tag").collect()} == {tuple(r) for r in back.where("frame_id = 2").select("point_id", "y", "t", "tag").collect()}
    # what a lost attempt left is not moved; two tasks with one frame are refused
    writer = FrameWriter(f"{tmp_path}/other", False, False)
    batches = df.where("frame_id = 1").withColumn("frame", F.lit("a")).coalesce(1).toArrow().combine_chunks().to_batches()
    lost, kept = writer.write(iter(batches)), writer.write(iter(batches))
    assert lost.folder != kept.folder
    writer.commit([kept, None])
    assert [p.name for p in (tmp_path / "other").iterdir()] == ["a"]
    with pytest.raises(ValueError, match="two tasks"):
        writer.commit([Written(kept.folder, ("b",)), Written(lost.folder, ("b",))])


def test_radius_search_in_a_dense_cell(spark, monkeypatch):
    """All points share one cell of the radius' size, a third of them one place: the nearest ten as by brute force, from cells that are far smaller."""
    from pointloom.operators import neighbors

    rng = np.random.default_rng(5)
    xyz = rng.uniform(0.05, 0.95, (30_000, 3)) ** 2
    xyz[::3] = [0.2, 0.2, 0.2]
    points = spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(xyz)), **dict(zip("xyz", xyz.T, strict=True))})).repartition(6).cache()
    queries = neighbors.as_queries(points.where("point_id % 100 = 0"))
    sides = []
    monkeypatch.setattr(neighbors, "cell_pairs", lambda q, p, side, *more, real=neighbors.cell_pairs: (sides.append(side), real(q, p, side, *more))[1])
    got = neighbors.radius_search(queries, points, 1.0, 10).toPandas()
    assert sides[0] <= 1 / 8
    d2 = ((xyz[::100, None] - xyz[None]) ** 2).sum(axis=2)
    for i, (qid, mine) in enumerate(got.sort_values(["qid", "rank"]).groupby("qid")):
        best = np.lexsort((np.arange(len(xyz)), d2[i].round(12)))[:10]
        assert qid == 100 * i and list(mine.point_id) == list(best) and np.allclose(mine.d2, d2[i][best])
    assert got.qid.nunique() == 300
    sides.clear()
    neighbors.radius_search(queries, points.where("point_id % 3 <> 0"), 0.01, 10).count()
    assert sides == [0.01]  # cells that are not crowded are joined once
    points.unpersist()
