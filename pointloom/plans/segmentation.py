"""Segmentation over neighbour graphs: region growing and minimum cut."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators.neighbors import PAIRS, around, as_queries, knn, matrix, radius_search, squares
from ..schema import NORMAL, XYZ
from ..scratch import cut, drop


@dataclass
class RegionParams:
    distance: float = 0.5
    angle: float = math.radians(10)
    dilation: float = 0.5
    max_steps: int = 1_000_000
    max_cluster: int = 1_000_000_000


def region_edges(df: DataFrame, p: RegionParams) -> DataFrame:
    """(qid, point_id): closer than the distance, and normals (signed) within the angle."""
    near = radius_search(as_queries(df), df.select("point_id", *XYZ), p.distance).where("qid <> point_id").select("qid", "point_id")
    a = df.select(F.col("point_id").alias("qid"), *[F.col(c).alias(f"a{c}") for c in NORMAL])
    b = df.select("point_id", *[F.col(c).alias(f"b{c}") for c in NORMAL])
    both = near.join(a, "qid").join(b, "point_id")
    return both.where(F.expr(f"{E.dot([f'a{c}' for c in NORMAL], [f'b{c}' for c in NORMAL])} >= {math.cos(p.angle)!r}")).select("qid", "point_id")


#: So many points of a cell are one block of a region search, where what is found is never sought again.
REGION_BLOCK = 1 << 16
_PLACED, _ASKED, _CELL = (*XYZ, *NORMAL), tuple(f"q{c}" for c in (*XYZ, *NORMAL)), ("cx", "cy", "cz")


def _oriented(df: DataFrame) -> DataFrame:
    return df.select("point_id", *_PLACED)


def _as_asked(df: DataFrame) -> DataFrame:
    return df.select(F.col("point_id").alias("qid"), *[F.col(c).alias(q) for c, q in zip(_PLACED, _ASKED, strict=True)])


def _reached(asked: np.ndarray, among: np.ndarray, p: RegionParams) -> np.ndarray:
    """Which of the places and normals among (6 x n) have a link of region_edges with one of the asked."""
    near = squares(asked[:3], among[:3]) < p.distance * p.distance
    a, b = asked[3:, :, None], among[3:, None]
    return (near & (a[0] * b[0] + a[1] * b[1] + a[2] * b[2] >= math.cos(p.angle))).any(0)


def _swept(asked: np.ndarray, places: np.ndarray, free: np.ndarray, p: RegionParams) -> tuple[np.ndarray, np.ndarray]:
    """(those of the columns `free` of places that have a link with one of the asked, the others): by few of the asked near each other, whatever was reached is left out then."""
    order, found = np.lexsort(np.floor(asked[:3] * (4 / p.distance))), []
    margin = p.distance * (1 + 1e-9) + 1e-15 * max(np.abs(asked[:3]).max(initial=0.0), np.abs(places[:3]).max(initial=0.0))
    for at in range(0, len(order), 64):
        some = asked[:, order[at : at + 64]]
        lo, hi = some[:3].min(1) - margin, some[:3].max(1) + margin
        inside = np.flatnonzero((places[0, free] >= lo[0]) & (places[0, free] <= hi[0]))
        for c in (1, 2):
            x = places[c, free[inside]]
            inside = inside[(x >= lo[c]) & (x <= hi[c])]
        row, hits = 0, []
        while row < some.shape[1] and len(inside):
            step = max(1, PAIRS // len(inside))
            hit = _reached(some[:, row : row + step], places[:, free[inside]], p)
            hits.append(inside[hit])
            inside, row = inside[~hit], row + step
        if any(map(len, hits)):
            hit = np.concatenate(hits)
            found.append(free[hit])
            free = np.delete(free, hit)
    return np.concatenate(found) if found else free[:0], free


def region_front(df: DataFrame, front: DataFrame, p: RegionParams) -> DataFrame:
    """(point_id) of points of df that have a link with one of the front's (point_id, ...), once for each block of these: links are neither shuffled nor written."""

    def work(queries: pa.Table, points: pa.Table) -> Iterator[pa.RecordBatch]:
        q, places, ids = matrix(queries, _ASKED), matrix(points, _PLACED), points["point_id"].combine_chunks()
        found, _ = _swept(q, places, np.arange(places.shape[1]), p)
        for at in range(0, len(found), PAIRS):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(found[at : at + PAIRS]))], ["point_id"])

    if p.distance <= 0:
        return df.select("point_id").limit(0)
    return around(_as_asked(front), _oriented(df), p.distance, work, f"point_id {dict(df.dtypes)['point_id']}", REGION_BLOCK)


def region_links(df: DataFrame, p: RegionParams) -> DataFrame:
    """(qid, point_id), both ways, that connect the same points as region_edges do: of each block fewer links than it has points.

    A task searches its block from point to point, and what was reached is not looked at again for the same part; a point of another block joins the parts that
    reach it. Links between two cells are looked for from one of them.
    """
    key = dict(df.dtypes)["point_id"]

    def work(queries: pa.Table, points: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, cells = matrix(queries.slice(0, 1), _CELL)[:, 0], matrix(points, [f"p{c}" for c in _CELL])
        differs = [np.sign(c - v) for c, v in zip(cells, cell, strict=True)]
        points = points.filter(pa.array(4 * differs[0] + 2 * differs[1] + differs[2] >= 0))
        ids, places = points["point_id"].combine_chunks(), matrix(points, _PLACED)
        own = pc.index_in(queries["qid"].combine_chunks(), value_set=ids).to_numpy()
        mine = np.zeros(len(ids), bool)
        mine[own] = True
        others, free = np.flatnonzero(~mine), mine.copy()
        part, roots, joined = np.full(len(ids), -1), [], []  # of others: the first part that reached each

        def top(i: int) -> int:
            while joined[i] != i:
                joined[i] = joined[joined[i]]
                i = joined[i]
            return i

        a, b = [], []
        for root in own:
            if not free[root]:
                continue
            number = len(roots)
            roots.append(root)
            joined.append(number)
            free[root] = False
            front, away, met = np.array([root]), others, []
            while len(front):
                found, rest = _swept(places[:, front], places, np.concatenate([np.flatnonzero(free), away]), p)
                front = new = found[mine[found]]
                reached, away = found[~mine[found]], rest[~mine[rest]]
                free[new] = False
                a.append(np.full(len(new), root))
                b.append(new)
                met.append(reached)
            met = np.concatenate(met)
            first = met[part[met] < 0]
            for other in np.unique(part[met[part[met] >= 0]]).tolist():
                x, y = top(other), top(number)
                if x != y:
                    joined[y] = x
                    a.append(np.array([roots[other]]))
                    b.append(np.array([root]))
            part[first] = number
            a.append(np.full(len(first), root))
            b.append(first)
        a, b = np.concatenate(a), np.concatenate(b)
        for at in range(0, len(a), PAIRS):
            x, y = (ids.take(pa.array(c[at : at + PAIRS])) for c in (a, b))
            yield pa.RecordBatch.from_arrays([x, y], ["qid", "point_id"])
            yield pa.RecordBatch.from_arrays([y, x], ["qid", "point_id"])

    if p.distance <= 0:
        return df.select(F.col("point_id").alias("qid"), "point_id").limit(0)
    cells = lambda c: F.expr(E.voxel(c, p.distance))
    queries = _as_asked(df).select("qid", "qx", "qy", "qz", *[cells(f"q{c}").alias(n) for c, n in zip(XYZ, _CELL, strict=True)])
    points = _oriented(df).select("*", *[cells(c).alias(f"p{n}") for c, n in zip(XYZ, _CELL, strict=True)])
    return around(queries, points, p.distance, work, f"qid {key}, point_id {key}", REGION_BLOCK)


@dataclass
class RegionContext:
    """A resumable search: the points reached, level by level, each level a table of its own."""

    cloud: DataFrame
    levels: list[DataFrame]
    size: int = 1
    steps: int = 0
    done: bool = False

    @property
    def reached(self) -> DataFrame:
        """All levels, as one scan."""
        first = self.levels[0]
        return first.sparkSession.read.schema(first.schema).parquet(*[x._scratch for x in self.levels])


def region_init(df: DataFrame, seed: tuple[float, float, float], p: RegionParams) -> RegionContext:
    """Starts at the point nearest to the seed."""
    d2 = " + ".join(f"({c} - {v!r}) * ({c} - {v!r})" for c, v in zip(XYZ, map(float, seed), strict=True))
    first = cut(df.orderBy(F.expr(d2), "point_id").limit(1).select("point_id"), "seed")
    return RegionContext(cut(_oriented(df), "cloud"), [first])


def region_update(context: RegionContext, p: RegionParams, steps: int = 1) -> RegionContext:
    """So many rounds: neighbours of the last level that were not reached yet. As links go both ways, they can only be new or in the last
    two levels, so a round reads and writes levels and never all that was reached. A round ends within p.max_cluster points."""
    for _ in range(steps):
        if context.done or context.steps >= p.max_steps:
            break
        front = context.cloud.join(context.levels[-1], "point_id", "left_semi")
        out = region_front(context.cloud, front, p).distinct()
        for level in context.levels[-2:]:
            out = out.join(level, "point_id", "left_anti")
        room = p.max_cluster - context.size
        found = cut(out, "level")
        n = found.count()
        if n > room:  # those of the least ids fill the cluster
            found, n = cut(found.orderBy("point_id").limit(room), "level"), room
        context.steps += 1
        context.size += n
        if n:
            context.levels.append(found)
        context.done = not n or context.size >= p.max_cluster
    return context


def region_dilation(df: DataFrame, reached: DataFrame, p: RegionParams) -> DataFrame:
    """All points within the dilation radius of a reached one."""
    core = df.join(reached, "point_id", "left_semi")
    return radius_search(as_queries(core), df.select("point_id", *XYZ), p.dilation).select("point_id").distinct()


def region_growing(df: DataFrame, seed: tuple[float, float, float], params: RegionParams | None = None, dilate: bool = True) -> DataFrame:
    """(point_id) of the seed's region."""
    p = params or RegionParams()
    context = region_init(df, seed, p)
    while not context.done and context.steps < p.max_steps:
        region_update(context, p)
    return region_dilation(df, context.reached, p) if dilate else context.reached


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(point_id, region): the least point_id that links (qid, point_id), which go both ways, lead to; nodes(point_id) without links are regions of their own.

    Labels are pointers to other points of the region. In each round they are followed four steps (two joins of the table with itself), and
    each point, and the point that its label names, takes the least label of its neighbours: a chain of n points is done in about log4(n) rounds, in any
    order of its ids. A round is a join of the links and one aggregation; it ends in a table, so a lost executor costs one round.
    """
    links = cut(edges.select(F.col("qid").alias("node"), F.col("point_id").alias("other")), "links")
    labels = cut(nodes.select(F.col("point_id").alias("node"), F.col("point_id").alias("label")).distinct(), "labels")
    for _ in range(most_rounds):
        ahead = labels
        for _ in range(2):
            step = ahead.select(F.col("node").alias("label"), F.col("label").alias("next"))
            ahead = ahead.join(step, "label").select("node", F.col("next").alias("label"))
        ahead = cut(ahead, "ahead")
        around = links.join(ahead.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other").groupBy("node").agg(F.min("seen").alias("seen"))
        offers = ahead.join(around, "node").where("seen < label")
        offers = offers.select("node", "seen").unionByName(offers.select(F.col("label").alias("node"), "seen"))
        lower = cut(offers.groupBy("node").agg(F.min("seen").alias("seen")), "lower")
        drop(labels)
        if lower.isEmpty():
            drop(lower)
            drop(links)
            return ahead.select(F.col("node").alias("point_id"), F.col("label").alias("region"))
        labels = cut(ahead.join(lower, "node", "left").select("node", F.least("label", "seen").alias("label")), "labels")
        drop(ahead)
        drop(lower)
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def all_regions(df: DataFrame, params: RegionParams | None = None) -> DataFrame:
    """(point_id, region, size) of every point: what region_growing without dilation finds from any seed in it; a region is named by its least point_id."""
    p = params or RegionParams()
    found = components(df.select("point_id"), region_links(df, p))
    return found.join(found.groupBy("region").agg(F.count(F.lit(1)).alias("size")), "region").select("point_id", "region", "size")


def seed_regions(df: DataFrame, regions: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_id, region) for each of seeds(seed_id, sx, sy, sz): the region of the point nearest to it. All regions are labelled once, however many seeds there are."""
    near = knn(seeds.select(F.col("seed_id").alias("qid"), *[F.col(f"s{c}").alias(f"q{c}") for c in XYZ]), df.select("point_id", *XYZ), 1)
    return near.select(F.col("qid").alias("seed_id"), "point_id").join(regions, "point_id").select("seed_id", "region")


@dataclass
class CutParams:
    k: int = 20
    distance_sigma: float = 0.25
    angle_sigma: float = math.radians(10)
    foreground: float = 0.25
    background: float = 3.0
    foreground_weight: float = 1e3


def cut_edges(df: DataFrame, p: CutParams) -> DataFrame:
    """(qid, point_id, weight): exp(-d2 / s^2) exp(-angle^2 / s^2) to the k nearest, self-links left out."""
    near = knn(as_queries(df), df.select("point_id", *XYZ), p.k).where("qid <> point_id")
    a = df.select(F.col("point_id").alias("qid"), *[F.col(c).alias(f"a{c}") for c in NORMAL])
    b = df.select("point_id", *[F.col(c).alias(f"b{c}") for c in NORMAL])
    angle = f"acos(least(1.0, abs({E.dot([f'a{c}' for c in NORMAL], [f'b{c}' for c in NORMAL])})))"
    weight = f"exp(-d2 / {p.distance_sigma**2!r}) * exp(-{angle} * {angle} / {p.angle_sigma**2!r})"
    return near.join(a, "qid").join(b, "point_id").select("qid", "point_id", F.expr(weight).alias("weight"))


def max_flow_side(n: int, edges: list[tuple[int, int, float]], source: int, sink: int) -> np.ndarray:
    """Which nodes stay on the source's side of a minimum cut: shortest augmenting levels with a residual search (undirected edges)."""
    to, cap, adj = [], [], [[] for _ in range(n)]
    for a, b, c in edges:
        adj[a].append(len(to))
        to.append(b)
        cap.append(c)
        adj[b].append(len(to))
        to.append(a)
        cap.append(c)
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in adj[v]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return np.array([x >= 0 for x in level])
        at = [0] * n
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-12)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[v] < len(adj[v]) and not (cap[adj[v][at[v]]] > 1e-12 and level[to[adj[v][at[v]]]] == level[v] + 1):
                at[v] += 1
            if at[v] < len(adj[v]):
                path.append(adj[v][at[v]])
                v = to[path[-1]]
            elif path:
                v = to[path.pop() ^ 1]
                at[v] += 1
            else:
                break


def min_cut(df: DataFrame, seeds: DataFrame, params: CutParams | None = None) -> DataFrame:
    """(seed_id, point_id) of the cluster of each of seeds(seed_id, sx, sy, sz): the graph is built once, the flow of a seed runs in its own group over points within the background radius (and one ring beyond)."""
    p = params or CutParams()
    edges = cut(cut_edges(df, p), "cut-edges")
    near = radius_search(seeds.select(F.col("seed_id").alias("qid"), *[F.col(f"s{c}").alias(f"q{c}") for c in XYZ]), df.select("point_id", *XYZ), p.background * 1.2)
    near = cut(near.select(F.col("qid").alias("seed_id"), "point_id", "d2"), "near")
    inner = near.select("seed_id", F.col("point_id").alias("qid"), F.col("d2").alias("d2a"))
    outer = near.select("seed_id", "point_id", F.col("d2").alias("d2b"))
    rows = edges.join(inner, "qid").join(outer, ["seed_id", "point_id"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d2 = dict(zip(pdf.qid, pdf.d2a, strict=True)) | dict(zip(pdf.point_id, pdf.d2b, strict=True))
        ids = sorted(d2)
        at = {x: i for i, x in enumerate(ids)}
        n = len(ids)
        links = [(at[a], at[b], w) for a, b, w in zip(pdf.qid, pdf.point_id, pdf.weight, strict=True)]
        nearest = min(ids, key=lambda x: (d2[x], x))
        links += [(n, at[x], p.foreground_weight) for x in ids if x == nearest or d2[x] < p.foreground**2]
        links += [(at[x], n + 1, p.foreground_weight) for x in ids if d2[x] >= p.background**2]
        side = max_flow_side(n + 2, links, n, n + 1)
        return pd.DataFrame({"seed_id": pdf.seed_id.iloc[0], "point_id": [x for x in ids if side[at[x]]]})

    return rows.groupBy("seed_id").applyInPandas(run, "seed_id long, point_id long")
