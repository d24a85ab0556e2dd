"""Closed-form alignment and global registration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import lie
from ..operators.metric import knn_feature, reciprocal
from ..operators.sampling import first_drawn
from ..operators.stats import bbox_diagonal
from ..operators.voxels import occupancy
from ..schema import XYZ


def alignment_sums(pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """One row of the sums that alignment needs from pairs(px.., qx..): n, sw, sp., sq., s.. (p q')."""
    w = F.col(weight) if weight else F.lit(1.0)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"), *[F.sum(w * F.col(f"{s}{c}")).alias(f"s{s}{c}") for s in "pq" for c in XYZ], *[F.sum(w * F.col(f"p{a}") * F.col(f"q{b}")).alias(f"s{a}{b}") for a in XYZ for b in XYZ])


def motion_from_sums(row, yaw_only: bool = False) -> np.ndarray:
    """The rigid motion that takes p to q with least squares: all of SE(3), or translation and a turn round z."""
    sw = row["sw"]
    if not sw:
        return np.eye(4)
    p, q = (np.array([row[f"s{s}{c}"] for c in XYZ]) / sw for s in "pq")
    h = np.array([[row[f"s{a}{b}"] for b in XYZ] for a in XYZ]) - sw * np.outer(p, q)
    if yaw_only:
        angle = np.arctan2(h[0, 1] - h[1, 0], h[0, 0] + h[1, 1])
        r = lie.so3_exp(np.array([0, 0, angle]))
    else:
        u, _, vt = np.linalg.svd(h)
        flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
        r = vt.T @ flip @ u.T
    return lie.pose(r, q - r @ p)


def align(pairs: DataFrame, weight: str | None = None, yaw_only: bool = False) -> np.ndarray:
    """One aggregate, then a 3x3 decomposition on the driver."""
    return motion_from_sums(alignment_sums(pairs, weight).head(), yaw_only)


def align_points(p: np.ndarray, q: np.ndarray, weight: np.ndarray | None = None, yaw_only: bool = False) -> np.ndarray:
    """The same for two small arrays of points."""
    w = np.ones(len(p)) if weight is None else np.asarray(weight, float)
    row = {"sw": w.sum()} | {f"sp{c}": (w * p[:, i]).sum() for i, c in enumerate(XYZ)} | {f"sq{c}": (w * q[:, i]).sum() for i, c in enumerate(XYZ)}
    row |= {f"s{a}{b}": (w * p[:, i] * q[:, j]).sum() for i, a in enumerate(XYZ) for j, b in enumerate(XYZ)}
    return motion_from_sums(row, yaw_only)


@dataclass
class Registration:
    """inlier_rate: the share of the target's points that the best motion's inliers make; motion takes the source to the target."""

    inlier_rate: float
    motion: np.ndarray


@dataclass
class RansacParams:
    iterations: int = 5000
    chunk: int = 1000
    resolution: float = 1.0
    rejection: float = 0.5
    early_stop: float = 0.8
    yaw_only: bool = False
    seed: int = 5489
    taboo_distance: float = 0.5
    taboo_angle: float = 0.1
    taboo: tuple = ()
    #: Hypotheses are scored on so many source points, in seeded order; the best `finalists` of a chunk then on all.
    score_points: int = 20_000
    finalists: int = 16


def hypotheses(table: np.ndarray, p: RansacParams, first: int, count: int) -> tuple[list[int], list[np.ndarray]]:
    """Motions of seeded samples from table (sx, sy, sz, tx, ty, tz): a pure function of each one's number. Samples whose triangles differ in size are rejected first."""
    k, ids, out = 2 if p.yaw_only else 3, [], []
    for i in range(first, first + count):
        pick = np.random.default_rng([p.seed, i]).choice(len(table), k, replace=False)
        s, t = table[pick, :3], table[pick, 3:]
        ds, dt = (np.linalg.norm(x - np.roll(x, 1, axis=0), axis=1) for x in (s, t))
        if (np.abs(dt - ds) / np.maximum(np.maximum(dt, ds), 1e-6)).max() > p.rejection:
            continue
        m = align_points(s, t, yaw_only=p.yaw_only)
        if any(np.linalg.norm(lie.between(x, m)[:3, 3]) < p.taboo_distance and np.linalg.norm(lie.so3_log(lie.between(x, m)[:3, :3])) < p.taboo_angle for x in p.taboo):
            continue
        ids.append(i)
        out.append(m)
    return ids, out


def score(source: DataFrame, cells: DataFrame, motions: list[tuple[int, np.ndarray]], resolution: float) -> DataFrame:
    """(id, hits): how many source points each motion puts into occupied cells. Motions are a chunk of fixed size, so they are broadcast."""
    rows = [(i, *[float(m[a][b]) for a in range(3) for b in range(4)]) for i, m in motions]
    table = source.sparkSession.createDataFrame(rows, "id long, " + ", ".join(f"m{a}{b} double" for a in range(3) for b in range(4)))
    placed = source.select(*XYZ).join(F.broadcast(table))
    moved = [F.expr(" + ".join([f"m{i}{j} * {XYZ[j]}" for j in range(3)] + [f"m{i}3"])).alias(c) for i, c in enumerate(XYZ)]
    keyed = placed.select("id", *moved).select("id", F.expr(E.voxel_key(resolution)).alias("vkey"))
    return keyed.join(cells, "vkey", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("hits"))


def ransac(target: DataFrame, source: DataFrame, target_features: DataFrame, source_features: DataFrame, params: RansacParams | None = None, max_samples: int = 20_000) -> Registration:
    """Feature matches once, then hypotheses in chunks: sampled on the driver from at most max_samples matches, scored together in one job each."""
    p = params or RansacParams()
    zero = F.exists("f", lambda x: x != 0)
    matches = knn_feature(source_features.where(zero).select(F.col("point_id").alias("qid"), "f"), target_features.where(zero), 1)
    side = lambda df, key, n: df.select(F.col("point_id").alias(key), *[F.col(c).alias(f"{n}{c}") for c in XYZ])
    table = matches.join(side(source, "qid", "s"), "qid").join(side(target, "point_id", "t"), "point_id")
    table = np.array(table.orderBy(F.xxhash64("qid", F.lit(p.seed))).limit(max_samples).select(*[f"{n}{c}" for n in "st" for c in XYZ]).collect(), float)
    cells = occupancy(target, p.resolution).cache()
    n_source, n_target = source.count(), target.count()
    best, best_motion = 0, np.eye(4)
    few = None
    if n_source > p.score_points:
        few = first_drawn(source.select("point_id", *XYZ), p.score_points, p.seed).cache()
    if len(table) < 3:
        return Registration(0.0, best_motion)
    for first in range(0, p.iterations, p.chunk):
        ids, motions = hypotheses(table, p, first, min(p.chunk, p.iterations - first))
        if not ids:
            continue
        chosen = list(zip(ids, motions, strict=True))
        if few is not None:
            known = dict(chosen)
            chosen = [(r.id, known[r.id]) for r in score(few, cells, chosen, p.resolution).orderBy(F.desc("hits"), "id").head(p.finalists)]
        top = score(source, cells, chosen, p.resolution).orderBy(F.desc("hits"), "id").head(1)
        if top and top[0].hits > best:
            best, best_motion = top[0].hits, motions[ids.index(top[0].id)]
        if best > p.early_stop * n_source:
            break
    return Registration(best / n_target, best_motion)


@dataclass
class GncParams:
    max_samples: int = 5000
    tuple_test_from: int = 3000
    tuple_ratio: float = 0.9
    outer: int = 64
    inner: int = 3
    shrink: float = 1.4
    least: float = 0.25
    yaw_only: bool = False
    seed: int = 7


def gnc(target: DataFrame, source: DataFrame, target_features: DataFrame, source_features: DataFrame, params: GncParams | None = None) -> Registration:
    """Graduated non-convexity over mutual feature matches; a bounded, seeded sample of them is solved on the driver."""
    p = params or GncParams()
    pairs = reciprocal(source_features, target_features)
    side = lambda df, key, n: df.select(F.col("point_id").alias(key), *[F.col(c).alias(f"{n}{c}") for c in XYZ])
    found = pairs.join(side(source, "a_id", "s"), "a_id").join(side(target, "b_id", "t"), "b_id")
    table = np.array(found.orderBy(F.xxhash64("a_id", F.lit(p.seed))).limit(p.max_samples).select(*[f"{n}{c}" for n in "st" for c in XYZ]).collect(), float).reshape(-1, 6)
    s, t = table[:, :3], table[:, 3:]
    if len(table) > p.tuple_test_from:
        rng, keep = np.random.default_rng(p.seed), np.zeros(len(table), bool)
        for _ in range(100 * len(table)):
            pick = rng.choice(len(table), 3, replace=False)
            a, b = (np.linalg.norm(x[pick] - np.roll(x[pick], 1, axis=0), axis=1) for x in (s, t))
            if ((a > p.tuple_ratio * b) & (a < b / p.tuple_ratio)).all():
                keep[pick] = True
            if keep.sum() > p.tuple_test_from // 3:
                break
        s, t = s[keep], t[keep]
    if len(s) < 3:
        return Registration(0.0, np.eye(4))
    mu, m = float(bbox_diagonal(target).head()[0]) ** 2, np.eye(4)
    for outer in range(p.outer):
        for inner in range(p.inner):
            e = ((t - (s @ m[:3, :3].T + m[:3, 3])) ** 2).sum(1)
            w = np.ones(len(s)) if outer == 0 and inner == 0 else (mu / (mu + e)) ** 2
            m = align_points(s, t, w, p.yaw_only)
        mu /= p.shrink
        if mu < p.least**2:
            break
    e = ((t - (s @ m[:3, :3].T + m[:3, 3])) ** 2).sum(1)
    return Registration(float((e < (2 * p.least) ** 2).mean()), m)
