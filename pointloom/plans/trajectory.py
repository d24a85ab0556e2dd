"""Cubic B-spline trajectories: knots, poses, velocities, inertial values, fitting."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lie

GRAVITY = np.array([0.0, 0.0, 9.80665])
# The cumulative cubic basis and its derivatives in u, as polynomials of the place between two knots.
BETA = ("(5 + 3 * u - 3 * u * u + u * u * u) / 6", "(1 + 3 * u + 3 * u * u - 2 * u * u * u) / 6", "u * u * u / 6")
BETA1 = ("(3 - 6 * u + 3 * u * u) / 6", "(3 + 6 * u - 6 * u * u) / 6", "u * u / 2")
BETA2 = ("(u - 1)", "(1 - 2 * u)", "u")


def arange_timestamps(spark: SparkSession, start: float, end: float, step: float, given: tuple[float, float] | None = None) -> DataFrame:
    """stamp from start by step, and end itself if the last differs from it by more than 1e-6. No stamps if end lies before start.

    given: the first and last stamps of a trajectory, which a negative start or end means.
    """
    if given is not None:
        start, end = given[0] if start < 0 else start, given[1] if end < 0 else end
    if step <= 0:
        raise ValueError("step must be positive")
    if end < start:
        return spark.range(0).select(F.lit(start).alias("stamp"))
    n = int(np.floor((end - start) / step + 1e-9)) + 1
    out = spark.range(n).select((F.lit(start) + F.col("id") * F.lit(step)).alias("stamp"))
    last = start + (n - 1) * step
    return out.union(spark.range(1).select(F.lit(end).alias("stamp"))) if abs(end - last) > 1e-6 else out


def knot_stamp(i: str, start: float, interval: float) -> str:
    return f"({start - interval / 2!r} + CAST({i} AS DOUBLE) * {interval!r})"


def knot_id(t: str, start: float, interval: float) -> str:
    return f"(CAST(floor(({t} - {start!r}) / {interval!r}) AS BIGINT) + 1)"


def knot_max_id(end: float, start: float, interval: float) -> int:
    return int(np.floor((end - start) / interval)) + 3


def with_knots(queries: DataFrame, knots: DataFrame, start: float, interval: float) -> DataFrame:
    """queries(t) with u and the translations of the four knots round each: k{0..3}{x,y,z}, from knots(knot, tx, ty, tz). Each knot goes to the
    four intervals it shapes, so the four of an interval meet by a grouping, and queries by an equi-join that Spark broadcasts if the knots are few."""
    spread = knots.select("*", F.explode(F.array(*[F.lit(j) for j in range(4)])).alias("_j")).withColumn("_i", F.col("knot") + 1 - F.col("_j"))
    four = spread.groupBy("_i").agg(*[F.max(F.when(F.col("_j") == j, F.col(f"t{c}"))).alias(f"k{j}{c}") for j in range(4) for c in "xyz"])
    at = queries.withColumn("_i", F.expr(knot_id("t", start, interval)))
    at = at.withColumn("u", F.expr(f"(t - {start!r}) / {interval!r} - floor((t - {start!r}) / {interval!r})"))
    return at.join(four, "_i").drop("_i")


def _blend(basis: tuple[str, str, str], c: str, scale: float = 1.0, base: bool = False) -> str:
    steps = " + ".join(f"({b}) * (k{i + 1}{c} - k{i}{c})" for i, b in enumerate(basis))
    return f"({f'k0{c} + ' if base else ''}({steps}) * {scale!r})"


def spline_translation(df: DataFrame) -> DataFrame:
    """df (with_knots) with px, py, pz."""
    return df.select("*", *[F.expr(_blend(BETA, c, base=True)).alias(f"p{c}") for c in "xyz"])


def spline_velocity(df: DataFrame, interval: float) -> DataFrame:
    return df.select("*", *[F.expr(_blend(BETA1, c, 1 / interval)).alias(f"v{c}") for c in "xyz"])


def spline_acceleration(df: DataFrame, interval: float) -> DataFrame:
    return df.select("*", *[F.expr(_blend(BETA2, c, 1 / interval**2)).alias(f"a{c}") for c in "xyz"])


def _basis(u: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.array([(5 + 3 * u - 3 * u * u + u**3) / 6, (1 + 3 * u + 3 * u * u - 2 * u**3) / 6, u**3 / 6]),
        np.array([(3 - 6 * u + 3 * u * u) / 6, (3 + 6 * u - 6 * u * u) / 6, u * u / 2]), np.array([u - 1, 1 - 2 * u, u]),
    )


def rotation(r: list[np.ndarray], u: float) -> np.ndarray:
    """The cumulative product R0 Exp(b1 d1) Exp(b2 d2) Exp(b3 d3) with d the logs between neighbours."""
    b, _, _ = _basis(u)
    out = r[0]
    for i in range(3):
        out = out @ lie.so3_exp(b[i] * lie.so3_log(r[i].T @ r[i + 1]))
    return out


def se3(m: list[np.ndarray], u: float) -> np.ndarray:
    b, _, _ = _basis(u)
    out = m[0]
    for i in range(3):
        out = out @ lie.se3_exp(b[i] * lie.se3_log(lie.between(m[i], m[i + 1])))
    return out


def angular_velocity(r: list[np.ndarray], u: float, interval: float) -> np.ndarray:
    """In the body frame."""
    b, b1, _ = _basis(u)
    w = np.zeros(3)
    for i in range(3):
        d = lie.so3_log(r[i].T @ r[i + 1])
        w = lie.so3_exp(b[i] * d).T @ w + b1[i] / interval * d
    return w


@dataclass
class ContinuousTrajectory:
    """Knots at start - interval / 2 + i * interval, i from 0; rotations and translations are splines of their own."""

    start: float
    interval: float
    rotations: np.ndarray
    translations: np.ndarray

    def _at(self, t: float) -> tuple[int, float]:
        x = (t - self.start) / self.interval
        i = int(np.clip(np.floor(x), 0, len(self.translations) - 4))
        return i, x - i

    def pose(self, t: float) -> np.ndarray:
        i, u = self._at(t)
        b, _, _ = _basis(u)
        k = self.translations[i : i + 4]
        return lie.pose(rotation(list(self.rotations[i : i + 4]), u), k[0] + b @ np.diff(k, axis=0))

    def imu(self, t: float) -> np.ndarray:
        """Acceleration with gravity in the body frame, then angular velocity."""
        i, u = self._at(t)
        _, _, b2 = _basis(u)
        r = list(self.rotations[i : i + 4])
        a = b2 @ np.diff(self.translations[i : i + 4], axis=0) / self.interval**2
        return np.concatenate([rotation(r, u).T @ (a + GRAVITY), angular_velocity(r, u, self.interval)])

    def evaluate(self, queries: DataFrame) -> DataFrame:
        """queries(ts) with pose (tx..qw) and inertial values (ax..wz); the knots go along with the function."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                poses, imus = [self.pose(t) for t in pdf.ts], [self.imu(t) for t in pdf.ts]
                values = [[t, *p[:3, 3], *lie.to_quaternion(p[:3, :3]), *a] for t, p, a in zip(pdf.ts, poses, imus, strict=True)]
                yield pd.DataFrame(values, columns=["ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw", "ax", "ay", "az", "wx", "wy", "wz"], dtype=float)

        return queries.select("ts").mapInPandas(run, ", ".join(f"{c} double" for c in ("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw", "ax", "ay", "az", "wx", "wy", "wz")))


def _band_factor(first: np.ndarray, weights: np.ndarray, n: int, smoothness: float) -> np.ndarray:
    """The Cholesky factor, four diagonals of it, of the normal equations of rows with `weights` from column `first` on and of neighbours' differences."""
    band = np.zeros((4, n))
    for a in range(4):
        for c in range(a, 4):
            np.add.at(band[c - a], first + a, weights[:, a] * weights[:, c])
    band[0, :-1] += smoothness**2
    band[0, 1:] += smoothness**2
    band[1, :-1] -= smoothness**2
    for j in range(n):
        for d in range(4):
            for k in range(1, 4 - d):
                if j - k >= 0:
                    band[d, j] -= band[k, j - k] * band[k + d, j - k]
        band[0, j] = np.sqrt(max(band[0, j], 1e-300))
        band[1:, j] /= band[0, j]
    return band


def _band_solve(band: np.ndarray, first: np.ndarray, weights: np.ndarray, right: np.ndarray, differences: np.ndarray, smoothness: float) -> np.ndarray:
    n = band.shape[1]
    x = np.zeros((n, right.shape[1]))
    for a in range(4):
        np.add.at(x, first + a, weights[:, a, None] * right)
    x[:-1] -= smoothness * differences
    x[1:] += smoothness * differences
    for j in range(n):
        x[j] = (x[j] - sum(band[k, j - k] * x[j - k] for k in range(1, min(3, j) + 1))) / band[0, j]
    for j in range(n - 1, -1, -1):
        x[j] = (x[j] - sum(band[k, j] * x[j + k] for k in range(1, min(3, n - 1 - j) + 1))) / band[0, j]
    return x


def _nearest(stamps: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The place of the stamp nearest to each time; of equally near ones the earlier, of equal ones the first."""
    order = np.argsort(stamps, kind="stable")
    ordered = stamps[order]
    after = np.searchsorted(ordered, times).clip(0, len(ordered) - 1)
    before = (after - 1).clip(0)
    best = np.where(np.abs(ordered[before] - times) <= np.abs(ordered[after] - times), before, after)
    return order[np.searchsorted(ordered, ordered[best])]


def fit_knots(stamps: np.ndarray, poses: list[np.ndarray], interval: float, smoothness: float = 1e-3, iterations: int = 10) -> ContinuousTrajectory:
    """Knots start at the pose nearest in time; translations are one banded least-squares problem (in time linear in the knots), rotations Gauss-Newton steps on right perturbations."""
    start, n = float(stamps[0]), knot_max_id(float(stamps[-1]), float(stamps[0]), interval) + 1
    times = start - interval / 2 + interval * np.arange(n)
    near = _nearest(stamps, times)
    rot = np.array([poses[i][:3, :3] for i in near])
    trans = np.array([poses[i][:3, 3] for i in near])
    traj = ContinuousTrajectory(start, interval, rot, trans)
    places = [traj._at(t) for t in stamps]
    first = np.array([i for i, _ in places])
    weights = np.array([[1 - b[0], b[0] - b[1], b[1] - b[2], b[2]] for b in (_basis(u)[0] for _, u in places)])
    factor = _band_factor(first, weights, n, smoothness)
    traj.translations = _band_solve(factor, first, weights, np.array([p[:3, 3] for p in poses]), np.zeros((n - 1, 3)), smoothness)
    for _ in range(iterations):
        res = np.array([lie.so3_log(rotation(list(traj.rotations[i : i + 4]), u).T @ p[:3, :3]) for (i, u), p in zip(places, poses, strict=True)])
        smooth = np.array([smoothness * lie.so3_log(traj.rotations[k].T @ traj.rotations[k + 1]) for k in range(n - 1)])
        # to first order a knot's right perturbation reaches the value with its weight of the basis
        step = _band_solve(factor, first, weights, res, -smooth, smoothness)
        traj.rotations = np.array([r @ lie.so3_exp(d) for r, d in zip(traj.rotations, step, strict=True)])
        if np.abs(step).max() < 1e-9:
            break
    return traj
