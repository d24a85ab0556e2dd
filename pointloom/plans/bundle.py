"""Bundle adjustment over planes and edges, inertial pre-integration, and small analytic factors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import lie
from ..operators.stats import distribution, merge_distributions
from ..schema import COV
from .optimize import ResidualFactor, numerical_jacobian


def pooled_eigenvalues(df: DataFrame, key: str = "frame_id") -> DataFrame:
    """One row l0 <= l1 <= l2: eigenvalues of all placed points' covariance, from each frame's distribution."""
    return merge_distributions(distribution(df, key)).select(*[F.expr(e).alias(f"l{i}") for i, e in enumerate(E.eigenvalues(COV))])


def plane_evm(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """(error): the least eigenvalue, the points' spread across their plane."""
    return pooled_eigenvalues(df).select((F.col("l0") * scale).alias("error"))


def edge_evm(df: DataFrame) -> DataFrame:
    """(error): the two lesser eigenvalues, the spread round a line."""
    return pooled_eigenvalues(df).select((F.col("l0") + F.col("l1")).alias("error"))


def eigen_derivatives(points: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(value, gradient, Hessian) of the k-th eigenvalue of the points' covariance over all coordinates."""
    n = len(points)
    d = points - points.mean(0)
    values, u = np.linalg.eigh(d.T @ d / n)
    v = u[:, k]
    along = d @ v
    grad = (2 / n * np.outer(along, v)).ravel()
    hess = np.zeros((3 * n, 3 * n))
    for i in range(3):
        if i != k:
            w = u[:, i]
            mixed = (np.outer(d @ w, v) + np.outer(along, w)).ravel() / n
            hess += 2 / (values[k] - values[i]) * np.outer(mixed, mixed)
    centre = np.eye(n) - np.ones((n, n)) / n
    return values[k], grad, hess + 2 / n * np.kron(centre, np.outer(v, v))


def eigen_gradients(df: DataFrame, k: int) -> DataFrame:
    """(point_id, value, dx, dy, dz): the k-th eigenvalue of all points' covariance and its derivative by each point. Only the moments reach the driver."""
    parts = list(frame_parts(df).values())
    total, mean, cov, _ = _pooled(parts, [np.eye(4)] * len(parts))
    values, axes = np.linalg.eigh(cov)
    u = axes[:, k]
    along = " + ".join(f"{float(u[i])!r} * ({c} - {float(mean[i])!r})" for i, c in enumerate("xyz"))
    return df.select("point_id", F.lit(float(values[k])).alias("value"), *[F.expr(f"{2 / total * float(u[i])!r} * ({along})").alias(f"d{c}") for i, c in enumerate("xyz")])


def lsq_error(parts: list[tuple[int, np.ndarray, np.ndarray]], poses: list[np.ndarray]) -> float:
    """Sum over frames (n, mean, cov) of the squared distances of their points from the common plane."""
    n = sum(p[0] for p in parts)
    placed = [(k, m[:3, :3] @ mu + m[:3, 3], m[:3, :3] @ c @ m[:3, :3].T) for (k, mu, c), m in zip(parts, poses, strict=True)]
    mean = sum(k * mu for k, mu, _ in placed) / n
    cov = sum(k * (c + np.outer(mu - mean, mu - mean)) for k, mu, c in placed) / n
    normal = np.linalg.eigh(cov)[1][:, 0]
    return float(sum(k * (normal @ c @ normal + ((mu - mean) @ normal) ** 2) for k, mu, c in placed))


def frame_parts(df: DataFrame, key: str = "frame_id") -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """(n, mean, covariance) of each frame's points: one row a frame reaches the driver, whatever the points."""
    out = {}
    for r in distribution(df, key).collect():
        c = np.array([r[x] for x in COV])
        out[r[key]] = (r.n, np.array([r.mx, r.my, r.mz]), np.array([[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]))
    return out


def _pooled(parts: list, poses: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray, list]:
    """(n, mean, covariance, [(n, second moment, sum)] of each frame) of all points placed by their frames' poses."""
    each = []
    for (n, mu, c), m in zip(parts, poses, strict=True):
        at, turned = m[:3, :3] @ mu + m[:3, 3], m[:3, :3] @ c @ m[:3, :3].T
        each.append((n, n * (turned + np.outer(at, at)), n * at))
    total = sum(e[0] for e in each)
    mean = sum(e[2] for e in each) / total
    return total, mean, sum(e[1] for e in each) / total - np.outer(mean, mean), each


@dataclass
class SpreadFactor:
    """Bundle adjustment by eigenvalues: the spread of the points of several frames across their common plane (the least eigenvalue of their
    covariance) or round their common line (the two lesser ones), as a function of the frames' poses.

    Points enter by their frames' counts, means and covariances only (frame_parts). A direction u of the eigenvectors meant is a residual u'(p - mean)
    of every point; its derivative by the poses takes the mean's into account, and the sums over points are closed forms of the
    moments, so the system is a Gauss-Newton one over all frames' poses.
    """

    keys: tuple[int, ...]
    parts: list[tuple[int, np.ndarray, np.ndarray]]
    kind: str = "plane"
    scale: float = 1.0

    def error(self, poses: list[np.ndarray]) -> float:
        values = np.linalg.eigvalsh(_pooled(self.parts, poses)[2])
        return self.scale * float(values[0] if self.kind == "plane" else values[0] + values[1])

    def linearize(self, values: dict[int, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        total, mean, cov, each = _pooled(self.parts, [values[k] for k in self.keys])
        spread, axes = np.linalg.eigh(cov)
        n = 6 * len(self.keys)
        h, b, error = np.zeros((n, n)), np.zeros(n), 0.0
        for i in range(1 if self.kind == "plane" else 2):
            u = axes[:, i]
            error += spread[i]
            common = np.concatenate([np.concatenate([np.cross(s, u), k * u]) for k, _, s in each]) / total  # derivative of u'mean
            for f, (k, second, s) in enumerate(each):
                at = slice(6 * f, 6 * f + 6)
                hat = lie.hat(u)
                # sums over the frame's points of g g', g and r g with g = (p x u, u) and r = u'(p - mean)
                gg = np.block([[hat @ second @ hat.T, -np.outer(hat @ s, u)], [-np.outer(u, hat @ s), k * np.outer(u, u)]])
                rg = np.concatenate([-hat @ (second @ u - s * (u @ mean)), u * (u @ s - k * (u @ mean))])
                h[at, at] += gg / total
                b[at] += rg / total
            h -= np.outer(common, common)
            # where the plane turns with the points: the eigenvector's own derivative lowers the curvature
            for j in range(3):
                if j == i or (self.kind != "plane" and j < 2):
                    continue
                w, mixed = axes[:, j], np.zeros(n)
                for f, (k, second, s) in enumerate(each):
                    one = lambda x, y: np.concatenate([np.cross(second @ y - s * (y @ mean), x), x * (y @ s - k * (y @ mean))])  # noqa: E731, B023
                    mixed[6 * f : 6 * f + 6] = (one(u, w) + one(w, u)) / total
                h -= np.outer(mixed, mixed) / max(spread[j] - spread[i], 1e-12)
        values_, vectors = np.linalg.eigh(h)
        return self.scale * error, self.scale * (vectors * np.maximum(values_, 0)) @ vectors.T, self.scale * b


@dataclass
class PlaneFactor:
    """Bundle adjustment by least squares: the squared distances of all frames' points from the plane fitted at the current poses, in closed form of the frames' moments."""

    keys: tuple[int, ...]
    parts: list[tuple[int, np.ndarray, np.ndarray]]

    def linearize(self, values: dict[int, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        total, mean, cov, each = _pooled(self.parts, [values[k] for k in self.keys])
        u = np.linalg.eigh(cov)[1][:, 0]
        hat, n = lie.hat(u), 6 * len(self.keys)
        h, b = np.zeros((n, n)), np.zeros(n)
        for f, (k, second, s) in enumerate(each):
            at = slice(6 * f, 6 * f + 6)
            h[at, at] = np.block([[hat @ second @ hat.T, -np.outer(hat @ s, u)], [-np.outer(u, hat @ s), k * np.outer(u, u)]])
            b[at] = np.concatenate([-hat @ (second @ u - s * (u @ mean)), u * (u @ s - k * (u @ mean))])
        return float(total * (u @ cov @ u)), h, b


@dataclass
class Preintegrated:
    rotation: np.ndarray
    velocity: np.ndarray
    position: np.ndarray
    seconds: float


def preintegrate(samples: np.ndarray, acc_bias: np.ndarray | None = None, gyro_bias: np.ndarray | None = None) -> Preintegrated:
    """samples (ax, ay, az, wx, wy, wz, dt) in order, at a bias: raw samples are kept, so another bias integrates them anew."""
    ba, bg = np.zeros(3) if acc_bias is None else acc_bias, np.zeros(3) if gyro_bias is None else gyro_bias
    r, v, p, t = np.eye(3), np.zeros(3), np.zeros(3), 0.0
    for *_, dt in samples:
        row = _
        a, w = np.array(row[:3]) - ba, np.array(row[3:]) - bg
        p = p + v * dt + 0.5 * (r @ a) * dt * dt
        v = v + (r @ a) * dt
        r = r @ lie.so3_exp(w * dt)
        t += dt
    return Preintegrated(r, v, p, t)


GRAVITY = np.array([0.0, 0.0, -9.80665])


@dataclass
class InertialFactor:
    """Inertial samples between two states: keys pose, velocity, pose, velocity, bias (accelerations', then rates').

    Samples are kept, so that each bias integrates them anew; the Jacobian by the bias is thus exact at any bias.
    """

    keys: tuple[int, int, int, int, int]
    samples: np.ndarray
    weight: float | np.ndarray = 1.0
    gravity: np.ndarray | None = None

    def residual(self, a: np.ndarray, va: np.ndarray, b: np.ndarray, vb: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Rotation, velocity and position of the second state against those predicted."""
        g = GRAVITY if self.gravity is None else self.gravity
        d = preintegrate(self.samples, bias[:3], bias[3:])
        ra, t = a[:3, :3], d.seconds
        turn = lie.so3_log(d.rotation.T @ ra.T @ b[:3, :3])
        speed = ra.T @ (vb - va - g * t) - d.velocity
        place = ra.T @ (b[:3, 3] - a[:3, 3] - va * t - 0.5 * g * t * t) - d.position
        return np.concatenate([turn, speed, place])

    def linearize(self, values: dict[int, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
        return ResidualFactor(self.keys, self.residual, self.weight).linearize(values)


def bias_jacobian(samples: np.ndarray, acc_bias: np.ndarray, gyro_bias: np.ndarray) -> np.ndarray:
    """(9, 6): how rotation, velocity and position of a pre-integration change with the bias."""
    base = preintegrate(samples, acc_bias, gyro_bias)

    def f(d: np.ndarray) -> np.ndarray:
        out = preintegrate(samples, acc_bias + d[:3], gyro_bias + d[3:])
        return np.concatenate([lie.so3_log(base.rotation.T @ out.rotation), out.velocity, out.position])

    return numerical_jacobian(f, 6)


def preintegrate_segments(imu: DataFrame) -> DataFrame:
    """(segment, seconds, vx.., px.., rotation vector) of imu(segment, seq, ax.., wx.., dt); a segment lies between two poses and is short."""
    import pandas as pd

    names = ["ax", "ay", "az", "wx", "wy", "wz", "dt"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = preintegrate(pdf.sort_values("seq")[names].to_numpy())
        w = lie.so3_log(out.rotation)
        return pd.DataFrame([[pdf.segment.iloc[0], out.seconds, *out.velocity, *out.position, *w]], columns=["segment", "seconds", "vx", "vy", "vz", "px", "py", "pz", "rx", "ry", "rz"])

    return imu.groupBy("segment").applyInPandas(run, "segment long, " + ", ".join(f"{c} double" for c in ("seconds", "vx", "vy", "vz", "px", "py", "pz", "rx", "ry", "rz")))


def interpolation_residual(a: np.ndarray, b: np.ndarray, c: np.ndarray, t: float) -> np.ndarray:
    """How far c is from the pose at t between a and b."""
    return lie.se3_log(lie.between(lie.interpolate(a, b, t), c))


def calibration_residual(a: np.ndarray, b: np.ndarray, extrinsic: np.ndarray, motion: np.ndarray) -> np.ndarray:
    """A motion measured in a sensor against two poses of the body and the sensor's place on it."""
    return lie.se3_log(lie.between(motion, lie.inverse(extrinsic) @ lie.between(a, b) @ extrinsic))


def rotate_vector_residual(r: np.ndarray, local: np.ndarray, world: np.ndarray) -> np.ndarray:
    return r @ local - world


def similarity_residual(scale: float, sim: np.ndarray, pose: np.ndarray, motion: np.ndarray) -> np.ndarray:
    """Between a similarity (scale, rigid part) and a rigid pose: the scale acts on the relative translation."""
    relative = lie.between(sim, pose)
    relative = lie.pose(relative[..., :3, :3], relative[..., :3, 3] / scale)
    return lie.se3_log(lie.between(motion, relative))


def interpolation_factor(a: int, b: int, c: int, t: float, weight: float = 1.0) -> ResidualFactor:
    return ResidualFactor((a, b, c), lambda x, y, z: interpolation_residual(x, y, z, t), weight)


def calibration_factor(a: int, b: int, extrinsic: int, motion: np.ndarray, weight: float = 1.0) -> ResidualFactor:
    return ResidualFactor((a, b, extrinsic), lambda x, y, e: calibration_residual(x, y, e, motion), weight)


def rotate_vector_factor(key: int, local: np.ndarray, world: np.ndarray, weight: float = 1.0) -> ResidualFactor:
    return ResidualFactor((key,), lambda x: rotate_vector_residual(x[:3, :3], local, world), weight)


def similarity_factor(scale: int, sim: int, pose: int, motion: np.ndarray, weight: float = 1.0) -> ResidualFactor:
    """The scale is a vector of one number, its logarithm."""
    return ResidualFactor((scale, sim, pose), lambda s, x, y: similarity_residual(float(np.exp(s[0])), x, y, motion), weight)


def expression_factor(keys: tuple[int, ...], expression, measured: np.ndarray, weight: float | np.ndarray = 1.0) -> ResidualFactor:
    """Any expression of the keys' values against what was measured: a pose is compared by its logarithm, a vector by its difference."""

    def residual(*at: np.ndarray) -> np.ndarray:
        got = expression(*at)
        return lie.se3_log(lie.between(measured, got)) if np.ndim(got) == 2 else np.atleast_1d(got - measured)

    return ResidualFactor(keys, residual, weight)
