"""Rotations and rigid motions as numpy arrays: SO(3) and SE(3) maps, quaternions, interpolation. All but the quaternions take stacks of any shape."""

from __future__ import annotations

import numpy as np


_EYE = np.eye(3)


def hat(w: np.ndarray) -> np.ndarray:
    w = np.asarray(w, float)
    out = np.zeros((*w.shape, 3))
    out[..., 2, 1], out[..., 0, 2], out[..., 1, 0] = w[..., 0], w[..., 1], w[..., 2]
    out[..., 1, 2], out[..., 2, 0], out[..., 0, 1] = -w[..., 0], -w[..., 1], -w[..., 2]
    return out


def _turned(w: np.ndarray, small: float, first: tuple, second: tuple) -> np.ndarray:
    """1 + f k + g k^2 for k = hat(w), with f and g as (value for small angles, function of the angle)."""
    k = hat(w)
    angle = np.sqrt((w * w).sum(-1))[..., None, None]
    tiny = angle < small
    if not tiny.any():
        return _EYE + first[1](angle) * k + second[1](angle) * k @ k
    safe = np.where(tiny, 1.0, angle)
    f, g = (np.where(tiny, low, of(safe)) for low, of in (first, second))
    return _EYE + f * k + g * k @ k


def so3_exp(w: np.ndarray) -> np.ndarray:
    return _turned(np.asarray(w, float), 1e-8, (1.0, lambda a: np.sin(a) / a), (0.5, lambda a: (1 - np.cos(a)) / a**2))


def _half_turn(r: np.ndarray, angle: float, v: np.ndarray) -> np.ndarray:
    """The logarithm of a rotation by nearly half a turn: the axis is in the symmetric part."""
    s = (r + np.eye(3)) / 2
    axis = s[:, np.argmax(np.diag(s))]
    axis = axis / np.linalg.norm(axis)
    return angle * (axis if axis @ v >= 0 else -axis)


def so3_log(r: np.ndarray) -> np.ndarray:
    angle = np.arccos(np.minimum(np.maximum((r[..., 0, 0] + r[..., 1, 1] + r[..., 2, 2] - 1) / 2, -1), 1))
    v = np.empty(r.shape[:-1])
    v[..., 0], v[..., 1], v[..., 2] = r[..., 2, 1] - r[..., 1, 2], r[..., 0, 2] - r[..., 2, 0], r[..., 1, 0] - r[..., 0, 1]
    half, tiny = np.pi - angle < 1e-5, angle < 1e-6
    plain = np.where(tiny | half, 1.0, angle)
    out = np.where(tiny, 0.5, plain / (2 * np.sin(plain)))[..., None] * v
    for at in np.argwhere(half) if half.any() else ():
        at = tuple(at)
        out[at] = _half_turn(r[at], angle[at], v[at])
    return out


def left_jacobian(w: np.ndarray) -> np.ndarray:
    return _turned(np.asarray(w, float), 1e-6, (0.5, lambda a: (1 - np.cos(a)) / a**2), (1 / 6, lambda a: (a - np.sin(a)) / a**3))


def pose(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.zeros((*np.shape(r)[:-2], 4, 4))
    out[..., :3, :3], out[..., :3, 3], out[..., 3, 3] = r, t, 1.0
    return out


def _times(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    return (r @ np.asarray(t)[..., None])[..., 0]


def se3_exp(xi: np.ndarray) -> np.ndarray:
    """xi: rotation vector, then translation part."""
    xi = np.asarray(xi, float)
    w, v = xi[..., :3], xi[..., 3:]
    k, a2 = hat(w), (w * w).sum(-1)
    small = a2 < 1e-12
    a2 = np.where(small, 1.0, a2)
    a = np.sqrt(a2)
    sine, f = np.where(small, 1.0, np.sin(a) / a), np.where(small, 0.5, (1 - np.cos(a)) / a2)[..., None, None]
    g = np.where(small, 1 / 6, (1 - sine) / a2)[..., None, None]
    square = k @ k
    out = np.zeros((*xi.shape[:-1], 4, 4))
    out[..., :3, :3] = _EYE + sine[..., None, None] * k + f * square
    out[..., :3, 3] = v + ((f * k + g * square) @ v[..., None])[..., 0]
    out[..., 3, 3] = 1.0
    return out


def se3_log(m: np.ndarray) -> np.ndarray:
    """The inverse of the left Jacobian is 1 - k / 2 + g k^2, k = hat(w), with g = (1 - a / 2 cot(a / 2)) / a^2."""
    w, t = so3_log(m[..., :3, :3]), m[..., :3, 3]
    a2 = (w * w).sum(-1)
    tiny = a2 < 1e-8
    a = np.sqrt(np.where(tiny, 1.0, a2))
    g = np.where(tiny, 1 / 12, (1 - a / (2 * np.tan(a / 2))) / (a * a))
    k = hat(w)
    once = (k @ t[..., None])[..., 0]
    out = np.empty((*w.shape[:-1], 6))
    out[..., :3], out[..., 3:] = w, t - once / 2 + g[..., None] * (k @ once[..., None])[..., 0]
    return out


def inverse(m: np.ndarray) -> np.ndarray:
    back = np.swapaxes(m[..., :3, :3], -1, -2)
    return pose(back, -_times(back, m[..., :3, 3]))


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return inverse(a) @ b


def interpolate(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """On the geodesic from a (t = 0) to b (t = 1)."""
    return a @ se3_exp(t * se3_log(between(a, b)))


def from_quaternion(q: np.ndarray) -> np.ndarray:
    """Rotation of a quaternion x, y, z, w (normalised first)."""
    x, y, z, w = np.asarray(q, float) / np.linalg.norm(q)
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])


def to_quaternion(r: np.ndarray) -> np.ndarray:
    """x, y, z, w with w >= 0, from the eigenvector of the symmetric 4x4 form."""
    m = np.array([
        [r[0, 0] - r[1, 1] - r[2, 2], 0, 0, 0], [r[0, 1] + r[1, 0], r[1, 1] - r[0, 0] - r[2, 2], 0, 0],
        [r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], r[2, 2] - r[0, 0] - r[1, 1], 0],
        [r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1], r[0, 0] + r[1, 1] + r[2, 2]],
    ])
    q = np.linalg.eigh(m / 3)[1][:, -1]
    return q if q[3] >= 0 else -q
