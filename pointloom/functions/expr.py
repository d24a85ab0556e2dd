"""Expressions in the SQL that Spark shares with other engines: each function returns a string for F.expr()."""

from __future__ import annotations

from collections.abc import Sequence

#: A voxel key packs three coordinates of 21 bits, shifted by OFFSET so that they are positive.
OFFSET, SIDE = 1 << 20, 1 << 21


def voxel(x: str, resolution: float) -> str:
    """The voxel coordinate of x: the product with the inverse resolution, rounded down."""
    return f"CAST(floor({x} * {1.0 / resolution!r}) AS BIGINT)"


def finite(*xs: str) -> str:
    """Neither null, NaN nor infinite, and within the range that a voxel coordinate can hold."""
    return "(" + " AND ".join(f"coalesce(abs({x}) < 1e15, FALSE)" for x in xs) + ")"


def pack(vx: str, vy: str, vz: str) -> str:
    """Voxel coordinates as one BIGINT; null out of range."""
    ok = " AND ".join(f"{v} BETWEEN {-OFFSET} AND {OFFSET - 1}" for v in (vx, vy, vz))
    return f"CASE WHEN {ok} THEN ({vx} + {OFFSET}) * {SIDE * SIDE} + ({vy} + {OFFSET}) * {SIDE} + ({vz} + {OFFSET}) END"


def voxel_key(resolution: float, x: str = "x", y: str = "y", z: str = "z") -> str:
    return f"CASE WHEN {finite(x, y, z)} THEN {pack(*(voxel(c, resolution) for c in (x, y, z)))} END"


def dot(a: Sequence[str], b: Sequence[str]) -> str:
    return "(" + " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True)) + ")"


def cross(a: Sequence[str], b: Sequence[str]) -> list[str]:
    return [f"(({a[i]}) * ({b[j]}) - ({a[j]}) * ({b[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]


def minus(a: Sequence[str], b: Sequence[str]) -> list[str]:
    return [f"(({x}) - ({y}))" for x, y in zip(a, b, strict=True)]


def norm2(a: Sequence[str]) -> str:
    return dot(a, a)


def moved(m: Sequence[Sequence[float]], x: Sequence[str], shift: bool = True) -> list[str]:
    """Rows of a 3x4 (or 4x4) matrix applied to a point (shift) or a direction."""
    return ["(" + " + ".join([f"{float(m[i][j])!r} * {x[j]}" for j in range(3)] + ([repr(float(m[i][3]))] if shift else [])) + ")" for i in range(3)]


COV = ("c00", "c01", "c02", "c11", "c12", "c22")


def symmetric(c: Sequence[str]) -> list[list[str]]:
    """A 3x3 matrix from its upper triangle by rows."""
    return [[c[0], c[1], c[2]], [c[1], c[3], c[4]], [c[2], c[4], c[5]]]


def rotated_cov(m: Sequence[Sequence[float]], c: Sequence[str] = COV) -> list[str]:
    """The upper triangle of A C A' for the 3x3 part of m."""
    s = symmetric(c)
    return ["(" + " + ".join(f"{float(m[i][k] * m[j][n])!r} * {s[k][n]}" for k in range(3) for n in range(3)) + ")" for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def inverse(c: Sequence[str]) -> list[str]:
    """The upper triangle of the inverse of a symmetric 3x3 matrix, by cofactors."""
    a, b, d, e, f, g = (f"({x})" for x in c)
    det = f"({a} * ({e} * {g} - {f} * {f}) - {b} * ({b} * {g} - {f} * {d}) + {d} * ({b} * {f} - {e} * {d}))"
    parts = (f"{e} * {g} - {f} * {f}", f"{d} * {f} - {b} * {g}", f"{b} * {f} - {d} * {e}", f"{a} * {g} - {d} * {d}", f"{b} * {d} - {a} * {f}", f"{a} * {e} - {b} * {b}")
    return [f"(({p}) / {det})" for p in parts]


def eigenvalues(c: Sequence[str]) -> list[str]:
    """Of a symmetric 3x3 matrix, ascending, in closed form."""
    a, b, d, e, f, g = (f"({x})" for x in c)
    q = f"(({a} + {e} + {g}) / 3.0)"
    p = f"sqrt((({a} - {q}) * ({a} - {q}) + ({e} - {q}) * ({e} - {q}) + ({g} - {q}) * ({g} - {q}) + 2.0 * ({b} * {b} + {d} * {d} + {f} * {f})) / 6.0)"
    x, y, z = (f"({v} - {q})" for v in (a, e, g))
    det = f"({x} * ({y} * {z} - {f} * {f}) - {b} * ({b} * {z} - {f} * {d}) + {d} * ({b} * {f} - {y} * {d}))"
    phi = f"(acos(least(1.0, greatest(-1.0, {det} / (2.0 * greatest({p} * {p} * {p}, 1e-300))))) / 3.0)"
    high, low = f"({q} + 2.0 * {p} * cos({phi}))", f"({q} + 2.0 * {p} * cos({phi} + 2.0943951023931953))"
    return [low, f"(3.0 * {q} - {high} - {low})", high]
