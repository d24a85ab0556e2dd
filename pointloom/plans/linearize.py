"""The central aggregate: residual rows of any factors to one Hessian, gradient and error for each factor.

A residual row has factor_id, the residual r0..r2, the moved point p0..p2 and the weight w00..w22 (upper triangle
of a symmetric 3x3). A motion is perturbed from the left by (rotation, translation): p changes by w x p + v, so the
residual q - p has the Jacobian [hat(p), -I]. All of H, b and the error are sums of columns: they fold in each task
and one row a factor is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E

R, P, WEIGHT = ("r0", "r1", "r2"), ("p0", "p1", "p2"), ("w00", "w01", "w02", "w11", "w12", "w22")
JACOBIAN = [["", "-p2", "p1", "-1.0", "", ""], ["p2", "", "-p0", "", "-1.0", ""], ["-p1", "p0", "", "", "", "-1.0"]]
IDENTITY_WEIGHT = ("1.0", "0.0", "0.0", "1.0", "0.0", "1.0")


@dataclass
class Linear:
    """A quadratic in the motion's perturbation: error + 2 b'd + d'Hd (all without the half)."""

    n: int
    error: float
    h: np.ndarray
    b: np.ndarray


def _sum(terms: list[str]) -> str:
    return "(" + (" + ".join(terms) or "0.0") + ")"


def terms() -> dict[str, str]:
    """The expression of each sum, by name."""
    w = E.symmetric(WEIGHT)
    wj = [[_sum([f"{w[i][k]} * ({JACOBIAN[k][c]})" for k in range(3) if JACOBIAN[k][c]]) for c in range(6)] for i in range(3)]
    wr = [_sum([f"{w[i][k]} * {R[k]}" for k in range(3)]) for i in range(3)]
    out = {f"h{a}{c}": _sum([f"({JACOBIAN[i][a]}) * {wj[i][c]}" for i in range(3) if JACOBIAN[i][a]]) for a in range(6) for c in range(a, 6)}
    out |= {f"b{a}": _sum([f"({JACOBIAN[i][a]}) * {wr[i]}" for i in range(3) if JACOBIAN[i][a]]) for a in range(6)}
    return out | {"error": _sum([f"{R[i]} * {wr[i]}" for i in range(3)])}


def errors(rows: DataFrame) -> DataFrame:
    """(factor_id, n_inliers, error): the sum of r'Wr."""
    return rows.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n_inliers"), F.sum(F.expr(terms()["error"])).alias("error"))


def linearized(rows: DataFrame) -> DataFrame:
    """(factor_id, n_inliers, error, h00..h55 upper triangle, b0..b5)."""
    return rows.groupBy("factor_id").agg(F.count(F.lit(1)).alias("n_inliers"), *[F.sum(F.expr(e)).alias(n) for n, e in terms().items()])


def collect(rows: DataFrame) -> dict[int, Linear]:
    """One job for all factors; one row each reaches the driver."""
    out = {}
    for r in linearized(rows).collect():
        h = np.zeros((6, 6))
        for a in range(6):
            for c in range(a, 6):
                h[a, c] = h[c, a] = r[f"h{a}{c}"]
        out[r.factor_id] = Linear(r.n_inliers, r.error, h, np.array([r[f"b{a}"] for a in range(6)]))
    return out


def inlier_fraction(rows: DataFrame, n_source: int) -> DataFrame:
    return rows.groupBy("factor_id").agg((F.count(F.lit(1)) / n_source).alias("fraction"))


def system_blocks(linear: DataFrame, keys: DataFrame) -> DataFrame:
    """(i, j, row, col, value): the blocks of all factors added up by key, as coordinates of a sparse system.

    linear: linearized(); keys(factor_id, sign_a, a, b): a factor on the motion between poses a and b has +H on both
    diagonal blocks and -H between them; one on b alone has a null a.
    """
    entries = [F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.col(f"h{min(r, c)}{max(r, c)}").alias("value")) for r in range(6) for c in range(6)]
    cells = linear.join(keys, "factor_id").select("a", "b", F.explode(F.array(*entries)).alias("e"))
    both = F.filter(F.array(
        F.struct(F.col("b").alias("i"), F.col("b").alias("j"), F.col("e.value").alias("value")), F.struct(F.col("a").alias("i"), F.col("a").alias("j"), F.col("e.value").alias("value")),
        F.struct(F.col("a").alias("i"), F.col("b").alias("j"), (-F.col("e.value")).alias("value")), F.struct(F.col("b").alias("i"), F.col("a").alias("j"), (-F.col("e.value")).alias("value")),
    ), lambda x: x["i"].isNotNull() & x["j"].isNotNull())
    spread = cells.select(F.col("e.row").alias("row"), F.col("e.col").alias("col"), F.explode(both).alias("s"))
    return spread.groupBy(F.col("s.i").alias("i"), F.col("s.j").alias("j"), "row", "col").agg(F.sum("s.value").alias("value"))
