"""Many scan-matching factors in one plan, with correspondences that are kept while their factor moves little."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import lie
from ..operators.neighbors import radius_search
from ..operators.rows import Matrix
from ..schema import COV, NORMAL, XYZ, require_columns
from ..scratch import cut, drop
from .factors import BROADCAST_MOTIONS, DIFFERENCE, SOURCE_COV, TARGET_COV, motions_table
from .linearize import IDENTITY_WEIGHT, P, R, WEIGHT, collect
from .optimize import HOOKS, ScanFactor

#: What a kind of factor needs of source and target besides places, and its weight.
KINDS = {
    "icp": ((), (), IDENTITY_WEIGHT),
    "plane": ((), NORMAL, ("tnx * tnx", "0.0", "0.0", "tny * tny", "0.0", "tnz * tnz")),
    "gicp": (COV, COV, E.inverse([f"({s} + {t})" for s, t in zip(SOURCE_COV, TARGET_COV, strict=True)])),
}


@dataclass
class MatchedGroup:
    """All factors of a kind over source(factor_id, point_id, ...) and target(point_id, ...), which has a factor_id too unless all share it.

    A source point and its nearest target point within max_distance are kept side by side in one table, made by one join for all factors
    that need it. A factor's part is made anew only when its motion is more than `rotation` (radians) or `translation` away from
    that which it was made at; with both zero, at every other motion. From the table, residual rows of all factors are one scan and a join with
    the motions: no search, and a plan that does not grow with the factors. `joins` counts the searches.
    """

    kind: str
    source: DataFrame
    target: DataFrame
    max_distance: float = 1.0
    rotation: float = 0.0
    translation: float = 0.0
    joins: int = 0
    made: dict[int, np.ndarray] = field(default_factory=dict)
    table: DataFrame | None = None

    def __post_init__(self) -> None:
        mine, theirs, _ = KINDS[self.kind]
        require_columns(self.source, "factor_id", "point_id", *XYZ, *mine)
        require_columns(self.target, "point_id", *XYZ, *theirs)

    def stale(self, motions: dict[int, Matrix]) -> list[int]:
        """The factors whose correspondences have to be sought for these motions."""
        out = []
        for k, m in motions.items():
            if k not in self.made:
                out.append(k)
                continue
            step = lie.between(self.made[k], np.asarray(m, float))
            if np.linalg.norm(step[:3, 3]) > self.translation or np.linalg.norm(lie.so3_log(step[:3, :3])) > self.rotation:
                out.append(k)
        return out

    def _motions(self, motions: dict[int, Matrix]) -> DataFrame:
        table = motions_table(self.source.sparkSession, motions)
        return F.broadcast(table) if len(motions) <= BROADCAST_MOTIONS else table

    def update(self, motions: dict[int, Matrix]) -> None:
        """Seek the correspondences of the factors that moved too far; the others' stay."""
        stale = self.stale(motions)
        if not stale:
            return
        self.joins += 1
        mine, theirs, _ = KINDS[self.kind]
        chosen = self._motions({k: motions[k] for k in stale})
        moved = [F.expr(" + ".join([f"m{i}{j} * {XYZ[j]}" for j in range(3)] + [f"m{i}3"])).alias(f"q{c}") for i, c in enumerate(XYZ)]
        by = ("factor_id",) if "factor_id" in self.target.columns else ()
        # what a match needs of both points travels in their keys, so that it is joined with neither again
        source = F.struct("factor_id", F.col("point_id").alias("src_id"), *[F.col(c).alias(f"o{c}") for c in (*XYZ, *mine)])
        target = F.struct(F.col("point_id").alias("tgt_id"), *[F.col(c).alias(f"q{i}") for i, c in enumerate(XYZ)], *[F.col(c).alias(f"t{c}") for c in theirs])
        queries = self.source.join(chosen, "factor_id").select(*by, source.alias("qid"), *moved)
        near = radius_search(queries, self.target.select(*by, target.alias("point_id"), *XYZ), self.max_distance, 1, by)
        found = near.select("qid.*", "point_id.*")
        before = self.table
        if before is not None:
            again = self.source.sparkSession.createDataFrame([(k,) for k in stale], "factor_id long")
            found = before.join(again, "factor_id", "left_anti").unionByName(found)
        self.table = cut(found, "correspondences")
        drop(before)
        self.made |= {k: np.array(motions[k], float) for k in stale}

    def rows(self, motions: dict[int, Matrix]) -> DataFrame:
        """The residual rows of all factors at their motions, for linearize."""
        self.update(motions)
        mine, _, weight = KINDS[self.kind]
        placed = self.table.join(self._motions(motions), "factor_id")
        at = [F.expr(" + ".join([f"m{i}{j} * o{XYZ[j]}" for j in range(3)] + [f"m{i}3"])).alias(P[i]) for i in range(3)]
        turned = []
        if mine:
            c = E.symmetric([f"o{x}" for x in COV])
            pairs = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
            turned = [F.expr(" + ".join(f"m{i}{k} * m{j}{n} * {c[k][n]}" for k in range(3) for n in range(3))).alias(SOURCE_COV[x]) for x, (i, j) in enumerate(pairs)]
        goal = [c for c in self.table.columns if c.startswith(("q", "t")) and c != "tgt_id"]
        made = placed.select("factor_id", "src_id", "tgt_id", *goal, *at, *turned)
        return made.select("factor_id", "src_id", "tgt_id", *P, *[F.expr(e).alias(n) for n, e in zip(R, DIFFERENCE, strict=True)], *[F.expr(e).cast("double").alias(n) for n, e in zip(WEIGHT, weight, strict=True)])

    def release(self) -> None:
        drop(self.table)
        self.table, self.made = None, {}


@dataclass
class MatchedFactor:
    """One factor of a group in a graph: source key b is matched in the frame of a (None: fixed target)."""

    group: MatchedGroup
    id: int
    b: int
    a: int | None = None

    keys = ScanFactor.keys
    motion = ScanFactor.motion
    expand = ScanFactor.expand


def _linearize(factors: list[MatchedFactor], values: dict[int, np.ndarray]) -> list:
    """One job for each group, whatever the number of its factors."""
    groups = {id(f.group): f.group for f in factors}
    found = {k: collect(g.rows({f.id: f.motion(values) for f in factors if f.group is g})) for k, g in groups.items()}
    out = []
    for f in factors:
        n, linear = 6 * len(f.keys), found[id(f.group)].get(f.id)
        out.append(f.expand(linear, values) if linear else (0.0, np.zeros((n, n)), np.zeros(n)))
    return out


HOOKS.register(MatchedFactor, _linearize)
