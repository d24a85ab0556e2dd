"""Large block-sparse systems solved where their blocks lie: rounds of elimination over independent sets, each a few joins."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schema import require_columns
from ..scratch import cut, drop

#: What is left is solved in one task when it has no more keys than this.
LAST = 200
#: Ranges of keys that are eliminated at once hold systems of about so many unknowns; ranges of more than four times as many are left to other rounds.
RANGE = 600


def _sums(column: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(column)[k]) for k in range(n)]).alias(column)


def block_table(entries: DataFrame, size: int) -> DataFrame:
    """(i, j, h array of size * size) from entries(i, j, row, col, value); entries of one place add up."""
    require_columns(entries, "i", "j", "row", "col", "value")
    at = F.col("row") * size + F.col("col")
    return entries.groupBy("i", "j").agg(F.array(*[F.coalesce(F.sum(F.when(at == k, F.col("value"))), F.lit(0.0)) for k in range(size * size)]).alias("h"))


def side_table(entries: DataFrame, size: int) -> DataFrame:
    """(i, b array of size) from entries(i, row, value)."""
    require_columns(entries, "i", "row", "value")
    return entries.groupBy("i").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("row") == k, F.col("value"))), F.lit(0.0)) for k in range(size)]).alias("b"))


def product(blocks: DataFrame, x: DataFrame, size: int) -> DataFrame:
    """(i, b): the matrix times x(i, x), a join on the columns' keys and a sum by the rows' keys."""
    parts = [reduce(lambda a, b: a + b, [F.col("h")[r * size + c] * F.col("x")[c] for c in range(size)]) for r in range(size)]
    moved = blocks.join(x.select(F.col("i").alias("j"), "x"), "j").select("i", F.array(*parts).alias("b"))
    return moved.groupBy("i").agg(_sums("b", size))


def residual(blocks: DataFrame, side: DataFrame, x: DataFrame, size: int) -> float:
    """The largest component of b - H x, over the largest of b."""
    both = side.join(product(blocks, x, size).withColumnRenamed("b", "hx"), "i", "left")
    off = [F.abs(F.col("b")[k] - F.coalesce(F.col("hx")[k], F.lit(0.0))) for k in range(size)]
    top = both.agg(F.max(F.array_max(F.array(*off))).alias("off"), F.max(F.array_max(F.transform("b", F.abs))).alias("most")).head()
    return 0.0 if not top.most else float(top.off / top.most)


def _chosen(blocks: DataFrame, turn: int) -> DataFrame:
    """(i) of an independent set: keys that come before all their neighbours, those of few neighbours first, equal ones by a hash of the round."""
    links = blocks.where("i <> j")
    order = F.struct(F.col("n"), F.xxhash64(F.col("i"), F.lit(turn)).alias("draw"), F.col("i").alias("key"))
    keys = blocks.groupBy("i").agg(F.count(F.lit(1)).alias("n")).select("i", order.alias("order"))
    first = links.join(keys.select(F.col("i").alias("j"), "order"), "j").groupBy("i").agg(F.min("order").alias("around"))
    return keys.join(first, "i", "left").where("around IS NULL OR order < around").select("i")


def _eliminate(size: int):
    """Rows of chosen keys to what they leave: gains H_ii^-1 H_ij, own H_ii^-1 b_i, and what is taken from the neighbours' blocks and sides."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for n, some in pdf.groupby(pdf.js.map(len)):  # rows of as many neighbours are one batch of small matrices
                diagonal = np.stack(some.d.to_list()).reshape(-1, size, size)
                b = np.stack(some.b.to_list())
                h = np.array([np.concatenate(x) if n else np.zeros(0) for x in some.hs]).reshape(-1, n, size, size)
                inverse = np.linalg.inv(diagonal)
                gains, own = inverse[:, None] @ h, np.einsum("nij,nj->ni", inverse, b)
                pairs = np.einsum("njba,nkbc->njkac", h, gains)
                sides = np.einsum("njba,nb->nja", h, own)
                out = {"gains": gains, "own": own, "pairs": pairs, "sides": sides}
                yield pd.DataFrame({"i": some.i.to_numpy(), "js": some.js.to_list()} | {k: list(v.reshape(len(some), -1)) for k, v in out.items()})

    return run


def _inside(blocks: DataFrame, width: int, most: int) -> DataFrame:
    """(i, part) of keys all of whose neighbours are of their own range of keys, in ranges of no more than `most` of them."""
    part = F.expr(f"i div {width}L")
    own = blocks.groupBy("i").agg(F.max(F.expr(f"j div {width}L") != part).alias("out"))
    own = own.where("NOT out").select("i", part.alias("part"))
    return own.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("part"))).where(F.col("n") <= most).drop("n")


def _eliminate_range(size: int):
    """The keys inside a range to what they leave, as _eliminate has it: gains and own of each, by the border keys of the range; what is taken from those is with the first key."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, first = np.unique(pdf.i, return_index=True)
        border = np.setdiff1d(pdf.j, keys)
        n, m = len(keys), len(border)
        inner, outer = np.zeros((n, size, n, size)), np.zeros((n, size, m, size))
        at, h = np.searchsorted(keys, pdf.i), np.stack(pdf.h.to_list()).reshape(-1, size, size)
        mine = np.isin(pdf.j, keys)
        np.add.at(inner.transpose(0, 2, 1, 3), (at[mine], np.searchsorted(keys, pdf.j[mine])), h[mine])
        np.add.at(outer.transpose(0, 2, 1, 3), (at[~mine], np.searchsorted(border, pdf.j[~mine])), h[~mine])
        b = np.stack(pdf.b.to_list())[first].reshape(-1, 1)
        outer = outer.reshape(n * size, m * size)
        x = np.linalg.solve(inner.reshape(n * size, n * size), np.hstack([outer, b]))
        gains, own = x[:, :-1].reshape(n, size, m, size).transpose(0, 2, 1, 3), x[:, -1].reshape(n, size)
        pairs = (outer.T @ x[:, :-1]).reshape(m, size, m, size).transpose(0, 2, 1, 3)
        none = np.zeros(0)
        rest = {"pairs": [pairs.ravel(), *[none] * (n - 1)], "sides": [outer.T @ x[:, -1], *[none] * (n - 1)]}
        return pd.DataFrame({"i": keys, "js": [border] * n, "gains": list(gains.reshape(n, -1)), "own": list(own)} | rest)

    return run


def _last(size: int):
    """The rest as one dense system; it has LAST keys at most."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf.i)
        h, b = np.zeros((len(keys), size, len(keys), size)), np.zeros((len(keys), size))
        for i, j, block in zip(np.searchsorted(keys, pdf.i), np.searchsorted(keys, pdf.j), pdf.h, strict=True):
            h[i, :, j] += np.asarray(block).reshape(size, size)
        for i, side in zip(np.searchsorted(keys, pdf.i), pdf.b, strict=True):
            if side is not None:
                b[i] = side
        x = np.linalg.solve(h.reshape(b.size, b.size), b.ravel())
        return pd.DataFrame({"i": keys, "x": list(x.reshape(len(keys), size))})

    return run


def solve(blocks: DataFrame, side: DataFrame, size: int = 6, last: int = LAST, most_rounds: int = 200) -> DataFrame:
    """(i, x array of size) with H x = b: blocks(i, j, h) of a symmetric positive definite matrix, both (i, j) and (j, i) given; side(i, b).

    As long as that takes a third of the keys, a round takes ranges of keys: a task eliminates all keys of its range that have no neighbour outside, so that
    a trajectory with short loops is down to a few keys a range at once, and ranges grow as keys get fewer. Where keys that are near are not linked, a round takes
    a set of keys of which no two are linked, those with few links first, and eliminates them at once: a task inverts their
    diagonal blocks in batches. What keys take from their neighbours is added by key. A chain loses a third of its keys in such a round, so
    there are about log(keys) rounds at most; the work of a key is the square of its links then. When `last` keys or fewer are left, a task solves
    them. Back substitution joins each round's keys with the values of their neighbours. No row of the system comes to the driver; each round is
    a table, so a lost executor costs one. Keys without a side have b = 0. A matrix that is not definite raises numpy's LinAlgError or gives no finite values.
    """
    require_columns(blocks, "i", "j", "h")
    require_columns(side, "i", "b")
    n2 = size * size
    zero = F.array(*[F.lit(0.0)] * size)
    system, sides = cut(blocks.select("i", "j", "h"), "blocks"), cut(side.select("i", "b"), "side")
    done: list[DataFrame] = []
    ranges, inside = True, None
    for turn in range(most_rounds):
        keys, lo, hi = system.agg(F.count_distinct("i"), F.min("i"), F.max("i")).head()
        if keys <= last:
            break
        schema = "i long, js array<long>, gains array<double>, own array<double>, pairs array<double>, sides array<double>"
        if ranges:
            each = max(RANGE // size, 2)
            inside = cut(_inside(system, max((hi - lo + 1) * each // keys, 1), 4 * each), "inside")
            ranges = 3 * inside.count() >= keys
        chosen = inside.select("i") if ranges else cut(_chosen(system, turn), "chosen")
        mine = system.join(chosen, "i").groupBy("i").agg(
            F.max(F.when(F.col("i") == F.col("j"), F.col("h"))).alias("d"), F.collect_list(F.when(F.col("i") != F.col("j"), F.struct("j", "h"))).alias("links")
        )
        mine = mine.join(sides, "i", "left").select("i", "d", F.coalesce("b", zero).alias("b"), F.col("links.j").alias("js"), F.col("links.h").alias("hs"))
        rows = system.join(inside, "i").join(sides, "i", "left").select("part", "i", "j", "h", F.coalesce("b", zero).alias("b")) if ranges else None
        gone = cut(rows.groupBy("part").applyInPandas(_eliminate_range(size), schema) if ranges else mine.mapInPandas(_eliminate(size), schema), "eliminated")
        done.append(gone)
        drop_to = chosen.select(F.col("i").alias("j"))
        kept = system.join(chosen, "i", "left_anti").join(drop_to, "j", "left_anti").select("i", "j", "h")
        degree = F.size("js")
        each = gone.where((degree > 0) & (F.size("pairs") > 0)).withColumn("p", F.explode(F.sequence(F.lit(0), degree * degree - 1)))
        taken = each.select(F.get("js", (F.col("p") / degree).cast("int")).alias("i"), F.get("js", F.col("p") % degree).alias("j"), F.transform(F.slice("pairs", F.col("p") * n2 + 1, n2), lambda v: -v).alias("h"))
        one = gone.where((degree > 0) & (F.size("pairs") > 0)).withColumn("p", F.explode(F.sequence(F.lit(0), degree - 1)))
        less = one.select(F.get("js", F.col("p")).alias("i"), F.transform(F.slice("sides", F.col("p") * size + 1, size), lambda v: -v).alias("b"))
        before = (system, sides)
        system = cut(kept.unionByName(taken).groupBy("i", "j").agg(_sums("h", n2)), "blocks")
        sides = cut(sides.join(chosen, "i", "left_anti").unionByName(less).groupBy("i").agg(_sums("b", size)), "side")
        for old in (*before, inside, chosen):
            drop(old)
        inside = None
    else:
        raise RuntimeError(f"{keys} keys are left after {most_rounds} rounds")
    rest = system.join(sides, "i", "left").withColumn("all", F.lit(0))
    x = cut(rest.groupBy("all").applyInPandas(_last(size), "i long, x array<double>"), "x")
    known = [x]
    for gone in reversed(done):
        at = gone.select("i", "own", "gains", F.posexplode_outer("js").alias("p", "j"))
        # a neighbour is of a later round, so its value is known
        solved = reduce(lambda a, b: a.unionByName(b), known)
        block = F.slice("gains", F.col("p") * n2 + 1, n2)
        parts = [reduce(lambda a, b: a + b, [block[r * size + c] * F.col("x")[c] for c in range(size)]) for r in range(size)]
        moved = at.where("j IS NOT NULL").join(solved.select(F.col("i").alias("j"), "x"), "j").select("i", F.array(*parts).alias("x")).groupBy("i").agg(_sums("x", size))
        minus = F.array(*[F.col("own")[k] - F.coalesce(F.col("m")[k], F.lit(0.0)) for k in range(size)])
        known.append(cut(gone.select("i", "own").join(moved.withColumnRenamed("x", "m"), "i", "left").select("i", minus.alias("x")), "x"))
        drop(gone)
    return reduce(lambda a, b: a.unionByName(b), known)
