"""Distributed union-find: connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: From so few edges on, one task ends the contraction: 16 bytes an edge, so 1 MB at most.
LAST_EDGES = 65_536


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the edges a[i] - b[i]."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = inverse[: len(a)], inverse[len(a) :]
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (up := label[label] != label).any():
            label[up] = label[label[up]]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[label]


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch of edges as a star forest with the same components."""
    for pdf in batches:
        nodes, roots = union_find(pdf.a.to_numpy(), pdf.b.to_numpy())
        other = nodes != roots
        yield pd.DataFrame({"a": nodes[other], "b": roots[other]})


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = pd.concat([*batches, pd.DataFrame({"a": [], "b": []}, dtype="int64")])
    nodes, roots = union_find(whole.a.to_numpy("int64"), whole.b.to_numpy("int64"))
    yield pd.DataFrame({"node": nodes, "root": roots})


def components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, root) for every node of edges(a long, b long); root: the smallest node of the component.

    Batches are thinned to forests first. While more than last_edges edges stay, each node is merged
    into its neighbour of lowest random rank (drawn anew each round), which leaves a constant share
    of the nodes; the maps are then composed backwards. Self-links, repeats and nulls are allowed:
    links with a null end are ignored, a self-link alone gives a node of its own. No table that grows with
    the edges is broadcast.
    """
    edges = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null"), "links")
    own = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    now = materialize(edges.where("a <> b").mapInPandas(_forest, "a long, b long"), "edges")
    maps: list[DataFrame] = []
    while now.count() > last_edges:
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(maps))).alias("rank"), c.alias("id"))  # noqa: E731, B023
        both = now.union(now.select("b", "a"))
        low = materialize(
            both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"))
            .select("node", F.least(F.col("m"), rank(F.col("node")))["id"].alias("up")),
            "map",
        )
        maps.append(low)
        at = lambda side, new: low.select(F.col("node").alias(side), F.col("up").alias(new)).hint("merge")  # noqa: E731, B023
        moved = now.join(at("a", "ua"), "a").select("b", "ua").join(at("b", "ub"), "b").where("ua <> ub")
        now = materialize(moved.select(F.col("ua").alias("a"), F.col("ub").alias("b")).mapInPandas(_forest, "a long, b long"), "edges")
    roots = now.repartition(1).mapInPandas(_finish, "node long, root long")
    for low in reversed(maps):
        known = materialize(roots, "roots")
        top = known.select(F.col("node").alias("up"), "root")
        roots = low.join(top.hint("merge"), "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    if maps:  # the random ranks chose the roots; the smallest node is the name
        roots = materialize(roots, "roots")
        name = materialize(roots.groupBy("root").agg(F.min(F.least("node", "root")).alias("name")), "names")
        roots = roots.join(name.hint("merge"), "root").select("node", F.col("name").alias("root"))
    return roots.union(own.distinct().join(roots.select("node").hint("merge"), "node", "left_anti"))
