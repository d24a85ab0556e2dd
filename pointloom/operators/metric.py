"""Nearest neighbours among feature vectors: partitions round pivots, pruned by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import require_columns
from ..scratch import cut, drop
from .neighbors import top_k

#: Pivots are fitted on the vectors of so many rows at most, those first in a seeded order.
SAMPLE = 16_384
#: A pivot for each so many rows, but never more than MOST_PIVOTS: what is known of pivots travels with every task.
ROWS_A_PIVOT, MOST_PIVOTS = 2_048, 1_024
#: Rows, and queries, that meet in one task at most, on average, and bytes of each as a matrix; larger partitions are divided. STRIP rows are compared at a time.
CROWD, BLOCK_BYTES, STRIP = 100_000, 32 << 20, 8_192


def _vectors(df: DataFrame) -> Column:
    """f in single precision where it is so, else in double; distances are in double always."""
    return F.col("f") if dict(df.dtypes)["f"] == "array<float>" else F.col("f").cast("array<double>").alias("f")


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A row for each vector."""
    flat = np.asarray(column.flatten(), float)
    width = width if width is not None else len(flat) // max(len(column), 1)
    if len(flat) != width * len(column) or pc.list_value_length(column).value_counts().__len__() > 1:
        raise ValueError("feature vectors must have one length")
    return flat.reshape(len(column), width)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y, but for rounding."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)


def _centres(sample: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """n centres of the sample; its first rows to begin with."""
    centres = sample[:n].copy()
    for _ in range(rounds if len(centres) > 1 else 0):
        home = np.concatenate([_squares(part, centres).argmin(1) for part in np.array_split(sample, -(-len(sample) // 2048))])
        sums, counts = np.zeros_like(centres), np.bincount(home, minlength=len(centres))
        np.add.at(sums, home, sample)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass
class MetricIndex:
    """Every row lies in the partition of its nearest pivot, with its distance from it; sizes, least and greatest distances are kept by partition."""

    pivots: np.ndarray
    sizes: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: DataFrame | None  # pivot, point_id, away, f
    blocks: Blocks | None = None  # of a search

    @property
    def slack(self) -> float:
        """More than the rounding of a distance from a pivot."""
        return 1e-6 * (1.0 + float(np.abs(self.pivots).max(initial=0.0))) * max(self.pivots.shape[1], 1) ** 0.5

    def release(self) -> None:
        drop(self.rows)


def build_index(points: DataFrame, rows_a_pivot: int = ROWS_A_PIVOT, sample: int = SAMPLE, seed: int = 7) -> MetricIndex:
    """The index of points(point_id, f); rows without a vector are left out. All others are in it, wherever the sample's came from."""
    require_columns(points, "point_id", "f")
    points = points.select("point_id", _vectors(points)).where("f IS NOT NULL")
    n = points.count()
    drawn = points.orderBy(F.xxhash64("point_id", F.lit(seed)), "point_id").limit(sample).select("f").toArrow().column("f").combine_chunks() if n else pa.array([], pa.list_(pa.float64()))
    if not n:
        return MetricIndex(np.zeros((0, 0)), np.zeros(0), np.zeros(0), np.zeros(0), None)
    pivots = _centres(_matrix(drawn), min(max(1, n // rows_a_pivot), MOST_PIVOTS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), pivots.shape[1])
            home = _squares(x, pivots).argmin(1) if len(x) else np.zeros(0, int)
            away = np.sqrt(((x - pivots[home]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), batch.column(0), pa.array(away), batch.column(1)], ["pivot", "point_id", "away", "f"])

    rows = cut(points.mapInArrow(assign, f"pivot int, point_id {dict(points.dtypes)['point_id']}, away double, f {dict(points.dtypes)['f']}"), "metric-index")
    stats = np.zeros((3, len(pivots)))
    for r in rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("least"), F.max("away").alias("most")).collect():  # a row a pivot
        stats[:, r.pivot] = r.n, r.least, r.most
    return MetricIndex(pivots, stats[0], stats[1], stats[2], rows)


def _homes(index: MetricIndex, x: np.ndarray, k: int) -> np.ndarray:
    """Which partitions each vector visits first: its nearest ones, until they have k rows."""
    d = _squares(x, index.pivots)
    order = d.argsort(1, kind="stable")
    before = index.sizes[order].cumsum(1) - index.sizes[order]
    first = np.zeros(d.shape, bool)
    np.put_along_axis(first, order, before < k, 1)
    return first


def _within(index: MetricIndex, x: np.ndarray, bound: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the chosen partitions can have a row within each vector's bound, a squared distance; and how far their pivots are."""
    d, reach = np.sqrt(_squares(x, index.pivots)), np.sqrt(bound)[:, None] + index.slack
    mine = d[:, chosen]
    # no row of a partition is nearer than its ring, nor than the border between the two pivots
    return (mine - index.most[chosen] <= reach) & (index.least[chosen] - mine <= reach) & ((mine - d.min(1, keepdims=True)) / 2 <= reach), mine


@dataclass
class Blocks:
    """How partitions are put into blocks: those next to each other along the pivots' longest direction share one; a large one is divided into several by its rows."""

    first: np.ndarray  # of each pivot, its first block
    parts: np.ndarray  # and the number of its blocks
    n: int

    @staticmethod
    def of(index: MetricIndex, rows: int) -> Blocks:
        middle = index.pivots - index.pivots.mean(0)
        order = (middle @ np.linalg.svd(middle, full_matrices=False)[2][0]).argsort(kind="stable") if len(middle) > 1 else np.zeros(1, int)
        first, parts, n, held = np.zeros(len(order), int), np.ones(len(order), int), 0, 0
        for pivot in order:
            size = int(index.sizes[pivot])
            if held and held + size > rows:
                n, held = n + 1, 0
            first[pivot], parts[pivot] = n, max(1, -(-size // rows))
            held += size
            if parts[pivot] > 1:
                n, held = n + parts[pivot], 0
        return Blocks(first, parts, n + (held > 0))


def _tasks(spark: SparkSession) -> int:
    return 3 * spark.sparkContext.defaultParallelism


def _most(index: MetricIndex) -> int:
    """Rows, or queries, of a task."""
    return max(1, min(CROWD, BLOCK_BYTES // (8 * max(index.pivots.shape[1], 1))))


def _visits(index: MetricIndex, queries: DataFrame, k: int, first: bool) -> DataFrame:
    """(block, qid, f, bound): each of queries(qid, f, bound), bound a squared distance, once for each block that has a partition it has to visit: its nearest ones at first, then all within the bound."""
    index, blocks = replace(index, rows=None), index.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.zeros((len(index.pivots), blocks.n), np.float32)
        for pivot, (a, parts) in enumerate(zip(blocks.first, blocks.parts, strict=True)):
            of[pivot, a : a + parts] = index.sizes[pivot] > 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_024):
                some = batch.slice(lo, 1_024)
                x = _matrix(some.column(1), index.pivots.shape[1])
                go = _homes(index, x, k) if first else _within(index, x, np.asarray(some.column(2), float), np.arange(len(index.pivots)))[0]
                at, block = np.nonzero(go.astype(np.float32) @ of)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *some.take(pa.array(at)).columns], ["block", *batch.schema.names])

    types = dict(queries.dtypes)
    return queries.select("qid", "f", "bound").mapInArrow(run, f"block int, qid {types['qid']}, f {types['f']}, bound double")


def _best(row: np.ndarray, ids: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each row, ties by id; rows ascend."""
    order = np.lexsort((ids, d2, row))
    row, ids, d2 = row[order], ids[order], d2[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], ids[best], d2[best]


def _meet(index: MetricIndex, q: pa.Table, p: pa.Table, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, point_id, d2): the k nearest rows (ties by point_id) of a block within the bound of each query, some queries at a time.

    The distance of the k-th found so far takes the bound's place, and only rows whose distance from the pivot allows it are compared.
    """
    p = p.take(pc.sort_indices(p, [("pivot", "ascending"), ("away", "ascending")]))
    y, ids, rings, of = _matrix(p["f"].combine_chunks(), index.pivots.shape[1]), p["point_id"].to_numpy(), p["away"].to_numpy(), p["pivot"].to_numpy()
    chosen, begin = np.unique(of, return_index=True)
    ends, squared = np.append(begin[1:], len(of)), (y * y).sum(1)
    x_all, bounds = _matrix(q["f"].combine_chunks(), index.pivots.shape[1]), q["bound"].to_numpy()
    for at in range(0, len(x_all), 256):
        x, bound = x_all[at : at + 256], bounds[at : at + 256].copy()
        go, away = _within(index, x, bound, chosen)
        row, found, d2 = np.zeros(0, int), ids[:0], np.zeros(0)
        for c in away.mean(0).argsort(kind="stable"):
            reach = np.sqrt(bound) + index.slack
            # rings of the partition that a query's bound, which shrinks, still reaches
            asks = np.flatnonzero(go[:, c] & (rings[begin[c]] <= away[:, c] + reach) & (rings[ends[c] - 1] >= away[:, c] - reach))
            if not len(asks):
                continue
            lo = begin[c] + np.searchsorted(rings[begin[c] : ends[c]], (away[asks, c] - reach[asks]).min())
            hi = begin[c] + np.searchsorted(rings[begin[c] : ends[c]], (away[asks, c] + reach[asks]).max(), side="right")
            for a in range(lo, hi, STRIP):
                b = min(a + STRIP, hi)
                square = _squares(x[asks], y[a:b])
                rounding = 1e-9 * (1 + squared[a:b].max() + (x[asks] * x[asks]).sum(1))
                within = bound[asks] + rounding
                if b - a > k and not np.isfinite(within).all():
                    within = np.minimum(within, np.partition(square, k - 1, axis=1)[:, k - 1] + rounding)
                near, column = np.nonzero(square <= within[:, None])
                exact = np.concatenate([((x[asks[near[i : i + 50_000]]] - y[a + column[i : i + 50_000]]) ** 2).sum(1) for i in range(0, len(near), 50_000)] or [np.zeros(0)])
                keep = exact <= bound[asks[near]]
                if keep.any():
                    row, found, d2 = _best(np.concatenate([row, asks[near[keep]]]), np.concatenate([found, ids[a + column[keep]]]), np.concatenate([d2, exact[keep]]), k)
                    last = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
                    bound[row[last]] = np.minimum(bound[row[last]], d2[last])
        yield at + row, found, d2


def _answers(index: MetricIndex, visits: DataFrame, k: int) -> DataFrame:
    """(qid, point_id, d2): k candidates at most a query and block. Queries of a block are divided so that all cores are busy and none is too large for a task; each part has the block's rows."""
    spark, blocks = visits.sparkSession, index.blocks
    asked = {r.block: r["count"] for r in visits.groupBy("block").count().collect()}  # a row a block
    each = min(_most(index), max(1, -(-sum(asked.values()) // _tasks(spark))))
    divided = F.broadcast(spark.createDataFrame([(i, max(1, -(-asked.get(i, 0) // each))) for i in range(blocks.n)], "block int, query_parts int"))
    placed = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(blocks.first, blocks.parts, strict=True))]
    placed = F.broadcast(spark.createDataFrame(placed, "pivot int, first int, row_parts int"))  # MOST_PIVOTS rows at most
    part = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = visits.join(divided, "block").withColumn("query_part", part("qid", "query_parts"))
    right = index.rows.join(placed, "pivot").withColumn("block", F.col("first") + part("point_id", "row_parts")).join(divided, "block")
    right = right.withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    keys, types, point = ["block", "query_part"], dict(visits.dtypes), dict(index.rows.dtypes)["point_id"]
    names = ["qid", "point_id", "d2"]
    known = replace(index, rows=None)

    def meet(q: pa.Table, p: pa.Table) -> pa.Table:
        out = [pa.table([q["qid"].take(pa.array(row)), pa.array(found, p.schema.field("point_id").type), pa.array(d2)], names) for row, found, d2 in _meet(known, q, p, k)] if q.num_rows and p.num_rows else []
        return pa.concat_tables(out) if out else pa.table([q["qid"].slice(0, 0), p["point_id"].slice(0, 0), pa.array([], pa.float64())], names)

    left, right = left.select(*keys, "qid", "f", "bound"), right.select(*keys, "pivot", "point_id", "f", "away")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"qid {types['qid']}, point_id {point}, d2 double")


def search(index: MetricIndex, queries: DataFrame, k: int, max_sq_dist: float | None = None) -> DataFrame:
    """(qid, point_id, d2, rank): the exact k nearest of the index to queries(qid, f), d2 below max_sq_dist, ties by point_id.

    A query first visits its nearest partition. The distance of its k-th row there bounds the search: it then visits only partitions that can
    have a nearer one, and there is compared only with rows whose distance from the pivot allows it. Partitions meet queries in blocks, whose number
    goes by cores and not by partitions, so that what is shuffled grows with the rows. Queries without a vector have no rows.
    """
    far = float("inf") if max_sq_dist is None else float(max_sq_dist)
    asked = queries.select("qid", _vectors(queries), F.lit(far).alias("bound")).where("f IS NOT NULL")
    if index.rows is None or k < 1:
        return asked.limit(0).select("qid", F.lit(0).cast("long").alias("point_id"), "bound").toDF("qid", "point_id", "d2").withColumn("rank", F.lit(0))
    within = F.col("d2") < far
    # as many blocks of rows for each part of the queries as there are rows for each query: then the least is shuffled
    n, tasks = int(index.sizes.sum()), _tasks(queries.sparkSession)
    cuts = round(min(max((tasks * n / max(asked.count(), 1)) ** 0.5, 1), tasks))
    index = replace(index, blocks=Blocks.of(index, min(_most(index), -(-n // cuts))))
    near = top_k(_answers(index, _visits(index, asked, k, True), k).where(within), k)
    if len(index.pivots) == 1:
        return near
    kth = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("d2")).alias("kth"))
    bounded = cut(asked.drop("bound").join(kth.hint("merge"), "qid", "left").select("qid", "f", F.coalesce("kth", F.lit(far)).alias("bound")), "bounded")
    # the partitions of the first round are visited again, with a bound: rounding never decides whether one is left out
    return top_k(_answers(index, _visits(index, bounded, k, False), k).where(within), k)


def knn_feature(queries: DataFrame, points: DataFrame, k: int, max_sq_dist: float | None = None) -> DataFrame:
    """(qid, point_id, d2, rank) in feature space: queries(qid, f), points(point_id, f), arrays of one length."""
    return search(build_index(points), queries, k, max_sq_dist)


def reciprocal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id): mutual nearest neighbours in feature space of (point_id, f) tables. Only rows of b that are some row's nearest are asked back."""
    forth = knn_feature(a.select(F.col("point_id").alias("qid"), "f"), b, 1)
    forth = cut(forth.select(F.col("qid").alias("a_id"), F.col("point_id").alias("b_id")), "forth")
    chosen = b.join(forth.select(F.col("b_id").alias("point_id")).distinct(), "point_id", "left_semi")
    back = knn_feature(chosen.select(F.col("point_id").alias("qid"), "f"), a, 1).select(F.col("point_id").alias("a_id"), F.col("qid").alias("b_id"))
    return forth.join(back, ["a_id", "b_id"])
