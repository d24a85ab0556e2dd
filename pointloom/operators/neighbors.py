"""Nearest-neighbour joins: equi-joins on cells, then exact distances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import expr as E
from ..schema import XYZ, require_columns
from ..scratch import cut

#: A cell of the first round of kNN holds no more points than this.
CROWD = 256
#: A radius search by cells of the radius' size looks at so many points a cell, at most, for each neighbour that is wanted.
DENSE = 32
#: So many queries of a cell, on average, meet the points round it in one block at most; a block's pairs are made some PAIRS at a time.
BLOCK, PAIRS = 4_096, 1 << 17
D2 = "(qx - x) * (qx - x) + (qy - y) * (qy - y) + (qz - z) * (qz - z)"
# The neighbourhoods of a voxel by size.
NEIGHBOURHOODS = {
    1: [(0, 0, 0)],
    7: [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) <= 1],
    19: [o for o in product((-1, 0, 1), repeat=3) if sum(map(abs, o)) <= 2],
    27: list(product((-1, 0, 1), repeat=3)),
}


def _queries(queries: DataFrame) -> DataFrame:
    require_columns(queries, "qid", "qx", "qy", "qz")
    return queries


def as_queries(df: DataFrame, key: str = "point_id") -> DataFrame:
    """qid, qx, qy, qz of a cloud."""
    return df.select(F.col(key).alias("qid"), *[F.col(c).alias(f"q{c}") for c in XYZ])


def cell_pairs(queries: DataFrame, points: DataFrame, cell: float, neighbourhood: int = 27, by: tuple[str, ...] = ()) -> DataFrame:
    """(queries.*, points.*) of points in the voxels round each query's, and of the same values of `by`, columns of both. The queries are replicated, so pass the smaller side as queries.

    Cells are joined on their three coordinates, so that clouds may lie anywhere (a packed key would end at 2**20 cells). Neither side is broadcast: Spark
    takes the replicated queries for as small as the table they come from.
    """
    require_columns(points, *XYZ)
    cells = ["_vx", "_vy", "_vz"]
    at = [F.expr(E.voxel(f"q{c}", cell)).alias(f"_{c}") for c in XYZ]
    offsets = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(XYZ, o, strict=True)]) for o in NEIGHBOURHOODS[neighbourhood]])
    spread = queries.where(F.expr(E.finite("qx", "qy", "qz"))).select("*", *at).withColumn("_o", F.explode(offsets))
    spread = spread.select("*", *[(F.col(f"_{c}") + F.col(f"_o.{c}")).alias(v) for c, v in zip(XYZ, cells, strict=True)]).drop("_x", "_y", "_z", "_o")
    placed = points.where(F.expr(E.finite(*XYZ))).select("*", *[F.expr(E.voxel(c, cell)).alias(v) for c, v in zip(XYZ, cells, strict=True)])
    return spread.join(placed.hint("merge"), [*by, *cells]).drop(*cells)


def around(queries: DataFrame, points: DataFrame, reach: float, work: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str, block: int = 0, rings: int = 1) -> DataFrame:
    """What work(queries, points) yields for every block of queries(qid, qx, qy, qz, ...) and all points(x, y, z, ...) within reach of its cell, and some more.

    A block is the queries of a cell, or a part of them where a cell has more than `block` (BLOCK); cells have the size of the reach, or of a part of it, with so many rings round them. All pairs of a query are in one task, so that nothing of the
    size of the pairs is shuffled, sorted or written: points are shuffled once for each block round them, queries once. Columns of both have different names.
    """
    cells, keys = ["_vx", "_vy", "_vz"], ["_vx", "_vy", "_vz", "_part"]
    offsets = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(XYZ, o, strict=True)]) for o in product(range(-rings, rings + 1), repeat=3)])
    side, block = reach / rings, block or BLOCK
    asked = queries.where(F.expr(E.finite("qx", "qy", "qz"))).select("*", *[F.expr(E.voxel(f"q{c}", side)).alias(v) for c, v in zip(XYZ, cells, strict=True)])
    sizes = cut(asked.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("_parts")), "blocks")
    blocks = sizes.agg(F.sum("_parts")).head()[0] or 1
    left = asked.join(sizes, cells).withColumn("_part", F.pmod(F.xxhash64("qid", "qx", "qy", "qz"), F.col("_parts"))).withColumn("_point", F.lit(False)).drop("_parts")
    at = [(F.expr(E.voxel(c, side)) + F.col(f"_o.{c}")).alias(v) for c, v in zip(XYZ, cells, strict=True)]
    right = points.where(F.expr(E.finite(*XYZ))).withColumn("_o", F.explode(offsets)).select("*", *at).drop("_o").join(sizes, cells)
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).withColumn("_point", F.lit(True)).drop("_parts")
    names = queries.columns, points.columns

    def met(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pa.Table.from_batches(held).combine_chunks()
        n = both.num_rows - pc.sum(both["_point"]).as_py()
        if n < both.num_rows:
            yield from work(both.select(names[0]).slice(0, n), both.select(names[1]).slice(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple = ()
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.stack([batch.column(c).to_numpy() for c in keys])
            begin = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for lo, hi in zip(begin, begin[1:], strict=False):
                if held and tuple(k[:, lo]) != last:
                    yield from met(held)
                    held = []
                last = tuple(k[:, lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from met(held)

    # few bytes make much work, so the number of tasks goes by blocks and cores
    tasks = max(1, min(int(blocks), 8 * queries.sparkSession.sparkContext.defaultParallelism))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition(tasks, *keys).sortWithinPartitions(*keys, "_point").mapInArrow(run, schema)


def matrix(table: pa.Table, names: tuple[str, ...] | list[str]) -> np.ndarray:
    """A row for each of the columns; null is NaN."""
    return np.stack([np.asarray(table[c].to_numpy(), float) for c in names])


def by_id(points: pa.Table) -> pa.Table:
    return points.take(pc.sort_indices(points["point_id"], null_placement="at_start"))


def tiles(q: np.ndarray, p: np.ndarray, reach: float, rows: int = 64, fine: int = 4) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of q, rows of p, ascending) of few queries near each other and all points that can be within reach of one: q and p are 3 x n."""
    order = np.lexsort(np.floor(q * (fine / reach)))
    margin = reach * (1 + 1e-9) + 1e-15 * max(np.abs(q).max(initial=0.0), np.abs(p).max(initial=0.0))
    for at in range(0, len(order), rows):
        some = order[at : at + rows]
        lo, hi = q[:, some].min(1) - margin, q[:, some].max(1) + margin
        inside = (p[0] >= lo[0]) & (p[0] <= hi[0])
        for c in (1, 2):
            inside &= (p[c] >= lo[c]) & (p[c] <= hi[c])
        yield some, np.flatnonzero(inside)


def squares(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """D2 of all columns of q with all of p, added in the same order."""
    out = None
    for a, b in zip(q, p, strict=True):
        step = a[:, None] - b[None]
        np.multiply(step, step, out=step)
        out = step if out is None else np.add(out, step, out=out)
    return out


def near_parts(q: np.ndarray, p: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of p, their squared distances) of tiles, some PAIRS at a time; every query is in one of them."""
    for some, columns in tiles(q, p, reach):
        step = max(1, PAIRS // max(1, len(columns)))
        for at in range(0, len(some), step):
            part = some[at : at + step]
            yield part, columns, squares(q[:, part], p[:, columns])


def _ranked(radius: float, schema: str) -> Callable:
    """All pairs closer than radius, of each query by distance, then point_id."""
    names = [x.split()[0] for x in schema.split(", ")]

    def work(queries: pa.Table, points: pa.Table) -> Iterator[pa.RecordBatch]:
        points = by_id(points)
        qid, pid = queries["qid"].combine_chunks(), points["point_id"].combine_chunks()
        for part, columns, d2 in near_parts(matrix(queries, ["qx", "qy", "qz"]), matrix(points, XYZ), radius):
            row, column = np.nonzero(d2 < radius * radius)
            if not len(row):
                continue
            value = d2[row, column]
            begin = np.searchsorted(row, np.arange(len(part) + 1))
            if len(row) > 500 * len(part):  # columns ascend by point_id: where no two are equally far, any sort will do
                order = np.empty(len(row), np.int64)
                for a, b in zip(begin, begin[1:], strict=False):
                    one = value[a:b].argsort()
                    if (np.diff(value[a:b][one]) == 0).any():
                        one = value[a:b].argsort(kind="stable")
                    order[a:b] = a + one
            else:
                order = np.lexsort((value, row))
            rank = np.arange(len(row), dtype=np.int32) - begin[row].astype(np.int32) + 1
            for at in range(0, len(row), PAIRS):
                o = order[at : at + PAIRS]
                columns_ = [qid.take(pa.array(part[row[o]])), pid.take(pa.array(columns[column[o]])), pa.array(value[o]), pa.array(rank[at : at + PAIRS])]
                yield pa.RecordBatch.from_arrays(columns_, names)

    return work


def radius_search(queries: DataFrame, points: DataFrame, radius: float, max_neighbors: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(qid, point_id, d2, rank) of points closer than radius; with max_neighbors the nearest so many, ties by point_id. With max_neighbors, `by` are columns of both in which a point has to equal the query.

    Cells of the radius' size that hold more than DENSE points for each wanted neighbour would make far more pairs than are asked for: then cells shrink
    as in knn, and a dense place is many small ones. Without max_neighbors every pair is a result: then a task makes and ranks all pairs of its queries.
    """
    require_columns(points, "point_id")
    if radius <= 0 or max_neighbors == 0:
        pairs = _queries(queries).limit(0).crossJoin(points.limit(0))
    elif max_neighbors and is_crowded(points, radius, max(CROWD, DENSE * max_neighbors), by):
        return knn(_queries(queries), points, max_neighbors, radius * radius, by=by)
    elif max_neighbors is None:
        schema = f"qid {dict(queries.dtypes)['qid']}, point_id {dict(points.dtypes)['point_id']}, d2 double, rank int"
        return around(_queries(queries).select("qid", "qx", "qy", "qz"), points.select("point_id", *XYZ), radius, _ranked(radius, schema), schema)
    else:
        pairs = cell_pairs(_queries(queries), points, radius, 27, by)
    near = pairs.select("qid", "point_id", F.expr(D2).alias("d2")).where(F.col("d2") < radius * radius)
    return top_k(near, max_neighbors)


def top_k(near: DataFrame, k: int | None) -> DataFrame:
    """rank per qid by d2, then point_id; Spark drops what is beyond k before the shuffle."""
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("d2", "point_id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def typical_cell(points: DataFrame, k: int) -> tuple[float, float]:
    """(cell size, diagonal): the side that would hold about k of the points if they filled their box."""
    r = points.where(F.expr(E.finite(*XYZ))).agg(*[f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n")).head()
    if not r.n:
        return 1.0, 0.0
    sides = [r[f"hi{c}"] - r[f"lo{c}"] for c in XYZ]
    filled = [s for s in sides if s > 1e-9]
    volume = 1.0
    for s in filled:
        volume *= s
    cell = (volume * k / r.n) ** (1 / len(filled)) if filled else 1.0
    return max(cell, max(sides, default=0.0) / 500_000, 1e-9), sum(s * s for s in sides) ** 0.5


def is_crowded(points: DataFrame, side: float, crowd: int, by: tuple[str, ...] = ()) -> bool:
    """Whether a cell of that side holds more than `crowd` points."""
    placed = points.where(F.expr(E.finite(*XYZ)))
    return not placed.groupBy(*by, *[F.expr(E.voxel(c, side)).alias(f"_{c}") for c in XYZ]).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).isEmpty()


def has_copies(points: DataFrame, k: int, by: tuple[str, ...] = ()) -> bool:
    """Whether more than k points share one place."""
    return not points.where(F.expr(E.finite(*XYZ))).groupBy(*by, *XYZ).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k).isEmpty()


def dense_cell(points: DataFrame, side: float, crowd: int = CROWD, by: tuple[str, ...] = ()) -> float:
    """side, halved (16 times at most) until no cell holds more than `crowd` points."""
    for _ in range(16):
        if not is_crowded(points, side, crowd, by):
            break
        side /= 2
    return side


def knn(queries: DataFrame, points: DataFrame, k: int, max_sq_dist: float | None = None, cell: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(qid, point_id, d2, rank): the exact k nearest, of the same values of `by` (columns of both), d2 below max_sq_dist, ties by point_id.

    Cells of side s hold everything within s of a query in the 27 round it: a query is done when it has k
    points within s. The others are asked again with s doubled, until s exceeds max_sq_dist or all
    distances there are. The first s is small enough for the densest cell, so dense regions are done before sparse ones make
    cells large. If very many points share one place, only the k of least point_id there can be neighbours, and queries of one place are asked once.
    """
    require_columns(points, "point_id", *XYZ)
    q = _queries(queries)
    if cell is None:
        most, (cell, _) = max(CROWD, 8 * k), typical_cell(points, k)
        if is_crowded(points, cell, most, by) and has_copies(points, k, by):
            search = lambda places, few: _knn(places, few, k, max_sq_dist, dense_cell(few, cell, most, by), by)
            return _by_place(q, points, k, search, (*by, *XYZ), (*by, "qx", "qy", "qz"))
        cell = dense_cell(points, cell, most, by)
    return _knn(q, points, k, max_sq_dist, cell, by)


def _by_place(q: DataFrame, points: DataFrame, k: int, search: Callable, at: tuple[str, ...], asked: tuple[str, ...]) -> DataFrame:
    """search(queries, points) for the k nearest where many points share a place (the columns `at`; of queries `asked`): only the k of least
    point_id there can be neighbours, and queries of one place are asked once."""
    first = W.partitionBy(*at).orderBy("point_id")
    few = cut(points.select("point_id", *at).withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= k).drop("_at"), "few")
    places = cut(q.groupBy(*asked).agg(F.count(F.lit(1)).alias("_n")).drop("_n").withColumn("_place", F.monotonically_increasing_id()), "places")
    found = search(places.withColumnRenamed("_place", "qid"), few)
    whole = q.join(places.hint("merge"), [q[c].eqNullSafe(places[c]) for c in asked]).select("qid", "_place")
    return whole.join(found.withColumnRenamed("qid", "_place").hint("merge"), "_place").select("qid", "point_id", "d2", "rank")


def _knn(q: DataFrame, points: DataFrame, k: int, max_sq_dist: float | None, side: float, by: tuple[str, ...] = ()) -> DataFrame:
    reach = max_sq_dist**0.5 if max_sq_dist is not None else None
    end = reach
    if reach is None:
        ends = [f(F.col(p + c)).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max)) for p in ("",)]
        low = points.where(F.expr(E.finite(*XYZ))).agg(*ends).head()
        asked = q.where(F.expr(E.finite("qx", "qy", "qz"))).agg(*[f(f"q{c}").alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]).head()
        if low.lox is None or asked.lox is None:
            end = side
        else:  # the diagonal of the box round queries and points
            end = sum((max(low[f"hi{c}"], asked[f"hi{c}"]) - min(low[f"lo{c}"], asked[f"lo{c}"])) ** 2 for c in XYZ) ** 0.5 * 1.01 + 1e-9

    def near(some: DataFrame, side: float) -> DataFrame:
        limit = F.lit(True) if max_sq_dist is None else F.col("d2") < max_sq_dist
        return cell_pairs(some, points, side, 27, by).select("qid", "point_id", F.expr(D2).alias("d2")).where(limit)

    sides = [side]
    while sides[-1] < end:
        sides.append(2 * sides[-1])
    if reach is not None:
        sides[-1] = min(sides[-1], end)
    return _by_rounds(q, k, sides[:-1], near, lambda some: near(some, sides[-1]))


def _by_rounds(q: DataFrame, k: int, sides: list[float], near: Callable, last: Callable) -> DataFrame:
    """The k nearest of each query: near(queries, side) has at least all wanted pairs (qid, point_id, d2) with d2 up to side squared, last(queries) all of them.

    A query is done when it has k within the side; the others go to the next one. What a round found is kept with whether its query is done, so the result
    is scans of the rounds' tables, and joins of the cloud's size are never broadcast: nothing that grows with the cloud passes through the driver.
    """
    done: list[DataFrame] = []
    whole = W.partitionBy("qid")
    for side in sides:
        settled = (F.count(F.lit(1)).over(whole) >= k) & (F.max("d2").over(whole) <= side * side)
        found = cut(top_k(near(q, side).select("qid", "point_id", "d2"), k).withColumn("_settled", settled), "knn").where("_settled")
        done.append(found.select("qid", "point_id", "d2", "rank"))
        q = cut(q.join(found.where("rank = 1").select("qid").hint("merge"), "qid", "left_anti"), "open")
        if not q.head(1):
            break
    else:
        done.append(top_k(last(q), k).select("qid", "point_id", "d2", "rank"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _ever_larger(points: DataFrame, k: int, cell: float) -> list[float]:
    """Sides of cells below `cell` for the rounds of a search for the k nearest: none where cells of that size are not crowded."""
    side, out = dense_cell(points, cell, max(CROWD, DENSE * k)), []
    while side < cell:
        out.append(side)
        side *= 2
    return out


def _rounds_or_places(q: DataFrame, points: DataFrame, k: int, cell: float, search: Callable, more: tuple[str, ...] = (), asked: tuple[str, ...] = ()) -> DataFrame:
    """search(queries, points), by places where cells are crowded and points share places; `more` and `asked` are coordinates beside those in space."""
    if is_crowded(points, cell, max(CROWD, DENSE * k)) and has_copies(points, k, more):
        return _by_place(q, points, k, search, (*XYZ, *more), ("qx", "qy", "qz", *asked))
    return search(q, points)


def with_index(near: DataFrame, index: Column) -> DataFrame:
    """A neighbour table whose point_id is replaced by an expression of it: an offset of a frame, a composite index, a column of a joined table."""
    return near.withColumn("point_id", index)


def knn_voxel(queries: DataFrame, points: DataFrame, k: int, cell: float, neighbourhood: int = 7, valid: Column | None = None, max_sq_dist: float | None = None) -> DataFrame:
    """As knn, but among the points of so many voxels round the query's only (and those on which `valid` holds): approximate.

    One join, unless voxels are crowded: then cells are smaller first, and queries that have k points of their voxels within such a cell's side are done. Copies
    of one place count as in knn there.
    """
    chosen = points if valid is None else points.where(valid)
    near_enough = F.lit(True) if max_sq_dist is None else F.col("d2") < max_sq_dist
    steps = [f"abs({E.voxel(f'q{c}', cell)} - {E.voxel(c, cell)})" for c in XYZ]
    most = {1: 0, 7: 1, 19: 2, 27: 3}[neighbourhood]
    inside = F.expr(f"{' AND '.join(f'{s} <= 1' for s in steps)} AND {' + '.join(steps)} <= {most}")

    def search(asked: DataFrame, among: DataFrame) -> DataFrame:
        near = lambda q, side: cell_pairs(q, among, side).where(inside).select("qid", "point_id", F.expr(D2).alias("d2")).where(near_enough)
        last = lambda q: cell_pairs(q, among, cell, neighbourhood).select("qid", "point_id", F.expr(D2).alias("d2")).where(near_enough)
        return _by_rounds(asked, k, _ever_larger(among, k, cell), near, last)

    return _rounds_or_places(_queries(queries), chosen, k, cell, search)


def knn_xyzi(queries: DataFrame, points: DataFrame, k: int, scale: float, cell: float, max_sq_dist: float) -> DataFrame:
    """kNN in (x, y, z, scaled intensity): queries(qid, qx, qy, qz, qi) with qi as it is, points' intensity times scale; cells on space alone bound the search.

    The distance in space is no longer than the whole one, so crowded cells may shrink as in knn_voxel.
    """
    if cell * cell < max_sq_dist:
        raise ValueError("cell must be at least the greatest distance")
    require_columns(queries, "qi")
    d2 = f"{D2} + (qi - intensity * {scale!r}) * (qi - intensity * {scale!r})"

    def search(asked: DataFrame, among: DataFrame) -> DataFrame:
        near = lambda q, side: cell_pairs(q, among, side).select("qid", "point_id", F.expr(d2).alias("d2")).where(F.col("d2") < max_sq_dist)
        return _by_rounds(asked, k, _ever_larger(among, k, cell), near, lambda q: near(q, cell))

    return _rounds_or_places(queries, points, k, cell, search, ("intensity",), ("qi",))


def correspondences(source: DataFrame, target: DataFrame, max_distance: float, k: int = 1) -> DataFrame:
    """(src_id, n, tgt_0.., d2_0..): the k nearest target points within max_distance; sources with fewer keep n < k and null targets."""
    near = radius_search(as_queries(source), target, max_distance, k)
    columns = [F.max(F.when(F.col("rank") == i + 1, F.col(c))).alias(f"{n}_{i}") for i in range(k) for c, n in (("point_id", "tgt"), ("d2", "d2"))]
    found = near.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), *columns)
    out = source.select(F.col("point_id").alias("src_id")).join(found.withColumnRenamed("qid", "src_id"), "src_id", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def nearest_stamp(queries: DataFrame, stamps: DataFrame, bucket: float) -> DataFrame:
    """(qid, stamp): of stamps(stamp), the one closest in time to each query(qid, t), the earlier of two; null only for a null t or without stamps.

    Stamps and queries are ordered together within buckets of time, one task each; what a bucket has before and after it comes from the
    buckets' least and greatest stamps, ordered likewise within groups of buckets. Choose the bucket so that it fits one task.
    """
    t, group = F.col("t"), 12
    both = queries.select("qid", t, F.lit(None).cast("double").alias("stamp")).unionByName(stamps.select(F.lit(None).cast(dict(queries.dtypes)["qid"]).alias("qid"), F.col("stamp").alias("t"), "stamp").where("stamp IS NOT NULL").distinct())
    both = both.where(t.isNotNull()).withColumn("_b", F.floor(t / bucket)).withColumn("_ask", F.col("stamp").isNull())
    ends = cut(both.groupBy("_b").agg(F.min("stamp").alias("lo"), F.max("stamp").alias("hi")).withColumn("_g", F.shiftright("_b", group)), "buckets")
    groups = ends.groupBy("_g").agg(F.min("lo").alias("glo"), F.max("hi").alias("ghi"))
    over = lambda order, *by: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    # groups hold 4,096 buckets each, so their own order is one small task
    groups = groups.select("_g", F.max("ghi").over(over("_g")).alias("gbefore"), F.min("glo").over(over(F.desc("_g"))).alias("gafter"))
    ends = ends.join(groups, "_g").select(
        "_b", F.coalesce(F.max("hi").over(over("_b", "_g")), "gbefore").alias("before"), F.coalesce(F.min("lo").over(over(F.desc("_b"), "_g")), "gafter").alias("after")
    )
    upto = W.partitionBy("_b").orderBy("t", "_ask").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("_b").orderBy(F.desc("t"), "_ask").rowsBetween(W.unboundedPreceding, 0)
    placed = both.select("*", F.max("stamp").over(upto).alias("prev"), F.min("stamp").over(down).alias("next")).where("_ask").join(cut(ends, "ends"), "_b")
    prev, next_ = F.coalesce("prev", "before"), F.coalesce("next", "after")
    best = F.when(prev.isNull(), next_).when(next_.isNull(), prev).when(t - prev <= next_ - t, prev).otherwise(next_)
    found = placed.select("qid", best.alias("stamp"))
    return found.unionByName(queries.where(t.isNull()).select("qid", F.lit(None).cast("double").alias("stamp")))
