"""Exact verification of candidates that share buckets, without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import thin
from .common import materialize

#: A bucket with more items is cut into blocks, and each pair of blocks is a task's group of its own.
BLOCK = 400
#: A bucket of more items (boilerplate's) is divided by prefixes of the items' sets before texts are shipped.
SPLIT = 10_000
#: The sets of so many texts are made in one call.
TOGETHER = 500


def crowded(rows: DataFrame, need: str | None = None) -> DataFrame:
    """(bucket, item) of rows(bucket long, item long[, need boolean]) whose bucket holds two rows or more (and one where `need` is true).

    Buckets are counted first; then a bitmap of fixed size lets through the rows worth a second shuffle.
    """
    marks = [F.max(need).alias("need")] if need else [F.lit(True).alias("need")]
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *marks).where("n > 1 and need").select("bucket")
    full = materialize(counts, "crowded")
    some = thin(rows.select("bucket", "item"), full, "bucket")
    return materialize(some.join(full, "bucket", "left_semi").distinct(), "members")


def jaccard(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sorted sets are that similar; sizes prune first."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= threshold * (len(a) + len(b) - both) and both > 0


def _inside(items: list[tuple[int, np.ndarray]], alike: Callable) -> Iterator[tuple[int, int]]:
    """Links that join each pair of similar items, directly or through others: an item is compared with a component until one is alike."""
    parts: list[list[tuple[int, np.ndarray]]] = []
    for item in items:
        mine, rest = [item], []
        for part in parts:
            hit = next((x for x in part if alike(x[1], item[1])), None)
            if hit is None:
                rest.append(part)
            else:
                yield hit[0], item[0]
                mine = part + mine if len(part) > len(mine) else mine + part
        parts = [*rest, mine]


def _loose(items: list[tuple[int, np.ndarray]], alike: Callable, most: int = 8) -> list[list[tuple[int, np.ndarray]]]:
    """Items beside the first one they are like, of a few: groups of items known to be connected, in one comparison an item where all are alike."""
    parts: list[list[tuple[int, np.ndarray]]] = []
    for item in items:
        for part in parts[:most]:
            if alike(part[0][1], item[1]):
                part.append(item)
                break
        else:
            parts.append([item])
    return parts


def _across(left: list, right: list, alike: Callable) -> Iterator[tuple[int, int]]:
    """Links that join each pair of similar items of two blocks, given those inside the blocks: groups are compared until one pair is alike."""
    lefts, rights = _loose(left, alike), _loose(right, alike)
    up = list(range(len(lefts) + len(rights)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, one in enumerate(lefts):
        for j, two in enumerate(rights):
            x, y = top(i), top(len(lefts) + j)
            if x == y:
                continue
            hit = next(((a, b) for a, sa in one for b, sb in two if alike(sa, sb)), None)
            if hit:
                up[y] = x
                yield hit


def finer(members: DataFrame, sizes: DataFrame, split: int, parts: DataFrame | None = None) -> DataFrame:
    """members with each bucket of more than `split` items replaced by parts(bucket, item), in which all pairs that matter meet. sizes(bucket, n).

    Without parts a bucket is divided into pairs of blocks, so that any two of its items stay together.
    """
    big = materialize(sizes.where(F.col("n") > split), "big")
    if not big.head(1):
        return members
    if parts is None:
        count = F.ceil(2 * F.col("n") / split)
        homes = members.join(big, "bucket").select("bucket", "item", count.alias("k"), F.pmod(F.xxhash64("item", F.lit(3)), count).alias("home"))
        homes = homes.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        parts = homes.select(F.xxhash64("bucket", F.least("home", "other"), F.greatest("home", "other")).alias("bucket"), "item")
    return materialize(members.join(big, "bucket", "left_anti").select("bucket", "item").unionByName(parts.select("bucket", "item")), "finer")


def _grouped(handle: Callable[[tuple, list], Iterator[tuple[int, int]]], keys: int, sets_of: Callable[[list[str]], list[np.ndarray]]) -> Callable:
    """A function of batches that hands rows, sorted by their first `keys` columns, to `handle` group by group: (keys, rows of the other columns) to links.

    The last column, a text, is handed on as its set. Sets are made for some rows together, which costs less than one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        now: tuple | None = None
        found: list[tuple[int, int]] = []

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])
            found.clear()
            return out

        for batch in batches:
            for at in range(0, len(batch), TOGETHER):
                *columns, texts = [c.to_pylist() for c in batch.slice(at, TOGETHER).columns]
                for row in zip(*columns, sets_of(texts), strict=True):
                    if row[:keys] != now:
                        if group:
                            found.extend(handle(now, group))
                        group, now = [], row[:keys]
                    group.append(row[keys:])
            yield batch_of()
        if group:
            found.extend(handle(now, group))
        yield batch_of()

    return run


def _prefixes(texts: DataFrame, set_of: Callable[[str], np.ndarray], threshold: float, sample: int = 10_000, most: int = 100_000) -> DataFrame:
    """(bucket, item) of texts(item, text): an item's rarest elements, so many that two similar sets have one of them in common, whatever
    the order. The order takes the elements that are frequent in a bounded sample last: it only decides how large the buckets are."""

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(set_of(t.as_py()).view(np.int64))], ["e"])

    some = texts.where(F.pmod(F.xxhash64("item", F.lit(4)), F.lit(-(-texts.count() // sample))) == 0).select("text").mapInArrow(elements, "e long")
    counts = some.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "e").limit(most).toPandas().sort_values("e")
    shared = texts.sparkSession.sparkContext.broadcast((counts.e.to_numpy("int64"), counts.n.to_numpy("int64")))

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value
        for batch in batches:
            out: list[np.ndarray] = []
            for t in batch.column(1):
                mine = set_of(t.as_py()).view(np.int64)
                at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
                often = np.where(known[at] == mine, n[at], 0) if len(known) else np.zeros(len(mine), np.int64)
                out.append(mine[np.lexsort((mine, often))][: max(0, len(mine) - int(np.ceil(threshold * len(mine) - 1e-6)) + 1)])
            items = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(o) for o in out])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *out])), pa.array(items)], ["bucket", "item"])

    return texts.select("item", "text").mapInArrow(prefix, "bucket long, item long")


def _leaders(inside: DataFrame, texts: DataFrame, sets_of: Callable[[list[str]], list[np.ndarray]], threshold: float, block: int) -> DataFrame:
    """(a, b): the links of the items of inside(bucket, item) with the first item of their bucket; one comparison an item."""
    first = inside.groupBy("bucket").agg(F.min("item").alias("leader"))
    asked = inside.join(first, "bucket").where("item <> leader").select("leader", "item").distinct()
    parts = F.ceil(F.count(F.lit(1)) / block).alias("parts")
    sizes = materialize(asked.groupBy("leader").agg(parts), "leaders")
    rows = asked.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("item", F.lit(5)), "parts").alias("part"), F.lit(True).alias("asks"), "item")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("asks"), F.col("leader").alias("item"))
    full = rows.union(heads).join(texts, "item").select("leader", "part", "asks", "item", "text")

    def compare(key: tuple, group: list) -> Iterator[tuple[int, int]]:
        head = group[0][2]  # the leader comes first
        return ((key[0], item) for _, item, mine in group[1:] if jaccard(head, mine, threshold))

    return full.repartition("leader", "part").sortWithinPartitions("leader", "part", "asks").mapInArrow(_grouped(compare, 2, sets_of), "a long, b long")


def similar_links(members: DataFrame, texts: DataFrame, set_of: Callable[[str], np.ndarray], threshold: float, block: int = BLOCK, split: int = SPLIT, sets_of: Callable[[list[str]], list[np.ndarray]] | None = None) -> DataFrame:
    """(a, b): links between items of members(bucket, item) that share a bucket and whose sets are similar.

    texts(item, text) has a row for each item; sets_of(texts) gives the sets of several, where that is cheaper than set_of of each. Of the similar pairs of a bucket, as many are returned as keep all of
    them connected. Buckets with the same items are compared once. A bucket of more than `split` items is divided exactly:
    items are linked with its first item where they are like it, then all meet again by prefixes of their sets, one element of which
    any two similar sets share; only items known to be connected are not compared with each other.
    """
    sets_of = sets_of or (lambda some: [set_of(t) for t in some])
    sizes = materialize(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split), "sizes")
    stars = label = None
    if sizes.head(1):
        inside = materialize(members.join(sizes, "bucket", "left_semi").select("bucket", "item"), "inside")
        theirs = materialize(texts.join(inside.select("item").distinct(), "item", "left_semi").select("item", "text"), "theirs")
        parts = materialize(_prefixes(theirs, set_of, threshold), "prefixes")
        stars = materialize(_leaders(inside, theirs, sets_of, threshold, block), "stars")
        label = materialize(stars.select(F.col("b").alias("item"), "a").union(stars.select("a", "a")).groupBy("item").agg(F.min("a").alias("label")), "labels")
        members = finer(members, sizes, split, parts)
    return _links(members, texts, sets_of, threshold, block, stars, label)


def _links(members: DataFrame, texts: DataFrame, sets_of: Callable, threshold: float, block: int, stars: DataFrame | None, label: DataFrame | None) -> DataFrame:
    """The links of all buckets by blocks, with those of stars(a, b). Of a bucket, the items of its most frequent label(item, label) are connected already."""
    named = members.join(label, "item", "left") if label is not None else members.withColumn("label", F.lit(None).cast("long"))
    marks = [F.expr(f"bit_xor(xxhash64(item, {i}))").alias(f"x{i}") for i in (0, 1)]
    main = F.lit(None).cast("long") if label is None else F.mode("label", True)
    buckets = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *marks, main.alias("main")).where("n > 1")
    once = buckets.groupBy("n", "x0", "x1").agg(F.min(F.struct("bucket", "main")).alias("one")).select("one.bucket", "n", "one.main")
    once = materialize(once, "buckets")
    rows = named.join(once, "bucket").withColumn("known", F.coalesce(F.col("label") == F.col("main"), F.lit(False)))
    if label is not None:
        once = rows.groupBy("bucket").agg(F.count_if("known").alias("known_n"), F.count(F.lit(1)).alias("n")).where("n > known_n")
        rows = rows.drop("n").join(materialize(once, "halves"), "bucket")
    else:
        rows = rows.withColumn("known_n", F.lit(0).cast("long"))
    old, new = F.ceil(F.col("known_n") / block), F.ceil((F.col("n") - F.col("known_n")) / block)
    place = F.xxhash64("item", F.lit(2))
    rows = rows.select("bucket", "item", "known", old.alias("old"), (old + new).alias("blocks"), F.when(F.col("known"), F.pmod(place, old)).otherwise(old + F.pmod(place, new)).alias("home"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("known"), F.col("old")).otherwise(F.lit(0).cast("long")), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), (F.col("home") > F.col("other")).alias("second"), "item")
    full = rows.join(texts, "item").select("bucket", "i", "j", "second", "item", "text")
    full = full.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    alike = lambda a, b: jaccard(a, b, threshold)

    def compare(cell: tuple, group: list) -> Iterator[tuple[int, int]]:
        sets = [(second, (item, mine)) for second, item, mine in group]
        if cell[1] == cell[2]:
            return _inside([s[1] for s in sets], alike)
        return _across([s[1] for s in sets if not s[0]], [s[1] for s in sets if s[0]], alike)

    found = full.mapInArrow(_grouped(compare, 3, sets_of), "a long, b long")
    return found if stars is None else found.union(stars)
