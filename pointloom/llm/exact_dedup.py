"""Operator 1, exact dedup: an extendible-hash index on shared files, in DataFrame operations only.

Index layout: a directory (one row per cell of hash prefixes) points to buckets. A bucket whose
distinct keys exceed its capacity is split by one more bit of the hash, which doubles the directory
whenever the split bucket was at full depth. A bucket is the range of keys of one prefix, named by its lowest
cell. Owner tasks hold ranges of buckets: the texts that need comparing travel to the owner of their
bucket, where the different texts of one 64-bit key are told apart by their bytes and chained.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, UPPER, ascii_lower, documents, materialize, require

#: Distinct keys that a bucket holds before it is split.
CAPACITY = 65_536
#: Copies of a text are folded to so many rows at most before they travel to its owner.
FOLDS = 16
#: So many repeated keys (8 bytes each) are broadcast to pick the texts to compare; beyond it texts are shuffled by key to meet them.
BROADCAST_KEYS = 1_000_000


def directory(keys: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cell, depth, bucket) for keys(h long, distinct): the directory at its global depth.

    Cells are counted at a depth with some bits to spare; each cell's bucket is its shallowest ancestor
    that is not overfull. If a cell is still overfull, the directory is doubled until none is.
    """
    total, depth = keys.count(), 0
    while total > capacity << depth:
        depth += 1
    depth += 2
    while True:
        cell = F.shiftrightunsigned("h", 64 - depth)
        cells = materialize(keys.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")), "cells")
        above = cells.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "cell", "n")
        sums = above.groupBy("d", F.expr(f"shiftright(cell, {depth} - d)").alias("prefix")).agg(F.sum("n").alias("n"))
        over = materialize(sums.where(F.col("n") > capacity), "overfull")
        if depth >= 60 or not over.where(F.col("d") == depth).count():
            break
        depth += 1
    path = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    path = path.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - d)"))
    deep = path.join(over.select("d", "prefix", F.lit(1).alias("full")), ["d", "prefix"], "left")
    local = deep.groupBy("cell").agg(F.coalesce(F.max(F.when(F.col("full") == 1, F.col("d") + 1)), F.lit(0)).alias("depth"))
    # a bucket's lowest cell: the bits below its local depth are zero
    lowest = F.expr(f"shiftleft(shiftright(cell, {depth} - depth), {depth} - depth)")
    return local.select("cell", "depth", F.lit(depth).alias("global_depth"), lowest.alias("bucket"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256, bucket and chain (null: no other text has the key).

    Texts are equal when they are after lower-casing A-Z; of equal texts the largest id stays. A null
    text is an empty one. Rows that repeat an id with an equal text are all kept or all dropped. A row
    with a null id stays only if no equal text has an id. An empty table gives no rows; other columns are ignored.
    """
    require(docs, id_col, text_col)
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("norm")).withColumn("h", F.xxhash64("norm"))
    entries = materialize(base.select("id", "h", F.sha2("norm", 256).alias("sha")), "entries")
    keys = materialize(entries.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "keys")
    repeated = keys.where("n > 1").select("h")
    few = repeated.count() <= broadcast_keys
    base = base.join(F.broadcast(repeated) if few else repeated, "h", "left_semi")
    table = materialize(directory(keys.select("h"), capacity), "directory")
    bits = table.agg(F.max("global_depth")).head()[0] or 1
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).alias("fold")
    folded = base.groupBy("h", "norm", fold).agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).drop("fold")
    placed = folded.withColumn("cell", F.shiftrightunsigned("h", 64 - bits)).join(table.select("cell", "bucket"), "cell").drop("cell")
    # each task owns a range of buckets; what follows needs no other exchange
    owned = materialize(placed, "placed").repartitionByRange("bucket")
    chains = owned.groupBy("bucket", "h", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    chains = chains.select("bucket", "h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    index = materialize(chains.withColumn("chain", F.row_number().over(W.partitionBy("bucket", "h").orderBy("sha"))), "index")
    found = entries.join(index, ["h", "sha"], "left")
    group = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), group.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"), "bucket", "chain")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("bucket", "chain")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
