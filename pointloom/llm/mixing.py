"""Operator 7, mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, materialize, n_words, require

MAX_EPOCHS = 3
SEED = "mix-1"


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources(source, size long, weight long) with target double.

    All sizes are shared by weight. A source whose share exceeds max_epochs times its size is clamped
    there, and what is left is shared among the others, until none is above. Each round is one small
    aggregate; only three sums reach the driver. Clamping is monotone, so rounds end.
    """
    total = sources.agg(F.sum("size")).head()[0] or 0
    cap = F.col("size") * max_epochs
    free_share = None
    clamped = F.lit(False)
    while True:
        row = sources.agg(
            F.sum(F.when(clamped, cap)).alias("caps"), F.sum(F.when(~clamped, F.col("weight"))).alias("weights"), F.count_if(clamped).alias("n")
        ).head()
        left, weights = total - (row.caps or 0), row.weights or 0
        if not weights or (free_share and row.n == free_share[2]):
            break
        free_share = (left, weights, row.n)
        clamped = clamped | (F.col("weight") * F.lit(left) > cap * F.lit(weights))
    left, weights, _ = free_share or (0, 1, 0)
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(weights).cast("double")
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def _rank(id_: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_.cast("string"), F.lit(""))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_epochs: int = MAX_EPOCHS, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target, copies, taken, and the columns of carry.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... A document is repeated floor(target / source_size)
    times; the rest goes to documents in seeded order until the next one would take more than half beyond it.
    Null and empty texts have size 0. Rows that repeat an id follow each other in the order of their sizes.
    A source without words gets target 0 and copies 0. An empty table gives no rows; columns not named are ignored.

    The seeded order of a source is cut into 4096 ranges of its hash, and what comes before a range is
    a sum over ranges, so that no task orders a whole source.
    """
    require(docs, id_col, text_col, source_col, *carry)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("src"), n_words(F.col(text_col)).alias("size"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    rows = rows.withColumn("rank", _rank(F.col("id"), seed)).withColumn("range", F.substring("rank", 1, 3))
    if not carry:
        rows = materialize(rows, "sizes")
    ranges = materialize(rows.groupBy("src", "range").agg(F.sum("size").alias("size")), "ranges")
    sources = ranges.groupBy("src").agg(F.sum("size").alias("size"))
    # one row per source here, however many documents there are
    order = F.row_number().over(W.orderBy(F.col("src").isNull(), F.col("src").cast("binary")))
    sources = materialize(sources.withColumn("weight", ((order - 1) % 3 + 1).cast("long")), "sources")
    filled = water_fill(sources, max_epochs).select("src", F.col("size").alias("source_size"), "target")
    filled = filled.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    filled = filled.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("src").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("src", "range", before.alias("before")).join(
        filled.withColumnRenamed("src", "of"), F.col("src").eqNullSafe(F.col("of")), "inner"
    ).drop("of")
    starts = materialize(starts, "starts").select(F.col("src").alias("of"), F.col("range").alias("at"), "before", "source_size", "target", "whole", "rest")
    within = F.sum("size").over(W.partitionBy("src", "range").orderBy("rank", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("within", within).join(starts, F.col("src").eqNullSafe(F.col("of")) & (F.col("range") == F.col("at")), "inner")
    left = F.col("rest") - (F.col("before") + F.col("within"))
    copies = (F.col("whole") + F.when((F.col("size") > 0) & (left * 2 >= F.col("size")), 1).otherwise(0)).cast("long")
    copies = F.least(copies, F.lit(max_epochs).cast("long"))
    out = placed.withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), F.col("src").alias("source"), "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: The same fixed point in closed form: sources in the order in which they would be clamped.
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
  md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS rank FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight, {MAX_EPOCHS} * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total,
  coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM w),
c AS (SELECT *, weight * (total - caps_before) > cap * weights_left AS clamped FROM o),
f AS (SELECT sum(CASE WHEN NOT clamped THEN weight END) AS weights, any_value(total) - coalesce(sum(CASE WHEN clamped THEN cap END), 0) AS remaining FROM c),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE (weight * remaining)::DOUBLE / weights::DOUBLE END AS target FROM c, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
p AS (SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, r.target - r.whole * r.source_size
  - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.rank, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size) AS remaining
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  (least(whole + CASE WHEN size > 0 AND remaining * 2 >= size THEN 1 ELSE 0 END, {MAX_EPOCHS}) * size)::BIGINT AS taken FROM p
"""
