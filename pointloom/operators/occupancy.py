"""Occupancy grids in bit blocks: a row for each block of 8 x 8 x 8 cells, a bit for each cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..schema import XYZ, require_columns

BLOCK = ("bx", "by", "bz")
#: A word of 64 bits for each layer of a block, along z.
WORDS = tuple(f"w{k}" for k in range(8))


def _cells(points: DataFrame, resolution: float) -> DataFrame:
    """points with their block, the layer in it and the bit in that layer; points that are not finite are dropped."""
    require_columns(points, *XYZ)
    low = lambda c: f"({E.voxel(c, resolution)} & 7)"
    at = [F.expr(f"{E.voxel(c, resolution)} >> 3").alias(b) for c, b in zip(XYZ, BLOCK, strict=True)]
    bit = F.expr(f"1L << CAST({low('y')} * 8 + {low('x')} AS INT)").alias("_bit")
    return points.where(F.expr(E.finite(*XYZ))).select("*", *at, F.expr(low("z")).alias("_layer"), bit)


def occupancy_blocks(points: DataFrame, resolution: float) -> DataFrame:
    """(bx, by, bz, w0..w7) of the cells that points lie in. Tasks OR their bits first, so blocks are shuffled and not points."""
    layers = _cells(points, resolution).groupBy(*BLOCK, "_layer").agg(F.bit_or("_bit").alias("_bits"))
    return layers.groupBy(*BLOCK).agg(*[F.coalesce(F.max(F.when(F.col("_layer") == k, F.col("_bits"))), F.lit(0).cast("long")).alias(w) for k, w in enumerate(WORDS)])


def merge_blocks(*grids: DataFrame) -> DataFrame:
    """The cells of any of the grids."""
    both = grids[0]
    for grid in grids[1:]:
        both = both.unionByName(grid)
    return both.groupBy(*BLOCK).agg(*[F.bit_or(w).alias(w) for w in WORDS])


def _bits(words: list[Column]) -> Column:
    total = F.bit_count(words[0])
    for w in words[1:]:
        total = total + F.bit_count(w)
    return total.cast("long")


def count_cells(grid: DataFrame) -> DataFrame:
    """(cells, blocks) of a grid; 0 of an empty one."""
    return grid.agg(F.coalesce(F.sum(_bits([F.col(w) for w in WORDS])), F.lit(0)).alias("cells"), F.count(F.lit(1)).alias("blocks"))


def common_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cells) that both grids have: blocks are joined, their words ANDed and the bits counted."""
    other = b.withColumnsRenamed({w: f"o{w}" for w in WORDS})
    both = _bits([F.col(w).bitwiseAND(F.col(f"o{w}")) for w in WORDS])
    return a.join(other, list(BLOCK)).agg(F.coalesce(F.sum(both), F.lit(0)).alias("cells"))


def lies_in(points: DataFrame, grid: DataFrame, resolution: float) -> DataFrame:
    """points with hit boolean: whether the point's cell is in the grid. Points that are not finite are dropped."""
    placed = _cells(points, resolution).join(grid, list(BLOCK), "left")
    word = F.coalesce(F.get(F.array(*WORDS), F.col("_layer")), F.lit(0).cast("long"))
    return placed.withColumn("hit", word.bitwiseAND(F.col("_bit")) != 0).select(*points.columns, "hit")
