"""A bitmap of fixed size over 64-bit keys, small enough to send to every task: it lets through all keys in it, and few others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**27 bits, 16 MB, whatever the number of keys.
BITS = 27
#: From so many keys on (a quarter of the bits) a bitmap lets through too much.
KEYS = 1 << 25


class Bitmap:
    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def of(keys: DataFrame, column: str, bits: int = BITS, most: int = KEYS) -> Bitmap | None:
        """From the low bits of keys, which must be hashes already. At most 2**bits / 8 bytes reach the driver.

        None for more than `most` keys: the caller must then join without a filter before it.
        """
        if keys.count() > most:
            return None
        low = F.col(column).bitwiseAND((1 << bits) - 1)
        parts = keys.select(low.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bytes"))
        # the first bucket, number 0, holds position 0 alone
        words = np.zeros((1 << bits) // 8 + 8192, np.uint8)
        for r in parts.toLocalIterator():
            at = r.bucket * 4096
            words[at : at + 4096] = np.frombuffer(bytes(r.bytes), np.uint8)
        return Bitmap(words)

    def has(self, keys: np.ndarray, bits: int = BITS) -> np.ndarray:
        low = keys.view(np.uint64) & np.uint64((1 << bits) - 1)
        at = low.astype(np.int64)
        # Spark: bucket (p - 1) // 32768 + 1 and bit (p - 1) % 32768 for p > 0; bucket 0 and bit 0 for p = 0
        bucket, bit = np.where(at > 0, 1 + (at - 1) // 32768, 0), np.where(at > 0, (at - 1) % 32768, 0)
        return (self.words[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 > 0


def thin(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose `column`, their first, may be in keys(column): a filter before a join. All rows if keys are too many for a bitmap."""
    made = Bitmap.of(keys, column)
    if made is None:
        return rows
    maybe = rows.sparkSession.sparkContext.broadcast(made)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(maybe.value.has(batch.column(0).to_numpy())))

    return rows.mapInArrow(keep, rows.schema)
