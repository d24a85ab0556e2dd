"""Operator 6, SimHash near-dedup by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import thin
from .common import documents, materialize, require
from .components import components
from .verify import crowded, similar_links

RADIUS, SEGMENTS, SHINGLE, SEED = 3, 2, 3, 42
#: 32 bands of 4 minima: two texts at similarity 0.8 share none with probability 5e-8.
BANDS, ROWS = 32, 4
_rng = np.random.default_rng(6)
_MULTIPLY = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int) -> list[bytes]:
    """Runs of so many words, lower-cased A-Z and space-joined, repeats included; fewer words give one run."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    return list(map(b" ".join, zip(*[parts[i:] for i in range(words)], strict=False)))


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit SimHash as a signed integer; 0 without words."""
    from xxhash import xxh64_intdigest

    runs = shingles(text, words)
    if not runs:
        return 0
    hashes = np.array([xxh64_intdigest(s, SEED) for s in runs], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, fp long) per row of docs; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, fp long")


def links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) of the different fingerprints in prints(fp) that differ in at most radius bits.

    Of two such fingerprints one segment differs in at most radius // segments bits. Each fingerprint
    looks up every key of that Hamming ball round its segment; of the two ends of a pair only the one
    with a 0 at the mask's highest bit looks it up. Full distances decide. The join is merged: Spark judges a
    table by its file, which is a small part of what it takes when broadcast.
    """
    width, ball = 64 // segments, radius // segments
    if 64 % segments or width > 62:
        raise ValueError("segments must be 2 or more and divide 64")
    masks = [sum(1 << b for b in bits) for k in range(ball + 1) for bits in combinations(range(width), k)]
    literal = F.array(*[F.lit(m).cast("long") for m in masks])
    highest = F.array(*[F.lit(1 << (m.bit_length() - 1) if m else 0).cast("long") for m in masks])
    table = prints.select("fp", F.explode(F.array(*[F.lit(i) for i in range(segments)])).alias("segment"))
    table = table.withColumn("key", F.expr(f"shiftrightunsigned(fp, segment * {width})").bitwiseAND(F.lit((1 << width) - 1)))
    pairs = F.arrays_zip(literal.alias("mask"), highest.alias("high"))
    looked = table.select(F.col("fp").alias("a"), "segment", "key", F.explode(pairs).alias("m")).where(F.col("key").bitwiseAND(F.col("m.high")) == 0)
    looked = looked.select("a", "segment", F.col("key").bitwiseXOR(F.col("m.mask")).alias("key"), (F.col("m.mask") == 0).alias("same"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius) & F.when(F.col("same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
    entries = table.select(F.col("fp").alias("b"), F.col("segment").alias("s"), F.col("key").alias("k"))
    return looked.join(entries.hint("merge"), (F.col("segment") == F.col("s")) & (F.col("key") == F.col("k")) & near).select("a", "b")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (hex), component_id (smallest id reachable over links of at most radius bits).

    Null and empty texts have fingerprint zero and link like any other. Each row that repeats
    an id belongs with its own fingerprint; a null id takes part and names a component only if all its ids are null.
    An empty table gives no rows; columns not named are ignored.
    """
    require(docs, id_col, text_col)
    prints = materialize(fingerprints(docs, id_col, text_col, words), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    roots = components(links(nodes.select("fp"), radius))
    linked = materialize(roots.select(F.col("node").alias("fp"), "root"), "linked")
    names = linked.join(nodes.hint("merge"), "fp").groupBy("root").agg(F.min("first").alias("name"))
    named = linked.join(materialize(names, "names").hint("merge"), "root").select("fp", "name")
    known = materialize(nodes.join(named.hint("merge"), "fp", "left").select("fp", F.coalesce("name", "first").alias("component_id")), "known")
    out = prints.join(known.hint("merge"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_bands(text: str, words: int = 5) -> np.ndarray:
    """BANDS signed 64-bit hashes of bands of MinHash minima over the word shingles. Without words, that of no shingle."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        if parts:
            word = np.array(list(map(xxh64_intdigest, parts)), np.uint64)
            width = min(words, len(parts))
            h = np.zeros(len(parts) - width + 1, np.uint64)
            for i in range(width):
                h = (h ^ word[i : i + len(h)]) * _BASE
                h ^= h >> np.uint64(29)
            h32 = (h >> np.uint64(32)).astype(np.uint32)
            for at in range(0, len(h32), 256):
                v = h32[None, at : at + 256] * _MULTIPLY[:, None]
                v += _ADD[:, None]
                np.minimum(low, v.min(axis=1), out=low)
        x = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in low.reshape(BANDS, ROWS).T:
            x = (x ^ row.astype(np.uint64)) * _BASE
            x ^= x >> np.uint64(29)
    return x.view(np.int64)


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(s) for s in shingles(text, words)], dtype=np.uint64))


def print_buckets(items: DataFrame) -> DataFrame:
    """(bucket, item) of items(item, fp): a bucket for each component of fingerprints linked by at most RADIUS bits."""
    prints = materialize(items.select("fp").distinct(), "prints")
    roots = materialize(components(links(prints)).select(F.col("node").alias("fp"), "root"), "linked")
    return items.join(roots.hint("merge"), "fp", "left").select(F.xxhash64(F.lit("SimHash"), F.coalesce("root", "fp")).alias("bucket"), "item")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(item, alt, keep_id, size) for each text that is in a group with others: item and alt are two 64-bit hashes of the text, keep_id the group's smallest id.

    Two texts are linked when their sets of word shingles have a Jaccard similarity of at least `threshold`. Candidates
    share one of 32 bands of 4 MinHash minima over those same shingles, so that whether a pair is looked up depends on its similarity
    alone and not on where the texts differ: at 0.8 it is missed with probability 5e-8. Exact Jaccard
    decides. Texts whose 64-bit SimHashes over those shingles are linked by at most RADIUS bits, found by multi-index hashing as in near_groups, are candidates too. Equal texts are one item (128 bits tell texts apart; of texts that share only the first 64, one is grouped and the others stay); null and empty
    texts are left out.
    """
    bands = [f"b{i}" for i in range(BANDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([near_bands(t.as_py(), words) for t in batch.column(3)], np.int64).reshape(-1, BANDS)
            prints = pa.array([fingerprint(t.as_py(), words) for t in batch.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], prints, *[pa.array(made[:, i]) for i in range(BANDS)]], ["id", "item", "alt", "fp", *bands])

    item, alt = text_names(text_col)
    rows = docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).select(F.col(id_col).cast("long").alias("id"), item.alias("item"), alt.alias("alt"), F.col(text_col).alias("t"))
    made = rows.mapInArrow(run, "id long, item long, alt long, fp long, " + ", ".join(f"{b} long" for b in bands))
    first = F.min(F.struct("alt", "id")).alias("first")
    items = materialize(made.groupBy("item").agg(first, F.count(F.lit(1)).alias("n"), F.min("fp").alias("fp"), *[F.min(b).alias(b) for b in bands]), "items")
    items = items.withColumns({"alt": F.col("first.alt"), "first": F.col("first.id")})
    members = crowded(items.select(F.explode(F.array(*bands)).alias("bucket"), "item").union(print_buckets(items)))
    wanted = materialize(members.select("item").distinct().join(items.select("item", "alt"), "item"), "wanted")
    texts = thin(rows.select("item", "alt", F.col("t").alias("text")), wanted, "item").join(wanted, ["item", "alt"], "left_semi")
    texts = materialize(texts.groupBy("item", "text").agg(F.count(F.lit(1)).alias("n")).drop("n"), "texts")
    roots = materialize(components(similar_links(members, texts, lambda t: shingle_set(t, words), threshold)), "groups")
    groups = roots.join(items.select("item", "first", "n"), roots.node == items.item).groupBy("root").agg(F.min("first").alias("keep_id"), F.sum("n").alias("size"))
    linked = roots.join(materialize(groups, "named"), "root").select(F.col("node").alias("item"), "keep_id", "size")
    linked = materialize(linked, "linked")
    alone = items.where("n > 1").select("item", "alt", F.col("first").alias("keep_id"), F.col("n").alias("size")).join(linked, "item", "left_anti")
    return linked.join(items.select("item", "alt"), "item").select("item", "alt", "keep_id", "size").union(alone)


def text_names(text_col: str) -> tuple[F.Column, F.Column]:
    """128 bits that name a text."""
    return F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows of each near-duplicate group but the one of the smallest id. Equal rows that repeat that id all stay; null and empty texts stay."""
    known = materialize(near_duplicates(docs, id_col, text_col, words, threshold), "near-duplicates").toDF("__item", "__other", "__keep", "__size")
    item, alt = text_names(text_col)
    rows = docs.withColumns({"__text": item, "__alt": alt}).join(known, (F.col("__text") == F.col("__item")) & (F.col("__alt") == F.col("__other")), "left")
    return rows.where(F.col("__item").isNull() | F.col(id_col).cast("long").eqNullSafe(F.col("__keep"))).drop("__text", "__alt", "__item", "__other", "__keep", "__size")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir))
