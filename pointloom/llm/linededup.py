"""Operator 2, line dedup: fuzzy lines by MinHash over character shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import Bitmap
from .common import documents, materialize, require
from .components import components
from .verify import crowded, similar_links

SHINGLE, THRESHOLD = 8, 0.8
#: 8 bands of 4 minima: two lines at similarity 0.8 share a band with probability 0.985, at 0.9 with 0.9999.
BANDS, ROWS = 8, 4
_rng = np.random.default_rng(2)
_MULTIPLY = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def normal(line: str) -> str:
    """What two equal lines have in common: lower case, white space as one space."""
    low = line.lower()
    # white space but the space is not printable
    return low.strip(" ") if "  " not in low and low.isprintable() else " ".join(low.split())


def key(line: str, bits: int = 64) -> tuple[int, int]:
    """128 bits that name a line: the first 64 (or fewer, in tests) group, the others tell lines apart that share them."""
    from xxhash import xxh3_128_intdigest

    h = xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h >> (128 - bits)) - (1 << (bits - 1)), (h & ((1 << 64) - 1)) - (1 << 63)


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all SHINGLE-character runs of the lines, number of them in each line); a shorter line is one run."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(x) for x in padded])
    with np.errstate(over="ignore"):
        h, width, power = code * np.uint64(0xD6E8FEB86659FD93), 1, _BASE
        while width < SHINGLE:
            h = h[:-width] * power + h[width:]
            power, width = power * power, 2 * width
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    ends = np.cumsum(sizes)
    valid = np.ones(len(code), bool)
    for back in range(1, SHINGLE):
        valid[ends - back] = False
    return h[valid[: len(h)]], sizes - SHINGLE + 1


def shingle_set(line: str) -> np.ndarray:
    return np.unique(shingle_hashes([line])[0])


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """shingle_set of each line."""
    out: list[np.ndarray] = []
    while len(out) < len(lines):
        some, size = [], 0
        while len(out) + len(some) < len(lines) and size < 100_000:
            some.append(lines[len(out) + len(some)])
            size += len(some[-1])
        hashes, counts = shingle_hashes(some)
        for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
            mine = np.sort(hashes[end - n : end])
            out.append(mine[np.concatenate([[True], mine[1:] != mine[:-1]])])
    return out


def band_hashes(lines: list[str]) -> np.ndarray:
    """(lines, BANDS) signed 64-bit hashes of bands of MinHash minima."""
    out = np.empty((len(lines), BANDS), np.int64)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (size < 100_000 or end == at):
            size += len(lines[end])
            end += 1
        h, counts = shingle_hashes(lines[at:end])
        h32, starts = (h >> np.uint64(32)).astype(np.uint32), np.cumsum(counts) - counts
        low = np.empty((BANDS * ROWS, end - at), np.uint32)
        v = np.empty_like(h32)
        with np.errstate(over="ignore"):
            for k in range(BANDS * ROWS):
                np.multiply(h32, _MULTIPLY[k], out=v)
                np.add(v, _ADD[k], out=v)
                low[k] = np.minimum.reduceat(v, starts)
            for band in range(BANDS):
                x = np.full(end - at, band + 1, np.uint64)
                for row in low[band * ROWS : (band + 1) * ROWS]:
                    x = (x ^ row.astype(np.uint64)) * _BASE
                    x ^= x >> np.uint64(29)
                out[at:end, band] = x.view(np.int64)
        at = end
    return out


def _signatures(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where: list[tuple] = []
            lines: list[str] = []
            for id_, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for pos, line in enumerate((text.as_py() or "").split("\n")):
                    if line := normal(line):
                        where.append((*key(line, bits), id_, th, pos))
                        lines.append(line)
            bands = band_hashes(lines)
            columns = [pa.array([w[i] for w in where], pa.int64()) for i in range(5)] + [pa.array(bands[:, i]) for i in range(BANDS)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "alt", "id", "th", "pos", *[f"b{i}" for i in range(BANDS)]])

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, key_bits: int = 64) -> DataFrame:
    """docs with text_col replaced and n_lines, n_removed: of each group of similar lines, over all texts, the first stays.

    Lines are split at newlines and compared in lower case with white space as one space; two are linked when
    their sets of 8-character shingles have a Jaccard similarity of at least `threshold`, and groups are components of
    links. The first line is the one of the smallest id (null first), then text hash, then position. Blank lines are
    neither compared nor removed. Rows that repeat id and text count as one row. Null texts stay null, with no lines; a
    text may lose all its lines and is then empty. An empty table gives no rows; other columns are kept (not ones named n_lines or n_removed).
    """
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("t"))
    bands = [f"b{i}" for i in range(BANDS)]
    lines = slim.mapInArrow(_signatures(key_bits), "key long, alt long, id long, th long, pos long, " + ", ".join(f"{b} long" for b in bands))
    # of lines that share the first 64 bits only, one is grouped and the others stay
    first = F.min(F.struct("alt", "id", "th", "pos")).alias("first")
    distinct = materialize(lines.groupBy("key").agg(first, F.count(F.lit(1)).alias("n"), *[F.min(b).alias(b) for b in bands]), "lines")
    members = crowded(distinct.select(F.explode(F.array(*bands)).alias("bucket"), F.col("key").alias("item")))
    wanted = materialize(members.select(F.col("item").alias("key")).union(distinct.where("n > 1").select("key")).distinct(), "wanted")
    maybe = docs.sparkSession.sparkContext.broadcast(Bitmap.of(wanted, "key"))  # None: the joins below pick the lines

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for id_, th, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = [(pos, x) for pos, line in enumerate(text_.as_py().split("\n")) if (x := normal(line))]
                names = [key(x, key_bits) for _, x in found]
                keys = np.array([a for a, _ in names], np.int64)
                out += [(*names[k], id_, th, *found[k]) for k in (np.flatnonzero(maybe.value.has(keys)) if maybe.value else range(len(keys)))]
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(6)], ["key", "alt", "id", "th", "pos", "line"])

    found = materialize(slim.mapInArrow(occurrences, "key long, alt long, id long, th long, pos long, line string"), "occurrences")
    items = members.select(F.col("item").alias("key")).distinct()
    # folded before the shuffle: a common line has very many occurrences
    texts = materialize(found.groupBy("key").agg(F.min(F.struct("alt", "line"))["line"].alias("text")).join(items, "key", "left_semi"), "texts")
    texts = texts.withColumnRenamed("key", "item")
    roots = materialize(components(similar_links(members, texts, shingle_set, threshold, sets_of=shingle_sets)), "groups")
    firsts, place = distinct.select("key", "first", "n"), F.struct("first.id", "first.th", "first.pos")
    kept = roots.join(firsts, roots.node == firsts.key).groupBy("root").agg(F.min(place).alias("keep"))
    linked = roots.join(materialize(kept, "kept"), "root").select(F.col("node").alias("key"), "keep")
    keeps = firsts.join(materialize(linked, "linked"), "key", "left").where("n > 1 or keep is not null").select("key", F.col("first.alt").alias("mine"), F.coalesce(F.col("keep"), place).alias("keep"))
    at = F.struct("id", "th", "pos")
    gone = found.drop("line").join(materialize(keeps, "keeps"), "key").where((F.col("alt") == F.col("mine")) & ~at.eqNullSafe(F.col("keep")))
    gone = materialize(gone.groupBy("id", "th").agg(F.collect_set("pos").alias("gone")), "gone")
    gone = gone.toDF("__gone_id", "__gone_th", "__gone")
    pieces = F.split(F.col(text_col), "\n", -1)
    joined = docs.withColumn("__gone_key", F.xxhash64(text)).join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__gone_id")) & (F.col("__gone_key") == F.col("__gone_th")), "left")
    left = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("__gone", i.cast("long"))), "\n")
    out = joined.withColumn("n_lines", F.coalesce(F.size(pieces), F.lit(0)).cast("long")).withColumn("n_removed", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
    out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.col("n_lines"))).withColumn("n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.col("n_removed")))
    return out.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left)).drop("__gone", "__gone_id", "__gone_th", "__gone_key")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(kept, 256).alias("kept_sha256"), F.length(kept).cast("long").alias("kept_chars"))
