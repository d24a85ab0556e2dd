"""Operator 9, repeated-substring dedup: a suffix sort sharded by minimiser.

Every WIDTH-byte window belongs to the leftmost of its smallest KGRAM-byte grams, its anchor. Equal windows
have equal anchors at equal offsets, so all suffixes that can share WIDTH bytes meet in the shard of one
anchor; suffixes whose anchor occurs once are settled by a count. In a shard, suffixes are sorted by the hash of
their first WIDTH bytes and offset; neighbours whose hashes agree are compared byte by byte. Classes of equal
pieces are found by their bytes and named by 128 bits (a hash of the anchor's gram and one of the piece).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import KEYS, Bitmap
from .common import documents, materialize, require

WIDTH, KGRAM = 400, 128
#: An anchor with more different contexts than this is settled by counting its windows instead of in one task.
SHARD_CLASSES = 1_000
#: So many windows of a text are hashed at once, and so many bytes of pieces leave a Python worker at once.
CHUNK, FLUSH = 1 << 20, 1 << 23
_POS = np.uint64((1 << 28) - 1)
_TABLE = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of every `width` bytes of data, by doubling."""
    power, at = _TABLE[data], 0
    out: np.ndarray | None = None
    size, left = 1, width
    with np.errstate(over="ignore"):
        while True:
            if left & 1:
                part = power[at:]
                if out is None:
                    out = part
                else:
                    n = min(len(out), len(part))
                    out = out[:n] * np.uint64(pow(_BASE, size, 1 << 64)) + part[:n]
                at += size
            left >>= 1
            if not left:
                break
            power = power[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:]
            size *= 2
    return out[: max(0, len(data) - width + 1)]


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def runs(data: np.ndarray, width: int = WIDTH, gram: int = KGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, hash of the anchor's gram) of each run of windows with one anchor, for less than 2**28 bytes."""
    n = len(data) - width + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    grams = _mix(rolling(data, gram))
    key = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    w = width - gram + 1
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    square = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    anchor = (low & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return first, last, anchor[first], grams[anchor[first]].view(np.int64)


def _hash(piece: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(piece) - (1 << 63)


def all_runs(raw: bytes, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """runs() of a text of any length, `chunk` windows at a time; a run across two chunks comes in two parts."""
    data = np.frombuffer(raw, np.uint8)
    for at in range(0, len(data) - WIDTH + 1, chunk):
        first, last, anchor, h = runs(data[at : at + chunk + WIDTH - 1])
        yield first + at, last + at, anchor + at, h


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.column(0):
            for *_, h in all_runs(t.as_py()):
                yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])


def _bytes_agree(flat: np.ndarray, i: np.ndarray, j: np.ndarray) -> bool:
    """Whether the WIDTH bytes at i[k] equal those at j[k] for every k."""
    windows = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)
    return all(np.array_equal(windows[i[k : k + 16_384]], windows[j[k : k + 16_384]]) for k in range(0, len(i), 16_384))


def _settle(groups: tuple[np.ndarray, ...], texts: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(h, u, lowest offset, highest offset) of the stretches of repeated windows of classes (h, u, lo, hi, n) with their texts."""
    h, u, lo, hi, n = groups
    sizes = np.array([len(t) for t in texts])
    start = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(texts), np.uint8)
    hashes = rolling(flat, WIDTH)
    count = hi - lo + 1
    owner = np.repeat(np.arange(len(h)), count)
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    offset, place = hi[owner] - step, start[owner] + step
    with np.errstate(over="ignore"):
        key = _mix(hashes[place] + h[owner].view(np.uint64) * np.uint64(_BASE)) + offset.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    one, two = order[:-1][same], order[1:][same]
    if not (np.array_equal(offset[one], offset[two]) and np.array_equal(h[owner[one]], h[owner[two]]) and _bytes_agree(flat, place[one], place[two])):
        # two different windows have one hash: number them by their bytes instead
        known: dict[tuple, int] = {}
        whole = flat.tobytes()
        key = np.array([known.setdefault((int(h[o]), int(f), whole[p : p + WIDTH]), len(known)) for o, f, p in zip(owner, offset, place, strict=True)])
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        one, two = order[:-1][same], order[1:][same]
    again = n[owner] > 1
    again[one] = again[two] = True
    edge = np.diff(np.concatenate([[0], again.astype(np.int8), [0]]))
    new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    split = np.flatnonzero(new & again & np.concatenate([[False], again[:-1]]))
    begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), split]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), split])) - 1
    return [(int(h[o]), int(u[o]), int(offset[e]), int(offset[b])) for b, e, o in zip(begin, end, owner[begin], strict=True)]


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h. Whole groups of one h are settled together, some megabytes at a time."""
    rows: list[tuple] = []
    size = 0

    def done(part: list[tuple]) -> pa.RecordBatch:
        columns = tuple(np.array([r[i] for r in part], np.int64) for i in range(5))
        found = _settle(columns, [r[5] for r in part])
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(4)], ["h", "u", "a", "b"])

    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
            if size > 2_000_000 and row[0] != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[5])
    if rows:
        yield done(rows)


_PIECE = "id long, th long, first long, last long, n long, h long, u long, lo long, hi long, piece binary"


class _Pieces:
    """Collects the pieces of texts for found(); equal pieces of one text at most WIDTH bytes apart are one row, as what they cover is in one run."""

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.open: dict[bytes, list] = {}
        self.size = 0

    def add(self, id_: int | None, th: int, raw: bytes, s0: int, s1: int, a: int, h: int) -> None:
        piece = raw[s0 : s1 + WIDTH]
        row = self.open.get(piece)
        if row and a - row[3] <= WIDTH:
            row[3], row[4] = a, row[4] + 1
            return
        row = [id_, th, a, a, 1, h, _hash(piece), a - s1, a - s0, piece]
        self.open[piece] = row
        self.rows.append(row)
        self.size += len(piece)

    def flush(self) -> pa.RecordBatch:
        arrays = [pa.array([r[i] for r in self.rows], pa.binary() if i == 9 else pa.int64()) for i in range(10)]
        self.__init__()
        return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _PIECE.split(", ")])


def _cut_by(maybe: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Cuts rows (id, th, t) into the pieces of the runs whose anchors pass."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _Pieces()
        for batch in batches:
            for id_, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py()
                pieces.open.clear()
                for first, last, anchor, h in all_runs(raw):
                    for k in np.flatnonzero(maybe(h)):
                        pieces.add(id_, th, raw, int(first[k]), int(last[k]), int(anchor[k]), int(h[k]))
                        if pieces.size > FLUSH:
                            yield pieces.flush()
        yield pieces.flush()

    return cut


def _cut_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for rows (id, th, t, runs array<struct<s0, s1, a, h>>)."""
    pieces = _Pieces()
    for batch in batches:
        for id_, th, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            raw = text.as_py()
            pieces.open.clear()
            for r in found.values.to_pylist():
                pieces.add(id_, th, raw, r["s0"], r["s1"], r["a"], r["h"])
                if pieces.size > FLUSH:
                    yield pieces.flush()
    yield pieces.flush()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for id_, th, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            for first, last, anchor, h in all_runs(text.as_py()):
                arrays = [pa.array([x.as_py()] * len(h), pa.int64()) for x in (id_, th)] + [pa.array(x) for x in (first, last, anchor, h)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "th", "s0", "s1", "a", "h"])


def _found(placed: DataFrame, twice: DataFrame, bitmap_keys: int) -> DataFrame:
    """The pieces of the runs of placed(id, th, t) whose anchors are in twice(h), and of few others: in one scan behind a bitmap of fixed
    size, or, for more anchors than it can tell apart, by a join of places and then of the texts that hold them."""
    maybe = Bitmap.of(twice, "h", most=bitmap_keys)
    if maybe:
        shared = placed.sparkSession.sparkContext.broadcast(maybe)
        return placed.mapInArrow(_cut_by(lambda h: shared.value.has(h)), _PIECE)
    places = placed.mapInArrow(_places, "id long, th long, s0 long, s1 long, a long, h long").join(twice, "h", "left_semi").distinct()
    held = places.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("s0", "s1", "a", "h"))).alias("runs")).toDF("id_", "th_", "runs")
    rows = placed.join(held, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_"))).select("id", "th", "t", "runs")
    return rows.mapInArrow(_cut_at, _PIECE)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, shard_classes: int = SHARD_CLASSES, bitmap_keys: int = KEYS) -> DataFrame:
    """(id, th, spans array<struct<from, to>>) of the rows of docs that hold repeated windows; th: xxhash64 of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.where(F.octet_length("t") >= WIDTH)
    anchors = rows.select(F.col("t").cast("binary")).mapInArrow(_anchors, "h long")
    twice = materialize(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "anchors")
    found = materialize(_found(rows.select("id", F.xxhash64("t").alias("th"), F.col("t").cast("binary").alias("t")), twice, bitmap_keys), "runs")
    # equal pieces of one anchor are one class: grouping compares their bytes
    classes = materialize(found.groupBy("h", "u", "lo", "hi", "piece").agg(F.sum("n").alias("n")), "classes")
    groups = materialize(classes.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n")).where("k > 1 or n > 1"), "groups")
    hot = groups.where(F.col("k") > shard_classes).select("h")
    alone = groups.where("k = 1").select("h")
    mixed = groups.where(F.col("k").between(2, shard_classes)).select("h")
    whole = classes.drop("piece").join(alone, "h", "left_semi").select("h", "u", F.col("lo").alias("a"), F.col("hi").alias("b"))
    parts = classes.join(mixed, "h", "left_semi").select("h", "u", "lo", "hi", "n", "piece")
    settled = parts.repartition("h").sortWithinPartitions("h").mapInArrow(_shard, "h long, u long, a long, b long")
    result = whole.union(settled)
    if hot.count():
        result = result.union(_by_windows(classes.join(hot, "h", "left_semi")))
    # one row a class: its stretches in an array, so that the join makes a row for each occurrence and no more
    stretches = materialize(result.groupBy("h", "u").agg(F.collect_list(F.struct("a", "b")).alias("parts")), "settled")
    spans = found.select("id", "th", "first", "last", "h", "u").join(stretches, ["h", "u"])
    span = F.transform("parts", lambda p: F.struct((F.col("first") - p["b"]).alias("from"), (F.col("last") - p["a"] + WIDTH).alias("to")))
    return spans.select("id", "th", F.explode(span).alias("span")).groupBy("id", "th").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def prime_hash(data: np.ndarray, width: int) -> np.ndarray:
    """Two polynomial hashes of every `width` bytes to different bases modulo 2**31 - 1, side by side in 62 bits."""
    prime, out = np.uint64((1 << 31) - 1), np.zeros(max(0, len(data) - width + 1), np.uint64)
    for base in (1_000_003, 1_664_525_011 % ((1 << 31) - 1)):
        power, got, at, size, left = data.astype(np.uint64) + np.uint64(1), None, 0, 1, width
        while left:
            times = np.uint64(pow(base, size, int(prime)))
            if left & 1:
                part = power[at:]
                n = min(len(part), len(part) if got is None else len(got))
                got = part[:n] if got is None else (got[:n] * times + part[:n]) % prime
                at += size
            left >>= 1
            if left:
                power = (power[:-size] * times + power[size:]) % prime
                size *= 2
        out = (out << np.uint64(31)) | got[: len(out)]
    return out


def _by_windows(classes: DataFrame) -> DataFrame:
    """The same by counting: a row for each window of a class, folded by content before the shuffle. Windows are told apart
    by 126 bits (two independent hashes), their anchors' hash and their offset."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, u, lo, hi, n = (np.array(batch.column(i).to_pylist(), np.int64) for i in range(5))
            for i, piece in enumerate(batch.column(5).to_pylist()):
                data = np.frombuffer(piece, np.uint8)
                hashes = [_mix(rolling(data, WIDTH)).view(np.int64), prime_hash(data, WIDTH).view(np.int64)]
                m = len(hashes[0])
                columns = [np.full(m, h[i]), np.full(m, u[i]), hi[i] - np.arange(m), np.full(m, n[i]), *hashes]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "u", "o", "n", "w", "v"])

    windows = classes.select("h", "u", "lo", "hi", "n", "piece").mapInArrow(cut, "h long, u long, o long, n long, w long, v long")
    windows = materialize(windows, "windows")
    keys = ["h", "o", "w", "v"]
    twice = windows.groupBy(*keys).agg(F.sum("n").alias("all")).where("all > 1").select(*keys)
    again = windows.join(materialize(twice, "twice"), keys, "left_semi")
    # consecutive offsets of a class are one stretch
    offsets = again.groupBy("h", "u").agg(F.array_sort(F.collect_list("o")).alias("o"))
    begin = F.filter("o", lambda x, i: (i == 0) | (F.get("o", i - 1) != x - 1))
    end = F.filter("o", lambda x, i: (i == F.size("o") - 1) | (F.get("o", i + 1) != x + 1))
    pairs = offsets.select("h", "u", F.explode(F.arrays_zip(begin.alias("a"), end.alias("b"))).alias("p"))
    return pairs.select("h", "u", "p.a", "p.b")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept_chars[, kept binary].

    Every byte goes that is covered by a 400-byte string which starts at another place of any text too.
    Texts are UTF-8 bytes, null is empty; strings never cross texts and are judged on the input. Rows that
    repeat an id are texts of their own (equal rows repeat each other wholly, if 400 bytes or longer). An
    empty table gives no rows; other columns are ignored. Texts are hashed in chunks, so that their length is not limited.
    """
    require(docs, id_col, text_col)
    spans = materialize(repeated_spans(docs, id_col, text_col), "spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("t"), F.xxhash64(text).alias("th"))
    known = spans.select(F.col("id").alias("id_"), F.col("th").alias("th_"), "spans")
    rows = rows.join(known, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left").select("id", "t", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for text, spans_ in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py()
                kept, at, removed, n = [], 0, 0, 0
                for s in spans_ or ():
                    begin, end = s["from"], s["to"]
                    if n == 0 or begin > at:
                        kept.append(raw[at:begin])
                        n += 1
                        at = begin
                    if end > at:
                        removed += end - at
                        at = end
                kept.append(raw[at:])
                left = b"".join(kept)
                # characters left: bytes that begin one
                chars = int(((np.frombuffer(left, np.uint8) & 0xC0) != 0x80).sum())
                for column, value in zip(out, (len(raw), removed, n, hashlib.sha256(left).hexdigest(), len(left), chars, left), strict=True):
                    column.append(value)
            arrays = [batch.column(0), *[pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(out[:6])]]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept_chars"]
            if with_text:
                arrays, names = [*arrays, pa.array(out[6], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept_chars long" + ", kept binary" * with_text
    return rows.mapInArrow(cut, schema).withColumnRenamed("id", id_col)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_kept counts the code points left, the unit in which documents state their lengths; bytes left are n_bytes - n_removed."""
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("kept_chars").alias("n_kept"))


#: Windows of the hexadecimal text by their position, cut from blocks of 512 bytes so that none is sought from a text's start.
OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT r, c.c AS c0, substr(x, 2 * c.c + 1, 2 * (512 + {WIDTH} - 1)) AS y FROM d, unnest(range(0, greatest(length(x) // 2 - {WIDTH} + 1, 0), 512)) AS c(c)),
w AS (SELECT r, c0 + j.j AS i, md5(substr(y, 2 * j.j + 1, 2 * {WIDTH})) AS w FROM b, unnest(range(0, least(512, length(y) // 2 - {WIDTH} + 1))) AS j(j)),
t AS (SELECT r, i FROM w WHERE w IN (SELECT w FROM w GROUP BY w HAVING count(*) > 1)),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER o <= {WIDTH} THEN 0 ELSE 1 END AS new FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
p AS (SELECT r, k, min(i) AS a, max(i) + {WIDTH} AS z FROM s GROUP BY r, k),
q AS (SELECT p.r, k, a, z, coalesce(lag(z) OVER (PARTITION BY p.r ORDER BY k), 0) AS before FROM p),
kept AS (SELECT q.r, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS z, string_agg(substr(x, 2 * before::BIGINT + 1, 2 * (a - before)::BIGINT), '' ORDER BY k) AS y
  FROM q JOIN d USING (r) GROUP BY q.r),
o AS (SELECT doc_id, x, n_removed, n_spans, coalesce(y, '') || substr(x, 2 * coalesce(z, 0)::BIGINT + 1) AS left_ FROM d LEFT JOIN kept USING (r))
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(left_)) AS kept_sha256,
  len(list_filter(regexp_extract_all(left_, '..'), lambda b: b[1] NOT IN ('8', '9', 'A', 'B')))::BIGINT AS n_kept FROM o
"""
