"""Operator 11, byte-level BPE: monoid tree reduction of encodings, and decoding up the tree."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, require

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Stretches of at most so many bytes are merged directly: the leaves of the tree.
LEAF = 4
#: Encodings of stretches of at most SHORT bytes, and whether two tokens stay beside each other, are remembered: syllables repeat where words don't.
SHORT, MOST_SHORT = 12, 200_000
#: A worker remembers the ids of pieces of at most MOST_CHARS characters. When it has so many, they become the older half of its memory, and what was that goes.
REMEMBERED, MOST_CHARS = 250_000, 40
#: Bytes of an Arrow batch that a task sends on, about.
BATCH_BYTES = 4_000_000


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encodings:
    """Encodings of byte strings under one table of ranks, as a monoid.

    The encoding of a string merges, again and again, the adjacent pair of least rank, of equal ones the first. Two facts carry the tree:
    a sequence of tokens is the encoding of its bytes if and only if each two neighbours are the encoding of their bytes (until the first merge
    across a border, all parts change as they would alone, so that merge would be made in the two tokens beside that border alone, too); and so, where
    a window around the join of two encodings is encoded anew, all tokens outside stay if the window's outer tokens and their outer
    neighbours are such a pair. A token that was the same at that place before is one.
    """

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF) -> None:
        self.ranks, self.leaf = ranks, leaf
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.short: dict[bytes, list[int]] = {}
        self.beside: dict[tuple[int, int], bool] = {}

    def _merge(self, raw: bytes) -> list[int]:
        """The encoding by its definition; short strings only."""
        ranks = self.ranks
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_queue(self, raw: bytes) -> list[int]:
        """The same with a queue of pairs: for windows of any size."""
        ranks, n = self.ranks, len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
        queue = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two parts is not there any more
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (rank := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(queue, (rank, i, end[stop]))
            if (left := before[i]) >= 0 and (rank := ranks.get(raw[left:stop])) is not None:
                heapq.heappush(queue, (rank, left, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out

    def _window(self, raw: bytes) -> list[int]:
        if (got := self.short.get(raw)) is None:
            got = self._merge(raw) if len(raw) <= 64 else self._merge_queue(raw)
            self._remember(raw, got)
        return got

    def _remember(self, raw: bytes, ids: list[int]) -> None:
        if len(raw) <= SHORT:
            if len(self.short) >= MOST_SHORT:
                self.short.clear()
            self.short[raw] = ids

    def _stable(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes."""
        if (got := self.beside.get((left, right))) is None:
            if len(self.beside) >= MOST_SHORT:
                self.beside.clear()
            got = self.beside[left, right] = self._window(self.tokens[left] + self.tokens[right]) == [left, right]
        return got

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two strings' concatenation from their encodings. If the tokens at the border stay, all do; else windows grow twofold, each side
        by itself, until the tokens outside provably stay."""
        if not left or not right:
            return left or right
        if self._stable(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1  # the window is left[i:] + right[:j]
        while True:
            window = self._window(b"".join([self.tokens[t] for t in [*left[i:], *right[:j]]]))
            fine_left = i == 0 or window[0] == left[i] or self._stable(left[i - 1], window[0])
            fine_right = j == len(right) or window[-1] == right[j - 1] or self._stable(window[-1], right[j])
            if fine_left and fine_right:
                return [*left[:i], *window, *right[j:]]
            if not fine_left:
                i = max(0, i - (len(left) - i))
            if not fine_right:
                j = min(len(right), 2 * j)

    def encode(self, raw: bytes) -> list[int]:
        """Halves are encoded recursively and joined. What is a token as a whole is that token."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        return self._tree(raw)

    def _tree(self, raw: bytes) -> list[int]:
        if (got := self.short.get(raw)) is None:
            n = len(raw)
            if n <= self.leaf:
                got = self._merge(raw)
            else:  # beginnings of words repeat more than their middles
                half = 1 << ((n - 1).bit_length() - 1) if n <= SHORT else n // 2
                got = self.join(self._tree(raw[:half]), self._tree(raw[half:]))
            self._remember(raw, got)
        return got


def concatenate(tokens: list[bytes]) -> bytes:
    """Neighbours joined pairwise, level by level."""
    level = [b"".join(tokens[i : i + 1024]) for i in range(0, len(tokens), 1024)]
    while len(level) > 1:
        level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else b""


class _Pieces(dict):
    """Ids of a text's pieces, as 32-bit integers; most texts repeat theirs."""

    def __init__(self, encodings: Encodings) -> None:
        self.encodings, self.older = encodings, {}

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.older.get(piece)) is None:
            ids = array("i", self.encodings.encode(piece.encode())).tobytes()
        if len(piece) <= MOST_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[str, Encodings] = {}


def _encodings(path: str) -> Encodings:
    if path not in _loaded:
        _loaded[path] = Encodings(read_ranks(path))
    return _loaded[path]


def _batched(batches: Iterator[pa.RecordBatch], column: str, make: Callable[[pa.Array], Iterator], pack: Callable[[list], pa.Array]) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is replaced by pack() of what make() gives for its cells, byte strings; a batch goes on when these reach BATCH_BYTES."""
    for batch in batches:
        start, cells, held = 0, [], 0
        for row, cell in enumerate(make(batch.column(batch.num_columns - 1))):
            cells.append(cell)
            held += len(cell)
            if held >= BATCH_BYTES or row == batch.num_rows - 1:
                kept = [c.slice(start, len(cells)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pack(cells)], [*batch.schema.names[:-1], column])
                start, cells, held = row + 1, [], 0


def _id_lists(cells: list[bytes]) -> pa.Array:
    """Lists of 32-bit integers from their bytes."""
    ends = np.cumsum([0, *[len(c) // 4 for c in cells]], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cells), np.int32)))


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str | None = None, ids_col: str = "ids") -> DataFrame:
    """docs without text_col and with ids_col array<int>: each match of the pattern is encoded by the file's ranks, by itself.

    A null text is an empty one and has no ids. A text and a match may be of any length: a match is encoded as a tree, whose joins
    look at small windows. Repeated rows are encoded each on their own. An empty table gives no rows; the other columns are carried along, whatever their
    names; a column called ids_col is replaced. There is no shuffle. A worker remembers a bounded number of short pieces.
    """
    require(docs, text_col)
    kept = [c for c in docs.columns if c not in (text_col, ids_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces = _Pieces(_encodings(path or ranks_path()))
        split = regex.compile(pattern or split_pattern()).findall

        def make(texts: pa.Array) -> Iterator[bytes]:
            for text in texts:
                yield b"".join(map(pieces.__getitem__, split(text.as_py())))

        yield from _batched(batches, ids_col, make, _id_lists)

    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return rows.mapInArrow(run, _schema(rows, kept, f"`{ids_col}` array<int>"))


def decode(encoded: DataFrame, ids_col: str = "ids", path: str | None = None, bytes_col: str = "decoded") -> DataFrame:
    """encoded without ids_col and with bytes_col binary: the tokens' bytes, concatenated up a tree. Null ids are none. An id that has no token is an error."""
    require(encoded, ids_col)
    kept = [c for c in encoded.columns if c not in (ids_col, bytes_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _encodings(path or ranks_path()).tokens.__getitem__

        def make(lists: pa.Array) -> Iterator[bytes]:
            ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            for start, end in zip(ends, ends[1:], strict=False):
                yield concatenate(list(map(token, ids[start:end].tolist())))

        yield from _batched(batches, bytes_col, make, lambda cells: pa.array(cells, pa.binary()))

    rows = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(ids_col))
    return rows.mapInArrow(run, _schema(rows, kept, f"`{bytes_col}` binary"))


def _schema(rows: DataFrame, kept: list[str], last: str) -> str:
    return ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept], last])


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    decoded = decode(encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
