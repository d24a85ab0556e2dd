"""Operator 10, packing: power-of-two decomposition of tokenised documents, so no sequence crosses documents."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from string import punctuation
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, require

MAX_TOKENS, END_ID = 4096, 2
TOKENIZER = "word_bpe_49k.json"
#: Words of at most so many characters are remembered with their ids by a Python worker.
MOST_CHARS = 40
#: When so many are, they become the older half of its memory, and what was the older half goes: at any time twice as many words at most, of some 230 bytes.
REMEMBERED = 600_000
#: So many new words are encoded in one call.
AT_ONCE = 64


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _stays(last: str) -> bool:
    """Whether a letter or digit ends in one after normalisation; a dotted capital I, say, becomes two characters, of which the second is a mark."""
    return last.isalnum() and (last.isascii() or normalize("NFC", last).lower()[-1].isalnum())


class WordIds(dict):
    """The ids of a text's space-free parts, as little-endian unsigned 32-bit integers.

    The vocabulary's normaliser and splitter never look across white space, so the ids of a text are
    those of its parts, one after another.
    """

    def __init__(self, path: str, most: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.old = most, {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that only end a piece of the splitter
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True

    def __missing__(self, part: str) -> bytes:
        if (got := self.old.get(part)) is not None:
            pass
        elif "<|" in part:  # may hold a special token
            got = self.encode(part)
        elif (base := part.rstrip(punctuation)) != part and base and _stays(base[-1]):
            # ASCII punctuation after what the normaliser leaves a letter or digit: the splitter always cuts there
            got = self[base] + self[part[len(base) :]]
        elif part.isascii() and part != (low := part.lower()):  # the normaliser lower-cases
            return self[low]
        else:
            got = self.encode(part)
        if len(part) <= MOST_CHARS:
            self.age()
            self[part] = got
        return got

    def age(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()

    def encode(self, part: str) -> bytes:
        return struct.pack(f"<{len(ids := self.tokenizer.encode(part, add_special_tokens=False).ids)}I", *ids)

    def learn(self, parts: set[str]) -> None:
        """Encodes what are letters only, many at once: the splitter leaves such a word whole, and each piece of it ends in an id that ends nothing else."""
        words = [w for w in {p.rstrip(punctuation) for p in parts} if w.isalpha() and len(w) <= MOST_CHARS and w not in self and w not in self.old]
        for at in range(0, len(words), AT_ONCE):
            some = words[at : at + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(some):  # else a word was more than one piece
                raw = ids.tobytes()
                self.update(zip(some, [raw[start:end] for start, end in zip([0, *ends], ends, strict=False)], strict=True))
            self.age()

    def text(self, text: str) -> bytes:
        parts = _spaced(text).split(" ")
        found = list(map(self.get, parts))
        new = [i for i, got in enumerate(found) if got is None]
        self.learn({parts[i] for i in new})
        for i in new:
            found[i] = self[parts[i]]
        return b"".join(found)


def _spaced(text: str) -> str:
    """A text whose ids are those of its parts between spaces, one after another. Latin-1 texts, which the normaliser only lower-cases, are in lower case,
    and commas and full stops between a letter or digit and a space are parts of their own."""
    text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
    if "<|" not in text and _is_latin(text):
        text = text.lower()
        for mark in ",.":
            pieces = text.split(f"{mark} ")
            last = pieces.pop()
            text = "".join([*[f"{p} {mark} " if p[-1:].isalnum() else f"{p}{mark} " for p in pieces], last])
    return text


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


_loaded: dict[tuple[str, int], WordIds] = {}


def pieces(n: int, most: int = MAX_TOKENS) -> Iterator[tuple[int, int]]:
    """(start, length) of n ids cut into powers of two, the longest first; most is a power of two."""
    start = 0
    while n - start >= most:
        yield start, most
        start += most
    for bit in range(most.bit_length() - 2, -1, -1):
        if n - start >= 1 << bit:
            yield start, 1 << bit
            start += 1 << bit


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, most: int = MAX_TOKENS, with_ids: bool = False, remember: int = REMEMBERED) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, bucket (log2 of the length), [ids,] sequence_id, offset.

    A document's ids, with END_ID after them, are cut into pieces of a power of two of at most `most` ids. Each
    piece is a sequence of its own in the bucket of its length, so nothing is padded. A null text is an
    empty one and gives one piece (END_ID alone). Rows with repeated or null ids are packed each on its own.
    An empty table gives no rows; columns not named are ignored. There is no shuffle. A Python worker remembers the ids of at most twice `remember` words.
    """
    require(docs, id_col, text_col)
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    name = path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = name or tokenizer_path()
        if (file, remember) not in _loaded:
            _loaded[file, remember] = WordIds(file, remember)
        words, end = _loaded[file, remember], END_ID.to_bytes(4, "little")
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            blobs: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(words.text(text.as_py() or "") + end)
                n = len(ids) // 4
                for start, length in pieces(n, most):
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, start, length, zlib.crc32(part), n, length.bit_length() - 1), strict=True):
                        column.append(value)
                    if with_ids:
                        blobs.append(bytes(part))
            arrays = [pa.array(c, pa.int32() if i == 5 else pa.int64()) for i, c in enumerate(out)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
            if with_ids:
                arrays, names = [*arrays, pa.array(blobs, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids binary" * with_ids
    cut = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
