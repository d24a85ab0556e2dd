"""Operator 5, language identification: a byte convolutional network trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, require

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 8, 6
#: The training sample holds about so many rows of each language, and so many characters of each row.
SAMPLE_ROWS, SAMPLE_CHARS = 1_500, 800
EPOCHS, BATCH, SEED = 8, 128, 7
UNKNOWN = "und"
HAS_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    """Embedded bytes, filters of several widths, rectified, their maxima over a window, softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The filters summed per pair of bytes: for bytes t and t+1 of all widths, byte t+2 of width 3, bytes t+2 and t+3 of width 4."""
        tap = [[(self.embed @ w[j]).astype(np.float32) for j in range(len(w))] for w in self.filters]
        two = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        head = np.concatenate([two(t[0], t[1]) + b for t, b in zip(tap, self.bias, strict=True)], axis=1)
        return np.ascontiguousarray(head, np.float32), tap[1][2], two(tap[2][2], tap[2][3])

    def probabilities(self, windows: np.ndarray, tables: tuple) -> np.ndarray:
        """windows: (n, WINDOW) bytes."""
        head, third, tail = tables
        k, out = FILTERS, np.empty((len(windows), len(self.langs)), np.float32)
        for at in range(0, len(windows), 64):
            b = windows[at : at + 64]
            pair = (b[:, :-1].astype(np.uint16) << 8) | b[:, 1:]
            conv = head[pair]
            conv[:, :-1, k : 2 * k] += third[b[:, 2:]]
            conv[:, :-2, 2 * k :] += tail[pair[:, 2:]]
            top = np.concatenate([conv[:, :, :k].max(1), conv[:, :-1, k : 2 * k].max(1), conv[:, :-2, 2 * k :].max(1)], axis=1)
            out[at : at + 64] = _softmax(np.maximum(top, 0) @ self.dense + self.dense_bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(text: bytes) -> np.ndarray:
    """All of a text as windows of WINDOW bytes, one after another, the last one filled up with zeros."""
    n = -(-len(text) // WINDOW) or 1
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
    """Seeded minibatch training with Adam; languages weigh alike. A third of the windows is cut short, so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    code = {x: i for i, x in enumerate(names)}
    xs, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        for row in cut(text.encode("utf-8", "surrogatepass"))[:3]:
            row = row.copy()
            if rng.random() < 1 / 3:
                row[rng.integers(8, WINDOW) :] = 0
            xs.append(row)
            ys.append(code[lang])
    x, y = np.array(xs, np.uint8).reshape(-1, WINDOW), np.array(ys, np.int64)
    weight = (len(y) / (len(names) * np.bincount(y, minlength=len(names)).clip(1)))[y] if len(y) else np.ones(0)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)), "d": rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(names))), "o": np.zeros(len(names))}
    for w in WIDTHS:
        p |= {f"w{w}": rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            b, n = x[rows], len(rows)
            emb = p["e"][b]
            tops, where = [], []
            for w in WIDTHS:
                t = WINDOW - w + 1
                conv = sum(emb[:, j : j + t] @ p[f"w{w}"][j] for j in range(w)) + p[f"b{w}"]
                arg = conv.argmax(1)
                where.append(arg)
                tops.append(np.take_along_axis(conv, arg[:, None, :], 1)[:, 0])
            top = np.concatenate(tops, 1)
            act = np.maximum(top, 0)
            dz = _softmax(act @ p["d"] + p["o"])
            dz[np.arange(n), y[rows]] -= 1
            dz = (dz * weight[rows, None] / n).astype(np.float32)
            grad = {"d": act.T @ dz, "o": dz.sum(0), "e": np.zeros_like(p["e"])}
            dtop = (dz @ p["d"].T) * (top > 0)
            for i, w in enumerate(WIDTHS):
                g = dtop[:, i * FILTERS : (i + 1) * FILTERS]
                grad[f"b{w}"], gw = g.sum(0), np.zeros_like(p[f"w{w}"])
                for j in range(w):
                    byte = b[np.arange(n)[:, None], where[i] + j]
                    gw[j] = np.einsum("nfe,nf->ef", p["e"][byte], g)
                    np.add.at(grad["e"], byte.ravel(), (g[:, :, None] * p[f"w{w}"][j].T[None]).reshape(-1, EMBED))
                grad[f"w{w}"] = gw
            step += 1
            for k, g in grad.items():
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                p[k] -= 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCNN(names, p["e"], [p[f"w{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["d"], p["o"])


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> DataFrame:
    """About `rows` labelled rows of each language, each a stretch of `chars` characters at a seeded place. One scan, no shuffle of texts."""
    counts = {r[0]: r[1] for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(lang_col).count().collect()}  # one row a language
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1_000_000)) / 1_000_000
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = F.when(F.col(lang_col) == lang, draw < rows / n).otherwise(keep)
    start = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED + 1)), F.greatest(F.length(text_col) - chars, F.lit(1)).cast("long")).cast("int") + 1
    text = F.substring(F.col(text_col), start, F.lit(chars))
    picked = labelled.where(keep & F.col(text_col).rlike(r"\p{L}")).select(text.alias("text"), F.col(lang_col).alias("lang"))
    return picked.orderBy("lang", "text")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCNN | None:
    """None if no row outside the held-out fold has a label and a letter."""
    rows = sample(docs.where(~held_out(id_col)), id_col, text_col, lang_col).collect()  # bounded by SAMPLE_ROWS x SAMPLE_CHARS a language
    return train([r.text for r in rows], [r.lang for r in rows]) if rows else None


def identify(docs: DataFrame, model: ByteCNN | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score, and the columns of carry.

    A text's probabilities are the means over all its windows, by the bytes in them; the language of the
    largest is the prediction (the first by name of equal ones), its probability the score. A text that
    is null or has no letter, and every text without a model, is `und` with score 0. Rows with repeated
    or null ids are predicted each on its own (a null id is not held out). An empty table gives no rows;
    columns not named are ignored.
    """
    require(docs, id_col, text_col, *carry)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text_"), held_out(id_col).alias("held_out"), *[F.col(c).alias(f"carry_{c}") for c in carry])
    made: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is not None and not made:
            made.append(model.tables())
        for batch in batches:
            langs, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
            texts = [t.as_py() for t in batch.column(1)]
            todo = [i for i, t in enumerate(texts) if t and model is not None and HAS_LETTER.search(t)]
            for at in range(0, len(todo), 256):
                part = todo[at : at + 256]
                raw = [texts[i].encode("utf-8", "surrogatepass") for i in part]
                cuts = [cut(r) for r in raw]
                sizes = np.array([len(c) for c in cuts])
                p = model.probabilities(np.concatenate(cuts), made[0])
                filled = np.full(len(p), WINDOW, np.float32)
                ends = np.cumsum(sizes)
                filled[ends - 1] = [len(r) - (len(c) - 1) * WINDOW for r, c in zip(raw, cuts, strict=True)]
                mean = np.add.reduceat(p * filled[:, None], ends - sizes, axis=0) / np.array([len(r) for r in raw])[:, None]
                for i, best, score in zip(part, mean.argmax(1), mean.max(1), strict=True):
                    langs[i], scores[i] = model.langs[best], min(1.0, float(score))
            columns = [batch.column(0), batch.column(2), pa.array(langs), pa.array(scores), *[batch.column(j) for j in range(3, batch.num_columns)]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "lang_pred", "score", *batch.schema.names[3:]])

    kinds = dict(picked.dtypes)
    schema = ", ".join(["id long", "held_out boolean", "lang_pred string", "score double", *[f"`carry_{c}` {kinds[f'carry_{c}']}" for c in carry]])
    out = picked.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", *[F.col(f"carry_{c}").alias(c) for c in carry])


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
