"""Operator 12, spelling variant grouping: forward and backward minimal automata find words one error apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, require

#: Letters of a word, once A-Z are lower-cased.
LETTERS = "a-zÀ-ÿ"
MIN_CHARS, MIN_COUNT, TIMES = 6, 5, 5
#: One run in so many of a document's different runs loses a letter.
LOSS = 199
#: Members of an automaton's shard, on average, and of a group of words that is not divided further.
SHARD = MOST = 20_000
#: A Python worker sends its counts on when it holds so many.
HELD = 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, loss: int = LOSS) -> DataFrame:
    """word, n: maximal runs of letters, A-Z lower-cased. If `loss` divides h, the crc32 of '<id>:<run>', the run loses its letter number
    h modulo its length. A null id counts as '', a null text has no words. Only what has min_chars letters then and min_count occurrences is a word."""
    require(docs, id_col, text_col)
    runs = re.compile(f"[{LETTERS}]{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(seen)
            for at in range(0, len(words), HELD):
                some = words[at : at + HELD]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([seen[w] for w in some], pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for found, n in Counter(runs.findall(text.as_py().lower().decode())).items():
                    h = zlib.crc32(found.encode(), start)
                    if h % loss == 0:
                        at = h % len(found)
                        found = found[:at] + found[at + 1 :]
                        if len(found) < min_chars:
                            continue
                    seen[found] += n
                if len(seen) > HELD:
                    yield from flush()
        yield from flush()

    # lower() of bytes changes A-Z only
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words. Each edge knows how many words come before those behind it,
    so that the sum along a path is the word's number (from 0, in order): a perfect hash."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._words_from: list[int] = []
        known: dict[tuple, int] = {}

        def settle(final: bool, edges: dict[str, int]) -> int:
            key = (final, tuple(edges.items()))
            if (state := known.get(key)) is None:
                state = known[key] = len(self.final)
                before, out = int(final), {}
                for letter, child in edges.items():
                    out[letter] = (child, before)
                    before += self._words_from[child]
                self.edges.append(out)
                self.final.append(final)
                self._words_from.append(before)
            return state

        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def shorten(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                path[-1][1][last[len(path) - 1]] = settle(final[0], edges)

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            shorten(same)
            path.extend(([False], {}) for _ in word[same:])
            path[-1][0][0] = True
            last = word
        shorten(0)
        self.root = settle(path[0][0][0], path[0][1])

    def __len__(self) -> int:
        return self._words_from[self.root]

    def _finish(self, state: int, number: int, rest: str) -> int:
        for letter in rest:
            if (edge := self.edges[state].get(letter)) is None:
                return -1
            state, number = edge[0], number + edge[1]
        return number if self.final[state] else -1

    def number(self, word: str) -> int:
        """The word's number, or -1."""
        return self._finish(self.root, 0, word)

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first `exact` letters of this one and differ behind them by one replaced or one more letter."""
        state, number, found = self.root, 0, set()
        for at in range(len(word) + 1):
            edges = self.edges[state]
            if at >= exact:
                for letter, (child, before) in edges.items():
                    found.add(self._finish(child, number + before, word[at:]))
                    if at < len(word) and letter != word[at]:
                        found.add(self._finish(child, number + before, word[at + 1 :]))
            if at == len(word) or (edge := edges.get(word[at])) is None:
                break
            state, number = edge[0], number + edge[1]
        found.discard(-1)
        return found


def _key() -> list[Column]:
    """What the members of a group share: the length of the shorter words, their first letters and their last letters."""
    word = F.col("word")
    return [F.col("shorter"), F.col("head"), F.col("tail"), F.substring(word, F.lit(1), F.col("head")).alias("first"), F.expr("right(word, tail)").alias("last")]


def _halves(members: DataFrame) -> DataFrame:
    """Each group in two: an error in the part that a group's words don't share yet leaves its first or its second half as it is."""
    half = F.expr("(shorter - head - tail) div 2").cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"))
    second = F.struct(F.col("head").alias("head"), (F.col("shorter") - F.col("head") - half).alias("tail"))
    return members.withColumn("half", F.explode(F.array(first, second))).select("word", "n", "shorter", F.col("half.head").alias("head"), F.col("half.tail").alias("tail"))


def memberships(words: DataFrame, min_chars: int, most: int) -> DataFrame:
    """word, n, shorter, head, tail, first, last: the groups in which a word meets its near words. A word is in the groups of its own length and of
    the next smaller one. A group of more than `most` words is halved again, and again, until at most one letter is not shared: such a group holds fewer words
    than the letters' number squared and some."""
    lengths = F.array_compact(F.array(F.length("word"), F.when(F.length("word") > min_chars, F.length("word") - 1)))
    parts, members = [], _halves(words.select("word", "n", F.explode(lengths).alias("shorter"), F.lit(0).alias("head"), F.lit(0).alias("tail")))
    while True:
        members = materialize(members.select("word", "n", *_key()), "members")
        key = ["shorter", "head", "tail", "first", "last"]
        large = members.where(F.col("shorter") - F.col("head") - F.col("tail") > 1).groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > most)
        large = materialize(large.select(*key), "large")
        if large.isEmpty():
            parts.append(members)
            break
        parts.append(members.join(large, key, "left_anti").select(*members.columns))
        members = _halves(members.join(large, key, "left_semi"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """word, near, near_n: all ordered pairs of words(word, n) that differ by exactly one inserted, deleted or replaced code point.

    The half of the shorter word that has no error is shared by both words. So words are dealt by length and first half, and by length and second half;
    a task makes a minimal automaton of its words, and one of the reversed ones for the second halves, walks each word's exact half
    and completes it with one error. Pairs that are found from both sides are returned once.
    """
    members = materialize(memberships(words, min_chars, most), "dealt")
    shards = max(1, -(-members.count() // shard))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        n = dict(zip(rows["word"], rows["n"], strict=True))
        pairs: set[tuple[str, str]] = set()
        forward = rows["head"] >= rows["tail"]
        for turn, some in ((1, rows[forward]), (-1, rows[~forward])):
            lexicon = sorted({w[::turn] for w in some["word"]})
            automaton = Automaton(lexicon)
            for word, shorter, head, tail in zip(some["word"], some["shorter"], some["head"], some["tail"], strict=True):
                if len(word) == shorter:
                    for i in automaton.one_error(word[::turn], head if turn == 1 else tail):
                        near = lexicon[i][::turn]
                        pairs.add((word, near))
                        pairs.add((near, word))
        found = list(pairs)
        return pd.DataFrame({"word": [a for a, _ in found], "near": [b for _, b in found], "near_n": [n[b] for _, b in found]}).astype({"word": str, "near": str, "near_n": "int64"})

    dealt = members.withColumn("shard", F.pmod(F.xxhash64("shorter", "head", "tail", "first", "last"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(search, "word string, near string, near_n long").distinct()


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, loss: int = LOSS, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is the near word with most occurrences (of equal ones the first by code points), if it occurs at least `times` as often as
    the word; its root is the last form of the chain that begins with it, or the word itself. Counts grow along a chain, so chains end, and
    few links suffice: roots are found by doubling.

    Null and empty texts have no words; a text may be of any length; rows that repeat an id or a text count each on their own, a null id as ''.
    An empty table gives no rows; columns not named are ignored.
    """
    words = materialize(word_counts(docs, id_col, text_col, min_chars, min_count, loss), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_pairs(words, min_chars, shard, most).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.minus") >= times * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")
    )
    forms = materialize(forms, "forms")
    links = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    while True:
        links = materialize(links, "links")
        if links.where("moved").isEmpty():
            break
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
    out = forms.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(documents(spark, sf_dir))


#: Pairs by the words that one deletion makes; crc32 byte by byte with its table.
OP12_SQL = rf"""
WITH RECURSIVE tables AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {MIN_CHARS} GROUP BY ALL),
x AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS hexed FROM r),
h AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(0, len(hexed), 2), lambda i: ('0x' || hexed[i + 1 : i + 2])::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM x, tables),
l AS (SELECT CASE WHEN h % {LOSS} = 0 THEN run[1 : (h % length(run))] || run[(h % length(run)) + 2 :] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM l WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
d AS (SELECT word, n, i, word[1 : i - 1] || word[i + 1 :] AS less FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d a JOIN d b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {TIMES} * n THEN near END AS form, CASE WHEN near_n >= {TIMES} * n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT c.word, c.root FROM c JOIN f ON c.root = f.word WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e USING (word)
"""
