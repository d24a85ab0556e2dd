"""Operator 3, URL filters: a Bloom filter cascade, exact over the corpus's key universe, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, materialize, require

BITS_PER_KEY, HASHES = 12, 4
#: A level has no more bits (16 MB), as levels are sent to every task; lists of more keys than fill it are joined instead.
MOST_BITS = 1 << 27
MOST_KEYS = MOST_BITS // BITS_PER_KEY // 2


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #. Null or no :// gives empty ones."""
    text = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key that a rule fitting (host, path) can have, longest first, then the longer host: host suffixes at dots, with path prefixes of the rules' lengths."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda p: p.isNotNull())
    made = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(
        (-F.length(s) - F.length(p)).alias("order"), (-F.length(s)).alias("then"), F.concat(s, p).alias("key")))))
    return F.transform(F.array_sort(made), lambda c: c["key"])


def positions(key: Column, level: int, bits: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(level))
    low, step = h.bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned(h, 33).bitwiseOR(F.lit(1))
    return [(low + step * i).bitwiseAND(bits - 1) for i in range(HASHES)]


class LevelTooLarge(ValueError):
    """A level of a cascade would have more than MOST_BITS bits."""


@dataclass
class Level:
    """One Bloom filter. Its 64-bit words are a constant of the plan, at most MOST_BITS of them."""

    number: int
    bits: int
    words: list[int]

    def has(self, key: Column) -> Column:
        words, out = F.from_json(F.lit(str(self.words)), "array<bigint>"), F.lit(True)
        for p in positions(key, self.number, self.bits):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            out = out & (F.call_function("getbit", word, p.bitwiseAND(63).cast("int")) == 1)
        return out


def build_level(keys: DataFrame, number: int, n: int) -> Level:
    bits = 64
    while bits < n * BITS_PER_KEY:
        bits *= 2
    if bits > MOST_BITS:
        raise LevelTooLarge(f"a level of {bits} bits is too large to send to every task")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), number, bits))).alias("p"))
    set_ = at.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 AS int))").alias("bit"))
    zeros = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = set_.union(zeros).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return Level(number, bits, [r.bits for r in words.orderBy("word").collect()])


class Cascade:
    """Exact membership in `listed` for every key of `universe` (both: key string, distinct), without a join.

    Level 1 encodes the listed keys, level 2 those other keys of the universe that pass it, level 3 the
    listed keys that pass level 2, and so on until no key passes wrongly.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        self.levels: list[Level] = []
        inside, outside = materialize(listed.select("key").distinct(), "listed"), None
        outside = universe.select("key").join(inside, "key", "left_anti")
        while n := inside.count():
            self.levels.append(build_level(inside, len(self.levels) + 1, n))
            passed = materialize(outside.where(self.levels[-1].has(F.col("key"))), "passed")
            inside, outside = passed, inside

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.has(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out


def by_join(rows: DataFrame, keys: Column, listed: DataFrame) -> DataFrame:
    """rows with rule and blocked, by equality with the listed keys: the exact way for lists too large for filters."""
    whole = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    verdicts = listed.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("blocked"))
    found = whole.select("row", F.posexplode(keys).alias("at", "key")).join(verdicts, "key")
    best = found.groupBy("row").agg(F.min_by(F.struct("key", "blocked"), "at").alias("best"))
    return whole.join(best, "row", "left").select("id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.blocked", F.lit(False)).alias("blocked"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", most_keys: int = MOST_KEYS) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict.

    rules(host, path, verdict): verdict is allow or block. A rule fits its host and the host's subdomains where
    the path starts with the rule's; of those that fit, the longest (host and path together, then the longer
    host) wins; a key that is listed both ways is blocked. Where none fits, rule is null and the verdict
    allow: the cascade finds no listed key. Lists of more than most_keys rules are joined instead, and so are lists for which a level of the cascade
    would have more than MOST_BITS bits: a level grows with the keys of the corpus that pass the one before. Null urls have no host. Rows with repeated or null ids are
    judged each on its own; an empty table gives no rows, and an empty rule list allows all; other columns are ignored.
    """
    require(pages, id_col, url_col)
    require(rules, "host", "path", "verdict")
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    listed = materialize(rules.select(F.concat("host", "path").alias("key"), "verdict", F.length("path").alias("n")), "rules")
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())  # one number for each length of a rule's path
    if not lengths:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    keys = candidates(F.col("host"), F.col("path"), lengths)

    def joined() -> DataFrame:
        out = by_join(rows, keys, listed)
        return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))

    if listed.count() > most_keys:
        return joined()
    universe = materialize(rows.select(F.explode(keys).alias("key")).distinct(), "universe")
    try:
        blocked, allowed = (Cascade(listed.where(F.col("verdict") == v), universe) for v in ("block", "allow"))
    except LevelTooLarge:  # so many of the universe's keys pass the first level wrongly
        return joined()
    found = F.filter("keys", lambda k: blocked.has(k) | allowed.has(k))
    out = rows.withColumn("keys", keys).withColumn("rule", F.get(found, F.lit(0)))
    verdict = F.when(F.col("rule").isNotNull() & blocked.has(F.col("rule")), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))


# The rules that the query judges by.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir, "pages"), rule_table(spark))


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


_ORDERED = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
OP3_SQL = f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _ORDERED)} END AS rule,
  CASE {" ".join(f"WHEN {_fits(h, p)} THEN '{v}'" for h, p, v in _ORDERED)} ELSE 'allow' END AS verdict FROM u
"""
