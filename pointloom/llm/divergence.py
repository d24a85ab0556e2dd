"""Operator 13, source divergence audit: inclusion-exclusion over the supports of smoothed term distributions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, UPPER, documents, materialize, require

#: Probabilities are in units of one in so many.
UNIT = 1_000_000_000
MIN_DOCS, TOP_TERMS = 3, 200
#: A Python worker sends its counts on when it holds so many.
HELD = 200_000
#: Bytes of terms: letters, A-Z lower-cased, and all bytes beyond ASCII. Others become spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have the term); nulls count as ''. Tasks count a batch of rows before anything is shuffled."""
    require(docs, lang_col, source_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in seen.items():
                terms = list(n)
                for at in range(0, len(terms), HELD):
                    some = terms[at : at + HELD]
                    columns = [pa.repeat(lang, len(some)), pa.repeat(source, len(some)), pa.array(some, pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([n[t] for t in some], pa.int64()), pa.array([rows[t] for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                terms = text.as_py().translate(_TERM_BYTES).split()
                if terms:
                    n, rows = seen.setdefault((lang, source), (Counter(), Counter()))
                    before = len(n)
                    n.update(terms)
                    rows.update(set(terms))
                    held += len(n) - before
                    if held > HELD:
                        yield from flush()
                        held = 0
        yield from flush()

    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col, text_col)]
    rows = docs.select(empty[0].alias("lang"), empty[1].alias("source"), empty[2].cast("binary").alias("text"))
    parts = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + 1 * kept)), in whole numbers of any size; null where no term is kept."""
    return F.expr(f"CASE WHEN kept > 0 THEN 1 + (cast({UNIT} AS decimal(10,0)) * ({count} + 1)) div cast({total} + kept AS decimal(20,0)) END")


def _gap(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far the sources of a language are from each other, and by which terms from the language.

    Terms are runs of ASCII letters (lower-cased) and of all characters beyond ASCII; a language keeps those in at least
    min_docs of its rows. In each (lang, source) group, and in the language, a kept term has p = 1 + floor(UNIT (n + 1) / (N + kept)).
    Part `pair`: for each other source, the sum over all kept terms of floor((p - q)^2 / q). Part `term`: the terms that the group
    uses more than its language does, the top_terms of largest value.

    A pair's sum over the kept terms is never made term by term. Terms that one side lacks have that side's least p, so the histogram
    of the other side's counts prices all of them at once, the shared ones too; terms that both lack have one value; and for
    the terms that both have, a join of posting lists adds what the three were wrong by. Work follows the postings, not groups times terms.

    Null lang, source and text count as ''. Groups without terms have rows as well; a language without kept terms has pairs of value 0.
    Repeated rows count each on their own. Equal values are ranked by item, by its bytes. An empty table gives no rows; columns not named are ignored.
    """
    counts = term_counts(docs, lang_col, source_col, text_col)
    of_term = W.partitionBy("lang", "term")
    counts = counts.withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term)).where(F.col("in_docs") >= min_docs)
    first = F.row_number().over(of_term.orderBy("source")) == 1
    counts = materialize(counts.withColumn("first", first).select("lang", "source", "term", "n", "lang_n", "first"), "postings")

    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"), F.count_if("first").alias("firsts"))
    groups = docs.select(*names).distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "support", "firsts"])
    of_lang = W.partitionBy("lang")
    groups = groups.withColumn("kept", F.sum("firsts").over(of_lang)).withColumn("lang_total", F.sum("total").over(of_lang)).drop("firsts")
    groups = materialize(groups.withColumn("p0", _share("0L", "total")), "groups")
    postings = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("support").alias("other_support"))
    pairs = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    neither = pairs.select("lang", "source", "item", F.coalesce((F.col("kept") - F.col("support") - F.col("other_support")) * _gap("p0", "q0"), F.lit(0).cast("long")).alias("value"))
    histogram = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    priced = histogram.join(pairs.drop("p0"), ["lang", "source"]).groupBy("lang", "source", "item")
    priced = priced.agg(F.sum(F.col("terms") * _gap("p", "q0")).alias("to"), F.sum(F.col("terms") * _gap("q0", "p")).alias("back"))
    here = postings.select("lang", "term", "source", "p", "p0")
    there = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = here.join(there, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item")

    def wrong_by(p: str, p0: str, q: str, q0: str) -> Column:
        return F.sum(_gap(p, q) - _gap(p, q0) - _gap(p0, q) + _gap(p0, q0))

    both = both.agg(wrong_by("p", "p0", "q", "q0").alias("to"), wrong_by("q", "q0", "p", "p0").alias("back"))
    swapped = [F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")]
    directed = neither
    for part in (priced, both):
        directed = directed.unionByName(part.select("lang", "source", "item", F.col("to").alias("value"))).unionByName(part.select(*swapped))
    ordered = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = directed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ordered))
    term = postings.withColumn("q", _share("lang_n", "lang_total")).where("p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"))
    term = term.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top_terms)
    out = pair.withColumn("part", F.lit("pair")).unionByName(term.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


#: Every kept term of every group, one by one.
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + kept) AS p,
  1 + ({UNIT}::HUGEINT * (lang_n + 1)) // (lang_total + kept) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM r)
WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
