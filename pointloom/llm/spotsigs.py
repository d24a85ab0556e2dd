"""Operator 8, document fingerprints: SpotSigs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import documents, materialize, require

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that it was for are as with be by on at from this an a or had have has not but which you "
    "der die das und ist nicht ein eine einen dem den des von zu mit sich auf für im auch es an werden aus er sie war "
    "le la les et est un une du des en que qui dans pour pas sur au aux avec ce il elle sont plus par ne se "
    "el los las y del que en un una por con no para es su se lo como más al pero sus"
).split()
CHAIN, LOOKAHEAD, GAP = 2, 12, 4
#: Consecutive ids that one group of the next-document window holds.
GROUP_BITS, SUPER_BITS = 8, 12


def signatures(text: Column, chain: int = CHAIN, lookahead: int = LOOKAHEAD) -> Column:
    """The set of a text's spot signatures, as sorted distinct integers.

    Each common word is an anchor; its signature is the anchor and the first `chain` content words among
    the `lookahead` words after it. So that lists and tables are covered too, the first word and every third
    word by hash that has no common word among the GAP words before it are anchors as well. A text without
    words is one signature of its characters; an empty text has none.
    """
    anchors = sorted(set(ANCHORS))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        bare = lambda i: ~F.exists(F.slice(w, F.greatest(i - GAP, F.lit(0)) + 1, F.least(i, F.lit(GAP))), lambda y: y.isin(anchors))
        is_spot = lambda x, i: x.isin(anchors) | (i == 0) | ((F.pmod(F.hash(x), F.lit(3)) == 0) & bare(i))
        spots = F.filter(F.transform(w, lambda x, i: F.when(is_spot(x, i), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        follow = lambda i: F.slice(F.filter(F.slice(w, i + 2, lookahead), lambda y: ~y.isin(anchors)), 1, chain)
        return F.transform(spots, lambda i: F.hash(F.get(w, i), follow(i)))

    found = F.transform(F.array(words), of)[0]
    found = F.when((F.size(found) == 0) & (F.length(text) > 0), F.array(F.hash(text))).otherwise(found)
    return F.sort_array(F.array_distinct(found))


def as_text(sigs: Column) -> Column:
    """The fingerprint: 8 hex digits for each signature, in order."""
    digits = F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")))
    return F.array_join(digits, "")


def partition_of(n: Column, least: float) -> Column:
    """The partition of sets of n signatures: sets whose partitions are not neighbours have a Jaccard similarity below `least`."""
    return F.when(n > 0, F.floor(F.log(n) / -F.log(F.lit(least)))).otherwise(-2).cast("int")


def jaccard(a: Column, b: Column, least: float = 0.0) -> Column:
    """Of two sets; 1 of two empty ones. Where partitions, or the lengths, show that it is below `least`, sets are not compared: 0."""
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    out = F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0)
    if least:
        out = out.when(F.abs(partition_of(n, least) - partition_of(m, least)) > 1, 0.0).when(F.least(n, m) < F.lit(least) * F.greatest(n, m), 0.0)
    return out.when(a == b, 1.0).otherwise(both / (n + m - both))


def with_next(rows: DataFrame, columns: list[str], derive: dict[str, Column] | None = None) -> DataFrame:
    """rows(key long, tie long, *columns) with next_*: the columns of the next row by key and tie, after the last the first.

    Columns to derive are led too; they are made once a row has found its group, so only once each.

    Rows are dealt by 2**GROUP_BITS consecutive keys, with the first row of the following group beside
    them. Which group follows is found among groups of groups, so one task sees a row per
    2**(GROUP_BITS + SUPER_BITS) keys at most.
    """
    rows = rows.withColumn("group", F.shiftright("key", GROUP_BITS))
    groups = rows.groupBy("group").agg(F.min("key").alias("first")).withColumn("super", F.shiftright("group", SUPER_BITS))
    groups = materialize(groups, "groups")
    supers = groups.groupBy("super").agg(F.min("first").alias("first"))
    start = supers.agg(F.min("first")).head()[0]
    supers = materialize(supers.select("super", F.coalesce(F.lead("first").over(W.orderBy("super")), F.lit(start).cast("long")).alias("after")), "supers")
    follow = groups.withColumn("inside", F.lead("first").over(W.partitionBy("super").orderBy("group"))).join(supers, "super")
    follow = materialize(follow.select(F.col("group").alias("for"), F.coalesce("inside", "after").alias("at")), "follow")
    edge = rows.join(follow, F.col("key") == F.col("at")).select(F.col("for").alias("group"), "key", "tie", *columns, F.lit(1).alias("edge"))
    both = rows.select("group", "key", "tie", *columns, F.lit(0).alias("edge")).unionByName(edge).withColumns(derive or {})
    order = W.partitionBy("group").orderBy("edge", "key", "tie")
    # a lead of each column: a struct of them would be a second copy in the shuffle
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in (*columns, *(derive or {}))}).where("edge = 0")


def spot_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter replaced by as many characters from the start of the
    next document by id (after the last: the first; a lone one follows itself). Rows that repeat an id
    follow each other by the hash of their texts; null ids come first. Null texts are empty ones: no
    signatures, fingerprint ''. Likenesses are the Jaccard similarities of signature sets, whatever their
    lengths; only near_pairs prunes. An empty table gives no rows; columns not named are ignored.
    """
    require(docs, id_col, text_col)
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), t.alias("t"))
    rows = rows.select(F.coalesce("id", F.lit(-(1 << 63)).cast("long")).alias("key"), F.xxhash64("t").alias("tie"), "id", "t")
    paired = with_next(rows, ["id", "t"], {"sigs": signatures(F.col("t"))})
    n = F.length("t")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - part), F.substring(F.col("next_t"), F.lit(1), part))
    wide = paired.select("id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    wide = wide.withColumn("edited_sigs", signatures(F.col("edited")))
    return wide.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sigs")).alias("fingerprint"),
        as_text(F.col("edited_sigs")).alias("edited_fingerprint"), jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(membership(id_col, class_id), pairs(a, b, likeness)): documents with equal signature sets are a class, named by the smallest id; pairs link classes.

    Sets are partitioned by length, so that a set meets only its own partition and the next; inside, sets meet on the
    signatures, rarest first by their count over all classes, that similar sets must share (prefix filter), so that what many
    documents repeat brings few together. Lengths and the places of the shared signature prune once more, and exact Jaccard decides.
    A null id takes part; null and empty texts are one class without pairs. An empty table gives no rows.
    """
    require(docs, id_col, text_col)
    t = F.coalesce(F.col(text_col), F.lit(""))
    made = materialize(docs.select(F.col(id_col).cast("long").alias("id"), signatures(t).alias("sigs")), "signatures")
    made = made.withColumn("finger", F.sha2(as_text(F.col("sigs")), 256))
    classes = materialize(made.groupBy("finger").agg(F.min("id").alias("class_id"), F.first("sigs").alias("sigs")), "classes")
    member = made.select("id", "finger").join(classes.select("finger", "class_id"), "finger").select(F.col("id").alias(id_col), "class_id")
    each = classes.select("finger", F.explode("sigs").alias("sig"))
    counted = each.join(materialize(each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")), "counts"), "sig")
    n = F.size("rare")
    prefix = F.slice("rare", F.lit(1), n - F.ceil(n * F.lit(threshold)).cast("int") + 1)
    rare = counted.groupBy("finger").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("rare"))
    keyed = materialize(rare.select("finger", n.alias("n"), partition_of(n, threshold).alias("band"), F.posexplode(prefix).alias("at", "s")).select("finger", "n", "band", "at", "s.sig"), "prefixes")
    lower = keyed.select("finger", "n", "sig", "at", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    near = (F.col("x.n") >= F.col("y.n") * threshold) & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.finger") < F.col("y.finger"))))
    # what can still be shared from the places of this signature on, if it is the first shared one
    most = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    near = near & (most * (1 + threshold) >= (F.col("x.n") + F.col("y.n")) * threshold - 1e-9)
    found = lower.alias("x").join(keyed.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.band") == F.col("y.band")) & near)
    found = found.select(F.col("x.finger").alias("fa"), F.col("y.finger").alias("fb")).distinct()
    a, b = classes.toDF("fa", "a", "sa"), classes.toDF("fb", "b", "sb")
    pairs = found.join(a, "fa").join(b, "fb").select("a", "b", jaccard(F.col("sa"), F.col("sb"), threshold).alias("likeness"))
    return member, pairs.where(F.col("likeness") >= threshold)


def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_fingerprints(documents(spark, sf_dir))
