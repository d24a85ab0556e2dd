"""The corpus pipeline: from raw documents to packed training sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import discard, made, scratch_root
from pointloom.llm.langid import UNKNOWN, fit, identify
from pointloom.llm.linededup import dedup_lines
from pointloom.llm.mixing import mix
from pointloom.llm.packing import pack
from pointloom.llm.simhash import drop_near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction of less probability is rejected; with four languages the least possible is 0.25.
LEAST_SCORE = 0.3
#: Packing's Python workers stay while the other stages run, and share an executor's memory with them: they remember fewer words than those of operator 10 alone.
REMEMBERED = 150_000
#: Rows that go to a Python worker at once: whole texts, that both sides hold several times over.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers get at most BATCH_ROWS rows at once; fewer where the session says so. Results do not depend on it."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= BATCH_ROWS:
        spark.conf.set(conf, BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents without a letter, and those of no recognisable language, go.

    Null and empty texts have no letter. Repeated rows are judged each on its own; without any labelled row no text can be recognised and all go;
    an empty table gives none. Columns beside those of documents are left out, whatever their names.
    """
    small_batches(spark)
    seen = identify(docs, fit(docs), carry=COLUMNS[1:])
    return seen.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of similar lines the first stays; documents that lose all their text go.

    The first is that of the smallest id, null before all. Null and empty texts have no words and go. Equal rows are one document: all of them keep or lose the
    same lines. An empty table gives none.
    """
    small_batches(spark)
    left = dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near-duplicates stays (five words, 0.8): that of the smallest id, null before all.

    Rows that repeat its id and text stay with it; null and empty texts stay. An empty table gives none.
    """
    small_batches(spark)
    return drop_near_duplicates(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents repeated, or left out, by their sources' target weights.

    A null source is one, the last. Null and empty texts have no words and go; equal rows are drawn one after another. An empty table gives none.
    """
    mixed = mix(docs, carry=("text", "lang", "n_chars")).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: token sequences of a power of two. A null or empty text is the end token alone; equal rows are packed each; an empty table gives none."""
    small_batches(spark)
    return pack(docs, with_ids=True, remember=REMEMBERED)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near), ("mixing", mixture), ("packing", packed)]
#: Trained models, MinHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_root(spark)}/pointloom/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = made()
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            discard(made() - before)  # the stage's own scratch tables
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
