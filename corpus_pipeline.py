"""The corpus pipeline: toxic documents go, near-duplicates go, personal data is masked, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All
but the last return the columns of ``documents``. Stages decide on rows, not ids: an id may be repeated,
with equal or other texts, or missing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsearch.llm.common import crc_class, stored, table
from litsearch.llm.ngram_join import jaccard_classes
from litsearch.llm.packing import pack_power_of_two
from litsearch.llm.pii import find_pii
from litsearch.llm.toxicity import sample_labelled, score_with, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not reject; each is scored with all its columns."""
    model = spark.sparkContext.broadcast(train(sample_labelled(docs, table(spark, sf_dir, "labels"))))
    rows = docs.select(F.struct(*COLUMNS).alias("doc_id"), crc_class("doc_id", 4).eqNullSafe(2).alias("held_out"), "text")
    return score_with(rows, model).where("predicted = 0").select("doc_id.*")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the smallest id, rows without id last."""
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    first = (jaccard_classes(rows, "row").select("row", "class_id").join(rows.select("row", "doc_id"), "row").groupBy("class_id")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("first")))
    return rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the text."""
    masked = find_pii(docs.select(F.struct("doc_id", "lang", "source").alias("doc"), "text"), "doc")
    return masked.select("doc.doc_id", F.col("redacted").alias("text"), "doc.lang", "doc.source",
                         F.char_length("redacted").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, ids included."""
    return pack_power_of_two(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("ngram_join", ngram_join), ("pii", pii), ("packing", packing)]

#: No stage but the last can be put into SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
