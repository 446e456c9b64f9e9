"""A training corpus in stages: each takes the documents that its predecessor kept and gives those that it keeps itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm import minhash, mixing, quality, sentencepiece, substring_dedup
from trajlake.operators.tables import kept

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, learned from labelled ones among these, predicts to be label 0.

    A null or empty text has the score of the bias alone; equal texts have equal scores, so repeated rows stay or go
    together. Rows with a null id are judged, but not learned from.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; where several texts of the group have that id, those
    of one. Rows without an id and texts without words stay; rows repeated in full stay or go together."""
    return minhash.keep_first(docs).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that repeat are cut out of the texts; other texts, null and empty ones too, stay as they are, and
    every row stays. Of equal windows none is spared; rows repeated in full repeat each other."""
    kept = substring_dedup.remove_repeats(docs)
    cut_out = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return kept.withColumn("text", cut_out).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of their slots: sources interleaved to their weights. A null source is one like others; rows
    with equal ids, null ones too, follow one another."""
    return mixing.in_order(mixing.mix(docs)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and slot and place of the mixing: files keep no order of rows, so it is in columns.
    They are worked out again here, being a function of doc_id, source and the counts. A null or empty text has no ids; rows
    with equal ids share their slots and places, in any order."""
    placed = mixing.mix(docs.select("doc_id", "source", "text")).drop("block")
    return sentencepiece.encode(placed).select("doc_id", "source", "n_tokens", "ids", "slot", "place")


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", one_of_each),
    ("substring dedup", without_repeats),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
