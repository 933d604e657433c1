"""The corpus pipeline: toxicity, line dedup, n-gram join, decontamination, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from strandweave.llm.queries import WORD_BPE
from strandweave.llm.tables import read, shelve, unused


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic."""
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those that lose all lines go."""
    return line_dedup.dedup_lines(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, null last.

    The rows are numbered before, so that rows with a null id and rows of one id are told apart;
    among rows of one id the hash of the text decides, then the number.
    """
    row = unused(docs, "_row")
    rows = shelve(docs.withColumn(row, F.monotonically_increasing_id()))
    keys = rows.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("text_hash"), F.col(row).alias("row")).alias("first"))
    groups = jaccard.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    stay = groups.join(keys, "row").groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return rows.join(stay, row, "left_semi").select(docs.columns)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack_digest(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", lines_out),
    ("jaccard_join", near_copies_out),
    ("decontaminate", leaks_out),
    ("packing", packed),
]

# Learned scores, alignment and tokenization have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = shelve(docs)
    return docs
