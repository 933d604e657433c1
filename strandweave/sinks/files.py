"""Result files: tables as parquet, contigs as FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_tables(folder: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def fasta_rows(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """contig_id, line, value: a header (line -1) before the lines of each contig."""
    heads = headers.select(
        "contig_id", F.lit(-1).cast("long").alias("line"), F.concat(F.lit(">"), "name", F.lit(" "), "description").alias("value")
    )
    return heads.unionByName(lines.select("contig_id", F.col("line").cast("long"), F.col("bases").alias("value")))


def renumbered(headers: DataFrame) -> DataFrame:
    """Assembly names ``ctg`` plus a ten-digit number from 1, without description."""
    number = F.lpad((F.col("contig_id") + 1).cast("string"), 10, "0")
    return headers.select("contig_id", F.concat(F.lit("ctg"), number).alias("name"))


def write_fasta(lines: DataFrame, headers: DataFrame, path: str) -> None:
    """Range-sorted part files; their concatenation in name order is the FASTA file.

    No task holds a whole assembly, nor a whole contig.
    """
    named = headers if "description" in headers.columns else headers.withColumn("description", F.lit(""))
    rows = fasta_rows(lines, named).withColumn("value", F.rtrim("value"))
    rows.repartitionByRange("contig_id", "line").sortWithinPartitions("contig_id", "line").select("value").write.mode(
        "overwrite"
    ).text(path)
