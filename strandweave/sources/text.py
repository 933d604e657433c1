"""Line-oriented text with a file-order key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """Lines with ``line_no``, an orderable struct; blank lines only if asked for.

    Splits of one file may be read in any order, so the block start comes before the
    row id, which only grows within a split.
    """
    lines = spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_no"),
        "value",
    )
    return lines if blank else lines.filter(F.length(F.trim("value")) > 0)


def fields(lines: DataFrame) -> DataFrame:
    """line_no and ``f``, the whitespace separated fields of the trimmed line.

    The one-element explode keeps the optimizer from repeating the split in every column
    taken from ``f``.
    """
    return lines.select("line_no", F.explode(F.array(F.split(F.trim("value"), r"\s+"))).alias("f"))


def known(value):
    """``value``, or null where the field holds ``*``, which stands for an unknown one."""
    return F.when(value != "*", value)


def require(condition, value, message: str):
    """``value`` where the condition holds, else fail the query with the message."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)))
