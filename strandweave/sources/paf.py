"""PAF overlaps: twelve positional fields per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.sources.text import fields, known, read_lines, require

# Names and types of the twelve positional fields.
PAF_FIELDS = [
    ("id1", "string"), ("len1", "long"), ("start1", "long"), ("end1", "long"), ("strand", "string"),
    ("id2", "string"), ("len2", "long"), ("start2", "long"), ("end2", "long"),
    ("c10", "string"), ("c11", "string"), ("c12", "string"),
]


def parse_paf(lines: DataFrame) -> DataFrame:
    """Typed overlap rows; a line with another number of fields fails the query.

    A coordinate ``*`` is unknown (null), as in overlaps of reads without bases.
    """
    split = fields(lines).withColumn(
        "f", require(F.size("f") == len(PAF_FIELDS), F.col("f"), "PAF line without 12 fields")
    )
    return split.select(
        "line_no",
        *[(F.col("f")[i] if t == "string" else known(F.col("f")[i]).cast(t)).alias(n) for i, (n, t) in enumerate(PAF_FIELDS)],
    )


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    return parse_paf(read_lines(spark, path))
