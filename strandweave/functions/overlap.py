"""Overlap classification as one CASE expression, and the unitig boundary predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import flip


def classify(rows: DataFrame) -> DataFrame:
    """Keep dovetail overlaps and add source, target and attributes.

    Added: src_read, src_orient, dst_read, dst_orient, ol_len, prefix_len and
    prefix_len_rev (of the twin edge dst^ -> src^), plus the coordinates of the source
    and target read on their own strand.  The overlap length is always read 1's span.
    """
    s1, s2 = F.col("start1") == 0, F.col("start2") == 0
    e1, e2 = F.col("end1") == F.col("len1"), F.col("end2") == F.col("len2")
    plus = F.col("strand") == "+"
    case = (
        F.when(plus & ((s1 & s2) | (e1 & e2)), F.lit(None))
        .when(plus & e1 & s2, F.lit("1+2+"))
        .when(plus & s1 & e2, F.lit("2+1+"))
        .when(plus, F.lit(None))
        .when((s1 & e2) | (e1 & s2), F.lit(None))
        .when(e1 & e2, F.lit("1+2-"))
        .when(s1 & s2, F.lit("1-2+"))
    )
    kept = rows.withColumn("_case", case).filter(F.col("_case").isNotNull())
    first = F.col("_case").startswith("1")

    def pick(a: str, b: str) -> Column:
        return F.when(first, F.col(a)).otherwise(F.col(b))

    ol = F.col("end1") - F.col("start1")
    return (
        kept.withColumn("src_read", pick("id1", "id2"))
        .withColumn("src_orient", F.substring("_case", 2, 1))
        .withColumn("dst_read", pick("id2", "id1"))
        .withColumn("dst_orient", F.substring("_case", 4, 1))
        .withColumn("ol_len", ol)
        .withColumn("src_len", pick("len1", "len2"))
        .withColumn("dst_len", pick("len2", "len1"))
        .withColumn("src_start", pick("start1", "start2"))
        .withColumn("src_end", pick("end1", "end2"))
        .withColumn("dst_start", pick("start2", "start1"))
        .withColumn("dst_end", pick("end2", "end1"))
        .withColumn("prefix_len", F.col("src_len") - F.col("ol_len"))
        .withColumn("prefix_len_rev", F.col("dst_len") - F.col("ol_len"))
        .drop("_case")
    )


def touches_outer_end(read: str, start: str, end: str, length: str, side: str) -> Column:
    """May this overlap leave the unitig?  True for unitigs of one read.

    Expects ``{side}_n``, ``{side}_first``, ``{side}_first_orient``, ``{side}_last`` and
    ``{side}_last_orient``; a read that is both first and last counts as first.
    """
    at_start, at_end = F.col(start) == 0, F.col(end) == F.col(length)
    is_first = F.col(read) == F.col(f"{side}_first")
    is_last = F.col(read) == F.col(f"{side}_last")
    on_first = F.when(F.col(f"{side}_first_orient") == "+", at_start).otherwise(at_end)
    on_last = F.when(F.col(f"{side}_last_orient") == "+", at_end).otherwise(at_start)
    return (
        F.when(F.coalesce(F.col(f"{side}_n"), F.lit(1)) <= 1, F.lit(True))
        .when(is_first, on_first)
        .when(is_last, on_last)
        .otherwise(F.lit(False))
    )


def twin_rows(rows: DataFrame) -> DataFrame:
    """Each classified overlap as its two directed edges (src, dst, ol_len, prefix_len)."""

    def edge(src, src_o, dst, dst_o, prefix) -> Column:
        return F.struct(
            F.col(src).alias("src_read"),
            src_o.alias("src_orient"),
            F.col(dst).alias("dst_read"),
            dst_o.alias("dst_orient"),
            F.col("ol_len").alias("ol_len"),
            F.col(prefix).alias("prefix_len"),
        )

    straight = edge("src_read", F.col("src_orient"), "dst_read", F.col("dst_orient"), "prefix_len")
    twin = edge("dst_read", flip("dst_orient"), "src_read", flip("src_orient"), "prefix_len_rev")
    keep = [c for c in ("hop",) if c in rows.columns]
    return rows.select(*keep, F.explode(F.array(straight, twin)).alias("e")).select(*keep, "e.*")
