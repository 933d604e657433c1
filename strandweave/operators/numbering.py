"""Ordered numbering and running totals that never put one group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import BROADCAST_ROWS, cut

# Rows of one group that share a task while scanning; the block totals are scanned
# after that, i.e. 32,768 times fewer rows.
BLOCK = 1 << 15


def with_row_index(
    df: DataFrame,
    order_by: Sequence[str],
    name: str = "row_index",
    group_by: Sequence[str] = (),
    start: int = 0,
) -> DataFrame:
    """Dense position of each row in ``order_by`` order, over the table or per group.

    Range-partitioned sort, then a count per (group, partition): the only windowed
    table has at most one row per group and partition.  ``order_by`` must be unique
    within the group, otherwise ties are numbered arbitrarily.
    """
    group_by = list(group_by)
    keys = [*group_by, *order_by]
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33))
    )
    runs = placed.groupBy(*group_by, "_part").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = (
        Window.partitionBy(*group_by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop(
        "_rows"
    )
    if not group_by:
        runs = F.broadcast(runs)  # one row per partition
    return (
        placed.join(runs, [*group_by, "_part"])
        .withColumn(name, F.col("_before") + F.col("_mid") - F.col("_first") + F.lit(start))
        .drop("_mid", "_part", "_first", "_before")
    )


def running_sum_before(
    df: DataFrame,
    group_by: Sequence[str],
    pos: str,
    values: dict[str, Column | str],
    block: int = BLOCK,
) -> DataFrame:
    """Add, per entry of ``values``, the sum over earlier positions of the same group.

    ``pos`` is dense from 0.  Each task scans at most ``block`` rows of a group; the
    carried totals come from one row per block.
    """
    return _scan(df, group_by, pos, values, block, F.sum)


def running_max_before(
    df: DataFrame,
    group_by: Sequence[str],
    pos: str,
    values: dict[str, Column | str],
    block: int = BLOCK,
) -> DataFrame:
    """Add the maximum over earlier positions of the same group (null at the first)."""
    return _scan(df, group_by, pos, values, block, F.max)


def _scan(df, group_by, pos, values, block, fold):
    group_by = list(group_by)
    work = df.withColumn("_block", F.floor(F.col(pos) / F.lit(block)).cast("long"))
    for out, value in values.items():
        work = work.withColumn(f"_v_{out}", F.col(value) if isinstance(value, str) else value)
    work = cut(work)  # read twice: for the block totals and inside the blocks
    totals = work.groupBy(*group_by, "_block").agg(
        *[fold(f"_v_{out}").alias(f"_t_{out}") for out in values]
    )
    blocks_before = (
        Window.partitionBy(*group_by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    for out in values:
        totals = totals.withColumn(f"_c_{out}", fold(f"_t_{out}").over(blocks_before))
    totals = totals.drop(*[f"_t_{out}" for out in values])
    inside = (
        Window.partitionBy(*group_by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = work.join(totals, [*group_by, "_block"])
    for out in values:
        local, carried = fold(f"_v_{out}").over(inside), F.col(f"_c_{out}")
        if fold is F.sum:
            value = F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
        else:
            value = F.greatest(local, carried)
        joined = joined.withColumn(out, value)
    return joined.drop("_block", *[f"_v_{o}" for o in values], *[f"_c_{o}" for o in values])


def lookup_side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dictionary side if its counted rows allow, else leave the join to AQE.

    Meant for materialised tables or cheap selections of them: the rows are counted.
    """
    return F.broadcast(df) if df.count() <= bound else df
