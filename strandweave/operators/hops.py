"""Hop-by-hop expansion from the graph's boundary reads over the kept overlaps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.overlap import twin_rows
from strandweave.functions.sequence import flip
from strandweave.operators.numbering import lookup_side
from strandweave.session import cut


def boundary_reads(unitig_ends: DataFrame) -> DataFrame:
    """Reads the expansion starts from: first and last of every unitig."""
    return unitig_ends.select(F.explode(F.array("first", "last")).alias("read_id")).distinct()


def ghost_adjacency(rows: DataFrame) -> DataFrame:
    """Both strands of each outside read next to its known neighbour.

    ``rows`` has exactly one end in the frontier (flag ``src_known``).  Returns hop,
    orient, read_id, read_len, dir ('in' or 'out'), nbr_read, nbr_orient, ol_len,
    prefix_len.
    """

    def entry(read, orient, length, direction, nbr, nbr_orient, prefix):
        return F.struct(
            orient.alias("orient"),
            F.col(read).alias("read_id"),
            F.col(length).alias("read_len"),
            F.lit(direction).alias("dir"),
            F.col(nbr).alias("nbr_read"),
            nbr_orient.alias("nbr_orient"),
            F.col("ol_len").alias("ol_len"),
            F.col(prefix).alias("prefix_len"),
        )

    so, do = F.col("src_orient"), F.col("dst_orient")
    new_src = F.array(
        entry("src_read", so, "src_len", "out", "dst_read", do, "prefix_len"),
        entry("src_read", flip("src_orient"), "src_len", "in", "dst_read", flip("dst_orient"), "prefix_len_rev"),
    )
    new_dst = F.array(
        entry("dst_read", do, "dst_len", "in", "src_read", so, "prefix_len"),
        entry("dst_read", flip("dst_orient"), "dst_len", "out", "src_read", flip("src_orient"), "prefix_len_rev"),
    )
    picked = F.when(F.col("src_known"), new_dst).otherwise(new_src)
    return rows.select("hop", F.explode(picked).alias("g")).select("hop", "g.*")


def expand(overlaps: DataFrame, frontier: DataFrame, stop_share: float = 0.01, max_hops: int | None = None):
    """(ghost_edges, ghost_adj) over all hops.

    Per hop: both ends known gives an edge and its twin, one end known a ghost, none is
    left for the next hop.  Stops once at most ``stop_share`` of the rows are left, at
    ``max_hops``, or when a hop makes no progress (rows unreachable from the graph).
    """
    rows = cut(overlaps)
    total = rows.count()
    left, hop = total, 1
    known = cut(frontier.select("read_id").distinct())
    edges, ghosts = [], []
    while left > total * stop_share and (max_hops is None or hop <= max_hops):
        flagged = rows
        for side in ("src", "dst"):
            flagged = flagged.join(
                lookup_side(known.select(F.col("read_id").alias(f"{side}_read"), F.lit(True).alias(f"{side}_known"))),
                f"{side}_read",
                "left",
            ).withColumn(f"{side}_known", F.coalesce(f"{side}_known", F.lit(False)))
        flagged = cut(flagged.withColumn("hop", F.lit(hop)))
        one = flagged.filter("src_known <> dst_known")
        edges.append(twin_rows(flagged.filter("src_known and dst_known")))
        ghosts.append(ghost_adjacency(one))
        rows = flagged.filter("not src_known and not dst_known").drop("src_known", "dst_known", "hop")
        remaining = rows.count()
        if remaining == left:
            break
        left = remaining
        fresh = one.select(F.when(F.col("src_known"), F.col("dst_read")).otherwise(F.col("src_read")).alias("read_id"))
        known = cut(known.union(fresh).distinct())
        hop += 1
    if not edges:
        none = rows.limit(0).withColumn("hop", F.lit(1)).withColumn("src_known", F.lit(True))
        return twin_rows(none), ghost_adjacency(none)
    return reduce(DataFrame.unionByName, edges), reduce(DataFrame.unionByName, ghosts)
