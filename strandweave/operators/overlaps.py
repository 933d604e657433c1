"""Overlap filtering against the assembly graph and exact ordered deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.functions.overlap import classify, touches_outer_end
from strandweave.functions.sequence import complement_id, strand_node
from strandweave.operators.numbering import lookup_side
from strandweave.sources.gfa import Assembly


def read_pair(a: str = "id1", b: str = "id2") -> Column:
    """Unordered pair of reads."""
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def edge_key(src: str, dst: str) -> Column:
    """The same key for an edge and its reverse-complement twin."""
    straight = F.struct(F.col(src).alias("s"), F.col(dst).alias("d"))
    twin = F.struct(complement_id(dst).alias("s"), complement_id(src).alias("d"))
    return F.least(straight, twin)


def first_per_pair(rows: DataFrame) -> DataFrame:
    """Earliest row of each unordered read pair, taken map-side."""
    others = [c for c in rows.columns if c != "line_no"]
    return (
        rows.groupBy(read_pair().alias("_pair"))
        .agg(F.min_by(F.struct("line_no", *others), "line_no").alias("r"))
        .select("r.*")
    )


def locate(rows: DataFrame, asm: Assembly) -> DataFrame:
    """Add src_node / dst_node (null for reads outside the graph) and the unitig ends."""
    node = asm.read_node
    for side in ("src", "dst"):
        rows = rows.join(
            lookup_side(node.select(F.col("read_id").alias(f"{side}_read"), F.col("real_id").alias(f"{side}_real"))),
            f"{side}_read",
            "left",
        )
    ends = asm.unitig_ends.filter("n > 1")
    for side in ("src", "dst"):
        rows = rows.join(
            lookup_side(ends.select(*[F.col(c).alias(f"{side}_{'real' if c == 'real_id' else c}") for c in ends.columns])),
            f"{side}_real",
            "left",
        )
    return rows.withColumn("src_node", strand_node("src_real", "src_orient")).withColumn(
        "dst_node", strand_node("dst_real", "dst_orient")
    )


def eligible(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Drop overlaps within a unitig, already in the graph, or inside a unitig."""
    rows = rows.filter(~F.coalesce(F.col("src_real") == F.col("dst_real"), F.lit(False)))
    rows = rows.filter(
        touches_outer_end("src_read", "src_start", "src_end", "src_len", "src")
        & touches_outer_end("dst_read", "dst_start", "dst_end", "dst_len", "dst")
    )
    listed = edges.select(edge_key("src", "dst").alias("_edge")).distinct()
    both = F.col("src_node").isNotNull() & F.col("dst_node").isNotNull()
    keyed = rows.withColumn("_edge", F.when(both, edge_key("src_node", "dst_node")))
    # only overlaps between two graph nodes can be listed; the others skip the join
    inside = keyed.filter(both).join(listed, "_edge", "left_anti")
    outside = keyed.filter(~both)
    return inside.unionByName(outside)


def first_accepted(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Accept rows in file order unless a key was taken by an earlier accepted row.

    Of the rows ``keep`` (all columns) and ``line_no`` travel and come back.

    A row claims its read pair and, with two graph nodes, its edge (up to the twin), or,
    with one node of several reads, (other read, strand, node).  A rejected row claims
    nothing, so the keys cannot be deduplicated one after the other.

    Of rows with equal keys only the earliest can ever be accepted, which is decided
    map-side.  What is left is small per group by construction: rows that compete share
    a node pair (or read and node), a unitig is entered through its two outer reads
    only, and each pair of reads has at most four strand combinations.  The sequential
    choice then runs inside that bounded array, in one shuffle and without rounds.
    """
    s, d = F.col("src_real"), F.col("dst_real")
    both = s.isNotNull() & d.isNotNull()
    multi = F.coalesce(F.col("src_n"), F.col("dst_n"), F.lit(1)) > 1
    lone_src, lone_dst = s.isNotNull() & d.isNull(), s.isNull() & d.isNotNull()
    second = (
        F.when(both, F.concat_ws("|", F.lit("e"), F.col("_edge.s"), F.col("_edge.d")))
        .when(lone_src & multi, F.concat_ws("|", F.lit("g"), "dst_orient", "src_node", "dst_read"))
        .when(lone_dst & multi, F.concat_ws("|", F.lit("g"), "src_orient", "dst_node", "src_read"))
    )
    group = (
        F.when(both, F.concat_ws("|", F.lit("n"), F.least(s, d), F.greatest(s, d)))
        .when(lone_src, F.concat_ws("|", F.lit("m"), s, "dst_read"))
        .when(lone_dst, F.concat_ws("|", F.lit("m"), d, "src_read"))
        .otherwise(F.concat_ws("|", F.lit("p"), F.least("id1", "id2"), F.greatest("id1", "id2")))
    )
    payload = F.struct("line_no", *[c for c in keep or rows.columns if c not in ("line_no", "_edge")])
    distinct = (
        rows.select(group.alias("g"), read_pair().alias("k1"), second.alias("k2"), payload.alias("row"))
        .groupBy("g", "k1", "k2")
        .agg(F.min_by("row", "row.line_no").alias("row"))
    )
    ordered = distinct.groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct(F.col("row.line_no").alias("at"), "k1", "k2", "row"))).alias("c")
    )
    clash = lambda a, x: (a["k1"] == x["k1"]) | F.coalesce(a["k2"] == x["k2"], F.lit(False))
    taken = F.aggregate(
        F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))),
        F.slice("c", 1, 1),
        lambda acc, x: F.when(F.exists(acc, lambda a: clash(a, x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return ordered.select(F.explode(taken).alias("t")).select("t.row.*")


def accepted_overlaps(paf: DataFrame, asm: Assembly) -> DataFrame:
    """Overlaps worth expanding, with their oriented reads, nodes and attributes."""
    rows = locate(classify(paf), asm)
    columns = [
        "line_no", "src_read", "src_orient", "dst_read", "dst_orient", "src_node", "dst_node",
        "ol_len", "prefix_len", "prefix_len_rev", "src_len", "dst_len",
    ]
    return first_accepted(eligible(rows, asm.edges), columns).select(*columns)
