"""Relational graph operators on edges(src, dst, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import complement_id
from strandweave.session import cut

# Neighbours per array: a hub is listed in several chunks instead of one huge row.
CHUNK = 4096


def adjacency(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """src, part, dsts: sorted successor arrays.

    A node with more than ``chunk`` successors gets several parts, split by target hash,
    so no array grows with a hub's degree.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_d"))
    parts = edges.join(degree, "src").withColumn(
        "part", F.pmod(F.xxhash64("dst"), F.ceil(F.col("_d") * 2 / F.lit(chunk)))
    )
    # below half a chunk the modulus is 1: everything in part 0
    return parts.groupBy("src", "part").agg(F.array_sort(F.collect_list("dst")).alias("dsts"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, in_deg, out_deg, zero for isolated nodes."""
    counted = (
        edges.select(F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
        .unionAll(edges.select(F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        .unionAll(nodes.select("node_id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    )
    return counted.groupBy("node_id").agg(F.sum("i").alias("in_deg"), F.sum("o").alias("out_deg"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Scaffold edges with both node and walk-node ends swapped."""
    swap = {"new_src": "new_dst", "new_dst": "new_src", "old_src": "old_dst", "old_dst": "old_src"}
    return edges.select(*[F.col(swap.get(c, c)).alias(c) for c in edges.columns])


def remove_nodes(edges: DataFrame, gone: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges touching none of the nodes in ``gone`` (column node_id)."""
    left = edges.join(gone.select(F.col("node_id").alias(src)), src, "left_anti")
    return left.join(gone.select(F.col("node_id").alias(dst)), dst, "left_anti").select(*edges.columns)


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def induced_subgraph(nodes: DataFrame, edges: DataFrame, visited: DataFrame):
    """(nodes, edges) without the visited nodes; ids stay the original ones."""
    return nodes.join(visited.select("node_id"), "node_id", "left_anti"), remove_nodes(edges, visited)


def jumped_over(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes between consecutive walk nodes (s -> t -> d) and their complements.

    The walk steps join their source's successors first, so the work follows the walks'
    degrees, and the second hop is a semi join on the full edge.
    """
    ahead = walks.select("walk_id", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("d"))
    pairs = walks.withColumnRenamed("node_id", "s").join(ahead, ["walk_id", "pos"]).select("s", "d").distinct()
    links = edges.select("src", "dst").distinct()
    via = pairs.join(links.select(F.col("src").alias("s"), F.col("dst").alias("t")), "s")
    middle = via.join(links.select(F.col("src").alias("t"), F.col("dst").alias("d")), ["t", "d"], "left_semi")
    return middle.select(F.explode(F.array(F.col("t"), complement_id("t"))).alias("node_id")).distinct()


def prune_dead_ends(edges: DataFrame, first_ghost: int) -> DataFrame:
    """Drop ghosts (node id >= first_ghost) lacking an in or an out edge, to a fixpoint."""
    current = cut(edges)
    while True:
        ends = current.select(
            F.explode(
                F.array(
                    F.struct(F.col("new_src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                    F.struct(F.col("new_dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
                )
            ).alias("e")
        ).select("e.*")
        dead = cut(
            ends.filter(F.col("node_id") >= first_ghost)
            .groupBy("node_id")
            .agg(F.max("o").alias("o"), F.max("i").alias("i"))
            .filter("o = 0 or i = 0")
            .select("node_id")
        )
        if dead.isEmpty():
            return current
        current = cut(remove_nodes(current, dead, "new_src", "new_dst"))


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node_id, comp (smallest node id of the weakly connected component).

    Each round contracts the graph: every node points to its smallest neighbour, labels
    are followed one step, and edges are relabelled and deduplicated, so the edge list
    shrinks quickly, hubs included.  Each round takes a node at least from every component
    that still has an edge, so the rounds come to an end.
    """
    work = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    nodes = work.select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    work = cut(work.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = cut(nodes.withColumn("comp", F.col("node_id")))
    while True:
        if work.isEmpty():
            return labels
        both = work.unionAll(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")))
        # follow once: the target of the target is never larger
        point = cut(
            point.alias("p")
            .join(point.alias("q"), F.col("p.to") == F.col("q.a"), "left")
            .select(F.col("p.a").alias("a"), F.coalesce("q.to", "p.to").alias("to"))
        )
        labels = cut(
            labels.join(point.select(F.col("a").alias("comp"), "to"), "comp", "left").select(
                "node_id", F.coalesce("to", "comp").alias("comp")
            )
        )
        moved = work.join(point.select("a", F.col("to").alias("x")), "a").join(
            point.select(F.col("a").alias("b"), F.col("to").alias("y")), "b"
        )
        work = cut(
            moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
