"""Scaffold graph: walks as key nodes, joined through ghost reads and inner edges."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import strand_node
from strandweave.operators.graph import prune_dead_ends, remove_nodes
from strandweave.operators.kmers import range_coverage
from strandweave.operators.numbering import lookup_side, with_row_index
from strandweave.operators.walks import walk_ends
from strandweave.session import cut


@dataclass
class ScaffoldGraph:
    """edges(new_src, new_dst, old_src, old_dst, prefix_len, ol_len) between key nodes
    (ids below ``n_walks``) and ghosts(node_id, hop, orient, read_id, read_len)."""

    edges: DataFrame
    ghosts: DataFrame
    n_walks: int
    useful: bool = True


def ghost_neighbours(ghost_adj: DataFrame, read_node: DataFrame, ends: DataFrame) -> DataFrame:
    """First-hop ghosts next to walk ends: orient, read_id, dir, walk_id, node_id, ..

    An out-neighbour must start a walk, an in-neighbour must end one; a node ending
    several walks yields one row for each.
    """
    near = ghost_adj.filter("hop = 1").join(
        lookup_side(read_node.withColumnRenamed("read_id", "nbr_read")), "nbr_read"
    )
    near = near.select(
        "orient", "read_id", "dir", strand_node("real_id", "nbr_orient").alias("node_id"), "prefix_len", "ol_len"
    ).distinct()
    open_ends = ends.select(
        "walk_id",
        "node_id",
        F.explode(
            F.filter(
                F.array(F.when(F.col("at_start"), F.lit("out")), F.when(F.col("at_end"), F.lit("in"))),
                lambda d: d.isNotNull(),
            )
        ).alias("dir"),
    ).distinct()
    return near.join(lookup_side(open_ends), ["node_id", "dir"])


def useful_ghosts(neighbours: DataFrame) -> DataFrame:
    """Ghosts with both an in and an out neighbour that do not all lie on one walk."""
    return (
        neighbours.groupBy("orient", "read_id")
        .agg(
            F.count_if(F.col("dir") == "in").alias("n_in"),
            F.count_if(F.col("dir") == "out").alias("n_out"),
            F.min("walk_id").alias("lo"),
            F.max("walk_id").alias("hi"),
        )
        .filter("n_in > 0 and n_out > 0 and lo < hi")
        .select("orient", "read_id")
    )


def second_hop(ghost_adj: DataFrame, first: DataFrame) -> DataFrame:
    """Second-hop ghosts between accepted first-hop ghosts: orient, read_id, dir, ghost, ..

    ``first`` has node_id, orient, read_id.
    """
    nbr = first.select(
        F.col("node_id").alias("ghost"), F.col("orient").alias("nbr_orient"), F.col("read_id").alias("nbr_read")
    )
    near = ghost_adj.filter("hop = 2").join(lookup_side(nbr), ["nbr_read", "nbr_orient"])
    near = near.select("orient", "read_id", "dir", "ghost", "prefix_len", "ol_len").distinct()
    both = (
        near.groupBy("orient", "read_id")
        .agg(F.count_if(F.col("dir") == "in").alias("i"), F.count_if(F.col("dir") == "out").alias("o"))
        .filter("i > 0 and o > 0")
        .select("orient", "read_id")
    )
    return near.join(both, ["orient", "read_id"])


def _scaffold_edge(src, dst, old_src, old_dst):
    none = F.lit(None).cast("long")
    return [
        src.alias("new_src"),
        dst.alias("new_dst"),
        (none if old_src is None else old_src).alias("old_src"),
        (none if old_dst is None else old_dst).alias("old_dst"),
        F.col("prefix_len"),
        F.col("ol_len"),
    ]


def ghost_edges_of(neighbours: DataFrame, ids: DataFrame) -> DataFrame:
    """Scaffold edges between first-hop ghosts and the walks they touch."""
    c = F.col
    rows = neighbours.join(lookup_side(ids.select("node_id", "orient", "read_id").withColumnRenamed("node_id", "ghost")), ["orient", "read_id"])
    out = rows.filter("dir = 'out'").select(*_scaffold_edge(c("ghost"), c("walk_id"), None, c("node_id")))
    into = rows.filter("dir = 'in'").select(*_scaffold_edge(c("walk_id"), c("ghost"), c("node_id"), None))
    return out.unionByName(into)


def inner_edges(ghost_edges: DataFrame, read_node: DataFrame, ends: DataFrame, ghosts: DataFrame | None) -> DataFrame:
    """Edges between walk ends, and (given ghosts) between ghosts, seen in the overlaps."""
    c = F.col
    rows = ghost_edges.filter("src_read <> dst_read")
    for side in ("src", "dst"):
        rows = rows.join(
            lookup_side(read_node.select(c("read_id").alias(f"{side}_read"), c("real_id").alias(f"{side}_real"))),
            f"{side}_read",
            "left",
        )
    inside = rows.filter("src_real is not null and dst_real is not null").select(
        strand_node("src_real", "src_orient").alias("s"), strand_node("dst_real", "dst_orient").alias("d"), "prefix_len", "ol_len"
    )
    tails = ends.filter("at_end").select(c("node_id").alias("s"), c("walk_id").alias("ws"))
    heads = ends.filter("at_start").select(c("node_id").alias("d"), c("walk_id").alias("wd"))
    found = inside.join(lookup_side(tails), "s").join(lookup_side(heads), "d").filter("ws <> wd")
    result = found.select(*_scaffold_edge(c("ws"), c("wd"), c("s"), c("d")))
    if ghosts is not None:
        outside = rows.filter("src_real is null or dst_real is null")
        for side in ("src", "dst"):
            outside = outside.join(
                ghosts.select(c("node_id").alias(f"{side}_ghost"), c("orient").alias(f"{side}_orient"), c("read_id").alias(f"{side}_read")),
                [f"{side}_read", f"{side}_orient"],
            )
        result = result.unionByName(outside.select(*_scaffold_edge(c("src_ghost"), c("dst_ghost"), None, None)))
    return result


def build_scaffold(
    walks: DataFrame,
    ghost_adj: DataFrame,
    ghost_edges: DataFrame,
    read_node: DataFrame,
    valid_p: float = 0.01,
    hop: int = 1,
    add_inner_edges: bool = False,
) -> ScaffoldGraph:
    """Insert ghosts (and inner edges), then prune ghosts left without in or out edges."""
    n_walks = walks.select("walk_id").distinct().count()
    ends = cut(walk_ends(walks, valid_p))
    lengths = ghost_adj.groupBy("hop", "orient", "read_id").agg(F.max("read_len").alias("read_len"))
    near = cut(ghost_neighbours(ghost_adj, read_node, ends))
    lengths = cut(lengths)
    first = lengths.filter("hop = 1")
    if hop <= 1:
        first = first.join(useful_ghosts(near), ["orient", "read_id"])
    ghosts = cut(with_row_index(first, ["orient", "read_id"], "node_id", start=n_walks))
    parts = [ghost_edges_of(near, ghosts)]
    if hop >= 2:
        outer = cut(second_hop(ghost_adj, ghosts))
        second = lengths.filter("hop = 2").join(outer.select("orient", "read_id").distinct(), ["orient", "read_id"])
        second = cut(with_row_index(second, ["orient", "read_id"], "node_id", start=n_walks + ghosts.count()))
        linked = outer.join(second.select("orient", "read_id", "node_id"), ["orient", "read_id"])
        c = F.col
        parts.append(linked.filter("dir = 'out'").select(*_scaffold_edge(c("node_id"), c("ghost"), None, None)))
        parts.append(linked.filter("dir = 'in'").select(*_scaffold_edge(c("ghost"), c("node_id"), None, None)))
        ghosts = cut(ghosts.unionByName(second))
    inner_added = False
    if add_inner_edges:
        inner = cut(inner_edges(ghost_edges, read_node, ends, ghosts if hop >= 2 else None))
        inner_added = not inner.isEmpty()
        parts.append(inner)
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    pruned = prune_dead_ends(edges, n_walks)
    alive = pruned.select(F.explode(F.array("new_src", "new_dst")).alias("node_id")).distinct()
    left = cut(ghosts.join(alive, "node_id", "left_semi"))
    return ScaffoldGraph(pruned, left, n_walks, useful=inner_added or not left.isEmpty())


# ------------------------------------------------------------------ repetitive ghosts


def slice_windows(orient, length, lo, hi, k: int):
    """Forward-strand window range of oriented windows lo <= p < hi."""
    last = length - k + 1
    plus = F.col(orient) == "+" if isinstance(orient, str) else orient == "+"
    return F.when(plus, lo).otherwise(last - hi), F.when(plus, hi).otherwise(last - lo)


def repetitive_ghosts(graph: ScaffoldGraph, ftiles: DataFrame, k: int, threshold: float) -> DataFrame:
    """Ghosts whose average overlap with their in- or out-neighbours is repetitive.

    The overlap's mean length (rounded down) is taken from the ghost's start for
    predecessors and from its end for successors.
    """
    e = graph.edges
    mean = F.floor(F.sum("ol_len") / F.count(F.lit(1))).cast("long")
    before = e.filter(F.col("new_dst") >= graph.n_walks).groupBy(F.col("new_dst").alias("node_id")).agg(mean.alias("a"))
    after = e.filter(F.col("new_src") >= graph.n_walks).groupBy(F.col("new_src").alias("node_id")).agg(mean.alias("a"))
    n = F.col("read_len")
    pre = before.withColumn("side", F.lit("pre")).join(graph.ghosts, "node_id").select(
        "node_id", "side", "orient", "read_id", "read_len", F.lit(0).alias("lo"), F.least(F.col("a"), n).alias("to")
    )
    suf_len = F.when(F.col("a") == 0, n).otherwise(F.least(F.col("a"), n))
    suf = after.withColumn("side", F.lit("suf")).join(graph.ghosts, "node_id").select(
        "node_id", "side", "orient", "read_id", "read_len", (n - suf_len).alias("lo"), n.alias("to")
    )
    asked = pre.unionByName(suf)
    lo, hi = slice_windows("orient", n, F.col("lo"), F.greatest(F.col("to") - k + 1, F.col("lo")), k)
    requests = asked.select(F.struct("node_id", "side").alias("req"), F.col("read_id").alias("name"), lo.alias("lo"), hi.alias("hi"))
    cov = range_coverage(requests, ftiles, "name")
    missed = F.col("total") - F.col("hits")
    return cov.filter(missed >= F.lit(threshold) * F.col("total")).select("req.node_id").distinct()


def drop_ghosts(graph: ScaffoldGraph, gone: DataFrame) -> ScaffoldGraph:
    return replace(
        graph,
        edges=cut(remove_nodes(graph.edges, gone, "new_src", "new_dst")),
        ghosts=cut(graph.ghosts.join(gone, "node_id", "left_anti")),
    )


# ------------------------------------------------------------------- parallel edges


def resolve_parallel(edges: DataFrame, walks: DataFrame, n_walks: int) -> DataFrame:
    """One edge per (new_src, new_dst): the one that discards the fewest walk nodes.

    The source's last position counts for, the target's first position against an edge;
    ties go to the longer overlap, then to the smaller node ids.
    """
    at = walks.groupBy("walk_id", "node_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    src_at = at.select(F.col("walk_id").alias("new_src"), F.col("node_id").alias("old_src"), F.col("last").alias("src_pos"))
    dst_at = at.select(F.col("walk_id").alias("new_dst"), F.col("node_id").alias("old_dst"), F.col("first").alias("dst_pos"))
    placed = edges.join(src_at, ["new_src", "old_src"], "left").join(dst_at, ["new_dst", "old_dst"], "left")
    kept = F.coalesce("src_pos", F.lit(0)) - F.coalesce("dst_pos", F.lit(0))
    order = F.struct(
        kept.alias("kept"),
        F.col("ol_len"),
        (-F.col("prefix_len")).alias("p"),
        (-F.coalesce("old_src", F.lit(0))).alias("s"),
        (-F.coalesce("old_dst", F.lit(0))).alias("d"),
    )
    item = F.struct("old_src", "old_dst", "prefix_len", "ol_len")
    best = placed.groupBy("new_src", "new_dst").agg(
        F.max_by(item, order).alias("e"), F.count(F.lit(1)).alias("_n")
    )
    clash = (F.col("new_src") >= n_walks) & (F.col("new_dst") >= n_walks) & (F.col("_n") > 1)
    checked = F.when(clash, F.raise_error(F.lit("duplicate edge between two ghosts")).cast("long")).otherwise(
        F.col("new_src")
    )
    return best.select(checked.alias("new_src"), "new_dst", "e.*")


# -------------------------------------------------------------------- edge coverage

# Coverage standing for "only invalid k-mers", and the k-mers an
# overhang must hold for its coverage to count.
INVALID_COVERAGE = -99999.0
MIN_KMERS = 100


def edge_sides(edges: DataFrame, graph: ScaffoldGraph, nodes: DataFrame) -> DataFrame:
    """Add the sequence behind both ends: {src,dst}_name, _orient, _len."""
    fields = ("name", "orient", "len")
    ghosts = graph.ghosts.select(
        F.lit(True).alias("ghost"), F.col("node_id").alias("id"), F.col("read_id").alias("name"), "orient", F.col("read_len").alias("len")
    )
    inner = nodes.select(F.lit(False).alias("ghost"), F.col("node_id").alias("id"), "name", "orient", F.col("read_len").alias("len"))
    known = lookup_side(ghosts.unionByName(inner))
    for side in ("src", "dst"):
        is_ghost = F.col(f"new_{side}") >= graph.n_walks
        edges = (
            edges.withColumn("ghost", is_ghost)
            .withColumn("id", F.when(is_ghost, F.col(f"new_{side}")).otherwise(F.col(f"old_{side}")))
            .join(known, ["ghost", "id"])
            .drop("ghost", "id")
            .withColumnsRenamed({f: f"{side}_{f}" for f in fields})
        )
    return edges


def edge_coverage(sided: DataFrame, ftiles: DataFrame, k: int, diff: float, threshold: float) -> DataFrame:
    """Coverage difference across each edge, in both walking directions.

    Adds diff_fwd, ok_fwd, diff_rev, ok_rev.  Walking backwards the same slices are cut
    from the swapped sequences, so both directions are computed here once and the walk
    search itself never touches a sequence.
    """
    ol = F.col("ol_len")
    slots = []
    for slot, side, kind in (("f1", "src", "head"), ("f2", "dst", "tail"), ("r1", "dst", "head"), ("r2", "src", "tail")):
        n = F.col(f"{side}_len")
        if kind == "head":  # s[:-ol], empty for ol = 0
            lo, hi = F.lit(0).cast("long"), F.when(ol == 0, 0).otherwise(n - ol - k + 1)
        else:  # s[ol:]
            lo, hi = ol, n - k + 1
        hi = F.greatest(lo, hi)
        flo, fhi = slice_windows(f"{side}_orient", n, lo, hi, k)
        slots.append(
            F.struct(F.lit(slot).alias("slot"), F.col(f"{side}_name").alias("name"), flo.cast("long").alias("lo"), fhi.cast("long").alias("hi"))
        )
    asked = sided.select("new_src", "new_dst", F.explode(F.array(*slots)).alias("q")).select("new_src", "new_dst", "q.*")
    requests = asked.select(F.struct("new_src", "new_dst", "slot").alias("req"), "name", "lo", "hi")
    cov = range_coverage(requests, ftiles, "name")
    invalid = F.col("total") - F.col("hits") >= F.lit(threshold) * F.col("total")
    value = F.when(invalid, F.lit(INVALID_COVERAGE)).otherwise(F.col("cov_sum") / F.col("hits"))
    wide = (
        cov.select("req.*", value.alias("c"))
        .groupBy("new_src", "new_dst")
        .agg(*[F.max(F.when(F.col("slot") == s, F.col("c"))).alias(s) for s in ("f1", "f2", "r1", "r2")])
    )
    joined = sided.join(wide, ["new_src", "new_dst"])
    long_enough = (ol + MIN_KMERS + k <= F.col("src_len")) & (ol + MIN_KMERS + k <= F.col("dst_len"))
    for tag, a, b in (("fwd", "f1", "f2"), ("rev", "r1", "r2")):
        one, two = F.col(a), F.col(b)
        delta = F.abs(one - two)
        either = (one == INVALID_COVERAGE) | (two == INVALID_COVERAGE)
        joined = joined.withColumn(f"diff_{tag}", delta).withColumn(
            f"ok_{tag}", long_enough & (either | (delta <= F.lit(diff) * F.greatest(one, two)))
        )
    return joined.drop("f1", "f2", "r1", "r2")
