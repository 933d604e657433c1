"""Walks as (walk_id, pos, node_id) rows: lengths, offsets, sequences, positions, ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import reverse_complement, slice_length
from strandweave.operators.numbering import lookup_side, running_sum_before
from strandweave.sources.text import require

LINE = 80
POSITION_BUCKET = 1 << 16


def steps(walks: DataFrame, edges: DataFrame) -> DataFrame:
    """Each walk node with the next node and the edge between them (null at the end).

    The neighbour comes from a join on (walk, position), so a walk of any length stays
    spread; when an edge repeats, the last one listed is used.
    """
    ahead = walks.select("walk_id", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("next_node"))
    latest = edges.groupBy("src", "dst").agg(
        F.max_by("prefix_len", "edge_id").alias("prefix_len"),
        F.max_by("ol_len", "edge_id").alias("ol_len"),
    )
    latest = latest.withColumnsRenamed({"src": "node_id", "dst": "next_node"})
    return walks.join(ahead, ["walk_id", "pos"], "left").join(latest, ["node_id", "next_node"], "left")


def pieces(walks: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bases each node contributes: walk_id, pos, node_id, take, piece_len.

    ``take`` is the prefix length towards the next node, null (everything) at the end.
    """
    lens = nodes.select("node_id", "read_len")
    return (
        steps(walks, edges)
        .join(lens, "node_id")
        .select(
            "walk_id",
            "pos",
            "node_id",
            F.col("prefix_len").alias("take"),
            F.when(F.col("next_node").isNull(), F.col("read_len"))
            .otherwise(slice_length("read_len", "prefix_len"))
            .alias("piece_len"),
        )
    )


def offsets(placed: DataFrame) -> DataFrame:
    """Add the offset of each piece within its walk."""
    return running_sum_before(placed, ["walk_id"], "pos", {"offset": "piece_len"})


def walk_lengths(walks: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """walk_id, n_nodes, length: the sum of prefixes plus the whole last node."""
    rows = steps(walks, edges).join(nodes.select("node_id", "read_len"), "node_id")
    step = F.when(F.col("next_node").isNull(), F.col("read_len")).otherwise(F.col("prefix_len"))
    return rows.groupBy("walk_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(step).alias("length"))


def render_lines(parts: DataFrame, width: int = LINE) -> DataFrame:
    """Text lines of each contig from pieces (contig_id, offset, text).

    A contig is never assembled in one row: each piece is cut at line borders and only
    the at most ``width`` fragments of a line meet.
    """
    cuts = parts.filter(F.length("text") > 0).withColumn("_end", F.col("offset") + F.length("text"))
    spread = cuts.withColumn(
        "line",
        F.explode(
            F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("_end") - 1) / width))
        ),
    )
    lo = F.greatest(F.col("offset"), F.col("line") * width)
    hi = F.least(F.col("_end"), (F.col("line") + 1) * width)
    frag = F.substring("text", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int"))
    frags = spread.select("contig_id", "line", lo.alias("at"), frag.alias("frag"))
    return (
        frags.groupBy("contig_id", "line")
        .agg(F.array_sort(F.collect_list(F.struct("at", "frag"))).alias("l"))
        .select("contig_id", "line", F.array_join(F.transform("l", lambda x: x["frag"]), "").alias("bases"))
    )


def cut_pieces(located: DataFrame, sequences: DataFrame, chunk: int = 1 << 14) -> DataFrame:
    """contig_id, offset, text for pieces (contig_id, offset, name, orient, skip, piece_len).

    ``skip`` bases of the oriented sequence are left out in front.  A long piece becomes
    several rows of at most ``chunk`` bases.  A name without sequence fails the query.
    """
    seqs = sequences.select("name", "seq")
    n = F.length("_o")
    known = require(F.col("seq").isNotNull(), F.col("seq"), "a piece's read has no sequence")
    joined = located.join(seqs, "name", "left").withColumn("seq", known)
    joined = joined.withColumn("_o", F.when(F.col("orient") == "+", F.col("seq")).otherwise(reverse_complement("seq")))
    body = F.substring("_o", (F.col("skip") + 1).cast("int"), F.least(F.col("piece_len").cast("int"), n))
    split = joined.filter("piece_len > 0").select(
        "contig_id",
        "offset",
        F.posexplode(F.regexp_extract_all(body, F.lit("(?s).{1,%d}" % chunk), F.lit(0))).alias("_i", "text"),
    )
    return split.select("contig_id", (F.col("offset") + F.col("_i") * chunk).alias("offset"), "text")


def walk_lines(walks: DataFrame, edges: DataFrame, nodes: DataFrame, sequences: DataFrame, width: int = LINE) -> DataFrame:
    """contig_id (= walk_id), line, bases of every walk."""
    placed = offsets(pieces(walks, edges, nodes)).join(nodes.select("node_id", "name", "orient"), "node_id")
    located = placed.select(
        F.col("walk_id").alias("contig_id"), "offset", "name", "orient", F.lit(0).alias("skip"), "piece_len"
    )
    return render_lines(cut_pieces(located, sequences), width)


def nodes_at(points: DataFrame, placed: DataFrame, bucket: int = POSITION_BUCKET) -> DataFrame:
    """Node covering each point; ``points`` has walk_id and ``at``.

    Interval join on (walk, bucket): a piece is listed once per bucket it touches, so no
    task sees a whole long walk and no base is exploded.
    """
    covers = placed.filter("piece_len > 0").withColumn(
        "_b",
        F.explode(
            F.sequence(
                F.floor(F.col("offset") / bucket), F.floor((F.col("offset") + F.col("piece_len") - 1) / bucket)
            )
        ),
    )
    covers = covers.select("walk_id", "_b", "pos", "node_id", F.col("offset").alias("_lo"), (F.col("offset") + F.col("piece_len")).alias("_hi"))
    asked = points.withColumn("_b", F.floor(F.col("at") / bucket))
    hit = asked.join(covers, ["walk_id", "_b"]).filter("at >= _lo and at < _hi")
    return hit.drop("_b", "_lo", "_hi")


def walk_sizes(walks: DataFrame) -> DataFrame:
    return walks.groupBy("walk_id").agg(F.count(F.lit(1)).alias("n"))


def walk_ends(walks: DataFrame, valid_p: float) -> DataFrame:
    """Nodes other walks may attach to: walk_id, pos, node_id, at_start, at_end.

    The first and the last ``valid_p`` share of each walk, at least one node.
    """
    sized = walks.join(lookup_side(walk_sizes(walks)), "walk_id")
    cutoff = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / F.lit(1 / valid_p)).cast("long"))
    return (
        sized.withColumn("at_start", F.col("pos") < cutoff)
        .withColumn("at_end", F.col("pos") >= F.col("n") - cutoff)
        .filter("at_start or at_end")
        .select("walk_id", "pos", "node_id", "at_start", "at_end")
    )


def multi_mapped(ends: DataFrame) -> DataFrame:
    """How many nodes start (or end) more than one walk."""
    per_node = ends.groupBy("node_id").agg(
        F.count_distinct(F.when(F.col("at_start"), F.col("walk_id"))).alias("s"),
        F.count_distinct(F.when(F.col("at_end"), F.col("walk_id"))).alias("e"),
    )
    return per_node.agg(
        F.count_if(F.col("s") > 1).alias("multi_start"), F.count_if(F.col("e") > 1).alias("multi_end")
    )


def assembly_stats(lengths: DataFrame) -> DataFrame:
    """n_contigs, total, longest, n50 of contig lengths (column ``length``).

    N50 needs a running total over lengths; equal lengths are merged first and the total
    is scanned in blocks.
    """
    from strandweave.operators.numbering import with_row_index

    by_len = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("k"))
    ranked = with_row_index(by_len.withColumn("_neg", -F.col("length")), ["_neg"], "_i")
    scanned = running_sum_before(ranked.withColumn("_g", F.lit(0)), ["_g"], "_i", {"before": F.col("length") * F.col("k")})
    total = lengths.agg(
        F.count(F.lit(1)).alias("n_contigs"), F.sum("length").alias("total"), F.max("length").alias("longest")
    )
    reached = scanned.join(F.broadcast(total)).filter(
        (F.col("before") + F.col("length") * F.col("k")) * 2 >= F.col("total")
    )
    return reached.groupBy("n_contigs", "total", "longest").agg(F.max("length").alias("n50"))
