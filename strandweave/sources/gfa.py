"""GFA graphs: raw unitig graphs (S/A/L lines) and final contigs (A lines)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.sequence import complement_id, overlap_similarity, reverse_complement, strand_node
from strandweave.operators.numbering import with_row_index
from strandweave.session import cut
from strandweave.sources.text import fields, known, require

# Read names that stand for scaffolding gaps.
GAP_NAMES = ("Ns", "scaf")


@dataclass
class Assembly:
    """The graph tables of one assembly.

    nodes(node_id, name, orient, read_len), real strand 2i and reverse strand 2i+1
    sequences(name, seq), forward strand only
    edges(edge_id, src, dst, prefix_len, ol_len, ol_sim)
    read_node(read_id, real_id)
    unitig_reads(real_id, idx, read_id, orient), unitig_ends one row per real node
    walks(walk_id, pos, node_id), only known for final contigs
    """

    nodes: DataFrame
    sequences: DataFrame
    edges: DataFrame
    read_node: DataFrame
    unitig_reads: DataFrame | None
    unitig_ends: DataFrame
    walks: DataFrame | None = None


# ---------------------------------------------------------------- raw unitig graph


def segment_rows(lines: DataFrame) -> DataFrame:
    """S lines; a sequence ``*`` is absent, i.e. empty if its length is 0 and else unknown."""
    rows = fields(lines).filter(F.col("f")[0] == "S")
    rows = rows.withColumn("f", require(F.size("f") == 5, F.col("f"), "S line without 4 fields"))
    seq, read_len = known(F.col("f")[2]), known(F.expr("substring(f[3], 6)")).cast("long")
    return rows.select(
        "line_no",
        F.col("f")[1].alias("name"),
        F.when(seq.isNull() & (read_len == 0), F.lit("")).otherwise(seq).alias("seq"),
        read_len.alias("read_len"),
    )


def member_rows(lines: DataFrame) -> DataFrame:
    rows = fields(lines).filter(F.col("f")[0] == "A")
    return rows.select(
        "line_no",
        F.col("f")[1].alias("name"),
        F.col("f")[2].cast("long").alias("start"),
        F.col("f")[3].alias("orient"),
        F.col("f")[4].alias("read_id"),
        known(F.col("f")[5]).cast("long").alias("rstart"),
        known(F.col("f")[6]).cast("long").alias("rend"),
    )


def link_rows(lines: DataFrame) -> DataFrame:
    """L lines; the older form carries ``:start-end`` suffixes on the ids.  An overlap ``*`` is null."""
    rows = fields(lines).filter(F.col("f")[0] == "L")
    old, new = F.size("f") == 7, F.size("f") == 8
    rows = rows.withColumn("f", require(old | new, F.col("f"), "L line of unknown format"))
    orient_ok = F.col("f")[2].isin("+", "-") & F.col("f")[4].isin("+", "-")
    rows = rows.withColumn("f", require(orient_ok, F.col("f"), "L line of unknown orientation"))

    def name(i: int):
        stem = F.regexp_extract(F.col("f")[i], r"(.*):\d-\d*", 1)
        return F.when(old, stem).otherwise(F.col("f")[i])

    return rows.select(
        "line_no",
        name(1).alias("id1"),
        F.col("f")[2].alias("o1"),
        name(3).alias("id2"),
        F.col("f")[4].alias("o2"),
        F.expr("cast(case when f[5] <> '*' then substring(f[5], 1, length(f[5]) - 1) end as bigint)").alias("ol_len"),
    )


def number_segments(lines: DataFrame) -> DataFrame:
    """Segments with their real node id, in file order: line_no, name, seq, read_len, real_id."""
    ranked = with_row_index(segment_rows(lines), ["line_no"], "real_id")
    return ranked.withColumn("real_id", F.col("real_id") * 2)


def both_strands(segments: DataFrame) -> DataFrame:
    """One row per strand: node_id, name, orient, read_len."""
    strands = F.array(
        F.struct(F.col("real_id").alias("node_id"), F.lit("+").alias("orient")),
        F.struct((F.col("real_id") + 1).alias("node_id"), F.lit("-").alias("orient")),
    )
    return segments.select("name", "read_len", F.explode(strands).alias("s")).select(
        "s.node_id", "name", "s.orient", "read_len"
    )


def unitig_members(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Reads of each ``utg`` segment in file order: real_id, idx, read_id, orient."""
    utgs = segments.filter(F.col("name").startswith("utg")).select("name", "real_id")
    rows = member_rows(lines).join(utgs, "name").select("real_id", "line_no", "read_id", "orient")
    return with_row_index(rows, ["line_no"], "idx", ["real_id"]).drop("line_no")


def ends_of(unitig_reads: DataFrame) -> DataFrame:
    """First and last read per unitig, aggregated map-side: real_id, n, first.., last.."""
    item = F.struct("read_id", "orient")
    ends = unitig_reads.groupBy("real_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(item, "idx").alias("a"),
        F.max_by(item, "idx").alias("b"),
    )
    return ends.select(
        "real_id",
        "n",
        F.col("a.read_id").alias("first"),
        F.col("a.orient").alias("first_orient"),
        F.col("b.read_id").alias("last"),
        F.col("b.orient").alias("last_orient"),
    )


def link_edges(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Directed edges with attributes: src, dst, ol_len, prefix_len, line_no.

    A later line overwrites the attributes of an earlier one, also those it implies for
    the reverse-complement twin; only edges the file itself lists are kept.
    """
    left = segments.select(F.col("name").alias("id1"), F.col("real_id").alias("r1"), F.col("read_len").alias("n1"))
    right = segments.select(F.col("name").alias("id2"), F.col("real_id").alias("r2"), F.col("read_len").alias("n2"))
    links = link_rows(lines).join(left, "id1", "left").join(right, "id2", "left")
    known = F.col("r1").isNotNull() & F.col("r2").isNotNull()
    links = links.select(
        "line_no",
        require(known, strand_node("r1", "o1"), "L line names an unknown segment").alias("s"),
        strand_node("r2", "o2").alias("d"),
        "ol_len",
        "n1",
        "n2",
    )
    sides = F.array(
        F.struct(F.col("s").alias("src"), F.col("d").alias("dst"), F.lit(1).alias("listed"), F.col("n1").alias("src_len")),
        F.struct(complement_id("d").alias("src"), complement_id("s").alias("dst"), F.lit(0).alias("listed"), F.col("n2").alias("src_len")),
    )
    written = links.select("line_no", "ol_len", F.explode(sides).alias("e")).select("line_no", "ol_len", "e.*")
    # within one line the edge itself is written first, then its twin
    stamp = F.struct("line_no", -F.col("listed"))
    return (
        written.groupBy("src", "dst")
        .agg(
            F.max("listed").alias("listed"),
            F.max_by("ol_len", stamp).alias("ol_len"),
            F.max("src_len").alias("src_len"),
            F.max(F.when(F.col("listed") == 1, F.col("line_no"))).alias("line_no"),
        )
        .filter("listed = 1")
        .select("src", "dst", "ol_len", (F.col("src_len") - F.col("ol_len")).alias("prefix_len"), "line_no")
    )


def with_node_sequence(df: DataFrame, node: str, out: str, nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Join the oriented sequence of ``node``; the reverse strand is computed, not stored."""
    side = nodes.select(F.col("node_id").alias(node), F.col("name").alias("_name"), F.col("orient").alias("_orient"))
    seqs = sequences.select(F.col("name").alias("_name"), F.col("seq").alias("_seq"))
    return (
        df.join(side, node)
        .join(seqs, "_name")
        .withColumn(out, F.when(F.col("_orient") == "+", F.col("_seq")).otherwise(reverse_complement("_seq")))
        .drop("_name", "_orient", "_seq")
    )


def edge_similarity(edges: DataFrame, nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Add ol_sim.  Only the overlapping ends travel through the join, not whole sequences.

    An edge and its reverse complement have one similarity, which is computed once.
    """
    real = sequences.join(nodes.filter("orient = '+'").select("name", "node_id"), "name")
    same = F.least(F.struct("src", "dst"), F.struct(complement_id("dst").alias("src"), complement_id("src").alias("dst")))
    paired = edges.withColumn("_same", same)
    ends = paired.select("_same.src", "_same.dst", "ol_len").distinct().select(
        "src",
        "dst",
        "ol_len",
        F.col("src").bitwiseAND(F.lit(-2)).alias("src_real"),
        F.col("dst").bitwiseAND(F.lit(-2)).alias("dst_real"),
    )

    def cut_end(rows, real_col, node_col, at_end, out):
        seqs = real.select(F.col("node_id").alias(real_col), F.col("seq").alias("_s"))
        forward = F.col(node_col) == F.col(real_col)
        n = F.col("ol_len").cast("int")
        right, left = F.right("_s", n), F.left("_s", n)
        near, far = (right, left) if at_end else (left, right)
        return (
            rows.join(seqs, real_col)
            .withColumn(out, F.when(forward, near).otherwise(reverse_complement(far)))
            .drop("_s")
        )

    # of a pair only one text moves, to where the other is cut; AQE splits the join's large partitions, and
    # both texts in one more shuffle would be most of what is written
    ends = cut_end(ends, "src_real", "src", True, "_a")
    ends = cut_end(ends, "dst_real", "dst", False, "_b")
    sims = ends.select(
        F.struct("src", "dst").alias("_pair"), F.col("ol_len").alias("_n"), overlap_similarity("_a", "_b", "ol_len").alias("ol_sim")
    )
    # an unknown overlap has no similarity, but its edge stays
    met = (F.col("_same") == F.col("_pair")) & F.col("ol_len").eqNullSafe(F.col("_n"))
    return paired.join(sims, met).select(*edges.columns, "ol_sim")


def number_edges(edges: DataFrame) -> DataFrame:
    return with_row_index(edges, ["line_no"], "edge_id").drop("line_no")


def raw_edges(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """The link lines' edges with their similarity, not numbered yet."""
    return edge_similarity(link_edges(lines, segments), both_strands(segments), segments.select("name", "seq"))


def raw_assembly(lines: DataFrame, segments: DataFrame | None = None, edges: DataFrame | None = None) -> Assembly:
    """Tables of a raw unitig graph.  Reads inside unitigs replace segment names, if any.

    Written tables of :func:`number_segments` and :func:`raw_edges` of the same written lines
    may be given, else they are made here.
    """
    if segments is None:
        lines = cut(lines)
        segments = cut(number_segments(lines))
    if edges is None:
        edges = raw_edges(lines, segments)
    nodes = both_strands(segments)
    sequences = segments.select("name", "seq")
    members = cut(unitig_members(lines, segments))
    plain = segments.filter(~F.col("name").startswith("utg")).select(
        "real_id", F.lit(0).cast("long").alias("idx"), F.col("name").alias("read_id"), F.lit("+").alias("orient")
    )
    contents = members.unionByName(plain)
    # a read listed by several unitigs belongs to the last one
    from_members = members.groupBy("read_id").agg(F.max("real_id").alias("real_id"))
    if from_members.limit(1).count():
        read_node = from_members
    else:
        read_node = segments.select(F.col("name").alias("read_id"), "real_id")
    return Assembly(nodes, sequences, cut(number_edges(edges)), cut(read_node), contents, cut(ends_of(contents)))


# ------------------------------------------------------------------- final contigs


def contig_rows(lines: DataFrame) -> DataFrame:
    """A lines between the first and the last real read of each contig, gaps named.

    Returns contig, pos, start, orient, name, rstart, rend, gap_len, next_start; a gap is
    named after its length, so gaps of equal length share a node.
    """
    rows = member_rows(lines).withColumnRenamed("name", "contig").withColumn(
        "is_gap", F.col("read_id").isin(*GAP_NAMES)
    )
    placed = with_row_index(rows, ["start", "line_no"], "pos", ["contig"])
    bounds = (
        placed.filter(~F.col("is_gap"))
        .groupBy("contig")
        .agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("line_no").alias("_seen"))
    )
    kept = (
        placed.join(bounds.drop("_seen"), "contig")
        .filter(F.col("pos").between(F.col("lo"), F.col("hi")))
        .withColumn("pos", F.col("pos") - F.col("lo"))
        .drop("lo", "hi")
    )
    following = kept.select("contig", (F.col("pos") - 1).alias("pos"), F.col("start").alias("next_start"))
    kept = kept.join(following, ["contig", "pos"], "left")
    gap_len = F.when(F.col("is_gap"), F.col("next_start") - F.col("start"))
    return kept.select(
        "contig",
        "pos",
        "line_no",
        "start",
        "orient",
        F.when(F.col("is_gap"), F.concat(F.lit("custom_n_"), gap_len)).otherwise(F.col("read_id")).alias("name"),
        "rstart",
        "rend",
        gap_len.alias("gap_len"),
        "next_start",
    )


def number_contig_nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """name, read_len, gap_len, real_id: reads by id first, gaps by length after them.

    A read that ``lengths`` does not list fails the query; one listed without a length keeps a null.
    """
    reads = rows.filter("gap_len is null").select("name").distinct().join(
        lengths.select(F.col("read_id").alias("name"), "read_len", F.lit(True).alias("listed")), "name", "left"
    )
    reads = reads.select(
        "name", require(F.col("listed").isNotNull(), F.col("read_len"), "read without sequence").alias("read_len")
    ).withColumn("gap_len", F.lit(None).cast("long"))
    gaps = rows.filter("gap_len is not null").select("name", F.col("gap_len").alias("read_len"), "gap_len").distinct()
    every = reads.unionByName(gaps).withColumn("grp", F.col("gap_len").isNotNull().cast("int"))
    every = every.withColumn("ord", F.coalesce("gap_len", F.lit(0)))
    ranked = with_row_index(every, ["grp", "ord", "name"], "real_id")
    return ranked.select("name", "read_len", "gap_len", (F.col("real_id") * 2).alias("real_id"))


def contig_edges(placed: DataFrame) -> DataFrame:
    """Edges between consecutive rows; an edge met again keeps its first attributes.

    ``placed`` has contig_no, pos, node_id, start.
    """
    step = placed.select(
        "contig_no", (F.col("pos") - 1).alias("pos"), F.col("node_id").alias("dst"), F.col("start").alias("dst_start")
    )
    pairs = placed.join(step, ["contig_no", "pos"])
    return (
        pairs.groupBy(F.col("node_id").alias("src"), "dst")
        .agg(F.min(F.struct("contig_no", "pos", (F.col("dst_start") - F.col("start")).alias("prefix_len"))).alias("e"))
        .select(
            "src",
            "dst",
            F.lit(0).cast("long").alias("ol_len"),
            F.col("e.prefix_len").alias("prefix_len"),
            F.lit(1.0).alias("ol_sim"),
            F.struct("e.contig_no", "e.pos").alias("line_no"),
        )
    )


def number_contigs(rows: DataFrame) -> DataFrame:
    """contig, contig_no in order of first appearance."""
    seen = rows.groupBy("contig").agg(F.min("line_no").alias("line_no"))
    return with_row_index(seen, ["line_no"], "contig_no").drop("line_no")


def place_contigs(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Contig rows with contig_no and oriented node_id."""
    return (
        rows.join(ids.select("name", "real_id"), "name")
        .join(number_contigs(rows), "contig")
        .withColumn("node_id", strand_node("real_id", "orient"))
    )


def contig_assembly(lines: DataFrame, reads: DataFrame) -> Assembly:
    """Tables of a final contig graph; ``reads`` has read_id, seq, read_len."""
    rows = cut(contig_rows(lines))
    ids = cut(number_contig_nodes(rows, reads.select("read_id", "read_len")))
    placed = cut(place_contigs(rows, ids))
    gap_seqs = ids.filter("gap_len is not null").select("name", F.expr("repeat('N', cast(gap_len as int))").alias("seq"))
    read_seqs = ids.filter("gap_len is null").select("name").join(
        reads.select(F.col("read_id").alias("name"), "seq"), "name"
    )
    edges = cut(number_edges(contig_edges(placed)))
    contents = ids.select(
        "real_id", F.lit(0).cast("long").alias("idx"), F.col("name").alias("read_id"), F.lit("+").alias("orient")
    )
    return Assembly(
        nodes=both_strands(ids),
        sequences=read_seqs.unionByName(gap_seqs),
        edges=edges,
        read_node=ids.select(F.col("name").alias("read_id"), "real_id"),
        unitig_reads=contents,
        unitig_ends=ends_of(contents),
        walks=placed.select(F.col("contig_no").alias("walk_id"), "pos", "node_id"),
    )
