"""Every operator as a query over the driver's tables, with its SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave import views
from strandweave.functions import sequence as sq
from strandweave.functions.overlap import classify, twin_rows
from strandweave.operators import baseline, contigs, fingerprint, gnn, graph, hops, kmers, lookahead, matching, overlaps, sampling, scaffold, telomere, walks
from strandweave.operators.numbering import with_row_index
from strandweave.plans import oracle
from strandweave.plans.postprocess import KmerSettings, Settings, TelomereScan, postprocess
from strandweave.session import checkpoint_dir, cut, delta_coded, tune
from strandweave.sources import fasta, gfa, reports
from strandweave.sources.paf import parse_paf

K, MOTIFS = oracle.K, oracle.MOTIFS
SCAN = TelomereScan(oracle.MIN_SCORE, oracle.PENALTY, oracle.MAX_DROP)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Stages several queries build on, written once per session and data folder.
_stages: dict[tuple, object] = {}


def stage(fn):
    def get(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in _stages:
            tune(spark)
            _stages[key] = fn(spark, sf)
        return _stages[key]

    return get


def forget_stages() -> None:
    _stages.clear()


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = oracle.with_ctes(sql)
        return run

    return register


# --------------------------------------------------------------------------- stages


@stage
def reads(spark, sf):
    return cut(views.reads(spark, sf).select("read_id", "seq", "read_len"))


@stage
def paf_rows(spark, sf):
    return cut(parse_paf(views.paf_lines(spark, sf)))


def folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@stage
def blocked_reads(spark, sf):
    path = folder(spark, "blocked")
    fasta.write_blocked(reads(spark, sf), path)
    return path


@stage
def indexed_reads(spark, sf):
    """Indexes of two sets of FASTA files: accurate and long reads."""
    out = []
    for name, rows in (("accurate", views.fastq_lines(spark, sf)), ("long", views.long_read_lines(spark, sf))):
        files, index = folder(spark, name), folder(spark, f"{name}-index")
        rows.write.text(files)
        fasta.save_index(fasta.read_index(spark, files, kind="fasta"), index)
        out.append(index)
    return out


@stage
def quad_files(spark, sf):
    path = folder(spark, "quads")
    views.quad_lines(spark, sf).write.text(path)
    return path


@stage
def raw_lines(spark, sf):
    return cut(views.raw_gfa_lines(spark, sf))


@stage
def raw_segments(spark, sf):
    return cut(gfa.number_segments(raw_lines(spark, sf)))


@stage
def raw_edges(spark, sf):
    return cut(gfa.raw_edges(raw_lines(spark, sf), raw_segments(spark, sf)))


@stage
def raw_asm(spark, sf):
    return gfa.raw_assembly(raw_lines(spark, sf), raw_segments(spark, sf), raw_edges(spark, sf))


@stage
def contig_rows(spark, sf):
    return cut(gfa.contig_rows(views.contig_gfa_lines(spark, sf)))


@stage
def contig_asm(spark, sf):
    return gfa.contig_assembly(views.contig_gfa_lines(spark, sf), reads(spark, sf))


@stage
def contig_ids(spark, sf):
    return cut(gfa.number_contig_nodes(contig_rows(spark, sf), reads(spark, sf)))


@stage
def contig_placed(spark, sf):
    return cut(gfa.place_contigs(contig_rows(spark, sf), contig_ids(spark, sf)))


@stage
def accepted_raw(spark, sf):
    return cut(overlaps.accepted_overlaps(paf_rows(spark, sf), raw_asm(spark, sf)))


@stage
def accepted_contig(spark, sf):
    return cut(overlaps.accepted_overlaps(paf_rows(spark, sf), contig_asm(spark, sf)))


@stage
def expanded_raw(spark, sf):
    return hops.expand(accepted_raw(spark, sf), hops.boundary_reads(raw_asm(spark, sf).unitig_ends))


@stage
def expanded_contig(spark, sf):
    return hops.expand(accepted_contig(spark, sf), hops.boundary_reads(contig_asm(spark, sf).unitig_ends))


@stage
def expanded_far(spark, sf):
    """Three hops from the contigs' first reads only, so that there are ghosts of ghosts."""
    first = contig_placed(spark, sf).filter("pos = 0").select(F.col("name").alias("read_id"))
    ge, ga = hops.expand(accepted_contig(spark, sf), first, max_hops=3)
    return cut(ge), cut(ga)


@stage
def counts(spark, sf):
    return cut(kmers.count_kmers(reads(spark, sf), K), delta_coded("hash"))


@stage
def bounds(spark, sf):
    return cut(kmers.solid_bounds(kmers.spectrum(counts(spark, sf))))


@stage
def solid(spark, sf):
    return cut(kmers.solid(counts(spark, sf), bounds(spark, sf)))


@stage
def placed_pieces(spark, sf):
    asm = contig_asm(spark, sf)
    return cut(walks.offsets(walks.pieces(asm.walks, asm.edges, asm.nodes)))


@stage
def scan_lines(spark, sf):
    asm = contig_asm(spark, sf)
    return cut(walks.walk_lines(asm.walks, asm.edges, asm.nodes, asm.sequences, telomere.SCAN_WIDTH))


@stage
def hits(spark, sf):
    return cut(telomere.motif_hits(scan_lines(spark, sf), MOTIFS))


@stage
def regions(spark, sf):
    sizes = telomere.contig_sizes(scan_lines(spark, sf))
    return cut(telomere.telomere_regions(hits(spark, sf), sizes, MOTIFS, SCAN.min_score, SCAN.penalty, SCAN.max_drop))


@stage
def typed(spark, sf):
    return cut(telomere.type_regions(regions(spark, sf), hits(spark, sf), MOTIFS))


@stage
def telo_nodes(spark, sf):
    return cut(telomere.region_nodes(typed(spark, sf), placed_pieces(spark, sf)))


@stage
def chopped(spark, sf):
    w = contig_asm(spark, sf).walks
    new_walks, telo_ref = telomere.chop_walks(w, telomere.telomere_events(w, telo_nodes(spark, sf)))
    return cut(new_walks), cut(telo_ref)


@stage
def ends(spark, sf):
    return cut(walks.walk_ends(contig_asm(spark, sf).walks, 0.01))


@stage
def scaffold_graph(spark, sf):
    asm = contig_asm(spark, sf)
    ge, ga = expanded_contig(spark, sf)
    return scaffold.build_scaffold(asm.walks, ga, ge, asm.read_node, 0.01, 1, True)


@stage
def freq_tiles(spark, sf):
    seqs = reads(spark, sf).select(F.col("read_id").alias("name"), "seq")
    return cut(kmers.frequency_tiles(seqs, "name", K, solid(spark, sf), counts(spark, sf)))


@stage
def filtered_graph(spark, sf):
    g = scaffold_graph(spark, sf)
    return scaffold.drop_ghosts(g, cut(scaffold.repetitive_ghosts(g, freq_tiles(spark, sf), K, 0.8)))


@stage
def single_edges(spark, sf):
    g = filtered_graph(spark, sf)
    return cut(scaffold.resolve_parallel(g.edges, contig_asm(spark, sf).walks, g.n_walks))


@stage
def scaffolds(spark, sf):
    ge, ga = expanded_contig(spark, sf)
    asm = contig_asm(spark, sf)
    settings = Settings(add_inner_edges=True, telo_motifs=MOTIFS, telomere=SCAN, kmers=KmerSettings(K, 1, 0.8))
    return postprocess(asm, asm.walks, ge, ga, reads(spark, sf), solid(spark, sf), settings, counts(spark, sf))


# ------------------------------------------------------------------ reads and k-mers


@query("reads_scan", "SELECT read_id, seq FROM reads")
def _(spark, sf):
    return fasta.parse_fasta_records(views.fastq_lines(spark, sf))


@query(
    "reads_precedence",
    f"""SELECT read_id, seq, 'hifi' AS source FROM reads UNION ALL
    SELECT 'r' || item_id * 40, {oracle._bases('text')}, 'ul' FROM benchmark WHERE 'r' || item_id * 40 NOT IN (SELECT read_id FROM reads)""",
)
def _(spark, sf):
    first = views.reads(spark, sf).select("read_id", "seq", F.lit("hifi").alias("source"))
    second = views.long_reads(spark, sf).select("read_id", "seq", F.lit("ul").alias("source"))
    return fasta.prefer(first, second)


@query("reads_blocked", "SELECT read_id, seq, read_len::BIGINT AS read_len FROM reads")
def _(spark, sf):
    return fasta.read_fasta(spark, blocked_reads(spark, sf), split=1 << 16)


@query("reads_quads", "SELECT read_id, seq FROM reads")
def _(spark, sf):
    return fasta.read_fastq(spark, quad_files(spark, sf)).select("read_id", "seq")


@query(
    "reads_fetched",
    f"""SELECT read_id, seq, length(read_id) + length(length(seq)::VARCHAR) + length(seq) + 8 AS n_bytes FROM reads WHERE doc_id % 50 = 0
    UNION ALL SELECT 'r' || item_id * 40, {oracle._bases('text')}, length('r' || item_id * 40) + length({oracle._bases('text')}) + 3 FROM benchmark
    WHERE 'r' || item_id * 40 NOT IN (SELECT read_id FROM reads)
    UNION ALL SELECT read_id, seq, length(read_id) + length(length(seq)::VARCHAR) + length(seq) + 8 FROM reads WHERE doc_id % 50 <> 0 AND read_id IN (SELECT 'r' || item_id * 40 FROM benchmark)""",
)
def _(spark, sf):
    accurate, long = (spark.read.parquet(i) for i in indexed_reads(spark, sf))
    wanted = views.table(spark, sf, "documents").filter("doc_id % 50 = 0").select(F.concat(F.lit("r"), F.col("doc_id")).alias("read_id"))
    return fasta.fetch_reads(wanted.unionByName(views.long_reads(spark, sf).select("read_id")), accurate, long)


@query("seq_revcomp", f"SELECT read_id, {oracle._rc('seq')} AS rc FROM reads")
def _(spark, sf):
    return views.reads(spark, sf).select("read_id", sq.reverse_complement("seq").alias("rc"))


@query("motif_count", "SELECT read_id, len(string_split(seq, 'ACG')) - 1 AS n FROM reads")
def _(spark, sf):
    return views.reads(spark, sf).select("read_id", sq.motif_count("seq", "ACG").alias("n"))


@query("kmer_count", f"SELECT {oracle._code('w', 9)} AS hash, freq FROM kmers9")
def _(spark, sf):
    return kmers.count_kmers(views.reads(spark, sf), 9)


@query("kmer_histogram", "SELECT freq, n FROM histo")
def _(spark, sf):
    return kmers.spectrum(counts(spark, sf))


@query("kmer_solid_bounds", "SELECT cutoff, round(average, 9) AS average, nearest, lower, upper FROM bounds")
def _(spark, sf):
    row = kmers.solid_bounds(kmers.spectrum(counts(spark, sf)))
    return row.withColumn("average", F.round("average", 9))


@query("kmer_solid", f"SELECT {oracle._code('w', K)} AS hash, freq FROM solid")
def _(spark, sf):
    return kmers.solid(counts(spark, sf), bounds(spark, sf))


@query(
    "seq_coverage",
    f"""SELECT r.read_id, coalesce(s, 0)::BIGINT AS cov_sum, coalesce(missed, 1) AS missed, coalesce(total, 1) AS total,
    CASE WHEN total > missed THEN round(s / (total - missed), 6) END AS avg_cov FROM reads r LEFT JOIN (
    SELECT read_id, sum(freq) AS s, count(*) - count(freq) AS missed, count(*) AS total FROM wfreq GROUP BY read_id) c USING (read_id)""",
)
def _(spark, sf):
    seqs = reads(spark, sf).select("read_id", "seq")
    cov = kmers.sequence_coverage(seqs, "read_id", K, solid(spark, sf))
    return cov.withColumn("avg_cov", F.round("avg_cov", 6))


# ------------------------------------------------------------------------- overlaps

_CLS = "src_read, src_orient, dst_read, dst_orient, ol_len"


@query(
    "paf_classify",
    f"SELECT id1, id2, strand, {_CLS}, src_len - ol_len AS prefix_len, dst_len - ol_len AS prefix_len_rev FROM cls",
)
def _(spark, sf):
    rows = classify(parse_paf(views.paf_lines(spark, sf)))
    return rows.select("id1", "id2", "strand", *_CLS.split(", "), "prefix_len", "prefix_len_rev")


@query(
    "paf_twin_edges",
    f"""SELECT {_CLS}, src_len - ol_len AS prefix_len FROM cls UNION ALL
    SELECT dst_read, {oracle._flip('dst_orient')}, src_read, {oracle._flip('src_orient')}, ol_len, dst_len - ol_len FROM cls""",
)
def _(spark, sf):
    return twin_rows(classify(paf_rows(spark, sf)))


@query(
    "paf_pair_dedup",
    f"SELECT id1, id2, {_CLS} FROM (SELECT *, row_number() OVER (PARTITION BY least(id1, id2), greatest(id1, id2) ORDER BY ln) AS rn FROM cls) WHERE rn = 1",
)
def _(spark, sf):
    return overlaps.first_per_pair(classify(paf_rows(spark, sf))).select("id1", "id2", *_CLS.split(", "))


_ACC = f"{_CLS}, src_node, dst_node, prefix_len, prefix_len_rev"


@query("paf_accepted_raw", f"SELECT {_ACC} FROM rawacc")
def _(spark, sf):
    return accepted_raw(spark, sf).select(*_ACC.split(", "))


@query("paf_accepted_contig", f"SELECT {_ACC} FROM conacc")
def _(spark, sf):
    return overlaps.accepted_overlaps(paf_rows(spark, sf), contig_asm(spark, sf)).select(*_ACC.split(", "))


_GE = "hop, src_read, src_orient, dst_read, dst_orient, ol_len, prefix_len"
_GA = "hop, orient, read_id, read_len, dir, nbr_read, nbr_orient, ol_len, prefix_len"


@query("hop_edges", f"SELECT {_GE} FROM rawge")
def _(spark, sf):
    return expanded_raw(spark, sf)[0].select(*_GE.split(", "))


@query("hop_ghosts", f"SELECT {_GA} FROM rawga")
def _(spark, sf):
    return expanded_raw(spark, sf)[1].select(*_GA.split(", "))


# ---------------------------------------------------------------------- graph tables


@query("gfa_nodes", "SELECT node_id, name, orient, read_len FROM rawnodes")
def _(spark, sf):
    return gfa.both_strands(raw_segments(spark, sf)).select("node_id", "name", "orient", "read_len")


@query("gfa_unitig_reads", "SELECT real_id, row_number() OVER (PARTITION BY utg ORDER BY doc_id) - 1 AS idx, read_id, orient FROM members JOIN segs USING (utg)")
def _(spark, sf):
    return gfa.unitig_members(raw_lines(spark, sf), raw_segments(spark, sf)).select("real_id", "idx", "read_id", "orient")


@query("gfa_unitig_ends", 'SELECT real_id, n, first AS "first", first_orient, last AS "last", last_orient FROM rawends')
def _(spark, sf):
    return raw_asm(spark, sf).unitig_ends


@query("gfa_edges", "SELECT src, dst, ol_len, prefix_len FROM rawedges")
def _(spark, sf):
    return gfa.link_edges(raw_lines(spark, sf), raw_segments(spark, sf)).drop("line_no")


@query(
    "edge_similarity",
    f"""SELECT src, dst, round(1 - levenshtein(right(a, ol_len::INT), left(b, ol_len::INT)) / ol_len::DOUBLE, 9) AS ol_sim FROM (
    SELECT src, dst, ol_len, CASE WHEN src % 2 = 0 THEN s.seq ELSE {oracle._rc('s.seq')} END AS a, CASE WHEN dst % 2 = 0 THEN d.seq ELSE {oracle._rc('d.seq')} END AS b
    FROM rawedges JOIN segs s ON s.real_id = src - src % 2 JOIN segs d ON d.real_id = dst - dst % 2)""",
)
def _(spark, sf):
    return raw_edges(spark, sf).select("src", "dst", F.round("ol_sim", 9).alias("ol_sim"))


@query("contig_rows", "SELECT contig, pos, start AS \"start\", orient, name, gap_len, next_start FROM crows")
def _(spark, sf):
    rows = gfa.contig_rows(views.contig_gfa_lines(spark, sf))
    return rows.select("contig", "pos", "start", "orient", "name", "gap_len", "next_start")


@query("contig_nodes", "SELECT node_id, name, orient, read_len FROM cnodes")
def _(spark, sf):
    return gfa.both_strands(contig_ids(spark, sf))


@query("contig_edges", "SELECT src, dst, ol_len::BIGINT AS ol_len, prefix_len, 1.0::DOUBLE AS ol_sim FROM cedges")
def _(spark, sf):
    return gfa.contig_edges(contig_placed(spark, sf)).select("src", "dst", "ol_len", "prefix_len", "ol_sim")


@query("adjacency", "SELECT src, 0::BIGINT AS part, string_agg(dst::VARCHAR, ',' ORDER BY dst) AS dsts FROM rawedges GROUP BY src")
def _(spark, sf):
    return graph.adjacency(raw_asm(spark, sf).edges).select(
        "src", F.col("part").cast("long").alias("part"), F.concat_ws(",", F.col("dsts").cast("array<string>")).alias("dsts")
    )


@query(
    "degrees",
    """SELECT node_id, (SELECT count(*) FROM rawedges WHERE dst = node_id) AS in_deg, (SELECT count(*) FROM rawedges WHERE src = node_id) AS out_deg FROM rawnodes""",
)
def _(spark, sf):
    asm = raw_asm(spark, sf)
    return graph.degrees(asm.nodes, asm.edges)


@query("edge_twins", "SELECT src, dst, xor(dst, 1) AS twin_src, xor(src, 1) AS twin_dst FROM rawedges")
def _(spark, sf):
    return raw_asm(spark, sf).edges.select(
        "src", "dst", sq.complement_id("dst").alias("twin_src"), sq.complement_id("src").alias("twin_dst")
    )


@query(
    "induced_subgraph",
    """SELECT src, dst FROM rawedges WHERE src NOT IN (SELECT src_node FROM rawacc WHERE src_node IS NOT NULL)
    AND dst NOT IN (SELECT src_node FROM rawacc WHERE src_node IS NOT NULL)""",
)
def _(spark, sf):
    asm = raw_asm(spark, sf)
    visited = accepted_raw(spark, sf).filter("src_node is not null").select(F.col("src_node").alias("node_id")).distinct()
    return graph.induced_subgraph(asm.nodes, asm.edges, visited)[1].select("src", "dst")


@query(
    "jumped_over",
    """SELECT DISTINCT unnest([t, xor(t, 1)]) AS node_id FROM (SELECT a.dst AS t FROM rawedges w JOIN rawedges a ON a.src = w.src
    JOIN rawedges b ON b.src = a.dst AND b.dst = w.dst)""",
)
def _(spark, sf):
    # every edge taken as a walk of one step
    edges = raw_asm(spark, sf).edges
    as_walks = edges.select(
        F.col("edge_id").alias("walk_id"),
        F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.col("src").alias("node_id")), F.struct(F.lit(1).alias("pos"), F.col("dst").alias("node_id")))).alias("s"),
    ).select("walk_id", "s.*")
    return graph.jumped_over(as_walks, edges)


# ---------------------------------------------------------------------------- walks


@query("baseline_walks", "SELECT contig_no AS walk_id, pos, node_id FROM cplaced")
def _(spark, sf):
    return contig_asm(spark, sf).walks


@query("walk_steps", "SELECT walk_id, pos, node_id, next_node, prefix_len, ol_len::BIGINT AS ol_len FROM csteps")
def _(spark, sf):
    asm = contig_asm(spark, sf)
    return walks.steps(asm.walks, asm.edges).select("walk_id", "pos", "node_id", "next_node", "prefix_len", "ol_len")


@query("walk_offsets", 'SELECT walk_id, pos, node_id, take, piece_len, "offset" FROM cpieces')
def _(spark, sf):
    asm = contig_asm(spark, sf)
    return walks.offsets(walks.pieces(asm.walks, asm.edges, asm.nodes))


_LENGTHS = """SELECT walk_id, count(*) AS n_nodes, sum(CASE WHEN next_node IS NULL THEN read_len ELSE prefix_len END)::BIGINT AS length
 FROM csteps s JOIN cnodes n ON n.node_id = s.node_id GROUP BY walk_id"""


@query("walk_lengths", _LENGTHS)
def _(spark, sf):
    asm = contig_asm(spark, sf)
    return walks.walk_lengths(asm.walks, asm.edges, asm.nodes)


@query(
    "assembly_stats",
    f"""WITH RECURSIVE l AS ({_LENGTHS.replace('FROM csteps', 'FROM csteps')}) SELECT count(*) AS n_contigs, sum(length)::BIGINT AS total, max(length) AS longest,
    (SELECT max(length) FROM (SELECT length, sum(length) OVER (ORDER BY length DESC) AS run FROM l) WHERE run * 2 >= (SELECT sum(length) FROM l)) AS n50 FROM l""".replace("WITH RECURSIVE l AS (", "SELECT n_contigs, total, longest, n50 FROM (WITH l AS (") + ")",
)
def _(spark, sf):
    asm = contig_asm(spark, sf)
    return walks.assembly_stats(walks.walk_lengths(asm.walks, asm.edges, asm.nodes))


def _lines_sql(text: str, key: str, width: int) -> str:
    return f"""SELECT {key} AS contig_id, l AS line, substr(seq, (l * {width} + 1)::INT, {width}) AS bases FROM (
    SELECT {key}, seq, unnest(range(0, (length(seq) + {width - 1}) // {width})) AS l FROM {text})"""


@query("walk_lines", _lines_sql("ctext", "walk_id", walks.LINE))
def _(spark, sf):
    asm = contig_asm(spark, sf)
    return walks.walk_lines(asm.walks, asm.edges, asm.nodes, asm.sequences)


_BASE = f"""SELECT contig_no, string_agg(CASE WHEN next_start IS NULL THEN body ELSE substr(body, 1, greatest(next_start - start, 0)::INT) END, '' ORDER BY pos) AS seq FROM (
 SELECT contig_no, pos, next_start, start, substr(CASE WHEN orient = '+' THEN seq ELSE {oracle._rc('seq')} END, (rstart + 1)::INT, greatest(rend - rstart, 0)::INT) AS body
 FROM cplaced JOIN cseqs USING (name)) GROUP BY contig_no"""


@query("baseline_lines", _lines_sql(f"({_BASE})", "contig_no", walks.LINE))
def _(spark, sf):
    return contigs.baseline_lines(contig_placed(spark, sf), contig_ids(spark, sf), contig_asm(spark, sf).sequences)


@query(
    "position_to_node",
    """SELECT p.walk_id, pt AS "at", pos, node_id FROM (SELECT walk_id, unnest(range(0, (sum(piece_len))::BIGINT, 97)) AS pt FROM cpieces GROUP BY walk_id) p
    JOIN cpieces c ON c.walk_id = p.walk_id AND pt >= "offset" AND pt < "offset" + piece_len""",
)
def _(spark, sf):
    placed = placed_pieces(spark, sf)
    size = placed.groupBy("walk_id").agg(F.sum("piece_len").alias("n")).filter("n > 0")
    points = size.select("walk_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(97).cast("long"))).alias("at"))
    return walks.nodes_at(points, placed).select("walk_id", "at", "pos", "node_id")


@query("walk_ends", "SELECT walk_id, pos, node_id, at_start, at_end FROM cends2")
def _(spark, sf):
    return walks.walk_ends(contig_asm(spark, sf).walks, 0.01)


@query(
    "multi_mapped",
    """SELECT count(*) FILTER (s > 1) AS multi_start, count(*) FILTER (e > 1) AS multi_end FROM (
    SELECT node_id, count(DISTINCT CASE WHEN at_start THEN walk_id END) AS s, count(DISTINCT CASE WHEN at_end THEN walk_id END) AS e FROM cends2 GROUP BY node_id)""",
)
def _(spark, sf):
    return walks.multi_mapped(ends(spark, sf))


# ------------------------------------------------------------------------- telomeres


@query("telomere_regions", 'SELECT walk_id, motif_no, side, "start", "end" FROM regions')
def _(spark, sf):
    r = regions(spark, sf)
    return r.select("walk_id", "motif_no", "side", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("telomere_types", "SELECT walk_id, motif_no, side, c1, c2, motif FROM typed")
def _(spark, sf):
    return telomere.type_regions(regions(spark, sf), hits(spark, sf), MOTIFS).select("walk_id", "motif_no", "side", "c1", "c2", "motif")


@query("telomere_nodes", "SELECT walk_id, start_node, end_node, motif FROM tnodes")
def _(spark, sf):
    return telomere.region_nodes(typed(spark, sf), placed_pieces(spark, sf))


@query("telomere_table_nodes", "SELECT walk_id, start_node, end_node, motif FROM tnodes")
def _(spark, sf):
    # the regions as an external finder lists them, one table per motif
    value = F.concat_ws("\t", F.col("walk_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    listed = [
        reports.parse_telomere_tsv(regions(spark, sf).filter(F.col("motif_no") == no).select(F.struct("walk_id", "start").alias("line_no"), value.alias("value")), no)
        for no in range(len(MOTIFS))
    ]
    found = telomere.type_regions(listed[0].unionByName(listed[1]), hits(spark, sf), MOTIFS)
    return telomere.region_nodes(found, placed_pieces(spark, sf))


@query(
    "telomere_events",
    """SELECT s.walk_id, s.pos AS lo, motif, min(e.pos) AS hi FROM tnodes t JOIN cpieces s ON s.walk_id = t.walk_id AND s.node_id = t.start_node
    JOIN cpieces e ON e.walk_id = t.walk_id AND e.node_id = t.end_node AND e.pos >= s.pos GROUP BY s.walk_id, s.pos, motif""",
)
def _(spark, sf):
    return telomere.telomere_events(contig_asm(spark, sf).walks, telo_nodes(spark, sf)).select("walk_id", "lo", "motif", "hi")


@query(
    "telomere_chop",
    """SELECT p.walk_id, c.pos - lo AS pos, node_id, ps AS "start", pe AS "end" FROM tpieces p JOIN cpieces c ON c.walk_id = p.old AND c.pos BETWEEN lo AND hi""",
)
def _(spark, sf):
    w, ref = chopped(spark, sf)
    return w.join(ref, "walk_id")


@query(
    "telomere_totals",
    "SELECT count(*) FILTER (ps = '+') + count(*) FILTER (pe = '+') AS plus, count(*) FILTER (ps = '-') + count(*) FILTER (pe = '-') AS minus FROM tpieces",
)
def _(spark, sf):
    return telomere.motif_totals(chopped(spark, sf)[1])


@query("chop_keeps_nodes", "SELECT count(*) AS n_left, count(*) AS n_right, true AS same FROM cplaced")
def _(spark, sf):
    return fingerprint.same_rows(contig_asm(spark, sf).walks, chopped(spark, sf)[0], ["node_id"])


@query("index_agreement", "SELECT count(*) AS n_left, count(*) AS n_right, true AS same FROM rawedges")
def _(spark, sf):
    edges = raw_asm(spark, sf).edges.select("src", "dst")
    ahead = graph.adjacency(edges).select("src", F.explode("dsts").alias("dst"))
    back = graph.adjacency(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return fingerprint.same_rows(ahead, back.select(F.explode("dsts").alias("src"), F.col("src").alias("dst")), ["src", "dst"])


@query(
    "node_class",
    """SELECT walk_id, CASE WHEN ps IS NOT NULL AND pe IS NOT NULL THEN 1 WHEN ps = '+' THEN 2 WHEN ps IS NOT NULL THEN 3
    WHEN pe = '+' THEN 4 WHEN pe IS NOT NULL THEN 5 ELSE 0 END AS class FROM tpieces""",
)
def _(spark, sf):
    return chopped(spark, sf)[1].select("walk_id", sq.telomere_class("start", "end").alias("class"))


# ------------------------------------------------------------------------ scaffolding

_SE = "new_src, new_dst, old_src, old_dst, prefix_len, ol_len"


@query("ghost_neighbours", "SELECT orient, read_id, dir, walk_id, node_id, prefix_len, ol_len FROM near")
def _(spark, sf):
    _, ga = expanded_contig(spark, sf)
    near = scaffold.ghost_neighbours(ga, contig_asm(spark, sf).read_node, ends(spark, sf))
    return near.select("orient", "read_id", "dir", "walk_id", "node_id", "prefix_len", "ol_len")


@query("ghost_nodes", "SELECT ghost AS node_id, orient, read_id FROM ghosts")
def _(spark, sf):
    return scaffold_graph(spark, sf).ghosts.select("node_id", "orient", "read_id")


@query("inner_edges", f"SELECT {_SE} FROM inner_e")
def _(spark, sf):
    ge, _ = expanded_contig(spark, sf)
    return scaffold.inner_edges(ge, contig_asm(spark, sf).read_node, ends(spark, sf), None)


@query("scaffold_edges", f"SELECT {_SE} FROM sedges")
def _(spark, sf):
    return scaffold_graph(spark, sf).edges


@query("reverse_edges", "SELECT new_dst AS new_src, new_src AS new_dst, old_dst AS old_src, old_src AS old_dst, prefix_len, ol_len FROM sedges")
def _(spark, sf):
    return graph.reverse_edges(scaffold_graph(spark, sf).edges)


def _prune_sql(start: str, n_walks: str, columns: str, rounds: int = 12) -> str:
    """Dead ends taken off round by round; the statement fails if a round more would take any."""
    body = f"p0 AS MATERIALIZED ({start})"
    for i in range(rounds):
        body += f""", p{i + 1} AS MATERIALIZED (SELECT * FROM p{i} WHERE (new_src < {n_walks} OR new_src IN (SELECT new_dst FROM p{i}))
         AND (new_dst < {n_walks} OR new_dst IN (SELECT new_src FROM p{i})))"""
    left = f"(SELECT count(*) FROM p{rounds - 1}) <> (SELECT count(*) FROM p{rounds})"
    return f"SELECT {columns} FROM (WITH {body} SELECT * FROM p{rounds} WHERE CASE WHEN {left} THEN error('more rounds needed') ELSE true END)"


@query("prune_dead_ends", _prune_sql("SELECT src AS new_src, dst AS new_dst FROM rawedges", "0", "new_src, new_dst"))
def _(spark, sf):
    # all nodes of the overlap graph taken as ghosts
    edges = raw_asm(spark, sf).edges.select(F.col("src").alias("new_src"), F.col("dst").alias("new_dst"))
    return graph.prune_dead_ends(edges, 0)


@stage
def wide_graph(spark, sf):
    """The scaffold graph over two hops, with edges between ghosts."""
    asm = contig_asm(spark, sf)
    ge, ga = expanded_far(spark, sf)
    return scaffold.build_scaffold(asm.walks, ga, ge, asm.read_node, 0.01, 2, True)


@stage
def first_ghosts(spark, sf):
    _, ga = expanded_far(spark, sf)
    n_walks = contig_asm(spark, sf).walks.select("walk_id").distinct().count()
    return cut(with_row_index(ga.filter("hop = 1").select("orient", "read_id").distinct(), ["orient", "read_id"], "node_id", start=n_walks))


@stage
def both_ghosts(spark, sf):
    """node_id, orient, read_id of the ghosts of both hops, before pruning."""
    first = first_ghosts(spark, sf)
    start = contig_asm(spark, sf).walks.select("walk_id").distinct().count() + first.count()
    second = scaffold.second_hop(expanded_far(spark, sf)[1], first).select("orient", "read_id").distinct()
    return cut(first.unionByName(with_row_index(second, ["orient", "read_id"], "node_id", start=start)))


@query("second_hop", "SELECT orient, read_id, dir, ghost, prefix_len, ol_len FROM n2 JOIN ok2 USING (orient, read_id)")
def _(spark, sf):
    rows = scaffold.second_hop(expanded_far(spark, sf)[1], first_ghosts(spark, sf))
    return rows.select("orient", "read_id", "dir", "ghost", "prefix_len", "ol_len")


@query("ghost_ghost_edges", f"SELECT {_SE} FROM outer_e")
def _(spark, sf):
    found = scaffold.inner_edges(expanded_far(spark, sf)[0], contig_asm(spark, sf).read_node, ends(spark, sf), both_ghosts(spark, sf))
    return found.filter("old_src is null and old_dst is null")


_N_WALKS = "(SELECT count(DISTINCT contig_no) FROM cplaced)"


@query("scaffold_edges_two_hops", _prune_sql("SELECT * FROM wide_e", _N_WALKS, _SE))
def _(spark, sf):
    return wide_graph(spark, sf).edges


# One row per walk: the first telomere region of the walk as side and motif, or ''.
_TELO = "SELECT DISTINCT contig_no AS node_id, coalesce((SELECT arg_min(substr(side, 1, 1) || motif, (motif_no, side)) FROM typed t WHERE t.walk_id = contig_no), '') AS telo FROM cplaced"


def walk_telomeres(spark, sf):
    first = typed(spark, sf).groupBy("walk_id").agg(F.min_by(F.concat(F.substring("side", 1, 1), F.col("motif")), F.struct("motif_no", "side")).alias("telo"))
    every = contig_asm(spark, sf).walks.select("walk_id").distinct()
    return every.join(first, "walk_id", "left").select(F.col("walk_id").alias("node_id"), F.coalesce("telo", F.lit("")).alias("telo"))


@stage
def steps_ahead(spark, sf):
    g, asm = filtered_graph(spark, sf), contig_asm(spark, sf)
    edges = single_edges(spark, sf)
    inner = cut(kmers.solid(counts(spark, sf), bounds(spark, sf), inclusive=False))
    texts = cut(lookahead.flanks(lookahead.ghost_ends(edges, g.n_walks), asm.walks, asm.edges, asm.nodes, asm.sequences))
    coverage = cut(lookahead.flank_coverage(texts, K, inner, 0.8))
    return cut(lookahead.ghost_steps(edges, g.n_walks, coverage, 0.3))


@query("ghost_steps", "SELECT src, ghost, dst, round(cov_diff, 6) AS cov_diff, invalid, ok FROM gsteps")
def _(spark, sf):
    return steps_ahead(spark, sf).withColumn("cov_diff", F.round("cov_diff", 6))


@query(
    "next_walks",
    f"""SELECT src, (t).ghost AS ghost, (t).dst AS dst, round((t).cov_diff, 6) AS cov_diff, (t).fit = 1 AS final FROM (
    SELECT src, arg_min({{'cov_diff': cov_diff, 'ghost': ghost, 'dst': dst, 'fit': fit}}, (cov_diff, ghost, dst)) FILTER ((invalid OR ok) AND fit >= 0) AS t FROM (
    SELECT g.*, CASE WHEN b.telo = '' THEN 0 WHEN a.telo = '' OR (substr(a.telo, 1, 1) <> substr(b.telo, 1, 1) AND substr(a.telo, 2, 1) <> substr(b.telo, 2, 1)) THEN 1 ELSE -1 END AS fit
    FROM gsteps g JOIN ({_TELO}) a ON a.node_id = src JOIN ({_TELO}) b ON b.node_id = dst) GROUP BY src) WHERE t IS NOT NULL""",
)
def _(spark, sf):
    best = lookahead.next_walks(steps_ahead(spark, sf), walk_telomeres(spark, sf), 0.3)
    return best.withColumn("cov_diff", F.round("cov_diff", 6))


# Steps of all overlaps of the raw graph, taken as walk, ghost, walk: the source's unitig, the overlap, the target's.
_TRIPLES = "SELECT src // 2 AS src, 1000000 + (src + dst) % 997 AS ghost, dst // 2 AS dst, max(ol_len) AS score FROM rawedges WHERE src // 2 <> dst // 2 GROUP BY ALL"


@stage
def taken_steps(spark, sf):
    edges = raw_asm(spark, sf).edges
    half = lambda c: F.expr(f"{c} div 2")
    ghost = F.lit(1_000_000) + (F.col("src") + F.col("dst")) % 997
    triples = edges.select(half("src").alias("src"), ghost.cast("long").alias("ghost"), half("dst").alias("dst"), "ol_len").filter("src <> dst")
    return cut(matching.greedy_steps(triples.groupBy("src", "ghost", "dst").agg(F.max("ol_len").alias("score"))))


# The same, one step after the other: a row of state with what is used up already.
_GREEDY = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (ORDER BY score DESC, src, ghost, dst) AS k FROM ({_TRIPLES})),
 r(k, a, g, b, won) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], []::BIGINT[], false UNION ALL
 SELECT s.k, CASE WHEN free THEN list_append(a, src) ELSE a END, CASE WHEN free THEN list_append(g, ghost) ELSE g END, CASE WHEN free THEN list_append(b, dst) ELSE b END, free
 FROM r JOIN s ON s.k = r.k + 1, LATERAL (SELECT NOT (list_contains(a, src) OR list_contains(g, ghost) OR list_contains(b, dst)) AS free))
 SELECT src, ghost, dst, score FROM s JOIN r USING (k) WHERE won"""


@query("greedy_steps", f"SELECT src, ghost, dst, score FROM ({_GREEDY})")
def _(spark, sf):
    return taken_steps(spark, sf)


# Rings are opened before their smallest walk; then every walk follows from the start of its path.
_CHAINS = f"""WITH RECURSIVE t AS MATERIALIZED (SELECT src, ghost, dst FROM ({_GREEDY})),
 up(node, x, low) AS (SELECT dst, src, least(src, dst) FROM t UNION ALL SELECT node, src, least(low, src) FROM up JOIN t ON t.dst = x WHERE x <> node),
 ring AS (SELECT node FROM up WHERE x = node AND low = node), u AS (SELECT * FROM t WHERE dst NOT IN (SELECT node FROM ring)),
 w(start, node, pos) AS (SELECT src, src, 0::BIGINT FROM u WHERE src NOT IN (SELECT dst FROM u) UNION ALL SELECT start, dst, pos + 2 FROM w JOIN u ON src = node),
 ids AS (SELECT start, row_number() OVER (ORDER BY start) - 1 AS walk_id FROM w WHERE pos = 0)
 SELECT walk_id, pos, node AS node_id FROM w JOIN ids USING (start) UNION ALL SELECT walk_id, pos + 1, ghost FROM w JOIN ids USING (start) JOIN u ON src = node"""


@query("greedy_chains", f"SELECT walk_id, pos, node_id FROM ({_CHAINS})")
def _(spark, sf):
    return matching.chains(taken_steps(spark, sf))


@query("repetitive_ghosts", "SELECT ghost AS node_id FROM rep")
def _(spark, sf):
    return scaffold.repetitive_ghosts(scaffold_graph(spark, sf), freq_tiles(spark, sf), K, 0.8)


@query("parallel_edges", f"SELECT {_SE} FROM oneedge")
def _(spark, sf):
    g = filtered_graph(spark, sf)
    return scaffold.resolve_parallel(g.edges, contig_asm(spark, sf).walks, g.n_walks)


@query(
    "edge_coverage",
    f"""SELECT new_src, new_dst, round(diff_fwd::DOUBLE, 6) AS diff_fwd, lenok AND (inv_f OR diff_fwd <= 1 * max_f) AS ok_fwd,
    round(diff_rev::DOUBLE, 6) AS diff_rev, lenok AND (inv_r OR diff_rev <= 1 * max_r) AS ok_rev FROM (
    SELECT s.new_src, s.new_dst, ol_len + 100 + {K} <= sl AND ol_len + 100 + {K} <= dl AS lenok,
     abs(f1 - f2) AS diff_fwd, f1 = -99999 OR f2 = -99999 AS inv_f, greatest(f1, f2) AS max_f,
     abs(r1 - r2) AS diff_rev, r1 = -99999 OR r2 = -99999 AS inv_r, greatest(r1, r2) AS max_r FROM sided s JOIN (
     SELECT new_src, new_dst, max(c) FILTER (slot = 'f1') AS f1, max(c) FILTER (slot = 'f2') AS f2, max(c) FILTER (slot = 'r1') AS r1, max(c) FILTER (slot = 'r2') AS r2
     FROM covval GROUP BY new_src, new_dst) v ON v.new_src = s.new_src AND v.new_dst = s.new_dst)""",
)
def _(spark, sf):
    sided = cut(scaffold.edge_sides(single_edges(spark, sf), filtered_graph(spark, sf), contig_asm(spark, sf).nodes))
    cov = scaffold.edge_coverage(sided, freq_tiles(spark, sf), K, 1, 0.8)
    return cov.select("new_src", "new_dst", F.round("diff_fwd", 6).alias("diff_fwd"), "ok_fwd", F.round("diff_rev", 6).alias("diff_rev"), "ok_rev")


@query(
    "components",
    """SELECT a AS node_id, min(b) AS comp FROM (WITH RECURSIVE reach(a, b) AS (SELECT src, src FROM rawedges UNION SELECT dst, dst FROM rawedges
    UNION SELECT a, n FROM reach JOIN (SELECT src AS m, dst AS n FROM rawedges UNION SELECT dst, src FROM rawedges) ON m = b) SELECT a, b FROM reach) GROUP BY a""",
)
def _(spark, sf):
    return graph.components(raw_asm(spark, sf).edges)


@query("scaffold_walks")
def _(spark, sf):
    res = scaffolds(spark, sf)
    return res.new_walks


@query("scaffold_contigs")
def _(spark, sf):
    res = scaffolds(spark, sf)
    return contigs.contig_headers(contigs.contig_lengths(res.pieces)).select("name", "description", "length")


@query("scaffold_lines")
def _(spark, sf):
    res = scaffolds(spark, sf)
    return contigs.scaffold_lines(res.pieces, res.sequences)


# ---------------------------------------------------------------------- text reports


@query(
    "phasing_errors",
    """SELECT arg_max(l_discount, k) FILTER (l_returnflag = 'R') AS switch_err, arg_max(l_discount, k) FILTER (l_returnflag = 'N') AS hamming_err FROM (
    SELECT l_returnflag, l_discount, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_no"),
        F.concat_ws("\t", F.when(F.col("l_returnflag") == "R", "W").when(F.col("l_returnflag") == "N", "H").otherwise("C"),
                    F.lit("0"), F.lit("1"), F.col("l_discount").cast("string")).alias("value"),
    )
    return reports.phasing_errors(rows)


# ------------------------------------------------------------------- scored baseline


@query(
    "node_features",
    """SELECT node_id, round((i - 10.10::DOUBLE) / 2.74::DOUBLE, 9) AS in_z, round((o - 10.10::DOUBLE) / 2.74::DOUBLE, 9) AS out_z, 1.0::DOUBLE AS one FROM (
    SELECT node_id, (SELECT count(*) FROM rawedges WHERE dst = node_id) AS i, (SELECT count(*) FROM rawedges WHERE src = node_id) AS o FROM rawnodes)""",
)
def _(spark, sf):
    asm = raw_asm(spark, sf)
    return gnn.node_features(asm.nodes, asm.edges).withColumns(
        {"in_z": F.round("in_z", 9), "out_z": F.round("out_z", 9)}
    )


@query("edge_features", "SELECT src, dst, round((ol_len - 10341::DOUBLE) / 5521::DOUBLE, 9) AS ol_z FROM rawedges")
def _(spark, sf):
    return gnn.edge_features(raw_asm(spark, sf).edges).select("src", "dst", F.round("ol_z", 9).alias("ol_z"))


@query(
    "gated_sum",
    """SELECT dst AS node_id, round(sum(g1 * src) / (sum(g1) + 1e-6::DOUBLE), 6) AS x, round(sum(g2 * ol_len) / (sum(g2) + 1e-6::DOUBLE), 6) AS y
    FROM (SELECT src, dst, ol_len, 1 / (1 + exp(-(ol_len / 10.0::DOUBLE))) AS g1, 1 / (1 + exp(-(prefix_len / 1000.0::DOUBLE))) AS g2 FROM rawedges) GROUP BY dst""",
)
def _(spark, sf):
    logistic = lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
    messages = raw_asm(spark, sf).edges.select(
        F.col("dst").alias("node_id"),
        F.array(F.col("src").cast("double"), F.col("ol_len").cast("double")).alias("v"),
        F.array(logistic(F.col("ol_len") / 10.0), logistic(F.col("prefix_len") / 1000.0)).alias("g"),
    )
    out = gnn.gated_mean(messages, "node_id", "v", "g", 2)
    return out.select("node_id", F.round(F.col("v")[0], 6).alias("x"), F.round(F.col("v")[1], 6).alias("y"))


@stage
def scored_edges(spark, sf):
    asm = raw_asm(spark, sf)
    scores = gnn.edge_scores(asm.nodes, asm.edges, gnn.random_weights())
    return cut(asm.edges.join(scores.select("edge_id", "score"), "edge_id"))


_HALF = [f"(((((draw + 42 * 1000003 + {o}) % 2147483647) * {f} % 2147483647) * {f} % 2147483647) * {f} % 2147483647)" for f, o in ((48271, 1), (69621, 7))]


@query(
    "sampled_edges",
    f"""SELECT draw, src * 2097152 + dst AS edge_id, src, dst FROM (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS rank FROM rawedges WHERE ol_len % 7 <> 0) p
    JOIN (SELECT draw, ({_HALF[0]} * 2147483648 + {_HALF[1]}) % (SELECT count(*) FROM rawedges WHERE ol_len % 7 <> 0) AS place FROM (SELECT unnest(range(0, 2000)) AS draw)) ON place = rank""",
)
def _(spark, sf):
    # edges whose overlap is a multiple of 7 stand for those with a probability of zero
    edges = raw_asm(spark, sf).edges.select(
        (F.col("src") * 2_097_152 + F.col("dst")).alias("edge_id"), "src", "dst", F.when(F.col("ol_len") % 7 == 0, -100.0).otherwise(1.0).alias("score")
    )
    return sampling.sample_edges(edges, 2000, seed=42)


@query("gnn_scores")
def _(spark, sf):
    return scored_edges(spark, sf).select("src", "dst", F.round("score", 3).alias("score"))


@query("greedy_walks")
def _(spark, sf):
    return baseline.greedy_walks(scored_edges(spark, sf), raw_asm(spark, sf).nodes)
