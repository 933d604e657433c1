"""Scaffolding of baseline walks, from overlaps to new contigs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators import contigs, decode, scaffold, telomere
from strandweave.operators.fingerprint import require_same
from strandweave.operators.kmers import TILE, frequency_tiles
from strandweave.operators.walks import offsets, pieces, walk_lines
from strandweave.session import cut
from strandweave.sources.fasta import require_reads
from strandweave.sources.gfa import Assembly
from strandweave.sources.reports import parse_telomere_tsv
from strandweave.sources.text import read_lines


@dataclass
class KmerSettings:
    k: int = 21
    diff: float = 1
    rep_threshold: float = 0.8


@dataclass
class TelomereScan:
    min_score: int = 300
    penalty: int = 1
    max_drop: int = 2000


@dataclass
class Settings:
    add_inner_edges: bool = False
    use_telomere_info: bool = True
    decoding: str = "coverage"
    walk_valid_p: float = 0.01
    hop: int = 1
    telo_motifs: tuple[str, str] = ("TTAGGG", "CCCTAA")
    kmers: KmerSettings = field(default_factory=KmerSettings)
    telomere: TelomereScan = field(default_factory=TelomereScan)
    telomere_tables: tuple[str, str] | None = None  # regions of an external finder, per motif


@dataclass
class Scaffolds:
    walks: DataFrame  # the baseline walks after chopping
    telo_ref: DataFrame
    graph: scaffold.ScaffoldGraph
    edges: DataFrame  # with coverage columns
    new_walks: DataFrame
    pieces: DataFrame
    sequences: DataFrame


def chop_at_telomeres(asm: Assembly, walks: DataFrame, settings: Settings):
    """(walks, telo_ref) after cutting walks at telomeric regions."""
    if not settings.use_telomere_info:
        return walks, telomere.no_telomeres(walks)
    motifs, scan = tuple(settings.telo_motifs), settings.telomere
    lines = cut(walk_lines(walks, asm.edges, asm.nodes, asm.sequences, telomere.SCAN_WIDTH))
    hits = cut(telomere.motif_hits(lines, motifs))
    if settings.telomere_tables:
        listed = [parse_telomere_tsv(read_lines(walks.sparkSession, path), no) for no, path in enumerate(settings.telomere_tables)]
        regions = cut(listed[0].unionByName(listed[1]))
    else:
        regions = cut(
            telomere.telomere_regions(hits, telomere.contig_sizes(lines), motifs, scan.min_score, scan.penalty, scan.max_drop)
        )
    typed = cut(telomere.type_regions(regions, hits, motifs))
    placed = offsets(pieces(walks, asm.edges, asm.nodes))
    found = cut(telomere.region_nodes(typed, placed))
    new_walks, telo_ref = telomere.chop_walks(walks, telomere.telomere_events(walks, found))
    new_walks = cut(new_walks)
    require_same(walks, new_walks, ["node_id"], "nodes of the walks before and after chopping")
    return new_walks, cut(telo_ref)


def scaffold_sequences(asm: Assembly, graph: scaffold.ScaffoldGraph, reads: DataFrame) -> DataFrame:
    """name, seq of the graph's nodes and of the ghosts; a ghost without read fails the query."""
    ghosts = require_reads(graph.ghosts.select("read_id").distinct(), reads)
    return asm.sequences.select("name", "seq").unionByName(ghosts.select(F.col("read_id").alias("name"), "seq"))


def postprocess(
    asm: Assembly,
    walks: DataFrame,
    ghost_edges: DataFrame,
    ghost_adj: DataFrame,
    reads: DataFrame,
    solid_kmers: DataFrame,
    settings: Settings,
    counts: DataFrame | None = None,
) -> Scaffolds | None:
    """New walks and contig pieces, or None if nothing useful could be added."""
    if settings.decoding not in decode.DECODERS:
        raise ValueError(f"unknown decoding {settings.decoding!r}")
    km = settings.kmers
    walks, telo_ref = chop_at_telomeres(asm, walks, settings)
    graph = scaffold.build_scaffold(
        walks, ghost_adj, ghost_edges, asm.read_node, settings.walk_valid_p, settings.hop, settings.add_inner_edges
    )
    if not graph.useful:
        return None
    sequences = cut(scaffold_sequences(asm, graph, reads))
    inner = graph.edges.select(F.explode(F.array("old_src", "old_dst")).alias("node_id")).filter("node_id is not null")
    wanted = (
        asm.nodes.join(inner.distinct(), "node_id", "left_semi")
        .select("name")
        .union(graph.ghosts.select("read_id"))
        .distinct()
    )
    ftiles = cut(frequency_tiles(sequences.join(wanted, "name", "left_semi"), "name", km.k, solid_kmers, counts, TILE))
    graph = scaffold.drop_ghosts(graph, cut(scaffold.repetitive_ghosts(graph, ftiles, km.k, km.rep_threshold)))
    single = cut(scaffold.resolve_parallel(graph.edges, walks, graph.n_walks))
    sided = cut(scaffold.edge_sides(single, graph, asm.nodes))
    edges = cut(scaffold.edge_coverage(sided, ftiles, km.k, km.diff, km.rep_threshold))
    new_walks = cut(decode.DECODERS[settings.decoding](edges, telo_ref, km.diff))
    parts = cut(contigs.scaffold_pieces(new_walks, edges, graph, walks, asm.edges, asm.nodes))
    return Scaffolds(walks, telo_ref, graph, edges, new_walks, parts, sequences)
