"""From assembler files to tables: graph, kept overlaps by hop, solid k-mers."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandweave.operators.hops import boundary_reads, expand
from strandweave.operators.kmers import count_kmers, solid, solid_bounds, spectrum
from strandweave.operators.overlaps import accepted_overlaps
from strandweave.session import cut, delta_coded, tune
from strandweave.sinks.files import load_table, save_tables
from strandweave.sources.fasta import prefer, read_fasta
from strandweave.sources.gfa import Assembly, contig_assembly, raw_assembly
from strandweave.sources.paf import read_paf
from strandweave.sources.text import read_lines

# The graph file each kind of source must come with.
GFA_SUFFIX = {"raw": ".bp.raw.r_utg.gfa", "contigs": ".p_ctg.gfa"}
ASSEMBLY_TABLES = ("nodes", "sequences", "edges", "read_node", "unitig_reads", "unitig_ends", "walks")


def read_assembly(spark: SparkSession, source: str, gfa_path: str, reads) -> Assembly:
    if source not in GFA_SUFFIX:
        raise ValueError(f"unknown source {source!r}")
    if not gfa_path.endswith(GFA_SUFFIX[source]):
        raise ValueError(f"{source} graphs are named *{GFA_SUFFIX[source]}")
    lines = read_lines(spark, gfa_path)
    return raw_assembly(lines) if source == "raw" else contig_assembly(lines, reads)


def run_preprocessing(
    spark: SparkSession, source: str, gfa_path: str, paf_path: str, reads_path: str, out: str,
    long_reads_path: str | None = None, k: int = 21, max_hops: int | None = None,
) -> None:
    """Write every table the later stages read.  k-mers come from the accurate reads only."""
    tune(spark)
    accurate = cut(read_fasta(spark, reads_path))
    every = prefer(accurate, read_fasta(spark, long_reads_path) if long_reads_path else None)
    asm = read_assembly(spark, source, gfa_path, every)
    tables = {n: getattr(asm, n) for n in ASSEMBLY_TABLES if getattr(asm, n) is not None}
    kept = accepted_overlaps(read_paf(spark, paf_path), asm)
    ghost_edges, ghost_adj = expand(kept, boundary_reads(asm.unitig_ends), max_hops=max_hops)
    counts = cut(count_kmers(accurate, k), delta_coded("hash"))
    bounds = cut(solid_bounds(spectrum(counts), need_minimum=True))
    save_tables(
        out, reads=every, ghost_edges=ghost_edges, ghost_adj=ghost_adj, kmer_counts=counts,
        kmer_bounds=bounds, kmers=solid(counts, bounds), **tables,
    )


def load_assembly(spark: SparkSession, folder: str, with_walks: bool) -> Assembly:
    names = ASSEMBLY_TABLES if with_walks else ASSEMBLY_TABLES[:-1]
    return Assembly(**{n: load_table(spark, folder, n) for n in names})


def scored(edges, scores):
    """Edges with the score column of a scoring run."""
    return edges.join(scores.select("edge_id", F.col("score")), "edge_id")
