"""Baseline walks and contigs, and the final scaffolding run, from preprocessed tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandweave.operators import contigs
from strandweave.operators.baseline import greedy_walks
from strandweave.operators.gnn import Weights, edge_scores
from strandweave.operators.walks import walk_lines
from strandweave.plans.postprocess import Settings, postprocess
from strandweave.plans.preprocess import load_assembly, scored
from strandweave.session import cut, tune
from strandweave.sinks.files import load_table, renumbered, save_tables, write_fasta
from strandweave.sources.gfa import contig_rows, number_contig_nodes, place_contigs
from strandweave.sources.text import read_lines


def run_raw_baseline(spark: SparkSession, folder: str, out: str, weights: Weights, **decoding) -> None:
    """Score the raw graph, decode walks and write them with their contigs."""
    tune(spark)
    asm = load_assembly(spark, folder, with_walks=False)
    scores = cut(edge_scores(asm.nodes, asm.edges, weights))
    edges = cut(scored(asm.edges, scores).withColumn("prefix_len", F.greatest("prefix_len", F.lit(0).cast("long"))))
    walks = cut(greedy_walks(edges, asm.nodes, **decoding))
    save_tables(out, walks=walks, scores=scores)
    lines = cut(walk_lines(walks, edges, asm.nodes, asm.sequences))
    _write_assembly(lines, out)


def run_contig_baseline(spark: SparkSession, gfa_path: str, folder: str, out: str) -> None:
    """Walks and sequences of the assembler's own final contigs."""
    tune(spark)
    reads = load_table(spark, folder, "reads")
    rows = cut(contig_rows(read_lines(spark, gfa_path)))
    ids = cut(number_contig_nodes(rows, reads))
    placed = cut(place_contigs(rows, ids))
    save_tables(out, walks=placed.select(F.col("contig_no").alias("walk_id"), "pos", "node_id"))
    lines = cut(contigs.baseline_lines(placed, ids, load_table(spark, folder, "sequences")))
    _write_assembly(lines, out)


def _write_assembly(lines, out: str) -> None:
    headers = renumbered(lines.select("contig_id").distinct())
    write_fasta(lines, headers, f"{out}/assembly.fasta")


def run_postprocessing(spark: SparkSession, folder: str, walks_folder: str, out: str, settings: Settings) -> bool:
    """Scaffold the baseline walks; False if there was nothing useful to add."""
    tune(spark)
    asm = load_assembly(spark, folder, with_walks=False)
    tables = {n: load_table(spark, folder, n) for n in ("ghost_edges", "ghost_adj", "reads", "kmers", "kmer_counts")}
    found = postprocess(
        asm, load_table(spark, walks_folder, "walks"), tables["ghost_edges"], tables["ghost_adj"],
        tables["reads"], tables["kmers"], settings, tables["kmer_counts"],
    )
    if found is None:
        return False
    headers = cut(contigs.contig_headers(contigs.contig_lengths(found.pieces)))
    lines = cut(contigs.scaffold_lines(found.pieces, found.sequences))
    write_fasta(lines, renumbered(headers), f"{out}/assembly.fasta")
    save_tables(out, walks=found.new_walks, edges=found.edges, telo_ref=found.telo_ref, contigs=headers)
    return True
