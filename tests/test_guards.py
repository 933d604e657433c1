"""Broken inputs fail or are read in full; nothing is lost silently."""

import pytest
from pyspark.sql import functions as F

from strandweave.operators import telomere
from strandweave.operators.walks import cut_pieces
from strandweave.sources.fasta import read_fasta, require_reads
from strandweave.sources.reports import parse_telomere_tsv


def test_empty_fastq_read(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\n\n+\n\n@r3\nGG\n+\nII\n\n")
    got = read_fasta(spark, str(tmp_path / "a.fastq")).orderBy("read_id").collect()
    assert [(r["read_id"], r["seq"], r["read_len"]) for r in got] == [("r1", "ACGT", 4), ("r2", "", 0), ("r3", "GG", 2)]


def test_piece_without_sequence_fails(spark):
    located = spark.createDataFrame([(1, 0, "a", "+", 0, 2), (1, 2, "b", "+", 0, 2)], "contig_id long, offset long, name string, orient string, skip int, piece_len long")
    known = spark.createDataFrame([("a", "ACGT")], "name string, seq string")
    with pytest.raises(Exception, match="no sequence"):
        cut_pieces(located, known).collect()
    both = known.unionByName(spark.createDataFrame([("b", "TTTT")], "name string, seq string"))
    assert sorted(r["text"] for r in cut_pieces(located, both).collect()) == ["AC", "TT"]


def test_missing_read_fails(spark):
    reads = spark.createDataFrame([("a", "AC")], "read_id string, seq string")
    with pytest.raises(Exception, match="not present"):
        require_reads(spark.createDataFrame([("a",), ("b",)], "read_id string"), reads).collect()


def test_regions_of_one_side_are_counted_apart(spark, lines):
    regions = parse_telomere_tsv(lines("1 50 60", "1 80 99"), 0)
    hits = spark.createDataFrame([(1, 51, "ACG"), (1, 82, "CGT"), (1, 88, "CGT")], "walk_id long, at long, word string")
    got = telomere.type_regions(regions, hits, ("ACG", "CGT")).orderBy("start").collect()
    assert [(r["start"], r["c1"], r["c2"], r["motif"]) for r in got] == [(50, 1, 0, "+"), (80, 0, 2, "-")]


def test_scaffold_order_guard(spark):
    from strandweave.sources.text import require

    rows = spark.createDataFrame([(3, 1)], "lo long, hi long")
    with pytest.raises(Exception, match="behind"):
        rows.select(require(F.col("hi") >= F.col("lo"), F.col("hi"), "enters behind")).collect()
