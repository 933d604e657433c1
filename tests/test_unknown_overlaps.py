"""Reads without a letter: their overlaps are unknown, and no row or query is lost."""

import math

import pytest

from strandweave import views
from strandweave.functions.overlap import classify
from strandweave.operators import gnn, matching
from strandweave.plans.catalog import QUERIES, forget_stages
from strandweave.sources import gfa
from strandweave.sources.paf import parse_paf


@pytest.fixture
def tables(spark, tmp_path):
    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    save("documents", [(0, "abcd efgh", "en"), (3, "12 34", "en"), (6, "xyz abc", "en"), (9, None, "en")], "doc_id long, text string, lang string")
    save("labels", [(d, 1, 0) for d in (0, 3, 6, 9)], "doc_id long, quality int, toxic int")
    # (o_custkey * 2 div 3, o_orderkey div 15): 0 with 3, 0 with 6, 0 with 9
    save("orders", [(45, 0, "F", "1"), (90, 1, "F", "1"), (135, 0, "F", "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    # (l_partkey div 2, l_orderkey div 15): 0 with 3 and 0 with 6, both strands
    lines = [(k, 0, 1, n, 2.0, f) for k, n in ((45, 3), (90, 1), (135, 3)) for f in "RN"]
    save("lineitem", lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string")
    return str(tmp_path)


def test_links_of_empty_segments(spark, tables):
    lines = views.raw_gfa_lines(spark, tables).cache()
    segments = gfa.number_segments(lines).cache()
    assert [(r.seq, r.read_len) for r in segments.orderBy("real_id").collect()] == [("ACGTACGT", 8), ("", 0), ("TACACG", 6), (None, None)]
    asm = gfa.raw_assembly(lines)
    got = {(r.src, r.dst): (r.ol_len, r.prefix_len, r.ol_sim is None) for r in asm.edges.collect()}
    assert got == {
        (0, 2): (None, None, True), (3, 1): (None, None, True),
        (0, 4): (1, 7, False), (5, 1): (1, 5, False),
        (0, 6): (8, 0, True), (7, 1): (8, None, True),
    }
    scores = gnn.edge_scores(asm.nodes, asm.edges, gnn.random_weights(layers=1)).collect()
    assert len(scores) == 6 and not any(math.isnan(r.score) for r in scores)


def test_overlaps_of_empty_reads(spark, tables):
    rows = parse_paf(views.paf_lines(spark, tables)).cache()
    assert rows.count() == 6
    assert rows.filter("len2 = 0 and end1 is null and end2 is null").count() == 2
    assert rows.filter("len2 is null").count() == 2
    # both begin at 0 on opposite strands, so the ends that are not known do not matter
    kept = {(r.id2, r.strand): r.ol_len for r in classify(rows).collect()}
    assert kept[("r3", "-")] is None and ("r3", "+") not in kept


def test_steps_without_a_score_come_last(spark):
    steps = spark.createDataFrame([(1, 10, 2, None), (1, 11, 3, 5), (4, 10, 5, None)], "src long, ghost long, dst long, score long")
    got = {(r.src, r.ghost, r.dst, r.score) for r in matching.greedy_steps(steps).collect()}
    assert got == {(1, 11, 3, 5), (4, 10, 5, None)}


def test_contig_reads_without_a_text_keep_their_nodes(spark, tables):
    reads = views.reads(spark, tables).cache()
    asm = gfa.contig_assembly(views.contig_gfa_lines(spark, tables), reads)
    got = {(r.node_id, r.name, r.read_len) for r in asm.nodes.filter("orient = '+'").collect()}
    assert got == {(0, "r0", 8), (2, "r3", 0), (4, "r6", 6), (6, "r9", None)}
    assert {(r.src, r.dst, r.prefix_len) for r in asm.edges.collect()} == {(0, 2, 900), (2, 4, 900), (4, 6, 900)}
    with pytest.raises(Exception, match="read without sequence"):
        gfa.contig_assembly(views.contig_gfa_lines(spark, tables), reads.filter("doc_id <> 9"))


def test_ghosts_beside_a_contig_with_a_read_without_a_text(spark, tables):
    # r12 is in no contig; it overlaps r0, at the start of the contig, and r9, which has no text, at its end
    docs = spark.createDataFrame([(12, "abcd ab", "en")], "doc_id long, text string, lang string")
    docs.write.mode("append").parquet(f"{tables}/documents.parquet")
    rows = [(180, 0, 1, 1, 2.0, "N"), (180, 18, 1, 1, 2.0, "N")]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string"
    spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tables}/lineitem.parquet")
    forget_stages()
    for name in ("ghost_neighbours", "ghost_nodes", "scaffold_edges", "ghost_ghost_edges"):
        QUERIES[name](spark, tables).collect()
    assert not QUERIES["ghost_neighbours"](spark, tables).filter("read_id = 'r12' and dir = 'out' and node_id = 0").isEmpty()
