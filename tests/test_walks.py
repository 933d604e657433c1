import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import graph, numbering, walks
from strandweave.sources import gfa

EDGES = "edge_id long, src long, dst long, prefix_len long, ol_len long"


def test_row_index_per_group(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i) for i in rng.sample(range(10_000), 500)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    got = {(r.g, r.v): r.i for r in numbering.with_row_index(df, ["v"], "i", ["g"]).collect()}
    for g in "ab":
        for i, v in enumerate(sorted(v for h, v in rows if h == g)):
            assert got[g, v] == i


def test_running_totals_across_blocks(spark):
    rows = [(g, i, (i * 7) % 11) for g in (1, 2) for i in range(20)]
    df = spark.createDataFrame(rows, "g long, pos long, v long")
    sums = numbering.running_sum_before(df, ["g"], "pos", {"s": "v"}, block=3)
    tops = numbering.running_max_before(df, ["g"], "pos", {"m": "v"}, block=3)
    s = {(r.g, r.pos): r.s for r in sums.collect()}
    m = {(r.g, r.pos): r.m for r in tops.collect()}
    for g, i, _ in rows:
        before = [v for h, j, v in rows if h == g and j < i]
        assert s[g, i] == sum(before) and m[g, i] == max(before, default=None)


def contig_world(spark):
    seqs = {"r0": "ACGTA", "r1": "GTACC", "r2": "CCTT"}
    nodes = [(2 * i + v, f"r{i}", "+-"[v], len(seqs[f"r{i}"])) for i in range(3) for v in (0, 1)]
    return (
        spark.createDataFrame([(7, 0, 0), (7, 1, 2), (7, 2, 4)], "walk_id long, pos long, node_id long"),
        spark.createDataFrame([(0, 0, 2, 3, 2), (1, 2, 4, 3, 2)], EDGES),
        spark.createDataFrame(nodes, "node_id long, name string, orient string, read_len long"),
        spark.createDataFrame(list(seqs.items()), "name string, seq string"),
    )


@pytest.mark.parametrize("width", [1, 4, 80])
def test_walk_sequence_golden(spark, width):
    w, e, n, s = contig_world(spark)
    text = "".join(r.bases for r in walks.walk_lines(w, e, n, s, width).orderBy("line").collect())
    assert text == "ACGGTACCTT"
    row = walks.walk_lengths(w, e, n).first()
    assert (row.n_nodes, row.length) == (3, 10)


def test_positions_fall_into_their_node(spark):
    w, e, n, _ = contig_world(spark)
    placed = walks.offsets(walks.pieces(w, e, n))
    points = spark.range(10).select(F.lit(7).cast("long").alias("walk_id"), F.col("id").alias("at"))
    got = {r.at: r.node_id for r in walks.nodes_at(points, placed, bucket=2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 2, 4: 2, 5: 2, 6: 4, 7: 4, 8: 4, 9: 4}


def test_negative_prefix_counts_from_the_end(spark):
    from strandweave.functions.sequence import head

    df = spark.createDataFrame([(p,) for p in (-9, -2, 0, 2, 9)], "p long")
    assert [r.h for r in df.select(head(F.lit("ACGTA"), "p").alias("h")).collect()] == ["ACGTA"[:p] for p in (-9, -2, 0, 2, 9)]


def test_walk_end_shares(spark):
    sizes = {0: 1, 1: 50, 2: 250, 3: 100}
    rows = [(w, i, w * 1000 + i) for w, n in sizes.items() for i in range(n)]
    got = walks.walk_ends(spark.createDataFrame(rows, "walk_id long, pos long, node_id long"), 0.01)
    count = {r.walk_id: (r.s, r.e) for r in got.groupBy("walk_id").agg(F.count_if("at_start").alias("s"), F.count_if("at_end").alias("e")).collect()}
    assert count == {0: (1, 1), 1: (1, 1), 2: (2, 2), 3: (1, 1)}


def test_raw_graph_golden(spark, lines):
    asm = gfa.raw_assembly(lines(
        "S utg1 ACGTA LN:i:5 rd:i:1", "A utg1 0 + r1 0 5", "S utg2 GTACC LN:i:5 rd:i:1", "A utg2 0 + r2 0 5",
        "L utg1 + utg2 + 3M L1:i:2 L2:i:2",
    ))
    assert {r.read_id: r.real_id for r in asm.read_node.collect()} == {"r1": 0, "r2": 2}
    assert [(r.src, r.dst, r.ol_len, r.prefix_len, r.ol_sim, r.edge_id) for r in asm.edges.collect()] == [(0, 2, 3, 2, 1.0, 0)]
    assert {(r.node_id, r.name, r.orient) for r in asm.nodes.collect()} == {(0, "utg1", "+"), (1, "utg1", "-"), (2, "utg2", "+"), (3, "utg2", "-")}


def test_raw_graph_old_ids_and_later_line_wins(spark, lines):
    asm = gfa.raw_assembly(lines(
        "S r1 ACGTA LN:i:5 rd:i:1", "S r2 GTACC LN:i:5 rd:i:1",
        "L r1:0-5 + r2:0-5 + 3M L1", "L r2:0-5 - r1:0-5 - 2M L1",
    ))
    assert {r.read_id: r.real_id for r in asm.read_node.collect()} == {"r1": 0, "r2": 2}
    # the second line is the twin of the first and overwrites the overlap of both
    assert {(r.src, r.dst, r.ol_len, r.prefix_len) for r in asm.edges.collect()} == {(0, 2, 2, 3), (3, 1, 2, 3)}


def test_malformed_graph_lines_fail(spark, lines):
    with pytest.raises(Exception, match="S line"):
        gfa.segment_rows(lines("S a ACGT LN:i:4")).collect()
    with pytest.raises(Exception, match="L line"):
        gfa.link_rows(lines("L a + b + 3M")).collect()


def test_contig_gaps_and_trimming(spark, lines):
    reads = spark.createDataFrame([("a", "ACGTACGT", 8), ("b", "GGGG", 4)], "read_id string, seq string, read_len long")
    asm = gfa.contig_assembly(lines(
        "A c1 0 + Ns 0 5", "A c1 5 + a 0 8", "A c1 11 + scaf 0 4", "A c1 15 - b 1 4", "A c1 19 + Ns 0 9", "S c1 * LN:i:9",
    ), reads)
    names = {r.node_id: r.name + r.orient for r in asm.nodes.collect()}
    assert [names[r.node_id] for r in asm.walks.orderBy("pos").collect()] == ["a+", "custom_n_4+", "b-"]
    assert [(names[r.src], names[r.dst], r.prefix_len) for r in asm.edges.orderBy("edge_id").collect()] == [("a+", "custom_n_4+", 6), ("custom_n_4+", "b-", 4)]


def test_components_and_pruning(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node_id: r.comp for r in graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    parent = {n: n for p in pairs for n in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in parent}
    edges = spark.createDataFrame([(0, 2), (2, 1), (0, 3), (3, 4)], "new_src long, new_dst long")
    assert {tuple(r) for r in graph.prune_dead_ends(edges, 2).collect()} == {(0, 2), (2, 1)}


def test_hub_successors_come_in_parts(spark):
    edges = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 5)], "src long, dst long")
    rows = graph.adjacency(edges, chunk=16).collect()
    assert sorted(d for r in rows if r.src == 1 for d in r.dsts) == list(range(100))
    assert len([r for r in rows if r.src == 1]) > 1 and len([r for r in rows if r.src == 2]) == 1
