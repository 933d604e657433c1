import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import contigs, decode, scaffold

EDGE = "new_src long, new_dst long, old_src long, old_dst long, prefix_len long, ol_len long"


def test_parallel_edges_golden(spark):
    walks = spark.createDataFrame([(0, i, 10 + i) for i in range(4)] + [(1, i, 20 + i) for i in range(2)], "walk_id long, pos long, node_id long")
    edges = spark.createDataFrame([(0, 5, 12, None, 1, 9), (0, 5, 13, None, 1, 3), (5, 1, None, 21, 1, 9), (5, 1, None, 20, 1, 3)], EDGE)
    got = {(r.new_src, r.new_dst): (r.old_src, r.old_dst) for r in scaffold.resolve_parallel(edges, walks, 2).collect()}
    assert got == {(0, 5): (13, None), (5, 1): (None, 20)}
    twice = spark.createDataFrame([(5, 6, None, None, 1, 9), (5, 6, None, None, 2, 9)], EDGE)
    with pytest.raises(Exception, match="two ghosts"):
        scaffold.resolve_parallel(twice, walks, 2).collect()


def adjacency(spark, rows):
    return spark.createDataFrame(rows, "hop int, orient string, read_id string, read_len long, dir string, nbr_read string, nbr_orient string, ol_len long, prefix_len long")


GHOST_EDGES = "hop int, src_read string, src_orient string, dst_read string, dst_orient string, ol_len long, prefix_len long"


def test_ghosts_join_walks_over_two_hops(spark):
    walks = spark.createDataFrame([(0, 0, 0), (1, 0, 2)], "walk_id long, pos long, node_id long")
    nodes = spark.createDataFrame([("a", 0), ("b", 2)], "read_id string, real_id long")
    rows = [
        (1, "+", "x", 9, "in", "a", "+", 5, 4), (1, "+", "x", 9, "out", "b", "+", 5, 4),  # bridges both walks
        (1, "+", "y", 9, "in", "a", "+", 5, 4), (1, "+", "z", 9, "out", "b", "+", 5, 4),  # dangling on hop one
        (2, "+", "w", 9, "in", "y", "+", 5, 4), (2, "+", "w", 9, "out", "z", "+", 5, 4),  # joins them on hop two
    ]
    none = spark.createDataFrame([], GHOST_EDGES)
    one = scaffold.build_scaffold(walks, adjacency(spark, rows), none, nodes, 0.01, 1)
    assert [r.read_id for r in one.ghosts.collect()] == ["x"] and one.useful
    assert {(r.new_src, r.new_dst, r.old_src, r.old_dst) for r in one.edges.collect()} == {(0, 2, 0, None), (2, 1, None, 2)}
    two = scaffold.build_scaffold(walks, adjacency(spark, rows), none, nodes, 0.01, 2)
    assert {r.read_id for r in two.ghosts.collect()} == {"w", "x", "y", "z"}
    assert two.edges.count() == 6
    lost = scaffold.build_scaffold(walks, adjacency(spark, rows[2:4]), none, nodes, 0.01, 2)
    assert not lost.useful and lost.edges.count() == 0
    inner = spark.createDataFrame([(1, "a", "+", "b", "+", 3, 2), (1, "a", "+", "a", "-", 3, 2)], GHOST_EDGES)
    linked = scaffold.build_scaffold(walks, adjacency(spark, rows[2:4]), inner, nodes, 0.01, 1, add_inner_edges=True)
    assert [tuple(r) for r in linked.edges.collect()] == [(0, 1, 0, 2, 2, 3)] and linked.useful


# ------------------------------------------------------------------------------ walks


def random_graph(seed, n_walks=14, n_ghosts=16, n_edges=46):
    rng = random.Random(seed)
    telo = [(rng.choice("+-") if rng.random() < 0.3 else None, rng.choice("+-") if rng.random() < 0.25 else None) for _ in range(n_walks)]
    pairs = set()
    while len(pairs) < n_edges:
        a, b = rng.randrange(n_walks + n_ghosts), rng.randrange(n_walks + n_ghosts)
        if a != b:
            pairs.add((a, b))
    return [(a, b, rng.random() < 0.8, rng.randint(0, 9) / 2, rng.random() < 0.8, rng.randint(0, 9) / 2) for a, b in sorted(pairs)], telo


def as_lists(df):
    out = {}
    for r in df.orderBy("walk_id", "pos").collect():
        out.setdefault(r.walk_id, []).append(r.node_id)
    return [out[i] for i in range(len(out))]


def decoded(spark, edges, telo, diff, **how):
    e = spark.createDataFrame(edges, "new_src long, new_dst long, ok_fwd boolean, diff_fwd double, ok_rev boolean, diff_rev double")
    ref = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(telo)], "walk_id long, start string, end string")
    return as_lists(decode.scaffold_walks(e, ref, diff, **how))


@pytest.mark.parametrize("seed, diff", [(1, 1), (3, 0.5), (5, 1)])
def test_properties_of_scaffold_walks(spark, seed, diff):
    edges, telo = random_graph(seed)
    walks = decoded(spark, edges, telo, diff)
    held = [n for w in walks for n in w]
    assert len(held) == len(set(held))  # every node once
    assert {n for n in held if n < len(telo)} == set(range(len(telo)))  # every walk somewhere
    assert all(w[0] < len(telo) and w[-1] < len(telo) for w in walks)  # no ghost at an end
    allowed = {(a, b): okf or okr for a, b, okf, _, okr, _ in edges}
    for w in walks:
        for step in zip(w, w[1:], strict=False):
            assert step in allowed and (allowed[step] or diff >= 1)
        marks = [t for n in w if n < len(telo) for t in telo[n] if t]
        if len(w) > 1 and marks:
            inner = [n for n in w[1:-1] if n < len(telo)]
            assert not any(t for n in inner for t in telo[n])  # telomeres at ends only
    for n, (s, e) in enumerate(telo):
        if s and e:
            assert [n] in walks
    # nobody is left alone beside an open neighbour that it could have taken
    single = {w[0] for w in walks if len(w) == 1 and telo[w[0]] == (None, None)}
    for a, b, okf, _, okr, _ in edges:
        assert not ({a, b} <= single and (okf or okr))


@pytest.mark.parametrize("seed", [4, 6])
def test_rounds_of_jobs_give_the_same_walks(spark, seed):
    edges, telo = random_graph(seed, 6, 5, 14)
    assert decoded(spark, edges, telo, 0.5, max_edges=0) == decoded(spark, edges, telo, 0.5)


NONE, END = (None, None), (None, "+")


@pytest.mark.parametrize(
    "edges, telo, diff, want",
    [
        # the least difference wins, then the smaller id; a rejected edge never does
        ([(0, 1, True, 2.0, True, 2.0), (0, 2, True, 1.0, True, 1.0), (0, 3, False, 0.0, False, 0.0)], [NONE] * 4, 0.5, [[0, 2], [1], [3]]),
        # an edge that is alone is taken unseen, if no edge is to be removed
        ([(0, 1, False, 9.0, False, 9.0)], [NONE] * 2, 1, [[0, 1]]),
        ([(0, 1, False, 9.0, False, 9.0)], [NONE] * 2, 0.5, [[0], [1]]),
        # a walk with a telomere goes before others and prefers to end at the opposite one
        ([(0, 1, True, 5.0, True, 5.0), (0, 2, True, 1.0, True, 1.0)], [("-", None), END, NONE], 0.5, [[0, 1], [2]]),
        # a telomere of the same side or motif is no end
        ([(0, 1, True, 5.0, True, 5.0), (0, 2, True, 7.0, True, 7.0)], [("+", None), END, NONE], 0.5, [[0, 2], [1]]),
        # ghosts join walks and never stand at an end
        ([(0, 4, True, 1.0, True, 1.0), (4, 1, True, 1.0, True, 1.0), (1, 5, True, 1.0, True, 1.0)], [NONE] * 2, 0.5, [[0, 4, 1]]),
        # from the middle a walk grows both ways, and the longest is taken first
        ([(0, 1, True, 1.0, True, 1.0), (1, 2, True, 1.0, True, 1.0), (3, 1, True, 2.0, True, 2.0)], [NONE] * 4, 0.5, [[0, 1, 2], [3]]),
    ],
)
def test_scaffold_walks_by_hand(spark, edges, telo, diff, want):
    assert sorted(decoded(spark, edges, telo, diff)) == sorted(want)


def test_contig_of_a_scaffold_walk(spark):
    walks = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 4), (1, 0, 6), (1, 1, 8)], "walk_id long, pos long, node_id long")
    seqs = {"a": "AAAA", "b": "CCCC", "c": "GGGG", "d": "TTTT", "e": "ACAC", "x": "GATTACA"}
    nodes = spark.createDataFrame([(2 * i, n, "+", 4) for i, n in enumerate("abcde")], "node_id long, name string, orient string, read_len long")
    graph_edges = spark.createDataFrame([(0, 0, 2, 2), (1, 2, 4, 3), (2, 6, 8, 0)], "edge_id long, src long, dst long, prefix_len long")
    edges = spark.createDataFrame([(0, 2, 2, None, 3, 1), (2, 1, None, 6, 5, 2)], EDGE)
    ghosts = spark.createDataFrame([(2, 1, "-", "x", 7)], "node_id long, hop int, orient string, read_id string, read_len long")
    g = scaffold.ScaffoldGraph(edges, ghosts, 2)
    new = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 1)], "walk_id long, pos long, node_id long")
    parts = contigs.scaffold_pieces(new, edges, g, walks, graph_edges, nodes)
    text = "".join(r.bases for r in contigs.scaffold_lines(parts, spark.createDataFrame(list(seqs.items()), "name string, seq string"), 6).orderBy("line").collect())
    # walk 0 up to node 2, the ghost's reverse strand, walk 1 whole; a prefix of 0 adds nothing
    assert text == "AA" + "CCC" + "TGTAA" + "" + "ACAC"
    head = contigs.contig_headers(contigs.contig_lengths(parts)).first()
    assert (head.name, head.description) == ("contig_0000000001", "length=000000000000014")


def test_edge_coverage_against_slices(spark):
    from strandweave.operators import kmers as km
    from tests.test_kmers import key

    rng = random.Random(9)
    k, seqs = 3, {n: "".join(rng.choice("AC") for _ in range(150 + 9 * i)) for i, n in enumerate("abxy")}
    frame = spark.createDataFrame(list(seqs.items()), "name string, seq string")
    counts = km.count_kmers(frame, k, "name")
    solid = counts.filter("freq > 60")
    table = {r.hash: r.freq for r in solid.collect()}
    tiles = km.frequency_tiles(frame, "name", k, solid, counts)
    rows = [(i, 50 + i, s, so, len(seqs[s]), d, do, len(seqs[d]), ol) for i, (s, so, d, do, ol) in enumerate(
        [("a", "+", "x", "-", 20), ("x", "-", "b", "+", 0), ("b", "-", "y", "+", 30), ("y", "+", "a", "-", 140)])]
    sided = spark.createDataFrame(rows, "new_src long, new_dst long, src_name string, src_orient string, src_len long, dst_name string, dst_orient string, dst_len long, ol_len long")
    got = {r.new_src: r for r in scaffold.edge_coverage(sided, tiles, k, 0.05, 0.6).collect()}
    pair = str.maketrans("ACGT", "TGCA")
    strand = lambda n, o: seqs[n] if o == "+" else seqs[n][::-1].translate(pair)

    def cov(s):
        f = [table.get(key(s[i : i + k])) for i in range(len(s) - k + 1)] or [None]
        hit = [x for x in f if x is not None]
        return -99999 if len(f) - len(hit) >= 0.6 * len(f) else sum(hit) / len(hit)

    for i, _, s, so, sl, d, do, dl, ol in rows:
        for tag, a, b in (("fwd", strand(s, so), strand(d, do)), ("rev", strand(d, do), strand(s, so))):
            one, two = cov(a[:-ol]), cov(b[ol:])
            ok = (-99999 in (one, two) or abs(one - two) <= 0.05 * max(one, two)) and ol + 100 + k <= min(sl, dl)
            assert got[i][f"diff_{tag}"] == pytest.approx(abs(one - two)) and got[i][f"ok_{tag}"] == ok
