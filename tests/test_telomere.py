import random

import pytest

from strandweave.operators import telomere as t

MOTIFS = ("TTAGGG", "CCCTAA")


@pytest.mark.parametrize(
    "walk, regions, pieces",
    [
        ("123456", [(1, 2, "+"), (5, 6, "-")], [("123456", "+", "-")]),
        ("12345", [(3, 4, "+")], [("1234", None, "+"), ("5", None, None)]),
        ("1234", [(1, 1, "+"), (3, 3, "+")], [("12", "+", None), ("34", "+", None)]),
        ("123", [], [("123", None, None)]),
    ],
)
def test_chop_goldens(spark, walk, regions, pieces):
    walks = spark.createDataFrame([(0, i, int(n)) for i, n in enumerate(walk)], "walk_id long, pos long, node_id long")
    told = spark.createDataFrame([(0, *r) for r in regions], "walk_id long, start_node long, end_node long, motif string")
    new, ref = t.chop_walks(walks, t.telomere_events(walks, told))
    parts = {}
    for r in new.orderBy("walk_id", "pos").collect():
        parts[r.walk_id] = parts.get(r.walk_id, "") + str(r.node_id)
    got = [(parts[r.walk_id], r.start, r.end) for r in ref.orderBy("walk_id").collect()]
    assert got == pieces


def scan(seq, motif, min_score, penalty, drop):
    """Base-by-base model of the left-end scan: end of the region or None."""
    words = {motif[i:] + motif[:i] for i in range(len(motif))}
    score = best = 0
    at = None
    for i in range(len(seq) - len(motif) + 1):
        score += 1 if seq[i : i + len(motif)] in words else -penalty
        if score > best:
            best, at = score, i + len(motif)
        elif best - score > drop:
            break
    return at if best >= min_score and at is not None else None


def test_regions_against_model(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    contigs = [
        "CCCTAA" * 12 + noise(300), noise(300) + "TTAGGG" * 9 + "TT", "TTAGGG" * 8 + noise(30) + "TTAGGG" * 20 + noise(99),
        noise(400), "CCCTAA" * 5 + noise(7) + "CCCTAA" * 30, noise(3),
    ]
    lines = [(c, i // 16, s[i : i + 16]) for c, s in enumerate(contigs) for i in range(0, len(s), 16)]
    df = spark.createDataFrame(lines, "contig_id long, line long, bases string")
    hits = t.motif_hits(df, MOTIFS, width=16)
    got = {(r.walk_id, r.motif_no, r.side): (r.start, r.end) for r in t.telomere_regions(hits, t.contig_sizes(df), MOTIFS, 20, 1, 25).collect()}
    pair = str.maketrans("ACGT", "TGCA")
    want = {}
    for c, s in enumerate(contigs):
        for no, m in enumerate(MOTIFS):
            left = scan(s, m, 20, 1, 25)
            right = scan(s[::-1].translate(pair), m, 20, 1, 25)
            if left:
                want[c, no, "start"] = (0, left)
            if right:
                want[c, no, "end"] = (len(s) - right, len(s))
    assert got == want and len(want) >= 4
    regions = t.telomere_regions(hits, t.contig_sizes(df), MOTIFS, 20, 1, 25)
    for r in t.type_regions(regions, hits, MOTIFS).collect():
        piece = contigs[r.walk_id][r.start : r.end - 1]
        assert (r.c1, r.c2) == (piece.count(MOTIFS[0]), piece.count(MOTIFS[1]))


def test_self_overlapping_motif_is_refused(spark):
    with pytest.raises(ValueError):
        t.motif_hits(spark.createDataFrame([(0, 0, "ACGT")], "contig_id long, line long, bases string"), ("ACA", "TGT"))


def test_words_of_many_lines_at_once():
    row, off, which = t.find_words([b"ACACA", b"", b"CA", b"AC?N"], ["ACA", "CAC"])
    assert sorted(zip(row.tolist(), off.tolist(), which.tolist())) == [(0, 0, 0), (0, 1, 1), (0, 2, 0)]


def test_hits_are_searched_without_a_scan_per_position(spark, capsys):
    lines = spark.createDataFrame([(7, 0, "ACTTAGG"), (7, 1, "GACCCTA"), (7, 2, "A")], "contig_id long, line long, bases string")
    hits = t.motif_hits(lines, MOTIFS, 7)
    hits.explain()
    assert "lambdafunction" not in capsys.readouterr().out
    text, words = "ACTTAGGGACCCTAA", {w for x in MOTIFS for w in t.rotations(x)}
    want = [(7, i, text[i : i + 6]) for i in range(len(text) - 5) if text[i : i + 6] in words]
    assert sorted((r.walk_id, r.at, r.word) for r in hits.collect()) == want and len(want) > 1
