"""Greedy steps against the plain loop, and chains with rings."""

import random

from strandweave.operators import matching


def loop(steps):
    used, out = [set(), set(), set()], []
    for s, g, d, score in sorted(steps, key=lambda x: (-x[3], x[:3])):
        if all(x not in u for x, u in zip((s, g, d), used, strict=True)):
            out.append((s, g, d, score))
            for x, u in zip((s, g, d), used, strict=True):
                u.add(x)
    return sorted(out)


def table(spark, steps):
    return spark.createDataFrame(steps, "src long, ghost long, dst long, score double")


def test_greedy_steps_equal_the_loop(spark):
    rng = random.Random(2)
    for n, scores in ((0, 1), (40, 1000), (150, 4)):
        steps = sorted({(rng.randrange(20), 100 + rng.randrange(30), rng.randrange(20)) for _ in range(n)})
        steps = [(*x, float(rng.randrange(scores))) for x in steps]
        assert sorted(map(tuple, matching.greedy_steps(table(spark, steps)).collect())) == loop(steps)


def test_a_chain_of_rising_scores_ends(spark):
    steps = [(i, 100 + i, i + 1, float(i)) for i in range(7)] + [(i, 100 + i, i + 2, i + 0.5) for i in range(7)]
    assert sorted(map(tuple, matching.greedy_steps(table(spark, steps)).collect())) == loop(steps)


def test_chains_and_rings(spark):
    path = [(i, 100 + i, i + 1) for i in range(5, 12)]
    ring = [(20, 120, 23), (23, 123, 21), (21, 121, 20)]
    pair = [(31, 131, 30), (30, 130, 31)]
    got = matching.chains(spark.createDataFrame(path + ring + pair + [(50, 150, 49)], "src long, ghost long, dst long"))
    walks = {}
    for r in sorted(got.collect(), key=lambda r: (r["walk_id"], r["pos"])):
        walks.setdefault(r["walk_id"], []).append(r["node_id"])
    want = [[x for i in range(5, 12) for x in (i, 100 + i)] + [12], [20, 120, 23, 123, 21], [30, 130, 31], [50, 150, 49]]
    assert [walks[k] for k in sorted(walks)] == want
    assert matching.chains(spark.createDataFrame([], "src long, ghost long, dst long")).collect() == []
