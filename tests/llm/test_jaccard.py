import itertools
import random
import re

import numpy as np

from strandweave.llm import jaccard
from tests.llm.corpus import frame, near_copies


def sets_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(texts):
    sets = [sets_of(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {(i, len(sets[i]), root(i)) for i in range(len(texts))}


def test_components_match_brute_force(spark):
    texts = near_copies()
    got = jaccard.jaccard_components(frame(spark, texts)).collect()
    assert {tuple(r) for r in got} == brute(texts)


def test_small_sets_match_brute_force(spark):
    """Sets of 1..25 shingles, where few blocks exist, in chains of small edits."""
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        t = [str(rng.randrange(10**6)) for _ in range(rng.randrange(4, 30))]
        for _ in range(4):
            texts.append(" ".join(t))
            t = t + [str(rng.randrange(10**6))] if rng.random() < 0.7 else t[1:]
    got = jaccard.jaccard_components(frame(spark, texts)).collect()
    assert {tuple(r) for r in got} == brute(texts)


def test_nulls_repeats_and_empty_tables(spark):
    texts = ["a b c d e f", "a b c d e f", None, "", "z z z", "z z z"]
    rows = jaccard.jaccard_components(frame(spark, texts, ids=[7, 7, 1, 2, None, None])).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(7, 2, 7), (7, 2, 7), (1, 0, 1), (2, 0, 2), (None, 1, None), (None, 1, None)], key=str)
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


def test_linked_pairs_share_g_blocks():
    rng = np.random.default_rng(0)
    for _ in range(300):
        u = np.unique(rng.integers(0, 2**63, int(rng.integers(4, 700)), dtype=np.uint64))
        v = np.unique(np.concatenate([rng.permutation(u)[int(rng.integers(0, len(u) // 9 + 1)) :], rng.integers(0, 2**63, int(rng.integers(0, len(u) // 9 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(u, v))
        if 100 * both < 80 * (len(u) + len(v) - both):
            continue
        assert jaccard.hamming(jaccard.sketch(u), jaccard.sketch(v)) <= len(u) + len(v) - 2 * both
        if len(u) == len(v) == both:
            continue
        shared = np.intersect1d(jaccard.block_keys(u), jaccard.block_keys(v))
        common = set(jaccard.bands(len(u))) & set(jaccard.bands(len(v)))
        assert any((shared >> np.uint64(58) == k).sum() >= jaccard.spare(k) for k in common)
