"""Ranked search, mixing and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandweave.llm import mixing, search, spelling
from tests.llm.corpus import WORDS, frame, lined, prose

ODD = [None, "", "  \n", "ÉÀ ñandú É1st café", "x" * 5000, "naïve Straße x y \u0085z", "tokens!", "same text here", "same text here"]
TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --------------------------------------------------------------------------- search


def ranked(docs, items, top=10):
    terms = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    n_docs, total = sum(bool(c) for c in terms), sum(sum(c.values()) for c in terms)
    df = Counter(w for c in terms for w in c)
    out = []
    for item, text in items:
        scores = []
        for (name, _), c in zip(docs, terms, strict=True):
            m = 10 + 90 * sum(c.values()) * n_docs // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                for w in set(TERM.findall((text or "").translate(LOWER)))
                if c[w]
            )
            if score > 0:
                scores.append((-score, name is None, name))
        out += [(item, k + 1, name, -s) for k, (s, _, name) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture
def corpus():
    rng = random.Random(3)
    passages = [prose(rng, 30) for _ in range(12)]
    common = ["and", "the", "of"]
    texts = []
    for k in range(260):
        words = prose(rng, rng.choice([1, 4, 30, 200])) + rng.choices(common, k=12)
        if k % 7 == 0:
            words += rng.choice(passages)
        rng.shuffle(words)
        texts.append(lined(words))
    texts += ["the the the", "the the the", "rare and", "rare the"] + ODD
    ids = [None if k % 50 == 9 else 1000 - k for k in range(len(texts))]
    return texts, ids, [(k, " ".join(p + common)) for k, p in enumerate(passages)] + [(50, "the"), (51, "zzz unseen"), (52, None), (53, ""), (54, "THE Rare é1ST"), (54, "rare"), (None, "ñandú and")]


def test_search_equals_brute_force(spark, corpus, monkeypatch):
    texts, ids, items = corpus
    docs = frame(spark, texts, ids).withColumn("score", F.lit(1)).withColumn("item_id", F.lit("x")).repartition(3)
    want = ranked(list(zip(ids, texts, strict=True)), items)
    for block_docs, batch_terms in ((4096, 200_000), (17, 40)):
        monkeypatch.setattr(search, "BLOCK_DOCS", block_docs)
        got = search.search(docs, items_of(spark, items).withColumn("rank", F.lit(0)), batch_terms=batch_terms)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_search_of_empty_tables(spark, corpus):
    texts, ids, items = corpus
    assert search.search(frame(spark, []), items_of(spark, items)).collect() == []
    assert search.search(frame(spark, texts, ids), items_of(spark, [])).collect() == []
    assert search.search(frame(spark, [None, ""]), items_of(spark, items)).collect() == []


def test_pair_bounds_are_bounds_and_tighter():
    """Random lists: no prefix scores above its bound, and pairs that never meet halve it."""
    rng = random.Random(5)
    tighter = 0
    for _ in range(200):
        n = rng.randrange(1, 7)
        lists = {t: {d: rng.randrange(1, 99) for d in rng.sample(range(12), rng.randrange(6))} for t in range(n)}
        best = {t: max(x.values()) for t, x in lists.items() if x}
        couple = {(t, t + 1): t for t in range(n - 1)}
        joint = {t: [lists[t][d] + lists[t + 1][d] for d in lists[t] if d in lists[t + 1]] for t in range(n - 1)}
        bounds = search.prefix_bounds(list(range(n)), best, couple, {t: max(j) for t, j in joint.items() if j})
        for j in range(n + 1):
            top = max((sum(lists[t].get(d, 0) for t in range(j)) for d in range(12)), default=0)
            assert top <= bounds[j] <= sum(best.get(t, 0) for t in range(j))
        tighter += bounds[n] < sum(best.values())
    assert tighter > 100


def test_index_is_written_and_read_in_groups_of_few_blocks(spark):
    # 3,000,000 postings in one task: the rows of a group are held together by whoever writes or reads it
    numbers = F.sequence(F.lit(0), F.lit(14_999))
    docs = spark.range(200, numPartitions=1).select(
        F.col("id").alias("doc_id"), F.array_join(F.transform(numbers, lambda x: F.concat(F.lit("w"), (x + F.col("id") * 60).cast("string"))), " ").alias("text")
    )
    index = search.build_index(docs)
    assert index.select(F.sum("n_terms"), F.sum(F.aggregate("dfs", F.lit(0), lambda a, x: a + x))).first() == (3_000_000, 3_000_000)
    groups = [f.metadata.row_group(i) for f in map(pq.ParquetFile, (x.removeprefix("file://") for x in index.inputFiles())) for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) == index.count() and max(g.total_byte_size for g in groups) < 12_000_000
    items = spark.createDataFrame([(1, "w0 w14"), (2, "w26939 absent")], "item_id long, text string")
    got = [(r.item_id, r.rank, r.doc_id) for r in search.search(docs, items).collect()]
    assert sorted(got) == [(1, 1, 0), (2, 1, 199)]


# --------------------------------------------------------------------------- mixing


def targets_of(sizes, weights=(5, 2, 1), most=3):
    """Weights in code point order, null last; the excess is reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] >= most * sizes[s]}
        if not above:
            return target
        capped |= above


def test_mix(spark):
    rng = random.Random(8)
    rows = []
    for source, n, lens in (("a", 900, [3, 7, 40, 41, 200]), ("b", 40, [5, 9, 100]), ("B", 300, [1, 2, 30]), ("ß", 200, [10, 900]), (None, 100, [8, 20]), ("z", 3, [0])):
        rows += [(k if k % 40 else None, " ".join(["w"] * rng.choice(lens)) or rng.choice([None, "", " \t\n"]), source) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("x")).withColumn("target", F.lit("y"))
    got = mixing.mix(docs.repartition(5))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    kept = got.collect()
    assert sorted(map(str, mixing.mix(docs.repartition(2)).collect())) == sorted(map(str, kept))  # reruns agree
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = targets_of(sizes)
    assert Counter(r["size"] for r in kept) == Counter(len((t or "").split()) for _, t, _ in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0) for r in kept)
    by_target = defaultdict(int)
    for r in kept:
        by_target[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert {k[0] for k in by_target} == set(sizes.values())
    for s, t in want.items():
        assert abs(by_target[sizes[s], round(t, 6)] - t) <= 10, (s, t)


def test_rates_are_the_entropy_balancing_solution(spark):
    """The multipliers solve the dual: rates min(3, exp(multiplier * size / mean)) meet the target."""
    classes = spark.createDataFrame([("=a", 4, 50), ("=a", 90, 7), ("=b", 10, 9), ("=b", 700, 2), ("=c", 0, 4)], "source string, size long, n long")
    targets = spark.createDataFrame([("=a", 830, 1700.0), ("=b", 1490, 120.5), ("=c", 0, 0.0)], "source string, source_size long, target double")
    solved = {r["source"]: r for r in mixing.tilts(classes, targets).collect()}
    for source, total in (("=a", 1700.0), ("=b", 120.5)):
        r = solved[source]
        got = sum(n * size * min(3.0, math.exp(r["multiplier"] * size / r["mean"])) for s, size, n in classes.collect() if s == source)
        assert abs(got - total) <= mixing.NEAR
    assert solved["=a"]["multiplier"] > 0 > solved["=b"]["multiplier"] and solved["=c"]["multiplier"] == 0


def test_mix_of_odd_tables(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    got = mixing.mix(frame(spark, [None, "", " "])).collect()
    assert [(r["size"], r["source_size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0.0, 0)] * 3
    one = mixing.mix(frame(spark, ["a b c"] * 7)).collect()
    assert sum(r["taken"] for r in one) == 21 == one[0]["target"]


# ------------------------------------------------------------------------- spelling


def near_forms(docs):
    counts = Counter()
    for name, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if name is None else name}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def one_change(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in n if one_change(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        if vs and n[best := min(vs, key=lambda v: (-n[v], v))] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out, key=str)


def test_spelling_equals_brute_force(spark):
    rng = random.Random(4)
    base = [rng.choice(WORDS) + rng.choice(["", "x", "ss", "é"]) + rng.choice(WORDS) for _ in range(14)] + ["aaaaaa", "bookkeeper"]
    texts = []
    for w in base:
        texts += [" ".join([w] * 130)]
        for n in (25, 8, 5, 4, 1):
            v, i = list(w), rng.randrange(len(w))
            rng.choice([lambda: v.insert(i, v[i]), lambda: v.pop(i), lambda: v.__setitem__(i, rng.choice("abcéÿ×"))])()
            texts.append(" ".join(["".join(v).title()] * n))
            v.insert(rng.randrange(len(v)), "q")
            texts.append(", ".join(["".join(v)] * 5))
    texts += ["aaaaaaa " * 40, "aaaaa " * 9, "AAAAAAAA " * 7, "É" * 6 + " " + "é" * 6, *ODD]
    long_runs = ["y" * 40 + "z" * 30, "y" * 40 + "z" * 29, "y" * 40 + "x" + "z" * 29]
    texts += [" ".join([w] * n) for w, n in zip(long_runs, (90, 9, 6), strict=True)] + [lined(prose(rng, 3000))]
    ids = [None if k % 30 == 7 else 3 * k for k in range(len(texts))]
    docs = frame(spark, texts, ids).withColumn("word", F.lit(1)).withColumn("n", F.lit(1)).repartition(3)
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = near_forms(list(zip(ids, texts, strict=True)))
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(1 for r in want if r[3]) > 20 and any(r[3] != r[5] for r in want if r[3])
    assert spelling.spelling_variants(frame(spark, [None, "", "short"])).collect() == []
    assert spelling.spelling_variants(frame(spark, [])).collect() == []


def test_spelling_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = near_forms([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, spelling.spelling_variants(docs).collect()), key=str) == want
