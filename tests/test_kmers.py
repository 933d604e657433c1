import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from strandweave.operators import kmers as km

PAIR = str.maketrans("ACGT", "TGCA")


def key(word):
    def h(w):
        v = 0
        for c in w:
            v = (v * 4 + "ACGT".index(c)) % (2**61 - 1)
        return v

    return min(h(word), h(word[::-1].translate(PAIR)))


def frame(spark, seqs):
    return spark.createDataFrame(list(seqs.items()), "read_id string, seq string")


def test_counts_and_coverage_golden(spark):
    counts = km.count_kmers(frame(spark, {"a": "ACGTA"}), 3)
    assert {r.hash: r.freq for r in counts.collect()} == {6: 2, 44: 1}
    cov = km.sequence_coverage(frame(spark, {"x": "ACGTA", "y": "AAA", "z": "AC"}), "read_id", 3, counts)
    got = {r.read_id: (r.avg_cov and round(r.avg_cov, 4), r.missed, r.total) for r in cov.collect()}
    assert got == {"x": (1.6667, 0, 3), "y": (None, 1, 1), "z": (None, 1, 1)}


def test_solid_bounds_golden(spark):
    histo = spark.createDataFrame([(1, 100), (2, 20), (3, 5), (4, 10), (5, 30), (6, 12), (7, 4), (8, 6), (9, 2)], "freq long, n long")
    row = km.solid_bounds(histo).first()
    assert (row.cutoff, row.average, row.nearest, row.lower, row.upper) == (9.0, 5.5625, 6, 3, 7)


def test_spectrum_without_a_minimum_has_no_solid_kmers(spark):
    histo = spark.createDataFrame([(1, 100), (2, 20), (3, 5), (4, 2)], "freq long, n long")
    bounds = km.solid_bounds(histo)
    row = bounds.first()
    assert (row.cutoff, row.average, row.nearest, row.lower, row.upper) == (4.0, None, 1, None, 4)
    seqs = frame(spark, {"x": "ACGTA", "y": "AC"})
    counts = km.count_kmers(seqs, 3)
    solid = km.solid(counts, bounds)
    assert solid.count() == 0
    got = {r.read_id: (r.cov_sum, r.avg_cov, r.missed, r.total) for r in km.sequence_coverage(seqs, "read_id", 3, solid).collect()}
    assert got == {"x": (0, None, 3, 3), "y": (0, None, 1, 1)}
    asked = spark.createDataFrame([(1, "x", 0, 3)], "req long, read_id string, lo long, hi long")
    tiles = km.frequency_tiles(seqs, "read_id", 3, solid, counts)
    assert [(r.cov_sum, r.hits, r.total) for r in km.range_coverage(asked, tiles, "read_id").collect()] == [(0, 0, 3)]


def test_keys_match_model_for_short_and_long_k():
    rng = random.Random(1)
    text = "".join(rng.choice("ACGT") for _ in range(200))
    for k in (5, 21, 30, 31, 40):
        want = [key(text[i : i + k]) for i in range(len(text) - k + 1)]
        assert km.window_keys(text.encode(), k).tolist() == want
    assert km.window_keys(b"ACNGT", 2).tolist()[1:3] == [-1, -1]
    assert km.window_keys(b"A", 2).tolist() == []


def test_tiles_cover_every_window_once(spark):
    rng = random.Random(2)
    seqs = {f"r{i}": "".join(rng.choice("ACGT") for _ in range(n)) for i, n in enumerate((4, 5, 16, 17, 31, 100))}
    occ = km.occurrences(frame(spark, seqs), ["read_id"], 5, tile=8)
    got = sorted((r.read_id, r.tile * 8 + r.off, r.hash) for r in occ.collect())
    want = sorted((n, i, key(s[i : i + 5])) for n, s in seqs.items() for i in range(len(s) - 4))
    assert got == want


def test_range_coverage_against_brute_force(spark):
    rng = random.Random(3)
    seqs = {f"r{i}": "".join(rng.choice("AC") for _ in range(60)) for i in range(4)}
    k = 4
    counts = km.count_kmers(frame(spark, seqs), k)
    solid = counts.filter("freq between 2 and 12")
    table = {r.hash: r.freq for r in solid.collect()}
    tiles = km.frequency_tiles(frame(spark, seqs), "read_id", k, solid, counts, tile=8)
    asked = [(i, f"r{i % 4}", lo, hi) for i, (lo, hi) in enumerate([(0, 57), (3, 20), (8, 16), (56, 57), (5, 5), (9, 4), (0, 1), (16, 57)])]
    req = spark.createDataFrame(asked, "req long, read_id string, lo long, hi long")
    got = {r.req: (r.cov_sum, r.hits, r.total) for r in km.range_coverage(req, tiles, "read_id", tile=8).collect()}
    for i, name, lo, hi in asked:
        f = [table.get(key(seqs[name][p : p + k])) for p in range(lo, hi)]
        f = [x for x in f if x is not None]
        assert got[i] == (sum(f), len(f), max(1, hi - lo)), i


def test_hot_kmers_join_gives_the_same(spark):
    seqs = frame(spark, {"a": "A" * 300 + "CGCGT", "b": "ACGTT" * 20})
    counts = km.count_kmers(seqs, 5)
    occ = km.occurrences(seqs, ["read_id"], 5)
    table = counts.filter("freq < 50")
    plain = km.with_frequency(occ, table).groupBy("hash").agg(F.sum("freq").alias("s"), F.count("*").alias("n"))
    hot = km.with_frequency(occ, table, counts).groupBy("hash").agg(F.sum("freq").alias("s"), F.count("*").alias("n"))
    assert plain.exceptAll(hot).count() == 0 and hot.exceptAll(plain).count() == 0


def test_runs_hold_every_window_in_one_bucket(spark):
    rng = random.Random(4)
    for k in (13, 21, 30):
        texts = ["".join(rng.choice(("ACGT", "ACGTN")[i % 2]) for _ in range(rng.choice((k - 1, k, k + 1, 300)))) for i in range(30)]
        texts += ["A" * 200, "AT" * 80, texts[0], texts[0][::-1].translate(PAIR)]
        want = Counter(x for t in texts for x in km.window_keys(t.encode(), k).tolist() if x >= 0)
        got = km.count_kmers(frame(spark, {f"r{i}": t for i, t in enumerate(texts)}), k).collect()
        assert len(got) == len(want) and {r.hash: r.freq for r in got} == want


def test_distinct_kmers_move_in_few_bytes(spark):
    # a row per k-mer takes 16 bytes; neighbouring windows that travel together take about 2 each
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(200_000))
    cuts = km.tiles(frame(spark, {"r": text}), ["read_id"], 21)
    moved = km.window_runs(cuts, 21).agg(F.sum(F.length("runs") + F.length("times"))).first()[0]
    assert moved < 2.5 * len(text)


def test_merging_in_parts_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(km, "MERGED", 10)
    bucket, run, times = km.runs_of([b"ACGTTGCATTAGCCATGACCATTG" * 20, b"GATTACA" * 50], 21)
    rows = [pa.RecordBatch.from_arrays([pa.array([r.tobytes()]), pa.array([t.astype("uint32").tobytes()])], ["runs", "times"]) for r, t in ((run[i : i + 3], times[i : i + 3]) for i in range(0, len(run), 3))]
    found = pa.Table.from_batches(km._run_counter(21)(iter(rows))).to_pydict()
    want = Counter(x for t in (b"ACGTTGCATTAGCCATGACCATTG" * 20, b"GATTACA" * 50) for x in km.window_keys(t, 21).tolist())
    assert dict(zip(found["hash"], found["freq"], strict=True)) == want


def test_tile_frequencies_against_brute_force(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    seqs = {"n": "A" * 400 + "N" + base[:700], "copies": base[:900] * 3, "short": "ACGT"}
    for i in range(40):
        text = base[rng.randrange(2500) :][: rng.choice((12, 30, 31, 400, 1100))]
        seqs[f"r{i}"] = text[::-1].translate(PAIR) if i % 3 else text
    for k in (13, 21, 30):
        counts = km.count_kmers(frame(spark, seqs), k)
        table = {r.hash: r.freq for r in counts.filter("freq between 2 and 300").collect()}
        solid = spark.createDataFrame(list(table.items()), "hash long, freq long")
        for tile in (64, 1024):
            want = {}
            for name, text in seqs.items():
                f = [table.get(x) for x in km.window_keys(text.encode(), k).tolist()]
                want |= {(name, t // tile): (f[t : t + tile], sum(x or 0 for x in f[:t]), sum(x is not None for x in f[:t])) for t in range(0, len(f), tile)}
            rows = km.frequency_tiles(frame(spark, seqs), "read_id", k, solid, counts, tile).collect()
            assert len(rows) == len(want) and {(r.read_id, r.tile): (r.freqs, r.sum_before, r.hits_before) for r in rows} == want


def test_lookups_move_in_few_bytes(spark):
    # a row per window takes 20 bytes and more; here it is a fraction of a run there and a byte back
    rng = random.Random(7)
    text = "".join(rng.choice("ACGT") for _ in range(200_000))
    seqs = frame(spark, {"r": text})
    cuts = km.tiles(seqs, ["read_id"], 21).withColumn("spot", F.monotonically_increasing_id()).cache()
    asked, known = km.asked_runs(cuts, 21), km.known_keys(km.count_kmers(seqs, 21).withColumnRenamed("n", "freq"), 21)
    there = asked.agg(F.sum(F.length("runs") + 20)).first()[0]
    fields = "block long, lo long, hi long, bucket int, width int, freqs binary"
    back = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(km._bucket_answers(21), fields).agg(F.sum(F.length("freqs") + 32), F.sum(F.length("freqs"))).first()
    assert back[1] == len(text) - 20 and there < 2.5 * len(text) and back[0] < 2.5 * len(text)
