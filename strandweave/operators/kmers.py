"""k-mer spectrum, solid bounds and sequence coverage.

Sequences are cut into tiles of bounded length (overlapping by k-1), so one long
sequence spreads over many tasks.  A k-mer is keyed by its base-4 polynomial value
modulo 2^61-1, the smaller of both strands; windows with other letters have key -1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from strandweave.operators.numbering import running_sum_before
from strandweave.session import cut
from strandweave.sources.text import require

TILE = 1024
COMBINED = 1024  # tiles whose k-mers are counted together before the shuffle
# Runs of windows travel as one long: their bases at two bits each below a leading one.
RUN_BASES, RUN_K = 31, range(13, 31)
BUCKETS = 4096  # groups of minimizers; one holds about a 4,096th of all runs
MERGED = 1 << 18  # runs of a bucket that are merged at a time
ROWS = 1 << 16  # k-mers in a batch that leaves a task
SPOT_BITS = 10  # so many low bits of a tile's number are its place in a block
PARCEL_BITS = 2  # so many low bits of a bucket do not count where k-mers are looked up, as groups cost time
# Hash base and modulus of the k-mer key.
KMER_BASE, KMER_MOD = 4, 2**61 - 1
# A k-mer seen more often than this share of all occurrences is looked up by broadcast;
# at most 1 / HOT_SHARE k-mers can be.
HOT_SHARE = 1e-4


def tiles(seqs: DataFrame, ids: list[str], k: int, tile: int = TILE) -> DataFrame:
    """ids.., tile (number), text: pieces of ``tile`` bases plus the next k-1.

    The split is one linear pass over each sequence; needs tile >= k - 1.
    """
    if tile < k - 1:
        raise ValueError("tile must hold at least k-1 bases")
    parts = F.regexp_extract_all("seq", F.lit("(?s).{1,%d}" % tile), F.lit(0))
    cuts = seqs.select(*ids, parts.alias("_p"))
    overlapped = F.transform(
        "_p", lambda x, i: F.concat(x, F.coalesce(F.left(F.get("_p", i + 1), F.lit(k - 1)), F.lit("")))
    )
    rows = cuts.select(*ids, F.posexplode(overlapped).alias("tile", "text")).withColumn(
        "tile", F.col("tile").cast("long")
    )
    # one byte per base moves here, before windows multiply it: tiles of a long sequence
    # leave the task that read it; AQE chooses how many partitions there are
    return rows.hint("rebalance", *ids, "tile")


def window_keys(text: bytes, k: int) -> np.ndarray:
    """Canonical keys of every window of one tile."""
    n = len(text) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    digit = _DIGITS[np.frombuffer(text, dtype=np.uint8)]
    bad = digit > 3
    fwd = digit.astype(np.uint64)
    rev = (3 - digit.astype(np.int64)).clip(0).astype(np.uint64)
    fwd[bad] = 0
    a = np.zeros(n, dtype=np.uint64)
    b = np.zeros(n, dtype=np.uint64)
    wraps = 2 * k > 60
    for j in range(k):
        a = a * np.uint64(KMER_BASE) + fwd[j : j + n]
        b = b * np.uint64(KMER_BASE) + rev[k - 1 - j : k - 1 - j + n]
        if wraps:
            a %= np.uint64(KMER_MOD)
            b %= np.uint64(KMER_MOD)
    keys = np.minimum(a, b).astype(np.int64)
    if bad.any():
        seen = np.concatenate([[0], np.cumsum(bad)])
        keys[seen[k:] - seen[:-k] > 0] = -1
    return keys


_DIGITS = np.full(256, 4, dtype=np.uint8)
_DIGITS[[ord(c) for c in "ACGT"]] = [0, 1, 2, 3]


def kmer_keys(text: Column | str, k: int) -> Column:
    """array<long> of the canonical keys of a tile, computed on Arrow batches."""

    @F.pandas_udf("array<bigint>")
    def keys(batch: pd.Series) -> pd.Series:
        return batch.map(lambda s: window_keys(s.encode("ascii", "replace"), k))

    return keys(text)


def occurrences(seqs: DataFrame, ids: list[str], k: int, tile: int = TILE) -> DataFrame:
    """One row per k-mer window: ids.., tile, off (within the tile), hash."""
    cuts = tiles(seqs.filter(F.length("seq") >= k), ids, k, tile).withColumn("keys", kmer_keys("text", k))
    return cuts.select(*ids, "tile", F.posexplode("keys").alias("off", "hash"))


def key_counts(cuts: DataFrame, k: int, id_col: str | None = None) -> DataFrame:
    """hash, n: known keys with their number, combined over up to ``COMBINED`` tiles.

    With ``id_col`` the column comes first and each tile is counted for itself.
    """
    named = [cuts.schema[id_col]] if id_col else []
    schema = StructType([*named, StructField("hash", LongType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COMBINED):
                part = batch.slice(at, COMBINED)
                keys = [window_keys(t.as_py().encode("ascii", "replace"), k) for t in part.column(part.num_columns - 1)]
                counted = [np.unique(x[x >= 0], return_counts=True) for x in (keys if id_col else [np.concatenate(keys)])]
                columns = [pa.array(np.concatenate([c[i] for c in counted]).astype(np.int64)) for i in range(2)]
                if id_col:
                    row = np.repeat(np.arange(len(counted)), [len(c[0]) for c in counted])
                    columns.insert(0, part.column(0).take(pa.array(row)))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return cuts.select(*([id_col] if id_col else []), "text").mapInArrow(run, schema)


def count_kmers(seqs: DataFrame, k: int, id_col: str = "read_id") -> DataFrame:
    """kmers(hash, freq) over both strands; partial counts precede the shuffle.

    For k of 13 to 30 neighbouring windows move together as :func:`window_runs`, at 8 bytes for about
    (k - m) / 2 windows; smaller k have few keys, which are counted in the task.
    """
    cuts = tiles(seqs.filter(F.length("seq") >= k), [id_col], k)
    if k not in RUN_K:
        return key_counts(cuts, k).groupBy("hash").agg(F.sum("n").alias("freq"))
    return window_runs(cuts, k).groupBy("bucket").applyInArrow(_run_counter(k), "hash long, freq long")


def minimizer_length(k: int) -> int:
    """Bases of a minimizer, such that a run of k - m + 1 windows fits into a long."""
    return max(9, 2 * k - RUN_BASES)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits, so that no simple repeat is a frequent minimum."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def runs_of(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of known windows with one minimizer: bucket, run, times, by bucket.

    The minimizer is the m-mer of a window whose mixed canonical key is smallest; a window and its
    reverse complement have the same one, so all windows of a k-mer meet in one bucket.
    """
    return placed_runs(texts, k)[:3]


def placed_runs(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`runs_of`, and of each known window its place in the texts and among the runs' windows.

    Places in the texts count as if one letter stood between them.
    """
    m = minimizer_length(k)
    most = k - m + 1
    digit = _DIGITS[np.frombuffer(b"N".join(texts), np.uint8)]
    n = len(digit) - k + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(np.int32), none, none, none, none
    seen = np.concatenate([[0], np.cumsum(digit > 3)])
    known = seen[k:] == seen[:-k]
    value = np.where(digit > 3, 0, digit).astype(np.uint64)
    fwd, rev = np.zeros(len(digit) - m + 1, np.uint64), np.zeros(len(digit) - m + 1, np.uint64)
    for j in range(m):
        fwd = fwd << np.uint64(2) | value[j : j + len(fwd)]
        rev = rev << np.uint64(2) | np.uint64(3) - value[m - 1 - j : m - 1 - j + len(fwd)]
    least = _mixed(np.minimum(fwd, rev))
    width = 1
    while width < most:  # the minimum over ``most`` neighbours, by doubling
        step = min(width, most - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = np.flatnonzero(known)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    first = np.flatnonzero(new)
    place = (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % most
    first = np.flatnonzero(place == 0)
    windows = np.diff(np.append(first, len(at)))
    start = at[first]
    run = np.ones(len(start), np.uint64)
    for j in range(most + k - 1):
        inside = j < windows + k - 1
        run[inside] = run[inside] << np.uint64(2) | value[start[inside] + j]
    bucket = _bucket(least[start])
    order = np.lexsort((run, bucket))
    bucket, run = bucket[order], run[order]
    head = np.ones(len(run), bool)
    head[1:] = (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])
    distinct = np.empty(len(run), np.int64)
    distinct[order] = np.cumsum(head) - 1
    head = np.flatnonzero(head)
    behind = np.cumsum(windows[order][head]) - windows[order][head]
    among = np.repeat(behind[distinct], windows) + place if len(head) else place
    return bucket[head], run[head].astype(np.int64), np.diff(np.append(head, len(run))), at, among


def _bucket(least: np.ndarray) -> np.ndarray:
    return ((_mixed(least) >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32)


def key_buckets(keys: np.ndarray, k: int) -> np.ndarray:
    """The bucket in which the windows of each k-mer meet, from its key."""
    m = minimizer_length(k)
    keys, mask = keys.astype(np.uint64), np.uint64(4**m - 1)
    least = np.full(len(keys), ~np.uint64(0))
    for j in range(k - m + 1):
        some = keys >> np.uint64(2 * j) & mask
        least = np.minimum(least, _mixed(np.minimum(some, _reverse(some, m))))
    return _bucket(least)


def window_runs(cuts: DataFrame, k: int) -> DataFrame:
    """bucket, runs, times: per bucket and ``COMBINED`` tiles the distinct runs and their numbers, as bytes."""
    schema = StructType([StructField("bucket", IntegerType()), StructField("runs", BinaryType()), StructField("times", BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COMBINED):
                texts = [t.as_py().encode("ascii", "replace") for t in batch.column(0).slice(at, COMBINED)]
                bucket, run, times = runs_of(texts, k)
                heads = np.flatnonzero(np.diff(bucket, prepend=-1))
                packed = [[x[i:j].tobytes() for i, j in zip(heads, [*heads[1:], len(run)], strict=True)] for x in (run, times.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), *[pa.array(p, pa.binary()) for p in packed]], schema.names)

    return cuts.select("text").mapInArrow(pack, schema)


def run_keys(run: np.ndarray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical key and number of every window of the runs."""
    keys, counts = [], []
    run, mask = run.astype(np.uint64), np.uint64(4**k - 1)
    for n in range(1, k - minimizer_length(k) + 2):
        bases = np.uint64(2 * (n + k - 1))
        some = run >> bases == 1
        for j in range(n):
            fwd = run[some] >> np.uint64(2 * j) & mask
            keys.append(np.minimum(fwd, _reverse(fwd, k)))
            counts.append(times[some])
    return np.concatenate(keys).astype(np.int64), np.concatenate(counts).astype(np.int64)


def _reverse(key: np.ndarray, k: int) -> np.ndarray:
    """Keys of the reverse complements: pairs of bits turned over and inverted."""
    x = ~key
    for shift, half in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = (x >> np.uint64(shift) & np.uint64(half)) | (x & np.uint64(half)) << np.uint64(shift)
    return x.byteswap() >> np.uint64(64 - 2 * k)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.intp)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _run_counter(k: int):
    """Counts the k-mers of one bucket, merging at every ``MERGED`` runs, so that it holds distinct ones only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        runs, times, size = [], [], 0

        def merge():
            more = run_keys(np.frombuffer(b"".join(runs), np.int64), np.frombuffer(b"".join(times), np.uint32), k)
            return summed(np.concatenate([keys, more[0]]), np.concatenate([counts, more[1]]))

        for batch in batches:
            runs += batch.column("runs").to_pylist()
            times += batch.column("times").to_pylist()
            size += sum(len(x) for x in times[-batch.num_rows :]) // 4
            if size >= max(MERGED, len(keys)):
                keys, counts = merge()
                runs, times, size = [], [], 0
        keys, counts = merge()
        for at in range(0, len(keys), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + ROWS]) for x in (keys, counts)], ["hash", "freq"])

    return count


def spectrum(kmers: DataFrame) -> DataFrame:
    """kmer_histo(freq, n)."""
    return kmers.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))


def solid_bounds(histo: DataFrame, need_minimum: bool = False) -> DataFrame:
    """One row (cutoff, average, nearest, lower, upper) from a k-mer spectrum.

    The windows below run over distinct frequencies up to the 99.5th percentile, one row
    each, which is what bounds them.  A spectrum without an interior minimum has no lower bound
    and no average (null), and so no solid k-mers; with ``need_minimum`` it fails.
    """
    histo = cut(histo)
    cutoff = histo.agg(F.expr("percentile(freq, 0.995, n)").alias("cutoff"))
    kept = histo.join(F.broadcast(cutoff), F.col("freq") <= F.col("cutoff"))
    axis = kept.agg(F.max("freq").alias("top"), F.max("cutoff").alias("cutoff"))
    dense = axis.select(F.explode(F.sequence(F.lit(1).cast("long"), "top")).alias("freq")).join(
        kept.select("freq", "n"), "freq", "left"
    )
    in_order = Window.orderBy("freq")
    n = F.coalesce("n", F.lit(0))
    minima = (
        dense.select("freq", n.alias("n"))
        .withColumn("prev", F.lag("n").over(in_order))
        .withColumn("next", F.lead("n").over(in_order))
        .filter("n < prev and n < next")
        .agg(F.min("freq").alias("lower"), F.array_sort(F.collect_list("freq")).alias("minima"))
    )
    if need_minimum:
        minima = minima.withColumn("lower", require(F.col("lower").isNotNull(), F.col("lower"), "k-mer spectrum has no local minimum"))
    above = kept.join(F.broadcast(minima), F.col("freq") > F.col("lower")).agg(
        (F.sum(F.col("freq") * F.col("n")) / F.sum("n")).alias("average")
    )
    nearest = kept.join(F.broadcast(above)).agg(
        F.min_by("freq", F.struct(F.abs(F.col("freq") - F.col("average")), F.col("freq"))).alias("nearest")
    )
    row = axis.join(F.broadcast(minima)).join(F.broadcast(above)).join(F.broadcast(nearest))
    first_after = F.element_at(F.filter("minima", lambda m: m > F.col("nearest")), 1)
    upper = F.when(F.exists("minima", lambda m: m > F.col("nearest")), first_after).otherwise(F.col("top"))
    return row.select("cutoff", "average", "nearest", "lower", upper.alias("upper"))


def solid(kmers: DataFrame, bounds: DataFrame, inclusive: bool = True) -> DataFrame:
    """k-mers within the bounds (the exclusive form drops both limits themselves)."""
    inside = (
        F.col("freq").between(F.col("lower"), F.col("upper"))
        if inclusive
        else (F.col("freq") > F.col("lower")) & (F.col("freq") < F.col("upper"))
    )
    return kmers.join(F.broadcast(bounds.select("lower", "upper")), inside).select("hash", "freq")


def with_frequency(occ: DataFrame, solid_kmers: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Add ``freq`` (null for a miss) to k-mer occurrences.

    Without care every occurrence of one repeat k-mer meets in one task.  Given the full
    counts, the few k-mers above ``HOT_SHARE`` of all occurrences are resolved by a
    broadcast of at most ``1 / HOT_SHARE`` rows and stay out of the shuffle join.
    """
    table = solid_kmers.select("hash", "freq")
    if counts is None:
        return occ.join(table, "hash", "left")
    total = counts.agg(F.sum("freq").alias("_total"))
    hot = (
        counts.join(F.broadcast(total), F.col("freq") > F.col("_total") * HOT_SHARE)
        .select("hash")
        .join(table.withColumnRenamed("freq", "_hot_freq"), "hash", "left")
        .withColumn("_hot", F.lit(True))
    )
    marked = occ.join(F.broadcast(hot), "hash", "left")
    # hot occurrences get a null key: they match nothing, and null keys of the left side
    # are spread by their window offset instead of meeting in one task
    cold = F.when(F.col("_hot").isNull(), F.col("hash"))
    salt = F.when(F.col("_hot").isNotNull(), F.col("off")).otherwise(F.lit(-1))
    joined = marked.withColumn("_key", cold).withColumn("_salt", salt).join(
        table.select(F.col("hash").alias("_key"), F.lit(-1).alias("_salt"), "freq"), ["_key", "_salt"], "left"
    )
    return joined.withColumn("freq", F.coalesce("freq", "_hot_freq")).drop("_key", "_salt", "_hot", "_hot_freq")


def _portions(spots: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows with neighbouring spots of one block."""
    ends = np.flatnonzero((np.diff(spots) != 1) | (np.diff(spots >> SPOT_BITS) != 0)) + 1
    return list(zip([0, *ends.tolist()], [*ends.tolist(), len(spots)], strict=True)) if len(spots) else []


def asked_runs(cuts: DataFrame, k: int) -> DataFrame:
    """bucket, lo, hi, runs: the distinct runs of the tiles with spots lo <= spot < hi, as bytes."""
    names = ["bucket", "lo", "hi", "runs"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = batch.column(0).to_numpy()
            for i, j in _portions(spots):
                bucket, run, _ = runs_of([t.as_py().encode("ascii", "replace") for t in batch.column(1).slice(i, j - i)], k)
                bucket >>= PARCEL_BITS
                heads = np.flatnonzero(np.diff(bucket, prepend=-1))
                packed = [run[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(run)], strict=True)]
                range_ = [np.full(len(heads), x, np.int64) for x in (spots[i], spots[j - 1] + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), *map(pa.array, range_), pa.array(packed, pa.binary())], names)

    return cuts.select("spot", "text").mapInArrow(pack, "bucket int, lo long, hi long, runs binary")


def known_keys(solid_kmers: DataFrame, k: int) -> DataFrame:
    """bucket, keys, freqs: k-mers by the bucket of their windows, as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, freqs = (batch.column(c).to_numpy() for c in ("hash", "freq"))
            keys, freqs = keys[keys >= 0], freqs[keys >= 0]
            bucket = key_buckets(keys, k) >> PARCEL_BITS
            order = np.argsort(bucket, kind="stable")
            bucket, keys, freqs = bucket[order], keys[order], freqs[order]
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(heads, [*heads[1:], len(keys)], strict=True)], pa.binary()) for x in (keys, freqs)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), *packed], ["bucket", "keys", "freqs"])

    return solid_kmers.select("hash", "freq").mapInArrow(pack, "bucket int, keys binary, freqs binary")


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _bucket_answers(k: int):
    """Frequencies of all windows of a bucket's runs, 0 for a miss; rows without a hit are left out."""
    names = ["block", "lo", "hi", "bucket", "width", "freqs"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)))

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows or not known.num_rows:
            return schema.empty_table()
        keys, freqs = _joined(known.column("keys")), _joined(known.column("freqs"))
        order = np.argsort(keys)
        keys, freqs = keys[order], freqs[order]
        packed = asked.column("runs").to_pylist()
        run, mask = np.frombuffer(b"".join(packed), np.uint64), np.uint64(4**k - 1)
        windows = np.zeros(len(run), np.int64)
        for n in range(1, k - minimizer_length(k) + 2):
            windows[run >> np.uint64(2 * (n + k - 1)) == 1] = n
        behind = np.concatenate([[0], np.cumsum(windows)])
        found = np.zeros(behind[-1], np.int64)
        for n in range(1, k - minimizer_length(k) + 2):
            some = np.flatnonzero(windows == n)
            for j in range(n):
                fwd = run[some] >> np.uint64(2 * (n - 1 - j)) & mask
                key = np.minimum(fwd, _reverse(fwd, k)).astype(np.int64)
                near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found[behind[some] + j] = np.where(keys[near] == key, freqs[near], 0)
        ends = behind[np.cumsum([len(x) // 8 for x in packed])]
        starts = np.concatenate([[0], ends[:-1]])
        hit = np.flatnonzero(np.add.reduceat(found != 0, starts))
        found = found.astype(np.min_scalar_type(int(found.max())))
        table = asked.take(pa.array(hit))
        lo = table.column("lo").to_numpy()
        columns = [lo >> SPOT_BITS, lo, table.column("hi"), table.column("bucket"), np.full(len(hit), found.itemsize, np.int32), [found[a:b].tobytes() for a, b in zip(starts[hit], ends[hit], strict=True)]]
        return pa.table([pa.chunked_array([pa.array(c, f.type)]) if not isinstance(c, pa.ChunkedArray) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

    return answer


def _tile_answers(k: int, schema: pa.Schema):
    """The windows' frequencies of the tiles of a block (null for a miss), and their totals."""

    def answer(found: pa.Table, cuts: pa.Table) -> pa.Table:
        cuts = cuts.take(pa.array(np.argsort(cuts.column("spot").to_numpy())))
        spots = cuts.column("spot").to_numpy()
        texts = [t.encode("ascii", "replace") for t in cuts.column("text").to_pylist()]
        size = np.array([max(0, len(t) - k + 1) for t in texts], np.int64)
        ends = np.cumsum(size)
        freqs = np.zeros(size.sum(), np.int64)
        if found.num_rows:
            found = found.sort_by([("lo", "ascending"), ("hi", "ascending"), ("bucket", "ascending")])
            lo, hi, bucket, width = (found.column(c).to_numpy() for c in ("lo", "hi", "bucket", "width"))
            packed = found.column("freqs")
            parts = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
            for a, b in zip(parts, [*parts[1:], len(lo)], strict=True):
                i, j = np.searchsorted(spots, (lo[a], hi[a]))
                buckets, run, _, at, among = placed_runs(texts[i:j], k)
                windows = np.zeros(len(run), np.int64)
                for n in range(1, k - minimizer_length(k) + 2):
                    windows[run.astype(np.uint64) >> np.uint64(2 * (n + k - 1)) == 1] = n
                behind = np.concatenate([[0], np.cumsum(windows)])
                answers = np.zeros(behind[-1], np.int64)
                first = np.searchsorted(buckets >> PARCEL_BITS, bucket[a:b])
                for r, spot in zip(range(a, b), behind[first].tolist(), strict=True):
                    some = np.frombuffer(packed[r].as_buffer(), f"<u{width[r]}")
                    answers[spot : spot + len(some)] = some
                # places in the texts, which stand one letter apart, become places among the tiles' windows
                place = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
                text = np.searchsorted(place, at, "right") - 1
                freqs[(ends - size)[i:j][text] + at - place[text]] = answers[among]
        rows = np.flatnonzero(size)
        hits = np.concatenate([[0], np.cumsum(freqs != 0)])
        sums = np.concatenate([[0], np.cumsum(freqs)])
        of = lambda total: (total[ends] - total[ends - size])[rows]
        columns = {"tile": cuts.column("tile").take(pa.array(rows)), "_sum": pa.array(of(sums)), "_hits": pa.array(of(hits))}
        columns[schema.names[0]] = cuts.column(schema.names[0]).take(pa.array(rows))
        if "freqs" in schema.names:
            columns["freqs"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends[rows]]).astype(np.int32)), pa.array(freqs, mask=freqs == 0))
        return pa.table([columns[n] for n in schema.names], schema=schema)

    return answer


def tile_frequencies(seqs: DataFrame, id_col: str, k: int, solid_kmers: DataFrame, tile: int = TILE, each: bool = True) -> DataFrame:
    """id, tile, freqs array<long> (null for a miss; only with ``each``), _sum, _hits, for k of 13 to 30.

    Tiles are numbered, and 1,024 neighbours are a block.  Of a block only the distinct runs of
    windows travel, to the buckets of the k-mers, and the frequencies of those that hit
    come back, a byte or a few for each window; neither names a tile.  The tiles' own runs, made again, tell
    where they belong.  So a repeated text moves once per block, and no row stands for a window.
    """
    cuts = tiles(seqs.filter(F.length("seq") >= k), [id_col], k, tile)
    cuts = cut(cuts.withColumn("spot", F.monotonically_increasing_id()).withColumn("block", F.shiftright("spot", SPOT_BITS)))
    asked, known = asked_runs(cuts, k), known_keys(solid_kmers, k)
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(
        _bucket_answers(k), "block long, lo long, hi long, bucket int, width int, freqs binary"
    )
    fields = [cuts.schema[id_col], cuts.schema["tile"], *([StructField("freqs", ArrayType(LongType()))] if each else []), StructField("_sum", LongType()), StructField("_hits", LongType())]
    schema = StructType(fields)
    return answers.groupBy("block").cogroup(cuts.groupBy("block")).applyInArrow(_tile_answers(k, to_arrow_schema(schema)), schema)


def sequence_coverage(seqs: DataFrame, id_col: str, k: int, solid_kmers: DataFrame) -> DataFrame:
    """id, cov_sum, missed, total, avg_cov over all windows of each sequence.

    A sequence shorter than k counts as one missed window.  The number of windows follows from
    the length, so only hits are joined: an inner join, which a runtime filter of the solid
    k-mers can thin out before the shuffle.
    """
    seen = key_counts(tiles(seqs.filter(F.length("seq") >= k), [id_col], k), k, id_col)
    found = (
        seen.join(solid_kmers.select("hash", "freq"), "hash")
        .groupBy(id_col)
        .agg(F.sum(F.col("n") * F.col("freq")).alias("cov_sum"), F.sum("n").alias("_hits"))
    )
    total = F.greatest(F.length("seq").cast("long") - k + 1, F.lit(1).cast("long"))
    every = seqs.select(id_col, total.alias("total")).join(found, id_col, "left")
    hits = F.coalesce("_hits", F.lit(0))
    return every.select(
        id_col,
        F.coalesce("cov_sum", F.lit(0)).alias("cov_sum"),
        (F.col("total") - hits).alias("missed"),
        "total",
        F.when(hits > 0, F.col("cov_sum") / hits).alias("avg_cov"),
    )


def frequency_tiles(seqs: DataFrame, id_col: str, k: int, solid_kmers: DataFrame, counts: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Per tile the window frequencies in order and the totals of all earlier tiles.

    id, tile, freqs array<long> (null = miss), sum_before, hits_before.  The collected
    list is bounded by the tile length.
    """
    if k in RUN_K:
        per_tile = cut(tile_frequencies(seqs, id_col, k, solid_kmers, tile))
        # only the totals are sorted and scanned; the frequencies are moved once
        before = running_sum_before(per_tile.drop("freqs"), [id_col], "tile", {"sum_before": "_sum", "hits_before": "_hits"})
        return per_tile.select(id_col, "tile", "freqs").join(before.hint("shuffle_hash"), [id_col, "tile"])
    per_tile = (
        with_frequency(occurrences(seqs, [id_col], k, tile), solid_kmers, counts)
        .groupBy(id_col, "tile")
        .agg(
            F.array_sort(F.collect_list(F.struct("off", "freq"))).alias("w"),
            F.coalesce(F.sum("freq"), F.lit(0)).alias("_sum"),
            F.count("freq").alias("_hits"),
        )
        .withColumn("freqs", F.transform("w", lambda x: x["freq"]))
        .drop("w")
    )
    return running_sum_before(per_tile, [id_col], "tile", {"sum_before": "_sum", "hits_before": "_hits"})


def range_coverage(requests: DataFrame, ftiles: DataFrame, id_col: str, tile: int = TILE) -> DataFrame:
    """Coverage of windows lo <= start < hi; ``requests`` has req, id, lo, hi.

    Returns req, cov_sum, hits, total, where total is at least 1 (an empty or too short
    slice is one missed window).  Each bound costs one tile lookup, however long the
    slice is: the answer is the difference of two running totals.
    """
    bounds = requests.select(
        "req",
        id_col,
        F.explode(
            F.array(
                F.struct(F.lit(-1).alias("sign"), F.greatest(F.col("lo"), F.lit(0)).alias("x")),
                F.struct(F.lit(1).alias("sign"), F.greatest(F.col("lo"), F.col("hi"), F.lit(0)).alias("x")),
            )
        ).alias("b"),
    ).select("req", id_col, "b.sign", "b.x")
    # the bound just past a sequence's last window falls into the tile of that window
    at = F.when(F.col("x") > 0, F.col("x") - 1).otherwise(F.lit(0))
    keyed = bounds.withColumn("tile", F.floor(at / F.lit(tile)).cast("long"))
    keyed = keyed.withColumn("take", (F.col("x") - F.col("tile") * tile).cast("int"))
    near = keyed.join(ftiles, [id_col, "tile"], "left")
    part = F.slice("freqs", F.lit(1), F.col("take"))
    summed = near.select(
        "req",
        "sign",
        (F.col("sum_before") + F.aggregate(part, F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)))).alias("s"),
        (F.col("hits_before") + F.size(F.filter(part, lambda v: v.isNotNull()))).alias("h"),
    )
    sums = summed.groupBy("req").agg(
        F.coalesce(F.sum(F.col("sign") * F.col("s")), F.lit(0)).alias("cov_sum"),
        F.coalesce(F.sum(F.col("sign") * F.col("h")), F.lit(0)).alias("hits"),
    )
    sizes = requests.select("req", F.greatest(F.col("hi") - F.col("lo"), F.lit(1)).alias("total"))
    return sums.join(sizes, "req")
