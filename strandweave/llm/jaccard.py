"""N-gram Jaccard join by parity sketches (operator 8).

A text's set holds its distinct 5-word shingles.  Sets A and B link when
``100 * |A & B| >= 80 * |A | B|``, which bounds their symmetric difference by
``(|A| + |B|) / 9``.

* Sketch.  Shingle hashes are XORed into the block (bucket) they fall in, so a block's word
  changes only where A and B differ: the number of differing blocks is a lower bound of the
  symmetric difference.  A narrow bit sketch (one parity bit per bucket) does the same with
  its Hamming distance.
* Size bands.  Band w covers sizes w..2.5w for w = 4, 8, 16, ..; any two sizes within the
  ratio 0.8 share a band, and sets of up to three shingles link with equal sets only.
* Pigeonhole.  A set of n shingles emits its first ``D + g`` non-empty blocks, D being the
  largest difference it can have with a partner.  At most D of them change, so a linked
  pair shares at least g blocks.  Hence every set may leave out its g - 1 most frequent
  blocks (in one global order): a linked pair still shares one.  This removes blocks made
  of passages that very many documents carry, and loses no link.
* Joining.  A block's members are paired with its smallest member only; the pairs pass
  the bit sketch and are verified on whole sets.  Members of one block that are not in one
  component yet are then compared by their sketches, in tiles of ``TILE`` members, so that only
  pairs within the bound come out: first the ``NEAREST`` of each member in a few blocks, which
  joins most families, then, with the components found by these, all pairs of all blocks.  The components are exactly
  those of all links.

Equal sets are one node from the start, so copies are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.tables import map_arrow, shelve
from strandweave.llm.wordhash import COMBINE, mix, shingle_sets
from strandweave.operators.graph import components

NUMERATOR, DENOMINATOR = 80, 100
BAND_SHIFT = 58  # the band sits in the top bits of a block key
TILE = 512  # members of a block compared at once
NEAREST = 2  # partners of each member, in the pass over its ``TRIED`` most shared blocks
TRIED = 3
SMALL = 16  # members of a block whose pairs are compared one by one


def bands(n: int) -> list[int]:
    """Numbers k of the bands w = 4 * 2**k that hold sets of ``n`` shingles."""
    return [k for k in range(max(0, n.bit_length() - 5), max(0, n.bit_length() - 2)) if 4 << k <= n <= (4 << k) * 5 // 2]


def spare(k: int) -> int:
    """g of band k: the number of blocks a linked pair shares at least."""
    return 2 + (4 << k) * 5 // 2 * 2 // 9 // 8


def blocks(k: int) -> int:
    return (4 << k) + 32


def farthest(n: int) -> int:
    """The largest symmetric difference a set of ``n`` has with any set it links to."""
    return (n + n * 5 // 4) // 9


def sketch(u: np.ndarray) -> bytes:
    """Parity bits of the set, a power of two of at least 2n and 64 bits."""
    bits = max(64, 1 << (2 * len(u) - 1).bit_length())
    parity = np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches; the longer one is folded by XOR to the shorter's length."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    if len(a) < len(b):
        a, b, x, y = b, a, y, x
    half = len(a) * 8
    while half > len(b) * 8:
        half //= 2
        x = (x >> half) ^ (x & ((1 << half) - 1))
    return (x ^ y).bit_count()


def sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) * DENOMINATOR >= np.maximum(a, b) * NUMERATOR


def set_id(u: np.ndarray) -> int:
    """Order-free 64-bit hash of a non-empty set, as a signed long."""
    folded = np.bitwise_xor.reduce(mix(u * COMBINE[20]), keepdims=True)
    return int(mix(folded + COMBINE[21:22] * np.uint64(len(u))).view(np.int64)[0])


def block_keys(u: np.ndarray) -> np.ndarray:
    """Keys of the blocks that a set emits, all its bands together."""
    n, out = len(u), []
    for k in bands(n):
        m, want = blocks(k), farthest(n) + spare(k)
        place = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        word = np.bitwise_xor.reduceat(u * COMBINE[22], start)[:want]
        keys = mix(word + (place[start[:want]] + np.uint64(1)) * COMBINE[23])
        if len(start) < want:  # too few blocks to promise g shared ones: such sets meet under g keys of their own
            keys = np.concatenate([keys, mix(np.arange(1, spare(k) + 1, dtype=np.uint64) * COMBINE[24])])
        out.append((keys >> np.uint64(64 - BAND_SHIFT)) | np.uint64(k << BAND_SHIFT))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _nodes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    n, node, bits = [], [], []
    for _, u in shingle_sets(batch.column("text")):
        n.append(len(u))
        node.append(set_id(u) if len(u) else None)
        bits.append(sketch(u) if len(u) else None)
    yield pa.RecordBatch.from_arrays(
        [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bits, pa.binary())],
        ["doc_id", "n", "node", "sketch"],
    )


def _keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    keys, node, size = [], [], 0
    names = ["key", "node"]
    for _, u in shingle_sets(batch.column("text")):
        got = block_keys(u)
        if not len(got):
            continue
        keys.append(got)
        node.append(np.full(len(got), set_id(u), np.int64))
        size += len(got)
        if size > 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(node))], names)
            keys, node, size = [], [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(node))], names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (key, node) rows of keys with two nodes at least; input sorted by both.

    One row is held back between batches, so a key of any size streams through.
    """
    k0, v0, joined = np.zeros(0, np.int64), np.zeros(0, np.int64), False
    for batch in batches:
        k = np.concatenate([k0, batch.column(0).to_numpy()])
        v = np.concatenate([v0, batch.column(1).to_numpy()])
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
        k, v = k[new], v[new]
        if not len(k):
            continue
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        same[0] = joined
        keep = (same[:-1] | same[1:])[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(k[:-1][keep]), pa.array(v[:-1][keep])], ["key", "node"])
        k0, v0, joined = k[-1:], v[-1:], bool(same[-2])
    if joined:
        yield pa.RecordBatch.from_arrays([pa.array(k0), pa.array(v0)], ["key", "node"])


def _near(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pairs whose sizes and bit sketches allow a link."""
    na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
    keep = sizes_fit(na, nb)
    sa, sb = batch.column("sa"), batch.column("sb")
    for i in np.flatnonzero(keep):
        keep[i] = hamming(sa[i].as_py(), sb[i].as_py()) * 9 <= na[i] + nb[i]
    yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _sets(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(node, whole set) of texts, in pieces of a few MB."""
    nodes, values, size = [], [], 0
    for _, u in shingle_sets(batch.column("text")):
        if not len(u):
            continue
        nodes.append(set_id(u))
        values.append(u.tobytes())
        size += len(values[-1])
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], ["node", "hashes"])
            nodes, values, size = [], [], 0
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(values, pa.binary())], ["node", "hashes"])


def _linked(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ha, hb, keep = batch.column("ha"), batch.column("hb"), np.zeros(batch.num_rows, bool)
    for i in range(batch.num_rows):
        a, b = (np.frombuffer(x[i].as_buffer(), np.uint64) for x in (ha, hb))
        both = len(np.intersect1d(a, b, assume_unique=True))
        keep[i] = DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)
    yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])


def _verify(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""
    side = nodes.select("node", "n", "sketch")
    with_a = pairs.join(side.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    with_b = with_a.join(side.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    near = shelve(map_arrow(with_b.select("a", "b", "na", "nb", "sa", "sb"), _near, "a long, b long"))
    asked = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rep = nodes.join(asked, "node").select("rep").distinct()
    needed = texts.join(rep, F.col("doc_id").eqNullSafe(F.col("rep"))).select("text")
    # an id may be null or repeated with another text, so the set names its node itself
    sets = shelve(map_arrow(needed, _sets, "node long, hashes binary"))
    joined = near.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b"
    )
    return shelve(map_arrow(joined.select("a", "b", "ha", "hb"), _linked, "a long, b long").distinct())


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text, ..).

    Empty, blank and null texts have no shingles and stay alone.  Rows with equal texts link.
    A null doc_id takes part but is never a component's id; alone it gets a null one.  Repeated
    rows each give a row.  Columns other than doc_id and text are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = shelve(map_arrow(texts, _nodes, "doc_id long, n long, node long, sketch binary"))
    nodes = shelve(
        rows.filter("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    keys = map_arrow(texts, _keys, "key long, node long")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key", "node")
    shared = shelve(sorted_keys.mapInArrow(_shared, "key long, node long"))
    held = shelve(_rarest(shared))
    links = _links(held, nodes, texts)
    label = components(links, "a", "b").select(F.col("node_id").alias("node"), "comp")
    first = nodes.join(label, "node").groupBy("comp").agg(F.min("rep").alias("first_id"))
    named = label.join(first, "comp").select("node", "first_id")
    lone = nodes.select("node", F.col("rep").alias("own_id"))
    return (
        rows.select("doc_id", "n", "node")
        .join(lone.join(named, "node", "left").select("node", F.coalesce("first_id", "own_id").alias("component_id")), "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    )


def _rarest(shared: DataFrame) -> DataFrame:
    """Rows (key, node) without each set's g - 1 most frequent blocks per band."""
    count = shared.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    band = F.shiftrightunsigned("key", BAND_SHIFT)
    rank = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("c"), "key"))
    top = 10 * F.pow(F.lit(2.0), F.col("band"))  # the largest size of the band; g as in spare()
    g = 2 + F.floor(F.floor(top * 2 / 9) / 8)
    return shared.join(count, "key").withColumn("band", band).withColumn("r", rank).filter(F.col("r") >= g).select("key", "node")


def _links(held: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between sets whose components are those of all links."""
    least = held.groupBy("key").agg(F.min("node").alias("a"))
    star = held.join(least, "key").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    links = _verify(star, nodes, texts)
    tested = star
    for most in (NEAREST, 0):
        pairs = _apart(held, links, nodes, most)
        if pairs is None:
            break
        pairs = shelve(pairs.join(tested, ["a", "b"], "left_anti"))
        links = links.unionAll(_verify(pairs, nodes, texts))
        tested = tested.unionAll(pairs)
    return links


def _apart(held: DataFrame, links: DataFrame, nodes: DataFrame, most: int) -> DataFrame | None:
    """Pairs (a, b) of one block but two components that the sketches let link; None if no block has two.

    With ``most``, only that many of each member's nearest partners in a tile, in its ``TRIED``
    most shared blocks.
    """
    label = components(links, "a", "b").select(F.col("node_id").alias("node"), "comp")
    placed = held.join(label, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("c")).filter("lo <> hi")
    rows = placed.join(split.select("key", "c", F.ceil(F.col("c") / TILE).cast("int").alias("tiles")), "key")
    if most:
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "key"))
        rows = rows.withColumn("r", rank).filter(F.col("r") <= TRIED)
    open_rows = shelve(rows.select("key", "node", "comp", "tiles"))
    if open_rows.isEmpty():
        return None
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = open_rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("key", "node", "comp", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    full = dealt.join(nodes.select("node", "n", "sketch"), "node").select("key", "lo", "hi", "node", "comp", "n", "sketch")
    grouped = full.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return grouped.mapInArrow(lambda batches: _near_in_groups(batches, most), "a long, b long").distinct()


def _near_in_groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """``near_pairs`` of each run of equal (key, lo, hi), a pair of tiles; the last run waits for its rest."""
    held: pa.Table | None = None

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, lo, hi, node, comp, n = (table.column(c).to_numpy() for c in range(6))
        bits = table.column(6)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        first = np.flatnonzero(new)
        size = np.diff([*first, len(key)])
        found = [
            near_pairs(node[a : a + g], comp[a : a + g], n[a : a + g], bits.slice(a, g).to_pylist(), most)
            for a, g in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True)
        ]
        run = np.cumsum(new) - 1
        small = size[run] <= SMALL
        for lag in range(1, SMALL):
            i = np.flatnonzero(small[:-lag] & (run[:-lag] == run[lag:]) & (comp[:-lag] != comp[lag:]))
            i = i[sizes_fit(n[i], n[i + lag])]
            i = [k for k in i.tolist() if hamming(bits[k].as_py(), bits[k + lag].as_py()) * 9 <= n[k] + n[k + lag]]
            if i:
                x, y = node[i], node[np.array(i) + lag]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))
        a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not table.num_rows:
            continue
        key, lo, hi = (table.column(c).to_numpy() for c in range(3))
        last = np.flatnonzero((key != key[-1]) | (lo != lo[-1]) | (hi != hi[-1]))
        at = int(last[-1]) + 1 if len(last) else 0
        if at:
            yield from pairs(table.slice(0, at))
        held = table.slice(at)
    if held is not None and held.num_rows:
        yield from pairs(held)


def near_pairs(node: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes], most: int) -> np.ndarray:
    """Pairs (two rows of smaller and larger node) of two components within the sketches' bound."""
    size = min(map(len, bits))
    folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0) for x in bits])
    folded = folded.view(np.uint64)
    out = []
    for i in range(len(node) - (0 if most else 1)):
        rest = slice(0, None) if most else slice(i + 1, None)
        distance = np.bitwise_count(folded[i] ^ folded[rest]).sum(axis=1, dtype=np.int64)
        fits = (comp[rest] != comp[i]) & (distance * 9 <= n[rest] + n[i])
        fits &= sizes_fit(n[rest], n[i])
        j = np.flatnonzero(fits)
        if most and len(j) > most:
            j = j[np.argpartition(distance[j] / (n[rest][j] + n[i]), most)[:most]]
        other = node[rest][j]
        out.append(np.stack([np.minimum(other, node[i]), np.maximum(other, node[i])]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
