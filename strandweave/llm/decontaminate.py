"""Benchmark decontamination by spaced-seed hashing (operator 2).

A fixed mask keeps some of the words of a window and ignores the others, so equal masked
hashes survive substitutions at the ignored places.  Windows of benchmark items and of texts
are hashed under every mask; equal hashes name a diagonal (text word minus item word), and
the overlap along it is verified word by word: the best stretch, a match counting 1 and a
substitution -2, must hold ``enough(item)`` equal words.

The masks miss no such stretch: each stretch that ``enough`` accepts, whatever the places
of its substitutions, has a window inside it whose kept words are all equal.  ``SHORT_MASKS`` add
the windows that items of 6 to 12 words need; the tests enumerate the stretches.

Benchmark items are taken in blocks of about ``BLOCK_WORDS`` words, by a hash.  One block's
index is what the tasks receive, so its size is bounded whatever the benchmark's; each block
takes one pass over the texts, which are neither shuffled nor shortened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.tables import map_arrow
from strandweave.llm.wordhash import COMBINE, slices, text_bytes, words

# Fixed masks: six of up to twelve words each.
MASKS = ("111111", "1101100101", "1010110011", "10101010101", "11001001011", "11110101", "100011000111")
# Five words each, for items of up to SHORT words only.
SHORT_MASKS = ("11111", "110111", "11100011")
SHORT = 12
SHORTEST = 6  # words of an item; shorter ones are no evidence
BLOCK_WORDS = 400_000
FILTER_BITS = 24


def enough(length: int) -> int:
    """Equal words that a stretch needs against an item of ``length`` words."""
    return min(10, -(-length * 7 // 10))


class Index:
    """Masked hashes of one block of items, sorted, behind a bitmap of fixed size."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        data, off = text_bytes(pa.array([text for _, text in items], pa.string()))
        self.words, first = words(data, off)
        self.names = [name for name, _ in items]
        length = np.diff(first)
        self.first, self.last = first[:-1], first[1:]
        short = bool(((length >= SHORTEST) & (length <= SHORT)).any())
        self.masks = [np.flatnonzero(np.array(list(m)) == "1") for m in (*MASKS, *(SHORT_MASKS if short else ()))]
        item = np.repeat(np.arange(len(items)), length)
        keys, places = [], []
        for k in range(len(self.masks)):
            at, key = self.seeds(self.words, item, k)
            fits = length[item[at]] >= SHORTEST
            if k >= len(MASKS):
                fits &= length[item[at]] <= SHORT
            keys.append(key[fits])
            places.append(at[fits])
        key, place = np.concatenate(keys), np.concatenate(places)
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.item = key[order], place[order], item
        self.bitmap = np.zeros(1 << FILTER_BITS, bool)
        self.bitmap[self.key >> np.uint64(64 - FILTER_BITS)] = True

    def seeds(self, hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, masked hash) of each window of mask ``k`` inside one text."""
        mask = self.masks[k]
        span = int(mask[-1]) + 1
        n = max(0, len(hashes) - span + 1)
        key = np.full(n, COMBINE[40 + k % 20] * np.uint64(1) ^ np.uint64(span), np.uint64)
        for c, o in enumerate(mask):
            key += hashes[o : o + n] * COMBINE[c]
        key ^= key >> np.uint64(29)
        key *= COMBINE[30]
        inside = owner[:n] == owner[span - 1 : span - 1 + n]
        return np.flatnonzero(inside), key[inside]

    def overlaps(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, equal words, first word in the text, in the item) for each overlap that holds."""
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rows = []
        for k in range(len(self.masks)):
            at, key = self.seeds(hashes, owner, k)
            likely = self.bitmap[key >> np.uint64(64 - FILTER_BITS)]
            at, key = at[likely], key[likely]
            lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
            n = hi - lo
            each = np.repeat(np.arange(len(at)), n)
            place = self.place[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            item = self.item[place]
            rows.append(np.stack([owner[at[each]], item, (at[each] - first[owner[at[each]]]) - (place - self.first[item])], axis=1))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, diagonal in np.unique(np.concatenate(rows), axis=0) if rows else ():
            doc, item, diagonal = int(doc), int(item), int(diagonal)
            length = int(self.last[item] - self.first[item])
            a, b = max(0, -diagonal), min(length, int(first[doc + 1] - first[doc]) - diagonal)
            begin = int(first[doc]) + diagonal
            equal = hashes[begin + a : begin + b] == self.words[self.first[item] + a : self.first[item] + b]
            score = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
            gain = score - np.minimum.accumulate(score)
            end = int(gain.argmax())
            start = int(score[: end + 1].argmin())
            matched = int(equal[start:end].sum())
            if matched >= enough(length) and matched > best.get((doc, item), (0, 0, 0))[0]:
                best[doc, item] = (matched, diagonal + a + start, a + start)
        for (doc, item), (matched, at_doc, at_item) in best.items():
            yield doc, item, matched, at_doc, at_item


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Index]:
    """Indexes of the benchmark's blocks; the driver holds one block at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", "[\\x20\\x09-\\x0D]+")))).head()[0] or 0
    n = -(-total // block_words)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()
        if rows:
            yield Index([(r["item_id"], r["text"]) for r in rows])


def _texts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, off = text_bytes(column)
    for i, j in slices(off):
        hashes, first = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, hashes, first


def leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, matched, doc_word, item_word, item_words: one row per text and item it holds.

    Null and empty texts and items hold nothing, nor do items under ``SHORTEST`` words.
    Repeated rows and null ids give rows of their own (repeated items one); an empty table on
    either side gives no rows; other columns are not read.
    """
    schema = "doc_id long, item_id long, matched int, doc_word long, item_word long, item_words long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in item_blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            index, rows = shared.value, []
            for i, hashes, first in _texts(batch.column("text")):
                for doc, item, matched, at_doc, at_item in index.overlaps(hashes, first):
                    rows.append((batch.column("doc_id")[i + doc].as_py(), index.names[item], matched, at_doc, at_item, int(index.last[item] - index.first[item])))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in schema.split(", ")])

        found = map_arrow(texts, run, schema)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item."""
    out = docs
    at = docs.columns.index("text")
    for index in item_blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            keep = np.ones(batch.num_rows, bool)
            for i, hashes, first in _texts(batch.column(at)):
                for doc, *_ in shared.value.overlaps(hashes, first):
                    keep[i + doc] = False
            yield batch.filter(pa.array(keep))

        out = map_arrow(out, run, out.schema)
    return out
