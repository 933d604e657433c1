"""Line deduplication by pairwise alignment (operator 4).

* A seed is the shortest run of whole lines, from a given line on, that holds ``MIN_WORDS``
  words.  Any common block of that many words begins with a seed, so sharing one is necessary.
* Candidates: a document is paired with the earliest document that holds each of its shared seeds.
  This gives a pair per document and seed at most, whatever the number of copies, and the
  earliest holder is the one whose lines stay.
* Each pair is aligned by patience diff on line hashes: lines that occur once on both sides
  (else the k-th occurrence with the k-th) are put in longest increasing order, the gaps
  between are aligned the same way, and ends grow over equal lines.
* One alignment keeps one order, so it may leave out passages that moved, that are repeated or that
  another anchor shuts out.  Where a stretch of shared lines is not wholly aligned, every
  common run of the pair is searched, whatever its place, by the sorted suffixes of both.
* Common runs of ``MIN_WORDS`` words or more are cut from the later document, all of them and
  wholly.  What follows a shared seed only in a holder that is not its earliest, and has fewer
  words itself, stays.

The earliest document with a line never loses it: a line goes only where an earlier document
holds the same line.  Documents are ordered by doc_id, null last, then by a hash of the text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.tables import map_arrow, shelve, unused
from strandweave.llm.wordhash import line_spans, mix, slices, span_hashes, text_bytes, word_spans

MIN_WORDS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs sorted by i that also increases in j."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Line pairs of the two ranges to align on: unique ones, else k-th with k-th occurrences."""
    left: dict[int, list[int]] = {}
    right: dict[int, list[int]] = {}
    for i in range(a0, a1):
        left.setdefault(a[i], []).append(i)
    for j in range(b0, b1):
        right.setdefault(b[j], []).append(j)
    common = [(left[h], right[h]) for h in left if h in right]
    pairs = [(x[0], y[0]) for x, y in common if len(x) == 1 and len(y) == 1]
    if not pairs:
        pairs = [p for x, y in common for p in zip(x, y, strict=False)]
    return _increasing(sorted(pairs))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) of two line lists, in order."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        chain = _anchors(a, b, a0, a1, b0, b1)
        matched.extend(chain)
        ends = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        if chain:
            todo.extend((i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False))
    return sorted(matched)


def _stretches(held: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each stretch of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], held, [False]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def longest_runs(a: list[int], b: list[int]) -> np.ndarray:
    """For each line of ``b``, how many lines from it on stand in a row somewhere in ``a``."""
    n, total = len(a), len(a) + 1 + len(b)
    code = np.unique(np.array([*a, *b], np.uint64), return_inverse=True)[1] + 1
    # ranks of the runs of 1, 2, 4, ... lines; 0 parts the two sides, -1 is behind the end
    ranks, span = [np.concatenate([code[:n], [0], code[n:]])], 1
    while span < min(n, len(b)):
        behind = np.full(total, -1)
        behind[: max(0, total - span)] = ranks[-1][span:]
        ranks.append(np.unique(ranks[-1] * (total + 2) + behind + 1, return_inverse=True)[1])
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    mine = order < n
    before = np.maximum.accumulate(np.where(mine, np.arange(total), -1))
    after = np.minimum.accumulate(np.where(mine, np.arange(total), total)[::-1])[::-1]
    ranks = [np.append(r, -1) for r in ranks]
    longest = np.zeros(total, np.int64)
    for near in (before, after):  # the longest common beginning is with a neighbour in the order
        at = np.flatnonzero((near >= 0) & (near < total) & ~mine)
        x, y = order[at], order[near[at]]
        start = x.copy()
        for k in range(len(ranks) - 1, -1, -1):
            step = np.where(ranks[k][x] == ranks[k][y], 1 << k, 0)
            x, y = x + step, y + step
        longest[start] = np.maximum(longest[start], x - start)
    return longest[n + 1 :]


def common_blocks(a: list[int], b: list[int], words: list[int], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Ranges of ``b`` (first, end) of the lines in runs that also stand in ``a`` and hold ``least`` words."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    cut = np.zeros(len(b), bool)
    run = []
    for pair in [*patience(a, b), (-9, -9)]:
        if run and pair != (run[-1][0] + 1, run[-1][1] + 1):
            first, end = run[0][1], run[-1][1] + 1
            cut[first:end] |= total[end] - total[first] >= least
            run = []
        run.append(pair)
    known = set(a)
    shared = _stretches(np.array([x in known for x in b], bool))
    if not all(cut[i:j].all() for i, j in shared if total[j] - total[i] >= least):
        first = np.arange(len(b))
        end = first + longest_runs(a, b)
        good = total[end] - total[first] >= least
        depth = np.bincount(first[good], minlength=len(b) + 1) - np.bincount(end[good], minlength=len(b) + 1)
        cut |= np.cumsum(depth)[:-1] > 0
    return _stretches(cut)


def _line_table(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Line hashes and word counts of each text, as packed 64- and 32-bit numbers."""
    data, off = text_bytes(batch.column("text"))
    hashes, counts = [], []
    for i, j in slices(off):
        part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        start, end, first = line_spans(part, at)
        line = span_hashes(part, start, end, False)
        word_start, _ = word_spans(part, at)
        n = np.searchsorted(word_start, end) - np.searchsorted(word_start, start)
        for d in range(j - i):
            hashes.append(line[first[d] : first[d + 1]].tobytes())
            counts.append(n[first[d] : first[d + 1]].astype(np.int32).tobytes())
    columns = [batch.column("doc"), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["doc", "lines", "words"])


def seeds(lines: np.ndarray, words: np.ndarray, least: int = MIN_WORDS) -> np.ndarray:
    """Hash of the shortest run from each line with words on that holds ``least`` words."""
    total = np.concatenate([[0], np.cumsum(words)])
    start = np.flatnonzero(words)
    end = np.searchsorted(total, total[start] + least)
    start, end = start[end <= len(words)], end[end <= len(words)]
    power, inverse = np.full((2, len(lines) + 1), 1, np.uint64)
    power[1:], inverse[1:] = _ODD, pow(int(_ODD), -1, 2**64)
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines * power[:-1])])
    return np.unique(mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64)))


def _seed_rows(batch: pa.RecordBatch, least: int) -> Iterator[pa.RecordBatch]:
    found = [
        seeds(np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.int32), least)
        for h, w in zip(batch.column("lines"), batch.column("words"), strict=True)
    ]
    row = np.repeat(np.arange(len(found)), [len(s) for s in found])
    flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
    for at in range(0, len(flat), 100_000):
        part = slice(at, at + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(flat[part]), batch.column("doc").take(pa.array(row[part]))], ["seed", "doc"])


DOC = "struct<missing:boolean,id:long,text_hash:long>"


def _doc_key():
    name = F.col("doc_id").cast("long")
    return F.struct(name.isNull().alias("missing"), name.alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash")).alias("doc")


def removed_ranges(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc, ranges array<struct<first, end>>: the line ranges that each later document loses."""
    source = docs.select(_doc_key(), F.col("text").cast("string").alias("text")).filter("text is not null")
    table = shelve(map_arrow(source, _line_table, f"doc {DOC}, lines binary, words binary"))
    marks = shelve(map_arrow(table, lambda batch: _seed_rows(batch, least), f"seed long, doc {DOC}"))
    holders = marks.groupBy("seed").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first <> last")
    pairs = marks.join(holders, "seed").filter(F.col("doc.id").isNull() | ~F.col("doc.id").eqNullSafe(F.col("first.id")))
    pairs = shelve(pairs.filter("doc <> first").select("doc", "first").distinct())
    once = table.dropDuplicates(["doc"])  # rows repeated as they are
    sides = pairs.join(once, "doc").join(once.select(F.col("doc").alias("first"), F.col("lines").alias("first_lines")), "first")

    def align(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, ranges = [], []
        for k in range(batch.num_rows):
            a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64).tolist() for c in ("first_lines", "lines"))
            words = np.frombuffer(batch.column("words")[k].as_buffer(), np.int32).tolist()
            found = common_blocks(a, b, words, least)
            if found:
                rows.append(k)
                ranges.append([{"first": x, "end": y} for x, y in found])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(ranges, kind)], ["doc", "ranges"])

    ranges = "array<struct<first:int,end:int>>"
    cuts = map_arrow(sides.select("doc", "lines", "words", "first_lines"), align, f"doc {DOC}, ranges {ranges}")
    # one document's ranges number no more than its lines
    return shelve(cuts.select("doc", F.explode("ranges").alias("r")).groupBy("doc").agg(F.collect_set("r").alias("ranges")))


def cut_text(text: str, ranges: list[dict]) -> tuple[str, int, int]:
    """(text without the ranges' lines, its lines before, lines cut)."""
    lines = text.split("\n")
    keep = np.ones(len(lines), bool)
    for r in ranges:
        keep[r["first"] : r["end"]] = False
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k), len(lines), int((~keep).sum())


def _joined(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` with the ranges to cut as last column."""
    doc, ranges = unused(docs, "_cut_doc"), unused(docs, "_cut_ranges")
    cuts = removed_ranges(docs, least).select(F.col("doc").alias(doc), F.col("ranges").alias(ranges))
    # one plan at every size: the texts are shuffled once, skewed partitions are split
    return docs.join(cuts.hint("merge"), _doc_key() == F.col(doc), "left").drop(doc)


def line_report(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_crc32 and removed (line ranges) per row.

    A null text has no lines and an empty one a single line.  Rows that repeat an id and a text
    are one document (each row gets its result), rows that repeat an id only are never cut
    against each other.  Null ids come last in the order.  An empty table gives no rows.
    """
    small = docs.select("doc_id", "text")
    return map_arrow(
        _joined(small, least).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "_cut_ranges"),
        _report,
        "doc_id long, n_lines long, n_removed long, kept_chars long, kept_crc32 long, removed string",
    )


def _report(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    import zlib

    rows = []
    for name, text, ranges in zip(*(batch.column(c) for c in range(3)), strict=True):
        text, ranges = text.as_py(), ranges.as_py() or []
        kept, n, gone = cut_text(text, ranges) if text is not None else ("", 0, 0)
        spans = ",".join(f"{r['first']}:{r['end']}" for r in sorted(ranges, key=lambda r: (r["first"], r["end"])))
        rows.append((name.as_py(), n, gone, len(kept), zlib.crc32(kept.encode()), spans))
    types = [pa.int64()] * 5 + [pa.string()]
    names = ["doc_id", "n_lines", "n_removed", "kept_chars", "kept_crc32", "removed"]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, types, strict=True)], names)


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs``, all columns, without the aligned lines; a document that loses all of them goes.

    Other documents stay as they are, empty and null texts included.
    """
    joined = _joined(docs, least)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ranges = batch.column(batch.num_columns - 1)
        texts, keep = [], []
        for text, r in zip(batch.column(at), ranges, strict=True):
            text, r = text.as_py(), r.as_py()
            if r:
                text = cut_text(text, r)[0]
            texts.append(text)
            keep.append(not r or bool(text.strip()))
        columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(joined, run, docs.schema)
