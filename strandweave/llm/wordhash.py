"""Vectorised 64-bit hashes of words, shingles and lines over batches of UTF-8 texts.

A word's hash is a polynomial over random 64-bit codes of its bytes, taken modulo 2**64
from prefix sums, so a whole batch costs a few NumPy passes.  Words are runs of bytes
other than space and \\t..\\r with A-Z lowered; both rules act on single bytes and
therefore hold for UTF-8 as they do for code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000  # texts hashed together; a longer text is hashed alone
SHINGLE = 5

_rng = np.random.default_rng(0x5EED)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _CODE.copy()
_LOWER[65:91] = _CODE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_POWER = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)
COMBINE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWER, _INVERSE
    if len(_POWER) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("_POWER", _BASE), ("_INVERSE", pow(_BASE, -1, 2**64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            globals()[name] = np.multiply.accumulate(table)
    return _POWER[:n], _INVERSE[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together, one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of the bytes start..end (exclusive) of each span."""
    power, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _CODE)[data] * power[: len(data)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text plus the total)."""
    start, end = word_spans(data, off)
    return span_hashes(data, start, end, True), np.searchsorted(start, off, "left")


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words; a word never crosses into the next text."""
    space = _SPACE[data]
    gap = np.ones(len(data) + 1, bool)  # gap[i]: nothing joins byte i-1 to byte i
    gap[1:-1] = space[:-1] | space[1:]
    gap[off[:-1]] = True
    inside = ~space
    start = np.flatnonzero(inside & gap[:-1])
    end = np.flatnonzero(inside & gap[1:]) + 1
    return start, end


def line_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first line of each text plus the total): text split at every newline."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    # a text's own start precedes the start behind a newline that ends the text before it
    count = np.bincount(np.searchsorted(off, breaks, "right") - 1, minlength=len(off) - 1) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = off[1:]
    return start, end, first


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its 5-word shingles); a shorter text is one shingle."""
    data, off = text_bytes(texts)
    for i, j in slices(off):
        part = off[i : j + 1] - off[i]
        hashes, first = words(data[off[i] : off[j]], part)
        total = len(hashes)
        grams = np.zeros(max(0, total - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            grams += hashes[k : k + len(grams)] * COMBINE[k]
        grams = mix(grams)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= SHINGLE:
                u = np.sort(grams[a : b - SHINGLE + 1])
                yield i + d, u[np.concatenate([[True], u[1:] != u[:-1]])]
            elif b > a:
                whole = np.array([b - a], np.uint64)
                for k in range(b - a):
                    whole += hashes[a + k : a + k + 1] * COMBINE[k + SHINGLE]
                yield i + d, mix(whole)
            else:
                yield i + d, np.zeros(0, np.uint64)
