"""Column expressions on sequences and strand-paired node ids."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# The IUPAC nucleotide codes and their complements.
IUPAC = "ACGTMRWSYKVHDBNacgtmrwsykvhdbn"
IUPAC_COMPLEMENT = "TGCAKYWSRMBDHVNtgcakywsrmbdhvn"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def reverse_complement(seq: Column | str) -> Column:
    return F.translate(F.reverse(_col(seq)), IUPAC, IUPAC_COMPLEMENT)


def oriented(seq: Column | str, orient: Column | str) -> Column:
    """The sequence as read on the given strand."""
    return F.when(_col(orient) == "+", _col(seq)).otherwise(reverse_complement(seq))


def complement_id(node: Column | str) -> Column:
    """Node ids come in strand pairs 2i / 2i+1."""
    return _col(node).bitwiseXOR(F.lit(1))


def flip(orient: Column | str) -> Column:
    return F.when(_col(orient) == "+", F.lit("-")).otherwise(F.lit("+"))


def strand_node(real_id: Column | str, orient: Column | str) -> Column:
    """Node of a read on a strand: the real id for '+', its pair otherwise."""
    return F.when(_col(orient) == "+", _col(real_id)).otherwise(complement_id(real_id))


def slice_length(length: Column | str, stop: Column | str) -> Column:
    """Length of ``s[:stop]``; a negative stop counts from the end."""
    length, stop = _col(length), _col(stop)
    return F.when(stop >= 0, F.least(length, stop)).otherwise(
        F.greatest(length + stop, F.lit(0).cast("long"))
    )


def head(seq: Column | str, stop: Column | str) -> Column:
    """``s[:stop]`` with the usual meaning of a negative stop."""
    seq = _col(seq)
    return F.substring(seq, F.lit(1), slice_length(F.length(seq).cast("long"), stop).cast("int"))


def motif_count(seq: Column | str, motif: str) -> Column:
    """Non-overlapping occurrences of a literal motif, scanned from the left."""
    return F.regexp_count(_col(seq), F.lit(motif)).cast("long")


WORD, LANES = 64, 16384  # rows in a bit vector; bit vectors a step works on at once
SPREAD = 1.3  # most words of a pair against the least in one step
BAND = 64  # cells on either side of the diagonal that are tried first


def edit_distances(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Levenshtein distances of many pairs of texts over one-byte letters.

    Only a band around the diagonal is computed, which gives the distance if that is not wider
    than the band and else an upper bound, and a band as wide as this bound gives the distance.
    So overlaps of reads that agree cost little, and any pair two passes at most.
    """
    out = np.zeros(len(left), np.int64)
    # the longer text makes the rows, so there are fewer steps over wider arrays
    pairs = [tuple(x.encode("latin-1") for x in ((a, b) if len(a) >= len(b) else (b, a))) for a, b in zip(left, right, strict=True)]
    for i, (a, b) in enumerate(pairs):
        out[i] = len(a) if not b else 0
    words = {i: -(-len(a) // WORD) for i, (a, b) in enumerate(pairs) if b}
    band = {i: max(BAND, len(pairs[i][0]) - len(pairs[i][1])) for i in words}
    todo = sorted(words, key=lambda i: (words[i], band[i]))
    wider: list[int] = []
    while todo or wider:
        if not todo:
            todo, wider = sorted(wider, key=lambda i: (words[i], band[i])), []
        least, k, widest = words[todo[0]], 0, 0
        while k < len(todo) and words[todo[k]] <= max(least + 1, least * SPREAD):
            most = max(widest, band[todo[k]])
            if k and min(words[todo[k]], 2 * most // WORD + 2) * (k + 1) > LANES:
                break
            k, widest = k + 1, most
        some, todo = todo[:k], todo[k:]
        for i, d in zip(some, _band_distances([pairs[i] for i in some], widest).tolist(), strict=True):
            out[i] = d
            if d > widest:
                band[i] = d
                wider.append(i)
    return out


def _letters(texts: list[bytes], length: int, code: np.ndarray) -> np.ndarray:
    """Letters of all texts by position (rows) and text (columns); 0 behind a text's end."""
    flat = np.frombuffer(b"".join(t.ljust(length, b"\0") for t in texts), np.uint8)
    return np.ascontiguousarray(code[flat].reshape(len(texts), length).T)


def _band_distances(pairs: list[tuple[bytes, bytes]], band: int) -> np.ndarray:
    """Distances within a band, by blocks of bit vectors.

    Neighbouring cells of a column differ by -1, 0 or 1, so two words hold the rises and falls
    of 64 rows of a column, and one word step yields the next column from the change that comes
    in above.  Word b of a column needs word b - 1 of the same column and word b of the one before:
    the words on an anti-diagonal, of all pairs, are one numpy step.  A word that enters the
    band below rises from cell to cell, one that leaves it above rises by one a column; neither is
    ever less than the truth.  Equal letters before both texts bring all to one number of rows.
    """
    words, n = max(-(-len(a) // WORD) for a, _ in pairs), len(pairs)
    padded = [(b"\1" * (words * WORD - len(a)), a, b) for a, b in pairs]
    a, b = [p + x for p, x, _ in padded], [p + x for p, _, x in padded]
    found = sorted(set(b"".join(a)))
    code = np.zeros(256, np.intp)
    code[found] = np.arange(1, len(found) + 1)
    rows = _letters(a, words * WORD, code).reshape(words, WORD, n)
    # the rows at which each letter stands; letter 0 stands nowhere
    equal = np.zeros((len(found) + 1, words, n), np.uint64)
    for bit in range(WORD):
        place = np.nonzero(rows[:, bit])
        equal[rows[:, bit][place], place[0], place[1]] |= np.uint64(1 << bit)
    equal, lane = equal.reshape(-1), np.arange(words * n).reshape(words, n)
    lengths = np.array([len(x) for x in b])
    steps = int(lengths.max())
    columns = np.zeros((steps + 2 * words, n), np.intp)
    columns[words : words + steps] = _letters(b, steps, code) * (words * n)
    one, top = np.uint64(1), np.uint64(WORD - 1)
    rises, falls = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    up, down = np.zeros((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)  # changes that come in above
    lowest, change, score = -1, np.zeros(n, np.int64), np.zeros(n, np.int64)  # of the last row in the band
    for t in range(steps + words - 1):
        lo = max(0, t - steps + 1, -((band + WORD - 1 - t) // (WORD + 1)))
        hi = min(words - 1, t, (t + band) // (WORD + 1))
        up[lo], down[lo] = 1, 0
        eq = equal[columns[t + words - hi : t + words - lo + 1][::-1] + lane[lo : hi + 1]]
        p, m, hp, hm = rises[lo : hi + 1], falls[lo : hi + 1], up[lo : hi + 1], down[lo : hi + 1]
        vertical = eq | m
        eq |= hm
        across = eq & p
        across += p
        across ^= p
        across |= eq
        plus = across | p
        np.invert(plus, out=plus)
        plus |= m
        minus = p & across
        out_up, out_down = plus >> top, minus >> top
        if hi > lowest:
            score += WORD - change
            lowest = hi
        change = out_up[-1].astype(np.int64) - out_down[-1].astype(np.int64)
        score += change * (t - hi < lengths)
        plus <<= one
        plus |= hp
        minus <<= one
        minus |= hm
        np.bitwise_and(plus, vertical, out=m)
        vertical |= plus
        np.invert(vertical, out=vertical)
        np.bitwise_or(minus, vertical, out=p)
        up[lo + 1 : hi + 2], down[lo + 1 : hi + 2] = out_up, out_down
    return score


@F.pandas_udf(IntegerType())
def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    out[known] = edit_distances(a[known].tolist(), b[known].tolist())
    return out


def overlap_similarity(src: Column | str, dst: Column | str, overlap: Column | str) -> Column:
    """1 - edit distance / overlap between the source's end and the target's start."""
    overlap = _col(overlap).cast("int")
    distance = _distances(F.right(_col(src), overlap), F.left(_col(dst), overlap))
    return F.lit(1.0) - distance / overlap


def telomere_class(start: Column | str, end: Column | str) -> Column:
    """0 none, 1 both ends, 2/3 start +/-, 4/5 end +/-."""
    start, end = _col(start), _col(end)
    return (
        F.when(start.isNotNull() & end.isNotNull(), 1)
        .when(start == "+", 2)
        .when(start.isNotNull(), 3)
        .when(end == "+", 4)
        .when(end.isNotNull(), 5)
        .otherwise(0)
    )
