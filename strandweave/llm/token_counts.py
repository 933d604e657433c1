"""Token counts with overlap resynchronisation (operator 3).

Texts up to ``chunk`` characters are counted whole.  A longer text is encoded in overlapping
chunks by the library, with offsets.  Two neighbouring chunks are spliced where both begin a
word of the pre-tokenizer at the same character, and where that place is proven:

* the left chunk starts at a proven place, and its word starts are those of the whole text up
  to ``MARGIN`` characters before its end and before its last word (the pattern reads a text
  from left to right, keeps no state between words and looks ahead less than the margin; added
  tokens are shorter than the margin as well, or the margin grows to their length);
* from a place that is a word start of the whole text, the right chunk runs as the whole text.

Where an overlap has no such place it is doubled, in the end up to the rest of the text, so
the counts are exact for every text.  Memory follows the chunk, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.tables import map_arrow
from strandweave.llm.tokens import AtomCounts

CHUNK, OVERLAP, MARGIN = 16_384, 256, 32


def _encode(tokenizer, text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each token, start of each word but the last one) in the whole text's characters."""
    e = tokenizer.encode(text[lo:hi], add_special_tokens=False)
    if not e.ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.array(e.offsets, np.int64)[:, 0] + lo
    words = np.array([-1 if w is None else w for w in e.word_ids], np.int64)
    begins = np.concatenate([[True], (words[1:] != words[:-1]) | (words[1:] < 0)])
    return starts, starts[begins]


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, never encoding more than a chunk at once unless overlaps must widen."""
    margin = max([MARGIN, *(len(t.content) + 1 for t in tokenizer.get_added_tokens_decoder().values())])
    overlap = max(overlap, 2 * margin)
    chunk = max(chunk, 2 * overlap)
    n, total, proven, lo = len(text), 0, 0, 0
    hi = min(n, chunk)
    starts, words = _encode(tokenizer, text, lo, hi)
    while hi < n:
        width = overlap
        while True:
            if width >= hi - proven:  # the overlap reaches back over the whole left chunk: lengthen that one
                hi = min(n, hi + 2 * (hi - proven))
                lo = proven
                starts, words = _encode(tokenizer, text, lo, hi)
                width = overlap
                if hi == n:
                    break
            begin = hi - width
            end = min(n, begin + max(chunk, 2 * width))
            next_starts, next_words = _encode(tokenizer, text, begin, end)
            left = words[:-1]
            left = left[(left >= max(begin, proven)) & (left <= hi - margin)]
            common = np.intersect1d(left, next_words[next_words > begin])
            if len(common):
                splice = int(common[-1])
                total += int(np.count_nonzero((starts >= proven) & (starts < splice)))
                proven, lo, hi, starts, words = splice, begin, end, next_starts, next_words
                break
            width *= 2
    return total + int(np.count_nonzero(starts >= proven))


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) per row, by the vocabulary at ``path``.

    Null and empty texts count 0.  Repeated rows and null ids give a row each; other columns
    are not read.  No begin, end or padding tokens; added tokens inside a text count as the
    library counts them.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counter = AtomCounts.of(path)
        texts = batch.column("text")
        out = []
        for value in texts:
            text = value.as_py() or ""
            out.append(counter.count(text) if len(text) <= chunk else count_spliced(counter.tokenizer, text, chunk, overlap))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(out, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = map_arrow(source, run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
