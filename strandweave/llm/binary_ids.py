"""Token ids in a binary file with Elias-Fano document boundaries (operator 10).

A file is a folder of Parquet parts whose rows are blocks, in the order (part, block):

* ``ids``: the concatenated ids of the block's documents, little-endian, 2 bytes each if the
  vocabulary has at most 65,536 ids, else 4 (``width``);
* the ends of its documents, a non-decreasing sequence of ``n_docs`` values up to ``n_ids``, in
  Elias-Fano form: ``low`` packs the ``low_bits`` lowest bits of each value, ``high`` is a
  bit vector with a one at (value >> low_bits) + index for each value, and ``select`` holds the
  place of every 256th one as unsigned 32-bit numbers, so an end is found from one directory
  entry and a scan of few bytes;
* ``doc_ids``: the documents' ids.

Blocks hold about ``BLOCK_IDS`` ids (a longer document has a block of its own), so a reader
needs one block in memory.  Parts are written and committed by Spark, hence a lost
executor only repeats its part and any file system that Spark writes will do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm.tables import map_arrow
from strandweave.llm.tokens import WordIds
from strandweave.operators.numbering import running_sum_before, with_row_index
from strandweave.session import checkpoint_dir

BLOCK_IDS = 1 << 20
STEP = 256
FILE = "doc_ids array<long>, n_docs long, n_ids long, width int, low_bits int, low binary, high binary, select binary, ids binary"


def elias_fano(ends: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """(low_bits, low, high, select) of a non-decreasing sequence of values up to ``universe``."""
    n = len(ends)
    low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
    low = (ends[:, None] >> np.arange(low_bits)) & 1
    ones = (ends >> low_bits) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    pack = lambda b: np.packbits(b.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return low_bits, pack(low), pack(bits), ones[::STEP].astype("<u4").tobytes()


class Ends:
    """Select over an encoded sequence: ``ends[i]`` is its i-th value."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, select: bytes):
        self.low_bits, self.low, self.high = low_bits, low, high
        self.select = np.frombuffer(select, "<u4")

    def __getitem__(self, i: int) -> int:
        place = int(self.select[i // STEP])
        missing = i % STEP
        at, byte = place // 8, self.high[place // 8] >> (place % 8) << (place % 8)
        while (ones := byte.bit_count()) <= missing:
            missing -= ones
            at += 1
            byte = self.high[at]
        for _ in range(missing):
            byte &= byte - 1
        high = at * 8 + (byte & -byte).bit_length() - 1 - i
        if not self.low_bits:
            return high
        first = i * self.low_bits
        window = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
        return high << self.low_bits | (window >> first % 8) & ((1 << self.low_bits) - 1)

    def all(self, n: int) -> np.ndarray:
        """The first ``n`` values at once."""
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[:n]
        low = np.unpackbits(np.frombuffer(self.low, np.uint8), count=n * self.low_bits, bitorder="little")
        weight = 1 << np.arange(self.low_bits, dtype=np.int64)
        return ((ones - np.arange(n)) << self.low_bits) + low.reshape(n, self.low_bits).astype(np.int64) @ weight


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None) -> str:
    """Encode each row's text, append ``end_id`` and write the file; returns its folder.

    Documents stand in ascending doc_id order (null first, equal ids by text).  The texts are
    range partitioned, so each task encodes and packs one run of documents.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds.of(path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        ids, names, size, part, block = [], [], 0, 0, 0

        def flush():
            nonlocal ids, names, size, block
            flat = np.frombuffer(b"".join(ids), "<u4")
            ends = np.cumsum([len(x) // 4 for x in ids])
            low_bits, low, high, select = elias_fano(ends, len(flat))
            columns = [
                pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(pa.int64())),
                pa.array([len(ids)], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([width], pa.int32()), pa.array([low_bits], pa.int32()),
                *(pa.array([x], pa.binary()) for x in (low, high, select, flat.astype(f"<u{width}").tobytes())),
            ]
            ids, names, size, block = [], [], 0, block + 1
            return pa.RecordBatch.from_arrays(columns, ["part", "block", *(f.split()[0] for f in FILE.split(", "))])

        for batch in batches:
            for name, text, p in zip(batch.column("doc_id"), batch.column("text"), batch.column("part"), strict=True):
                got = encoder.encode(text.as_py()) + end
                if ids and size + len(got) // 4 > BLOCK_IDS:
                    yield flush()
                part = p.as_py()
                ids.append(got)
                names.append(name.as_py())
                size += len(got) // 4
        if ids:
            yield flush()

    blocks = ordered.mapInArrow(run, f"part int, block int, {FILE}")
    blocks.write.option("compression", "none").parquet(folder)
    return folder


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, block, base: ids that stand before each block."""
    sizes = spark.read.parquet(folder).select("part", "block", "n_ids")
    placed = with_row_index(sizes, ["part", "block"], "pos")
    return running_sum_before(placed, [], "pos", {"base": "n_ids"}).select("part", "block", "base")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the file alone."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            n = row["n_docs"]
            ends = Ends(row["low_bits"], row["low"], row["high"], row["select"]).all(n)
            begins = np.concatenate([[0], ends[:-1]])
            flat = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                 pa.array(begins, pa.int64()), pa.array(ends - begins, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "block", "doc_id", "begin", "n_tokens", "ids_crc32"],
            )

    # a batch of several blocks would hold them all in memory
    blocks = spark.read.parquet(folder)
    rows = map_arrow(blocks, run, "part int, block int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    named = rows.join(block_starts(spark, folder), ["part", "block"])
    return named.select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def binary_ids(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text, ..) and read every document back from the file.

    Null and empty texts hold the end id alone.  Repeated rows and null ids are documents
    of their own; an empty table gives an empty file; other columns are not read.
    """
    return read_ids(docs.sparkSession, write_ids(docs, path, end_id))
