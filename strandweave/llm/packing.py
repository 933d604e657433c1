"""Best-fit packing by the configuration linear program (operator 7).

Pieces of at most ``capacity`` tokens go into as few sequences as possible.  The driver works
on the histogram of piece lengths alone, which has ``capacity`` entries at most whatever the
number of pieces:

1. Lengths are grouped into ``UNITS`` classes.  The configuration program asks for the least
   number of patterns (multisets of classes that fit a sequence) that cover every class.
   Multiplicative weights solve it: a class is priced by its size times the exponential of how
   far its covering lags behind, a knapsack dynamic program finds the best-priced pattern, and
   that pattern's amount grows by a share of the class it uses up fastest.
2. An amount is rounded to whole sequences as it grows and filled with real lengths: the
   longest of each class, and for the last two classes a pair that fills the sequence to the
   last token, if there is one.
3. What no pattern can take, and the shortest lengths, which are kept for this, goes best fit
   decreasing into the gaps, then into new sequences.

All steps yield runs: ``n`` consecutive sequences that take pieces of one length, with
consecutive ranks, at one offset.  A piece finds its run by its length and its rank among the
pieces of that length, so the assignment is a lookup in a table whose size does not depend on the
number of pieces.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.tables import map_arrow, shelve
from strandweave.llm.tokens import WordIds

CAPACITY = 4096
UNITS = 128
STEP = 0.1  # share of a class that one round of the program covers at most
LAG = 16.0  # weight of a class that lags behind by all of its pieces, as an exponent
KEPT = 0.04  # share of the pieces, the shortest, kept out of the patterns to fill gaps
POOR = 30  # a pattern that leaves more than this share of a sequence empty is not used
PART_SHIFT = 33


def best_pattern(price: np.ndarray, units: int) -> list[int]:
    """The multiset of sizes 1..len(price) of total at most ``units`` with the highest price."""
    best, take = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        top = min(room, len(price))
        value = price[:top] + best[room - top : room][::-1]
        i = int(value.argmax())
        if value[i] > best[room - 1]:
            best[room], take[room] = value[i], i + 1
        else:
            best[room] = best[room - 1]
    found, room = [], units
    while room:
        if take[room]:
            found.append(int(take[room]))
            room -= int(take[room])
        else:
            room -= 1
    return found


class Plan:
    """Runs (length, first rank, pieces, first sequence, offset) built from a histogram."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = {length: n for length, n in histogram.items() if n}
        self.capacity = capacity
        self.rank = dict.fromkeys(histogram, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # room left: [(first sequence, how many)]
        self.rooms: list[int] = []
        self.sequences = 0
        self.patterned = 0  # pieces that patterns have placed

    def put(self, length: int, first: int, n: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], n, first, offset))
        self.rank[length] += n
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]

    def leave(self, room: int, first: int, n: int) -> None:
        if room and n:
            if room not in self.gaps:
                self.gaps[room] = []
                heapq.heappush(self.rooms, room)
            self.gaps[room].append((first, n))

    def open(self, lengths: list[int], n: int) -> None:
        """``n`` new sequences that each hold pieces of these lengths."""
        offset = 0
        for length in lengths:
            self.put(length, self.sequences, n, offset)
            offset += length
        self.leave(self.capacity - offset, self.sequences, n)
        self.sequences += n

    def longest(self, upto: int, above: int = 0) -> int | None:
        """The longest length left that is at most ``upto`` and more than ``above``."""
        found = np.flatnonzero(self.count[above + 1 : upto + 1])
        return above + 1 + int(found[-1]) if len(found) else None

    def pair(self, total: int, near: int) -> tuple[int, int] | None:
        """Two lengths left that add up to ``total``, one of them as near as can be to ``near``."""
        a = np.arange(max(1, total - self.capacity), min(self.capacity, total - 1) + 1)
        rest = total - a
        good = a[(self.count[a] > 0) & (self.count[rest] > 0) & ((a != rest) | (self.count[a] > 1))]
        if not len(good):
            return None
        one = int(good[np.abs(good - near).argmin()])
        return one, total - one

    def lengths_of(self, pattern: list[int], width: int) -> list[int]:
        """Real lengths for classes in descending order; class u holds (u - 1) * width + 1 .. u * width."""
        chosen, room = [], self.capacity
        for i, unit in enumerate(pattern):
            if i == len(pattern) - 2 and (both := self.pair(room, unit * width)):
                chosen += both
                break
            length = self.longest(min(unit * width, room), (unit - 1) * width)
            if i == len(pattern) - 1:
                length = self.longest(room) or length
            if length is None:
                continue
            chosen.append(length)
            self.count[length] -= 1
            room -= length
        self.count[:] = self.stock  # only looked up
        return chosen

    def patterns(self, units: int, step: float, lag: float, kept: float, poor: int) -> None:
        """The configuration program by multiplicative weights, in whole sequences."""
        width = -(-self.capacity // units)
        self.stock = np.zeros(self.capacity + 1, np.int64)
        total, aside = sum(self.left.values()), 0
        for length in sorted(self.left):
            if aside < kept * total and length < self.capacity // 8:
                aside += self.left[length]
            else:
                self.stock[length] = self.left[length]
        self.count = self.stock.copy()
        classes = -(-np.arange(self.capacity + 1) // width)
        demand = np.bincount(classes, self.stock, units + 1)[1:]
        size, share = np.arange(1, units + 1), np.divide(1, demand, out=np.zeros(units), where=demand > 0)
        given_up = np.zeros(units, bool)
        while True:
            uncovered = np.bincount(classes, self.stock, units + 1)[1:]
            open_ = (uncovered > 0) & ~given_up
            if not open_.any():
                break
            ahead = float((uncovered * size).sum() / (demand * size).sum())
            price = np.where(open_, size * np.exp(lag * (uncovered * share - ahead)), 0.0)
            pattern = sorted(best_pattern(price, units), reverse=True)
            lengths = self.lengths_of(pattern, width)
            used = Counter(lengths)
            if self.capacity - sum(lengths) > poor:  # nothing left fills a sequence with this class
                given_up[pattern[0] - 1] = True
                continue
            grow = step * min(uncovered[u - 1] / k for u, k in Counter(pattern).items())
            n = min(max(1, round(grow)), *(int(self.stock[x]) // k for x, k in used.items()))
            self.open(lengths, n)
            for x, k in used.items():
                self.stock[x] -= n * k
                self.count[x] = self.stock[x]
            self.patterned += n * len(lengths)

    def best_fit(self) -> None:
        """What is left, longest first, each time into the smallest room that holds it."""
        for length in sorted(self.left, reverse=True):
            rooms = sorted(r for r in self.gaps if r >= length)
            while rooms:
                room = heapq.heappop(rooms)
                while room >= length and self.left.get(length):
                    # one room after the other, from the tightest; a filled room may take more of them
                    groups = self.gaps.get(room)
                    if not groups:
                        break
                    first, n = groups.pop()
                    per = min(room // length, -(-self.left[length] // n))
                    if per > 1 and self.left[length] < n * per:
                        per -= 1
                    k = min(n, self.left[length]) if per == 1 else n
                    for j in range(per):
                        self.put(length, first, k, self.capacity - room + j * length)
                    if k < n:
                        groups.append((first + k, n - k))
                    rest = room - per * length
                    self.leave(rest, first, k)
                    if rest >= length:  # it took fewer than fit: the next to visit
                        heapq.heappush(rooms, rest)
                        if groups:
                            heapq.heappush(rooms, room)
                        break
                if not self.left.get(length):
                    break
            while self.left.get(length):
                per = min(self.capacity // length, self.left[length])
                self.open([length] * per, self.left[length] // per)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, units: int = UNITS) -> Plan:
    """The packing of pieces counted by length: patterns of the program, then best fit for the rest."""
    made = Plan(histogram, capacity)
    made.patterns(units, STEP, LAG, KEPT, capacity // POOR)
    made.best_fit()
    return made


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, units: int = UNITS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(runs, sequences) of the packing."""
    made = plan(histogram, capacity, units)
    return made.runs, made.sequences


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """uid, doc_id, piece, start, length, ids: each text's ids with ``end_id``, cut at ``capacity``.

    ``ids`` are little-endian unsigned 32-bit integers; ``uid`` holds the writing task above
    bit 33 and a counter below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = WordIds.of(path)
        end = np.array([end_id], "<u4").tobytes()
        uid = TaskContext.get().partitionId() << PART_SHIFT
        rows, size = [], 0
        schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encoder.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((uid, name.as_py(), k, at // 4, len(part) // 4, part))
                    uid += 1
                    size += len(part)
                if size > 8_000_000:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids binary")


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """uid, sequence_id, offset for rows (uid, length, ..) of a written table."""
    spark = parts.sparkSession
    counted = parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    runs, _ = plan_runs({r["length"]: r["n"] for r in counted}, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    spark_runs = spark.sparkContext.broadcast(table)
    # the rank of a piece among those of its length, in two steps so that no length is one group
    share = F.shiftright("uid", PART_SHIFT)
    own = parts.select("uid", "length", share.alias("share"))
    sizes = own.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "share", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "share").orderBy("uid")) - 1
    ranked = own.withColumn("inside", inside).join(sizes, ["length", "share"]).select("uid", "length", (F.col("before") + F.col("inside")).alias("rank"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not batch.num_rows:
            return
        t = spark_runs.value
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        step = int(max(t[:, 1].max(), rank.max())) + 1
        i = np.searchsorted(t[:, 0] * step + t[:, 1], length * step + rank, "right") - 1
        found = [batch.column("uid"), pa.array(t[i, 3] + rank - t[i, 1]), pa.array(t[i, 4])]
        yield pa.RecordBatch.from_arrays(found, ["uid", "sequence_id", "offset"])

    return map_arrow(ranked, run, "uid long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset for each piece of each row.

    Null and empty texts are one piece that holds the end id.  Repeated rows and null ids
    are packed as documents of their own; an empty table gives no rows; other columns are
    not read.  Only texts longer than ``capacity`` are cut.
    """
    parts = shelve(pieces(docs, path, end_id, capacity))
    return parts.join(place(parts, capacity), "uid").drop("uid")


def pack_digest(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pack`` with ``ids_crc32`` in place of the ids."""
    parts = shelve(pieces(docs, path, end_id, capacity))
    crc = parts.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return crc.join(place(parts, capacity), "uid").drop("uid")
