"""Ranked lexical search with pair-bound MaxScore (operator 11).

Three tables, each written once, carry a search.  None of them needs a shuffle of postings:

1. The *index*: a row per block of documents with its terms and their postings.
2. The *impact index* of a batch of items, a row per block: of the items' terms the impacts, the
   largest impact and the ``top``-th largest; of pairs of terms that stand next to each other when
   an item's terms are ordered by weight, the same of the sums of both impacts over the
   documents that hold both (the pair's intersection list).
3. The ``top`` documents of each item in each task, of which the best are kept.

A document that holds one of two terms scores at most the larger maximum for them, one that
holds both at most the joint maximum.  So the larger of the three bounds the pair, often
far below the sum of both maxima.  The bound of a prefix of an item's terms (lightest first) is
the best combination of single and pair bounds, found by dynamic programming.  Terms whose
prefix bound cannot reach the threshold are not essential: documents that hold only these are
never met, whole blocks are skipped, and a document is dropped as soon as its score and the
bound of what is left stay under the threshold.  The threshold starts at the ``top``-th
largest (joint) impact that any block has, and grows with the documents found.

Everything skipped is strictly below the threshold, so the ranking is exact, ties included.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.tables import map_arrow, shelve

TOP = 10
BLOCK_DOCS, BLOCK_POSTINGS = 4096, 1 << 18  # where a block of the index ends
# A row is a block of some MB.  Left to itself Parquet puts a hundred of them into a group, which is written
# from memory and read into it as a whole.
ROW_GROUPS = {"parquet.block.row.count.limit": "4"}
BATCH_TERMS = 200_000  # terms of the items that are searched in one pass over the index

INDEX = "doc_ids array<long>, lens array<long>, n_filled long, n_terms long, terms array<string>, dfs array<int>, docs binary, tfs binary"
IMPACTS = (
    "doc_ids array<long>, terms array<int>, sizes array<int>, docs binary, impacts binary, best array<long>, kth array<long>,"
    " pairs array<int>, pair_best array<long>, pair_kth array<long>"
)

# One byte per byte of UTF-8: A-Z become a-z, digits, letters and all beyond ASCII stay, the rest is space.
_SPELLED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode().translate(_SPELLED).split()


def _row(schema: str, **values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([values[n]], kinds[k]) for n, k in fields], [n for n, _ in fields])


def build_index(docs: DataFrame) -> DataFrame:
    """The index of whole texts, written; null texts are documents without terms.

    ``docs`` of a block's postings are places in its ``doc_ids``, ascending within each term; a
    document of more than ``BLOCK_POSTINGS`` terms has a block of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[int | None] = []
        lens: list[int] = []
        words: dict[bytes, int] = defaultdict(lambda: len(words))
        at: list[np.ndarray] = []
        tfs: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal held
            terms = list(words)
            rank = np.empty(len(terms), np.int64)
            order = sorted(range(len(terms)), key=terms.__getitem__)
            rank[order] = np.arange(len(terms))
            term = rank[np.concatenate(at)] if at else np.empty(0, np.int64)
            doc = np.repeat(np.arange(len(at)), [len(x) for x in at])
            by_term = np.argsort(term, kind="stable")
            out = _row(
                INDEX, doc_ids=names, lens=lens, n_filled=sum(n > 0 for n in lens), n_terms=sum(lens), terms=[terms[i].decode() for i in order],
                dfs=np.bincount(term, minlength=len(terms)), docs=doc[by_term].astype("<u4").tobytes(),
                tfs=(np.concatenate(tfs)[by_term] if tfs else np.empty(0)).astype("<u4").tobytes(),
            )
            names.clear(), lens.clear(), words.clear(), at.clear(), tfs.clear()
            held = 0
            return out

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                found = terms_of(text.as_py())
                counts = Counter(found)
                if names and (len(names) >= BLOCK_DOCS or held + len(counts) > BLOCK_POSTINGS):
                    yield flush()
                names.append(name.as_py())
                lens.append(len(found))
                at.append(np.fromiter(map(words.__getitem__, counts), np.int64, len(counts)))
                tfs.append(np.fromiter(counts.values(), np.int64, len(counts)))
                held += len(counts)
        if names:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return shelve(texts.mapInArrow(run, INDEX), ROW_GROUPS)


def _top_th(values: np.ndarray, top: int) -> int:
    return int(np.partition(values, len(values) - top)[len(values) - top]) if len(values) >= top else 0


class Batch:
    """Items that are searched together: their terms with weights, pairs, and each item's order.

    ``items`` holds (number, distinct terms).  An item's terms are ordered by weight, lightest first.
    """

    def __init__(self, items: list[tuple[int, list[str]]], weights: dict[str, int]):
        self.weight = [w for _, w in sorted(weights.items())]
        self.place = {t: i for i, t in enumerate(sorted(weights))}
        self.items = [(number, sorted((self.place[t] for t in terms if t in weights), key=lambda i: (self.weight[i], i))) for number, terms in items]
        couples = sorted({p for _, terms in self.items for p in zip(terms, terms[1:], strict=False)})
        self.couple = {p: i for i, p in enumerate(couples)}


def impact_index(index: DataFrame, batch: Batch, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """The impact index of a batch of items, written."""
    wanted, weight, couple = pa.array(sorted(batch.place), pa.string()), batch.weight, batch.couple

    def run(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # a block after the other, and of its terms only those of the items leave the Arrow columns
        for r in range(rows.num_rows):
            row = {name: rows.column(name).slice(r, 1) for name in rows.schema.names}
            length = np.array([10 + 90 * n * n_docs // n_terms for n in row["lens"][0].as_py()], np.int64) if n_terms else np.empty(0, np.int64)
            dfs = row["dfs"].flatten().to_numpy()
            ends = np.cumsum(dfs, dtype=np.int64)
            docs, tfs = np.frombuffer(row["docs"][0].as_buffer(), "<u4"), np.frombuffer(row["tfs"][0].as_buffer(), "<u4")
            place = pc.index_in(row["terms"].flatten(), value_set=wanted)
            lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i in np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False)).tolist():
                t, some = place[i].as_py(), slice(ends[i] - dfs[i], ends[i])
                d, tf = docs[some], tfs[some].astype(np.int64)
                lists[t] = d, weight[t] * (1_000_000_000 * tf // (1000 * tf + 8 * length[d]))
            pairs, pair_best, pair_kth = [], [], []
            for (a, b), number in couple.items():
                if a in lists and b in lists:
                    (da, ia), (db, ib) = sorted((lists[a], lists[b]), key=lambda x: len(x[0]))
                    spot = np.minimum(np.searchsorted(db, da), len(db) - 1)
                    both = db[spot] == da
                    if both.any():
                        joint = ia[both] + ib[spot[both]]
                        pairs.append(number)
                        pair_best.append(int(joint.max()))
                        pair_kth.append(_top_th(joint, top))
            own = [i for _, i in lists.values()]
            yield _row(
                IMPACTS, doc_ids=row["doc_ids"][0].as_py(), terms=list(lists), sizes=[len(i) for i in own],
                docs=b"".join(d.tobytes() for d, _ in lists.values()), impacts=b"".join(i.astype("<i8").tobytes() for i in own),
                best=[int(i.max()) for i in own], kth=[_top_th(i, top) for i in own], pairs=pairs, pair_best=pair_best, pair_kth=pair_kth,
            )

    return shelve(map_arrow(index, run, IMPACTS), ROW_GROUPS)


def _floors(impacts: DataFrame, key: str, value: str) -> dict[int, int]:
    """The largest ``value`` of any block by ``key``: at most one row per term or pair of the batch."""
    each = impacts.select(F.explode(F.arrays_zip(key, value)).alias("x")).select(F.col(f"x.{key}").alias("k"), F.col(f"x.{value}").alias("v"))
    return dict(map(tuple, each.filter("v > 0").groupBy("k").agg(F.max("v")).collect()))


def _best_of(block: dict, lists: dict, terms: list[int], bounds: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the block's documents that score at least ``least`` (and above 0)."""
    essential = next((j for j in range(len(terms)) if bounds[j + 1] >= least), len(terms))
    score = np.zeros(len(block["doc_ids"]), np.int64)
    for t in terms[essential:]:
        if t in lists:
            docs, impacts = lists[t]
            score[docs] += impacts
    alive = np.flatnonzero(score)
    for j in range(essential - 1, -1, -1):
        alive = alive[score[alive] + bounds[j + 1] >= least]
        if not len(alive):
            break
        if terms[j] in lists:
            docs, impacts = lists[terms[j]]
            spot = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
            here = docs[spot] == alive
            score[alive[here]] += impacts[spot[here]]
    alive = alive[score[alive] >= least]
    return alive, score[alive]


def prefix_bounds(terms: list[int], best: dict[int, int], couple: dict, pair_best: dict[int, int]) -> list[int]:
    """Upper bounds of what the first 0, 1, .. terms can add to a score in a block."""
    bounds = [0]
    for j, t in enumerate(terms):
        bound = bounds[j] + best.get(t, 0)
        if j:
            both = max(pair_best.get(couple[terms[j - 1], t], 0), best.get(terms[j - 1], 0), best.get(t, 0))
            bound = min(bound, bounds[j - 1] + both)
        bounds.append(max(bound, bounds[j]))
    return bounds


def search_batch(impacts: DataFrame, batch: Batch, top: int) -> DataFrame:
    """item, rank, doc_id, score of the batch's items, by the impact index."""
    by_term, by_pair = _floors(impacts, "terms", "kth"), _floors(impacts, "pairs", "pair_kth")
    items, couple = batch.items, batch.couple
    floor = [
        max([1, *(by_term.get(t, 0) for t in terms), *(by_pair.get(couple[p], 0) for p in zip(terms, terms[1:], strict=False))]) for _, terms in items
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = list(floor)
        found: dict[int, list[tuple[int, bool, int]]] = defaultdict(list)
        for rows in batches:
            for block in (rows.slice(r, 1).to_pylist()[0] for r in range(rows.num_rows)):
                ends = np.cumsum(block["sizes"], dtype=np.int64)
                docs, values = np.frombuffer(block["docs"], "<u4"), np.frombuffer(block["impacts"], "<i8")
                lists = {t: (docs[e - n : e], values[e - n : e]) for t, n, e in zip(block["terms"], block["sizes"], ends, strict=True)}
                best, pair_best = dict(zip(block["terms"], block["best"], strict=True)), dict(zip(block["pairs"], block["pair_best"], strict=True))
                names = block["doc_ids"]
                for k, (_, terms) in enumerate(items):
                    bounds = prefix_bounds(terms, best, couple, pair_best)
                    if bounds[-1] < least[k]:
                        continue
                    alive, score = _best_of(block, lists, terms, bounds, least[k])
                    if len(score) > top:
                        more = score >= _top_th(score, top)
                        alive, score = alive[more], score[more]
                    new = [(-int(s), names[d] is None, names[d] or 0) for d, s in zip(alive, score, strict=True)]
                    if new:
                        found[k] = sorted(found[k] + new)[:top]
                        if len(found[k]) == top:
                            least[k] = max(least[k], -found[k][-1][0])
        rows_ = [(items[k][0], None if missing else name, -less) for k, docs in found.items() for less, missing, name in docs]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows_, strict=True) if rows_ else ([], [], []))], ["item", "doc_id", "score"])

    hits = impacts.mapInArrow(run, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` best documents of each item.

    Every row of ``items`` is an item, also one whose item_id is null or repeated.  Items
    without terms, or whose terms no document holds, have no rows; null texts have no terms.
    Documents with a null doc_id come last among equal scores; rows with a repeated doc_id are
    documents of their own.  Equal rows of ``docs`` take a rank each.  Other columns are not read.

    The items pass through the driver in batches of about ``batch_terms`` terms, one pass over
    the index each; batches end in written tables, so that one at a time is held.
    """
    numbered = shelve(items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("item")))
    index = build_index(docs)
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_filled"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    spark, results = docs.sparkSession, []

    def run(batch_items: list[tuple[int, list[str]]]) -> None:
        wanted = spark.createDataFrame([(t,) for t in sorted({t for _, terms in batch_items for t in terms})], "term string")
        listed = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
        held = listed.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = {r["term"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in held}
        batch = Batch(batch_items, weights)
        results.append(shelve(search_batch(impact_index(index, batch, n_docs, n_terms, top), batch, top)))

    waiting, held = [], 0
    for row in numbered.select("item", "text").toLocalIterator():
        terms = sorted({t.decode() for t in terms_of(row["text"])})
        if waiting and held + len(terms) > batch_terms:
            run(waiting)
            waiting, held = [], 0
        if terms:
            waiting.append((row["item"], terms))
            held += len(terms)
    if waiting:
        run(waiting)
    empty = spark.createDataFrame([], "item long, doc_id long, score long, rank int")
    found = empty
    for table in results:
        found = found.unionByName(table)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
