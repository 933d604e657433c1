"""Mixing sources to target weights by entropy balancing (operator 12), DataFrame functions only.

Among all rates r of documents with 0 <= r <= ``most`` whose words add up to the target of
their source, the mix takes the one nearest to "every document once" in relative entropy,
the sum of r ln r - r.  Its dual is convex and has one multiplier per source, and gives
r = min(most, exp(multiplier * size / mean size)): rates tilted exponentially by size.  Each
Newton step of all sources at once is one grouped sum.  A step that would leave the bracket of
its root is replaced by the middle of the bracket.

The rate depends on (source, size) alone, so everything but the last step runs over
the table of such classes.  Copies are rounded to whole ones per class, down first, then
up by largest remainder as long as the target has room, then by size; a source misses its target
by less than the smallest document that may still be taken once more.  The copies of a
class are dealt evenly to its documents, in hash order.

Sums are exact decimals, so reruns and other partitionings agree to the last copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.tables import shelve
from strandweave.operators.numbering import with_row_index
from strandweave.session import BROADCAST_ROWS

WEIGHTS = (5, 2, 1)  # of the sources in code point order, repeating
MOST = 3  # copies of a document, and target words per word of a source
NEAR = 0.5  # words by which a source may miss its target before rounding
STEPS = 200  # Newton steps; the bracket is at the resolution of doubles far earlier

_EXACT = "decimal(38,6)"


class _Sources:
    """How a table with a row per source is kept: as one broadcast file while its counted rows allow."""

    def __init__(self, targets: DataFrame):
        self.few = targets.count() <= BROADCAST_ROWS

    def keep(self, table: DataFrame) -> DataFrame:
        return shelve(table.coalesce(1) if self.few else table)

    def side(self, table: DataFrame) -> DataFrame:
        return F.broadcast(table) if self.few else table


def _exact_sum(column):
    """A sum of doubles that does not depend on their order."""
    return F.sum(column.cast(_EXACT)).cast("double")


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, tie: the words of each whole text (null: 0).

    ``source`` is "=" and the source, or "" for null, so that it can be joined on.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", source.alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("tie"))


def source_targets(classes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of a (source, size, n) table.

    Sources in code point order, null last, take the weights in turn.  What exceeds ``most``
    times a source's size is shared anew among the others until none is above.  Each round is
    one aggregate over the sources.
    """
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ordered = with_row_index(sizes.withColumn("last", F.col("source") == ""), ["last", "source"], "rank")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = shelve(ordered.select("source", "source_size", turn.cast("double").alias("weight")))
    cap = (F.col("source_size") * most).cast("double")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0  # words per unit of weight of the sources below their cap
    while True:
        capped = cap <= F.col("weight") * share
        row = table.agg(
            F.sum(F.when(~capped, F.col("weight"))).alias("free"), F.sum(F.when(capped, F.col("source_size") * most)).alias("spent")
        ).first()
        if not row["free"]:
            break
        above = (total - (row["spent"] or 0)) / row["free"]
        if above <= share:
            break
        share = above
    return table.select("source", "source_size", F.least(cap, F.col("weight") * share).alias("target"))


def _tilted(most: int):
    """Rate of a class: exp(multiplier * size / mean), at most ``most``, and all of it at the cap."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(50.0)))))


def tilts(classes: DataFrame, targets: DataFrame, most: int = MOST, near: float = NEAR) -> DataFrame:
    """source, source_size, target, mean, full, multiplier: the dual solution of every source.

    ``full`` marks sources at their cap, whose multiplier is infinite.  Sources without words
    keep the multiplier 0.
    """
    words, kept = classes.filter("size > 0"), _Sources(targets)
    shape = words.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("_words"), F.sum("n").alias("_docs"), F.min("size").alias("_least"))
    start = targets.join(shape, "source", "left")
    mean, ratio = F.col("_words") / F.col("_docs"), F.col("target") / F.col("_words")
    # at the far end of the bracket every class is below, or every class at, its share
    far = F.when(ratio < 1, mean * F.log(ratio)).otherwise(mean * F.log(F.lit(float(most)))) / F.col("_least")
    full = F.coalesce(F.col("target") >= F.col("_words") * most, F.lit(False))
    state = kept.keep(
        start.select(
            "source", "source_size", "target", F.coalesce(mean, F.lit(1.0)).alias("mean"), full.alias("full"), F.lit(0.0).alias("multiplier"),
            F.coalesce(F.least(far, F.lit(0.0)), F.lit(0.0)).alias("lo"), F.coalesce(F.greatest(far, F.lit(0.0)), F.lit(0.0)).alias("hi"),
            (F.coalesce(F.col("_words"), F.lit(0)) == 0).alias("done"),
        )
    )
    for _ in range(STEPS):
        open_ = state.filter("not done and not full")
        at = words.join(kept.side(open_), "source")
        rate, size = _tilted(most), F.col("size").cast("double")
        slope = F.when(rate < most, rate * size * size / F.col("mean")).otherwise(0.0)
        sums = at.groupBy("source").agg(_exact_sum(F.col("n") * rate * size).alias("got"), _exact_sum(F.col("n") * slope).alias("slope"))
        step = state.join(kept.side(sums), "source", "left")
        miss = F.col("got") - F.col("target")
        lo = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("multiplier")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("multiplier") - miss / F.col("slope"))
        middle = (lo + hi) / 2
        over = F.col("done") | F.col("full") | (F.abs(miss) <= near) | (middle <= lo) | (middle >= hi)
        nxt = F.when((newton > lo) & (newton < hi), newton).otherwise(middle)
        state = kept.keep(
            step.select(
                "source", "source_size", "target", "mean", "full", F.when(over, F.col("multiplier")).otherwise(nxt).alias("multiplier"),
                F.when(over, F.col("lo")).otherwise(lo).alias("lo"), F.when(over, F.col("hi")).otherwise(hi).alias("hi"), over.alias("done"),
            )
        )
        if state.filter("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "full", "multiplier")


def class_copies(classes: DataFrame, tilted: DataFrame, most: int = MOST) -> DataFrame:
    """source, size, n, source_size, target, copies: whole copies of each (source, size) class.

    Rounded down, then one copy more for the largest remainders while the target has room,
    then for the largest sizes that still fit.  Each of these later rounds at least halves what
    is missing, so there are few.  At last the smallest document that may be taken once more is
    taken if that leaves the source nearer to its target.
    """
    kept = _Sources(tilted)
    joined = classes.join(kept.side(tilted), "source")
    exact = F.when(F.col("size") == 0, F.col("n")).otherwise(F.col("n") * _tilted(most))
    copies = F.least(F.floor(exact), F.col("n") * most).cast("long")
    columns = ["source", "source_size", "target", "size", "n"]
    table = shelve(joined.select(*columns, copies.alias("copies"), F.round(exact - F.floor(exact), 9).alias("rest")))

    def placed():
        taken = table.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        may = (F.col("size") > 0) & (F.col("copies") < F.col("n") * most)
        return table.join(kept.side(taken), "source").withColumn("room", F.col("target") - F.col("taken")).withColumn("may", may)

    order = [F.col("rest").desc(), F.col("size").desc()]
    while True:
        open_ = placed().withColumn("fits", F.col("may") & (F.col("size") <= F.col("room")))
        if open_.filter("fits").isEmpty():
            break
        before = Window.partitionBy("source").orderBy(F.col("fits").desc(), *order).rowsBetween(Window.unboundedPreceding, 0)
        upto = F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0)).over(before)
        more = (F.col("fits") & (upto <= F.col("room"))).cast("long")
        table = shelve(open_.select(*columns, (F.col("copies") + more).alias("copies"), "rest"))
        order = [F.col("size").desc()]
    last = placed().withColumn("least", F.min(F.when(F.col("may"), F.col("size"))).over(Window.partitionBy("source")))
    nearer = F.col("may") & (F.col("size") == F.col("least")) & (F.col("size") - F.col("room") < F.col("room"))
    return last.select(*columns, (F.col("copies") + F.coalesce(nearer, F.lit(False)).cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes of each document.

    A null source is one of its own, after all others.  A null or empty text has no words and
    takes none; a table without words has targets of 0.  Rows with a null or repeated doc_id
    are documents of their own; among equal rows the extra copy goes to any.  Other columns
    of ``docs`` are not read.
    """
    sizes = shelve(word_sizes(docs))
    classes = shelve(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    copies = class_copies(classes, tilts(classes, source_targets(classes, weights, most), most), most)
    # even shares first; only documents of classes that leave a remainder have to be ranked
    named = copies.select("source", "size", "source_size", "target", F.expr("copies div n").alias("each"), (F.col("copies") % F.col("n")).alias("extra"))
    placed = shelve(sizes.join(named, ["source", "size"]))
    whole, split = placed.filter("extra = 0 or size = 0"), placed.filter("extra > 0 and size > 0")
    ranked = with_row_index(split, ["tie", "doc_id"], "rank", ["source", "size"])
    more = (F.col("rank") < F.col("extra")).cast("long")
    columns = ["doc_id", "size", "source_size", "target"]
    return whole.select(*columns, (F.col("each") * F.col("size")).alias("taken")).unionByName(
        ranked.select(*columns, ((F.col("each") + more) * F.col("size")).alias("taken"))
    )
