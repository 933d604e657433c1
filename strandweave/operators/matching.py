"""Score-greedy steps: the best step first, every walk and ghost used once.

Taking steps in the order of their scores, each if its start, ghost and target are still free, is
sequential only in appearance: a step that is the best one left at its start, at its ghost and at its
target is taken whatever happens elsewhere.  So all such steps are taken in one round, what
they use up leaves, and the next best steps move up.  Rounds follow chains of ever better
neighbours, of which random scores leave a logarithmic number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.numbering import with_row_index
from strandweave.session import cut, stack

ENDS = ("src", "ghost", "dst")


def greedy_steps(steps: DataFrame) -> DataFrame:
    """The steps (src, ghost, dst, score) that are taken; the higher score first, then the smaller ids.

    Steps without a score (null) come last.
    """
    rank = F.struct(F.isnull("score").alias("none"), F.negative("score").alias("less"), *ENDS)
    left = cut(steps.select(*ENDS, "score").withColumn("rank", rank))
    taken: list[DataFrame] = []
    while not left.isEmpty():
        best = left
        for end in ENDS:
            best = best.join(left.groupBy(end).agg(F.min("rank").alias(f"best_{end}")), end)
        won = cut(best.filter(reduce(lambda a, b: a & b, [F.col("rank") == F.col(f"best_{e}") for e in ENDS])).select(*ENDS, "score"))
        stack(taken, won)
        for end in ENDS:
            left = left.join(won.select(end), end, "left_anti")
        left = cut(left.select(*ENDS, "score", "rank"))
    return reduce(DataFrame.unionByName, taken) if taken else steps.select(*ENDS, "score").limit(0)


def _ahead(reach: DataFrame) -> DataFrame:
    """One round of pointer jumping: twice the way, with its length and the smallest walk on it."""
    far = reach.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("gap").alias("more"), F.col("least").alias("less"), F.col("done").alias("far_done"))
    joined = reach.join(far, "to")
    return cut(joined.select("node", F.col("far").alias("to"), (F.col("gap") + F.col("more")).alias("gap"), F.least("least", "less").alias("least"), F.col("far_done").alias("done")))


def chains(taken: DataFrame) -> DataFrame:
    """walk_id, pos, node_id: taken steps as walks that alternate walks and ghosts.

    Every walk is left and entered once at most, so steps form paths and rings; a ring is
    opened before its smallest walk.  Each walk finds its path's start and its distance by pointer
    jumping, so a path of n walks takes log n rounds.  Numbers follow the starts' ids.
    """
    steps = cut(taken.select("src", "ghost", "dst"))
    nodes = steps.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    back = nodes.join(steps.select(F.col("dst").alias("node"), F.col("src").alias("before")), "node", "left")
    first = F.col("before").isNull()
    reach = cut(
        back.select("node", F.coalesce("before", "node").alias("to"), F.when(first, 0).otherwise(1).cast("long").alias("gap"), F.least("node", "before").alias("least"), first.alias("done"))
    )
    waiting = reach.filter("not done").count()
    while waiting:
        reach = _ahead(reach)
        left = reach.filter("not done").count()
        if left == waiting:  # on a path some walk would have arrived
            break
        waiting = left
    if waiting:
        ring = cut(reach.filter("not done"))
        while True:
            wider = _ahead(ring)
            same = wider.select("node", F.col("least").alias("now")).join(ring, "node").filter("now <> least").isEmpty()
            ring = wider
            if same:
                break
        opened = ring.filter("node = least").select(F.col("node").alias("dst"))
        return chains(steps.join(opened, "dst", "left_anti"))
    ids = with_row_index(reach.filter("gap = 0").select("to"), ["to"], "walk_id")
    placed = cut(reach.select("node", "to", "gap").join(ids, "to"))
    walks = placed.select("walk_id", (F.col("gap") * 2).alias("pos"), F.col("node").alias("node_id"))
    ghosts = placed.join(steps.select(F.col("src").alias("node"), "ghost"), "node")
    return walks.unionByName(ghosts.select("walk_id", (F.col("gap") * 2 + 1).alias("pos"), F.col("ghost").alias("node_id")))
