"""Sampling edges with replacement from one global pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators.baseline import MIN_START_SCORE
from strandweave.operators.numbering import running_sum_before, with_row_index
from strandweave.session import cut

BUCKET = 1 << 16
# Modulus and factors of the two generators (multiplicative, modulo 2^31 - 1).
MODULUS, FACTORS = 2_147_483_647, (48_271, 69_621)


def ticket(draw: Column, seed: int) -> Column:
    """62 pseudo-random bits of a draw: both generators, three steps from its own start each."""
    halves = []
    for factor, offset in zip(FACTORS, (1, 7), strict=True):
        x = (draw + F.lit(seed) * F.lit(1_000_003) + F.lit(offset)) % F.lit(MODULUS)
        for _ in range(3):
            x = x * F.lit(factor) % F.lit(MODULUS)
        halves.append(x)
    return halves[0] * F.lit(1 << 31) + halves[1]


def sample_edges(edges: DataFrame, n: int, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """draw, edge_id, src, dst: ``n`` independent uniform draws among edges that may start a walk.

    Eligible are all edges whose probability is not zero in single precision.  The eligible
    edges in the order of ``edge_id`` are the pool.  It is never sorted: a histogram over ranges
    of ids gives the range that holds a draw and the rank inside it, and only the ranges that were
    drawn, of at most ``bucket`` edges each, are ranked.  An empty pool fails the query.
    """
    spark = edges.sparkSession
    pool = edges.filter(F.col("score") > MIN_START_SCORE).select("edge_id", "src", "dst", F.expr(f"edge_id div {bucket}").alias("range"))
    counts = pool.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    starts = cut(running_sum_before(with_row_index(counts, ["range"], "pos"), [], "pos", {"start": "n"}))
    total = starts.agg(F.sum("n")).first()[0]
    if not total:
        raise ValueError("no edge with a probability above zero")
    place = ticket(F.col("id"), seed) % F.lit(total)
    draws = spark.range(n).select(F.col("id").alias("draw"), place.alias("place"), F.floor(place / bucket).cast("long").alias("cell"))
    # a range covers at most two cells of as many places
    cells = starts.select("range", "start", "n", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("n") - 1) / bucket))).alias("cell"))
    met = cells.join(draws, "cell").filter("place >= start and place < start + n")
    drawn = cut(met.select("draw", "range", (F.col("place") - F.col("start")).alias("rank")))
    some = pool.join(drawn.select("range").distinct(), "range", "left_semi")
    ranked = with_row_index(some, ["edge_id"], "rank", ["range"])
    return ranked.join(drawn, ["range", "rank"]).select("draw", "edge_id", "src", "dst")
