"""Telomere regions at walk ends, their motifs and nodes, and chopping walks there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandweave.operators.numbering import lookup_side, running_max_before, with_row_index
from strandweave.operators.walks import nodes_at, walk_sizes

_PAIR = str.maketrans("ACGT", "TGCA")
SCAN_WIDTH = 512


def _reverse_complement(word: str) -> str:
    return word[::-1].translate(_PAIR)


def rotations(motif: str) -> list[str]:
    return sorted({motif[i:] + motif[:i] for i in range(len(motif))})


def _check_motif(motif: str) -> None:
    if any(motif[:n] == motif[-n:] for n in range(1, len(motif))):
        raise ValueError("motif overlaps itself; occurrences would not be countable independently")


def motif_hits(lines: DataFrame, motifs: tuple[str, str], width: int = SCAN_WIDTH) -> DataFrame:
    """walk_id, at, word: every window equal to a rotation of a motif or its reverse.

    ``lines`` are contig lines of ``width`` bases, so a long contig is searched by many
    tasks; only hits leave the search.  The lines of a batch are compared as one byte array.
    """
    for motif in motifs:
        _check_motif(motif)
    if len({len(m) for m in motifs}) != 1:
        raise ValueError("both motifs must have the same length")
    m = len(motifs[0])
    words = sorted({w for x in motifs for y in (x, _reverse_complement(x)) for w in rotations(y)})
    following = lines.select("contig_id", (F.col("line") - 1).alias("line"), F.left("bases", F.lit(m - 1)).alias("_next"))
    text = lines.join(following, ["contig_id", "line"], "left").select(
        "contig_id", "line", F.concat("bases", F.coalesce("_next", F.lit(""))).alias("t")
    )
    id_field = lines.schema["contig_id"]
    schema = StructType([StructField("walk_id", id_field.dataType), StructField("at", LongType()), StructField("word", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode("ascii", "replace") for x in batch.column(2).to_pylist()]
            row, off, which = find_words(texts, words)
            at = batch.column(1).to_numpy()[row] * width + off
            found = [batch.column(0).take(pa.array(row)), pa.array(at, pa.int64()), pa.array(words).take(pa.array(which))]
            yield pa.RecordBatch.from_arrays(found, schema.names)

    return text.mapInArrow(run, schema)


def find_words(texts: list[bytes], words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, offset, word) numbers of every occurrence, overlapping ones too; the words have one length.

    All texts are compared at once; the zero byte between two is in no word.
    """
    m = len(words[0])
    flat = np.frombuffer(b"\0".join(texts) + b"\0" * m, np.uint8)
    starts = np.cumsum([0, *[len(x) + 1 for x in texts[:-1]]])
    n = len(flat) - m
    at = [np.flatnonzero(np.logical_and.reduce([flat[k : n + k] == ord(c) for k, c in enumerate(w)])) for w in words]
    which = np.repeat(np.arange(len(words)), [len(a) for a in at])
    every = np.concatenate(at)
    row = np.searchsorted(starts, every, "right") - 1
    return row, every - starts[row], which


def contig_sizes(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("contig_id").alias("walk_id")).agg(F.sum(F.length("bases")).alias("size"))


def telomere_regions(
    hits: DataFrame,
    sizes: DataFrame,
    motifs: tuple[str, str],
    min_score: int = 300,
    penalty: int = 1,
    max_drop: int = 2000,
) -> DataFrame:
    """walk_id, motif_no, side, start, end (exclusive) of telomeric contig ends.

    From the left end rotations of the motif, from the right end rotations of its reverse
    complement score 1 per window and other windows cost ``penalty``; the scan ends once
    the score falls more than ``max_drop`` below its best.  The region reaches to the best
    score if that is at least ``min_score``.  Between hits the score only falls, so hits
    alone decide, scanned in blocks.
    """
    m = len(motifs[0])
    sided = []
    for no, motif in enumerate(motifs):
        for side, words in (("start", rotations(motif)), ("end", rotations(_reverse_complement(motif)))):
            sided.append(
                F.when(F.col("word").isin(*words), F.struct(F.lit(no).alias("motif_no"), F.lit(side).alias("side")))
            )
    marked = hits.select("walk_id", "at", F.explode(F.filter(F.array(*sided), lambda s: s.isNotNull())).alias("s"))
    marked = marked.join(lookup_side(sizes), "walk_id").select(
        "walk_id",
        "s.motif_no",
        "s.side",
        "size",
        F.when(F.col("s.side") == "start", F.col("at")).otherwise(F.col("size") - m - F.col("at")).alias("step"),
    )
    key = ["walk_id", "motif_no", "side"]
    ranked = with_row_index(marked, ["step"], "rank", key)
    before = F.col("rank") - F.lit(penalty) * (F.col("step") - F.col("rank"))
    scored = running_max_before(ranked.withColumn("score", before + 1), key, "rank", {"best": "score"})
    dropped = F.greatest(F.coalesce("best", F.lit(0)), F.lit(0)) - (F.col("score") - 1) > max_drop
    stops = scored.filter(dropped).groupBy(*key).agg(F.min("rank").alias("stop"))
    reached = scored.join(lookup_side(stops), key, "left").filter("stop is null or rank < stop")
    best = reached.groupBy(*key, "size").agg(
        F.max("score").alias("top"), F.max_by("step", F.struct(F.col("score"), -F.col("rank"))).alias("step")
    )
    reach = F.col("step") + m
    return best.filter(F.col("top") >= min_score).select(
        *key,
        F.when(F.col("side") == "start", F.lit(0)).otherwise(F.col("size") - reach).alias("start"),
        F.when(F.col("side") == "start", reach).otherwise(F.col("size")).alias("end"),
    )


def type_regions(regions: DataFrame, hits: DataFrame, motifs: tuple[str, str]) -> DataFrame:
    """Add ``motif``: '+' if the first motif occurs more often within the region, else '-'.

    The last base of a region is left out, as is done for its node.
    """
    m = len(motifs[0])
    region = ["walk_id", "motif_no", "side", "start", "end"]  # an external list may hold several per side
    exact = hits.filter(F.col("word").isin(*motifs))
    counted = (
        exact.join(lookup_side(regions), "walk_id")
        .filter((F.col("at") >= F.col("start")) & (F.col("at") + m <= F.col("end") - 1))
        .groupBy(*region)
        .agg(F.count_if(F.col("word") == motifs[0]).alias("c1"), F.count_if(F.col("word") == motifs[1]).alias("c2"))
    )
    joined = regions.join(counted, region, "left")
    c1, c2 = F.coalesce("c1", F.lit(0)), F.coalesce("c2", F.lit(0))
    return joined.select(*regions.columns, c1.alias("c1"), c2.alias("c2"), F.when(c1 > c2, "+").otherwise("-").alias("motif"))


def region_nodes(typed: DataFrame, placed: DataFrame) -> DataFrame:
    """walk_id, start_node, end_node, motif; the first region of a start node wins.

    Regions of the first motif come first, within a motif the left end.
    """
    ends = F.array(
        F.struct(F.lit("s").alias("which"), F.col("start").alias("at")),
        F.struct(F.lit("e").alias("which"), (F.col("end") - 1).alias("at")),
    )
    points = typed.select(
        "walk_id",
        F.struct("motif_no", F.when(F.col("side") == "start", 0).otherwise(1).alias("o"), F.col("start").alias("left")).alias("ord"),
        "motif",
        F.explode(ends).alias("p"),
    ).select("walk_id", "ord", "motif", "p.which", "p.at")
    found = nodes_at(points, placed)
    regions = found.groupBy("walk_id", "ord", "motif").agg(
        F.max(F.when(F.col("which") == "s", F.col("node_id"))).alias("start_node"),
        F.max(F.when(F.col("which") == "e", F.col("node_id"))).alias("end_node"),
    )
    return (
        regions.groupBy("walk_id", "start_node")
        .agg(F.min_by(F.struct("end_node", "motif"), "ord").alias("r"))
        .select("walk_id", "start_node", "r.end_node", "r.motif")
    )


def telomere_events(walks: DataFrame, regions: DataFrame) -> DataFrame:
    """walk_id, lo, hi, motif: walk positions covered each time a region's start is met."""
    at_start = walks.join(
        lookup_side(regions.withColumnRenamed("start_node", "node_id")), ["walk_id", "node_id"]
    ).select("walk_id", F.col("pos").alias("lo"), "end_node", "motif")
    ends = walks.select("walk_id", F.col("node_id").alias("end_node"), "pos")
    return (
        ends.join(lookup_side(at_start), ["walk_id", "end_node"])
        .filter("pos >= lo")
        .groupBy("walk_id", "lo", "motif")
        .agg(F.min("pos").alias("hi"))
    )


def chop_pieces(events: list[tuple[int, int, str]], size: int) -> list[tuple[int, int, str | None, str | None]]:
    """Pieces (lo, hi, start motif, end motif) of one walk from its ordered events."""
    pieces, begin, opened, done = [], 0, None, 0
    for lo, hi, motif in sorted(events):
        if lo < done:
            continue  # swallowed by the region before
        if opened is None:
            if lo > begin:
                pieces.append((begin, hi, None, motif))
                begin = hi + 1
            else:
                opened = motif
        elif opened == motif:
            pieces.append((begin, lo - 1, opened, None))
            begin = lo
        else:
            pieces.append((begin, hi, opened, motif))
            begin, opened = hi + 1, None
        done = hi + 1
    if begin < size:
        pieces.append((begin, size - 1, opened, None))
    return pieces


def chop_walks(walks: DataFrame, events: DataFrame):
    """(walks, telo_ref) with new walk ids in (old walk, piece) order.

    Only the few events of a walk are grouped; its nodes follow by a range join.
    """
    sizes = walk_sizes(walks)
    told = sizes.join(events, "walk_id")

    def cut_walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = chop_pieces(list(zip(pdf["lo"], pdf["hi"], pdf["motif"])), int(pdf["n"].iloc[0]))
        out = pd.DataFrame(rows, columns=["lo", "hi", "start", "end"])
        out.insert(0, "walk_id", pdf["walk_id"].iloc[0])
        return out

    chopped = told.groupBy("walk_id").applyInPandas(cut_walk, "walk_id long, lo long, hi long, start string, end string")
    none = F.lit(None).cast("string")
    whole = sizes.join(events.select("walk_id").distinct(), "walk_id", "left_anti").select(
        "walk_id", F.lit(0).cast("long").alias("lo"), (F.col("n") - 1).alias("hi"), none.alias("start"), none.alias("end")
    )
    pieces = with_row_index(chopped.unionByName(whole), ["walk_id", "lo"], "new_id")
    new_walks = (
        walks.join(lookup_side(pieces), "walk_id")
        .filter("pos between lo and hi")
        .select(F.col("new_id").alias("walk_id"), (F.col("pos") - F.col("lo")).alias("pos"), "node_id")
    )
    return new_walks, pieces.select(F.col("new_id").alias("walk_id"), "start", "end")


def no_telomeres(walks: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return walks.select("walk_id").distinct().select("walk_id", none.alias("start"), none.alias("end"))


def motif_totals(telo_ref: DataFrame) -> DataFrame:
    plus = F.count_if(F.col("start") == "+") + F.count_if(F.col("end") == "+")
    minus = F.count_if(F.col("start") == "-") + F.count_if(F.col("end") == "-")
    return telo_ref.agg(plus.alias("plus"), minus.alias("minus"))
