"""Embedding near-duplicates by int8 tile products with error bounds (operator 9).

A unit vector u is stored as ``u = s * q + e`` with q in -127..127 and the length of e known
exactly.  For two vectors ``|cos - s1 * s2 * (q1 . q2)| <= |s1 * q1| * |e2| + |e1|``, so one integer
matrix product per pair of tiles rules out all pairs whose bound stays below the threshold;
the others are computed in double precision from the vectors themselves.

Vectors of one label and length are dealt into tiles by a hash of their id; a pair of tiles is
one task's group, so the largest label spreads like any other and a group is two tiles at
most.  A group returns counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.tables import shelve
from strandweave.operators.graph import components

THRESHOLD = 0.98
TILE = 2048
ROWS = 512  # rows of a product held at once
EXACT_DIMS = 1000  # 127 * 127 * 1000 < 2**24: sums stay exact in single precision


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, length of s * q, length of the error) of the rows' directions."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None])
    near = q * s[:, None]
    return q.astype(np.int8), s, np.linalg.norm(near, axis=1), np.linalg.norm(u - near, axis=1)


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) with cosine of at least ``threshold``; i < j if both are one tile."""
    qa, sa, la, ea = quantise(a)
    qb, sb, _, eb = quantise(b)
    kind = np.float32 if a.shape[1] <= EXACT_DIMS else np.float64
    right = qb.astype(kind).T
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    found_i, found_j = [], []
    for at in range(0, len(a), ROWS):
        rows = slice(at, at + ROWS)
        most = (qa[rows].astype(kind) @ right).astype(np.float64) * (sa[rows, None] * sb[None, :])
        most += la[rows, None] * eb[None, :] + ea[rows, None]
        i, j = np.nonzero(most >= threshold - 1e-9)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            cosine = np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y])
            found_i.append(x[cosine >= threshold])
            found_j.append(y[cosine >= threshold])
    return np.concatenate([*found_i, np.zeros(0, np.int64)]), np.concatenate([*found_j, np.zeros(0, np.int64)])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def embedding_components(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label, ..).

    Only vectors of one label link.  A vector without a label, null, empty, zero or with a null or
    non-finite component links with nothing, nor do vectors of different lengths.  Every row is a
    vector, also one whose vec_id is repeated; all rows of a component with its smallest vec_id
    are kept.  A row with a null vec_id has a null component and links with nothing.  Other
    columns are not read.
    """
    numbered = F.monotonically_increasing_id().alias("row")
    rows = shelve(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"), numbered))
    # x - x is 0 for finite x only; a null component makes the test null
    finite = F.forall("embedding", lambda x: F.coalesce((x - x) == 0, F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    usable = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    usable = usable.select("row", "label", "embedding", F.size("embedding").alias("dims"))
    tiles = usable.groupBy("label", "dims").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = usable.join(tiles, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one = group["own"].to_numpy() == group["lo"].to_numpy()
        ids = group["row"].to_numpy()
        all_rows = np.stack(group["embedding"].to_numpy()).astype(np.float64)
        # a power of two keeps every direction and takes lengths off the ends of the range
        all_rows = np.ldexp(all_rows, -np.frexp(np.abs(all_rows).max(axis=1))[1][:, None])
        if group["lo"].iat[0] == group["hi"].iat[0]:
            i, j = tile_links(all_rows, all_rows, threshold, True)
        else:
            a, b = np.flatnonzero(one), np.flatnonzero(~one)
            i, j = tile_links(all_rows[a], all_rows[b], threshold, False) if len(a) and len(b) else (a[:0], b[:0])
            i, j = a[i], b[j]
        n_links = np.bincount(np.concatenate([i, j]), minlength=len(ids))
        root = _roots(len(ids), i, j)
        hit = n_links > 0
        return pd.DataFrame({"row": ids[hit], "n": n_links[hit], "root": ids[root[hit]]})

    found = shelve(dealt.groupBy("label", "dims", "lo", "hi").applyInPandas(compare, "row long, n long, root long"))
    counts = found.groupBy("row").agg(F.sum("n").alias("n"))
    linked = components(found.filter("row <> root").select(F.col("row").alias("a"), F.col("root").alias("b")), "a", "b")
    linked = linked.select(F.col("node_id").alias("row"), "comp").join(counts, "row")
    every = shelve(rows.select("row", "vec_id").join(linked, "row", "left"))
    named = every.filter("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("smallest"))
    component = F.coalesce("smallest", "vec_id")
    return every.join(named, "comp", "left").select(
        "vec_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
