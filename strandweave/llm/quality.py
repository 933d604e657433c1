"""Quality classifier with hierarchical empirical Bayes (operator 1).

Evidence.  A logistic regression on counts of a text (words, distinct and repeated words, capitals,
signs, lines) is fitted on at most ``SAMPLE`` labelled documents, the first by a hash of
the id; its log odds less those of the prior are a document's evidence.

Sites.  Hosts and paths below them get Beta posteriors from the documents' own probabilities.
A host is shrunk to the global mean with a weight found from the spread of the hosts' means
(method of moments), a path to its host likewise.  A document's own share is taken out of
its path and its host, so it is not counted twice: a host's only document has the global mean.  All of this is grouped sums with map-side combining; a
host with a third of all documents is one row of sums.

The final log odds add the evidence to those of the path's posterior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.tables import map_arrow, shelve
from strandweave.llm.wordhash import line_spans, slices, span_hashes, text_bytes, words

SAMPLE = 20_000
FEATURES = 9


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text; an empty text has zeros."""
    data, off = text_bytes(column)
    out = np.zeros((len(off) - 1, FEATURES))
    kind = np.zeros(256, np.int8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 3, 2
    kind[[9, 10, 11, 12, 13, 32]] = 4
    for i, j in slices(off):
        part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
        hashes, first = words(part, at)
        kinds = kind[part]
        totals = [np.concatenate([[0], np.cumsum(kinds == k)])[at] for k in range(5)]
        start, end, line_first = line_spans(part, at)
        lines = span_hashes(part, start, end, False)
        for d in range(j - i):
            h = hashes[first[d] : first[d + 1]]
            n = len(h)
            if not n:
                continue
            size = at[d + 1] - at[d]
            sign, upper, lower, digit, _ = (t[d + 1] - t[d] for t in totals)
            u, c = np.unique(h, return_counts=True)
            rows = lines[line_first[d] : line_first[d + 1]]
            out[i + d] = (
                np.log1p(n), len(u) / n, c.max() / n, np.count_nonzero(h[1:] == h[:-1]) / n, upper / max(1, upper + lower),
                sign / size, digit / size, len(np.unique(rows)) / len(rows), min(size / n, 30) / 10,
            )
    return out


def design(x: np.ndarray) -> np.ndarray:
    """Intercept, the features, their squares and the features cut at low values."""
    return np.column_stack([np.ones(len(x)), x, x * x, np.sqrt(np.abs(x))])


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    z = design(x)
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (y - p) - penalty * np.r_[0, beta[1:]]
        hessian = (z * (p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(beta))
        step = np.clip(np.linalg.solve(hessian, gradient), -3, 3)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """(coefficients, log odds of the prior) from ``labels`` (doc_id, quality).

    Documents labelled both ways count as good; null ids and labels do not count.  Without labels of
    both classes there is no evidence and the prior is 1/2.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    picked = known.agg(F.max(F.col("quality").cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = text_features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    rows = map_arrow(texts.join(F.broadcast(picked), "doc_id").select("text", "y"), run, "y int, x array<double>").collect()  # ``sample`` rows
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return np.zeros(design(np.zeros((1, FEATURES))).shape[1]), 0.0
    prior = y.mean()
    return fit(np.array([r["x"] for r in rows]), y), float(np.log(prior / (1 - prior)))


def quality_scores(docs: DataFrame, labels: DataFrame, host: str = "source", path: tuple[str, ...] = ("source", "lang"), sample: int = SAMPLE) -> DataFrame:
    """doc_id, evidence, host_quality, path_quality, quality, keep per row of ``docs``.

    ``host`` and ``path`` name columns; a null in them is a site of its own.  A null or empty text
    has the evidence of a text without words.  Repeated rows and null ids give rows of their own, each
    counting for its site; an empty table gives none.
    """
    beta, prior = learn(docs, labels, sample)
    site = lambda cols: F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)]))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), site((host,)).alias("host"), site(path).alias("path"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        odds = design(text_features(batch.column("text"))) @ beta
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "host", "path")] + [pa.array(np.clip(odds, -12, 12))], ["doc_id", "host", "path", "odds"])

    rows = shelve(map_arrow(source, run, "doc_id long, host string, path string, odds double").withColumn("p", 1 / (1 + F.exp(-F.col("odds")))))
    by_path = shelve(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v")))
    by_host = by_path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.sum("v").alias("host_v"))
    all_n, all_s = by_host.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = F.lit(all_s / all_n if all_n else 0.5)
    host_weight = F.lit(_weight(by_host, F.col("host_s") / F.col("host_n"), F.col("host_n"), F.col("host_v"), mean))
    host_mean = (F.col("host_s") + host_weight * mean) / (F.col("host_n") + host_weight)
    paths = by_path.join(by_host.select("host", "host_n", "host_s", host_mean.alias("host_mean")), "host")
    weight = F.lit(_weight(paths, F.col("s") / F.col("n"), F.col("n"), F.col("v"), F.col("host_mean")))
    joined = rows.join(paths.select("path", "n", "s", "host_n", "host_s"), "path")
    # both posteriors come from the other documents of the site only
    host_quality = (F.col("host_s") - F.col("p") + host_weight * mean) / (F.col("host_n") - 1 + host_weight)
    others = (F.col("s") - F.col("p") + weight * F.col("host_quality")) / (F.col("n") - 1 + weight)
    path_quality = F.least(F.greatest(others, F.lit(1e-4)), F.lit(1 - 1e-4))
    evidence = F.col("odds") - F.lit(prior)
    final = evidence + F.log(F.col("path_quality") / (1 - F.col("path_quality")))
    named = joined.withColumn("host_quality", host_quality).withColumn("path_quality", path_quality).withColumn("quality", 1 / (1 + F.exp(-final)))
    return named.select("doc_id", evidence.alias("evidence"), "host_quality", "path_quality", "quality", (F.col("quality") >= 0.5).alias("keep"))


def _weight(sites: DataFrame, mean, n, v, centre) -> float:
    """The pseudo-count of the prior, by moments of the sites' means around ``centre``.

    The squared distances exceed the means' own variance by the variance between sites; centre
    (1 - centre) over it, less 1, is the count, kept between 1 and 10,000.
    """
    between = F.sum(n * (mean - centre) * (mean - centre)) / F.sum(n) - F.sum(v / n) / F.sum(n)
    level = F.sum(n * centre * (1 - centre)) / F.sum(n)
    count = level / F.greatest(between, F.lit(1e-9)) - 1
    return sites.agg(F.coalesce(F.least(F.greatest(count, F.lit(1.0)), F.lit(1e4)), F.lit(1.0))).first()[0]
