"""Toxicity by a weighted lexicon matched with Aho-Corasick (operator 6).

Texts are folded first: lower case, accents and look-alike letters of other scripts to Latin
ones, digits and signs inside a word to the letters they stand for.  The lexicon holds words
and beginnings of words with weights learned from labelled texts (log odds of occurring in a
toxic text).  One pass of an Aho-Corasick automaton finds them all; each word counts its
best entry, and hits inside an exception phrase do not count.  The sum is normalised by the text's
length, and a logistic curve fitted on other labelled texts turns it into a score.

Learning takes at most ``PER_CLASS`` labelled texts of either class, the first by a hash of the
id; half of them, by another hash, make the lexicon and half fit the curve.  The curve's intercept
is moved to the share of toxic labels among all labels that may be used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandweave.llm.tables import map_arrow, unused

PER_CLASS = 6000
STEMS = (5, 6, 7, 8)  # letters of a beginning

# Letters of other scripts that look like Latin ones, and what digits and signs stand for.
LOOKALIKES = dict(zip("аеіјкмнорсту хѕԁԛԝαβεηικνορτυχγ", "aeijkmhopcty xsdqwabenikvoptuxy", strict=True))
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"})


def _folds() -> dict[int, str]:
    table = {}
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))
        if bare != chr(c):
            table[c] = bare.lower()
    table |= {ord(k): v for k, v in LOOKALIKES.items() if k != " "}
    table |= dict.fromkeys([0xAD, *range(0x200B, 0x2010), 0x2060, 0xFEFF, *range(0x300, 0x370)], "")
    return table | {ord("ß"): "ss", ord("ı"): "i", ord("ø"): "o", ord("ł"): "l", ord("đ"): "d"}


_FOLD = _folds()
_TOKEN = re.compile(r"[\w@$!|]+")
_SIGNS = "@$!|_"


def fold(text: str | None) -> list[str]:
    """The folded words of a text, without bare numbers and signs."""
    if not text:
        return []
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    out = []
    for token in _TOKEN.findall(low):
        if token.isalpha():
            out.append(token)
            continue
        token = token.strip(_SIGNS)
        if token.isalpha():
            out.append(token)
        elif any(c.isalpha() for c in token):
            out.append(token.translate(SUBSTITUTES))
    return out


def terms(words: list[str]) -> set[str]:
    """Candidate entries of a text: `` word `` and `` beginn``."""
    distinct = set(words)
    found = {f" {w} " for w in distinct}
    for n in STEMS:
        found.update(f" {w[:n]}" for w in distinct if len(w) > n)
    return found


class Lexicon:
    """Weighted entries, exception phrases and the curve; a plain value sent to the tasks."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], curve: np.ndarray):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def features(self, words: list[str], automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
        """(log of the summed weight, weight per word, words hit) without excepted hits."""
        text = f" {' '.join(words)} "
        best: dict[int, float] = {}
        excepted = []
        if len(automaton):
            for end, (size, weight) in automaton.iter(text):
                at = end - size + 1
                if weight is None:
                    excepted.append((at, end))
                elif weight > best.get(at, 0.0):
                    best[at] = weight
        hits = [w for at, w in best.items() if not any(a <= at < b for a, b in excepted)]
        total = sum(hits)
        return math.log1p(total), total / (len(words) + 20), math.log1p(len(hits))

    def score(self, words: list[str], automaton: ahocorasick.Automaton) -> float:
        z = self.curve[0] + float(np.dot(self.curve[1:], self.features(words, automaton)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2) -> np.ndarray:
    """Logistic regression with a small ridge, by Newton steps; classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty * np.r_[0, beta[1:]]
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon and curve from ``labels`` (doc_id, toxic), all of which may be used.

    A document labelled both ways counts as toxic; rows with a null id or label do not count.
    Without labels of both classes every score is the share of toxic labels (0 without any).
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).head()
    picked = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionAll(picked[1]))  # 2 * per_class rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n = (Counter(), Counter())
        for name, text, y in zip(batch.column("doc_id"), batch.column("text"), batch.column("toxic"), strict=True):
            if _half(name.as_py()):
                n[y.as_py()].update(terms(fold(text.as_py())))
                n[y.as_py()][""] += 1
        rows = sorted(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), *(pa.array([c[t] for t in rows], pa.int64()) for c in n)], ["term", "n0", "n1"])

    counts = map_arrow(texts, count, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    size = {"n0": 0, "n1": 0}
    heavy = counts.filter("n1 >= 3 and n1 > n0 / 4 or term = ''").collect()  # terms of ``per_class`` texts
    for row in heavy:
        if row["term"] == "":
            size = {"n0": row["n0"], "n1": row["n1"]}
    prior = (share["t"] or 0) / share["n"] if share["n"] else 0.0
    if not size["n0"] or not size["n1"]:
        flat = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Lexicon({}, list(exceptions), np.array([flat, 0.0, 0.0, 0.0]))
    weights = {}
    for row in heavy:
        rate1, rate0 = (row["n1"] + 0.1) / (size["n1"] + 0.2), (row["n0"] + 0.5) / (size["n0"] + 1)
        spread = math.sqrt(1 / row["n1"] + 1 / (row["n0"] + 0.5)) if row["term"] else 0
        weight = math.log(rate1 / rate0) - spread if row["term"] else 0
        if weight > 0.7:
            weights[row["term"]] = weight
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0])))
    draft = Lexicon(weights, list(exceptions), np.zeros(4))
    phrases, x, y = _second_half(texts, draft)
    draft.exceptions = sorted({*exceptions, *phrases})
    if len(set(y)) < 2:
        flat = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return Lexicon(weights, draft.exceptions, np.array([flat, 0.0, 0.0, 0.0]))
    curve = fit_curve(x, y)
    curve[0] += math.log(prior / (1 - prior))
    return Lexicon(weights, draft.exceptions, curve)


def _half(name: int) -> bool:
    return (name * 0x9E3779B97F4A7C15 >> 40) & 1 == 1


def _second_half(texts: DataFrame, draft: Lexicon) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(exception phrases, features, labels) of the texts that did not make the lexicon.

    An exception phrase is an entry with its neighbour word that occurs in at least five clean
    texts and in a twentieth of that many toxic ones at most.
    """
    shared = texts.sparkSession.sparkContext.broadcast(draft)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lexicon, rows = shared.value, []
        automaton = lexicon.automaton()
        for name, text, y in zip(batch.column("doc_id"), batch.column("text"), batch.column("toxic"), strict=True):
            if _half(name.as_py()):
                continue
            words = fold(text.as_py())
            near = {p for a, b in zip(words, words[1:], strict=False) if f" {a} " in lexicon.weights or f" {b} " in lexicon.weights for p in [f" {a} {b} "]}
            rows.append((y.as_py(), list(lexicon.features(words, automaton)), sorted(near)))
        kinds = [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 3, kinds, strict=True)], ["y", "x", "phrases"])

    found = map_arrow(texts, run, "y int, x array<double>, phrases array<string>")
    data = found.select("y", "x").collect()  # bounded as the sample is
    by_phrase = found.select("y", F.explode("phrases").alias("p")).groupBy("p").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    phrases = [r["p"] for r in by_phrase.filter("n0 >= 5 and n1 * 20 <= n0").select("p").collect()]
    return phrases, np.array([r["x"] for r in data]).reshape(-1, 3), np.array([r["y"] for r in data])


def scored(docs: DataFrame, lexicon: Lexicon, name: str) -> DataFrame:
    """``docs`` with a last column ``name``; null and empty texts get the curve's lowest value."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            score = [shared.value.score(fold(t.as_py()), automaton) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(name):
    return F.pmod(F.crc32(name.cast("string").cast("binary")), F.lit(5)) == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs`` (doc_id, text, ..).

    Labels of ids whose crc32 modulo 5 is 0 are held out and never learned from.  Null ids are
    not held out; repeated rows give a row each; other columns are not read.
    """
    lexicon = learn(docs, labels.filter(~held_out(F.col("doc_id"))))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(source, lexicon, "score").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    lexicon = learn(docs, labels.filter(~held_out(F.col("doc_id"))))
    score = unused(docs, "_score")
    return scored(docs, lexicon, score).filter(F.col(score) < 0.5).drop(score)
