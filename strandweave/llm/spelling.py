"""Spelling variants by a trie-node pair dictionary (operator 13).

The prefixes of all words are the nodes of a trie, their suffixes those of the trie of the
reversed words; both are numbered.  A word of length L meets, by pairs (prefix node, suffix
node),

* for each position i the pair around the letter i, which it *skips*: words that skip to
  the same pair differ in that one letter;
* for each gap i the pair around the gap, where a letter may be *inserted*: a word that skips
  to this pair is this word with one letter more.

Equal pairs spell equal rests, so a join on the two numbers gives exactly the words at one
change, without candidates to verify.  A pair is met by at most one word per letter of the
alphabet (and the one without a letter), so groups are bounded however many words there are,
and each member leaves one row: how many neighbours it met and the best of them.

A node is named by its prefix or suffix up to ``NAMED`` code points, a longer one by the SHA-256
digest of it, so that a run of a million letters gives a million short names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.tables import map_arrow, shelve
from strandweave.operators.numbering import with_row_index

LETTERS, OCCURRENCES, RATIO, ONE_IN = 6, 5, 5, 199
NAMED = 32
HELD = 200_000  # distinct words that a task holds before it passes their counts on
# One byte per code point up to U+00FF: A-Z become a-z, letters from U+00C0 on stay, the rest is space.
_SPELLED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def word_counts(docs: DataFrame, letters: int = LETTERS, one_in: int = ONE_IN) -> DataFrame:
    """word, n: words of whole texts with A-Z lower-cased, counted in the task before the shuffle.

    Runs are damaged as the contract of the query says: where crc32("<doc_id>:<run>") is
    a multiple of ``one_in``, one code point is deleted.  A null doc_id is written as nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def flush():
            words = pa.array([w.decode("latin-1") for w in total], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if (text := text.as_py()) is None:
                    continue
                head = zlib.crc32(f"{'' if (d := doc_id.as_py()) is None else d}:".encode())
                for word, n in Counter(text.encode("latin-1", "replace").translate(_SPELLED).split()).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), head)
                    if h % one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= letters:
                        total[word] += n
                if len(total) >= HELD:
                    yield flush()
                    total.clear()
        if total:
            yield flush()

    counts = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def _names(text: str) -> Iterator[str]:
    """Names of all prefixes of ``text``, the empty one first."""
    digest = hashlib.sha256()
    for i in range(len(text) + 1):
        if i <= NAMED:
            yield text[:i]
        else:
            yield "#" + digest.copy().hexdigest()
        digest.update(text[i : i + 1].encode())


def node_names(words: DataFrame) -> DataFrame:
    """word_id, side, at, first, name: the trie nodes of each word.

    Side 0 names the prefix that ends at ``at``, side 1 the suffix that begins there.
    ``first`` tells whether the letter at ``at`` differs from the one before.
    """
    columns = {"word_id": pa.int64(), "side": pa.int32(), "at": pa.int32(), "first": pa.bool_(), "name": pa.string()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for word_id, word in zip(batch.column("word_id").to_pylist(), batch.column("word").to_pylist(), strict=True):
            for side, text in enumerate((word, word[::-1])):
                for i, name in enumerate(_names(text)):
                    at = len(word) - i if side else i
                    rows.append((word_id, side, at, word[at - 1 : at] != word[at : at + 1], name))
                    if len(rows) >= 1 << 16:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return map_arrow(words.select("word_id", "word"), run, "word_id long, side int, at int, first boolean, name string")


def numbered_nodes(words: DataFrame) -> DataFrame:
    """word_id, side, at, first, node: the nodes with numbers, equal for equal prefixes and suffixes.

    The roots, in which every word would meet, are -1 without a join.
    """
    names = shelve(node_names(words))
    below = names.filter("name <> ''")
    nodes = shelve(below.select("side", "name").distinct().withColumn("node", F.monotonically_increasing_id()))
    columns = ["word_id", "side", "at", "first", "node"]
    roots_ = names.filter("name = ''").withColumn("node", F.lit(-1).cast("long"))
    return below.join(nodes, ["side", "name"]).select(*columns).unionByName(roots_.select(*columns))


def node_pairs(words: DataFrame) -> DataFrame:
    """prefix, suffix, skips, first, word_id: the pairs of each word.

    ``skips`` pairs leave one letter out.  ``first`` marks those at the first letter of a run of
    equal letters, as any letter of a run leaves the same rest; pairs around gaps have it, too.
    """
    nodes = shelve(numbered_nodes(words))
    prefix = nodes.filter("side = 0").select("word_id", "at", "first", F.col("node").alias("prefix"))
    ends = F.explode(F.array(F.struct(F.lit(False).alias("skips"), F.col("at").alias("at")), F.struct(F.lit(True).alias("skips"), (F.col("at") - 1).alias("at"))))
    suffix = nodes.filter("side = 1").select("word_id", F.col("node").alias("suffix"), ends.alias("e"))
    pairs = prefix.join(suffix.select("word_id", "suffix", "e.*"), ["word_id", "at"])
    return pairs.select("prefix", "suffix", "skips", (F.col("first") | ~F.col("skips")).alias("first"), "word_id")


def neighbours(words: DataFrame) -> DataFrame:
    """word_id, n_near, best: how many words are at one change, and the most frequent of them.

    ``best`` is struct(less, word_id) with less = -n; word_id grows in code point order, so ties
    go to the smallest word.  Words without neighbours have no row.
    """
    pairs = node_pairs(words).join(words.select("word_id", F.negative("n").alias("less")), "word_id")
    member = F.struct(F.struct("less", "word_id").alias("me"), "skips", "first")
    # one word per letter at most shares a pair; pairs of one word alone meet nobody
    groups = pairs.groupBy("prefix", "suffix").agg(F.array_sort(F.collect_list(member)).alias("members"))
    met = groups.filter(F.size("members") > 1).select(F.explode("members").alias("m"), "members")
    # words that both skip here differ in that letter; else one has a letter more, counted at the first of its run
    near = lambda x: (x["me"] != F.col("m.me")) & (x["skips"] & F.col("m.skips") | x["first"] & F.col("m.first"))
    others = met.select("m.me.word_id", F.filter("members", near).alias("others")).filter(F.size("others") > 0)
    rows = others.select("word_id", F.size("others").alias("n"), F.col("others")[0]["me"].alias("best"))
    return rows.groupBy("word_id").agg(F.sum("n").cast("long").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word_id, root_id of (word_id, form_id) rows by pointer jumping; a root has no form itself.

    Occurrences grow along the forms, so they end, and each round halves the way.
    """
    reached = shelve(forms.select("word_id", F.col("form_id").alias("root_id")))
    while True:
        ahead = reached.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next"))
        step = reached.join(ahead, "root_id", "left")
        step = shelve(step.select("word_id", F.coalesce("next", "root_id").alias("root_id"), F.col("next").isNotNull().alias("moved")))
        reached = step.select("word_id", "root_id")
        if step.filter("moved").isEmpty():
            return reached


def spelling_variants(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, ratio: int = RATIO, one_in: int = ONE_IN) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word with enough letters and occurrences.

    A word's form is its most frequent neighbour (ties: smallest in code point order) if that
    occurs ``ratio`` times as often, else null.  Null texts have no words, an empty table
    gives no rows, repeated rows count each; other columns of ``docs`` are not read.
    """
    frequent = word_counts(docs, letters, one_in).filter(F.col("n") >= occurrences)
    words = shelve(with_row_index(frequent, ["word"], "word_id"))
    best_n = F.negative(F.col("best.less"))
    has = best_n >= F.col("n") * ratio
    near = words.select("word_id", "n").join(neighbours(words), "word_id", "left")
    table = shelve(
        near.select(
            "word_id", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has, F.col("best.word_id")).alias("form_id"), F.when(has, best_n).cast("long").alias("form_n"),
        )
    )
    ends = roots(table.filter("form_id is not null"))
    whole = table.join(ends, "word_id", "left").withColumn("root_id", F.coalesce("root_id", "word_id"))
    for key, name in (("word_id", "word"), ("form_id", "form"), ("root_id", "root")):
        whole = whole.join(words.select(F.col("word_id").alias(key), F.col("word").alias(name)), key, "left")
    return whole.select("word", "n", "n_near", "form", "form_n", "root")
