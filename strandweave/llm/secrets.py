"""Secret scans by patterns and a randomness test battery (operator 5), DataFrame functions only.

Patterns give the base spans.  Other long runs of key characters are candidates, digits or letters
alone included; for each the smallest encoding that holds it is inferred (keys without a digit
have encodings of their own, so that words do not crowd the bands of the others), and three tests ask whether its symbols could be drawn
evenly at random from that alphabet: chi-squared for uniformity, the runs test for symbols of
the alphabet's halves, and the lag-one serial correlation.  Fisher's method combines the
three p-values into one.

Words, paths and identifiers have p-values near 0, random keys evenly spread ones.  Short strings
carry less evidence, so the cut is set for each encoding and length band (doubling lengths):
twice the candidates above 1/2 estimate how many are random, what exceeds them above a cut
are false discoveries, and the smallest cut keeps their share below ``FALSE_SHARE``.  The cut
comes from a histogram of ``BINS`` bins of each band, so no group of candidates is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.tables import shelve

# The patterns, with the characters a kept match needs.
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
KINDS = {
    "assign": f"{ASSIGN}{VALUE}",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",  # a maximal run of 24 or more: the kept matches of [0-9a-f]+
    "random": "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
ORDER = list(KINDS)
LEAST = {"assign": 6, "access": 20, "hex": 24}
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "letters64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BINS = 200
FALSE_SHARE = 0.1
LEAST_P = 0.02


def upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the rational approximation 7.1.26 of Abramowitz and Stegun."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def with_tests(df: DataFrame) -> DataFrame:
    """Adds encoding, n_symbols and p_random for the string column ``key``."""
    core = F.rtrim(F.col("key"), F.lit("="))
    df = df.withColumn("_core", F.translate(core, "-_", "+/")).withColumn("n_symbols", F.length("_core"))
    encoding = (
        F.when(F.col("_core").rlike("^[0-9]+$"), "decimal")
        .when(F.col("_core").rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(F.col("_core").rlike("^[a-z]+$"), "lower")
        .when(F.col("_core").rlike("^[A-Z]+$"), "upper")
        .when(F.col("_core").rlike("^[A-Za-z]+$"), "letters")
        .when(F.col("_core").rlike("^[A-Z2-7]+$"), "base32")
        .when(F.col("_core").rlike("^[A-Za-z0-9]+$"), "base62")
        .when(F.col("_core").rlike("^[A-Za-z+/]+$"), "letters64")
        .otherwise("base64")
    )
    alphabet = F.lit(None).cast("string")
    for name, symbols in ALPHABETS.items():
        alphabet = F.when(F.col("encoding") == name, symbols).otherwise(alphabet)
    df = df.withColumn("encoding", encoding).withColumn("_alphabet", alphabet)
    df = df.withColumn("_k", F.length("_alphabet").cast("double")).withColumn("_n", F.col("n_symbols").cast("double"))
    spelled = F.when(F.col("encoding") == "hex", F.lower("_core")).otherwise(F.col("_core"))
    df = df.withColumn("_spelled", spelled)
    # one pass over the symbols, whatever the length; the explode of one element keeps it from being repeated
    symbols = F.transform(F.filter(F.split("_spelled", ""), lambda c: c != ""), lambda c: F.instr(F.col("_alphabet"), c))
    df = df.withColumn("_x", F.explode(F.array(symbols)))
    n, k = F.col("_n"), F.col("_k")
    squares = F.aggregate(F.array_distinct("_x"), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter("_x", lambda x: x == c)).cast("double"), F.lit(2.0)))
    uniform = (squares * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    df = df.withColumn("_p1", upper_tail(uniform))
    df = df.withColumn("_high", F.size(F.filter("_x", lambda x: x > F.col("_k") / 2)).cast("double"))
    df = df.withColumn("_next", F.slice(F.col("_x"), F.lit(2), F.greatest(F.col("n_symbols") - 1, F.lit(1))))
    df = df.withColumn("_pairs", F.arrays_zip(F.slice("_x", F.lit(1), F.size("_next")).alias("a"), F.col("_next").alias("b")))
    turns = F.size(F.filter("_pairs", lambda p: (p["a"] > F.col("_k") / 2) != (p["b"] > F.col("_k") / 2)))
    h, low = F.col("_high"), n - F.col("_high")
    expected = 2 * h * low / n + 1
    spread = 2 * h * low * (2 * h * low - n) / (n * n * (n - 1))
    df = df.withColumn("_p2", F.when(spread > 0, 2 * upper_tail(F.abs((turns + 1 - expected) / F.sqrt(spread)))).otherwise(F.lit(0.0)))
    df = df.withColumn("_m", F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + x) / n)
    around = F.aggregate("_x", F.lit(0.0), lambda acc, x: acc + (x - F.col("_m")) * (x - F.col("_m")))
    lagged = F.aggregate("_pairs", F.lit(0.0), lambda acc, p: acc + (p["a"] - F.col("_m")) * (p["b"] - F.col("_m")))
    df = df.withColumn("_p3", F.when(around > 0, 2 * upper_tail(F.abs((lagged / around + 1 / n) * F.sqrt(n)))).otherwise(F.lit(0.0)))
    half = -sum(F.log(F.greatest(F.col(p), F.lit(1e-300))) for p in ("_p1", "_p2", "_p3"))
    df = df.withColumn("_half", half).withColumn("p_random", F.exp(-F.col("_half")) * (1 + F.col("_half") + F.col("_half") * F.col("_half") / 2))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def _found(kind: str, text: Column) -> Column:
    """array<struct<ord, gap, size, key>> of a kind's matches; gap: characters since the match before."""
    pattern = F.lit(KINDS[kind])
    parts = F.arrays_zip(F.split(text, KINDS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    rows = F.transform(
        F.filter(parts, lambda p: p["hit"].isNotNull()),
        lambda p: F.struct(
            F.lit(ORDER.index(kind)).alias("ord"),
            F.length(p["gap"]).alias("gap"),
            F.length(p["hit"]).alias("size"),
            (F.length(p["hit"]) - F.length(F.regexp_extract(p["hit"], f"^{ASSIGN}", 0)) if kind == "assign" else F.length(p["hit"])).alias("kept"),
            (p["hit"] if kind == "random" else F.lit(None).cast("string")).alias("key"),
        ),
    )
    empty = F.array().cast("array<struct<ord:int,gap:int,size:int,kept:int,key:string>>")
    return F.when(text.rlike(KINDS[kind]), rows).otherwise(empty)


def secret_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id and spans array<struct<start, ord, end, kind>> per row of ``docs``, in order.

    ``start`` and ``end`` count code points, end exclusive.  Null and empty texts have no spans;
    repeated rows and null ids give rows of their own; an empty table gives none; other
    columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # the patterns run on each text once, here; behind it only the matches travel
    found = rows.select("row", "doc_id", F.concat(*[_found(kind, F.col("text")) for kind in ORDER]).alias("found"))
    single = found.select("row", "doc_id", F.posexplode_outer("found").alias("pos", "f")).select("row", "doc_id", "pos", "f.*")
    before = Window.partitionBy("row", "ord").orderBy("pos")
    placed = single.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    placed = shelve(placed.select("row", "doc_id", "ord", "start", "end", "kept", "key"))
    least = F.element_at(F.create_map(*[x for kind, n in LEAST.items() for x in (F.lit(ORDER.index(kind)), F.lit(n))]), F.col("ord"))
    base = placed.filter("ord < 3").filter(F.col("kept") >= least).select("row", "start", "ord", "end")
    candidate = placed.filter("ord = 3")
    tested = with_tests(candidate.select("row", "start", "ord", "end", "key")).filter("n_symbols >= 16")
    tested = tested.withColumn("band", F.floor(F.log2(F.col("n_symbols") / 16.0)).cast("int"))
    tested = shelve(tested.withColumn("bin", F.least(F.floor(F.col("p_random") * BINS), F.lit(BINS - 1)).cast("int")).drop("key"))
    random = tested.join(F.broadcast(_cuts(tested)), ["encoding", "band"]).filter("bin >= cut").select("row", "start", "ord", "end")
    names = F.array(*[F.lit(kind) for kind in ORDER])
    # a random span that meets a base one goes; what begins before and behind it is a running maximum and minimum
    near = Window.partitionBy("row").orderBy("start")
    base_end, base_start = (F.max(F.when(F.col("ord") < 3, F.col("end"))), F.min(F.when(F.col("ord") < 3, F.col("start"))))
    meets = base.unionAll(random).withColumn("before", base_end.over(near.rangeBetween(Window.unboundedPreceding, 0))).withColumn("behind", base_start.over(near.rangeBetween(0, Window.unboundedFollowing)))
    met = F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("behind") < F.col("end"), F.lit(False))
    clear = meets.filter((F.col("ord") < 3) | ~met)
    spans = clear.groupBy("row").agg(F.collect_list(F.struct("start", "ord", "end")).alias("s"))
    every = placed.select("row", "doc_id").distinct()
    joined = every.join(spans, "row", "left").withColumn("s", F.coalesce("s", F.array().cast("array<struct<start:bigint,ord:int,end:bigint>>")))
    named = F.transform(F.array_sort("s"), lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), F.get(names, x["ord"]).alias("kind")))
    return joined.select("row", "doc_id", named.alias("spans"))


def _cuts(tested: DataFrame) -> DataFrame:
    """encoding, band, cut (a bin); at most one row per encoding and doubling of the length."""
    counts = tested.groupBy("encoding", "band", "bin").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("encoding", "band")
    above = F.sum("n").over(group.orderBy(F.desc("bin")))
    random = 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(group)
    counts = counts.withColumn("above", above).withColumn("random", random)
    false = F.greatest(F.lit(0.0), F.col("above") - (1 - F.col("bin") / BINS) * F.col("random")) / F.col("above")
    passing = counts.filter((false <= FALSE_SHARE) & (F.col("bin") >= int(LEAST_P * BINS)))
    return passing.groupBy("encoding", "band").agg(F.min("bin").alias("cut"))


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (text) per row of ``docs``."""
    found = secret_spans(docs)
    show = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of_kind = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    count = {kind: of_kind(kind).alias(f"n_{kind}") for kind in ORDER}
    base = F.filter("spans", lambda x: x["ord"] < 3)
    return found.select("doc_id", *count.values(), F.sha2(show(base).cast("binary"), 256).alias("base_sha256"), show(F.col("spans")).alias("spans"))
