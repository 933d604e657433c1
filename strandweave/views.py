"""Assembly inputs derived from the driver's tables.

The driver's tables are not genomic, so each input file of the engine is derived from
whole tables: ``documents`` become reads, ``labels`` decide which reads the assembler
kept, ``orders`` link unitigs, ``lineitem`` holds the read overlaps.  One contig gathers
every English read, so one key holds a large share of all rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandweave.functions.sequence import flip, oriented

# Letters A..Z spelled with the four bases in turn.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAC"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_AS_BASES = bytes.maketrans((LETTERS + LETTERS.lower()).encode(), (BASES + BASES).encode())
_NO_LETTER = bytes(b for b in range(256) if not (chr(b).isascii() and chr(b).isalpha()))


@F.pandas_udf(StringType())
def _bases(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t.encode().translate(_AS_BASES, _NO_LETTER).decode(), na_action="ignore")


def to_bases(text: str) -> F.Column:
    """The letters A to Z of a text, in either case, as bases; bytes of other characters are none of them."""
    return _bases(F.col(text))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads(doc_id, read_id, seq, read_len) from whole document texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", to_bases("text").alias("seq"))
    return docs.select(
        "doc_id",
        F.concat(F.lit("r"), F.col("doc_id")).alias("read_id"),
        "seq",
        F.length("seq").cast("long").alias("read_len"),
    )


def long_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second read set whose ids partly repeat those of :func:`reads`."""
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("r"), F.col("item_id") * 40).alias("read_id"), to_bases("text").alias("seq")
    )
    return items.withColumn("read_len", F.length("seq").cast("long"))


def or_unknown(value: F.Column | str) -> F.Column:
    """A field of a text line; ``*`` for null, which would drop the field."""
    return F.coalesce(F.col(value).cast("string") if isinstance(value, str) else value, F.lit("*"))


def read_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    # grouped so that the length is computed once per text: left as a projection, generated
    # join code would evaluate it again for every matching overlap
    return reads(spark, sf_dir).groupBy("doc_id", "read_id").agg(F.max("read_len").alias("read_len"))


def paf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap rows; ``line_no`` is an orderable struct standing for the file order.

    Overlaps of a read without bases have unknown (null) coordinates.
    """
    pairs = table(spark, sf_dir, "lineitem").select(
        F.expr("l_partkey div 2").alias("d1"),
        F.expr("l_orderkey div 15").alias("d2"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_no"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        F.expr("l_linenumber % 5").alias("kind"),
        F.expr("l_suppkey * 50 + cast(l_quantity as bigint)").alias("span"),
    )
    lens = read_lengths(spark, sf_dir)
    one = lens.select(F.col("doc_id").alias("d1"), F.col("read_id").alias("id1"), F.col("read_len").alias("len1"))
    two = lens.select(F.col("doc_id").alias("d2"), F.col("read_id").alias("id2"), F.col("read_len").alias("len2"))
    rows = (
        pairs.filter("d1 <> d2")
        .join(one, "d1")
        .join(two, "d2")
        .withColumn("ol", F.lit(1) + F.try_mod("span", F.least("len1", "len2")))
    )
    tail1, tail2, zero = F.col("len1") - F.col("ol"), F.col("len2") - F.col("ol"), F.lit(0)
    kind = F.col("kind")
    start1 = F.when(kind.isin(0, 2), tail1).when(kind == 4, F.least(F.lit(10), tail1)).otherwise(zero)
    start2 = F.when(kind.isin(1, 2), tail2).when(kind == 4, F.least(F.lit(20), tail2)).otherwise(zero)
    return rows.select(
        "line_no",
        "id1",
        "len1",
        start1.cast("long").alias("start1"),
        (start1 + F.col("ol")).cast("long").alias("end1"),
        "strand",
        "id2",
        "len2",
        start2.cast("long").alias("start2"),
        (start2 + F.col("ol")).cast("long").alias("end2"),
    )


def paf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap rows as 12-field text lines."""
    rows = paf(spark, sf_dir)
    fields = ["id1", "len1", "start1", "end1", "strand", "id2", "len2", "start2", "end2"]
    value = F.concat_ws("\t", *[or_unknown(c) for c in fields], F.lit("0\t0\t255"))
    return rows.select("line_no", value.alias("value"))


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled reads in unitigs of up to three: utg, doc_id, read_id, orient, seq, read_len."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "+").otherwise("-").alias("orient")
    )
    return (
        reads(spark, sf_dir)
        .join(labels, "doc_id")
        .withColumn("utg", F.expr("doc_id div 3"))
        .select("utg", "doc_id", "read_id", "orient", "seq", "read_len")
    )


def raw_gfa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw unitig graph as text lines: S, its A lines, then L lines with their reverse."""
    members = unitigs(spark, sf_dir)
    name = F.format_string("utg%09dl", F.col("utg"))
    segments = members.groupBy("utg").agg(
        F.array_sort(F.collect_list(F.struct("doc_id", oriented("seq", "orient").alias("s")))).alias("m")
    ).select(
        "utg", F.when(F.exists("m", lambda x: x["s"].isNotNull()), F.array_join(F.transform("m", lambda x: x["s"]), "")).alias("seq")
    )
    s_lines = segments.select(
        F.struct(F.lit(0).alias("part"), F.col("utg").alias("major"), F.lit(-1).cast("long").alias("minor")).alias("line_no"),
        F.concat_ws("\t", F.lit("S"), name, or_unknown(F.when(F.length("seq") > 0, F.col("seq"))), F.concat(F.lit("LN:i:"), or_unknown(F.length("seq").cast("string"))), F.lit("rd:i:1")).alias("value"),
    )
    a_lines = members.select(
        F.struct(F.lit(0).alias("part"), F.col("utg").alias("major"), F.col("doc_id").alias("minor")).alias("line_no"),
        F.concat_ws("\t", F.lit("A"), name, F.lit("0"), "orient", "read_id", F.lit("0"), or_unknown("read_len")).alias("value"),
    )
    by_doc = members.select("doc_id", "utg").join(
        segments.select("utg", F.length("seq").cast("long").alias("seg_len")), "utg"
    )
    left = by_doc.select(F.col("doc_id").alias("a"), F.col("utg").alias("u1"), F.col("seg_len").alias("n1"))
    right = by_doc.select(F.col("doc_id").alias("b"), F.col("utg").alias("u2"), F.col("seg_len").alias("n2"))
    links = (
        table(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            F.expr("o_custkey * 2 div 3").alias("a"),
            F.expr("o_orderkey div 15").alias("b"),
            F.when(F.col("o_orderstatus") == "F", "+").otherwise("-").alias("o1"),
            F.when(F.substring("o_orderpriority", 1, 1) <= "3", "+").otherwise("-").alias("o2"),
        )
        .join(left, "a")
        .join(right, "b")
        .filter("u1 <> u2")
        .withColumn("ol", F.expr("1 + try_mod(o_orderkey, least(n1, n2))"))
    )
    both = links.select(
        "o_orderkey",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("long").alias("minor"), F.col("u1").alias("x"), F.col("o1").alias("ox"), F.col("u2").alias("y"), F.col("o2").alias("oy")),
                F.struct(F.lit(1).cast("long").alias("minor"), F.col("u2").alias("x"), flip("o2").alias("ox"), F.col("u1").alias("y"), flip("o1").alias("oy")),
            )
        ).alias("l"),
        "ol",
    )
    l_lines = both.select(
        F.struct(F.lit(1).alias("part"), F.col("o_orderkey").alias("major"), F.col("l.minor").alias("minor")).alias("line_no"),
        F.concat_ws(
            "\t",
            F.lit("L"),
            F.format_string("utg%09dl", F.col("l.x")),
            "l.ox",
            F.format_string("utg%09dl", F.col("l.y")),
            "l.oy",
            or_unknown(F.concat(F.col("ol"), F.lit("M"))),
            F.lit("L1:i:0"),
            F.lit("L2:i:0"),
        ).alias("value"),
    )
    return s_lines.unionByName(a_lines).unionByName(l_lines)


def contig_gfa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final contigs as A lines; some rows are scaffolding gaps."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    rows = (
        labels.join(docs, "doc_id")
        .join(read_lengths(spark, sf_dir), "doc_id")
        .select(
            F.col("doc_id").alias("line_no"),
            F.when(F.col("lang") == "en", F.lit("ctg_en"))
            .otherwise(F.concat(F.lit("ctg"), F.expr("doc_id div 16")))
            .alias("contig"),
            (F.col("doc_id") * 300).alias("start"),
            F.when(F.col("quality") == 1, "+").otherwise("-").alias("orient"),
            F.when((F.col("toxic") == 1) & (F.col("doc_id") % 2 == 0), F.lit("Ns"))
            .when(F.col("toxic") == 1, F.lit("scaf"))
            .otherwise(F.col("read_id"))
            .alias("read"),
            (F.col("doc_id") % 3).alias("rstart"),
            F.col("read_len").alias("rend"),
        )
    )
    value = F.concat_ws(
        "\t", F.lit("A"), "contig", F.col("start").cast("string"), "orient", "read",
        F.col("rstart").cast("string"), or_unknown("rend"),
    )
    return rows.select("line_no", value.alias("value"))


def fastq_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reads as FASTA records, one text row per record as the file reader yields them."""
    return reads(spark, sf_dir).select(
        F.concat(F.lit(">"), F.col("read_id"), F.lit(" len="), F.col("read_len"), F.lit("\n"), F.col("seq")).alias("value")
    )


def quad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole reads as FASTQ records, whose qualities also begin with the marks of other lines."""
    seq = F.col("seq")
    return reads(spark, sf_dir).select(
        F.concat(F.lit("@"), F.col("read_id"), F.lit(" x\n"), seq, F.lit("\n+\n"), F.translate(seq, "ACGT", "@+IJ")).alias("value")
    )


def long_read_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second read set as FASTA records."""
    return long_reads(spark, sf_dir).select(F.concat(F.lit(">"), "read_id", F.lit("\n"), "seq").alias("value"))
