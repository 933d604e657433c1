"""Read files by ranges: blocked gzip, indexed reads, FASTQ numbering."""

import gzip
import random
import zlib

import pytest

from strandweave.sources import fasta, ranges

ODD = [("a", ""), ("b", "A"), ("long", "ACGT" * 60_000), ("c", ""), ("d", "G" * 17)]


def made(n=400, seed=1):
    rng = random.Random(seed)
    return ODD + [(f"r{i}", "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 60, 700, 5000])))) for i in range(n)]


def as_fasta(reads, width=70):
    return "".join(f">{i} x=1\n" + "".join(s[k : k + width] + "\n" for k in range(0, len(s), width)) for i, s in reads)


def as_fastq(reads):
    # qualities begin with the marks of headers and separators
    return "".join(f"@{i} x\n{s}\n+\n{s.translate(str.maketrans('ACGTN', '@+>I@'))}\n" for i, s in reads)


def blocked(data: bytes, step=20_000) -> bytes:
    return b"".join(ranges.packed_block(data[i : i + step]) for i in range(0, len(data), step)) + ranges.LAST_BLOCK


def pairs(df):
    return sorted((r["read_id"], r["seq"]) for r in df.collect())


def test_written_blocks_are_gzip():
    data = as_fasta(made()).encode()
    assert gzip.decompress(blocked(data)) == data
    assert zlib.decompress(ranges.LAST_BLOCK, 31) == b""


@pytest.mark.parametrize(("kind", "text"), [("fasta", as_fasta), ("fastq", as_fastq)])
def test_every_split_gives_every_record_once(kind, text):
    """Ranges of any size, also smaller than records and blocks, plain and blocked."""
    reads = made(60)
    data = text(reads).encode()
    import io

    for packed, content in ((False, data), (True, blocked(data, 3000))):
        for step in (37, 1000, 4096, 50_000, len(content)):
            if step == 37 and not packed:
                content_, want = text(reads[:1] + reads[3:20]).encode(), reads[:1] + reads[3:20]
            else:
                content_, want = content, reads
            got = []
            for lo in range(0, len(content_), step):
                file, hi = io.BytesIO(content_), min(lo + step, len(content_))
                chunks = ranges.block_chunks(file, lo, len(content_)) if packed else ranges.plain_chunks(file, lo, hi, len(content_), 611)
                got += ranges.RECORDS[kind](chunks, hi, lo == 0)
            assert [(r[3], r[4]) for r in got] == want, (packed, step)


def test_blocked_files_equal_plain_ones(spark, tmp_path):
    reads = made()
    for kind, text in (("fa", as_fasta(reads)), ("fq", as_fastq(reads))):
        (tmp_path / f"x.{kind}").write_text(text)
        (tmp_path / f"x.{kind}.bgz").write_bytes(blocked(text.encode()))
        packed = fasta.read_fasta(spark, str(tmp_path / f"x.{kind}.bgz"), split=15_000)
        assert packed.rdd.getNumPartitions() > 5
        per_task = packed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(n > 0 for n in per_task) > 3 and max(per_task) < len(reads)
        assert pairs(packed) == pairs(fasta.read_fasta(spark, str(tmp_path / f"x.{kind}"))) == sorted(reads)


def test_several_files_and_gzip_without_blocks(spark, tmp_path):
    reads = made(50)
    (tmp_path / "a.fa.bgz").write_bytes(gzip.compress(as_fasta(reads[:20]).encode()) + gzip.compress(as_fasta(reads[20:40]).encode()))
    (tmp_path / "b.fa.bgz").write_bytes(blocked(as_fasta(reads[40:]).encode()))
    (tmp_path / "c.fa.bgz").write_bytes(b"")
    assert pairs(fasta.read_fasta(spark, str(tmp_path / "*.fa.bgz"), split=5000)) == sorted(reads)
    with pytest.raises(Exception, match="no_such"):
        fasta.read_fasta(spark, str(tmp_path / "no_such.fa.bgz")).collect()


def test_written_parts_are_read_again(spark, tmp_path):
    reads = made()
    folder = str(tmp_path / "out")
    table = spark.createDataFrame(reads, "read_id string, seq string")
    fasta.write_blocked(table.repartition(3), folder)
    assert len(list((tmp_path / "out").glob("part-*.fa.bgz"))) == 3 and not list((tmp_path / "out").glob(".part*"))
    got = fasta.read_fasta(spark, folder, split=30_000)
    assert pairs(got) == sorted(reads)
    assert {r["read_len"] == len(r["seq"]) for r in got.collect()} == {True}
    table.limit(2).coalesce(1).write.format("reads").mode("overwrite").save(folder)
    assert fasta.read_fasta(spark, folder).count() == 2


def test_fetched_reads(spark, tmp_path):
    reads = made()
    text = as_fasta(reads)
    (tmp_path / "x.fa").write_text(text)
    (tmp_path / "x.fa.bgz").write_bytes(blocked(text.encode(), 4000))
    (tmp_path / "y.fq").write_text(as_fastq([("only", "GATTACA"), ("b", "TTTT")]))
    other = fasta.read_index(spark, str(tmp_path / "y.fq"))
    wanted = spark.createDataFrame([("r7",), ("b",), ("long",), ("only",), ("b",), ("r399",), ("c",)], "read_id string")
    want = sorted((i, s) for i, s in [*reads, ("only", "GATTACA")] if i in {"r7", "b", "long", "only", "r399", "c"})
    for name in ("x.fa", "x.fa.bgz"):
        fasta.save_index(fasta.read_index(spark, str(tmp_path / name), split=50_000), str(tmp_path / f"{name}.index"))
        index = spark.read.parquet(str(tmp_path / f"{name}.index"))
        assert index.count() == len(reads)
        got = fasta.fetch_reads(wanted, index, other)
        assert pairs(got) == want
    few = fasta.fetch_reads(wanted.filter("read_id <> 'long'"), index, other)
    assert sum(r["n_bytes"] for r in few.collect()) < 0.05 * len(text)  # no byte outside the records is read
    with pytest.raises(Exception, match="read not present"):
        fasta.fetch_reads(spark.createDataFrame([("nobody",)], "read_id string"), index, other).collect()


def test_fastq_records_are_joined_where_they_are_read(spark, tmp_path):
    reads = made(300)
    (tmp_path / "x.fq").write_text(as_fastq(reads) + "\n\n")
    (tmp_path / "z.fq").write_text("@last x\nAC\n+\nII")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("20000", "300000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = fasta.read_fastq(spark, str(tmp_path / "*.fq"))
            assert pairs(got) == sorted([*reads, ("last", "AC")])
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "rangepartitioning" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.fq").write_text("no header\nAC\n+\nII\n")
    with pytest.raises(Exception, match="FASTQ record without @"):
        fasta.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
