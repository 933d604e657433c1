"""What the plans of the overlap queries move through shuffles."""

from strandweave.operators import overlaps
from strandweave.plans import catalog
from strandweave.sources import gfa

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_pair_of_texts_is_not_shuffled_again(spark):
    lines, segments = catalog.raw_lines(spark, SF), catalog.raw_segments(spark, SF)
    edges = gfa.raw_edges(lines, segments)
    assert edges.count() > 0 and "RebalancePartitions" not in plan(edges)


def test_accepted_overlaps_move_what_is_asked_for(spark):
    asm = catalog.contig_asm(spark, SF)
    rows = overlaps.accepted_overlaps(catalog.paf_rows(spark, SF), asm)
    assert rows.count() > 0
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        payload = [x[x.index("struct(line_no") :].split(" AS ")[0] for x in plan(rows).splitlines() if "struct(line_no" in x]
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert payload and not any(name in x for x in payload for name in ("src_first", "dst_last", "src_start", "strand"))
