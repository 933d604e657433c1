"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

The queries run in pipeline order.  A stage several of them need (parsed overlaps, k-mer
counts, ..) is written once and its time counts for the first query that needs it.
"""

from __future__ import annotations

import json
import os
import time

from strandweave.plans.catalog import QUERIES
from strandweave.session import build_session

HEADLINE = [
    "reads_scan", "kmer_histogram", "kmer_solid_bounds", "seq_coverage", "paf_classify", "gfa_edges", "edge_similarity",
    "paf_accepted_raw", "hop_edges", "hop_ghosts", "degrees", "components", "contig_edges", "paf_accepted_contig",
    "walk_offsets", "walk_lines", "telomere_regions", "telomere_chop", "ghost_neighbours", "scaffold_edges",
    "repetitive_ghosts", "edge_coverage", "scaffold_contigs", "scaffold_lines", "assembly_stats", "gnn_scores", "greedy_walks",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start-up is not part of a query
    took: dict[str, float] = {}
    for name in HEADLINE:
        begin = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 3)
    spark.stop()
    line = {"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").split("/")[-1]}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
