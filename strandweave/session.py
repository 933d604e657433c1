"""Session settings shared by every plan: adaptive execution, skew joins, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session.  Skewed keys (one read, one
# contig, one k-mer holding a large share of the rows) are split by AQE, also when
# the split costs one more shuffle downstream.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# A side is broadcast only when its counted rows stay under this bound.
BROADCAST_ROWS = 200_000


def build_session(app: str = "strandweave", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))
        # AQE packs small partitions; of large tables a core's share in one piece would be sorted on disk
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(8 * sc.defaultParallelism))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; one under /tmp only in local mode."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandweave-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def delta_coded(key: str) -> dict[str, str]:
    """Options of :func:`cut` for a column of sorted long keys: differences are written, not values."""
    return {"parquet.writer.version": "v2", f"parquet.enable.dictionary#{key}": "false"}


def cut(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Materialise ``df`` as a table (zstd) in the shared folder and read it back.

    Cuts the lineage and survives lost executors.  Against an RDD checkpoint, a written
    table keeps column pruning, gives the planner true sizes (so it can broadcast what
    is small), and packs small partitions on reading.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stack(tables: list[DataFrame], table: DataFrame, branches: int = 16) -> None:
    """Append a table of equal schema; ``branches`` tables are rewritten as one.

    Rounds that each leave a small table thus never make a plan with a branch per round.
    """
    tables.append(table)
    if len(tables) >= branches:
        tables[:] = [cut(reduce(DataFrame.unionByName, tables))]
