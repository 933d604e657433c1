"""A configured run: every stage of every genome, each at most once.

The settings tree has the sections ``run`` (which genomes go through which stage, and from which
source), ``genome_info`` (telomere motifs and input paths of each genome), ``postprocessing``
and ``misc``.  A finished stage leaves a manifest beside its tables: a digest of its settings,
of its inputs' files (name, size, time of change), and of the stage before it.  A later run skips
a stage whose manifest still matches, and runs it again after any of these has changed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators.gnn import load_weights, random_weights
from strandweave.plans.baseline import run_contig_baseline, run_postprocessing, run_raw_baseline
from strandweave.plans.preprocess import run_preprocessing
from strandweave.sources.config import settings_for

# The names of sources in a settings tree, and of the stages in their order.
SOURCES = {"GNNome": "raw", "hifiasm": "contigs"}
STAGES = ("preprocessing", "generate_baseline", "postprocessing")


@dataclass
class Stage:
    """What to run, and all that its result depends on besides the stages before it."""

    folder: str
    settings: dict[str, Any]
    inputs: list[str]
    after: str | None
    work: Callable[[], None]


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(path, bytes, time of change) of the files behind a path; no content is read."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").cast("string"))
    return sorted(tuple(r) for r in listed.collect())


def digest(spark: SparkSession, stage: Stage) -> str:
    files = [files_of(spark, p) for p in stage.inputs]
    before = manifest(spark, stage.after) if stage.after else None
    told = json.dumps([stage.settings, files, before], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def manifest(spark: SparkSession, folder: str) -> str | None:
    """The digest of the run that wrote a folder; None if none was finished."""
    try:
        rows = spark.read.text(f"{folder}/manifest").collect()
    except AnalysisException:
        return None
    return json.loads(rows[0]["value"])["digest"] if rows else None


def seal(spark: SparkSession, folder: str, value: str) -> None:
    line = json.dumps({"digest": value})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def open_seal(spark: SparkSession, folder: str) -> None:
    """Nothing of a folder counts while a stage writes it."""
    spark.createDataFrame([], "value string").write.mode("overwrite").text(f"{folder}/manifest")


def stages_of(spark: SparkSession, config: dict[str, Any], genome: str, out: str) -> list[tuple[str, Stage]]:
    """(name, stage) of a genome in order, those only that the settings ask for."""
    asked = {s: config["run"].get(s) or {} for s in STAGES}
    wanted = {s for s in STAGES if genome in (asked[s].get("genomes") or [])}
    info, kmers = config["genome_info"][genome], config["misc"]["kmers"]
    paths, model = info["paths"], (config["misc"].get("paths") or {}).get("model")
    tables, base = f"{out}/{genome}/tables", f"{out}/{genome}/baseline"
    found: list[tuple[str, Stage]] = []
    source = lambda stage: SOURCES[asked[stage]["source"]]
    if "preprocessing" in wanted:
        reads = [paths["ec_reads"], *([paths["ul_reads"]] if paths.get("ul_reads") else [])]
        kind = source("preprocessing")
        found.append(("preprocessing", Stage(
            tables, {"source": kind, "k": kmers["k"]}, [paths["gfa"], paths["paf"], *reads], None,
            lambda: run_preprocessing(spark, kind, paths["gfa"], paths["paf"], paths["ec_reads"], tables, paths.get("ul_reads"), int(kmers["k"])),
        )))
    if "generate_baseline" in wanted:
        decoding = (config.get("gnnome") or {}).get("decoding") or {}
        options = {o: int(decoding[n]) for o, n in (("nb_paths", "num_decoding_paths"), ("len_threshold", "len_threshold")) if n in decoding}
        if source("generate_baseline") == "raw":
            found.append(("generate_baseline", Stage(
                base, {"source": "raw", "model": model, **options}, [], tables,
                lambda: run_raw_baseline(spark, tables, base, load_weights(model) if model else random_weights(), **options),
            )))
        else:
            found.append(("generate_baseline", Stage(
                base, {"source": "contigs"}, [paths["gfa"]], tables, lambda: run_contig_baseline(spark, paths["gfa"], tables, base),
            )))
    if "postprocessing" in wanted:
        settings = settings_for(config, genome)
        final = f"{out}/{genome}/final"
        found.append(("postprocessing", Stage(
            final, {"settings": settings}, list(settings.telomere_tables or ()), base, lambda: run_postprocessing(spark, tables, base, final, settings),
        )))
    return found


def run(spark: SparkSession, config: dict[str, Any], out: str) -> DataFrame:
    """Run what is not done yet: genome, stage, folder, started (false: it was up to date)."""
    genomes = dict.fromkeys(g for s in STAGES for g in (config["run"].get(s) or {}).get("genomes") or [])
    rows = []
    for genome in genomes:
        for name, stage in stages_of(spark, config, genome, out):
            value = digest(spark, stage)
            started = manifest(spark, stage.folder) != value
            if started:
                open_seal(spark, stage.folder)
                stage.work()
                seal(spark, stage.folder, value)
            rows.append((genome, name, stage.folder, started))
    return spark.createDataFrame(rows, "genome string, stage string, folder string, started boolean")
