"""A configured run of two genomes: all stages once, then none, then what a change asks for."""

import random

from strandweave.plans import run as plan
from strandweave.sources.config import load_yaml, settings_for


def genome_files(folder, seed):
    """Two contigs with a dropped read between them; k-mers at two depths, so that the spectrum has a minimum."""
    folder.mkdir()
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    at = {"a": (0, 1200), "b": (800, 2000), "x": (1700, 2700), "c": (2400, 3400), "d": (3000, 4000)}
    seqs = {n: genome[s:e] for n, (s, e) in at.items()}
    depth = {f"{n}{i}": s for n, s in seqs.items() for i in range(9)}
    errors = {f"e{i}": "".join(rng.choice("ACGT") for _ in range(60)) for i in range(30)}
    twice = {f"t{i}{j}": s[:60] for i, s in enumerate(errors.values()) for j in range(2) if i < 9}
    (folder / "r.ec.fa").write_text("".join(f">{n}\n{s}\n" for n, s in {**seqs, **depth, **errors, **twice}.items()))
    (folder / "g.p_ctg.gfa").write_text(
        "S\tc1\t*\tLN:i:9\nA\tc1\t0\t+\ta\t0\t1200\nA\tc1\t800\t+\tb\t0\t1200\nA\tc2\t0\t+\tc\t0\t1000\nA\tc2\t600\t+\td\t0\t1000\n"
    )
    paf = []
    for n, m in (("b", "x"), ("x", "c"), ("a", "b")):
        ol = at[n][1] - at[m][0]
        ln, lm = len(seqs[n]), len(seqs[m])
        paf.append(f"{n} {ln} {ln - ol} {ln} + {m} {lm} 0 {ol} 0 0 255")
    (folder / "o.paf").write_text("\n".join(paf) + "\n")
    return genome


YAML = """
run:
  preprocessing: {{source: hifiasm, genomes: [one, two]}}
  generate_baseline: {{source: hifiasm, genomes: [one, two]}}
  postprocessing: {{genomes: [one, two]}}
postprocessing: {{add_inner_edges: false, use_telomere_info: false, decoding: coverage, walk_valid_p: 0.01, hop: 1}}
misc:
  kmers: {{k: 21, diff: 1, rep_threshold: 0.8}}
genome_info:
  one: {{telo_motifs: [TTAGGG, CCCTAA], paths: {{ec_reads: {0}/one/r.ec.fa, ul_reads: ~, gfa: {0}/one/g.p_ctg.gfa, paf: {0}/one/o.paf}}}}
  two: {{telo_motifs: [TTAGGG, CCCTAA], paths: {{ec_reads: {0}/two/r.ec.fa, ul_reads: ~, gfa: {0}/two/g.p_ctg.gfa, paf: {0}/two/o.paf}}}}
"""


def contigs(folder):
    parts = sorted(p for p in (folder / "assembly.fasta").iterdir() if p.name.startswith("part"))
    return "".join(p.read_text() for p in parts)


def test_two_genomes_from_one_file(spark, tmp_path):
    genomes = {n: genome_files(tmp_path / n, seed) for n, seed in (("one", 1), ("two", 2))}
    (tmp_path / "config.yaml").write_text(YAML.format(tmp_path))
    config = load_yaml(str(tmp_path / "config.yaml"))
    out = tmp_path / "out"

    def started():
        return [(r["genome"], r["stage"]) for r in plan.run(spark, config, str(out)).collect() if r["started"]]

    every = [(g, s) for g in ("one", "two") for s in plan.STAGES]
    assert started() == every
    for name, genome in genomes.items():
        text = contigs(out / name / "final")
        assert text.count(">") == 1 and "".join(x for x in text.splitlines() if not x.startswith(">")) == genome
    assert started() == []
    config["postprocessing"]["walk_valid_p"] = 0.02
    assert started() == [("one", "postprocessing"), ("two", "postprocessing")]
    (tmp_path / "two" / "o.paf").write_text((tmp_path / "two" / "o.paf").read_text() + "\n")
    assert started() == [("two", s) for s in plan.STAGES]
    plan.open_seal(spark, str(out / "one" / "baseline"))  # as if the stage had been interrupted
    assert started() == [("one", "generate_baseline")]
    assert started() == []


def test_settings_name_external_telomere_tables():
    import yaml

    config = yaml.safe_load(YAML.format("x"))
    assert settings_for(config, "one").telomere_tables is None
    config["genome_info"]["one"]["paths"]["telomeres"] = ["a.tsv", "b.tsv"]
    assert settings_for(config, "one").telomere_tables == ("a.tsv", "b.tsv")
