"""Run settings from a YAML file."""

from __future__ import annotations

from typing import Any

from strandweave.plans.postprocess import KmerSettings, Settings, TelomereScan


def load_yaml(path: str) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs PyYAML; pass a dict instead") from e
    with open(path) as f:
        return yaml.safe_load(f)


def settings_for(config: dict[str, Any], genome: str) -> Settings:
    """Scaffolding settings of one genome from the config tree."""
    post = config["postprocessing"]
    km = config["misc"]["kmers"]
    scan = config["misc"].get("telomere", {})
    return Settings(
        add_inner_edges=bool(post["add_inner_edges"]),
        use_telomere_info=bool(post["use_telomere_info"]),
        decoding=post["decoding"],
        walk_valid_p=float(post["walk_valid_p"]),
        hop=int(post["hop"]),
        telo_motifs=tuple(config["genome_info"][genome]["telo_motifs"]),
        kmers=KmerSettings(int(km["k"]), float(km["diff"]), float(km["rep_threshold"])),
        telomere=TelomereScan(**scan),
        telomere_tables=tuple(tables) if (tables := config["genome_info"][genome]["paths"].get("telomeres")) else None,
    )
