import random

from strandweave.operators.telomere import motif_totals
from strandweave.plans import baseline, preprocess
from strandweave.plans.postprocess import KmerSettings, Settings


def test_two_contigs_are_joined_through_a_dropped_read(spark, tmp_path):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(4000))
    at = {"a": (0, 1200), "b": (800, 2000), "x": (1700, 2700), "c": (2400, 3400), "d": (3000, 4000)}
    seqs = {n: genome[s:e] for n, (s, e) in at.items()}
    (tmp_path / "r.ec.fa").write_text("".join(f">{n}\n{s}\n" for n, s in seqs.items()))
    (tmp_path / "g.p_ctg.gfa").write_text(
        "S\tc1\t*\tLN:i:9\nA\tc1\t0\t+\ta\t0\t1200\nA\tc1\t800\t+\tb\t0\t1200\nA\tc2\t0\t+\tc\t0\t1000\nA\tc2\t600\t+\td\t0\t1000\n"
    )
    paf = []
    for n, m in (("b", "x"), ("x", "c"), ("a", "b")):
        ol = at[n][1] - at[m][0]
        ln, lm = len(seqs[n]), len(seqs[m])
        paf.append(f"{n} {ln} {ln - ol} {ln} + {m} {lm} 0 {ol} 0 0 255")
    (tmp_path / "o.paf").write_text("\n".join(paf) + "\n")
    tables, base, final = (str(tmp_path / n) for n in ("tables", "base", "final"))
    # every k-mer of this read set is solid: the spectrum is replaced by a flat one
    try:
        preprocess.run_preprocessing(spark, "contigs", str(tmp_path / "g.p_ctg.gfa"), str(tmp_path / "o.paf"), str(tmp_path / "r.ec.fa"), tables)
    except Exception as e:
        assert "local minimum" in str(e)
        from strandweave.operators.kmers import count_kmers
        from strandweave.sinks.files import save_tables
        from strandweave.sources.fasta import read_fasta

        reads = read_fasta(spark, str(tmp_path / "r.ec.fa"))
        asm = preprocess.read_assembly(spark, "contigs", str(tmp_path / "g.p_ctg.gfa"), reads)
        kept = preprocess.accepted_overlaps(preprocess.read_paf(spark, str(tmp_path / "o.paf")), asm)
        edges, adj = preprocess.expand(kept, preprocess.boundary_reads(asm.unitig_ends))
        counts = count_kmers(reads, 21)
        save_tables(tables, reads=reads, ghost_edges=edges, ghost_adj=adj, kmer_counts=counts, kmers=counts,
                    **{n: getattr(asm, n) for n in preprocess.ASSEMBLY_TABLES})
    baseline.run_contig_baseline(spark, str(tmp_path / "g.p_ctg.gfa"), tables, base)

    def fasta_of(folder):
        rows = sorted(p for p in (tmp_path / folder / "assembly.fasta").iterdir() if p.name.startswith("part"))
        out = {}
        for line in "".join(p.read_text() for p in rows).splitlines():
            if line.startswith(">"):
                name = line[1:]
                out[name] = ""
            else:
                out[name] += line
        return out

    assert fasta_of("base") == {"ctg0000000001": genome[:2000], "ctg0000000002": genome[2400:3000] + seqs["d"]}
    settings = Settings(use_telomere_info=False, kmers=KmerSettings(21, 1, 0.8))
    assert baseline.run_postprocessing(spark, tables, base, final, settings)
    assert fasta_of("final") == {"ctg0000000001": genome}
    telo = spark.read.parquet(f"{final}/telo_ref")
    assert tuple(motif_totals(telo).first()) == (0, 0)
