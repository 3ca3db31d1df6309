"""Index, phase and iterative on small files: what a panel's haplotypes say about samples with few reads."""

import numpy as np
import pytest

from lociflow.plans import commands
from lociflow.sources import vcf

SITES = 8


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A panel of 40 samples drawn from 4 haplotypes over 2 chromosomes of 12 markers, and a target of 6 samples with
    reads at every third marker."""
    rng = np.random.default_rng(1)
    at = tmp_path_factory.mktemp("vcf")
    base = rng.integers(0, 2, (2, 4, 12))
    panel = base[:, rng.integers(0, 4, 80)]
    truth = base[:, rng.integers(0, 4, 12)]

    def write(name, ids, cell, info):
        head = "\t".join([*vcf.COLUMNS, "FORMAT", *ids])
        lines = ["##fileformat=VCFv4.1", head]
        for c in range(2):
            for m in range(12):
                cells = [cell(c, k, m) for k in range(len(ids))]
                lines.append("\t".join([f"chr{c + 1}", str(100 + m), f"m{m}", "A", "C", ".", "PASS", info, "GT" if name == "panel" else "GT:PL", *cells]))
        (at / f"{name}.vcf").write_text("\n".join(lines) + "\n")

    write("panel", [f"p{k}" for k in range(40)], lambda c, k, m: f"{panel[c, 2 * k, m]}|{panel[c, 2 * k + 1, m]}", "AC=1;AN=3")

    def reads(c, k, m):
        if m % 3 or k == 5:
            return "./."
        dose = truth[c, 2 * k, m] + truth[c, 2 * k + 1, m]
        return "0/0:" + ",".join(str(40 * abs(g - dose)) for g in range(3))

    write("target", [f"t{k}" for k in range(6)], reads, ".")
    return str(at), truth, panel


def genotypes(spark, path):
    rows = vcf.lines(spark, path)
    assert vcf.header(rows)[9:] == [f"t{k}" for k in range(6)]
    found = vcf.calls(vcf.records(rows), "chrom", "pos").collect()
    return {(int(r.chrom[3:]) - 1, r.pos - 100, r.sample_idx): r for r in found}


def test_index_then_phase(spark, files):
    at, truth, panel = files
    commands.index(spark, f"{at}/panel.vcf", f"{at}/index", sites=SITES)
    codes = spark.read.parquet(f"{at}/index/haplotypes")
    assert codes.count() == 4 * 80 and spark.read.parquet(f"{at}/index/markers").count() == 24
    edges = spark.read.parquet(f"{at}/index/edges")
    assert {r["s"] for r in edges.groupBy("region", "site").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()} == {80}
    commands.phase(spark, f"{at}/target.vcf", f"{at}/index", f"{at}/out", sites=SITES)
    got = genotypes(spark, f"{at}/out/genotypes")
    assert len(got) == 24 * 6
    doses = lambda r: (r.genotype >> 8 & 0x7F) + (r.genotype & 0x7F)
    right = [doses(r) == truth[c, 2 * k, m] + truth[c, 2 * k + 1, m] for (c, m, k), r in got.items() if k < 5]
    assert np.mean(right) > 0.85 and all(doses(got[c, m, k]) == truth[c, 2 * k, m] + truth[c, 2 * k + 1, m] for c in range(2) for m in range(0, 12, 3) for k in range(5))
    phased = genotypes(spark, f"{at}/out/consensus")
    assert len(phased) == 24 * 6 and all(r.genotype >> 15 for r in phased.values())
    same = [doses(r) == truth[c, 2 * k, m] + truth[c, 2 * k + 1, m] for (c, m, k), r in phased.items() if k < 5]
    assert np.mean(same) > 0.85


def test_iterative(spark, files):
    at, truth, _ = files
    exclude = spark.createDataFrame([("p0",)], "sample_id string")
    commands.iterative(spark, f"{at}/target.vcf", f"{at}/panel.vcf", f"{at}/rounds", rounds=3, sites=SITES, exclude=exclude)
    assert spark.read.parquet(f"{at}/rounds/tables/haplotypes").count() == 4 * 78
    got = genotypes(spark, f"{at}/rounds/consensus")
    doses = lambda r: (r.genotype >> 8 & 0x7F) + (r.genotype & 0x7F)
    assert len(got) == 24 * 6 and np.mean([doses(r) == truth[c, 2 * k, m] + truth[c, 2 * k + 1, m] for (c, m, k), r in got.items() if k < 5]) > 0.85


def write_vcf(path, ids, chroms, cell, form):
    """A VCF with markers 100 bases apart: cell(chrom, sample, marker)."""
    lines = ["##fileformat=VCFv4.1", "\t".join([*vcf.COLUMNS, "FORMAT", *ids])]
    for c, count in enumerate(chroms):
        lines += ["\t".join([f"chr{c + 1}", str(100 * (m + 1)), f"m{m}", "A", "C", ".", "PASS", ".", form, *(cell(c, k, m) for k in range(len(ids)))]) for m in range(count)]
    path.write_text("\n".join(lines) + "\n")


def sides(spark, path):
    """By chromosome and sample, the alleles of the two haplotypes by position, and the phase sets."""
    rows = vcf.calls(vcf.records(vcf.lines(spark, path)), "chrom", "pos").orderBy("chrom", "pos").collect()
    out = {}
    for r in rows:
        a, b, sets = out.setdefault((r.chrom, r.sample_idx), ([], [], set()))
        a.append(r.genotype >> 8 & 0x7F), b.append(r.genotype & 0x7F), sets.add(r.fields["PS"])
    return out


def switches(got, truth):
    """At which heterozygous markers the order of the sides changes against the truth's, and how many there are."""
    het = [k for k in range(len(truth[0])) if truth[0][k] != truth[1][k] and got[0][k] != got[1][k]]
    same = [got[0][k] == truth[0][k] for k in het]
    return [het[i] for i in range(1, len(het)) if same[i] != same[i - 1]], len(het)


def test_phase_holds_over_windows(spark, tmp_path):
    """All of the panel changes alleles in the middle of the chromosome, so the target must too."""
    one, two = [0] * 16 + [1] * 16, [1] * 16 + [0] * 16
    write_vcf(tmp_path / "panel.vcf", [f"p{k}" for k in range(20)], [32], lambda c, k, m: f"{one[m]}|{two[m]}", "GT")
    write_vcf(tmp_path / "target.vcf", ["t"], [32], lambda c, k, m: "0/1:127,0,127", "GT:PL")
    commands.index(spark, f"{tmp_path}/panel.vcf", f"{tmp_path}/index")
    commands.phase(spark, f"{tmp_path}/target.vcf", f"{tmp_path}/index", f"{tmp_path}/out")
    commands.phase(spark, f"{tmp_path}/target.vcf", f"{tmp_path}/index", f"{tmp_path}/few", keep=3)
    commands.phase(spark, f"{tmp_path}/target.vcf", f"{tmp_path}/index", f"{tmp_path}/mosaic", people=2)
    for out in ("out", "few", "mosaic"):
        a, b, sets = sides(spark, f"{tmp_path}/{out}/consensus")["chr1", 0]
        assert sorted([a, b]) == [one, two] and sets == {"1"}


@pytest.mark.parametrize("sites", [16, 24])
def test_switches_at_borders(spark, tmp_path, sites):
    """200 markers, mosaics of eight haplotypes: borders switch no more often than other places."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (8, 200))

    def mosaic():
        at = np.where(rng.random(200) < 0.01, rng.integers(0, 8, 200), -1)
        at[0] = rng.integers(0, 8)
        at = at[np.maximum.accumulate(np.where(at >= 0, np.arange(200), 0))]
        return base[at, np.arange(200)]

    panel, truth = [mosaic() for _ in range(80)], [mosaic() for _ in range(16)]
    write_vcf(tmp_path / "panel.vcf", [f"p{k}" for k in range(40)], [200], lambda c, k, m: f"{panel[2 * k][m]}|{panel[2 * k + 1][m]}", "GT")
    pl = {0: "0,60,120", 1: "60,0,60", 2: "120,60,0"}
    write_vcf(tmp_path / "target.vcf", [f"t{k}" for k in range(8)], [200], lambda c, k, m: "0/0:" + pl[truth[2 * k][m] + truth[2 * k + 1][m]], "GT:PL")
    commands.index(spark, f"{tmp_path}/panel.vcf", f"{tmp_path}/index", sites=sites)
    commands.phase(spark, f"{tmp_path}/target.vcf", f"{tmp_path}/index", f"{tmp_path}/out", sites=sites)
    found, hets, step = [], 0, sites // 2
    for (_, k), (a, b, _) in sides(spark, f"{tmp_path}/out/consensus").items():
        at, n = switches((a, b), (truth[2 * k], truth[2 * k + 1]))
        found, hets = found + at, hets + n
    # a window's core begins a quarter of it behind its start
    near = [m for m in found if (m - sites // 4) % step == 0]
    assert hets > 500 and len(found) / hets < 0.06 and len(near) / (hets / step) <= max(0.08, 2 * len(found) / hets)


def test_lists_maps_and_starts(spark, files):
    at, truth, _ = files
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id string")
    few = {"sites": SITES, "include": ids("t1", "t4", "t5"), "exclude": ids("t5")}
    slow = spark.createDataFrame([("chr1", 100, 0.0), ("chr1", 111, 11.0)], "chrom string, bp long, cm double")
    wrong = spark.createDataFrame([(k, 0.25 if k == 3 else 0.001) for k in range(24)], "ordinal long, rate double")
    commands.index(spark, f"{at}/panel.vcf", f"{at}/index2", sites=SITES)
    commands.phase(spark, f"{at}/target.vcf", f"{at}/index2", f"{at}/few", genetic_map=slow, errors=wrong, **few)
    assert vcf.header(vcf.lines(spark, f"{at}/few/genotypes"))[9:] == ["t1", "t4"]
    info = {(r.chrom, r.pos): (float(r.info["THETA"]), float(r.info["ERATE"])) for r in vcf.records(vcf.lines(spark, f"{at}/few/genotypes")).collect()}
    assert info["chr1", 103][1] == 0.25 and info["chr1", 104][1] == 0.001 and abs(info["chr1", 105][0] - 0.01) < 0.002 and info["chr2", 105][0] == 0.01
    assert spark.read.parquet(f"{at}/few/tables/posteriors").select("sample_id").distinct().count() == 2
    for start, copies in (("random", 2), ("phased", 0)):
        out = f"{at}/{start}"
        commands.iterative(spark, f"{at}/target.vcf", f"{at}/panel.vcf", out, rounds=2, sites=SITES, start=start, copies=copies, include_targets=ids("t0", "t1", "t2"), seed=3)
        n = {r.n for r in spark.read.parquet(f"{out}/tables/nodes-0").groupBy("region", "site").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
        # the panel's, the copies', and those the first round starts with
        assert n == {80 + 6 * copies + 6}
        rates = spark.read.parquet(f"{out}/tables/rates-0")
        assert rates.count() == 24 and rates.where("rate <= 0 OR error <= 0").count() == 0 and rates.select("error").distinct().count() >= 1
        doses = {(r.key, r.sample_id): r for r in spark.read.parquet(f"{out}/dosages").collect()}
        assert len(doses) == 24 * 3 and {r.n for r in doses.values()} == {5}
        right = [round(doses[f"chr{c + 1}:{100 + m}:C", k].dosage) == truth[c, 2 * k, m] + truth[c, 2 * k + 1, m] for c in range(2) for m in range(12) for k in range(3)]
        assert np.mean(right) > 0.8
    with pytest.raises(ValueError):
        commands.iterative(spark, "", "", "", start="other")


def test_rates_are_learned():
    """Crossovers and misread alleles of draws come near what was simulated."""
    from lociflow.functions.genetics import settled_error
    from lociflow.operators import phasing

    rng = np.random.default_rng(8)
    base = rng.integers(0, 2, (6, 16))
    graph, before = [], 1
    for m in range(16):  # six nodes a site, each haplotype its own
        graph.append((base[:, m], np.full(6, 1 / 6), np.eye(6) if m else np.full((1, 6), 1 / 6)))
    theta, error, n = 0.05, 0.04, 3000
    at = rng.integers(0, 6, (n, 2))
    phreds = np.zeros((n, 16, 3))
    for m in range(16):
        at = np.where(rng.random((n, 2)) < theta, rng.integers(0, 6, (n, 2)), at) if m else at
        dose = (base[at, m] ^ (rng.random((n, 2)) < error)).sum(1)
        phreds[np.arange(n)[:, None], m, np.arange(3)] = 60.0 * np.abs(np.arange(3) - dose[:, None])
    keys = phasing.draw_keys(1, list(range(n)), 1)
    rate, wrong = np.full(16, 0.01), np.full(16, 0.01)
    for k in range(12):
        held, crossed = phasing.draw(graph, rate, k, keys, phasing.forward(graph, phreds, rate, wrong))
        codes = phasing.imputed(held, phreds, wrong, k, keys)
        bits = lambda x: (x[:, :, None] >> np.arange(16)) & 1
        got, want = bits(codes).sum(1), bits(held).sum(1)
        off, pair = np.abs(got - want), (got == 1) & (want == 1)
        counts = (np.where(pair, 0, 2 - off).sum(), off.sum(), pair.sum())
        wrong[:] = settled_error(*(np.array([float(c)]) for c in counts))[0]
        rate[1:] = bits(crossed)[:, :, 1:].sum() / (2 * n * 15)
    assert abs(wrong[0] - error) < 0.012 and abs(rate[1] - theta) < 0.02
