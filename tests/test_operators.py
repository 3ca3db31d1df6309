"""Goldens and edge cases of the genotype operators."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.functions import genetics as G
from lociflow.functions import stats as S
from lociflow.operators import genotypes, haplotypes, labels, markers, merging, mosaic, phasing, selection, stitching
from lociflow.sources import panels, sinks, vcf

#: 600 haplotypes of 4 sites.
GROUPS = [("0000", 21), ("0001", 79), ("0010", 95), ("0011", 116), ("0100", 25), ("0101", 112), ("0111", 152)]


def panel(spark):
    rows, k = [], 0
    for text, n in GROUPS:
        for _ in range(n):
            rows.append((0, k, sum(1 << s for s in range(4) if text[s] == "1")))
            k += 1
    return spark.createDataFrame(rows, "region long, hap_id long, code long")


def test_order_of_the_panel(spark):
    rows = haplotypes.pbwt(panel(spark)).orderBy("rank").collect()
    starts = [r.rank - 1 for r in rows if r.agree_from != 0]
    text = lambda c: "".join(str(c >> s & 1) for s in range(4))
    assert [text(rows[k].code) for k in starts] == ["0000", "0100", "0010", "0001", "0101", "0011", "0111"]
    assert [rows[k].agree_from for k in starts[1:]] == [2, 3, 4, 2, 3, 2]


def test_graph_of_the_panel(spark):
    edges = {(r.site, r.parent, r.allele): r for r in haplotypes.edges(panel(spark), 4).collect()}
    assert edges[0, 0, 0].n == 600 and edges[0, 0, 0].siblings
    assert edges[1, 0, 0].n == 311 and edges[1, 0, 1].n == 289
    for site in range(4):
        assert sum(e.n for (s, _, _), e in edges.items() if s == site) == 600
        assert abs(sum(e.p_edge for (s, _, _), e in edges.items() if s == site) - 1) < 1e-9


def test_filled_likelihoods(spark):
    rows = spark.createDataFrame([(50, 0, 20), (0, 10, 40), (40, 10, 0), (0, 5, 0)], "a int, b int, c int")
    a, b, c = G.filled(F.col("a"), F.col("b"), F.col("c"))
    assert [tuple(r) for r in rows.select(a, b, c).collect()] == [(127, 0, 20), (0, 10, 127), (127, 10, 0), (0, 5, 127)]


def test_votes_tie_to_the_lowest(spark):
    rows = spark.createDataFrame([(1, 2), (1, 0), (2, 3), (2, 3), (2, 1)], "k int, code int")
    assert {(r.k, r.code, r.votes, r.draws) for r in genotypes.votes(rows, "k").collect()} == {(1, 0, 1, 2), (2, 3, 2, 3)}


def test_map_is_clamped(spark):
    sites = spark.createDataFrame([(1, "chr1", 5), (2, "chr1", 15), (3, "chr1", 99), (4, "chr2", 7)], "site long, chrom string, pos long")
    points = spark.createDataFrame([("chr1", 10, 1.0), ("chr1", 20, 3.0)], "chrom string, bp long, cm double")
    assert {r.site: r.cm for r in markers.interpolated(sites, points).collect()} == {1: 1.0, 2: 2.0, 3: 3.0, 4: None}


def test_ks_distance(spark):
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (0, 1, 2.0), (0, 1, 3.0), (1, 0, 1.0)], "k int, g int, v double")
    (r,) = genotypes.ks_distance(rows, "k", "g", "v").collect()
    assert (r.k, r.d, r.n, r.m) == (0, 0.5, 2, 2)


def test_kolmogorov_tail(spark):
    rows = spark.createDataFrame([(0.0,), (0.2,), (0.999999,), (1.000001,), (1.358099,), (1.627624,), (9.0,)], "x double")
    p = [r.p for r in rows.select(G.kolmogorov_tail(F.col("x")).alias("p")).collect()]
    assert p[0] == 1 and p[1] > 0.999999 and abs(p[2] - p[3]) < 1e-5 and p[6] < 1e-60
    assert abs(p[4] - 0.05) < 1e-5 and abs(p[5] - 0.01) < 1e-5


def test_orders_of_the_panel(spark):
    rows = haplotypes.forward_order(panel(spark), 4).where("site = 3").orderBy("rank").collect()
    assert {r["rank"]: r["div"] for r in rows if r["div"]} == {0: 4, 21: 2, 46: 3, 141: 4, 220: 2, 332: 3, 448: 2}
    rows = haplotypes.backward_order(panel(spark), 4).where("site = 0").orderBy("rank").collect()
    assert [r.hap_id for r in rows] == list(range(600))
    assert {r["rank"]: r["div"] for r in rows if r["div"]} == {0: 4, 21: 1, 100: 2, 195: 1, 311: 3, 336: 1, 448: 2}


def test_orders_against_sorting(spark):
    rng = np.random.default_rng(2)
    haps = [(k, int(rng.integers(0, 2**7)) & ~(1 << int(rng.integers(0, 7)))) for k in range(60)]
    table = spark.createDataFrame([(1, k, c) for k, c in haps], "region long, hap_id long, code long")
    text = {k: "".join(str(c >> s & 1) for s in range(7)) for k, c in haps}
    for order, key in ((haplotypes.forward_order, lambda k, s: text[k][s::-1]), (haplotypes.backward_order, lambda k, s: text[k][s:])):
        got = {}
        for r in order(table, 7).collect():
            got.setdefault(r.site, []).append((r["rank"], r.hap_id))
        for site in range(7):
            assert [h for _, h in sorted(got[site])] == sorted(text, key=lambda k: (key(k, site), k))


def test_graph_without_and_with_a_window(spark):
    nodes, edges = haplotypes.graph(panel(spark), 4, 4)
    # the trie of the panel: a node for each distinct prefix
    prefixes = [len({g[: k + 1] for g, _ in GROUPS}) for k in range(4)]
    sizes = {r.site: r["count"] for r in nodes.groupBy("site").count().collect()}
    assert sizes == dict(enumerate(prefixes))
    out = {(r.site, r.node): r for r in haplotypes.node_table(nodes, edges).collect()}
    assert all(out[0, k].siblings for k in range(prefixes[0])) and out[0, 0].parents == [] and out[0, 0].p == 1
    assert {(r.n, r.allele) for r in edges.where("site = 1").collect()} == {(311, 0), (289, 1)}
    assert out[3, 0].child0 == out[3, 0].child1 == -1
    # with a window of one site, what ends in one allele is one node
    nodes, edges = haplotypes.graph(panel(spark), 4, 1)
    assert {r["count"] for r in nodes.groupBy("site").count().where("site > 0").collect()} == {2}
    r = haplotypes.level_summary(nodes, edges).first()
    assert (r.max_nodes, r.nodes, r.mean_nodes) == (2, 7, 1.75)
    pairs = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 7)], "region long, site int, parent int, child int")
    assert sorted((t.freq, t.prob) for t in haplotypes.transitions(pairs, edges).collect()) == [(0, 0.0), (311, 311 / 600)]
    assert haplotypes.graph(panel(spark).limit(0), 4, 1)[0].count() == 0


def small_graph(rng, sizes=(2, 3, 3, 2)):
    graph, before = [], 1
    for n in sizes:
        step = rng.random((before, n)) * (rng.random((before, n)) < 0.8)
        step[step.sum(1) == 0] = 1
        share = rng.random(n)
        graph.append((np.array([k % 2 for k in range(n)]), share / share.sum(), step / step.sum(1, keepdims=True)))
        before = n
    return graph


def brute_posterior(graph, phreds, rates):
    """Every path of node pairs, with and without a switch of either side before each step."""
    like = lambda s, a, b: 10 ** (-0.1 * phreds[s][a + b]) if phreds[s][a + b] < 127 else 0.0
    total = np.zeros((len(graph), 3))

    def one_side(s, p, c):
        """From node p of site s - 1 to c: on by the edge, or by one from a node drawn anew."""
        keep = 1 - rates[s]
        return keep * graph[s][2][p, c] + rates[s] * float(graph[s - 1][1] @ graph[s][2][:, c])

    ranges = [range(len(a)) for a, _, _ in graph]
    for one in itertools.product(*ranges):
        for two in itertools.product(*ranges):
            w = graph[0][1][one[0]] * graph[0][1][two[0]]
            kinds = [int(graph[s][0][one[s]] + graph[s][0][two[s]]) for s in range(len(graph))]
            for s in range(len(graph)):
                w *= like(s, int(graph[s][0][one[s]]), int(graph[s][0][two[s]]))
                if s:
                    w *= one_side(s, one[s - 1], one[s]) * one_side(s, two[s - 1], two[s])
            for s, k in enumerate(kinds):
                total[s, k] += w
    return total / total.sum(1, keepdims=True)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(7)
    for _ in range(5):
        graph = small_graph(rng)
        phreds = rng.integers(0, 40, (2, 4, 3)).astype(float)
        phreds[0, 1] = 0
        phreds[1, 2, 0] = 127
        rates = np.array([0.0, 0.01, 0.2, 0.05])
        got = phasing.posterior(graph, phreds, rates)
        for k in range(2):
            assert np.allclose(got[k], brute_posterior(graph, phreds[k], rates))


def test_draws_follow_the_posterior():
    rng = np.random.default_rng(3)
    graph = small_graph(rng)
    phreds, rates = rng.integers(0, 15, (1, 4, 3)).astype(float), np.full(4, 0.05)
    drawn = phasing.draw(graph, rates, 1, phasing.draw_keys(5, [9], 4000), phasing.forward(graph, phreds, rates))[0].tolist()
    share = np.array([[np.mean([(a >> s & 1) + (b >> s & 1) == g for a, b in drawn]) for g in range(3)] for s in range(4)])
    assert np.abs(share - phasing.posterior(graph, phreds, rates)[0]).max() < 0.04


def test_excluded_genotypes_count_only_if_all_are():
    alleles = np.array([0, 1])
    assert phasing.emissions(np.array([[127.0, 10.0, 127.0]]), alleles)[0, 0, 0] == 0
    assert (phasing.emissions(np.array([[127.0, 127.0, 127.0]]), alleles) > 0).all()


def test_posteriors_of_a_table(spark):
    nodes, edges = haplotypes.graph(panel(spark), 4, 2)
    reads = [(0, 1, s, 0, 30, 60) for s in range(4)] + [(0, 2, 1, 60, 30, 0), (9, 3, 0, 0, 0, 0)]
    rows = phasing.posteriors(spark.createDataFrame(reads, "region long, sample_id long, site int, pl0 long, pl1 long, pl2 long"), nodes, edges, 4).collect()
    assert len(rows) == 8 and {r.sample_id for r in rows} == {1, 2}
    row = phasing.graph_rows(nodes, edges).select("nodes", "edges").toArrow()
    graph = phasing.levels(*(phasing.columns(row.column(c)[0].values) for c in ("nodes", "edges")))
    one = np.array([[[0, 30, 60]] * 4], float)
    exp = brute_posterior(graph, one[0], np.full(4, 0.01))
    got = np.array([[r.p0, r.p1, r.p2] for r in sorted(rows, key=lambda r: r.site) if r.sample_id == 1])
    assert np.allclose(got, exp)


def test_consensus_of_draws(spark):
    # 4 sites, read from bit 0: two draws of one phase, one of the mirror image, one that flips half way
    a, b = 0b0101, 0b1010
    codes, flips, errors = phasing.vote(np.array([[(a, b), (a, b), (b, a)], [(3, 12), (3, 12), (15, 0)]]), 4)
    assert codes[0].tolist() == [0b1010, 0b0101] and set(codes[1].tolist()) == {3, 12}
    assert flips.tolist() == [0, 1] and errors.tolist() == [0, 0]
    rows = spark.createDataFrame([(1, k, a, b) for k in range(3)] + [(2, 0, 0, 0), (3, 0, 1, 1), (3, 1, 1, 0), (3, 2, 0, 0)], "sample_id long, round int, code1 long, code2 long")
    out = {r.sample_id: r for r in phasing.consensus(rows, 4, "sample_id").collect()}
    assert {out[1].code1, out[1].code2} == {a, b} and (out[2].code1, out[2].errors) == (0, 0.0)
    assert (out[3].code1, out[3].code2, out[3].flips, round(out[3].errors, 6)) == (0, 0, 0.0, round(2 / 3, 6))
    assert phasing.consensus(rows.limit(0), 4, "sample_id").count() == 0


def test_initial_haplotypes_follow_the_posterior(spark):
    rows = spark.range(20_000).select(F.col("id").alias("sample_id"), F.lit(1).alias("site"), F.lit(0.2).alias("p0"), F.lit(0.5).alias("p1"), F.lit(0.3).alias("p2"))
    out = phasing.initial_haplotypes(rows)
    share = {(r.allele1, r.allele2): r["count"] / 20_000 for r in out.groupBy("allele1", "allele2").count().collect()}
    assert abs(share[0, 0] - 0.2) < 0.02 and abs(share[1, 1] - 0.3) < 0.02 and abs(share[0, 1] - 0.25) < 0.02 and abs(share[1, 0] - 0.25) < 0.02
    assert out.exceptAll(phasing.initial_haplotypes(rows.repartition(7))).count() == 0


def test_distribution_functions(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.3, 1.0, 2.5, 7.0, 30.0)], "x double")
    x = F.col("x")
    rows = df.select("x", S.chi_square_tail(x, F.lit(2.0)).alias("chi"), S.t_tail(x, F.lit(1.0)).alias("t1"), S.t_tail(x, F.lit(2.0)).alias("t2"), S.f_tail(x, F.lit(2.0), F.lit(4.0)).alias("f"), S.normal_lower(x).alias("z"), S.normal_quantile(x / 31 + 0.01).alias("q"))
    for r in rows.collect():
        v = r.x
        assert math.isclose(r.chi, math.exp(-v / 2), rel_tol=1e-9)
        assert math.isclose(r.t1, 1 - 2 * math.atan(v) / math.pi, rel_tol=1e-8)
        assert math.isclose(r.t2, 1 - v / math.sqrt(2 + v * v), rel_tol=1e-8, abs_tol=1e-12)
        assert math.isclose(r.f, (1 + v / 2) ** -2, rel_tol=1e-8)
        assert math.isclose(r.z, 0.5 * math.erfc(-v / math.sqrt(2)), rel_tol=1e-9)
        assert math.isclose(S.gamma_upper([3.0], [v])[0], math.exp(-v) * (1 + v + v * v / 2), rel_tol=1e-9)
        assert math.isclose(S.log_gamma([v + 0.1])[0], math.lgamma(v + 0.1), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(0.5 * math.erfc(-r.q / math.sqrt(2)), v / 31 + 0.01, rel_tol=1e-8)
    none = df.limit(1).select(S.t_tail(x, F.lit(0.0)), S.normal_quantile(x), S.f_tail(F.lit(1.0), x, x), S.chi_square_tail(F.lit(None).cast("double"), F.lit(1.0))).first()
    assert list(none) == [None] * 4 and np.isnan(S.log_gamma([0.0, -1.0])).all()


def test_exact_smirnov():
    for m, n in ((2, 3), (3, 3), (4, 6)):
        distances = []
        for at in itertools.combinations(range(m + n), m):
            steps = np.where(np.isin(np.arange(m + n), at), 1 / m, -1 / n)
            distances.append(np.abs(steps.cumsum()).max())
        for d in {round(x, 9) for x in distances}:
            assert math.isclose(S.smirnov(m, n, d)[0], np.mean([x < d - 1e-9 for x in distances]), abs_tol=1e-12)
    # the two goldens: one exact, one by the limit distribution
    assert math.isclose(1 - S.smirnov(21, 57, 948 / 1197)[0], 3.054e-10, rel_tol=1e-3)
    assert math.isclose(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * 0.38**2 * 50) for k in range(1, 9)), 1.071e-06, rel_tol=1e-3)


def test_smirnov_with_ties(spark):
    """Against all ways to deal the pooled values to the two samples."""
    for pooled, m in (([1, 1, 2, 3, 3, 3, 5], 3), ([1, 1, 1, 1, 2, 2, 4, 9], 4), ([7] * 6, 2), ([1, 2, 2, 3, 4, 4, 4, 8, 9], 2)):
        n, values = len(pooled) - m, sorted(set(pooled))
        sizes = np.array([pooled.count(v) for v in values])
        found = []
        for at in itertools.combinations(range(len(pooled)), m):
            one = [pooled[k] for k in at]
            rest = [pooled[k] for k in range(len(pooled)) if k not in at]
            found.append(max(abs(sum(x <= v for x in one) / m - sum(x <= v for x in rest) / n) for v in values))
        ends = np.zeros((1, len(pooled)), bool)
        ends[0, np.cumsum(sizes) - 1] = True
        for d in {round(x, 9) for x in found if x > 0}:
            assert math.isclose(S.smirnov(m, n, d, ends)[0], np.mean([x < d - 1e-9 for x in found]), abs_tol=1e-12)
    rows = spark.createDataFrame([(1, g, v) for g, v in [(0, 1), (0, 1), (0, 3), (1, 1), (1, 2), (1, 3), (1, 3), (1, 5)]] + [(2, 0, 1), (2, 1, 2)], "k int, g int, v int")
    out = {r.k: r for r in genotypes.ks_test(genotypes.ks_distance(rows, "k", "g", "v")).collect()}
    far = lambda one, rest: max(abs(sum(x <= v for x in one) / 3 - sum(x <= v for x in rest) / 5) for v in (1, 2, 3, 5))
    pooled = [1, 1, 3, 1, 2, 3, 3, 5]
    ways = [far([pooled[k] for k in at], [pooled[k] for k in range(8) if k not in at]) for at in itertools.combinations(range(8), 3)]
    assert math.isclose(out[1].p, np.mean([x >= out[1].d - 1e-9 for x in ways]), rel_tol=1e-9) and math.isclose(out[2].p, 1.0)


def test_one_sample_kolmogorov():
    # n = 1: D is uniform on (1/2, 1); n = 2 by its piecewise form; and a limit
    assert math.isclose(S.kolmogorov_one(1, 0.75), 0.5) and math.isclose(S.kolmogorov_one(2, 0.4), 2 * (2 * 0.4 - 0.5) ** 2)
    x = 0.12 * math.sqrt(2000)
    assert abs(S.kolmogorov_one(2000, 0.12 / math.sqrt(10) * 1.0) - (1 - 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * (x / math.sqrt(10)) ** 2) for k in range(1, 50)))) < 0.02


def test_ks_decisions(spark):
    rows = spark.createDataFrame([("a", 0.5, 2, 2, 2.4), ("b", 948 / 1197, 21, 57, 0.4), ("c", 0.38, 100, 100, 0.25), ("d", 0.1, 200, 100, 0.2)], "k string, d double, n long, m long, bound double")
    out = {r.k: r for r in genotypes.ks_test(rows).collect()}
    assert out["a"].p == 1 and out["a"].similar and math.isclose(out["b"].p, 3.054e-10, rel_tol=1e-3) and not out["b"].similar
    assert math.isclose(out["c"].p, 1.071e-06, rel_tol=1e-3) and not out["c"].similar and out["d"].similar


def test_error_rates(spark):
    rows = spark.createDataFrame([(90, 10, 0), (90, 10, 20), (0, 0, 0), (50, 50, 10)], "a long, b long, u long")
    got = [r.e for r in rows.select(G.error_rate(F.col("a"), F.col("b"), F.col("u")).alias("e")).collect()]
    r = 0.1
    for _ in range(100):
        r = (10 + 40 * r * r / (r * r + (1 - r) ** 2)) / 140
    assert got[0] == 0.1 and abs(got[1] - r) < 1e-4 and got[2] == 0 and abs(got[3] - 0.5) < 1e-9


TEXT = """##fileformat=VCFv4.1
##note
##a=b=c
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t10\tr1\ta\tc\t.\tPASS\tAF=0.25;DB;AF=9\tGT:DP:PL\t0/1:7:10,0,20\t./.
chr1\tx\tr2\tG\tT,a\t12.6\tq10;s50\t.\tGT:GD:GQ:DS\t1|0:3:40:0.5\t2/1:9:5:.
chrX\t5\t.\tC\tT\t0\t.\tAC=3;AN=9\tGT\t1\t.
20\t7\tr4\tA\t.\t-3\tPASS\tAC=1\tGL\t-1.25,-0.5,-3\t-0,-1,-2
"""


def test_reading_vcf(spark):
    rows = spark.createDataFrame([(x,) for x in TEXT.splitlines()], "value string")
    assert vcf.meta(rows).collect() == [("fileformat", "VCFv4.1"), ("note", ""), ("a", "b=c")]
    assert vcf.header(rows)[8:] == ["FORMAT", "s1", "s2"]
    assert vcf.samples(rows).collect() == [(0, "s1"), (1, "s2")]
    r = vcf.records(rows).collect()
    assert [x.pos for x in r] == [10, 0, 5, 7] and [x.ref for x in r] == ["A", "G", "C", "A"]
    assert r[1].alts == ["T", "A"] and [round(x.qual, 1) for x in r] == [-1, 12.6, 0, -3] and r[1].filters == ["q10", "s50"]
    assert r[0].info == {"AF": "0.25", "DB": ""} and r[1].info == {} and r[2].info == {"AC": "3", "AN": "9"}
    found = {(x.pos, x.sample_idx): x for x in vcf.calls(vcf.records(rows), "pos").withColumn("pl", vcf.phreds(F.col("fields"))).collect()}
    assert found[10, 0].genotype == 1 and found[10, 0].pl == [10, 0, 20] and found[10, 0].depth == 7
    assert found[10, 1].genotype == 65535 and found[10, 1].pl is None and found[10, 1].fields == {"GT": "./.", "DP": "", "PL": ""}
    assert found[0, 0].genotype == 1 << 15 | 1 << 8 and abs(found[0, 0].dosage - 0.5) < 1e-9 and found[0, 1].genotype == 1 << 8 | 2 and found[0, 1].dosage is None
    assert found[5, 0].genotype == 1 << 8 | 0xFF and found[5, 1].genotype == 65535
    assert found[7, 0].genotype == 65535 and found[7, 0].pl == [12, 5, 30]
    low = {(x.pos, x.sample_idx): x.genotype for x in vcf.calls(vcf.records(rows), "pos", least_depth=5, least_quality=10).collect()}
    assert low[0, 0] == 65535 and low[0, 1] == 65535 and low[10, 0] == 1
    freq = [x.f for x in vcf.records(rows).select(G.panel_ref_freq(F.col("info"), F.col("alts")).alias("f")).collect()]
    assert freq == [0.75, 1e-6, 1 - 3.5 / 10, 1e-6]
    assert vcf.biallelic(vcf.records(rows)).count() == 3
    with pytest.raises(Exception, match="differ in number"):
        vcf.calls(vcf.records(spark.createDataFrame([("1\t1\t.\tA\tC\t.\t.\t.\tGT:DP\t0/1",)], "value string")), "pos").collect()
    with pytest.raises(Exception, match="cannot parse"):
        vcf.calls(vcf.records(spark.createDataFrame([("1\t1\t.\tA\tC\t.\t.\t.\tGT\t0",)], "value string")), "pos").collect()
    with pytest.raises(ValueError):
        vcf.header(rows.where("value LIKE '##%'"))


def test_vcf_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(x,) for x in TEXT.splitlines()], "value string")
    sites = vcf.records(rows).withColumn("key", F.concat_ws(":", "chrom", "pos"))
    found = vcf.calls(sites, "key")
    values = found.select("key", "sample_idx", sinks.genotype_text(F.col("genotype")).alias("text"))
    sinks.write(spark, sinks.header_lines(vcf.meta(rows), vcf.samples(rows)), sinks.record_lines(sites, values), f"{tmp_path}/out")
    again = vcf.lines(spark, f"{tmp_path}/out")
    assert [r.value for r in again.limit(4).collect()] == ["##fileformat=VCFv4.1", "##note=", "##a=b=c", TEXT.splitlines()[3]]
    assert [r.value.split("\t")[:2] for r in again.collect()[4:]] == [["20", "7"], ["chr1", "0"], ["chr1", "10"], ["chrX", "5"]]
    keep = ["key", "sample_idx", "genotype"]
    second = vcf.calls(vcf.records(again).withColumn("key", F.concat_ws(":", "chrom", "pos")), "key")
    assert sorted(map(tuple, second.select(keep).collect())) == sorted(map(tuple, found.select(keep).collect()))
    lines = {r.value.split("\t")[2]: r.value.split("\t") for r in sinks.record_lines(sites).collect()}
    assert lines["r2"][5:] == ["13", "q10;s50", "."] and lines["r1"][7] == "AF=0.25;DB" and lines["r4"][5] == "."
    counts = {r.key: (r.ac, r.an, r.ns) for r in sinks.site_counts(found, "key").collect()}
    assert counts == {"chr1:10": (1, 2, 1), "chr1:0": (3, 4, 2), "chrX:5": (1, 2, 1), "20:7": (0, 0, 0)}


def test_side_files(spark, tmp_path):
    (tmp_path / "ids").write_text("a\n\n b \n")
    assert [r.sample_id for r in vcf.id_list(spark, f"{tmp_path}/ids").collect()] == ["a", "b"]
    (tmp_path / "map").write_text("chr bp cM\n1 100 0.5\n1 200 0.75\n1 100 0.6\n")
    assert sorted(map(tuple, vcf.genetic_map(spark, f"{tmp_path}/map").collect())) == [("chr1", 100, 0.6), ("chr1", 200, 0.75)]
    (tmp_path / "rates").write_text("interval rate\nx 0.5\ny 0.25\n")
    assert [tuple(r) for r in vcf.rate_map(spark, f"{tmp_path}/rates").orderBy("ordinal").collect()] == [(0, 0.5), (1, 0.25)]
    (tmp_path / "sites").write_text("chr1 10 A C 0.75 0.01\n")
    assert tuple(vcf.site_file(spark, f"{tmp_path}/sites").first()) == ("chr1", 10, "A", "C", 0.75, 0.01)


def test_sample_selection_with_empty_lists(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "a"), (1, 1, "c")], "source int, sample_idx int, sample_id string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "sample_id string")
    names = lambda *lists: sorted(r.person for r in markers.selected_samples(rows, *lists).collect())
    assert names() == ["a", "a_dup", "b", "c"] == names(ids(), ids())
    assert names(ids("a", "c")) == ["a", "a_dup", "c"] and names(None, ids("a")) == ["b", "c"] and names(ids("z")) == []


def test_maps_across_ranges(spark):
    rng = np.random.default_rng(5)
    at = sorted(rng.choice(10_000, 80, replace=False).tolist())
    cm = np.sort(rng.random(80) * 50).tolist()
    points = spark.createDataFrame([("c", a, c) for a, c in zip(at, cm)], "chrom string, bp long, cm double")
    sites = sorted(rng.choice(12_000, 300, replace=False).tolist()) + at[:5]
    table = spark.createDataFrame([(k, "c", p) for k, p in enumerate(sites)] + [(9999, "d", 5)], "site long, chrom string, pos long")
    for width in (50, 700, 10**6):
        placed = markers.interpolated(table, points, width)
        got = {r.site: r.cm for r in placed.collect()}
        assert got.pop(9999) is None
        assert all(abs(got[k] - np.interp(p, at, cm)) < 1e-9 for k, p in enumerate(sites))
        rate = {r.site: r.rate for r in markers.rates(placed.where("cm IS NOT NULL"), width).collect()}
        order = sorted(range(len(sites)), key=lambda k: (sites[k], k))
        assert order[0] not in rate and len(rate) == len(sites) - 1
        for a, b in zip(order, order[1:]):
            assert abs(rate[b] - max((1 + got[a] / 200) ** -2 - (1 + got[b] / 200) ** -2, 1e-5)) < 1e-12
    assert {r.rate for r in markers.theta(table).collect()} == {0.01}
    assert markers.theta(table, points).count() == len(sites) + 1


def test_other_allele(spark):
    rows = spark.createDataFrame([("A", "A", "0"), ("A", "0", "A"), ("A", "T", "G"), ("A", "C", "G"), ("A", "C", "A"), ("A", "T", "0")], "r string, a string, b string")
    got = rows.select(markers.resolved_alt(F.col("r"), F.col("a"), F.col("b")), markers.resolved_alt(F.col("r"), F.col("a"), F.col("b"), flip=False)).collect()
    assert [tuple(r) for r in got] == [(".", "."), (".", "."), ("C", "."), (".", "."), ("C", "C"), (".", ".")]


#: 600 haplotypes of 4 sites, whose nodes merge.
MERGING = [("0000", 21), ("0001", 79), ("0011", 95), ("0110", 116), ("1000", 25), ("1001", 112), ("1011", 152)]


def test_merged_graph(spark):
    rows, k = [], 0
    for text, n in MERGING:
        rows += [(3, k + i, sum(1 << s for s in range(4) if text[s] == "1")) for i in range(n)]
        k += n
    table = spark.createDataFrame(rows, "region long, hap_id long, code long")
    nodes, edges = merging.merged_graph(table, 4)
    found = {}
    for r in nodes.orderBy("site", "node").collect():
        found.setdefault(r.site, []).append((r.allele, r.n))
    assert [len(found[s]) for s in range(3)] == [2, 2, 3]
    assert [[a for a, _ in found[s]] for s in range(3)] == [[0, 1], [0, 1], [0, 1, 1]] or sorted(a for a, _ in found[2]) == [0, 1, 1]
    assert sorted(n for _, n in found[3]) == [46, 116, 191, 247]
    assert {r["s"] for r in edges.groupBy("site").agg(F.sum("n").alias("s")).collect()} == {600}
    assert merging.merged_graph(table.limit(0), 4)[0].count() == 0


#: Two sets of places, and whether they overlap.
OVERLAPS = [([1, 2, 3, 4, 6, 7], [5, 8, 9], False), ([1, 2, 3, 4, 6, 7], [5], True), ([1, 2, 3, 4, 6, 7], [9], False), ([1, 2, 3, 4, 6, 7], [-1, 9], True)]


def test_overlapping_sets(spark):
    for a, b, exp in OVERLAPS:
        assert merging.overlapping(np.array(a), np.array(b)) is exp and merging.overlapping(np.array(b), np.array(a)) is exp
    rows = spark.createDataFrame([(k, g, x) for k, (a, b, _) in enumerate(OVERLAPS) for g, s in enumerate((a, b)) for x in s], "k int, g int, x int")
    assert [r.overlaps for r in merging.overlap(rows, "k", "g", "x").orderBy("k").collect()] == [exp for *_, exp in OVERLAPS]
    assert merging.overlap(rows.where("g = 0"), "k", "g", "x").count() == 0


def test_look_ahead():
    assert merging.next_ahead(0.5, 100, 100) == 10 and merging.next_ahead(1.5, 80, 100) == 96
    assert merging.next_ahead(3.0, 96, 100) == 115 and merging.next_ahead(1.5, 96, 100) == 100


def plain_merge(members, allele, related, site, sites, ahead):
    """Greedy merging of groups of (code, count) by plain loops over all pairs; gives the group each ends in."""
    behind = sites - 1 - site
    rev = lambda c: sum((c >> (site + 1 + j) & 1) << (behind - 1 - j) for j in range(behind))
    everything = sorted((rev(c), c, n, allele[g]) for g, m in enumerate(members) for c, n in m)
    place, at, before = {}, 0.0, {}
    for key, code, n, side in everything:
        length = 0
        if side in before:
            length = 1 + next((j for j in range(behind) if (key ^ before[side]) >> (behind - 1 - j)), behind)
        before[side] = key
        for k in range(n):
            at += 1 / max(length if k == 0 else behind + 1, 20)
            place.setdefault(key, []).append(at)
    members, into, related = [list(m) for m in members], list(range(len(members))), list(related)

    def test(a, b):
        na, nb = (sum(n for _, n in members[g]) for g in (a, b))
        share = lambda g, t, w, n: sum(k for c, k in members[g] if rev(c) >> (behind - t) == w) / n
        keys = [[x for c, n in members[g] for x in [rev(c)] * n] for g in (a, b)]
        if na * nb < 10_000:
            d = max(abs(share(a, t, w, na) - share(b, t, w, nb)) for t in range(1, min(ahead, behind) + 1) for w in {rev(c) >> (behind - t) for g in (a, b) for c, _ in members[g]})
            ok = d <= 0.8 * 0.9 * math.sqrt(1 / na + 1 / nb) + 1e-12
            if min(na, nb) <= 5:
                less, more = (keys[0], keys[1]) if na < nb else (keys[1], keys[0])
                near = lambda x: {k >> (behind - min(5, behind)) for k in x}
                ok &= near(less) <= near(more) or na == nb and near(more) <= near(less)
            return (0.10001, d) if ok else None
        # haplotypes that go on alike share their coordinates
        y, yy = ([sum(np.mean(np.array(place[k]) ** e) for k in keys[g]) for g in (0, 1)] for e in (1, 2))
        n, sx = na + nb, nb
        vx, vy = n * sx - sx * sx, n * sum(yy) - sum(y) ** 2
        r2 = (n * y[1] - sx * sum(y)) ** 2 / (vx * vy)
        t = math.sqrt(r2 * (n - 2) / max(1 - r2, 1e-12))
        if S.t_two_sided(np.array([t]), np.array([n - 2.0]))[0] < 0.05 or not merging.overlapping(np.sort(keys[0]), np.sort(keys[1])):
            return None
        d = max(abs(np.mean(np.array(keys[0]) <= v) - np.mean(np.array(keys[1]) <= v)) for v in set(keys[0] + keys[1]))
        z = d * math.sqrt(na * nb / (na + nb))
        p = 1.0 if z <= 0 else min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 200)))
        return (p, d) if p > 0.1 else None

    while True:
        pairs = []
        for a, b in itertools.combinations([g for g in range(len(members)) if members[g]], 2):
            if allele[a] == allele[b] and (related[a] or related[b]) and (found := test(a, b)):
                pairs.append((-round(found[0], 9), round(found[1], 12), a, b))
        if not pairs:
            return into
        _, _, a, b = min(pairs)
        members[a] += members[b]
        members[b] = []
        related[a] |= related[b]
        into = [a if g == b else g for g in into]


@pytest.mark.parametrize("most, block", [(40, 1 << 22), (400, 1 << 22), (4, 64)])
def test_merging_against_loops(monkeypatch, most, block):
    monkeypatch.setattr(merging, "BLOCK", block)
    rng, merges = np.random.default_rng(most), 0
    for _ in range(12):
        sites, codes = 7, np.unique(rng.integers(0, 128, 40))
        counts = rng.integers(1, most, len(codes))
        for site in (1, 3):
            node = np.unique(codes & ((2 << site) - 1), return_inverse=True)[1] % 6 * 2 + (codes >> site & 1)
            found, node = np.unique(node, return_inverse=True)
            allele, related = found % 2, rng.random(len(found)) < 0.7
            behind = sites - 1 - site
            key = np.array([sum((c >> (site + 1 + j) & 1) << (behind - 1 - j) for j in range(behind)) for c in codes.tolist()])
            order = np.lexsort((codes, key))
            here = merging.Site(key[order], counts[order], node[order], allele, related, behind, 16)
            got = np.empty(len(codes), int)
            got[order] = here.merge(False)[0]
            members = [[(c, n) for c, n, k in zip(codes.tolist(), counts.tolist(), node.tolist()) if k == g] for g in range(len(found))]
            into = plain_merge(members, allele.tolist(), related.tolist(), site, sites, 16)
            assert got.tolist() == [into[k] for k in node.tolist()]
            merges += len(set(into)) < len(found)
    assert merges


def test_look_ahead_grows_with_what_is_undecided():
    """Alike nodes over few sites keep the look-ahead going; what goes on unlike farther off is then told apart."""
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 14, 300))
    counts = rng.integers(1, 9, len(codes))
    near, far = (merging.merged_edges(codes, counts, 14, k) for k in (2, 16))
    assert sum(e[4] for e in near if e[0] == 13) == sum(e[4] for e in far if e[0] == 13) == counts.sum()
    assert len([e for e in near if e[0] == 5]) <= len([e for e in far if e[0] == 5])


def test_cheapest_cut_against_all_cuts():
    rng = np.random.default_rng(9)
    for _ in range(15):
        sites, n = 6, int(rng.integers(4, 40))
        codes = rng.integers(0, 1 << int(rng.integers(1, sites + 1)), n)
        unique = np.zeros((1, sites, sites))
        for a in range(sites):
            for b in range(a, sites):
                unique[0, a, b] = len(set(((codes >> a) & ((2 << b - a) - 1)).tolist()))

        def price(first, last):
            u = unique[0, first, last]
            return math.inf if u > n / 2 else (4 * u * u + u * n) * (last - first) + 2 * n * n

        def cheapest(at):
            if at == 0:
                return n * n
            return min([cheapest(at - 1) + n * n, *(cheapest(f) + price(f, at) for f in range(at))])

        cost, starts = selection.cheapest_cut(unique, np.array([float(n)]))
        assert cost[0] == cheapest(sites - 1)
        paid = sum(n * n if f == k else price(f, k) for k, f in enumerate(starts[0].tolist()) if f >= 0)
        assert paid == cost[0]


def test_nearest_people_against_loops(spark, monkeypatch):
    monkeypatch.setattr(selection, "BLOCK", 4)
    rng, sites = np.random.default_rng(2), 9
    codes = rng.integers(0, 1 << sites, (11, 2))
    rows = [(5, 2 * p + k, int(codes[p, k])) for p in range(11) for k in (0, 1)] + [(5, 99, 3), (6, 0, 1)]
    haps = spark.createDataFrame(rows, "region long, hap_id long, code long")
    bit = lambda c, s: int(c) >> s & 1

    def cost(t, a, b):
        return min(sum(2 * (bit(t, s) != bit((a, b)[w[s]], s)) for s in range(sites)) + sum(2 * (x != y) for x, y in zip(w, w[1:])) for w in itertools.product((0, 1), repeat=sites))

    def run(x):
        return max(len(r) for r in format(x, f"0{sites}b").split("1"))

    exp = {}
    for a in range(11):
        near = sorted((min(cost(t, *codes[b]) for t in codes[a]), b) for b in range(11) if b != a)[:3]
        for rank, (c, b) in enumerate(near):
            apart = [int(x ^ y) for x in codes[a] for y in codes[b]]
            exp[a, rank + 1] = (b, c, sum(bin(x).count("1") for x in apart), max(map(run, apart)))
    got = {(r.person, r.rank): (r.other, r.switches, r.mismatches, r.longest) for r in selection.nearest_people(haps, sites, 3).collect()}
    assert got == exp and selection.nearest_people(haps.limit(0), sites, 3).count() == 0


def test_weighted_sample(spark):
    rows = spark.createDataFrame([(g, k, float(w)) for g in range(600) for k, w in enumerate((4, 2, 1, 0, 1))], "g long, k long, w double")
    got = selection.sampled(rows, "w", 2, 7, "g", item="k").collect()
    share = Counter(r.k for r in got)
    assert len(got) == 1200 and share[3] == 0 and share[0] > share[1] > max(share[2], share[4])
    # P(item 0 is drawn) of two draws without replacement
    first = {0: 0.5, 1: 0.25, 2: 0.125, 4: 0.125}
    exp = first[0] + sum(p * 4 / (8 - w) for k, p, w in ((1, 0.25, 2), (2, 0.125, 1), (4, 0.125, 1)))
    assert abs(share[0] / 600 - exp) < 0.06
    assert sorted(map(tuple, got)) == sorted(map(tuple, selection.sampled(rows.repartition(7), "w", 2, 7, "g", item="k").collect()))


def test_phase_carried_over_ranges(spark):
    """Turns and phase sets by ranges of windows are those of one walk."""
    rng = np.random.default_rng(4)
    votes = [(g, w, int(rng.integers(0, 3)), int(rng.integers(0, 3))) for g in range(3) for w in range(1, 40) if rng.random() < 0.9]
    windows = spark.createDataFrame([(g, w) for g in range(3) for w in range(40)], "g long, window long")
    table = spark.createDataFrame(votes, "g long, window long, same long, other long")
    got = {(r.g, r.window): (r.turned, r.phase_set) for r in stitching.carried(windows, table, "g", width=7).collect()}
    by = {(g, w): (a, b) for g, w, a, b in votes}
    for g in range(3):
        turned, phase_set = False, 0
        for w in range(40):
            same, other = by.get((g, w), (0, 0))
            turned ^= other > same
            phase_set += w > 0 and same == other
            assert got[g, w] == (turned, phase_set)


def test_places(spark):
    for n, sites, overlap in ((32, 16, 8), (7, 16, 8), (200, 24, 6), (17, 16, 0)):
        markers_ = spark.createDataFrame([(f"k{o}", "c", o) for o in range(n)], "key string, chrom string, ordinal long")
        rows = stitching.places(markers_, sites, overlap).collect()
        step = sites - overlap
        assert Counter(r.key for r in rows if r.core) == {f"k{o}": 1 for o in range(n)}
        for r in rows:
            assert r.window * step + r.site == int(r.key[1:]) and 0 <= r.site < sites
        ends = {w: sorted(r.site for r in rows if r.window == w) for w in {r.window for r in rows}}
        assert all(s == list(range(sites)) for w, s in ends.items() if w < max(ends)) and ends[max(ends)][0] == 0
    with pytest.raises(ValueError):
        stitching.places(markers_, 16, 9)


def random_graph(rng, sites, haps):
    """Levels of a graph of `haps` haplotypes whose nodes are their last four alleles."""
    codes, out, before = rng.integers(0, 1 << sites, haps), [], np.zeros(haps, int)
    for site in range(sites):
        found, node = np.unique((codes >> max(0, site - 3)) & ((1 << min(4, site + 1)) - 1), return_inverse=True)
        counts = np.zeros((before.max() + 1, len(found)))
        np.add.at(counts, (before, node), 1)
        out.append((found >> min(3, site) & 1, np.bincount(node) / haps, counts / counts.sum(1, keepdims=True)))
        before = node
    return out


@pytest.mark.parametrize("rate, error", [(0.01, 0.0), (0.2, 0.03), (0.0, 0.01)])
def test_pairs_that_are_kept(rate, error):
    rng = np.random.default_rng(6)
    for _ in range(6):
        sites = 7
        graph, phreds = random_graph(rng, sites, 60), rng.integers(0, 40, (1, sites, 3)).astype(float)
        rates, errors = np.full(sites, rate), np.full(sites, error)
        whole = phasing.forward(graph, phreds, rates, errors)
        for kept, full in zip(phasing.forward_pairs(graph, phreds[0], rates, errors, 10**6), whole):
            dense = np.zeros(full[0].shape)
            dense[kept[1], kept[2]] = kept[0]
            assert np.allclose(dense, full[0], atol=1e-12)
        few = phasing.forward_pairs(graph, phreds[0], rates, errors, 5)
        for site in range(1, sites):
            values, i, j = few[site - 1]
            before = np.zeros((len(graph[site - 1][0]),) * 2)
            before[i, j] = values
            alleles, _, step = graph[site]
            exp = (step.T @ phasing.mixed(before[None], graph[site - 1][1], rate) @ step * phasing.emissions(phreds[:, site], alleles, error))[0]
            top = np.sort(exp.ravel())[::-1][:5]
            got = exp[few[site][1], few[site][2]]
            assert len(got) == min(5, (exp > 0).sum()) and np.allclose(got, top[: len(got)]) and np.allclose(few[site][0], got / got.sum())


def test_draws_from_kept_pairs():
    rng = np.random.default_rng(7)
    graph, phreds, rates, errors = random_graph(rng, 6, 30), rng.integers(0, 15, (1, 6, 3)).astype(float), np.full(6, 0.05), np.zeros(6)
    keys = phasing.draw_keys(3, [4], 4000)
    codes, crossed = phasing.draw_pairs(graph, rates, 1, keys, phasing.forward_pairs(graph, phreds[0], rates, errors, 10**6))
    share = np.array([[np.mean(((codes >> s) & 1).sum(1) == d) for d in range(3)] for s in range(6)])
    assert np.abs(share - phasing.posterior(graph, phreds, rates)[0]).max() < 0.04
    assert 0 < np.mean((crossed >> 3) & 1) < 0.2 and not (crossed & 1).any()


def mosaic_case(rng, states=3, sites=5):
    alleles = rng.integers(0, 2, (1, states, sites))
    phreds = rng.integers(0, 12, (1, sites, 3)).astype(float)
    phreds[0, [1, 2]] = 5.0  # nothing is read there
    rates = np.concatenate([[0.0], rng.uniform(0.05, 0.3, sites - 1)])
    return alleles, rng.uniform(0.5, 2, (1, states)), phreds, rates, np.full(sites, 0.05)


def mosaic_paths(alleles, weights, phreds, rates, errors):
    """The probability of each pair of paths, from all of them."""
    _, states, sites = alleles.shape
    w, like = weights[0] / weights.sum(), 10.0 ** (-0.1 * phreds[0])
    pairs = list(itertools.product(range(states), repeat=2))
    found = {}
    for path in itertools.product(pairs, repeat=sites):
        p = 1.0
        for s, (i, j) in enumerate(path):
            for now, old in ((i, path[s - 1][0]), (j, path[s - 1][1])):
                p *= w[now] if s == 0 else rates[s] * w[now] + (1 - rates[s]) * (now == old)
            dose = alleles[0, i, s] + alleles[0, j, s]
            p *= phasing.penetrance(errors[s])[dose] @ like[s]
        found[path] = p
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


def test_mosaics_are_drawn_as_all_paths_say():
    rng = np.random.default_rng(13)
    case = mosaic_case(rng)
    exp = mosaic_paths(*case)
    keys = phasing.draw_keys(1, [3], 20_000)
    drawn = mosaic.Mosaic(*case).draw(2, keys)
    assert (drawn == mosaic.Mosaic(*case, every=1).draw(2, keys)).all() and (drawn == mosaic.Mosaic(*case, every=50).draw(2, keys)).all()
    for s in range(5):
        for pair in itertools.product(range(3), repeat=2):
            assert abs(np.mean((drawn[:, :, s] == pair).all(1)) - sum(p for path, p in exp.items() if path[s] == pair)) < 0.02
        if s:  # joint with the site before, skipped ones included
            for side in (0, 1):
                same = sum(p for path, p in exp.items() if path[s][side] == path[s - 1][side])
                assert abs(np.mean(drawn[:, side, s] == drawn[:, side, s - 1]) - same) < 0.02
    # the forward sums at the last site
    last = mosaic.Mosaic(*case)
    got = last.at(len(last.sites) - 1)[0]
    assert np.allclose(got, [[sum(p for path, p in exp.items() if path[4] == (i, j)) for j in range(3)] for i in range(3)], atol=1e-9)
    kept, steps = mosaic.kept_sites(case[2], case[3])
    assert kept.tolist() == [0, 3, 4] and math.isclose(steps[1], 1 - np.prod(1 - case[3][1:4]))


def test_mosaics_of_a_table(spark):
    one, two = 0b00110101, 0b11001010
    chosen = spark.createDataFrame([(1, s, h, c, 1.0) for s in (5, 6) for h, c in ((0, one), (1, two), (2, one ^ 255), (3, 0))], "region long, sample_id long, hap_id long, code long, weight double")
    phreds = spark.createDataFrame([(1, s, k, *((0, 60, 120) if (one >> k & 1) + (two >> k & 1) == 0 else (60, 0, 60) if (one >> k & 1) + (two >> k & 1) == 1 else (120, 60, 0))) for s in (5, 6, 7) for k in range(8)], "region long, sample_id long, site int, pl0 long, pl1 long, pl2 long")
    rows = mosaic.mosaics(phreds, chosen, 8, 3, 0.001, 0.001).collect()
    assert len(rows) == 6 and {r.sample_id for r in rows} == {5, 6}
    for r in rows:
        assert r.code1 ^ r.code2 == 255 and len(r.sources1) == len(r.sources2) == 8 and set(r.sources1) | set(r.sources2) <= {0, 1, 2, 3}
        codes = {0: one, 1: two, 2: one ^ 255, 3: 0}
        assert r.code1 == sum((codes[h] >> k & 1) << k for k, h in enumerate(r.sources1))
        assert r.crossed1 == sum(1 << k for k in range(1, 8) if r.sources1[k] != r.sources1[k - 1])
    assert mosaic.mosaics(phreds.limit(0), chosen, 8, 1).count() == 0


def test_marginals_and_case_shares(spark):
    rng = np.random.default_rng(21)
    for kept in (True, False):
        case = mosaic_case(rng)
        if not kept:
            case[2][0, 0] = 3.0  # nothing is read at the first site either
        exp, got = mosaic_paths(*case), mosaic.Mosaic(*case).marginals()[0]
        for s in range(5):
            for h in range(3):
                assert math.isclose(got[s, h], sum(p * ((path[s][0] == h) + (path[s][1] == h)) for path, p in exp.items()), abs_tol=1e-7)
    alleles, weights, phreds, rates, errors = case
    codes = [int(sum(int(a) << k for k, a in enumerate(row))) for row in alleles[0]]
    people = [(4, 2), (5, 1), (6, 0)]  # a case, a control, and one of unknown status
    chosen = spark.createDataFrame([(1, 9, 2 * p, c, float(w)) for (p, _), c, w in zip(people, codes, weights[0])], "region long, sample_id long, hap_id long, code long, weight double")
    reads = spark.createDataFrame([(1, 9, k, *map(int, phreds[0, k])) for k in range(5)], "region long, sample_id long, site int, pl0 long, pl1 long, pl2 long")
    table = spark.createDataFrame([(1, k, float(rates[k]), float(errors[k])) for k in range(5)], "region long, site int, rate double, error double")
    status = spark.createDataFrame([x for x in people if x[1]], "sample_id long, status int")
    out = {r.site: r for r in mosaic.case_shares(reads, chosen, status, 5, table).collect()}
    for s in range(5):
        share = got[s, 0] / (got[s, 0] + got[s, 1])
        assert math.isclose(out[s].share, share, abs_tol=1e-7) and math.isclose(out[s].score, 0.5 * share - 0.5 * (1 - share), abs_tol=1e-7)
    assert mosaic.case_shares(reads, chosen, status.limit(0), 5, table).count() == 0


def test_label_branches(spark):
    cases = {  # the panel's two, the sample's labels, what becomes of them
        "same": ("A", "C", ["A", "C"], {"A": "A", "C": "C"}, "same"),
        "numbers": ("A", "C", ["1", "2"], {"1": "A", "2": "C"}, "renamed"),
        "one number": ("A", "C", ["A", "2"], {"A": "A", "2": "C"}, "renamed"),
        "other strand": ("A", "C", ["T", "G"], {"T": "A", "G": "C"}, "flipped"),
        "one of it": ("A", "C", ["G"], {"G": "C"}, "flipped"),
        "numbers of it": ("A", "C", ["4", "3"], {"4": "A", "3": "C"}, "renamed, flipped"),
        "each other's": ("A", "T", ["C", "G"], {"C": None, "G": None}, "mismatch"),
        "own and new": ("A", "C", ["A", "G"], {"A": None, "G": None}, "mismatch"),
        "long": ("A", "C", ["INS"], {"INS": None}, "mismatch"),
        "three new": ("A", "C", ["T", "G", "N"], {"T": None, "G": None, "N": None}, "mismatch"),
        "room": ("A", None, ["A", "G"], {"A": "A", "G": "G"}, "kept"),
    }
    panel = spark.createDataFrame([(k, a, b) for k, (a, b, *_) in cases.items()] + [("unseen", "A", "C")], "key string, allele0 string, allele1 string")
    seen = spark.createDataFrame([(k, x) for k, c in cases.items() for x in [*c[2], *c[2], None]] + [("no panel", "A")], "key string, label string")
    decided = labels.decisions(panel, seen)
    got = {}
    for r in decided.collect():
        got.setdefault(r.key, ({}, set()))[0][r.label] = r.to
        got[r.key][1].add(r.action)
    assert got == {k: (to, {action}) for k, (_, _, _, to, action) in cases.items()}
    calls = spark.createDataFrame([("other strand", "T", "G", 1), ("long", "INS", "INS", 2), ("same", "A", None, 3)], "key string, first string, second string, n int")
    assert {r.n: (r.first, r.second) for r in labels.relabelled(calls, decided, "first", "second").collect()} == {1: ("A", "C"), 2: (None, None), 3: ("A", None)}


def test_text_panels(spark, tmp_path):
    rng = np.random.default_rng(1)
    table = [(f"rs{k}", 1000 * k + 5, "A", "G" if k % 2 else "T") for k in range(300)]
    (tmp_path / "legend").write_text("rs position a0 a1\n\n" + "\n".join("  ".join(map(str, r)) for r in table) + "\n")
    haps = rng.integers(0, 2, (41, 300))
    (tmp_path / "haps").write_text("\n".join(" ".join(map(str, h)) for h in haps.tolist()) + "\n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")  # several splits a file
    try:
        legend, lines = panels.legend(spark, str(tmp_path / "legend")), panels.haplotypes(spark, str(tmp_path / "haps"), 300)
        assert lines.rdd.getNumPartitions() >= 1 and [tuple(r) for r in legend.select("ordinal", "name", "pos", "allele0", "allele1").orderBy("ordinal").collect()] == [(k, *r) for k, r in enumerate(table)]
        assert [r.alleles for r in lines.orderBy("hap_id").collect()] == ["".join(map(str, h)) for h in haps.tolist()]
        assert panels.long_form(lines).agg(F.sum("allele"), F.count(F.lit(1)), F.max("ordinal")).first()[:] == (int(haps.sum()), 41 * 300, 299)
        panels.write(panels.legend_lines(legend), str(tmp_path / "legend2"))
        panels.write(panels.haplotype_lines(lines), str(tmp_path / "haps2"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    text = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*")))
    assert text("haps2") == (tmp_path / "haps").read_text().rstrip("\n") + "\n"
    assert text("legend2").splitlines() == ["rs position a0 a1", *(" ".join(map(str, r)) for r in table)]
    (tmp_path / "bad").write_text("rs position a0 a1\nrs1 5 A\n")
    (tmp_path / "twice").write_text("h\nrs1 5 A C\nrs1 6 A C\n")
    with pytest.raises(Exception, match="four words"):
        panels.legend(spark, str(tmp_path / "bad")).collect()
    with pytest.raises(ValueError):
        panels.legend(spark, str(tmp_path / "twice"))
    for wrong in ("0 1 2", "0 1", "01 1 "):
        (tmp_path / "wrong").write_text(wrong + "\n")
        with pytest.raises(Exception, match="a haplotype is 3 alleles"):
            panels.haplotypes(spark, str(tmp_path / "wrong"), 3).collect()


def test_orders_of_regions_at_once_and_by_windows(spark, monkeypatch):
    """Regions that a task holds, a large one by windows, and one that has no name, against sorted strings."""
    rng = np.random.default_rng(12)
    rows = [(r, h, int(rng.integers(0, 1 << 6)) & int(rng.integers(0, 1 << 6))) for r, n in ((1, 40), (2, 90), (7, 1), (9, 30)) for h in range(n)] + [(None, h, None) for h in range(5)]
    haps = spark.createDataFrame(rows, "region long, hap_id long, code long").repartition(3)
    text = {(r, h): "".join(str(c >> s & 1) for s in range(6)) if c is not None else "" for r, h, c in rows}
    monkeypatch.setattr(haplotypes, "AT_ONCE", 16)
    kinds = (lambda h: haplotypes.forward_order(h, 6), lambda h: haplotypes.backward_order(h, 6), lambda h: merging.backward_coordinates(h, 6))
    for k, made in enumerate(kinds):
        got = {held: {(x.region, x.site, x.hap_id): tuple(x)[3:] for x in made(haps).collect()} for held in (10**6, 50) if not monkeypatch.setattr(haplotypes, "HELD", held)}
        whole = got[10**6]
        assert whole == got[50] and len(whole) == 6 * len(rows)
        for region in (1, 2, 7, 9, None):
            for site in range(6):
                own = sorted((h for r, h in text if r == region), key=lambda h: (text[region, h][site::-1] if not k else text[region, h][site:], h))
                assert [whole[region, site, h][0] for h in own] == list(range(len(own)))
                for before, h in zip(own, own[1:]):
                    a, b = ((text[region, x][site::-1] if not k else text[region, x][site:]) for x in (before, h))
                    assert region is None or whole[region, site, h][1] == len(a) - next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    assert all(whole[None, 0, h][2] == pytest.approx((h + 1) / merging.LEAST_LENGTH) for h in range(5))


@pytest.mark.parametrize("order", [haplotypes.forward_order, haplotypes.backward_order])
def test_orders_sort_no_row_for_each_site(spark, order):
    order(panel(spark), 4).write.format("noop").mode("overwrite").save()
    store = spark._jsparkSession.sharedState().statusStore()
    nodes = store.planGraph(store.executionsList().last().executionId()).allNodes()
    assert "Generate" not in {nodes.apply(k).name() for k in range(nodes.size())}


def generated(spark):
    """Rows that generators made in what ran last."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values = dict(re.findall(r"(\d+) -> ([\d,]+)", store.executionMetrics(last).toString()))
    nodes = store.planGraph(last).allNodes()
    each = [(n.name(), n.metrics().apply(k)) for n in map(nodes.apply, range(nodes.size())) for k in range(n.metrics().size())]
    return [int(values[str(m.accumulatorId())].replace(",", "")) for name, m in each if name == "Generate" and m.name() == "number of output rows"]


def test_draws_are_added_up_before_they_are_cut_into_sites(spark):
    rows = [(1, s, (s * 5 + k) % 8, (s + 3 * k) % 8) for s in range(20) for k in range(10)] + [(1, 20, None, 3), (1, 20, 5, 1), (1, 21, None, None)]
    drawn = spark.createDataFrame(rows, "region long, sample_id long, code1 long, code2 long")
    out = {(r.sample_id, r.site): r for r in genotypes.draw_dosages(drawn, 3, "region").collect()}
    assert generated(spark) == [22 * 3] and len(out) == 22 * 3
    for (sample, site), r in out.items():
        doses = [(a >> site & 1) + (b >> site & 1) for _, s, a, b in rows if s == sample and a is not None]
        assert r.n == sum(x[1] == sample for x in rows)
        assert [r.p0, r.p1, r.p2] == ([doses.count(k) / len(doses) for k in range(3)] if doses else [None] * 3)


@pytest.mark.parametrize("width", [7, 4096])
def test_phase_joined_over_ranges(spark, width):
    """By a loop over the windows of each group; a group without a name keeps its windows, which have no votes."""
    rng = np.random.default_rng(21)
    rows = [(g, w, int(rng.integers(0, 256)), int(rng.integers(0, 256))) for g in (0, 1, 2, None) for w in range(45) if w in (13, 14) or rng.random() < 0.9]
    codes = spark.createDataFrame(rows, "g long, window long, code1 long, code2 long").repartition(3)
    got = {(r.g, r.window): (r.code1, r.code2, r.phase_set) for r in stitching.joined(codes, 8, 4, "g", width=width).collect()}
    by = {(g, w): (a, b) for g, w, a, b in rows}
    assert len(got) == len(rows)
    for g in (0, 1, 2, None):
        turned, phase_set = False, -1
        for w in range(45):
            if (g, w) not in by:
                continue
            a, b = by[g, w]
            same = other = 0
            if g is not None and (g, w - 1) in by:
                before = [c >> 4 for c in by[g, w - 1]]
                for s in range(4):
                    x, y, p, q = (c >> s & 1 for c in (a, b, *before))
                    same, other = same + (x != y and p != q and x == p), other + (x != y and p != q and x != p)
            turned ^= other > same
            phase_set += same == other
            assert got[g, w] == ((b, a, phase_set) if turned else (a, b, phase_set))


def test_consensus_where_draws_are_made(spark):
    """The same as of draws that were put out, of which many samples share their reads; and nothing is shuffled for it."""
    rng = np.random.default_rng(31)
    haps = spark.createDataFrame([(r, h, int(rng.integers(0, 16))) for r in (1, 2) for h in range(30)], "region long, hap_id long, code long")
    kinds = [(0, 30, 127), (127, 30, 0), (20, 3, 20)]
    reads = spark.createDataFrame([(r, s, int(rng.integers(0, 4)), *kinds[s % 3]) for r in (1, 2) for s in range(60) for _ in range(1)], "region long, sample_id long, site int, pl0 long, pl1 long, pl2 long")
    graph = haplotypes.graph(haps, 4, 4)
    key = lambda rows: sorted(tuple(x) for x in rows)
    for more in ({}, {"error": 0.05}, {"keep": 3}):
        one = phasing.drawn_consensus(reads, *graph, 4, 5, **more)
        two = phasing.consensus(phasing.draws(reads, *graph, 4, 5, **more), 4, "region", "sample_id")
        assert key(one.collect()) == key(two.collect()) and one.count() == 120


def test_sums_of_equal_reads_are_made_once(spark, monkeypatch):
    import pyarrow as pa

    made = []
    whole = phasing.forward
    monkeypatch.setattr(phasing, "forward", lambda graph, phreds, *more: made.append(len(phreds)) or whole(graph, phreds, *more))
    haps = spark.createDataFrame([(1, h, h % 4) for h in range(20)], "region long, hap_id long, code long")
    reads = spark.createDataFrame([(1, s, s % 2, 0, 30, 127) for s in range(50)], "region long, sample_id long, site int, pl0 long, pl1 long, pl2 long")
    rows = phasing._rows(reads, *haplotypes.graph(haps, 2, 2), 2, 0.01, 0.0).toArrow()
    found = [x for batch in pa.Table.from_batches(rows.to_batches()).to_batches() for x in phasing._drawn(batch, 2, 3, 1, None)]
    assert made == [2] and sorted(i for _, ids, *_ in found for i in ids.tolist()) == list(range(50))
