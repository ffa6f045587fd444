import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import bases as B
from lociflow.operators import genotype, markers, mixture, panel
from lociflow.operators import pairs as PR


def simulated(alpha, seed=1, n=400, depth=20, dims=2):
    """Counts and a panel of a mixture with known truth."""
    rng = np.random.default_rng(seed)
    ud = rng.normal(0, 0.25, (n, dims))
    mu = rng.uniform(0.4, 1.6, n)
    pc1, pc2 = np.array([0.8, -0.6][:dims]), np.array([-0.5, 0.7][:dims])
    af = [np.clip((ud @ pc + mu) / 2, 0.01, 0.99) for pc in (pc1, pc2)]
    g1, g2 = (rng.binomial(2, p) for p in af)
    counts: dict = {}
    for m in range(n):
        for _ in range(depth):
            g = g1[m] if rng.random() < alpha else g2[m]
            kind = int(rng.random() < g / 2)
            q = int(rng.choice([20, 30, 40]))
            if rng.random() < 10 ** (-q / 10):
                kind = int(rng.choice([1 - kind, 2]))
            counts[m, kind, q] = counts.get((m, kind, q), 0) + 1
    return [(*k, v) for k, v in counts.items()], [(m, float(mu[m]), [float(x) for x in ud[m]]) for m in range(n)], pc1, pc2


@pytest.mark.parametrize("alpha", [0.0, 0.05, 0.2])
def test_known_contamination_is_found(spark, alpha):
    counts, rows, pc1, pc2 = simulated(alpha)
    llk = mixture.Likelihood(spark.createDataFrame(counts, "marker_idx int, kind int, qual int, n int"), spark.createDataFrame(rows, "marker_idx int, mu double, ud array<double>"))
    fit = mixture.fit(llk, 2, tolerance=1e-7)
    assert fit.alpha == pytest.approx(alpha, abs=0.025)
    assert fit.llk1 >= fit.llk0 - 1e-2  # at alpha near 0 the two meet
    assert np.allclose(fit.pc2, pc2, atol=0.35)
    fixed = mixture.fit(llk, 2, fix_pc=list(pc2), tolerance=1e-6)
    assert fixed.pc2 == pytest.approx(list(pc2)) or fixed.pc1 == pytest.approx(list(pc2))
    assert mixture.fit(llk, 2, within=True, fix_pc=list(pc2), fix_alpha=alpha).alpha == pytest.approx(alpha)


def test_both_ways_of_evaluation_agree(spark, monkeypatch):
    counts, rows, pc1, pc2 = simulated(0.1, n=60)
    c, p = spark.createDataFrame(counts, "marker_idx int, kind int, qual int, n int"), spark.createDataFrame(rows, "marker_idx int, mu double, ud array<double>")
    local = mixture.Likelihood(c, p)(pc1, pc2, 0.1)
    monkeypatch.setattr(mixture, "ON_DRIVER", 10)
    assert mixture.Likelihood(c, p)(pc1, pc2, 0.1) == pytest.approx(local)
    brute = 0.0
    for m, mu, ud in rows:
        af = [min(max((np.dot(ud, pc) + mu) / 2, 5e-5), 1 - 5e-5) for pc in (pc1, pc2)]
        f = [((1 - a) ** 2, 2 * a * (1 - a), a * a) for a in af]
        total = 0.0
        for g1 in range(3):
            for g2 in range(3):
                like = 1.0
                for k, kind, q, n in counts:
                    if k == m:
                        e = 10 ** (-q / 10)
                        like *= (sum(w * (mixture.WRONG[kind, g] * e + mixture.RIGHT[kind, g] * (1 - e)) for w, g in ((0.1, g1), (0.9, g2)))) ** n
                total += like * f[0][g1] * f[1][g2]
        brute += math.log(total)
    assert local == pytest.approx(brute)


def test_simplex_finds_a_minimum():
    x, v = mixture.simplex(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2 + (p[0] - 3) * (p[1] + 1) * 0.5, np.array([0.0, 0.0]), 1e-12)
    assert np.allclose(x, [3, -1], atol=1e-3) and v < 1e-5


def test_svd_of_a_low_rank_panel(spark):
    rng = np.random.default_rng(2)
    full = rng.normal(size=(80, 4)) @ rng.normal(size=(4, 12))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(full)], "k int, g array<double>").repartition(3)
    built, samples, d = panel.build_panel(df, "k", "g", 5)
    centred = full - full.mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(d[:4], s[:4]) and d[4] < 1e-5
    ud = np.array([r.ud for r in built.orderBy("k").collect()])
    v = np.array([r.pc for r in samples.orderBy("sample").collect()])
    assert np.allclose(ud @ v.T, centred, atol=1e-6)


def test_uncensored_sizes_keep_their_density(spark):
    rng = random.Random(3)
    sizes = [max(1, min(1999, round(rng.gauss(300, 40)))) for _ in range(2000)]
    cols = "status string, max1 int, max2 int, obs int, fwd_whole boolean, rev_whole boolean"
    pairs = spark.createDataFrame([("PropPair", 900, 900, s, True, True) for s in sizes], cols)
    got = {r.k: r.density for r in PR.adjusted_insert(pairs).collect()}
    assert len(got) == PR.BINS
    for k in (250, 300, 350):
        assert got[k] == pytest.approx(2 * sizes.count(k) / 2000, abs=1e-5)


def test_censored_pairs_route_by_status(spark):
    cols = "status string, max1 int, max2 int, obs int, fwd_whole boolean, rev_whole boolean"
    rows = [("FwdOnly", 10, -1, -1, None, None), ("RevOnly", -1, 20, -1, None, None), ("PartialPair", 30, 40, 5, True, False), ("PartialPair", 31, 41, 5, False, True)]
    rows += [("PartialPair", 32, 42, 5, False, False), ("LowQual", 1, 1, 1, None, None), ("NotPair", 1, 1, 1, None, None), ("PropPair", 99, 99, 50, True, True), ("FwdOnly", 5000, -1, -1, None, None)]
    df = spark.createDataFrame(rows, cols)
    got = {r.k: (r.seen, r.cut) for r in PR.censored(df, "RevOnly").collect()}
    assert got == {10: (0, 1), 30: (0, 1), 41: (0, 1), 50: (1, 0)}
    assert 20 in {r.k for r in PR.censored(df, "FwdOnly").collect()}


def test_genotypes_of_clear_sites(spark):
    marks = spark.createDataFrame([("1", 10, "A", "C"), ("1", 20, "A", "C"), ("1", 30, "A", "C")], "chrom string, pos int, ref string, alt string")
    rows = [("1", 10, "A", 30)] * 20 + [("1", 20, "A", 30)] * 10 + [("1", 20, "C", 30)] * 10 + [("1", 30, "C", 30)] * 20
    bases = spark.createDataFrame(rows, "chrom string, pos int, base string, qual int")
    out = genotype.calls(genotype.likelihoods(bases, marks), marks.withColumn("af", F.lit(0.3)))
    assert {r.pos: r.gt for r in out.collect()} == {10: "0/0", 20: "0/1", 30: "1/1"}


def test_quota_and_spacing(spark):
    rows = [(str(c), 5000 * i, f"{c}-{i}", 500) for c in (1, 2, "X") for i in range(10)] + [("1", 5001, "near", 500)]
    df = spark.createDataFrame(rows, "chrom string, pos int, name string, flank int")
    kept = {r.name for r in markers.greedy_spaced(df).collect()}
    assert "near" not in kept and len(kept) == 30
    quota = markers.with_quota(df, 5, 7, 3).groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in quota} == {"long": 5, "short": 7, "x": 3}


def test_empty_tables(spark):
    schema = "read_id bigint, chrom string, pos int, strand boolean, mapq int, seq string, qual string, cigar array<struct<len:int,op:string>>, md string"
    none = B.aligned_bases(spark.createDataFrame([], schema))
    assert none.collect() == [] and B.depth(none).collect() == []
    hist = B.depth_histogram(B.depth(none).groupBy("depth").agg(F.count(F.lit(1)).alias("sites")), 100).collect()
    assert len(hist) == 1024 and sum(r.sites for r in hist) == 100
    odd = spark.createDataFrame([(1, None, 5, False, 1, "A", "I", [(1, "M")], "1"), (2, "1", None, False, 1, "A", "I", [(1, "M")], "1"), (3, "1", 5, True, 1, "AC", None, [(2, "M")], None)], schema)
    assert sorted((r.read_id, r.pos, r.qual, r.cycle) for r in B.aligned_bases(odd).collect()) == [(3, 5, None, 1), (3, 6, None, 0)]
