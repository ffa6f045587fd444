"""Genotype likelihoods and calls from bases at markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions import numeric


def base_class(base: Column, ref: Column, alt: Column) -> Column:
    return F.when(base == ref, "ref").when(base == alt, "alt").otherwise("other")


def likelihoods(bases: DataFrame, markers: DataFrame) -> DataFrame:
    """``chrom, pos, depth, pl0, pl1, pl2``: rounded -10 log10 likelihoods of 0, 1 and 2 alternative alleles.

    Bases are first counted by (site, class, quality), so deep sites cost no
    more than their distinct qualities.
    """
    at = bases.join(markers.select("chrom", "pos", "ref", "alt").dropDuplicates(["chrom", "pos"]), ["chrom", "pos"])
    kind = base_class(F.col("base"), F.col("ref"), F.col("alt"))
    counts = at.groupBy("chrom", "pos", kind.alias("kind"), "qual").agg(F.count(F.lit(1)).alias("n"))
    e = numeric.probability(F.greatest("qual", F.lit(1)))
    log = lambda x: F.log10(x) * F.col("n")
    of = lambda same, other: F.when(F.col("kind") == same, log(1 - e)).when(F.col("kind") == other, log(e / 3)).otherwise(log(2 * e / 3))
    het = F.when(F.col("kind") == "other", log(2 * e / 3)).otherwise(log(0.5 - e / 3))
    sums = counts.groupBy("chrom", "pos").agg(
        F.sum("n").alias("depth"), F.sum(of("ref", "alt")).alias("g0"), F.sum(het).alias("g1"), F.sum(of("alt", "ref")).alias("g2")
    )
    score = lambda c: numeric.half_up(F.round(-10 * F.col(c), 6))
    return sums.select("chrom", "pos", "depth", score("g0").alias("pl0"), score("g1").alias("pl1"), score("g2").alias("pl2"))


def calls(scores: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``gt`` and posterior scores from the likelihoods and Hardy-Weinberg priors; ties mostly resolve to 1/1."""
    own = scores.join(frequencies.select("chrom", "pos", "af").dropDuplicates(["chrom", "pos"]), ["chrom", "pos"])
    af = F.col("af")
    prior = (numeric.phred((1 - af) * (1 - af)), numeric.phred(2 * af * (1 - af)), numeric.phred(af * af))
    own = own.withColumns({f"_s{i}": prior[i] + F.col(f"pl{i}") for i in range(3)})
    least = F.least("_s0", "_s1", "_s2")  # the log-sum is taken relative to the best, so deep sites do not underflow
    total = least + numeric.phred(sum((numeric.probability(F.col(f"_s{i}") - least) for i in range(1, 3)), numeric.probability(F.col("_s0") - least)))
    own = own.withColumns({f"gp{i}": numeric.half_up(F.round(F.col(f"_s{i}") - total, 6)) for i in range(3)})
    gt = (
        F.when((F.col("gp0") < F.col("gp1")) & (F.col("gp0") < F.col("gp2")), "0/0")
        .when((F.col("gp0") >= F.col("gp1")) & (F.col("gp1") < F.col("gp2")), "0/1")
        .otherwise("1/1")
    )
    return own.select("chrom", "pos", "depth", "pl0", "pl1", "pl2", "gp0", "gp1", "gp2", gt.alias("gt"))
