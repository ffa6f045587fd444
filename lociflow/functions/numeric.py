"""Phred scales, genotype arithmetic, mapping-quality and mismatch limits."""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

AF_FLOOR = 0.00005


def phred(p: Column) -> Column:
    return -10 * F.log10(p)


def probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def inverse_logit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def hardy_weinberg(af: Column) -> Column:
    """``[homref, het, homalt]`` with the allele frequency kept off 0 and 1."""
    p = F.greatest(F.lit(AF_FLOOR), F.least(F.lit(1 - AF_FLOOR), af))
    return F.array((1 - p) * (1 - p), 2 * p * (1 - p), p * p)


def base_given_genotype(genotype: Column, base_class: Column, error: Column) -> Column:
    """P(base class | genotype, error); classes are 'ref', 'alt' and 'other', genotypes count alternative alleles."""
    right = (
        F.when(base_class == "ref", F.when(genotype == 0, 1.0).when(genotype == 1, 0.5).otherwise(0.0))
        .when(base_class == "alt", F.when(genotype == 0, 0.0).when(genotype == 1, 0.5).otherwise(1.0))
        .otherwise(0.0)
    )
    wrong = (
        F.when(base_class == "ref", F.when(genotype == 0, 0.0).when(genotype == 1, 1 / 6).otherwise(1 / 3))
        .when(base_class == "alt", F.when(genotype == 0, 1 / 3).when(genotype == 1, 1 / 6).otherwise(0.0))
        .otherwise(2 / 3)
    )
    return F.when(error, wrong).otherwise(right)


def single_end_mapq(best: Column, second: Column, differences: Column, most: Column) -> Column:
    """0 for several best hits, 25 at the limit of differences, 37 without a second hit, else by the number of second hits."""
    n = F.least(second, F.lit(255))
    falling = F.floor(F.lit(4.343) * F.ln(n) + 0.5).cast("int")
    return (
        F.when(best == 0, 23)
        .when(best > 1, 0)
        .when(differences == most, 25)
        .when(second == 0, 37)
        .otherwise(F.when(falling < 23, 23 - falling).otherwise(0))
    )


def most_differences(length: int, error: float = 0.02, missed: float = 0.04) -> int:
    """The least k whose Poisson tail beyond k is below ``missed`` for a read of ``length``."""
    mean = error * length
    if mean <= 0:
        return 1
    log, total = -mean, math.exp(-mean)  # the log of a term, as the first ones vanish for long reads
    for k in range(1, int(2 * mean) + 1000):
        log += math.log(mean / k)
        total += math.exp(log)
        if k >= mean / 2 and 1 - total < missed:
            return k
    raise ValueError("the limit does not settle")


KNOWN_LENGTHS = 1024


def difference_limit(length: Column) -> Column:
    """``most_differences`` of a column of lengths: a table for reads of usual length, computed for each longer one."""
    known = F.array(*[F.lit(most_differences(n)) for n in range(KNOWN_LENGTHS + 1)])
    beyond = F.arrow_udf(lambda x: pa.array([None if n is None else _limit(n) for n in x.to_pylist()], pa.int32()), "int")
    return F.when(length <= KNOWN_LENGTHS, F.element_at(known, length + 1)).otherwise(beyond(F.when(length > KNOWN_LENGTHS, length)))


@functools.lru_cache(maxsize=100_000)
def _limit(length: int) -> int:
    return most_differences(length)


def read_error(qualities: Column, first: int = 25) -> Column:
    """Probability of an error within the first bases: 1 - prod(1 - 10^(-q/10))."""
    right = F.aggregate(F.slice(qualities, 1, first), F.lit(1.0), lambda acc, q: acc * (1 - probability(q)))
    return 1 - right


def alignment_score(mismatches: Column, opens: Column, extensions: Column) -> Column:
    """Weighted differences: a mismatch counts 3, a gap 11, its extension 4."""
    return 3 * mismatches + 11 * opens + 4 * extensions


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def flag(value: Column | str, bit: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value.bitwiseAND(bit) != 0


PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE = 1, 2, 4, 8, 16, 32
FIRST, SECOND, SECONDARY, FAILED, DUPLICATE = 64, 128, 256, 512, 1024
