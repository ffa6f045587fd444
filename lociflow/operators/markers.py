"""Variant markers: predicates over candidates, spacing, quotas, flanks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import keys
from lociflow.operators import intervals

LEAST_AF = 0.01


def markers_of(contigs: DataFrame) -> DataFrame:
    """``name, chrom, pos, ref, alt, class, flank`` decoded from contig names; names of another form are left out."""
    rows = contigs.select("name", keys.contig("name").alias("m")).filter("m.pos is not null")
    flank = F.when(F.col("m.class") == "long", keys.FLANK["long"]).otherwise(keys.FLANK["short"])
    return rows.select("name", "m.*", flank.alias("flank"))


def flanks(markers: DataFrame) -> DataFrame:
    """The closed interval around each marker."""
    return markers.select("name", "chrom", (F.col("pos") - F.col("flank")).alias("beg"), (F.col("pos") + F.col("flank")).alias("end"))


def candidates(vcf: DataFrame, least_af: float = LEAST_AF) -> DataFrame:
    """Sites on whitelisted chromosomes with one base each and an allele frequency off 0 and 1; cheap tests first."""
    own = vcf.withColumn("chrom", keys.chrom("chrom"))
    own = own.filter(F.col("chrom").isin(keys.CHROMOSOMES) & (F.length("ref") == 1) & (F.length("alt") == 1))
    af = F.try_element_at("info", F.lit("AF")).try_cast("double")
    return own.withColumn("af", af).filter(F.col("af").between(least_af, 1 - least_af))


def well_spaced(markers: DataFrame) -> DataFrame:
    """Static spacing: markers further from both neighbours than the two flanks together."""
    line = Window.partitionBy("chrom").orderBy("pos", "name")
    left = F.col("pos") - F.lag("pos").over(line) >= F.col("flank") + F.lag("flank").over(line)
    right = F.lead("pos").over(line) - F.col("pos") >= F.col("flank") + F.lead("flank").over(line)
    kept = markers.withColumn("_ok", F.coalesce(left, F.lit(True)) & F.coalesce(right, F.lit(True)))
    return kept.filter("_ok").drop("_ok")


def greedy_spaced(markers: DataFrame) -> DataFrame:
    """Greedy spacing in order of position: a marker stays if its flank is clear of the last one that stayed.

    Streams through partitions sorted by (chrom, pos), so a chromosome is never
    held as a whole.
    """
    columns = markers.columns
    at = [columns.index(c) for c in ("chrom", "pos", "flank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for chrom, pos, flank in zip(*(batch.column(i).to_pylist() for i in at)):
                free = last is None or last[0] != chrom or pos - last[1] >= last[2] + flank
                keep.append(free)
                if free:
                    last = (chrom, pos, flank)
            yield batch.filter(pa.array(keep))

    ordered = markers.dropna(subset=["chrom", "pos"]).repartition(F.xxhash64("chrom")).sortWithinPartitions("chrom", "pos", "name")
    return ordered.mapInArrow(run, ordered.schema)


def targeted(markers: DataFrame, target: DataFrame) -> DataFrame:
    """Markers with ``in_target``: do they lie in some target region?"""
    hit = intervals.in_regions(markers.select("name", "chrom", "pos"), target).select("name").distinct().withColumn("_t", F.lit(True))
    return markers.join(hit, "name", "left").withColumn("in_target", F.coalesce("_t", F.lit(False))).drop("_t")


def with_quota(markers: DataFrame, n_long: int, n_short: int, n_sex: int) -> DataFrame:
    """First come, first served in order of (chrom, pos): autosomes fill the long quota, then the short one; X and Y their own.

    With a column ``in_target`` the markers in target regions come before all others.
    Every group is cut to its quota by a distributed top-n before it is numbered.
    """
    first = [F.desc("in_target")] if "in_target" in markers.columns else []
    auto = markers.filter(F.col("chrom").isin(keys.AUTOSOMES)).orderBy(*first, "chrom", "pos", "name").limit(n_long + n_short)
    number = F.row_number().over(Window.orderBy(*first, "chrom", "pos", "name"))  # within the quota
    auto = auto.withColumn("class", F.when(number <= n_long, "long").otherwise("short"))
    out = auto
    for c in ("X", "Y"):
        own = markers.filter(F.col("chrom") == c).orderBy(*first, "pos", "name").limit(n_sex)
        out = out.unionByName(own.withColumn("class", F.lit(c.lower())))
    return out


def callable_mask(masks: DataFrame, mask: str, least: float = 0.995) -> DataFrame:
    """Windows with ``callable`` (letters P of their mask) and ``ok``: are they ``least`` of its length?"""
    n = F.length(mask) - F.length(F.translate(mask, "P", ""))
    return masks.withColumn("callable", n).withColumn("ok", F.col("callable") >= F.lit(least) * F.length(mask))


def class_counts(markers: DataFrame) -> DataFrame:
    kind = F.when(F.col("chrom").isin("X", "Y"), F.lower("chrom")).otherwise(F.col("class"))
    return markers.groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("markers"))


def effective_size(markers: DataFrame, read_length: int) -> DataFrame:
    """One row: positions that reads can cover when they must hold 35% of the marker's side of a flank."""
    chop = int(read_length * 0.65 + 0.5)
    return markers.agg(F.sum((F.col("flank") - chop) * 2 + 1).cast("bigint").alias("effective_size"), F.count(F.lit(1)).alias("markers"))


def gc_window(df: DataFrame, key: str, seq: str, before: int = 50, after: int = 49) -> DataFrame:
    """``key, at, gc``: percent of G and C in the window around every position of each sequence.

    From prefix sums over the bases of a batch: no row of a base is ever shuffled.
    """

    def run(seqs: pa.Array) -> pa.Array:
        texts = seqs.cast(pa.large_binary())
        ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        starts = ends - ends[0]
        upto = np.r_[0, np.cumsum((raw == ord("G")) | (raw == ord("C")))]
        row = np.repeat(np.arange(len(texts)), np.diff(starts))
        at = np.arange(len(raw))
        low, high = np.maximum(starts[:-1][row], at - before), np.minimum(starts[1:][row], at + after + 1)
        gc = (100 * (upto[high] - upto[low]) // (high - low)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(gc))

    plain = F.regexp_replace(F.upper(F.col(seq)), "[^A-Z]", "N")  # one byte a base
    own = df.filter(F.length(seq) > 0).select(F.col(key), F.arrow_udf(run, "array<int>")(plain).alias("_gc"))
    return own.select(key, F.posexplode("_gc").alias("at", "gc")).withColumn("at", F.col("at") + 1)


def allele_counts(genotypes: DataFrame, key: str, gt: Column) -> DataFrame:
    """Per site from an array of 0, 1, 2 and -1 (missing): alleles called, alternative alleles, the rarer allele's."""
    known = F.filter(gt, lambda g: g >= 0)
    total = 2 * F.size(known)
    alt = F.aggregate(known, F.lit(0), lambda acc, g: acc + g)
    return genotypes.select(key, total.alias("alleles"), alt.alias("alt"), F.least(alt, total - alt).alias("minor"))


def best_genotype(pl: Column) -> Column:
    """Alternative alleles of the least capped likelihood score; the lower genotype on a tie, -1 without scores."""
    capped = F.transform(pl, lambda x: F.least(x, F.lit(255)))
    return F.when(F.size(capped) == 3, F.array_position(capped, F.array_min(capped)).cast("int") - 1).otherwise(-1)
