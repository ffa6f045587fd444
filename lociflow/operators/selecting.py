"""Row predicates over reads, records and variants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import keys, numeric, sequence
from lociflow.operators import ordered

RESOLUTION = 1_000_000
LEAST_FRACTION, LEAST_QUALITY = 0.25, 13


def downsampled(reads: DataFrame, name: str, fraction: float, seed: int) -> DataFrame:
    """Reads whose name hashes below the fraction; mates share the name and so the fate, nulls are kept out."""
    plain = keys.read_name(F.substring_index(F.col(name), " ", 1))
    place = F.pmod(F.xxhash64(plain, F.lit(seed)), F.lit(RESOLUTION)) / RESOLUTION
    return reads.filter(F.col(name).isNotNull() & (place < fraction))


def flagged(records: DataFrame, required: int = 0, excluded: int = 0) -> DataFrame:
    """Records with all required flag bits and none of the excluded ones."""
    flag = F.col("flag")
    return records.filter((flag.bitwiseAND(required) == required) & (flag.bitwiseAND(excluded) == 0))


def confident(alignments: DataFrame, least: int = 20) -> DataFrame:
    """Placed reads of some mapping quality; 255 means not available and is left out."""
    return alignments.filter(~numeric.flag("flag", numeric.UNMAPPED) & F.col("mapq").between(least, 254))


def pileup_reads(alignments: DataFrame, least: int = 13, cap: int = 40) -> DataFrame:
    """Reads for a pileup: placed, primary, passed, no duplicate, capped mapping quality of ``least`` or more."""
    clean = flagged(alignments, 0, numeric.UNMAPPED | numeric.SECONDARY | numeric.FAILED | numeric.DUPLICATE)
    return clean.filter("pos > 0 and mapq is not null").withColumn("mapq", F.least("mapq", F.lit(cap))).filter(F.col("mapq") >= least)


def bridging(alignments: DataFrame, markers: DataFrame) -> DataFrame:
    """Alignments with ``bridging``: do they leave the contig they are placed on?"""
    bounds = markers.select(F.col("name").alias("contig"), (F.col("pos") - F.col("flank")).alias("_low"), (F.col("pos") + F.col("flank")).alias("_high"))
    end = F.col("pos") + sequence.reference_length("cigar") - 1
    out = alignments.join(bounds, "contig")
    return out.withColumn("bridging", (F.col("pos") < F.col("_low")) | (end > F.col("_high"))).drop("_low", "_high")


def many_unknown(reads: DataFrame, seq: str, share: float = LEAST_FRACTION, most: Column | None = None) -> DataFrame:
    """Reads with ``unknown`` bases and ``rejected``: are they beyond a share of the read, or a limit?"""
    n = F.length(seq) - F.length(F.translate(F.upper(F.col(seq)), "N.", ""))
    return reads.withColumn("unknown", n).withColumn("rejected", (n > most) if most is not None else (n >= share * F.length(seq)))


def kept_variants(df: DataFrame, least_alt: int, least_minor: int) -> DataFrame:
    """Variants ``filter, alt, gt`` (genotypes as text) that no rule discards.

    Kept are those with filter PASS, one alternative, every genotype known and phased, and enough
    alternative and rarer alleles.
    """
    alleles = F.flatten(F.transform("gt", lambda g: F.split(g, r"[|/]")))
    total, alt = F.size(alleles), F.size(F.filter(alleles, lambda a: a != "0"))
    known, phased = ~F.exists("gt", lambda g: g.contains(".")), ~F.exists("gt", lambda g: g.contains("/"))
    rules = (F.col("filter") == "PASS") & ~F.col("alt").contains(",") & known & phased
    return df.filter(rules & (alt >= least_alt) & (F.least(alt, total - alt) >= least_minor))


def listed(df: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows whose key is on the list, or is not."""
    return df.join(ids.select(key).distinct(), key, "left_semi" if keep else "left_anti")


def problems(records: DataFrame) -> DataFrame:
    """Records with ``problems``: the names of the checks that they fail, in order."""
    unmapped = numeric.flag("flag", numeric.UNMAPPED)
    checks = {
        "flag": F.col("flag").isNull() | ~F.col("flag").between(0, 4095),
        "both_ends": numeric.flag("flag", numeric.FIRST) == numeric.flag("flag", numeric.SECOND),
        "reference": F.col("reference_id").isNull() | (F.col("reference_id") < -1),
        "position": F.col("pos").isNull() | (F.col("pos") < 0) | (~unmapped & (F.col("pos") == 0)),
        "mapq": F.col("mapq").isNull() | ~F.col("mapq").between(0, 255),
        "insert_size": F.col("insert_size").isNull() | (F.abs(F.col("insert_size").cast("bigint")) > 536_870_912),
        "unpaired_proper": numeric.flag("flag", numeric.PROPER) & ~numeric.flag("flag", numeric.PAIRED),
    }
    return records.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), n) for n, c in checks.items()])))


def line_problems(records: DataFrame) -> DataFrame:
    """Records ``name, flag, cigar, seq, qual, md`` with ``problems``: the checks of their texts that they fail, in order."""
    cigar = F.col("cigar")
    wrong = F.exists(cigar, lambda c: (c["len"] < 1) | ~c["op"].isin(*"MIDNSHP=X"))
    inner = F.slice(cigar, F.lit(2), F.greatest(F.size(cigar) - 2, F.lit(0)))
    checks = {
        "name": F.col("name").isNull() | ~F.col("name").rlike(r"\A[!-?A-~]{1,254}\z"),
        "cigar_missing": ~numeric.flag("flag", numeric.UNMAPPED) & (cigar.isNull() | (F.size(cigar) < 1)),
        "cigar_operation": cigar.isNotNull() & wrong,
        "cigar_hard_clip": (F.size(cigar) > 2) & F.exists(inner, lambda c: c["op"] == "H"),
        "cigar_length": cigar.isNotNull() & F.col("seq").isNotNull() & (sequence.read_length("cigar") != F.length("seq")),
        "qual": F.col("qual").isNotNull() & ((F.length("qual") != F.coalesce(F.length("seq"), F.lit(0))) | ~F.col("qual").rlike(r"\A[!-~]*\z")),
        "tag_md": F.col("md").isNotNull() & ~F.col("md").rlike(r"\A[0-9]+(([A-Z]|\^[A-Z]+)[0-9]+)*\z"),
    }
    return records.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()])))


def clipped_ends(alignments: DataFrame, most: float) -> DataFrame:
    """``read_id, clip_begin, clip_end``: read bases to clip so that no run of bases from an end has a mismatch rate above ``most``.

    Both ends are worked inwards until they meet, the end with fewer bases since its last cut first; a run
    that exceeds the rate at a mismatch is cut there and a new one begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = clips(*batch.columns[1:])
            columns = [batch.column(0), pa.array(heads, pa.int32()), pa.array(tails, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["read_id", "clip_begin", "clip_end"])

    def clips(lengths: pa.Array, places: pa.Array, wrong: pa.Array) -> tuple[list[int], list[int]]:
        heads, tails = [], []
        for n, own, bad in zip(lengths.to_pylist(), places.to_pylist(), wrong.to_pylist()):
            bad = set(bad or [])
            cut, seen, missed, at = [-1, n], [0, 0], [0, 0], [0, len(own or []) - 1]
            open_ends = [True, True]
            while any(open_ends):
                side = 0 if open_ends[0] and (not open_ends[1] or seen[0] <= seen[1]) else 1
                i = at[side]
                place = own[i] if own and 0 <= i < len(own) else None
                if place is None or (place >= cut[1] if side == 0 else place <= cut[0]):
                    open_ends[side] = False
                    continue
                at[side] += 1 - 2 * side
                seen[side] += 1
                missed[side] += place in bad
                if place in bad and missed[side] > most * seen[side]:
                    cut[side], seen[side], missed[side] = place, 0, 0
            heads.append(cut[0] + 1)
            tails.append(n - cut[1])
        return heads, tails

    blocks = F.filter(sequence.blocks("cigar"), lambda b: b["op"].isin("M", "=", "X") & (b["len"] > 0))
    places = F.flatten(F.transform(blocks, lambda b: F.sequence(b["read_off"], b["read_off"] + b["len"] - 1)))
    known = F.map_keys(sequence.md_mismatches("md"))
    to_read = lambda m: F.filter(F.transform(blocks, lambda b: F.when((m >= b["ref_off"]) & (m < b["ref_off"] + b["len"]), b["read_off"] + m - b["ref_off"])), lambda x: x.isNotNull())
    wrong = F.flatten(F.transform(known, to_read))
    rows = alignments.select("read_id", F.length("seq").alias("_n"), places.alias("_places"), wrong.alias("_wrong"))
    return rows.mapInArrow(run, f"read_id {alignments.schema['read_id'].dataType.simpleString()}, clip_begin int, clip_end int")


def out_of_order(records: DataFrame, by: str, order: str) -> DataFrame:
    """Records with ``sorted``: does (reference, position) not fall behind the record before?"""
    place = F.struct(F.when(F.col("reference_id") < 0, 1 << 30).otherwise(F.col("reference_id")).alias("r"), F.col("pos").alias("p"))
    rows = ordered.with_previous(records, [by], order, place)
    return rows.withColumn("sorted", F.coalesce(place >= F.col("previous"), F.lit(True))).drop("previous")


def consecutive_duplicates(markers: DataFrame) -> DataFrame:
    """Markers at the position of the one before them on their chromosome."""
    line = Window.partitionBy("chrom").orderBy("pos", "name")
    return markers.withColumn("_before", F.lag("pos").over(line)).filter("_before = pos").drop("_before")


def mismatch_share(bases: DataFrame, least_quality: int = 0) -> DataFrame:
    """``read_id, bases, mismatches, quality_sum``: mismatches of each read and the summed quality under them.

    A column ``mismatch`` says which bases are; without one those that differ from a reference base and are known.
    """
    own = F.col("mismatch") if "mismatch" in bases.columns else (F.col("base") != F.col("ref_base")) & (F.col("base") != "N")
    differs = own & (F.col("qual") >= least_quality)
    return bases.groupBy("read_id").agg(
        F.count(F.lit(1)).alias("bases"),
        F.count_if(differs).alias("mismatches"),
        F.coalesce(F.sum(F.when(differs, F.col("qual"))), F.lit(0)).alias("quality_sum"),
    )
