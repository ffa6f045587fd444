"""Aligned bases and what is counted over them: depth, quality by reported quality and by cycle, pileups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import keys, sequence

MOST_DEPTH = 1023
SPAN = 1_024


def aligned_bases(alignments: DataFrame) -> DataFrame:
    """One row per base of an M block of each placed read.

    ``read_id, chrom, pos, base, qual, cycle, ref_base, mapq, strand``; cycle is
    the place in sequencing order from 0.  Clipped and inserted bases have no
    row.  Reads without position, script or bases have none.
    """
    rows = _matching(alignments).withColumn("_known", sequence.md_mismatches("md"))
    return _lookup(rows.withColumn("_i", F.explode(F.expr("sequence(0, _b.len - 1)"))))


def _matching(alignments: DataFrame) -> DataFrame:
    """The M blocks of placed reads, with what is needed to look their bases up."""
    placed = alignments.filter("pos is not null and cigar is not null and seq is not null and chrom is not null")
    return placed.select(
        "read_id",
        keys.chrom("chrom").alias("chrom"),
        F.col("pos").alias("_start"),
        "seq",
        "qual",
        "mapq",
        "strand",
        "md",
        F.explode(sequence.blocks("cigar")).alias("_b"),
    ).filter("_b.op in ('M', '=', 'X') and _b.len > 0")


def _lookup(each: DataFrame) -> DataFrame:
    """The base ``_i`` places into a block."""
    at = F.col("_b.read_off") + F.col("_i")
    base = F.substr("seq", at + 1, F.lit(1))
    return each.select(
        "read_id",
        "chrom",
        (F.col("_start") + F.col("_b.ref_off") + F.col("_i")).alias("pos"),
        base.alias("base"),
        (F.ascii(F.substr("qual", at + 1, F.lit(1))) - 33).alias("qual"),
        F.when(F.col("strand"), F.length("seq") - 1 - at).otherwise(at).alias("cycle"),
        F.coalesce(F.try_element_at("_known", F.col("_b.ref_off") + F.col("_i")), base).alias("ref_base"),
        "mapq",
        "strand",
    )


def marker_bases(alignments: DataFrame, markers: DataFrame) -> DataFrame:
    """The rows of ``aligned_bases`` at the positions of markers (``chrom, pos``).

    Blocks meet the markers within bins of SPAN positions first, so only reads that
    cover a marker go on, and their base is looked up by its offset: no other base is listed.
    """
    to_bin = lambda x: F.floor(x / SPAN)
    beg = F.col("_start") + F.col("_b.ref_off")
    sites = markers.select("chrom", "pos").dropna().distinct().select("chrom", F.col("pos").alias("_at"), to_bin(F.col("pos")).alias("_bin"))
    rows = _matching(alignments).withColumns({"_beg": beg, "_bin": F.explode(F.sequence(to_bin(beg), to_bin(beg + F.col("_b.len") - 1)))})
    inside = (F.col("_at") >= F.col("_beg")) & (F.col("_at") < F.col("_beg") + F.col("_b.len"))
    hits = rows.join(sites, ["chrom", "_bin"]).filter(inside)
    return _lookup(hits.withColumns({"_i": F.col("_at") - F.col("_beg"), "_known": sequence.md_mismatches("md")}))


def mismatch_scripts(rows: DataFrame) -> DataFrame:
    """``read_id, md``: the MD text of reads ``read_id, seq, ref, cigar`` over the reference bases that their matches and deletions consume."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scripts(*batch.columns[1:]), pa.string())], names=["read_id", "md"])

    kind = rows.schema["read_id"].dataType.simpleString()
    return rows.select("read_id", "seq", "ref", "cigar").mapInArrow(run, f"read_id {kind}, md string")


def _scripts(seqs: pa.Array, refs: pa.Array, cigars: pa.Array) -> list[str | None]:
    out = []
    for seq, ref, cigar in zip(seqs.to_pylist(), refs.to_pylist(), cigars.to_pylist()):
        if seq is None or ref is None or cigar is None:
            out.append(None)
            continue
        text, run, read_at, ref_at = [], 0, 0, 0
        for step in cigar:
            op, n = step["op"], step["len"]
            if op in "M=X":
                for a, b in zip(seq[read_at : read_at + n], ref[ref_at : ref_at + n]):
                    if a == b:
                        run += 1
                    else:
                        text.append(f"{run}{b}")
                        run = 0
            elif op == "D":
                text.append(f"{run}^{ref[ref_at : ref_at + n]}")
                run = 0
            read_at += n if op in "MIS=X" else 0
            ref_at += n if op in "MD=X" else 0
        out.append("".join(text) + str(run))
    return out


def depth(bases: DataFrame) -> DataFrame:
    """``chrom, pos, depth, q20, q30`` of every covered site."""
    return bases.groupBy("chrom", "pos").agg(
        F.count(F.lit(1)).alias("depth"),
        F.count_if(F.col("qual") >= 20).alias("q20"),
        F.count_if(F.col("qual") >= 30).alias("q30"),
    )


def site_depth(alignments: DataFrame) -> DataFrame:
    """``chrom, pos, depth, q20, q30`` of every covered site, as ``depth`` of all aligned bases.

    A batch of blocks is folded to one row per site in NumPy, so no base becomes a row.
    """
    beg = F.col("_start") + F.col("_b.ref_off")
    blocks = _matching(alignments).select("chrom", beg.alias("beg"), F.col("_b.len").alias("len"), F.col("_b.read_off").alias("off"), F.coalesce("qual", F.lit("")).alias("qual"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chrom = batch.column(0).dictionary_encode()
            beg, size, off = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            raw = batch.column(4).cast(pa.large_binary())
            ends = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
            text = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
            row = np.repeat(np.arange(len(size)), size)
            if not len(row):
                continue
            i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            at = ends[row] + off[row] + i
            known = at < ends[row + 1]
            quality = np.zeros(len(row), np.int64)
            quality[known] = text[at[known]].astype(np.int64) - 33
            key = (chrom.indices.to_numpy().astype(np.int64)[row] << 40) + beg[row] + i + (1 << 39)
            order = np.argsort(key, kind="stable")
            key, quality = key[order], quality[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = [np.diff(np.r_[first, len(key)]), *(np.add.reduceat((quality >= q).astype(np.int64), first) for q in (20, 30))]
            site = key[first]
            columns = [chrom.dictionary.take(pa.array(site >> 40)), pa.array(((site & ((1 << 40) - 1)) - (1 << 39)).astype(np.int32)), *map(pa.array, counts)]
            yield pa.RecordBatch.from_arrays(columns, names=["chrom", "pos", "depth", "q20", "q30"])

    folded = blocks.mapInArrow(run, "chrom string, pos int, depth bigint, q20 bigint, q30 bigint")
    return folded.groupBy("chrom", "pos").agg(*[F.sum(c).alias(c) for c in ("depth", "q20", "q30")])


def filled(histogram: DataFrame, key: str, size: int, values: list[str]) -> DataFrame:
    """A histogram with a row for each of 0 .. size - 1."""
    spark = histogram.sparkSession
    every = spark.range(size).select(F.col("id").cast("int").alias(key))
    return every.join(histogram.withColumn(key, F.col(key).cast("int")), key, "left").fillna(0, values)


def depth_histogram(sites: DataFrame, region_size: int) -> DataFrame:
    """``depth, sites`` for 0 .. MOST_DEPTH of counts ``depth, sites``; 0 holds the positions without a base."""
    counts = sites.groupBy(F.least(F.col("depth"), F.lit(MOST_DEPTH)).alias("depth")).agg(F.sum("sites").alias("sites"))
    full = filled(counts, "depth", MOST_DEPTH + 1, ["sites"])
    covered = F.sum("sites").over(Window.partitionBy())
    return full.withColumn("sites", F.when(F.col("depth") == 0, F.lit(region_size) - covered).otherwise(F.col("sites")))


def sites_from(sites: DataFrame, limits: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """One row with the sites of at least each depth, of counts ``depth, sites``."""
    return sites.agg(*[F.coalesce(F.sum(F.when(F.col("depth") >= k, F.col("sites"))), F.lit(0)).alias(f"depth_{k}") for k in limits])


def mismatches(bases: DataFrame, known_sites: DataFrame | None = None) -> DataFrame:
    """Bases with ``mismatch``: both bases known, different, and the site not among the known ones."""
    differs = (F.col("base") != "N") & (F.col("ref_base") != "N") & (F.col("base") != F.col("ref_base"))
    if known_sites is None:
        return bases.withColumn("mismatch", differs)
    listed = known_sites.select("chrom", "pos").distinct().withColumn("_known", F.lit(True))
    joined = bases.join(listed, ["chrom", "pos"], "left")
    return joined.withColumn("mismatch", differs & F.col("_known").isNull()).drop("_known")


def quality_by_reported(bases: DataFrame) -> DataFrame:
    """``qual, mismatches, bases, empirical`` with empirical = -10 log10((mismatches + 1) / (bases + 2))."""
    counts = bases.groupBy("qual").agg(F.count_if("mismatch").alias("mismatches"), F.count(F.lit(1)).alias("bases"))
    return counts.withColumn("empirical", F.round(-10 * F.log10((F.col("mismatches") + 1) / (F.col("bases") + 2)), 6))


def quality_by_cycle(bases: DataFrame) -> DataFrame:
    """``cycle`` from 1, mismatches, bases and the empirical quality, carried forward over cycles without a mismatch."""
    counts = bases.groupBy((F.col("cycle") + 1).alias("cycle")).agg(
        F.count_if("mismatch").alias("mismatches"), F.count(F.lit(1)).alias("bases")
    )
    own = -10 * F.log10((F.col("mismatches") + 1e-6) / (F.col("bases") + 1e-6))
    line = Window.orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)  # one row per cycle of a read
    carried = F.last(F.when(F.col("mismatches") != 0, own), ignorenulls=True).over(line)
    return counts.withColumn("empirical", F.round(F.coalesce(carried, F.lit(0.0)), 6))


def pileup(at: DataFrame, cap: int | None = None) -> DataFrame:
    """``chrom, pos, depth, items`` of bases at markers, items ordered by read; at most ``cap`` of them in read order."""
    if cap is not None:
        line = Window.partitionBy("chrom", "pos").orderBy("read_id", "cycle")
        at = at.withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= cap)
    item = F.struct("read_id", "cycle", "base", "qual", "mapq", "strand")
    return at.groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("depth"), F.array_sort(F.collect_list(item)).alias("items"))


def pileup_text(piles: DataFrame, markers: DataFrame) -> DataFrame:
    """Eight text columns of each pile; bases in capitals are on the reverse strand."""
    base = lambda x: F.when(x["strand"], F.upper(x["base"])).otherwise(F.lower(x["base"]))
    code = lambda c: F.array_join(F.transform("items", c), "")
    ref = markers.select("chrom", "pos", "ref").dropDuplicates(["chrom", "pos"])
    return piles.join(ref, ["chrom", "pos"], "left").select(
        "chrom",
        "pos",
        F.coalesce("ref", F.lit(".")).alias("ref"),
        "depth",
        code(base).alias("bases"),
        code(lambda x: F.char(x["qual"] + 33)).alias("quals"),
        code(lambda x: F.char(F.least(F.coalesce(x["mapq"], F.lit(0)), F.lit(93)) + 33)).alias("mapqs"),
        F.array_join(F.transform("items", lambda x: (x["cycle"] + 1).cast("string")), ",").alias("cycles"),
    )


def gc_depth(depths: DataFrame, gc: DataFrame) -> DataFrame:
    """``gc, depth_sum, sites, normalised``: mean depth at each GC percentage over the overall mean; sites without GC count as 0."""
    joined = depths.join(gc, ["chrom", "pos"], "left").fillna(0, ["gc"])
    by = joined.groupBy("gc").agg(F.sum("depth").alias("depth_sum"), F.count(F.lit(1)).alias("sites"))
    whole = Window.partitionBy()  # at most 101 rows
    mean = F.sum("depth_sum").over(whole) / F.sum("sites").over(whole)
    return by.withColumn("normalised", F.round(F.col("depth_sum") / F.col("sites") / mean, 6))
