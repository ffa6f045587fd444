"""Command line: ``index``, ``align`` and ``pop+con`` over Spark.

    spark-submit -m lociflow.cli index --siteVCF sites.vcf --out_prefix out ...

Tables are written as Parquet below the output prefix; reports as text.
"""

from __future__ import annotations

import argparse
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import keys, numeric, sequence
from lociflow.operators import bases as B
from lociflow.operators import genotype, intervals, kmers, mapper, markers, mixture, pairs, panel, selecting, summary
from lociflow.session import cut
from lociflow.sources import reads as RD
from lociflow.sources import sinks, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lociflow")
    verbs = top.add_subparsers(dest="verb", required=True)
    i = verbs.add_parser("index", help="select markers and build the reduced genome")
    source = i.add_mutually_exclusive_group(required=True)
    source.add_argument("--siteVCF")
    source.add_argument("--predefinedVCF")
    i.add_argument("--regionList")
    i.add_argument("--dbsnpVCF")
    i.add_argument("--ref", required=True, help="FASTA")
    i.add_argument("--out_prefix", required=True)
    i.add_argument("--callableRegion")
    i.add_argument("--var_long", type=int, default=1000)
    i.add_argument("--var_short", type=int, default=9000)
    i.add_argument("--flank_len", type=int, default=250)
    i.add_argument("--flank_long_len", type=int, default=1000)
    a = verbs.add_parser("align", help="filter and place reads, and count statistics")
    a.add_argument("--fastq_1")
    a.add_argument("--fastq_2")
    a.add_argument("--fq_list")
    a.add_argument("--sam_in", help="aligned reads as SAM text instead of reads")
    a.add_argument("--index_prefix", required=True)
    a.add_argument("--out_prefix", required=True)
    a.add_argument("--kmer_thresh", type=int, default=3)
    a.add_argument("--q", type=int, default=0, help="quality for 3' trimming")
    a.add_argument("--I", action="store_true", help="qualities have the offset 64")
    a.add_argument("--frac_samp", type=float, default=1.0)
    a.add_argument("--seed", type=int, default=12345)
    c = verbs.add_parser("pop+con", help="fit ancestry and contamination")
    c.add_argument("--PileupFile")
    c.add_argument("--SVDPrefix")
    c.add_argument("--RefVCF", help="build the panel from genotypes and stop")
    c.add_argument("--Output", required=True)
    c.add_argument("--WithinAncestry", action="store_true")
    c.add_argument("--DisableSanityCheck", action="store_true")
    c.add_argument("--NumPC", type=int, default=4)
    c.add_argument("--FixPC", help="a:b:...")
    c.add_argument("--FixAlpha", type=float)
    c.add_argument("--KnownAF")
    c.add_argument("--Epsilon", type=float, default=1e-8)
    return top


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, seq`` of a FASTA file."""
    rows = RD.read_fastq(spark, path)
    return rows.select(keys.chrom(F.substring_index("name", " ", 1)).alias("chrom"), F.upper("seq").alias("seq"))


def run_index(spark: SparkSession, o: argparse.Namespace) -> None:
    if o.predefinedVCF:
        sites = text.vcf(text.lines(spark, o.predefinedVCF)).withColumn("chrom", keys.chrom("chrom"))
        kind = F.when(F.col("id").endswith("|L"), "long").otherwise("short")
        flank = F.when(kind == "long", o.flank_long_len).otherwise(o.flank_len)
        chosen = sites.select("chrom", "pos", F.col("id").alias("name"), "ref", "alt", kind.alias("class"), flank.alias("flank"))
    else:
        found = markers.candidates(text.vcf(text.lines(spark, o.siteVCF)))
        if o.regionList:
            found = intervals.in_regions(found, intervals.collapse(text.bed(text.lines(spark, o.regionList))))
        found = found.withColumn("name", F.concat_ws(":", "chrom", "pos", "ref", "alt")).withColumn("flank", F.lit(o.flank_long_len))
        if o.callableRegion:
            windows = markers.flanks(found)
            fine = intervals.covered(windows, text.bed(text.lines(spark, o.callableRegion)), "name").filter("ok").select("name")
            found = found.join(fine, "name", "left_semi")
        n_sex = 100 if o.var_short < 1000 else 300 if o.var_short < 9000 else 3000
        chosen = markers.with_quota(markers.greedy_spaced(found.select("chrom", "pos", "name", "ref", "alt", "af", "flank")), o.var_long, o.var_short, n_sex)
        chosen = chosen.withColumn("flank", F.when(F.col("class") == "long", o.flank_long_len).otherwise(o.flank_len))
    chosen = chosen.withColumn("name", keys.contig_name("chrom", "pos", "ref", "alt", "class"))
    chosen.write.mode("overwrite").parquet(f"{o.out_prefix}/markers")
    chosen = spark.read.parquet(f"{o.out_prefix}/markers")
    windows = markers.flanks(chosen)
    reduced = RD.fetch(windows, RD.fasta_blocks(read_fasta(spark, o.ref))).select("name", "chrom", "beg", F.col("bases").alias("seq"))
    reduced.write.mode("overwrite").parquet(f"{o.out_prefix}/contigs")
    reduced = spark.read.parquet(f"{o.out_prefix}/contigs")
    gc = markers.gc_window(reduced, "name", "seq").join(reduced.select("name", "chrom", "beg"), "name")
    gc.select("chrom", (F.col("beg") + F.col("at") - 1).alias("pos"), "gc").write.mode("overwrite").parquet(f"{o.out_prefix}/gc")
    alleles = kmers.both_alleles(reduced.join(chosen.select("name", "ref", "alt"), "name"), "name", "seq", "ref", "alt")
    kmers.panel_keys(alleles.filter("not reverse"), "seq").write.mode("overwrite").parquet(f"{o.out_prefix}/kmers")
    if o.dbsnpVCF:
        known = text.vcf(text.lines(spark, o.dbsnpVCF)).withColumn("chrom", keys.chrom("chrom")).select("chrom", "pos")
        intervals.in_regions(known, windows).write.mode("overwrite").parquet(f"{o.out_prefix}/known")
    sinks.save(sinks.fasta(reduced, "name", "seq"), f"{o.out_prefix}/reduced.fa")
    sinks.save(sinks.tabbed(windows, ["chrom", "beg", "end"]), f"{o.out_prefix}/flanks.bed")
    spark.createDataFrame([(json.dumps(vars(o)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{o.out_prefix}/params")


def _reads(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    if o.fq_list:
        listed = text.fastq_list(text.lines(spark, o.fq_list)).collect()  # a list of files
        files = [(r.path1, r.path2) for r in listed]
    else:
        files = [(o.fastq_1, o.fastq_2)]
    reads = RD.read_listed(spark, files)
    if o.frac_samp < 1:
        reads = selecting.downsampled(reads, "name", o.frac_samp, o.seed)
    if o.I:
        reads = reads.withColumn("qual", sequence.old_qualities("qual"))
    if o.q > 0:
        kept = sequence.trimmed_length("qual", o.q)
        reads = reads.withColumn("_n", kept).withColumns({c: F.substr(c, F.lit(1), F.col("_n")) for c in ("seq", "qual")}).drop("_n")
    return reads.withColumn("read_id", F.xxhash64("file_id", "mate", "read_idx"))


def run_align(spark: SparkSession, o: argparse.Namespace) -> None:
    marks = spark.read.parquet(f"{o.index_prefix}/markers")
    contigs = spark.read.parquet(f"{o.index_prefix}/contigs")
    if o.sam_in:
        rows = text.sam(text.lines(spark, o.sam_in)).filter("cigar is not null")
        md = F.substring_index(F.try_element_at("tags", F.lit("MD")), ":", -1)
        placed = rows.select(F.xxhash64("name", "flag").alias("read_id"), "chrom", "pos", "mapq", "cigar", md.alias("md"), "seq", "qual", numeric.flag("flag", numeric.REVERSE).alias("strand"))
    else:
        reads = _reads(spark, o)
        reads.write.mode("overwrite").parquet(f"{o.out_prefix}/reads")
        reads = spark.read.parquet(f"{o.out_prefix}/reads")
        summary.file_totals(reads).write.mode("overwrite").parquet(f"{o.out_prefix}/file_totals")
        kept = kmers.filter_reads(reads, "read_id", "seq", spark.read.parquet(f"{o.index_prefix}/kmers"), o.kmer_thresh).filter("kept")
        use = reads.join(kept.select("read_id"), "read_id", "left_semi")
        placed = place_reads(use.drop("name"), contigs)
    placed.write.mode("overwrite").parquet(f"{o.out_prefix}/alignments")
    placed = spark.read.parquet(f"{o.out_prefix}/alignments")
    bases = intervals.in_regions(B.aligned_bases(placed), intervals.collapse(markers.flanks(marks)))
    known = _maybe(spark, f"{o.index_prefix}/known")
    judged = B.mismatches(bases, known)
    depths = B.depth(bases)
    region = intervals.total_length(intervals.collapse(markers.flanks(marks))).first()["bases"]
    out = {
        "depth_hist": B.depth_histogram(depths.groupBy("depth").agg(F.count(F.lit(1)).alias("sites")), region),
        "gc_hist": B.gc_depth(depths, spark.read.parquet(f"{o.index_prefix}/gc").dropDuplicates(["chrom", "pos"])),
        "quality_by_reported": B.quality_by_reported(judged),
        "quality_by_cycle": B.quality_by_cycle(judged),
        "sites_by_depth": B.sites_from(depths.groupBy("depth").agg(F.count(F.lit(1)).alias("sites"))),
    }
    at = B.marker_bases(placed, marks)
    piles = B.pileup(at)
    out["pileup"] = B.pileup_text(piles, marks)
    af = marks.select("chrom", "pos", F.coalesce("af", F.lit(0.5)).alias("af")) if "af" in marks.columns else marks.select("chrom", "pos", F.lit(0.5).alias("af"))
    out["genotypes"] = genotype.calls(genotype.likelihoods(at, marks), af)
    if not o.sam_in:
        marked = placed.withColumn("flag", pairs.flags("file_id", "read_idx", "mate", "strand"))
        out["sex_contigs"] = summary.contig_counters(marked, marks, ["X", "Y"])
        pair = pairs.pair_status(pairs.aligned_pairs(placed.drop("read_idx"), placed.select("read_id", "read_idx"), marks))
        pair.write.mode("overwrite").parquet(f"{o.out_prefix}/pairs")
        pair = spark.read.parquet(f"{o.out_prefix}/pairs")
        out |= {"duplicates": pairs.duplicate_rate(pair), "insert_sizes": pairs.adjusted_insert(pair)}
        out["summary"] = summary.summary(spark.read.parquet(f"{o.out_prefix}/reads"), depths, marks, region, pair)
    for name, df in out.items():
        df.write.mode("overwrite").parquet(f"{o.out_prefix}/{name}")
    sinks.save(sinks.tabbed(out["pileup"]), f"{o.out_prefix}/pileup.txt")


def place_reads(reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Alignments of reads on the contigs: whole reads by mismatches, the rest with gaps, then mates beside confident ones.

    A read that fits nowhere with mismatches alone is placed with gaps if exactly one contig has its fewest edits. What is
    then left is looked for by local alignment where its placed mate predicts it, and has the quality of LEAST_ANCHOR.
    """
    bare = reads.select(F.col("read_id").alias("key"), "seq")
    targets = contigs.select("name", "seq")
    best = mapper.placed(mapper.hits(bare, targets))
    whole = best.join(bare.select("key", F.length("seq").alias("_n")), "key")
    cigar = F.array(F.struct(F.col("_n").alias("len"), F.lit("M").alias("op")))
    whole = whole.select("key", "name", "at", "reverse", "mapq", cigar.alias("cigar"))
    rest = bare.join(whole.select("key"), "key", "left_anti").filter(F.length("seq") >= 2 * mapper.SEED)
    gapped = mapper.gapped_hits(rest, targets)
    each = gapped.groupBy("key", "edits").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("name", "at", "reverse", "cigar")).alias("p"))
    first = each.groupBy("key").agg(F.min(F.struct("edits", "n", "p")).alias("b")).filter("b.n = 1")
    gapped = first.select("key", "b.p.name", "b.p.at", "b.p.reverse", F.lit(25).alias("mapq"), "b.p.cigar")
    found = cut(whole.unionByName(gapped))
    ids = reads.select(F.col("read_id").alias("key"), "file_id", "read_idx", "mate", "seq")
    sure = found.withColumn("stop", F.col("at") + sequence.reference_length("cigar")).join(ids.drop("seq"), "key")
    one, two = (sure.filter(F.col("mate") == m).select("file_id", "read_idx", "name", "at", "stop", "reverse") for m in (1, 2))
    size = F.greatest("stop", "stop_2") - F.least("at", "at_2")
    both = one.join(two.withColumnsRenamed({"at": "at_2", "stop": "stop_2", "reverse": "reverse_2"}), ["file_id", "read_idx", "name"]).filter("reverse <> reverse_2")
    usual, spread = both.agg(F.median(size), F.stddev_pop(size)).first()  # one row
    missing = ids.join(found.select("key"), "key", "left_anti")
    other = sure.drop("key").withColumn("mate", 3 - F.col("mate"))
    anchors = missing.join(other, ["file_id", "read_idx", "mate"]).select("key", "name", "at", "stop", "reverse", "mapq", "seq")
    beside = mapper.rescued(anchors, targets, int(usual or 250), max(10, int(spread or 50)))
    beside = beside.select("key", "name", "at", "reverse", F.lit(mapper.LEAST_ANCHOR).alias("mapq"), "cigar")
    own = cut(found.unionByName(beside)).join(reads.withColumnRenamed("read_id", "key"), "key").join(contigs.select("name", "chrom", "beg", F.col("seq").alias("_ref")), "name")
    turned = F.upper(F.when(F.col("reverse"), sequence.reverse_complement("seq")).otherwise(F.col("seq")))
    piece = F.substr("_ref", F.col("at") + 1, sequence.reference_length("cigar"))
    own = cut(own.withColumn("seq", turned).withColumn("ref", F.upper(piece)).withColumnRenamed("key", "read_id").drop("_ref"))
    scripts = B.mismatch_scripts(own)
    qual = F.when(F.col("reverse"), F.reverse("qual")).otherwise(F.col("qual"))
    return own.join(scripts, "read_id").select(
        "read_id", "chrom", (F.col("beg") + F.col("at")).alias("pos"), "mapq", "cigar", "md", "seq", qual.alias("qual"), F.col("reverse").alias("strand"), "file_id", "mate", "read_idx", F.col("name").alias("contig")
    )


def _maybe(spark: SparkSession, path: str) -> DataFrame | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.parquet(path) if exists else None


def run_popcon(spark: SparkSession, o: argparse.Namespace) -> mixture.Fit | None:
    if o.RefVCF:
        sites = text.genotype_vcf(text.lines(spark, o.RefVCF)).withColumn("chrom", keys.chrom("chrom"))
        sites = sites.filter(F.col("chrom").isin(keys.AUTOSOMES) & (F.length("ref") == 1) & (F.length("alt") == 1))
        best = F.when(F.size("pl") == 3, markers.best_genotype(F.col("pl"))).otherwise(text.alternative_alleles(F.col("gt")))
        per = sites.withColumn("g", best.cast("double")).groupBy("chrom", "pos", "ref", "alt")
        rows = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "g"))), lambda x: F.greatest(x["g"], F.lit(0.0))).alias("g"))
        rows = rows.withColumn("marker", keys.contig_name("chrom", "pos", "ref", "alt", F.lit("short")))
        built, samples, _ = panel.build_panel(rows, "marker", "g", 10)
        built.join(rows.select("marker", "chrom", "pos", "ref", "alt"), "marker").write.mode("overwrite").parquet(f"{o.Output}/panel")
        samples.write.mode("overwrite").parquet(f"{o.Output}/samples")
        return None
    own = spark.read.parquet(f"{o.SVDPrefix}/panel").withColumn("marker_idx", F.xxhash64("chrom", "pos"))
    width = own.agg(F.min(F.size("ud"))).first()[0]
    dims = min(o.NumPC, 4)
    if width < dims:
        raise ValueError(f"the panel has {width} components; --NumPC asks for {dims}")
    own = own.withColumn("ud", F.slice("ud", 1, dims))
    piles = text.pileup_text(text.lines(spark, o.PileupFile), own)
    each = piles.select("chrom", "pos", F.posexplode(F.split("bases", "")).alias("_i", "base"), "quals").filter("base <> ''")
    each = each.withColumn("qual", F.ascii(F.substr("quals", F.col("_i") + 1, F.lit(1))) - 33).withColumn("base", F.upper("base"))
    counts = mixture.sufficient(each, own)
    if not o.DisableSanityCheck:
        if not mixture.enough_markers(counts, own):
            raise ValueError("too few markers are covered; --DisableSanityCheck fits all the same")
        counts = mixture.usual_depth(counts)
    known = None
    if o.KnownAF:
        af = text.known_frequencies(text.lines(spark, o.KnownAF))
        known = own.join(af.select("chrom", "pos", "af"), ["chrom", "pos"]).select("marker_idx", "af")
    fixed = [float(x) for x in o.FixPC.split(":")] if o.FixPC else [0.0] * dims if o.KnownAF else None
    llk = mixture.Likelihood(counts, own, known)
    result = mixture.fit(llk, dims, o.WithinAncestry or bool(o.KnownAF), fixed, o.FixAlpha, o.Epsilon)
    ancestry = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(np.atleast_1d(result.pc1), np.atleast_1d(result.pc2)))]
    spark.createDataFrame(ancestry, "pc int, contaminating double, intended double").coalesce(1).write.mode("overwrite").csv(f"{o.Output}/ancestry", header=True)
    row = [(result.alpha, result.llk1, result.llk0, result.evaluations)]
    spark.createDataFrame(row, "alpha double, llk1 double, llk0 double, evaluations int").coalesce(1).write.mode("overwrite").csv(f"{o.Output}/self", header=True)
    return result


def main(arguments: list[str] | None = None) -> None:
    options = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("lociflow").getOrCreate()
    {"index": run_index, "align": run_align, "pop+con": run_popcon}[options.verb](spark, options)


if __name__ == "__main__":
    main()
