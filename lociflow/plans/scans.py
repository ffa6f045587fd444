"""Queries of sources and sinks: tables written in a text format and read back, and text forms of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.functions import keys, sequence
from lociflow.operators import bases as B
from lociflow.operators import kmers
from lociflow.operators import lookup as L
from lociflow.operators import markers as M
from lociflow.operators import pairs as PR
from lociflow.operators import selecting as S
from lociflow.operators import summary as SU
from lociflow.operators import sweep as SW
from lociflow.plans.aggregates import _CALL, _GT, _SEX_CONTIGS, SIZE, SQL_ADJUSTED, calls_table, genotype_array, site_table
from lociflow.plans.domain import (
    ALN, BASES, DEPTH, MARKERS, MISMATCHES, PAIRS, READS, base_table, marker_base_table, marker_table, norm, pair_table, placed, read_table, segment_table,
)
from lociflow.plans.registry import Registry
from lociflow.session import table
from lociflow.sources import binary as BN
from lociflow.sources import reads as RD
from lociflow.sources import sinks as K
from lociflow.sources import text as TX
from lociflow.streaming.jobs import place

R = Registry()
QUERIES, SQL = R.queries, R.sql


def _lines(df, *cells):
    return df.select(F.concat_ws("\t", *[c if not isinstance(c, str) else F.col(c).cast("string") for c in cells]).alias("value"))


_WHOLE = "name is not null and seq is not null and qual is not null and length(seq) = length(qual)"


@R.query("src_s01_fastq", f"with {READS} select name, seq, qual, count(*) as n from reads where {_WHOLE} group by 1, 2, 3")
def fastq(spark, sf_dir):
    """Reads written as FASTQ to the shared folder and read by the data source."""
    at = place(spark, "fastq")
    K.save(K.fastq(read_table(spark, sf_dir).filter(_WHOLE)), at)
    rows = RD.read_fastq(spark, at + "/*.txt")
    return rows.groupBy("name", "seq", "qual").agg(F.count(F.lit(1)).alias("n"))


@R.query("src_s04_fastq_list", "select path1, path2 from fastq_list")
def fastq_list(spark, sf_dir):
    files = table(spark, sf_dir, "fastq_list")
    body = files.select(F.concat_ws(" ", "path1", "path2").alias("value"))
    return TX.fastq_list(spark.createDataFrame([("# two columns",), ("",)], "value string").unionByName(body))


@R.query(
    "src_s07_genotype_vcf",
    f"with g as (select vec_id, {_GT} as g from embeddings) select vec_id::bigint as id, 's' || (i - 1) as sample, cast(g[i] as int) as alleles from (select vec_id, g, unnest(range(1, 9)) as i from g)",
)
def genotype_vcf(spark, sf_dir):
    """Eight samples a site, written with GT and PL and read back."""
    e = table(spark, sf_dir, "embeddings")
    text = F.transform(F.slice(genotype_array(), 1, 8), lambda g: F.when(g < 0, "./.:0,0,0").when(g == 0, "0/0:0,9,9").when(g == 1, "0|1:9,0,9").otherwise("1/1:9,9,0"))
    site = [F.lit("1"), F.col("vec_id").cast("string"), F.col("vec_id").cast("string"), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), F.lit("."), F.lit("GT:PL")]
    body = e.select(F.concat_ws("\t", *site, F.array_join(text, "\t")).alias("value"))
    header = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{i}" for i in range(8)]])
    sites = TX.genotype_vcf(spark.createDataFrame([("##fileformat=VCFv4.1",), (header,)], "value string").unionByName(body))
    return sites.select(F.col("id").cast("bigint").alias("id"), "sample", TX.alternative_alleles(F.col("gt")).alias("alleles"))


@R.query("src_s09_bed", f"with {MARKERS} select chrom, greatest(0, pos - flank) as beg, cast(max(pos + flank) as int) as \"end\" from markers group by 1, 2")
def bed(spark, sf_dir):
    m = table(spark, sf_dir, "contigs").withColumn("m", keys.contig("name"))
    flank = F.when(F.col("m.class") == "long", 1000).otherwise(250)
    return TX.bed(_lines(m, "chrom", F.greatest(F.lit(0), F.col("m.pos") - flank).cast("string"), (F.col("m.pos") + flank).cast("string")))


@R.query("src_s10_callable_bed", "select chrom, pos - 50 as beg, pos + 50 as \"end\" from contigs where pos > 50")
def callable_bed(spark, sf_dir):
    rows = table(spark, sf_dir, "contigs").filter("pos > 50")
    return TX.bed_or_points(_lines(rows, "chrom", (F.col("pos") - 50).cast("string"), (F.col("pos") + 50).cast("string")))


@R.query("src_s11_bed_or_points", "select chrom, case when reference_id % 2 = 0 then pos - 1 else pos end as beg, case when reference_id % 2 = 0 then pos else pos + 7 end as \"end\" from contigs")
def bed_or_points(spark, sf_dir):
    c = table(spark, sf_dir, "contigs")
    stop = F.when(F.col("reference_id") % 2 == 1, (F.col("pos") + 7).cast("string"))
    head = spark.createDataFrame([("# comment",), ("track name=x",), ("browser position",)], "value string")
    return TX.bed_or_points(head.unionByName(_lines(c, "chrom", "pos", stop)))


@R.query("src_s12_marker_bed", f"with {MARKERS} select chrom, cast(pos - 1 as int) as beg, pos, ref, alt from markers")
def marker_bed(spark, sf_dir):
    m = marker_table(spark, sf_dir)
    return TX.marker_bed(_lines(m, "chrom", (F.col("pos") - 1).cast("string"), "pos", "ref", "alt"))


@R.query("src_s13_fasta_fetch", f"with {ALN} select read_id, substr(seq, 21, greatest(0, least(length(seq), 90) - 20)) as bases from aln where length(seq) >= 21")
def fasta_fetch(spark, sf_dir):
    """Positions 21 to 90 of every sequence, from blocks of 32 bases."""
    own = placed(spark, sf_dir).filter("seq is not null").select(F.col("read_id").alias("chrom"), "seq")
    regions = own.select("chrom", F.lit(21).alias("beg"), F.lit(90).alias("end"))
    return RD.fetch(regions, RD.fasta_blocks(own, 32), 32).filter("bases <> ''").select(F.col("chrom").alias("read_id"), "bases")


@R.query("src_s14_fetch_normalised", f"with {MARKERS} select m.name, c.contig_len from markers m join contigs c on {norm('c.chrom')} = m.chrom and c.pos = m.pos")
def fetch_normalised(spark, sf_dir):
    c = table(spark, sf_dir, "contigs").select(keys.chrom("chrom").alias("chrom"), "pos", "contig_len")
    return marker_table(spark, sf_dir).join(c, ["chrom", "pos"]).select("name", "contig_len")


@R.query("src_s15_contig_sizes", f"select {norm('chrom')} as chrom, cast(sum(contig_len) as bigint) as bases, count(*) as contigs from contigs group by 1")
def contig_sizes(spark, sf_dir):
    sizes = TX.fasta_index(_lines(table(spark, sf_dir, "contigs"), "chrom", "contig_len", F.lit("0"), F.lit("50"), F.lit("51")))
    return sizes.groupBy("chrom").agg(F.sum("len").alias("bases"), F.count(F.lit(1)).alias("contigs"))


@R.query("src_s16_sam", f"with {ALN} select read_id, flag, chrom, coalesce(pos, 0) as pos, coalesce(mapq, 0) as mapq, seq, qual, cast(coalesce(list_sum(list_transform(cigar, lambda c: c.len)), case when seq is not null then length(seq) end) as int) as ops, md from aln where read_id is not null")
def sam(spark, sf_dir):
    own = placed(spark, sf_dir).withColumn("name", F.col("read_id").cast("string"))
    header = spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:1\tLN:1000",)], "value string")
    back = TX.sam(header.unionByName(K.sam_lines(own, sequence.render_cigar("cigar", "seq"))))
    total = F.aggregate("cigar", F.lit(0), lambda a, c: a + c["len"])
    md = F.substring_index(F.try_element_at("tags", F.lit("MD")), ":", -1)
    return back.select(F.col("name").cast("bigint").alias("read_id"), "flag", "chrom", "pos", "mapq", "seq", "qual", total.alias("ops"), md.alias("md"))


@R.query("src_s17_region_scan", "select distinct rec_id, reference_id, pos from sam_records where reference_id = 958 and pos between 121692000 and 121693000")
def region_scan(spark, sf_dir):
    """A region of records: the predicate reaches the scan, row groups outside it are skipped."""
    return table(spark, sf_dir, "sam_records").filter("reference_id = 958 and pos between 121692000 and 121693000").select("rec_id", "reference_id", "pos").distinct()


@R.query("src_s19_pileup_scan", f"with {MARKERS}, {BASES} select b.chrom, b.pos, count(*) as depth from bases b join aln a using (read_id) where a.flag & 1796 = 0 and a.pos > 0 and a.mapq >= 13 and b.qual >= 2 and exists (select 1 from markers m where m.chrom = b.chrom and m.pos = b.pos) group by 1, 2")
def pileup_scan(spark, sf_dir):
    bases = B.marker_bases(S.pileup_reads(placed(spark, sf_dir)), marker_table(spark, sf_dir)).filter("qual >= 2")
    return B.depth(bases).select("chrom", "pos", "depth")


_TEXT = f"""with {MARKERS}, {BASES}, mk as (select distinct on (chrom, pos) chrom, pos, ref from markers order by chrom, pos, name), b as (select b.*, mk.ref from bases b join mk using (chrom, pos) where b.qual is not null)"""


def _piles(spark, sf_dir):
    marks = marker_table(spark, sf_dir).groupBy("chrom", "pos").agg(F.min_by("ref", "name").alias("ref"))
    return B.pileup_text(B.pileup(marker_base_table(spark, sf_dir).filter("qual is not null")), marks)


_CELLS = """chrom || chr(9) || pos || chr(9) || ref || chr(9) || count(*) || chr(9) || string_agg(case when strand then upper(base) else lower(base) end, '' order by read_id, cycle)
  || chr(9) || string_agg(chr(qual + 33), '' order by read_id, cycle)"""


@R.query(
    "snk_k16_pileup_text",
    f"{_TEXT} select {_CELLS} || chr(9) || string_agg(chr(least(coalesce(mapq, 0), 93) + 33), '' order by read_id, cycle) || chr(9) || string_agg(cast(cycle + 1 as varchar), ',' order by read_id, cycle) as value from b group by chrom, pos, ref",
)
def pileup_text(spark, sf_dir):
    return K.tabbed(_piles(spark, sf_dir))


@R.query("snk_k21_short_pileup_text", f"{_TEXT} select {_CELLS} as value from b group by chrom, pos, ref")
def short_pileup_text(spark, sf_dir):
    return K.tabbed(_piles(spark, sf_dir), ["chrom", "pos", "ref", "depth", "bases", "quals"])


@R.query("src_s20_pileup_text", f"{_TEXT} select chrom, pos, ref, cast(count(*) as int) as depth, string_agg(case when strand then upper(base) else lower(base) end, '' order by read_id, cycle) as bases from b group by chrom, pos, ref")
def read_pileup_text(spark, sf_dir):
    lines = K.tabbed(_piles(spark, sf_dir), ["chrom", "pos", "ref", "depth", "bases", "quals"])
    return TX.pileup_text(lines, marker_table(spark, sf_dir)).select("chrom", "pos", "ref", "depth", "bases")


@R.query("src_s21_matrix", "select 'v' || vec_id as name, list_transform(embedding[1:4], lambda x: round(x::double, 6)) as values from embeddings")
def matrix(spark, sf_dir):
    cells = F.transform("embedding", lambda x: x.cast("double").cast("string"))
    rows = table(spark, sf_dir, "embeddings").select(F.concat_ws("\t", F.concat(F.lit("v"), F.col("vec_id").cast("string")), F.array_join(cells, " ")).alias("value"))
    return TX.matrix(rows, 4).select("name", F.transform("values", lambda x: F.round(x, 6)).alias("values"))


@R.query("src_s22_known_af", f"with {MARKERS} select chrom, pos, ref, alt, round((pos % 97 + 1) / 100.0::double, 6) as af from markers")
def known_af(spark, sf_dir):
    m = marker_table(spark, sf_dir)
    lines = _lines(m, "chrom", (F.col("pos") - 1).cast("string"), "pos", "ref", "alt", ((F.col("pos") % 97 + 1) / 100.0).cast("string"))
    return TX.known_frequencies(lines).select("chrom", "pos", "ref", "alt", F.round("af", 6).alias("af"))


@R.query("src_s23_insert_table", f"with {PAIRS} select file_id, read_idx, status, max1, max2, obs from pairs")
def insert_table(spark, sf_dir):
    return TX.insert_table(K.tabbed(pair_table(spark, sf_dir), ["file_id", "read_idx", "status", "max1", "max2", "obs"]))


@R.query("src_s25_panel_keys", f"""with {ALN}, panel as (select distinct upper(seq) as p from aln where mapq >= 55 and mapq < 255 and seq is not null), both_ as (select p from panel union select translate(reverse(p), 'ACGT', 'TGCA') from panel),
pk as (select distinct kmer from (select substr(p, i::int, 32) as kmer from (select p, unnest(range(1, length(p) - 30)) as i from both_ where length(p) >= 32)) where regexp_full_match(kmer, '[ACGT]+')),
h as (select distinct unnest(range(6)) as mask, unnest([substr(kmer, 1, 16), substr(kmer, 17, 16), substr(kmer, 1, 8) || substr(kmer, 25, 8), substr(kmer, 9, 16), substr(kmer, 1, 8) || substr(kmer, 17, 8), substr(kmer, 9, 8) || substr(kmer, 25, 8)]) as key from pk) select cast(mask as tinyint) as mask, count(*) as keys from h group by 1""")
def panel_keys(spark, sf_dir):
    return kmers.panel_keys(placed(spark, sf_dir).filter("mapq >= 55 and mapq < 255"), "seq").groupBy("mask").agg(F.count(F.lit(1)).alias("keys"))


@R.query("src_s26_populations", "select 'v' || vec_id as sample, 'pop' || label as population from embeddings")
def populations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return TX.populations(e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit("   pop"), F.col("label").cast("string")).alias("value")))


@R.query("join_d18_holes", "with w as (select reference_id, contig_offset as beg, contig_offset + contig_len as stop from contigs), h as (select reference_id * 700 as h, 150 + reference_id % 90 as len from contigs) select w.reference_id, cast(sum(least(stop, h + len) - greatest(beg, h)) as bigint) as holes from w join h on beg < h + len and h < stop group by 1")
def holes(spark, sf_dir):
    c = table(spark, sf_dir, "contigs")
    windows = c.select("reference_id", F.col("contig_offset").alias("beg"), (F.col("contig_offset") + F.col("contig_len")).alias("end"))
    gaps = c.select((F.col("reference_id") * 700).cast("bigint").alias("offset"), (150 + F.col("reference_id") % 90).cast("bigint").alias("len"))
    return L.hole_overlap(windows, gaps, "reference_id")


@R.query("snk_k01_selected_sites", f"with {MARKERS} select chrom || chr(9) || pos || chr(9) || name || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'CLASS=' || class as value from markers")
def selected_sites(spark, sf_dir):
    m = marker_table(spark, sf_dir)
    info = F.create_map(F.lit("CLASS"), F.col("class"))
    return K.vcf_sites(m.select("chrom", "pos", F.col("name").alias("id"), "ref", "alt", F.lit(None).cast("double").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info")))


@R.query("snk_k02_flank_bed", f"with {MARKERS} select chrom || chr(9) || (pos - flank) || chr(9) || (pos + flank) as value from markers")
def flank_bed(spark, sf_dir):
    return K.tabbed(marker_table(spark, sf_dir).select("chrom", F.col("pos") - F.col("flank"), F.col("pos") + F.col("flank")))


@R.query("snk_k03_known_subset", f"with {MARKERS} select chrom || chr(9) || pos || chr(9) || ref || chr(9) || alt as value from markers where exists (select 1 from alignments a where a.contig = markers.name)")
def known_subset(spark, sf_dir):
    seen = placed(spark, sf_dir).select(F.col("contig").alias("name")).distinct()
    return K.tabbed(marker_table(spark, sf_dir).join(seen, "name", "left_semi"), ["chrom", "pos", "ref", "alt"])


@R.query("snk_k04_fasta", f"with {READS} select '>' || read_id || chr(10) || seq as value from reads where seq is not null")
def fasta(spark, sf_dir):
    return K.fasta(read_table(spark, sf_dir).filter("seq is not null").withColumn("id", F.col("read_id").cast("string")), "id", "seq")


_SAM = f"""with {ALN}, {MISMATCHES}, x as (select read_id, count(*) as n from mm group by 1),
t as (select a.*, coalesce(x.n, 0) as xm, coalesce(list_sum(list_transform(list_filter(cigar, lambda c: c.op in ('I', 'D')), lambda c: c.len)), 0) as xg, len(list_filter(cigar, lambda c: c.op in ('I', 'D'))) as xo
  from aln a left join x using (read_id)),
sam as (select read_id, concat_ws(chr(9), read_id, flag, coalesce(chrom, '*'), coalesce(pos, 0), coalesce(mapq, 0), case when len(cigar) > 0 then list_aggregate(list_transform(cigar, lambda c: c.len || c.op), 'string_agg', '') else coalesce(length(seq) || 'M', '*') end,
  '*', 0, 0, coalesce(seq, '*'), coalesce(qual, '*'), 'RG:Z:' || file_id, case when cigar is not null then concat_ws(chr(9), 'XT:A:' || case when c1 = 1 then 'U' else 'R' end, 'NM:i:' || cast(xm + xg as bigint), 'SM:i:' || coalesce(mapq, 0), 'X0:i:' || c1, 'X1:i:' || c2,
  'XM:i:' || xm, 'XO:i:' || xo, 'XG:i:' || cast(xg as bigint)) end, 'MD:Z:' || md) as value from t)"""


def _sam_lines(spark, sf_dir):
    own = placed(spark, sf_dir).withColumns({"name": F.col("read_id").cast("string"), "read_group": F.col("file_id").cast("string")})
    return K.sam_lines(own, sequence.render_cigar("cigar", "seq"), K.placement_tags())


_INDEX = f"""{ALN}, {MARKERS}, panel as (select distinct upper(seq) as p from aln where mapq >= 55 and mapq < 255 and seq is not null), both_ as (select p from panel union select translate(reverse(p), 'ACGT', 'TGCA') from panel),
pk as (select distinct kmer from (select substr(p, i::int, 32) as kmer from (select p, unnest(range(1, length(p) - 30)) as i from both_ where length(p) >= 32)) where regexp_full_match(kmer, '[ACGT]+')),
h as (select distinct unnest(range(6)) as mask, unnest([substr(kmer, 1, 16), substr(kmer, 17, 16), substr(kmer, 1, 8) || substr(kmer, 25, 8), substr(kmer, 9, 16), substr(kmer, 1, 8) || substr(kmer, 17, 8), substr(kmer, 9, 8) || substr(kmer, 25, 8)]) as key from pk)"""


@R.query(
    "snk_k06_index_tables",
    f"with {_INDEX} select 'kmers' as part, count(*) as n from h union all select 'markers', count(*) from markers union all select 'contigs', count(*) from panel union all select 'param:flank', 250 union all select 'param:flank_long', 1000",
)
def index_tables(spark, sf_dir):
    """The tables of an index, written and read back: keys of the panel, markers, sequences, parameters as JSON."""
    at = place(spark, "index")
    sure = placed(spark, sf_dir).filter("mapq >= 55 and mapq < 255")
    sequences = sure.filter("seq is not null").groupBy(F.upper("seq").alias("seq")).agg(F.min("read_id").alias("name"))
    K.save_index(at, kmers.panel_keys(sure, "seq"), marker_table(spark, sf_dir), sequences, {"flank": 250, "flank_long": 1000})
    parts = [spark.read.parquet(f"{at}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n in ("kmers", "markers", "contigs")]
    params = spark.read.json(f"{at}/params").select(F.concat(F.lit("param:"), F.col("name")).alias("part"), F.col("value").cast("bigint").alias("n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(params)


@R.query("src_s18_indexed_lines", f"with {MARKERS}, w as (select name, chrom, pos - flank as beg, pos + flank as \"end\" from markers), l as (select read_id, {norm('chrom')} as chrom, pos from (select distinct on (read_id) * from alignments order by read_id) where pos > 0) select w.name, count(*) as lines from w join l on l.chrom = w.chrom and l.pos between w.beg and w.\"end\" group by 1")
def indexed_lines(spark, sf_dir):
    """Lines of a text sorted by position, found by regions through its index of bins."""
    own = placed(spark, sf_dir).filter("pos > 0").select(keys.chrom("chrom").alias("chrom"), "pos", F.col("read_id").cast("string").alias("rest"))
    at = place(spark, "lines")
    TX.save_indexed(own.select("chrom", "pos", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "rest").alias("value")), at)
    windows = marker_table(spark, sf_dir).select("name", "chrom", (F.col("pos") - F.col("flank")).alias("beg"), (F.col("pos") + F.col("flank")).alias("end"))
    return TX.indexed_lines(spark, at, windows).groupBy("name").agg(F.count(F.lit(1)).alias("lines"))


@R.query("snk_k07_sam_records", f"{_SAM} select value from sam")
def sam_text(spark, sf_dir):
    """Whole SAM lines with the tags of a placement."""
    return _sam_lines(spark, sf_dir)


@R.query("snk_k08_sam_file", f"{_SAM} select value from sam union all select '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' union all select '@RG' || chr(9) || 'ID:' || file_id || chr(9) || 'SM:sample' from (select distinct file_id from aln)")
def sam_file(spark, sf_dir):
    """A SAM file with its header, written as text and read back line by line."""
    groups = placed(spark, sf_dir).select("file_id").distinct().select(F.concat(F.lit("@RG\tID:"), F.col("file_id").cast("string"), F.lit("\tSM:sample")).alias("value"))
    head = spark.createDataFrame([("@HD\tVN:1.6\tSO:unsorted",)], "value string").unionByName(groups)
    at = place(spark, "sam")
    K.save(head.unionByName(_sam_lines(spark, sf_dir)), at)
    return spark.read.text(at)


@R.query(
    "snk_k07_bam_records",
    f"""with {ALN} select read_id, coalesce(flag, 0) as flag, chrom, coalesce(pos, 0) as pos, coalesce(mapq, 0) as mapq, upper(seq) as seq, case when length(qual) = length(seq) and length(seq) > 0 then qual end as qual, len(cigar) as ops, 'Z:' || file_id as rg, 'Z:' || md as md from aln""",
)
def bam_records(spark, sf_dir):
    """BAM files of all placed and unplaced reads, written a file per partition and read back."""
    own = placed(spark, sf_dir).withColumns({"name": F.col("read_id").cast("string"), "mate_chrom": F.lit(None).cast("string"), "mate_pos": F.lit(0), "insert_size": F.lit(0)})
    tags = F.map_filter(F.create_map(F.lit("RG"), F.concat(F.lit("Z:"), F.col("file_id").cast("string")), F.lit("MD"), F.concat(F.lit("Z:"), F.col("md"))), lambda _, v: v.isNotNull())
    names = sorted(r[0] for r in own.select("chrom").distinct().collect() if r[0] is not None)  # the chromosomes of the header
    at = place(spark, "bam")
    BN.write_bam(own.withColumn("tags", tags), at, [(n, 300_000_000) for n in names])
    back = BN.read_bam(spark, at + "/*.bam")
    ops = F.when(F.col("cigar").isNotNull(), F.size("cigar").cast("bigint"))
    return back.select(F.col("name").cast("bigint").alias("read_id"), "flag", "chrom", "pos", "mapq", "seq", "qual", ops.alias("ops"), F.try_element_at("tags", F.lit("RG")).alias("rg"), F.try_element_at("tags", F.lit("MD")).alias("md"))


@R.query("snk_k09_insert_table", f"with {PAIRS} select file_id || chr(9) || read_idx || chr(9) || status || chr(9) || max1 || chr(9) || max2 || chr(9) || obs as value from pairs")
def insert_lines(spark, sf_dir):
    return K.tabbed(pair_table(spark, sf_dir), ["file_id", "read_idx", "status", "max1", "max2", "obs"])


@R.query("snk_k10_depth_lines", f"with {BASES}, {DEPTH}, h as (select least(depth, 1023) as depth, count(*) as sites from depth group by 1) select d.depth || chr(9) || case when d.depth = 0 then {SIZE} - (select count(*) from depth) else coalesce(h.sites, 0) end as value from (select unnest(range(1024)) as depth) d left join h using (depth)")
def depth_lines(spark, sf_dir):
    return K.tabbed(B.depth_histogram(SW.depth_counts(segment_table(spark, sf_dir)), SIZE), ["depth", "sites"])


@R.query("snk_k15_sex_contigs", f"select contig || chr(9) || overlapping || chr(9) || included || chr(9) || pair_overlapping || chr(9) || pair_included as value from ({_SEX_CONTIGS})")
def sex_contig_lines(spark, sf_dir):
    counts = SU.contig_counters(placed(spark, sf_dir), marker_table(spark, sf_dir), ["X", "Y"]).orderBy("contig")
    return K.tabbed(counts, ["contig", "overlapping", "included", "pair_overlapping", "pair_included"])


@R.query(
    "snk_k17_call_lines",
    f"""select concat_ws(chr(9), c.chrom, c.pos, '.', m.ref, m.alt, '.', 'PASS', 'AF=' || cast(((c.pos % 97) + 1) / 100.0::double as varchar) || ';AC=' || depth, 'GT:PL:GP',
      gt || ':' || pl0 || ',' || pl1 || ',' || pl2 || ':' || gp0 || ',' || gp1 || ',' || gp2) as value from ({_CALL}) c join (select chrom, pos, ref, alt from (with {MARKERS} select distinct on (chrom, pos) chrom, pos, ref, alt from markers order by chrom, pos, name)) m using (chrom, pos)""",
)
def call_lines(spark, sf_dir):
    calls = calls_table(spark, sf_dir).join(site_table(spark, sf_dir), ["chrom", "pos"])
    return K.vcf_calls(calls.withColumn("af", ((F.col("pos") % 97) + 1) / F.lit(100.0)))


@R.query(
    "snk_k18_file_lines",
    f"""with {READS} select concat_ws(chr(9), coalesce(cast(file_id as varchar), 'Total'), count(*), cast(sum(length(seq)) as bigint), cast(sum(length(seq)) // count(*) as bigint)) as value from reads group by grouping sets ((file_id), ())""",
)
def file_lines(spark, sf_dir):
    """Reads, bases and read length of each file, and the row of all."""
    totals = SU.file_totals(read_table(spark, sf_dir))
    return K.tabbed(totals.select(F.coalesce(F.col("file_id").cast("string"), F.lit("Total")).alias("file"), "reads", "bases", "read_length"))


@R.query(
    "snk_k18_sequence_lines",
    f"""with {READS}, {ALN}, a as (select r.file_id, a.read_id, a.pos > 0 and a.cigar is not null as placed, coalesce(a.mapq, 0) as mapq from reads r join aln a using (read_id))
    select concat_ws(chr(9), coalesce(cast(file_id as varchar), 'Total'), count(*), count(*) filter (placed), count(*) filter (placed and mapq < 20), count(*) filter (not coalesce(placed, false))) as value from a group by grouping sets ((file_id), ())""",
)
def sequence_lines(spark, sf_dir):
    """Reads of each file by what became of them, and the row of all."""
    own = placed(spark, sf_dir).select("read_id", (F.coalesce(F.col("pos") > 0, F.lit(False)) & F.col("cigar").isNotNull()).alias("placed"), F.coalesce("mapq", F.lit(0)).alias("mapq"))
    return K.tabbed(SU.placing_totals(read_table(spark, sf_dir).select("read_id", "file_id").join(own, "read_id")))


_JUDGED = f"""with {BASES}, {MARKERS}, mis as (select b.*, coalesce(base <> 'N' and ref_base <> 'N' and base <> ref_base
  and not exists (select 1 from markers m where m.chrom = b.chrom and m.pos = b.pos), false) as mismatch from bases b where qual is not null)"""


def _judged(spark, sf_dir):
    return B.mismatches(base_table(spark, sf_dir).filter("qual is not null"), marker_table(spark, sf_dir))


@R.query("snk_k12_reported_quality_lines", f"{_JUDGED} select concat_ws(chr(9), qual, count(*) filter (mismatch), count(*), printf('%.6f', round(-10 * log10((count(*) filter (mismatch) + 1) / (count(*) + 2)), 6))) as value from mis group by qual")
def reported_quality_lines(spark, sf_dir):
    own = B.quality_by_reported(_judged(spark, sf_dir)).withColumn("empirical", F.format_string("%.6f", "empirical"))
    return K.tabbed(own, ["qual", "mismatches", "bases", "empirical"])


@R.query(
    "snk_k13_cycle_quality_lines",
    f"""{_JUDGED}, c as (select cycle + 1 as cycle, count(*) filter (mismatch) as mismatches, count(*) as bases from mis group by 1)
    select concat_ws(chr(9), cycle, mismatches, bases, printf('%.6f', round(coalesce(last_value(case when mismatches <> 0 then -10 * log10((mismatches + 1e-6) / (bases + 1e-6)) end ignore nulls) over (order by cycle rows between unbounded preceding and current row), 0), 6)), 0) as value from c""",
)
def cycle_quality_lines(spark, sf_dir):
    """The last column is always 0."""
    own = B.quality_by_cycle(_judged(spark, sf_dir)).withColumns({"empirical": F.format_string("%.6f", "empirical"), "none": F.lit(0)})
    return K.tabbed(own, ["cycle", "mismatches", "bases", "empirical", "none"])


@R.query("snk_k14_adjusted_insert_lines", f"select k || chr(9) || printf('%.9f', density) as value from ({SQL_ADJUSTED})")
def adjusted_insert_lines(spark, sf_dir):
    own = PR.adjusted_insert(pair_table(spark, sf_dir)).withColumn("density", F.format_string("%.9f", "density"))
    return K.tabbed(own, ["k", "density"])


@R.query("snk_k14_raw_insert_lines", f"with {PAIRS}, h as (select obs as k, count(*) as n from pairs where obs between 0 and 4095 group by obs) select g.k || chr(9) || coalesce(h.n, 0) as value from (select unnest(range(4096)) as k) g left join h using (k)")
def raw_insert_lines(spark, sf_dir):
    counts = pair_table(spark, sf_dir).filter("obs between 0 and 4095").groupBy(F.col("obs").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return K.tabbed(B.filled(counts, "k", 4096, ["n"]), ["k", "n"])


_PROFILE = """first_of as (select contig, arg_min(upper(seq), read_id) as s from aln where contig is not null and length(seq) > 0 group by contig),
at_ as (select contig, s, length(s) as n, unnest(range(1, length(s) + 1)) as i from first_of),
profile as (select contig, i, cast(floor(100 * count(*) filter (substr(s, i::int, 1) in ('G', 'C')) over v / count(*) over v) as int) as gc
  from at_ window v as (partition by contig order by i rows between 50 preceding and 49 following))"""


def _profiles(spark, sf_dir):
    """``contig, gc``: the profile of windows of 100 bases along each contig, of its first read, as no contig has its own bases here."""
    rows = placed(spark, sf_dir).filter("contig is not null and length(seq) > 0")
    first = rows.groupBy("contig").agg(F.min_by("seq", "read_id").alias("seq"))
    each = M.gc_window(first, "contig", "seq")
    return each.groupBy("contig").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "gc"))), lambda x: x["gc"]).alias("gc"))


@R.query("snk_k05_gc_vectors", f"with {ALN}, {_PROFILE} select contig, list(gc order by i) as gc from profile group by contig")
def gc_arrays(spark, sf_dir):
    """GC profiles as they are stored in Parquet: written and read back."""
    at = place(spark, "gc")
    _profiles(spark, sf_dir).write.parquet(at)
    return spark.read.parquet(at)


@R.query("src_s24_gc_vectors", f"with {ALN}, {MARKERS}, {_PROFILE}, g as (select contig, list(gc order by i) as gc from profile group by contig) select m.chrom, m.pos, m.name, g.gc[len(g.gc) // 2 + 1] as gc from markers m left join g on g.contig = m.name")
def gc_vectors(spark, sf_dir):
    """Stored profiles joined to the markers by their contig; the value at the middle of each, null without a profile."""
    at = place(spark, "gc")
    _profiles(spark, sf_dir).write.parquet(at)
    stored = spark.read.parquet(at).select(F.col("contig").alias("name"), F.element_at("gc", F.floor(F.size("gc") / 2).cast("int") + 1).alias("gc"))
    return marker_table(spark, sf_dir).join(stored, "name", "left").select("chrom", "pos", "name", "gc")


@R.query(
    "snk_k11_depth_by_gc_lines",
    f"with {BASES}, {DEPTH} select concat_ws(chr(9), (pos::bigint * 7) % 101, cast(sum(depth) as bigint), count(*), printf('%.6f', round(sum(depth) / count(*) / ((select sum(depth) from depth) / (select count(*) from depth)), 6))) as value from depth group by (pos::bigint * 7) % 101",
)
def depth_by_gc_lines(spark, sf_dir):
    depths = SW.depth(segment_table(spark, sf_dir))
    gc = depths.select("chrom", "pos", (F.col("pos").cast("bigint") * 7 % 101).cast("int").alias("gc"))
    own = B.gc_depth(depths, gc).withColumn("normalised", F.format_string("%.6f", "normalised"))
    return K.tabbed(own, ["gc", "depth_sum", "sites", "normalised"])


@R.query("src_s08_plink", f"with g as (select vec_id, {_GT} as g from embeddings) select '1' as chrom, cast(vec_id + 1 as int) as pos, 'v' || vec_id as id, 'A' as first, 'C' as second, g as copies from g")
def plink(spark, sf_dir):
    """Genotypes written as a bed, bim and fam file and read back by ranges of variants."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", genotype_array().alias("copies"))
    rows = e.select(F.lit("1").alias("chrom"), (F.col("vec_id") + 1).cast("int").alias("pos"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), F.lit("A").alias("first"), F.lit("C").alias("second"), "copies")
    at = place(spark, "plink")
    BN.write_plink(rows, at + "/panel")
    return BN.read_plink(spark, at + "/panel")
