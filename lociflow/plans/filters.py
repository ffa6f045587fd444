"""Queries of projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.functions import keys, sequence
from lociflow.operators import bases as B
from lociflow.operators import batches as BT
from lociflow.operators import intervals
from lociflow.operators import kmers as K
from lociflow.operators import markers as M
from lociflow.operators import pairs as PR
from lociflow.operators import selecting as S
from lociflow.plans.aggregates import _GT, genotype_array
from lociflow.plans.domain import ALN, BASES, MARKERS, PAIRS, READS, base_table, marker_table, norm, placed, read_table
from lociflow.plans.registry import Registry
from lociflow.session import table
from lociflow.sources import text as TX

R = Registry()
QUERIES, SQL = R.queries, R.sql
_REFL = "list_sum(list_transform(cigar, lambda c: case when c.op in ('M', 'D', 'N', '=', 'X') then c.len else 0 end))"
_LIST = ", ".join(f"'{c}'" for c in keys.CHROMOSOMES)


@R.query("flt_p01_chrom_whitelist", f"with {ALN} select read_id, {norm('chrom')} as chrom from aln where {norm('chrom')} in ({_LIST})")
def chrom_whitelist(spark, sf_dir):
    own = placed(spark, sf_dir).select("read_id", keys.chrom("chrom").alias("chrom"))
    return own.filter(F.col("chrom").isin(keys.CHROMOSOMES))


def vcf_lines(spark, sf_dir):
    """Candidate sites as VCF text: contigs with a frequency from their number; every ninth has none, every seventh two alternatives."""
    c = table(spark, sf_dir, "contigs").withColumn("m", keys.contig("name")).withColumn("i", F.col("reference_id"))
    alt = F.when(F.col("i") % 7 == 0, F.concat(F.col("m.alt"), F.lit(",T"))).otherwise(F.col("m.alt"))
    info = F.when(F.col("i") % 9 == 0, "DB").otherwise(F.concat(F.lit("DB;AF="), ((F.col("i") % 200) / 200.0).cast("string")))
    cells = [F.col("chrom"), F.col("pos").cast("string"), F.concat(F.lit("rs"), F.col("i").cast("string")), F.col("m.ref"), alt, F.lit("50"), F.lit("PASS"), info]
    body = c.select(F.concat_ws("\t", *cells).alias("value"))
    return spark.createDataFrame([("##fileformat=VCFv4.1",), ("#CHROM\tPOS",)], "value string").unionByName(body)


_VCF = f"""{MARKERS}, vcf as (select c.chrom, c.pos, 'rs' || c.reference_id as id, m.ref, case when reference_id % 7 = 0 then m.alt || ',T' else m.alt end as alt,
  case when reference_id % 9 <> 0 then (reference_id % 200) / 200.0 end as af from contigs c join markers m using (name))"""


@R.query("src_s05_vcf", f"with {_VCF} select chrom, pos, id, ref, alt, af from vcf")
def vcf(spark, sf_dir):
    sites = TX.vcf(vcf_lines(spark, sf_dir))
    return sites.select("chrom", "pos", "id", "ref", "alt", F.try_element_at("info", F.lit("AF")).cast("double").alias("af"))


@R.query("flt_p02_biallelic", f"with {_VCF} select id from vcf where length(ref) = 1 and length(alt) = 1")
def biallelic(spark, sf_dir):
    return TX.vcf(vcf_lines(spark, sf_dir)).filter((F.length("ref") == 1) & (F.length("alt") == 1)).select("id")


@R.query("flt_p03_af_range", f"with {_VCF} select id, {norm('chrom')} as chrom, pos, af from vcf where length(ref) = 1 and length(alt) = 1 and {norm('chrom')} in ({_LIST}) and af between 0.01 and 0.99")
def af_range(spark, sf_dir):
    return M.candidates(TX.vcf(vcf_lines(spark, sf_dir))).select("id", "chrom", "pos", "af")


@R.query("src_s06_vcf_section", f"with {_VCF} select id, pos from vcf where chrom = '10' and pos < 90000000 and pos + length(ref) - 1 >= 20000000")
def vcf_section(spark, sf_dir):
    return TX.vcf_section(TX.vcf(vcf_lines(spark, sf_dir)), "10", 20_000_000, 90_000_000, overlap=True).select("id", "pos")


@R.query("flt_p04_chrom_norm", f"select distinct chrom, {norm('chrom')} as normal from alignments")
def chrom_norm(spark, sf_dir):
    return table(spark, sf_dir, "alignments").select("chrom").distinct().withColumn("normal", keys.chrom("chrom"))


@R.query(
    "flt_p05_spaced_markers",
    f"with {MARKERS}, s as (select *, pos - lag(pos) over w >= flank + lag(flank) over w as l, lead(pos) over w - pos >= flank + lead(flank) over w as r from markers window w as (partition by chrom order by pos, name)) select name, chrom, pos from s where coalesce(l, true) and coalesce(r, true)",
)
def spaced_markers(spark, sf_dir):
    return M.well_spaced(marker_table(spark, sf_dir)).select("name", "chrom", "pos")


@R.query(
    "flt_p05_greedy_markers",
    f"""with recursive {MARKERS}, o as (select *, row_number() over (partition by chrom order by pos, name) as k from markers),
    g as (select chrom, name, pos, flank, k, true as kept, pos as lp, flank as lf from o where k = 1
      union all select o.chrom, o.name, o.pos, o.flank, o.k, o.pos - g.lp >= g.lf + o.flank, case when o.pos - g.lp >= g.lf + o.flank then o.pos else g.lp end,
        case when o.pos - g.lp >= g.lf + o.flank then o.flank else g.lf end from g join o on o.chrom = g.chrom and o.k = g.k + 1)
    select name, chrom, pos from g where kept""",
)
def greedy_markers(spark, sf_dir):
    return M.greedy_spaced(marker_table(spark, sf_dir)).select("name", "chrom", "pos")


@R.query("flt_p07_callable_letters", f"with {READS}, m as (select read_id, translate(upper(seq), 'ACGT.', 'PPPPN') as mask from reads where length(seq) > 0) select read_id, length(mask) - length(replace(mask, 'P', '')) as callable, length(mask) - length(replace(mask, 'P', '')) >= 0.995 * length(mask) as ok from m")
def callable_letters(spark, sf_dir):
    """The letters P of a mask, here of known bases, over its length."""
    masks = read_table(spark, sf_dir).filter("length(seq) > 0").select("read_id", F.translate(F.upper("seq"), "ACGT.", "PPPPN").alias("mask"))
    return M.callable_mask(masks, "mask").select("read_id", F.col("callable").cast("bigint").alias("callable"), "ok")


_MASKS = ", ".join(f"substr(kmer, {1 + 8 * a}, 8) || substr(kmer, {1 + 8 * b}, 8)" for a, b in K.MASKS)
_NUM = "list_sum(list_transform(range(16), lambda j: (case substr(key, j + 1, 1) when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end)::hugeint * (4::hugeint ** (15 - j))))"
_KEYS = f"""{ALN}, panel as (select distinct upper(seq) as p from aln where mapq >= 55 and mapq < 255 and seq is not null), both_ as (select p from panel union select translate(reverse(p), 'ACGT', 'TGCA') from panel),
pk as (select distinct kmer from (select substr(p, i, 32) as kmer from (select p, unnest(range(1, length(p) - 30)) as i from both_ where length(p) >= 32)) where regexp_full_match(kmer, '[ACGT]+')),
held as (select distinct unnest(range(6)) as mask, unnest([{_MASKS}]) as key from pk),
{READS}, rk as (select read_id, o as chunk, substr(upper(seq), o + 1, 32) as kmer from (select read_id, seq, unnest([0, 32, 64]) as o from reads)),
rm as (select read_id, chunk, unnest(range(6)) as mask, regexp_replace(unnest([{_MASKS}]), '[^ACGT]', 'A', 'g') as key from rk where length(kmer) = 32),
hit as (select read_id, chunk, count(*) as n from rm join held using (mask, key) group by 1, 2)"""


def _panel(spark, sf_dir):
    return K.panel_table(placed(spark, sf_dir).filter("mapq >= 55 and mapq < 255"), "seq")


@R.query("flt_p08_kmer_filter", f"with {_KEYS} select r.read_id, cast(coalesce(sum(n), 0) as bigint) as hits, coalesce(sum(n), 0) >= 3 as kept from reads r left join hit using (read_id) group by r.read_id")
def kmer_filter(spark, sf_dir):
    return K.filter_reads(read_table(spark, sf_dir), "read_id", "seq", _panel(spark, sf_dir))


@R.query("flt_p09_kmer_any_chunk", f"with {_KEYS} select r.read_id, cast(coalesce(max(n), 0) as bigint) as hits from reads r left join hit using (read_id) group by r.read_id")
def kmer_any_chunk(spark, sf_dir):
    return K.shared_keys(read_table(spark, sf_dir), "read_id", "seq", _panel(spark, sf_dir), any_chunk=True)


@R.query("join_j09_shared_kmers", f"with {_KEYS} select read_id, chunk, n from hit")
def shared_kmers(spark, sf_dir):
    return K.hits(read_table(spark, sf_dir), "read_id", "seq", _panel(spark, sf_dir)).withColumnRenamed("_id", "read_id")


_BARCODE = 8
_CUT_READS = READS.replace("reads as", "whole as", 1) + f""", reads as (select read_id, file_id, mate, read_idx, name, substr(seq, {_BARCODE + 1}) as seq, substr(qual, {_BARCODE + 1}) as qual, list_aggregate([case when ascii(substr(qual, i::int, 1)) - 33 < 13 then lower(substr(seq, i::int, 1)) else substr(seq, i::int, 1) end for i in range(1, least({_BARCODE}, length(seq)) + 1)], 'string_agg', '') as barcode
  from whole where seq is not null and qual is not null and length(seq) = length(qual))"""
_BATCH = f"""with recursive {_KEYS.replace(READS, _CUT_READS)}, th as (select read_id, cast(coalesce(sum(n), 0) as bigint) as hits from reads left join hit using (read_id) group by 1),
{{trim}}, cuts as (select read_id, min_by(cut, l) as kept from t group by read_id),
batch as (select r.*, hits, hits < 3 as filtered, case when hits < 3 then length(seq) else kept end as kept
  from reads r join th using (read_id) join cuts using (read_id))"""


def _batch(spark, sf_dir):
    return BT.read_batch(read_table(spark, sf_dir), _panel(spark, sf_dir), 3, 15, _BARCODE)


def _batch_sql() -> str:
    body = _TRIM[_TRIM.index("q as (") : _TRIM.rindex("select read_id, cast(min_by")].rstrip()
    return _BATCH.format(trim=body)


@R.query("flt_p10_downsample")
def downsample(spark, sf_dir):
    return S.downsampled(read_table(spark, sf_dir), "name", 0.25, 7).select("read_id", "file_id", "mate", "read_idx")


@R.query("flt_p10_mates_together", "select true as together")
def mates_together(spark, sf_dir):
    """Does down-sampling keep or drop both mates with one name?"""
    reads = read_table(spark, sf_dir).filter("name is not null").withColumn("name", F.lower(keys.read_name(F.substring_index("name", " ", 1))))
    kept = S.downsampled(reads, "name", 0.25, 7).select("read_id").withColumn("kept", F.lit(True))
    by = reads.join(kept, "read_id", "left").groupBy("name").agg(F.count_distinct(F.coalesce("kept", F.lit(False))).alias("n"))
    return by.agg((F.max("n") == 1).alias("together"))


_TRIM = """with recursive {reads}, q as (select read_id, length(qual) as n, qual from reads where qual is not null),
t as (select read_id, qual, n, n - 1 as l, 0 as s, 0 as best, n as cut, n > 35 as on_ from q
  union all select read_id, qual, n, l - 1, s + 15 - (ascii(substr(qual, l + 1, 1)) - 33),
    case when s + 15 - (ascii(substr(qual, l + 1, 1)) - 33) > best then s + 15 - (ascii(substr(qual, l + 1, 1)) - 33) else best end,
    case when s + 15 - (ascii(substr(qual, l + 1, 1)) - 33) > best then l else cut end,
    s + 15 - (ascii(substr(qual, l + 1, 1)) - 33) >= 0 and l - 1 >= 35 from t where on_)
select read_id, cast(min_by(cut, l) as int) as kept from t group by read_id""".format(reads=READS)


@R.query("flt_p11_quality_trim", _TRIM)
def quality_trim(spark, sf_dir):
    return read_table(spark, sf_dir).filter("qual is not null").select("read_id", sequence.trimmed_length("qual").alias("kept"))


@R.query("src_s02_filtered_batches", _batch_sql() + " select read_id, hits, filtered, cast(kept as int) as kept, barcode, substr(seq, 1, cast(kept as int)) as seq from batch")
def filtered_batches(spark, sf_dir):
    """Barcode, filter and trimming of every read in one plan; nothing is sampled out."""
    return _batch(spark, sf_dir).select("read_id", "hits", "filtered", F.length("seq").alias("kept"), "barcode", "seq")


@R.query("src_s03_paired_batches", _batch_sql() + " select file_id, read_idx, count(*) as mates, count(*) filter (not filtered) = 2 as both, cast(sum(kept) as bigint) as bases from batch group by 1, 2 having count(*) filter (not filtered) > 0")
def paired_batches(spark, sf_dir):
    return BT.read_pairs(_batch(spark, sf_dir))


@R.query(
    "flt_p12_barcode",
    f"with {READS} select read_id, list_aggregate([case when ascii(substr(qual, i::int, 1)) - 33 < 13 then lower(substr(seq, i::int, 1)) else substr(seq, i::int, 1) end for i in range(1, least(8, length(seq)) + 1)], 'string_agg', '') as barcode from reads where seq is not null and length(qual) = length(seq)",
)
def barcode(spark, sf_dir):
    reads = read_table(spark, sf_dir).filter("seq is not null and length(qual) = length(seq)")
    return reads.select("read_id", sequence.barcode("seq", "qual").alias("barcode"))


@R.query("flt_p13_confident", f"with {ALN} select read_id, mapq from aln where flag & 4 = 0 and mapq between 20 and 254")
def confident(spark, sf_dir):
    return S.confident(placed(spark, sf_dir)).select("read_id", "mapq")


@R.query("flt_p14_confident_pairs", f"with {PAIRS} select file_id, read_idx from good where coalesce(m1.placed and m1.mapq > 20, false) and coalesce(m2.placed and m2.mapq > 20, false)")
def confident_pairs(spark, sf_dir):
    reads = table(spark, sf_dir, "fastq_reads").select("read_id", "read_idx").distinct()
    pairs = PR.pair_status(PR.aligned_pairs(placed(spark, sf_dir), reads, marker_table(spark, sf_dir)), least_mapq=20)
    return pairs.filter("status in ('PropPair', 'PartialPair', 'NotPair')").select("file_id", "read_idx")




@R.query("flt_p15_bridging", f"with {MARKERS}, {ALN} select a.read_id, a.pos < m.pos - m.flank or a.pos + {_REFL} - 1 > m.pos + m.flank as bridging from aln a join markers m on m.name = a.contig")
def bridging(spark, sf_dir):
    return S.bridging(placed(spark, sf_dir), marker_table(spark, sf_dir)).select("read_id", "bridging")


@R.query("flt_p16_flag_masks", "select distinct rec_id, flag from sam_records where flag & 3 = 3 and flag & 1540 = 0")
def flag_masks(spark, sf_dir):
    return S.flagged(table(spark, sf_dir, "sam_records"), 3, 1540).select("rec_id", "flag").distinct()


@R.query("flt_p17_pileup_reads", f"with {MARKERS}, {ALN} select read_id, least(mapq, 40) as mapq from aln where flag & 1796 = 0 and pos > 0 and mapq >= 13 and exists (select 1 from markers m where m.chrom = {norm('aln.chrom')} and aln.pos <= m.pos and aln.pos + {_REFL} - 1 >= m.pos)")
def pileup_reads(spark, sf_dir):
    """Reads for a pileup that overlap a marker."""
    reads = S.pileup_reads(placed(spark, sf_dir)).select("read_id", "mapq", keys.chrom("chrom").alias("chrom"), F.col("pos").alias("beg"), (F.col("pos") + sequence.reference_length("cigar") - 1).alias("end"))
    points = marker_table(spark, sf_dir).select("chrom", F.col("pos").alias("beg"), F.col("pos").alias("end")).distinct()
    return intervals.overlapping(reads, points).select("read_id", "mapq")


@R.query("flt_p18_base_quality", f"with {BASES} select read_id, count(*) as bases from bases where qual >= 2 group by read_id")
def base_quality(spark, sf_dir):
    return base_table(spark, sf_dir).filter("qual >= 2").groupBy("read_id").agg(F.count(F.lit(1)).alias("bases"))


@R.query(
    "flt_p19_bases_in_flanks",
    f"with {MARKERS}, {BASES} select b.read_id, count(*) as bases from bases b where exists (select 1 from markers m where m.chrom = b.chrom and b.pos between m.pos - m.flank and m.pos + m.flank) group by b.read_id",
)
def bases_in_flanks(spark, sf_dir):
    regions = intervals.collapse(M.flanks(marker_table(spark, sf_dir)))
    return intervals.in_regions(base_table(spark, sf_dir), regions).groupBy("read_id").agg(F.count(F.lit(1)).alias("bases"))


_KNOWN = "not exists (select 1 from markers m where m.chrom = b.chrom and m.pos = b.pos)"


@R.query(
    "flt_p20_mismatches",
    f"with {MARKERS}, {BASES}, j as (select b.*, coalesce(base <> 'N' and ref_base <> 'N' and base <> ref_base and {_KNOWN}, false) as mismatch from bases b where qual is not null) select read_id, count(*) as bases, count(*) filter (mismatch) as mismatches, cast(coalesce(sum(qual) filter (mismatch and qual >= 0), 0) as bigint) as quality_sum from j group by read_id",
)
def mismatches(spark, sf_dir):
    """Mismatches of each read away from known sites."""
    return S.mismatch_share(B.mismatches(base_table(spark, sf_dir).filter("qual is not null"), marker_table(spark, sf_dir)))


_RULES = f"""with g as (select vec_id, label, {_GT} as g from embeddings), v as (select vec_id, g, case when label = 3 then 'LOW' else 'PASS' end as filter, case when vec_id % 11 = 0 then 'C,T' else 'C' end as alt, vec_id % 7 <> 0 as phased from g)
select vec_id from v where filter = 'PASS' and phased and not contains(alt, ',') and not list_contains(g, -1) and list_sum(g) >= 40 and least(list_sum(g), 2 * len(g) - list_sum(g)) >= 45"""


def variant_rows(spark, sf_dir):
    """Variants with a filter, alternatives and genotype text: every seventh has a genotype that is not phased, every eleventh two alternatives."""
    bar = F.when(F.col("vec_id") % 7 == 0, "/").otherwise("|")
    text = F.transform(genotype_array(), lambda g: F.when(g < 0, ".").when(g == 0, F.concat(F.lit("0"), bar, F.lit("0"))).when(g == 1, F.concat(F.lit("0"), bar, F.lit("1"))).otherwise(F.concat(F.lit("1"), bar, F.lit("1"))))
    status = F.when(F.col("label") == 3, "LOW").otherwise("PASS")
    alt = F.when(F.col("vec_id") % 11 == 0, "C,T").otherwise("C")
    return table(spark, sf_dir, "embeddings").select("vec_id", status.alias("filter"), alt.alias("alt"), text.alias("gt"))


@R.query("flt_p21_discard_rules", _RULES)
def discard_rules(spark, sf_dir):
    return S.kept_variants(variant_rows(spark, sf_dir), 40, 45).select("vec_id")


@R.query("flt_p22_id_lists", "select distinct rec_id from sam_records where reference_id in (select reference_id from contigs where chrom = '10') and file_id not in (select file_id from fastq_list where path2 is null)")
def id_lists(spark, sf_dir):
    wanted = table(spark, sf_dir, "contigs").filter("chrom = '10'")
    single = table(spark, sf_dir, "fastq_list").filter("path2 is null")
    own = S.listed(table(spark, sf_dir, "sam_records"), wanted, "reference_id")
    return S.listed(own, single, "file_id", keep=False).select("rec_id").distinct()


@R.query("flt_p23_sample_subset", f"with g as (select vec_id, list_filter({_GT}, lambda x, i: i % 4 = 1) as g from embeddings) select vec_id, cast(list_sum(g) as int) as total from g")
def sample_subset(spark, sf_dir):
    own = F.filter(genotype_array(), lambda x, i: i % 4 == 0)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(own, F.lit(0), lambda a, x: a + x).alias("total"))


@R.query("flt_p24_panel_filter", f"with {MARKERS}, s as (select *, lag(pos) over (partition by chrom order by pos, name) as b from markers) select name, chrom, pos, coalesce(b = pos, false) as repeated from s where chrom in ({', '.join(repr(c) for c in keys.AUTOSOMES)}) and length(ref) = 1 and length(alt) = 1")
def panel_filter(spark, sf_dir):
    marks = marker_table(spark, sf_dir)
    again = S.consecutive_duplicates(marks).select("name").withColumn("repeated", F.lit(True))
    own = marks.filter(F.col("chrom").isin(keys.AUTOSOMES) & (F.length("ref") == 1) & (F.length("alt") == 1))
    return own.join(again, "name", "left").select("name", "chrom", "pos", F.coalesce("repeated", F.lit(False)).alias("repeated"))


@R.query("flt_p27_clipped", f"with {ALN} select read_id from aln where len(list_filter(cigar, lambda c: c.op in ('S', 'H'))) > 0")
def clipped(spark, sf_dir):
    return placed(spark, sf_dir).filter(sequence.is_clipped("cigar")).select("read_id")


@R.query("flt_p28_unknown_bases", f"with {READS}, n as (select read_id, length(seq) - length(replace(replace(upper(seq), 'N', ''), '.', '')) as unknown, length(seq) as len from reads where seq is not null) select read_id, unknown, unknown >= 0.25 * len as rejected from n")
def unknown_bases(spark, sf_dir):
    return S.many_unknown(read_table(spark, sf_dir).filter("seq is not null"), "seq").select("read_id", F.col("unknown").cast("bigint").alias("unknown"), "rejected")


_MISQ = f"with {BASES}, j as (select b.*, base <> ref_base and base <> 'N' as mismatch from bases b where qual is not null)"


@R.query("flt_p29_quality_sum", f"{_MISQ} select read_id, cast(sum(qual) filter (mismatch) as bigint) as quality_sum from j group by read_id having sum(qual) filter (mismatch) > 60")
def quality_sum(spark, sf_dir):
    """Reads whose summed quality under mismatches is too great."""
    return S.mismatch_share(base_table(spark, sf_dir).filter("qual is not null"), -99).filter("quality_sum > 60").select("read_id", "quality_sum")


@R.query("flt_p29_clip_mismatches")
def clip_mismatches(spark, sf_dir):
    """Bases that are clipped from both ends of reads with too many mismatches there."""
    clips = S.clipped_ends(placed(spark, sf_dir).filter("cigar is not null and seq is not null"), 0.25)
    return clips.filter("clip_begin + clip_end > 0").select("read_id", "clip_begin", "clip_end")


_CHECKS = """list_filter([case when flag is null or flag not between 0 and 4095 then 'flag' end, case when (flag & 64 <> 0) = (flag & 128 <> 0) then 'both_ends' end,
  case when reference_id is null or reference_id < -1 then 'reference' end, case when pos is null or pos < 0 or (flag & 4 = 0 and pos = 0) then 'position' end,
  case when mapq is null or mapq not between 0 and 255 then 'mapq' end, case when insert_size is null or abs(insert_size::bigint) > 536870912 then 'insert_size' end,
  case when flag & 2 <> 0 and flag & 1 = 0 then 'unpaired_proper' end], lambda x: x is not null)"""


@R.query("flt_p30_record_problems", f"with p as (select rec_id, loaded_at, {_CHECKS} as problems from sam_records) select rec_id, problems from p where len(problems) > 0")
def record_problems(spark, sf_dir):
    return S.problems(table(spark, sf_dir, "sam_records")).filter(F.size("problems") > 0).select("rec_id", "problems")


_LINE_CHECKS = r"""list_filter([case when name is null or not regexp_full_match(name, '[!-?A-~]{1,254}') then 'name' end,
  case when flag & 4 = 0 and (cigar is null or len(cigar) = 0) then 'cigar_missing' end,
  case when len(list_filter(cigar, lambda c: c.len < 1 or c.op not in ('M', 'I', 'D', 'N', 'S', 'H', 'P', '=', 'X'))) > 0 then 'cigar_operation' end,
  case when len(list_filter(cigar, lambda c, i: c.op = 'H' and i > 1 and i < len(cigar))) > 0 then 'cigar_hard_clip' end,
  case when seq is not null and coalesce(list_sum(list_transform(cigar, lambda c: case when c.op in ('M', 'I', 'S', '=', 'X') then c.len else 0 end)), length(seq)) <> length(seq) then 'cigar_length' end,
  case when qual is not null and (length(qual) <> coalesce(length(seq), 0) or not regexp_full_match(qual, '[!-~]*')) then 'qual' end,
  case when md is not null and not regexp_full_match(md, '[0-9]+(([A-Z]|\^[A-Z]+)[0-9]+)*') then 'tag_md' end], lambda x: x is not null)"""


@R.query("flt_p30_line_problems", f"with {ALN}, {READS}, a as (select aln.*, split_part(r.name, ' ', 1) as name from aln left join reads r using (read_id)), p as (select read_id, {_LINE_CHECKS.replace(chr(92) * 2, chr(92))} as problems from a) select read_id, problems from p where len(problems) > 0")
def line_problems(spark, sf_dir):
    """Checks of the variable-length fields of a record: name, edit script, qualities and tags."""
    names = read_table(spark, sf_dir).select("read_id", F.substring_index("name", " ", 1).alias("name"))
    return S.line_problems(placed(spark, sf_dir).join(names, "read_id", "left")).filter(F.size("problems") > 0).select("read_id", "problems")
