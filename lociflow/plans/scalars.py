"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociflow.functions import keys, numeric, sequence, sql
from lociflow.operators import bases as B
from lociflow.operators import kmers as K
from lociflow.plans.domain import ALN, BASES, BLOCKS, MARKERS, MISMATCHES, READS, marker_table, norm, placed, read_table
from lociflow.plans.registry import Registry
from lociflow.session import table

R = Registry()
QUERIES, SQL = R.queries, R.sql
_RC = "translate(reverse({0}), 'ACGTacgt', 'TGCAtgca')"


@R.query("fn_f01_chrom", f"select reference_id, {norm('chrom')} as chrom from contigs")
def chrom(spark, sf_dir):
    return table(spark, sf_dir, "contigs").select("reference_id", keys.chrom("chrom").alias("chrom"))


@R.query("fn_f02_reverse_complement", f"with {READS} select read_id, {_RC.format('seq')} as rc from reads where seq is not null")
def reverse_complement(spark, sf_dir):
    return read_table(spark, sf_dir).filter("seq is not null").select("read_id", sequence.reverse_complement("seq").alias("rc"))


@R.query("fn_f03_sequencing_order", f"with {ALN} select read_id, case when strand then {_RC.format('seq')} else seq end as seq, case when strand then reverse(qual) else qual end as qual from aln")
def sequencing_order(spark, sf_dir):
    qual = F.when(F.col("strand"), F.reverse("qual")).otherwise(F.col("qual"))
    return placed(spark, sf_dir).select("read_id", sequence.sequencing_order("seq", "strand").alias("seq"), qual.alias("qual"))


_CIG = "list_aggregate(list_transform(cigar, lambda c: c.len || c.op), 'string_agg', '')"


@R.query("fn_f04_parse_cigar", f"with {ALN} select read_id, list_sum(list_transform(cigar, lambda c: c.len)) ::bigint as total, len(cigar) as ops from aln where cigar is not null")
def parse_cigar(spark, sf_dir):
    text = placed(spark, sf_dir).filter("cigar is not null").select("read_id", sequence.render_cigar("cigar", "seq").alias("c"))
    parsed = text.withColumn("p", sequence.parse_cigar("c"))
    return parsed.select("read_id", F.aggregate("p", F.lit(0).cast("bigint"), lambda a, c: a + c["len"]).alias("total"), F.size("p").cast("bigint").alias("ops"))


@R.query("fn_f05_render_cigar", f"with {ALN} select read_id, case when len(cigar) > 0 then {_CIG} else length(seq) || 'M' end as cigar from aln where seq is not null")
def render_cigar(spark, sf_dir):
    return placed(spark, sf_dir).filter("seq is not null").select("read_id", sequence.render_cigar("cigar", "seq").alias("cigar"))


@R.query(
    "fn_f06_reference_bases",
    f"""with {BASES}, mpart as (select read_id, ref_base as t, pos - (select a.pos from aln a where a.read_id = b.read_id) as off, 0 as j from bases b),
    del as (select m.read_id, substr(m.x, 2) as t, m.off, 0 as j from mdo m join blk on blk.read_id = m.read_id and blk.op = 'D' and blk.ref_off = m.off where m.x[1] = '^')
    select read_id, string_agg(t, '' order by off, j) as ref from (select * from mpart union all select * from del) group by read_id""",
)
def reference_bases(spark, sf_dir):
    own = placed(spark, sf_dir).filter("cigar is not null and pos is not null and seq is not null and chrom is not null and md is not null")
    return own.select("read_id", sequence.reference_bases("seq", "md", "cigar").alias("ref"))


@R.query(
    "fn_f07_mismatch_script",
    f"""with {BASES}, ev as (select b.read_id, b.pos - a.pos as off, 1 as w, ref_base as t from bases b join aln a using (read_id) where b.base <> b.ref_base union all
      select m.read_id, m.off, length(m.x) - 1, m.x from mdo m join blk on blk.read_id = m.read_id and blk.op = 'D' and blk.ref_off = m.off where m.x[1] = '^'),
    o as (select *, off - coalesce(lag(off + w) over (partition by read_id order by off), 0) as run from ev), n as (select read_id, max(ref_off + case when op in ('M', 'D', '=', 'X') then len else 0 end) as refl from blk group by 1),
    g as (select read_id, string_agg(run || t, '' order by off) as t, max(off + w) as upto from o group by 1)
    select a.read_id, coalesce(g.t, '') || cast(n.refl - coalesce(g.upto, 0) as bigint) as md from aln a join n using (read_id) left join g using (read_id) where md is not null""",
)
def mismatch_script(spark, sf_dir):
    """The MD text written anew from the read, the reference bases under it and the edit script."""
    own = placed(spark, sf_dir).filter("cigar is not null and pos is not null and seq is not null and chrom is not null and md is not null")
    with_ref = own.select("read_id", "seq", "cigar", sequence.reference_bases("seq", "md", "cigar").alias("ref"))
    return B.mismatch_scripts(with_ref)


@R.query(
    "fn_f07_edit_distance",
    f"with {ALN}, {MISMATCHES}, n as (select read_id, count(*) as n from mm group by 1) select a.read_id, cast(coalesce(n.n, 0) + list_sum(list_transform(cigar, lambda c: case when c.op in ('I', 'D') then c.len else 0 end)) as int) as nm from aln a left join n using (read_id) where cigar is not null and md is not null",
)
def edit_distance(spark, sf_dir):
    return placed(spark, sf_dir).filter("cigar is not null and md is not null").select("read_id", sequence.edit_distance_of("md", "cigar").alias("nm"))


@R.query("fn_f08_reference_end", f"with {ALN} select read_id, cast(pos + list_sum(list_transform(cigar, lambda c: case when c.op in ('M', 'D', 'N', '=', 'X') then c.len else 0 end)) - 1 as int) as end_pos from aln where cigar is not null and pos is not null")
def reference_end(spark, sf_dir):
    return placed(spark, sf_dir).filter("cigar is not null and pos is not null").select("read_id", (F.col("pos") + sequence.reference_length("cigar") - 1).alias("end_pos"))


@R.query("fn_f09_split_keeping_empties", "select line_id, len(string_split(raw_line, ',')) as cells from read_lines where raw_line is not null")
def split_keeping_empties(spark, sf_dir):
    return table(spark, sf_dir, "read_lines").filter("raw_line is not null").select("line_id", F.size(F.split("raw_line", ",", -1)).cast("bigint").alias("cells"))


@R.query("fn_f10_contig_decode", f"with {MARKERS} select name, chrom, pos, ref, alt, class from markers")
def contig_decode(spark, sf_dir):
    return table(spark, sf_dir, "contigs").select("name", keys.contig("name").alias("m")).select("name", "m.chrom", "m.pos", "m.ref", "m.alt", "m.class")


@R.query("fn_f11_read_name", r"select distinct name, case when length(name) > 2 then regexp_replace(name, '[/\\][12]$', '') else name end as plain from fastq_reads where name is not null")
def read_name(spark, sf_dir):
    return table(spark, sf_dir, "fastq_reads").filter("name is not null").select("name").distinct().withColumn("plain", keys.read_name("name"))


@R.query("fn_f12_basename", r"select file_id, regexp_extract(path1, '[^/\\]*$') as base from fastq_list")
def basename(spark, sf_dir):
    return table(spark, sf_dir, "fastq_list").select("file_id", keys.basename("path1").alias("base"))


_PILED = """piled as (select read_id, case when strand then ',' else '.' end as same, upper(seq) as s, mapq, length(seq) as n from aln where length(seq) > 0)"""


@R.query("fn_f13_pileup_cleanup", f"with {ALN}, {_PILED} select read_id, substr(s, 1, 5) || 'GGG' || substr(s, 6) as bases from piled")
def pileup_cleanup(spark, sf_dir):
    """Pileup texts of all alignments: a read start with its quality, bases, the reference marks, indels of one and two digits, an end."""
    own = placed(spark, sf_dir).filter("length(seq) > 0")
    up, mark = F.upper("seq"), F.when(F.col("strand"), ",").otherwise(".")
    quality = F.char(F.least(F.coalesce("mapq", F.lit(0)), F.lit(93)) + 33)
    rest = lambda n: F.substr(up, F.lit(n), F.length("seq"))
    text = F.concat(F.lit("^"), quality, F.substr(up, F.lit(1), F.lit(5)), F.lit("+2AC"), F.repeat(mark, F.lit(3)), F.lit("-12ACGTNacgtnAC"), rest(6), F.lit("$"))
    return own.select("read_id", sequence.pileup_cleanup(text, F.lit("g")).alias("bases"))


@R.query("fn_f14_unescape", r"select line_id, replace(raw_line, '\t', chr(9)) as line from read_lines where raw_line is not null")
def unescape(spark, sf_dir):
    return table(spark, sf_dir, "read_lines").filter("raw_line is not null").select("line_id", keys.unescaped("raw_line").alias("line"))


_COUNT = ", ".join(f"length(seq) - length(replace(upper(seq), '{b}', '')) as {b.lower()}" for b in "ACGT")


@R.query("fn_f15_base_counts", f"with {READS}, n as (select read_id, {_COUNT} from reads where seq is not null) select *, greatest(a, c, g, t) as most from n")
def base_counts(spark, sf_dir):
    counts = [sequence.count_of("seq", b).cast("bigint").alias(b.lower()) for b in "ACGT"]
    return read_table(spark, sf_dir).filter("seq is not null").select("read_id", *counts).withColumn("most", F.greatest("a", "c", "g", "t"))


@R.query("fn_f16_clip_ends", f"with {ALN} select read_id, cast(case when len(cigar) > 0 and cigar[1].op = 'S' then cigar[1].len else 0 end as int) as clip_begin, cast(case when len(cigar) > 1 and cigar[-1].op = 'S' then cigar[-1].len else 0 end as int) as clip_end from aln where cigar is not null")
def clip_ends(spark, sf_dir):
    return placed(spark, sf_dir).filter("cigar is not null").select("read_id", sequence.clip_at("cigar", False).alias("clip_begin"), sequence.clip_at("cigar", True).alias("clip_end"))


_CLIP = """c as (select read_id, k, op, len, read_off, ref_off, n, greatest(5, cb) as lo, n - greatest(7, ce) as hi from blk join
  (select read_id, length(seq) as n, case when cigar[1].op = 'S' then cigar[1].len else 0 end as cb, case when len(cigar) > 1 and cigar[-1].op = 'S' then cigar[-1].len else 0 end as ce from aln) using (read_id)),
k as (select *, case when op in ('M', 'I', '=', 'X') then greatest(0, least(read_off + len, hi) - greatest(read_off, lo)) when op in ('D', 'N') and read_off > lo and read_off < hi then len else 0 end as left_ from c)"""


@R.query(
    "fn_f16_soft_clip",
    f"""with {ALN}, {BLOCKS}, {_CLIP} select read_id, case when any_value(lo) < any_value(hi) then any_value(lo) || 'S' || string_agg(left_ || op, '' order by k) filter (left_ > 0) || (any_value(n) - any_value(hi)) || 'S' else any_value(n) || 'S' end as cigar,
    cast(coalesce(min(case when left_ > 0 and op in ('M', '=', 'X', 'D', 'N') then ref_off + case when op in ('D', 'N') then 0 else greatest(0, lo - read_off) end end), 0) as int) as shift from k group by read_id""",
)
def soft_clip(spark, sf_dir):
    """Five bases clipped from the begin and seven from the end of every placed read."""
    own = placed(spark, sf_dir).filter("pos is not null and cigar is not null and seq is not null and chrom is not null")
    clipped = own.select("read_id", "seq", sequence.soft_clipped("cigar", 5, 7).alias("c"))
    return clipped.select("read_id", sequence.render_cigar("c.cigar", "seq").alias("cigar"), "c.shift")


@R.query("fn_f17_day_text", "select distinct rec_id, strftime(recorded_at, '%Y%m%d') as day from sam_records")
def day_text(spark, sf_dir):
    return table(spark, sf_dir, "sam_records").select("rec_id", F.date_format("recorded_at", "yyyyMMdd").alias("day")).distinct()


@R.query("fn_f18_phred", "select distinct mapq, round(pow(10.0, -mapq / 10.0), 9) as p, round(-10 * log10(pow(10.0, -mapq / 10.0)), 6) as q from alignments where mapq is not null")
def phred(spark, sf_dir):
    p = numeric.probability(F.col("mapq"))
    return table(spark, sf_dir, "alignments").filter("mapq is not null").select("mapq").distinct().select("mapq", F.round(p, 9).alias("p"), F.round(numeric.phred(p), 6).alias("q"))


@R.query("fn_f19_logit", "select event_id, round(ln(p / (1 - p)), 6) as logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) as back from (select event_id, (value + 1) / 500 as p from events)")
def logit(spark, sf_dir):
    p = (F.col("value") + 1) / 500
    return table(spark, sf_dir, "events").select("event_id", F.round(numeric.logit(p), 6).alias("logit"), F.round(numeric.inverse_logit(numeric.logit(p)), 6).alias("back"))


@R.query("fn_f20_hardy_weinberg", "select event_id, round((1 - p) * (1 - p), 9) as hom_ref, round(2 * p * (1 - p), 9) as het, round(p * p, 9) as hom_alt from (select event_id, greatest(0.00005, least(0.99995, value / 400 - 0.1)) as p from events)")
def hardy_weinberg(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", numeric.hardy_weinberg(F.col("value") / 400 - 0.1).alias("f"))
    return own.select("event_id", *[F.round(F.col("f").getItem(i), 9).alias(n) for i, n in enumerate(("hom_ref", "het", "hom_alt"))])


_GRID = "(select unnest(['ref', 'alt', 'other']) as kind), (select unnest([0, 1, 2]) as g), (select unnest([true, false]) as e)"


@R.query(
    "fn_f21_base_given_genotype",
    f"""select kind, g, e, round(case when e then (case kind when 'ref' then (case g when 0 then 0 when 1 then 1 / 6.0::double else 1 / 3.0::double end) when 'alt' then (case g when 0 then 1 / 3.0::double when 1 then 1 / 6.0::double else 0 end) else 2 / 3.0::double end)
    else (case kind when 'ref' then 1 - g / 2.0::double when 'alt' then g / 2.0::double else 0 end) end, 9) as p from {_GRID}""",
)
def base_given_genotype(spark, sf_dir):
    rows = spark.createDataFrame([(k, g, e) for k in ("ref", "alt", "other") for g in range(3) for e in (True, False)], "kind string, g int, e boolean")
    return rows.select("kind", "g", "e", F.round(numeric.base_given_genotype(F.col("g"), F.col("kind"), F.col("e")), 9).alias("p"))


_POISSON = """with recursive l as (select distinct length(seq) as len from fastq_reads where seq is not null), t as (select len, 0 as k, exp(-0.02 * len) as term, exp(-0.02 * len) as total from l
  union all select len, k + 1, term * 0.02 * len / (k + 1), total + term * 0.02 * len / (k + 1) from t where k < 60) select cast(len as int) as len, cast(min(k) as int) as most from t where k > 0 and 1 - total < 0.04 group by len"""


@R.query("fn_f23_most_differences", _POISSON)
def most_differences(spark, sf_dir):
    lengths = table(spark, sf_dir, "fastq_reads").filter("seq is not null").select(F.length("seq").alias("len")).distinct()
    return lengths.select("len", numeric.difference_limit(F.col("len")).alias("most"))


@R.query("fn_f24_single_end_mapq", f"with {ALN} select read_id, cast(case when c1 = 0 then 23 when c1 > 1 then 0 when score = 12 then 25 when c2 = 0 then 37 else greatest(0, 23 - cast(floor(4.343 * ln(least(c2, 255)) + 0.5) as int)) end as int) as q from aln where score is not null")
def single_end_mapq(spark, sf_dir):
    q = numeric.single_end_mapq(F.col("c1"), F.col("c2"), F.col("score"), F.lit(12))
    return placed(spark, sf_dir).filter("score is not null").select("read_id", q.alias("q"))


@R.query("fn_f25_read_error", f"with {READS} select read_id, round(1 - list_product(list_transform(range(1, least(25, length(qual)) + 1), lambda i: 1 - pow(10.0, -(ascii(substr(qual, i::int, 1)) - 33) / 10.0))), 6) as error from reads where length(qual) > 0")
def read_error(spark, sf_dir):
    return read_table(spark, sf_dir).filter("length(qual) > 0").select("read_id", F.round(numeric.read_error(sequence.qualities("qual")), 6).alias("error"))


@R.query("fn_f26_alignment_score", f"with {ALN} select read_id, 3 * coalesce(score, 0) + 11 * c1 + 4 * c2 as score from aln")
def alignment_score(spark, sf_dir):
    return placed(spark, sf_dir).select("read_id", numeric.alignment_score(F.coalesce("score", F.lit(0)), F.col("c1"), F.col("c2")).alias("score"))


@R.query("fn_f27_overlap_length", f"with {MARKERS}, n as (select name, chrom, pos, flank, lead(pos) over w as q, lead(flank) over w as f from markers window w as (partition by chrom order by pos, name)) select name, abs(least(pos + flank, q + f) - greatest(pos - flank, q - f)) as overlap from n where q is not null")
def overlap_length(spark, sf_dir):
    line = Window.partitionBy("chrom").orderBy("pos", "name")
    own = marker_table(spark, sf_dir).withColumns({"q": F.lead("pos").over(line), "f": F.lead("flank").over(line)}).filter("q is not null")
    size = F.abs(F.least(F.col("pos") + F.col("flank"), F.col("q") + F.col("f")) - F.greatest(F.col("pos") - F.col("flank"), F.col("q") - F.col("f")))
    return own.select("name", size.alias("overlap"))


_PACK = "list_sum(list_transform(range(16), lambda j: (case substr(key, j::int + 1, 1) when 'C' then 1 when 'G' then 2 when 'T' then 3 else 0 end)::bigint * cast(pow(4, 15 - j) as bigint)))"


@R.query(
    "fn_f29_masked_keys",
    f"with {READS}, k as (select read_id, substr(upper(seq), 1, 32) as kmer from reads where length(seq) >= 32), m as (select read_id, unnest(range(6)) as mask, regexp_replace(unnest([{', '.join(f'substr(kmer, {1 + 8 * a}, 8) || substr(kmer, {1 + 8 * b}, 8)' for a, b in K.MASKS)}]), '[^ACGT]', 'A', 'g') as key from k) select read_id, mask::tinyint as mask, cast({_PACK} as bigint) as key from m",
)
def masked_keys(spark, sf_dir):
    kmer = F.substr(F.upper("seq"), F.lit(1), F.lit(32))
    rows = read_table(spark, sf_dir).filter("length(seq) >= 32").select("read_id", F.inline(K.masked_keys(kmer)))
    return rows


@R.query("fn_f30_flag_bits", "select distinct rec_id, flag & 16 <> 0 as reverse, flag & 1024 <> 0 as duplicate, flag & 4 <> 0 as unmapped, (flag | 1024) as marked from sam_records")
def flag_bits(spark, sf_dir):
    of = lambda b, n: numeric.flag("flag", b).alias(n)
    return table(spark, sf_dir, "sam_records").select("rec_id", of(16, "reverse"), of(1024, "duplicate"), of(4, "unmapped"), F.col("flag").bitwiseOR(1024).alias("marked")).distinct()


@R.query("fn_f31_array_helpers", "select vec_id, round(list_max(embedding)::double, 5) as high, round(list_min(embedding)::double, 5) as low, len(list_filter(embedding, lambda x: x > 0)) as positive, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as norm from embeddings")
def array_helpers(spark, sf_dir):
    e = F.col("embedding")
    norm_of = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.array_max(e).cast("double"), 5).alias("high"), F.round(F.array_min(e).cast("double"), 5).alias("low"), F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positive"), F.round(norm_of, 4).alias("norm"))


@R.query("fn_f32_info_lookup", "select event_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) as k, false as flagged from events")
def info_lookup(spark, sf_dir):
    info = F.str_to_map(F.concat(F.lit("DB;K="), F.regexp_extract("props", "([0-9]+)", 1)), F.lit(";"), F.lit("="))
    own = table(spark, sf_dir, "events").select("event_id", info.alias("info"))
    return own.select("event_id", F.try_element_at("info", F.lit("K")).cast("int").alias("k"), F.map_contains_key("info", F.lit("AF")).alias("flagged"))


@R.query("fn_f33_seeded_uniform")
def seeded_uniform(spark, sf_dir):
    """Uniform numbers from a seed and the key: stable under any partitioning."""
    u = F.pmod(F.xxhash64("event_id", F.lit(12345)), F.lit(1 << 40)) / float(1 << 40)
    return table(spark, sf_dir, "events").select("event_id", u.alias("u"))


@R.query("fn_f34_genomic_order", f"with {MARKERS}, k as (select name, coalesce(try_cast(chrom as int), case chrom when 'X' then 23 when 'Y' then 24 else 25 end) as c, pos from markers) select name, c * 1000000000::bigint + pos as place from k")
def genomic_order(spark, sf_dir):
    number = F.coalesce(F.col("chrom").try_cast("int"), F.when(F.col("chrom") == "X", 23).when(F.col("chrom") == "Y", 24).otherwise(25))
    return marker_table(spark, sf_dir).select("name", (number.cast("bigint") * 1_000_000_000 + F.col("pos")).alias("place"))


@R.query("fn_f34_numeric_aware_order", r"""select line_id, list_aggregate(list_transform(regexp_extract_all(raw_line, '[0-9]+|[^0-9]+'), lambda x: case when x[1] between '0' and '9' then lpad(cast(length(ltrim(x, '0')) as varchar), 9, '0') || ltrim(x, '0') else x end), 'string_agg', '') as place from read_lines where length(raw_line) > 0""")
def numeric_aware_order(spark, sf_dir):
    """A sort key of texts in which runs of digits count as numbers."""
    return table(spark, sf_dir, "read_lines").filter("length(raw_line) > 0").select("line_id", keys.natural("raw_line").alias("place"))


@R.query(
    "fn_sql_functions",
    f"""with {ALN}, {MARKERS}, {BASES.replace(ALN + ", ", "")}, top as (select chrom, pos, base, row_number() over (partition by chrom, pos order by count(*) desc, base) as k, count(*) as n from bases where base in ('A', 'C', 'G', 'T') and exists (select 1 from markers m where m.chrom = bases.chrom and m.pos = bases.pos) group by chrom, pos, base)
    select chrom, pos, base as majority, {_RC.format('base')} as other, {norm("'chr' || chrom")} as same from top where k = 1""",
)
def sql_functions(spark, sf_dir):
    """The functions in SQL text: the majority base of each marker that reads cover, and its complement."""
    sql.register(spark)
    B.marker_bases(placed(spark, sf_dir), marker_table(spark, sf_dir)).filter("base in ('A', 'C', 'G', 'T')").createOrReplaceTempView("marker_bases")
    return spark.sql("select chrom, pos, majority, reverse_complement(majority) as other, norm_chrom(concat('chr', chrom)) as same from (select chrom, pos, majority_base(base) as majority from marker_bases group by chrom, pos)")
