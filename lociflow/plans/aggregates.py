"""Queries of aggregations over bases, pairs, records and markers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.operators import bases as B
from lociflow.operators import genotype as G
from lociflow.operators import hits as H
from lociflow.operators import markers as M
from lociflow.operators import pairs as PR
from lociflow.operators import panel as P
from lociflow.operators import summary as S
from lociflow.operators import sweep as SW
from lociflow.plans.domain import (
    ALN, BASES, DEPTH, MARKERS, PAIRS, READS, base_table, marker_base_table, marker_table, pair_table, placed, read_table, segment_table,
)
from lociflow.plans.registry import Registry
from lociflow.session import cut, table
from lociflow.sources import sinks as K

R = Registry()
QUERIES, SQL = R.queries, R.sql
_B = f"with {BASES}"
_D = f"{_B}, {DEPTH}"
SIZE = 1_000_000_000


@R.query("agg_a01_depth", f"{_D} select chrom, pos, depth from depth")
def depth(spark, sf_dir):
    return SW.depth(segment_table(spark, sf_dir))


@R.query("agg_a02_q20_q30_depth", f"{_D} select chrom, pos, q20, q30 from depth where q20 > 0")
def q20_q30(spark, sf_dir):
    return B.site_depth(placed(spark, sf_dir)).filter("q20 > 0").select("chrom", "pos", "q20", "q30")


@R.query(
    "agg_a03_depth_histogram",
    f"""{_D}, h as (select least(depth, 1023) as depth, count(*) as sites from depth group by 1)
    select cast(d.depth as int) as depth, case when d.depth = 0 then {SIZE} - (select count(*) from depth) else coalesce(h.sites, 0) end as sites
    from (select unnest(range(1024)) as depth) d left join h using (depth)""",
)
def depth_histogram(spark, sf_dir):
    return B.depth_histogram(SW.depth_counts(segment_table(spark, sf_dir)), SIZE)


@R.query(
    "agg_a04_sites_by_depth",
    f"{_D} select " + ", ".join(f"count(*) filter (depth >= {k}) as depth_{k}" for k in (1, 2, 5, 10)) + " from depth",
)
def sites_by_depth(spark, sf_dir):
    return B.sites_from(SW.depth_counts(segment_table(spark, sf_dir)))


@R.query(
    "agg_a05_gc_depth",
    f"""{_D}, g as (select chrom, pos, case when pos % 3 <> 0 then cast((pos * 7::bigint) % 101 as int) else 0 end as gc, depth from depth)
    select gc, cast(sum(depth) as bigint) as depth_sum, count(*) as sites,
      round(sum(depth) / count(*) / ((select sum(depth) from g) / (select count(*) from g)), 6) as normalised from g group by gc""",
)
def gc_depth(spark, sf_dir):
    bases = base_table(spark, sf_dir)
    gc = bases.select("chrom", "pos").distinct().filter("pos % 3 <> 0").withColumn("gc", (F.col("pos").cast("bigint") * 7 % 101).cast("int"))
    return B.gc_depth(B.depth(bases), gc)


_MIS = f"""{_B}, {MARKERS}, mis as (select b.*, coalesce(base <> 'N' and ref_base <> 'N' and base <> ref_base
  and not exists (select 1 from markers m where m.chrom = b.chrom and m.pos = b.pos), false) as mismatch from bases b where qual is not null)"""


def _mis(spark, sf_dir):
    return B.mismatches(base_table(spark, sf_dir).filter("qual is not null"), marker_table(spark, sf_dir))


@R.query(
    "agg_a06_quality_by_reported",
    f"{_MIS} select qual, count(*) filter (mismatch) as mismatches, count(*) as bases, round(-10 * log10((count(*) filter (mismatch) + 1) / (count(*) + 2)), 6) as empirical from mis group by qual",
)
def quality_by_reported(spark, sf_dir):
    return B.quality_by_reported(_mis(spark, sf_dir))


@R.query(
    "agg_a07_quality_by_cycle",
    f"""{_MIS}, c as (select cast(cycle + 1 as int) as cycle, count(*) filter (mismatch) as mismatches, count(*) as bases from mis group by 1)
    select cycle, mismatches, bases, round(coalesce(last_value(case when mismatches <> 0 then -10 * log10((mismatches + 1e-6) / (bases + 1e-6)) end ignore nulls)
      over (order by cycle rows between unbounded preceding and current row), 0), 6) as empirical from c""",
)
def quality_by_cycle(spark, sf_dir):
    return B.quality_by_cycle(_mis(spark, sf_dir))


_PR = f"with {PAIRS}"


@R.query("join_f28_pair_status", f"{_PR} select file_id, read_idx, status, max1, max2, obs from pairs")
def pair_status(spark, sf_dir):
    return pair_table(spark, sf_dir).select("file_id", "read_idx", "status", "max1", "max2", "obs")


@R.query(
    "agg_a08_insert_histogram",
    f"{_PR} select cast(case when status = 'NotPair' then 0 else greatest(least(obs, 4095), 0) end as int) as size, count(*) as pairs from pairs where status in ('NotPair', 'PropPair', 'PartialPair') group by 1",
)
def insert_histogram(spark, sf_dir):
    pairs = pair_table(spark, sf_dir).filter("status in ('NotPair', 'PropPair', 'PartialPair')")
    size = F.when(F.col("status") == "NotPair", 0).otherwise(F.greatest(F.least("obs", F.lit(4095)), F.lit(0)))
    return pairs.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("pairs"))


@R.query(
    "agg_a09_duplicate_rate",
    f"""{_PR}, n as (select count(*) as n, count(distinct (contig, beg, "end")) as d from pairs where status = 'PropPair')
    select 2 * (n - d) as duplicate_reads, 2 * n as pair_reads, round((n - d) / nullif(n, 0), 6) as rate from n""",
)
def duplicate_rate(spark, sf_dir):
    return PR.duplicate_rate(pair_table(spark, sf_dir))


_SEX_CONTIGS = f"""with {MARKERS}, {ALN}, r as (select m.name as contig, a.file_id, a.read_id, a.pos <= m.pos + m.flank and a.pos + length(a.seq) > m.pos - m.flank as over_,
      a.pos >= m.pos - m.flank and a.pos + length(a.seq) - 1 <= m.pos + m.flank as inside, a.flag & 2 <> 0 or a.flag & 8 = 0 as mated
      from aln a join markers m on m.name = a.contig where m.chrom in ('X', 'Y') and a.pos > 0 and a.seq is not null)
    select contig, count(*) filter (over_) as overlapping, count(*) filter (inside) as included, count(*) filter (over_ and mated) as pair_overlapping,
      count(*) filter (inside and mated) as pair_included from r group by contig"""


@R.query("agg_a10_sex_contigs", _SEX_CONTIGS)
def sex_contigs(spark, sf_dir):
    return S.contig_counters(placed(spark, sf_dir), marker_table(spark, sf_dir), ["X", "Y"])


@R.query(
    "agg_a11_file_totals",
    f"""with {READS} select file_id, count(*) as reads, cast(sum(length(seq)) as bigint) as bases, cast(sum(length(seq)) // count(*) as bigint) as read_length,
    grouping(file_id) = 1 as is_total from reads group by grouping sets ((file_id), ())""",
)
def file_totals(spark, sf_dir):
    return S.file_totals(read_table(spark, sf_dir))


@R.query(
    "agg_a12_pileup",
    f"""with {MARKERS}, {BASES} select chrom, pos, count(*) as depth, string_agg(base, '' order by read_id, cycle) as bases, string_agg(cast(qual as varchar), ',' order by read_id, cycle) as quals
    from bases b where qual is not null and exists (select 1 from markers m where m.chrom = b.chrom and m.pos = b.pos) group by chrom, pos""",
)
def pileup(spark, sf_dir):
    piles = B.pileup(marker_base_table(spark, sf_dir).filter("qual is not null"))
    join = lambda f, sep: F.array_join(F.transform("items", f), sep)
    return piles.select("chrom", "pos", "depth", join(lambda x: x["base"], "").alias("bases"), join(lambda x: x["qual"].cast("string"), ",").alias("quals"))


@R.query(
    "agg_a13_quality_fractions",
    f"""{_D} select round(sum(q20) / count(*), 6) as q20_depth, round(sum(q30) / count(*), 6) as q30_depth, round(sum(q20) / sum(depth), 6) as q20_bases, round(sum(q30) / sum(depth), 6) as q30_bases from depth""",
)
def quality_fractions(spark, sf_dir):
    sums = B.site_depth(placed(spark, sf_dir)).agg(*[F.sum(c).alias(c) for c in ("depth", "q20", "q30")], F.count(F.lit(1)).alias("n"))
    ratio = lambda a, b, n: F.round(F.col(a) / F.col(b), 6).alias(n)
    return sums.select(ratio("q20", "n", "q20_depth"), ratio("q30", "n", "q30_depth"), ratio("q20", "depth", "q20_bases"), ratio("q30", "depth", "q30_bases"))


def _median_sql(least):
    return f"""(select coalesce(min(k), 0) from (select k, sum(n) over (order by k) as run, sum(n) over () as total from
      (select abs(insert_size::bigint) as k, count(*) as n from sam_records where insert_size <> 0 and abs(insert_size::bigint) between {least} and 4095 group by 1)) where run > total // 2)"""


@R.query("agg_a14_truncated_median", f"select 300 as least, {_median_sql(300)} as median union all select 500, {_median_sql(500)}")
def truncated_median(spark, sf_dir):
    size = F.abs(F.col("insert_size").cast("bigint"))
    sizes = table(spark, sf_dir, "sam_records").filter("insert_size <> 0").groupBy(size.alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("k <= 4095")
    of = lambda least: PR.truncated_median(sizes, "k", "n", least).select(F.lit(least).alias("least"), "median")
    return of(300).unionByName(of(500))


_PL = f"""with {MARKERS}, {BASES}, mk as (select distinct on (chrom, pos) chrom, pos, ref, alt from markers order by chrom, pos, name),
at_ as (select b.chrom, b.pos, case when base = ref then 'ref' when base = alt then 'alt' else 'other' end as kind, pow(10.0, -greatest(qual, 1) / 10.0) as e from bases b join mk using (chrom, pos) where qual is not null),
gl as (select chrom, pos, count(*) as depth,
  sum(log10(case kind when 'ref' then 1 - e when 'alt' then e / 3 else 2 * e / 3 end)) as g0,
  sum(log10(case kind when 'other' then 2 * e / 3 else 0.5 - e / 3 end)) as g1,
  sum(log10(case kind when 'alt' then 1 - e when 'ref' then e / 3 else 2 * e / 3 end)) as g2 from at_ group by 1, 2),
pl as (select chrom, pos, depth, cast(floor(round(-10 * g0, 6) + 0.5) as bigint) as pl0, cast(floor(round(-10 * g1, 6) + 0.5) as bigint) as pl1, cast(floor(round(-10 * g2, 6) + 0.5) as bigint) as pl2 from gl)"""


def site_table(spark, sf_dir):
    """One marker per site, the first by name."""
    marks = marker_table(spark, sf_dir).groupBy("chrom", "pos").agg(F.min_by(F.struct("ref", "alt"), "name").alias("m"))
    return marks.select("chrom", "pos", "m.ref", "m.alt")


def _scores(spark, sf_dir):
    return G.likelihoods(marker_base_table(spark, sf_dir).filter("qual is not null"), site_table(spark, sf_dir))


@R.query("agg_a15_genotype_likelihoods", f"{_PL} select * from pl")
def genotype_likelihoods(spark, sf_dir):
    return _scores(spark, sf_dir)


_CALL = f"""{_PL}, pr as (select *, ((pos % 97) + 1) / 100.0 as af from pl),
po as (select *, -10 * log10((1 - af) * (1 - af)) + pl0 as s0, -10 * log10(2 * af * (1 - af)) + pl1 as s1, -10 * log10(af * af) + pl2 as s2 from pr),
mi as (select *, least(s0, s1, s2) as lo from po),
tt as (select *, lo - 10 * log10(pow(10.0, -(s0 - lo) / 10) + pow(10.0, -(s1 - lo) / 10) + pow(10.0, -(s2 - lo) / 10)) as t from mi),
gp as (select *, cast(floor(round(s0 - t, 6) + 0.5) as bigint) as gp0, cast(floor(round(s1 - t, 6) + 0.5) as bigint) as gp1, cast(floor(round(s2 - t, 6) + 0.5) as bigint) as gp2 from tt)
select chrom, pos, depth, pl0, pl1, pl2, gp0, gp1, gp2, case when gp0 < gp1 and gp0 < gp2 then '0/0' when gp0 >= gp1 and gp1 < gp2 then '0/1' else '1/1' end as gt from gp"""


@R.query("fn_f22_genotype_calls", _CALL)
def genotype_calls(spark, sf_dir):
    return calls_table(spark, sf_dir)


def calls_table(spark, sf_dir):
    af = site_table(spark, sf_dir).withColumn("af", ((F.col("pos") % 97) + 1) / 100.0)
    return G.calls(_scores(spark, sf_dir), af)


@R.query(
    "agg_a16_depth_moments",
    f"with {MARKERS}, {BASES}, {DEPTH}, d as (select distinct d.chrom, d.pos, d.depth from depth d join markers using (chrom, pos)) select count(*) as sites, round(avg(depth), 6) as mean, round(stddev_pop(depth), 6) as deviation from d",
)
def depth_moments(spark, sf_dir):
    return S.depth_moments(_marker_depth(spark, sf_dir))


def _marker_depth(spark, sf_dir):
    return B.depth(marker_base_table(spark, sf_dir))


@R.query(
    "flt_p25_usual_depth",
    f"with {MARKERS}, {BASES}, {DEPTH}, d as (select distinct d.chrom, d.pos, d.depth from depth d join markers using (chrom, pos)) select chrom, pos, depth from d where abs(depth - (select avg(depth) from d)) <= 3 * (select stddev_pop(depth) from d)",
)
def usual_depth(spark, sf_dir):
    return S.usual_depth(_marker_depth(spark, sf_dir)).select("chrom", "pos", "depth")


@R.query(
    "agg_a17_column_moments",
    "select cast(d as int) as dim, round(avg(x), 5) as mean, round(stddev_pop(x), 5) as deviation from (select unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as d from embeddings) group by d",
)
def column_moments(spark, sf_dir):
    return P.column_stats(table(spark, sf_dir, "embeddings"), "embedding").select("dim", F.round("mean", 5).alias("mean"), F.round("deviation", 5).alias("deviation"))


@R.query(
    "agg_a19_row_means",
    "select vec_id, round(list_avg(embedding::double[]), 6) as mean, round(list_sum(list_transform(embedding::double[], lambda x: (x - list_avg(embedding::double[])) * (x - list_avg(embedding::double[])))), 5) as spread from embeddings",
)
def row_means(spark, sf_dir):
    rows = P.row_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows.select("vec_id", F.round("mean", 6).alias("mean"), F.round(F.aggregate("centred", F.lit(0.0), lambda a, x: a + x * x), 5).alias("spread"))


@R.query("agg_a21_genome_size", "select cast(sum(contig_len) as bigint) as bases, count(*) as contigs, cast(max(contig_offset + contig_len) as bigint) as end_offset from contigs")
def genome_size(spark, sf_dir):
    return table(spark, sf_dir, "contigs").agg(F.sum("contig_len").alias("bases"), F.count(F.lit(1)).alias("contigs"), F.max(F.col("contig_offset") + F.col("contig_len")).alias("end_offset"))


_FLAGS = {"paired": 1, "proper": 2, "secondary": 256, "failed": 512, "duplicate": 1024}


@R.query(
    "agg_a22_flag_counters",
    "select file_id, count(*) as records, count(*) filter (flag & 4 = 0) as mapped, "
    + ", ".join(f"count(*) filter (flag & {b} <> 0) as {n}" for n, b in _FLAGS.items())
    + ", round(count(*) filter (flag & 4 = 0) / count(*), 6) as mapping_rate from sam_records group by file_id",
)
def flag_counters(spark, sf_dir):
    return S.flag_counters(table(spark, sf_dir, "sam_records"), ["file_id"])


_GT = "list_transform(embedding, lambda x: case when x < -0.25 then -1 when x < 0 then 0 when x < 0.1 then 1 else 2 end)"


def genotype_array():
    """Genotypes from the embeddings' values by thresholds, -1 for missing."""
    return F.transform("embedding", lambda x: F.when(x < -0.25, -1).when(x < 0, 0).when(x < F.lit(0.1).cast("double"), 1).otherwise(2))


@R.query(
    "agg_a23_allele_counts",
    f"""with g as (select vec_id, list_filter({_GT}, lambda g: g >= 0) as g from embeddings)
    select vec_id, cast(2 * len(g) as int) as alleles, cast(coalesce(list_sum(g), 0) as int) as alt, cast(least(coalesce(list_sum(g), 0), 2 * len(g) - coalesce(list_sum(g), 0)) as int) as minor from g""",
)
def allele_counts(spark, sf_dir):
    return M.allele_counts(table(spark, sf_dir, "embeddings"), "vec_id", genotype_array())


@R.query(
    "agg_a24_insert_moments",
    """with s as (select file_id, abs(insert_size::bigint)::double as x from sam_records where insert_size <> 0),
    r as (select *, row_number() over (partition by file_id order by x) - 1 as i, count(*) over (partition by file_id) as n from s),
    q as (select file_id, max(x) filter (i = floor(n * 0.25 + 0.5)) as p25, max(x) filter (i = floor(n * 0.5 + 0.5)) as p50, max(x) filter (i = floor(n * 0.75 + 0.5)) as p75 from r group by 1),
    f as (select *, greatest(1.0, floor(p25 - 2 * (p75 - p25) + 0.499)) as low, floor(p75 + 2 * (p75 - p25) + 0.499) as high from q),
    w as (select f.*, s.x from s join f using (file_id) where x between low and high),
    m as (select file_id, avg(x) as mu, stddev_pop(x) as sd from w group by 1)
    select w.file_id, any_value(p25) as p25, any_value(p50) as p50, any_value(p75) as p75, any_value(low) as low, any_value(high) as high, count(*) as n, round(any_value(mu), 4) as mean,
      round(any_value(sd), 4) as deviation, round(avg(pow((x - mu) / nullif(sd, 0), 3)), 4) as skewness, round(avg(pow((x - mu) / nullif(sd, 0), 4)) - 3, 4) as kurtosis from w join m using (file_id) group by w.file_id""",
)
def insert_moments(spark, sf_dir):
    size = F.abs(F.col("insert_size").cast("bigint"))
    rows = table(spark, sf_dir, "sam_records").filter("insert_size <> 0").select("file_id", size.alias("size"))
    return PR.insert_moments(rows, "file_id", "size")


@R.query("agg_a26_class_counts", f"with {MARKERS} select case when chrom in ('X', 'Y') then lower(chrom) else class end as class, count(*) as markers from markers group by 1")
def class_counts(spark, sf_dir):
    return M.class_counts(marker_table(spark, sf_dir))


@R.query("agg_a27_effective_size", f"with {MARKERS} select cast(sum((flank - 66) * 2 + 1) as bigint) as effective_size, count(*) as markers from markers")
def effective_size(spark, sf_dir):
    return M.effective_size(marker_table(spark, sf_dir), 101)


_MEDIAN = lambda least: f"""(select coalesce(min(k), 0) from (select k, sum(n) over (order by k) as run, sum(n) over () as total from ih where k >= {least}) where run > total // 2)"""
_SUMMARY = f"""with {PAIRS}, {READS}, {BASES.replace(ALN + ", ", "")}, {DEPTH},
    t as (select count(*) as reads, sum(length(seq)) as bases, sum(length(seq)) // count(*) as len from reads), m as (select count(*) as covered, sum(depth) as mapped, sum(q20) as q20, sum(q30) as q30,
      count(*) filter (depth >= 2) as d2, count(*) filter (depth >= 5) as d5, count(*) filter (depth >= 10) as d10 from depth), g as (select sum(2 * flank + 1) as region from markers),
    du as (select count(*) as n, count(distinct (contig, beg, "end")) as d from pairs where status = 'PropPair'), ih as (select obs as k, count(*) as n from pairs where status in ('PropPair', 'PartialPair') and obs between 1 and 4095 group by obs)
    select cast(t.reads as bigint) as total_reads, cast(t.bases as bigint) as total_bases, cast(t.len as bigint) as read_length, cast(m.mapped as bigint) as bases_mapped, cast(g.region as bigint) as region_size,
      round(m.mapped / t.len * {SIZE}::double / g.region / t.reads, 6) as mapping, round(t.bases / {SIZE}::double, 9) as expected_depth, round(m.mapped / g.region, 6) as estimated_depth,
      round(m.covered / g.region, 6) as depth_1, round(m.d2 / g.region, 6) as depth_2, round(m.d5 / g.region, 6) as depth_5, round(m.d10 / g.region, 6) as depth_10,
      round(m.q20 / m.mapped, 6) as q20_bases, round(m.q30 / m.mapped, 6) as q30_bases, round(m.q20 / m.covered, 6) as q20_depth, round(m.q30 / m.covered, 6) as q30_depth,
      round((du.n - du.d) / nullif(du.n, 0), 6) as duplicate_rate, cast({_MEDIAN(300)} as bigint) as median_300, cast({_MEDIAN(500)} as bigint) as median_500 from t, m, g, du"""


@R.query("agg_a28_summary", _SUMMARY)
def summary(spark, sf_dir):
    return S.summary(read_table(spark, sf_dir), B.site_depth(placed(spark, sf_dir)), marker_table(spark, sf_dir), SIZE, pair_table(spark, sf_dir))


_PLS = "[cast(floor((1 + embedding[1]) * 200) as int), cast(floor((1 + embedding[2]) * 200) as int), cast(floor((1 + embedding[3]) * 200) as int)]"


@R.query(
    "agg_a29_best_genotype",
    f"with p as (select vec_id, list_transform({_PLS}, lambda x: least(x, 255)) as pl from embeddings) select vec_id, cast(list_position(pl, list_min(pl)) - 1 as int) as genotype from p",
)
def best_genotype(spark, sf_dir):
    pl = F.array(*[F.floor((1 + F.element_at("embedding", i)) * 200).cast("int") for i in (1, 2, 3)])
    return table(spark, sf_dir, "embeddings").select("vec_id", M.best_genotype(pl).alias("genotype"))


@R.query(
    "agg_a30_hit_counts",
    """with h as (select read_id, mapq, min(mapq) over (partition by read_id) as best from sam_records where read_id is not null and mapq is not null and mapq <> 255)
    select read_id, count(*) filter (mapq = best) as c1, count(*) filter (mapq > best) as c2, case when count(*) filter (mapq = best) = 1 then 'unique' else 'repeat' end as type from h group by read_id""",
)
def hit_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "sam_records").filter("read_id is not null and mapq is not null and mapq <> 255")
    return H.hit_counts(rows, "read_id", "mapq")


@R.query("agg_a31_sample_check", "select file_id, count(distinct split_part(name, ':', 1)) = 1 as single from fastq_reads where name is not null group by file_id")
def sample_check(spark, sf_dir):
    sample = F.split_part(F.col("name"), F.lit(":"), F.lit(1))
    rows = table(spark, sf_dir, "fastq_reads").filter("name is not null")
    return rows.groupBy("file_id").agg((F.count_distinct(sample) == 1).alias("single"))


_CUT = lambda excluded: f"""(select k, cast(count(*) filter (seen) as bigint) as seen, cast(count(*) filter (not seen) as bigint) as cut from (
  select case status when 'PropPair' then obs when 'FwdOnly' then max1 when 'RevOnly' then max2 else case when fwd_whole and not rev_whole then max1 when not fwd_whole and rev_whole then max2 end end as k,
  status = 'PropPair' as seen from pairs where status not in ('LowQual', 'NotPair', '{excluded}')) where k between 0 and 1999 group by k)"""  # noqa: E731


@R.query("num_m02_censoring_counts", f"{_PR} select 'FwdOnly' as excluded, * from {_CUT('FwdOnly')} union all select 'RevOnly', * from {_CUT('RevOnly')}")
def censoring_counts(spark, sf_dir):
    pairs = pair_table(spark, sf_dir)
    of = lambda x: PR.censored(pairs, x).select(F.lit(x).alias("excluded"), "k", "seen", "cut")
    return of("FwdOnly").unionByName(of("RevOnly"))


def _fold_sql(name, excluded):
    return f"""{name}_c as (select b.k, coalesce(c.seen, 0) as seen, coalesce(c.cut, 0) as cut from (select unnest(range(2000)) as k) b left join {_CUT(excluded)} c using (k)),
{name}_n as (select sum(seen + cut)::double as n from {name}_c),
{name}_r as (select 0 as k, f, f as ff, (cut + 1e-6) / (1 - f) / n as gg from (select (seen + 1e-6) / n as f, cut, n from {name}_c, {name}_n where k = 0)
  union all select k, f, ff + f, gg + (cut + 1e-6) / (1 - (ff + f)) / n from (select c.k, (c.seen + 1e-6) / (1 - r.gg) / n as f, r.ff, r.gg, c.cut, n from {name}_r r join {name}_c c on c.k = r.k + 1, {name}_n))"""


SQL_ADJUSTED = f"with recursive {PAIRS}, {_fold_sql('fa', 'FwdOnly')}, {_fold_sql('fb', 'RevOnly')} select cast(a.k as int) as k, round(a.f + b.f, 9) as density from fa_r a join fb_r b using (k)"


@R.query("num_m01_adjusted_insert", SQL_ADJUSTED)
def adjusted_insert(spark, sf_dir):
    return PR.adjusted_insert(pair_table(spark, sf_dir))


@R.query("agg_a25_censored_density", f"with recursive {PAIRS}, {_fold_sql('fa', 'FwdOnly')} select cast(k as int) as k, round(f, 9) as density, round(ff, 9) as upto_seen, round(gg, 9) as upto_cut from fa_r")
def censored_density(spark, sf_dir):
    """Sizes corrected for censoring, without the pairs of which only the forward side is placed, and both running sums."""
    counts = PR.censored(cut(pair_table(spark, sf_dir).select("status", "max1", "max2", "obs", "fwd_whole", "rev_whole")), "FwdOnly")
    return PR.adjusted(counts).select("k", *[F.round(c, 9).alias(c) for c in ("density", "upto_seen", "upto_cut")])


@R.query("agg_u05_distinct_fragments", f'{_PR} select distinct contig, beg, "end" from pairs where status = \'PropPair\'')
def distinct_fragments(spark, sf_dir):
    return pair_table(spark, sf_dir).filter("status = 'PropPair'").select("contig", "beg", "end").distinct()


@R.query(
    "str_t04_depth_sweep",
    f"""{_B}, c as (select chrom, pos, count(*) as depth from bases group by 1, 2), e as (select chrom, pos, depth, lag(pos) over w as lp, lag(depth) over w as ld from c window w as (partition by chrom order by pos)),
    g as (select *, sum(case when lp = pos - 1 and ld = depth then 0 else 1 end) over (partition by chrom order by pos) as no from e)
    select chrom, cast(min(pos) as int) as beg, cast(max(pos) as int) as "end", any_value(depth) as depth from g group by chrom, no""",
)
def depth_sweep(spark, sf_dir):
    return segment_table(spark, sf_dir)


@R.query("srt_o08_flushed_by_coordinate", f"{_B}, {DEPTH} select chrom, pos, depth from depth where depth >= 5")
def flushed_by_coordinate(spark, sf_dir):
    """Deep sites in coordinate order, each listed once the sweep has passed it."""
    segments = segment_table(spark, sf_dir).filter("depth >= 5")
    sites = SW.depth(segments)
    return sites.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")


_METRICS = """total_reads total_bases read_length bases_mapped region_size mapping expected_depth estimated_depth depth_1 depth_2 depth_5 depth_10
    q20_bases q30_bases q20_depth q30_depth duplicate_rate median_300 median_500""".split()


@R.query("rep_r06_summary_rows", f"select unnest([{', '.join(repr(m) for m in _METRICS)}]) as metric, unnest([{', '.join(f'{m}::double' for m in _METRICS)}]) as value from ({_SUMMARY})")
def summary_rows(spark, sf_dir):
    """Every metric of the summary by its name, one a row."""
    row = summary(spark, sf_dir)
    return row.select(*[F.col(c).cast("double").alias(c) for c in _METRICS]).unpivot([], _METRICS, "metric", "value")


@R.query("snk_k18_summary_lines", f"select metric || chr(9) || printf('%.6f', value) as value from (select unnest([{', '.join(repr(m) for m in _METRICS)}]) as metric, unnest([{', '.join(f'{m}::double' for m in _METRICS)}]) as value from ({_SUMMARY}))")
def summary_lines(spark, sf_dir):
    return K.tabbed(summary_rows(spark, sf_dir).withColumn("value", F.format_string("%.6f", "value")))
