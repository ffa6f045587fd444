"""The domain tables as operators expect them, and the same as SQL building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.operators import bases as B
from lociflow.operators import markers as M
from lociflow.operators import pairs as PR
from lociflow.operators import sweep as SW
from lociflow.operators.distinct_rows import first_rows
from lociflow.session import table

NORM = "case when contains(upper({0}), 'CHR') then substr(upper({0}), 4) else upper({0}) end"


def norm(c: str) -> str:
    return NORM.format(c)


MARKERS = f"""markers as (
  select name, {norm("split_part(name, ':', 1)")} as chrom, try_cast(regexp_extract(name, '^[^:]*:([0-9]+)@', 1) as int) as pos,
    regexp_extract(name, '@([^/]*)/', 1) as ref, regexp_extract(name, '/([^|]*)', 1) as alt,
    case when name like '%L' then 'long' else 'short' end as class, case when name like '%L' then 1000 else 250 end as flank
  from contigs)"""
FLANKS = "flanks as (select name, chrom, pos - flank as beg, pos + flank as \"end\" from markers)"
ALN = "aln as (select distinct on (read_id) * from alignments order by read_id)"
BLOCKS = """ops as (
  select read_id, unnest(cigar) as o, generate_subscripts(cigar, 1) as k from aln
  where pos is not null and cigar is not null and seq is not null and chrom is not null),
blk as (
  select read_id, k, o.op as op, o.len as len,
    cast(coalesce(sum(case when o.op in ('M', 'I', 'S', '=', 'X') then o.len else 0 end) over w, 0) as int) as read_off,
    cast(coalesce(sum(case when o.op in ('M', 'D', 'N', '=', 'X') then o.len else 0 end) over w, 0) as int) as ref_off
  from ops window w as (partition by read_id order by k rows between unbounded preceding and 1 preceding))"""
MISMATCHES = r"""mdt as (
  select read_id, unnest(t) as x, generate_subscripts(t, 1) as k
  from (select read_id, regexp_extract_all(md, '[0-9]+|\^[A-Z]+|[A-Z]') as t from aln where md is not null)),
mdo as (
  select read_id, x, k, cast(coalesce(sum(case when x[1] between '0' and '9' then try_cast(x as int) when x[1] = '^' then length(x) - 1 else 1 end)
    over (partition by read_id order by k rows between unbounded preceding and 1 preceding), 0) as int) as off
  from (select read_id, x, k from mdt)),
mm as (select read_id, off, x as ref_base from mdo where x[1] between 'A' and 'Z')"""
BASES = f"""{ALN}, {BLOCKS}, {MISMATCHES},
each as (select read_id, read_off, ref_off, unnest(range(len)) as i from blk where op in ('M', '=', 'X')),
bases as (
  select a.read_id, {norm("a.chrom")} as chrom, cast(a.pos + e.ref_off + e.i as int) as pos, substr(seq, e.read_off + e.i + 1, 1) as base,
    ascii(substr(qual, e.read_off + e.i + 1, 1)) - 33 as qual,
    cast(case when strand then length(seq) - 1 - (e.read_off + e.i) else e.read_off + e.i end as int) as cycle,
    coalesce(m.ref_base, substr(seq, e.read_off + e.i + 1, 1)) as ref_base, mapq, strand
  from each e join aln a using (read_id) left join mm m on m.read_id = e.read_id and m.off = e.ref_off + e.i)"""
DEPTH = """depth as (
  select chrom, pos, count(*) as depth, count(*) filter (qual >= 20) as q20, count(*) filter (qual >= 30) as q30 from bases group by chrom, pos)"""


def collapsed(source: str, out: str) -> str:
    """CTE that merges the closed intervals of ``source``."""
    return f"""{out}_f as (select chrom, beg, "end", case when beg <= max("end") over (partition by chrom order by beg, "end"
    rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from {source}),
{out}_n as (select *, sum(fresh) over (partition by chrom order by beg, "end" rows between unbounded preceding and current row) as no from {out}_f),
{out} as (select chrom, min(beg) as beg, max("end") as "end" from {out}_n group by chrom, no)"""


def marker_table(spark, sf_dir):
    return M.markers_of(table(spark, sf_dir, "contigs"))


def flank_table(spark, sf_dir):
    return M.flanks(marker_table(spark, sf_dir))


def placed(spark, sf_dir):
    """One row per read of the alignments; repeated rows hold the same content."""
    return first_rows(table(spark, sf_dir, "alignments"), "read_id")


def base_table(spark, sf_dir):
    return B.aligned_bases(placed(spark, sf_dir))


def marker_base_table(spark, sf_dir):
    return B.marker_bases(placed(spark, sf_dir), marker_table(spark, sf_dir))


def segment_table(spark, sf_dir):
    return SW.depth_segments(SW.block_ends(placed(spark, sf_dir).filter("seq is not null")))


def read_table(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "fastq_reads"), "read_id")


READS = "reads as (select distinct on (read_id) * from fastq_reads order by read_id)"


def pair_table(spark, sf_dir):
    reads = table(spark, sf_dir, "fastq_reads").select("read_id", "read_idx").distinct()
    return PR.pair_status(PR.aligned_pairs(placed(spark, sf_dir), reads, marker_table(spark, sf_dir)))


_SIDE = """{{'chrom': {norm}, 'contig': contig,
  'beg': pos - case when len(cigar) > 0 and cigar[1].op = 'S' then cigar[1].len else 0 end,
  'end': pos + refl - 1 + case when len(cigar) > 1 and cigar[-1].op = 'S' then cigar[-1].len else 0 end,
  'reverse': strand, 'mapq': coalesce(mapq, 0), 'clipped': len(list_filter(cigar, lambda c: c.op in ('S', 'H'))) > 0,
  'placed': contig is not null and coalesce(pos > 0, false), 'low': centre - flank, 'high': centre + flank}}""".format(norm=norm("chrom"))
PAIRS = f"""{MARKERS}, {ALN},
ids as (select distinct read_id, read_idx from fastq_reads),
sides as (
  select a.file_id, i.read_idx, a.mate, {_SIDE} as s
  from (select *, coalesce(list_sum(list_transform(cigar, lambda c: case when c.op in ('M', 'D', 'N', '=', 'X') then c.len else 0 end)), 0) as refl from aln) a
  join ids i using (read_id) left join (select name, pos as centre, flank from markers) m on m.name = a.contig),
two as (select file_id, read_idx, max(s) filter (mate = 1) as m1, max(s) filter (mate = 2) as m2 from sides group by all),
good as (select *, coalesce(m1.placed and m1.mapq > 0, false) as g1, coalesce(m2.placed and m2.mapq > 0, false) as g2,
  case when m1.reverse then m1."end" - m1.low + 1 else m1.high - m1.beg + 1 end as r1,
  case when m2.reverse then m2."end" - m2.low + 1 else m2.high - m2.beg + 1 end as r2,
  case when not m1.reverse then m1 else m2 end as fwd, case when not m1.reverse then m2 else m1 end as rev from two),
facing as (select *, coalesce(g1 and g2 and m1.contig = m2.contig and m1.reverse <> m2.reverse and fwd.beg <= rev."end", false) as face,
  cast(case when g1 and r1 > 0 then r1 else -1 end as int) as k1, cast(case when g2 and r2 > 0 then r2 else -1 end as int) as k2 from good),
pairs as (
  select file_id, read_idx, case when not g1 and not g2 then 'LowQual'
      when not (g1 and g2) then case when (case when g1 then m1.reverse else m2.reverse end) then 'RevOnly' else 'FwdOnly' end
      when not face then 'NotPair' when m1.clipped or m2.clipped then 'PartialPair' else 'PropPair' end as status,
    case when coalesce(m1.reverse, false) then k2 else k1 end as max1, case when coalesce(m1.reverse, false) then k1 else k2 end as max2,
    cast(case when face then rev."end" - fwd.beg + 1 else -1 end as int) as obs, coalesce(m1.contig, m2.contig) as contig,
    cast(case when face then fwd.beg end as int) as beg, cast(case when face then rev."end" end as int) as "end",
    case when face then not fwd.clipped end as fwd_whole, case when face then not rev.clipped end as rev_whole
  from facing)"""


def event_points(spark, sf_dir):
    """Events as points: contig c<user mod 7>, position in seconds."""
    events = table(spark, sf_dir, "events")
    pos = F.unix_seconds(F.col("ts").cast("timestamp")).cast("int") - 1_700_000_000
    return events.select("event_id", F.concat(F.lit("C"), (F.col("user_id") % 7).cast("string")).alias("chrom"), pos.alias("pos"), "event_type", "value")


POINTS = """points as (select event_id, 'C' || cast(user_id % 7 as varchar) as chrom,
  cast(floor(epoch(ts)) as bigint)::int - 1700000000 as pos, event_type, value from events)"""


def event_regions(spark, sf_dir, kind: str | None = None):
    """Events as closed intervals of their value in minutes."""
    points = event_points(spark, sf_dir)
    points = points if kind is None else points.filter(F.col("event_type") == kind)
    return points.select("chrom", F.col("pos").alias("beg"), (F.col("pos") + F.floor(F.col("value") * 60).cast("int")).alias("end"))


REGIONS = """regions as (select chrom, pos as beg, pos + cast(floor(value * 60) as int) as "end", event_type from points)"""
