"""Queries of interval operators and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociflow.functions import keys, sequence
from lociflow.operators import intervals as I
from lociflow.operators import bases as B
from lociflow.operators import pairs as PR
from lociflow.operators.lookup import locate, zipped
from lociflow.plans.domain import (
    ALN, BASES, DEPTH, FLANKS, MARKERS, POINTS, READS, REGIONS,
    base_table, collapsed, event_regions, flank_table, marker_base_table, marker_table, norm, placed, read_table,
)
from lociflow.plans.registry import Registry
from lociflow.session import table
from lociflow.sources import text as TX

R = Registry()
QUERIES, SQL = R.queries, R.sql
_E = f"with {POINTS}, {REGIONS}"


def _of(kind, name):
    return f"{name} as (select chrom, beg, \"end\" from regions where event_type = '{kind}')"


_TWO = f"{_E}, {_of('click', 'ra')}, {_of('view', 'rb')}, {collapsed('ra', 'ca')}, {collapsed('rb', 'cb')}"


@R.query("win_w05_region_collapse", f"{_E}, {collapsed('regions', 'c')} select chrom, beg, \"end\" from c")
def region_collapse(spark, sf_dir):
    return I.collapse(event_regions(spark, sf_dir))


@R.query("set_u01_region_union", f"{_TWO}, both_ as (select * from ra union all select * from rb), {collapsed('both_', 'c')} select chrom, beg, \"end\" from c")
def region_union(spark, sf_dir):
    return I.union(event_regions(spark, sf_dir, "click"), event_regions(spark, sf_dir, "view"))


def _cross(op):
    return f"""{_TWO} select ca.chrom, greatest(ca.beg, cb.beg) as beg, least(ca."end", cb."end") as "end" from ca join cb on ca.chrom = cb.chrom
    and greatest(ca.beg, cb.beg) {op} least(ca."end", cb."end")"""


def _lists(spark, sf_dir):
    return I.collapse(event_regions(spark, sf_dir, "click")), I.collapse(event_regions(spark, sf_dir, "view"))


@R.query("join_j02_region_intersect", _cross("<"))
def region_intersect(spark, sf_dir):
    return I.intersect(*_lists(spark, sf_dir))


@R.query("set_u02_region_intersect_touching", _cross("<="))
def region_touching(spark, sf_dir):
    return I.intersect(*_lists(spark, sf_dir), touching=True)


@R.query("set_u03_region_equality", "select true as same, false as other")
def region_equality(spark, sf_dir):
    a, b = _lists(spark, sf_dir)
    return spark.createDataFrame([(I.same_regions(a, I.collapse(a)), I.same_regions(a, b))], "same boolean, other boolean")


@R.query("agg_a20_region_size", f"{_TWO} select count(*) as regions, cast(sum(\"end\" - beg + 1) as bigint) as bases from ca")
def region_size(spark, sf_dir):
    return I.total_length(_lists(spark, sf_dir)[0])


_FL = f"with {MARKERS}, {FLANKS}, {collapsed('flanks', 'c')}, {ALN}, pts as (select read_id, {norm('chrom')} as chrom, pos from aln)"
_EXISTS = 'exists (select 1 from c where c.chrom = pts.chrom and pts.pos between c.beg and c."end")'


def _points(spark, sf_dir):
    return placed(spark, sf_dir).select("read_id", keys.chrom("chrom").alias("chrom"), "pos")


@R.query("join_j03_point_in_region", f"{_FL} select read_id, chrom, pos from pts where {_EXISTS}")
def point_in_region(spark, sf_dir):
    return I.in_regions(_points(spark, sf_dir), I.collapse(flank_table(spark, sf_dir)))


@R.query("join_j06_point_not_in_region", f"{_FL} select read_id, chrom, pos from pts where not {_EXISTS}")
def point_not_in_region(spark, sf_dir):
    return I.in_regions(_points(spark, sf_dir), I.collapse(flank_table(spark, sf_dir)), inside=False)


@R.query(
    "join_j01_known_in_flanks",
    f"with {MARKERS}, {FLANKS}, known as (select distinct {norm('k.chrom')} as chrom, k.pos + 100 as pos from contigs k) "
    'select chrom, pos from known where exists (select 1 from flanks f where f.chrom = known.chrom and known.pos between f.beg and f."end")',
)
def known_in_flanks(spark, sf_dir):
    known = marker_table(spark, sf_dir).select("chrom", (F.col("pos") + 100).alias("pos")).distinct()
    return I.in_regions(known, flank_table(spark, sf_dir))


_WIN = f'with {MARKERS}, {ALN}, {POINTS}, w as (select name, chrom, pos - flank as beg, pos + flank as "end" from markers), reg as (select distinct {norm("chrom")} as chrom, pos as beg, pos + 120 as "end" from aln where pos > 0), {collapsed("reg", "c")}'


def _callable(spark, sf_dir):
    points = _points(spark, sf_dir).filter("pos > 0").select("chrom", "pos").distinct()
    return I.collapse(points.select("chrom", F.col("pos").alias("beg"), (F.col("pos") + 120).alias("end")))


@R.query(
    "join_j16_callable_overlap",
    f'{_WIN} select w.name, w.chrom, w.beg, w."end", cast(coalesce(sum(case when c.beg is not null then least(w."end", c."end") - greatest(w.beg, c.beg) end), 0) as bigint) as overlap, '
    'coalesce(sum(case when c.beg is not null then least(w."end", c."end") - greatest(w.beg, c.beg) end), 0) >= 0.995 * (w."end" - w.beg + 1) as ok '
    'from w left join c on w.chrom = c.chrom and greatest(w.beg, c.beg) <= least(w."end", c."end") group by w.name, w.chrom, w.beg, w."end"',
)
def callable_overlap(spark, sf_dir):
    return I.covered(flank_table(spark, sf_dir), _callable(spark, sf_dir), "name")


@R.query("flt_p06_callable_markers", f"{_WIN} select w.name from w join c on w.chrom = c.chrom and greatest(w.beg, c.beg) <= least(w.\"end\", c.\"end\") group by w.name, w.beg, w.\"end\" having sum(least(w.\"end\", c.\"end\") - greatest(w.beg, c.beg)) >= 0.1 * (w.\"end\" - w.beg + 1)")
def callable_markers(spark, sf_dir):
    return I.covered(flank_table(spark, sf_dir), _callable(spark, sf_dir), "name", 0.1).filter("ok").select("name")


_READ_WINDOWS = f'rw as (select read_id, {norm("chrom")} as chrom, pos as beg, cast(pos + length(seq) as int) as "end" from aln where pos > 0 and seq is not null)'


@R.query(
    "join_j17_overlap_half_open",
    f'with {MARKERS}, {ALN}, mk as (select distinct chrom, pos - 1 as beg, pos as "end" from markers), {_READ_WINDOWS} '
    'select read_id, chrom, beg, "end" from rw where exists (select 1 from mk where mk.chrom = rw.chrom and rw.beg < mk."end" and mk.beg < rw."end")',
)
def overlap_half_open(spark, sf_dir):
    reads = placed(spark, sf_dir).filter("pos > 0 and seq is not null")
    reads = reads.select("read_id", keys.chrom("chrom").alias("chrom"), F.col("pos").alias("beg"), (F.col("pos") + F.length("seq")).alias("end"))
    markers = marker_table(spark, sf_dir).select("chrom", (F.col("pos") - 1).alias("beg"), F.col("pos").alias("end")).distinct()
    return I.overlapping(reads, markers, half_open=True)


_NEAR = f"""with {MARKERS}, {ALN}, mk as (select chrom, pos, max(flank) as flank, min(name) as name from markers group by 1, 2),
    p as (select read_id, {norm('chrom')} as chrom, pos, cast(pos + coalesce(list_sum(list_transform(cigar, lambda c: case when c.op in ('M', 'D', 'N', '=', 'X') then c.len else 0 end)), 1) - 1 as int) as stop from aln where pos is not null and chrom is not null),
    l as (select p.read_id, max(m.pos) as left_pos from p join mk m on m.chrom = p.chrom and m.pos <= p.pos and m.pos >= p.pos - 1500 group by 1),
    r as (select p.read_id, min(m.pos) as right_pos from p join mk m on m.chrom = p.chrom and m.pos > p.pos and m.pos <= p.pos + 1500 group by 1),
    o as (select p.*, l.left_pos, r.right_pos, case when a.pos is not null then least(p.stop, a.pos + a.flank) - greatest(p.pos, a.pos - a.flank) + 1 end as left_overlap, case when b.pos is not null then least(p.stop, b.pos + b.flank) - greatest(p.pos, b.pos - b.flank) + 1 end as right_overlap, a.name as left_name, b.name as right_name
      from p left join l using (read_id) left join r using (read_id) left join mk a on a.chrom = p.chrom and a.pos = l.left_pos left join mk b on b.chrom = p.chrom and b.pos = r.right_pos)"""


@R.query("join_j04_nearest_markers", f"{_NEAR} select read_id, chrom, pos, left_pos, right_pos from o")
def nearest_markers(spark, sf_dir):
    return I.nearest(_points(spark, sf_dir), marker_table(spark, sf_dir), "read_id", 1500)


@R.query(
    "join_j04_chosen_marker",
    f"""{_NEAR} select read_id, case when coalesce(left_overlap, 0) >= coalesce(right_overlap, 0) then left_name else right_name end as name, cast(greatest(coalesce(left_overlap, 0), coalesce(right_overlap, 0)) as int) as overlap
    from o where greatest(coalesce(left_overlap, 0), coalesce(right_overlap, 0)) > 0""",
)
def chosen_marker(spark, sf_dir):
    """Of the markers left and right of a read the one whose flank it overlaps more; reads that overlap neither are rejected."""
    reads = placed(spark, sf_dir).filter("pos is not null and chrom is not null")
    length = F.coalesce(sequence.reference_length("cigar"), F.lit(1))
    reads = reads.select("read_id", keys.chrom("chrom").alias("chrom"), "pos", (F.col("pos") + length - 1).alias("end"))
    return I.chosen(reads, marker_table(spark, sf_dir), "read_id", 1500).select("read_id", "name", "overlap")


@R.query(
    "join_j05_bases_at_markers",
    f"with {MARKERS}, {BASES} select b.read_id, b.chrom, b.pos, b.base, b.qual from bases b where exists (select 1 from markers m where m.chrom = b.chrom and m.pos = b.pos)",
)
def bases_at_markers(spark, sf_dir):
    return marker_base_table(spark, sf_dir).select("read_id", "chrom", "pos", "base", "qual")


_PLAIN = r"regexp_replace(split_part({0}, ' ', 1), '[/\\][12]$', '')"


@R.query(
    "join_j07_mates_by_index",
    f"""with {READS} select a.file_id, a.read_idx, a.read_id as read_id_1, a.name as name_1, b.read_id as read_id_2, b.name as name_2,
    {_PLAIN.format('a.name')} is not distinct from {_PLAIN.format('b.name')} as same_name
    from reads a join reads b on a.file_id = b.file_id and a.read_idx = b.read_idx and a.mate = 1 and b.mate = 2""",
)
def mates_by_index(spark, sf_dir):
    return PR.mates(read_table(spark, sf_dir))


@R.query(
    "join_j08_singletons",
    f"with {READS}, n as (select file_id, read_idx, count(distinct mate) as mates from reads group by 1, 2) select read_id, file_id, mate, read_idx from reads join n using (file_id, read_idx) where mates = 1",
)
def singletons(spark, sf_dir):
    return PR.singletons(read_table(spark, sf_dir)).select("read_id", "file_id", "mate", "read_idx")


@R.query(
    "join_j10_markers_with_depth",
    f"with {MARKERS}, {BASES}, {DEPTH} select m.name, m.chrom, m.pos, d.depth from markers m join depth d using (chrom, pos)",
)
def markers_with_depth(spark, sf_dir):
    return marker_table(spark, sf_dir).join(B.depth(marker_base_table(spark, sf_dir)), ["chrom", "pos"]).select("name", "chrom", "pos", "depth")


@R.query(
    "join_j11_depth_with_gc",
    f"""with {BASES}, {DEPTH}, gc as (select chrom, pos, cast(floor(100 * count(*) filter (ref_base in ('G', 'C')) / count(*)) as int) as gc from bases where cycle < 50 group by 1, 2)
    select d.chrom, d.pos, d.depth, coalesce(g.gc, 0) as gc from depth d left join gc g using (chrom, pos)""",
)
def depth_with_gc(spark, sf_dir):
    bases = base_table(spark, sf_dir)
    gc = bases.filter("cycle < 50").groupBy("chrom", "pos").agg(F.floor(100 * F.count_if(F.col("ref_base").isin("G", "C")) / F.count(F.lit(1))).cast("int").alias("gc"))
    return B.depth(bases).join(gc, ["chrom", "pos"], "left").fillna(0, ["gc"]).select("chrom", "pos", "depth", "gc")


@R.query(
    "join_j13_offset_to_contig",
    """with q as (select rec_id, (rec_id * 977) % 800000 as place from sam_records group by rec_id)
    select rec_id, place, c.reference_id, place - c.contig_offset as within from q join contigs c on place >= c.contig_offset and place < c.contig_offset + c.contig_len""",
)
def offset_to_contig(spark, sf_dir):
    points = table(spark, sf_dir, "sam_records").select("rec_id").distinct().withColumn("place", (F.col("rec_id") * 977) % 800000)
    return locate(points, table(spark, sf_dir, "contigs"), "place").select("rec_id", "place", "reference_id", "within")


@R.query(
    "join_j21_excluded_positions",
    f"with {MARKERS}, {ALN}, p as (select read_id, {norm('chrom')} as chrom, pos from aln), x as (select chrom, pos from p where pos > 0 group by 1, 2 having count(*) >= 20) select read_id, chrom, pos from p where not exists (select 1 from x where x.chrom = p.chrom and x.pos = p.pos)",
)
def excluded_positions(spark, sf_dir):
    points = _points(spark, sf_dir)
    hot = points.filter("pos > 0").groupBy("chrom", "pos").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20").select("chrom", "pos")
    return points.join(hot, ["chrom", "pos"], "left_anti").select("read_id", "chrom", "pos")


@R.query(
    "join_j12_panel_at_selected",
    f"with {MARKERS} select name, chrom, pos from markers where exists (select 1 from sam_records s where s.reference_id = (select c.reference_id from contigs c where c.name = markers.name) and s.mapq >= 20 and s.mapq <> 255)",
)
def panel_at_selected(spark, sf_dir):
    seen = table(spark, sf_dir, "sam_records").filter("mapq >= 20 and mapq <> 255").select("reference_id").distinct()
    used = table(spark, sf_dir, "contigs").join(seen, "reference_id", "left_semi").select("name")
    return marker_table(spark, sf_dir).join(used, "name", "left_semi").select("name", "chrom", "pos")


@R.query(
    "join_j14_sample_populations",
    "select 'v' || e.vec_id as sample, round(e.embedding[1]::double, 6) as pc1, p.population from embeddings e left join (select vec_id, 'pop' || label as population from embeddings where label <> 3) p using (vec_id)",
)
def sample_populations(spark, sf_dir):
    """Samples with the population of a list of labels; samples that are not listed have none."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("sample"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("pc1"))
    lines = e.filter("label <> 3").select(F.concat("sample", F.lit(" pop"), F.col("label").cast("string")).alias("value"))
    return e.join(TX.populations(lines), "sample", "left").select("sample", "pc1", "population")


@R.query(
    "join_j15_positional_zip",
    "with a as (select reference_id as i, name from contigs), b as (select reference_id as i, pos from contigs), c as (select reference_id as i, contig_len from contigs) select i, name, pos, contig_len from a join b using (i) join c using (i)",
)
def positional_zip(spark, sf_dir):
    contigs = table(spark, sf_dir, "contigs").withColumnRenamed("reference_id", "i")
    return zipped([contigs.select("i", "name"), contigs.select("i", "pos"), contigs.select("i", "contig_len")], "i")


@R.query(
    "win_w08_neighbour_distance",
    f"with {MARKERS} select name, chrom, pos, pos - lag(pos) over w as before, lead(pos) over w - pos as after from (select min(name) as name, chrom, pos from markers group by chrom, pos) window w as (partition by chrom order by pos)",
)
def neighbour_distance(spark, sf_dir):
    marks = marker_table(spark, sf_dir).groupBy("chrom", "pos").agg(F.min("name").alias("name"))
    return I.neighbour_distance(marks).select("name", "chrom", "pos", "before", "after")

