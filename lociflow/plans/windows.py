"""Queries of window-like operators, ordering, top-k, set operations and report tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociflow.operators import bases as B
from lociflow.operators import hits as H
from lociflow.operators import kmers as K
from lociflow.operators import markers as M
from lociflow.operators import ordered as OD
from lociflow.operators import pairs as PR
from lociflow.operators import report as RP
from lociflow.operators import selecting as S
from lociflow.operators import sweep as SW
from lociflow.plans.aggregates import SQL_ADJUSTED
from lociflow.plans.domain import ALN, BASES, DEPTH, MARKERS, READS, base_table, marker_base_table, marker_table, pair_table, placed, read_table, segment_table
from lociflow.plans.registry import Registry
from lociflow.session import table
from lociflow.streaming.jobs import place

R = Registry()
QUERIES, SQL = R.queries, R.sql

_GCW = """, u as (select read_id, upper(seq) as s, length(seq) as n from aln where length(seq) > 0), p as (select read_id, s, n, unnest(range(1, n + 1)) as i from u),
w as (select read_id, n, i, count(*) filter (substr(s, i::int, 1) in ('G', 'C')) over v as gc, count(*) over v as c from p window v as (partition by read_id order by i rows between 50 preceding and 49 following))"""


@R.query("win_w01_gc_window", f"with {ALN}{_GCW} select read_id, cast(i as int) as at, cast(floor(100 * gc / c) as int) as gc from w")
def gc_window(spark, sf_dir):
    return M.gc_window(placed(spark, sf_dir), "read_id", "seq")


@R.query(
    "win_w02_carried_forward",
    "select event_id, last_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and current row) as carried from events",
)
def carried_forward(spark, sf_dir):
    return OD.carried(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", "value > 50").select("event_id", "carried")


_FOLD = """with recursive d as (select cast(abs(insert_size::bigint) // 50 as int) as k, count(*) filter (mapq >= 20) as seen, count(*) filter (mapq < 20) as cut from sam_records where insert_size <> 0 and abs(insert_size::bigint) < 2000 and mapq is not null group by 1),
c as (select b.k, coalesce(seen, 0) as seen, coalesce(cut, 0) as cut from (select unnest(range(40)) as k) b left join d using (k)), n as (select sum(seen + cut)::double as n from c),
r as (select 0 as k, (seen + 1e-6) / n as f, (seen + 1e-6) / n as ff, (cut + 1e-6) / (1 - (seen + 1e-6) / n) / n as gg from c, n where k = 0
  union all select k, f, ff + f, gg + (cut + 1e-6) / (1 - (ff + f)) / n from (select c.k, (c.seen + 1e-6) / (1 - r.gg) / n as f, r.ff, r.gg, c.cut, n from r join c on c.k = r.k + 1, n))"""


@R.query("win_w03_running_sums", f"{_FOLD} select cast(k as int) as k, round(f, 9) as density, round(ff, 9) as upto_seen, round(gg, 9) as upto_cut from r")
def running_sums(spark, sf_dir):
    """Two running sums that feed each other: sizes seen with good quality, and those cut off by a bad one, in bins of 50."""
    size = F.abs(F.col("insert_size").cast("bigint"))
    rows = table(spark, sf_dir, "sam_records").filter("insert_size <> 0 and mapq is not null").filter(size < 2000)
    counts = rows.groupBy(F.floor(size / 50).cast("int").alias("k")).agg(F.count_if(F.col("mapq") >= 20).alias("seen"), F.count_if(F.col("mapq") < 20).alias("cut"))
    rounded = [F.round(c, 9).alias(c) for c in ("density", "upto_seen", "upto_cut")]
    return PR.adjusted(counts, 40).select("k", *rounded)


_HIST = "h as (select mapq, count(*) as n, avg(pos % 101) as gc from alignments where mapq between 0 and 254 group by 1)"


def _histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "alignments").filter("mapq between 0 and 254")
    return rows.groupBy("mapq").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("pos") % 101).alias("gc"))


@R.query(
    "win_w04_cumulative_share",
    f"with {_HIST} select mapq, n, round(100 * sum(n) over w / sum(n) over (), 6) as share, round(sum(n * gc) over w / sum(n) over w, 6) as running from h window w as (order by mapq)",
)
def cumulative_share(spark, sf_dir):
    return RP.cumulative_share(_histogram(spark, sf_dir), "mapq", "n", "gc").select("mapq", "n", "share", "running")


_DEPTHS = f"with {BASES}, {DEPTH}, h as (select depth, count(*) as n from depth group by depth)"


def _depth_hist(spark, sf_dir):
    return SW.depth_counts(segment_table(spark, sf_dir)).withColumnRenamed("sites", "n")


@R.query("win_w06_rebinned", f"{_DEPTHS} select cast(min(depth) as bigint) as depth, cast(sum(n) as bigint) as n from h group by (depth - (select min(depth) from h)) // 10")
def rebinned(spark, sf_dir):
    return RP.rebinned(_depth_hist(spark, sf_dir), "depth", "n")


@R.query(
    "win_w07_turning_points",
    f"""with {_HIST}, m as (select mapq as mode, n as top from h order by n desc, mapq limit 1), s as (select h.*, mode, top, case when mapq >= mode then 1 else -1 end as side from h, m),
    r as (select *, case when n > 1.2 * coalesce(lag(n) over (partition by side order by abs(mapq - mode)), top) then 1 else 0 end as rise from s),
    c as (select *, sum(rise) over (partition by side order by abs(mapq - mode) rows between unbounded preceding and current row) as k from r) select mapq, n from c where k < 3""",
)
def turning_points(spark, sf_dir):
    return RP.turning_points(_histogram(spark, sf_dir).select("mapq", "n"), "mapq", "n")


_ALLELES = f"""with {MARKERS}, {ALN}, own as (select m.name, m.ref, m.alt, arg_min(upper(a.seq), a.read_id) as s from aln a join markers m on m.name = a.contig where length(a.seq) >= 64 group by 1, 2, 3),
al as (select name, unnest(['ref', 'alt']) as allele, unnest([substr(s, 1, length(s) // 2) || ref || substr(s, length(s) // 2 + 2), substr(s, 1, length(s) // 2) || alt || substr(s, length(s) // 2 + 2)]) as s from own),
st as (select name, allele, unnest([false, true]) as reverse, unnest([s, translate(reverse(s), 'ACGT', 'TGCA')]) as s from al)"""


@R.query("win_w09_rolling_kmers", f"{_ALLELES} select name, allele, reverse, cast(i as int) as at, substr(s, i::int, 32) as kmer from (select *, unnest(range(1, length(s) - 30)) as i from st)")
def rolling_kmers(spark, sf_dir):
    """All 32-mers of each marker's sequence with either allele in its middle, on both strands; a read stands for the sequence."""
    marks = marker_table(spark, sf_dir).select(F.col("name").alias("contig"), "ref", "alt")
    rows = placed(spark, sf_dir).filter("length(seq) >= 64").join(marks, "contig")
    own = rows.groupBy(F.col("contig").alias("name"), "ref", "alt").agg(F.min_by("seq", "read_id").alias("seq"))
    return K.rolling(K.both_alleles(own, "name", "seq", "ref", "alt"), ["name", "allele", "reverse"], "seq")


@R.query("win_w10_first_wins", "select rec_id, loaded_at from (select rec_id, loaded_at, row_number() over (partition by rec_id order by loaded_at) as k from sam_records) where k = 1")
def first_wins(spark, sf_dir):
    return table(spark, sf_dir, "sam_records").groupBy("rec_id").agg(F.min("loaded_at").alias("loaded_at"))


@R.query(
    "win_w11_sort_check",
    """with u as (select distinct on (rec_id) * from sam_records order by rec_id, loaded_at), l as (select rec_id, file_id, case when reference_id < 0 then 1073741824 else reference_id end as r, pos as p from u),
    g as (select *, lag(r) over w as lr, lag(p) over w as lp, lag(rec_id) over w as lid from l window w as (partition by file_id order by rec_id))
    select rec_id, lid is null or (case when lr is null then true when r is null then false when r <> lr then r > lr when lp is null then true when p is null then false else p >= lp end) as sorted from g""",
)
def sort_check(spark, sf_dir):
    rows = table(spark, sf_dir, "sam_records").select("rec_id", "file_id", "reference_id", "pos").dropDuplicates(["rec_id"])
    return S.out_of_order(rows, "file_id", "rec_id").select("rec_id", "sorted")


@R.query(
    "win_w12_batch_fallback",
    """with b as (select file_id, cast(recorded_at as date) as day, count(*) as n, round(avg(case when insert_size between 1 and 5000 then insert_size end), 6) as mean from sam_records group by 1, 2)
    select file_id, day, last_value(case when n >= 40 then mean end ignore nulls) over (partition by file_id order by day rows between unbounded preceding and current row) as used from b""",
)
def batch_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "sam_records").groupBy("file_id", F.to_date("recorded_at").alias("day"))
    batch = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("insert_size").between(1, 5000), F.col("insert_size"))), 6).alias("mean"))
    return OD.carried(batch, ["file_id"], "day", "mean", "n >= 40").select("file_id", "day", F.col("carried").alias("used"))


@R.query(
    "win_w13_interpolated",
    f"""with {_HIST}, g as (select i * 2.5 as x from range(0, 41) t(i)), l as (select g.x, max(h.mapq) as lx from g left join h on h.mapq <= g.x group by g.x), r as (select g.x, min(h.mapq) as rx from g left join h on h.mapq >= g.x group by g.x)
    select cast(l.x as double) as x, round(case when lx is null then b.n when rx is null then a.n when lx = rx then a.n else a.n + (l.x - lx) / (rx - lx) * (b.n - a.n) end, 6) as y
    from l join r using (x) left join h a on a.mapq = lx left join h b on b.mapq = rx""",
)
def interpolated(spark, sf_dir):
    grid = F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: i * F.lit(2.5))
    return RP.interpolated(_histogram(spark, sf_dir), "mapq", "n", grid)


@R.query("srt_o01_by_position", f"with {MARKERS} select name, chrom, pos, row_number() over (order by chrom, pos, name) as place from markers")
def by_position(spark, sf_dir):
    """Order by chromosome as text and position, with the place from per-chromosome counts: no global window."""
    marks = marker_table(spark, sf_dir)
    counts = marks.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))  # a row per chromosome
    before = counts.withColumn("_before", F.sum("n").over(Window.orderBy("chrom")) - F.col("n")).drop("n")
    own = marks.withColumn("_k", F.row_number().over(Window.partitionBy("chrom").orderBy("pos", "name")))
    return own.join(before, "chrom").select("name", "chrom", "pos", (F.col("_before") + F.col("_k")).alias("place")).orderBy("place")


_TARGET = "(pos % 5 = 0)"


@R.query(
    "srt_o02_marker_quota",
    f"""with {MARKERS}, m as (select *, {_TARGET} as hit from markers), a as (select *, row_number() over (order by hit desc, chrom, pos, name) as k from m where chrom not in ('X', 'Y')), s as (select *, row_number() over (partition by chrom order by hit desc, pos, name) as k from m where chrom in ('X', 'Y'))
    select name, case when k <= 100 then 'long' else 'short' end as class, hit as in_target from a where k <= 800 union all select name, lower(chrom), hit from s where k <= 20""",
)
def marker_quota(spark, sf_dir):
    """Quotas of a run over markers in target regions first, then over the others."""
    marks = marker_table(spark, sf_dir)
    target = marks.filter(_TARGET).select("chrom", F.col("pos").alias("beg"), F.col("pos").alias("end"))
    return M.with_quota(M.targeted(marks, target), 100, 700, 20).select("name", "class", "in_target")


@R.query("srt_o03_text_then_number", "select distinct chrom, pos from alignments where pos > 0 and chrom is not null")
def text_then_number(spark, sf_dir):
    return table(spark, sf_dir, "alignments").filter("pos > 0 and chrom is not null").select("chrom", "pos").distinct().orderBy("chrom", "pos")


@R.query("srt_o04_coordinate_sort", "select distinct rec_id, reference_id, pos from sam_records")
def coordinate_sort(spark, sf_dir):
    """Coordinate order by range partitions: a total order without one task seeing all rows."""
    rows = table(spark, sf_dir, "sam_records").select("rec_id", "reference_id", "pos").distinct()
    place = F.when(F.col("reference_id") < 0, 1 << 30).otherwise(F.col("reference_id"))
    return rows.withColumn("_r", place).repartitionByRange("_r", "pos", "rec_id").sortWithinPartitions("_r", "pos", "rec_id").drop("_r")


_HITS = "hits as (select distinct rec_id, read_id, mapq from sam_records where read_id is not null and mapq is not null and mapq <> 255)"


def _hits(spark, sf_dir):
    return table(spark, sf_dir, "sam_records").filter("read_id is not null and mapq is not null and mapq <> 255").select("rec_id", "read_id", "mapq").distinct()


@R.query("srt_o05_best_two", f"with {_HITS} select rec_id, read_id, mapq from (select *, dense_rank() over (partition by read_id order by mapq) as k from hits) where k <= 2")
def best_two(spark, sf_dir):
    return H.best_two(_hits(spark, sf_dir), "read_id", "mapq")


@R.query("srt_o06_alternatives", f"with {_HITS} select rec_id, read_id, mapq from (select *, row_number() over (partition by read_id order by mapq, rec_id) - 1 as k, count(*) over (partition by read_id) - 1 as c from hits) where k between 1 and 3 and c <= 10")
def alternatives(spark, sf_dir):
    return H.alternatives(_hits(spark, sf_dir), "read_id", "mapq", "rec_id", 3, 10).select("rec_id", "read_id", "mapq")


@R.query("srt_o07_sorted_sizes", "select file_id, cast(recorded_at as date) as day, list(abs(insert_size::bigint) order by abs(insert_size::bigint)) as sizes from sam_records where insert_size <> 0 group by 1, 2")
def sorted_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "sam_records").filter("insert_size <> 0")
    return rows.groupBy("file_id", F.to_date("recorded_at").alias("day")).agg(F.sort_array(F.collect_list(F.abs(F.col("insert_size").cast("bigint")))).alias("sizes"))


@R.query("srt_o09_depth_cap", f"with {MARKERS}, {BASES}, c as (select b.*, row_number() over (partition by b.chrom, b.pos order by read_id, cycle) as k from bases b where exists (select 1 from markers m where m.chrom = b.chrom and m.pos = b.pos)) select chrom, pos, count(*) as depth from c where k <= 250 group by 1, 2")
def depth_cap(spark, sf_dir):
    return B.pileup(marker_base_table(spark, sf_dir), cap=250).select("chrom", "pos", "depth")


@R.query("srt_o10_first_components", "select vec_id, list_transform(embedding[1:4], lambda x: round(x::double, 6)) as pc from embeddings")
def first_components(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 6)).alias("pc"))


@R.query("set_u04_concatenated", f"with {MARKERS} select name, chrom, pos from markers")
def concatenated(spark, sf_dir):
    """The markers of each chromosome written to a folder of its own, and all folders read as one."""
    at = place(spark, "chromosomes")
    marker_table(spark, sf_dir).select("name", "chrom", "pos").write.partitionBy("chrom").parquet(at)
    return spark.read.schema("name string, pos int, chrom string").parquet(at).select("name", "chrom", "pos")


_RAW = "raw as (select obs as k, count(*) as n from pairs where status in ('PropPair', 'PartialPair') and obs between 0 and 1999 group by obs)"


def _both_curves(spark, sf_dir):
    """``category, k, value``: counts of observed sizes, and their densities corrected for censoring."""
    pairs = pair_table(spark, sf_dir)
    raw = pairs.filter("status in ('PropPair', 'PartialPair') and obs between 0 and 1999").groupBy(F.col("obs").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return RP.stacked({"raw": raw, "adjusted": PR.adjusted_insert(pairs).withColumnRenamed("density", "value")}, ["k", "value"])


_ADJ = SQL_ADJUSTED[SQL_ADJUSTED.index("with recursive ") + len("with recursive ") : SQL_ADJUSTED.rindex("select cast(a.k")]
_CURVES = f"with recursive {_ADJ}, {_RAW}, both_ as (select 'raw' as category, cast(k as int) as k, n::double as value from raw union all select 'adjusted', cast(a.k as int), round(a.f + b.f, 9) from fa_r a join fb_r b using (k))"


@R.query("set_u06_stacked", f"{_CURVES} select category, k, value from both_")
def stacked(spark, sf_dir):
    return _both_curves(spark, sf_dir)


@R.query("set_u07_distinct_sorted", "select read_id, list_sort(list_distinct(list(mapq))) as mapqs from sam_records where read_id is not null and mapq is not null group by read_id")
def distinct_sorted(spark, sf_dir):
    rows = table(spark, sf_dir, "sam_records").filter("read_id is not null and mapq is not null")
    return rows.groupBy("read_id").agg(F.sort_array(F.collect_set("mapq")).alias("mapqs"))


@R.query("set_u08_panel_and_sample", "select vec_id as sample, label, false as is_user from embeddings union all select -1, null, true")
def panel_and_sample(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), "label", F.lit(False).alias("is_user"))
    return own.unionByName(spark.createDataFrame([(-1, None, True)], "sample bigint, label int, is_user boolean"))


@R.query(
    "rep_r01_depth_rows",
    f"""{_DEPTHS}, b as (select depth, n from h where depth between 1 and 149), m as (select depth as mode, n as top from b order by n desc, depth limit 1),
    s as (select b.*, mode, top, case when depth >= mode then 1 else -1 end as side from b, m), r as (select *, case when n > 1.2 * coalesce(lag(n) over (partition by side order by abs(depth - mode)), top) then 1 else 0 end as rise from s),
    c as (select *, sum(rise) over (partition by side order by abs(depth - mode) rows between unbounded preceding and current row) as k from r)
    select depth, n, k < 3 as zoomed from c""",
)
def depth_rows(spark, sf_dir):
    """Rows 1 to 149, and which of them the zoomed plot shows: up to the third turning point on each side of the mode."""
    return RP.zoomed(_depth_hist(spark, sf_dir).filter("depth between 1 and 149"), "depth", "n")


_CYC = f"with {BASES}, c as (select cast(g.cycle as int) as cycle, coalesce(n, 0) as n from (select unnest(range(250)) as cycle) g left join (select cycle, count(*) as n from bases group by 1) b using (cycle))"


@R.query("rep_r02_cycle_rows", f"{_CYC} select cycle, n from c where cycle <= 150 and cycle < coalesce((select min(cycle) from c where n = 0), 1000)")
def cycle_rows(spark, sf_dir):
    counts = base_table(spark, sf_dir).groupBy("cycle").agg(F.count(F.lit(1)).alias("n"))
    return RP.until_empty(B.filled(counts, "cycle", 250, ["n"]), "cycle", "n", 150)


@R.query("rep_r03_quality_rows", f"with {BASES} select qual, count(*) as n from bases where qual between 0 and 39 group by qual")
def quality_rows(spark, sf_dir):
    return base_table(spark, sf_dir).filter("qual between 0 and 39").groupBy("qual").agg(F.count(F.lit(1)).alias("n"))


@R.query(
    "rep_r04_gc_curve",
    f"""with {_HIST}, c as (select *, 100 * sum(n) over w / sum(n) over () as share, sum(n * gc) over w / sum(n) over w as running from h window w as (order by mapq)),
    p as (select round(share, 6) as share, round(running, 6) as running from c), g as (select i * 0.05::double as x from range(0, 2001) t(i)),
    l as (select g.x, max(p.share) as lx from g left join p on p.share <= g.x group by g.x), r as (select g.x, min(p.share) as rx from g left join p on p.share >= g.x group by g.x)
    select round(l.x, 2) as percentile, round(case when lx is null then b.running when rx is null then a.running when lx = rx then a.running else a.running + (l.x - lx) / (rx - lx) * (b.running - a.running) end, 6) as gc
    from l join r using (x) left join p a on a.share = lx left join p b on b.share = rx""",
)
def gc_curve(spark, sf_dir):
    """The running mean at each twentieth of a percent of the cumulative share."""
    curve = RP.cumulative_share(_histogram(spark, sf_dir), "mapq", "n", "gc")
    grid = F.transform(F.sequence(F.lit(0), F.lit(2000)), lambda i: i * F.lit(0.05))
    return RP.interpolated(curve, "share", "running", grid).select(F.round("x", 2).alias("percentile"), F.col("y").alias("gc"))


@R.query(
    "rep_r05_insert_curves",
    f"{_CURVES}, w as (select category, k // 10 as bin, sum(value) as value from both_ group by 1, 2) select category, cast(bin as int) as bin, round(value, 6) as value, round(value / sum(value) over (partition by category), 6) as share from w",
)
def insert_curves(spark, sf_dir):
    """Observed and corrected sizes in bins of ten, each as a share of its curve."""
    bins = _both_curves(spark, sf_dir).groupBy("category", F.floor(F.col("k") / 10).cast("int").alias("bin")).agg(F.sum("value").alias("value"))
    return RP.normalised(bins, "value", "category").select("category", "bin", F.round("value", 6).alias("value"), F.round("share", 6).alias("share"))


@R.query("rep_r07_ancestry_table", "select vec_id as sample, round(embedding[1]::double, 6) as pc1, round(embedding[2]::double, 6) as pc2, 'pop' || label as population, false as is_user from embeddings union all select -1, 0.01, 0.01, null, true")
def ancestry_table(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    pc = lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)
    own = e.select(F.col("vec_id").alias("sample"), pc(1).alias("pc1"), pc(2).alias("pc2"))
    labels = e.select(F.col("vec_id").alias("sample"), F.concat(F.lit("pop"), F.col("label").cast("string")).alias("population"))
    user = spark.createDataFrame([(-1, 0.01, 0.01)], "sample bigint, pc1 double, pc2 double").withColumn("is_user", F.lit(True))
    return own.withColumn("is_user", F.lit(False)).unionByName(user).join(labels, "sample", "left").select("sample", "pc1", "pc2", "population", "is_user")


