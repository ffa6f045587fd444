"""Queries of numerical models, placing of reads and streaming forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lociflow.functions import sequence
from lociflow.operators import mapper as MP
from lociflow.operators import mixture as MX
from lociflow.operators import panel as P
from lociflow.plans.domain import ALN, BASES, MARKERS, READS, marker_base_table, marker_table, placed, read_table
from lociflow.plans.registry import Registry
from lociflow.session import cut, table
from lociflow.streaming import jobs

R = Registry()
QUERIES, SQL = R.queries, R.sql
PC1, PC2, ALPHA = [0.3, -0.2], [-0.1, 0.25], 0.05


@R.query(
    "num_m03_gram",
    """with e as (select vec_id, list_avg(embedding::double[]) as m, embedding from embeddings), x as (select vec_id, generate_subscripts(embedding, 1) - 1 as d, unnest(embedding)::double - m as x from e)
    select cast(a.d as int) as i, cast(b.d as int) as j, round(sum(a.x * b.x), 4) as product from x a join x b on a.vec_id = b.vec_id and a.d <= b.d group by a.d, b.d""",
)
def gram(spark, sf_dir):
    centred = P.row_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return P.gram(centred, "centred").select("i", "j", F.round("product", 4).alias("product"))


@R.query("num_m03_svd")
def svd(spark, sf_dir):
    """``component, singular_value, share`` of the ten largest."""
    centred = P.row_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    d, _ = P.truncated_svd(centred, "centred", 10)
    total = centred.agg(F.sum(F.aggregate("centred", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 1.0  # of all components
    return spark.createDataFrame([(i + 1, float(x), float(x * x / total)) for i, x in enumerate(d)], "component int, singular_value double, share double")


_CENTRED = "with e as (select vec_id, list_avg(embedding::double[]) as m, embedding from embeddings), x as (select vec_id, generate_subscripts(embedding, 1) - 1 as d, unnest(embedding)::double - m as x from e)"


@R.query(
    "num_m03_spectrum",
    f"{_CENTRED}, g as (select a.d as i, b.d as j, sum(a.x * b.x) as p from x a join x b on a.vec_id = b.vec_id group by 1, 2) select round(sum(p) filter (i = j), 3) as squares, round(sum(p * p) / 1000, 3) as fourth_powers from g",
)
def spectrum(spark, sf_dir):
    """All singular values together: the sum of their squares and (in thousands) of their fourth powers."""
    centred = P.row_means(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    d, _ = P.truncated_svd(centred, "centred", P.MOST_COLUMNS)
    return spark.createDataFrame([(round(float((d**2).sum()), 3), round(float((d**4).sum()) / 1000, 3))], "squares double, fourth_powers double")


@R.query("num_m03_loadings", f"{_CENTRED} select vec_id, round(sum(x * x), 4) as squares from x group by vec_id")
def loadings(spark, sf_dir):
    """Squared length of each row's loadings on all components, which is that of the centred row."""
    built, _, _ = P.build_panel(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", P.MOST_COLUMNS)
    return built.select("vec_id", F.round(F.aggregate("ud", F.lit(0.0), lambda a, x: a + x * x), 4).alias("squares"))


@R.query("snk_k22_panel_tables")
def panel_tables(spark, sf_dir):
    """Loadings and mean of each row, ten components."""
    panel, _, _ = P.build_panel(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return panel.select("vec_id", "mu", "ud")


def panel_of(spark, sf_dir):
    """A panel over the markers: two loadings and a mean from the embeddings."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pc = lambda i: F.element_at("embedding", i).cast("double")
    e = e.select(F.col("vec_id").alias("_v"), F.array(pc(1), pc(2)).alias("ud"), (0.6 + pc(3)).alias("mu"))
    ids = table(spark, sf_dir, "contigs").select("name", F.col("reference_id").cast("bigint").alias("marker_idx"))
    marks = marker_table(spark, sf_dir).join(ids, "name").withColumn("_v", F.col("marker_idx") % 500)
    first = marks.groupBy("chrom", "pos").agg(F.min_by(F.struct("ref", "alt", "marker_idx", "_v"), "name").alias("m")).select("chrom", "pos", "m.*")
    return first.join(e, "_v").select("marker_idx", "chrom", "pos", "ref", "alt", "mu", "ud")


_PANEL = f"""{MARKERS}, {BASES}, pm as (select distinct on (m.chrom, m.pos) m.chrom, m.pos, m.ref, m.alt, c.reference_id::bigint as marker_idx from markers m join contigs c using (name) order by m.chrom, m.pos, m.name),
panel as (select pm.*, 0.6 + e.embedding[3]::double as mu, e.embedding[1]::double as u1, e.embedding[2]::double as u2 from pm join embeddings e on e.vec_id = pm.marker_idx % 500),
suff as (select marker_idx, case when base = ref then 0 when base = alt then 1 else 2 end as kind, qual, count(*) as n from bases join pm using (chrom, pos) where qual is not null group by 1, 2, 3)"""


def counts_of(spark, sf_dir):
    return MX.sufficient(marker_base_table(spark, sf_dir).filter("qual is not null"), panel_of(spark, sf_dir))


@R.query("num_a18_sufficient_counts", f"with {_PANEL} select marker_idx, kind, qual, n from suff")
def sufficient_counts(spark, sf_dir):
    return counts_of(spark, sf_dir)


@R.query("num_m04_panel_frequencies", f"with {_PANEL} select marker_idx, round((u1 * {PC1[0]} + u2 * {PC1[1]} + mu) / 2, 6) as af from panel")
def panel_frequencies(spark, sf_dir):
    dot = F.aggregate(F.zip_with("ud", F.array(*map(F.lit, PC1)), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return panel_of(spark, sf_dir).select("marker_idx", F.round((dot + F.col("mu")) / 2, 6).alias("af"))


def _given(g, wrong):
    ref = {0: "0", 1: "1 / 6.0::double", 2: "1 / 3.0::double"} if wrong else {0: "1", 1: "0.5::double", 2: "0"}
    alt = {0: "1 / 3.0::double", 1: "1 / 6.0::double", 2: "0"} if wrong else {0: "0", 1: "0.5::double", 2: "1"}
    return f"(case kind when 0 then {ref[g]} when 1 then {alt[g]} else {'2 / 3.0::double' if wrong else '0'} end)"


def _mixed(g1, g2, alpha):
    part = lambda w: f"({alpha} * {_given(g1, w)} + (1 - {alpha}) * {_given(g2, w)})"
    p = f"{part(True)} * e + {part(False)} * (1 - e)"
    return f"sum(case when {p} > 0 then n * ln({p}) else -1e300 end) as l{g1}{g2}"


def _llk_sql(alpha):
    clip = lambda pc: f"greatest(5e-5, least(0.99995, (u1 * {pc[0]} + u2 * {pc[1]} + mu) / 2))"
    cells = [(a, b) for a in range(3) for b in range(3)]
    freq = lambda f, g: [f"pow(1 - {f}, 2)", f"2 * {f} * (1 - {f})", f"pow({f}, 2)"][g]
    terms = ", ".join(f"l{a}{b} + ln({freq('f1', a)} * {freq('f2', b)}) as t{a}{b}" for a, b in cells)
    top = "greatest(" + ", ".join(f"t{a}{b}" for a, b in cells) + ")"
    return f"""select marker_idx, {top} + ln({' + '.join(f'exp(t{a}{b} - {top})' for a, b in cells)}) as llk from (
      select marker_idx, {terms} from (select marker_idx, {clip(PC1)} as f1, {clip(PC2)} as f2, {', '.join(_mixed(a, b, alpha) for a, b in cells)}
        from (select s.*, pow(10.0, -qual / 10.0)::double as e, u1, u2, mu from suff s join panel using (marker_idx)) group by marker_idx, f1, f2))"""


@R.query(
    "agg_a18_mixture_llk",
    f"with {_PANEL}, a as ({_llk_sql(ALPHA)}), z as ({_llk_sql(0.0)}) select {ALPHA}::double as alpha, round(sum(llk), 4) as llk from a union all select 0.0::double, round(sum(llk), 4) from z",
)
def mixture_llk(spark, sf_dir):
    llk = MX.Likelihood(counts_of(spark, sf_dir), panel_of(spark, sf_dir))
    rows = [(a, round(llk(np.array(PC1), np.array(PC2), a), 4)) for a in (ALPHA, 0.0)]
    return spark.createDataFrame(rows, "alpha double, llk double")


@R.query("num_m05_mixture_fit")
def mixture_fit(spark, sf_dir):
    """All six modes on the pileup at the panel's markers."""
    llk = MX.Likelihood(MX.usual_depth(counts_of(spark, sf_dir)), panel_of(spark, sf_dir))
    modes = [(w, p, a) for w in (True, False) for p, a in ((None, None), (PC2, None), (None, ALPHA))]
    rows = []
    for within, pc, alpha in modes:
        f = MX.fit(llk, 2, within, pc, alpha, tolerance=1e-6)
        rows.append((within, pc is not None, alpha is not None, f.pc1, f.pc2, f.alpha, f.llk1, f.llk0))
    return spark.createDataFrame(rows, "within boolean, fixed_pc boolean, fixed_alpha boolean, pc1 array<double>, pc2 array<double>, alpha double, llk1 double, llk0 double")


@R.query(
    "flt_p26_enough_markers",
    f"with {_PANEL} select (select count(distinct marker_idx) from suff) as covered, (select count(*) from panel) as markers, (select count(distinct marker_idx) from suff) > 20 and (select count(distinct marker_idx) from suff) > 0.1 * (select count(*) from panel) as enough",
)
def enough_markers(spark, sf_dir):
    counts, panel = counts_of(spark, sf_dir), panel_of(spark, sf_dir)
    covered = counts.agg(F.count_distinct("marker_idx").alias("covered"))
    row = covered.join(F.broadcast(panel.agg(F.count(F.lit(1)).alias("markers"))))
    return row.withColumn("enough", F.lit(MX.enough_markers(counts, panel, 20, 0.1)))


def contig_reads(spark, sf_dir):
    """Confident reads as contigs: the test tables hold no reference sequence."""
    rows = placed(spark, sf_dir).filter("mapq >= 58 and mapq < 255 and length(seq) >= 16")
    return rows.groupBy(F.col("seq")).agg(F.min("read_id").alias("name")).select("name", "seq")


_HITS = f"""{ALN}, ctg as (select upper(seq) as c, min(read_id) as name from aln where mapq >= 58 and mapq < 255 and length(seq) >= 16 group by seq), {READS},
rd as (select read_id as key, false as reverse, upper(seq) as r from reads where length(seq) >= 16 union all select read_id, true, translate(reverse(upper(seq)), 'ACGTacgt', 'TGCAtgca') from reads where length(seq) >= 16),
po as (with recursive l as (select unnest(range(16, 300)) as len), t as (select len, 0 as k, exp(-0.02 * len) as term, exp(-0.02 * len) as total from l
  union all select len, k + 1, term * 0.02 * len / (k + 1), total + term * 0.02 * len / (k + 1) from t where k < 60) select len, min(k) as most from t where k > 0 and 1 - total < 0.04 group by len),
un as (select distinct r, most from rd join po on po.len = length(r)),
fit as (select r, most, name, c, unnest(range(0, length(c) - length(r) + 1)) as place from un join ctg on length(r) <= length(c)),
at_ as (select r, name, place, hamming(r, substr(c, place::int + 1, length(r))) as differences from fit where hamming(r, substr(c, place::int + 1, length(r))) <= most),
hits as (select key, reverse, name, place, differences from rd join at_ using (r))"""


def _reads(spark, sf_dir):
    return read_table(spark, sf_dir).select(F.col("read_id").alias("key"), "seq")


def hits_of(spark, sf_dir):
    """Every place within the mismatch limit; the SQL compares each read with each place of each contig."""
    return MP.hits(_reads(spark, sf_dir), contig_reads(spark, sf_dir))


@R.query("join_j18_gapped_hits")
def gapped_hits(spark, sf_dir):
    """Of reads that fit nowhere with mismatches alone: the best place with gaps on each contig."""
    found = hits_of(spark, sf_dir).select("key").distinct()
    rest = _reads(spark, sf_dir).filter("length(seq) >= 32").join(found, "key", "left_anti")
    return MP.gapped_hits(rest, contig_reads(spark, sf_dir)).select("key", "reverse", "name", F.col("at").alias("place"), "edits", sequence.render_cigar("cigar", F.lit("")).alias("cigar"))


@R.query("join_j18_seed_hits", f"with {_HITS} select key, reverse, name, cast(place as int) as place, cast(differences as int) as differences from hits")
def seed_hits(spark, sf_dir):
    return hits_of(spark, sf_dir).withColumnRenamed("at", "place")


@R.query(
    "join_j19_best_places",
    f"""with {_HITS}, b as (select key, min(differences) as d, arg_min(name, (differences, name, place, reverse)) as name, arg_min(place, (differences, name, place, reverse)) as place, arg_min(reverse, (differences, name, place, reverse)) as reverse from hits group by key),
    c as (select b.key, b.name, cast(b.place as int) as place, b.reverse, cast(b.d as int) as differences, cast(count(*) filter (h.differences = b.d) as int) as c1, cast(count(*) filter (h.differences > b.d) as int) as c2 from b join hits h using (key) group by all)
    select *, cast(case when c1 > 1 then 0 when c2 = 0 then 37 else greatest(0, 23 - cast(floor(4.343 * ln(least(c2, 255)) + 0.5) as int)) end as int) as mapq from c""",
)
def best_places(spark, sf_dir):
    return MP.placed(hits_of(spark, sf_dir)).withColumnRenamed("at", "place")


def fragments(spark, sf_dir):
    """Both mates of a read joined to one contig: the first, then the reverse complement of the second."""
    reads = read_table(spark, sf_dir).filter("length(seq) >= 16")
    side = lambda n: reads.filter(F.col("mate") == n).select("file_id", "read_idx", F.upper("seq").alias(f"s{n}"))
    both = side(1).join(side(2), ["file_id", "read_idx"])
    return both.select("s1", "s2", F.struct("file_id", "read_idx").alias("name"), F.concat("s1", sequence.reverse_complement("s2")).alias("seq"))


_FRAG = """, fr as (select a.file_id, a.read_idx, length(a.seq) as n, length(b.seq) as m, upper(a.seq) as s1, upper(b.seq) as s2 from reads a join reads b on a.file_id = b.file_id and a.read_idx = b.read_idx and a.mate = 1 and b.mate = 2
  where length(a.seq) >= 16 and length(b.seq) >= 16)"""


@R.query("join_j19_proper_pairs")
def proper_pairs(spark, sf_dir):
    """Of the places of both mates on the fragments, the pair with the least cost.

    Repeated deliveries of a read give the same pair again, so they need no shuffle of their own.
    """
    reads = table(spark, sf_dir, "fastq_reads").filter("length(seq) >= 16")
    side = lambda n: reads.filter(F.col("mate") == n).select("file_id", "read_idx", F.upper("seq").alias(f"s{n}"))
    pairs = side(1).join(side(2), ["file_id", "read_idx"]).select(F.struct("file_id", "read_idx").alias("name"), "s1", "s2")
    best = MP.proper_pairs(pairs, 200, 40)
    return best.select(
        "pair.file_id", "pair.read_idx", F.col("name.read_idx").alias("fragment"), F.col("at").alias("place_1"), F.col("at_2").alias("place_2"), "size", F.round("cost", 6).alias("cost")
    )


_ANCHOR = """, an as (select r.file_id, r.read_idx from reads r join aln a using (read_id) where r.mate = 1 and a.mapq >= 17 and a.mapq < 255),
q as (select fr.*, m, translate(reverse(s2), 'ACGT', 'TGCA') as t from fr join an using (file_id, read_idx)),
mu as (select *, substr(t, 1, m // 2) || translate(substr(t, m // 2 + 1, 1), 'ACGTN.', 'CGTAAA') || substr(t, m // 2 + 2) as u from q)"""


def _anchors(spark, sf_dir, change):
    """The first mates of confident reads, placed at the begin of their fragment, with the second mates as ``change`` alters them."""
    sure = placed(spark, sf_dir).filter("mapq >= 17 and mapq < 255").select("read_id", "mapq")
    first = read_table(spark, sf_dir).filter("mate = 1").join(sure, "read_id").select("file_id", "read_idx", "mapq")
    own = fragments(spark, sf_dir).select("name.file_id", "name.read_idx", "s1", "s2", "seq").join(first, ["file_id", "read_idx"])
    key = F.struct("file_id", "read_idx")
    contigs = own.select(key.alias("name"), "seq")
    turned = change(sequence.reverse_complement("s2"), F.length("s2"))
    anchors = own.select(key.alias("key"), key.alias("name"), F.lit(0).alias("at"), F.length("s1").alias("stop"), F.lit(False).alias("reverse"), "mapq", sequence.reverse_complement(turned).alias("seq"))
    return anchors, contigs


@R.query("join_j20_mate_rescue", f"with {ALN}, {READS}{_FRAG}{_ANCHOR} select file_id, read_idx, cast(m - 4 as int) as score from mu where m >= 20 and m - length(regexp_replace(u, '[^ACGT]', '', 'g')) < 0.25 * m")
def mate_rescue(spark, sf_dir):
    """Second mates with one base changed, found in the predicted window beside their confident first mates."""
    def change(t, n):
        half = F.floor(n / 2).cast("int")
        return F.concat(F.substr(t, F.lit(1), half), F.translate(F.substr(t, half + 1, F.lit(1)), "ACGTN.", "CGTAAA"), F.substr(t, half + 2, n))

    anchors, contigs = _anchors(spark, sf_dir, change)
    found = MP.rescued(anchors, contigs, 250, 150)
    return found.select("key.file_id", "key.read_idx", "score")


@R.query("join_j20_gapped_rescue")
def gapped_rescue(spark, sf_dir):
    """Second mates with two bases lost, found with a gap."""
    anchors, contigs = _anchors(spark, sf_dir, lambda t, n: F.concat(F.substr(t, F.lit(1), F.floor(n / 2).cast("int")), F.substr(t, F.floor(n / 2).cast("int") + 3, n)))
    found = MP.rescued(anchors, contigs, 250, 150)
    return found.select("key.file_id", "key.read_idx", F.col("at").alias("place"), "reverse", "score", sequence.render_cigar("cigar", F.lit("")).alias("cigar"))


@R.query("str_t01_micro_batches", "select event_type, count(*) as rows from events group by event_type")
def micro_batches(spark, sf_dir):
    return jobs.batch_counts(spark, f"{sf_dir}/events.parquet", "event_type")


@R.query("str_t02_distinct_keys", "select distinct rec_id from sam_records")
def distinct_keys(spark, sf_dir):
    return jobs.first_of_key(spark, f"{sf_dir}/sam_records.parquet", ["rec_id"], "recorded_at", "30 days")


@R.query("str_t03_mate_buffer", f"with {READS} select a.file_id, a.read_idx, a.read_id as read_id_1, b.read_id as read_id_2 from reads a join reads b on a.file_id = b.file_id and a.read_idx = b.read_idx and a.mate = 1 and b.mate = 2")
def mate_buffer(spark, sf_dir):
    return jobs.mate_stream(spark, f"{sf_dir}/fastq_reads.parquet")


_GOOD = "insert_size between 1 and 2000 and (day(recorded_at) % 3 <> 0 or file_id = 1)"


@R.query(
    "str_t05_carried_stats",
    f"""with d as (select cast(recorded_at as date) as d, count(*) filter ({_GOOD}) as n, avg(insert_size) filter ({_GOOD}) as mean from sam_records where recorded_at is not null group by 1)
    select row_number() over (order by d) - 1 as batch, n, round(last_value(case when n >= 40 then mean end ignore nulls) over (order by d rows between unbounded preceding and current row), 6) as used from d""",
)
def carried_stats(spark, sf_dir):
    """A file a day, a file a batch: every third day has few good rows, so the statistics of the day before go on."""
    rows, at = table(spark, sf_dir, "sam_records").filter("recorded_at is not null"), jobs.place(spark, "days")
    for (day,) in rows.select(F.to_date("recorded_at").alias("d")).distinct().orderBy("d").collect():  # two weeks
        rows.filter(F.to_date("recorded_at") == F.lit(day)).coalesce(1).write.mode("append").parquet(at)
    out = jobs.carried_stats(spark, at, "insert_size", _GOOD, 40)
    return out.select("batch", "n", F.round("used", 6).alias("used"))


@R.query("str_t06_running_totals", "select event_type, count(*) as rows, round(sum(value), 2) as total from events group by event_type")
def running_totals(spark, sf_dir):
    out = jobs.running_totals(spark, f"{sf_dir}/events.parquet", "event_type", "value")
    return out.select("event_type", "rows", F.round("total", 2).alias("total"))


@R.query("snk_k19_ancestry_report")
def ancestry_report(spark, sf_dir):
    """``pc, contaminating, intended`` of the fit with different ancestry."""
    llk = MX.Likelihood(MX.usual_depth(counts_of(spark, sf_dir)), panel_of(spark, sf_dir))
    f = MX.fit(llk, 2, tolerance=1e-6)
    return spark.createDataFrame([(i + 1, a, b) for i, (a, b) in enumerate(zip(f.pc1, f.pc2))], "pc int, contaminating double, intended double")


@R.query("snk_k20_self_report")
def self_report(spark, sf_dir):
    """One row: markers, bases, mean depth, alpha and both likelihoods of the fit within one ancestry."""
    counts = counts_of(spark, sf_dir)
    f = MX.fit(MX.Likelihood(counts, panel_of(spark, sf_dir)), 2, within=True, tolerance=1e-6)
    row = counts.agg(F.count_distinct("marker_idx").alias("markers"), F.sum("n").alias("bases"))
    row = row.withColumn("mean_depth", F.round(F.try_divide("bases", "markers"), 4))
    return row.withColumns({"alpha": F.lit(f.alpha), "llk1": F.lit(f.llk1), "llk0": F.lit(f.llk0)})
