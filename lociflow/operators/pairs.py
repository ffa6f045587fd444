"""Mates, pair status, insert sizes and duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociflow.functions import keys, sequence
from lociflow.session import cut

BINS = 2000
START = 1e-6


def mates(reads: DataFrame) -> DataFrame:
    """Pairs by ``(file_id, read_idx)`` with both names and ``same_name``; reads without a mate are left out."""
    side = lambda n: reads.filter(F.col("mate") == n).select(
        "file_id", "read_idx", F.col("read_id").alias(f"read_id_{n}"), F.col("name").alias(f"name_{n}")
    )
    plain = lambda c: keys.read_name(F.substring_index(F.col(c), " ", 1))
    both = side(1).join(side(2), ["file_id", "read_idx"])
    return both.withColumn("same_name", plain("name_1").eqNullSafe(plain("name_2")))


def singletons(reads: DataFrame) -> DataFrame:
    """Reads whose ``(file_id, read_idx)`` has one mate only."""
    line = Window.partitionBy("file_id", "read_idx")
    both = F.size(F.collect_set("mate").over(line))
    return reads.withColumn("_mates", both).filter("_mates = 1").drop("_mates")


def flags(file: str, index: str, mate: str, strand: str) -> Column:
    """The flag of a placed read among the placed reads: paired, which mate, strand, and whether the mate is placed."""
    both = F.size(F.collect_set(mate).over(Window.partitionBy(file, index))) > 1
    return (1 + F.when(both, 0).otherwise(8) + F.when(F.col(strand), 16).otherwise(0) + F.when(F.col(mate) == 1, 64).otherwise(128)).cast("int")


def aligned_pairs(alignments: DataFrame, read_idx: DataFrame, markers: DataFrame) -> DataFrame:
    """Both placements of each pair with the limits that the contig sets to its insert size.

    ``read_idx`` maps read_id to ``(file_id, read_idx)``; markers give contig
    bounds.  A side carries position, end, clips and the largest size seen from it.
    """
    bounds = markers.select(F.col("name").alias("contig"), F.col("pos").alias("_centre"), F.col("flank").alias("_flank"))
    at = alignments.join(read_idx.select("read_id", "read_idx"), "read_id").join(bounds, "contig", "left")
    end = F.col("pos") + sequence.reference_length("cigar") - 1
    side = F.struct(
        keys.chrom("chrom").alias("chrom"),
        "contig",
        (F.col("pos") - sequence.clip_at("cigar", False)).alias("beg"),
        (end + sequence.clip_at("cigar", True)).alias("end"),
        F.col("strand").alias("reverse"),
        F.coalesce("mapq", F.lit(0)).alias("mapq"),
        sequence.is_clipped("cigar").alias("clipped"),
        F.when(F.col("contig").isNotNull() & (F.col("pos") > 0), True).otherwise(False).alias("placed"),
        (F.col("_centre") - F.col("_flank")).alias("low"),
        (F.col("_centre") + F.col("_flank")).alias("high"),
    )
    of = lambda n: F.max(F.when(F.col("mate") == n, side)).alias(f"m{n}")
    return at.groupBy("file_id", "read_idx").agg(of(1), of(2)).filter("m1 is not null or m2 is not null")


def pair_status(pairs: DataFrame, least_mapq: int = 0) -> DataFrame:
    """``status`` with ``max1``, ``max2`` (largest sizes seen from each side, -1 where cut off) and ``obs`` (-1 for none).

    LowQual: no placed side above the mapping quality; FwdOnly / RevOnly: one
    such side; NotPair: different contigs or not forward-reverse; PropPair and
    PartialPair: forward-reverse without and with a clipped side.
    """
    good = lambda s: F.coalesce(F.col(f"{s}.placed") & (F.col(f"{s}.mapq") > least_mapq), F.lit(False))
    reach = lambda s: F.when(
        F.col(f"{s}.reverse"), F.col(f"{s}.end") - F.col(f"{s}.low") + 1
    ).otherwise(F.col(f"{s}.high") - F.col(f"{s}.beg") + 1)
    own = pairs.withColumns({"_g1": good("m1"), "_g2": good("m2"), "_r1": reach("m1"), "_r2": reach("m2")})
    known = lambda i: F.when(F.col(f"_g{i}") & (F.col(f"_r{i}") > 0), F.col(f"_r{i}")).otherwise(-1)
    turned = F.coalesce(F.col("m1.reverse"), F.lit(False))
    own = own.withColumns(
        {
            "_fwd": F.when(~F.col("m1.reverse"), F.col("m1")).otherwise(F.col("m2")),
            "_rev": F.when(~F.col("m1.reverse"), F.col("m2")).otherwise(F.col("m1")),
            "max1": F.when(turned, known(2)).otherwise(known(1)),
            "max2": F.when(turned, known(1)).otherwise(known(2)),
        }
    )
    opposite = F.col("_g1") & F.col("_g2") & (F.col("m1.contig") == F.col("m2.contig")) & (F.col("m1.reverse") != F.col("m2.reverse"))
    own = own.withColumn("_facing", F.coalesce(opposite & (F.col("_fwd.beg") <= F.col("_rev.end")), F.lit(False)))
    one = F.when(F.col("_g1"), F.col("m1.reverse")).otherwise(F.col("m2.reverse"))
    status = (
        F.when(~F.col("_g1") & ~F.col("_g2"), "LowQual")
        .when(~(F.col("_g1") & F.col("_g2")), F.when(one, "RevOnly").otherwise("FwdOnly"))
        .when(~F.col("_facing"), "NotPair")
        .when(F.col("m1.clipped") | F.col("m2.clipped"), "PartialPair")
        .otherwise("PropPair")
    )
    where = lambda c: F.when(F.col("_facing"), c)
    return own.select(
        "file_id",
        "read_idx",
        status.alias("status"),
        "max1",
        "max2",
        where(F.col("_rev.end") - F.col("_fwd.beg") + 1).otherwise(-1).alias("obs"),
        F.coalesce("m1.contig", "m2.contig").alias("contig"),
        where(F.col("_fwd.beg")).alias("beg"),
        where(F.col("_rev.end")).alias("end"),
        where(~F.col("_fwd.clipped")).alias("fwd_whole"),
        where(~F.col("_rev.clipped")).alias("rev_whole"),
    )


def duplicate_rate(pairs: DataFrame) -> DataFrame:
    """Exact duplication over proper pairs with the key (contig, beg, end); one row."""
    proper = pairs.filter("status = 'PropPair'")
    fragments = proper.groupBy("contig", "beg", "end").agg(F.count(F.lit(1)).alias("n"))
    sums = fragments.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("distinct"))
    return sums.select(
        (2 * (F.col("n") - F.col("distinct"))).alias("duplicate_reads"),
        (2 * F.col("n")).alias("pair_reads"),
        F.round(F.try_divide(F.col("n") - F.col("distinct"), F.col("n")), 6).alias("rate"),
    )


def censored(pairs: DataFrame, excluded: str) -> DataFrame:
    """``k, seen, cut``: observed and censored pairs of each size below BINS, without pairs of one status.

    A single side is censored at its limit, a partial pair at the limit of its
    unclipped side (none if both or neither are clipped).
    """
    own = pairs.filter((F.col("status") != excluded) & ~F.col("status").isin("LowQual", "NotPair", "Abnormal"))
    partial = F.when(F.col("fwd_whole") & ~F.col("rev_whole"), F.col("max1")).when(~F.col("fwd_whole") & F.col("rev_whole"), F.col("max2"))
    at = (
        F.when(F.col("status") == "PropPair", F.col("obs"))
        .when(F.col("status") == "FwdOnly", F.col("max1"))
        .when(F.col("status") == "RevOnly", F.col("max2"))
        .when(F.col("status") == "PartialPair", partial)
    )
    seen = F.col("status") == "PropPair"
    rows = own.select(at.alias("k"), seen.alias("_seen")).filter(F.col("k").between(0, BINS - 1))
    return rows.groupBy("k").agg(F.count_if("_seen").alias("seen"), F.count_if(~F.col("_seen")).alias("cut"))


def adjusted(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """``k, density, upto_seen, upto_cut`` of 0 .. bins - 1: sizes corrected for censoring by one ordered fold.

    f = n / (1 - G) / N and g = m / (1 - F) / N, F and G their running sums.
    """
    spark = counts.sparkSession
    every = spark.range(bins).select(F.col("id").cast("int").alias("k")).join(counts, "k", "left").fillna(0, ["seen", "cut"])
    rows = every.agg(
        F.sum(F.col("seen") + F.col("cut")).alias("n"),
        F.array_sort(F.collect_list(F.struct("k", "seen", "cut"))).alias("bins"),
    )
    zero = F.expr("named_struct('f', 0D, 'g', 0D, 'out', cast(array() as array<struct<density:double,upto_seen:double,upto_cut:double>>))")
    n = F.greatest(F.col("n").cast("double"), F.lit(1.0))

    def step(acc: Column, b: Column) -> Column:
        f = (b["seen"] + START) / (1 - acc["g"]) / n
        total = acc["f"] + f
        g = (b["cut"] + START) / (1 - total) / n
        item = F.struct(f.alias("density"), total.alias("upto_seen"), (acc["g"] + g).alias("upto_cut"))
        return F.struct(total.alias("f"), (acc["g"] + g).alias("g"), F.array_append(acc["out"], item).alias("out"))

    folded = rows.select(F.aggregate("bins", zero, step, lambda acc: acc["out"]).alias("_o"))
    return folded.select(F.posexplode("_o").alias("k", "_v")).select("k", "_v.*")


def adjusted_insert(pairs: DataFrame) -> DataFrame:
    """The sum of the two corrected densities, each without the single sides of one direction."""
    pairs = cut(pairs.select("status", "max1", "max2", "obs", "fwd_whole", "rev_whole"))  # read twice, and a short plan
    a = adjusted(censored(pairs, "FwdOnly")).select("k", F.col("density").alias("_a"))
    b = adjusted(censored(pairs, "RevOnly")).select("k", F.col("density").alias("_b"))
    return a.join(b, "k").select("k", F.round(F.col("_a") + F.col("_b"), 9).alias("density"))


def truncated_median(histogram: DataFrame, key: str, value: str, least: int) -> DataFrame:
    """First bucket from ``least`` on where the running count exceeds half (whole-number) of the counts there, else 0."""
    own = histogram.filter(F.col(key) >= least)
    line = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)  # one row per bucket
    running = own.select(key, F.sum(value).over(line).alias("_run"), F.sum(value).over(Window.partitionBy()).alias("_all"))
    hit = running.filter(F.col("_run") > F.floor(F.col("_all") / 2))
    return hit.agg(F.coalesce(F.min(key), F.lit(0)).cast("bigint").alias("median"))


def insert_moments(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: quartiles by position, fences of two interquartile ranges, mean, deviation, skewness and kurtosis within.

    Rows are first counted by (key, value), so a key's pass is over its distinct values.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    line = Window.partitionBy(key)
    upto = F.sum("_c").over(line.orderBy("_x"))
    ranked = counts.withColumns({"_upto": upto, "_n": F.sum("_c").over(line)})
    at = lambda share: F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * share + 0.5), F.col("_x")))
    quarters = ranked.groupBy(key).agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    fenced = quarters.withColumns(
        {
            "low": F.greatest(F.lit(1.0), F.floor(F.col("p25") - 2 * (F.col("p75") - F.col("p25")) + 0.499).cast("double")),
            "high": F.floor(F.col("p75") + 2 * (F.col("p75") - F.col("p25")) + 0.499).cast("double"),
        }
    )
    within = counts.join(fenced, key).filter(F.col("_x").between(F.col("low"), F.col("high")))
    within = within.withColumn("_mean", F.sum(F.col("_x") * F.col("_c")).over(line) / F.sum("_c").over(line))
    moment = lambda p: F.sum(F.pow(F.col("_x") - F.col("_mean"), p) * F.col("_c"))
    sums = within.groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("p25", "p50", "p75", "low", "high")],
        F.sum("_c").alias("n"),
        F.first("_mean").alias("mean"),
        *[moment(p).alias(f"_m{p}") for p in (2, 3, 4)],
    )
    sd = F.sqrt(F.col("_m2") / F.col("n"))
    return sums.select(
        key,
        "p25",
        "p50",
        "p75",
        "low",
        "high",
        "n",
        F.round("mean", 4).alias("mean"),
        F.round(sd, 4).alias("deviation"),
        F.round(F.try_divide(F.col("_m3") / F.col("n"), F.pow(sd, 3)), 4).alias("skewness"),
        F.round(F.try_divide(F.col("_m4") / F.col("n"), F.pow(sd, 4)) - 3, 4).alias("kurtosis"),
    )
