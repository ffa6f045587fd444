"""Text formats: parsers from DataFrames of lines (column ``value``), and readers by path.

Lines that cannot be read are left out by the readers of headers and comments
only where the format says so; otherwise their cells are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.functions import keys, sequence


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of plain or gzip files."""
    return spark.read.text(path)


def _cells(df: DataFrame, sep: str = "\t") -> tuple[DataFrame, callable]:
    rows = df.withColumn("_c", F.split("value", sep, -1))
    return rows, lambda i: F.try_element_at("_c", F.lit(i + 1))


def info_map(info: Column) -> Column:
    """Map of VCF INFO; a flag has a null value, ``.`` gives an empty map."""
    return F.when(info == ".", F.expr("cast(map() as map<string,string>)")).otherwise(F.str_to_map(info, F.lit(";"), F.lit("=")))


def vcf(df: DataFrame) -> DataFrame:
    """``chrom, pos, id, ref, alt, qual, filter, info`` of site lines; header lines are skipped."""
    rows, cell = _cells(df.filter("value not like '#%' and value <> ''"))
    return rows.select(
        cell(0).alias("chrom"),
        cell(1).try_cast("int").alias("pos"),
        cell(2).alias("id"),
        cell(3).alias("ref"),
        cell(4).alias("alt"),
        cell(5).try_cast("double").alias("qual"),
        cell(6).alias("filter"),
        info_map(cell(7)).alias("info"),
    )


def vcf_section(sites: DataFrame, chrom: str, start: int, end: int, overlap: bool = False) -> DataFrame:
    """Sites of [start, end), 1-based; with ``overlap`` also those whose REF reaches into it."""
    reach = F.length("ref") - 1 if overlap else F.lit(0)
    return sites.filter((F.col("chrom") == chrom) & (F.col("pos") < end) & (F.col("pos") + reach >= start))


def genotype_vcf(df: DataFrame, samples: list[str] | None = None) -> DataFrame:
    """``chrom, pos, id, ref, alt, filter, sample, gt, pl, gl``: a row per sample value.

    Sample names come from the header line; ``samples`` keeps some of them.
    """
    header = df.filter("value like '#CHROM%'").select("value").first()
    names = header[0].split("\t")[9:] if header else []
    rows, cell = _cells(df.filter("value not like '#%' and value <> ''"))
    each = rows.select(
        cell(0).alias("chrom"),
        cell(1).try_cast("int").alias("pos"),
        cell(2).alias("id"),
        cell(3).alias("ref"),
        cell(4).alias("alt"),
        cell(6).alias("filter"),
        F.split(cell(8), ":").alias("_format"),
        F.posexplode(F.slice("_c", 10, 1 << 20)).alias("_n", "_value"),
    )
    value = F.map_from_arrays("_format", F.slice(F.concat(F.split("_value", ":"), F.array_repeat(F.lit(None).cast("string"), 64)), F.lit(1), F.size("_format")))
    each = each.withColumn("_v", value).withColumn("sample", F.try_element_at(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), F.col("_n") + 1))
    if samples is not None:
        each = each.filter(F.col("sample").isin(samples))
    field = lambda k: F.try_element_at("_v", F.lit(k))
    numbers = lambda k, t: F.transform(F.split(field(k), ","), lambda x: x.try_cast(t))
    return each.select("chrom", "pos", "id", "ref", "alt", "filter", "sample", field("GT").alias("gt"), numbers("PL", "int").alias("pl"), numbers("GL", "double").alias("gl"))


def alternative_alleles(gt: Column) -> Column:
    """0, 1 or 2 alternative alleles of a genotype text, -1 where one is missing."""
    alleles = F.split(gt, r"[/|]")
    missing = F.exists(alleles, lambda a: a == ".") | gt.isNull()
    return F.when(missing, -1).otherwise(F.aggregate(alleles, F.lit(0), lambda acc, a: acc + (a != "0").cast("int")))


def bed(df: DataFrame) -> DataFrame:
    """``chrom, beg, end`` of the first three columns; the first is normalised, of equal begins the farthest end stays."""
    rows, cell = _cells(df.filter("value not like '#%' and trim(value) <> ''"), r"\s+")
    regions = rows.select(keys.chrom(cell(0)).alias("chrom"), cell(1).try_cast("int").alias("beg"), cell(2).try_cast("int").alias("end"))
    return regions.groupBy("chrom", "beg").agg(F.max("end").alias("end"))


def bed_or_points(df: DataFrame) -> DataFrame:
    """``chrom, beg, end`` half-open from 0: two numbers are that already, one number is a 1-based point."""
    rows, cell = _cells(df.filter(r"value not rlike '^(#|browser\\b|track\\b)' and trim(value) <> ''"), r"\s+")
    first, second = cell(1).try_cast("int"), cell(2).try_cast("int")
    return rows.select(
        cell(0).alias("chrom"),
        F.when(second.isNull(), first - 1).otherwise(first).alias("beg"),
        F.when(second.isNull(), first).otherwise(second).alias("end"),
    )


def marker_bed(df: DataFrame) -> DataFrame:
    """``chrom, beg, pos, ref, alt`` of ``chrom beg end ref alt`` lines."""
    rows, cell = _cells(df.filter("trim(value) <> ''"), r"\s+")
    return rows.select(
        keys.chrom(cell(0)).alias("chrom"), cell(1).try_cast("int").alias("beg"), cell(2).try_cast("int").alias("pos"), cell(3).alias("ref"), cell(4).alias("alt")
    )


def known_frequencies(df: DataFrame) -> DataFrame:
    """``chrom, beg, pos, ref, alt, af`` of six-column lines."""
    rows, cell = _cells(df.filter("trim(value) <> ''"), r"\s+")
    return rows.select(
        keys.chrom(cell(0)).alias("chrom"),
        cell(1).try_cast("int").alias("beg"),
        cell(2).try_cast("int").alias("pos"),
        cell(3).alias("ref"),
        cell(4).alias("alt"),
        cell(5).try_cast("double").alias("af"),
    )


def pileup_text(df: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """``chrom, pos, ref, depth, bases, quals`` of pileup lines, cleaned, at markers only if they are given."""
    rows, cell = _cells(df.filter("value <> ''"))
    piles = rows.select(
        keys.chrom(cell(0)).alias("chrom"),
        cell(1).try_cast("int").alias("pos"),
        F.upper(cell(2)).alias("ref"),
        cell(3).try_cast("int").alias("depth"),
        sequence.pileup_cleanup(cell(4), cell(2)).alias("bases"),
        cell(5).alias("quals"),
    )
    return piles if markers is None else piles.join(markers.select("chrom", "pos").distinct(), ["chrom", "pos"], "left_semi")


def matrix(df: DataFrame, columns: int | None = None) -> DataFrame:
    """``name, values`` of white-space lines whose first cell is a name; the first ``columns`` numbers, all if not given."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = df.filter("trim(value) <> ''").select(cells.alias("_c"))
    last = F.lit(columns) if columns is not None else F.size("_c")
    return rows.select(F.element_at("_c", 1).alias("name"), F.transform(F.slice("_c", F.lit(2), last), lambda x: x.try_cast("double")).alias("values"))


def populations(df: DataFrame) -> DataFrame:
    """``sample, population`` of white-space lines."""
    cells = F.split(F.trim("value"), r"\s+")
    return df.filter("trim(value) <> ''").select(F.try_element_at(cells, F.lit(1)).alias("sample"), F.try_element_at(cells, F.lit(2)).alias("population"))


def fastq_list(df: DataFrame) -> DataFrame:
    """``path1, path2`` of lines of one or two paths; comments are skipped, a null path2 is single-end."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = df.filter("trim(value) <> '' and value not like '#%'")
    return rows.select(F.element_at(cells, 1).alias("path1"), F.try_element_at(cells, F.lit(2)).alias("path2"))


def fasta_index(df: DataFrame) -> DataFrame:
    """``chrom, len`` of the first two columns of a FASTA index, normalised."""
    rows, cell = _cells(df.filter("value <> ''"))
    return rows.select(keys.chrom(cell(0)).alias("chrom"), cell(1).try_cast("bigint").alias("len"))


def insert_table(df: DataFrame) -> DataFrame:
    """``file_id, read_idx, status, max1, max2, obs`` of tab-separated lines."""
    rows, cell = _cells(df.filter("value <> ''"))
    return rows.select(
        cell(0).try_cast("bigint").alias("file_id"),
        cell(1).try_cast("bigint").alias("read_idx"),
        cell(2).alias("status"),
        *[cell(i).try_cast("int").alias(n) for i, n in ((3, "max1"), (4, "max2"), (5, "obs"))],
    )


def sam(df: DataFrame) -> DataFrame:
    """The eleven fixed fields of SAM lines, ``tags`` as a map of ``XX`` to its typed text; headers are skipped."""
    rows, cell = _cells(df.filter("value not like '@%' and value <> ''"))
    tag = lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)).alias("key"), F.substr(x, F.lit(4)).alias("value"))
    return rows.select(
        cell(0).alias("name"),
        cell(1).try_cast("int").alias("flag"),
        F.nullif(cell(2), F.lit("*")).alias("chrom"),
        cell(3).try_cast("int").alias("pos"),
        cell(4).try_cast("int").alias("mapq"),
        sequence.parse_cigar(cell(5)).alias("cigar"),
        F.nullif(cell(6), F.lit("*")).alias("mate_chrom"),
        cell(7).try_cast("int").alias("mate_pos"),
        cell(8).try_cast("int").alias("insert_size"),
        F.nullif(cell(9), F.lit("*")).alias("seq"),
        F.nullif(cell(10), F.lit("*")).alias("qual"),
        F.map_from_entries(F.transform(F.slice("_c", 12, 1 << 20), tag)).alias("tags"),
    )


INDEX_BIN = 16_384
INDEX_GROUPS = 64


def save_indexed(lines: DataFrame, path: str) -> None:
    """Text lines ``chrom, pos, value`` in an order by place, in folders of a hash of (chrom, bin): the folder is the index."""
    bins = F.floor(F.col("pos") / INDEX_BIN).cast("bigint")
    group = F.pmod(F.xxhash64("chrom", bins), F.lit(INDEX_GROUPS)).cast("int")
    rows = lines.select("chrom", "pos", "value", group.alias("group"))
    rows.repartitionByRange("group", "chrom", "pos").sortWithinPartitions("group", "chrom", "pos").select("value", "group").write.partitionBy("group").text(path)


def indexed_lines(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """Region columns with ``pos`` and ``value`` of the lines in each region ``chrom, beg, end`` (closed).

    Regions are listed by the bins they touch; only folders that a region asks for are read (dynamic pruning).
    """
    to_bin = lambda x: F.floor(x / INDEX_BIN).cast("bigint")
    asked = regions.withColumn("_bin", F.explode(F.sequence(to_bin(F.col("beg")), to_bin(F.col("end")))))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("chrom", "_bin"), F.lit(INDEX_GROUPS)).cast("int"))
    cells = F.split("value", "\t")
    rows = spark.read.schema("value string, group int").text(path).select("group", "value", cells.getItem(0).alias("chrom"), cells.getItem(1).cast("int").alias("pos"))
    rows = rows.withColumn("_bin", to_bin(F.col("pos")))
    return rows.join(asked, ["group", "chrom", "_bin"]).filter("pos between beg and end").drop("group", "_bin")
