"""Text forms of results, and writing them.

Every form is a DataFrame with one column ``value``; ``save`` writes it.  Ordered
single-file output is meant for reports, whose rows are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.functions import sequence


def tabbed(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Tab-separated cells; null is written ``.``."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in columns or df.columns]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def info_text(info: Column) -> Column:
    """INFO of a map, keys in order; a null value is a flag."""
    entries = F.array_sort(F.map_entries(info))
    text = F.transform(entries, lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))
    return F.when(F.size(text) > 0, F.array_join(text, ";")).otherwise(".")


def vcf_sites(sites: DataFrame) -> DataFrame:
    """Site lines ordered by chromosome (as text) and position."""
    own = sites.withColumn("info", info_text(F.col("info"))).orderBy("chrom", "pos")
    return tabbed(own, ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"])


def vcf_calls(calls: DataFrame, sample: str = "sample") -> DataFrame:
    """Call lines with GT:PL:GP; ``chrom, pos, ref, alt, af, depth, gt, pl0.., gp0..``."""
    three = lambda c: F.concat_ws(",", *[F.col(f"{c}{i}").cast("string") for i in range(3)])
    info = F.concat(F.lit("AF="), F.col("af").cast("string"), F.lit(";AC="), F.col("depth").cast("string"))
    own = calls.select("chrom", "pos", F.lit(".").alias("id"), "ref", "alt", F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"), F.lit("GT:PL:GP").alias("format"), F.concat_ws(":", "gt", three("pl"), three("gp")).alias(sample))
    return tabbed(own.orderBy("chrom", "pos"))


def fasta(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Two lines a sequence."""
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))


def fastq(df: DataFrame) -> DataFrame:
    """Four lines a read; a null cell is an empty line."""
    cell = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(F.concat(F.lit("@"), cell("name"), F.lit("\n"), cell("seq"), F.lit("\n+\n"), cell("qual")).alias("value"))


def placement_tags() -> list[Column]:
    """Tags of a placement: type, edits, quality, counts of best and other hits, mismatches, gaps and gap bases.

    From ``cigar, md, mapq, c1, c2``; reads without a script have none.
    """
    gaps = F.filter("cigar", lambda c: c["op"].isin("I", "D"))
    tags = {
        "XT:A": F.when(F.col("c1") == 1, "U").otherwise("R"),
        "NM:i": sequence.edit_distance_of(F.coalesce("md", F.lit("")), "cigar"),
        "SM:i": F.coalesce("mapq", F.lit(0)),
        "X0:i": F.col("c1"),
        "X1:i": F.col("c2"),
        "XM:i": F.size(F.map_keys(sequence.md_mismatches(F.coalesce("md", F.lit(""))))),
        "XO:i": F.size(gaps),
        "XG:i": F.aggregate(gaps, F.lit(0), lambda a, c: a + c["len"]),
    }
    return [F.when(F.col("cigar").isNotNull(), F.concat(F.lit(f"{name}:"), value.cast("string"))) for name, value in tags.items()]


def sam_lines(df: DataFrame, cigar_text: Column, tags: list[Column] | None = None) -> DataFrame:
    """SAM lines of placed and unplaced reads with their read group (``read_group``), given tags and MD."""
    group = [F.concat(F.lit("RG:Z:"), F.col("read_group"))] if "read_group" in df.columns else []
    star = lambda c: F.coalesce(c, F.lit("*"))
    cells = [
        F.col("name"),
        F.col("flag").cast("string"),
        star(F.col("chrom")),
        F.coalesce("pos", F.lit(0)).cast("string"),
        F.coalesce("mapq", F.lit(0)).cast("string"),
        star(cigar_text),
        F.lit("*"),
        F.lit("0"),
        F.lit("0"),
        star(F.col("seq")),
        star(F.col("qual")),
        *group,
        *(tags or []),
        F.when(F.col("md").isNotNull(), F.concat(F.lit("MD:Z:"), F.col("md"))),
    ]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def save(df: DataFrame, path: str, single: bool = False, header: list[str] | None = None) -> None:
    """Write lines as text; ``single`` for small ordered reports, with their header lines first."""
    if header:
        first = df.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1)
        df = first.union(df)
    (df.coalesce(1) if single else df).write.mode("overwrite").text(path)


def save_index(path: str, kmers: DataFrame, markers: DataFrame, contigs: DataFrame, params: dict[str, int | str]) -> None:
    """The tables of an index as Parquet and its parameters as JSON, one a line."""
    for name, df in (("kmers", kmers), ("markers", markers), ("contigs", contigs)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = [(name, str(value)) for name, value in params.items()]
    kmers.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/params")
