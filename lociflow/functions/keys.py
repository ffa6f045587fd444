"""Normalisation of keys: chromosomes, contig names, read names, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLANK = {"short": 250, "long": 1000}
AUTOSOMES = [str(i) for i in range(1, 23)]
CHROMOSOMES = [*AUTOSOMES, "X", "Y"]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chrom(x: Column | str) -> Column:
    """Upper case; where it contains CHR, without its first three characters.  Null stays null."""
    up = F.upper(_col(x))
    return F.when(up.contains("CHR"), F.substring(up, 4, 1 << 30)).otherwise(up)


def contig(x: Column | str) -> Column:
    """``chrom, pos, ref, alt, class`` of a contig name chrom:pos@ref/alt, with |L for a long flank."""
    x = _col(x)
    part = lambda i: F.regexp_extract(x, r"\A([^:]*):([0-9]+)@([^/]*)/([^|]*)(\|L)?\z", i)
    return F.struct(
        chrom(part(1)).alias("chrom"),
        part(2).try_cast("int").alias("pos"),
        part(3).alias("ref"),
        part(4).alias("alt"),
        F.when(x.endswith("L"), "long").otherwise("short").alias("class"),
    )


def contig_name(c: Column | str, pos: Column | str, ref: Column | str, alt: Column | str, kind: Column | str) -> Column:
    """The contig name of a marker."""
    tail = F.when(_col(kind) == "long", "|L").otherwise("")
    return F.concat(_col(c), F.lit(":"), _col(pos).cast("string"), F.lit("@"), _col(ref), F.lit("/"), _col(alt), tail)


def read_name(x: Column | str) -> Column:
    """Without a final /1 or /2 if longer than two characters, or the backslash form of it."""
    x = _col(x)
    return F.when(F.length(x) > 2, F.regexp_replace(x, r"[/\\][12]\z", "")).otherwise(x)


def basename(x: Column | str) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_extract(_col(x), r"([^/\\]*)\z", 1)


def unescaped(x: Column | str) -> Column:
    r"""``\t``, ``\n``, ``\r`` and ``\\`` written out, as in read-group lines."""
    mark = "\u0001"
    out = F.replace(_col(x), F.lit("\\\\"), F.lit(mark))
    for short, full in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r")):
        out = F.replace(out, F.lit(short), F.lit(full))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def natural(x: Column | str) -> Column:
    """A sort key in which runs of digits count as numbers: each is led by its length without leading zeros."""
    parts = F.regexp_extract_all(_col(x), F.lit("([0-9]+|[^0-9]+)"), 1)
    bare = lambda p: F.regexp_replace(p, r"\A0+", "")
    number = lambda p: F.concat(F.lpad(F.length(bare(p)).cast("string"), 9, "0"), bare(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\A[0-9]"), number(p)).otherwise(p)), "")
