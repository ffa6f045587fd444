"""Column expressions over base strings, edit scripts and quality strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIGAR = "array<struct<len:int,op:string>>"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(x: Column | str) -> Column:
    """Bases other than A, C, G and T are kept."""
    return F.translate(F.reverse(_col(x)), "ACGTacgt", "TGCAtgca")


def sequencing_order(x: Column | str, strand: Column | str) -> Column:
    """A base string as it was sequenced: reverse complement where strand is true."""
    return F.when(_col(strand), reverse_complement(x)).otherwise(_col(x))


def parse_cigar(x: Column | str) -> Column:
    """``[{len, op}]`` of a text such as 12S88M; null for null and ``*``."""
    x = _col(x)
    lengths = F.regexp_extract_all(x, F.lit(r"([0-9]+)[MIDNSHP=X]"), 1)
    ops = F.regexp_extract_all(x, F.lit(r"[0-9]+([MIDNSHP=X])"), 1)
    both = F.zip_with(lengths, ops, lambda n, op: F.struct(n.cast("int").alias("len"), op.alias("op")))
    return F.when(x != "*", both)


def render_cigar(cigar: Column | str, seq: Column | str) -> Column:
    """The text of an edit script; without one, the whole read as a match."""
    text = F.array_join(F.transform(_col(cigar), lambda c: F.concat(c["len"].cast("string"), c["op"])), "")
    whole = F.concat(F.length(_col(seq)).cast("string"), F.lit("M"))
    return F.when(F.size(_col(cigar)) > 0, text).otherwise(whole)


def _sum_of(cigar: Column, ops: str) -> Column:
    add = lambda total, c: total + F.when(F.lit(ops).contains(c["op"]), c["len"]).otherwise(0)
    return F.aggregate(cigar, F.lit(0), add)


def reference_length(cigar: Column | str) -> Column:
    """Reference bases that a script consumes."""
    return _sum_of(_col(cigar), "MDN=X")


def read_length(cigar: Column | str) -> Column:
    """Read bases that a script consumes."""
    return _sum_of(_col(cigar), "MIS=X")


def is_clipped(cigar: Column | str) -> Column:
    """Is an end of the read clipped?"""
    return F.exists(_col(cigar), lambda c: c["op"].isin("S", "H"))


def clip_at(cigar: Column | str, end: bool) -> Column:
    """Soft-clipped bases at the begin or the end."""
    cigar = _col(cigar)
    edge = F.try_element_at(cigar, F.lit(-1 if end else 1))
    return F.when((F.size(cigar) > (1 if end else 0)) & (edge["op"] == "S"), edge["len"]).otherwise(0)


def blocks(cigar: Column | str) -> Column:
    """``[{op, len, read_off, ref_off}]``: each operation with the bases before it, both 0-based."""
    zero = F.expr("named_struct('read', 0, 'ref', 0, 'out', cast(array() as array<struct<op:string,len:int,read_off:int,ref_off:int>>))")

    def step(acc: Column, c: Column) -> Column:
        item = F.struct(c["op"].alias("op"), c["len"].alias("len"), acc["read"].alias("read_off"), acc["ref"].alias("ref_off"))
        return F.struct(
            (acc["read"] + F.when(c["op"].isin("M", "I", "S", "=", "X"), c["len"]).otherwise(0)).alias("read"),
            (acc["ref"] + F.when(c["op"].isin("M", "D", "N", "=", "X"), c["len"]).otherwise(0)).alias("ref"),
            F.array_append(acc["out"], item).alias("out"),
        )

    return F.aggregate(_col(cigar), zero, step, lambda acc: acc["out"])


def md_mismatches(md: Column | str) -> Column:
    """Map from the reference offset of each mismatch to the reference base there."""
    parts = F.regexp_extract_all(_col(md), F.lit(r"([0-9]+|\^[A-Z]+|[A-Z])"), 1)
    zero = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<key:int,value:string>>))")

    def step(acc: Column, x: Column) -> Column:
        number, letter = x.rlike("^[0-9]"), x.rlike("^[A-Z]")
        ahead = F.when(number, x.try_cast("int")).when(letter, 1).otherwise(F.length(x) - 1)
        item = F.struct(acc["at"].alias("key"), x.alias("value"))
        return F.struct(
            (acc["at"] + ahead).alias("at"), F.when(letter, F.array_append(acc["out"], item)).otherwise(acc["out"]).alias("out")
        )

    return F.map_from_entries(F.aggregate(parts, zero, step, lambda acc: acc["out"]))


def md_deletions(md: Column | str) -> Column:
    """The deleted reference bases, in order."""
    return F.regexp_extract_all(_col(md), F.lit(r"\^([A-Z]+)"), 1)


def reference_bases(seq: Column | str, md: Column | str, cigar: Column | str) -> Column:
    """Reference bases under an alignment: inserted and clipped bases left out, deleted ones put in."""
    seq, known, gone = _col(seq), md_mismatches(md), md_deletions(md)

    def block(b: Column) -> Column:
        match = F.transform(
            F.sequence(F.lit(0), b["len"] - 1),
            lambda i: F.coalesce(F.try_element_at(known, b["ref_off"] + i), F.substr(seq, b["read_off"] + i + 1, F.lit(1))),
        )
        return F.when(b["op"].isin("M", "=", "X") & (b["len"] > 0), F.array_join(match, "")).otherwise("")

    own = F.filter(blocks(cigar), lambda b: b["op"].isin("M", "D", "=", "X"))
    zero = F.expr("named_struct('gone', 1, 'out', '')")

    def step(acc: Column, b: Column) -> Column:
        deleted = F.coalesce(F.try_element_at(gone, acc["gone"]), F.lit(""))
        return F.struct(
            (acc["gone"] + (b["op"] == "D").cast("int")).alias("gone"),
            F.concat(acc["out"], F.when(b["op"] == "D", deleted).otherwise(block(b))).alias("out"),
        )

    return F.aggregate(own, zero, step, lambda acc: acc["out"])


def edit_distance_of(md: Column | str, cigar: Column | str) -> Column:
    """Mismatches plus inserted and deleted bases."""
    return F.size(F.map_keys(md_mismatches(md))) + _sum_of(_col(cigar), "ID")


def soft_clipped(cigar: Column | str, begin: int, end: int) -> Column:
    """``cigar, shift``: at least so many read bases at either end turned into a soft clip, and how far the position moves.

    Clips that are longer stay; hard clips are dropped; a deletion stays only between bases that do. A read without
    a base left is one clip.
    """
    cigar = _col(cigar)
    n = read_length(cigar)
    low = F.greatest(F.lit(begin), clip_at(cigar, False))
    high = n - F.greatest(F.lit(end), clip_at(cigar, True))

    def left(b: Column) -> Column:
        inside = F.greatest(F.lit(0), F.least(b["read_off"] + b["len"], high) - F.greatest(b["read_off"], low))
        gap = F.when((b["read_off"] > low) & (b["read_off"] < high), b["len"]).otherwise(0)
        return F.when(b["op"].isin("M", "I", "=", "X"), inside).when(b["op"].isin("D", "N"), gap).otherwise(0)

    def place(b: Column) -> Column:
        return b["ref_off"] + F.when(b["op"].isin("D", "N"), 0).otherwise(F.greatest(F.lit(0), low - b["read_off"]))

    own = F.filter(F.transform(blocks(cigar), lambda b: F.struct(left(b).alias("len"), b["op"].alias("op"), place(b).alias("at"))), lambda x: x["len"] > 0)
    clip = lambda size: F.array(F.struct(size.alias("len"), F.lit("S").alias("op")))
    kept = F.transform(own, lambda x: F.struct(x["len"].alias("len"), x["op"].alias("op")))
    on_reference = F.filter(own, lambda x: x["op"] != "I")
    whole = F.filter(F.concat(clip(low), kept, clip(n - high)), lambda x: x["len"] > 0)
    shift = F.coalesce(F.array_min(F.transform(on_reference, lambda x: x["at"])), F.lit(0))
    return F.struct(F.when(low < high, whole).otherwise(clip(n)).alias("cigar"), shift.alias("shift"))


def qualities(qual: Column | str, offset: int = 33) -> Column:
    """Phred values of a quality string."""
    chars = F.filter(F.split(_col(qual), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.ascii(c) - offset)


def old_qualities(qual: Column | str) -> Column:
    """A quality string of offset 64 shifted to offset 33."""
    codes = F.filter(F.split(_col(qual), ""), lambda c: c != "")
    return F.array_join(F.transform(codes, lambda c: F.char(F.ascii(c) - 31)), "")


def trimmed_length(qual: Column | str, threshold: int = 15, floor: int = 35) -> Column:
    """Bases left after 3' trimming: the cut with the largest sum of ``threshold - q`` behind it, not below ``floor``."""
    values = F.reverse(qualities(qual))
    n = F.length(_col(qual))
    zero = F.expr("named_struct('i', 0, 'sum', 0, 'best', 0, 'cut', 0, 'on', true)")

    def step(acc: Column, q: Column) -> Column:
        total = acc["sum"] + F.lit(threshold) - q
        on = acc["on"] & (total >= 0) & (n - acc["i"] > floor)
        better = on & (total > acc["best"])
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(on, total).otherwise(acc["sum"]).alias("sum"),
            F.when(better, total).otherwise(acc["best"]).alias("best"),
            F.when(better, acc["i"] + 1).otherwise(acc["cut"]).alias("cut"),
            on.alias("on"),
        )

    cut = F.aggregate(values, zero, step, lambda acc: acc["cut"])
    return F.when(n <= floor, n).otherwise(n - cut)


def barcode(seq: Column | str, qual: Column | str, length: int = 8, least: int = 13) -> Column:
    """The first bases, at most 15, in lower case where their quality is below ``least``."""
    n = min(length, 15)
    seq, qual = _col(seq), _col(qual)
    place = F.sequence(F.lit(1), F.least(F.lit(n), F.length(seq)))
    base = lambda i: F.substr(seq, i, F.lit(1))
    low = lambda i: F.ascii(F.substr(qual, i, F.lit(1))) - 33 < least
    return F.when(F.length(seq) > 0, F.array_join(F.transform(place, lambda i: F.when(low(i), F.lower(base(i))).otherwise(base(i))), ""))


def pileup_cleanup(bases: Column | str, ref: Column | str) -> Column:
    """Bases of a pileup text: without read starts, ends and indels; dots and commas are the reference base."""
    plain = F.regexp_replace(F.regexp_replace(_col(bases), r"\^.", ""), r"\$", "")
    # an indel is a sign, its length and as many letters: the pieces between signs drop them
    pieces = F.split(plain, r"[+-](?=[0-9])", -1)
    number = lambda p: F.regexp_extract(p, r"^([0-9]+)", 1)
    rest = F.transform(
        pieces,
        lambda p, i: F.when(i == 0, p).otherwise(F.substr(p, F.length(number(p)) + F.coalesce(number(p).try_cast("int"), F.lit(0)) + 1, F.lit(1 << 30))),
    )
    return F.regexp_replace(F.array_join(rest, ""), "[.,]", F.upper(_col(ref)))


def count_of(x: Column | str, letters: str) -> Column:
    """Characters of x among ``letters``, in either case."""
    up = F.upper(_col(x))
    return F.length(up) - F.length(F.translate(up, letters.upper(), ""))
