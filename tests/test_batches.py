"""Batch reads, discarded variants, clipped ends, record checks, chosen markers and files of genotypes."""

import random

from lociflow.functions import sequence
from lociflow.operators import batches, bases, intervals, kmers, selecting
from lociflow.sources import binary


def test_batches_keep_mates_together(spark):
    rng = random.Random(2)
    panel = "".join(rng.choice("ACGT") for _ in range(200))
    rows = []
    for i in range(60):
        for mate in (1, 2):
            seq = "ACGTACGT" + (panel[i : i + 70] if i % 2 else "".join(rng.choice("ACGT") for _ in range(70)))
            rows.append((2 * i + mate, 1, mate, i, f"r{i}/{mate}", seq, "I" * 60 + "!" * 18))
    rows += [(500, 1, 1, 99, "x", None, None), (501, 1, 2, 99, None, "ACGT", "IIII"), (502, 1, 1, 98, "y", "AC", "I")]
    df = spark.createDataFrame(rows, "read_id int, file_id int, mate int, read_idx int, name string, seq string, qual string").repartition(3)
    known = kmers.panel_table(spark.createDataFrame([(panel,)], "s string"), "s")
    out = {r.read_id: r for r in batches.read_batch(df, known, 3, 15, 8).collect()}
    assert set(out) == {r[0] for r in rows if r[5] and r[6] and len(r[5]) == len(r[6])}
    for r in rows[:120]:
        o = out[r[0]]
        assert (o.barcode, o.filtered) == ("ACGTACGT", r[3] % 2 == 0)
        assert o.seq == (r[5][8:60] if r[3] % 2 else r[5][8:]) and len(o.seq) == len(o.qual)
    sampled = batches.read_batch(df, known, 0, 0, 0, 0.5, 7).collect()
    by = {}
    for r in sampled:
        by.setdefault(r.read_idx, set()).add(r.mate)
        assert not r.filtered and r.barcode is None
    assert all(m == {1, 2} for i, m in by.items() if i < 60) and 10 < len(by) < 50
    pairs = batches.read_pairs(batches.read_batch(df, known, 3, 15, 8)).collect()
    assert {(r.read_idx, r.mates, r.both) for r in pairs} == {(i, 2, True) for i in range(1, 60, 2)}
    assert batches.read_batch(df.limit(0), known).collect() == []


def test_discarded_variants(spark):
    rows = [(1, "PASS", "C", ["0|1", "1|1"]), (2, "LOW", "C", ["0|1", "1|1"]), (3, "PASS", "C,T", ["0|1", "1|1"]), (4, "PASS", "C", ["0/1", "1|1"]), (5, "PASS", "C", ["0|1", "."]), (6, "PASS", "C", ["0|0", "0|0"]), (7, "PASS", "C", ["1|1", "1|1"])]
    df = spark.createDataFrame(rows, "k int, filter string, alt string, gt array<string>")
    assert [r.k for r in selecting.kept_variants(df, 1, 1).collect()] == [1]


def clipped(n, wrong, most):
    """Both ends at once, by hand: (begin, end) of read bases 0 .. n - 1."""
    out = []
    for bad in (wrong, {n - 1 - i for i in wrong}):
        cut = seen = missed = 0
        for i in range(n // 2):
            seen += 1
            missed += i in bad
            if i in bad and missed > most * seen:
                cut, seen, missed = i + 1, 0, 0
        out.append(cut)
    return tuple(out)


def test_clipped_ends(spark):
    rows, want = [], {}
    cases = {1: set(), 2: {0, 1}, 3: {0, 5}, 4: {39}, 5: {30, 38, 39}, 6: {0, 39}, 7: {3, 4, 5}}
    for key, wrong in cases.items():
        seq = "A" * 40
        md, last = "", 0
        for i in sorted(wrong):
            md, last = md + f"{i - last}C", i + 1
        rows.append((key, seq, md + str(40 - last), [(40, "M")]))
        want[key] = clipped(40, wrong, 0.25)
    rows += [(20, None, None, None), (21, "", "0", [])]
    df = spark.createDataFrame(rows, "read_id int, seq string, md string, cigar array<struct<len:int,op:string>>")
    got = {r.read_id: (r.clip_begin, r.clip_end) for r in selecting.clipped_ends(df.filter("seq is not null"), 0.25).collect()}
    assert got == want | {21: (0, 0)}


def test_soft_clips(spark):
    rows = [(1, [(40, "M")]), (2, [(6, "S"), (34, "M")]), (3, [(4, "M"), (3, "D"), (36, "M")]), (4, [(5, "M"), (2, "I"), (33, "M")]), (5, [(8, "M")])]
    df = spark.createDataFrame(rows, "k int, cigar array<struct<len:int,op:string>>")
    out = {r.k: ("".join(f"{c['len']}{c['op']}" for c in r.c["cigar"]), r.c["shift"]) for r in df.withColumn("c", sequence.soft_clipped("cigar", 5, 4)).collect()}
    assert out == {1: ("5S31M4S", 5), 2: ("6S30M4S", 0), 3: ("5S31M4S", 8), 4: ("5S2I29M4S", 5), 5: ("8S", 0)}


def test_chosen_markers(spark):
    marks = spark.createDataFrame([("a", "1", 1000, 250), ("b", "1", 1700, 250), ("wide", "1", 5000, 1000), ("c", "2", 10, 250)], "name string, chrom string, pos int, flank int")
    reads = [(1, "1", 1100, 1200), (2, "1", 1400, 1500), (3, "1", 1240, 1460), (4, "1", 3950, 4050), (5, "2", 900, 1000), (6, "3", 5, 50), (7, "1", None, None)]
    df = spark.createDataFrame(reads, "id int, chrom string, pos int, end int")
    got = {r.id: (r.name, r.overlap) for r in intervals.chosen(df, marks, "id", 1500).collect()}
    assert got == {1: ("a", 101), 2: ("b", 51), 3: ("a", 11), 4: ("wide", 51)}
    assert intervals.chosen(df.limit(0), marks, "id", 1500).collect() == [] == intervals.chosen(df, marks.limit(0), "id", 1500).collect()


def test_marker_bases_are_those_of_all_bases(spark, rows):
    rng = random.Random(6)
    scripts = [[(30, "M")], [(5, "S"), (25, "M")], [(10, "M"), (3, "D"), (20, "M")], [(10, "M"), (4, "I"), (16, "M")], None]
    data = [(i, rng.choice(["1", "chr1", "2", None]), rng.randint(1000, 1090), rng.random() < 0.5, 60, "".join(rng.choice("ACGT") for _ in range(30)), "I" * 30, rng.choice(scripts), "30") for i in range(200)]
    own = spark.createDataFrame(data, "read_id int, chrom string, pos int, strand boolean, mapq int, seq string, qual string, cigar array<struct<len:int,op:string>>, md string")
    marks = spark.createDataFrame([("1", p) for p in range(1000, 1130, 7)] + [("2", 1023), ("2", 1024), ("2", 1024), (None, 5)], "chrom string, pos int")
    want = rows(bases.aligned_bases(own).join(marks.distinct(), ["chrom", "pos"], "left_semi").select("read_id", "chrom", "pos", "base", "qual", "cycle", "ref_base"))
    assert rows(bases.marker_bases(own, marks).select("read_id", "chrom", "pos", "base", "qual", "cycle", "ref_base")) == want and len(want) > 100


def test_written_genotypes_and_records_come_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary, "VARIANTS", 3)
    rng = random.Random(3)
    rows = [("1", 10 * i, f"v{i}", "A", "C", [rng.choice([-1, 0, 1, 2]) for _ in range(6)]) for i in range(8)]
    df = spark.createDataFrame(rows, "chrom string, pos int, id string, first string, second string, copies array<int>").repartition(3)
    binary.write_plink(df, f"file:{tmp_path}/g")
    assert sorted(tuple(r) for r in binary.read_plink(spark, f"{tmp_path}/g").collect()) == rows
    schema = "name string, flag int, chrom string, pos int, mapq int, cigar array<struct<len:int,op:string>>, mate_chrom string, mate_pos int, insert_size int, seq string, qual string, tags map<string,string>"
    records = [(f"r{i}", 16 * (i % 2), "c1" if i % 3 else None, 5 * i + 1, 60, [(3, "S"), (7, "M")], "c2", 9, -30, "ACGTNACGTN", "IIIIIIIII!", {"NM": "i:2", "MD": "Z:4A0", "XT": "A:U", "XF": "f:0.5"}) for i in range(40)]
    records += [("none", 4, None, 0, 0, None, None, 0, 0, None, None, {}), ("odd", 0, "c1", 1, 9, [(1, "M")], None, 0, 0, "A", None, None)]
    own = spark.createDataFrame(records, schema).repartition(3)
    monkeypatch.setattr(binary, "BLOCK_BYTES", 700)
    assert binary.write_bam(own, f"{tmp_path}/b", [("c1", 900), ("c2", 900)]) == 42
    back = {r.name: r for r in binary.read_bam(spark, f"{tmp_path}/b/*.bam").collect()}
    assert len(back) == 42
    for name, flag, chrom, pos, mapq, cigar, mate, at, size, seq, qual, tags in records:
        r = back[name]
        assert (r.flag, r.chrom, r.pos, r.mapq, r.mate_chrom, r.mate_pos, r.insert_size, r.seq, r.qual) == (flag, chrom, pos, mapq, mate, at, size, seq, qual)
        assert ([tuple(c) for c in r.cigar] if r.cigar else None) == cigar and r.tags == (tags or {})


def test_sites_folded_in_batches_are_those_of_all_bases(spark, rows):
    rng = random.Random(9)
    scripts = [[(30, "M")], [(5, "S"), (25, "M")], [(10, "M"), (3, "D"), (20, "M")], [(10, "M"), (4, "I"), (16, "M")], None, [(30, "S")]]
    quality = lambda: "".join(chr(rng.randint(33, 75)) for _ in range(30))
    data = [(i, rng.choice(["1", "chr1", "X", None]), rng.choice([None, -3, *range(1000, 1060)]), True, 60, "A" * 30, rng.choice([quality(), quality(), None, "", "IIII"]), rng.choice(scripts), None) for i in range(300)]
    own = spark.createDataFrame(data, "read_id int, chrom string, pos int, strand boolean, mapq int, seq string, qual string, cigar array<struct<len:int,op:string>>, md string").repartition(3)
    want = rows(bases.depth(bases.aligned_bases(own)))
    assert rows(bases.site_depth(own)) == want and len(want) > 100
    assert bases.site_depth(own.limit(0)).collect() == []
