import random

import pytest
from pyspark.sql import functions as F

from lociflow.functions import keys, numeric, sequence
from lociflow.operators import bases, kmers, mapper

READ = "AAAAAATAAAAAA"
RECOVERY = [
    ("T12", "13M", "TAAAAATAAAAAA"),
    ("4T8", "13M", "AAAATATAAAAAA"),
    ("12T", "13M", "AAAAAATAAAAAT"),
    ("11T0T", "13M", "AAAAAATAAAATT"),
    ("10", "4M3I6M", "AAAAAAAAAA"),
    ("9", "4S9M", "AATAAAAAA"),
    ("9", "9M4S", "AAAAAATAA"),
    ("9^TTTT4", "9M4D4M", "AAAAAATAATTTTAAAA"),
    ("6G^GGG5T", "7M3D6M", "AAAAAAGGGGAAAAAT"),
    ("9^TTTT2^TT2", "9M4D2M2D2M", "AAAAAATAATTTTAATTAA"),
]


def test_reference_bases(spark):
    df = spark.createDataFrame([(READ, md, c, want) for md, c, want in RECOVERY], "seq string, md string, c string, want string")
    for r in df.withColumn("cigar", sequence.parse_cigar("c")).withColumn("got", sequence.reference_bases("seq", "md", "cigar")).collect():
        assert r.got == r.want, (r.md, r.c)


def one(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("x")).first()["x"]


def test_keys(spark):
    rows = spark.createDataFrame([("chr1",), ("CHRx",), ("22",), (None,), ("",), ("achr7",)], "c string")
    assert [r[0] for r in rows.select(keys.chrom("c")).collect()] == ["1", "X", "22", None, "", "R7"]
    assert one(spark, keys.contig("n"), "n string", "chr3:47@A/G|L").asDict() == {"chrom": "3", "pos": 47, "ref": "A", "alt": "G", "class": "long"}
    assert one(spark, keys.contig("n"), "n string", "bad").pos is None
    assert one(spark, keys.contig_name(F.lit("3"), F.lit(47), F.lit("A"), F.lit("G"), F.lit("long")), "n string", "") == "3:47@A/G|L"
    names = spark.createDataFrame([("r/1",), ("/1",), ("r\\2",), ("r/3",)], "n string")
    assert [r[0] for r in names.select(keys.read_name("n")).collect()] == ["r", "/1", "r", "r/3"]
    assert one(spark, keys.unescaped("n"), "n string", r"a\tb\\t\n") == "a\tb\\t\n"


def trim(qual, threshold, floor=35):
    total = best = 0
    cut = len(qual)
    for at in range(len(qual) - 1, floor - 1, -1):
        total += threshold - (ord(qual[at]) - 33)
        if total < 0:
            break
        if total > best:
            best, cut = total, at
    return cut


def test_trimming_and_qualities(spark):
    rng = random.Random(1)
    quals = ["".join(chr(33 + rng.choice([2, 10, 30, 40])) for _ in range(rng.randint(1, 120))) for _ in range(200)]
    got = spark.createDataFrame([(q,) for q in quals], "q string").select("q", sequence.trimmed_length("q", 15).alias("n")).collect()
    assert all(r.n == trim(r.q, 15) for r in got)
    assert one(spark, sequence.old_qualities("q"), "q string", "h@") == "I!"
    assert one(spark, sequence.barcode("s", "q", 4), "s string, q string", "ACGT", "I!I!") == "AcGt"


def test_cigars(spark):
    assert [tuple(x) for x in one(spark, sequence.parse_cigar("c"), "c string", "3S10M2D")] == [(3, "S"), (10, "M"), (2, "D")]
    assert one(spark, sequence.parse_cigar("c"), "c string", "*") is None
    own = spark.createDataFrame([("3S10M2D4I",)], "c string").withColumn("g", sequence.parse_cigar("c"))
    got = own.select(sequence.reference_length("g"), sequence.read_length("g"), sequence.is_clipped("g"), sequence.clip_at("g", False), sequence.clip_at("g", True), sequence.render_cigar("g", F.lit("A"))).first()
    assert tuple(got) == (12, 17, True, 3, 0, "3S10M2D4I")


def test_scripts_lead_back_to_the_reference(spark):
    rng, data = random.Random(3), []
    for key in range(60):
        ref = "".join(rng.choice("ACGT") for _ in range(30))
        read = "".join(c if rng.random() < 0.8 else rng.choice("ACGT") for c in ref)
        cigar = [(30, "M")]
        if key % 3 == 1:  # two bases lost, three clipped before
            read, cigar = "GGG" + read[:10] + read[12:], [(3, "S"), (10, "M"), (2, "D"), (18, "M")]
        if key % 3 == 2:
            read, cigar = read[:15] + "TT" + read[15:], [(15, "M"), (2, "I"), (15, "M")]
        data.append((key, read, ref, cigar))
    data += [(90, None, "A", [(1, "M")]), (91, "A", "A", None)]
    df = spark.createDataFrame(data, "read_id int, seq string, ref string, cigar array<struct<len:int,op:string>>")
    back = df.join(bases.mismatch_scripts(df), "read_id").withColumn("back", sequence.reference_bases("seq", "md", "cigar"))
    for r in back.collect():
        assert r.back == r.ref if r.read_id < 90 else r.md is None


@pytest.mark.parametrize("length, most", [(17, 2), (38, 3), (64, 4), (93, 5), (124, 6), (157, 7)])
def test_published_difference_limits(length, most):
    assert numeric.most_differences(length) == most


def test_words_agree_with_the_column_expression(spark):
    rng = random.Random(4)
    reads = [(i, "".join(rng.choice("ACGTacgtN.") for _ in range(rng.randint(0, 130)))) for i in range(80)] + [(99, None)]
    df = spark.createDataFrame(reads, "id int, s string")
    got = {tuple(r) for r in kmers.read_keys(df, "id", "s").collect()}
    chunks = F.array(*[F.struct(F.lit(o).alias("chunk"), F.substr(F.upper("s"), F.lit(o + 1), F.lit(32)).alias("k")) for o in (0, 32, 64)])
    want = df.select("id", F.inline(chunks)).filter("length(k) = 32").select("id", "chunk", F.inline(kmers.masked_keys(F.col("k"))))
    assert got == {tuple(r) for r in want.collect()} and len(got) > 100
    assert kmers.panel_keys(df.limit(0), "s").collect() == []


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(h[i][j - 1] + mapper.OPEN, e[i][j - 1] + mapper.EXTEND)
            f[i][j] = max(h[i - 1][j] + mapper.OPEN, f[i - 1][j] + mapper.EXTEND)
            h[i][j] = max(0, h[i - 1][j - 1] + (mapper.MATCH if a[i - 1] == b[j - 1] else mapper.MISMATCH), e[i][j], f[i][j])
    return max(map(max, h))


def test_local_alignment():
    rng = random.Random(5)
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 40)))
        b = a[5:25] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 20)))
        b = b[:8] + rng.choice(["", "GG", "T"]) + b[8:]
        score, i, k, j, m = mapper.local_alignment(a, b)
        assert score == smith_waterman(a, b)
        assert not score or smith_waterman(a[i:k], b[j:m]) == score


def test_large_panels_are_joined_and_give_the_same_hits(spark, rows, monkeypatch):
    rng = random.Random(12)
    panel = ["".join(rng.choice("ACGTN" if i % 5 == 0 else "ACGT") for _ in range(90)) for i in range(12)] + [None, "", "ACG"]
    reads = [(i, (panel[i % 12][10:] + "ACGT" * 9) if i % 3 else "".join(rng.choice("ACGTN") for _ in range(100))) for i in range(60)] + [(97, None), (98, ""), (99, "A" * 31)]
    own = spark.createDataFrame(reads, "id int, s string").selectExpr("*", "1 as chunk", "2 as mask", "3 as part").repartition(3)
    known = spark.createDataFrame([(p,) for p in panel], "s string").repartition(4)
    table = kmers.panel_table(known, "s")
    small = rows(kmers.filter_reads(own, "id", "s", table))
    assert sum(r[2] for r in small) > 20 and len(small) == len(reads)
    assert rows(kmers.filter_reads(own, "id", "s", kmers.panel_keys(known, "s"))) == small
    most = rows(kmers.shared_keys(own, "id", "s", table, any_chunk=True))
    monkeypatch.setattr(kmers, "IN_SCAN", 0)
    assert rows(kmers.filter_reads(own, "id", "s", table)) == small and rows(kmers.shared_keys(own, "id", "s", table, any_chunk=True)) == most
    monkeypatch.setattr(kmers, "MOST_BITS", 6)  # full bitmaps lose nothing
    assert rows(kmers.filter_reads(own, "id", "s", table)) == small
    assert {r.hits for r in kmers.filter_reads(own, "id", "s", kmers.panel_table(known.limit(0), "s")).collect()} == {0}
