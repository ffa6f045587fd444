import gzip

import pytest
from pyspark.sql import functions as F

from lociflow.sources import reads as RD
from lociflow.sources import sinks, text


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_fastq_and_fasta_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\n@@II\n@r2\nAC\nGT\n+r2\nII\nII\n\n")
    (tmp_path / "b.fq").write_text("@s1\nA\n+\nI\n>f1\nACGT\nAC\n")
    got = [tuple(r)[1:] for r in RD.read_fastq(spark, f"{tmp_path}/*").orderBy("path", "read_idx").collect()]
    assert got == [(0, "r1 x", "ACGT", "@@II"), (1, "r2", "ACGT", "IIII"), (0, "s1", "A", "I"), (1, "f1", "ACGTAC", None)]
    listed = RD.read_listed(spark, [(f"{tmp_path}/a.fq.gz", None), (f"{tmp_path}/b.fq", f"{tmp_path}/a.fq.gz")])
    assert listed.filter("file_id = 1 and mate = 1").count() == 2
    (tmp_path / "bad.fq").write_text("@s1\nAC\n+\nI\n")
    with pytest.raises(Exception, match="differ in length"):
        RD.read_fastq(spark, f"{tmp_path}/bad.fq").collect()


def test_fastq_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fq").write_text("@a\nA\n+\nI\n")
    RD.register(spark)
    df = spark.readStream.format("lociflow_fastq").option("path", f"{tmp_path}/in/*.fq").load()
    query = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    (tmp_path / "in/b.fq").write_text("@b\nC\n+\nI\n")
    query.processAllAvailable()
    query.stop()
    assert sorted(r.name for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_vcf(spark):
    df = text.vcf(lines(spark, "##x", "#CHROM\tPOS", "chr1\t5\trs1\tAC\tG\t.\tPASS\tDB;AF=0.5", "2\tx\t.\tA\tC\t9\tq10\t."))
    a, b = df.orderBy("chrom", ascending=False).collect()
    assert (a.pos, a.qual, a.info) == (5, None, {"DB": None, "AF": "0.5"}) and (b.pos, b.qual, b.info) == (None, 9.0, {})
    assert text.vcf_section(df, "chr1", 6, 9).count() == 0 and text.vcf_section(df, "chr1", 6, 9, overlap=True).count() == 1
    again = text.vcf(sinks.vcf_sites(df.filter("pos = 5"))).first()
    assert again.info == a.info


def test_genotype_vcf(spark):
    df = lines(spark, "##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\ts2", "1\t5\t.\tA\tC\t.\tPASS\t.\tGT:PL\t0/1:9,0,7\t./.\t1|1:9,9,0")
    got = {r["sample"]: r for r in text.genotype_vcf(df).withColumn("n", text.alternative_alleles(F.col("gt"))).collect()}
    assert {k: r.n for k, r in got.items()} == {"s0": 1, "s1": -1, "s2": 2} and got["s0"].pl == [9, 0, 7] and got["s1"].pl is None
    assert [r["sample"] for r in text.genotype_vcf(df, ["s2"]).collect()] == ["s2"]


def test_beds(spark, rows):
    df = lines(spark, "chr1\t5\t9", "1\t5\t20\tx", "", "# c", "2 7 8")
    assert rows(text.bed(df)) == [("1", 5, 20), ("2", 7, 8)]
    df = lines(spark, "track name", "browser x", "1 7", "1 7 9", "tracks 1 2")
    assert rows(text.bed_or_points(df)) == [("1", 6, 7), ("1", 7, 9), ("tracks", 1, 2)]


def test_sam(spark):
    df = text.sam(lines(spark, "@HD\tx", "r\t16\tchr1\t5\t60\t4M\t=\t9\t-3\tACGT\tIIII\tNM:i:0\tMD:Z:4", "u\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*"))
    r, u = df.orderBy("name").collect()
    assert [tuple(c) for c in r.cigar] == [(4, "M")] and r.tags == {"NM": "i:0", "MD": "Z:4"} and r.insert_size == -3
    assert (u.chrom, u.cigar, u.seq) == (None, None, None)


def test_blocks(spark):
    seq = "".join("ACGT"[i * i % 4] for i in range(95))
    blocks = RD.fasta_blocks(spark.createDataFrame([("1", seq), ("2", ""), ("3", None)], "chrom string, seq string"), 10)
    regions = spark.createDataFrame([("1", b, e) for b, e in ((1, 1), (-5, 12), (10, 11), (90, 200), (96, 99), (31, 30))], "chrom string, beg int, end int")
    got = {(r.beg, r.end): r.bases for r in RD.fetch(regions, blocks, 10).collect()}
    assert {k: v for k, v in got.items() if v} == {(b, e): seq[b - 1 : e] for b, e in ((1, 1), (1, 12), (10, 11), (90, 200))}


def test_save_with_header(spark, tmp_path):
    sinks.save(sinks.tabbed(spark.createDataFrame([(1, None)], "a int, b string")), f"{tmp_path}/o", single=True, header=["#a\tb"])
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/o").collect()) == ["#a\tb", "1\t."]
