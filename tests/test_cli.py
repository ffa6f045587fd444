import gzip
import random

import pytest

from lociflow import cli


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """A genome, candidate sites, and paired reads around them with one alternative sample."""
    at = tmp_path_factory.mktemp("cli")
    rng = random.Random(11)
    genome = "".join(rng.choice("ACGT") for _ in range(40_000))
    (at / "ref.fa").write_text(">1 test\n" + "\n".join(genome[i : i + 60] for i in range(0, len(genome), 60)) + "\n")
    places = list(range(2000, 38_000, 3000))
    alt = {p: rng.choice([b for b in "ACGT" if b != genome[p - 1]]) for p in places}
    sites = [f"1\t{p}\trs{p}\t{genome[p - 1]}\t{alt[p]}\t50\tPASS\tAF=0.3" for p in places]
    sites += ["1\t2100\tnear\tA\tC\t50\tPASS\tAF=0.3", "1\t5\tindel\tAC\tA\t5\tPASS\tAF=0.3", "9\t7\trare\tA\tC\t5\tPASS\tAF=0.001", "1\t9\tnone\tA\tC\t5\tPASS\tDB"]
    (at / "sites.vcf").write_text("##fileformat=VCFv4.1\n" + "\n".join(sites) + "\n")
    carried = set(places[::2])
    own = "".join(alt[p] if p in carried else c for p, c in enumerate(genome, 1))
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    with gzip.open(at / "r_1.fq.gz", "wt") as one, gzip.open(at / "r_2.fq.gz", "wt") as two:
        for i in range(700):
            beg = rng.choice(places) - 150 + rng.randint(-60, 60)
            size = 260 + rng.randint(-20, 20)
            a, b = own[beg : beg + 100], turn(own[beg + size - 100 : beg + size])
            one.write(f"@r{i}/1\n{a}\n+\n{'I' * 100}\n")
            two.write(f"@r{i}/2\n{b}\n+\n{'I' * 100}\n")
    return at, places, carried, alt


def run(spark, *words):
    options = cli.parser().parse_args([str(w) for w in words])
    return {"index": cli.run_index, "align": cli.run_align, "pop+con": cli.run_popcon}[options.verb](spark, options)


def test_index_and_align(spark, files):
    at, places, carried, alt = files
    run(spark, "index", "--siteVCF", at / "sites.vcf", "--ref", at / "ref.fa", "--out_prefix", at / "ix", "--var_long", 3, "--var_short", 100)
    marks = spark.read.parquet(f"{at}/ix/markers").collect()
    assert {m.pos for m in marks} == set(places) and sum(m["class"] == "long" for m in marks) == 3
    contigs = {c.name: c for c in spark.read.parquet(f"{at}/ix/contigs").collect()}
    assert all(len(c.seq) == (2001 if n.endswith("L") else 501) for n, c in contigs.items())
    run(spark, "align", "--fastq_1", at / "r_1.fq.gz", "--fastq_2", at / "r_2.fq.gz", "--index_prefix", at / "ix", "--out_prefix", at / "out", "--kmer_thresh", 1)
    placed = spark.read.parquet(f"{at}/out/alignments")
    assert placed.count() > 1200
    calls = {r.pos: r.gt for r in spark.read.parquet(f"{at}/out/genotypes").collect()}
    assert calls and all(calls[p] == ("1/1" if p in carried else "0/0") for p in calls)
    status = {r.status: r["count"] for r in spark.read.parquet(f"{at}/out/pairs").groupBy("status").count().collect()}
    assert status["PropPair"] > 500
    assert spark.read.parquet(f"{at}/out/summary").first()["total_reads"] == 1400


def test_panel_and_fit(spark, files):
    at = files[0]
    rng = random.Random(3)
    samples = 30
    pcs = [rng.gauss(0, 1) for _ in range(samples)]
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *[f"s{i}" for i in range(samples)]])
    body, pile, bed = [], [], []
    for m in range(300):
        base, slope = rng.uniform(0.3, 0.7), rng.uniform(-0.2, 0.2)
        p = [min(0.98, max(0.02, base + slope * x)) for x in pcs]
        gt = ["/".join(str(int(rng.random() < q)) for _ in range(2)) for q in p]
        body.append(f"1\t{100 + 10 * m}\t.\tA\tC\t.\tPASS\t.\tGT\t" + "\t".join(gt))
        g = sum(int(rng.random() < min(0.98, max(0.02, base + slope))) for _ in range(2))
        bases = "".join("C" if rng.random() < g / 2 else "." for _ in range(12))
        pile.append(f"1\t{100 + 10 * m}\tA\t12\t{bases}\t{'I' * 12}")
        bed.append(f"1\t{99 + 10 * m}\t{100 + 10 * m}\tA\tC\t{base}")
    (at / "ref.vcf").write_text("\n".join([head, *body]) + "\n")
    (at / "pile.txt").write_text("\n".join(pile) + "\n")
    (at / "af.bed").write_text("\n".join(bed) + "\n")
    run(spark, "pop+con", "--RefVCF", at / "ref.vcf", "--Output", at / "svd")
    with pytest.raises(ValueError, match="too few markers"):
        run(spark, "pop+con", "--PileupFile", at / "pile.txt", "--SVDPrefix", at / "svd", "--Output", at / "fit", "--NumPC", 2)
    fit = run(spark, "pop+con", "--PileupFile", at / "pile.txt", "--SVDPrefix", at / "svd", "--Output", at / "fit", "--NumPC", 2, "--DisableSanityCheck", "--WithinAncestry")
    assert fit.alpha < 0.05 and len(fit.pc2) == 2
    known = run(spark, "pop+con", "--PileupFile", at / "pile.txt", "--SVDPrefix", at / "svd", "--Output", at / "fit2", "--NumPC", 2, "--DisableSanityCheck", "--KnownAF", at / "af.bed")
    assert known.alpha < 0.05
    assert spark.read.csv(f"{at}/fit/self", header=True).count() == 1
