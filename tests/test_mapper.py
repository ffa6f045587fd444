import random

from lociflow.functions import numeric
from lociflow.operators import mapper
from lociflow.plans import models

SEED = mapper.SEED


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def fastq(spark, folder, rows):
    """A folder with the table fastq_reads of rows ``read_id, file_id, read_idx, mate, seq``."""
    spark.createDataFrame(rows, "read_id bigint, file_id int, read_idx bigint, mate int, seq string").write.parquet(f"{folder}/fastq_reads.parquet")
    return str(folder)


def changed(rng, s, n):
    s = list(s)
    for i in rng.sample(range(len(s)), n):
        s[i] = rng.choice("ACGT".replace(s[i], ""))
    return "".join(s)


def brute_places(seq, contigs):
    """(name, at, stop, reverse, differences) of every place within the limit."""
    most = numeric.most_differences(len(seq))
    for name, c in contigs.items():
        for reverse, s in ((False, seq), (True, turned(seq))):
            for at in range(len(c) - len(s) + 1):
                d = sum(x != y for x, y in zip(s, c[at : at + len(s)]))
                if d <= most:
                    yield name, at, at + len(s), reverse, d


def brute_proper_pairs(rows):
    mates = {(f, i, m): s for _, f, i, m, s in rows}
    contigs = {(f, i): s + turned(mates[f, i, 2]) for (f, i, m), s in mates.items() if m == 1}
    out = set()
    for f, i in contigs:
        one, two = (list(brute_places(mates[f, i, m], contigs)) for m in (1, 2))
        best = []
        for name, at, stop, reverse, d in one:
            for name2, at2, stop2, reverse2, d2 in two:
                if name == name2 and reverse != reverse2 and (at2 <= at if reverse else at <= at2):
                    size = max(stop, stop2) - min(at, at2)
                    best.append((d + d2 + abs(size - 200) / 40, name, at, at2, size))
        if best:
            cost, name, at, at2, size = min(best)
            out.add((f, i, name[1], at, at2, size, round(cost, 6)))
    return out


def test_pairs_of_repeated_mates_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    base = lambda: "".join(rng.choice("ACGT") for _ in range(100))
    hot, cold, rows = base(), [base() for _ in range(4)], []
    mates = [(hot, base()) for _ in range(6)] + [(base(), hot) for _ in range(3)] + [(hot, cold[0])] * 3 + [(cold[1], cold[2]), (cold[1], cold[2]), (cold[3], base()), (hot, hot)]
    mates += [(changed(rng, a, 2), changed(rng, b, 3)) for a, b in mates[:2]]
    for i, (a, b) in enumerate(mates):
        rows += [(2 * i, 1, i, 1, a), (2 * i + 1, 1, i, 2, b)]
    got = {tuple(r) for r in models.proper_pairs(spark, fastq(spark, tmp_path, rows)).collect()}
    want = brute_proper_pairs(rows)
    assert got == want and len(want) == len(mates)


def test_pairs_of_all_lengths_against_brute_force(spark, tmp_path):
    """Short and long mates, unknown bases, swapped and changed copies, fragments cut from others; reads without a file are no mates."""
    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGTN" if rng.random() < 0.1 else "ACGT") for _ in range(n))
    mates = [(base(rng.choice((16, 20, 28, 36, 50, 76, 101, 150))), base(rng.choice((16, 23, 36, 47, 64, 101, 150)))) for _ in range(24)] + [("G" * 101, "G" * 40), ("G" * 30, base(60))]
    for a, b in mates[:24]:
        whole = a + turned(b)
        mates += [(b, a), (changed(rng, a, 1), changed(rng, b, 1))]
        n = min(len(whole) // 3, rng.choice((16, 18, 22, 30, 40)))
        if n >= 16:
            one, two = whole[1 : n + 1], turned(whole[-n:])
            mates.append((changed(rng, one, rng.randrange(3)), changed(rng, two, rng.randrange(2))))
            mates.append((turned(changed(rng, whole[-n:], 1)), changed(rng, one, 1)))
    rows = []
    for i, (a, b) in enumerate(mates):
        rows += [(2 * i, 1, i, 1, a), (2 * i + 1, 1, i, 2, b)]
    lost = [(10_000, None, 0, 1, mates[0][0]), (10_001, None, 0, 2, mates[0][1])]
    got = {tuple(r) for r in models.proper_pairs(spark, fastq(spark, tmp_path, rows + lost + rows[:4])).collect()}
    want = brute_proper_pairs(rows)
    assert got == want and len(want) == len(mates) and sum(x[1] != x[2] for x in want) > 10


def test_every_place_within_the_limit_is_found(spark):
    rng = random.Random(2)
    contigs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(180)) for i in range(6)}
    reads = []
    for n in [*range(16, 100), 123, 124, 150]:
        for _ in range(3):
            c = contigs[rng.choice(sorted(contigs))]
            at, most = rng.randrange(len(c) - n + 1), numeric.most_differences(n)
            s = list(c[at : at + n])
            for j in range(most):  # one in the middle of each part
                i = (2 * j + 1) * n // (2 * most)
                s[i] = rng.choice("ACGT".replace(s[i], ""))
            s = "".join(s) if rng.random() < 0.5 else changed(rng, c[at : at + n], most)
            reads.append((len(reads), turned(s) if rng.random() < 0.5 else s))
    covered = [n for n in range(SEED, 3000) if n < SEED * (numeric.most_differences(min(n, 1024)) + 1)]
    assert all(any(low <= n <= high and numeric.most_differences(n) == k for k, low, high, *_ in mapper.PIECES) or n >= mapper.SINGLE * (numeric.most_differences(n) + 1) for n in covered)
    found = mapper.hits(spark.createDataFrame(reads, "key int, seq string"), spark.createDataFrame([*contigs.items()], "name string, seq string"))
    want = sorted((key, reverse, name, at, d) for key, s in reads for name, at, _, reverse, d in brute_places(s, contigs))
    assert sorted(map(tuple, found.collect())) == want and len(want) >= len(reads)
