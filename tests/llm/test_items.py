import math
import random
from collections import Counter

import numpy as np
import pytest

from lociflow.llm import bagminhash as B
from lociflow.llm import components, iceberg, quantiles
from lociflow.llm import redelivered as D


def rank_ok(sorted_values, value, share, error=0.01):
    n = len(sorted_values)
    low, high = np.searchsorted(sorted_values, value), np.searchsorted(sorted_values, value, side="right")
    return low <= (share + error) * n and high >= (share - error) * n


@pytest.mark.parametrize("shape", ["lognormal", "ties", "sorted", "reversed"])
def test_sketch_error_and_merging(shape):
    rng = np.random.default_rng(1)
    values = {
        "lognormal": rng.lognormal(5, 2, 300_000),
        "ties": rng.integers(0, 5, 300_000).astype(float),
        "sorted": np.arange(300_000.0),
        "reversed": np.arange(300_000.0)[::-1],
    }[shape]
    whole, parts = quantiles.Sketch(), []
    for block in np.array_split(values, 40):
        whole.update(block)
        one = quantiles.Sketch()
        for x in np.array_split(block, 7):
            one.update(x)
        parts.append(quantiles.Sketch.from_bytes(one.to_bytes()))
    union = parts[0]
    for p in parts[1:]:
        union.merge(p)
    ordered = np.sort(values)
    shares = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 0.9999]
    for sketch in (whole, union):
        assert sketch.n == len(values)
        assert sum(len(x) for x in sketch.levels) < 20_000
        for s, v in zip(shares, sketch.quantiles(shares)):
            assert rank_ok(ordered, v, s, max(0.0005, 0.02 * (1 - s))), (shape, s)


def test_grouped_percentiles(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float("nan"), rng.gauss(0, 1)]), 1) for _ in range(30_000)]
    df = spark.createDataFrame(data, "g string, v double, n int").repartition(6)
    by = {}
    for g, v, _ in data:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    out = quantiles.grouped_percentiles(df, ["g"], "v").collect()
    assert len(out) == 3 * len(quantiles.PERCENTILES)
    for r in out:
        assert r.n == len(by[r.g]) and rank_ok(np.sort(by[r.g]), r.value, r.percentile / 100)
    assert quantiles.grouped_percentiles(df.limit(0), ["g"], "v").collect() == []
    assert quantiles.grouped_percentiles(df.selectExpr("g", "cast(null as int) as v"), ["g"], "v").collect() == []
    few = spark.createDataFrame([("x", i) for i in range(1, 101)], "g string, v int")
    exact = {r.percentile: r.value for r in quantiles.grouped_percentiles(few, ["g"], "v").collect()}
    assert exact == {p: float(p) for p in quantiles.PERCENTILES}


def test_flushing_keeps_all_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", 500)
    df = spark.range(4000).selectExpr("id % 50 as g", "id as v").repartition(3)
    assert {r.n for r in quantiles.grouped_percentiles(df, ["g"], "v").collect()} == {80}


def test_frequent_items(spark, rows):
    rng = random.Random(3)
    data = [(rng.choice(["acgt", "ACGT", "AC.T", "ACNT", "", None, *("ACGT" * 3 + c * n for c in "ACG" for n in range(1, 60))]),) for _ in range(3000)]
    df = spark.createDataFrame(data, "seq string").selectExpr("*", "1 as n", "2 as value")
    counts = Counter("".join(c if c in "ACGT" else "N" for c in s.upper()) for (s,) in data if s is not None)
    total = sum(counts.values())
    for share in (0.005, 0.01, 1.0):
        want = sorted((v, n) for v, n in counts.items() if n >= share * total)
        found = iceberg.frequent_items(df, iceberg.bases(), share)
        assert rows(found.select("value", "n")) == want
    assert rows(iceberg.frequent_items(df.limit(0), iceberg.bases(), 0.1)) == []
    assert rows(iceberg.frequent_items(spark.createDataFrame([("A",)] * 3 + [("C",)], "seq string"), iceberg.bases(), 0.25).select("value", "n")) == [("A", 3), ("C", 1)]


def test_small_shares_size_the_buckets(spark, rows, monkeypatch):
    assert iceberg.buckets_for(iceberg.Fraction("0.005")) == 1 << 14 and iceberg.buckets_for(iceberg.Fraction(1)) == 1 << 12
    assert iceberg.buckets_for(iceberg.Fraction("0.00001")) >= 64 * 100_000
    df = spark.range(3000).selectExpr("cast(if(id % 3 = 0, id % 7, id) as string) as seq")
    want = rows(iceberg.frequent_items(df, iceberg.bases(), 0.01).select("value", "n"))
    monkeypatch.setattr(iceberg, "LISTED", 10)
    assert rows(iceberg.frequent_items(df, iceberg.bases(), 0.01).select("value", "n")) == want


def test_stored_sketches_combine(spark):
    df = spark.range(60_000).selectExpr("id % 3 as g", "id % 14 as day", "cast(pow(id % 997, 2) as double) as v").repartition(9)
    days = quantiles.described(quantiles.sketches(df, ["g", "day"], "v"))
    assert {r.n for r in days.collect()} <= set(range(1400, 1500)) and days.count() == 42
    whole = {(r.g, r.percentile): r for r in quantiles.percentiles(quantiles.merged(days, ["g"]), ["g"]).collect()}
    for g in range(3):
        values = np.sort(np.array([float((i % 997) ** 2) for i in range(g, 60_000, 3)]))
        for p in quantiles.PERCENTILES:
            assert whole[g, p].n == len(values) and rank_ok(values, whole[g, p].value, p / 100)


def test_equal_partitions_flip_apart():
    values = np.arange(50_000.0)
    parts = [quantiles.Sketch(i) for i in range(64)]
    for s in parts:
        s.update(values)
        s.compress()
    assert len({s.to_bytes() for s in parts}) > 32


@pytest.mark.parametrize("weights", [[1.0, 2.0, 3.0, 5.0, 7.0, 40.0, 700.0], [0.25, 0.5, 1.5, 2.75, 3.1]])
def test_signatures_estimate_weighted_jaccard(weights):
    rng = np.random.default_rng(4)
    for _ in range(5):
        a = dict(zip(range(40), rng.choice(weights, 40)))
        b = {k + int(rng.integers(0, 2)) * 100: v if rng.random() < 0.7 else rng.choice(weights) for k, v in a.items()}
        keys = set(a) | set(b)
        truth = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
        bag = np.r_[np.zeros(len(a), int), np.ones(len(b), int)]
        element = B.mixed(np.array([*a, *b], np.uint64) + np.uint64(rng.integers(1, 1 << 40)))
        weight = np.array([*a.values(), *b.values()])
        m = 4096
        values = B.signatures(bag, element, weight, 2, m)
        assert abs((values[0] == values[1]).mean() - truth) < 5 * math.sqrt(0.25 / m)
    assert np.isinf(B.signatures(bag, element, np.zeros(len(bag)), 3, 4)).all()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def strand(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def mutate(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        at = rng.randrange(len(s) + 1)
        kind = rng.choice("sid")
        if kind == "i":
            s.insert(at, rng.choice("ACGTN"))
        elif s and at < len(s):
            s[at : at + 1] = [rng.choice("ACGTN")] if kind == "s" else []
    return "".join(s)


def test_within_is_the_edit_distance():
    rng = random.Random(6)
    code = lambda s: np.array(["ACGTN".index(c) + 1 for c in s], np.uint8)
    for _ in range(300):
        a = "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 40)))
        b = mutate(rng, a, rng.randint(0, 8))
        d = edit_distance(a, b)
        for most in range(0, 8):
            assert D.within(code(a), code(b), most) == (d <= most)


def reads_with_copies(rng, n=120, hot=0, same_tile=True):
    out, read_id = [], 0
    for _ in range(n):
        name = ["ins", "7", "FC1", str(rng.randint(1, 3)), str(rng.randint(1, 4)), str(rng.randint(1, 10**6)), str(rng.randint(1, 10**6))]
        seq = "".join(rng.choice("ACGT") for _ in range(rng.randint(20, 120)))
        for _ in range(rng.choice([1, 1, 2, 3])):
            other, s = list(name), mutate(rng, seq, rng.choice([0, 1, 2, len(seq) // 10, len(seq) // 8]))
            if rng.random() < 0.4:
                other[rng.randrange(7)] = str(rng.randint(1, 10**6))
            if rng.random() < 0.3:
                rng.shuffle(other)
            if rng.random() < 0.2:
                other.insert(rng.randrange(8), "dup")
            s = strand(s) if rng.random() < 0.3 else s
            tail = rng.choice(["", "/1", "/2", " 1:N:0:ACGT"])
            text = rng.choice(":_.|#").join(other) + tail
            read_id += 1
            out.append((read_id, text.upper() if rng.random() < 0.3 else text, s.lower() if rng.random() < 0.3 else s.replace("N", ".")))
    for _ in range(hot):
        read_id += 1
        out.append((read_id, "ins:7:FC1:1:1:0:0", mutate(rng, rng.choice(["ACGTTGCA" * 8, "G" * 60]), rng.randint(0, 5))))
    return out


def brute_pairs(data):
    import re

    rows = set()
    for i, name, seq in data:
        if None in (i, name, seq):
            continue
        tokens = re.split(r"[:_.|#]", re.sub(r"/[12]\Z", "", name.split(" ")[0]).lower())
        rows.add((i, tuple(tokens), re.sub("[^ACGT]", "N", seq.upper())))
    rows, out = sorted(rows), set()
    for x, (i, ta, sa) in enumerate(rows):
        for j, tb, sb in rows[x + 1 :]:
            if i != j and sum((Counter(ta) & Counter(tb)).values()) >= 6:
                most = max(len(sa), len(sb)) // 10
                if min(edit_distance(sa, sb), edit_distance(sa, strand(sb))) <= most:
                    out.add((i, j))
    return sorted(out)


def test_pairs_against_brute_force(spark, rows):
    data = reads_with_copies(random.Random(7))
    data += [data[0], (None, *data[1][1:]), (5001, None, data[1][2]), (5002, data[1][1], None), (5003, "a:b:c:d:e:f", ""), (5004, "a.b.c.d.e.f/1", ""), (5005, "", "")]
    df = spark.createDataFrame(data, "read_id bigint, name string, seq string").selectExpr("*", "1 as a", "2 as bucket", "3 as id")
    truth = brute_pairs(data)
    assert rows(D.delivered_again(df)) == sorted(truth, key=repr) and len(truth) > 30
    assert rows(D.delivered_again(df.limit(0))) == []


def test_hot_names_and_tokens_go_the_other_way(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "BUCKET", 8)
    monkeypatch.setattr(D, "RARE", 20)
    data = reads_with_copies(random.Random(9), n=40, hot=40)
    df = spark.createDataFrame(data, "read_id bigint, name string, seq string").repartition(3)
    truth, found = brute_pairs(data), rows(D.delivered_again(df))
    assert len(truth) > 300 and set(found) <= set(truth)
    assert len(found) >= 0.97 * len(truth)


def test_hot_names_lose_no_pair_at_the_edit_limit(spark, rows, monkeypatch):
    monkeypatch.setattr(D, "BUCKET", 8)
    monkeypatch.setattr(D, "RARE", 20)
    rng, data = random.Random(21), [(5000, "ins:7:FC1:1:1:0:0", ""), (5001, "ins:7:FC1:1:1:0:0", "ACGTA"), (5002, "ins:7:FC1:1:1:0:0", "TACGT")]
    for i in range(60):  # evenly spaced substitutions hit nearly every 8-mer
        seq = "".join(rng.choice("ACGT") for _ in range(rng.choice([10, 20, 20, 29, 30, 45, 70])))
        other, edits = list(seq), len(seq) // 10
        for j in range(edits):
            at = (2 * j + 1) * len(seq) // (2 * edits)
            other[at] = rng.choice("ACGT".replace(other[at], "")) if i % 2 else rng.choice(["", other[at] + rng.choice("ACGT")])
        other = "".join(other)
        data += [(2 * i, "ins:7:FC1:1:1:0:0", seq), (2 * i + 1, "ins:7:FC1:1:1:0:0", strand(other) if i % 3 else other)]
    df = spark.createDataFrame(data, "read_id bigint, name string, seq string").repartition(3)
    truth = brute_pairs(data)
    assert len(truth) > 55
    assert rows(D.delivered_again(df)) == sorted(truth, key=repr)


def brute_bags(data, rare):
    """Class (sequence on either strand and tokens) and bag of each read; weights as documented."""
    import re

    reads = {}
    for i, name, seq in data:
        if None not in (i, name, seq):
            words = sorted(re.split(r"[:_.|#]", re.sub(r"/[12]\Z", "", name.split(" ")[0]).lower()))
            own = re.sub("[^ACGT]", "N", seq.upper())
            reads.setdefault(i, set()).add((min(own, strand(own)), tuple(words)))
    kept = [(i, c) for i, name, seq in data if None not in (i, name, seq) for c in reads[i]]
    n, df, copies = len(kept), Counter(t for _, c in kept for t in set(c[1])), Counter(c[0] for _, c in kept)
    bags = {}
    for _, (seq, words) in kept:
        bag = Counter()
        if copies[seq] <= B.COPIES:
            runs = [seq[k : k + B.K] for k in range(len(seq) - B.K + 1)]
            bag.update(min(r, strand(r)) for r in runs)
        for t in words:
            bag["token", t] += B.TOKEN_WEIGHT * max(0, min(B.MOST, int(math.log2(n / df[t])) - rare))
        bags[seq, words] = bag
    return reads, bags


def test_weighted_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "FREE", 2)
    data = [r for r in reads_with_copies(random.Random(5), n=150)]
    data += [(9000 + i, f"{i}:x:y", "ACGTACGGTTACGATT") for i in range(30)]  # a sequence of many reads
    data += [data[3], (None, *data[1][1:]), (5001, None, "A"), (5002, "x:y", None), (5003, "", ""), (5004, "", "")]
    reads, bags = brute_bags(data[:-6] + data[-5:], B.FREE)
    df = spark.createDataFrame(data[:-6] + data[-5:], "read_id bigint, name string, seq string").selectExpr("*", "1 as class", "2 as key", "3 as id").repartition(3)
    truth, classes = Counter(), list(bags)
    for x, a in enumerate(classes):
        for b in classes[x + 1 :]:
            common, every = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            if every and common >= B.SIMILAR * every:
                truth[a] += 1
                truth[b] += 1
    out = B.weighted_links(df).collect()
    assert sorted(r.read_id for r in out) == sorted(i for i in reads for _ in reads[i])
    found = {}
    for r in out:
        (c,) = reads[r.read_id]
        assert found.setdefault(c, (r.class_id, r.links)) == (r.class_id, r.links)
        assert r.links <= truth[c] and (r.links == 0) == (r.similarity is None)
    assert len({c for c, _ in found.values()}) == len(found)
    for r in out[:200]:
        if r.links:
            a = next(iter(reads[r.read_id]))
            b = next(c for c, (own, _) in found.items() if own == r.closest)
            assert abs(r.similarity - sum((bags[a] & bags[b]).values()) / sum((bags[a] | bags[b]).values())) < 1e-6 and abs(r.estimate - r.similarity) < 0.5
    recall = sum(n for _, n in found.values()) / sum(truth.values())
    assert sum(truth.values()) > 100 and recall >= 0.9
    assert B.weighted_links(df.limit(0)).collect() == []


def test_crowded_buckets_lose_no_more(spark, monkeypatch):
    data = reads_with_copies(random.Random(8), n=60)
    df = spark.createDataFrame(data, "read_id bigint, name string, seq string").repartition(3)
    monkeypatch.setattr(B, "FREE", 0)
    links = lambda: {r.read_id: r.links for r in B.weighted_links(df).collect()}
    all_of = links()
    monkeypatch.setattr(B, "CROWD", 1)  # every bucket is crowded
    assert sum(all_of.values()) > 40 and sum(links().values()) >= 0.9 * sum(all_of.values())


def crowd_of_reads(rng):
    """Reads that share an adapter and part of a name."""
    adapter, out = "".join(rng.choice("ACGT") for _ in range(80)), []
    for _ in range(150):
        seq = adapter + "".join(rng.choice("ACGT") for _ in range(rng.choice([10, 20, 40, 60])))
        name = ["ins", "7", "FC1", "1", str(rng.randint(1, 3)), str(rng.randint(1, 10**6)), str(rng.randint(1, 10**6))]
        for _ in range(rng.choice([1, 1, 2, 3])):
            other = list(name)
            if rng.random() < 0.5:
                other[rng.randrange(7)] = str(rng.randint(1, 10**6))
            out.append((len(out), ":".join(other), mutate(rng, seq, rng.choice([0, 1, 4]))))
    return out


def test_crowded_buckets_lose_no_pair(spark, rows, monkeypatch):
    df = spark.createDataFrame(crowd_of_reads(random.Random(31)), "read_id bigint, name string, seq string").repartition(3)
    monkeypatch.setattr(B, "FREE", 6)
    monkeypatch.setattr(B, "CROWD", 10**6)  # no bucket is crowded, all pairs of each are verified
    want = rows(B.weighted_links(df))
    assert sum(r[2] for r in want) > 300
    for crowd in (20, 1):
        monkeypatch.setattr(B, "CROWD", crowd)
        assert rows(B.weighted_links(df)) == want


def test_hot_sequences_are_told_exactly(spark, rows, monkeypatch):
    data = reads_with_copies(random.Random(32), n=60) + [(9000 + i, f"{i}:x:y", "ACGTACGGTTACGATT") for i in range(B.COPIES + 1)]
    df = spark.createDataFrame(data, "read_id bigint, name string, seq string").repartition(3)
    monkeypatch.setattr(B, "FREE", 0)
    want = rows(B.weighted_links(df))
    monkeypatch.setattr(B, "_bitmap", lambda keys: np.full(1 << (B.BITS - 3), 255, np.uint8))  # every sequence falls on a bit of a hot one
    assert rows(B.weighted_links(df)) == want


def test_copies_of_hot_sequences_are_all_linked(spark, monkeypatch):
    monkeypatch.setattr(B, "FREE", 2)
    rng = random.Random(33)
    data = [(9000 + i, ":".join(str(rng.randint(1, 10**6)) for _ in range(rng.choice([2, 3, 4]))) + ":x:y", seq) for seq in ("ACGTACGGTTACGATTCAGGATTACC" * 2, "GGATTCCATT" * 6) for i in range(40)]
    for i, name, seq in data[:80]:  # delivered again with one to three edits and with other tokens, of the hot sequence or another
        other = name.split(":")
        if rng.random() < 0.4:
            other[rng.randrange(len(other))] = rng.choice(["x", str(rng.randint(1, 10**6))])
        data.append((i + 1000, ":".join(other), mutate(rng, strand(seq) if i % 2 else seq, rng.choice([0, 1, 3, 30]))))
    data = [(n, *r[1:]) for n, r in enumerate(reads_with_copies(rng, n=60) + data)]
    reads, _ = brute_bags(data, B.FREE)
    kept = [next(iter(reads[i])) for i in sorted(reads)]
    df, copies, classes = Counter(t for c in kept for t in set(c[1])), Counter(c[0] for c in kept), sorted(set(kept))
    hot = {seq for seq, n in copies.items() if n > B.COPIES}
    runs = {c: Counter(min(r, strand(r)) for r in (c[0][k : k + B.K] for k in range(len(c[0]) - B.K + 1))) for c in classes}
    name = {c: Counter({t: n * B.TOKEN_WEIGHT * max(0, min(B.MOST, int(math.log2(len(kept) / df[t])) - B.FREE)) for t, n in Counter(c[1]).items()}) for c in classes}

    def similarity(a, b):
        gone = {r for c in (a, b) if c[0] in hot for r in runs[c]}
        x, y = (Counter({r: n for r, n in runs[c].items() if r not in gone}) + Counter({("t", t): n for t, n in name[c].items()}) for c in (a, b))
        return sum((x & y).values()) / max(1, sum((x | y).values()))

    found = {kept[r.read_id]: r for r in B.weighted_links(spark.createDataFrame(data, "read_id bigint, name string, seq string").repartition(3)).collect()}
    truth = {c: [s for o in classes if o != c and (c[0] in hot or o[0] in hot) and (s := similarity(c, o)) >= B.SIMILAR] for c in classes}
    assert len(hot) == 2 and sum(len(truth[c]) for c in classes if c[0] in hot) > 40 and sum(len(truth[c]) for c in classes if c[0] not in hot) > 20
    for c in classes:
        if c[0] in hot:
            assert found[c].links == len(truth[c])
            assert not truth[c] or abs(found[c].similarity - max(truth[c])) < 1e-6 and abs(found[c].estimate - found[c].similarity) < 0.5
        else:
            assert found[c].links >= len(truth[c])


def test_groups_against_union_find(spark):
    rng = random.Random(12)
    pairs = [(rng.randint(1, 400), rng.randint(1, 400)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1300)] + [(2000, i) for i in range(2001, 2100)]
    pairs += [(5, 5), (7, None), pairs[0], pairs[0][::-1]]
    rng.shuffle(pairs)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    links = {frozenset(p) for p in pairs if None not in p and p[0] != p[1]}
    for x, y in (sorted(p) for p in links):
        low, high = sorted((find(x), find(y)))
        root[high] = low
    df = spark.createDataFrame(pairs, "a bigint, b bigint").selectExpr("*", "1 as u", "2 as id")
    want = {x: (find(x), sum(x in p for p in links)) for p in links for x in p}
    assert {r.id: (r.group_id, r.links) for r in components.groups(df).collect()} == want
    assert components.groups(df.limit(0)).collect() == []
