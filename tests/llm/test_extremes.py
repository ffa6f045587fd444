"""Very long texts, infinities, ties and single rows."""

import random

from lociflow.llm import bagminhash, bpe, iceberg, quantiles, redelivered, repeats, winnow


def test_long_reads_and_names(spark, rows):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(20_000))
    other = seq[:5_000] + "T" + seq[5_000:15_000] + seq[15_001:]
    name = ":".join(str(rng.randint(1, 10**9)) for _ in range(2_000))
    data = [(1, name, seq), (2, name + ":dup/1", other), (3, name, seq[:10_000]), (4, "a:b:c:d:e:f:g", "N" * 30_000), (5, "g#f#e#d#c#b#a", "." * 29_000), (6, "", "A"), (7, " x", "A")]
    df = spark.createDataFrame(data, "read_id bigint, name string, seq string")
    assert rows(redelivered.delivered_again(df)) == [(1, 2), (4, 5)]
    assert rows(redelivered.delivered_again(df.filter("read_id = 1"))) == []
    assert {r.read_id: r.links for r in bagminhash.weighted_links(df).collect()}.keys() == {1, 2, 3, 4, 5, 6, 7}


def test_same_read_a_hundred_times(spark):
    df = spark.createDataFrame([(i, "a:b:c:d:e:f:g", "ACGTACGTAC") for i in range(100)], "read_id bigint, name string, seq string")
    assert redelivered.delivered_again(df).count() == 4950


def test_infinite_values(spark):
    df = spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (1, 0.0)], "g int, v double")
    got = {r.percentile: r.value for r in quantiles.grouped_percentiles(df, ["g"], "v").collect()}
    assert got[5] == float("-inf") and got[50] == 0.0 and got[99] == float("inf")
    assert [r.value for r in quantiles.grouped_percentiles(df, [], "v", (50,)).collect()] == [0.0]


def test_long_documents(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(200_000)]
    item = " ".join(words[150_000:150_012])
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "x" * 300_000), (3, "語" * 100_000), (4, "again " * 100_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item), (8, "again " * 30)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in winnow.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()) == [(1, 7), (4, 8)]
    book = {r.doc_id: r for r in repeats.ledger(docs, "doc_id", "text").collect()}
    assert (book[1].n_words, book[1].failed & 1) == (200_000, 0) and book[4].failed & 1 and book[2].n_words == 1
    ids = {r.doc_id: len(r.ids) for r in bpe.encode_texts(docs, "doc_id", "text").collect()}
    assert all(n > 10_000 for n in ids.values())


def test_long_values_and_ties(spark):
    df = spark.createDataFrame([("A" * 100_000,), ("C" * 100_000,)] * 2, "seq string")
    assert sorted(r.n for r in iceberg.frequent_items(df, iceberg.bases(), 0.5).collect()) == [2, 2]
