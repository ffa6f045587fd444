import random

from lociflow.operators import heavy_keys as H


def brute(data):
    out = {}
    for key, value in data:
        out.setdefault(key, []).append(value)
    said = []
    for key, values in out.items():
        seen = [v for v in values if v is not None]
        mean = sum(seen) / len(seen) if seen else None
        ends = (min(seen), max(seen), seen[0], seen[-1]) if seen else (None,) * 4
        said.append((key, len(values), len(seen), mean, *ends, sum(a != b for a, b in zip(seen, seen[1:]))))
    return sorted(said, key=repr)


def frame(spark, data, parts=5):
    chunk = -(-len(data) // parts) or 1
    rdd = spark.sparkContext.parallelize(data, parts)
    assert rdd.glom().map(len).max() <= chunk + 1
    return spark.createDataFrame(rdd, "k int, v int")


def test_ordered_states_meet_at_chunk_borders(spark, rows, monkeypatch):
    monkeypatch.setattr(H, "LEAST_CHUNK", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rng = random.Random(3)
        data = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, 0, 1, 2, 255])) for _ in range(400)]
        df = frame(spark, data)
        assert rows(H.keyed_stats(df, "k", "v")) == brute(data)
        chunks = H.chunk_states(H.folded(df, "k", "v")).filter("key = 1").orderBy("chunk").collect()
        assert len(chunks) > 20 and max(c.n for c in chunks) <= 7 + 5
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edges(spark, rows):
    data = [(None, None), (None, 3), (2, None), (2**31 - 1, -(2**31)), (2, None)]
    assert rows(H.keyed_stats(frame(spark, data, 2), "k", "v")) == brute(data)
    assert rows(H.keyed_stats(spark.createDataFrame([], "k int, v int"), "k", "v")) == []
    clash = spark.createDataFrame([(1, 2, 3, 4)], "k int, v int, key int, part int")
    assert rows(H.keyed_stats(clash, "k", "v")) == [(1, 1, 1, 2.0, 2, 2, 2, 2, 0)]


def test_threshold_counts_all_rows(spark, rows):
    data = [(1, 0)] * 5 + [(2, 0)] * 4 + [(None, 0)] * 91
    assert rows(H.heavy_keys(frame(spark, data), "k", "v")) == [(1, 5)]
    assert rows(H.heavy_keys(spark.createDataFrame([], "k int, v int"), "k", "v")) == []
