import random

from lociflow.operators.distinct_rows import first_rows


def test_both_ways_keep_one_row_a_key(spark, rows, tmp_path, monkeypatch):
    rng = random.Random(4)
    data = [(i if rng.random() < 0.95 else None, f"text {i % 40}", i % 3) for i in range(500) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    data = [(k, t if k is not None else "none", n if k is not None else 0) for k, t, n in data]
    spark.createDataFrame(data, "k bigint, t string, _slot int").withColumnRenamed("_slot", "n").repartition(5).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    want = sorted(set(data), key=repr)
    assert rows(first_rows(df, "k")) == want and rows(first_rows(df, "k", wide=0)) == want
    plan = first_rows(df, "k", wide=0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(k") == 1  # of the repeated rows
    assert first_rows(df.limit(0), "k", wide=0).collect() == []
