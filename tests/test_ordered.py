import random

from pyspark.sql import functions as F

from lociflow.operators import ordered


def test_against_a_plain_pass(spark):
    rng = random.Random(6)
    data = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([None, 1, 2, 3]), rng.random() < 0.1) for i in range(3000)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, i int, v int, ok boolean").selectExpr("*", "1 as _own", "2 as _in").drop("_own", "_in").repartition(5)
    last, before, want = {}, {}, {}
    for g, i, v, ok in sorted(data, key=lambda r: r[1]):
        previous = before.get(g)
        if ok:
            last[g] = v
        before[g] = v
        want[i] = (last.get(g), previous)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.i: r.carried for r in ordered.carried(df, ["g"], "i", "v", "ok").collect()}
        rows = {r.i: r.previous for r in ordered.with_previous(df, ["g"], "i", F.col("v")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == {i: w[0] for i, w in want.items()}
    assert rows == {i: w[1] for i, w in want.items()}
    assert ordered.carried(df.limit(0), ["g"], "i", "v", "ok").collect() == []
