"""Streams of several files, and a restart in the middle."""

import pytest
from pyspark.sql import functions as F

from lociflow.streaming import jobs


def written(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_statistics_go_on_over_poor_batches(spark, tmp_path):
    parts = [[(10,)] * 5, [(99,)] * 2, [(30,)] * 6, [(None,)] * 4, [(50,)] * 5]
    at = written(spark, tmp_path / "s", parts, "v int")
    out = {r.batch: (r.n, r.used) for r in jobs.carried_stats(spark, at, "v", "v is not null", 5).collect()}
    assert out == {0: (5, 10.0), 1: (2, 10.0), 2: (6, 30.0), 3: (0, 30.0), 4: (5, 50.0)}


def test_totals_and_counts_over_files(spark, tmp_path):
    at = written(spark, tmp_path / "t", [[("a", 1.0), ("b", 2.0)], [("a", 3.0)], [("c", 4.0), ("a", 0.5)]], "k string, v double")
    assert {r.k: (r.rows, r.total) for r in jobs.running_totals(spark, at, "k", "v").collect()} == {"a": (3, 4.5), "b": (1, 2.0), "c": (1, 4.0)}
    assert {r.k: r.rows for r in jobs.batch_counts(spark, at, "k").collect()} == {"a": 3, "b": 1, "c": 1}


def test_keys_and_mates_meet_across_files(spark, tmp_path):
    t = lambda n: f"2026-01-01 00:00:{n:02d}"
    rows = [[(1, 1, 7, 1, t(1)), (2, 1, 8, 1, t(2))], [(3, 1, 7, 2, t(3)), (1, 1, 7, 1, t(4))], [(4, 1, 9, 2, t(5)), (5, 1, 8, 2, t(6)), (3, 1, 7, 2, t(7))]]
    schema = "read_id bigint, file_id bigint, read_idx bigint, mate int, run_at string"
    for i, part in enumerate(rows):
        df = spark.createDataFrame(part, schema).withColumn("run_at", F.to_timestamp("run_at"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    at = str(tmp_path / "m")
    assert sorted(r.read_id for r in jobs.first_of_key(spark, at, ["read_id"], "run_at", "1 hour").collect()) == [1, 2, 3, 4, 5]
    pairs = sorted(tuple(r) for r in jobs.mate_stream(spark, at, "1 hour").collect())
    assert pairs == [(1, 7, 1, 3), (1, 8, 2, 5)]


def test_a_job_goes_on_where_it_stopped(spark, tmp_path):
    at = written(spark, tmp_path / "r", [[(1,)], [(2,)], [(3,)]], "v int")
    seen = []

    def step(batch, n, folder):
        if n == 1 and not seen.count("failed"):
            seen.append("failed")
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={n}")

    to = str(tmp_path / "out")
    with pytest.raises(Exception, match="lost"):
        jobs.each_batch(jobs.stream(spark, at), "again", step, to=to)
    assert jobs.each_batch(jobs.stream(spark, at), "again", step, to=to) == to
    assert sorted(r.v for r in spark.read.parquet(f"{to}/rows").collect()) == [1, 2, 3]


def test_many_small_files_are_few_batches(spark, tmp_path, monkeypatch):
    at = written(spark, tmp_path / "d", [[(i % 7, f"2026-01-0{1 + i % 7}")] for i in range(12)], "k int, t string")
    places, place = [], jobs.place
    monkeypatch.setattr(jobs, "place", lambda *a: places.append(place(*a)) or places[-1])

    def batches(size):
        monkeypatch.setattr(jobs, "LARGE", size)
        assert sorted(r.k for r in jobs.first_of_key(spark, at, ["k"], "t", "30 days").collect()) == [*range(7)]
        return sum(not f.name.startswith(".") for f in (type(tmp_path)(places[-1].removeprefix("file:")) / "state" / "sources" / "0").iterdir())

    assert batches(jobs.LARGE) == 1 and batches(1) == 12


@pytest.mark.parametrize("size", [1, jobs.LARGE])
def test_all_reads_of_a_mate_meet_once(spark, tmp_path, monkeypatch, size):
    """As in SQL, two reads of one mate are two pairs; repeated deliveries are none, in the same batch or later."""
    monkeypatch.setattr(jobs, "LARGE", size)
    t = lambda n: f"2026-01-01 00:00:{n:02d}"
    parts = [[(1, 1, 7, 1, t(1)), (1, 1, 7, 1, t(2))], [(2, 1, 7, 1, t(3)), (4, 2, 7, 2, t(3))], [(3, 1, 7, 2, t(4)), (5, None, 7, 1, t(4))], [(3, 1, 7, 2, t(5)), (2, 1, 7, 1, t(9)), (6, None, 7, 2, t(9))]]
    schema = "read_id bigint, file_id bigint, read_idx bigint, mate int, run_at string"
    at = written(spark, tmp_path / "m", parts, schema)
    assert sorted(tuple(r) for r in jobs.mate_stream(spark, at, "1 hour").collect()) == [(1, 7, 1, 3), (1, 7, 2, 3)]
