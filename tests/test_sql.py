from lociflow.functions import sql


def test_functions_in_sql_text(spark):
    assert set(sql.register(spark)) >= {"norm_chrom", "majority_base"}
    sql.register(spark)  # again
    row = spark.sql(
        r"""select norm_chrom('chr7') as a, norm_chrom(null) as b, reverse_complement('ACgtN') as c, plain_read_name('r1/2') as d, plain_read_name('r\\1') as e, round(phred(phred_probability(13)), 6) as f,
        count_bases('AcGN', 'gc') as g, reference_length(array(named_struct('len', 3, 'op', 'S'), named_struct('len', 7, 'op', 'M'), named_struct('len', 2, 'op', 'D'))) as h, flag_set(20, 16) as i"""
    ).first()
    assert tuple(row)[:2] == ("7", None)
    assert row.c == "NacGT" and (row.d, row.e, row.f, row.g, row.h, row.i) == ("r1", "r", 13.0, 2, 9, True)
    df = spark.createDataFrame([(1, "A"), (1, "C"), (1, "A"), (2, "T"), (2, "G"), (3, None), (3, "N")], "k int, b string")
    df.createOrReplaceTempView("own_bases")
    assert {r.k: r.m for r in spark.sql("select k, majority_base(b) as m from own_bases group by k").collect()} == {1: "A", 2: "G", 3: "N"}
