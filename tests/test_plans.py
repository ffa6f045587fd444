import os

import pytest

import __spark_entry__ as entry
from lociflow.operators import heavy_keys
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.DATA), reason="needs the test tables")


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    return entry.queries()[name](spark, oracle.DATA)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "src_s17_region_scan")
    assert "EqualTo(reference_id,958)" in text and "GreaterThanOrEqual(pos,121692000)" in text
    assert "ReadSchema: struct<rec_id:bigint,reference_id:int,pos:int>" in text
    assert "ReadSchema: struct<file_id:bigint,flag:int>" in plan(spark, "agg_a22_flag_counters")


def test_malformed_lines_are_parsed_once(spark):
    for name in ("p1_found", "p1_reads", "p1_report"):
        assert plan(spark, name).count("ArrowEvalPython") == 1


def test_heavy_keys_read_two_columns_once(spark):
    records = spark.read.parquet(f"{oracle.DATA}/sam_records.parquet")
    text = heavy_keys.folded(records, "reference_id", "mapq")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<reference_id:int,mapq:int>" in text and text.count("Scan parquet") == 1
    assert "Scan parquet" not in plan(spark, "p3_reference_stats")  # from the written pieces


@pytest.mark.parametrize("name", ["agg_a01_depth", "agg_a12_pileup", "agg_a15_genotype_likelihoods", "join_f28_pair_status", "win_w05_region_collapse", "flt_p20_mismatches"])
def test_relational_operators_stay_in_the_jvm(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "MapInArrow" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("name", ["join_j02_region_intersect", "join_j03_point_in_region", "join_j16_callable_overlap", "join_j17_overlap_half_open", "join_j13_offset_to_contig"])
def test_interval_joins_are_equi_joins(spark, name):
    text = plan(spark, name)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_ends_are_folded_before_the_shuffle(spark):
    text = plan(spark, "agg_a01_depth")  # by the sweep: a read sends its ends, no base
    assert "partial_sum" in text and text.count("Generate explode(sequence(beg") == 1


@pytest.mark.parametrize("name", ["agg_a12_pileup", "agg_a15_genotype_likelihoods", "join_j05_bases_at_markers", "join_j10_markers_with_depth", "src_s19_pileup_scan"])
def test_markers_meet_blocks_before_any_base_is_looked_up(spark, name):
    text = plan(spark, name)
    assert "sequence(0, (_b" not in text and "sequence(0, _b" not in text and "Join [chrom" in text
