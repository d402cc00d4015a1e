"""The plans that matter at scale: what is read, shuffled, shared and gathered."""

import re

import pytest

from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


def static_plan(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def executed_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python_in_any_plan(spark, name):
    plan = static_plan(QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert node not in plan, node


@pytest.mark.parametrize("name", ["d9_clean_baseline_retest", "k4_monthly_partner_outliers", "d14_zone_band_gaps",
                                  "d6c_brand_outlets", "e8_segment_summary"])
def test_statistics_share_the_shuffle_of_their_rows(spark, name):
    assert "ReusedExchange" in executed_plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["b1_order_dedup", "e14_repeat_within_30d"])
def test_rows_per_key_are_pruned_before_the_shuffle(spark, name):
    plan = static_plan(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_only_needed_columns_are_read(spark):
    plan = static_plan(QUERIES["e17_promo_revenue_share"](spark, SF))
    columns = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"}


def test_status_filter_turns_the_left_join_inner(spark):
    plan = QUERIES["d8_partner_outliers"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, \(order_id", plan)


@pytest.mark.parametrize("name", ["c15_key_continuation"])
def test_ranking_gathers_no_rows_in_one_task(spark, name):
    """After the ordered slices are written, only one row per slice may meet in one task."""
    plan = static_plan(QUERIES[name](spark, SF))
    for window in re.findall(r"\(\d+\) Window\n.*?\n\n", plan, re.S):
        assert "_slice" in window


def scans(df, table):
    """How often the executed plan reads a table; reused exchanges and subqueries count once."""
    plan = executed_plan(df)
    return len(re.findall(rf"FileScan parquet[^\n]*{table}\.parquet", plan.split("== Initial Plan ==")[0]))


@pytest.mark.parametrize("name", ["e5_rfm_base", "c16_persistence_rates"])
def test_the_latest_order_comes_from_the_rows_already_grouped(spark, name):
    assert scans(QUERIES[name](spark, SF), "orders") == 1


@pytest.mark.parametrize("name", ["e3_retention_matrix", "e15_month_one_retention", "c16_persistence_rates",
                                  "e11_retention_by_first_order"])
def test_months_are_no_sets(spark, name):
    plan = static_plan(QUERIES[name](spark, SF))
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_tables_laid_out_by_order_join_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no side were small
    try:
        plan = executed_plan(QUERIES["d4_segments_from_layers"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_all_grains_come_from_one_scan(spark):
    one, several = (QUERIES[n](spark, SF) for n in ("d10_zone_band_late_rate", "d6_late_rates_by_grain"))
    for table in ("orders", "lineitem", "customer"):
        assert scans(one, table) == scans(several, table)


@pytest.mark.parametrize("name", ["k1_from_kept_counts", "k4_from_kept_counts", "e20_from_kept_counts"])
def test_kept_counts_read_no_orders(spark, name):
    df = QUERIES[name](spark, SF)
    assert scans(df, "orders") == 0 and scans(df, "lineitem") == 0


def test_both_scores_read_the_customers_once(spark):
    df = QUERIES["e6_rfm_scores"](spark, SF)
    assert "Exchange" not in executed_plan(df)  # written once; the borders are literals


@pytest.mark.parametrize("shared,plain", [("d14_zone_band_gaps", "d10_zone_band_late_rate"),
                                          ("k4_monthly_partner_outliers", "k1_rolling_7day_late_rate")])
def test_statistics_read_no_table_again(spark, shared, plain):
    ours, theirs = QUERIES[shared](spark, SF), QUERIES[plain](spark, SF)
    for table in ("orders", "lineitem"):
        assert scans(ours, table) == scans(theirs, table) > 0
