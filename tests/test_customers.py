from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orderloom.operators import customer_kpis as growth
from orderloom.operators import customers as cust
from orderloom.operators import prep
from workload.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = ("order_id bigint, customer_id string, order_placed_at timestamp_ntz, total decimal(18,2), "
          "discount_construct string, order_status string, customer_complaint_tag string")


def orders(spark, *rows):
    """(customer, 'yyyy-mm-dd', total, discounted)"""
    from decimal import Decimal

    data = [(i, c, d and datetime.fromisoformat(d), Decimal(t), "promo" if p else None, "Delivered", None)
            for i, (c, d, t, p) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def test_retention_counts_month_boundaries(spark):
    df = orders(spark, ("a", "2024-09-30", 1, 0), ("a", "2024-10-01", 1, 0), ("a", "2024-10-20", 1, 0),
                ("b", "2024-09-01", 1, 0), ("b", "2025-01-31", 1, 0), (None, "2024-09-01", 1, 0), ("c", None, 1, 0))
    got = {(r.cohort_month, r.months_since_first_order): (r.active_customers, r.cohort_size, r.retention_rate)
           for r in cust.retention_matrix(df).collect()}
    assert got == {("2024-09", 0): (2, 2, 100.0), ("2024-09", 1): (1, 2, 50.0), ("2024-09", 4): (1, 2, 50.0)}
    late = growth.month_one_retention(df).collect()
    assert [(r.cohort_month, r.retention_rate) for r in late] == [("2024-09", 50.0)]


def test_undated_orders_appear_as_unknown_offset(spark):
    df = orders(spark, ("a", "2024-09-30", 1, 0), ("a", None, 1, 0))
    assert {r.months_since_first_order for r in cust.retention_matrix(df).collect()} == {0, None}


def test_every_cohort_starts_complete(spark):
    rows = QUERIES["e3_retention_matrix"](spark, SF).where("months_since_first_order = 0").collect()
    assert rows and all(r.retention_rate == 100.0 for r in rows)


def test_first_order_decides_and_ties_fall_to_the_lower_id(spark):
    df = orders(spark, ("a", "2024-09-01", 1, 1), ("a", "2024-09-01", 1, 0), ("b", "2024-09-02", 1, 1),
                ("b", "2024-09-01", 1, 0), ("c", None, 1, 1), ("c", "2024-09-05", 1, 0))
    got = {r.customer_id: r.first_order_had_discount for r in cust.first_order_attribute(df).collect()}
    assert got == {"a": True, "b": False, "c": False}
    sizes = {r.first_order_had_discount: r.cohort_size for r in cust.retention_by_first_order(df)
             .where("months_since_first_order = 0").collect()}
    assert sizes == {True: 1, False: 2}


@pytest.mark.parametrize("r,f,m,name", [(5, 4, 5, "Champions"), (5, 4, 4, "Loyal"), (4, 1, 5, "Loyal"),
                                        (4, 1, 4, "Other"), (2, 3, 3, "At-risk"), (1, 1, 1, "Churned"), (3, 4, 5, "Other")])
def test_segment_rules(spark, r, f, m, name):
    df = spark.createDataFrame([(r, f, m)], "r_score bigint, f_score bigint, m_score bigint")
    assert cust.rfm_segments(df).first().rfm_segment == name


def test_rfm_scores_are_balanced_fifths(spark):
    scored = QUERIES["e6_rfm_scores"](spark, SF)
    for score in ("r_score", "m_score"):
        sizes = [r["count"] for r in scored.groupBy(score).count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_shares_sum_to_a_hundred(spark):
    shares = QUERIES["e8_segment_summary"](spark, SF).agg(F.sum("share_pct")).first()[0]
    assert abs(shares - 100) < 0.03


def test_repeat_within_thirty_days(spark):
    df = orders(spark, ("a", "2024-09-01", 1, 0), ("a", "2024-10-01", 1, 0), ("b", "2024-09-01", 1, 0),
                ("b", "2024-10-02", 1, 0), ("c", "2024-09-05", 1, 0), ("c", "2024-09-05", 1, 0), ("d", "2024-09-09", 1, 0))
    row = growth.repeat_within(df).first()
    assert (row.cohort_size, row.repeat_within_30d_count, row.repeat_rate_30d_pct) == (4, 2, 50.0)


def test_one_time_and_promo_revenue(spark):
    df = orders(spark, ("a", "2024-09-01", 30, 1), ("b", "2024-09-01", 50, 0), ("b", "2024-10-01", 20, 1))
    once = growth.one_time_revenue(df).first()
    assert (once.one_time_customer_revenue, once.total_cohort_revenue, once.pct_one_time) == (30.0, 100.0, 30.0)
    months = {r.order_month: r for r in growth.outside_band(growth.promo_revenue_share(df)).collect()}
    assert months["2024-09"].pct_promo_dependent == 37.5 and months["2024-09"].is_outside_band
    assert months["2024-10"].pct_promo_dependent == 100.0


def test_sensitivity_is_strict_about_the_threshold(spark):
    df = orders(spark, ("a", "2024-09-01", 60, 1), ("a", "2024-09-02", 0, 0), ("b", "2024-09-01", 40, 1))
    got = {r.threshold_pct: r.revenue_share_pct for r in cust.promo_share_sensitivity(df).collect()}
    assert got[45] == 100.0 and got[50] == 40.0


def test_spend_concentration_of_ten_customers(spark):
    df = orders(spark, *[(f"c{i}", "2024-09-01", i, 1) for i in range(1, 11)])
    got = {r.top_pct: (r.customers, r.top_revenue) for r in cust.spend_concentration(df).collect()}
    assert got == {10: (1, 10.0), 20: (2, 19.0)}


def test_complaints_skip_unserved_and_unknown_status(spark):
    df = orders(spark, *[("a", "2024-09-01", 1, 0)] * 5).withColumns({
        "order_status": F.element_at(F.array(*map(F.lit, ["Delivered", "Rejected", "Picked up", "Timed out"]), F.lit(None).cast("string")),
                                     (F.col("order_id") + 1).cast("int")),
        "customer_complaint_tag": F.when(F.col("order_id") < 2, "Wrong item")})
    row = growth.complaint_rate(df).first()
    assert (row.total_orders, row.complaint_count, row.complaint_rate_per_100) == (2, 1, 50.0)


def test_maturity(spark):
    df = spark.createDataFrame([("2024-09",), ("2024-10",), ("2024-11",)], "cohort_month string")
    snapshot = spark.sql("SELECT date'2024-11-30' AS snapshot_date")
    days = {r.cohort_month: r.is_mature for r in growth.with_maturity(df, snapshot, days=30).collect()}
    assert days == {"2024-09": True, "2024-10": True, "2024-11": False}
    months = {r.cohort_month: r.is_mature for r in growth.with_maturity(df, snapshot, months=2).collect()}
    assert months == {"2024-09": True, "2024-10": False, "2024-11": False}


def test_persistence(spark):
    df = orders(spark, ("a", "2024-09-01", 1, 0), ("a", "2024-10-01", 1, 0), ("a", "2024-11-01", 1, 0),
                ("b", "2024-09-01", 1, 0), ("c", "2024-11-05", 1, 0), ("d", "2024-09-01", 1, 0), ("d", "2024-10-09", 1, 0))
    overall = prep.persistence_rates(df).where("cohort_month IS NULL").first()
    assert (overall.customers, overall.active_month1) == (3, 2)  # c joined in the last month
    assert (overall.active_customer_months, overall.followed_customer_months) == (2, 1)


def test_key_continuation_has_no_gaps(spark):
    batch = spark.range(100).select((F.col("id") * 7 % 100).alias("x"))
    existing = spark.range(5).select((F.col("id") + 10).alias("key"))
    got = prep.continue_keys(batch, [F.col("x").asc()], existing, "key").orderBy("x").collect()
    assert [r.key for r in got] == list(range(15, 115))


def test_months_are_filled_with_zero(spark):
    df = orders(spark, ("a", "2024-11-01", 1, 0), ("a", "2025-02-01", 1, 0), ("b", "2024-12-05", 1, 0))
    got = {(r.order_month, r.customer_id): r.orders for r in prep.zero_filled_months(df, "customer_id").collect()}
    assert len(got) == 8 and sum(got.values()) == 3 and got["2025-01", "a"] == 0
