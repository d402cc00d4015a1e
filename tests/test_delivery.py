from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orderloom.operators import delivery as dlv
from orderloom.operators import delivery_kpis as kpi
from orderloom.operators import staging
from workload import fixtures as fx
from workload.queries import QUERIES

SF = "/root/testdata/sf0.01"
OPS = "order_id bigint, partner_id string, promised_sla_minutes double, actual_fulfillment_minutes double, is_late int"


def ops(spark, *rows):
    return spark.createDataFrame([(o, p, 40.0, 30.0, late) for o, p, late in rows], OPS)


def test_lowest_partner_is_kept_and_changes_are_marked(spark):
    rows = ops(spark, (1, "B", 1), (1, "A", 0), (1, "A", 0), (2, None, None), (3, None, None), (3, "C", 1), (4, "D", 0))
    full = dlv.resolve_assignments(staging.dedup_ops(rows))
    got = {r.order_id: (r.partner_id, r.is_late, r.partners_assigned, r.was_reassigned) for r in full.collect()}
    assert got == {1: ("A", 0, 2, True), 2: (None, None, 0, False), 3: ("C", 1, 1, False), 4: ("D", 0, 1, False)}
    short = dlv.resolve_repeated(rows).select(full.drop("partners_assigned").columns)
    assert sorted(short.collect()) == sorted(full.drop("partners_assigned").collect())


def test_segments_lose_and_repeat_no_order(spark):
    orders = fx.orders(spark, SF, line=True, zone=True)
    segments = dlv.delivery_segments(orders, dlv.resolve_repeated(fx.ops(spark, SF)))
    total = orders.count()
    by_status = {r.delivery_status: r["count"] for r in segments.groupBy("delivery_status").count().collect()}
    assert sum(by_status.values()) == total == segments.select("order_id").distinct().count()
    assert set(by_status) == {"late", "on_time", "not_deliverable"}


def test_distance_bands(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (1.5,), (3.0,), (5.0,), (5.1,), (None,)], "km double")
    got = [r[0] for r in df.select(dlv.distance_band(F.col("km"))).collect()]
    assert got == ["Band_1", "Band_1", "Band_2", "Band_2", "Band_3", "Band_4", None]


def segments(spark, *rows):
    """(partner, late orders, on-time orders)"""
    data = [(p, s) for p, late, fine in rows for s in ["late"] * late + ["on_time"] * fine]
    data.append(("never", "not_deliverable"))
    return spark.createDataFrame(data, "partner_id string, delivery_status string")


def test_outliers_and_clean_baseline(spark):
    rows = [(f"p{i}", 3 + i % 2, 37 - i % 2) for i in range(9)] + [("slow", 20, 20)]
    tested = dlv.retest_on_clean_baseline(dlv.partner_outliers(segments(spark, *rows)))
    got = {r.partner_id: r for r in tested.collect()}
    assert {p for p, r in got.items() if r.late_rate_flag} == {"slow"}
    assert {p for p, r in got.items() if r.flagged_on_clean_baseline} == {"slow"}
    assert got["slow"].late_rate_pct == 50.0 and got["p0"].clean_mean == 8.61
    assert "never" not in got


def test_one_partner_has_no_deviation_and_no_flag(spark):
    row = dlv.retest_on_clean_baseline(dlv.partner_outliers(segments(spark, ("only", 1, 1)))).first()
    assert row.late_rate_stddev is None and row.late_rate_flag is None
    assert row.clean_mean is None  # an unknown flag is not a clean one
    assert row.is_low_volume


@pytest.mark.parametrize("name", ["d9_clean_baseline_retest", "d9_outliers_from_landing"])
def test_planted_partners_are_found(spark, name):
    """The first test flags exactly the planted ones; the stricter re-test keeps them all.

    Among a hundred partners a few ordinary ones lie beyond two clean deviations by chance.
    """
    tested = QUERIES[name](spark, SF).collect()
    planted = {f"DP{i:09d}" for i in (0, 25, 50, 75)}
    assert {r.partner_id for r in tested if r.late_rate_flag} == planted
    again = {r.partner_id: r.late_rate_pct for r in tested if r.flagged_on_clean_baseline}
    assert planted <= set(again)
    assert all(rate < 20 for p, rate in again.items() if p not in planted)


def test_counterfactual(spark):
    data = segments(spark, ("a", 10, 90), ("bad", 50, 50))
    targets = spark.createDataFrame([("bad",)], "partner_id string")
    clean = spark.createDataFrame([(10.0,)], "clean_mean double")
    row = dlv.counterfactual(data, "partner_id", targets, clean).first()
    assert (row.actual_rate_pct, row.hypothetical_rate_pct, row.improvement_pp) == (30.0, 10.0, 20.0)
    pooled = dlv.counterfactual(data, "partner_id", targets).first()
    assert pooled.hypothetical_rate_pct == 10.0
    none = dlv.counterfactual(data, "partner_id", targets.where("false")).first()
    assert none.improvement_pp == 0.0


def test_zone_gaps_leave_the_zone_itself_out(spark):
    data = []
    for zone, band, late, fine in [("x", "Band_1", 5, 5), ("y", "Band_1", 1, 9), ("z", "Band_1", 2, 8), ("x", "Band_2", 1, 9)]:
        data += [(zone, band, s) for s in ["late"] * late + ["on_time"] * fine]
    df = spark.createDataFrame(data, "subzone string, distance_band string, delivery_status string")
    got = {(r.subzone, r.distance_band): r for r in dlv.zone_band_gaps(df).collect()}
    x = got["x", "Band_1"]
    assert (x.peer_min_pct, x.peer_max_pct, x.gap_to_peer_max_pp) == (10.0, 20.0, 30.0)
    assert (x.own_other_bands_pct, x.gap_to_own_other_bands_pp) == (10.0, 40.0)
    assert (got["y", "Band_1"].peer_min_pct, got["y", "Band_1"].peer_max_pct) == (20.0, 50.0)
    lone = got["x", "Band_2"]
    assert lone.peer_max_pct is None and lone.own_other_bands_pct == 50.0


def test_over_representation_keeps_partners_without_orders(spark):
    df = segments(spark, ("a", 1, 3), ("b", 0, 4)).withColumn("subzone", F.col("partner_id"))
    listed = spark.createDataFrame([("a",), ("ghost",)], "partner_id string")
    got = {r.partner_id: r for r in dlv.over_representation(df, F.col("subzone") == "a", listed).collect()}
    assert got["a"].slice_share_pct == 100.0 and got["a"].is_over_represented
    assert (got["ghost"].slice_orders, got["ghost"].all_orders) == (0, 0)


PLACED = "order_id bigint, order_placed_at timestamp_ntz, subzone string, partner_id string, is_late int"


def placed(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], PLACED)


def test_rolling_rate_counts_days_with_orders(spark):
    days = [1, 2, 3, 4, 5, 6, 7, 20]
    df = placed(spark, *[(datetime(2024, 9, d, 12), "z", "a", int(d == 1)) for d in days])
    rows = {r.order_date.day: r for r in kpi.rolling_daily_late_rate(df).collect()}
    assert rows[7].rolling_late_count == 1 and rows[20].rolling_deliverable_count == 7
    strict = {r.order_date.day: r for r in kpi.rolling_daily_late_rate(df, calendar=True).collect()}
    assert strict[20].rolling_deliverable_count == 1


def test_rolling_rate_without_deliveries_is_null(spark):
    df = placed(spark, (datetime(2024, 9, 1), "z", None, None))
    assert kpi.rolling_daily_late_rate(df).first().rolling_7day_late_rate_pct is None


def test_concentration_ties_and_unknown_partners(spark):
    day = datetime(2024, 9, 1)
    df = placed(spark, (day, "z", "b", 0), (day, "z", "a", 0), (day, "z", None, None), (day, "z", None, None))
    lead = kpi.partner_concentration(df).first()
    assert (lead.top_partner_id, lead.top_partner_orders, lead.subzone_total_orders) == (None, 2, 4)
    known = kpi.partner_concentration(df, drop_null_partner=True).first()
    assert (known.top_partner_id, known.top_partner_pct, known.is_concentration_risk) == ("a", 50.0, True)
    assert known.is_low_volume


def test_undated_orders_keep_their_month_group(spark):
    df = placed(spark, (None, "z", "a", 1), (None, "z", "b", 0), (datetime(2024, 9, 1), "z", "a", 0))
    months = {r.order_month: r for r in kpi.monthly_partner_outliers(df).where("partner_id = 'a'").collect()}
    assert set(months) == {None, "2024-09"} and months[None].month_mean == 50.0
