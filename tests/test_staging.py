from datetime import datetime

from pyspark.sql import functions as F

from orderloom.operators import quality, staging
from orderloom.sources.files import normalize_nulls
from orderloom.sources.schemas import ORDERS, landing_schema


def landed(spark, *rows):
    """Landing rows from dictionaries; columns not named are missing."""
    full = [tuple(r.get(c) for c in ORDERS) for r in rows]
    return spark.createDataFrame(full, landing_schema("orders_raw"))


def outlets(spark, *ids):
    return spark.createDataFrame([(i, None, None, None) for i in ids], landing_schema("restaurants_dim"))


def order(order_id, **more):
    base = {"order_id": order_id, "restaurant_id": "1", "order_placed_at": "2024-09-10 10:00:00",
            "kpt_duration_minutes": "12.5", "distance": "3km", "rating": "5"}
    return {**base, **more}


def test_latest_placement_wins_whatever_its_format(spark):
    raw = landed(spark, order("1", order_placed_at="2024-09-10 10:00:00", customer_id="old"),
                 order("1", order_placed_at="11:38 PM, September 10 2024", customer_id="new"))
    assert staging.dedup_orders(staging.parse_orders(raw)).select("customer_id").first()[0] == "new"


def test_equal_times_fall_to_the_known_longer_kitchen_time(spark):
    raw = landed(spark, order("1", kpt_duration_minutes=None), order("1", kpt_duration_minutes="9.0"),
                 order("1", kpt_duration_minutes="10.0"))
    kept = staging.dedup_orders(staging.parse_orders(raw)).collect()
    assert [r.kpt_duration_minutes for r in kept] == [10.0]  # as numbers, not as text


def test_full_ties_are_decided_the_same_way_in_any_row_order(spark):
    rows = [order("1", customer_id=c) for c in "abcdef"]
    picks = {staging.dedup_orders(staging.parse_orders(landed(spark, *r))).first().customer_id
             for r in (rows, rows[::-1], rows[3:] + rows[:3])}
    assert len(picks) == 1


def test_staged_shape_and_flags(spark):
    raw = landed(spark,
                 order("1", rating="6", kpt_duration_minutes="-4"),
                 order("2", restaurant_id="9", rating=None, kpt_duration_minutes="NaN", rider_wait_time_minutes=""),
                 order("3", restaurant_id=None))
    staged = staging.stage_orders(normalize_nulls(raw), outlets(spark, "1", "1", "2"))
    assert len(staged.columns) == 34 and staged.count() == 3  # a repeated outlet adds no rows
    rows = {r.order_id: r for r in staged.collect()}
    flags = lambda r: (r.is_restaurant_orphaned, r.is_kpt_invalid, r.is_rating_invalid, r.is_kpt_missing,
                       r.is_rider_wait_missing)
    assert flags(rows[1]) == (False, True, True, False, True)
    assert flags(rows[2]) == (True, None, None, True, True)
    assert flags(rows[3]) == (True, False, False, False, True)
    assert rows[1].order_placed_at == datetime(2024, 9, 10, 10) and rows[1].distance_km == 3.0


def test_ops_keep_one_row_per_order_and_partner_with_null_as_a_key(spark):
    rows = [("1", "A", "40", "30.5", "0.0"), ("1", "A", "40", "30.5", "0.0"), ("1", "B", "40", "50", "1.0"),
            ("1", None, None, None, None), ("1", None, None, None, None)]
    staged = staging.stage_ops(spark.createDataFrame(rows, landing_schema("delivery_ops_fact")))
    got = sorted(staged.collect(), key=lambda r: str(r.partner_id))
    assert [(r.partner_id, r.is_late) for r in got] == [("A", 0), ("B", 1), (None, None)]


def test_unparseable_rows_can_be_dropped(spark):
    raw = landed(spark, order("1", order_placed_at="junk"), order("2"))
    kept = staging.drop_unparseable(staging.parse_orders(raw))
    assert [r.order_id for r in kept.collect()] == [2]


def test_quality_report_counts_planted_defects(spark):
    raw = landed(spark, order("1"), order("1"), order("2", city=" Metro"), order("3", rating="6"),
                 order("4", order_placed_at="junk", kpt_duration_minutes=None),
                 order("5", order_placed_at="1:05 AM, March 5 2025", restaurant_id="7"))
    ops = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "order_id bigint, partner_id string")
    dim = outlets(spark, "1").withColumn("restaurant_id", F.col("restaurant_id").cast("bigint"))
    got = {r.issue: r.row_count for r in quality.quality_report(raw, dim, ops).collect()}
    assert got == {"second_time_format": 4, "unreadable_time": 1, "untidy_text": 1, "orphaned_restaurant": 1,
                   "missing_kpt": 1, "missing_rider_wait": 6, "negative_kpt": 0, "rating_off_scale": 1,
                   "repeated_order": 1, "repeated_ops_order": 1}


def test_bill_identity_is_exact(spark):
    bill = {"bill_subtotal": "100.10", "packaging_charges": "10.20", "gold_discount": "0.30"}
    raw = landed(spark, order("1", total="110.00", **bill), order("2", total="110.01", **bill), order("3", **bill))
    row = quality.bill_violations(staging.parse_orders(raw)).first()
    assert (row.orders, row.violations) == (2, 1)


def test_empty_input(spark):
    staged = staging.stage_orders(landed(spark), outlets(spark))
    assert staged.count() == 0
