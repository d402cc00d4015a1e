"""Flows that start from landing tables.

Each is one lazy plan: the optimizer drops the columns and joins a result does not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from orderloom.operators import customers, delivery, staging
from orderloom.sources.files import normalize_nulls, typed

RETENTION_COLUMNS = ("order_id", "order_placed_at", "kpt_duration_minutes", "customer_id")


def staged_orders(orders_raw: DataFrame, restaurants: DataFrame) -> DataFrame:
    return staging.stage_orders(normalize_nulls(orders_raw), normalize_nulls(restaurants))


def resolved_deliveries(ops_raw: DataFrame) -> DataFrame:
    """One row per order straight from landing rows: cleaning and choice in one grouping."""
    return delivery.resolve_repeated(typed(normalize_nulls(ops_raw), "delivery_ops_fact"))


def segments_from_landing(
    orders_raw: DataFrame, restaurants: DataFrame, ops_raw: DataFrame
) -> DataFrame:
    return delivery.delivery_segments(
        staged_orders(orders_raw, restaurants), resolved_deliveries(ops_raw)
    )


def outliers_from_landing(orders_raw: DataFrame, ops_raw: DataFrame) -> DataFrame:
    """Partner outliers re-tested on the clean baseline.

    Of the orders only their existence matters, and cleaning keeps every order id, so one
    landing column is read instead of staging them all.
    """
    known = typed(normalize_nulls(orders_raw.select("order_id")), "orders_raw").distinct()
    segments = delivery.delivery_segments(known, resolved_deliveries(ops_raw))
    return delivery.retest_on_clean_baseline(delivery.partner_outliers(segments))


def retention_from_landing(orders_raw: DataFrame) -> DataFrame:
    """Retention matrix from landing orders.

    Only the columns that cleaning decides by and the result needs are read.
    """
    needed = orders_raw.select(*RETENTION_COLUMNS)
    parsed = staging.parse_orders(normalize_nulls(needed))
    return customers.retention_matrix(staging.dedup_orders(parsed))
