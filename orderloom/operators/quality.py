"""Data-quality reports over landing and staged tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.parsing import DATE_FIRST, TIME_FORMS, parse_moment, tidy_text
from orderloom.functions.rates import MONEY, count_where, pct
from orderloom.functions.scalars import with_scalars
from orderloom.operators.staging import RATING_MAX, TIDIED, flag_orphans
from orderloom.sources.commits import CommittedTable
from orderloom.sources.files import cast_text

# The discount columns of a bill.
DISCOUNTS = (
    "restaurant_discount_promo",
    "restaurant_discount_flat",
    "gold_discount",
    "brand_pack_discount",
)


def _surplus_rows(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows beyond the first of each key: counted per key, so copies collapse early."""
    per_key = df.groupBy(key).agg((F.count("*") - 1).alias("surplus"))
    return per_key.agg(F.coalesce(F.sum("surplus"), F.lit(0)).cast("bigint").alias(name))


def value_defects() -> dict[str, Column]:
    """Counts over landing rows (null tokens normalized) that need no other table: a load can take them
    while it writes."""
    time = F.col("order_placed_at")
    kpt = cast_text(F.col("kpt_duration_minutes"), "double")
    untidy = reduce(Column.__or__, (F.col(c) != tidy_text(F.col(c)) for c in TIDIED))
    second_form = parse_moment(time, {DATE_FIRST: TIME_FORMS[DATE_FIRST]})
    return {
        "second_time_format": count_where(second_form.isNotNull()),
        "unreadable_time": count_where(time.isNotNull() & parse_moment(time).isNull()),
        "untidy_text": count_where(untidy),
        "missing_kpt": count_where(kpt.isNull()),
        "missing_rider_wait": count_where(F.col("rider_wait_time_minutes").isNull()),
        "negative_kpt": count_where(kpt < 0),
        "rating_off_scale": count_where(cast_text(F.col("rating"), "double") > RATING_MAX),
    }


def defects_from_commits(table: CommittedTable) -> DataFrame:
    """``(issue, row_count)`` of all committed batches, from the records of their loads."""
    names = list(value_defects())
    return table.totals().where(F.col("name").isin(names)).select(
        F.col("name").alias("issue"), F.col("value").alias("row_count")
    )


def quality_report(orders_raw: DataFrame, restaurants: DataFrame, ops: DataFrame) -> DataFrame:
    """Rows per known defect: ``(issue, row_count)``.

    Takes landing orders with null tokens already normalized. Value defects are counted
    over all landing rows, repeated ones included.
    """
    linked = flag_orphans(
        orders_raw.withColumn("restaurant_id", cast_text(F.col("restaurant_id"), "bigint")),
        restaurants,
    )
    counts = linked.agg(
        *(count.alias(name) for name, count in value_defects().items()),
        count_where(F.col("is_restaurant_orphaned")).alias("orphaned_restaurant"),
    )
    repeated_orders = _surplus_rows(orders_raw, "order_id", "repeated_order")
    repeated_ops = _surplus_rows(ops, "order_id", "repeated_ops_order")
    wide = with_scalars(with_scalars(counts, repeated_orders), repeated_ops)
    return wide.unpivot([], wide.columns, "issue", "row_count")


def bill_violations(orders: DataFrame) -> DataFrame:
    """Whether ``total = subtotal + packaging - discounts`` holds, in exact decimals.

    One row ``(orders, violations)``. Rows with a missing part cannot be judged and count
    as neither; a missing discount is no discount.
    """
    discounts = sum((F.coalesce(F.col(c).cast(MONEY), F.lit(0)) for c in DISCOUNTS), F.lit(0))
    due = F.col("bill_subtotal").cast(MONEY) + F.col("packaging_charges").cast(MONEY) - discounts
    broken = F.col("total").cast(MONEY) != due
    return orders.agg(
        count_where(broken.isNotNull()).alias("orders"), count_where(broken).alias("violations")
    )


def response_rate(
    orders: DataFrame, field: str = "rating", status: str = "Delivered"
) -> DataFrame:
    """Share of orders in ``status`` where an optional field was filled in."""
    return (
        orders.where(F.col("order_status") == status)
        .agg(F.count("*").alias("delivered_orders"), F.count(field).alias("responses"))
        .withColumn("response_rate_pct", pct(F.col("responses"), F.col("delivered_orders")))
    )
