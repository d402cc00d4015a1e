"""Cleaning of the landing tables: one row per key, typed, flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.parsing import parse_distance, parse_moment, tidy_text
from orderloom.sources.files import cast_text, typed
from orderloom.sources.schemas import ORDERS

# Fixed value: the rating scale.
RATING_MAX = 5

TIDIED = ("restaurant_name", "subzone", "city")


def keep_first(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """One row per key, the first in ``order_by``; ties fall to a hash of the whole row.

    Spark prunes to one row per key before the shuffle (WindowGroupLimit), so copies of
    one key collapse in the task that reads them.
    """
    tie_break = F.xxhash64(*df.columns)
    first = Window.partitionBy(*keys).orderBy(*order_by, tie_break)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def parse_orders(orders_raw: DataFrame) -> DataFrame:
    """Landing orders with every column in its declared type.

    Text is tidied, the two time formats become one timestamp, and the distance label
    becomes ``distance_km``.
    """

    def parsed(name: str) -> Column:
        text = F.col(name)
        if name in TIDIED:
            return tidy_text(text).alias(name)
        if name == "order_placed_at":
            return parse_moment(text).alias(name)
        if name == "distance":
            return parse_distance(text).alias("distance_km")
        return cast_text(text, ORDERS[name]).alias(name)

    return orders_raw.select(*(parsed(c) for c in orders_raw.columns))


def dedup_orders(orders: DataFrame) -> DataFrame:
    """One row per order: the latest placement, then the longest known kitchen time.

    Remaining ties look at every column given, so select the columns a result needs first:
    the others are then neither read nor shuffled.
    """
    return keep_first(
        orders,
        ["order_id"],
        [F.col("order_placed_at").desc_nulls_last(), F.col("kpt_duration_minutes").desc_nulls_last()],
    )


def flag_orphans(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """``is_restaurant_orphaned``: the outlet is unknown to the dimension."""
    known = restaurants.select(F.col("restaurant_id").alias("_known_id")).distinct()
    return (
        orders.join(known, F.col("restaurant_id") == F.col("_known_id"), "left")
        .withColumn("is_restaurant_orphaned", F.col("_known_id").isNull())
        .drop("_known_id")
    )


def flag_values(orders: DataFrame) -> DataFrame:
    """Flags for impossible and missing measurements; a missing value is not impossible."""
    kpt, wait = F.col("kpt_duration_minutes"), F.col("rider_wait_time_minutes")
    return orders.withColumns(
        {
            "is_kpt_invalid": kpt < 0,
            "is_rating_invalid": F.col("rating") > RATING_MAX,
            "is_kpt_missing": kpt.isNull(),
            "is_rider_wait_missing": wait.isNull(),
        }
    )


def stage_orders(orders_raw: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Landing orders to one clean, flagged row per order."""
    outlets = restaurants.select(
        cast_text(F.col("restaurant_id").cast("string"), "bigint").alias("restaurant_id")
    )
    return flag_values(flag_orphans(dedup_orders(parse_orders(orders_raw)), outlets))


def dedup_ops(ops: DataFrame) -> DataFrame:
    """One row per (order, partner): the lowest of the remaining columns, NULLs first.

    A missing partner is a key of its own.
    """
    keys = ["order_id", "partner_id"]
    rest = [c for c in ops.columns if c not in keys]
    kept = ops.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_kept"))
    return kept.select(*keys, *(F.col(f"_kept.{c}").alias(c) for c in rest))


def stage_ops(ops_raw: DataFrame) -> DataFrame:
    """Landing delivery rows to one typed row per (order, partner)."""
    return dedup_ops(typed(ops_raw, "delivery_ops_fact"))


def drop_unparseable(orders: DataFrame, column: str = "order_placed_at") -> DataFrame:
    """Only the rows whose timestamp could be read."""
    return orders.na.drop(subset=[column])
