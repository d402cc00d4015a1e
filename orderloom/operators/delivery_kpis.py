"""Recurring delivery indicators by day and month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.calendar import month_label, month_start
from orderloom.functions.rates import count_where, exact_mean, pct
from orderloom.functions.scalars import with_group_stats
from orderloom.operators.delivery import OUTLIER_SDS

# Default thresholds.
PARTNER_MONTH_FLOOR = 20
BRAND_VOLUME_SHARE = 0.3
CONCENTRATION_PCT = 30
ZONE_MONTH_FLOOR = 100

_PLACED = "order_placed_at"


def _late() -> Column:
    return count_where(F.col("is_late") == 1)


def _deliverable() -> Column:
    return count_where(F.col("is_late").isNotNull())


def with_lateness(orders: DataFrame, resolved: DataFrame, how: str = "left") -> DataFrame:
    """Orders with the partner and lateness of their one delivery row."""
    return orders.join(resolved.select("order_id", "partner_id", "is_late"), "order_id", how)


def _rolling(per: DataFrame, moment: str, frame, names: dict[str, str]) -> DataFrame:
    late = F.sum(names["late"]).over(frame)
    count = F.sum(names["count"]).over(frame)
    return per.select(
        moment,
        names["count"],
        names["late"],
        late.alias("rolling_late_count"),
        count.alias("rolling_deliverable_count"),
        pct(late, count).alias(names["rate"]),
    )


def rolling_daily_late_rate(orders_late: DataFrame, days: int = 7, calendar: bool = False) -> DataFrame:
    """Late rate over the last ``days`` days on which orders exist, or calendar days.

    The window runs over one row per day.
    """
    per = orders_late.groupBy(F.col(_PLACED).cast("date").alias("order_date")).agg(
        _deliverable().alias("daily_deliverable_orders"), _late().alias("daily_late_orders")
    )
    return roll_days(per, days, calendar)


def roll_days(per: DataFrame, days: int, calendar: bool) -> DataFrame:
    """The rates from one row of counts per day."""
    if calendar:
        frame = Window.orderBy(F.unix_date("order_date")).rangeBetween(1 - days, 0)
    else:
        frame = Window.orderBy(F.col("order_date").asc_nulls_last()).rowsBetween(1 - days, 0)
    names = {
        "count": "daily_deliverable_orders",
        "late": "daily_late_orders",
        "rate": f"rolling_{days}day_late_rate_pct",
    }
    return _rolling(per, "order_date", frame, names)


def rolling_monthly_late_rate(orders_late: DataFrame, months: int = 3) -> DataFrame:
    """The same over the last ``months`` months that have orders."""
    per = orders_late.groupBy(month_start(F.col(_PLACED)).alias("_month")).agg(
        _deliverable().alias("monthly_deliverable_orders"), _late().alias("monthly_late_orders")
    )
    return roll_months(per, months)


def roll_months(per: DataFrame, months: int) -> DataFrame:
    """The rates from one row of counts per month."""
    frame = Window.orderBy(F.col("_month").asc_nulls_last()).rowsBetween(1 - months, 0)
    names = {
        "count": "monthly_deliverable_orders",
        "late": "monthly_late_orders",
        "rate": f"rolling_{months}month_late_rate_pct",
    }
    rolled = _rolling(per, "_month", frame, names)
    return rolled.select(month_label(F.col("_month")).alias("order_month"), *rolled.columns[1:])


def slice_monthly_late_rate(orders_late: DataFrame, within: Column) -> DataFrame:
    """Monthly late rate of the orders in a slice, such as one zone's short trips."""
    per = (
        orders_late.where(within)
        .groupBy(month_start(F.col(_PLACED)).alias("_month"))
        .agg(_deliverable().alias("deliverable_orders"), _late().alias("late_orders"))
    )
    return per.select(
        month_label(F.col("_month")).alias("order_month"),
        "deliverable_orders",
        "late_orders",
        pct(F.col("late_orders"), F.col("deliverable_orders")).alias("late_rate_pct"),
    )


def monthly_partner_outliers(
    orders_late: DataFrame, sds: float = OUTLIER_SDS, volume_floor: int = PARTNER_MONTH_FLOOR
) -> DataFrame:
    """Outlier test repeated inside every month; takes orders that have a delivery row.

    The month's mean and deviation come from a grouping that reuses the shuffled
    partner-month rows; no task holds all partners of a month.
    """
    per = (
        orders_late.where(F.col("partner_id").isNotNull())
        .groupBy(month_start(F.col(_PLACED)).alias("_month"), "partner_id")
        .agg(
            _deliverable().alias("monthly_deliverable_orders"),
            _late().alias("_late"),
            F.count("*").alias("_rows"),
        )
    )
    return test_partner_months(per, sds, volume_floor)


def test_partner_months(
    counts: DataFrame, sds: float = OUTLIER_SDS, volume_floor: int = PARTNER_MONTH_FLOOR
) -> DataFrame:
    """The test on one row of counts per month and partner."""
    per = counts.withColumn("late_rate_pct", pct(F.col("_late"), F.col("monthly_deliverable_orders")))
    # Always true; it makes both branches need the same columns, so they share one shuffle.
    stats = (
        per.where(F.col("_rows") > 0)
        .groupBy("_month")
        .agg(
            exact_mean(F.col("late_rate_pct")).alias("month_mean"),
            F.round(F.stddev("late_rate_pct"), 2).alias("month_stddev"),
        )
    )
    limit = F.col("month_mean") + sds * F.col("month_stddev")
    return with_group_stats(per, ["_month"], stats).select(
        month_label(F.col("_month")).alias("order_month"),
        "partner_id",
        "monthly_deliverable_orders",
        "late_rate_pct",
        (F.col("_rows") < volume_floor).alias("is_low_volume"),
        "month_mean",
        "month_stddev",
        (F.col("late_rate_pct") > limit).alias("is_flagged"),
    )


def outlier_tally(monthly: DataFrame) -> DataFrame:
    """Months observed and months flagged for every partner that was flagged at all."""
    return (
        monthly.groupBy("partner_id")
        .agg(
            F.count("*").alias("months_observed"),
            count_where(F.col("is_flagged")).alias("months_flagged"),
        )
        .where("months_flagged > 0")
    )


def brand_monthly_late_rate(
    orders_late: DataFrame, volume_share: float = BRAND_VOLUME_SHARE
) -> DataFrame:
    """Monthly late rate per brand; low volume is relative to the brand's own average.

    The window holds one brand's months only.
    """
    per = orders_late.groupBy(month_start(F.col(_PLACED)).alias("_month"), "restaurant_name").agg(
        _deliverable().alias("monthly_deliverable_orders"), _late().alias("_late")
    )
    count = F.col("monthly_deliverable_orders")
    usual = F.avg(count).over(Window.partitionBy("restaurant_name"))
    return per.withColumn("brand_avg_monthly_orders", usual).select(
        month_label(F.col("_month")).alias("order_month"),
        "restaurant_name",
        count,
        pct(F.col("_late"), count).alias("late_rate_pct"),
        "brand_avg_monthly_orders",
        (count < F.col("brand_avg_monthly_orders") * volume_share).alias("is_low_volume"),
    )


def partner_concentration(
    orders_late: DataFrame,
    risk_pct: float = CONCENTRATION_PCT,
    volume_floor: int = ZONE_MONTH_FLOOR,
    drop_null_partner: bool = False,
) -> DataFrame:
    """Largest partner of each (month, zone); takes orders that have a delivery row.

    Orders without a partner form a group of their own unless ``drop_null_partner``.
    Among equals the lowest partner id leads. Both steps are combinable, so a dominant
    partner or zone shrinks before each shuffle.
    """
    rows = orders_late.where(F.col("partner_id").isNotNull()) if drop_null_partner else orders_late
    per = rows.groupBy(month_start(F.col(_PLACED)).alias("_month"), "subzone", "partner_id").agg(
        F.count("order_id").alias("_n")
    )
    return lead_of_zone_months(per, risk_pct, volume_floor)


def lead_of_zone_months(
    per: DataFrame, risk_pct: float = CONCENTRATION_PCT, volume_floor: int = ZONE_MONTH_FLOOR
) -> DataFrame:
    """The largest partner from one row of counts per month, zone and partner."""
    lead = F.struct((-F.col("_n")).alias("_neg"), F.isnull("partner_id").alias("_unknown"), "partner_id")
    top = per.groupBy("_month", "subzone").agg(
        F.min(lead).alias("_top"), F.sum("_n").alias("subzone_total_orders")
    )
    orders, total = -F.col("_top._neg"), F.col("subzone_total_orders")
    return top.withColumn("top_partner_pct", pct(orders, total)).select(
        month_label(F.col("_month")).alias("order_month"),
        "subzone",
        F.col("_top.partner_id").alias("top_partner_id"),
        orders.alias("top_partner_orders"),
        total,
        "top_partner_pct",
        (F.col("top_partner_pct") > risk_pct).alias("is_concentration_risk"),
        (total < volume_floor).alias("is_low_volume"),
    )


def dominance_tally(concentration: DataFrame) -> DataFrame:
    """Number of zone-months that each partner leads."""
    return concentration.groupBy("top_partner_id").agg(
        F.count("*").alias("zone_months_led"),
        count_where(F.col("is_concentration_risk")).alias("zone_months_at_risk"),
    )
