"""Recurring growth indicators by cohort and month.

Indicators by cohort need time to pass after a first order. Young cohorts look worse than
they are, so those tables can be marked with ``is_mature``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.calendar import month_index, month_label, month_start
from orderloom.functions.rates import cents, count_where, money_sum, pct
from orderloom.functions.scalars import with_scalars
from orderloom.operators.customers import discounted, retention_matrix

# Default horizons, bands and excluded statuses.
REPEAT_DAYS = 30
MATURE_MONTHS = 2
PROMO_BAND_PCT = (65, 80)
NEVER_SERVED = ("Timed out", "Rejected")

_PLACED = "order_placed_at"


def _known_customer(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("customer_id").isNotNull())


def repeat_within(orders: DataFrame, days: int = REPEAT_DAYS) -> DataFrame:
    """Share of each cohort whose second order came within ``days`` of the first.

    A second order on the same day counts. Only each customer's two earliest orders leave
    the task that reads them (WindowGroupLimit).
    """
    day = F.col(_PLACED).cast("date")
    earliest = Window.partitionBy("customer_id").orderBy(F.col("day").asc_nulls_last())
    two = (
        _known_customer(orders)
        .select("customer_id", day.alias("day"))
        .withColumn("rn", F.row_number().over(earliest))
        .where("rn <= 2")
    )
    per = two.groupBy("customer_id").agg(
        F.min(F.when(F.col("rn") == 1, F.col("day"))).alias("first_day"),
        F.min(F.when(F.col("rn") == 2, F.col("day"))).alias("second_day"),
    )
    soon = F.datediff("second_day", "first_day") <= days
    counts = (
        per.where(F.col("first_day").isNotNull())
        .groupBy(month_start(F.col("first_day")).alias("_cohort"))
        .agg(F.count("*").alias("cohort_size"), count_where(soon).alias("_repeats"))
    )
    return counts.select(
        month_label(F.col("_cohort")).alias("cohort_month"),
        "cohort_size",
        F.col("_repeats").alias(f"repeat_within_{days}d_count"),
        pct(F.col("_repeats"), F.col("cohort_size")).alias(f"repeat_rate_{days}d_pct"),
    )


def month_one_retention(orders: DataFrame) -> DataFrame:
    """The retention matrix one month after the first order."""
    return retention_matrix(orders).where(F.col("months_since_first_order") == 1)


def one_time_revenue(orders: DataFrame) -> DataFrame:
    """Share of each cohort's revenue from customers with a single order."""
    per = _known_customer(orders).groupBy("customer_id").agg(
        month_start(F.min(_PLACED)).alias("_cohort"),
        F.count("*").alias("_orders"),
        money_sum(F.col("total")).alias("_spend"),
    )
    once = F.coalesce(F.sum(F.when(F.col("_orders") == 1, F.col("_spend"))), F.lit(0))
    sums = per.groupBy("_cohort").agg(once.alias("_once"), F.sum("_spend").alias("_all"))
    return sums.select(
        month_label(F.col("_cohort")).alias("cohort_month"),
        F.col("_once").cast("double").alias("one_time_customer_revenue"),
        F.col("_all").cast("double").alias("total_cohort_revenue"),
        pct(cents(F.col("_once")), cents(F.col("_all"))).alias("pct_one_time"),
    )


def promo_revenue_share(orders: DataFrame) -> DataFrame:
    """Monthly share of revenue from discounted orders; needs no elapsed time."""
    sums = orders.groupBy(month_start(F.col(_PLACED)).alias("_month")).agg(
        money_sum(F.col("total")).alias("_all"),
        F.coalesce(money_sum(F.when(discounted(), F.col("total"))), F.lit(0)).alias("_promo"),
    )
    return sums.select(
        month_label(F.col("_month")).alias("order_month"),
        F.col("_all").cast("double").alias("total_revenue"),
        F.col("_promo").cast("double").alias("promo_dependent_revenue"),
        pct(cents(F.col("_promo")), cents(F.col("_all"))).alias("pct_promo_dependent"),
    )


def outside_band(monthly: DataFrame, band=PROMO_BAND_PCT) -> DataFrame:
    """Flag the months whose promo share leaves its usual band."""
    return monthly.withColumn("is_outside_band", ~F.col("pct_promo_dependent").between(*band))


def champions_conversion(segments: DataFrame) -> DataFrame:
    """Share of each cohort that became Champions."""
    known = segments.where(F.col("customer_id").isNotNull())
    per = known.groupBy("cohort_month").agg(
        count_where(F.col("rfm_segment") == "Champions").alias("champions"),
        F.count("*").alias("cohort_size"),
    )
    return per.select(
        month_label(F.col("cohort_month")).alias("cohort_month"),
        "champions",
        "cohort_size",
        pct(F.col("champions"), F.col("cohort_size")).alias("conversion_pct"),
    )


def at_risk_in_mature_cohorts(
    segments: DataFrame, snapshot: DataFrame, months: int = MATURE_MONTHS
) -> DataFrame:
    """At-risk customers by mature cohort, with the totals of mature and of all cohorts.

    A cohort is mature when it began at least ``months`` months before the snapshot's month.
    """
    per = (
        segments.where(F.col("customer_id").isNotNull())
        .groupBy("cohort_month")
        .agg(count_where(F.col("rfm_segment") == "At-risk").alias("at_risk_customers"))
    )
    age = month_index(F.col("snapshot_date")) - month_index(F.col("cohort_month"))
    aged = with_scalars(per, snapshot).withColumn("_mature", age >= months)
    totals = aged.agg(
        F.coalesce(F.sum(F.when(F.col("_mature"), F.col("at_risk_customers"))), F.lit(0))
        .cast("bigint")
        .alias("mature_at_risk"),
        F.sum("at_risk_customers").alias("all_at_risk"),
    )
    return with_scalars(aged.where("_mature"), totals).select(
        month_label(F.col("cohort_month")).alias("cohort_month"),
        "at_risk_customers",
        pct(F.col("at_risk_customers"), F.col("mature_at_risk")).alias("share_pct"),
        "mature_at_risk",
        "all_at_risk",
    )


def complaint_rate(orders: DataFrame, excluded=NEVER_SERVED) -> DataFrame:
    """Monthly complaints per 100 served orders; an unknown status is not served."""
    counts = (
        orders.where(~F.col("order_status").isin(*excluded))
        .groupBy(month_start(F.col(_PLACED)).alias("_month"))
        .agg(
            F.count("order_id").alias("total_orders"),
            F.count("customer_complaint_tag").alias("complaint_count"),
            F.count("*").alias("_rows"),
        )
    )
    return complaint_share(counts)


def complaint_share(counts: DataFrame) -> DataFrame:
    """The rates from monthly counts of served orders."""
    return counts.select(
        month_label(F.col("_month")).alias("order_month"),
        "total_orders",
        "complaint_count",
        pct(F.col("complaint_count"), F.col("_rows")).alias("complaint_rate_per_100"),
    )


def with_maturity(
    by_cohort: DataFrame, snapshot: DataFrame, days: int | None = None, months: int | None = None
) -> DataFrame:
    """Mark the cohorts that were observed long enough for their indicator.

    With ``days``, the whole horizon after the cohort's last day must lie within the data;
    with ``months``, the snapshot's month must be at least that many months later.
    """
    start = F.to_date(F.concat("cohort_month", F.lit("-01")))
    if days is not None:
        mature = F.date_add(F.last_day(start), days) <= F.col("snapshot_date")
    else:
        mature = month_index(F.col("snapshot_date")) - month_index(start) >= months
    return with_scalars(by_cohort, snapshot).withColumn("is_mature", mature).drop("snapshot_date")

