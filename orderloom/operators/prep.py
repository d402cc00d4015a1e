"""Preparation of dimensions, delivery facts and batches from order rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.calendar import month_label, month_of_index, month_start
from orderloom.functions.ranking import exact_medians, with_rank
from orderloom.functions.rates import count_where, pct
from orderloom.functions.scalars import with_scalars
from orderloom.operators.customers import active_months, cohorts

# Statuses of orders that a rider took on.
REACHED_A_RIDER = ("Delivered", "Returned", "Return cancelled")

_PLACED = "order_placed_at"


def extract_dimension(df: DataFrame, key: str, attributes: list[str], order_by: str) -> DataFrame:
    """First row per key: the one with the lowest ``order_by``, a unique column."""
    first = F.min(F.struct(order_by, *attributes)).alias("_first")
    return df.groupBy(key).agg(first).select(key, *(F.col(f"_first.{a}") for a in attributes))


def lowest_volume(df: DataFrame, key: str, k: int = 2) -> DataFrame:
    """The ``k`` keys with the fewest rows, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("row_count")).orderBy("row_count", key).limit(k)


def without_lowest_volume(dimension: DataFrame, df: DataFrame, key: str, k: int = 2) -> DataFrame:
    """The dimension without its ``k`` keys of lowest volume; any ``k``, so no broadcast is asked for."""
    return dimension.join(lowest_volume(df, key, k).select(key), key, "left_anti")


def impute_median(df: DataFrame, *columns: str) -> DataFrame:
    """Fill missing values with the exact median of their column. Runs a job."""
    medians = exact_medians(df, *columns)
    named = medians.select(*(F.col(c).alias(f"_median_{c}") for c in columns))
    filled = {c: F.coalesce(F.col(c), F.col(f"_median_{c}")) for c in columns}
    return with_scalars(df, named).withColumns(filled).drop(*named.columns)


def late_flag(actual: Column, promised: Column) -> Column:
    return (actual > promised).cast("int")


def only_if_delivered(value: Column, status: Column, served=REACHED_A_RIDER) -> Column:
    """NULL for orders that never reached a rider."""
    return F.when(status.isin(*served), value)


def late_rate_by_flag(ops: DataFrame, listed: Column) -> DataFrame:
    """Late rate of the listed rows, of the others, and of all (flag NULL), in one pass."""
    known = ops.where(F.col("partner_id").isNotNull()).withColumn("is_listed", listed)
    return (
        known.rollup("is_listed")
        .agg(F.count("is_late").alias("orders"), F.sum("is_late").alias("late_orders"))
        .withColumn("late_rate_pct", pct(F.col("late_orders"), F.col("orders")))
    )


def category_share(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Share of each dimension key among the facts; keys without facts have share 0.

    Shares sum to 1 over the dimension.
    """
    counts = facts.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("orders"))
    listed = dimension.select(key).join(counts, key, "left").na.fill(0, ["orders"])
    whole = listed.agg(F.sum("orders").alias("_all"))
    return with_scalars(listed, whole).select(
        key, "orders", (F.col("orders") / F.nullif(F.col("_all"), F.lit(0))).alias("share")
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows chosen by the hash of their key: the same rows on every run.

    Each task keeps its best ``n`` and those meet in one task, so ``n`` is for small samples.
    """
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    return df.orderBy(draw, key).limit(n)


def one_per_group(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """One row of each group, chosen by the hash of its key."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))
    rest = [c for c in df.columns if c != group]
    picked = df.groupBy(group).agg(F.min(F.struct(draw.alias("_draw"), key, *(c for c in rest if c != key))).alias("_p"))
    return picked.select(group, *(F.col(f"_p.{c}") for c in rest))


def activity_span(orders: DataFrame) -> DataFrame:
    """First and last active month of each customer."""
    per = orders.groupBy("customer_id").agg(F.min(_PLACED).alias("_lo"), F.max(_PLACED).alias("_hi"))
    return per.select(
        "customer_id",
        month_label(F.col("_lo")).alias("first_active_month"),
        month_label(F.col("_hi")).alias("last_active_month"),
    )


def zero_filled_months(orders: DataFrame, *keys: str) -> DataFrame:
    """Orders per month and key with a row for every month of the whole span.

    Every key gets its own list of months, so the result is the only thing that grows.
    """
    dated = orders.where(F.col(_PLACED).isNotNull())
    per = dated.groupBy(month_start(F.col(_PLACED)).alias("_month"), *keys).agg(F.count("*").alias("orders"))
    span = per.agg(F.min("_month").alias("_lo"), F.max("_month").alias("_hi"))
    months = F.sequence("_lo", "_hi", F.make_ym_interval(F.lit(0), F.lit(1)))
    groups = per.where(F.col("orders") > 0).select(*keys).distinct()
    spine = with_scalars(groups, span).select(*keys, F.explode(months).alias("_month"))
    filled = spine.alias("s").join(
        per.alias("p"),
        [F.col("s._month") == F.col("p._month"), *(F.col(f"s.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys)],
        "left",
    )
    return filled.select(
        month_label(F.col("s._month")).alias("order_month"),
        *(F.col(f"s.{k}") for k in keys),
        F.coalesce(F.col("p.orders"), F.lit(0)).cast("bigint").alias("orders"),
    )


def continue_keys(batch: DataFrame, order_by: list[Column], existing: DataFrame, key: str) -> DataFrame:
    """Number the rows of a new batch from the highest existing key on, without gaps.

    ``order_by`` must be a total order. Runs a job that orders the batch and writes it.
    """
    rest = [c for c in batch.columns if c != key]
    highest = existing.agg(F.max(key).cast("bigint").alias("_max"))
    ranked = with_scalars(with_rank(batch.select(*rest), order_by, "_rank"), highest)
    return ranked.select((F.coalesce(F.col("_max"), F.lit(0)) + F.col("_rank")).alias(key), *rest)


def persistence_rates(orders: DataFrame) -> DataFrame:
    """How likely customers order again, by cohort and over all (cohort NULL).

    ``month1_rate_pct``: customers active one month after joining, of those who joined.
    ``persist_rate_pct``: active customer-months followed by another, of all active months
    after the joining month. Months whose successor lies beyond the data are left out of
    both bases, since it cannot be seen.
    """
    every = active_months(orders)
    # the final month counts orders without a customer as well
    final = every.agg(F.max("month").alias("_final"))
    by_month = Window.partitionBy("customer_id").orderBy(F.col("month").asc_nulls_last())
    rows = every.withColumn("_next", F.lead("month").over(by_month)).where(
        F.col("customer_id").isNotNull() & F.col("cohort_index").isNotNull()
    )
    dated = with_scalars(rows, final)
    joined, month, last = F.col("cohort_index"), F.col("month"), F.col("_final")
    followed = F.col("_next") == month + 1
    first, later = (month == joined) & (joined < last), (month > joined) & (month < last)
    sums = dated.rollup("cohort_index").agg(
        count_where(first).alias("customers"),
        count_where(first & followed).alias("active_month1"),
        count_where(later).alias("active_customer_months"),
        count_where(later & followed).alias("followed_customer_months"),
    )
    return sums.select(
        month_label(month_of_index(F.col("cohort_index"))).alias("cohort_month"),
        "customers",
        "active_month1",
        "active_customer_months",
        "followed_customer_months",
        pct(F.col("active_month1"), F.col("customers")).alias("month1_rate_pct"),
        pct(F.col("followed_customer_months"), F.col("active_customer_months")).alias("persist_rate_pct"),
    )


def average_cohort_size(orders: DataFrame) -> DataFrame:
    """Mean number of new customers per month that has any."""
    known = orders.where(F.col("customer_id").isNotNull())
    sizes = cohorts(known).groupBy("cohort_month").agg(F.count("*").alias("n"))
    return sizes.where(F.col("cohort_month").isNotNull()).agg(
        F.count("*").alias("months"),
        F.sum("n").alias("new_customers"),
        (F.sum("n") / F.count("*")).alias("avg_new_customers"),
    )
