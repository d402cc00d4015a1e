"""Customer analyses: cohorts, retention, RFM, promotion dependency.

Every analysis groups the orders by customer. Retention first reduces them to one row per customer
and active month, in the task that reads them, so even a customer with a third of all orders is
small. The split by first order carries 64 months in one number instead, beside the first order in
one number too, so its grouping hashes into buffers of fixed width.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.calendar import month_index, month_label, month_of_index, month_start
from orderloom.functions.rates import WIDE, cents, count_where, money_sum, pct
from orderloom.functions.scalars import with_scalars
from orderloom.functions.selection import with_tiles, with_top

# Scoring rules and default cut-offs.
RFM_TILES = 5
PROMO_SHARE_PCT = 50
SENSITIVITY_PCTS = (40, 45, 50, 55, 60, 65, 70)
TOP_SPENDER_PCTS = (10, 20)

_PLACED = "order_placed_at"
_MONTH = f"(year({_PLACED}) * 12 + month({_PLACED}) - 1)"
#: Microseconds of a time that comes after all others.
_NEVER = 9 * 10**17


def _known_customer(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("customer_id").isNotNull())


def discounted() -> Column:
    return F.col("discount_construct").isNotNull()


def cohorts(orders: DataFrame) -> DataFrame:
    """First order date and its month for each customer (customers without id form one row)."""
    first = orders.groupBy("customer_id").agg(F.min(_PLACED).cast("date").alias("first_order_date"))
    return first.withColumn("cohort_month", month_start(F.col("first_order_date")))


def cohort_sizes(orders: DataFrame) -> DataFrame:
    """Customers per cohort."""
    return (
        cohorts(orders)
        .groupBy("cohort_month")
        .agg(F.count("customer_id").alias("cohort_size"))
        .withColumn("cohort_month", month_label(F.col("cohort_month")))
    )


def month_bitmaps(orders: DataFrame, *more: Column) -> DataFrame:
    """customer_id, word, bits and ``more`` aggregates: bit ``i`` of ``bits`` is set if the known customer was
    active in month ``64 * word + i``. Undated orders are a row of their own, without word. A customer has as many rows
    as words, whatever the number of orders or years."""
    month = month_index(F.col(_PLACED))
    known = _known_customer(orders).withColumns(
        {"word": F.floor(month / 64), "_bit": F.expr(f"shiftleft(1L, cast(pmod({_MONTH}, 64) AS int))")}
    )
    return known.groupBy("customer_id", "word").agg(F.expr("bit_or(_bit)").alias("bits"), *more)


def active_months(orders: DataFrame) -> DataFrame:
    """One row per (customer, active month) with the customer's first month; undated orders have
    month NULL, orders without customer are one customer.

    Orders hash to (customer, month) in the task that reads them, in buffers of fixed width; only
    those far fewer rows are gathered by customer.
    """
    months = orders.select("customer_id", month_index(F.col(_PLACED)).alias("month")).distinct()
    return months.withColumn("cohort_index", F.min("month").over(Window.partitionBy("customer_id")))


def _retention(activity: DataFrame, *keys: str) -> DataFrame:
    """Active customers by offset beside those at the first offset of the same cohort."""
    group = [*keys, "cohort_index"]
    per = activity.groupBy(*group, "months_since_first_order").agg(
        F.count("*").alias("active_customers")
    )
    return _with_cohort_size(per, *keys)


def _with_cohort_size(per: DataFrame, *keys: str) -> DataFrame:
    """``per``: active customers by ``keys``, cohort and offset."""
    group = [*keys, "cohort_index"]
    # One row per month of a cohort.
    start = Window.partitionBy(*group).orderBy(F.col("months_since_first_order").asc_nulls_last())
    sized = per.withColumn("cohort_size", F.first("active_customers").over(start))
    return sized.select(
        *keys,
        month_label(month_of_index(F.col("cohort_index"))).alias("cohort_month"),
        "months_since_first_order",
        "active_customers",
        "cohort_size",
        pct(F.col("active_customers"), F.col("cohort_size")).alias("retention_rate"),
    )


def retention_matrix(orders: DataFrame) -> DataFrame:
    """Share of each monthly cohort that orders again, by months since the first order.

    Every customer is active in its first month, so the size of a cohort is its count at
    offset 0 and needs no second pass.
    """
    since = (F.col("month") - F.col("cohort_index")).cast("bigint").alias("months_since_first_order")
    dated = active_months(orders).where(F.col("customer_id").isNotNull() & F.col("cohort_index").isNotNull())
    return _retention(dated.select("cohort_index", since))


def rfm_base(orders: DataFrame) -> DataFrame:
    """Recency in days, number of orders and spend of each customer, and its cohort.

    ``orders`` has one row per order. The reference day is the latest order of all.
    """
    per = orders.groupBy("customer_id").agg(
        F.min(_PLACED).cast("date").alias("_first"),
        F.max(_PLACED).cast("date").alias("_last"),
        F.count("order_id").alias("frequency_orders"),
        money_sum(F.col("total")).alias("monetary_total"),
    )
    # the latest order of all is the latest of the customers' last ones, from the same shuffle
    dated = with_scalars(per, per.agg(F.max("_last").alias("snapshot_date")))
    return dated.select(
        "customer_id",
        month_start(F.col("_first")).alias("cohort_month"),
        F.datediff("snapshot_date", "_last").cast("bigint").alias("recency_days"),
        "frequency_orders",
        "monetary_total",
    )


def snapshot_date(orders: DataFrame) -> DataFrame:
    """One row: the latest order date."""
    return orders.agg(F.max(_PLACED).cast("date").alias("snapshot_date"))


def frequency_band(orders: Column) -> Column:
    """Fixed bands, since most customers share a frequency of one: 1, 2, 3-4, 5 or more."""
    return (
        F.when(orders == 1, 1)
        .when(orders == 2, 2)
        .when(orders.between(3, 4), 3)
        .when(orders >= 5, 4)
        .cast("bigint")
    )


def rfm_scores(base: DataFrame) -> DataFrame:
    """Recency and spend fifths and the frequency band; ties fall to the customer id.

    Runs jobs: the customer table is written once, and the borders of the fifths are selected from it.
    """
    recency, spend = F.col("recency_days"), F.col("monetary_total")
    customer = [F.col("customer_id").isNull().alias("unnamed"), F.col("customer_id").alias("id")]
    keys = {
        # longest ago first, unknown before all
        "r_score": F.struct(recency.isNotNull().alias("known"), (-recency).alias("value"), *customer),
        "m_score": F.struct(spend.isNull().alias("unknown"), spend.alias("value"), *customer),
    }
    scored = with_tiles(base, keys, RFM_TILES)
    return scored.withColumn("f_score", frequency_band(F.col("frequency_orders")))


def rfm_segments(scores: DataFrame) -> DataFrame:
    """Named segment of each customer, the first rule that holds."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    # The segment rules in order of precedence.
    segment = (
        F.when((r == 5) & (f == 4) & (m == 5), "Champions")
        .when((r > 3) & ((f >= 3) | (m > 4)), "Loyal")
        .when((r <= 2) & (f >= 3) & (m >= 3), "At-risk")
        .when((r == 1) & (f == 1) & (m == 1), "Churned")
        .otherwise("Other")
    )
    return scores.withColumn("rfm_segment", segment)


def segment_summary(segments: DataFrame) -> DataFrame:
    """Customers and share per segment."""
    per = segments.groupBy("rfm_segment").agg(F.count("*").alias("customers"))
    whole = per.agg(F.sum("customers").alias("_all"))
    return with_scalars(per, whole).select(
        "rfm_segment", "customers", pct(F.col("customers"), F.col("_all")).alias("share_pct")
    )


def segment_share_by_cohort(segments: DataFrame) -> DataFrame:
    """Share of each segment within each cohort; shares of young cohorts are not comparable."""
    known = segments.where(F.col("customer_id").isNotNull())
    per = known.groupBy("cohort_month", "rfm_segment").agg(F.count("*").alias("customers"))
    size = F.sum("customers").over(Window.partitionBy("cohort_month"))  # one row per segment
    return per.select(
        month_label(F.col("cohort_month")).alias("cohort_month"),
        "rfm_segment",
        "customers",
        pct(F.col("customers"), size).alias("share_of_cohort_pct"),
    )


def _first_order() -> Column:
    """Least (time, id) of a customer with the attribute; an unknown time comes last."""
    placed = F.col(_PLACED)
    return F.min(F.struct(placed.isNull().alias("_undated"), placed, "order_id", discounted().alias("flag")))


def first_order_attribute(orders: DataFrame) -> DataFrame:
    """Whether each customer's first order was discounted: known before any outcome."""
    per = orders.groupBy("customer_id").agg(_first_order().alias("_first"))
    return per.select("customer_id", F.col("_first.flag").alias("first_order_had_discount"))


def _first_order_number() -> Column:
    """The same choice as ``_first_order`` as one whole number of fixed width: time, id, flag."""
    micros = F.coalesce(F.unix_micros(F.col(_PLACED).cast("timestamp")), F.lit(_NEVER)).cast("decimal(19,0)")
    # order ids from 0 on, unknown ones first
    order = F.coalesce(F.col("order_id").cast("decimal(20,0)"), F.lit(Decimal(-(2**63)))) + F.lit(Decimal(2**63))
    flag = F.when(discounted(), 1).otherwise(0)
    number = (micros.cast("decimal(18,0)") * F.lit(Decimal(2**64))).cast(WIDE) + order.cast("decimal(20,0)")
    return F.min((number.cast(WIDE) * 2 + flag).cast(WIDE))


def retention_by_first_order(orders: DataFrame) -> DataFrame:
    """Retention matrix split by whether the first order was discounted.

    Every aggregate has a buffer of fixed width: months are bits, the first order is one number, and the
    customers active at an offset are sums of bits.
    """
    flag = "first_order_had_discount"
    month = month_index(F.col(_PLACED))
    words = month_bitmaps(orders, F.min(month).alias("_month"), _first_order_number().alias("_first"))
    customer = Window.partitionBy("customer_id")  # one row for each word
    flagged = words.select(
        F.min("_month").over(customer).alias("cohort_index"),
        (F.min("_first").over(customer) % 2 != 0).alias(flag),
        "word",
        "bits",
    )
    bits = [F.sum(F.expr(f"shiftrightunsigned(bits, {i}) & 1L")).alias(f"_{i}") for i in range(64)]
    sums = flagged.groupBy(flag, "cohort_index", "word").agg(F.count("*").alias("_rows"), *bits)
    by_month = F.inline(
        F.array(*(F.struct((F.col("word") * 64 + i).alias("month"), F.col(f"_{i}").alias("active_customers")) for i in range(64)))
    )
    dated = sums.where(F.col("word").isNotNull()).select(flag, "cohort_index", by_month).where("active_customers > 0")
    undated = sums.where(F.col("word").isNull()).select(
        flag, "cohort_index", F.lit(None).cast("bigint").alias("month"), F.col("_rows").alias("active_customers")
    )
    since = (F.col("month") - F.col("cohort_index")).cast("bigint").alias("months_since_first_order")
    return _with_cohort_size(dated.unionAll(undated).select(flag, "cohort_index", since, "active_customers"), flag)


def promo_usage(orders: DataFrame) -> DataFrame:
    """Orders, discounted orders and spend of each known customer."""
    return _known_customer(orders).groupBy("customer_id").agg(
        F.count("*").alias("orders"),
        count_where(discounted()).alias("discounted_orders"),
        money_sum(F.col("total")).alias("spend"),
    )


def _depends_on_promo(threshold_pct: int) -> Column:
    return F.col("discounted_orders") * 100 > F.col("orders") * threshold_pct


def promo_share_sensitivity(orders: DataFrame, thresholds=SENSITIVITY_PCTS) -> DataFrame:
    """Revenue share of customers whose discounted share exceeds each threshold.

    All thresholds are conditional sums of one pass over the customers.
    """
    sums = []
    for t in thresholds:
        hit = _depends_on_promo(t)
        sums += [count_where(hit).alias(f"n_{t}"), F.sum(F.when(hit, F.col("spend"))).alias(f"s_{t}")]
    wide = promo_usage(orders).agg(F.sum("spend").alias("total"), *sums)
    rows = F.array(
        *(
            F.struct(
                F.lit(t).cast("bigint").alias("threshold_pct"),
                F.col(f"n_{t}").alias("customers"),
                F.coalesce(F.col(f"s_{t}"), F.lit(0)).alias("revenue"),
            )
            for t in thresholds
        )
    )
    return wide.select("total", F.inline(rows)).select(
        "threshold_pct",
        F.col("customers").alias("promo_customers"),
        F.col("revenue").cast("double").alias("promo_revenue"),
        F.col("total").cast("double").alias("total_revenue"),
        pct(cents(F.col("revenue")), cents(F.col("total"))).alias("revenue_share_pct"),
    )


def spend_concentration(
    orders: DataFrame, threshold_pct: int = PROMO_SHARE_PCT, top_pcts=TOP_SPENDER_PCTS
) -> DataFrame:
    """Revenue share of the top spenders among promo-dependent customers.

    The top p percent are the first ``ceil(p * n / 100)`` by spend, ties by customer id.
    Runs jobs: those customers are written once, and the borders are selected from them.
    """
    dependent = promo_usage(orders).where(_depends_on_promo(threshold_pct)).select("customer_id", "spend")
    spend = F.col("spend")
    key = F.struct(spend.isNull().alias("unknown"), (-spend).alias("value"), F.col("customer_id").alias("id"))
    ranked = with_top(dependent, key, {f"in_{p}": p for p in top_pcts})
    sums = []
    for p in top_pcts:
        inside = F.col(f"in_{p}")
        sums += [count_where(inside).alias(f"n_{p}"), F.sum(F.when(inside, F.col("spend"))).alias(f"s_{p}")]
    wide = ranked.agg(F.sum("spend").alias("total"), *sums)
    rows = F.array(
        *(
            F.struct(
                F.lit(p).cast("bigint").alias("top_pct"),
                F.col(f"n_{p}").alias("customers"),
                F.col(f"s_{p}").alias("revenue"),
            )
            for p in top_pcts
        )
    )
    return wide.select("total", F.inline(rows)).select(
        "top_pct",
        "customers",
        F.col("revenue").cast("double").alias("top_revenue"),
        F.col("total").cast("double").alias("segment_revenue"),
        pct(cents(F.col("revenue")), cents(F.col("total"))).alias("revenue_share_pct"),
    )


def order_frequency(orders: DataFrame) -> DataFrame:
    """Customers by number of orders, and their share."""
    per = _known_customer(orders).groupBy("customer_id").agg(F.count("order_id").alias("frequency_orders"))
    counts = per.groupBy("frequency_orders").agg(F.count("*").alias("customers"))
    whole = counts.agg(F.sum("customers").alias("_all"))
    return with_scalars(counts, whole).select(
        "frequency_orders", "customers", pct(F.col("customers"), F.col("_all")).alias("share_pct")
    )
