"""Running figures kept up by batch: additive counts per day and key, merged instead of recounted.

A batch of orders (with their delivery rows) is reduced to counts and these are committed once to a table
of the marts layer. Every figure below comes from the merged counts, which have a row per day, zone and
partner, so history is never read again. A batch that is corrected later replaces its own counts.

Counts of one order must come from one batch: an order belongs to the batch of its delivery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderloom.functions.calendar import month_start
from orderloom.functions.rates import count_where
from orderloom.operators import customer_kpis, delivery_kpis
from orderloom.sources.commits import CommittedTable

KEYS = ("order_date", "subzone", "partner_id", "has_delivery")
COUNTS = ("rows", "orders", "deliverable", "late", "served_rows", "served_orders", "complaints")
_SCHEMA = "order_date date, subzone string, partner_id string, has_delivery boolean, " + ", ".join(
    f"{c} bigint" for c in COUNTS
)


def daily_counts(orders: DataFrame, resolved: DataFrame) -> DataFrame:
    """Counts of a batch: one shuffle of partial sums, combined in the tasks that read the orders."""
    late = resolved.select("order_id", "partner_id", "is_late", F.lit(True).alias("has_delivery"))
    joined = orders.join(late, "order_id", "left")
    served = ~F.col("order_status").isin(*customer_kpis.NEVER_SERVED)
    return joined.groupBy(
        F.col("order_placed_at").cast("date").alias("order_date"),
        "subzone",
        "partner_id",
        F.coalesce("has_delivery", F.lit(False)).alias("has_delivery"),
    ).agg(
        F.count("*").alias("rows"),
        F.count("order_id").alias("orders"),
        count_where(F.col("is_late").isNotNull()).alias("deliverable"),
        count_where(F.col("is_late") == 1).alias("late"),
        count_where(served).alias("served_rows"),
        count_where(served & F.col("order_id").isNotNull()).alias("served_orders"),
        count_where(served & F.col("customer_complaint_tag").isNotNull()).alias("complaints"),
    )


class DailyCounts:
    """The committed counts of all batches."""

    def __init__(self, table: CommittedTable):
        self._table = table

    def add(self, batch: str, orders: DataFrame, resolved: DataFrame, *, replace: bool = False) -> bool:
        """Count a batch once; False if it is counted already."""
        return self._table.append(batch, daily_counts(orders, resolved), replace=replace)

    def by(self, *keys, delivered: bool = False) -> DataFrame:
        """Merged counts by ``keys``; ``delivered``: only of orders that have a delivery row."""
        counts = self._table.read(schema=_SCHEMA)
        counts = counts.where("has_delivery") if delivered else counts
        return counts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in COUNTS))

    # -- figures -------------------------------------------------------------------------

    def rolling_daily_late_rate(self, days: int = 7, calendar: bool = False) -> DataFrame:
        per = self.by("order_date").select(
            "order_date", F.col("deliverable").alias("daily_deliverable_orders"), F.col("late").alias("daily_late_orders")
        )
        return delivery_kpis.roll_days(per, days, calendar)

    def rolling_monthly_late_rate(self, months: int = 3) -> DataFrame:
        per = self.by(month_start(F.col("order_date")).alias("_month")).select(
            "_month", F.col("deliverable").alias("monthly_deliverable_orders"), F.col("late").alias("monthly_late_orders")
        )
        return delivery_kpis.roll_months(per, months)

    def monthly_partner_outliers(self, **limits) -> DataFrame:
        known = self.by(month_start(F.col("order_date")).alias("_month"), "partner_id", delivered=True)
        per = known.where(F.col("partner_id").isNotNull()).select(
            "_month",
            "partner_id",
            F.col("deliverable").alias("monthly_deliverable_orders"),
            F.col("late").alias("_late"),
            F.col("rows").alias("_rows"),
        )
        return delivery_kpis.test_partner_months(per, **limits)

    def partner_concentration(self, **limits) -> DataFrame:
        per = self.by(month_start(F.col("order_date")).alias("_month"), "subzone", "partner_id", delivered=True)
        return delivery_kpis.lead_of_zone_months(
            per.select("_month", "subzone", "partner_id", F.col("orders").alias("_n")), **limits
        )

    def complaint_rate(self) -> DataFrame:
        per = self.by(month_start(F.col("order_date")).alias("_month")).where("served_rows > 0")
        return customer_kpis.complaint_share(
            per.select(
                "_month",
                F.col("served_orders").alias("total_orders"),
                F.col("complaints").alias("complaint_count"),
                F.col("served_rows").alias("_rows"),
            )
        )
