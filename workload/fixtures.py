"""The shared test tables in the shape the operators expect (see FIXTURES.md).

Every frame covers the whole of its source tables. Planted defects are expressions on the
order key, and ``workload.oracle`` states the same expressions in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderloom.sources.schemas import ORDERS


# The columns read, so that no job is spent on finding them out.
COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_regionkey int",
    "customer": "c_custkey bigint, c_nationkey int",
    "supplier": "s_suppkey bigint, s_acctbal double",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_tax double",
    "events": "event_id bigint, user_id bigint, event_type string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


PARTNER_ID = "concat('DP', lpad({}, 9, '0'))"
KM = "CASE WHEN km_step < 1 THEN 0.5D ELSE double(km_step) END"


def _main_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lowest line of each order with its part: outlet, distance and durations."""
    line = (
        table(spark, sf_dir, "lineitem")
        .selectExpr("l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS line")
        .groupBy("l_orderkey")
        .agg({"line": "min"})
        .toDF("l_orderkey", "line")
        .select("l_orderkey", "line.*")
    )
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    return line.join(part, "l_partkey", "left").selectExpr(
        "l_orderkey AS order_id",
        "l_suppkey AS main_supplier",
        "l_partkey AS restaurant_id",
        "lower(p_brand) AS restaurant_name",
        "int(floor(l_quantity / 5)) AS km_step",
        "p_size * 7 / 10.0D AS kitchen_minutes",
        "round(l_tax * 100) AS wait_minutes",
        "double(p_size) AS size",
    )


def _zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").toDF("o_custkey", "n_nationkey")
    nation = table(spark, sf_dir, "nation").toDF("n_nationkey", "r_regionkey")
    named = customer.join(nation, "n_nationkey", "left").join(
        table(spark, sf_dir, "region"), "r_regionkey", "left"
    )
    return named.selectExpr("o_custkey", "lower(r_name) AS subzone")


def orders(spark: SparkSession, sf_dir: str, line: bool = False, zone: bool = False) -> DataFrame:
    """Clean orders, one row each; ``line`` and ``zone`` add the columns that need joins."""
    base = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "order_id")
    columns = [
        "order_id",
        "concat('C', o_custkey, '-', year(o_orderdate)) AS customer_id",
        "timestampadd(MINUTE, int(order_id % 1440), o_orderdate) AS order_placed_at",
        """CASE o_orderstatus WHEN 'F' THEN 'Delivered'
             WHEN 'O' THEN CASE order_id % 10 WHEN 0 THEN 'Returned' WHEN 1 THEN 'Return cancelled'
                           ELSE 'Delivered' END
             ELSE CASE order_id % 3 WHEN 0 THEN 'Rejected' WHEN 1 THEN 'Timed out' ELSE 'Picked up' END
           END AS order_status""",
        "CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderpriority END"
        " AS discount_construct",
        "CAST(o_totalprice AS decimal(18,2)) AS total",
        "CASE WHEN order_id % 1000 = 0 THEN 6D WHEN order_id % 8 = 0 THEN double(1 + order_id % 5) END"
        " AS rating",
        "CASE WHEN order_id % 40 = 0 THEN 'Wrong item' END AS customer_complaint_tag",
    ]
    if line:
        base = base.join(_main_lines(spark, sf_dir), "order_id", "left")
        columns += [
            "restaurant_id",
            "restaurant_name",
            f"CASE WHEN km_step IS NOT NULL THEN {KM} END AS distance_km",
            "CASE WHEN order_id % 997 = 0 THEN -size WHEN order_id % 50 != 0 THEN kitchen_minutes END"
            " AS kpt_duration_minutes",
            "CASE WHEN order_id % 53 != 0 THEN wait_minutes END AS rider_wait_time_minutes",
        ]
    if zone:
        base = base.join(_zones(spark, sf_dir), "o_custkey", "left")
        columns.append("subzone")
    return base.selectExpr(*columns)


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery rows, one per order line: repeats, and other partners for some orders.

    Orders that never reached a rider keep their rows with everything else NULL.
    """
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS order_id", "l_suppkey")
    served = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id", "o_orderstatus != 'P' AS served"
    )
    timed = (
        lines.join(_main_lines(spark, sf_dir), "order_id")
        .join(served, "order_id")
        .selectExpr(
            "*",
            "CASE WHEN order_id % 40 = 0 THEN l_suppkey ELSE main_supplier END AS supplier",
            f"{KM} AS km",
            "bround((38 + 3.2D * km) / 5) * 5 AS promised",
            "kitchen_minutes + wait_minutes + greatest(3D, 6 + 2.3D * km)"
            " + CASE WHEN supplier % 25 = 0 THEN 14D ELSE 0D END AS actual",
        )
    )
    partner = PARTNER_ID.format("supplier")
    return timed.selectExpr(
        "order_id",
        f"CASE WHEN served THEN {partner} END AS partner_id",
        "CASE WHEN served THEN promised END AS promised_sla_minutes",
        "CASE WHEN served THEN actual END AS actual_fulfillment_minutes",
        "CASE WHEN served THEN int(actual > promised) END AS is_late",
    )


def ops_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery rows as landed text, with the flag spelled ``1.0``."""
    rows = ops(spark, sf_dir)
    return rows.selectExpr(
        *(f"string({c}) AS {c}" for c in rows.columns if c != "is_late"),
        "string(double(is_late)) AS is_late",
    )


def restaurants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets from all parts; the keys of some are misprinted, which orphans their orders."""
    return table(spark, sf_dir, "part").selectExpr(
        "string(CASE WHEN p_partkey % 100 = 7 THEN -p_partkey - 1 ELSE p_partkey END) AS restaurant_id",
        "lower(p_brand) AS restaurant_name",
        "lower(p_type) AS subzone",
        "'metro city' AS city",
    )


def partners(spark: SparkSession, sf_dir: str, condition: str = "true") -> DataFrame:
    partner = PARTNER_ID.format("s_suppkey")
    return table(spark, sf_dir, "supplier").where(condition).selectExpr(f"{partner} AS partner_id")


FROM_LINE = {"restaurant_id", "restaurant_name", "distance", "kpt_duration_minutes", "rider_wait_time_minutes"}


def orders_raw(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Landed orders: text columns with repeats, two time formats, untidy text and null tokens.

    A landing table is one wide file whose unused columns cost nothing; with ``columns`` the
    joins behind unused ones are left out here too.
    """
    columns = columns or tuple(ORDERS)
    gold = "CASE WHEN order_id % 4 != 0 THEN order_id % 3 END"
    discounts = f"order_id % 50 + order_id % 7 + coalesce({gold}, 0) + order_id % 5"
    misprint = "CASE WHEN order_id % 641 = 0 THEN 1 ELSE 0 END"
    packaging = "10 + order_id % 15"
    rotating = "CASE order_id % 3 WHEN 0 THEN 'NaN' WHEN 1 THEN 'null' ELSE '' END"
    moved = "timestampadd(HOUR, CASE WHEN copy = 2 THEN int(order_id % 3) - 1 ELSE 0 END, order_placed_at)"
    values = {
        "restaurant_id": "string(restaurant_id)",
        "restaurant_name": "CASE WHEN order_id % 25 = 1 THEN concat('  ', restaurant_name, '  ')"
        " ELSE restaurant_name END",
        "subzone": "CASE WHEN order_id % 25 = 0 THEN upper(subzone) ELSE subzone END",
        "city": "'Metro City'",
        # second copies spell the key otherwise, and differ in time format, time and kitchen time
        "order_id": "CASE WHEN copy = 2 THEN concat(order_id, '.0') ELSE string(order_id) END",
        "order_placed_at": "CASE WHEN order_id % 1013 = 0 THEN 'not a date'"
        f" WHEN (order_id % 20 = 0) != (copy = 2) THEN date_format({moved}, 'yyyy-MM-dd HH:mm:ss')"
        f" ELSE date_format({moved}, 'hh:mm a, MMMM dd yyyy') END",
        "order_status": "order_status",
        "delivery": "'Platform Delivery'",
        "distance": "CASE WHEN distance_km < 1 THEN '<1km' ELSE concat(int(distance_km), 'km') END",
        "items_in_order": "concat(1 + order_id % 4, ' x dish, sauce')",
        "discount_construct": "coalesce(discount_construct, 'null')",
        "bill_subtotal": f"string(CAST(total - ({packaging}) + {discounts} + {misprint} AS decimal(18,2)))",
        "packaging_charges": f"string({packaging})",
        "restaurant_discount_promo": "string(order_id % 50)",
        "restaurant_discount_flat": "string(order_id % 7)",
        "gold_discount": f"coalesce(string({gold}), 'NaN')",
        "brand_pack_discount": "string(order_id % 5)",
        "total": "string(total)",
        "rating": "coalesce(string(rating), '')",
        "review": "CASE WHEN order_id % 90 = 0 THEN concat('cold, \"late\"', chr(10), 'again ', order_id) END",
        "kpt_duration_minutes": "CASE WHEN copy = 2 AND order_id % 3 = 1 THEN string(order_id % 7 + 0.5D)"
        f" ELSE coalesce(string(kpt_duration_minutes), {rotating}) END",
        "rider_wait_time_minutes": "coalesce(string(rider_wait_time_minutes), 'NULL')",
        "order_ready_marked": "CASE order_id % 3 WHEN 0 THEN 'Correctly' WHEN 1 THEN 'Incorrectly'"
        " ELSE 'Missed' END",
        "customer_complaint_tag": "customer_complaint_tag",
        "customer_id": "customer_id",
    }
    copies = "explode(sequence(1, CASE WHEN order_id % 500 = 0 THEN 2 ELSE 1 END)) AS copy"
    clean = orders(spark, sf_dir, line=bool(FROM_LINE & set(columns)), zone="subzone" in columns)
    texts = [f"{values.get(c, 'string(NULL)')} AS {c}" for c in columns]
    return clean.selectExpr("*", copies).selectExpr(*texts)
