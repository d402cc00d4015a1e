"""Column names of the landing tables, in file order, and their typed forms."""

from __future__ import annotations

from pyspark.sql import types as T

ORDERS = {
    "restaurant_id": "bigint",
    "restaurant_name": "string",
    "subzone": "string",
    "city": "string",
    "order_id": "bigint",
    "order_placed_at": "string",
    "order_status": "string",
    "delivery": "string",
    "distance": "string",
    "items_in_order": "string",
    "instructions": "string",
    "discount_construct": "string",
    "bill_subtotal": "decimal(18,2)",
    "packaging_charges": "decimal(18,2)",
    "restaurant_discount_promo": "decimal(18,2)",
    "restaurant_discount_flat": "decimal(18,2)",
    "gold_discount": "decimal(18,2)",
    "brand_pack_discount": "decimal(18,2)",
    "total": "decimal(18,2)",
    "rating": "double",
    "review": "string",
    "cancellation_reason": "string",
    "restaurant_compensation": "decimal(18,2)",
    "restaurant_penalty": "decimal(18,2)",
    "kpt_duration_minutes": "double",
    "rider_wait_time_minutes": "double",
    "order_ready_marked": "string",
    "customer_complaint_tag": "string",
    "customer_id": "string",
}

RESTAURANTS = {
    "restaurant_id": "bigint",
    "restaurant_name": "string",
    "subzone": "string",
    "city": "string",
}

PARTNERS = {
    "partner_id": "string",
    "vehicle_type": "string",
    "home_subzone": "string",
    "join_date": "date",
}

DELIVERY_OPS = {
    "order_id": "bigint",
    "partner_id": "string",
    "promised_sla_minutes": "double",
    "actual_fulfillment_minutes": "double",
    "is_late": "int",
}

LANDING = {
    "orders_raw": ORDERS,
    "restaurants_dim": RESTAURANTS,
    "delivery_partners_dim": PARTNERS,
    "delivery_ops_fact": DELIVERY_OPS,
}


def landing_schema(table: str) -> T.StructType:
    """All-string schema in which a table is loaded before any cleaning."""
    return T.StructType([T.StructField(name, T.StringType()) for name in LANDING[table]])
