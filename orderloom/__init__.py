"""Delivery and retention analytics as composable Spark DataFrame operators."""
