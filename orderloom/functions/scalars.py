"""Attach whole-table and per-group statistics without unpartitioned windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the columns of the one-row ``stats`` to every row of ``df``.

    A scalar subquery: ``stats`` is computed once and enters the plan as a literal.
    """
    holder = "_scalars"
    row = stats.select(F.struct(*stats.columns)).scalar()
    return df.withColumn(holder, row).select(
        *df.columns, *(F.col(f"{holder}.{c}").alias(c) for c in stats.columns)
    )


def with_group_stats(df: DataFrame, keys: list[str], stats: DataFrame) -> DataFrame:
    """Join per-group ``stats`` (one row per ``keys``) back; NULL keys match each other."""
    renamed = stats.select(
        *(F.col(k).alias(f"_g_{k}") for k in keys), *(c for c in stats.columns if c not in keys)
    )
    match = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys))
    return df.join(renamed, match).drop(*(f"_g_{k}" for k in keys))
