"""Exact ratios and means.

Percentages and means are rounded half-up on integers, so the last digit does
not depend on the order in which partial sums were merged.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
WIDE = "decimal(38,0)"


def _div(num: Column, den: Column) -> Column:
    return F.call_function("div", num, den)


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def pct(num: Column, den: Column) -> Column:
    """``100 * num / den`` rounded half-up to two decimals; NULL when ``den`` is 0.

    Both sides are non-negative whole numbers (counts, or money in cents).
    """
    num, den = num.cast(WIDE), F.nullif(den.cast(WIDE), F.lit(0).cast(WIDE))
    return _div(num * 20000 + den, den * 2).cast("double") / 100


def cents(amount: Column) -> Column:
    """Money amount as a whole number of cents."""
    return (amount.cast("decimal(28,2)") * 100).cast(WIDE)


def money_sum(amount: Column) -> Column:
    """Sum of a money column in exact decimal arithmetic."""
    return F.sum(amount.cast(MONEY))


def exact_mean(value: Column) -> Column:
    """Mean of ``value`` (up to six decimals) rounded half away from zero to two.

    An aggregate: the sum is an exact decimal, hence independent of row order.
    """
    exact = value.cast("decimal(18,6)")
    micros = (F.sum(exact) * 1000000).cast(WIDE)
    step = F.nullif(F.count(exact), F.lit(0)).cast(WIDE) * 10000
    magnitude = _div(F.abs(micros) * 2 + step, step * 2).cast("double") / 100
    return F.when(micros < 0, -magnitude).otherwise(magnitude)
