"""Month arithmetic on dates and zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(moment: Column) -> Column:
    """First day of the month, as a DATE."""
    return F.trunc(moment.cast("date"), "MM")


def month_label(moment: Column) -> Column:
    """``yyyy-MM`` text of a date or timestamp."""
    return F.date_format(moment.cast("date"), "yyyy-MM")


def month_index(moment: Column) -> Column:
    """Months since year 0: consecutive whole numbers for consecutive months."""
    return F.year(moment) * 12 + F.month(moment) - 1


def month_of_index(index: Column) -> Column:
    """First day of the month with the given ``month_index``."""
    return F.make_date(F.floor(index / 12).cast("int"), (index % 12 + 1).cast("int"), F.lit(1))


def months_between_starts(earlier: Column, later: Column) -> Column:
    """Number of month boundaries crossed between two moments.

    30 September to 1 October counts as one month, unlike an elapsed-time difference.
    """
    return (month_index(later) - month_index(earlier)).cast("bigint")
