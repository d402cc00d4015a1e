"""Text clean-up expressions for string-typed landing columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms the source systems write.
NULL_TOKENS = ("", "NaN", "null", "NULL")
CLOCK_FIRST, DATE_FIRST = "h:mm a, MMMM d yyyy", "yyyy-MM-dd HH:mm:ss"
# Each time pattern with the SQL LIKE shape of the texts that can match it.
TIME_FORMS = {CLOCK_FIRST: "%:% %, % % %", DATE_FIRST: "____-%-% %:%:%"}
SHORT_DISTANCE_TEXT = "<1km"
SHORT_DISTANCE_KM = 0.5
DISTANCE_UNIT = "km"


def null_if_token(text: Column, tokens=NULL_TOKENS) -> Column:
    """NULL where the text is one of the tokens that stand for a missing value."""
    return F.when(~text.isin(*tokens), text)


def tidy_text(text: Column) -> Column:
    return F.lower(F.trim(text))


def parse_moment(text: Column, forms=TIME_FORMS) -> Column:
    """Zone-less timestamp from the first matching pattern, NULL when none matches.

    The text is read as UTC and carried to TIMESTAMP_NTZ by its distance from the
    epoch, so the wall time survives whatever zone the session runs in. A failed parse is
    slow, so a pattern is tried only on texts of its shape.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    trimmed = F.trim(text)

    def read(pattern: str) -> Column:
        instant = F.try_to_timestamp(F.concat(trimmed, F.lit(" +0000")), F.lit(f"{pattern} Z"))
        return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)

    return F.coalesce(*(F.when(trimmed.like(shape), read(p)) for p, shape in forms.items()))


def parse_distance(text: Column) -> Column:
    """Kilometres from a bucketed distance label; NULL when it is not a number."""
    number = F.replace(text, F.lit(DISTANCE_UNIT)).try_cast("double")
    return F.when(text == SHORT_DISTANCE_TEXT, F.lit(SHORT_DISTANCE_KM)).otherwise(number)
