from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orderloom.functions import calendar, rates
from orderloom.functions.parsing import null_if_token, parse_distance, parse_moment, tidy_text
from orderloom.sources.files import cast_text


def values(spark, texts, expression, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_both_time_formats_and_bad_text(spark):
    texts = ["11:38 PM, September 10 2024", "1:05 AM, March 5 2025", "2024-09-10 23:38:00",
             "  01:05 AM, March 05 2025 ", "not a date", "2024-13-40 00:00:00", "", None]
    assert values(spark, texts, parse_moment) == [
        datetime(2024, 9, 10, 23, 38), datetime(2025, 3, 5, 1, 5), datetime(2024, 9, 10, 23, 38),
        datetime(2025, 3, 5, 1, 5), None, None, None, None,
    ]


def test_wall_time_survives_a_daylight_saving_gap(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist on that day in this zone
        assert values(spark, ["2:30 AM, March 9 2025"], parse_moment) == [datetime(2025, 3, 9, 2, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_distance(spark):
    assert values(spark, ["<1km", "3km", "12km", "far", None], parse_distance) == [0.5, 3.0, 12.0, None, None]


def test_null_tokens_and_text(spark):
    assert values(spark, ["", "NaN", "null", "NULL", "Nan", "x", None], null_if_token) == [
        None, None, None, None, "Nan", "x", None,
    ]
    assert values(spark, ["  North Side ", "EAST", None], tidy_text) == ["north side", "east", None]


def test_whole_numbers_in_both_spellings(spark):
    got = values(spark, ["1", "1.0", "0.0", "x", "1.x", None], lambda t: cast_text(t, "int"))
    assert got == [1, 1, 0, None, None, None]
    assert values(spark, ["99999999999999999999", "12"], lambda t: cast_text(t, "bigint")) == [None, 12]


def test_month_gap_counts_boundaries(spark):
    df = spark.sql("SELECT date'2024-09-30' AS a, date'2024-10-01' AS b, date'2025-01-31' AS c")
    gap = calendar.months_between_starts
    row = df.select(gap(F.col("a"), F.col("b")), gap(F.col("a"), F.col("c"))).first()
    assert tuple(row) == (1, 4)
    back = calendar.month_of_index(calendar.month_index(F.col("c")))
    assert str(df.select(back).first()[0]) == "2025-01-01"


@pytest.mark.parametrize("num,den,expected", [(1, 3, 33.33), (1, 8, 12.5), (1, 800, 0.13), (0, 5, 0.0), (5, 0, None)])
def test_percentage_rounds_half_up(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "n bigint, d bigint")
    assert df.select(rates.pct(F.col("n"), F.col("d"))).first()[0] == expected


def test_exact_mean_rounds_half_away_from_zero(spark):
    def mean(xs):
        return spark.createDataFrame([(x,) for x in xs], "x double").agg(rates.exact_mean(F.col("x"))).first()[0]

    assert mean([0.01, 0.02, 0.0, 0.03, None]) == 0.02  # 0.015
    assert mean([-0.01, -0.02, 0.0, -0.03]) == -0.02
    assert mean([None]) is None
