import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions import ranking


def skewed(spark, n):
    """A third of the rows share one value, and some have none."""
    x = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.xxhash64("id") % 50)
    return spark.range(n).select(F.col("id").alias("key"), x.cast("bigint").alias("x"))


@pytest.mark.parametrize("n,tiles", [(5000, 5), (5003, 7), (3, 5), (1, 5), (0, 5), (1000, 1000), (10, 20)])
@pytest.mark.parametrize("ascending", [True, False])
def test_tiles_equal_the_built_in_function(spark, n, tiles, ascending):
    df = skewed(spark, n)
    order = [F.col("x").asc_nulls_last() if ascending else F.col("x").desc_nulls_first(), F.col("key").asc()]
    mine = {r.key: r.tile for r in ranking.with_tile(df, order, tiles, "tile").collect()}
    theirs = {r.key: r.t for r in df.select("key", F.ntile(tiles).over(Window.orderBy(*order)).alias("t")).collect()}
    assert mine == theirs


def test_rank_is_dense_and_hot_values_are_spread(spark):
    df = skewed(spark, 9000)
    order = [F.col("x").asc_nulls_last(), F.col("key").asc()]
    slices = ranking._slices(df, order, "test")
    sizes = [r["count"] for r in slices.groupBy("_slice").count().collect()]
    assert max(sizes) < 9000 / 3  # the hot third is not in one slice
    ranks = [r.rank for r in ranking.with_rank(df, order, "rank").collect()]
    assert sorted(ranks) == list(range(1, 9001))


def test_running_total(spark):
    df = skewed(spark, 500).withColumn("w", F.col("key") % 4)
    order = [F.col("key").asc()]
    got = ranking.with_running_total(df, order, "w", "before", "total").orderBy("key").collect()
    weights = [k % 4 for k in range(500)]
    assert [r.before for r in got] == list(np.cumsum([0] + weights[:-1]))
    assert {r.total for r in got} == {sum(weights)}


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [5.0] * 7 + [1.0, 9.0], [3.0, None, 1.0, 2.0, None, 10.0]])
def test_medians_of_two_columns(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, w int")
    known = [v for v in values if v is not None]
    row = ranking.exact_medians(df, "v", "w").first()
    assert (row.v, row.w) == (np.median(known), np.median(range(len(values))))


def test_median_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0)], "v double, w double")
    row = ranking.exact_medians(df, "v", "w").first()
    assert (row.v, row.w) == (None, 1.0)
