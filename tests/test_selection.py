"""Tiles and tops by selection equal those of sorted tables, whatever the sample."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from orderloom.functions import selection
from tests.test_plans import executed_plan, static_plan
from tests.test_ranking import skewed
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


def key(x="x"):
    return F.struct(F.col(x).isNull().alias("unknown"), F.col(x).alias("value"), F.col("key"))


@pytest.fixture(params=[(100_000, 4_000), (20, 12), (7, 3), (1, 2)])
def limits(request, monkeypatch):
    """Also with so few sampled keys that brackets miss."""
    for name, value in zip(("DIRECT_ROWS", "SAMPLED_KEYS"), request.param):
        monkeypatch.setattr(selection, name, value)


@pytest.mark.parametrize("n,tiles", [(503, 5), (3, 5), (1, 5), (0, 5), (10, 20)])
def test_tiles_equal_the_built_in_function(spark, limits, n, tiles):
    df = skewed(spark, n)
    down = F.struct(F.col("x").isNotNull().alias("known"), (-F.col("x")).alias("value"), F.col("key"))
    mine = selection.with_tiles(df, {"up": key(), "down": down}, tiles)
    orders = {"up": F.col("x").asc_nulls_last(), "down": F.col("x").desc_nulls_first()}
    theirs = df.select("key", "x", *(F.ntile(tiles).over(Window.orderBy(o, "key")).cast("bigint").alias(c) for c, o in orders.items()))
    assert mine.columns == ["key", "x", "up", "down"]
    assert sorted(map(str, mine.collect())) == sorted(map(str, theirs.collect()))


@pytest.mark.parametrize("n", [400, 9, 1, 0])
def test_tops_equal_ranks(spark, limits, n):
    df = skewed(spark, n)
    got = selection.with_top(df, key(), {"a": 10, "b": 33, "none": 0, "all": 100})
    rank = F.row_number().over(Window.orderBy(F.col("x").asc_nulls_last(), "key"))
    want = df.select("key", *((rank <= -(-n * p // 100)).alias(c) for c, p in (("a", 10), ("b", 33), ("none", 0), ("all", 100))))
    assert sorted(map(str, got.drop("x").collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["e6_rfm_scores", "e13_spend_concentration"])
def test_scores_need_no_sort_of_the_table(spark, name):
    plan = static_plan(QUERIES[name](spark, SF))
    assert "rangepartitioning" not in plan and "Window" not in plan


def test_the_narrowing_passes_sort_nothing_whole(spark, monkeypatch):
    """A bracket's sample leaves each task as its first rows by hash."""
    monkeypatch.setattr(selection, "DIRECT_ROWS", 50)
    df = skewed(spark, 500).withColumn("k", key())
    inside = selection._inside(df, [("k", None, None)], {"k": df.schema["k"].dataType})
    order = Window.partitionBy("span").orderBy(F.xxhash64("key_0"), "key_0")
    plan = executed_plan(inside.withColumn("place", F.row_number().over(order)).where("place <= 5"))
    assert "WindowGroupLimit" in plan
