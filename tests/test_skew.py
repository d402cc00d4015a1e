"""One key holds a third of all rows: results equal brute force, and the key shrinks early."""

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from orderloom.functions.ranking import with_rank
from orderloom.operators import customers as cust
from orderloom.operators import delivery as dlv
from orderloom.operators import prep, staging

N = 30_000


def shuffled_rows(df):
    """Rows written by each shuffle of the executed plan."""
    df.collect()
    found = []

    def visit(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if name.startswith(("ShuffleQueryStage", "ResultQueryStage", "TableCacheQueryStage")):
            return visit(node.plan())
        if name == "Exchange":
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    visit(df._jdf.queryExecution().executedPlan())
    return found


def hot(column, others):
    """A third of the rows get key 0."""
    return F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id") % others)


def test_hot_order_collapses_before_the_shuffle(spark):
    rows = spark.range(N).select(
        hot("id", 5000).alias("order_id"), F.col("id").cast("string").alias("customer_id"),
        F.lit(datetime(2024, 9, 1)).cast("timestamp_ntz").alias("order_placed_at"),
        (F.col("id") % 90).cast("double").alias("kpt_duration_minutes"))
    kept = staging.dedup_orders(rows)
    best = rows.groupBy("order_id").agg(F.max("kpt_duration_minutes").alias("k"))
    assert kept.select("order_id", "kpt_duration_minutes").exceptAll(best).count() == 0
    assert kept.count() == best.count()
    assert sum(shuffled_rows(kept)) < N * 0.75  # the hot third is gone


def test_hot_order_in_delivery_rows(spark):
    rows = spark.range(N).select(
        hot("id", 5000).alias("order_id"), F.concat(F.lit("P"), F.col("id") % 40).alias("partner_id"),
        F.lit(40.0).alias("promised_sla_minutes"), (F.col("id") % 70).cast("double").alias("actual_fulfillment_minutes"),
        (F.col("id") % 2).cast("int").alias("is_late"))
    short = dlv.resolve_repeated(rows)
    full = dlv.resolve_assignments(staging.dedup_ops(rows))
    assert full.drop("partners_assigned").exceptAll(short.select(full.drop("partners_assigned").columns)).count() == 0
    assert short.count() == full.count()
    assert sum(shuffled_rows(short)) < N * 0.75


def test_hot_customer(spark):
    start = datetime(2023, 1, 1)
    rows = [(i, "hot" if i % 3 == 0 else f"c{i * 7919 % 4001}", start + timedelta(days=i * 31 % 700)) for i in range(N)]
    df = spark.createDataFrame(rows, "order_id bigint, customer_id string, order_placed_at timestamp_ntz")
    months = defaultdict(set)
    for _, customer, placed in rows:
        months[customer].add(placed.year * 12 + placed.month)
    expected = defaultdict(int)
    for active in months.values():
        for m in active:
            expected[min(active), m - min(active)] += 1
    got = {(r.cohort_month, r.months_since_first_order): r.active_customers for r in cust.retention_matrix(df).collect()}
    named = {(f"{(k - 1) // 12}-{(k - 1) % 12 + 1:02d}", o): n for (k, o), n in expected.items()}
    assert got == named
    bitmaps = cust.month_bitmaps(df)
    assert sum(shuffled_rows(bitmaps)) < N * 0.75
    flagged = df.withColumn("discount_construct", F.when(F.col("order_id") % 2 == 0, "x"))
    split = defaultdict(int)
    for r in cust.retention_by_first_order(flagged).collect():
        split[r.cohort_month, r.months_since_first_order] += r.active_customers
    assert split == named


def test_months_beyond_one_number(spark):
    """Activity over centuries, before and after the year 0 of the bit count, and orders without a date."""
    dates = [datetime(1, 1, 5), datetime(1969, 12, 31), datetime(1970, 1, 1), datetime(2275, 6, 1), datetime(9999, 12, 1), None]
    rows = [(i, "a", d) for i, d in enumerate(dates)] + [(9, "b", None), (10, "c", dates[2]), (11, None, dates[2])]
    df = spark.createDataFrame(rows, "order_id bigint, customer_id string, order_placed_at timestamp_ntz")
    df = df.withColumn("discount_construct", F.when(F.col("order_id").isin(0, 9), "x"))
    got = {
        (r.first_order_had_discount, r.cohort_month, r.months_since_first_order, r.active_customers)
        for r in cust.retention_by_first_order(df).collect()
    }
    start = 12
    since = [(d.year * 12 + d.month - 1) - start if d else None for d in dates]
    assert got == {*((True, "0001-01", n, 1) for n in since), (True, None, None, 1), (False, "1970-01", 0, 1)}


def test_hot_value_in_a_ranking(spark):
    df = spark.range(N).select("id", hot("id", 1000).alias("x"))
    ranked = with_rank(df, [F.col("x").asc(), F.col("id").asc()], "rank")
    order = sorted((r.x, r.id) for r in df.collect())
    assert {r.id: r.rank for r in ranked.collect()} == {i: n + 1 for n, (_, i) in enumerate(order)}
