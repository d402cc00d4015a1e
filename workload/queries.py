"""One query per operator, each over the whole of the tables it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions import storage
from orderloom.functions.calendar import month_label
from orderloom.operators import customer_kpis as growth
from orderloom.operators import customers as cust
from orderloom.operators import delivery as dlv
from orderloom.operators import delivery_kpis as kpi
from orderloom.operators import prep, quality, staging
from orderloom.plans import flows, upkeep
from orderloom.sources import commits, files, layers, quarantine
from workload import fixtures as fx

ZONE = "asia"
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# -- frames ------------------------------------------------------------------------------


def _landed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return files.normalize_nulls(fx.orders_raw(spark, d, *columns))


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return staging.stage_orders(_landed(spark, d), fx.restaurants(spark, d))


def _staged_ops(spark: SparkSession, d: str) -> DataFrame:
    return staging.stage_ops(files.normalize_nulls(fx.ops_raw(spark, d)))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return dlv.resolve_repeated(fx.ops(spark, d))


def _segments(spark: SparkSession, d: str, line: bool = False, zone: bool = False) -> DataFrame:
    return dlv.delivery_segments(fx.orders(spark, d, line, zone), _resolved(spark, d))


def _lateness(spark, d, how="left", line=False, zone=False) -> DataFrame:
    return kpi.with_lateness(fx.orders(spark, d, line, zone), _resolved(spark, d), how)


def _outliers(spark: SparkSession, d: str) -> DataFrame:
    return dlv.partner_outliers(_segments(spark, d))


def _rfm(spark: SparkSession, d: str) -> DataFrame:
    return cust.rfm_segments(cust.rfm_scores(cust.rfm_base(fx.orders(spark, d))))


def _short_trip_in_zone():
    return (F.col("subzone") == ZONE) & (F.col("distance_km") <= 1)


def _by_name(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


# -- A: sources and layers ---------------------------------------------------------------


@query
def a1_csv_source(spark, d):
    path = storage.new_path(spark, "restaurants-csv")
    printed = fx.restaurants(spark, d).toDF("Restaurant ID", "Restaurant name", "Subzone", "City")
    files.write_csv(printed, path)
    return files.typed(files.read_landing_csv(spark, "restaurants_dim", path), "restaurants_dim")


@query
def a2_null_tokens(spark, d):
    landed = _landed(spark, d)
    counts = landed.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in landed.columns))
    return counts.unpivot([], counts.columns, "column_name", "null_rows")


@query
def a3_landing_orders(spark, d):
    return fx.orders_raw(spark, d)


@query
def a4_bulk_append(spark, d):
    house = layers.Warehouse(spark, storage.new_path(spark, "append"))
    for late in (False, True):
        recent = F.coalesce(F.year("order_placed_at") >= 1998, F.lit(False))  # undated orders come first
        batch = fx.orders(spark, d).where(recent == F.lit(late))
        house.append("raw", "orders", batch.select("order_id", "order_placed_at", "order_status"))
    return house.source("raw", "orders").groupBy("order_status").agg(F.count("*").alias("orders"))


def _expected_rows(spark, d) -> DataFrame:
    def rows(name):
        return fx.table(spark, d, name)

    key = F.col("o_orderkey")
    twice = F.count_if(key % 500 == 0)
    counted = {
        "orders_raw": rows("orders").agg((F.count("*") + twice).alias("n")),
        "delivery_ops_fact": rows("lineitem").agg(F.count("*").alias("n")),
        "restaurants_dim": rows("part").agg(F.count("*").alias("n")),
        "delivery_partners_dim": rows("supplier").agg((F.count("*") + 1).alias("n")),
    }
    return layers.append_batches(
        *(df.select(F.lit(t).alias("table_name"), F.col("n").alias("expected_rows")) for t, df in counted.items())
    )


@query
def a5_row_reconciliation(spark, d):
    tables = {
        "orders_raw": fx.orders_raw(spark, d),
        "delivery_ops_fact": fx.ops_raw(spark, d),
        "restaurants_dim": fx.restaurants(spark, d),
        "delivery_partners_dim": fx.partners(spark, d),
    }
    return layers.reconcile_row_counts(tables, _expected_rows(spark, d))


@query
def a6_csv_round_trip(spark, d):
    path = storage.new_path(spark, "orders-csv")
    files.write_csv(fx.orders_raw(spark, d), path)
    orders = staging.parse_orders(files.read_landing_csv(spark, "orders_raw", path))
    return orders.groupBy("restaurant_name").agg(
        F.count("*").alias("order_rows"),
        F.sum("total").cast("double").alias("total"),
        F.count("kpt_duration_minutes").alias("kpt_rows"),
        F.min("order_placed_at").alias("first_order"),
        F.count("review").alias("reviews"),
        F.max("review").alias("last_review"),
    )


@query
def a8_layer_tables(spark, d):
    house = layers.Warehouse(spark, storage.new_path(spark, "layers"))
    house.publish("raw", "delivery_ops_fact", fx.ops_raw(spark, d))
    house.publish("staging", "delivery_ops", staging.stage_ops(house.source("raw", "delivery_ops_fact")))
    return house.publish("marts", "order_partner", dlv.lowest_partner_row(house.source("staging", "delivery_ops")))


@query
def a9_named_source(spark, d):
    house = layers.Warehouse(spark, storage.new_path(spark, "named"))
    house.publish("staging", "orders", fx.orders(spark, d))
    return spark.sql(
        "SELECT order_status, count(*) AS orders, cast(sum(total) AS double) AS total "
        "FROM staging_orders GROUP BY order_status"
    )


@query
def a10_batch_append(spark, d):
    placed = F.col("order_placed_at")
    orders = fx.orders(spark, d).select("order_id", "order_placed_at", "total")
    recent = F.coalesce(F.year(placed) >= 1998, F.lit(False))  # undated orders come first
    first = orders.where(~recent)
    second = orders.where(recent).select("total", "order_id", "order_placed_at")
    both = layers.append_batches(first, second)
    return both.groupBy(month_label(placed).alias("order_month")).agg(
        F.count("*").alias("orders"), F.sum("total").cast("double").alias("total")
    )


def _committed(spark, label) -> commits.CommittedTable:
    return commits.CommittedTable(spark, storage.new_path(spark, label))


def _early_and_late(df: DataFrame) -> list[DataFrame]:
    """Two batches by year; undated orders come first."""
    recent = F.coalesce(F.year("order_placed_at") >= 1998, F.lit(False))
    return [df.where(~recent), df.where(recent)]


@query
def a4_batches_loaded_once(spark, d):
    """The first batch is tried again, the second stops half-way before it is loaded."""
    table = _committed(spark, "once")
    early, late = _early_and_late(fx.orders(spark, d).select("order_id", "order_placed_at", "order_status", "total"))
    table.append("early", early)
    table.append("early", early)
    late.where("order_id % 2 = 0").write.parquet(f"{table.root}/data/late-half")  # never committed
    table.append("late", late)
    loaded = table.read().groupBy("order_status").agg(
        F.count("*").alias("orders"), F.sum("total").cast("double").alias("total"))
    return loaded.unionAll(table.totals().select("name", "value", F.lit(None).cast("double")))


@query
def a1_malformed_rows_kept(spark, d):
    """Outlets as CSV; some lines lack a field, some have one too many."""
    path, table = storage.new_path(spark, "outlet-lines"), _committed(spark, "checked")
    quoted = """concat('"', restaurant_name, '","', subzone, '"')"""
    line = f"""concat(restaurant_id, ',', CASE WHEN restaurant_id % 50 = 3 THEN {quoted}
                 WHEN restaurant_id % 50 = 4 THEN concat({quoted}, ',metro city,"a, b"')
                 ELSE concat({quoted}, ',metro city') END)"""
    lines = fx.restaurants(spark, d).selectExpr(f"{line} AS `a,b,c,d`")
    # unquoted, with a separator that no line holds: each file has a header and the lines as they are
    lines.write.options(header=True, sep="\x01", quote="", escapeQuotes=False).csv(path)
    quarantine.load_checked(table, "all", "restaurants_dim", path)
    good = quarantine.good_rows(table, "restaurants_dim").select(
        "restaurant_id", F.concat_ws("|", "restaurant_name", "subzone", "city").alias("content"), F.lit(None).cast("string").alias("reason")
    )
    refused = quarantine.refused_rows(table).select(
        F.substring_index("record", ",", 1).alias("restaurant_id"), F.col("record").alias("content"), "reason"
    )
    counts = table.totals().select(F.lit(None).cast("string"), F.col("value").cast("string"), "name")
    return good.unionAll(refused).unionAll(counts)


@query
def a4_new_files_once(spark, d):
    """Two rounds of files and one without any, by the file stream."""
    files_at, target, memory = (storage.new_path(spark, x) for x in ("landed", "streamed", "memory"))
    outlets = fx.restaurants(spark, d)
    for part in (outlets.where("restaurant_id % 2 = 0"), outlets.where("restaurant_id % 2 <> 0"), None):
        if part is not None:
            part.write.mode("append").options(header=True, quote='"', escape='"').csv(files_at)
        quarantine.stream_checked_files(spark, "restaurants_dim", files_at, target, memory)
    streamed = quarantine.streamed_rows(spark, "restaurants_dim", target)
    return streamed.groupBy("restaurant_name", "rejected").agg(F.count("*").alias("outlets"))


@query
def a5_counts_from_load(spark, d):
    tables = {
        "orders_raw": fx.orders_raw(spark, d),
        "delivery_ops_fact": fx.ops_raw(spark, d),
        "restaurants_dim": fx.restaurants(spark, d),
        "delivery_partners_dim": fx.partners(spark, d),
    }
    loaded = {name: _committed(spark, name) for name in tables}
    for name, df in tables.items():
        loaded[name].append("all", df)
    return commits.reconcile_commits(loaded, _expected_rows(spark, d))


@query
def b12_defects_from_load(spark, d):
    """Two batches of landing orders, their defects counted while they are written."""
    table = _committed(spark, "defects")
    landed = _landed(spark, d)
    for k in (0, 1):
        part = landed.where(F.pmod(F.crc32("order_id"), F.lit(2)) == k)
        table.append(f"part-{k}", part, metrics=quality.value_defects())
    return quality.defects_from_commits(table)


# -- B: cleaning -------------------------------------------------------------------------


@query
def b1_order_dedup(spark, d):
    return _by_name(
        staging.dedup_orders(staging.parse_orders(_landed(spark, d))),
        "order_id", "order_placed_at", "kpt_duration_minutes", "customer_id",
    )


@query
def b2_staged_orders(spark, d):
    staged = _staged(spark, d)
    return staged.select(*(F.col(c).cast("double") if t.startswith("decimal") else F.col(c) for c, t in staged.dtypes))


@query
def b3_text_standardization(spark, d):
    orders = staging.parse_orders(_landed(spark, d, *staging.TIDIED))
    return orders.groupBy("restaurant_name", "subzone", "city").agg(F.count("*").alias("order_rows"))


@query
def b4_timestamp_parse(spark, d):
    return staging.parse_orders(_landed(spark, d, "order_id", "order_placed_at"))


@query
def b5_distance_parse(spark, d):
    return staging.parse_orders(_landed(spark, d, "order_id", "distance"))


@query
def b6_orphan_flag(spark, d):
    return _staged(spark, d).select("order_id", "restaurant_id", "is_restaurant_orphaned")


@query
def b7_b8_b9_value_flags(spark, d):
    return _by_name(
        _staged(spark, d),
        "order_id", "is_kpt_invalid", "is_rating_invalid", "is_kpt_missing", "is_rider_wait_missing",
    )


@query
def b10_ops_dedup(spark, d):
    return _staged_ops(spark, d)


@query
def b11_typed_cast(spark, d):
    ops = files.typed(files.normalize_nulls(fx.ops_raw(spark, d)), "delivery_ops_fact")
    return ops.groupBy("is_late").agg(
        F.count("*").alias("delivery_rows"),
        F.sum("promised_sla_minutes").alias("promised_minutes"),
        F.max("actual_fulfillment_minutes").alias("max_actual"),
    )


@query
def b12_quality_report(spark, d):
    outlets = files.typed(fx.restaurants(spark, d), "restaurants_dim")
    return quality.quality_report(_landed(spark, d), outlets, fx.ops(spark, d))


@query
def b13_bill_identity(spark, d):
    bill = ("bill_subtotal", "packaging_charges", *quality.DISCOUNTS, "total")
    return quality.bill_violations(staging.parse_orders(_landed(spark, d, *bill)))


@query
def b14_drop_unparseable(spark, d):
    kept = staging.drop_unparseable(staging.parse_orders(_landed(spark, d, "order_placed_at")))
    return kept.groupBy(month_label(F.col("order_placed_at")).alias("order_month")).agg(
        F.count("*").alias("order_rows")
    )


@query
def b15_response_rate(spark, d):
    return quality.response_rate(fx.orders(spark, d))


# -- C: preparation ----------------------------------------------------------------------


@query
def c1_dimension(spark, d):
    orders = fx.orders(spark, d, line=True, zone=True)
    outlets = orders.where(F.col("restaurant_id").isNotNull())
    return prep.extract_dimension(outlets, "restaurant_id", ["restaurant_name", "subzone"], "order_id")


@query
def c2_bottom_k_exclusion(spark, d):
    orders = fx.orders(spark, d, line=True).where(F.col("restaurant_name").isNotNull())
    brands = fx.table(spark, d, "part").select(F.lower("p_brand").alias("restaurant_name")).distinct()
    return prep.without_lowest_volume(brands, orders, "restaurant_name")


@query
def c4_median_imputation(spark, d):
    columns = ["kpt_duration_minutes", "rider_wait_time_minutes"]
    orders = fx.orders(spark, d, line=True).select("order_id", *columns)
    return prep.impute_median(orders, *columns)


@query
def c7_late_flag(spark, d):
    rows = _resolved(spark, d)
    late = prep.late_flag(F.col("actual_fulfillment_minutes"), F.col("promised_sla_minutes"))
    return rows.select("order_id", late.alias("is_late"))


@query
def c8_undelivered_mask(spark, d):
    status = fx.orders(spark, d).select("order_id", "order_status")
    masked = prep.only_if_delivered(F.col("was_reassigned"), F.col("order_status"))
    return _resolved(spark, d).join(status, "order_id").select("order_id", masked.alias("was_reassigned"))


@query
def c9_late_rate_by_flag(spark, d):
    listed = F.substring("partner_id", -2, 2).isin("00", "25", "50", "75")
    return prep.late_rate_by_flag(fx.ops(spark, d), listed)


@query
def c10_category_share(spark, d):
    return prep.category_share(fx.partners(spark, d), _resolved(spark, d), "partner_id")


@query
def c12_seeded_sample(spark, d):
    orders = fx.orders(spark, d).select("order_id", "customer_id", "order_status")
    return prep.seeded_sample(orders, "order_id", 40, "11")


@query
def c12_one_per_customer(spark, d):
    orders = fx.orders(spark, d).select("customer_id", "order_id", "order_status")
    return prep.one_per_group(orders, "customer_id", "order_id", "7")


@query
def c13_activity_span(spark, d):
    return prep.activity_span(fx.orders(spark, d))


@query
def c14_zero_filled_months(spark, d):
    complaints = fx.orders(spark, d, zone=True).where(F.col("customer_complaint_tag").isNotNull())
    return prep.zero_filled_months(complaints, "subzone")


@query
def c15_key_continuation(spark, d):
    batch = fx.table(spark, d, "events").select("event_id", "user_id", "event_type")
    order = [F.col("user_id").asc_nulls_last(), F.col("event_id").asc()]
    return prep.continue_keys(batch, order, fx.orders(spark, d), "order_id")


@query
def c16_persistence_rates(spark, d):
    return prep.persistence_rates(fx.orders(spark, d))


@query
def c17_average_cohort_size(spark, d):
    return prep.average_cohort_size(fx.orders(spark, d))


# -- D: delivery operations --------------------------------------------------------------


@query
def d1_partners_per_order(spark, d):
    return dlv.partners_per_order(staging.dedup_ops(fx.ops(spark, d)))


@query
def d2_lowest_partner_row(spark, d):
    return dlv.lowest_partner_row(fx.ops(spark, d))


@query
def d3_resolved_assignments(spark, d):
    return dlv.resolve_assignments(staging.dedup_ops(fx.ops(spark, d)))


@query
def d4_delivery_segments(spark, d):
    return _by_name(
        _segments(spark, d, line=True),
        "order_id", "order_status", "partner_id", "was_reassigned", "delivery_status", "distance_band",
    )


@query
def d4_segments_from_layers(spark, d):
    """Stored tables laid out by order: neither the grouping nor the join needs an exchange."""
    house = layers.Warehouse(spark, storage.new_path(spark, "laid-out"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = fx.orders(spark, d, line=True).select("order_id", "order_status", "distance_km")
    orders = house.publish_bucketed("raw", "orders", orders, ["order_id"], buckets)
    ops = house.publish_bucketed("raw", "delivery_ops", fx.ops(spark, d), ["order_id"], buckets)
    return _by_name(
        dlv.delivery_segments(orders, dlv.resolve_repeated(ops)),
        "order_id", "order_status", "partner_id", "was_reassigned", "delivery_status", "distance_band",
    )


@query
def d6_late_rates_by_grain(spark, d):
    grains = {
        "outlet": ("restaurant_id",),
        "brand outlet": ("restaurant_name", "restaurant_id"),
        "zone": ("subzone",),
        "partner": ("partner_id",),
        "zone and band": ("subzone", "distance_band"),
    }
    return dlv.late_rates_by_grain(_segments(spark, d, line=True, zone=True), grains)


@query
def d5_distance_bands(spark, d):
    orders = fx.orders(spark, d, line=True)
    band = dlv.distance_band(F.col("distance_km")).alias("distance_band")
    return orders.select("order_id", "distance_km", band)


@query
def d6_late_rate_by_restaurant(spark, d):
    return dlv.late_rate_by(_segments(spark, d, line=True), "restaurant_name")


@query
def d6b_late_rate_by_zone(spark, d):
    return dlv.late_rate_by(_segments(spark, d, zone=True), "subzone")


@query
def d6b_late_rate_by_partner(spark, d):
    return dlv.late_rate_by(_segments(spark, d), "partner_id")


@query
def d6c_brand_outlets(spark, d):
    return dlv.brand_outlet_rates(_segments(spark, d, line=True), volume_floor=5)


@query
def d7_counterfactual_partners(spark, d):
    segments = _segments(spark, d)
    tested = dlv.partner_outliers(segments)
    flagged = tested.where("late_rate_flag").select("partner_id")
    return dlv.counterfactual(segments, "partner_id", flagged, dlv.clean_baseline(tested))


@query
def d7_counterfactual_brands(spark, d):
    segments = _segments(spark, d, line=True)
    brands = fx.table(spark, d, "part").select(F.lower("p_brand").alias("restaurant_name")).distinct()
    worst = brands.where(F.col("restaurant_name").isin("brand#3", "brand#7"))
    return dlv.counterfactual(segments, "restaurant_name", worst)


@query
def d8_partner_outliers(spark, d):
    return _outliers(spark, d)


@query
def d9_clean_baseline_retest(spark, d):
    return dlv.retest_on_clean_baseline(_outliers(spark, d))


@query
def d10_zone_band_late_rate(spark, d):
    return dlv.late_rate_by(_segments(spark, d, line=True, zone=True), "subzone", "distance_band")


def _landed_segments(spark, d):
    return flows.segments_from_landing(fx.orders_raw(spark, d), fx.restaurants(spark, d), fx.ops_raw(spark, d))


@query
def d6_late_rate_from_landing(spark, d):
    return dlv.late_rate_by(_landed_segments(spark, d), "restaurant_id")


@query
def d10_zone_band_from_landing(spark, d):
    return dlv.late_rate_by(_landed_segments(spark, d), "subzone", "distance_band")


@query
def d11_possible_kitchen_minutes(spark, d):
    segments = _segments(spark, d, line=True, zone=True)
    return dlv.mean_minutes_by(
        segments, "kpt_duration_minutes", "avg_kpt_minutes", "subzone", "distance_band", exclude_invalid=True
    )


@query
def d11_kitchen_minutes(spark, d):
    segments = _segments(spark, d, line=True, zone=True)
    return dlv.mean_minutes_by(segments, "kpt_duration_minutes", "avg_kpt_minutes", "subzone", "distance_band")


@query
def d12_rider_wait_minutes(spark, d):
    segments = _segments(spark, d, line=True, zone=True)
    return dlv.mean_minutes_by(segments, "rider_wait_time_minutes", "avg_rider_wait_minutes", "subzone", "distance_band")


@query
def d13_partner_mix(spark, d):
    return dlv.partner_mix(_segments(spark, d, line=True, zone=True), _short_trip_in_zone())


@query
def d14_zone_band_gaps(spark, d):
    return dlv.zone_band_gaps(_segments(spark, d, line=True, zone=True))


@query
def d15_over_representation(spark, d):
    segments = _segments(spark, d, line=True, zone=True)
    return dlv.over_representation(segments, _short_trip_in_zone(), fx.partners(spark, d))


@query
def k1_rolling_7day_late_rate(spark, d):
    return kpi.rolling_daily_late_rate(_lateness(spark, d))


@query
def k1_rolling_calendar_days(spark, d):
    return kpi.rolling_daily_late_rate(_lateness(spark, d), calendar=True)


@query
def k2_rolling_3month_late_rate(spark, d):
    return kpi.rolling_monthly_late_rate(_lateness(spark, d))


@query
def k3_slice_monthly_late_rate(spark, d):
    return kpi.slice_monthly_late_rate(_lateness(spark, d, line=True, zone=True), _short_trip_in_zone())


@query
def k4_monthly_partner_outliers(spark, d):
    return kpi.monthly_partner_outliers(_lateness(spark, d, "inner"))


@query
def k4b_outlier_tally(spark, d):
    return kpi.outlier_tally(kpi.monthly_partner_outliers(_lateness(spark, d, "inner")))


@query
def k5_brand_late_rate(spark, d):
    return kpi.brand_monthly_late_rate(_lateness(spark, d, "inner", line=True))


@query
def k6_partner_concentration(spark, d):
    return kpi.partner_concentration(_lateness(spark, d, "inner", zone=True))


@query
def k6_concentration_known_partners(spark, d):
    rows = _lateness(spark, d, "inner", zone=True)
    return kpi.partner_concentration(rows, drop_null_partner=True)


@query
def k6b_dominance_tally(spark, d):
    return kpi.dominance_tally(kpi.partner_concentration(_lateness(spark, d, "inner", zone=True)))


def _kept_up(spark, d) -> upkeep.DailyCounts:
    """Two batches of orders; the second is counted wrongly first and then replaced."""
    counts = upkeep.DailyCounts(_committed(spark, "daily-counts"))
    resolved = _resolved(spark, d)
    early, late = _early_and_late(fx.orders(spark, d, zone=True))
    counts.add("early", early, resolved)
    counts.add("late", late.where("order_id % 3 = 0"), resolved)
    counts.add("late", late, resolved, replace=True)
    return counts


@query
def k1_from_kept_counts(spark, d):
    return _kept_up(spark, d).rolling_daily_late_rate()


@query
def k2_from_kept_counts(spark, d):
    return _kept_up(spark, d).rolling_monthly_late_rate()


@query
def k4_from_kept_counts(spark, d):
    return _kept_up(spark, d).monthly_partner_outliers()


@query
def k6_from_kept_counts(spark, d):
    return _kept_up(spark, d).partner_concentration()


@query
def e20_from_kept_counts(spark, d):
    return _kept_up(spark, d).complaint_rate()


# -- E: customers ------------------------------------------------------------------------


@query
def e1_cohorts(spark, d):
    return cust.cohorts(fx.orders(spark, d))


@query
def e2_cohort_sizes(spark, d):
    return cust.cohort_sizes(fx.orders(spark, d))


@query
def e3_retention_matrix(spark, d):
    return cust.retention_matrix(fx.orders(spark, d))


@query
def e3_retention_from_landing(spark, d):
    return flows.retention_from_landing(fx.orders_raw(spark, d, *flows.RETENTION_COLUMNS))


@query
def e4_snapshot_date(spark, d):
    return cust.snapshot_date(fx.orders(spark, d))


@query
def e5_rfm_base(spark, d):
    base = cust.rfm_base(fx.orders(spark, d))
    return base.withColumn("monetary_total", F.col("monetary_total").cast("double"))


@query
def e6_rfm_scores(spark, d):
    scores = cust.rfm_scores(cust.rfm_base(fx.orders(spark, d)))
    return scores.withColumn("monetary_total", F.col("monetary_total").cast("double"))


@query
def e7_rfm_segments(spark, d):
    return _rfm(spark, d).select("customer_id", "r_score", "f_score", "m_score", "rfm_segment")


@query
def e8_segment_summary(spark, d):
    return cust.segment_summary(_rfm(spark, d))


@query
def e9_segment_share_by_cohort(spark, d):
    return cust.segment_share_by_cohort(_rfm(spark, d))


@query
def e10_first_order_attribute(spark, d):
    return cust.first_order_attribute(fx.orders(spark, d))


@query
def e11_retention_by_first_order(spark, d):
    return cust.retention_by_first_order(fx.orders(spark, d))


@query
def e12_promo_share_sensitivity(spark, d):
    return cust.promo_share_sensitivity(fx.orders(spark, d))


@query
def e13_spend_concentration(spark, d):
    return cust.spend_concentration(fx.orders(spark, d))


@query
def e14_repeat_within_30d(spark, d):
    return growth.repeat_within(fx.orders(spark, d))


@query
def e15_month_one_retention(spark, d):
    return growth.month_one_retention(fx.orders(spark, d))


@query
def e16_one_time_revenue(spark, d):
    return growth.one_time_revenue(fx.orders(spark, d))


@query
def e17_promo_revenue_share(spark, d):
    return growth.promo_revenue_share(fx.orders(spark, d))


@query
def e17b_promo_band_check(spark, d):
    return growth.outside_band(growth.promo_revenue_share(fx.orders(spark, d)))


@query
def e18_champions_conversion(spark, d):
    return growth.champions_conversion(_rfm(spark, d))


@query
def e19_at_risk_mature_cohorts(spark, d):
    return growth.at_risk_in_mature_cohorts(_rfm(spark, d), cust.snapshot_date(fx.orders(spark, d)))


@query
def e20_complaint_rate(spark, d):
    return growth.complaint_rate(fx.orders(spark, d))


@query
def e21_maturity_days(spark, d):
    orders = fx.orders(spark, d)
    return growth.with_maturity(growth.repeat_within(orders), cust.snapshot_date(orders), days=30)


@query
def e21_maturity_months(spark, d):
    orders = fx.orders(spark, d)
    return growth.with_maturity(growth.one_time_revenue(orders), cust.snapshot_date(orders), months=2)


@query
def e22_order_frequency(spark, d):
    return cust.order_frequency(fx.orders(spark, d))


@query
def d9_outliers_from_landing(spark, d):
    return flows.outliers_from_landing(fx.orders_raw(spark, d, "order_id"), fx.ops_raw(spark, d))
