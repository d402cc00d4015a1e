"""Delivery operations: assignment, lateness by dimension, outliers, confounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.rates import WIDE, count_where, exact_mean, pct
from orderloom.functions.scalars import with_group_stats, with_scalars

# Default thresholds and labels.
VOLUME_FLOOR = 30
OUTLIER_SDS = 2
BAND_EDGES_KM = (1, 3, 5)
LATE, ON_TIME, NOT_DELIVERABLE = "late", "on_time", "not_deliverable"


def partners_per_order(ops: DataFrame) -> DataFrame:
    """Distinct partners of each order; ``ops`` has one row per (order, partner)."""
    return ops.groupBy("order_id").agg(F.count("partner_id").alias("partners_assigned"))


def _lowest_partner(ops: DataFrame) -> Column:
    """Least row of an order: known partners first, by id, then by the other columns."""
    rest = [c for c in ops.columns if c not in ("order_id", "partner_id")]
    return F.min(F.struct(F.isnull("partner_id").alias("_unknown"), "partner_id", *rest))


def _unpack(resolved: DataFrame, ops: DataFrame, *extra) -> DataFrame:
    kept = [F.col(f"_kept.{c}").alias(c) for c in ops.columns if c != "order_id"]
    return resolved.select("order_id", *kept, *extra)


def lowest_partner_row(ops: DataFrame) -> DataFrame:
    """One row per order: that of the lowest partner id (no assignment time is recorded)."""
    return _unpack(ops.groupBy("order_id").agg(_lowest_partner(ops).alias("_kept")), ops)


def resolve_assignments(ops: DataFrame) -> DataFrame:
    """One row per order with the number of partners and whether it changed hands.

    ``ops`` has one row per (order, partner), so a plain count is the distinct count and
    one grouping replaces two groupings and a join.
    """
    resolved = ops.groupBy("order_id").agg(
        _lowest_partner(ops).alias("_kept"), F.count("partner_id").alias("partners_assigned")
    )
    return _unpack(
        resolved, ops, "partners_assigned", (F.col("partners_assigned") > 1).alias("was_reassigned")
    )


def resolve_repeated(ops: DataFrame) -> DataFrame:
    """Like ``resolve_assignments`` without the count, straight from rows with repeats.

    An order changed hands when its highest partner differs from the lowest, which is the
    one kept. Both are plain extremes, so repeats need no separate pass: one shuffle,
    combined before it.
    """
    resolved = ops.groupBy("order_id").agg(
        _lowest_partner(ops).alias("_kept"), F.max("partner_id").alias("_highest")
    )
    changed = F.coalesce(F.col("_highest") != F.col("_kept.partner_id"), F.lit(False))
    return _unpack(resolved, ops, changed.alias("was_reassigned"))


def distance_band(km: Column, edges=BAND_EDGES_KM) -> Column:
    """``Band_1`` up to the first edge, and so on; an unknown distance has no band."""
    band = F.when(km <= edges[0], "Band_1")
    for i, edge in enumerate(edges[1:], start=2):
        band = band.when(km <= edge, f"Band_{i}")
    return band.when(km > edges[-1], f"Band_{len(edges) + 1}")


def delivery_segments(orders: DataFrame, resolved: DataFrame, edges=BAND_EDGES_KM) -> DataFrame:
    """Orders with their partner, delivery status and distance band; no order is lost.

    A filter on ``delivery_status`` turns the left join into an inner one in the optimizer.
    """
    carried = resolved.select("order_id", "partner_id", "was_reassigned", "is_late")
    late = F.col("is_late")
    status = (
        F.when(late == 1, LATE).when(late == 0, ON_TIME).when(late.isNull(), NOT_DELIVERABLE)
    )
    joined = orders.join(carried, "order_id", "left").withColumn("delivery_status", status)
    if "distance_km" in orders.columns:
        joined = joined.withColumn("distance_band", distance_band(F.col("distance_km"), edges))
    return joined.drop("is_late")


def deliverable(segments: DataFrame) -> DataFrame:
    """Only the orders that reached a rider."""
    return segments.where(F.col("delivery_status") != NOT_DELIVERABLE)


def _is_late() -> Column:
    return F.col("delivery_status") == LATE


def late_rate_by(segments: DataFrame, *dims: str, volume_floor: int = VOLUME_FLOOR) -> DataFrame:
    """Late rate of deliverable orders per combination of ``dims``."""
    per = deliverable(segments).groupBy(*dims).agg(
        F.count("*").alias("deliverable_orders"), count_where(_is_late()).alias("_late")
    )
    return per.select(
        *dims,
        "deliverable_orders",
        pct(F.col("_late"), F.col("deliverable_orders")).alias("late_rate_pct"),
        (F.col("deliverable_orders") < volume_floor).alias("is_low_volume"),
    )


def late_rates_by_grain(
    segments: DataFrame, grains: dict[str, tuple[str, ...]], volume_floor: int = VOLUME_FLOOR
) -> DataFrame:
    """``late_rate_by`` for several sets of dimensions from one scan and one shuffle of partial counts.

    ``grains``: name -> columns. Rows are told apart by ``grain``; columns that a grain does not have are NULL.
    """
    dims = list(dict.fromkeys(c for columns in grains.values() for c in columns))
    rows = deliverable(segments).select(*dims, _is_late().alias("_is_late"))
    # spark numbers a grouping set by the columns it leaves out, the first one highest
    numbers = {
        name: sum(1 << (len(dims) - 1 - i) for i, c in enumerate(dims) if c not in columns)
        for name, columns in grains.items()
    }
    if len(set(numbers.values())) < len(grains):
        raise ValueError("two grains have the same columns")
    per = rows.groupingSets([[F.col(c) for c in columns] for columns in grains.values()], *dims).agg(
        F.grouping_id().alias("_number"),
        F.count("*").alias("deliverable_orders"),
        count_where(F.col("_is_late")).alias("_late"),
    )
    grain = F.element_at(F.create_map(*(F.lit(x) for name, n in numbers.items() for x in (n, name))), F.col("_number").cast("int"))
    return per.select(
        grain.alias("grain"),
        *dims,
        "deliverable_orders",
        pct(F.col("_late"), F.col("deliverable_orders")).alias("late_rate_pct"),
        (F.col("deliverable_orders") < volume_floor).alias("is_low_volume"),
    )


def brand_outlet_rates(segments: DataFrame, volume_floor: int = VOLUME_FLOOR) -> DataFrame:
    """Late rate of every outlet beside the lowest rate among its brand's outlets.

    A brand is late throughout when even its best outlet of sufficient volume is; that
    minimum is NULL for brands with low-volume outlets only.
    """
    outlets = late_rate_by(
        segments, "restaurant_name", "restaurant_id", volume_floor=volume_floor
    )
    best = outlets.groupBy("restaurant_name").agg(
        F.count("*").alias("brand_outlets"),
        F.min(F.when(~F.col("is_low_volume"), F.col("late_rate_pct"))).alias("brand_min_late_rate_pct"),
    )
    return with_group_stats(outlets, ["restaurant_name"], best)


def counterfactual(
    segments: DataFrame, key: str, targets: DataFrame, clean_rate: DataFrame | None = None
) -> DataFrame:
    """Platform late rate if the target keys performed at a clean rate.

    ``targets`` holds the distinct keys to fix in column ``key``. ``clean_rate`` is a one-row
    table with column ``clean_mean`` (a percentage with two decimals); without it the
    pooled rate of all other keys is used, which equals leaving the targets out.
    """
    per = deliverable(segments).groupBy(key).agg(
        F.count("*").alias("n"), count_where(_is_late()).alias("late")
    )
    marked = per.join(targets.select(F.col(key).alias("_target")), F.col(key) == F.col("_target"), "left")
    hit = F.col("_target").isNotNull()
    sums = marked.agg(
        F.sum("n").alias("deliverable_orders"),
        F.sum("late").alias("late_orders"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("target_orders"),
        F.coalesce(F.sum(F.when(hit, F.col("late"))), F.lit(0)).alias("target_late_orders"),
    )
    n, other_late = F.col("deliverable_orders"), F.col("late_orders") - F.col("target_late_orders")
    if clean_rate is None:
        hypothetical = pct(other_late, n - F.col("target_orders"))
    else:
        sums = with_scalars(sums, clean_rate.select("clean_mean"))
        hundredths = F.round(F.col("clean_mean") * 100).cast(WIDE)
        late_if_clean = other_late.cast(WIDE) * 10000 + F.col("target_orders").cast(WIDE) * hundredths
        hypothetical = pct(late_if_clean, n.cast(WIDE) * 10000)
    rated = sums.withColumn("actual_rate_pct", pct(F.col("late_orders"), n)).withColumn(
        "hypothetical_rate_pct", hypothetical
    )
    return rated.select(
        "deliverable_orders",
        "late_orders",
        "target_orders",
        "target_late_orders",
        "actual_rate_pct",
        "hypothetical_rate_pct",
        F.round(F.col("actual_rate_pct") - F.col("hypothetical_rate_pct"), 2).alias("improvement_pp"),
    )


def partner_outliers(
    segments: DataFrame, sds: float = OUTLIER_SDS, volume_floor: int = VOLUME_FLOOR
) -> DataFrame:
    """Partners whose late rate exceeds mean + ``sds`` standard deviations over all partners.

    Rates, mean and deviation are rounded before they are compared.
    """
    per = late_rate_by(segments, "partner_id", volume_floor=volume_floor)
    per = per.withColumnRenamed("deliverable_orders", "delivery_count")
    stats = per.agg(
        exact_mean(F.col("late_rate_pct")).alias("late_rate_mean"),
        F.round(F.stddev("late_rate_pct"), 2).alias("late_rate_stddev"),
    )
    limit = F.col("late_rate_mean") + sds * F.col("late_rate_stddev")
    return with_scalars(per, stats).withColumn("late_rate_flag", F.col("late_rate_pct") > limit)


def retest_on_clean_baseline(outliers: DataFrame, sds: float = OUTLIER_SDS) -> DataFrame:
    """Re-flag every partner against the mean and deviation of the unflagged ones."""
    clean = clean_baseline(outliers)
    limit = F.col("clean_mean") + sds * F.col("clean_stddev")
    return with_scalars(outliers, clean).withColumn(
        "flagged_on_clean_baseline", F.col("late_rate_pct") > limit
    )


def clean_baseline(outliers: DataFrame) -> DataFrame:
    """One row: mean and deviation of the rates of unflagged partners."""
    return outliers.where(~F.col("late_rate_flag")).agg(
        exact_mean(F.col("late_rate_pct")).alias("clean_mean"),
        F.round(F.stddev("late_rate_pct"), 2).alias("clean_stddev"),
    )


def mean_minutes_by(
    segments: DataFrame,
    minutes: str,
    out_col: str,
    *dims: str,
    exclude_invalid: bool = False,
    volume_floor: int = VOLUME_FLOOR,
) -> DataFrame:
    """Mean of a duration column over deliverable orders.

    Impossible (negative) values are part of the mean unless ``exclude_invalid``.
    """
    value = F.col(minutes)
    if exclude_invalid:
        value = F.when(value >= 0, value)
    return (
        deliverable(segments)
        .groupBy(*dims)
        .agg(F.count("*").alias("order_count"), exact_mean(value).alias(out_col))
        .withColumn("is_low_volume", F.col("order_count") < volume_floor)
    )


def partner_mix(segments: DataFrame, within: Column) -> DataFrame:
    """Orders and share of each partner inside a slice of the deliverable orders."""
    per = deliverable(segments).where(within).groupBy("partner_id").agg(F.count("*").alias("order_count"))
    whole = per.agg(F.sum("order_count").alias("_slice"))
    return with_scalars(per, whole).select(
        "partner_id", "order_count", pct(F.col("order_count"), F.col("_slice")).alias("pct_of_slice")
    )


def zone_band_gaps(segments: DataFrame) -> DataFrame:
    """Each zone's late rate in a band beside its peers and beside its own other bands.

    Peers are the other zones in the same band (lowest and highest rate). Own other bands
    are pooled over their orders. Gaps are in percentage points; NULL without a
    counterpart. Extremes without the zone itself come from the extreme zone and the
    runner-up, so no zone meets every other zone.
    """
    per = (
        deliverable(segments)
        .groupBy("subzone", "distance_band")
        .agg(F.count("*").alias("deliverable_orders"), count_where(_is_late()).alias("late_orders"))
        .withColumn("late_rate_pct", pct(F.col("late_orders"), F.col("deliverable_orders")))
    )
    rate, zone = F.col("late_rate_pct"), F.col("subzone")
    ends = per.groupBy("distance_band").agg(
        F.min(F.struct("late_rate_pct", "subzone")).alias("_lo"),
        F.max(F.struct("late_rate_pct", "subzone")).alias("_hi"),
    )
    placed = with_group_stats(per, ["distance_band"], ends)
    at_lo, at_hi = zone.eqNullSafe(F.col("_lo.subzone")), zone.eqNullSafe(F.col("_hi.subzone"))
    runners_up = placed.groupBy("distance_band").agg(
        F.min(F.when(~at_lo, rate)).alias("_lo2"), F.max(F.when(~at_hi, rate)).alias("_hi2")
    )
    own = per.groupBy("subzone").agg(
        F.sum("deliverable_orders").alias("_zone_n"), F.sum("late_orders").alias("_zone_late")
    )
    full = with_group_stats(
        with_group_stats(placed, ["distance_band"], runners_up), ["subzone"], own
    )
    peer_min = F.when(at_lo, F.col("_lo2")).otherwise(F.col("_lo.late_rate_pct"))
    peer_max = F.when(at_hi, F.col("_hi2")).otherwise(F.col("_hi.late_rate_pct"))
    other_bands = pct(
        F.col("_zone_late") - F.col("late_orders"), F.col("_zone_n") - F.col("deliverable_orders")
    )
    return full.select(
        "subzone",
        "distance_band",
        "deliverable_orders",
        "late_rate_pct",
        peer_min.alias("peer_min_pct"),
        peer_max.alias("peer_max_pct"),
        F.round(rate - peer_max, 2).alias("gap_to_peer_max_pp"),
        other_bands.alias("own_other_bands_pct"),
        F.round(rate - other_bands, 2).alias("gap_to_own_other_bands_pp"),
    )


def over_representation(segments: DataFrame, within: Column, partners: DataFrame) -> DataFrame:
    """Share of each listed partner inside a slice against its share of all orders.

    ``partners`` holds distinct ids; those without orders are kept with zero.
    """
    orders = deliverable(segments)
    inside = F.coalesce(within, F.lit(False))
    per = orders.groupBy("partner_id").agg(
        count_where(inside).alias("slice_orders"), F.count("*").alias("all_orders")
    )
    whole = per.agg(
        F.sum("slice_orders").alias("_slice"), F.sum("all_orders").alias("_all")
    )
    listed = partners.select("partner_id").join(per, "partner_id", "left").na.fill(0)
    share = with_scalars(listed, whole).withColumns(
        {
            "slice_share_pct": pct(F.col("slice_orders"), F.col("_slice")),
            "overall_share_pct": pct(F.col("all_orders"), F.col("_all")),
        }
    )
    over = F.col("slice_share_pct") > F.col("overall_share_pct")
    return share.drop("_slice", "_all").withColumn("is_over_represented", over)
