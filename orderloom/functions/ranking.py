"""Exact global ranks, tiles and running totals over tables of any size.

A window without PARTITION BY sorts the whole table in one task. Here the rows are
range-partitioned on the full ordering instead, sorted inside each slice, and
written once together with their slot number (slice and position). A row's rank is its
position plus the size of all earlier slices, which is a table with one row per slice.

The ordering must be total (end it with a unique key): then a value that many rows
share is spread over several slices, and the result does not depend on chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.functions.scalars import with_group_stats
from orderloom.functions.storage import freeze

_SLOT, _SLICE = "_slot", "_slice"
_POSITION_BITS = 33


def _slices(df: DataFrame, order_by: list[Column], label: str) -> DataFrame:
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(width, *order_by)
        .sortWithinPartitions(*order_by)
        .withColumn(_SLOT, F.monotonically_increasing_id())
    )
    return freeze(placed, label).withColumn(_SLICE, F.shiftright(_SLOT, _POSITION_BITS))


def _slice_offsets(slices: DataFrame, weight: Column) -> DataFrame:
    """Weight before each slice and in total: one row per slice, so a small table."""
    earlier = Window.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(_SLICE).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    sums = slices.groupBy(_SLICE).agg(weight.alias("_w"))
    return sums.select(
        _SLICE,
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_w").over(everything).alias("_total"),
    )


def with_rank(
    df: DataFrame, order_by: list[Column], rank_col: str, total_col: str | None = None
) -> DataFrame:
    """Add the exact 1-based position of each row in ``order_by`` (a total order).

    Runs a job: the ordered slices are written to the shared folder.
    """
    slices = _slices(df, order_by, "rank")
    offsets = _slice_offsets(slices, F.count("*"))
    position = F.col(_SLOT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    ranked = slices.join(F.broadcast(offsets), _SLICE)  # at most one row per shuffle partition
    extra = [F.col("_total").alias(total_col)] if total_col else []
    return ranked.select(
        *df.columns, (F.col("_offset") + position + 1).cast("bigint").alias(rank_col), *extra
    )


def tile_of_rank(rank: Column, total: Column, tiles: int) -> Column:
    """NTILE number of a row from its rank: the first ``total % tiles`` tiles get one row more."""
    size = F.floor(total / tiles)
    longer = total - size * tiles
    in_longer = F.ceil(rank / (size + 1))
    in_rest = longer + F.ceil((rank - longer * (size + 1)) / F.nullif(size, F.lit(0)))
    return F.when(rank <= longer * (size + 1), in_longer).otherwise(in_rest).cast("bigint")


def with_tile(df: DataFrame, order_by: list[Column], tiles: int, tile_col: str) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY order_by)`` without gathering the table in one task."""
    ranked = with_rank(df, order_by, "_rank", "_rows")
    tile = tile_of_rank(F.col("_rank"), F.col("_rows"), tiles)
    return ranked.select(*df.columns, tile.alias(tile_col))


def with_running_total(
    df: DataFrame, order_by: list[Column], weight: str, before_col: str, total_col: str
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows, and over all rows.

    The inner window runs per slice, and slices are balanced because the order is total.
    """
    slices = _slices(df, order_by, "running")
    offsets = _slice_offsets(slices, F.sum(weight))
    earlier = (
        Window.partitionBy(_SLICE).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    summed = slices.withColumn("_inside", inside).join(F.broadcast(offsets), _SLICE)
    return summed.select(
        *df.columns,
        (F.col("_offset") + F.col("_inside")).alias(before_col),
        F.col("_total").alias(total_col),
    )


def exact_medians(df: DataFrame, *columns: str) -> DataFrame:
    """One-row table with the exact median of the non-NULL values of each numeric column.

    One pass over ``df`` counts every distinct value, so a value that fills a third of the
    table becomes one row; the rest works on those counts. Runs a job.
    """
    doubles = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    counts = (
        doubles.unpivot([], list(columns), "name", "value")
        .where(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count("*").alias("_n"))
    )
    order = [F.col("name").asc(), F.col("value").asc()]
    placed = with_running_total(counts, order, "_n", "_before", "_everything")
    bounds = placed.groupBy("name").agg(F.min("_before").alias("_start"), F.sum("_n").alias("_all"))
    before = F.col("_before") - F.col("_start")
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1

    def at(column: str, rank: Column) -> Column:
        hit = (F.col("name") == column) & (before < rank) & (rank <= before + F.col("_n"))
        return F.max(F.when(hit, F.col("value")))

    return with_group_stats(placed, ["name"], bounds).agg(
        *(((at(c, lower) + at(c, upper)) / 2).alias(c) for c in columns)
    )
