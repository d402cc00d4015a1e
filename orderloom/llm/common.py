"""What several text operators share: names, normalisation, tables of checked size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.storage import freeze

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: A table is broadcast only when it was written, counted, and holds at most so many rows and so many bytes as
#: Parquet.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    """The text as a string, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def without_space(column: Column) -> Column:
    return F.translate(column, SPACE, "")


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of a row's id and text: rows with one key are interchangeable."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text_of(text_col))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidied(run):
    """``run`` over batches; at its end the worker gives memory that it holds but does not use back to the machine.

    Workers are used again by later stages, and what one stage has held at its peak would stay with them.
    """

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def tidied_group(run):
    """``run`` over one group, at the end of which the worker does as in ``tidied``."""

    def wrapped(group):
        out = run(group)
        give_back()
        return out

    return wrapped


def give_back() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        return


def buckets_for(spark: SparkSession, amount: int, each: int) -> int:
    """So many buckets that one holds about ``each`` of ``amount``, but not fewer than the session's width."""
    return max(width(spark), math.ceil(amount / each))


def checked(df: DataFrame, label: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written once and counted: broadcast when small, else left to a shuffled join.

    The written table also cuts the lineage, so nothing is computed again for the join.
    """
    written = freeze(df, label)
    size = int(str(written._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    small = size <= BROADCAST_BYTES and written.count() <= most
    return F.broadcast(written) if small else written
