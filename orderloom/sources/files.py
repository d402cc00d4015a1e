"""CSV files in and out, null tokens and typed casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.parsing import NULL_TOKENS, null_if_token
from orderloom.sources.schemas import LANDING, landing_schema

CSV_OPTIONS = {
    "header": True,
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "enforceSchema": True,  # columns bind by position, whatever the header says
    "columnPruning": False,  # every row is checked whole, whichever columns are read
}


def csv_options(line_breaks: bool = True, on_error: str = "FAILFAST") -> dict:
    """Options of every CSV read.

    ``line_breaks``: quoted fields may hold line breaks; a file is then read by one task, so data
    should land in many files. ``on_error``: FAILFAST stops at a row with the wrong number of
    columns, PERMISSIVE pads or cuts it, DROPMALFORMED leaves it out.
    """
    return CSV_OPTIONS | {"multiLine": line_breaks, "mode": on_error}


def read_landing_csv(
    spark: SparkSession, table: str, path: str, *, line_breaks: bool = True, on_error: str = "FAILFAST"
) -> DataFrame:
    """A landing table from CSV: header skipped, columns by position, all strings."""
    raw = spark.read.options(**csv_options(line_breaks, on_error)).schema(landing_schema(table)).csv(path)
    return normalize_nulls(raw)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Files with a header line; each executor writes its own part."""
    df.write.mode(mode).options(header=True, quote='"', escape='"', emptyValue="").csv(path)


def normalize_nulls(df: DataFrame, tokens=NULL_TOKENS) -> DataFrame:
    """Replace the tokens that stand for a missing value in every string column."""
    return df.select(
        *(
            null_if_token(F.col(name), tokens).alias(name) if kind == "string" else F.col(name)
            for name, kind in df.dtypes
        )
    )


def cast_text(text: Column, kind: str) -> Column:
    """Typed value or NULL. Whole numbers may be spelled ``1`` or ``1.0``; a fraction is no whole
    number and gives NULL.

    A cast that fails is far slower than one that succeeds, so the spelling decides
    which cast is tried.
    """
    if kind == "string":
        return text
    if kind in ("int", "bigint"):
        number = text.try_cast("decimal(38,9)")
        whole = F.when(number == F.floor(number), number).try_cast(kind)
        return F.when(text.contains("."), whole).otherwise(text.try_cast(kind))
    return text.try_cast(kind)


def typed(df: DataFrame, table: str) -> DataFrame:
    """The landing columns of ``table`` in their declared types."""
    kinds = LANDING[table]
    return df.select(*(cast_text(F.col(c), kinds[c]).alias(c) for c in df.columns))
