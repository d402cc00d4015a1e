"""Loads that keep malformed rows beside the good ones, with file and reason.

One read gives both: a row whose number of fields is not that of the table goes to the error side with its
text, and the load goes on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.rates import count_where
from orderloom.sources.commits import CommittedTable
from orderloom.sources.files import csv_options, normalize_nulls
from orderloom.sources.schemas import landing_schema

RECORD, FILE, REASON, REJECTED = "record", "file", "reason", "rejected"
# Reasons of a refusal.
TOO_FEW, TOO_MANY = "too few fields", "too many fields"


def _fields(record: Column) -> Column:
    """Number of fields of a CSV record; separators inside quotes do not count."""
    bare = F.regexp_replace(record, '"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _checked(raw: DataFrame, table: str) -> DataFrame:
    """Landing columns, then record, file, reason and rejected; the last four say why a row is refused."""
    names = landing_schema(table).names
    bad = F.col(RECORD).isNotNull()
    reason = F.when(bad, F.when(_fields(F.col(RECORD)) < len(names), TOO_FEW).otherwise(TOO_MANY))
    marked = raw.select(
        *names, RECORD, F.when(bad, F.col("_metadata.file_name")).alias(FILE), reason.alias(REASON), bad.alias(REJECTED)
    )
    clean = normalize_nulls(marked.select(*names, F.struct(RECORD, FILE, REASON, REJECTED).alias("_check")))
    return clean.select(*names, "_check.*")


def _with_record(table: str) -> T.StructType:
    return T.StructType([*landing_schema(table).fields, T.StructField(RECORD, T.StringType())])


def _options(line_breaks: bool) -> dict:
    return csv_options(line_breaks, "PERMISSIVE") | {"columnNameOfCorruptRecord": RECORD}


def read_checked_csv(spark: SparkSession, table: str, path: str, *, line_breaks: bool = True) -> DataFrame:
    """All rows of CSV files, good and refused ones (see ``_checked``)."""
    raw = spark.read.options(**_options(line_breaks)).schema(_with_record(table)).csv(path)
    return _checked(raw, table)


def load_checked(
    target: CommittedTable, batch: str, table: str, path: str, *, line_breaks: bool = True
) -> bool:
    """Load CSV files as one batch, once. Good and refused rows come from one read and are counted by it
    (metrics ``good_rows``, ``too_few_fields``, ``too_many_fields``); ``good_rows`` and ``refused_rows`` read them."""
    rows = read_checked_csv(target.spark, table, path, line_breaks=line_breaks)
    metrics = {
        "good_rows": count_where(~F.col(REJECTED)),
        "too_few_fields": count_where(F.col(REASON) == TOO_FEW),
        "too_many_fields": count_where(F.col(REASON) == TOO_MANY),
    }
    return target.append(batch, rows, metrics=metrics, split_by=REJECTED)


def good_rows(target: CommittedTable, table: str) -> DataFrame:
    """The landing rows of all batches; folders of refused rows are not opened."""
    return target.read(f"{REJECTED}=false", landing_schema(table))


def refused_rows(target: CommittedTable) -> DataFrame:
    """record, file, reason of every refused row."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (RECORD, FILE, REASON)])
    return target.read(f"{REJECTED}=true", schema)


def stream_checked_files(
    spark: SparkSession, table: str, files: str, target: str, checkpoint: str, *, line_breaks: bool = True
) -> None:
    """Append the files not loaded before, good and refused rows, to ``target`` (split by ``rejected``).

    The stream's checkpoint remembers the files and its sink lists what is committed.
    """
    raw = spark.readStream.options(**_options(line_breaks)).schema(_with_record(table)).csv(files)
    query = (
        _checked(raw, table)
        .writeStream.format("parquet")
        .partitionBy(REJECTED)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def streamed_rows(spark: SparkSession, table: str, target: str) -> DataFrame:
    """Landing columns, record, file, reason and rejected of what ``stream_checked_files`` has committed."""
    texts = [T.StructField(c, T.StringType()) for c in (RECORD, FILE, REASON)]
    flag = T.StructField(REJECTED, T.BooleanType())
    schema = T.StructType([*landing_schema(table).fields, *texts, flag])
    return spark.read.schema(schema).parquet(target)
