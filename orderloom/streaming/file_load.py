"""Load new landing files exactly once.

A bulk load command remembers which files it has loaded and skips them the next time.
Here a file stream run until it has caught up does the same: its checkpoint is the memory.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from orderloom.sources.files import csv_options, normalize_nulls
from orderloom.sources.schemas import landing_schema


def load_new_files(
    spark: SparkSession,
    table: str,
    files: str,
    target: str,
    checkpoint: str,
    *,
    line_breaks: bool = True,
    on_error: str = "FAILFAST",
) -> None:
    """Append the rows of CSV files not loaded before to the Parquet table ``target``.

    A file with a malformed row stops the load (``csv_options``); it is read again next time.
    """
    stream = spark.readStream.options(**csv_options(line_breaks, on_error)).schema(landing_schema(table)).csv(files)
    query = (
        normalize_nulls(stream)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
