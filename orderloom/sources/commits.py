"""Stored tables whose batches are loaded once, with the counts taken while loading.

A batch is written to a folder of its own, and becomes part of the table when its record is renamed
into the commit list, which is one atomic step. A load that stops half-way leaves a folder that no record names, so
readers never see it; a load that is tried again finds the record and does nothing. Of two
loads of one batch that run at the same time, one rename wins.

Counts are observed on the rows as they are written, in the last stage, where Spark counts each
task once; so a report on a load reads the records and not the table.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECORD = "batch string, folder string, rows bigint, metrics map<string, bigint>"
_BATCH_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


class CommittedTable:
    """A table of committed batches under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- writing -------------------------------------------------------------------------

    def append(
        self,
        batch: str,
        df: DataFrame,
        *,
        metrics: dict[str, Column] | None = None,
        split_by: str | None = None,
        replace: bool = False,
    ) -> bool:
        """Load ``df`` as ``batch``; False if that batch is there already.

        ``metrics``: named aggregates kept in the record beside the number of rows. ``split_by``: a
        column whose values get folders of their own, so that reading one skips the others. ``replace``:
        the batch takes the place of an earlier one of its name; readers see either the old or the new.
        """
        if not _BATCH_NAME.fullmatch(batch):
            raise ValueError(f"no name for a batch: {batch!r}")
        if not replace and self._exists(self._record_path(batch)):
            return False
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        named = {"rows": F.count(F.lit(1)), **(metrics or {})}
        seen = Observation()
        writer = df.observe(seen, *(c.cast("bigint").alias(n) for n, c in named.items())).write
        (writer.partitionBy(split_by) if split_by else writer).parquet(f"{self.root}/{folder}")
        counts = {n: int(seen.get.get(n) or 0) for n in named}
        record = {"batch": batch, "folder": folder, "rows": counts.pop("rows"), "metrics": counts}
        return self._commit(batch, json.dumps(record), replace)

    def _commit(self, batch: str, text: str, replace: bool) -> bool:
        """Rename the record into the list: False if another load of the batch came first."""
        jvm, target = self.spark._jvm, self._path(self._record_path(batch))
        draft = self._path(f"{self.root}/commits/.{batch}-{uuid.uuid4().hex}")
        files = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, int(replace))
        if replace:
            options[0] = kinds.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            files.getUri(), self.spark._jsc.hadoopConfiguration()
        )
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(target), options)
        except Exception as refused:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(refused):
                return False
            raise
        return True

    # -- reading -------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        """One row per committed batch: batch, folder, rows, metrics."""
        if not self._exists(f"{self.root}/commits"):
            return self.spark.createDataFrame([], _RECORD)
        return self.spark.read.schema(_RECORD).json(f"{self.root}/commits")

    def read(self, part: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
        """The rows of all committed batches; ``part`` (as ``column=value``) those of one folder of a
        split table. ``schema`` is needed where nothing may be committed yet."""
        inner = f"/{part}" if part else ""
        paths = [f"{self.root}/{r.folder}{inner}" for r in self.commits().orderBy("batch").collect()]
        paths = [p for p in paths if not part or self._exists(p)]
        if not paths:
            if schema is None:
                raise AnalysisException(f"no batch of {self.root} is committed{' with ' + part if part else ''}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*paths)

    def totals(self) -> DataFrame:
        """name, value: rows and metrics summed over all batches, from the records alone."""
        named = F.map_concat(F.create_map(F.lit("rows"), F.col("rows")), F.coalesce("metrics", F.expr("map()")))
        each = self.commits().select(F.explode(named).alias("name", "value"))
        return each.groupBy("name").agg(F.sum("value").alias("value"))

    # -- files ---------------------------------------------------------------------------

    def _record_path(self, batch: str) -> str:
        return f"{self.root}/commits/{batch}.json"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, path: str) -> bool:
        at = self._path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)


def reconcile_commits(tables: dict[str, CommittedTable], expected: DataFrame) -> DataFrame:
    """Like ``layers.reconcile_row_counts``, from the records of the loads: no table is read."""
    counted = None
    for name, table in tables.items():
        rows = table.commits().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("actual_rows"))
        rows = rows.select(F.lit(name).alias("table_name"), "actual_rows")
        counted = rows if counted is None else counted.unionAll(rows)
    return expected.join(counted, "table_name", "left").select(
        "table_name",
        F.col("expected_rows").cast("bigint").alias("expected_rows"),
        "actual_rows",
        F.expr("actual_rows <=> expected_rows").alias("ok"),
    )
