"""Named layers of tables: raw, staging, intermediate, marts."""

from __future__ import annotations

from functools import reduce
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Layer names and how a layer is kept (views are recomputed, tables stored).
LAYERS = {"raw": "table", "staging": "view", "intermediate": "view", "marts": "table"}

DESCRIPTIONS = {
    "orders_raw": "One row per order, repeated rows included, all columns as text",
    "restaurants_dim": "One row per outlet; some outlets of the orders may be missing",
    "delivery_partners_dim": "One row per delivery partner",
    "delivery_ops_fact": "One row per order and partner, repeated rows included",
}


class Warehouse:
    """Tables under one root folder, addressed as (layer, name)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._views: dict[tuple[str, str], DataFrame] = {}

    def path(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise KeyError(f"unknown layer {layer!r}; one of {sorted(LAYERS)}")
        return f"{self.root}/{layer}/{name}"

    def append(self, layer: str, name: str, df: DataFrame) -> None:
        """Bulk append of a batch to a stored table."""
        df.write.mode("append").parquet(self.path(layer, name))

    def publish(self, layer: str, name: str, df: DataFrame) -> DataFrame:
        """Keep ``df`` the way its layer is kept, under the view name ``layer_name``."""
        path = self.path(layer, name)
        if LAYERS[layer] == "table":
            df.write.mode("overwrite").parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
        self._views[layer, name] = df
        df.createOrReplaceTempView(f"{layer}_{name}")
        return df

    def publish_bucketed(self, layer: str, name: str, df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
        """Keep ``df`` as a stored table laid out by ``keys``, with as many buckets as its partners in joins.

        Joins and groupings by the keys between tables of equal layout need no exchange: every row of a
        key lies in the bucket that the other table has it in, sorted. The rows are dealt to buckets
        before the write, so a bucket is one file. The layout is kept by the session's catalog.
        """
        if LAYERS[layer] != "table":
            raise ValueError(f"layer {layer!r} keeps no tables")
        path = self.path(layer, name)
        table = f"{layer}_{name}_{sha1(path.encode()).hexdigest()[:12]}"
        (
            df.repartition(buckets, *keys)
            .write.mode("overwrite")
            .option("path", path)
            .bucketBy(buckets, *keys)
            .sortBy(*keys)
            .saveAsTable(table)
        )
        self._views[layer, name] = stored = self.spark.table(table)
        stored.createOrReplaceTempView(f"{layer}_{name}")
        return stored

    def source(self, layer: str, name: str) -> DataFrame:
        if (layer, name) in self._views:
            return self._views[layer, name]
        return self.spark.read.parquet(self.path(layer, name))

    def describe(self) -> DataFrame:
        rows = [(name, text) for name, text in DESCRIPTIONS.items()]
        return self.spark.createDataFrame(rows, "name string, description string")


def append_batches(*batches: DataFrame) -> DataFrame:
    """All rows of all batches, repeated rows kept, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), batches)


def reconcile_row_counts(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Actual against expected rows: ``(table_name, expected_rows, actual_rows, ok)``."""
    counted = append_batches(
        *(
            df.agg(F.count("*").alias("actual_rows")).select(
                F.lit(name).alias("table_name"), "actual_rows"
            )
            for name, df in tables.items()
        )
    )
    return expected.join(counted, "table_name", "left").select(
        "table_name",
        F.col("expected_rows").cast("bigint").alias("expected_rows"),
        "actual_rows",
        F.expr("actual_rows <=> expected_rows").alias("ok"),
    )
