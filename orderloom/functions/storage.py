"""Tables written to the folder all executors share, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


@cache
def _local_folder() -> str:
    """A folder of this machine, for local masters; the session's settings stay as they are."""
    return tempfile.mkdtemp(prefix="orderloom-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared scratch folder, as the session names it.

    Only a local master, which has no other machines, may fall back to a folder of
    this machine.
    """
    context = spark.sparkContext
    root = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that every executor can reach")
        root = _local_folder()
    return root.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark)}/orderloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet and return a scan of the written files.

    Later uses read files instead of recomputing the plan, keep column pruning, and
    do not depend on any executor that took part in the write. The files live as long as results
    are read from them: ``path`` puts them into a folder of the caller's, ``release`` ends all others.
    """
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete everything this library has written to the shared folder for this application; others keep
    theirs. Results that were not computed to their end by then cannot be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
