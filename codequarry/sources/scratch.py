"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATH_OF: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Without one there is no folder that all executors see, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("intermediate tables need a folder that the driver and all executors share: set spark.checkpoint.dir when the session is made")
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/codequarry/{label}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, path: str, *partitions: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as Parquet, or append it to what is there; its shuffle files go when the write has ended, as nothing else reads them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*partitions).mode(mode).parquet(path)
    finally:
        conf.set(key, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: lineage ends here, lost executors don't matter."""
    spark = df.sparkSession
    path = new_path(spark, label)
    write_once(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*staged: DataFrame) -> None:
    """Delete tables made by ``stage`` whose readers have all finished; others are left alone."""
    for df in staged:
        if (path := _PATH_OF.pop(df, None)) is not None:
            delete(df.sparkSession, path)
