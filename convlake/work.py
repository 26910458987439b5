"""Work tables in the folder that driver and executors share, and paths of any of Spark's file systems."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, or under the warehouse where that isn't set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/convlake-work/{uuid.uuid4().hex}"


def staged(df: DataFrame, path: str) -> DataFrame:
    """``df`` written once and read back, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """The file system of ``path`` and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names right below ``path``; none if it isn't there."""
    fs, where = hadoop(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop(spark, path)
    return fs.exists(where)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what nothing reads any more."""
    fs, where = hadoop(spark, path)
    fs.delete(where, True)
