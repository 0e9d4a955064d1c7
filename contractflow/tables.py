"""Versioned small tables on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _path(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    fs, target = _path(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(target)] if fs.exists(target) else []


def read_version(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (older than ``before``), or None.

    The folder is listed once, and only versions newer than the one found are looked into.
    """
    names = names_in(spark, path)
    written = sorted((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), reverse=True)
    for version in written:
        if (before is None or version < before) and exists(spark, f"{path}/version={version}/_SUCCESS"):
            return spark.read.schema(schema).parquet(f"{path}/version={version}")
    return None


def write_version(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
