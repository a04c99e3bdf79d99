"""Folders on whatever file system Spark is configured for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, sorted; none when it does not exist."""
    fs, target = _at(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def chat_folder(spark: SparkSession, root: str) -> str:
    """The folder to import from: the cleaned one where there is one."""
    cleaned = f"{root}/csv_clean"
    return cleaned if exists(spark, cleaned) else f"{root}/csv"
