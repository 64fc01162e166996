"""Paths in whatever store they name."""

from __future__ import annotations

from py4j.java_gateway import JavaObject
from pyspark.sql import SparkSession


def opened(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """(the path's file system, the path)."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def exists(spark: SparkSession, path: str) -> bool:
    fs, there = opened(spark, path)
    return fs.exists(there)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is not there."""
    fs, there = opened(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(there)) if fs.exists(there) else []


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, there = opened(spark, path)
        fs.delete(there, True)


def replace(spark: SparkSession, path: str, there: str) -> None:
    """Moves a folder to a place where another may lie, which goes."""
    fs, new = opened(spark, path)
    old = opened(spark, there)[1]
    fs.delete(old, True)
    fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        raise OSError(f"cannot move {path} to {there}")
