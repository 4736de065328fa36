"""Names of files and folders in any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place) and system.getFileStatus(place).isDirectory()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if there is no such folder."""
    system, place = _at(spark, path)
    return [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and all below it."""
    system, place = _at(spark, path)
    system.delete(place, True)
