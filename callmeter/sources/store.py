"""Folders of a store, through the file system that Spark finds for a path."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where it is missing."""
    fs, own = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(own)) if fs.exists(own) else []


def sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Name and bytes of the files in a folder that are not hidden, by name."""
    fs, own = _at(spark, path)
    return sorted((x.getPath().getName(), x.getLen()) for x in fs.listStatus(own) if x.getPath().getName()[0] not in "_.")


def mark(spark: SparkSession, path: str) -> None:
    """Creates an empty file."""
    fs, own = _at(spark, path)
    fs.create(own, False).close()


def remove(spark: SparkSession, path: str) -> None:
    fs, own = _at(spark, path)
    fs.delete(own, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Gives a folder another name; one that is missing is made there, empty."""
    fs, own = _at(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(new.getParent() if fs.exists(own) else new)
    if fs.exists(own) and not fs.rename(own, new):
        raise OSError(f"{path} cannot be renamed to {to}")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="callmeter-")
