"""Text files as documents: one row for each whole file."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, folder: str, collection: str, glob: str = "*") -> DataFrame:
    """collection, file_name and content of the folder's files, of every extension by default, not of those below it."""
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return files.select(F.lit(collection).alias("collection"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


def route(spark: SparkSession, folder: str, names: list[str], to: str, clock=time.time) -> list[str]:
    """Move files of folder to another folder; one whose name is taken there gets the milliseconds before its name.  Returns the new paths."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(to))
    out = []
    for name in names:
        target = f"{to.rstrip('/')}/{name}"
        if fs.exists(path(target)):
            target = f"{to.rstrip('/')}/{int(clock() * 1000)}_{name}"
        if not fs.rename(path(f"{folder.rstrip('/')}/{name}"), path(target)):
            raise OSError(f"{name} can't be moved to {to}")
        out.append(target)
    return out


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """The files of a folder in order, not those below it or hidden ones; a listing that a driver holds by its nature."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(x.getPath().getName() for x in found if x.isFile() and not x.getPath().getName().startswith((".", "_")))
