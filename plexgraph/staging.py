"""Tables that cut a lineage: written as Parquet in the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder set on the context.

    Only a local master may go without one; its own temporary folder is then used."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or getattr(spark, "_plexgraph_shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plexgraph-")
        spark._plexgraph_shared = folder
    return folder.rstrip("/")


def staged_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df written and read back: a lost executor then costs a reread, not a recomputation of what came before."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_dealt(df: DataFrame, label: str, key: str, tasks: int, codec: str = "zstd") -> DataFrame:
    """As stage, for a table that is joined by key again and again: rows lie in buckets of the key, so such a join moves its other side only."""
    spark = df.sparkSession
    path = staged_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    df.repartition(tasks, key).write.option("compression", codec).option("path", path).bucketBy(tasks, key).saveAsTable(name)
    return spark.table(name)


def drop_dealt(df: DataFrame) -> None:
    """Forget a table that stage_dealt made, and delete its files."""
    drop_staged(df)
    for path in {x.rsplit("/", 2)[1] for x in df.inputFiles()}:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {path.replace('-', '_')}")


def moved_by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join that never sends it whole through the driver.

    Spark takes a staged table's compressed files for its size, and would broadcast names or labels of millions of rows as a few MB."""
    return df.hint("merge")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more, by the store's own file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a table that stage made, once its readers are done."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        drop(df.sparkSession, path)
