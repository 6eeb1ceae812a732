"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only a session on one machine (tests) may have none; it gets a temporary folder. On a cluster a
    folder that isn't shared would lose tables, so there its absence is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hertzlake-"))
    return context.getCheckpointDir().get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """The tables of one operator. What its result doesn't read can be cleared once the result's tables are written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """df, written to the shared folder and read again, so that a lost executor costs no earlier work."""
        path = shared_path(self.spark, name)
        df.write.option("compression", codec).parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((table, path))
        return table

    def clear(self, *keep: DataFrame) -> None:
        """Delete all tables but those to keep, given as stored() returned them."""
        kept = [x for x in self.tables if any(x[0] is table for table in keep)]
        for table, path in self.tables:
            if not any(table is x[0] for x in kept):
                remove(self.spark, path)
        self.tables = kept


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """A table of its own that stays."""
    return Scratch(df.sparkSession).stored(df, name, codec)
