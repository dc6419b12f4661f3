"""Cutting the lineage of tables that loops build up, and dealing out small ones."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share. A session on this machine alone gets
    one where none is set; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A table that Spark reads in fewer pieces than there are cores, dealt out to all of them; others as they are. Such a
    table is small for its session (a piece is 128 MB at most), and a file's pieces can be fewer than they look, as a row
    group is read by one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read from there, so that plans of later rounds stay short and lost
    executors cost one round. It is worked out once; `clear` deletes what was written."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    MADE.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that were cut in this process; to be called when the results made of them are written."""
    for path in MADE:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    MADE.clear()
