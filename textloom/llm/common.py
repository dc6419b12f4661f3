"""Shared helpers: scratch tables in the folder that driver and executors share, and keyed look-ups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a session on this machine alone
    (as in tests) gets one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written between the steps of an operator, so that lost executors cost one step and lineage stays short.

    `keep` writes a frame and reads it back; `drop` deletes all that was kept but the frames named. An operator whose
    result is evaluated later leaves its tables to the caller, who deletes them by `clear` when the result is written.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        Scratch.made.append(self)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self._held = [*getattr(self, "_held", []), out]
        return out

    def drop(self, *but: DataFrame) -> None:
        saved = {id(x) for x in but}
        for key, path in list(self.paths.items()):
            if key not in saved:
                delete(self.spark, path)
                del self.paths[key]


def clear(since: int = 0) -> None:
    """Deletes the tables of all scratch folders made in this process after the first `since`."""
    for scratch in Scratch.made[since:]:
        delete(scratch.spark, scratch.root)
    del Scratch.made[since:]


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2
