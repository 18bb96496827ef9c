"""Tables between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(RuntimeError):
    """spark.checkpoint.dir is unset on a cluster."""


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="kinfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Tables:
    """Parquet tables of one run; ``drop`` deletes those that no later step reads.

    As a context it deletes all but those it was told to ``keep``, which lazy results still read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.live: dict[str, DataFrame] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the table, so that a lost executor costs no earlier step."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        self.live[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._scratch)
            self.live.pop(t._scratch, None)
