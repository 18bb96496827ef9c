"""Tables that are written between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession

from kinfold.shared import Tables, folder  # noqa: F401

#: Rows and bytes of an Arrow batch of texts; Spark's default of 10,000 rows alone can be gigabytes.
BATCH_ROWS, BATCH_BYTES = 1_000, 8_000_000


def bounded(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, unless it has set smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


class Scratch(Tables):
    """Parquet tables of one run of an operator; ``drop`` deletes those that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, name)
        bounded(spark)

    def sweep(self) -> None:
        """Frees the shuffle files of finished steps: Spark's cleaner does so once the driver has
        collected the objects that stand for them, which it otherwise may not do for long."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
