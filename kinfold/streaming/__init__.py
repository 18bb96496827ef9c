"""Feature files as a stream: quality control of each arriving chunk, without state.

The engine's models need all samples and a fitted null model, but per-feature statistics don't: a
stream of Parquet files with (snp_idx, dosage) is summarised and filtered as it arrives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinfold.operators import qc
from kinfold.sources import bed


def passing_features(spark: SparkSession, path: str, maf: float = 0.01, missing: float = 0.05) -> DataFrame:
    """Streaming DataFrame of the features that pass the scan's quality control."""
    stream = spark.readStream.schema(bed.SCHEMA).parquet(path)
    return bed.summarised(stream).where(qc.scan_pass(maf, missing))
