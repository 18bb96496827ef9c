"""Positions of all rows in one order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.shared import Tables

#: The low bits of monotonically_increasing_id() count the rows of a partition.
ROW_BITS = 33


def numbered(df: DataFrame, *order: str | Column, out: str = "pos", sums: dict[str, str] | None = None) -> DataFrame:
    """Adds ``out``, the position from 0 in the order of the columns, and for each of ``sums`` (name:
    column) the sum of that column over the rows before.

    The rows are sorted by range over all tasks and written, so that their places are final; what each
    partition holds is summed, and these few sums are offsets for its rows."""
    from pyspark.sql import Window

    sums = sums or {}
    rows = Tables(df.sparkSession, "rank").write(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", ROW_BITS)
    rows = rows.withColumn("_part", part).withColumn("_at", F.col("_id") - F.shiftleft(part, ROW_BITS))
    each = rows.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_s_{k}") for k, c in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = each.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", *(f"_s_{k}" for k in sums))))
    rows = rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_n") + F.col("_at"))
    within = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    for k, c in sums.items():
        rows = rows.withColumn(k, F.col(f"_s_{k}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return rows.drop("_id", "_part", "_at", "_n", *(f"_s_{k}" for k in sums))
