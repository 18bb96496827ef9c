"""Distributed ranks and running sums: no task holds more than a bucket of a group.

A group (a source, say) may hold a third of all rows, so a window over it would be one task.  Rows
are bucketed by leading hexadecimal digits of their seeded hash, whose number follows the row count;
a window ranks within a bucket.  Offsets of buckets come from running sums on two levels: within runs
of buckets, and over the sums of these runs, whose number is the square root of that of the buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about.
BUCKET_ROWS = 20_000


def digits(rows: int, least: int = 2) -> int:
    """Leading hexadecimal digits that leave about BUCKET_ROWS rows in a bucket."""
    n = least
    while rows > BUCKET_ROWS * 16**n:
        n += 1
    return n


def shuffled(seed: str, *columns: Column) -> Column:
    """A seeded hash as 32 hexadecimal digits, in text order a random order; null counts as empty."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)))


def offsets(counts: DataFrame, bucket: str, run: Column, n: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``out``, the sum of ``n`` over the buckets of a group ``by`` before each; ``run`` is
    non-decreasing in ``bucket`` and puts neighbouring buckets together."""
    counts = counts.withColumn("_run", run)
    before = lambda w: F.coalesce(F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = counts.withColumn("_s", F.col(n)).withColumn("_near", before(Window.partitionBy(*by, "_run").orderBy(bucket))).drop("_s")
    runs = counts.groupBy(*by, "_run").agg(F.sum(n).alias("_s"))
    far = runs.select(*by, "_run", before(Window.partitionBy(*by).orderBy("_run")).alias("_far"))
    return near.join(far, [*by, "_run"]).withColumn(out, F.col("_far") + F.col("_near")).drop("_run", "_near", "_far")
