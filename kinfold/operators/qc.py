"""Quality control of features in long form (iid, snp, d) and as predicates on af and miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAF, MISSING = 0.01, 0.05


def frequencies(geno: DataFrame) -> DataFrame:
    """(snp, nobs, n, af, miss): af is half the mean dosage, 0 without data."""
    return geno.groupBy("snp").agg(F.count("d").alias("nobs"), F.count("*").alias("n"), F.coalesce(F.sum("d") / (2e0 * F.count("d")), F.lit(0.0)).alias("af")).withColumn("miss", 1e0 - F.col("nobs") / F.col("n"))


def scan_pass(maf: float = MAF, missing: float = MISSING) -> Column:
    return (F.col("af") > maf) & (F.col("af") < 1 - maf) & (F.col("miss") < missing)


def grm_pass(maf: float = MAF, missing: float = MISSING) -> Column:
    """One-sided frequency filter, and none without variance."""
    return (F.col("af") >= maf) & (F.col("miss") <= missing) & (F.col("af") * (1 - F.col("af")) > 0)


def with_frequencies(geno: DataFrame) -> DataFrame:
    return geno.join(frequencies(geno), "snp")


def centred(geno: DataFrame) -> DataFrame:
    return with_frequencies(geno).withColumn("x", F.coalesce(F.col("d") - 2e0 * F.col("af"), F.lit(0.0)))


def imputed(geno: DataFrame) -> DataFrame:
    return with_frequencies(geno).withColumn("x", F.coalesce(F.col("d").cast("double"), 2e0 * F.col("af")))


def standardised_or_zero(geno: DataFrame, maf: float = MAF, missing: float = MISSING) -> DataFrame:
    """Centred and divided by the sample deviation; 0 for features that fail."""
    x = centred(geno)
    sd = x.groupBy("snp").agg(F.sqrt(F.sum(F.col("x") * F.col("x")) / (F.count("*") - 1)).alias("sd"))
    return x.join(sd, "snp").withColumn("x", F.when(scan_pass(maf, missing) & (F.col("sd") > 0), F.col("x") / F.col("sd")).otherwise(0.0))


def promising(p: Column, cut: float = 1e-3) -> Column:
    """Whether the smallest of an array of p-values is below the cut."""
    return F.array_min(p) < cut
