"""Thinning of correlated features: of those that go together the strongest signal stays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import grm
from kinfold.shared import Tables

R2 = 0.1


def correlated(rows: DataFrame, r2: float = R2, **sizes) -> DataFrame:
    """(a, b), b < a: pairs of features whose squared correlation over the samples is at least ``r2``.

    rows: (iid, snp, x) with x centred and 0 where missing.  Features without variance have no pair."""
    norm = rows.groupBy("snp").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n")).where("_n > 0")
    unit = rows.join(norm, "snp").select(F.col("snp").alias("iid"), F.col("iid").alias("snp"), (F.col("x") / F.col("_n")).alias("x"))
    return grm.product(unit, **sizes).where((F.col("i") != F.col("j")) & (F.col("value") * F.col("value") >= r2)).select(F.col("i").alias("a"), F.col("j").alias("b"))


def leads(features: DataFrame, links: DataFrame, by: str = "p", cutoff: float | None = None) -> DataFrame:
    """The features (snp, ``by``) that remain when, from the smallest ``by`` on, each one that is still
    there removes those linked with it; ties go to the smaller snp.  Null and values of ``cutoff`` or more take no part.

    In a round every feature stays that no undecided neighbour precedes, which gives the same as one by one."""
    tables = Tables(features.sparkSession, "ld")
    ok = F.col(by).isNotNull() if cutoff is None else F.col(by) < cutoff
    left = tables.write(features.where(ok).select("snp", F.col(by).alias("_by")))
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = tables.write(links.select(ways.alias("z")).select("z.a", "z.b").distinct())
    kept = []
    while True:
        near = both.join(left.select(F.col("snp").alias("a"), F.col("_by").alias("_a")), "a").join(left.select(F.col("snp").alias("b"), F.col("_by").alias("_b")), "b")
        beaten = near.where(F.struct("_b", "b") < F.struct(F.col("_a").alias("_b"), F.col("a").alias("b"))).select(F.col("a").alias("snp")).distinct()
        best = tables.write(left.join(beaten, "snp", "left_anti"))
        kept.append(best)
        out = best.select("snp").union(both.join(best.select(F.col("snp").alias("a")), "a").select(F.col("b").alias("snp"))).distinct()
        then = tables.write(left.join(out, "snp", "left_anti"))
        tables.drop(left)
        left = then
        if left.isEmpty():
            tables.drop(left, both)
            return reduce(DataFrame.unionByName, kept).withColumnRenamed("_by", by)
