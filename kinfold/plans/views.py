"""Association views over the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """Lazily derived views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def feature(self) -> DataFrame:
        """(iid, snp, v): embeddings, one row for each component."""
        return self.table("embeddings").select(F.col("vec_id").alias("iid"), F.posexplode("embedding").alias("snp", "v")).select("iid", F.col("snp").cast("long").alias("snp"), F.col("v").cast("double").alias("v"))

    @staticmethod
    def _dosage(iid, snp, v):
        hole = (iid * 31 + snp * 17) % 97 < F.when(snp % 16 == 5, 12).otherwise(2)
        at = 0.05 * (snp % 8)
        return F.when(hole, None).when(v < at - 0.05, 0).when(v < at + 0.10, 1).otherwise(2)

    @property
    def geno(self) -> DataFrame:
        """(iid, snp, d): thresholded features with holes."""
        return self.feature.select("iid", "snp", self._dosage(F.col("iid"), F.col("snp"), F.col("v")).cast("int").alias("d"))

    @property
    def samples(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("iid"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("cov"), F.col("c_mktsegment").alias("cls"))

    @property
    def env(self) -> DataFrame:
        o = self.table("orders").groupBy(F.col("o_custkey").alias("iid"))
        return o.agg(F.count("*").cast("double").alias("e1"), F.avg("o_totalprice").alias("e2"), F.avg(F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("e3"))

    @property
    def bim(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("snp_idx"), F.col("p_brand").alias("chrom"), F.col("p_name").alias("snp_id"))

    @property
    def annotation(self) -> DataFrame:
        """Features with the columns of a feature file."""
        p = self.table("part")
        return p.select(F.col("p_partkey").alias("snp_idx"), F.col("p_brand").alias("chrom"), F.col("p_name").alias("snp_id"), F.col("p_size").cast("long").alias("base"), F.substring("p_type", 1, 1).alias("allele1"), F.substring("p_type", 2, 1).alias("allele2"))

    def arrays(self) -> tuple[DataFrame, DataFrame]:
        """Features as (snp_idx, dosage) over the samples that have genotype and environments, and
        these samples (pos, iid, y, e1..e3) in array order."""
        s = self.samples.join(self.env, "iid").join(self.table("embeddings").select(F.col("vec_id").alias("iid")), "iid")
        rows = self.geno.join(s.select("iid"), "iid")
        features = rows.groupBy(F.col("snp").alias("snp_idx")).agg(F.array_sort(F.collect_list(F.struct("iid", "d"))).alias("c")).select("snp_idx", F.col("c.d").alias("dosage"))
        return features, s.orderBy("iid")

    def model_inputs(self):
        """Features, ids, standardised y and environments as arrays (a sample is a few numbers)."""
        features, s = self.arrays()
        pdf = s.select("iid", "y", "e1", "e2", "e3").toPandas()
        e = pdf[["e1", "e2", "e3"]].to_numpy(float)
        e = (e - e.mean(0)) / e.std(0)
        y = pdf.y.to_numpy(float)
        return features, pdf.iid.to_numpy(), (y - y.mean()) / y.std(), np.ascontiguousarray(e)


SQL = """WITH RECURSIVE feature AS (SELECT vec_id AS iid, unnest(embedding)::DOUBLE AS v, (generate_subscripts(embedding, 1) - 1)::BIGINT AS snp FROM embeddings),
geno AS (SELECT iid, snp, CASE WHEN (iid * 31 + snp * 17) % 97 < (CASE WHEN snp % 16 = 5 THEN 12 ELSE 2 END) THEN NULL
  WHEN v < 0.05e0 * (snp % 8) - 0.05e0 THEN 0 WHEN v < 0.05e0 * (snp % 8) + 0.10e0 THEN 1 ELSE 2 END AS d FROM feature),
samples AS (SELECT c_custkey AS iid, c_acctbal AS y, c_nationkey AS cov, c_mktsegment AS cls FROM customer),
env AS (SELECT o_custkey AS iid, count(*)::DOUBLE AS e1, avg(o_totalprice) AS e2, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1e0 ELSE 0e0 END) AS e3 FROM orders GROUP BY o_custkey),
freq AS (SELECT snp, count(d) AS nobs, count(*) AS n, coalesce(sum(d) / (2e0 * count(d)), 0e0) AS af, 1e0 - count(d)::DOUBLE / count(*) AS miss FROM geno GROUP BY snp),
gf AS (SELECT geno.iid, geno.snp, d, af, miss FROM geno JOIN freq USING (snp)),
centred AS (SELECT iid, snp, af, miss, coalesce(d - 2e0 * af, 0e0) AS x FROM gf)
"""
