"""Registered queries of the engine and the SQL that gives the same rows.

Every query runs over whole tables.  Numbers are rounded, as engines add in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import ranges, special, text
from kinfold.operators import graph, grm, ld, qc, table
from kinfold.plans import association, lmm, mom, scan, susie
from kinfold.plans.views import SQL as BASE
from kinfold.plans.views import Views
from kinfold import sinks
from kinfold.shared import Tables, folder
from kinfold.sources import bed
from kinfold.sources import grm as grm_io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Relatedness beyond which the feature matrix links two samples.
CUTOFF = 0.40
PASS = "af > 0.01 AND af < 0.99 AND miss < 0.05"


def query(sql: str | None = None):
    """Registers a function of the views under its name, with its SQL over the view definitions."""

    def add(f: Callable[[Views], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = BASE + (", " + sql[5:] if sql.lstrip().startswith("WITH ") else sql)
        return f

    return add


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def entry(c: str = "value") -> Column:
    """``r`` for the entries of a matrix, which are many: half away from zero without a decimal for each."""
    x = F.col(c) * 1e6
    whole = F.when(x < 0, -F.floor(0.5 - x)).otherwise(F.floor(x + 0.5)).cast("double")
    return F.when(F.abs(x) < 2.0**52, whole / 1e6).otherwise(F.col(c)).alias(c)


# -- features ---------------------------------------------------------------------------------------


@query("SELECT snp, nobs, n, round(af, 6) AS af, round(miss, 6) AS miss FROM freq")
def geno_af_missing(v):
    return qc.frequencies(v.geno).select("snp", "nobs", "n", r("af").alias("af"), r("miss").alias("miss"))


@query(f"SELECT snp FROM freq WHERE {PASS}")
def geno_qc_scan(v):
    return qc.frequencies(v.geno).where(qc.scan_pass()).select("snp")


@query("SELECT snp FROM freq WHERE af >= 0.01 AND miss <= 0.05 AND af * (1 - af) > 0")
def geno_qc_grm(v):
    return qc.frequencies(v.geno).where(qc.grm_pass()).select("snp")


@query(f"""SELECT iid, c.snp, round(CASE WHEN {PASS} AND sd > 0 THEN x / sd ELSE 0e0 END, 6) AS x FROM centred c
JOIN (SELECT snp, sqrt(sum(x * x) / (count(*) - 1)) AS sd FROM centred GROUP BY snp) s ON c.snp = s.snp""")
def geno_qc_mom(v):
    return qc.standardised_or_zero(v.geno).select("iid", "snp", r("x").alias("x"))


@query("SELECT iid, snp, round(x, 6) AS x FROM centred")
def geno_center_impute(v):
    return qc.centred(v.geno).select("iid", "snp", r("x").alias("x"))


@query("SELECT iid, snp, round(coalesce(d::DOUBLE, 2e0 * af), 6) AS x FROM gf")
def geno_mean_impute(v):
    return qc.imputed(v.geno).select("iid", "snp", r("x").alias("x"))


HOLE = "CASE WHEN (iid * 7 + snp * 3) % 29 = 0 THEN NULL ELSE v END"


@query(f"SELECT iid, snp, round(coalesce(h, avg(h) OVER (PARTITION BY snp)), 6) AS x, count(h) OVER (PARTITION BY snp) AS nobs FROM (SELECT iid, snp, {HOLE} AS h FROM feature)")
def feature_mean_impute(v):
    rows = v.feature.withColumn("h", F.when((F.col("iid") * 7 + F.col("snp") * 3) % 29 == 0, None).otherwise(F.col("v")))
    wide = rows.groupBy("snp").agg(F.array_sort(F.collect_list(F.struct("iid", "h"))).alias("c")).select("snp", F.col("c.iid").alias("ids"), F.col("c.h").alias("values"))
    out = bed.feature_imputed(wide)
    return out.select("snp", "nobs", F.explode(F.arrays_zip("ids", "values")).alias("z")).select(F.col("z.ids").alias("iid"), "snp", r("z.values").alias("x"), "nobs")


@query("""SELECT p_partkey, k, CASE (p_partkey % 256 >> (2 * k)) & 3 WHEN 0 THEN 2 WHEN 1 THEN NULL WHEN 2 THEN 1 ELSE 0 END AS d
FROM part, (SELECT unnest(range(4))::INT AS k)""")
def bed_bit_decode(v):
    byte = (F.col("p_partkey") % 256).cast("int")
    code = F.element_at(F.array(*(F.shiftright(byte, 2 * k).bitwiseAND(F.lit(3)) for k in range(4))), F.col("k") + 1)
    d = F.when(code == 0, 2).when(code == 1, None).when(code == 2, 1).otherwise(0)
    return v.table("part").select("p_partkey", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).select("p_partkey", "k", d.alias("d"))


@query("SELECT p_partkey AS snp_idx, p_brand AS chrom, p_name AS snp_id FROM part WHERE p_partkey >= 10 AND p_partkey < 50")
def snp_anno_range(v):
    return bed.annotation(v.bim, 10, 40)


@query("SELECT k::INT AS k, (k - 1) * (n // 7) AS first, CASE WHEN k = 7 THEN n ELSE k * (n // 7) END AS stop FROM (SELECT count(*) AS n FROM part), (SELECT unnest(range(1, 8)) AS k)")
def snp_split_task(v):
    n = v.table("part").count()
    return v.spark.createDataFrame([(k, *ranges.split_task(n, 7, k)) for k in range(1, 8)], "k int, first long, stop long")


@query("SELECT k::INT AS k, k * (n // 20) AS first, CASE WHEN k = 19 THEN n ELSE (k + 1) * (n // 20) END AS stop FROM (SELECT count(*) AS n FROM part), (SELECT unnest(range(20)) AS k)")
def snp_chunk_bounds(v):
    n = v.table("part").count()
    return v.spark.createDataFrame([(k, *c) for k, c in enumerate(ranges.chunks(0, n, 20))], "k int, first long, stop long")


# -- table ------------------------------------------------------------------------------------------


@query("SELECT iid, y FROM samples WHERE iid IN (SELECT vec_id FROM embeddings)")
def pheno_align_semi(v):
    return table.keep_in(v.samples, v.table("embeddings").select(F.col("vec_id").alias("iid"))).select("iid", "y")


@query("SELECT iid, y, cls FROM samples WHERE iid % 37 <> 0")
def pheno_missing_filter(v):
    raw = v.samples.select("iid", "y", F.when(F.col("iid") % 37 == 0, "NA").otherwise(F.col("y").cast("string")).alias("token"), "cls")
    return table.drop_missing(raw, ["token", "cls"]).select("iid", "y", "cls")


@query("SELECT iid FROM samples WHERE iid NOT IN (SELECT vec_id FROM embeddings)")
def pheno_unmatched_anti(v):
    return table.unmatched(v.samples, v.table("embeddings").select(F.col("vec_id").alias("iid"))).select("iid")


@query("SELECT vec_id AS iid, vec_id AS fam_idx FROM embeddings WHERE vec_id IN (SELECT iid FROM samples)")
def sample_locations(v):
    have = v.table("embeddings").select(F.col("vec_id").alias("iid"), F.col("vec_id").alias("fam_idx"))
    return table.locate(table.keep_in(have, v.samples).select("iid"), have, index="fam_idx")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def dup_id_check(v):
    return table.duplicates(v.table("orders"), "o_custkey")


@query("SELECT cls, dense_rank() OVER (ORDER BY cls)::INT AS level FROM (SELECT DISTINCT cls FROM samples)")
def distinct_levels(v):
    return v.spark.createDataFrame([(x, i + 1) for i, x in enumerate(table.levels(v.samples, "cls"))], "cls string, level int")


@query("SELECT o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_orderpriority")
def distinct_first_seen(v):
    return table.first_seen(v.table("orders"), "o_orderpriority", "o_orderkey")


def _ids(v):
    return v.table("customer").select(F.col("c_custkey").alias("id")), v.table("embeddings").select(F.col("vec_id").alias("id"))


@query("SELECT c_custkey AS id FROM customer UNION SELECT vec_id FROM embeddings")
def col_set_union(v):
    a, b = _ids(v)
    return a.union(b).distinct()


@query("SELECT c_custkey AS id FROM customer INTERSECT SELECT vec_id FROM embeddings")
def col_set_intersect(v):
    a, b = _ids(v)
    return a.intersect(b)


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT vec_id FROM embeddings")
def col_set_except(v):
    a, b = _ids(v)
    return a.subtract(b)


@query("SELECT iid, cov, group_size, row_number() OVER (ORDER BY group_size, cov, iid) - 1 AS pos FROM (SELECT iid, cov, count(*) OVER (PARTITION BY cov) AS group_size FROM samples)")
def reorder_by_group(v):
    return table.group_order(v.samples.select("iid", "cov"), "cov", "iid").select("iid", "cov", "group_size", F.col("pos").cast("long").alias("pos"))


@query("""SELECT cov, group_size, coalesce(sum(group_size) OVER (ORDER BY group_size, cov ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, group_size * group_size AS entries
FROM (SELECT cov, count(*) AS group_size FROM samples GROUP BY cov)""")
def block_offsets(v):
    return table.block_offsets(v.samples, "cov")


STD = ", ".join(f"(e{k} - avg(e{k}) OVER ()) / stddev_pop(e{k}) OVER () AS e{k}" for k in (1, 2, 3))


@query(f"SELECT iid, round(e1, 6) AS e1, round(e2, 6) AS e2, round(e3, 6) AS e3 FROM (SELECT iid, {STD} FROM env)")
def standardize_env(v):
    return table.standardised(v.env, ["e1", "e2", "e3"]).select("iid", *(r(c).alias(c) for c in ("e1", "e2", "e3")))


@query("""SELECT 1 AS a, 2 AS b, round(corr(e1, e2), 6) AS value FROM env UNION ALL SELECT 1, 3, round(corr(e1, e3), 6) FROM env UNION ALL SELECT 2, 3, round(corr(e2, e3), 6) FROM env""")
def env_corr_matrix(v):
    c = table.correlations(v.env, ["e1", "e2", "e3"])
    return v.spark.createDataFrame([(a + 1, b + 1, float(c[a, b])) for a in range(3) for b in range(a + 1, 3)], "a int, b int, value double").withColumn("value", r("value"))


@query(f"SELECT iid, round((e1 * e1 + e2 * e2 + e3 * e3) / 3e0, 6) AS d FROM (SELECT iid, {STD} FROM env)")
def nxe_diag(v):
    e = table.standardised(v.env, ["e1", "e2", "e3"])
    return e.select("iid", r((F.col("e1") ** 2 + F.col("e2") ** 2 + F.col("e3") ** 2) / 3.0).alias("d"))


@query("SELECT iid, l.cls AS level, CASE WHEN s.cls = l.cls THEN 1e0 ELSE 0e0 END AS x FROM samples s, (SELECT DISTINCT cls FROM samples) l")
def class_one_hot(v):
    cols = table.one_hot("cls", table.levels(v.samples, "cls"))
    return v.samples.select("iid", F.explode(F.array(*(F.struct(F.lit(k[4:]).alias("level"), c.alias("x")) for k, c in cols.items()))).alias("z")).select("iid", "z.level", "z.x")


@query("SELECT iid, cls, dense_rank() OVER (ORDER BY cls) - 1 AS level_idx FROM samples")
def class_incidence(v):
    return table.incidence(v.samples, "iid", "cls").join(v.samples.select("iid", "cls"), "iid").select("iid", "cls", F.col("level_idx").cast("long").alias("level_idx"))


@query("""SELECT 0 AS a, 0 AS b, count(*)::DOUBLE AS value FROM samples UNION ALL SELECT 1, 0, sum(cov)::DOUBLE FROM samples UNION ALL SELECT 1, 1, sum(cov * cov)::DOUBLE FROM samples""")
def design_gram(v):
    g = table.gram(v.samples, [F.lit(1.0), F.col("cov")])
    return v.spark.createDataFrame([(a, b, float(g[a, b])) for a in range(2) for b in range(a + 1)], "a int, b int, value double")


@query("SELECT iid, round(y - (SELECT regr_intercept(y, cov) FROM samples) - (SELECT regr_slope(y, cov) FROM samples) * cov, 4) AS residual FROM samples")
def ols_residual_simple(v):
    return table.residuals(v.samples, "y", [F.lit(1.0), F.col("cov")]).select("iid", r("residual", 4).alias("residual"))


@query("""WITH m AS (SELECT cov, cls, iid, y FROM samples), w AS (SELECT iid, cls, y - avg(y) OVER (PARTITION BY cls) AS yd, cov - avg(cov) OVER (PARTITION BY cls) AS xd FROM m)
SELECT iid, round(yd - (SELECT sum(xd * yd) / sum(xd * xd) FROM w) * xd, 4) AS residual FROM w""")
def ols_residual_full(v):
    """Intercept, covariate and all class levels; one level depends on the others and is dropped."""
    cols, _ = table.design(v.samples, ["cov"], ["cls"])
    return table.residuals(v.samples, "y", cols).select("iid", r("residual", 4).alias("residual"))


@query("SELECT o_orderkey, round(ln(o_totalprice), 6) AS y FROM orders")
def log_transform(v):
    return v.table("orders").select("o_orderkey", r(table.log_positive(F.col("o_totalprice"))).alias("y"))


@query("SELECT iid, round((rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 - 0.375e0) / (count(*) OVER () + 0.25e0), 8) AS quantile FROM samples")
def blom_quantile(v):
    return table.blom(v.samples, "y").select("iid", r("quantile", 8).alias("quantile"))


def _poly(x: str, *c: str) -> str:
    """A polynomial in SQL, highest power first."""
    out = c[0]
    for k in c[1:]:
        out = f"({out} * {x} + {k})"
    return out


#: Acklam's published rational approximation of the normal quantile, relative error 1.15e-9.
_A = ("-3.969683028665376e+01", "2.209460984245205e+02", "-2.759285104469687e+02", "1.383577518672690e+02", "-3.066479806614716e+01", "2.506628277459239e+00")
_B = ("-5.447609879822406e+01", "1.615858368580409e+02", "-1.556989798598866e+02", "6.680131188771972e+01", "-1.328068155288572e+01", "1e0")
_C = ("-7.784894002430293e-03", "-3.223964580411365e-01", "-2.400758277161838e+00", "-2.549732539343734e+00", "4.374664141464968e+00", "2.938163982698783e+00")
_D = ("7.784695709041462e-03", "3.224671290700398e-01", "2.445134137142996e+00", "3.754408661907416e+00", "1e0")
_TAIL = "sqrt(-2e0 * ln(least(p, 1e0 - p)))"


@query(f"""WITH q AS (SELECT iid, (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 - 0.375e0) / (count(*) OVER () + 0.25e0) AS p FROM samples)
SELECT iid, round(CASE WHEN p BETWEEN 0.02425e0 AND 0.97575e0 THEN (p - 0.5e0) * {_poly("((p - 0.5e0) * (p - 0.5e0))", *_A)} / {_poly("((p - 0.5e0) * (p - 0.5e0))", *_B)}
  ELSE sign(0.5e0 - p) * {_poly(_TAIL, *_C)} / {_poly(_TAIL, *_D)} END, 4) AS z FROM q""")
def inverse_normal(v):
    return table.blom(v.samples, "y").select("iid", r(special.norm_ppf("quantile"), 4).alias("z"))


# -- relationship -----------------------------------------------------------------------------------

_H = "2e0 * af * (1e0 - af)"
_KEPT = "k AS (SELECT iid, snp, d, af FROM gf WHERE af >= 0.01 AND miss <= 0.05 AND af * (1 - af) > 0)"


def _grm_sql(x: str, var: str, unit: str, code_type: int) -> str:
    z = f"({x}) / ({unit})" if code_type == 2 else x
    scale = "count(*)" if code_type == 2 else f"sum({var})"
    return f"""WITH {_KEPT}, z AS (SELECT iid, snp, CASE WHEN d IS NULL THEN 0e0 ELSE {z} END AS x FROM k),
c AS (SELECT {scale} AS s FROM (SELECT DISTINCT snp, af FROM k))
SELECT a.iid AS i, b.iid AS j, round(sum(a.x * b.x) / max(s), 6) AS value FROM z a JOIN z b ON a.snp = b.snp AND b.iid <= a.iid, c GROUP BY a.iid, b.iid"""


def _grm(v, kind, code_type):
    return grm.relationship(v.geno, kind, code_type, by_value=True).select("i", "j", entry())


_ADD = ("d - 2e0 * af", _H, f"sqrt({_H})")
_BIO = (f"CASE WHEN d = 2 THEN 0 ELSE d END - {_H}", f"{_H} * (1e0 - {_H})", f"sqrt({_H} * (1e0 - {_H}))")
_STAT = (f"CASE d WHEN 0 THEN -2e0 * af * af WHEN 1 THEN {_H} ELSE -2e0 * (1e0 - af) * (1e0 - af) END", f"({_H}) * ({_H})", _H)


@query(_grm_sql(*_ADD, 1))
def grm_additive_t1(v):
    return _grm(v, "additive", 1)


@query(_grm_sql(*_ADD, 2))
def grm_additive_t2(v):
    return _grm(v, "additive", 2)


@query(_grm_sql(*_BIO, 2))
def grm_dom_bio(v):
    return _grm(v, "dominance_biological", 2)


@query(_grm_sql(*_STAT, 1))
def grm_dom_stat(v):
    return _grm(v, "dominance_statistical", 1)


_FEAT = """f0 AS (SELECT iid, snp, v - avg(v) OVER (PARTITION BY snp) AS x FROM feature), f1 AS (SELECT iid, snp, x / sqrt(avg(x * x) OVER (PARTITION BY snp)) AS x FROM f0),
fg AS (SELECT a.iid AS i, b.iid AS j, sum(a.x * b.x) / 64e0 AS value FROM f1 a JOIN f1 b ON a.snp = b.snp AND b.iid <= a.iid GROUP BY a.iid, b.iid)"""


def _feature_grm(v, above: float | None = None, **part) -> DataFrame:
    return grm.product(*grm.feature_coded(v.feature), above=above, **part)


def _kernel(v, ridge: float = 0.0) -> grm.Factors:
    return grm.Factors(*grm.feature_coded(v.feature), ridge)


@query(f"WITH {_FEAT} SELECT i, j, round(value, 6) AS value FROM fg")
def grm_feature(v):
    return _feature_grm(v, by_value=True).select("i", "j", entry())


@query(f"WITH {_FEAT} SELECT i, j, round(value * value, 6) AS value FROM fg")
def grm_epistatic(v):
    g = _feature_grm(v, by_value=True)
    return grm.epistatic(g, g).select("i", "j", entry())


@query(f"WITH {_FEAT} SELECT i + 1 AS row, j + 1 AS col, round(value, 6) AS value FROM fg")
def grm_reformat_triplet(v):
    return grm_io.reformat(_feature_grm(v, by_value=True), 1).withColumn("value", entry())


@query(f"WITH {_FEAT} SELECT i, j, round(CASE WHEN i = j THEN value + 0.001e0 ELSE value END, 6) AS value FROM fg")
def grm_diag_jitter(v):
    return grm_io.with_diagonal(_feature_grm(v, by_value=True), 0.001).withColumn("value", entry())


@query(f"WITH {_FEAT} SELECT i, j, round(value, 6) AS value FROM fg")
def grm_merge(v):
    """The triangle in four parts of about equal area, and merged again."""
    b = ranges.triangle_bounds((v.table("embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1, 4)
    b = [None, *b[1:-1], None]  # every id is in a part
    return grm_io.merge([_feature_grm(v, only=(a, z), by_value=True) for a, z in zip(b, b[1:], strict=False)]).withColumn("value", entry())


@query("SELECT p_partkey AS p, i, p_partkey - i * (i + 1) // 2 AS j FROM (SELECT p_partkey, floor((sqrt(8e0 * p_partkey + 1) - 1) / 2)::BIGINT AS i FROM part)")
def lower_triangle_index(v):
    i, j = grm_io.triangle_index(F.col("p"))
    return v.table("part").select(F.col("p_partkey").alias("p")).select("p", i.alias("i"), j.alias("j"))


@query("""WITH n AS (SELECT count(*) AS n FROM part), c AS (SELECT r.b, k, n, abs(8 * (r.b * (r.b + 1) // 2) - k * (n * (n + 1) // 2)) AS far FROM n, (SELECT unnest(range(1, (SELECT n FROM n))) AS b) r, (SELECT unnest(range(1, 8)) AS k))
SELECT k::INT AS k, arg_min(b, far * 1000000000 + b) AS bound FROM c GROUP BY k""")
def triangle_partition(v):
    n = v.table("part").count()
    return v.spark.createDataFrame(list(enumerate(ranges.triangle_bounds(n, 8)))[1:-1], "k int, bound long")


_EDGES = f"{_FEAT}, e AS (SELECT i AS a, j AS b FROM fg WHERE i <> j AND value > {CUTOFF}e0)"
_COMP = f"""{_EDGES}, r(iid, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.iid, CASE WHEN e.a = r.root THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.root OR e.b = r.root),
m AS (SELECT iid, min(root) AS root FROM r GROUP BY iid)"""


@query(f"WITH {_EDGES} SELECT a, b FROM e")
def related_edges(v):
    return graph.edges(_feature_grm(v, CUTOFF), CUTOFF)


def _groups(v, g=None):
    nodes = v.table("embeddings").select(F.col("vec_id").alias("iid"))
    return graph.groups(nodes, graph.edges(_feature_grm(v, CUTOFF) if g is None else g, CUTOFF))


@query(f"WITH {_COMP} SELECT iid, dense_rank() OVER (ORDER BY root) AS group_id, count(*) OVER (PARTITION BY root) AS group_size FROM m")
def related_components(v):
    return _groups(v)


@query(f"WITH {_COMP} SELECT group_size, count(*) AS groups FROM (SELECT count(*) AS group_size FROM m GROUP BY root) GROUP BY group_size")
def group_sizes(v):
    return _groups(v).select("group_id", "group_size").distinct().groupBy("group_size").agg(F.count("*").alias("groups"))


@query(f"WITH {_COMP} SELECT dense_rank() OVER (ORDER BY x.root) AS group_id, i, j, round(value, 6) AS value FROM fg JOIN m x ON x.iid = i JOIN m y ON y.iid = j WHERE x.root = y.root")
def within_group_grm(v):
    return _feature_grm(v, within=_groups(v), by_value=True).select("group_id", "i", "j", entry())


@query(f"WITH {_COMP} SELECT iid AS grm_index, 's' || iid AS iid, dense_rank() OVER (ORDER BY root) AS group_id, count(*) OVER (PARTITION BY root) AS group_size FROM m")
def group_file(v):
    """Groups written as a group file and read back, joined to the samples by index."""
    rows = _groups(v).select(F.col("iid").alias("grm_index"), F.concat(F.lit("s"), "iid").alias("iid"), "group_id", "group_size")
    prefix = _place(v, "group")
    path, _ = sinks.groups(rows, prefix)
    names = grm_io.ids(v.spark, sinks.grm_ids(rows.select("grm_index", "iid"), prefix))
    return grm_io.retained(grm_io.read_groups(v.spark, path, names), names)


@query(f"WITH {_FEAT} SELECT 's' || i AS iid1, 's' || j AS iid2, round(value, 6) AS value FROM fg")
def grm_id_triplets(v):
    g = _feature_grm(v, by_value=True)
    names = v.table("embeddings").select(F.col("vec_id").alias("grm_index"), F.concat(F.lit("s"), "vec_id").alias("iid"))
    return grm_io.reformat(g, 2, names).withColumn("value", entry())


@query(f"WITH {_FEAT} SELECT i, j, round(CASE WHEN i = j THEN value + 0.001e0 ELSE value END, 6) AS value FROM fg")
def grm_files(v):
    """The dense binary file, written and read back."""
    return grm_io.read_dense(v.spark, sinks.grm_dense(_feature_grm(v), _place(v, "dense"))).withColumn("value", r("value"))


@query(f"WITH {_FEAT} SELECT i, j, round(value, 6) AS value FROM fg WHERE value > {CUTOFF}e0")
def grm_sparse_files(v):
    """The sparse binary file of entries beyond the cutoff, written and read back."""
    return grm_io.read_sparse(v.spark, sinks.grm_sparse(_feature_grm(v, CUTOFF), _place(v, "sparse"))).withColumn("value", r("value"))


def _place(v, name: str) -> str:
    return f"{folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def _packed(v) -> str:
    """The genotypes as packed files; returns the prefix."""
    prefix = _place(v, "packed")
    order = v.table("embeddings").select(F.col("vec_id").alias("iid"))
    rows = v.geno.groupBy("snp").agg(F.array_sort(F.collect_list(F.struct("iid", "d"))).alias("c")).select("snp", F.col("c.d").alias("dosage"))
    sinks.packed(rows, prefix, order, v.annotation.where("snp_idx < 64"))
    return prefix


_WANTED = (9, 3, 3, 60, 0)


@query(f"""WITH w AS (SELECT unnest([{", ".join(map(str, _WANTED))}])::BIGINT AS snp, unnest(range({len(_WANTED)}))::BIGINT AS req_pos)
SELECT req_pos, snp AS feat_idx, count(*) AS n, max(nobs) AS nobs, round(max(2e0 * af), 6) AS mean, round(sum(coalesce(d, 2e0 * af) * (iid % 7 + 1)), 4) AS digest FROM w JOIN geno USING (snp) JOIN freq USING (snp) GROUP BY req_pos, snp""".replace("count(*) AS n, max(nobs)", "count(*) AS n, max(freq.nobs)"))
def bed_index_read(v):
    """Packed files written, and features read by index in the order asked for, mean-imputed."""
    rows = bed.block_at(v.spark, _packed(v), 0, list(_WANTED))
    digest = F.aggregate(F.transform("values", lambda x, i: x * (i % 7 + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("req_pos", "feat_idx", F.size("values").cast("long").alias("n"), "nobs", r("mean").alias("mean"), r(digest, 4).alias("digest"))


@query("SELECT snp AS feat_idx, nobs, round(af, 6) AS mean FROM freq")
def bed_summary(v):
    """Frequency and count of each feature of the packed files."""
    return bed.summary(v.spark, _packed(v), 0).select("feat_idx", "nobs", r("mean").alias("mean"))


@query("SELECT snp AS feat_idx, count(d) AS nobs, round(avg(d), 6) AS mean FROM geno WHERE snp >= 10 AND snp < 25 GROUP BY snp")
def matrix_block(v):
    """Features of a text matrix, written and read by range through the format dispatch."""
    prefix = _place(v, "matrix")
    rows = v.geno.groupBy("snp").agg(F.array_sort(F.collect_list(F.struct("iid", "d"))).alias("c"))
    line = F.array_join(F.transform("c.d", lambda x: F.coalesce(x.cast("string"), F.lit("NA"))), " ")
    sinks.table(rows.select("snp", line.alias("line")).orderBy("snp").select("line"), f"{prefix}.fmat", [], header=False)
    return bed.block(v.spark, prefix, 1, 10, 25).select("feat_idx", "nobs", r("mean").alias("mean"))


@query("SELECT c_custkey AS row_id, 'c' || c_custkey AS iid, round(c_acctbal, 2) AS y, c_mktsegment AS cls FROM customer WHERE c_custkey % 11 <> 0".replace("c_custkey AS row_id", "c_custkey AS row_id"))
def phenotype_file(v):
    """A phenotype table with missing values, written, scanned by column, filtered and typed."""
    c = v.table("customer")
    y = F.when(F.col("c_custkey") % 11 == 0, F.lit("NA")).otherwise(F.format_string("%.2f", "c_acctbal"))
    rows = c.orderBy("c_custkey").select(F.concat(F.lit("c"), "c_custkey").alias("iid"), y.alias("y"), F.col("c_mktsegment").alias("cls"), F.lit("x").alias("unused"))
    path = sinks.table(rows, f"{_place(v, 'phenotype')}.txt", [])
    got = table.read_and_filter(bed.phenotypes(v.spark, path, ["iid", "y", "cls"]), [], ["y"])
    return got.select("row_id", "iid", r(text.strict_double(F.col("y")), 2).alias("y"), "cls")


@query("SELECT o_custkey AS iid, list_sort(list_distinct(list(o_orderkey) || list(o_orderkey // 2))) AS ids FROM orders GROUP BY o_custkey")
def merged_lists(v):
    o = v.table("orders").groupBy(F.col("o_custkey").alias("iid")).agg(F.collect_list("o_orderkey").alias("a"), F.collect_list(F.expr("o_orderkey div 2")).alias("b"))
    return o.select("iid", table.merged(F.col("a"), F.col("b")).alias("ids"))


@query(f"""WITH {_EDGES}, step(n, iid, left_) AS (SELECT -1, -1::BIGINT, (SELECT list({{'a': a, 'b': b}}) FROM e)
UNION ALL SELECT n + 1, x, [t FOR t IN left_ IF t.a <> x AND t.b <> x] FROM (SELECT n, left_, (SELECT id FROM (SELECT unnest(list_concat([t.a FOR t IN left_], [t.b FOR t IN left_])) AS id) GROUP BY id ORDER BY count(*) DESC, id LIMIT 1) AS x FROM step WHERE len(left_) > 0))
SELECT iid, n AS step FROM step WHERE n >= 0""")
def prune_close(v):
    removed = graph.prune(graph.edges(_feature_grm(v, CUTOFF), CUTOFF))
    return v.spark.createDataFrame([(int(x), i) for i, x in enumerate(removed)], "iid long, step int")


@query()
def grm_pca_eigenvalues(v):
    return grm.eigenvalues(_kernel(v))


@query()
def grm_inverse(v):
    """Inverse within the groups of related samples, with a small ridge."""
    return grm.inverse_by_features(_kernel(v, 0.001), _groups(v))


@query(f"WITH {_FEAT}, s AS (SELECT iid, {STD} FROM env) SELECT i, j, round(value * (x.e1 * y.e1 + x.e2 * y.e2 + x.e3 * y.e3) / 3e0, 6) AS value FROM fg JOIN s x ON x.iid = i JOIN s y ON y.iid = j")
def gxe_relationship(v):
    have = v.table("embeddings").select(F.col("vec_id").alias("iid"))
    e = table.keep_in(table.standardised(v.env, ["e1", "e2", "e3"]), have)
    return grm.environment_kernel(_feature_grm(v), e, ["e1", "e2", "e3"]).withColumn("value", r("value"))


# -- variance components ----------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT iid, {STD} FROM env), t AS (SELECT y / 1000e0 AS y, (e1 * e1 + e2 * e2 + e3 * e3) / 3e0 AS d FROM samples JOIN s USING (iid)),
u AS (SELECT y, d, 1e0 / (2e0 + d) AS w FROM t)
SELECT count(*) AS n, round(sum(w * y * y), 4) AS s_yy, round(sum(w * y), 4) AS s_1y, round(sum(w), 4) AS s_11, round(sum(w * w * d * y * y), 4) AS s_d_yy, round(sum(w * w * w * d * d), 4) AS t_dd_11, round(sum(w * d), 4) AS tr_d, round(sum(ln(2e0 + d)), 4) AS logdet FROM u""")
def reml_stats_singleton(v):
    """Sums of one iteration over unrelated samples at unit components: kernels 1, diag |E|^2 / q, 1."""
    e = table.standardised(v.env, ["e1", "e2", "e3"])
    t = v.samples.join(e, "iid").select((F.col("y") / 1000.0).alias("y"), ((F.col("e1") ** 2 + F.col("e2") ** 2 + F.col("e3") ** 2) / 3.0).alias("d"))
    w, y, d = 1.0 / (2.0 + F.col("d")), F.col("y"), F.col("d")
    sums = {"s_yy": w * y * y, "s_1y": w * y, "s_11": w, "s_d_yy": w * w * d * y * y, "t_dd_11": w * w * w * d * d, "tr_d": w * d, "logdet": F.ln(2.0 + d)}
    return t.agg(F.count("*").alias("n"), *(r(F.sum(c), 4).alias(n) for n, c in sums.items()))


ENV = ["e1", "e2", "e3"]


def _model(v, *, gxe: bool, **limits) -> association.Model:
    """The null model of the samples that have genotype and environments, related by their features."""
    tables = Tables(v.spark, "model")
    kernel = _kernel(v)
    groups = tables.write(_groups(v))
    s = tables.write(table.standardised(v.samples.join(v.env, "iid").join(groups.select("iid"), "iid"), ["y"]))
    fixed = [F.lit(1.0)]
    if gxe:
        s, fixed = association.gxe_prepare(s, "y", fixed, ENV)
    return association.fitted(s, kernel, groups, "y", fixed, ENV, gxe=gxe, **limits)


@query()
def reml_varcom(v):
    f = _model(v, gxe=True).fit
    return v.spark.createDataFrame([(*row, f.converged, f.iterations, row[0] in f.held) for row in f.variance_rows()], "component string, variance double, se double, converged boolean, iterations int, held boolean")


@query()
def heritability(v):
    f = _model(v, gxe=True).fit
    return v.spark.createDataFrame([(*row, f.converged) for row in f.heritability(2)], "component string, h2 double, se double, converged boolean")


@query()
def reml_two_components(v):
    """The main-effect model in the eigenbasis of the blocks."""
    f = _model(v, gxe=False).fit
    return v.spark.createDataFrame([(*row, f.converged, f.iterations) for row in f.variance_rows()], "component string, variance double, se double, converged boolean, iterations int")


@query(f"""WITH {_FEAT}, t AS (SELECT y / 1000e0 AS y, 0.6e0 * value + 0.4e0 AS v, value AS l FROM samples JOIN fg ON i = iid AND j = iid)
SELECT count(*) AS n, round(sum(y * y / v), 4) AS s_0_0, round(sum(y / v), 4) AS s_1_0, round(sum(1e0 / v), 4) AS s_1_1, round(sum(l * y * y / (v * v)), 4) AS s0_0_0, round(sum(l * l / (v * v * v)), 4) AS t00_1_1, round(sum(l / v), 4) AS tr0, round(sum(ln(v)), 4) AS logdet FROM t""")
def reml_eigen_sums(v):
    """The sums of one two-component iteration over unrelated samples, whose eigenvalue is the diagonal."""
    k = _feature_grm(v).where("i = j").select(F.col("i").alias("iid"), F.col("value").alias("lam"))
    rows = v.samples.join(k, "iid").select("lam", (F.col("y") / 1000.0).alias("w0"), F.lit(1.0).alias("w1"))
    s = lmm.eigen_sums(rows, np.array([0.6, 0.4]), 2)
    return s.select("n", *(r(c, 4).alias(c) for c in ("s_0_0", "s_1_0", "s_1_1", "s0_0_0", "t00_1_1", "tr0", "logdet")))


@query("""WITH s AS (SELECT iid, y, (e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER () AS e1 FROM samples JOIN env USING (iid))
SELECT iid, round(e1, 6) AS e1, round(y - (SELECT regr_intercept(y, e1) FROM s) - (SELECT regr_slope(y, e1) FROM s) * e1, 4) AS y FROM s""")
def gxe_prepared(v):
    """Preparation of an interaction model with one environment: standardised, and y without it."""
    s, _ = association.gxe_prepare(v.samples.join(v.env, "iid"), "y", [F.lit(1.0)], ["e1"])
    return s.select("iid", r("e1").alias("e1"), r("y", 4).alias("y"))


@query("""WITH s AS (SELECT iid, cls, y, e1 FROM samples JOIN env USING (iid)), w AS (SELECT iid, y - avg(y) OVER (PARTITION BY cls) AS yd, e1 - avg(e1) OVER (PARTITION BY cls) AS xd FROM s)
SELECT iid, round(yd - (SELECT sum(xd * yd) / sum(xd * xd) FROM w) * xd, 4) AS y FROM w""")
def mom_adjusted(v):
    """y without intercept, class levels and an environment, as the method of moments takes it."""
    return mom.adjusted(v.samples.join(v.env, "iid"), "y", [], ["cls"], ["e1"]).select("iid", r("y", 4).alias("y"))


@query("SELECT p_partkey AS snp_idx FROM part WHERE p_partkey >= (SELECT 2 * ((max(p_partkey) + 1) // 5) FROM part) AND p_partkey < (SELECT 3 * ((max(p_partkey) + 1) // 5) FROM part)")
def mom_block(v):
    return mom.block(v.table("part").select(F.col("p_partkey").alias("snp_idx")), 5, 3)


# -- scans ------------------------------------------------------------------------------------------

_SCAN = f"""s0 AS (SELECT iid, y, e1, e2, e3 FROM samples JOIN env USING (iid) WHERE iid IN (SELECT vec_id FROM embeddings)),
s AS (SELECT iid, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y, {STD} FROM s0),
fq AS (SELECT snp, coalesce(sum(d) / (2e0 * count(d)), 0e0) AS af, count(d) AS nobs, 1e0 - count(d)::DOUBLE / count(*) AS miss FROM geno JOIN s USING (iid) GROUP BY snp),
x AS (SELECT snp, af, nobs, coalesce(d - 2e0 * af, 0e0) AS x, y, e1, e2, e3 FROM geno JOIN s USING (iid) JOIN fq USING (snp) WHERE {PASS}),
u AS (SELECT snp, max(af) AS af, max(nobs) AS nobs, sum(x * x) AS xx, sum(x * y) AS u0, sum(x * e1 * y) AS u1, sum(x * e2 * y) AS u2, sum(x * e3 * y) AS u3,
  sum(x * x * e1) AS c1, sum(x * x * e1 * e1) AS v1 FROM x GROUP BY snp)"""


def _long(v) -> DataFrame:
    """Passing features in long form: centred x with standardised trait and environments."""
    s = v.samples.join(v.env, "iid").join(v.table("embeddings").select(F.col("vec_id").alias("iid")), "iid").select("iid", "y", "e1", "e2", "e3")
    s = table.standardised(s, ["y", "e1", "e2", "e3"])
    g = qc.centred(table.keep_in(v.geno, s)).where(qc.scan_pass())
    return g.join(s, "iid")


def _sums(v) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    own = [F.sum(x * F.col(f"e{k}") * y).alias(f"u{k}") for k in (1, 2, 3)]
    return _long(v).groupBy("snp").agg(F.max("af").alias("af"), F.max("nobs").alias("nobs"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("u0"), *own, F.sum(x * x * F.col("e1")).alias("c1"), F.sum(x * x * F.col("e1") ** 2).alias("v1"))


@query(f"WITH {_SCAN} SELECT snp, nobs, round(af, 6) AS af, round(u0 / xx, 6) AS beta, round(sqrt(1 / xx), 6) AS se, round(u0 * u0 / xx, 5) AS chi2 FROM u")
def scan_main_stat(v):
    return _sums(v).select("snp", "nobs", r("af").alias("af"), r(F.col("u0") / F.col("xx")).alias("beta"), r(F.sqrt(1 / F.col("xx"))).alias("se"), r(F.col("u0") ** 2 / F.col("xx"), 5).alias("chi2"))


@query(f"WITH {_SCAN} SELECT snp, round(u1 / sqrt(xx), 6) AS z1, round(u2 / sqrt(xx), 6) AS z2, round(u3 / sqrt(xx), 6) AS z3 FROM u")
def scan_env_z(v):
    return _sums(v).select("snp", *(r(F.col(f"u{k}") / F.sqrt("xx")).alias(f"z{k}") for k in (1, 2, 3)))


@query(f"WITH {_SCAN} SELECT snp, round((xx * u1 - c1 * u0) / (xx * v1 - c1 * c1), 6) AS beta, round(sqrt(xx / (xx * v1 - c1 * c1)), 6) AS se FROM u")
def scan_refit_2x2(v):
    """Interaction with the first environment beside the main effect: closed-form 2 by 2 inverse."""
    xx, c, w = F.col("xx"), F.col("c1"), F.col("v1")
    det = xx * w - c * c
    return _sums(v).select("snp", r((xx * F.col("u1") - c * F.col("u0")) / det).alias("beta"), r(F.sqrt(xx / det)).alias("se"))


@query(f"WITH {_SCAN} SELECT snp, round((u1 * u1 + u2 * u2 + u3 * u3) / xx, 5) AS q FROM u")
def scan_score_sumsq(v):
    z = F.transform(F.array("u1", "u2", "u3"), lambda u: u * u / F.col("xx"))
    return _sums(v).select("snp", r(F.aggregate(z, F.lit(0.0), lambda a, b: a + b), 5).alias("q"))


@query(f"WITH {_SCAN} SELECT snp FROM u WHERE greatest(u0 * u0, u1 * u1, u2 * u2, u3 * u3) / xx > 3.0e0")
def scan_promising(v):
    """Features whose largest chi-square passes the cut (p is decreasing in it)."""
    return _sums(v).where(F.greatest(*(F.col(f"u{k}") ** 2 for k in range(4))) / F.col("xx") > 3.0).select("snp")


#: Squared correlation from which features of the tables go together.
_R2 = 0.01


@query(f"""WITH {_SCAN}, g AS (SELECT geno.iid, geno.snp, coalesce(d - 2e0 * af, 0e0) AS x FROM geno JOIN s USING (iid) JOIN fq USING (snp) WHERE {PASS}),
pair AS (SELECT a.snp AS a, b.snp AS b FROM g a JOIN g b ON a.iid = b.iid AND a.snp <> b.snp JOIN u p ON p.snp = a.snp JOIN u q ON q.snp = b.snp GROUP BY a.snp, b.snp HAVING sum(a.x * b.x) * sum(a.x * b.x) / (max(p.xx) * max(q.xx)) >= {_R2}e0),
near AS (SELECT a AS snp, list(b) AS near FROM pair GROUP BY a),
o AS (SELECT u.snp, coalesce(near, []) AS near, row_number() OVER (ORDER BY u0 * u0 / xx DESC, u.snp) AS place FROM u LEFT JOIN near ON near.snp = u.snp),
taken(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT place, CASE WHEN list_has_any(near, kept) THEN kept ELSE list_append(kept, o.snp) END FROM taken JOIN o ON o.place = k + 1)
SELECT unnest(kept) AS snp FROM taken WHERE k = (SELECT max(k) FROM taken)""")
def ld_leads(v):
    """Of features that go together, those with the strongest main effect."""
    x = _long(v).select("iid", "snp", "x")
    return ld.leads(_sums(v).select("snp", (-(F.col("u0") ** 2) / F.col("xx")).alias("p")), ld.correlated(x, _R2)).select("snp")


#: Fixed components of the checked forms, and V of an unrelated sample under them.
_V = "(0.5e0 + 0.3e0 * d + 0.1e0 * d + 0.4e0)"


@query(f"""WITH {_SCAN}, k AS (SELECT snp, x, y, e1, {_V.replace("d", "((e1 * e1 + e2 * e2 + e3 * e3) / 3e0)")} AS v FROM x)
SELECT snp, round(sum(x * x / v), 5) AS m00, round(sum(x * x * e1 / v), 5) AS m01, round(sum(x * x * e1 * e1 / v), 5) AS m11, round(sum(x / v), 5) AS vx, round(sum(x * y / v), 5) AS vy, round(sum(x * x), 5) AS xx FROM k GROUP BY snp""")
def null_weighted_forms(v):
    """Quadratic forms of a scan under the covariance of an interaction model, for unrelated samples."""
    features, _, y, e = v.model_inputs()
    d = (e * e).sum(1) / 3
    null = scan.Null(y, np.ones((len(y), 1)), 1 / (0.5 + 0.3 * d + 0.1 * d + 0.4))
    f = scan.quadratic(features, null, e).where("ok")
    m = F.col("m")
    cols = {"m00": m[0], "m01": m[1], "m11": m[5], "vx": F.col("vx")[0], "vy": F.col("vy")[0], "xx": F.col("xx")}
    return f.select(F.col("snp_idx").alias("snp"), *(r(c, 5).alias(n) for n, c in cols.items()))


_BIM = "bim AS (SELECT p_partkey AS snp, p_brand AS chrom, p_name AS name, p_size::BIGINT AS base, substr(p_type, 1, 1) AS allele1, substr(p_type, 2, 1) AS allele2 FROM part)"


@query(f'WITH {_SCAN}, {_BIM} SELECT snp AS "order", chrom, name AS "SNP", base, allele1, allele2, round(af, 6) AS af, nobs AS "N", round(u0 / xx, 6) AS beta, round(sqrt(1e0 / xx), 6) AS se FROM u JOIN bim USING (snp)')
def assoc_table(v):
    """The annotated result table, under unrelated samples of unit variance."""
    features, _, y, _ = v.model_inputs()
    rows = scan.annotated(scan.scan_main(features, scan.Null(y, np.ones((len(y), 0)), np.ones(len(y))), 1.0), v.annotation)
    return rows.where(F.col("beta").isNotNull() & ~F.isnan("beta")).select("order", "chrom", "SNP", "base", "allele1", "allele2", r("af").alias("af"), "N", r("beta").alias("beta"), r("se").alias("se"))


@query()
def scan_gxe_full(v):
    """Fitted null model, calibration, scan of all features, annotation."""
    features, _ = v.arrays()
    return association.gxe_scan(features, _model(v, gxe=True), v.annotation)[0]


@query()
def scan_main_full(v):
    features, _ = v.arrays()
    return association.main_scan(features, _model(v, gxe=False), v.annotation)[0]


@query()
def random_panel_gamma(v):
    features, _ = v.arrays()
    return association.main_scan(features, _model(v, gxe=False))[2]


_P = "(event_id % 89 + 1) / 100e0"


def _acat_sql(w: str) -> str:
    return f"""SELECT user_id, round(0.5e0 - atan(sum({w} * tan((0.5e0 - {_P}) * pi())) / sum({w})) / pi(), 6) AS p FROM events GROUP BY user_id"""


def _acat(v, w) -> DataFrame:
    rows = v.table("events").select("user_id", F.struct("event_id", ((F.col("event_id") % 89 + 1) / 100.0).alias("p"), w.alias("w")).alias("z")).groupBy("user_id").agg(F.array_sort(F.collect_list("z")).alias("z"))
    return rows.select("user_id", r(special.acat_column(F.col("z.p"), F.col("z.w"))).alias("p"))


@query(_acat_sql("1e0"))
def acat_combine(v):
    return _acat(v, F.lit(1.0))


@query(_acat_sql("(event_id % 3 + 1)::DOUBLE"))
def acat_weighted(v):
    return _acat(v, (F.col("event_id") % 3 + 1).cast("double"))


@query()
def saddle_pvalue(v):
    return v.table("orders").select("o_orderkey", special.mixture_sf(F.col("o_totalprice") / 20000.0, [1.0, 0.7, 0.4, 0.1]).alias("p"))


@query("SELECT p_partkey AS snp_idx FROM part ORDER BY (p_partkey * 7919 + 12345) % 1000003, p_partkey LIMIT 100")
def sample_snps_hash(v):
    """The sampling operator: a fixed number of features in the order of a modular hash."""
    return v.table("part").select(F.col("p_partkey").alias("snp_idx")).orderBy((F.col("snp_idx") * 7919 + 12345) % 1000003, "snp_idx").limit(100)


@query()
def mom_varcom(v):
    features, _, y, e = v.model_inputs()
    return v.spark.createDataFrame(list(mom.fit(features, y, e).items()), "component string, variance double")


@query(f"""WITH s AS (SELECT iid, y FROM samples WHERE iid IN (SELECT vec_id FROM embeddings)), b AS (SELECT iid, CASE WHEN (iid * 13 + 5) % 7 < 3 THEN -1e0 ELSE 1e0 END AS b FROM s),
q AS (SELECT snp, coalesce(sum(d) / (2e0 * count(d)), 0e0) AS af, 1e0 - count(d)::DOUBLE / count(*) AS miss FROM geno JOIN s USING (iid) GROUP BY snp),
x AS (SELECT snp, iid, af, miss, coalesce(d - 2e0 * af, 0e0) AS x FROM geno JOIN s USING (iid) JOIN q USING (snp)),
z AS (SELECT x.snp, x.iid, CASE WHEN {PASS} AND sd > 0 THEN x / sd ELSE 0e0 END AS x FROM x JOIN (SELECT snp, sqrt(sum(x * x) / (count(*) - 1)) AS sd FROM x GROUP BY snp) d ON x.snp = d.snp),
p AS (SELECT snp, sum(x * b) AS c FROM z JOIN b USING (iid) GROUP BY snp)
SELECT z.iid, round(sum(z.x * p.c) / 64e0, 5) AS gb FROM z JOIN p USING (snp) GROUP BY z.iid""")
def mom_product(v):
    """G b for one fixed probe of signs."""
    s = table.keep_in(v.samples, v.table("embeddings").select(F.col("vec_id").alias("iid")))
    z = qc.standardised_or_zero(table.keep_in(v.geno, s)).withColumn("b", F.when((F.col("iid") * 13 + 5) % 7 < 3, -1.0).otherwise(1.0))
    c = z.groupBy("snp").agg(F.sum(F.col("x") * F.col("b")).alias("c"))
    m = v.geno.select("snp").distinct().count()
    return z.join(c, "snp").groupBy("iid").agg(r(F.sum(F.col("x") * F.col("c")) / m, 5).alias("gb"))


# -- fine-mapping -----------------------------------------------------------------------------------

_ALPHA = "al AS (SELECT p_partkey % 40 AS effect, p_partkey // 40 AS col, (p_size + 1e0) / sum(p_size + 1e0) OVER (PARTITION BY p_partkey % 40) AS alpha FROM part)"


def _alpha(v) -> DataFrame:
    p = v.table("part").select((F.col("p_partkey") % 40).alias("effect"), F.expr("p_partkey div 40").alias("col"), (F.col("p_size") + 1.0).alias("w"))
    return p.withColumn("alpha", F.col("w") / F.sum("w").over(Window.partitionBy("effect"))).drop("w")


@query(f"WITH {_ALPHA} SELECT col, round(1 - exp(sum(ln(1 - alpha))), 6) AS pip FROM al WHERE alpha < 1 GROUP BY col")
def pip(v):
    """1 - prod(1 - alpha) over effects (an effect with a single column is no shared evidence here)."""
    return _alpha(v).where("alpha < 1").groupBy("col").agg(r(1 - F.exp(F.sum(F.ln(1 - F.col("alpha"))))).alias("pip"))


@query(f"WITH {_ALPHA} SELECT effect, col FROM (SELECT effect, col, alpha, round(sum(alpha) OVER (PARTITION BY effect ORDER BY alpha DESC, col ROWS UNBOUNDED PRECEDING) - alpha, 9) AS before FROM al) WHERE before < 0.95")
def credible_set(v):
    w = Window.partitionBy("effect").orderBy(F.desc("alpha"), "col").rowsBetween(Window.unboundedPreceding, 0)
    return _alpha(v).withColumn("before", r(F.sum("alpha").over(w) - F.col("alpha"), 9)).where("before < 0.95").select("effect", "col")


@query("SELECT round(least(abs(corr(e1, e2)), abs(corr(e1, e3)), abs(corr(e2, e3))), 6) AS purity FROM env")
def purity_min_corr(v):
    c = np.abs(table.correlations(v.env, ["e1", "e2", "e3"]))
    return v.spark.createDataFrame([(float(c[np.triu_indices(3, 1)].min()),)], "purity double").withColumn("purity", r("purity"))


@query()
def susie_fit(v):
    """Which environments modify each feature: every feature is fine-mapped, in the task that holds it."""
    features, _, y, e = v.model_inputs()
    shared = v.spark.sparkContext.broadcast((y, e))

    def run(batches):
        trait, env = shared.value
        for pdf in batches:
            x, _, _, _ = scan.prepared(pdf)
            for snp, one in zip(pdf.snp_idx, x, strict=True):
                if not one.any():
                    continue
                w = susie.design(one, env)
                out = susie.fit(w.T @ w, w.T @ trait, float(trait @ trait), float(trait.var()), np.corrcoef(w.T), samples=len(trait))
                yield pd.DataFrame({"snp_idx": snp, "col": np.arange(len(out.pip)), "pip": out.pip})

    return features.mapInPandas(run, "snp_idx long, col long, pip double")


# -- text -------------------------------------------------------------------------------------------


@query("""SELECT doc_id, len(f)::INT AS n_fields, f[1] AS first, f[len(f)] AS last FROM (SELECT doc_id, regexp_extract_all(trim(translate(regexp_replace(text, '#.*', '', 's'), chr(9) || ',;' || chr(13) || chr(10), '     ')), '[^ \\x0B\\x0C]+') AS f FROM documents)""")
def text_normalise_split(v):
    f = text.fields(text.normalise(F.col("text")))
    return v.table("documents").select("doc_id", f.alias("f")).select("doc_id", F.size("f").alias("n_fields"), F.get("f", F.lit(0)).alias("first"), F.when(F.size("f") > 0, F.element_at("f", -1)).alias("last"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'NA') GROUP BY lang")
def missing_token(v):
    return v.table("documents").where(text.is_missing(F.col("lang"), ("en", "NA"))).groupBy("lang").agg(F.count("*").alias("n"))
