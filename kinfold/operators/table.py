"""Phenotype table: missing values, alignment, order, design matrices."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import text
from kinfold.operators.rank import numbered


#: Share of the rows below which filtering warns.
LEAST_KEPT = 0.05


class EmptyTable(ValueError):
    """No row is left."""


def drop_missing(df: DataFrame, columns: list[str], tokens: tuple[str, ...] = text.MISSING) -> DataFrame:
    """Rows whose ``columns`` all hold a value."""
    for c in columns if tokens else ():
        df = df.where(F.col(c).isNotNull() & ~text.is_missing(F.col(c).cast("string"), tokens))
    return df


def keep_in(df: DataFrame, ids: DataFrame, key: str = "iid") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def unmatched(df: DataFrame, ids: DataFrame, key: str = "iid") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def locate(wanted: DataFrame, have: DataFrame, key: str = "iid", index: str = "idx") -> DataFrame:
    """Index of each wanted id, the first of duplicates; an unknown id is an error."""
    if missing := [r[0] for r in unmatched(wanted, have, key).select(key).limit(5).collect()]:
        raise KeyError(f"unknown ids: {missing}")
    return wanted.join(have.groupBy(key).agg(F.min(index).alias(index)), key)


def read_and_filter(df: DataFrame, id_lists: list[DataFrame], used: list[str], key: str = "iid", tokens: tuple[str, ...] = text.MISSING) -> DataFrame:
    """Aligned, complete rows; none left is an error, fewer than LEAST_KEPT of them a warning."""
    out = drop_missing(df, used, tokens)
    for ids in id_lists:
        out = keep_in(out, ids, key)
    kept = out.count()
    if not kept:
        raise EmptyTable("no row is left after filtering")
    if kept < LEAST_KEPT * df.count():
        warnings.warn(f"only {kept} rows are left after filtering", stacklevel=2)
    return out


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def levels(df: DataFrame, col: str) -> list[str]:
    """Sorted distinct levels of a class column."""
    return [r[0] for r in df.select(F.col(col).cast("string")).distinct().orderBy(col).collect()]


def first_seen(df: DataFrame, col: str, pos: str) -> DataFrame:
    return df.groupBy(col).agg(F.min(pos).alias(pos)).orderBy(pos)


def one_hot(col: str, values: list[str]) -> dict[str, Column]:
    return {f"{col} {v}": F.when(F.col(col).cast("string") == v, 1.0).otherwise(0.0) for v in values}


def incidence(df: DataFrame, row: str, col: str) -> DataFrame:
    """Sparse incidence matrix: (row, level_idx, 1.0)."""
    named = numbered(df.select(col).where(F.col(col).isNotNull()).distinct(), col, out="level_idx")
    return df.join(named, col).select(row, "level_idx", F.lit(1.0).alias("value"))


def group_order(df: DataFrame, group: str, index: str) -> DataFrame:
    """Adds group_size and pos: order by size of group, group, index.  Sizes are counted before the
    shuffle and joined back, so a hot group is split."""
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    return numbered(df.join(sizes, df[group].eqNullSafe(sizes[group])).drop(sizes[group]), "group_size", group, index)


def block_offsets(df: DataFrame, group: str) -> DataFrame:
    """Groups in block order with the first position of each, and the entries of their dense blocks."""
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    placed = numbered(sizes, "group_size", group, sums={"start": "group_size"})
    return placed.select(group, "group_size", "start", (F.col("group_size") * F.col("group_size")).alias("entries"))


def reorder(df: DataFrame, order: DataFrame, key: str = "iid") -> DataFrame:
    """Rows in the order of ``order`` (key, pos); absent and repeated ids are errors."""
    if not duplicates(order, key).isEmpty() or not unmatched(order, df, key).isEmpty():
        raise ValueError("ids are absent or come twice")
    return df.join(order, key).orderBy("pos")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns minus mean, over population deviation (a column without variance becomes 0)."""
    s = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in columns})


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Pearson matrix from one aggregate; a column without variance correlates with nothing."""
    pairs = [(a, b) for a in range(len(columns)) for b in range(a)]
    r = df.agg(F.count("*"), *(F.corr(columns[a], columns[b]) for a, b in pairs)).first()
    out = np.eye(len(columns))
    for (a, b), v in zip(pairs, r[1:], strict=True):
        out[a, b] = out[b, a] = 0.0 if v is None or np.isnan(v) else v
    return out


def gram(df: DataFrame, columns: list[Column]) -> np.ndarray:
    """X'X of columns, in one distributed aggregate of fixed size."""
    k = len(columns)
    named = df.select(*(c.cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    r = named.agg(*(F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(k) for j in range(i + 1))).first()
    out, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i + 1):
            out[i, j] = out[j, i] = r[at] or 0.0
            at += 1
    return out


def independent(xtx: np.ndarray, tol: float = 1e-6) -> list[int]:
    """Columns that don't depend on earlier ones: unpivoted Cholesky of the Gram matrix, whose
    diagonal is that of the R of a QR decomposition; the tolerance is relative to the column."""
    k, keep = len(xtx), []
    rows: list[np.ndarray] = []
    for j in range(k):
        v = xtx[j].copy()
        for r in rows:
            v -= r[j] * r
        if v[j] > (tol**2) * max(xtx[j, j], 1e-300) and np.sqrt(max(v[j], 0)) > tol:
            rows.append(v / np.sqrt(v[j]))
            keep.append(j)
    return keep


def residuals(df: DataFrame, y: str, x: list[Column], out: str = "residual") -> DataFrame:
    """y minus its least-squares fit; dependent columns are dropped."""
    g = gram(df, [*x, F.col(y)])
    keep = independent(g[:-1, :-1])
    beta = np.linalg.solve(g[np.ix_(keep, keep)], g[keep, -1]) if keep else np.zeros(0)
    fit = sum((x[j].cast("double") * F.lit(float(b)) for j, b in zip(keep, beta, strict=True)), F.lit(0.0))
    return df.withColumn(out, F.col(y) - fit)


def design(df: DataFrame, covariates: list[str], classes: list[str]) -> tuple[list[Column], list[str]]:
    """Intercept, covariates and one-hot blocks, without dependent columns, with labels."""
    cols, labels = [F.lit(1.0)], ["intercept"]
    for c in covariates:
        cols.append(F.col(c).cast("double"))
        labels.append(f"covariate {c}")
    for c in classes:
        for name, col in one_hot(c, levels(df, c)).items():
            cols.append(col)
            labels.append(f"class {name}")
    keep = independent(gram(df, cols))
    return [cols[i] for i in keep], [labels[i] for i in keep]


def log_positive(c: Column) -> Column:
    return F.when(c > 0, F.ln(c)).otherwise(F.raise_error(F.lit("logarithm of a number that isn't positive")).cast("double"))


def blom(df: DataFrame, y: str, out: str = "quantile") -> DataFrame:
    """(mid-rank - 3/8) / (n + 1/4); ties share their mean rank; rows without a value go.

    Ranks come from counts of distinct values, which are summed up in the order of the values over all tasks."""
    counts = numbered(df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count("*").alias("_c")), y, sums={"_below": "_c"})
    rank = counts.select(F.col(y), (F.col("_below") + (F.col("_c") + 1) / 2e0).alias("_r"), F.col("_c"))
    n = df.where(F.col(y).isNotNull()).count()
    return df.join(rank, y).withColumn(out, (F.col("_r") - 0.375) / (n + 0.25)).drop("_r", "_c")


class RankDeficient(ValueError):
    """The design has columns that depend on others."""


def check_rank(df: DataFrame, columns: list[Column], tol: float = 1e-6) -> None:
    """Raises if a column depends on earlier ones."""
    g = gram(df, columns)
    keep = independent(g, tol)
    if len(keep) < len(columns):
        raise RankDeficient(f"columns that depend on earlier ones: {sorted(set(range(len(columns))) - set(keep))}")


def blom_all(df: DataFrame, columns: list[str], suffix: str = "_q") -> DataFrame:
    """``blom`` of several traits."""
    for c in columns:
        df = blom(df, c, c + suffix)
    return df


def merged(*lists: Column) -> Column:
    """Sorted distinct elements of several lists; a null list counts as empty."""
    return F.array_sort(F.array_distinct(F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull()))))
