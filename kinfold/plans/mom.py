"""Heritability by the method of moments with random probes.

Of each kernel only its products with y and a few probes are needed.  Features stream through one
map, whose partial sums (samples by probes) are added by sample in an aggregate; the moment equations
are of the size of the components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.ranges import split_task
from kinfold.operators import qc, table
from kinfold.plans.scan import passes, prepared


def probes(y: np.ndarray, r: int = 10, seed: int = 1) -> np.ndarray:
    """[y, r standard normal vectors], seeded."""
    return np.column_stack([y, np.random.default_rng(seed).standard_normal((len(y), r))])


def accumulate(features: DataFrame, b: np.ndarray, e: np.ndarray, maf: float = qc.MAF, missing: float = qc.MISSING) -> tuple[np.ndarray, np.ndarray]:
    """G B and (K o EE'/q) B, with G = sum of x x' / m over all m features; those that fail count as 0."""
    n, r, q = len(b), b.shape[1], max(1, e.shape[1])
    shared = features.sparkSession.sparkContext.broadcast((b, e))

    def run(batches):
        bb, ee = shared.value
        gb, vb, m = np.zeros((n, r)), np.zeros((n, r)), 0
        for pdf in batches:
            x, af, miss, _ = prepared(pdf)
            sd = np.sqrt((x * x).sum(1) / (n - 1))
            ok = passes(af, miss, maf, missing) & (sd > 0)
            x = x[ok] / sd[ok, None]
            m += len(pdf)
            gb += x.T @ (x @ bb)
            for k in range(ee.shape[1]):
                xe = x * ee[:, k]
                vb += xe.T @ (xe @ bb)
        yield pd.DataFrame({"i": np.arange(n), "g": list(gb), "v": list(vb), "m": [m] + [0] * (n - 1)})

    add = lambda c: F.array(*(F.sum(F.col(c)[j]) for j in range(r)))
    rows = features.mapInPandas(run, "i long, g array<double>, v array<double>, m long").groupBy("i").agg(add("g").alias("g"), add("v").alias("v"), F.sum("m").alias("m")).orderBy("i").collect()
    m = sum(x.m for x in rows)
    return np.array([x.g for x in rows]) / m, np.array([x.v for x in rows]) / (m * q)


def solve(b: np.ndarray, gb: np.ndarray, vb: np.ndarray, e: np.ndarray, noise_by_env: bool = True) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Components, their values, and both sides of the moment equations."""
    y, z = b[:, 0], b[:, 1:]
    d = (e * e).sum(1) / e.shape[1]
    names = ["G", "GxE", *(["NxE"] if noise_by_env else []), "residual"]
    products = [gb, vb, *([d[:, None] * b] if noise_by_env else []), b]
    k = len(names)
    left = np.empty((k, k))
    for i in range(k):
        for j in range(k):
            left[i, j] = (products[i][:, 1:] * products[j][:, 1:]).sum() / z.shape[1]
    left[-1, -1] = len(y)
    if noise_by_env:  # known exactly, without probes
        left[2, 2], left[2, 3], left[3, 2] = (d * d).sum(), d.sum(), d.sum()
    right = np.array([y @ p[:, 0] for p in products])
    return names, np.linalg.solve(left, right), left, right


def block(features: DataFrame, total: int, current: int, key: str = "snp_idx") -> DataFrame:
    """Part ``current`` (from 1) of ``total`` equal ranges of the features; the last takes the rest."""
    start, end = split_task((features.agg(F.max(key)).first()[0] or 0) + 1, total, current)
    return features.where((F.col(key) >= start) & (F.col(key) < end))


def adjusted(samples: DataFrame, y: str, covariates: list[str], classes: list[str], env: list[str]) -> DataFrame:
    """y replaced by its residual on the fixed effects (dependent columns go) and the environments as
    they are, which must not depend on the fixed effects."""
    x, _ = table.design(samples, covariates, classes)
    every = [*x, *(F.col(c) for c in env)]
    table.check_rank(samples, every)
    return table.residuals(samples, y, every, out=y)


def fit(features: DataFrame, y: np.ndarray, e: np.ndarray, *, r: int = 10, seed: int = 1, noise_by_env: bool = True, maf: float = qc.MAF, missing: float = qc.MISSING) -> dict[str, float]:
    b = probes(y, r, seed)
    names, var, _, _ = solve(b, *accumulate(features, b, e, maf, missing), e, noise_by_env)
    return dict(zip(names, var.tolist(), strict=True))


def fit_per_environment(features: DataFrame, y: np.ndarray, e: np.ndarray, *, r: int = 10, seed: int = 1, maf: float = qc.MAF, missing: float = qc.MISSING) -> dict[str, float]:
    """One interaction component for each environment."""
    b = probes(y, r, seed)
    gb = accumulate(features, b, e[:, :1], maf, missing)[0]
    products = [gb, *(accumulate(features, b, e[:, [k]], maf, missing)[1] for k in range(e.shape[1])), b]
    left = np.array([[(p[:, 1:] * q[:, 1:]).sum() / r for q in products] for p in products])
    left[-1, -1] = len(y)
    var = np.linalg.solve(left, np.array([b[:, 0] @ p[:, 0] for p in products]))
    return dict(zip(["G", *(f"GxE{k + 1}" for k in range(e.shape[1])), "residual"], var.tolist(), strict=True))
