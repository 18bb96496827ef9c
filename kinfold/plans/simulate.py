"""Simulated traits with additive, background and focused interaction effects, for tests."""

from __future__ import annotations

import numpy as np


def positive_definite(a: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(a)
        return True
    except np.linalg.LinAlgError:
        return False


def nearest_correlation(a: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    """Symmetric matrix with raised eigenvalues and unit diagonal."""
    a = (a + a.T) / 2
    values, vectors = np.linalg.eigh(a)
    a = vectors @ np.diag(np.maximum(values, floor)) @ vectors.T
    d = np.sqrt(np.diag(a))
    return a / np.outer(d, d)


def standardise(g: np.ndarray) -> np.ndarray:
    """Missing (NaN) to the feature mean, then mean 0 and deviation 1; features in rows."""
    g = np.where(np.isnan(g), np.nanmean(g, axis=1, keepdims=True), g)
    sd = g.std(1, keepdims=True)
    return (g - g.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1)


def to_variance(x: np.ndarray, share: float) -> np.ndarray:
    sd = x.std()
    return (x - x.mean()) * np.sqrt(share) / sd if sd > 0 else x * 0


def trait(n: int = 400, m: int = 200, q: int = 5, *, additive: float = 0.3, background: float = 0.1, focused: float = 0.4, seed: int = 2025) -> dict:
    """Dosages (m by n), environments, and a trait whose feature 0 interacts with the first two environments."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.1, 0.5, m)
    g = rng.binomial(2, p[:, None], (m, n)).astype(float)
    x, e = standardise(g), rng.standard_normal((n, q))
    parts = [to_variance(rng.standard_normal(m) @ x, additive), to_variance(((rng.standard_normal((m, q)).T @ x).T * e).sum(1), background), to_variance(x[0] * (e[:, 0] + e[:, 1]), focused), to_variance(rng.standard_normal(n), 1 - additive - background - focused)]
    return {"dosage": g, "env": e, "y": sum(parts)}
