"""Fine-mapping of the environments behind a signal: a sum of single effects.

Only X'V^-1 X, X'V^-1 y, y'V^-1 y and the correlations of X are needed, a few numbers from one pass
over the samples; the iteration over effects runs on these.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Result:
    alpha: np.ndarray
    mu: np.ndarray
    pip: np.ndarray
    sets: list[list[int]]
    coverage: list[float]
    iterations: int
    sigma2: float = 1.0


def design(x: np.ndarray, e: np.ndarray, *, with_env: bool = False) -> np.ndarray:
    """Standardised feature, [environments], and feature times each environment."""
    x = (x - x.mean()) / (x.std() or 1.0)
    return np.column_stack([x, *([e] if with_env else []), x[:, None] * e])


def _best_prior(b: np.ndarray, s2: np.ndarray, prior: np.ndarray, now: float) -> float:
    """Prior variance on [1e-10, 1e10] that maximises the marginal likelihood: golden section on its
    logarithm; the current value stays if it is better."""

    def loss(lv: float) -> float:
        v = np.exp(lv)
        bf = 0.5 * np.log(s2 / (s2 + v)) + 0.5 * b * b / s2 * v / (s2 + v)
        top = bf.max()
        return -(top + np.log((prior * np.exp(bf - top)).sum()))

    low, high, g = np.log(1e-10), np.log(1e10), (np.sqrt(5) - 1) / 2
    grid = np.linspace(low, high, 60)
    at = int(np.argmin([loss(t) for t in grid]))
    low, high = grid[max(0, at - 1)], grid[min(59, at + 1)]
    for _ in range(80):
        a, c = high - g * (high - low), low + g * (high - low)
        if loss(a) < loss(c):
            high = c
        else:
            low = a
    best = (low + high) / 2
    return float(np.exp(best)) if loss(best) < loss(np.log(max(now, 1e-300))) else now


def fit(xx: np.ndarray, xy: np.ndarray, yy: float, var_y: float, corr: np.ndarray, *, effects: int = 10, max_iter: int = 100, tol: float = 1e-3, coverage: float = 0.95, min_abs_corr: float = 0.5, samples: int | None = None) -> Result:
    """With ``samples``, their number, the residual variance is estimated again after each round: the
    expected squared residual for each sample; otherwise it stays 1 (a whitened trait)."""
    p = len(xy)
    effects = min(effects, p)
    sigma2, norm = 1.0 if samples is None else yy / samples, np.diag(xx)
    prior, s2 = np.full(p, 1 / p), sigma2 / norm
    alpha, mu, mu2 = np.full((effects, p), 1 / p), np.zeros((effects, p)), np.zeros((effects, p))
    v0, kl = np.full(effects, 0.2 * var_y), np.zeros(effects)
    before, i = -np.inf, 0
    for i in range(1, max_iter + 1):
        for k in range(effects):
            others = (alpha * mu).sum(0) - alpha[k] * mu[k]
            b = (xy - xx @ others) / norm
            v0[k] = _best_prior(b, s2, prior, v0[k])
            bf = 0.5 * np.log(s2 / (s2 + v0[k])) + 0.5 * b * b / s2 * v0[k] / (s2 + v0[k])
            w = prior * np.exp(bf - bf.max())
            alpha[k] = w / w.sum()
            post = 1 / (1 / v0[k] + 1 / s2)
            mu[k], mu2[k] = post / s2 * b, post + (post / s2 * b) ** 2
            single = bf.max() + np.log(w.sum())
            kl[k] = -single + (alpha[k] * (mu[k] * b / s2 - 0.5 * mu2[k] / s2)).sum()
        m = alpha * mu
        total = m.sum(0)
        fit2 = total @ xx @ total - sum(r @ xx @ r for r in m) + (alpha * mu2 @ np.diag(xx)).sum()
        rest = max(float(yy - 2 * total @ xy + fit2), 1e-12)
        elbo = -0.5 * rest / sigma2 - (0.5 * samples * np.log(sigma2) if samples else 0.0) - kl.sum()
        if abs(elbo - before) < tol:
            break
        before = elbo
        if samples:
            sigma2 = rest / samples
            s2 = sigma2 / norm
    sets, claimed = credible_sets(alpha, corr, coverage, min_abs_corr)
    return Result(alpha, mu, 1 - np.prod(1 - alpha, axis=0), sets, claimed, i, float(sigma2))


def credible_sets(alpha: np.ndarray, corr: np.ndarray, coverage: float = 0.95, min_abs_corr: float = 0.5) -> tuple[list[list[int]], list[float]]:
    """Of each effect the fewest columns that reach the coverage; kept if single or pure; each once."""
    sets, claimed = [], []
    for a in alpha:
        order = np.argsort(-a, kind="stable")
        n = int(np.searchsorted(np.cumsum(a[order]), coverage - 1e-12) + 1)
        own = sorted(order[: min(n, len(a))].tolist())
        pure = len(own) == 1 or np.abs(corr[np.ix_(own, own)]).min() > min_abs_corr
        if pure and own not in sets:
            sets.append(own)
            claimed.append(float(a[own].sum()))
    return sets, claimed
