"""Two-component normal mixture on a weighted histogram."""

from __future__ import annotations

import numpy as np


def fit_two_gaussians(v: np.ndarray, n: np.ndarray, min_pixels: int = 10,
                      max_iter: int = 200, tol: float = 1e-7):
    """Expectation-maximisation started at the weighted quartiles.

    Returns (mu0, sd0, mu1, sd1) with mu0 <= mu1, or None when the data are
    too few or hold a single value.
    """
    total = n.sum()
    if total < min_pixels or len(v) < 2:
        return None
    order = np.argsort(v)
    v, n = v[order], n[order]
    cum = np.cumsum(n)
    mu = np.array([v[np.searchsorted(cum, q * total)] for q in (0.25, 0.75)])
    if mu[0] == mu[1]:
        mu = np.array([v[0], v[-1]])
    spread = np.average((v - np.average(v, weights=n)) ** 2, weights=n)
    floor = max(spread * 1e-6, 1e-12)
    var = np.full(2, spread)
    share = np.full(2, 0.5)
    last = -np.inf
    for _ in range(max_iter):
        logp = (np.log(share) - 0.5 * np.log(2 * np.pi * var)
                - (v[:, None] - mu) ** 2 / (2 * var))
        top = logp.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        resp = np.exp(logp - norm[:, None]) * n[:, None]
        mass = np.maximum(resp.sum(axis=0), 1e-300)
        mu = (resp * v[:, None]).sum(axis=0) / mass
        var = np.maximum((resp * (v[:, None] - mu) ** 2).sum(axis=0) / mass, floor)
        share = mass / total
        now = float((n * norm).sum() / total)
        if abs(now - last) < tol:
            break
        last = now
    first, second = (0, 1) if mu[0] <= mu[1] else (1, 0)
    sd = np.sqrt(var)
    return float(mu[first]), float(sd[first]), float(mu[second]), float(sd[second])
