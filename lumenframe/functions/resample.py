"""Separable resampling weights and the cosine transform as matrices."""

from __future__ import annotations

import numpy as np


def kernel(kind: str, t: np.ndarray, a: float = -0.5) -> np.ndarray:
    t = np.abs(t)
    if kind == "linear":
        return np.maximum(0.0, 1 - t)
    if kind == "cubic":
        near = (a + 2) * t ** 3 - (a + 3) * t ** 2 + 1
        far = a * (t ** 3 - 5 * t ** 2 + 8 * t - 4)
        return np.where(t <= 1, near, np.where(t < 2, far, 0.0))
    if kind == "nearest":
        return ((t <= 0.5) * 1.0)
    raise ValueError(f"unknown kernel {kind!r}")


def resize_matrix(n_in: int, n_out: int, kind: str = "linear", antialias: bool = True,
                  a: float = -0.5) -> np.ndarray:
    """(n_out, n_in) weights, pixel centres aligned, rows summing to one."""
    step = n_in / n_out
    stretch = max(step, 1.0) if antialias else 1.0
    centre = (np.arange(n_out) + 0.5) * step - 0.5
    w = kernel(kind, (centre[:, None] - np.arange(n_in)) / stretch, a)
    return w / w.sum(axis=1, keepdims=True)


def resize_stack(stack: np.ndarray, height: int, width: int, kind: str = "linear",
                 antialias: bool = True, a: float = -0.5) -> np.ndarray:
    """Resize the last two axes of an array."""
    h, w = stack.shape[-2:]
    if (h, w) == (height, width):
        return stack
    return resize_matrix(h, height, kind, antialias, a) @ stack @ resize_matrix(w, width, kind, antialias, a).T


def cosine_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II: C @ v transforms, C.T @ w inverts."""
    k = np.arange(n)[:, None]
    c = np.sqrt(2.0 / n) * np.cos(np.pi * (np.arange(n) + 0.5) * k / n)
    c[0] /= np.sqrt(2.0)
    return c
