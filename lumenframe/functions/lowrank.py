"""Robust fit of an illumination model to a stack of images.

The published model (Peng et al., 2017) is

    image_r(x) = b_r * S(x) + D(x) + sparse_r(x)

with a brightness b_r per image, a smooth field S of mean 1 and a smooth
offset D. Here it is fitted as a regression, pixel by pixel over the images:

1. Given S and D, an image's brightness is the weighted slope of (image - D)
   against S.
2. Given all brightnesses, a pixel's values are a straight line in b. Its
   intercept is taken from the images below the mean brightness, where the
   offset weighs most and content least; the slope through (0, D) from all.
   Both follow from five weighted sums over images: w, w b, w b b, w v, w b v.
   A line leaves open how much of b S belongs to D (adding c S to D takes c
   from every b), so D is what has no share of the shape of S: the multiple of
   S that the intercept correlates with is taken out of it.
3. Weights play down what is sparse: with u = |v - b S - D| / (b S), the
   deviation relative to the image's own level, w = 1 / (b (u + epsilon))^2.
   One factor of u + epsilon makes absolute deviations out of squared ones, the
   other reweights them, so that large deviations hardly count; b makes all
   images count by relative errors.
4. S and D are smoothed by shrinking their cosine coefficients by a multiple of
   the noise, which is read off the high frequencies.

Steps repeat until the field stops moving. Images never change and carry no
state: only S, D and a few numbers go from round to round, so an image may be
anywhere and a lost one is simply read again.
"""

from __future__ import annotations

import numpy as np

from lumenframe.functions.resample import cosine_matrix

SUMS = ("w", "wb", "wbb", "wv", "wbv")
DARKEST = 1e-9           # an image or level below this share of the stack's counts as black
NORMAL = 0.6745          # median of the absolute value of a standard normal


def shrink(v, by):
    """Soft threshold."""
    return np.sign(v) * np.maximum(np.abs(v) - by, 0.0)


def weights(rest: np.ndarray, level: np.ndarray, epsilon: float) -> np.ndarray:
    """1 / (u + epsilon)^2 for deviations relative to a level."""
    return 1.0 / np.square(np.abs(rest) / level + epsilon)


def brightness(d: np.ndarray, flat: np.ndarray, dark: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(brightness, weights) of the rows of ``d``; black rows have brightness 0 and no weight."""
    v = d - dark
    b = v.mean(axis=1) / flat.mean(axis=-1)
    lit = b > DARKEST
    level = np.where(lit, b, 1.0)[:, None] * np.maximum(flat, DARKEST)
    w = weights(v - b[:, None] * flat, level, epsilon) * lit[:, None]
    b = (w * flat * v).sum(axis=1) / np.maximum((w * flat * flat).sum(axis=1), DARKEST)
    return np.maximum(b, 0.0), w


def pixel_sums(d: np.ndarray, flat: np.ndarray, dark: np.ndarray, centre: float, settings) -> np.ndarray:
    """(sums, pixels): the sums of SUMS over the rows of ``d``, with a dark field also those over rows below ``centre``."""
    b, w = brightness(d, flat, dark, settings.epsilon)
    w = w / np.square(np.maximum(b, DARKEST))[:, None]
    of = lambda d, b, w: [w.sum(axis=0), (w * b).sum(axis=0), (w * b * b).sum(axis=0), (w * d).sum(axis=0), (w * b * d).sum(axis=0)]
    out = of(d, b[:, None], w)
    if settings.darkfield:
        dim = b <= centre
        out += of(d[dim], b[dim, None], w[dim])
    return np.stack(out)


def smooth(v: np.ndarray, side: int, strength: float | None) -> np.ndarray:
    """``v`` (side x side, flattened) with its cosine coefficients shrunk, the mean left alone.

    The threshold is ``strength`` times the noise level; without it, the level
    that noise alone stays under for that many coefficients.
    """
    c = cosine_matrix(side)
    coefficients = c @ v.reshape(side, side) @ c.T
    k = np.arange(side)
    high = np.abs(coefficients[k[:, None] + k[None, :] >= side])
    noise = np.median(high) / NORMAL if high.size else 0.0
    by = noise * (np.sqrt(2 * np.log(max(side * side, 2))) if strength is None else strength)
    mean = coefficients[0, 0]
    coefficients = shrink(coefficients, by)
    coefficients[0, 0] = mean
    return (c.T @ coefficients @ c).ravel()


def sum_names(settings) -> list[str]:
    return [*SUMS, *[f"dim_{s}" for s in SUMS if settings.darkfield]]


def offset_of(sums: np.ndarray) -> np.ndarray:
    """Intercept of every pixel's line over the dim images, less its share of the field's shape; 0 where all are equally bright."""
    w, wb, wbb, wv, wbv = sums
    det = w * wbb - wb * wb      # normal equations of a line
    clear = det > 1e-6 * w * wbb
    if not clear.any():
        return np.zeros_like(w)
    slope = np.where(clear, (w * wbv - wb * wv) / np.where(clear, det, 1.0), wbv / np.maximum(wbb, DARKEST))
    rest = np.where(clear, (wv - wb * slope) / np.maximum(w, DARKEST), 0.0)
    shape = slope / slope.mean() if abs(slope.mean()) > DARKEST else np.ones_like(slope)
    vary = shape - shape.mean()
    return rest - shape * (rest * vary).sum() / max((vary * vary).sum(), DARKEST)


def update(sums: np.ndarray, flat: np.ndarray, dark: np.ndarray, low: float, side: int, settings) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(field, offset, mean brightness, how far they moved) from the sums over a stack whose smallest value is ``low``."""
    w, wb, wbb, wv, wbv = sums[:5]
    offset = np.zeros_like(dark)
    if settings.darkfield:
        offset = np.clip(smooth(offset_of(sums[5:]), side, settings.lambda_dark), 0.0, max(low, 0.0))
    field = smooth((wbv - offset * wb) / np.maximum(wbb, DARKEST), side, settings.lambda_flat)
    field = field / field.mean() if field.mean() > DARKEST else np.ones_like(flat)
    centre = float(wb.sum() / max(w.sum(), DARKEST))
    moved = np.abs(field - flat).mean() + np.abs(offset - dark).mean() / max(centre, DARKEST)
    return field, offset, centre, float(moved)


def base_levels(d: np.ndarray, flat: np.ndarray, dark: np.ndarray, epsilon: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(level, converged) of every row: its brightness under a known field, reweighted until it stops moving.

    ``flat`` and ``dark`` have a row each. Rows do not depend on each other.
    """
    v = d - dark
    ratio = v / np.maximum(flat, DARKEST)
    level = np.maximum(np.median(ratio, axis=1), 0.0)
    done = np.zeros(len(d), bool)
    for _ in range(rounds):
        on = np.flatnonzero(~done)
        if not len(on):
            break
        b = level[on, None]
        w = weights(v[on] - b * flat[on], np.maximum(b * flat[on], DARKEST), epsilon)
        new = np.maximum((w * flat[on] * v[on]).sum(axis=1) / np.maximum((w * np.square(flat[on])).sum(axis=1), DARKEST), 0.0)
        done[on] = np.abs(new - level[on]) <= tolerance * np.maximum(new, DARKEST)
        level[on] = new
    return level, done
