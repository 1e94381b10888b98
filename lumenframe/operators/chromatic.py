"""Chromatic shift: affine resampling of one channel, and its estimation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.relational import attach

AXES = ("z", "y", "x")
SIDES = ("depth", "height", "width")


def warp(moving: DataFrame, info: DataFrame, matrix: Sequence[Sequence[float]], shift: Sequence[float]) -> DataFrame:
    """(z, y, x, v): value at matrix @ (z, y, x) + shift, trilinear, 0 outside the image.

    Each input voxel sends its weighted value to the few outputs it can reach.
    Contributions of neighbouring voxels merge on the map side, so the image
    crosses the network about once and no join is needed.
    """
    a = np.asarray(matrix, float)
    inv, t = np.linalg.inv(a), np.asarray(shift, float)
    reach = np.abs(inv).sum(axis=1)
    vox = attach(moving.select(*AXES, F.col("v").cast("double").alias("v")), info, [])
    out = vox
    for i, axis in enumerate(AXES):
        centre = sum((float(inv[i, j]) * (F.col(AXES[j]) - float(t[j])) for j in range(3)), F.lit(0.0))
        lo = F.greatest(F.lit(0), F.ceil(centre - float(reach[i])).cast("int"))
        hi = F.least(F.col(SIDES[i]) - 1, F.floor(centre + float(reach[i])).cast("int"))
        out = out.withColumn(f"_o{axis}", F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")))
    for axis in AXES:
        out = out.withColumn(f"o{axis}", F.explode(f"_o{axis}")).drop(f"_o{axis}")
    weight, inside = F.lit(1.0), F.lit(True)
    for i, axis in enumerate(AXES):
        src = sum((float(a[i, j]) * F.col(f"o{AXES[j]}") for j in range(3)), F.lit(float(t[i])))
        weight = weight * F.greatest(F.lit(0.0), 1 - F.abs(src - F.col(axis)))
        inside = inside & (src >= 0) & (src <= F.col(SIDES[i]) - 1)
    sent = out.withColumn("_w", weight).filter(inside & (F.col("_w") > 0)).select(
        *[F.col(f"o{x}").alias(x) for x in AXES], (F.col("_w") * F.col("v")).alias("v"))
    blank = vox.select(*AXES, F.lit(0.0).alias("v"))
    return sent.unionByName(blank).groupBy(*AXES).agg(F.sum("v").alias("v"))


def correct_channel(voxels: DataFrame, info: DataFrame, channel: int, matrix, shift, integer: bool = True) -> DataFrame:
    """Replace one channel by its warped version, truncated to pixels."""
    moved = warp(voxels.filter(F.col("c") == channel), info, matrix, shift)
    v = F.col("v").cast("int") if integer else F.col("v")
    return (voxels.filter(F.col("c") != channel)
            .unionByName(moved.select(F.lit(channel).alias("c"), *AXES, v.alias("v"))))


def estimate(fixed: DataFrame, moving: DataFrame, info: DataFrame, rounds: int = 15, tol: float = 1e-4):
    """Axis scales and shift that bring ``moving`` onto ``fixed``: (matrix, shift).

    Gauss-Newton on brightness differences with a free gain and level. A round
    is one warp plus one aggregation of the normal equations; the driver
    solves an 8 x 8 system.
    """
    scale, shift = np.ones(3), np.zeros(3)
    f = fixed.select(*AXES, F.col("v").cast("double").alias("f"))
    for _ in range(rounds):
        w = warp(moving, info, np.diag(scale), shift)
        cell = w
        for axis in AXES:  # central differences by shifting the warped image
            for step, name in ((1, "hi"), (-1, "lo")):
                cell = cell.unionByName(
                    w.select(*[(F.col(a) - step if a == axis else F.col(a)).alias(a) for a in AXES],
                             F.col("v").alias(f"{axis}{name}")), allowMissingColumns=True)
        grads = [f"{axis}{n}" for axis in AXES for n in ("hi", "lo")]
        g = cell.groupBy(*AXES).agg(*[F.max(c).alias(c) for c in ("v", *grads)]).dropna()
        terms = [F.lit(1.0), F.col("v")]
        for axis in AXES:
            slope = (F.col(f"{axis}hi") - F.col(f"{axis}lo")) / 2
            terms += [slope, slope * F.col(axis)]
        joined = f.join(g, list(AXES)).select("f", *[t.alias(f"t{i}") for i, t in enumerate(terms)])
        n = len(terms)
        sums = joined.agg(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"a{i}_{j}")
                            for i in range(n) for j in range(i, n)],
                          *[F.sum(F.col(f"t{i}") * F.col("f")).alias(f"b{i}") for i in range(n)]).first()
        m = np.array([[sums[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        sol = np.linalg.lstsq(m, np.array([sums[f"b{i}"] for i in range(n)]), rcond=None)[0]
        gain = sol[1] if sol[1] else 1.0
        move = sol[2:] / gain          # per axis: constant part, part growing with the position
        step_shift, step_scale = move[0::2] * scale, move[1::2] * scale
        shift, scale = shift + step_shift, scale + step_scale
        if max(np.abs(step_shift).max(), np.abs(step_scale).max()) < tol:
            break
    return np.diag(scale), shift
