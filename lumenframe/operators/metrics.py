"""Image agreement measures over (..., y, x, a, b) pixel pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.blocks import ROW, to_blocks

# fixed values: structural similarity window and stabilisers
SSIM_SIDE = 11
SSIM_SIGMA = 1.5
SSIM_K1 = 0.01
SSIM_K2 = 0.03


def iou(pairs: DataFrame, keys: Sequence[str] = ("c",)) -> DataFrame:
    """tp / (tp + fp + fn) of two masks given as truthy columns a and b; 0 when both are empty."""
    a, b = F.col("a") != 0, F.col("b") != 0
    tp, any_ = F.count_if(a & b), F.count_if(a | b)
    return pairs.groupBy(*keys).agg(F.when(any_ > 0, tp / any_).otherwise(F.lit(0.0)).alias("iou"))


def psnr(pairs: DataFrame, keys: Sequence[str] = ("c",), max_value: float = 255.0) -> DataFrame:
    """10 log10(max^2 / mse); infinite for equal images."""
    d = F.col("a").cast("double") - F.col("b").cast("double")
    mse = F.avg(d * d)
    return pairs.groupBy(*keys).agg(F.when(
        mse > 0, 10 * F.log10(F.lit(max_value * max_value) / mse)).otherwise(F.lit(float("inf"))).alias("psnr"))


def _gauss():
    r = np.arange(SSIM_SIDE) - SSIM_SIDE // 2
    w = np.exp(-(r ** 2) / (2 * SSIM_SIGMA ** 2))
    return w / w.sum()


def _window_mean(img):
    """Weighted means over every full window."""
    w = _gauss()
    rows = np.lib.stride_tricks.sliding_window_view(img, SSIM_SIDE, axis=0) @ w
    return np.lib.stride_tricks.sliding_window_view(rows, SSIM_SIDE, axis=1) @ w


def _ssim_blocks(batches, block, max_value, shape):
    c1, c2 = (SSIM_K1 * max_value) ** 2, (SSIM_K2 * max_value) ** 2
    reach = SSIM_SIDE // 2
    for batch in batches:
        by, bx = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("by", "bx"))
        total, count = [], []
        for i in range(batch.num_rows):
            px = batch.column("px")[i].values.to_numpy()
            y = px // ROW - by[i] * block + reach
            x = px % ROW - bx[i] * block + reach
            a, b, have = (np.zeros((block + 2 * reach,) * 2) for _ in range(3))
            a[y, x] = batch.column("a")[i].values.to_numpy()
            b[y, x] = batch.column("b")[i].values.to_numpy()
            have[y, x] = 1
            held = np.lib.stride_tricks.sliding_window_view(have, (SSIM_SIDE, SSIM_SIDE)).sum(axis=(2, 3))
            if shape is None:
                full = held == SSIM_SIDE ** 2
            else:
                inside = [(at >= reach) & (at < side - reach) for at, side in
                          ((np.arange(block) + by[i] * block, shape[0]), (np.arange(block) + bx[i] * block, shape[1]))]
                full = (held > 0) & inside[0][:, None] & inside[1]
            ma, mb = _window_mean(a), _window_mean(b)
            mab, maa = _window_mean(a * b), _window_mean(a * a + b * b)
            light = (2 * ma * mb + c1) / (ma * ma + mb * mb + c1)
            form = (2 * (mab - ma * mb) + c2) / (maa - ma * ma - mb * mb + c2)
            total.append(float((light * form)[full].sum()))
            count.append(int(full.sum()))
        keep = [n for n in batch.schema.names if n not in ("px", "a", "b")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in keep], pa.array(total, pa.float64()), pa.array(count, pa.int64())],
            names=[*keep, "total", "windows"])


def ssim(pairs: DataFrame, keys: Sequence[str] = ("c", "z"), max_value: float = 255.0, block: int = 128,
         shape: tuple[int, int] | None = None) -> DataFrame:
    """Mean structural similarity over all full 11x11 Gaussian windows, computed per block with a halo.

    With the image's ``shape`` every window inside it that holds a pixel
    counts, and missing pixels as 0 in both images; without, windows with
    missing pixels do not count. A group without any window has null.
    """
    px = pairs.select(*keys, "y", "x", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    packed = to_blocks(px, keys, block, SSIM_SIDE // 2, ["a", "b"])
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name not in ("px", "a", "b"))
    sums = packed.mapInArrow(lambda it: _ssim_blocks(it, block, max_value, shape), f"{kept}, total double, windows bigint")
    return sums.groupBy(*keys).agg(F.try_divide(F.sum("total"), F.sum("windows")).alias("ssim"))
