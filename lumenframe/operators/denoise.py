"""Blend and hooks around an external denoising network.

Networks are user callables on numpy batches; the library ships none.
"""

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators.image import clip_pixel, from_signed_unit, widen_to_uint16


def _unit(v: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))


def blend(noisy: Column, direct: Column, noise: Column, gamma: float = 0.5) -> Column:
    """Mix the direct estimate with input minus estimated noise; [-1, 1] in, 0..255 out."""
    return from_signed_unit(gamma * _unit(direct) + (1 - gamma) * _unit(noisy - noise))


def to_output(v: Column, dtype: str) -> Column:
    """0..255 floats to the output pixel type."""
    if dtype == "uint16":
        return widen_to_uint16(v)
    if dtype == "uint8":
        return clip_pixel(v, 255)
    raise ValueError(f"dtype must be 'uint8' or 'uint16', not {dtype!r}")


def denoise_tiles(tiles: DataFrame, direct: Callable[[np.ndarray], np.ndarray],
                  noise: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int],
                  gamma: float = 0.5, batch_size: int = 64) -> DataFrame:
    """Run two networks over tile rows (``px`` array of doubles in [-1, 1]); adds ``denoised``.

    Each callable maps (n, h, w) to (n, h, w). Tiles arrive in Arrow batches;
    a task holds one batch at a time.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(px: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in px:
            out = []
            for start in range(0, len(series), batch_size):
                part = series.iloc[start:start + batch_size]
                x = np.stack(part.to_list()).reshape(-1, *shape)
                mixed = gamma * np.clip(direct(x), -1, 1) + (1 - gamma) * np.clip(x - noise(x), -1, 1)
                out.extend(((mixed + 1) * 0.5 * 255).reshape(len(part), -1))
            yield pd.Series(out)

    return tiles.withColumn("denoised", run(F.col("px").cast("array<double>")))
