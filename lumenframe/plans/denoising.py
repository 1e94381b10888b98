"""Slice enhancement ahead of a denoiser and restoration after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import enhance as E
from lumenframe.operators import image as I
from lumenframe.operators.denoise import blend, to_output
from lumenframe.session import cut


def enhance(voxels: DataFrame, info: DataFrame, height: int, width: int, reference_slice: int,
            target_range: tuple[int, int], clip: float = 1.5, grid: tuple[int, int] = (64, 64),
            channels=(1,), uint16: bool = True) -> DataFrame:
    """16-bit frames to enhanced slices in [-1, 1], padded to multiples of four.

    Slices strictly inside ``target_range`` are equalised and matched to the
    equalised reference slice; the others pass unchanged.
    """
    eight = I.frame_scale(voxels) if uint16 else voxels
    padded = I.pad_to_multiple(eight, info, channels)
    h, w = height + 4 - height % 4, width + 4 - width % 4
    inside = I.slices_between(padded, *target_range)
    outside = padded.filter(~((F.col("z") > target_range[0]) & (F.col("z") < target_range[1])))
    even = lambda df: E.equalize_tiles(df, h, w, clip, grid)
    matched = E.match_histograms(cut(even(inside)), even(padded.filter(F.col("z") == reference_slice)))
    both = (matched.select("c", "z", "y", "x", F.col("matched").alias("v"))
            .unionByName(outside.select("c", "z", "y", "x", F.col("v").cast("double").alias("v"))))
    return both.withColumn("v", I.to_signed_unit(F.col("v")))


def restore(enhanced: DataFrame, direct: Column, noise: Column, height: int, width: int, dtype: str) -> DataFrame:
    """Blend two estimates, crop the padding and cast to the output type."""
    mixed = blend(F.col("v"), direct, noise)
    return (enhanced.filter((F.col("y") < height) & (F.col("x") < width))
            .select("c", "z", "y", "x", to_output(mixed, dtype).alias("v")))


def training_pairs(enhanced: DataFrame, clean, noisy, height: int, width: int, patch: int = 64) -> DataFrame:
    """Clean and noisy patches zipped by position: (slot, z_clean, z_noisy, py, px, y, x, clean, noisy)."""
    def cut_out(slices, name):
        picked = I.take_slices(enhanced, slices)
        p = I.patches(picked, height, width, patch, patch, keys=("slot", "c", "z"))
        return p.select("slot", "c", "py", "px", "y", "x", F.col("z").alias(f"z_{name}"), F.col("v").alias(name))
    return cut_out(clean, "clean").join(cut_out(noisy, "noisy"), ["slot", "c", "py", "px", "y", "x"])
