"""Data model: column conventions, fixed domain values and settings.

Voxel table   (c, z, y, x, v)             one row per voxel, ``c`` is 1-based
Mask table    (..., c, z, y, x)           one row per *set* voxel (sparse)
Punctum table (punctum_id, x, y, z, score, radius, vol_size, mass,
               mean_intensity, max_intensity, sd_intensity,
               voxels array<struct<x,y,z>>)

Any operator that takes ``keys`` accepts extra leading columns such as
``scene``; the default is one image.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
# Domain constants that results depend on.
UINT8_MAX = 255
UINT16_MAX = 65535
ROI_MARGIN = 5              # pixels around a punctum; upper bound is exclusive
MIN_PUNCTUM_VOXELS = 5
LOW_CONFIDENCE = "low_confidence"
SINGLE_CHANNEL_CONFIDENCE = 0.8
REJECTED_SINGLE_CHANNELS = (2, 5)
WEAK_CHANNELS = (4, 5)      # channels whose pairs are always linked once seen
CH2_MIN_THRESHOLD = 0.6
CH2_THRESHOLD_FACTOR = 1.5
CLIQUE_SIZE_BONUS = 0.5
CLIQUE_PROB_BONUS = 0.3
DENDRITE_SKIP_ABOVE = 0.8
AXON_SKIP_BELOW = 0.2
THICKNESS_EPS = 1e-5
ENTROPY_EPS = 1e-8
DENSITY_EPS = 1e-6
# -----------------------------------------------------------------------------

VOXEL_SCHEMA = T.StructType([
    T.StructField("c", T.IntegerType()),
    T.StructField("z", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("x", T.IntegerType()),
    T.StructField("v", T.DoubleType()),
])

PUNCTUM_SCHEMA = T.StructType([
    T.StructField("punctum_id", T.LongType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("radius", T.DoubleType()),
    T.StructField("vol_size", T.LongType()),
    T.StructField("mass", T.DoubleType()),
    T.StructField("mean_intensity", T.DoubleType()),
    T.StructField("max_intensity", T.DoubleType()),
    T.StructField("sd_intensity", T.DoubleType()),
    T.StructField("voxels", T.ArrayType(T.StructType([
        T.StructField("x", T.IntegerType()),
        T.StructField("y", T.IntegerType()),
        T.StructField("z", T.IntegerType()),
    ]))),
])


@dataclass(frozen=True)
class ThresholdSettings:
    """Adaptive threshold: mixture midpoint, percentile when it does not separate."""

    fallback_percentile: float = 95.0
    dprime_thresh: float = 1.0
    min_pixels: int = 10
    max_iter: int = 200
    tol: float = 1e-7


@dataclass(frozen=True)
class MorphologySettings:
    """Axon / dendrite split by region thickness."""

    thickness_thresh: float = 6.0
    soft_margin: float = 0.5


@dataclass(frozen=True)
class ClassifySettings:
    """Pair thresholds and channel roles for punctum classification.

    ``optimal_threshold`` stands for the threshold shipped with a trained
    pair model; when present it takes precedence over ``overlap_thresh``.
    """

    signal_channel: int = 4
    post_cell_channel: int | None = 2
    use_axon_dendrite: bool = True
    overlap_thresh: float = 0.6
    optimal_threshold: float | None = None
    rule_overlap_thresh: float = 0.6
    confidence_threshold: float | None = None
    margin: int = ROI_MARGIN
    threshold: ThresholdSettings = ThresholdSettings()
    morphology: MorphologySettings = MorphologySettings()


@dataclass(frozen=True)
class FlatfieldSettings:
    """Flatfield estimation.

    ``lambda_flat`` and ``lambda_dark`` are smoothing thresholds as multiples of
    the noise (None: from the number of coefficients); a field that moves less
    than ``tolerance`` on average is final.
    """

    working_size: int = 128
    rounds: int = 60
    tolerance: float = 1e-5
    epsilon: float = 0.1
    lambda_flat: float | None = None
    lambda_dark: float | None = None
    darkfield: bool = False


def validate_channels(requested, n_channels: int) -> list[int]:
    """Check 1-based channel numbers against an image; ``None`` means all."""
    if requested is None:
        return list(range(1, n_channels + 1))
    bad = [c for c in requested if not 1 <= c <= n_channels]
    if bad:
        raise ValueError(f"channels {bad} outside 1..{n_channels}")
    return list(requested)


def pixel_type(kind: str, itemsize: int, max_value: float) -> str:
    """Output pixel type ('uint8' or 'uint16') for an array kind code.

    ``kind`` follows numpy's one-letter codes. Unsigned 8/16-bit data keep
    their type, other numbers are judged by their maximum, anything else fails.
    """
    if kind == "u" and itemsize in (1, 2):
        return "uint8" if itemsize == 1 else "uint16"
    if kind in "iuf":
        return "uint8" if max_value <= UINT8_MAX else "uint16"
    raise ValueError(f"no pixel type for kind {kind!r}")
