"""Per-channel intensity thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.mixture import fit_two_gaussians
from lumenframe.model import ThresholdSettings
from lumenframe.operators.relational import histogram, percentiles


def percentile_threshold(voxels: DataFrame, p: float = 95.0, keys=("c",),
                         weight: str | None = None) -> DataFrame:
    """(keys, thr): linear-interpolation percentile of the group's pixels."""
    return percentiles(histogram(voxels, keys, "v", weight), keys, {"thr": p})


def dprime(mu0: Column, sd0: Column, mu1: Column, sd1: Column) -> Column:
    """Separation of two normal components."""
    return F.abs(mu1 - mu0) / F.sqrt((sd0 * sd0 + sd1 * sd1) * F.lit(0.5))


def adaptive_threshold(voxels: DataFrame, settings: ThresholdSettings = ThresholdSettings(),
                       keys=("c",), weight: str | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """(keys, thr, dprime) by a two-component mixture on the value histogram.

    ``wanted`` (keys) lists the groups that must have a row; one without any
    pixel gets threshold 0.

    The histogram holds at most 65,536 rows per group, so the grouped kernel
    sees a fixed-size input however many voxels stand behind it. Groups with
    too few pixels, a poor separation or a failed fit use the percentile.
    """
    keys = list(keys)
    hist = histogram(voxels, keys, "v", weight)
    fallback = percentiles(hist, keys, {"pct": settings.fallback_percentile})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hist.schema if f.name in keys)

    def fit(pdf):
        head = pdf.loc[[pdf.index[0]], keys].reset_index(drop=True)
        fitted = fit_two_gaussians(pdf["v"].to_numpy(float), pdf["n"].to_numpy(float),
                                   settings.min_pixels, settings.max_iter, settings.tol)
        mu0, sd0, mu1, sd1 = fitted if fitted else (None,) * 4
        return head.assign(mu0=mu0, sd0=sd0, mu1=mu1, sd1=sd1)

    fits = hist.groupBy(*keys).applyInPandas(
        fit, f"{kinds}, mu0 double, sd0 double, mu1 double, sd1 double")
    d = fits.withColumn("dprime", F.when(
        (F.col("sd0") > 0) | (F.col("sd1") > 0),
        dprime(F.col("mu0"), F.col("sd0"), F.col("mu1"), F.col("sd1"))))
    usable = F.col("dprime") >= settings.dprime_thresh
    out = fallback.join(d, keys, "left").select(
        *keys,
        F.when(usable, (F.col("mu0") + F.col("mu1")) / 2).otherwise(F.col("pct")).alias("thr"),
        "dprime")
    if wanted is None:
        return out
    return wanted.select(*keys).distinct().join(out, keys, "left").withColumn("thr", F.coalesce("thr", F.lit(0.0)))
