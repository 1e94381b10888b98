"""Slice-level statistics and clean / noisy / reference frame selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.image import clip_pixel
from lumenframe.operators.relational import attach


def load_channel(voxels: DataFrame, channel: int | None = None, n_channels: int = 1) -> DataFrame:
    """One channel as 8-bit (z, y, x, v); ranges above 255 are scaled by the maximum."""
    wanted = 1 if channel is None else channel
    if not 1 <= wanted <= n_channels:
        raise ValueError(f"channel {wanted} outside 1..{n_channels}")
    one = voxels.filter(F.col("c") == wanted)
    top = one.agg(F.max("v").alias("_top"))
    v = F.col("v").cast("double")
    scaled = F.when(F.col("_top") > 255, v / F.col("_top") * 255.0).otherwise(v)
    return attach(one, top, []).select("z", "y", "x", clip_pixel(scaled, 255).alias("v"))


def slice_means(voxels: DataFrame, keys=("c",)) -> DataFrame:
    """(keys, z, m): mean intensity per slice. Everything after works on this small table."""
    return voxels.groupBy(*keys, "z").agg(F.avg("v").alias("m"))


def percentile_normalize(means: DataFrame, low: float = 2, high: float = 98, keys=("c",)) -> DataFrame:
    """Scale each series to [0, 1] between two percentiles; a flat series becomes 0."""
    limits = means.groupBy(*keys).agg(F.percentile("m", F.lit(low / 100.0)).alias("lo"),
                                      F.percentile("m", F.lit(high / 100.0)).alias("hi"))
    unit = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), (F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(F.lit(0.0))
    return means.join(limits, list(keys)).select(*keys, "z", unit.alias("m"))


def centred_run(center: Column, total: Column, count: int) -> Column:
    """Up to ``count`` consecutive indices around ``center``, moved inside [0, total)."""
    first = F.greatest(F.lit(0), center - count // 2)
    end = F.least(total, first + count)
    start = F.greatest(F.lit(0), end - count)
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def ranked(means: DataFrame, keys=("c",)) -> DataFrame:
    """Per image: slice count and slices by falling mean (ties: lower index first).

    A group has one row per slice of one image stack.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("neg"), F.col("z").alias("z"))))
    return means.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("total"), order.alias("_o"),
        F.min(F.when(F.col("m") > 0.05, F.col("z"))).alias("_z0"),
        F.max(F.when(F.col("m") > 0.05, F.col("z"))).alias("_z1"),
    ).withColumn("order", F.transform("_o", lambda s: s["z"])).drop("_o")


def top_slices(means: DataFrame, n: int = 2, keys=("c",)) -> DataFrame:
    """(keys, rank, z) of the brightest slices, rank from 1."""
    return ranked(means, keys).select(
        *keys, F.posexplode(F.slice("order", 1, n)).alias("rank", "z")
    ).withColumn("rank", F.col("rank") + 1)


def usable_range(means: DataFrame, keys=("c",)) -> DataFrame:
    """(keys, z_start, z_end): trims dim slices at both ends; end exclusive."""
    return ranked(means, keys).select(
        *keys, F.coalesce("_z0", F.lit(0)).alias("z_start"),
        F.coalesce(F.col("_z1") + 1, F.col("total")).alias("z_end"))


def select_frames(means: DataFrame, keys=("c",)) -> DataFrame:
    """(keys, clean, noisy, reference, z_start, z_end), 0-based slice arrays."""
    r = ranked(means, keys)
    first = F.get("order", F.lit(0))
    second = F.coalesce(F.get("order", F.lit(1)), first)
    r = r.withColumns({"_first": first, "_second": second})
    chosen = F.array_union(centred_run(F.col("_first"), F.col("total"), 5),
                           centred_run(F.col("_second"), F.col("total"), 5))
    near = centred_run(F.col("_second"), F.col("total"), 5)
    return r.select(
        *keys,
        F.array_sort(F.slice(F.array_union(chosen, F.col("order")), 1, 10)).alias("clean"),
        centred_run(F.floor(F.col("total") / 2).cast("int"), F.col("total"), 10).alias("noisy"),
        F.get(F.filter("order", lambda z: F.array_contains(near, z)), F.lit(0)).alias("reference"),
        F.coalesce("_z0", F.lit(0)).alias("z_start"),
        F.coalesce(F.col("_z1") + 1, F.col("total")).alias("z_end"))


def selection_rows(selection: DataFrame, keys=("c",)) -> DataFrame:
    """(keys, frame_type, slice_index) in 1-based text form for export."""
    text = lambda a: F.array_join(F.transform(a, lambda z: (z + 1).cast("string")), ",")
    row = lambda name, value: F.struct(F.lit(name).alias("frame_type"), value.alias("slice_index"))
    rows = F.array(
        row("clean frame", text("clean")),
        row("noisy frame", text("noisy")),
        row("reference frame", (F.col("reference") + 1).cast("string")),
        row("Target range", F.concat_ws(",", (F.col("z_start") + 1).cast("string"),
                                        F.col("z_end").cast("string"))))
    return selection.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
