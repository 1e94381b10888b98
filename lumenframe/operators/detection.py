"""Component-based punctum detection.

Threshold, 3-D components, size filter, measures. This is a plain detector in
place of a closed one whose method is not published with its parameters; no
equivalence is claimed.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.components import BLOCK, contract, label_components
from lumenframe.session import cut

SEED_SIZE = 6                # fixed value: smallest component kept
_Y, _Z = 1 << 32, 1 << 64    # node number = z * 2^64 + y * 2^32 + x of a region's first pixel


def label_volume(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """(z, y, x, v, label): 26-connected components of one channel's mask.

    Slices are labelled first; regions of neighbouring slices that touch are
    linked, and only those links are contracted.
    """
    plane = label_components(mask, ["z"], 8, block).select(
        "z", "y", "x", (F.col("z").cast("decimal(11,0)") * F.lit(Decimal(_Z))
                        + F.col("label").cast("decimal(20,0)")).cast("decimal(38,0)").alias("node"))
    plane = cut(plane.join(mask.select("z", "y", "x", "v"), ["z", "y", "x"]))
    near = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"))
                     for a in (-1, 0, 1) for b in (-1, 0, 1)])
    above = (plane.withColumn("_n", F.explode(near))
             .select((F.col("z") + 1).alias("z"), (F.col("y") + F.col("_n.dy")).alias("y"),
                     (F.col("x") + F.col("_n.dx")).alias("x"), F.col("node").alias("w")))
    links = cut(above.join(plane.select("z", "y", "x", F.col("node").alias("u")), ["z", "y", "x"])
                .select("u", "w").distinct())
    if links.isEmpty():
        return plane.withColumnRenamed("node", "label")
    roots = contract(links, []).withColumnRenamed("label", "node")
    return (plane.join(roots, "node", "left")
            .select("z", "y", "x", "v", F.coalesce("root", "node").alias("label")))


def measure(labelled: DataFrame, seed_size: int = SEED_SIZE) -> DataFrame:
    """Puncta of at least ``seed_size`` voxels; every measure combines map-side.

    The box (x_min .. y_max, n_voxels) replaces a voxel list, which a large
    component would make unbounded.
    """
    mid = lambda a: (F.sum(F.col(a) * F.col("v").cast("double")) / F.sum("v")).alias(a)
    m = labelled.groupBy("label").agg(
        mid("x"), mid("y"), mid("z"), F.count(F.lit(1)).alias("vol_size"),
        F.sum("v").cast("double").alias("mass"), F.avg("v").alias("mean_intensity"),
        F.max("v").cast("double").alias("max_intensity"), F.stddev_pop("v").alias("sd_intensity"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return (m.filter(F.col("vol_size") >= seed_size)
            .select(F.col("label").alias("punctum_id"), "x", "y", "z",
                    (F.col("mean_intensity") / F.col("max_intensity")).alias("score"),
                    F.cbrt(F.col("vol_size") * 3.0 / (4.0 * F.pi())).alias("radius"), "vol_size", "mass",
                    "mean_intensity", "max_intensity", "sd_intensity",
                    F.col("vol_size").cast("int").alias("n_voxels"), "x_min", "x_max", "y_min", "y_max"))


def detect(mask: DataFrame, seed_size: int = SEED_SIZE, block: int = BLOCK) -> DataFrame:
    return measure(label_volume(mask, block), seed_size)
