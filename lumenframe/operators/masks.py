"""Sparse binary masks: one row per set voxel, set operations as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.relational import attach

# fixed values: structuring elements as (dz, dy, dx) offsets
CROSS = [(0, -1, 0), (0, 0, -1), (0, 0, 0), (0, 0, 1), (0, 1, 0)]
CUBE = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def above_threshold(voxels: DataFrame, thresholds: DataFrame, keys=("c",)) -> DataFrame:
    """Voxels strictly above their group's threshold; groups without one drop out.

    The filter runs right after the scan, so later shuffles carry set voxels only.
    """
    return attach(voxels, thresholds.select(*keys, "thr"), list(keys)).filter("v > thr").drop("thr")


def spread(mask: DataFrame, offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Every set voxel at every offset (a bag)."""
    steps = F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(d).alias("dx"))
                      for a, b, d in offsets])
    moved = mask.withColumn("_o", F.explode(steps))
    return moved.withColumns({a: (F.col(a) + F.col(f"_o.d{a}")) for a in ("z", "y", "x")}).drop("_o")


def erode(mask: DataFrame, keys=("c",), offsets=CROSS) -> DataFrame:
    """Voxels whose whole neighbourhood is set; outside the image counts as unset."""
    cols = [*keys, "z", "y", "x"]
    return (spread(mask.select(*cols), offsets).groupBy(*cols)
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(offsets)).drop("_n"))


def dilate(mask: DataFrame, info: DataFrame, keys=("c",), offsets=CROSS) -> DataFrame:
    """Union of the neighbourhoods, clipped to the image."""
    cols = [*keys, "z", "y", "x"]
    grown = attach(spread(mask.select(*cols), offsets), info, [])
    for axis, side in (("z", "depth"), ("y", "height"), ("x", "width")):
        grown = grown.filter((F.col(axis) >= 0) & (F.col(axis) < F.col(side)))
    return grown.select(*cols).distinct()


def perimeter(mask: DataFrame, keys=("c",)) -> DataFrame:
    """Set voxels that erosion by a cross removes."""
    return mask.join(erode(mask, keys), [*keys, "z", "y", "x"], "left_anti")


def pair_overlap(mask: DataFrame, keys=()) -> DataFrame:
    """Jaccard and Dice of every channel pair over shared positions.

    One shuffle on the position gathers the channels set there (at most five);
    pairs and singles are then counted with map-side combining, so the join of
    the mask with itself never happens.
    """
    keys = list(keys)
    at = mask.groupBy(*keys, "z", "y", "x").agg(F.array_sort(F.collect_set("c")).alias("cs"))
    combos = F.flatten(F.transform("cs", lambda a: F.transform(
        F.filter("cs", lambda b: b >= a), lambda b: F.struct(a.alias("c1"), b.alias("c2")))))
    counts = (at.select(*keys, F.explode(combos).alias("p"))
              .groupBy(*keys, "p.c1", "p.c2").agg(F.count(F.lit(1)).alias("n")))
    # at most 15 counts per key from here on: plain array work, no join
    table = F.map_from_entries(F.collect_list(F.struct(F.struct("c1", "c2"), "n")))
    cs = F.array_sort(F.collect_set("c1"))
    per = counts.groupBy(*keys).agg(table.alias("_n"), cs.alias("cs"))
    pairs = per.select(*keys, "_n", F.explode(F.flatten(F.transform("cs", lambda a: F.transform(
        F.filter("cs", lambda b: b > a), lambda b: F.struct(a.alias("c1"), b.alias("c2")))))).alias("p"))
    size = lambda a, b: F.coalesce(F.try_element_at("_n", F.struct(
        F.col(a).alias("c1"), F.col(b).alias("c2"))), F.lit(0)).cast("long")
    n, s1, s2 = F.col("inter"), F.col("size1"), F.col("size2")
    return (pairs.select(*keys, "_n", "p.c1", "p.c2")
            .select(*keys, "c1", "c2", size("c1", "c1").alias("size1"), size("c2", "c2").alias("size2"),
                    size("c1", "c2").alias("inter"))
            .withColumns({"uni": s1 + s2 - n, "jaccard": n / (s1 + s2 - n), "dice": 2 * n / (s1 + s2)}))
