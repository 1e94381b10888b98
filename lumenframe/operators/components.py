"""Connected components and region measures on sparse masks.

A slice may hold any number of set pixels, so no slice goes to one task.
Pixels are labelled inside fixed-size blocks, blocks are stitched by joining
border pixels only, and the resulting label graph is contracted with
distributed min-label rounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.raster import component_labels
from lumenframe.model import ENTROPY_EPS, THICKNESS_EPS, MorphologySettings
from lumenframe.operators.masks import CUBE, dilate
from lumenframe.operators.relational import by_key
from lumenframe.session import cut

BLOCK = 256                     # at most 65,536 pixels per block
_ROW = 1 << 32                  # label = y * 2^32 + x of a component's first pixel


def _label_blocks(batches, connectivity):
    for batch in batches:
        lists = batch.column("px")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        group = np.repeat(np.arange(len(sizes)), sizes)
        roots = component_labels(group, flat // _ROW, flat % _ROW, connectivity)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        labels = pa.ListArray.from_arrays(offsets, pa.array(flat[roots], pa.int64()))
        cols = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*cols, labels], names=[*batch.schema.names, "label"])


def label_in_blocks(mask: DataFrame, keys: Sequence[str], connectivity: int, block: int) -> DataFrame:
    """(keys, y, x, label) with labels unique within (keys, block)."""
    placed = mask.withColumns({"_by": F.floor(F.col("y") / block), "_bx": F.floor(F.col("x") / block)})
    packed = (by_key(placed, [*keys, "_by", "_bx"]).groupBy(*keys, "_by", "_bx")
              .agg(F.collect_list(F.col("y").cast("long") * _ROW + F.col("x")).alias("px")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema)
    labelled = packed.mapInArrow(lambda it: _label_blocks(it, connectivity), f"{fields}, label array<bigint>")
    return (labelled.select(*keys, F.explode(F.arrays_zip("px", "label")).alias("_p"))
            .select(*keys, F.floor(F.col("_p.px") / _ROW).cast("int").alias("y"),
                    (F.col("_p.px") % _ROW).cast("int").alias("x"), F.col("_p.label").alias("label")))


def _border_links(labelled: DataFrame, keys: Sequence[str], connectivity: int, block: int) -> DataFrame:
    """Distinct label pairs that touch across a block border."""
    m = block - 1
    edge = labelled.filter(
        (F.col("y") % block).isin(0, m) | (F.col("x") % block).isin(0, m))
    steps = [(0, 1), (1, 0)] if connectivity == 4 else [(0, 1), (1, -1), (1, 0), (1, 1)]
    hops = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps])
    reach = (edge.withColumn("_h", F.explode(hops))
             .withColumns({"ny": F.col("y") + F.col("_h.dy"), "nx": F.col("x") + F.col("_h.dx")})
             .filter((F.floor(F.col("ny") / block) != F.floor(F.col("y") / block))
                     | (F.floor(F.col("nx") / block) != F.floor(F.col("x") / block)))
             .select(*keys, F.col("ny").alias("y"), F.col("nx").alias("x"), F.col("label").alias("la")))
    return (reach.join(edge.select(*keys, "y", "x", F.col("label").alias("lb")), [*keys, "y", "x"])
            .select(*keys, F.greatest("la", "lb").alias("u"), F.least("la", "lb").alias("w"))
            .filter("u <> w").distinct())


def contract(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, label, root): smallest label reachable, by alternating star rounds.

    ``links`` (keys, u, w) with u > w should be materialised.

    Both star steps (Kiveris et al., 2014) reduce a node's neighbours to their
    minimum with map-side combining and join that back on the node; a hub node
    is an ordinary skewed join key, which adaptive execution splits. Each
    round is checkpointed, so lineage stays one round deep. Only border labels
    take part, never pixels.
    """
    keys = list(keys)
    edges = links
    last = None
    while True:
        sym = edges.unionByName(edges.select(*keys, F.col("w").alias("u"), F.col("u").alias("w")))
        low = sym.groupBy(*keys, "u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = (sym.filter("w > u").join(low, [*keys, "u"])
                 .select(*keys, F.col("w").alias("u"), F.col("m").alias("w")).distinct())
        down = large.groupBy(*keys, "u").agg(F.min("w").alias("m"))
        small = (large.join(down, [*keys, "u"]).filter("w <> m")
                 .select(*keys, F.col("w").alias("u"), F.col("m").alias("w"))
                 .unionByName(down.select(*keys, "u", F.col("m").alias("w"))).distinct())
        edges = cut(small)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*keys, "u", "w").cast("decimal(38,0)"))
                          .alias("h")).first()
        if state == last:
            return edges.select(*keys, F.col("u").alias("label"), F.col("w").alias("root"))
        last = state


def label_components(mask: DataFrame, keys: Sequence[str] = ("c", "z"), connectivity: int = 8,
                     block: int = BLOCK, spans_blocks: bool = True) -> DataFrame:
    """(keys, y, x, label): 2-D components per slice, label = smallest y * 2^32 + x.

    ``spans_blocks=False`` states that no group crosses a block (small ROIs
    with local coordinates) and skips the stitching.
    """
    keys = list(keys)
    cols = [*keys, "y", "x"]
    labelled = label_in_blocks(mask.select(*cols), keys, connectivity, block)
    if not spans_blocks:
        return labelled
    labelled = cut(labelled)
    links = cut(_border_links(labelled, keys, connectivity, block))
    if links.isEmpty():
        return labelled
    roots = contract(links, keys)
    return (labelled.join(roots, [*keys, "label"], "left")
            .select(*cols, F.coalesce("root", "label").alias("label")))


# ------------------------------------------------------------ region measures
def regions(labelled: DataFrame, keys: Sequence[str] = ("c", "z")) -> DataFrame:
    """One row per component: area, bounding box and second moments."""
    return labelled.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.sum(F.col("y").cast("long")).alias("sy"), F.sum(F.col("x").cast("long")).alias("sx"),
        F.sum(F.col("y").cast("long") * F.col("y")).alias("syy"),
        F.sum(F.col("x").cast("long") * F.col("x")).alias("sxx"),
        F.sum(F.col("x").cast("long") * F.col("y")).alias("sxy"))


def with_eccentricity(regions_df: DataFrame) -> DataFrame:
    """Eccentricity of the ellipse with the region's second moments (0 for a point).

    Moments come from exact integer sums scaled by the squared area.
    """
    a = F.col("area").cast("double")
    vy = (F.col("area") * F.col("syy") - F.col("sy") * F.col("sy")).cast("double")
    vx = (F.col("area") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")
    vxy = (F.col("area") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double")
    # unit-square pixels add 1/12 per axis in some definitions; plain pixel moments are used here
    gap = F.sqrt((vy - vx) * (vy - vx) + 4 * vxy * vxy)
    big, small = (vy + vx + gap) / 2 / (a * a), (vy + vx - gap) / 2 / (a * a)
    return regions_df.withColumn("eccentricity", F.when(
        big > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - small / big))).otherwise(F.lit(0.0)))


def with_entropy(regions_df: DataFrame) -> DataFrame:
    """-ln(sd_y * sd_x + eps) of a region's pixels; 0 for a single pixel."""
    a = F.col("area").cast("double")
    sd = lambda s2, s1: F.sqrt((F.col("area") * F.col(s2) - F.col(s1) * F.col(s1)).cast("double")) / a
    return regions_df.withColumn("entropy", F.when(
        F.col("area") > 1, -F.ln(sd("syy", "sy") * sd("sxx", "sx") + ENTROPY_EPS)).otherwise(F.lit(0.0)))


def largest(regions_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The biggest component per group; ties go to the smallest label."""
    rest = [c for c in regions_df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("area"), -F.col("label")))
    return regions_df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def with_kind(regions_df: DataFrame, settings: MorphologySettings = MorphologySettings()) -> DataFrame:
    """Add thickness, is_axon, is_dendrite; regions between the bounds are both."""
    side = F.greatest(F.col("y_max") - F.col("y_min"), F.col("x_max") - F.col("x_min")) + 1
    t, m = settings.thickness_thresh, settings.soft_margin
    thick = F.col("thickness")
    return (regions_df.withColumn("thickness", F.col("area") / (side + THICKNESS_EPS))
            .withColumn("is_axon", F.when(thick >= t + m, 0).otherwise(1))
            .withColumn("is_dendrite", F.when(thick >= t + m, 1).when(thick <= t - m, 0).otherwise(1)))


def separate_neurites(mask: DataFrame, info: DataFrame, settings: MorphologySettings = MorphologySettings(),
                      block: int = BLOCK) -> DataFrame:
    """Sparse (z, y, x, is_axon, is_dendrite) from one channel's mask.

    Per-slice 8-connected regions are split by thickness; the axon part is
    then grown by a 3x3x3 cube. A voxel may be in both.
    """
    labelled = label_components(mask, ["z"], 8, block)
    kinds = with_kind(regions(labelled, ["z"]), settings).select("z", "label", "is_axon", "is_dendrite")
    marked = labelled.join(kinds, ["z", "label"])
    axon = dilate(marked.filter("is_axon = 1"), info, keys=(), offsets=CUBE)
    both = (axon.select("z", "y", "x", F.lit(1).alias("is_axon"), F.lit(0).alias("is_dendrite"))
            .unionByName(marked.filter("is_dendrite = 1").select(
                "z", "y", "x", F.lit(0).alias("is_axon"), F.lit(1).alias("is_dendrite"))))
    return both.groupBy("z", "y", "x").agg(F.max("is_axon").alias("is_axon"),
                                           F.max("is_dendrite").alias("is_dendrite"))
