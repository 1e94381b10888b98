"""Shading correction of tiled images, each as one plan."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.model import FlatfieldSettings
from lumenframe.operators import enhance as E
from lumenframe.operators import image as I
from lumenframe.operators import shading as SH

METHODS = ("annotation", "annotation_interpolate", "base")


def full_correction(tiles: DataFrame, flatfield: DataFrame, side: int, stride: int, max_value: int, *,
                    invert: Collection[int] = (), background: Collection[int] = (), method: str = "annotation",
                    mask: DataFrame | None = None, base: DataFrame | None = None, overlap: float = 0.05,
                    normalize: Collection[int] = (), clip_limit: float = 0.01, kernel: tuple[int, int] | None = None,
                    shape: tuple[int, int] | None = None, keys=("c", "z")) -> DataFrame:
    """(keys, y, x, v int): dark field, flat field, background, stitching, clipping, normalisation.

    ``tiles`` (keys, ty, tx, px) are square and ``stride`` pixels apart.
    Channels in ``invert`` are corrected on their inverse and turned back.
    Channels in ``background`` lose it by one of three methods: the median of
    a tile's pixels outside ``mask`` (y, x), taken from these pixels; the same
    medians interpolated over the grid of tiles, taken from all pixels; or
    ``base`` (keys, ty, tx, base), taken from all pixels. Channels in
    ``normalize`` are equalised adaptively (whole images of ``shape``) before
    an inverse is turned back.
    """
    if method not in METHODS:
        raise ValueError(f"unknown background method {method!r}")
    keys, tile = list(keys), [*keys, "ty", "tx"]
    chosen = lambda channels: F.col("c").isin(*channels) if channels else F.lit(False)
    turned = F.when(chosen(invert), F.transform("px", lambda v: max_value - v)).otherwise(F.col("px"))
    flat = SH.correct_tiles(tiles.withColumn("px", turned), flatfield, None)
    slot, slots = I.tile_slot(F.floor(F.col("_i") / side), F.col("_i") % side, side, side, stride)
    at = flat.select(*tile, F.posexplode("px").alias("_i", "v")).select(
        *tile, slot.alias("slot"), (F.col("ty") * stride + F.floor(F.col("_i") / side)).cast("int").alias("y"),
        (F.col("tx") * stride + F.col("_i") % side).cast("int").alias("x"), "v")
    mine, others = at.filter(chosen(background)), at.filter(~chosen(background))
    if background and method == "annotation":
        mine = SH.subtract_background(mine, mask, SH.tile_background(mine, mask, tile), tile)
    elif background:
        if method == "base":
            level = base.select(*tile, F.col("base").alias("background"))
        else:
            cell = lambda t: SH.grid_cell(F.col(t) * stride, F.col(t) * stride + side, side, overlap)
            place = flat.filter(chosen(background)).select(*tile, cell("ty").alias("gy"), cell("tx").alias("gx"))
            known = place.join(SH.tile_background(mine, mask, tile), tile).select(*keys, "gy", "gx", "background")
            level = place.join(SH.interpolate_background(known, place, keys), [*keys, "gy", "gx"]).select(*tile, "background")
        mine = SH.attach(mine, level, tile, "left").withColumn("v", F.col("v") - F.coalesce("background", F.lit(0.0)))
    whole = I.stitch(mine.select(*at.columns).unionByName(others), [k for k in keys if k != "z"], slots)
    whole = whole.select(*keys, "y", "x", I.clip_pixel(F.col("v"), max_value).alias("v"))
    if normalize:
        if shape is None:
            raise ValueError("normalisation needs the shape of the whole image")
        even = E.equalize_adaptive(whole.filter(chosen(normalize)), *shape, max_value, clip_limit, kernel, keys)
        whole = even.unionByName(whole.filter(~chosen(normalize)))
    v = F.col("v")
    back = F.when(v == 0, 0).otherwise(max_value - v)  # nothing stays nothing
    return whole.select(*keys, "y", "x", F.when(chosen(invert), back).otherwise(v).alias("v"))


def entry_correction(tiles: DataFrame, shape: tuple[int, int], stride: int, max_value: int, *, channels: Collection[int] | None = None,
                     ratio: int = 4, field: DataFrame | None = None, keys=("c",), image=("c", "z")) -> DataFrame:
    """(image, y, x, v int): the plain correction flow on tile rows (keys, ..., ty, tx, px).

    A field is fitted to tiles decimated by ``ratio`` (or given at that size),
    widened to the tile's size by cubic convolution, and the full tiles of the
    chosen channels (None: all) are divided by it, saturated pixels left alone.
    Tiles are averaged where they overlap, clipped and cut to integers.
    """
    small = tuple(-(-n // ratio) for n in shape)
    chosen = F.col("c").isin(*channels) if channels is not None else F.lit(True)
    if field is None:
        settings = FlatfieldSettings(working_size=small[0])
        field = SH.estimate_flatfield(SH.decimate_tiles(tiles.filter(chosen), shape, ratio), small, settings, keys)
    flat = SH.correct_tiles(tiles, SH.resize_field(field, small, shape), max_value)
    rows, cols = shape
    slot, slots = I.tile_slot(F.floor(F.col("_i") / cols), F.col("_i") % cols, rows, cols, stride)
    at = flat.select(*image, "ty", "tx", F.posexplode("px").alias("_i", "v")).select(
        *image, slot.alias("slot"), (F.col("ty") * stride + F.floor(F.col("_i") / cols)).cast("int").alias("y"),
        (F.col("tx") * stride + F.col("_i") % cols).cast("int").alias("x"), "v")
    return I.stitch(at, [k for k in image if k != "z"], slots).select(*image, "y", "x", I.clip_pixel(F.col("v"), max_value).alias("v"))
