"""Image and puncta views over Parquet tables.

``tiles`` keeps one row per camera tile with its pixels in an array; ``voxels``
unfolds it. Placement of a tile is arithmetic on its id, so building the view
is a scan plus projection: no window, no shuffle, and only the two columns
that are needed leave the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = 5          # channels of the view
TILE = 8              # tile side in pixels (64 values)
PLANE_TILES = 2       # tiles per plane side
PLANE = TILE * PLANE_TILES
PUNCTA_DEPTH = 30     # z range of the puncta view; may exceed the image depth


def _level(e):
    """A value in [-1, 1] as a 16-bit pixel."""
    return F.floor((e.cast("double") + 1) * 32767.5).cast("int")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, z, ty, tx, px array<int>): 16-bit tiles from the embedding table."""
    t = F.expr(f"vec_id div {CHANNELS}")
    in_plane = PLANE_TILES * PLANE_TILES
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        (F.col("vec_id") % CHANNELS + 1).cast("int").alias("c"),
        F.floor(t / in_plane).cast("int").alias("z"),
        F.floor((t % in_plane) / PLANE_TILES).cast("int").alias("ty"),
        (t % PLANE_TILES).cast("int").alias("tx"),
        F.transform("embedding", _level).alias("px"),
    )


def unfold(tile_df: DataFrame, stride: int = TILE, **more: Column) -> DataFrame:
    """Tiles to voxels. A stride below the tile side makes tiles overlap.

    ``more`` are further columns by name, in terms of the place ``_i`` in the tile.
    """
    other = [c for c in tile_df.columns if c not in ("ty", "tx", "px")]
    return (
        tile_df.select("*", F.posexplode("px").alias("_i", "v"))
        .select(*other,
                (F.col("ty") * stride + F.floor(F.col("_i") / TILE)).cast("int").alias("y"),
                (F.col("tx") * stride + F.col("_i") % TILE).cast("int").alias("x"),
                "v", *[expr.alias(name) for name, expr in more.items()])
    )


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, z, y, x, v int) with v in 0..65535."""
    t, side = F.expr(f"vec_id div {CHANNELS}"), PLANE_TILES
    ty = F.floor((t % (side * side)) / side)
    cell = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.posexplode("embedding").alias("_i", "_e"))
    return cell.select(
        (F.col("vec_id") % CHANNELS + 1).cast("int").alias("c"),
        F.floor(t / (side * side)).cast("int").alias("z"),
        (ty * TILE + F.floor(F.col("_i") / TILE)).cast("int").alias("y"),
        (t % side * TILE + F.col("_i") % TILE).cast("int").alias("x"),
        _level(F.col("_e")).alias("v"))


def image_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row (depth, height, width): reads tile ids only."""
    return tiles(spark, sf_dir).agg(
        (F.max("z") + 1).cast("int").alias("depth"),
        F.lit(PLANE).alias("height"), F.lit(PLANE).alias("width"))


def puncta(spark: SparkSession, sf_dir: str, boxed: bool = False) -> DataFrame:
    """Every event as a punctum whose voxels are a 3x3 block clipped to the plane.

    ``boxed``: with the block's box and size, as detection writes them, in
    place of the list, which costs far more than the rest of a row.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("punctum_id"),
        (F.col("user_id") % PLANE).cast("int").alias("x"),
        (F.col("event_id") % PLANE).cast("int").alias("y"),
        (F.floor(F.col("event_id") / PLANE) % PUNCTA_DEPTH).cast("int").alias("z"),
        F.col("value").alias("mass"))
    lo = lambda c: F.greatest(F.col(c) - 1, F.lit(0))
    hi = lambda c: F.least(F.col(c) + 1, F.lit(PLANE - 1))
    if boxed:
        size = (hi("y") - lo("y") + 1) * (hi("x") - lo("x") + 1)
        return e.withColumns({"n_voxels": size.cast("int"), "x_min": lo("x"), "x_max": hi("x"), "y_min": lo("y"), "y_max": hi("y")})
    block = F.flatten(F.transform(F.sequence(lo("y"), hi("y")), lambda yy: F.transform(
        F.sequence(lo("x"), hi("x")),
        lambda xx: F.struct(xx.alias("x"), yy.alias("y"), F.col("z").alias("z")))))
    return e.withColumn("voxels", block)
