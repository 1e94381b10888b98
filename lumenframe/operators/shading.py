"""Flatfield estimation and shading correction.

Training images are rows with a pixel array of at most working_size^2 values.
All stacks (a channel, or scene and channel) are fitted in one plan: the field
of every stack is a row of a small table that is joined to the blocks of
images, one aggregate per round adds up what all blocks say about their
stacks, and the next fields follow from it in tasks. The driver sees how many
stacks are still moving, nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import lowrank as L
from lumenframe.functions.resample import resize_matrix, resize_stack
from lumenframe.model import FlatfieldSettings
from lumenframe.operators.image import clip_pixel, saturate, stitch
from lumenframe.operators.relational import attach
from lumenframe.session import cut

BLOCK_VALUES = 1 << 20       # pixel values of the images that are held against a field together


def resize_tiles(tiles: DataFrame, shape: tuple[int, int], out: tuple[int, int], kind: str = "linear",
                 antialias: bool = True) -> DataFrame:
    """Resize the ``px`` array of every tile row; batches are matrix products, no shuffle."""
    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("px")
            stack = batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, *shape)
            small = resize_stack(stack, *out, kind, antialias)
            size = out[0] * out[1]
            px = pa.ListArray.from_arrays(pa.array(np.arange(len(small) + 1) * size, pa.int32()), pa.array(small.ravel()))
            yield pa.RecordBatch.from_arrays(
                [px if k == i else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)

    schema = ", ".join(f"{f.name} {'array<double>' if f.name == 'px' else f.dataType.simpleString()}"
                       for f in tiles.schema)
    return tiles.mapInArrow(run, schema)


def decimate_tiles(tiles: DataFrame, shape: tuple[int, int], ratio: int) -> DataFrame:
    """Block means of ``ratio`` x ``ratio`` pixels in every tile row, as tiles are read; the last blocks may be smaller."""
    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("px")
            stack = _matrix(batch.column(i)).astype(float).reshape(-1, *shape)
            for axis in (1, 2):
                at = np.arange(0, shape[axis - 1], ratio)
                size = np.diff(np.append(at, shape[axis - 1]))
                stack = np.add.reduceat(stack, at, axis=axis) / (size[:, None] if axis == 1 else size)
            px = _lists(list(stack.reshape(len(stack), -1)))
            yield pa.RecordBatch.from_arrays(
                [px if k == i else batch.column(k) for k in range(batch.num_columns)], names=batch.schema.names)
    rest = [c for c in tiles.columns if c != "px"]
    return tiles.select(*rest, "px").mapInArrow(run, _schema(tiles, rest, "px array<double>"))


def resize_field(field: DataFrame, small: tuple[int, int], shape: tuple[int, int], a: float = -0.75) -> DataFrame:
    """A field (keys, y, x, flat) of size ``small`` at size ``shape`` by cubic convolution, as a join with its weights."""
    keys = [k for k in field.columns if k not in ("y", "x", "flat", "dark")]
    out = field.select(*keys, "y", "x", "flat")
    for axis, n, m in (("y", small[0], shape[0]), ("x", small[1], shape[1])):
        w = resize_matrix(n, m, "cubic", False, a)
        weight = field.sparkSession.createDataFrame([(i, o, float(w[o, i])) for o in range(m) for i in range(n) if w[o, i]], "_i int, _o int, _w double")
        other = "x" if axis == "y" else "y"
        out = (out.join(F.broadcast(weight), F.col(axis) == F.col("_i")).groupBy(*keys, other, F.col("_o").alias("_to"))
               .agg(F.sum(F.col("flat") * F.col("_w")).alias("flat")).withColumnRenamed("_to", axis))
    return out.select(*keys, "y", "x", "flat")


def order_rows(stack: DataFrame, keys=("c",), crowded: bool = False) -> DataFrame:
    """(keys, r, px): row r holds every pixel's r-th smallest value over the images.

    Plain ranking is per (keys, pixel). ``crowded`` stacks are ranked in two
    steps instead: a range partitioning cuts even one pixel's values (ties
    included) into even pieces, pieces are counted, and a value's rank is its
    piece's offset plus its place inside.
    """
    keys = list(keys)
    pixel = [*keys, "i"]
    if not crowded:
        cells = stack.select(*keys, F.posexplode("px").alias("i", "v"))
        ranked = cells.withColumn("r", F.row_number().over(Window.partitionBy(*pixel).orderBy("v")))
    else:
        tie = F.xxhash64("px")
        parts = int(stack.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        cells = stack.select(*keys, tie.alias("_t"), F.posexplode("px").alias("i", "v"))
        cells = cut(cells.repartitionByRange(parts, *pixel, "v", "_t").withColumn("_part", F.spark_partition_id()))
        counts = cells.groupBy(*pixel, "_part").agg(F.count(F.lit(1)).alias("n"))  # pieces, not values
        upto = Window.partitionBy(*pixel).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select(*pixel, "_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_o"))
        place = F.row_number().over(Window.partitionBy(*pixel, "_part").orderBy("v", "_t"))
        ranked = cells.withColumn("_p", place).join(offsets, [*pixel, "_part"]).withColumn(
            "r", F.col("_p") + F.col("_o"))
    return (ranked.groupBy(*keys, "r")
            .agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_p"))
            .select(*keys, "r", F.col("_p.v").alias("px")))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def image_blocks(stack: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, px): images of a stack put together, so that a field meets a block and not every image."""
    def run(batches):
        for batch in batches:
            groups: dict = {}
            for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys])):
                groups.setdefault(key, []).append(i)
            px = batch.column("px")
            for rows in groups.values():
                most = max(1, BLOCK_VALUES // max(1, len(px[rows[0]])))
                for a in range(0, len(rows), most):
                    some = pa.array(rows[a:a + most])
                    flat = px.take(some).flatten()
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(some[:1]) for k in keys],
                         pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=[*keys, "px"])
    return stack.select(*keys, "px").mapInArrow(run, _schema(stack, keys, "px array<double>"))


def _schema(df: DataFrame, keys, rest: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], rest])


def _vector(column, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def fit_fields(stack: DataFrame, side: int, settings: FlatfieldSettings, keys=("c",)) -> DataFrame:
    """(keys, flat, dark, converged): the fields of all stacks from images (keys, px) of side x side pixels."""
    keys, size, names = list(keys), side * side, L.sum_names(settings)
    blocks = cut(image_blocks(stack, keys))
    same = lambda v: F.array_repeat(F.lit(v), size)
    fields = cut(blocks.groupBy(*keys).agg(F.min(F.array_min("px")).alias("low"))
                 .select(*keys, "low", same(1.0).alias("flat"), same(0.0).alias("dark"), F.lit(0.0).alias("centre"), F.lit(False).alias("converged")))

    def say(batches):
        for batch in batches:
            at, out = np.arange(size, dtype=np.int32), []
            for i in range(batch.num_rows):
                out.append(L.pixel_sums(_vector(batch.column("px"), i).reshape(-1, size), _vector(batch.column("flat"), i),
                                        _vector(batch.column("dark"), i), batch.column("centre")[i].as_py(), settings))
            if out:
                which = pa.array(np.repeat(np.arange(len(out)), size))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(which) for k in keys], pa.array(np.tile(at, len(out))),
                     *[pa.array(np.concatenate([o[j] for o in out])) for j in range(len(names))]], names=[*keys, "i", *names])

    def move(batches):
        for batch in batches:
            flats, darks, centres, still = [], [], [], []
            for i in range(batch.num_rows):
                sums = np.stack([_vector(batch.column(s), i) for s in names])
                flat, dark, centre, moved = L.update(sums, _vector(batch.column("flat"), i), _vector(batch.column("dark"), i),
                                             batch.column("low")[i].as_py(), side, settings)
                flats.append(flat)
                darks.append(dark)
                centres.append(centre)
                still.append(moved <= settings.tolerance)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], batch.column("low"), _lists(flats), _lists(darks), pa.array(centres),
                 pa.array(still, pa.bool_())], names=[*keys, "low", "flat", "dark", "centre", "converged"])

    for _ in range(settings.rounds):
        moving = fields.filter("NOT converged")
        met = attach(blocks, moving.select(*keys, "flat", "dark", "centre"), keys)
        sums = met.mapInArrow(say, _schema(stack, keys, "i int, " + ", ".join(f"{s} double" for s in names)))
        by_pixel = sums.groupBy(*keys, "i").agg(*[F.sum(s).alias(s) for s in names])
        ordered = by_pixel.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", *names))).alias("_p"))  # one per pixel
        vectors = ordered.select(*keys, *[F.col(f"_p.{s}").alias(s) for s in names])
        next_fields = moving.join(vectors, keys).mapInArrow(
            move, _schema(stack, keys, "low double, flat array<double>, dark array<double>, centre double, converged boolean"))
        fields = cut(fields.filter("converged").unionByName(next_fields))
        if fields.filter("NOT converged").isEmpty():
            break
    return fields.drop("low", "centre")


def estimate_flatfield(tiles: DataFrame, shape: tuple[int, int],
                       settings: FlatfieldSettings = FlatfieldSettings(), keys=("c",)) -> DataFrame:
    """(keys, y, x, flat, dark) at tile size from tile rows (keys, px).

    Every key (a channel, or scene and channel) is a stack of its own; a key
    must not be null. Pixels are ranked over the images of their stack first,
    so that what an image shows moves to the ends of the ranks.
    """
    keys, side = list(keys), settings.working_size
    small_images = cut(resize_tiles(tiles.select(*keys, "px"), shape, (side, side)))
    fields = fit_fields(order_rows(small_images, keys, crowded=True), side, settings, keys)

    def widen(batches):
        up = lambda v: resize_stack(v.reshape(side, side), *shape, "cubic", antialias=True)
        for batch in batches:
            flats = [up(_vector(batch.column("flat"), i)) for i in range(batch.num_rows)]
            darks = [up(_vector(batch.column("dark"), i)).ravel() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], _lists([(f / f.mean()).ravel() for f in flats]), _lists(darks)],
                names=[*keys, "flat", "dark"])
    whole = fields.select(*keys, "flat", "dark").mapInArrow(widen, _schema(tiles, keys, "flat array<double>, dark array<double>"))
    cells = whole.select(*keys, F.posexplode(F.arrays_zip("flat", "dark")).alias("_i", "_v"))
    return cells.select(*keys, F.floor(F.col("_i") / shape[1]).cast("int").alias("y"), (F.col("_i") % shape[1]).cast("int").alias("x"),
                        F.col("_v.flat").alias("flat"), F.col("_v.dark").alias("dark"))


def field_arrays(flatfield: DataFrame) -> DataFrame:
    """(keys, _flat, _dark): one array each per key from rows (keys, y, x, flat[, dark])."""
    keys = [k for k in flatfield.columns if k not in ("y", "x", "flat", "dark")]
    dark = F.col("dark") if "dark" in flatfield.columns else F.lit(0.0)
    pixel = F.array_sort(F.collect_list(F.struct("y", "x", F.struct("flat", dark.alias("dark")).alias("f"))))
    return flatfield.groupBy(*keys).agg(F.transform(pixel, lambda p: p["f"]["flat"]).alias("_flat"),
                                        F.transform(pixel, lambda p: p["f"]["dark"]).alias("_dark"))


def apply_flatfield(tile_voxels: DataFrame, flatfield: DataFrame, max_value: int) -> DataFrame:
    """(v - dark) / flat for tile voxels (keys, ..., ly, lx, v); saturated pixels stay.

    The flatfield's own key columns (``c``, or scene and ``c``) choose the
    field; images without one pass through, and a field without ``dark`` has
    none. The lookup is broadcast by its measured size; ``correct_tiles``
    moves no pixel at any size.
    """
    keys = [k for k in flatfield.columns if k not in ("y", "x", "flat", "dark")]
    dark = F.col("dark") if "dark" in flatfield.columns else F.lit(0.0)
    ff = flatfield.select(*keys, F.col("y").alias("ly"), F.col("x").alias("lx"), F.col("flat").alias("_flat"), dark.alias("_dark"))
    corrected = saturate((F.col("v") - F.col("_dark")) / F.col("_flat"), F.col("v"), max_value)
    return attach(tile_voxels, ff, [*keys, "ly", "lx"], "left").select(
        *[F.when(F.col("_flat").isNull(), F.col("v").cast("double")).otherwise(corrected).alias("v") if c == "v" else c
          for c in tile_voxels.columns])


def correct_tiles(tiles: DataFrame, flatfield: DataFrame, max_value: int | None) -> DataFrame:
    """``apply_flatfield`` for tile rows (keys, ..., px): a field is one array per key,
    so only (key, field) rows meet the tiles, never pixels. Without ``max_value``
    saturated pixels are corrected like others."""
    keys = [k for k in flatfield.columns if k not in ("y", "x", "flat", "dark")]
    fields = field_arrays(flatfield)
    plain = F.transform("px", lambda v: v.cast("double"))
    level = F.zip_with(F.zip_with("px", "_dark", lambda v, d: v - d), "_flat", lambda v, f: v / f)
    kept = level if max_value is None else F.zip_with("px", level, lambda v, w: saturate(w, v, max_value))
    return attach(tiles, fields, keys, "left").select(
        *[F.when(F.col("_flat").isNull(), plain).otherwise(kept).alias("px") if c == "px" else c for c in tiles.columns])


def correct_shading(tile_voxels: DataFrame, flatfield: DataFrame, max_value: int, keys=("c",)) -> DataFrame:
    """Flat-field, stitch, clip and truncate: (keys, z, y, x, v int)."""
    done = stitch(apply_flatfield(tile_voxels, flatfield, max_value), keys)
    return done.withColumn("v", clip_pixel(F.col("v"), max_value)).drop("coverage")


# ------------------------------------------------------------------ background
def grid_cell(start: Column, end: Column, size: int, overlap: float) -> Column:
    """Index of a tile on the acquisition grid from its extent."""
    middle = ((end + start) / 2.0 - size * overlap).cast("int")
    return F.floor(middle / int(size * (1 - 2 * overlap))).cast("int")


def tile_background(tile_voxels: DataFrame, mask: DataFrame, keys, max_share: float = 0.9) -> DataFrame:
    """(keys, background): median of a tile's pixels outside the mask.

    Only tiles less than ``max_share`` covered have one. ``mask`` is sparse
    (y, x) in image coordinates; a tile bounds the group size.
    """
    keys = list(keys)
    marked = tile_voxels.join(mask.select("y", "x").withColumn("_in", F.lit(1)), ["y", "x"], "left")
    return (marked.groupBy(*keys).agg(F.median(F.when(F.col("_in").isNull(), F.col("v"))).alias("background"),
                                      F.avg(F.coalesce("_in", F.lit(0))).alias("_share"))
            .filter((F.col("_share") < max_share) & F.col("background").isNotNull()).drop("_share"))


def subtract_background(tile_voxels: DataFrame, mask: DataFrame, background: DataFrame, keys) -> DataFrame:
    """Subtract a tile's background from its pixels outside the mask."""
    keys = list(keys)
    marked = tile_voxels.join(mask.select("y", "x").withColumn("_in", F.lit(1)), ["y", "x"], "left")
    return (marked.join(background, keys, "left")
            .withColumn("v", F.when(F.col("_in").isNull(), F.col("v") - F.coalesce("background", F.lit(0.0)))
                        .otherwise(F.col("v").cast("double"))).drop("_in", "background"))


def interpolate_background(grid: DataFrame, wanted: DataFrame, keys=("c", "z")) -> DataFrame:
    """(keys, gy, gx, background) at ``wanted`` cells by a cubic radial basis through ``grid``.

    One solve per grid (a slice of a scene and channel): a group holds one row
    per tile of a slice, whatever the depth of the stack.
    """
    keys = list(keys)

    def fit(key, ask, known):
        pts, val = known[["gy", "gx"]].to_numpy(float), known["background"].to_numpy(float)
        at = ask[["gy", "gx"]].to_numpy(float)
        dist = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) ** 3
        out = ask[[*keys, "gy", "gx"]].copy()
        if len(pts):
            out["background"] = dist(at, pts) @ np.linalg.lstsq(dist(pts, pts), val, rcond=None)[0] \
                if len(pts) > 1 else val[0]
        else:
            out["background"] = 0.0
        return out

    # Names of its own: both sides may come from the same tiles.
    known = grid.filter("background <> 0").select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(c).alias(c) for c in ("gy", "gx", "background")])
    cells = wanted.select(*keys, "gy", "gx").distinct()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema)
    return cells.groupBy(*keys).cogroup(known.groupBy(*[f"_{k}" for k in keys])).applyInPandas(fit, f"{kinds}, background double")


def base_fluorescence(tiles: DataFrame, shape: tuple[int, int], field: DataFrame, working_size: int = 128,
                      rounds: int = 50, epsilon: float = 0.1, tolerance: float = 1e-6) -> DataFrame:
    """(..., base, converged): background level of every tile row (keys, ..., px), given its flatfield.

    ``field`` (keys, y, x, flat[, dark]) chooses by its own key columns; a tile
    without a field is an error. A tile's level is its brightness under the
    field, where pixels far from it hardly count; tiles do not depend on each
    other, so this is one map over rows that a field array was joined to.
    """
    side = working_size
    keys = [k for k in field.columns if k not in ("y", "x", "flat", "dark")]
    ids = [c for c in tiles.columns if c != "px"]
    small = resize_tiles(attach(tiles, field_arrays(field), keys, "left"), shape, (side, side))
    named = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    known = F.when(F.col("_flat").isNull(), F.raise_error(F.concat(F.lit("no field for channel "), named)).cast("array<double>")).otherwise(F.col("_flat"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = _matrix(batch.column("px"))
                down = lambda name: resize_stack(_matrix(batch.column(name)).reshape(-1, *shape), side, side).reshape(-1, side * side)
                level, done = L.base_levels(d, down("_flat"), down("_dark"), epsilon, rounds, tolerance)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], pa.array(level), pa.array(done)], names=[*ids, "base", "converged"])
    return small.withColumn("_flat", known).mapInArrow(run, _schema(tiles, ids, "base double, converged boolean"))
