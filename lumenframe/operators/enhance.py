"""Contrast operators: histogram matching, tiled and adaptive equalisation.

All are lookups: value tables are derived from histograms (256 rows per
slice or tile) and joined back, so slices are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.relational import attach, histogram
from lumenframe.session import cut

LEVELS = 256
WORD = 64                      # levels that a word of bits stands for


def _cumulative(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add q: share of pixels with a value up to v."""
    run = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("q", F.sum("n").over(run) / F.sum("n").over(Window.partitionBy(*keys)))


def match_table(source_hist: DataFrame, template_hist: DataFrame, keys: Sequence[str],
                template_keys: Sequence[str]) -> DataFrame:
    """(keys, v, matched): source value to template value at the same quantile.

    Nearest template quantiles below and above are found by one ordered pass
    over the union of both tables; between them the value is interpolated.
    """
    if not template_keys:
        raise ValueError("the template needs a key, such as the channel")
    keys = list(keys)
    src = _cumulative(source_hist, keys).select(*keys, "q", "v", F.lit(None).cast("double").alias("t"))
    tq = _cumulative(template_hist, list(template_keys)).select(
        *template_keys, "q", F.col("v").cast("double").alias("t"))
    units = source_hist.select(*keys).distinct()
    tpl = units.join(tq, list(template_keys))  # a template has at most one row per pixel value
    both = src.unionByName(tpl.select(*keys, "q", F.lit(None).cast(dict(src.dtypes)["v"]).alias("v"), "t"))
    point = F.when(F.col("t").isNotNull(), F.struct("q", "t"))
    before = Window.partitionBy(*keys).orderBy("q").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("q").rangeBetween(0, Window.unboundedFollowing)
    near = (both.withColumn("lo", F.max(point).over(before)).withColumn("hi", F.min(point).over(after))
            .filter("v IS NOT NULL"))
    q, lo, hi = F.col("q"), F.col("lo"), F.col("hi")
    value = (F.when(lo.isNull(), hi["t"]).when(hi.isNull() | (hi["q"] == lo["q"]), lo["t"])
             .otherwise(lo["t"] + (hi["t"] - lo["t"]) * (q - lo["q"]) / (hi["q"] - lo["q"])))
    return near.select(*keys, "v", value.alias("matched"))


def match_histograms(voxels: DataFrame, reference: DataFrame, keys=("c", "z"), reference_keys=("c",)) -> DataFrame:
    """Give every slice the value distribution of the reference slice; adds ``matched``."""
    table = match_table(histogram(voxels, keys), histogram(reference, reference_keys), keys, reference_keys)
    return attach(voxels, table, [*keys, "v"])


# ---------------------------------------------------------- tiled equalisation
def _padding(height: int, width: int, grid: tuple[int, int]) -> tuple[int, int]:
    """Rows and columns added so that tiles fit: none if both axes are divisible,
    else up to the next multiple on both, a full tile count on a divisible one."""
    rows, cols = grid
    return (0, 0) if height % rows == 0 and width % cols == 0 else (rows - height % rows, cols - width % cols)


def _reflected(pos: Column, size: int, pad: int) -> Column:
    """A pixel's positions after mirror padding."""
    mirrored = F.when((pos < size - 1) & (2 * (size - 1) - pos < size + pad), 2 * (size - 1) - pos)
    return F.explode(F.array_compact(F.array(pos, mirrored)))


def tile_tables(voxels: DataFrame, height: int, width: int, clip: float, grid: tuple[int, int],
                keys: Sequence[str]) -> DataFrame:
    """(keys, ty, tx, lut): clipped, equalising table of every tile, see ``_level``.

    A table has the running totals of the levels that are present, at most as
    many as the tile has pixels, and a bit per level that says which these are.
    Levels are worked out for the pixels alone: small tiles have far fewer than LEVELS.
    """
    rows, cols = grid
    ph, pw = _padding(height, width, grid)
    th, tw = (height + ph) // rows, (width + pw) // cols
    area = th * tw
    limit = max(int(clip * area / LEVELS), 1) if clip > 0 else area
    counts = (voxels.withColumn("_y", _reflected(F.col("y"), height, ph))
              .withColumn("_x", _reflected(F.col("x"), width, pw))
              .groupBy(*keys, F.floor(F.col("_y") / th).cast("int").alias("ty"),
                       F.floor(F.col("_x") / tw).cast("int").alias("tx"), "v")
              .agg(F.count(F.lit(1)).cast("int").alias("n")))
    tile = Window.partitionBy(*keys, "ty", "tx")
    runs = counts.select(
        *keys, "ty", "tx", F.col("v").cast("int").alias("v"),
        F.sum(F.least(F.col("n"), F.lit(limit))).over(tile.orderBy("v")).cast("int").alias("cum"),
        F.greatest(F.col("n") - limit, F.lit(0)).alias("over"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v").bitwiseAND(WORD - 1))
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("v") / WORD) == j, bit)), F.lit(0).cast("long")).alias(f"_w{j}") for j in range(LEVELS // WORD)]
    per = runs.groupBy(*keys, "ty", "tx").agg(
        *words, F.array_sort(F.collect_list(F.struct("v", "cum")))["cum"].alias("_cum"), F.sum("over").cast("int").alias("_over"))
    present = [F.bit_count(f"_w{j}") for j in range(LEVELS // WORD)]
    before = [sum(present[:j], F.lit(0)) for j in range(LEVELS // WORD)]
    base, rest = F.floor(F.col("_over") / LEVELS).cast("int"), F.col("_over") % LEVELS
    step = F.greatest(F.floor(LEVELS / F.greatest(rest, F.lit(1))), F.lit(1)).cast("int")
    return per.select(*keys, "ty", "tx", F.struct(
        F.array(*[f"_w{j}" for j in range(LEVELS // WORD)]).alias("words"), F.array(*before).alias("before"),
        F.concat(F.array(F.lit(0)), "_cum").alias("totals"), base.alias("base"), rest.alias("rest"), step.alias("step")).alias("lut"))


def _level(lut: Column, v: Column, area: int) -> Column:
    """The new level of level ``v`` by a tile's table; null outside 0..LEVELS - 1.

    The present levels up to ``v`` are counted in the words; that many totals on is the running total at ``v``.
    """
    at = F.floor(v / WORD).cast("int")
    upto = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), WORD - 1 - v.bitwiseAND(WORD - 1))
    total = F.get(lut["totals"], F.get(lut["before"], at) + F.bit_count(F.get(lut["words"], at).bitwiseAND(upto)))
    # the clipped surplus comes back evenly, its remainder on every step-th level
    dealt = total + lut["base"] * (v + 1) + F.least(lut["rest"], F.floor(v / lut["step"]) + 1)
    return F.when(total.isNotNull(), F.least(F.lit(float(LEVELS - 1)), F.rint(dealt * (float(LEVELS - 1) / area))))


def corner_tables(luts: DataFrame, rows: int, cols: int, keys: Sequence[str]) -> DataFrame:
    """(keys, cy, cx, _c): the tables of the four tiles around every cell between tile centres, border tiles repeated."""
    def served(t, n):
        # (corner, cell) on one axis: the cells that a tile serves, clamped border cells last
        pair = lambda d, cell: F.struct(F.lit(d).alias("d"), cell.cast("int").alias("cell"))
        return F.explode(F.array_compact(F.array(
            pair(0, t), pair(1, t - 1), F.when(t == 0, pair(0, F.lit(-1))), F.when(t == n - 1, pair(1, F.lit(n - 1))))))
    # tables are made once and unfolded, not once per corner
    return (luts.withColumn("_y", served(F.col("ty"), rows)).withColumn("_x", served(F.col("tx"), cols))
            .groupBy(*keys, F.col("_y.cell").alias("cy"), F.col("_x.cell").alias("cx"))
            .agg(F.array_sort(F.collect_list(F.struct((F.col("_y.d") * 2 + F.col("_x.d")).alias("k"), "lut"))).alias("_c")))


def equalize_tiles(voxels: DataFrame, height: int, width: int, clip: float = 1.5,
                   grid: tuple[int, int] = (64, 64), keys=("c", "z")) -> DataFrame:
    """Contrast-limited adaptive equalisation of 8-bit slices; replaces ``v``.

    A pixel blends the tables of the four nearest tile centres. Those four are
    put side by side once per cell between centres, so a pixel needs one join.
    Pixels next to a tile without any pixel have no result.
    """
    keys = list(keys)
    rows, cols = grid
    ph, pw = _padding(height, width, grid)
    th, tw = (height + ph) // rows, (width + pw) // cols
    cells = corner_tables(tile_tables(voxels, height, width, clip, grid, keys), rows, cols, keys)

    fy, fx = F.col("y") / F.lit(float(th)) - 0.5, F.col("x") / F.lit(float(tw)) - 0.5
    placed = voxels.withColumns({"cy": F.floor(fy).cast("int"), "cx": F.floor(fx).cast("int")}).withColumns({
        "_ya": fy - F.col("cy"), "_xa": fx - F.col("cx")})
    # a lambda: four times this expression in generated code would be a method too long to compile
    placed = placed.join(cells.filter(F.size("_c") == 4), [*keys, "cy", "cx"]).withColumn(
        "_l", F.transform("_c", lambda e: _level(e["lut"], F.col("v").cast("int"), th * tw)))
    at = lambda k: F.get("_l", F.lit(k))
    top = at(0) * (1 - F.col("_xa")) + at(1) * F.col("_xa")
    low = at(2) * (1 - F.col("_xa")) + at(3) * F.col("_xa")
    blend = F.rint(top * (1 - F.col("_ya")) + low * F.col("_ya")).cast("int")
    return placed.select(*[blend.alias("v") if c == "v" else c for c in voxels.columns])


# ------------------------------------------------- adaptive equalisation, 16 bit
FINE, BINS = 1 << 14, 256      # gray levels, and bins of their histograms
BIN = 1 + FINE // BINS


def limited(hist: np.ndarray, limit: int) -> np.ndarray:
    """A histogram cut at ``limit``, its surplus dealt back.

    Every bin gets an equal share first, bins that would pass the limit are
    filled up to it. What is left goes out one by one to bins below the limit,
    evenly strided, starting one bin later each time, until it is used up or
    no bin can take any.
    """
    surplus = int(np.maximum(hist - limit, 0).sum())
    cut_off = np.minimum(hist, limit)
    share = surplus // len(hist)
    filled = np.where(cut_off < limit - share, cut_off + share, limit)
    left = surplus - int((filled - cut_off).sum())
    while left > 0:
        before = left
        for first in range(len(hist)):
            open_ = filled < limit
            stride = max(1, int(open_.sum()) // left)
            takes = np.flatnonzero(open_[first::stride]) * stride + first
            filled[takes] += 1
            left -= len(takes)
            if left <= 0:
                break
        if left == before:
            break
    return filled


def _level_tables(batches, limit: int, area: int, names: list[str]):
    """Tables of tiles from the counts of their bins."""
    for batch in batches:
        tables = []
        for bins, counts in zip(batch.column("bins").to_pylist(), batch.column("counts").to_pylist()):
            hist = np.zeros(BINS, np.int64)
            hist[bins] = counts
            total = np.cumsum(limited(hist, limit)) * ((FINE - 1) / area)
            tables.append(np.minimum(total, FINE - 1).astype(np.int32))
        flat = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        lut = pa.ListArray.from_arrays(pa.array(np.arange(len(tables) + 1) * BINS, pa.int32()), pa.array(flat, pa.int32()))
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lut], names=[*names, "lut"])


def equalize_adaptive(voxels: DataFrame, height: int, width: int, max_value: int, clip_limit: float = 0.01,
                      kernel: tuple[int, int] | None = None, keys=("c", "z")) -> DataFrame:
    """Contrast-limited adaptive equalisation of whole images (keys) of integer pixels; replaces ``v``.

    Values are stretched to 16,384 levels and counted in 256 bins per tile. A
    tile has an eighth of the image a side unless ``kernel`` says otherwise;
    the image is mirrored at its end to fill the last one. ``clip_limit`` is
    the share of a tile's pixels that one bin may hold (0: no limit). A pixel
    blends the tables of the four nearest tiles, then the image is stretched to
    0 .. max_value. An image of one value stays as it is.
    """
    keys = list(keys)
    kh, kw = kernel or (max(height // 8, 1), max(width // 8, 1))
    ph, pw = -height % kh, -width % kw
    rows, cols, area = (height + ph) // kh, (width + pw) // kw, kh * kw
    limit = max(int(clip_limit * area), 1) if clip_limit > 0 else area
    ends = lambda df, v: df.groupBy(*keys).agg(F.min(v).alias("_low"), F.max(v).alias("_high"))
    spread = F.col("_high") - F.col("_low")
    fine = F.rint((F.col("v") - F.col("_low")) / spread * F.lit(float(FINE - 1)))
    bins = F.when(spread > 0, F.floor(fine / BIN)).otherwise(0).cast("int")
    binned = attach(voxels, ends(voxels, "v"), keys).withColumns({"_flat": spread == 0, "_bin": bins})
    counts = (binned.withColumn("_y", _reflected(F.col("y"), height, ph)).withColumn("_x", _reflected(F.col("x"), width, pw))
              .groupBy(*keys, F.floor(F.col("_y") / kh).cast("int").alias("ty"), F.floor(F.col("_x") / kw).cast("int").alias("tx"), "_bin")
              .agg(F.count(F.lit(1)).alias("n")))
    tile = [*keys, "ty", "tx"]
    per = counts.groupBy(*tile).agg(F.collect_list("_bin").alias("bins"), F.collect_list("n").alias("counts"))  # at most BINS
    kinds = {f.name: f.dataType.simpleString() for f in per.schema}
    luts = per.mapInArrow(lambda it: _level_tables(it, limit, area, tile), ", ".join([*[f"{k} {kinds[k]}" for k in tile], "lut array<int>"]))
    cells = corner_tables(luts, rows, cols, keys)

    # A cell reaches from one tile's centre to the next; centres of even tiles lie on the later pixel.
    at_y, at_x = F.col("y") + kh // 2, F.col("x") + kw // 2
    placed = binned.withColumns({"cy": (F.floor(at_y / kh) - 1).cast("int"), "cx": (F.floor(at_x / kw) - 1).cast("int"),
                                 "_fy": (at_y % kh) / F.lit(float(kh)), "_fx": (at_x % kw) / F.lit(float(kw))})
    level = lambda k: F.get(F.get("_c", F.lit(k))["lut"], F.col("_bin")).cast("double")
    top = level(0) * (1 - F.col("_fx")) + level(1) * F.col("_fx")
    low = level(2) * (1 - F.col("_fx")) + level(3) * F.col("_fx")
    # The blend is cut to an integer; sums of products may lie a little below one.
    blend = F.floor(top * (1 - F.col("_fy")) + low * F.col("_fy") + 1e-6)
    mixed = cut(placed.join(cells, [*keys, "cy", "cx"]).withColumn("_e", blend).select(*voxels.columns, "_flat", "_e"))
    out = F.floor((F.col("_e") - F.col("_low")) / F.when(spread == 0, 1).otherwise(spread) * max_value + 1e-6)
    value = F.when(F.col("_flat"), F.col("v")).otherwise(out).cast("int")
    return attach(mixed, ends(mixed, "_e"), keys).select(*[value.alias("v") if c == "v" else c for c in voxels.columns])
