"""Skeletons of binary masks by parallel thinning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.raster import thin_canvas, thin_lists
from lumenframe.operators.blocks import ROW, to_blocks
from lumenframe.operators.relational import by_key
from lumenframe.session import cut

BLOCK = 256
ROUNDS = 16                 # thinning rounds between halo exchanges
LOCAL_SIDE = 512            # groups up to this extent are thinned in one piece


def _thin_lists(batches):
    for batch in batches:
        lists = batch.column("px")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(lists.offsets.to_numpy())
        group = np.repeat(np.arange(len(sizes)), sizes)
        kept = thin_lists(group, flat // ROW, flat % ROW)
        left = np.bincount(group[kept], minlength=len(sizes))
        px = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()),
                                      pa.array(flat[kept], pa.int64()))
        names = batch.schema.names
        yield pa.RecordBatch.from_arrays([px if n == "px" else batch.column(n) for n in names], names=names)


def _unpack(df: DataFrame, keys) -> DataFrame:
    return df.select(*keys, F.explode("px").alias("_p")).select(
        *keys, F.floor(F.col("_p") / ROW).cast("int").alias("y"), (F.col("_p") % ROW).cast("int").alias("x"))


def skeletonize_local(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Thin each group whole. For groups with a bounded extent, such as ROIs."""
    packed = by_key(mask, keys).groupBy(*keys).agg(F.collect_list(F.col("y").cast("long") * ROW + F.col("x")).alias("px"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema)
    return _unpack(packed.mapInArrow(_thin_lists, schema), keys)


def _thin_block(batches, block, rounds):
    halo = 2 * rounds
    for batch in batches:
        by, bx = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("by", "bx"))
        lists = batch.column("px")
        out, moved = [], []
        for i in range(batch.num_rows):
            px = lists[i].values.to_numpy()
            y = px // ROW - by[i] * block + halo
            x = px % ROW - bx[i] * block + halo
            canvas = np.zeros((block + 2 * halo,) * 2, np.uint8)
            canvas[y, x] = 1
            core = (slice(halo, halo + block),) * 2
            before = thin_canvas(canvas, rounds - 1)[core]
            inside = (y >= halo) & (y < halo + block) & (x >= halo) & (x < halo + block)
            after = thin_canvas(canvas, rounds)
            moved.append(bool((after[core] != before).any()))
            out.append(px[inside & (after[y, x] == 1)])
        px = pa.array(out, pa.list_(pa.int64()))
        names = [n for n in batch.schema.names]
        cols = [px if n == "px" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(moved, pa.bool_())], names=[*names, "moved"])


def skeletonize_blocks(mask: DataFrame, keys: Sequence[str], block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """Thin masks of any extent: blocks with a halo, exchanged until nothing moves.

    One round reads pixels two steps away, so a halo of 2 * rounds makes the
    block's own pixels exact; the result equals thinning the whole plane.
    """
    keys = list(keys)
    current = mask.select(*keys, "y", "x")
    while True:
        packed = to_blocks(current, keys, block, 2 * rounds)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema)
        done = cut(packed.mapInArrow(lambda it: _thin_block(it, block, rounds), f"{schema}, moved boolean"))
        current = _unpack(done, keys)
        if done.filter("moved").isEmpty():
            return current


def skeletonize(mask: DataFrame, keys: Sequence[str] = ("c", "z")) -> DataFrame:
    """Skeleton pixels per group; small groups in one piece, large ones in blocks."""
    keys = list(keys)
    pixels = mask.select(*keys, "y", "x")
    extent = pixels.groupBy(*keys).agg(
        F.greatest(F.max("y") - F.min("y"), F.max("x") - F.min("x")).alias("_e"))
    large = extent.filter(F.col("_e") >= LOCAL_SIDE).select(*keys)
    if large.isEmpty():
        return skeletonize_local(pixels, keys)
    large = cut(large)
    return (skeletonize_local(pixels.join(large, keys, "left_anti"), keys)
            .unionByName(skeletonize_blocks(pixels.join(large, keys, "left_semi"), keys)))


def skeleton_length(mask: DataFrame, keys: Sequence[str] = ("c", "z")) -> DataFrame:
    return skeletonize(mask, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("length"))
