"""Fixed-size blocks with a halo: the unit of work for dense local kernels.

A kernel sees at most (block + 2 * halo)^2 pixels, whatever the slice size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = 1 << 32  # packed position: y * 2^32 + x


def _covering(pos: Column, block: int, halo: int) -> Column:
    first = F.greatest(F.lit(0), F.floor((pos - halo) / block))
    return F.explode(F.sequence(first, F.floor((pos + halo) / block)))


def to_blocks(pixels: DataFrame, keys: Sequence[str], block: int, halo: int,
              values: Sequence[str] = ()) -> DataFrame:
    """(keys, by, bx, px array<bigint>, <value> array...) in one shared order.

    A pixel goes to every block whose halo reaches it: one block inside, two
    or four near borders.
    """
    spread = (pixels.withColumn("by", _covering(F.col("y"), block, halo))
              .withColumn("bx", _covering(F.col("x"), block, halo)))
    item = F.struct((F.col("y").cast("long") * ROW + F.col("x")).alias("px"), *values)
    packed = spread.groupBy(*keys, "by", "bx").agg(F.array_sort(F.collect_list(item)).alias("_i"))
    return packed.select(*keys, "by", "bx", *[F.col(f"_i.{n}").alias(n) for n in ("px", *values)])
