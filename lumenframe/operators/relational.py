"""Shared relational building blocks: histograms, percentiles, safe lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.session import cut

# A lookup of this size is safe on every executor.
BROADCAST_BYTES = 16 << 20
SALTS = 64


def histogram(df: DataFrame, keys: Sequence[str], value: str = "v",
              weight: str | None = None) -> DataFrame:
    """Value counts per group: (keys, value, n).

    Pixels are 8 or 16 bit, or a per-channel monotone rescaling of such, so a
    group has at most 65,536 rows here whatever the image size. Everything
    that needs order statistics works on this table, never on raw voxels.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*keys, value).agg(n.cast("long").alias("n"))


def percentiles(hist: DataFrame, keys: Sequence[str], probs: Mapping[str, float],
                value: str = "v") -> DataFrame:
    """Linear-interpolation percentiles (0..100) from a histogram."""
    cols = [F.percentile(F.col(value), F.lit(p / 100.0), F.col("n")).alias(name)
            for name, p in probs.items()]
    return hist.groupBy(*keys).agg(*cols)


def is_small(materialised: DataFrame) -> bool:
    """Are the rows, counted with the widths of their types, within BROADCAST_BYTES?

    For tables of plain columns; array columns count by their real sizes.
    """
    width = F.lit(16)
    for f in materialised.schema:
        kind = f.dataType.simpleString()
        width = width + (F.coalesce(F.size(f.name), F.lit(0)) * 8 if kind.startswith("array") else
                         F.coalesce(F.octet_length(f.name), F.lit(0)) if kind in ("string", "binary") else F.lit(8))
    total = materialised.agg(F.sum(width.cast("long"))).first()[0]
    return (total or 0) <= BROADCAST_BYTES


def attach(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a per-group table back to voxels without shuffling the voxels.

    ``on`` empty: the lookup is a global aggregate and enters as a scalar
    subquery (which fails if it ever had a second row). Any other lookup is
    materialised once and measured: small ones are broadcast, larger ones go
    through a shuffle join whose voxel side is salted, so a group holding a
    large share of the rows still spreads over many tasks.
    """
    on = list(on)
    if not on:
        row = lookup.select(F.struct(*lookup.columns).alias("_row")).scalar()
        return df.withColumn("_row", row).select(*df.columns, "_row.*")
    lookup = cut(lookup)
    if is_small(lookup):
        return df.join(F.broadcast(lookup), on, how)
    rest = [c for c in df.columns if c not in on] or on
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*on, *rest), F.lit(SALTS)).cast("int"))
    fanned = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(fanned, [*on, "_salt"], how).drop("_salt")


def hand_back(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join what was worked out once per distinct key back to the rows with that key.

    Unlike a per-group table, ``lookup`` may have as many keys as ``df`` has
    rows: it is broadcast if it measures small and merge-joined otherwise,
    where adaptive execution splits a key with many rows.
    """
    lookup = cut(lookup)
    return df.join(F.broadcast(lookup) if is_small(lookup) else lookup.hint("merge"), list(on), how)


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """``df`` with its position (int, from 0) in each group by ``order``.

    Rows are dealt into ranges of (group, order), so one group spreads over
    many tasks; a range is numbered alone and offsets come from the counts of
    the ranges before it. Rows equal in all of these may change places.
    """
    group, order = list(group), list(order)
    dealt = cut(df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group, *order)
                .withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*group, "_part"]]
    return (dealt.withColumn("_k", place).alias("a").join(offsets.alias("b"), same)
            .select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_before") + F.col("_k")).cast("int").alias(name)))


def by_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition ahead of a CPU-heavy grouped step.

    The following aggregation reuses this exchange. Naming the partition count
    keeps adaptive execution from merging tasks by their few bytes.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def int_col(expr) -> "F.Column":
    """Truncate toward zero, the way fixed-width pixel casts do."""
    return expr.cast("int")
