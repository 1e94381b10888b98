"""Multiscale overlap of channel masks around puncta.

Layout: one shuffle brings a punctum's mask pixels together; from there on
every step is an aggregation on keys that contain ``punctum_id`` or a
row-local expression on bit words, so nothing is shuffled again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import words as W
from lumenframe.operators.relational import by_key

BOX = ("x1", "x2", "y1", "y2")
SLICES = (-1, 0, 1)
PUNCTUM = ("punctum_id", "chans", "axon_cov", "dendrite_cov")


def plane_words(roi_mask: DataFrame) -> DataFrame:
    """(punctum_id, box, c, planes): a channel's ROI slices packed into bit words.

    ``planes`` is array<struct<c, dz, words, n_axon, n_dendrite>>, dz in
    -1..1. The three slices are aggregated side by side, so a pixel row is
    grouped once. Slices whose maximum is 0 are dropped (they count as empty
    even under a negative threshold). Neurite counts need flagged masks.
    """
    flagged = "is_axon" in roi_mask.columns
    h, w = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    key = ["punctum_id", *BOX, "c"]
    extra = ["is_axon", "is_dendrite"] if flagged else []
    px = by_key(roi_mask, ["punctum_id"]).select(
        *key, "dz", "v", *extra, F.posexplode(W.contributions(
            F.col("y") - F.col("y1"), F.col("x") - F.col("x1"), h, w)).alias("_k", "_p"))
    aggs, item = [], []
    for s, dz in enumerate(SLICES):
        on = F.col("dz") == dz
        aggs += [F.bit_or(F.when(on, W.single_bit(F.col("_p.b")))).alias(f"w{s}"),
                 F.max(F.when(on, F.col("v"))).alias(f"m{s}")]
        for name in extra:  # halo copies do not count again
            aggs.append(F.sum(F.when(on & (F.col("_k") == 0), F.col(name))).alias(f"{name}{s}"))
        item.append(F.col(f"w{s}"))
    rows = px.groupBy(*key, F.col("_p.i").alias("i")).agg(*aggs)
    totals = [F.max(f"m{s}").alias(f"m{s}") for s in range(3)]
    totals += [F.sum(f"{n}{s}").alias(f"{n}{s}") for n in extra for s in range(3)]
    packed = rows.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("i", F.struct(*item)))).alias("_m"), *totals)
    slots = F.sequence(F.lit(0), W.length(h, w) - 1)
    packed = packed.withColumn("_w", F.transform(slots, lambda i: F.try_element_at("_m", i)))

    def plane(s, dz):
        words = F.transform("_w", lambda e: F.coalesce(e[f"w{s}"], F.lit(0).cast("long")))
        count = lambda n: (F.col(f"{n}{s}") if flagged else F.lit(None)).cast("long")
        return F.when(F.col(f"m{s}") != 0, F.struct(
            F.col("c").alias("c"), F.lit(dz).alias("dz"), words.alias("words"),
            count("is_axon").alias("n_axon"), count("is_dendrite").alias("n_dendrite")))

    return (packed.select(*key, F.array_compact(F.array(*[plane(s, dz) for s, dz in enumerate(SLICES)])).alias("planes"))
            .filter(F.size("planes") > 0))


def by_punctum(channel_planes: DataFrame, neurite_channel: int = 2) -> DataFrame:
    """(punctum_id, box, planes, chans, axon_cov, dendrite_cov), one row per detected punctum.

    At most five channels times three slices; coverage is the share of one
    channel's pixels on neurites.
    """
    grouped = channel_planes.groupBy("punctum_id", *BOX).agg(
        F.array_sort(F.collect_list(F.struct("c", "planes"))).alias("_c"))
    mine = F.filter("planes", lambda p: p["c"] == neurite_channel)
    total = F.aggregate(mine, F.lit(0), lambda n, p: n + W.count(p["words"]))
    on = lambda f: F.aggregate(mine, F.lit(0).cast("long"), lambda n, p: n + p[f])
    share = lambda f: F.when(total > 0, on(f) / total)
    return grouped.select(
        "punctum_id", *BOX, F.flatten(F.col("_c.planes")).alias("planes"),
        F.col("_c.c").alias("chans")).withColumns({
            "axon_cov": share("n_axon"), "dendrite_cov": share("n_dendrite")})


def channel_pairs(chans: Column) -> Column:
    """All c1 < c2 of a sorted channel array."""
    return F.flatten(F.transform(chans, lambda a: F.transform(
        F.filter(chans, lambda b: b > a), lambda b: F.struct(a.alias("c1"), b.alias("c2")))))


def _slices(c: Column) -> Column:
    return F.transform(F.filter("planes", lambda p: p["c"] == c), lambda p: p["dz"])


def _combined(c: Column, shared: Column) -> Column:
    picked = F.filter("planes", lambda p: (p["c"] == c) & F.array_contains(shared, p["dz"]))
    return W.union_of(F.transform(picked, lambda p: p["words"]))


def pair_masks(grouped: DataFrame) -> DataFrame:
    """One row per pair: masks m1, m2 OR-ed over the shared slices (null without any).

    A punctum with a single channel keeps one row with null c1, c2.
    """
    roi = W.frame(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    pairs = grouped.withColumn("roi", roi).withColumn("_p", F.explode_outer(channel_pairs(F.col("chans"))))
    pairs = pairs.withColumns({"c1": F.col("_p.c1"), "c2": F.col("_p.c2")})
    pairs = pairs.withColumn("_shared", F.array_intersect(_slices(F.col("c1")), _slices(F.col("c2"))))
    return pairs.select(*PUNCTUM, "roi", "c1", "c2", F.size("_shared").alias("n_shared"),
                        _combined(F.col("c1"), F.col("_shared")).alias("m1"),
                        _combined(F.col("c2"), F.col("_shared")).alias("m2"))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in "abi"])))
def scale_counts(m1: pa.Array, m2: pa.Array, roi: pa.Array) -> pa.Array:
    """Pixels of two masks and of their intersection: eroded, as they are, dilated.

    The words of a whole batch stand in one buffer; a word's neighbours in its
    own mask are the shifted buffer with zeros at the mask's ends. A missing
    mask gives zeros.
    """
    there = pc.and_(m1.is_valid(), m2.is_valid())
    first, second, frame = (x.filter(there) for x in (m1, m2, roi))
    sizes = pc.list_value_length(first).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    words = [x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in (first, second, frame)]
    one = np.uint64(1)

    def beside(w):
        before, after = np.zeros_like(w), np.zeros_like(w)
        before[1:], after[:-1] = w[:-1], w[1:]
        before[ends - sizes], after[ends - 1] = 0, 0
        return before, after

    def eroded(w):
        before, after = beside(w)
        return w & (w << one) & (w >> one) & before & after

    def dilated(w):
        before, after = beside(w)
        return (w | (w << one) | (w >> one) | before | after) & words[2]

    def count(w):
        total = np.concatenate([[0], np.cumsum(np.bitwise_count(w & np.uint64(W.CORE)).astype(np.int64))])
        return total[ends] - total[ends - sizes]

    out = np.zeros((len(m1), 3, 3), np.int32)
    rows = np.flatnonzero(there.to_numpy(zero_copy_only=False))
    for k, change in enumerate((eroded, lambda w: w, dilated)):
        a, b = change(words[0]), change(words[1])
        for j, w in enumerate((a, b, a & b)):
            out[rows, k, j] = count(w)
    flat = out.reshape(-1, 3)
    return pa.FixedSizeListArray.from_arrays(pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], ["a", "b", "i"]), 3).cast(
        pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("i", pa.int32())])))


def multiscale(pairs: DataFrame) -> DataFrame:
    """Jaccard / Dice after erosion, as is, and after dilation; empty unions are skipped.

    Scale factors 0.8, 1.0 and 1.2 all resolve to a one-pixel cross or
    to no change. Adds jacc_mean, jacc_std, dice_mean and score.
    """
    wide = pairs.withColumn("_s", F.filter(
        scale_counts(F.col("m1"), F.col("m2"), F.col("roi")), lambda s: s["a"] + s["b"] - s["i"] > 0))
    wide = wide.withColumns({
        "_j": F.transform("_s", lambda s: s["i"] / (s["a"] + s["b"] - s["i"])),
        "_d": F.transform("_s", lambda s: 2 * s["i"] / (s["a"] + s["b"]))})
    wide = wide.withColumns({"jacc_mean": mean_of("_j"), "dice_mean": mean_of("_d")})
    dev = F.transform("_j", lambda j: (j - F.col("jacc_mean")) * (j - F.col("jacc_mean")))
    return wide.select(*PUNCTUM, "c1", "c2", "n_shared", "jacc_mean",
                       F.sqrt(mean_of(dev)).alias("jacc_std"), "dice_mean",
                       (F.lit(0.5) * F.col("jacc_mean") + F.lit(0.5) * F.col("dice_mean")).alias("score"))


def mean_of(array) -> Column:
    """Mean of an array of doubles in array order; 0 when empty."""
    array = F.col(array) if isinstance(array, str) else array
    total = F.aggregate(array, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(array) > 0, total / F.size(array)).otherwise(F.lit(0.0))


def overlap_scores(roi_mask: DataFrame) -> DataFrame:
    """Overlap measures for every punctum and pair (see ``pair_masks`` for lone channels)."""
    return multiscale(pair_masks(by_punctum(plane_words(roi_mask))))
