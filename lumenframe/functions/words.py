"""Binary ROI masks as arrays of 64-bit words: column expressions only.

A mask of height H and width W is cut into vertical strips of 62 pixels. Word
``strip * (H + 1) + row`` holds one strip row in bits 1..62; bits 0 and 63
repeat the neighbouring strips' edge pixels, and the extra row between strips
stays zero. One step of erosion or dilation then needs shifts and the two
adjacent words only, for a mask of any size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRIP = 62
CORE = ((1 << STRIP) - 1) << 1


def strips(width: Column) -> Column:
    return F.ceil(width / STRIP).cast("int")


def length(height: Column, width: Column) -> Column:
    return strips(width) * (height + 1)


def contributions(row: Column, col: Column, height: Column, width: Column) -> Column:
    """array<struct<i, b>>: word index and bit of one pixel, halo copies included."""
    strip = F.floor(col / STRIP).cast("int")
    bit = (col % STRIP + 1).cast("int")
    at = lambda s, b: F.struct((s * (height + 1) + row).cast("int").alias("i"), b.cast("int").alias("b"))
    wide = F.array_compact(F.array(
        at(strip, bit),
        F.when((bit == 1) & (strip > 0), at(strip - 1, F.lit(63))),
        F.when((bit == STRIP) & (strip + 1 < strips(width)), at(strip + 1, F.lit(0)))))
    return F.when(width <= STRIP, F.array(at(F.lit(0), bit))).otherwise(wide)


def single_bit(bit: Column) -> Column:
    # F.shiftleft takes a literal amount only
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def frame(height: Column, width: Column) -> Column:
    """Words with every core pixel of the ROI set."""
    def word(i):
        strip = F.floor(i / (height + 1)).cast("int")
        cols = F.least(F.lit(STRIP), width - strip * STRIP).cast("int")
        ones = (F.call_function("shiftleft", F.lit(1).cast("long"), cols) - 1)
        return F.when(i % (height + 1) == height, F.lit(0).cast("long")).otherwise(F.shiftleft(ones, 1))
    return F.transform(F.sequence(F.lit(0), length(height, width) - 1), word)


def _zero(word: Column) -> Column:
    return F.coalesce(word, F.lit(0).cast("long"))


def _beside(words: Column, i: Column, step: int) -> Column:
    return _zero(F.get(words, i + step))


def erode(words: Column) -> Column:
    """Erosion by a cross; outside the ROI counts as unset."""
    return F.transform(words, lambda w, i: (
        w.bitwiseAND(F.shiftleft(w, 1)).bitwiseAND(F.shiftrightunsigned(w, 1))
        .bitwiseAND(_beside(words, i, -1)).bitwiseAND(_beside(words, i, 1))))


def dilate(words: Column, roi: Column) -> Column:
    """Dilation by a cross, clipped to the ROI."""
    return F.transform(words, lambda w, i: (
        w.bitwiseOR(F.shiftleft(w, 1)).bitwiseOR(F.shiftrightunsigned(w, 1))
        .bitwiseOR(_beside(words, i, -1)).bitwiseOR(_beside(words, i, 1))
        .bitwiseAND(F.get(roi, i))))


def both(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p.bitwiseAND(q))


def either(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p.bitwiseOR(q))


def count(words: Column) -> Column:
    """Number of set pixels (halo copies excluded)."""
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w.bitwiseAND(F.lit(CORE))))


def union_of(masks: Column) -> Column:
    """OR of an array of word arrays of equal length; null when there is none."""
    return F.aggregate(F.slice(masks, 2, F.greatest(F.size(masks) - 1, F.lit(0))),
                       F.get(masks, F.lit(0)), either)
