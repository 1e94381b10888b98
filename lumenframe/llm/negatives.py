"""Hard negatives by Kronecker-packed inner products.

Vectors are rounded to integers. Their components are shifted to be
non-negative and those of several candidates are put into separate fields of
one wide number: c1 + c2 * 2^w + ... Multiplying such a number by an anchor's
component multiplies every field at once, and the sum over all components
holds every candidate's inner product in its own field, because a field is
wide enough for the largest possible sum. Unpacking and undoing the shift
gives exact scores. A wide number is a double while two fields fit its 53
exact bits (a matrix product then does the sums), else a Python integer of
any width.

Anchors meet all candidates in blocks: a bounded block of anchors is broadcast,
every task holds it against its candidates batch by batch and keeps the best
of each anchor, and the few it keeps are ranked in Spark. Candidates are never
shuffled and no pair becomes a row unless a task's best holds it. The first
pass finds positives (same label), the second negatives inside the window of
each positive.

Defined cases: a row with a null label, a null vector or a null or non-finite
component (also after scaling) takes no part; shorter vectors are padded with
zeros; a null vec_id is no anchor and comes last among equal scores; repeated
rows are rows of their own, and an anchor is not its own positive; an anchor
without a positive, or a positive without a negative, has no row; a score
beyond 64 bits ranks exactly and is null in the result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import numbered
from lumenframe.session import cut

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100           # percent of the positive's score
ANCHORS = 20_000              # anchors in a broadcast block
TILE = (512, 2048)            # anchors and candidates of one matrix product
KEPT = 1 << 18                # negatives a task holds before it drops those that can't win
EXACT_BITS = 53
BIG = np.iinfo(np.int64).max


def integers(column: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dims) floor(SCALE * x) as doubles, and which rows take part."""
    n = len(column)
    start, end = column.offsets.to_numpy()[:-1], column.offsets.to_numpy()[1:]
    values = column.values.to_numpy(zero_copy_only=False).astype(float)   # a null component is not a number
    with np.errstate(all="ignore"):
        scaled = np.floor(values * SCALE)
    out = np.zeros((n, dims))
    length = np.where(np.asarray(column.is_valid()), end - start, 0)
    for size in np.unique(length):
        rows = np.flatnonzero(length == size)
        out[rows, :size] = scaled[start[rows][:, None] + np.arange(size)]
    return out, np.isfinite(out).all(axis=1) & np.asarray(column.is_valid())


def relabelled(label: str = "label", ident: str = "vec_id"):
    """Label, raised by one (modulo 10) where the id is divisible by 7."""
    plain = F.col(label).cast("long")
    return F.when(F.col(ident) % 7 == 0, (plain + 1) % 10).otherwise(plain)


@dataclass
class Packing:
    """Fields of the wide numbers for components in low .. high."""
    dims: int
    low: int
    high: int

    @property
    def width(self) -> int:
        return (max(self.dims, 1) * (self.high - self.low) ** 2).bit_length() + 1

    @property
    def fields(self) -> int:
        return EXACT_BITS // self.width if self.width <= EXACT_BITS else 16

    @property
    def exact(self) -> bool:
        """Do products fit doubles?"""
        return self.width <= EXACT_BITS

    def shifted(self, vectors: np.ndarray) -> np.ndarray:
        if self.exact:
            return vectors - self.low
        return np.array([[int(x) - self.low for x in v] for v in vectors], object).reshape(vectors.shape)

    def pack(self, shifted: np.ndarray) -> np.ndarray:
        """(rows, dims) to (ceil(rows / fields), dims) wide numbers."""
        short = -len(shifted) % self.fields
        rows = np.concatenate([shifted, np.zeros((short, self.dims), shifted.dtype)]).reshape(-1, self.fields, self.dims)
        wide = rows[:, 0]
        for k in range(1, self.fields):
            wide = wide + rows[:, k] * (1 << self.width * k)
        return wide

    def scores(self, anchors: np.ndarray, wide: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
        """(anchors, n) inner products of shifted anchors and n packed candidates with component sums ``sums``."""
        product = anchors @ wide.T
        if self.exact:
            product = product.astype(np.int64)
        out = np.empty((len(anchors), wide.shape[0], self.fields), product.dtype)
        for k in range(self.fields):
            out[:, :, k] = (product >> self.width * k) & ((1 << self.width) - 1)
        out = out.reshape(len(anchors), -1)[:, :n]
        # (a - low)(c - low) summed, so a*c = product + low * (sum of both shifted) + dims * low^2
        mine = anchors.sum(axis=1)
        if self.exact:
            mine = mine.astype(np.int64)
        return out + self.low * (mine[:, None] + sums[None, :]) + self.dims * self.low * self.low


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["embedding"]
        dims = int(np.diff(lists.offsets.to_numpy()).max(initial=0))
        out, good = integers(lists, dims)
        if good.any() and dims:
            part = out[good]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in (part.min(), part.max(), float(dims))],
                                             ["low", "high", "dims"])


class Block:
    """A broadcast block of anchors sorted by label: number, label, id, shifted vectors."""

    def __init__(self, table: pa.Table, packing: Packing):
        self.packing = packing
        vectors, good = integers(table["embedding"].combine_chunks(), packing.dims)
        rows = np.flatnonzero(good)
        rows = rows[np.argsort(table["_label"].to_numpy()[rows], kind="stable")]
        self.number, self.label, self.ids = (table[c].to_numpy()[rows] for c in ("_no", "_label", "vec_id"))
        self.vectors = packing.shifted(vectors[rows])

    def own(self) -> np.ndarray:
        """Every anchor's product with itself."""
        sums = self.sums(self.vectors)
        out = [self.packing.scores(self.vectors[i:i + 1], self.packing.pack(self.vectors[i:i + 1]), 1, sums[i:i + 1])[0, 0] for i in range(len(sums))]
        return np.array(out, sums.dtype)

    def sums(self, shifted: np.ndarray) -> np.ndarray:
        total = shifted.sum(axis=1)
        return total.astype(np.int64) if self.packing.exact else total

    def candidates(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(labels, ids, null ids, shifted vectors, sums) of tiles of candidates in order of id, nulls last."""
        for batch in batches:
            vectors, good = integers(batch["embedding"], self.packing.dims)
            rows = np.flatnonzero(good)
            absent = np.asarray(batch["vec_id"].is_null())
            ids = np.where(absent, 0, batch["vec_id"].fill_null(0).to_numpy())
            rows = rows[np.lexsort((ids[rows], absent[rows]))]
            labels = batch["_label"].to_numpy()
            for a in range(0, len(rows), TILE[1]):
                some = rows[a:a + TILE[1]]
                shifted = self.packing.shifted(vectors[some])
                yield labels[some], ids[some], absent[some], shifted, self.sums(shifted)

    def ordered(self, score: np.ndarray) -> list[pa.Array]:
        """Scores as bytes that sort like them, and as longs where they fit."""
        if self.packing.exact:
            score = score.astype(np.int64)
            raw = (score.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes()
            fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(score), [None, pa.py_buffer(raw)])
            return [fixed.cast(pa.binary()), pa.array(score)]
        size = 2 + max(self.packing.dims, 1).bit_length() // 8 + 2 * max(abs(self.packing.low), abs(self.packing.high), 1).bit_length() // 8 + 1
        key = [(int(x) + (1 << 8 * size - 1)).to_bytes(size, "big") for x in score]
        return [pa.array(key, pa.binary()), pa.array([int(x) if -BIG <= x <= BIG else None for x in score], pa.int64())]


def leading(score: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of every row; of equal scores the first column."""
    if score.dtype != object and score.shape[1] > 8 * k:
        # Only what reaches the k-th score needs sorting.
        floor = np.partition(score, -k, axis=1)[:, -k:].min(axis=1)
        i, j = np.nonzero(score >= floor[:, None])
        order = np.lexsort((j, -score[i, j], i))
        return j[order][_rank(i[order]) < k].reshape(len(score), k)
    return np.argsort(-score, axis=1, kind="stable")[:, :k]


def _rank(groups: np.ndarray) -> np.ndarray:
    """Place of every element in its run of equal, neighbouring values."""
    if not len(groups):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    return np.arange(len(groups)) - np.repeat(start, np.diff(np.append(start, len(groups))))


def _order(group: np.ndarray, score: np.ndarray, absent: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """By group, then higher score, then smaller id with nulls last."""
    if score.dtype != object:
        return np.lexsort((ids, absent, -score, group))
    return np.array(sorted(range(len(group)), key=lambda i: (group[i], -score[i], absent[i], ids[i])), np.int64)


class Best:
    """Flat lists of (anchor, score, null id, id) that are cut back to what can still win."""

    def __init__(self, keep):
        self.keep, self.parts, self.size = keep, [], 0

    def add(self, anchor, score, absent, ids):
        self.parts.append((anchor, score, absent, ids))
        self.size += len(anchor)
        if self.size > KEPT:
            self.trim()

    def trim(self):
        if self.parts:
            columns = [np.concatenate(c) for c in zip(*self.parts)]
            order = _order(*columns)
            columns = [c[order] for c in columns]
            kept = self.keep(columns[0], columns[1])
            self.parts = [tuple(c[kept] for c in columns)]
            self.size = len(self.parts[0][0])
        return self.parts[0] if self.parts else None


ROW = "no long, anchor long, id long, key binary, score long, own boolean, fits int"


def _rows(block: Block, found, own: np.ndarray, fits: np.ndarray) -> pa.RecordBatch:
    anchor, score, absent, ids = found
    return pa.RecordBatch.from_arrays(
        [pa.array(block.number[anchor]), pa.array(block.ids[anchor]), pa.array(ids, mask=absent), *block.ordered(score),
         pa.array(own), pa.array(fits, pa.int32())], [f.split()[0] for f in ROW.split(", ")])


def _positives(block: Block, batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of every anchor's label in a task's rows. ``own``: it may be the anchor itself."""
    best = Best(lambda anchor, score: _rank(anchor) < k)
    for labels, ids, absent, shifted, sums in block.candidates(batches):
        for label in np.unique(labels):
            start, stop = np.searchsorted(block.label, [label, label + 1])
            rows = np.flatnonzero(labels == label)
            wide = block.packing.pack(shifted[rows])
            for a in range(start, stop, TILE[0]):
                mine = block.vectors[a:min(a + TILE[0], stop)]
                score = block.packing.scores(mine, wide, len(rows), sums[rows])
                first = leading(score, k)
                anchor = np.repeat(np.arange(a, a + len(mine)), first.shape[1])
                column = first.ravel()
                best.add(anchor, score[anchor - a, column], absent[rows][column], ids[rows][column])
    found = best.trim()
    if found:
        anchor, score, absent, ids = found
        own = (ids == block.ids[anchor]) & ~absent & np.asarray(score == block.own()[anchor], bool)
        yield _rows(block, found, own, np.zeros(len(anchor)))


def _negatives(block: Block, batches: Iterator[pa.RecordBatch], low: np.ndarray, high: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Rows of other labels that are among the first k in a task for a window of their anchor.

    ``low`` and ``high`` (anchors, windows) bound the windows; ``fits`` has a bit per window.
    """
    floor, ceiling = low.min(axis=1), high.max(axis=1)

    def keep(anchor, score):
        wanted = np.zeros(len(anchor), bool)
        reach = low.copy()
        for p in range(low.shape[1]):
            inside = np.flatnonzero((score >= low[anchor, p]) & (score <= high[anchor, p]))
            rank = _rank(anchor[inside])
            wanted[inside[rank < k]] = True
            last = inside[rank == k - 1]
            reach[anchor[last], p] = score[last]     # nothing below a window's k-th can win
        floor[:] = reach.min(axis=1)
        return wanted
    best = Best(keep)
    for labels, ids, absent, shifted, sums in block.candidates(batches):
        wide = block.packing.pack(shifted)
        for a in range(0, len(block.vectors), TILE[0]):
            mine = slice(a, a + TILE[0])
            score = block.packing.scores(block.vectors[mine], wide, len(sums), sums)
            i, j = np.nonzero((score >= floor[mine, None]) & (score <= ceiling[mine, None]) & (block.label[mine, None] != labels[None, :]))
            best.add(i + a, score[i, j], absent[j], ids[j])
    found = best.trim()
    if found:
        anchor, score = found[0], found[1]
        bits = sum(((score >= low[anchor, p]) & (score <= high[anchor, p])).astype(int) << p for p in range(low.shape[1]))
        yield _rows(block, found, np.zeros(len(anchor), bool), bits)


def _windows(block: Block, positives: pa.Table, count: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of every anchor's windows; without a positive a window is empty."""
    kind = np.int64 if block.packing.exact else object
    none = 1 << 62 if block.packing.exact else 1 << 4096
    lows, highs = np.full((len(block.number), count), none, kind), np.full((len(block.number), count), -none, kind)
    at = {n: i for i, n in enumerate(block.number.tolist())}
    offset = None
    for no, rank, key in zip(*(positives[c].to_pylist() for c in ("no", "positive_rank", "key"))):
        offset = offset or 1 << 8 * len(key) - 1
        score = int.from_bytes(key, "big") - offset
        if -(-low * score // 100) <= high * score // 100:
            lows[at[no], rank - 1], highs[at[no], rank - 1] = -(-low * score // 100), high * score // 100
    return lows, highs


def _table(df: DataFrame) -> bytes:
    """A bounded table as bytes for a broadcast."""
    table, sink = df.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def hard_negatives(df: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, anchors_at_once: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``df``: vec_id, embedding, label. Anchors are rows whose id is divisible by ``every``.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    out = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), relabelled().alias("_label")).filter(
        "_label IS NOT NULL AND embedding IS NOT NULL")
    limits = (rows.select("embedding").mapInArrow(_bounds, "low double, high double, dims double")
              .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("dims").alias("dims")).first())
    anchors = numbered(rows.filter(F.col("vec_id") % every == 0), [], "_no")
    total = anchors.count() if limits["low"] is not None else 0
    if not total:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    packing = Packing(int(limits["dims"]), int(min(limits["low"], 0)), int(max(limits["high"], 0)))
    first = lambda c: [F.desc(c), F.col("id").asc_nulls_last()]
    parts = []
    for start in range(0, total, anchors_at_once):
        table = sc.broadcast(_table(anchors.filter(F.col("_no").between(start, start + anchors_at_once - 1))))
        block = lambda t=table: Block(pa.ipc.open_stream(t.value).read_all(), packing)
        same = rows.mapInArrow(lambda it, b=block: _positives(b(), it, positives + 1), ROW)
        by_anchor = Window.partitionBy("no")
        place = F.row_number().over(by_anchor.orderBy(*first("key")))
        close = same.withColumn("place", place).filter(F.col("place") <= positives + 1)
        # Of the rows that look like the anchor, one is the anchor.
        itself = F.min(F.when(F.col("own"), F.col("place"))).over(by_anchor)
        other = close.withColumn("itself", itself).filter("itself IS NULL OR place <> itself")
        chosen = cut(other.withColumn("positive_rank", F.row_number().over(by_anchor.orderBy("place"))).filter(F.col("positive_rank") <= positives)
                     .select("no", F.col("anchor").alias("anchor_id"), "positive_rank", F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"), "key"))
        windows = sc.broadcast(_table(chosen.select("no", "positive_rank", "key")))

        def mine(batches, b=block, w=windows):
            here = b()
            return _negatives(here, batches, *_windows(here, pa.ipc.open_stream(w.value).read_all(), positives, low, high), negatives)
        different = rows.mapInArrow(mine, ROW).select("no", "id", "key", "score", "fits")
        bit = F.call_function("shiftright", F.col("fits"), F.col("positive_rank") - 1).bitwiseAND(1) == 1
        met = chosen.drop("key").join(different, "no").filter(bit)
        rank = F.row_number().over(Window.partitionBy("no", "positive_rank").orderBy(*first("key")))
        parts.append(cut(met.withColumn("rank", rank).filter(F.col("rank") <= negatives)
                         .select(*out[:3], F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


NEGATIVE_SQL = """
    WITH v AS (SELECT row_number() OVER () row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END lab,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) e
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.row_no ano, a.vec_id anchor_id, b.row_no bno, b.vec_id id, a.lab = b.lab same, CAST(list_inner_product(a.e, b.e) AS BIGINT) score
          FROM v a JOIN v b ON a.row_no <> b.row_no WHERE a.vec_id % 100 = 0),
    p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ano ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.anchor_id, p.id positive_id, p.score positive_score, s.id negative_id, s.score negative_score,
                 row_number() OVER (PARTITION BY p.ano, p.bno ORDER BY s.score DESC, s.id) AS rank
          FROM p JOIN s ON s.ano = p.ano AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query(NEGATIVE_SQL)
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
