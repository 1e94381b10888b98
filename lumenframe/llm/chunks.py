"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes of UTF-8 decides where a chunk
ends, so boundaries depend on nearby content only and come back after an
insertion. A boundary that follows another candidate within SHORTEST bytes is
dropped by that local rule, a gap over LONGEST bytes is cut at fixed steps
from its start. Chunks are compared by digest; neighbouring chunks that also
occur in another document form a span. Spans of at least SPAN characters are
reported, which leaves out single common lines.

The ends of a passage that are no whole chunk are not part of its span: it is
on average one chunk (about 33 bytes) shorter on either side.

Positions are code points, ends exclusive. Defined cases: a null or empty text
has no spans; rows equal in id and text are one document; a null id is never
the first holder of a passage that a row with an id has; text repeated only
inside one document is no repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import documents
from lumenframe.session import cut

ONE_IN = 24            # positions per candidate boundary
SHORTEST, LONGEST = 8, 1024
SPAN = 80              # code points of a reported span
# Fixed pseudo-random values per byte: a 16-bit hash sees exactly 16 bytes.
GEAR = (((np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(0xFFFF)).astype(np.uint16)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a byte array, the last one at its length."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        earlier = np.zeros_like(h)
        earlier[step:] = h[:-step] << np.uint16(step)
        h = h + earlier
    ends = np.flatnonzero(h < 65536 // ONE_IN) + 1
    ends = ends[np.diff(ends, prepend=-SHORTEST) >= SHORTEST]
    ends = np.append(ends[ends < len(data)], len(data))
    gaps = np.diff(ends, prepend=0)
    if len(data) and gaps.max() > LONGEST:
        extra = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST])]
        ends = np.sort(np.concatenate([ends, *extra]))
    return ends if len(data) else ends[:0]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and end (code points) of every chunk of a text."""
    for batch in batches:
        digests, ends = [], []
        for value in batch["data"]:
            raw = value.as_buffer().to_pybytes()
            data = np.frombuffer(raw, np.uint8)
            stops = boundaries(data)
            chars = np.cumsum((data & 0xC0) != 0x80)
            ends.append(chars[stops - 1].astype(np.int32) if len(stops) else [])
            stops = stops.tolist()
            digests.append(np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip([0, *stops], stops)], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["key"], pa.array(digests, pa.list_(pa.int64())),
                                          pa.array(ends, pa.list_(pa.int32()))], ["doc_id", "key", "digests", "ends"])


def repeated_spans(df: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, key, start, end, first_doc_id, removed): spans whose chunks all occur in several documents.

    first_doc_id is the smallest id that has one of the chunks. removed: each
    of the chunks has a holder with a smaller id, so dropping the span loses
    nothing; the holder's own span is not removed.
    """
    data = F.coalesce(F.col("text"), F.lit(""))
    keyed = df.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), data.cast("binary").alias("data"))
    chunked = cut(keyed.mapInArrow(_chunked, "doc_id long, key long, digests array<long>, ends array<int>"))
    # Four numbers a chunk: neighbours are known by their ends, ids come back at the end.
    each = chunked.select("key", "ends", F.posexplode(F.arrays_zip("digests", "ends")).alias("k", "c")).select(
        "key", F.col("c.digests").alias("digest"), F.coalesce(F.get("ends", F.col("k") - 1), F.lit(0)).alias("start"), F.col("c.ends").alias("end"))
    holders = chunked.select("doc_id", "key", F.explode("digests").alias("digest"))
    # Counting is combined before the shuffle, so a passage that everybody has is one row per task.
    repeated = holders.groupBy("digest").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("doc_id").alias("first")).filter(
        "a <> b").select("digest", "first")
    # One exchange by document serves both the distinct rows and the windows.
    found = each.join(repeated, "digest").select("key", "start", "end", "first").repartition("key").distinct()
    ids = chunked.select("key", "doc_id").distinct()
    order = Window.partitionBy("key").orderBy("start")
    apart = F.coalesce(F.lag("end").over(order) != F.col("start"), F.lit(True)).cast("int")
    run = (found.withColumn("_apart", apart).withColumn("island", F.sum("_apart").over(order)).join(ids, "key")
           .withColumn("removed", ~F.col("doc_id").eqNullSafe(F.col("first"))))
    # A run's length decides; inside it, what this document has first stays apart from what it repeats.
    whole = Window.partitionBy("key", "island")
    turn = Window.partitionBy("key", "island").orderBy("start")
    parts = run.withColumns({
        "length": F.max("end").over(whole) - F.min("start").over(whole),
        "turned": F.coalesce(F.lag("removed").over(turn) != F.col("removed"), F.lit(False)).cast("int"),
    }).filter(F.col("length") >= span).withColumn("part", F.sum("turned").over(turn))
    return parts.groupBy("key", "island", "part").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.min("first").alias("first_doc_id"), F.first("removed").alias("removed")).drop("island", "part")


def drop_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Documents without the passages that an earlier one has, other columns unchanged."""
    gone = repeated_spans(docs.select("doc_id", "text"), span).filter("removed").groupBy(F.col("key").alias("_gone")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    t = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate("_spans", start, lambda s, x: F.struct(x["end"].alias("at"), F.concat(
        s["out"], F.substring(t, s["at"] + 1, x["start"] - s["at"])).alias("out")),
        lambda s: F.concat(s["out"], F.substring(t, s["at"] + 1, F.char_length(t))))
    joined = docs.withColumn("_key", F.xxhash64("doc_id", "text")).join(gone, F.col("_key") == F.col("_gone"), "left")
    return joined.withColumn("text", F.when(F.col("_spans").isNull(), t).otherwise(rest)).select(*docs.columns)


@query()
def op6_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that several documents share, by document."""
    return repeated_spans(documents(spark, sf_dir)).select("doc_id", "start", "end", "first_doc_id", "removed")
