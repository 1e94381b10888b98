"""Packing by power-of-two decomposition.

A document of n tokens becomes n // longest pieces of the longest length and
one piece for every bit of the rest, the longest first. Each piece is a
sequence of its own: its length is a power of two, so nothing is padded and no
sequence crosses documents. Sequences of equal length form a bucket and get
neighbouring numbers, which is the order a loader batches them in.

Tasks encode, cut and count: a piece gets its number among the pieces of its
length in its task. The table of pieces is written once; the numbers of pieces
per task and length then say where each task's numbers start, so no piece is
shuffled or sorted to be numbered.

Defined cases: a null or empty text has its end token alone (one piece of
length 1); equal rows are packed each; null ids stay null; other columns of
the input are not carried; texts of any length go through in slices of output.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm import bpe
from lumenframe.llm.catalog import query
from lumenframe.llm.rows import documents, small, stored, tokenizer_path

LONGEST = 4096
END_TOKEN = 2
SLICE = 4 << 20         # bytes of ids in one batch of output


def cuts(n: int, longest: int = LONGEST) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, then the bits of the rest from the highest down."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    out = [(start, longest) for start in range(0, n - longest + 1, longest)]
    start = n - n % longest
    for bit in reversed(range(longest.bit_length() - 1)):
        if n % longest >> bit & 1:
            out.append((start, 1 << bit))
            start += 1 << bit
    return out


def pieces(df: DataFrame, path: str, longest: int = LONGEST, end_token: int | None = END_TOKEN) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, bucket, part, place): every piece of ``df`` (doc_id, text).

    ``ids`` are four little-endian bytes a token; ``place`` counts the pieces of a bucket (log2 of the length) in the
    task ``part``.
    """
    cuts(0, longest)
    content, end = bpe.content_of(df.sparkSession, path), b"" if end_token is None else end_token.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, placed = bpe.codec(content.value), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            size = 0

            def out() -> pa.RecordBatch:
                at, start, length, ids, crc, tokens, bucket, place = zip(*rows)
                long = lambda v: pa.array(v, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(at)), long(start), long(length), pa.array(ids, pa.binary()), long(crc), long(tokens),
                     pa.array(bucket, pa.int32()), pa.array([part] * len(at), pa.int32()), long(place)], names)
            texts = (str(t.as_buffer(), "utf-8", "replace") if t.is_valid else "" for t in batch["text"])
            for i, ids in enumerate(codec.encode_all(texts)):
                ids += end
                for start, length in cuts(len(ids) // 4, longest):
                    piece, bucket = ids[4 * start:4 * (start + length)], length.bit_length() - 1
                    rows.append((i, start, length, piece, zlib.crc32(piece), len(ids) // 4, bucket, placed[bucket]))
                    placed[bucket] += 1
                    size += len(piece)
                    if size >= SLICE:
                        yield out()
                        rows, size = [], 0
            if rows:
                yield out()
    ident = df.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ident}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, bucket int, part int, place long"
    names = [f.split()[0] for f in schema.split(", ")]
    return df.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def pack(df: DataFrame, path: str, longest: int = LONGEST, end_token: int | None = END_TOKEN) -> DataFrame:
    """(doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset, bucket): every piece and its place."""
    rows = stored(pieces(df, path, longest, end_token))
    sizes = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    tasks_before = sizes.withColumn("_tasks", F.coalesce(F.sum("n").over(earlier("bucket", "part")), F.lit(0)))
    # Buckets follow each other: at most one row per power of two.
    buckets = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(earlier("bucket")), F.lit(0)).alias("_buckets"))
    first = tasks_before.join(F.broadcast(buckets), "bucket").select("bucket", "part", (F.col("_tasks") + F.col("_buckets")).alias("_first"))
    return (rows.join(small(first), ["bucket", "part"])
            .select("doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("place")).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset"), "bucket"))


@query()
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into sequences of power-of-two length."""
    return pack(documents(spark, sf_dir), tokenizer_path()).drop("ids")
