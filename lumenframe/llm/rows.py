"""Helpers shared by the operators: stable materialised rows, gapless numbers, bounded broadcasts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.session import cut, ensure_checkpoint_dir

# A side is broadcast only if it was counted and has at most this many rows,
# of at most a few hundred bytes each.
BROADCAST_ROWS = 100_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))


def tasks(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``limit`` rows. ``df`` should be materialised."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_key(text: str | Column = "text") -> Column:
    """128-bit key of a text; a null text counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def numbered(df: DataFrame, group: Sequence[str], name: str) -> DataFrame:
    """``df`` with a number that runs from 0 without gaps in each group.

    No group is gathered: rows are numbered inside (group, input partition),
    so a task sees at most what one input split held, and the offsets of the
    partitions come from their counts. The rows are materialised once, which
    keeps partition ids the same in both uses.
    """
    spark = df.sparkSession
    rows = cut(df.withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_part")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    first = F.row_number().over(within.orderBy(F.lit(0))) - 1
    return (rows.withColumn("_k", first)
            .join(offsets, [*group, "_part"])
            .withColumn(name, (F.col("_before") + F.col("_k")).cast("long"))
            .select(*[c for c in df.columns], name))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the checkpoint folder and read again: columns that a use does not need are not read."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_one(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` that ``decisions`` (doc_id, text_key, kept) keeps, all columns as they were.

    Most documents stay, so the few refused keys are anti-joined. Rows with the
    same id and text are one key; if such a key stays and has several rows,
    one of them is returned.
    """
    keys = cut(decisions.groupBy("doc_id", "text_key").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    same = F.col("doc_id").eqNullSafe(F.col("_chosen_id")) & (F.col("_text_key") == F.col("_chosen_key"))
    chosen = lambda which: small(keys.filter(which).select(F.col("doc_id").alias("_chosen_id"), F.col("text_key").alias("_chosen_key")))
    out = docs.withColumn("_text_key", text_key()).join(chosen("NOT kept"), same, "left_anti")
    if not keys.filter("kept AND n > 1").isEmpty():
        many = chosen("kept AND n > 1")
        one = out.join(many, same, "left_semi").dropDuplicates(["doc_id", "_text_key"])
        out = out.join(many, same, "left_anti").unionByName(one)
    return out.drop("_text_key")
