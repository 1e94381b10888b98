"""Weighted rendezvous hashing of record keys over shards.

A record goes to the shard with the smallest -ln(u) / weight, where u is a
uniform hash of (key, shard). The choice among old shards does not depend on
a new one, so adding a shard moves records only into it, and a shard gets its
weight's share whatever the keys are.

Defined cases: a null key is a key like any other, equal keys share a shard; a
null text has size 1 and the checksum of no bytes; slots run from 0 in every
shard that has rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import documents, numbered

SHARDS = 16


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard (int) of ``key`` among ``weights`` (shard: weight > 0)."""
    def cost(shard: int, weight: float) -> Column:
        # 52 hash bits, moved off 0 and 1 so that the logarithm is finite
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / weight).alias("cost"), F.lit(shard).alias("shard"))
    return F.least(*[cost(s, w) for s, w in sorted(weights.items())])["shard"] if len(weights) > 1 else F.lit(next(iter(weights)))


def assign(df: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float] | None = None,
           key: str = "doc_id") -> DataFrame:
    """``df`` with its shard, its slot in the shard, and the shard under ``grown`` weights.

    Columns of these names are replaced. The whole row is materialised once to
    number the slots, so pass the columns that are needed.
    """
    out = df.drop("shard", "slot", "grown_shard")
    out = out.withColumn("shard", shard_of(F.col(key), weights))
    out = out.withColumn("grown_shard", shard_of(F.col(key), grown) if grown else F.lit(None).cast("int"))
    return numbered(out, ["shard"], "slot")


@query()
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of equal weight, and where it goes with a seventeenth."""
    even = lambda n: dict.fromkeys(range(n), 1.0)
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"))
    return assign(rows, even(SHARDS), even(SHARDS + 1)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
