"""Exact dedup and sharding against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import exact, shards
from lumenframe.llm.catalog import QUERIES
from lumenframe.llm.rows import keep_one, numbered, text_key

SF = "/root/testdata/sf0.001"


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    return {n: (min(g)[3], len(g)) for n, g in groups.items()}


def test_exact_copies(docs, texts):
    rows = exact.exact_copies(docs.withColumn("source", F.lit("s")).withColumn("kept", F.lit("clash"))).collect()
    want = plain_groups(texts)
    assert len(rows) == len(texts) and all(r.source == "s" for r in rows)
    by_hash = {hashlib.sha256(n.encode()).hexdigest(): g for n, g in want.items()}
    kept = Counter()
    for r in rows:
        assert (r.keep_id, r.group_size) == by_hash[r.text_sha256]
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("parts", ["3", "50"])
def test_hot_text_spreads_and_stays_one_group(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("hot "), F.lit("text"))).otherwise(
            F.concat(F.lit("t"), "id")).alias("text"))
        runs = exact.sorted_runs(df, "text", "doc_id").filter("text = 'hot text'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert runs > int(parts) / 2
        rows = exact.exact_copies(df).filter("group_size > 1").collect()
        assert {(r.keep_id, r.group_size) for r in rows} == {(1, 400)} and sum(r.kept for r in rows) == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_drop_copies_keeps_columns(docs, texts, no_docs):
    extra = docs.withColumns({"kept": F.lit(1), "_id": F.lit(2), "text_sha256": F.lit("x")})
    out = exact.drop_copies(extra)
    assert out.columns == extra.columns and out.count() == len(plain_groups(texts))
    assert exact.drop_copies(no_docs).count() == 0


def test_keep_one_of_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 3), (None, None, 4), (None, "", 5)], "doc_id long, text string, x int")
    all_kept = docs.select("doc_id", text_key().alias("text_key"), F.lit(True).alias("kept"))
    out = keep_one(docs, all_kept).collect()
    assert Counter(r.doc_id for r in out) == {1: 1, 2: 1, None: 1}


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000, numPartitions=7).select((F.col("id") % 3).alias("g"), "id")
    rows = numbered(df, ["g"], "n").collect()
    for g in range(3):
        assert sorted(r.n for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))


def test_shards(spark, docs, no_docs):
    even = dict.fromkeys(range(16), 1.0)
    grown = even | {16: 1.0}
    extra = docs.withColumn("shard", F.lit("clash")).withColumn("other", F.lit(3))
    rows = shards.assign(extra, even, grown).collect()
    by_id = defaultdict(set)
    for r in rows:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.other == 3
        by_id[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_id.values())
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert shards.assign(no_docs, even).count() == 0


def test_weights_and_small_moves(spark):
    keys = spark.range(30_000).withColumnRenamed("id", "doc_id")
    old, new = {0: 1.0, 1: 2.0, 2: 1.0}, {0: 1.0, 1: 2.0, 2: 1.0, 3: 4.0}
    rows = shards.assign(keys, old, new).groupBy("shard", "grown_shard").count().collect()
    share = Counter()
    for r in rows:
        share[r.shard] += r["count"] / 30_000
        assert r.grown_shard in (r.shard, 3)
    assert abs(share[1] - 0.5) < 0.02 and abs(share[0] - 0.25) < 0.02
    assert abs(sum(r["count"] for r in rows if r.grown_shard == 3) / 30_000 - 0.5) < 0.02


def test_shard_query(spark, documents_table):
    rows = {r.doc_id: r for r in QUERIES["op4_sharding"](spark, SF).collect()}
    for d in documents_table.collect():
        data = (d.text or "").encode()
        assert (rows[d.doc_id].size, rows[d.doc_id].text_crc32, rows[d.doc_id].law) == (len(data) + 1, zlib.crc32(data), "key")
