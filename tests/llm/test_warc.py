"""WARC round trips and boundary chains."""

import base64
import hashlib
import os
import tempfile

from pyspark.sql import functions as F

from lumenframe.llm import warc

DATE = "2025-01-01T00:00:00Z"
MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="warc-"), "out")


def pages(spark):
    inner = "x\r\n\r\n" + MAGIC + "tail\nWARC/1.1\r\nContent-Length: 999999\r\n\r\n"
    rows = [(1, "http://a/1", "same"), (2, None, "same"), (3, "http://a/ b\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 700), (6, "u", inner), (7, "u", inner + "!"),
            (8, "u", "\nWARC/1." * 30), (9, "u", "WARC/1.1\r\n"), (None, "u", "without id"), (10, "u", "twice"), (10, "u", "twice"), (11, "u", "\r\n\r\n" * 50)]
    rows += [(100 + i, "u", f"page {i} " * (i % 40)) for i in range(60)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))


def check(rows, got):
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(i or -1, largest.get(h or "", -1))
    assert len(got) == len(rows)
    seen = sorted((r.record_id, r.record_type) for r in got)
    name = lambda i: f"{warc.ID}{'null' if i is None else i}"
    revisit = lambda i, h: largest[h or ""] not in (i, -1)
    assert seen == sorted((name(i), "revisit" if revisit(i, h) else "response") for i, _, h in rows)
    want = {name(i): (i, (h or "").encode()) for i, _, h in rows}
    for r in got:
        i, data = want[r.record_id]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if r.record_type == "response":
            assert bytes(r.payload) == data and r.refers_to is None
        else:
            assert r.payload is None and r.refers_to == name(largest[data.decode()])


def test_round_trip_over_many_splits(spark):
    rows, df = pages(spark)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "1500b"):
            path = folder()
            warc.write(df.repartition(2), path, DATE)
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            check(rows, warc.read(spark, path).collect())
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_files_are_plain_warc(spark):
    rows, df = pages(spark)
    path = folder()
    warc.write(df.repartition(2), path, DATE, least_bytes=5)
    n = revisits = 0
    for f in os.listdir(path):
        data = open(os.path.join(path, f), "rb").read() if f.startswith("part-") else b""
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            length = int(head.rpartition(b"Content-Length: ")[2])
            assert rest[length:length + 4] == b"\r\n\r\n"
            n, revisits, data = n + 1, revisits + (b"Type: revisit" in head), rest[length + 4:]
    # "same" and the empty payloads are under five bytes: all of these are responses
    assert n == len(rows) and revisits == sum(1 for i, _, h in rows if h and len(h.encode()) >= 5 and i is not None and any(
        j is not None and j > i and h == g for j, _, g in rows))


def test_damaged_and_empty_archives(spark):
    path = tempfile.mkdtemp(prefix="warc-")
    open(os.path.join(path, "a.warc"), "w", newline="").write(MAGIC + MAGIC + MAGIC[:-8])
    open(os.path.join(path, "b.warc"), "w", newline="").write("junk\n" + MAGIC)
    open(os.path.join(path, "c.warc"), "w", newline="").write("")
    assert [r.offset for r in warc.read(spark, path).orderBy("offset").collect()] == [0, len(MAGIC)]
    out = folder()
    warc.write(pages(spark)[1].limit(0), out, DATE)
    assert warc.read(spark, out).count() == 0
