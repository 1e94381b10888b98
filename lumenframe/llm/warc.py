"""Web archives (WARC/1.1): writing, and reading split files by verified boundaries.

A file is read in pieces that start at the record magic, wherever Spark splits
it. Some of these starts are no records but bytes inside a payload. Every
start is a candidate with one possible successor, the offset after its declared
length; the true records are those that the chain from the file's first byte
reaches. Tasks follow chains inside a split and keep, per candidate, where its
chain leaves the split; pointer jumping over these exits (one row per
candidate, log2(splits of a file) rounds) finds where the true chain enters
each split, and each split then marks its own part of it.

A record with magic inside its payload lies in several pieces; only such
pieces are shuffled and put together again.

Defined cases: a null payload is empty; a null or odd url keeps the record
(line breaks and spaces in it are escaped); rows of a null id are written too;
of rows that share the largest id of a group, all are responses; a file that
does not begin with a record has none; a record cut off by the file's end is
left out; empty tables give empty archives.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import small
from lumenframe.session import cut, ensure_checkpoint_dir

MAGIC = b"WARC/1."
BREAK = "\nWARC/1."     # what stands between two pieces of a file
END = "\r\n\r\n"        # after a header, and after a record
ID = "urn:lumenframe:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})(?=\r\n|$)")
FIELD = re.compile(rb"\r\n([^:\r\n]+):[ \t]*([^\r\n]*)")


# ------------------------------------------------------------------ writing
def base32(hexed: Column) -> Column:
    """Upper-case base 32 of a 40-digit hexadecimal number: 5 digits make 4 letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write(df: DataFrame, path: str, date: str, ident: str = "page_id", url: str = "url", payload: str = "html",
          least_bytes: int = 0, records_per_file: int = 100_000) -> None:
    """One record per row. Of equal payloads of at least ``least_bytes`` the row
    with the largest id is a response and the others revisit it."""
    body = F.coalesce(F.col(payload), F.lit(""))
    raw = body.cast("binary")
    rows = df.select(F.col(ident).alias("id"), F.col(url).alias("url"), body.alias("body"), F.sha2(raw, 256).alias("key"),
                     base32(F.sha1(raw)).alias("digest"), F.octet_length(raw).alias("size"))
    groups = cut(rows.filter(F.col("size") >= least_bytes).groupBy("key").agg(
        F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keep IS NOT NULL").select("key", "keep"))
    rows = rows.join(small(groups), "key", "left")
    revisit = F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    urn = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, "body"))
    escaped = F.regexp_replace(F.regexp_replace("url", "[\r\n]", "%0A"), "[\\x00-\\x20]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")), F.lit(f"\r\nWARC-Date: {date}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), escaped), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), urn(F.col("keep")))).otherwise(""),
        F.lit("\r\nContent-Length: "), F.octet_length(block), F.lit(END))
    # Spark ends every line with the separator, which is a record's end here.
    (rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", records_per_file).text(path))


# ------------------------------------------------------------------ reading
def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): pieces of the files, in file order inside a partition."""
    return spark.read.option("lineSep", BREAK).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _in_order(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """(file, split, number in the split, other columns) of every piece."""
    at, k = None, 0
    for batch in batches:
        for file, split, *rest in zip(batch["file"].to_pylist(), batch["split"].to_pylist(), *[batch[n] for n in names]):
            at, k = ((file, split), 0) if at != (file, split) else (at, k + 1)
            yield file, split, k, *[x.as_py() for x in rest]


def _length(head: bytes) -> int:
    """Declared block length of a header (after the magic), -1 if it is none."""
    found = LENGTH.findall(b"\r\n" + head.partition(b"\r\n")[2]) if head[:1].isdigit() and head[1:3] == b"\r\n" else []
    return int(found[0]) if len(found) == 1 else -1


def _split_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: offsets of its candidates and of their successors,
    counted from the split's first candidate, and where each chain leaves the split."""
    def row(file, split, offsets, nexts, end):
        index = {o: i for i, o in enumerate(offsets)}
        leaves = [-1] * len(offsets)
        for i in range(len(offsets) - 1, -1, -1):
            j = index.get(nexts[i])
            leaves[i] = leaves[j] if j is not None and j > i else nexts[i] if nexts[i] >= end else -1
        return pa.RecordBatch.from_pylist([{"file": file, "split": split, "bytes": end, "offsets": offsets, "nexts": nexts, "leaves": leaves}], CHAINS)
    key, offsets, nexts, at = None, [], [], 0
    for file, split, k, head, size, full in _in_order(batches, "head", "size", "full"):
        if k == 0:
            if key:
                yield row(*key, offsets, nexts, at)
            key, offsets, nexts, at = (file, split), [], [], 0
        first = split == 0 and k == 0  # the file's first piece still has its magic
        if first:
            ok, head, size = head.startswith(MAGIC), head[len(MAGIC):], size - len(MAGIC)
        length = _length(head) if full and not (first and not ok) else -1
        offsets.append(at)
        nexts.append(at + len(MAGIC) + len(head) + len(END) + length + len(END) if length >= 0 else -1)
        at += len(BREAK) + size
    if key:
        yield row(*key, offsets, nexts, at)


CHAINS = pa.schema([("file", pa.string()), ("split", pa.int64()), ("bytes", pa.int64()), ("offsets", pa.list_(pa.int64())),
                    ("nexts", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int64()))])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of every split: verified if the chain from the entry passes them; owner: the record they lie in."""
    for batch in batches:
        for r in batch.to_pylist():
            index = {o: i for i, o in enumerate(r["offsets"])}
            true, i = set(), index.get(r["entry"])
            while i is not None and i not in true:
                if r["nexts"][i] >= 0:
                    true.add(i)
                i = index.get(r["nexts"][i])
            n = len(r["offsets"])
            yield pa.RecordBatch.from_pydict({
                "file": [r["file"]] * n, "split": [r["split"]] * n, "k": list(range(n)),
                "offset": [r["base"] + o for o in r["offsets"]],
                "next": [r["base"] + x for x in r["nexts"]], "verified": [i in true for i in range(n)]},
                pa.schema([("file", pa.string()), ("split", pa.int64()), ("k", pa.int64()), ("offset", pa.int64()),
                           ("next", pa.int64()), ("verified", pa.bool_())]))


def boundaries(pieces: DataFrame) -> DataFrame:
    """(file, split, k, offset, next, verified): every candidate and whether it is a record."""
    head = F.substring_index("value", END, 1)
    heads = pieces.select("file", "split", head.cast("binary").alias("head"), F.octet_length("value").cast("long").alias("size"),
                          (F.octet_length(head) < F.octet_length("value")).alias("full"))
    chains = cut(heads.mapInArrow(_split_chains, "file string, split long, bytes long, offsets array<long>, nexts array<long>, leaves array<long>"))
    # Pieces follow each other without gaps, so a split's first candidate stands after all earlier bytes.
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    based = chains.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    hops = (based.select("file", "split", "base", F.explode(F.arrays_zip("offsets", "leaves")).alias("c"))
            .select("file", "split", (F.col("base") + F.col("c.offsets")).alias("offset"),
                    F.when(F.col("c.leaves") >= 0, F.col("base") + F.col("c.leaves")).alias("next")))
    # Only the start of a file and places where some chain leaves a split can be entries.
    doors = hops.filter("next IS NOT NULL").select("file", F.col("next").alias("offset")).distinct()
    hops = cut(hops.filter("offset = 0").unionByName(hops.filter("offset > 0").join(doors, ["file", "offset"], "left_semi")
                                                     .select("file", "split", "offset", "next")))
    reached = hops.filter("offset = 0").select("file", "offset")
    jumps = hops.filter("next IS NOT NULL").select("file", "offset", "next")
    known = reached.count()
    while True:
        steps = reached.join(jumps, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reached = cut(reached.unionByName(steps).distinct())
        if (n := reached.count()) == known:
            break
        known = n
        further = jumps.select("file", F.col("offset").alias("from"), F.col("next").alias("offset")).join(
            jumps, ["file", "offset"], "left")
        # A jump past the last door stays where it is.
        jumps = cut(further.select("file", F.col("from").alias("offset"), F.coalesce("next", "offset").alias("next")))
    entries = hops.join(reached, ["file", "offset"]).select("file", "split", F.col("offset").alias("_entry"))
    rows = based.join(entries, ["file", "split"], "left").withColumn("entry", F.col("_entry") - F.col("base"))
    return rows.select("file", "split", "base", "entry", "offsets", "nexts").mapInArrow(
        _mark, "file string, split long, k long, offset long, next long, verified boolean")


def _parser(with_payload: bool):
    """Fields of whole records. A piece that is not one whole record gives a row without type."""
    def parse(record: bytes) -> dict:
        head, _, rest = record.partition(END.encode())
        length = _length(head)
        if length < 0 or len(rest) < length or rest[length:].strip(b"\r\n"):
            return {}
        fields = {k.decode("latin-1").lower(): v.decode("utf-8", "replace") for k, v in FIELD.findall(b"\r\n" + head.partition(b"\r\n")[2])}
        http, _, payload = rest[:length].partition(END.encode())
        revisit = fields.get("warc-type") == "revisit"
        size = LENGTH.search(http)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        return {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id", "").strip("<>"),
                "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
                "payload_digest": fields.get("warc-payload-digest", "").rpartition(":")[2] if revisit else digest,
                "payload_bytes": int(size[1]) if revisit and size else len(payload),
                "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                "payload": payload if with_payload and not revisit else None}

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("k", pa.int64()), *FIELDS])
        rows, held = [], 0
        for file, split, k, value in _in_order(batches, "value"):
            if split == 0 and k == 0:
                value = value[len(MAGIC):]
            rows.append({"file": file, "split": split, "k": k} | parse(value))
            held += len(value)
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)
    return parse, parsed


FIELDS = [("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()),
          ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())]
DDL = "record_type string, record_id string, url string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(file, offset, record_type, record_id, url, date, payload_digest,
    payload_bytes, refers_to, payload) of every record.

    Digest and size of a response are those of the payload read; of a revisit,
    which has none, those it declares. Without payloads only the small fields
    are shuffled.
    """
    parse, parsed = _parser(with_payload)
    pieces = _pieces(spark, path).withColumn("value", F.col("value").cast("binary"))
    found = cut(boundaries(_pieces(spark, path)))
    # A candidate that is no record may lie inside the last record before it (files have a bounded size).
    order = Window.partitionBy("file").orderBy("offset")
    holder = F.last(F.when(F.col("verified"), F.struct("offset", "next")), True).over(order)
    owned = found.withColumn("_holder", holder).filter(F.col("offset") < F.col("_holder.next")).withColumn("owner", F.col("_holder.offset"))
    owners = owned.filter("NOT verified").select("file", "owner").distinct()
    broken = cut(owned.join(owners, ["file", "owner"], "left_semi").select("file", "split", "k", "offset", "owner"))
    keys = ["file", "split", "k"]
    whole = found.filter("verified").join(broken.select(*keys), keys, "left_anti").select(*keys, "offset")
    names = [n for n, _ in FIELDS]
    out = (pieces.mapInArrow(parsed, f"file string, split long, k long, {DDL}").filter("record_type IS NOT NULL")
           .join(whole, keys).select("file", "offset", *names))
    if broken.isEmpty():
        return out

    def number(batches):
        for file, split, k, value in _in_order(batches, "value"):
            yield pa.RecordBatch.from_pylist([{"file": file, "split": split, "k": k, "value": value[len(MAGIC):] if split == 0 and k == 0 else value}])

    def rebuilt(batches):
        for batch in batches:
            for r in batch.to_pylist():
                row = {"file": r["file"], "offset": r["offset"]} | parse(BREAK.encode().join(r["parts"]))
                yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), ("offset", pa.int64()), *FIELDS]))

    parts = pieces.mapInArrow(number, "file string, split long, k long, value binary").join(small(broken), keys)
    joined = parts.groupBy("file", F.col("owner").alias("offset")).agg(F.transform(F.array_sort(F.collect_list(
        F.struct("offset", "value"))), lambda x: x["value"]).alias("parts"))
    again = joined.mapInArrow(rebuilt, f"file string, offset long, {DDL}").filter("record_type IS NOT NULL")
    return out.unionByName(again.select("file", "offset", *names))


@query("""
    WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
    k AS (SELECT *, count(*) OVER (PARTITION BY html) n, max(page_id) OVER (PARTITION BY html) keep FROM p),
    d AS (SELECT *, sha1(html) h FROM k),
    b AS (SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(h, 5 * g + 1, 5) AS BIGINT)) v FROM d)
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
           CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
    FROM b
""")
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4()}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, date="2025-01-01T00:00:00Z")
    page = lambda c: F.regexp_extract(c, "([0-9-]+)$", 1).try_cast("long")
    return read(spark, path, with_payload=False).select(
        page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))
