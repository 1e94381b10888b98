"""Multi-page TIFF as a Spark data source (uncompressed, one sample, 8 or 16 bit).

Reading yields bands of image lines, so memory per task is one band. Files
above a size are split by page; only directory entries are read to plan that.
Region options skip pages, lines and columns before any pixel is decoded.

    spark.dataSource.register(MicroTiff)
    spark.read.format("microtiff").option("path", "/data/*.tif").load()
"""

from __future__ import annotations

import glob
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage)

# ---------------------------------------------------------------- fixed values
# TIFF 6.0 / BigTIFF tags and field type sizes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, SAMPLE_FORMAT = 273, 277, 278, 279, 339
TYPE_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
# -----------------------------------------------------------------------------

BAND_PIXELS = 1 << 20
SPLIT_BYTES = 256 << 20
SCHEMA = "path string, page int, y0 int, rows int, width int, height int, bits int, px array<int>"


@dataclass
class Page:
    width: int
    height: int
    bits: int
    order: str
    offsets: tuple
    rows_per_strip: int


def pages(path: str):
    """Walk a file's image directories."""
    with open(path, "rb") as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError(f"not a TIFF file: {path}")
        magic, = struct.unpack(order + "H", head[2:4])
        if magic not in (42, 43):
            raise ValueError(f"not a TIFF file: {path}")
        big = magic == 43
        count_fmt, entry, slot, ptr = ("Q", 20, 8, "Q") if big else ("H", 12, 4, "I")
        at, = struct.unpack(order + ptr, head[8:16] if big else head[4:8])
        while at:
            f.seek(at)
            n, = struct.unpack(order + count_fmt, f.read(struct.calcsize(count_fmt)))
            block = f.read(n * entry + struct.calcsize(ptr))
            tags = {}
            for i in range(n):
                item = block[i * entry:(i + 1) * entry]
                tag, kind = struct.unpack(order + "HH", item[:4])
                many, = struct.unpack(order + ptr, item[4:4 + struct.calcsize(ptr)])
                code = TYPE_CODES.get(kind)
                if code is None:
                    continue
                fmt = f"{order}{many}{code}"
                size, raw = struct.calcsize(fmt), item[-slot:]
                if size > slot:
                    where, = struct.unpack(order + ptr, raw)
                    f.seek(where)
                    raw = f.read(size)
                tags[tag] = struct.unpack(fmt, raw[:size])
            at, = struct.unpack(order + ptr, block[n * entry:])
            one = lambda t, default: tags.get(t, (default,))[0]
            if one(COMPRESSION, 1) != 1 or one(SAMPLES, 1) != 1 or one(BITS, 1) not in (8, 16) \
                    or one(SAMPLE_FORMAT, 1) != 1:
                raise ValueError(f"unsupported TIFF layout in {path}")
            yield Page(one(WIDTH, 0), one(LENGTH, 0), one(BITS, 8), order, tags[STRIP_OFFSETS],
                       min(one(ROWS_PER_STRIP, 1 << 31), one(LENGTH, 0)))


@dataclass
class Share(InputPartition):
    path: str
    first: int
    last: int | None


def files_of(path: str) -> list[str]:
    """A file, a glob, or the TIFF files of a folder, sorted by name."""
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "*")) if p.lower().endswith((".tif", ".tiff")))
    return sorted(glob.glob(path))


class MicroTiffReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        bound = lambda k: int(options[k]) if k in options else None
        self.page_range = (bound("page_start") or 0, bound("page_end"))
        self.y_range = (bound("y_start") or 0, bound("y_end"))
        self.x_range = (bound("x_start") or 0, bound("x_end"))
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.pixels = str(options.get("pixels", "true")).lower() != "false"

    def partitions(self):
        out = []
        lo, hi = self.page_range
        for path in files_of(self.path):
            size = os.path.getsize(path)
            if size <= self.split_bytes:
                out.append(Share(path, lo, hi))
                continue
            total = sum(1 for _ in pages(path))
            end = total if hi is None else min(hi, total)
            step = max(1, int(total * self.split_bytes / size))
            out += [Share(path, a, min(a + step, end)) for a in range(lo, end, step)]
        return out

    def read(self, share):
        with open(share.path, "rb") as f:
            for number, page in enumerate(pages(share.path)):
                if number < share.first:
                    continue
                if share.last is not None and number >= share.last:
                    break
                yield from self._bands(f, share.path, number, page) if self.pixels else self._header(share.path, number, page)

    @staticmethod
    def _header(path, number, page):
        """One row without pixels: what the page's directory says."""
        yield pa.RecordBatch.from_arrays(
            [pa.array([path]), *[pa.array([v], pa.int32()) for v in (number, 0, 0, page.width, page.height, page.bits)],
             pa.array([[]], pa.list_(pa.int32()))], names=["path", "page", "y0", "rows", "width", "height", "bits", "px"])

    def _bands(self, f, path, number, page):
        kind = np.dtype(page.order + ("u1" if page.bits == 8 else "u2"))
        line = page.width * kind.itemsize
        y_end = min(self.y_range[1] or page.height, page.height)
        x0, x1 = self.x_range[0], min(self.x_range[1] or page.width, page.width)
        band = max(1, BAND_PIXELS // max(page.width, 1))
        y = self.y_range[0]
        while y < y_end and x0 < x1:
            strip, inside = divmod(y, page.rows_per_strip)
            take = min(band, y_end - y, page.rows_per_strip - inside)
            f.seek(page.offsets[strip] + inside * line)
            px = np.frombuffer(f.read(take * line), kind).reshape(take, page.width)[:, x0:x1].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), *[pa.array([v], pa.int32()) for v in
                                     (number, y, take, x1 - x0, page.height, page.bits)],
                 pa.array([px.ravel()], pa.list_(pa.int32()))],
                names=["path", "page", "y0", "rows", "width", "height", "bits", "px"])
            y += take


@dataclass
class Written(WriterCommitMessage):
    files: list


class MicroTiffWriter(DataSourceWriter):
    """Lines (name, pages, page, y, xs, px) to files; a partition must hold whole files in line order.

    The folder must be one that driver and executors share. Tasks write
    temporary files; the driver gives them their names when all tasks are
    done, so a lost or repeated task leaves no half file and no double one.
    """

    def __init__(self, options, overwrite):
        self.folder = options["path"]
        self.width, self.height = int(options["width"]), int(options["height"])
        self.bits = int(options.get("bits", 16))
        self.overwrite = overwrite

    def write(self, rows):
        from pyspark import TaskContext
        attempt = TaskContext.get().taskAttemptId()
        os.makedirs(self.folder, exist_ok=True)
        done, out, name = [], None, None
        for row in rows:
            if row["name"] != name:
                self._close(out, done)
                name = row["name"]
                final = os.path.join(self.folder, name)
                out = PageFile(f"{final}.{attempt}.tmp", final, self.width, self.height, self.bits, row["pages"])
            out.line(row["page"], row["y"], row["xs"], row["px"])
        self._close(out, done)
        return Written(done)

    @staticmethod
    def _close(out, done):
        if out is not None:
            done.append(out.finish())

    def commit(self, messages):
        written = [pair for m in messages if m is not None for pair in m.files]
        for temporary, final in written:
            if not os.path.exists(temporary):
                raise FileNotFoundError(f"{temporary}: executors and driver must share {self.folder}")
        for temporary, final in written:
            os.replace(temporary, final)
        self._drop_leftovers({final for _, final in written})
        if self.overwrite:
            for old in set(files_of(self.folder)) - {final for _, final in written}:
                os.remove(old)

    def abort(self, messages):
        for m in messages:
            for temporary, _ in m.files if m is not None else ():
                if os.path.exists(temporary):
                    os.remove(temporary)

    @staticmethod
    def _drop_leftovers(finals):
        """Temporary files of attempts that lost."""
        for final in finals:
            for left in glob.glob(glob.escape(final) + ".*.tmp"):
                os.remove(left)


class PageFile:
    """Streams pages into a BigTIFF; missing lines and pixels are zero."""

    def __init__(self, temporary, final, width, height, bits, pages=1):
        self.temporary, self.final, self.pages = temporary, final, pages
        self.width, self.height, self.bits = width, height, bits
        self.kind = np.dtype("u1" if bits == 8 else "<u2")
        self.size = width * height * self.kind.itemsize
        self.f = open(temporary, "wb")
        self.f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))
        self.page, self.y = 0, 0
        self._directory(self.page)

    def _directory(self, page):
        """Each page is its directory (8 entries, 176 bytes) followed by one strip."""
        at = self.f.tell()
        tags = [(WIDTH, 4, self.width), (LENGTH, 4, self.height), (BITS, 3, self.bits), (COMPRESSION, 3, 1),
                (PHOTOMETRIC, 3, 1), (STRIP_OFFSETS, 16, at + 176), (ROWS_PER_STRIP, 4, self.height),
                (STRIP_COUNTS, 16, self.size)]
        self.f.write(struct.pack("<Q", len(tags)))
        for tag, kind, value in tags:
            self.f.write(struct.pack("<HHQQ", tag, kind, 1, value))
        self.next_at = self.f.tell()
        self.f.write(struct.pack("<Q", 0))

    def _fill(self, page, y):
        while self.page < page:
            self.f.write(bytes((self.height - self.y) * self.width * self.kind.itemsize))
            start = self.f.tell()
            self.f.seek(self.next_at)
            self.f.write(struct.pack("<Q", start))
            self.f.seek(start)
            self.page, self.y = self.page + 1, 0
            self._directory(self.page)
        self.f.write(bytes((y - self.y) * self.width * self.kind.itemsize))

    def line(self, page, y, xs, px):
        self._fill(page, y)
        data = np.zeros(self.width, self.kind)
        data[np.asarray(xs, np.int64)] = px
        self.f.write(data.tobytes())
        self.y = y + 1

    def finish(self):
        self._fill(max(self.page, self.pages - 1), self.height)
        self.f.close()
        return self.temporary, self.final


class MicroTiff(DataSource):
    @classmethod
    def name(cls):
        return "microtiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return MicroTiffReader(self.options)

    def writer(self, schema, overwrite):
        return MicroTiffWriter(self.options, overwrite)


def to_voxels(bands: DataFrame, channels: int = 1, channel_last: bool = True, depth: int | None = None,
              x_start: int = 0, named: bool = False) -> DataFrame:
    """Bands to (path, c, z, y, x, v).

    ``channel_last``: channels alternate fastest (page = z * channels + c);
    otherwise page = c * depth + z. ``named``: channel and first slice stand
    in the file name, as ``write_stacks`` puts them.
    """
    if named:
        part = lambda tag: F.regexp_extract("path", rf"_{tag}(\d+)", 1).cast("int")
        bands = bands.withColumns({"_c": part("ch"), "_z0": part("z")})
    if channel_last:
        c, z = F.col("page") % channels, F.floor(F.col("page") / channels)
    else:
        if depth is None:
            raise ValueError("depth is needed when channels are outermost")
        c, z = F.floor(F.col("page") / depth), F.col("page") % depth
    if named:
        c, z = F.col("_c") - 1, F.col("page") + F.col("_z0")
    return bands.select("*", F.posexplode("px").alias("_i", "v")).select(
        "path", (c + 1).cast("int").alias("c"), z.cast("int").alias("z"),
        (F.col("y0") + F.floor(F.col("_i") / F.col("width"))).cast("int").alias("y"),
        (F.col("_i") % F.col("width") + x_start).cast("int").alias("x"), "v")


def image_infos(bands: DataFrame) -> DataFrame:
    """(path, pages, height, width, bits) per file. Read with option pixels=false, no pixel is decoded."""
    return bands.groupBy("path").agg(
        (F.max("page") + 1).alias("pages"), F.max("height").alias("height"),
        F.max("width").alias("width"), F.max("bits").alias("bits"))


def write_stacks(voxels: DataFrame, folder: str, width: int, height: int, bits: int, depth: int, stem: str = "image",
                 slices_per_file: int = 64) -> None:
    """Multi-page files of one channel and a run of slices each; missing voxels become 0.

    Lines (one image row) are gathered, sorted per file with spilling and
    streamed out, so a task never holds a page and no task gets a channel.
    """
    first = F.floor(F.col("z") / slices_per_file) * slices_per_file
    name = F.concat(F.lit(f"{stem}_ch"), F.col("c").cast("string"), F.lit("_z"),
                    F.lpad(first.cast("string"), 6, "0"), F.lit(".tif"))
    lines = (voxels.groupBy("c", "z", "y")
             .agg(F.collect_list("x").alias("xs"), F.collect_list(F.col("v").cast("int")).alias("px"))
             .select(name.alias("name"), F.least(F.lit(slices_per_file), depth - first).cast("int").alias("pages"),
                     (F.col("z") - first).cast("int").alias("page"), "y", "xs", "px"))
    (lines.repartition("name").sortWithinPartitions("name", "page", "y")
     .write.format("microtiff").option("path", folder).option("width", width).option("height", height)
     .option("bits", bits).mode("append").save())
