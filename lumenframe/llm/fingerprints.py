"""Document fingerprints by MinHash over universal hash permutations.

A text is the set of its five-word shingles: words are runs without white
space after lower-casing. A shingle is a 64-bit number; slot i of the
fingerprint is the smallest value of ``a_i * shingle + b_i`` (upper half of 64
bits, a_i odd), so the share of equal slots estimates the Jaccard index of two
shingle sets. numpy works on one matrix of shingles by slots at a time, whose
size is bounded, whatever the text is.

``near_copies`` cuts signatures into bands, joins the bands in Spark and
verifies the Jaccard index of what meets there.

``edited_likeness`` needs every document's successor. Rows are range-
partitioned by descending id and stream through their partition, each waiting
for the next. Where a partition ends, its last row meets the first row of the
next partition in a join of one row per partition.

Defined cases: a null text counts as empty; a text without words has no
shingle, a fingerprint of largest values, and is alike only to others of its
kind; under five words are one shingle; null ids come after all others, equal
ids follow each other by a digest of the text; a single document follows
itself; an empty table gives an empty one; other columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.catalog import query
from lumenframe.llm.near import classes_of, mix, text_sets
from lumenframe.llm.rows import documents, tasks, text_key
from lumenframe.session import cut

WORDS = 5
SLOTS = 64
BANDS, ROWS = 16, 4     # of the 64 slots: a pair of 0.8 shares a band with probability 0.9998
THRESHOLD = 0.8
MATRIX = 1 << 12        # shingles that meet all permutations at a time
SEED = 13

_draw = np.random.default_rng(SEED)
FACTOR = _draw.integers(0, 1 << 63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _draw.integers(0, 1 << 63, SLOTS, np.uint64)
PLACES = _draw.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
REMEMBERED = 100_000    # words whose numbers a Python worker keeps; a full memory is emptied


class WordNumbers(dict):
    """64-bit number of a word's bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        number = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = number
        return number


_numbers = WordNumbers()


def shingle_numbers(text: str, k: int = WORDS) -> np.ndarray:
    """Shingles of a text in order of place."""
    found = text.lower().encode("utf-8", "replace").split()   # bytes split at ASCII white space alone
    words = np.fromiter(map(_numbers.__getitem__, found), np.uint64, len(found))
    n = max(1, len(words) - k + 1) if len(words) else 0
    total = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        total += words[i:i + n] * PLACES[i]
    return mix(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest value of every permutation, 32 bits each."""
    least = np.full(SLOTS, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), MATRIX):
        values = shingles[a:a + MATRIX, None] * FACTOR + SHIFT >> np.uint64(32)
        least = np.minimum(least, values.min(axis=0))
    return least.astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    return signature(shingle_numbers(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def as_text(value: pa.Scalar) -> str:
    return str(value.as_buffer(), "utf-8", "replace") if value.is_valid else ""


# ------------------------------------------------------------------ successors
RESULT = "doc_id long, n_chars long, edited binary, mine binary, other binary, near_edited double, near_next double"
# ``part`` numbers partitions; ``head`` is a partition's first text, ``tail`` the last one, whose row is still open.
EDGES = RESULT + ", part int, head binary, tail binary"
TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _row(ident, text: str, mine: np.ndarray, following: str, theirs: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return (ident, len(text), hashlib.sha256(changed.encode("utf-8", "replace")).digest(), mine.astype(">u4").tobytes(),
            other.astype(">u4").tobytes(), likeness(mine, other), likeness(mine, theirs))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, TYPES[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted partition with the row after it; the last one stays open."""
    part, held, head = TaskContext.get().partitionId(), None, None
    for batch in batches:
        out = []
        for ident, value in zip(batch["doc_id"].to_pylist(), batch["text"]):
            text = as_text(value)
            row = (ident, text, fingerprint(text))
            if held:
                out.append((*_row(*held, *row[1:]), part, head, None))
                head = None
            else:
                head = text.encode()
            held = row
        yield _batch(out, EDGES)
    if held:
        yield _batch([(held[0], *[None] * 6, part, head, held[1].encode())], EDGES)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come with the text after them, one at a time."""
    for batch in batches:
        for ident, value, after in zip(batch["doc_id"].to_pylist(), batch["tail"], batch["head"]):
            text, following = as_text(value), as_text(after)
            yield _batch([_row(ident, text, fingerprint(text), following, fingerprint(following))], RESULT)


def edited_likeness(df: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text takes its end from the next document by descending id.
    Equal rows are told apart by their place in the input, so that no id and
    no text is bound to one task.
    """
    order = [F.desc_nulls_last("doc_id"), F.col("key"), F.col("place")]
    keyed = df.select("doc_id", F.col("text").cast("binary").alias("text"), text_key().alias("key"),
                      F.monotonically_increasing_id().alias("place"))
    rows = cut(keyed.repartitionByRange(tasks(df.sparkSession), *order).sortWithinPartitions(*order)
               .select("doc_id", "text").mapInArrow(_streamed, EDGES))
    heads = rows.filter("head IS NOT NULL").select("part", "head")   # one row per partition
    parts, every = Window.orderBy("part"), Window.partitionBy()      # over their numbers alone
    turn = heads.select("part", F.coalesce(F.lead("part").over(parts), F.min("part").over(every)).alias("next"))
    seams = (rows.filter("tail IS NOT NULL").select("doc_id", "tail", "part").join(turn, "part")
             .join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "tail", "head"))
    done = rows.filter("tail IS NULL").drop("part", "head", "tail").unionByName(seams.mapInArrow(_paired, RESULT))
    text = lambda c, name: F.lower(F.hex(c)).alias(name)
    return done.select("doc_id", "n_chars", text("edited", "edited_sha256"), text("mine", "fingerprint"),
                       text("other", "edited_fingerprint"), "near_edited", "near_next")


# ------------------------------------------------------------------ near copies
def band_numbers(sign: np.ndarray) -> list[int]:
    """One signed 64-bit number per band."""
    parts = sign.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * FACTOR[0]
    for r in range(ROWS):
        total = mix(total + parts[:, r] * PLACES[r])
    return total.view(np.int64).tolist()


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a text's number of shingles and its bands."""
    for batch in batches:
        sets = [np.unique(shingle_numbers(as_text(t))) for t in batch["text"]]
        columns = [batch[c] for c in ("doc_id", "text_key", "words_key")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([len(s) for s in sets], pa.int64()),
             pa.array([band_numbers(signature(s)) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
            ["doc_id", "text_key", "words_key", "n_shingles", "buckets"])


def _plain_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles as a set: every one counts once, so the index is the ordinary Jaccard index."""
    for batch in batches:
        for i, t in enumerate(batch["text"]):
            s = np.unique(shingle_numbers(as_text(t)))
            yield pa.RecordBatch.from_arrays([batch["words_key"].slice(i, 1), pa.array([s.tobytes()], pa.binary()),
                                              pa.array([np.ones(len(s), np.uint32).tobytes()], pa.binary())], ["words_key", "h", "c"])


def near_copies(df: DataFrame) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, kept) of every row: classes linked by a Jaccard index of 0.8 or more.

    Signature bands are joined in Spark: each band's bucket compares its most
    central text with the others, then what is still apart in chunks; links
    are verified on whole shingle sets. A class has its smallest id as name
    and keeps one row.
    """
    keyed = df.select("doc_id", text_key().alias("text_key"), text_key().alias("words_key"), F.col("text").cast("binary").alias("text"))
    rows = cut(keyed.mapInArrow(_banded, "doc_id long, text_key binary, words_key binary, n_shingles long, buckets array<long>"))
    return classes_of(rows, lambda wanted: text_sets(keyed.select("words_key", "text"), wanted, _plain_sets))


@query()
def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return edited_likeness(documents(spark, sf_dir))
