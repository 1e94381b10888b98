"""Near-duplicate documents by probability MinHash.

A text is its five-word shingles (lower case) weighted by how often they occur.
Similarity is the probability Jaccard index of the weights; for shingles that
occur once it is the ordinary Jaccard index. It does not change if all weights
of a text are scaled.

Signatures: every shingle is a Poisson process whose rate is its weight; each
arrival falls into one slot, and a slot keeps the shingle that arrives first.
A shingle stops as soon as its next arrival is later than the latest slot of
its text. All shingles of a batch step together. Slots are cut into bands;
texts that agree in a band share a bucket.

Links are verified exactly, and no pair of a bucket is left out:

1. Copies count once. In each bucket the most central text is compared with
   all others (linear in the bucket; the same pair in several bands is one).
   Verified links give components.
2. A bucket that still holds several components is compared further: members
   outside its largest component with all members of other components. Both
   sides are dealt in chunks of bounded size, so no task holds a whole bucket
   and no pair becomes a row.

A class is a component of links of at least THRESHOLD; its id is its smallest
document id. A pair of similarity 0.8 misses all bands with probability 3e-6.

Defined cases: a null text counts as empty; texts without words are copies of
each other; a text of under five words is one shingle; a null id never names a
class that has another id; classes of rows without ids have a null id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import documents, keep_one, small, tasks, text_key
from lumenframe.operators.components import contract
from lumenframe.session import cut

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
STEP = 200_000         # shingles that go through the signature rounds together
CHUNK = 1 << 18        # shingles on either side of a comparison task
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingle hashes of a text, given the hashes of its words, and their counts."""
    n = max(1, len(words) - k + 1) if len(words) else 0
    total = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        total += words[i:i + n] * ODD[i]
    return np.unique(mix(total), return_counts=True)


def each_words(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Word hashes of every row, without copying."""
    values, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:]):
        yield values[a:b]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int = BANDS * ROWS) -> np.ndarray:
    """(texts, slots): the shingle that arrives first in each slot. Every set has a shingle."""
    doc = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    seed = np.concatenate([h for h, _ in sets])
    rate = np.concatenate([c for _, c in sets]).astype(float)
    first = np.full((len(sets), slots), np.inf)
    flat, winner = first.reshape(-1), np.zeros(len(sets) * slots, np.uint64)
    time, arrival = np.zeros(len(seed)), 0
    while len(seed):
        arrival += 1
        x = mix(seed + np.uint64(arrival * int(GOLDEN) % (1 << 64)))
        time = time - np.log(((x >> np.uint64(11)).astype(float) + 0.5) * 2.0 ** -53) / rate
        early = time < first.max(axis=1)[doc]
        doc, seed, rate, time, x = doc[early], seed[early], rate[early], time[early], x[early]
        at = doc * slots + ((mix(x) >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(flat, at, time)
        won = flat[at] == time
        winner[at[won]] = seed[won]
    return winner.reshape(len(sets), slots)


def buckets(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(texts, bands): one 64-bit number per band, as signed integers."""
    parts = signature.reshape(len(signature), bands, -1)
    total = np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN
    for r in range(parts.shape[2]):
        total = mix(total + parts[:, :, r] * ODD[r % len(ODD)])
    return total.view(np.int64)


def similarity(a: np.ndarray, ca: np.ndarray, b: np.ndarray, cb: np.ndarray) -> float:
    """Probability Jaccard index of two weighted sets (sorted hashes, weights)."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = ca[ia].astype(float), cb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    start = np.searchsorted(x / y, x / y, "left")  # shared shingles with a smaller ratio come before it
    below_x, below_y = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(y)])
    in_a, in_b = float(ca.sum()) - below_x[start], float(cb.sum()) - below_y[-1] + below_y[start]
    return float((1.0 / (in_a / x + in_b / y)).sum())


# ------------------------------------------------------------------ tasks
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a text's number of shingles and its buckets."""
    for batch in batches:
        columns = [batch[c] for c in ("doc_id", "text_key", "words_key")]
        start, sets, size = 0, [], 0
        for i, words in enumerate(each_words(batch["words"])):
            sets.append(shingles(words))
            size += len(sets[-1][0])
            if size >= STEP or i + 1 == batch.num_rows:
                some = [k for k, s in enumerate(sets) if len(s[0])]
                found: list = [[] for _ in sets]
                if some:
                    for k, row in zip(some, buckets(signatures([sets[k] for k in some])).tolist()):
                        found[k] = row
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(start, len(sets)) for c in columns], pa.array([len(s[0]) for s in sets], pa.int64()),
                     pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text_key", "words_key", "n_shingles", "buckets"])
                start, sets, size = i + 1, [], 0


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle hashes and counts as bytes."""
    for batch in batches:
        for i, words in enumerate(each_words(batch["words"])):
            h, c = shingles(words)
            yield pa.RecordBatch.from_arrays([batch["words_key"].slice(i, 1), pa.array([h.tobytes()], pa.binary()),
                                              pa.array([c.astype(np.uint32).tobytes()], pa.binary())], ["words_key", "h", "c"])


def _set(h, c) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint32)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are similar enough, larger key first."""
    for batch in batches:
        keep = [similarity(*_set(ha, ca), *_set(hb, cb)) >= THRESHOLD
                for ha, ca, hb, cb in zip(batch["ha"], batch["ca"], batch["hb"], batch["cb"])]
        yield pa.RecordBatch.from_arrays([batch["hub"], batch["words_key"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _cross(table: pa.Table) -> pa.Table:
    """Links between components in one comparison task: minor members with all others."""
    keys, comps = table["words_key"].to_pylist(), table["comp"].to_pylist()
    minor, other = table["minor"].to_pylist(), table["other"].to_pylist()
    sets = [_set(h, c) for h, c in zip(table["h"], table["c"])]
    members = [i for i, o in enumerate(other) if o]
    parent: dict = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x
    shingle = np.concatenate([sets[i][0] for i in members]) if members else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(members)), [len(sets[i][0]) for i in members])
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    links = []
    for f in (i for i, m in enumerate(minor) if m):
        h, c = sets[f]
        lo, hi = np.searchsorted(shingle, h, "left"), np.searchsorted(shingle, h, "right")
        n = hi - lo
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        # The index is at most the share of f's weight that both have.
        shared = np.bincount(owner[flat], weights=np.repeat(c, n), minlength=len(members))
        for m in np.flatnonzero(shared >= THRESHOLD * c.sum() * (1 - 1e-9)):
            g = members[m]
            a, b = root(comps[f]), root(comps[g])
            if a != b and similarity(h, c, *sets[g]) >= THRESHOLD:
                parent[a] = b
                links.append((keys[f], keys[g]))
    return pa.table({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


# ------------------------------------------------------------------ jobs
def word_hashes(norm: str) -> Column:
    """Hashes of the words of a normalised text; only these numbers reach Python."""
    hashed = F.transform(F.split(norm, " "), lambda w: F.xxhash64(w))
    return F.when(F.col(norm) == "", F.array().cast("array<bigint>")).otherwise(hashed)


def _links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).filter("u <> w").distinct()


def text_sets(frame: DataFrame, wanted: DataFrame, kernel: Callable, prepare: Callable[[DataFrame], DataFrame] = lambda f: f) -> DataFrame:
    """(words_key, h, c): shingles and weights, as bytes, of the wanted texts of ``frame`` (words_key, ...)."""
    found = frame.join(wanted, "words_key", "left_semi").dropDuplicates(["words_key"])
    return cut(prepare(found).mapInArrow(kernel, "words_key binary, h binary, c binary"))


def near_classes(df: DataFrame) -> DataFrame:
    """(doc_id, text_key, class_id, class_size, kept) of every row of ``df`` (doc_id, text).

    Of each class one row is kept: the smallest id, null last, then the smallest text key.
    """
    space = " \t\n\x0b\f\r"
    norm = F.regexp_replace(F.btrim(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(space)), "[\\x20\\x09-\\x0D]+", " ")
    normed = df.select("doc_id", text_key().alias("text_key"), norm.alias("norm")).withColumn(
        "words_key", F.unhex(F.md5(F.col("norm").cast("binary"))))
    hashed = lambda f: f.select("words_key", word_hashes("norm").alias("words"))
    rows = cut(normed.select("doc_id", "text_key", "words_key", word_hashes("norm").alias("words")).mapInArrow(_signed, "doc_id long, text_key binary, words_key binary, n_shingles long, buckets array<long>"))
    return classes_of(rows, lambda wanted: text_sets(normed.select("words_key", "norm"), wanted, _sets, hashed))


def classes_of(rows: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Classes of materialised ``rows`` (doc_id, text_key, words_key, n_shingles, buckets).

    Rows of one words_key are copies. ``sets_of`` gives the weighted sets
    (words_key, h, c) of the keys it is asked for, materialised.
    """
    spark = rows.sparkSession
    texts = rows.dropDuplicates(["words_key"])
    every = texts.select("words_key", "n_shingles", F.explode("buckets").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut(every.join(shared, "bucket"))
    central = members.groupBy("words_key").agg(F.sum("size").alias("weight"))
    ranked = members.join(central, "words_key")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("weight", "words_key"))["words_key"].alias("hub"))
    pairs = cut(ranked.select("bucket", "words_key").join(hubs, "bucket").filter("hub <> words_key")
                .select("hub", "words_key").distinct())

    sets = sets_of(small(cut(members.select("words_key").distinct())))
    # A hub may meet a third of all texts: both sides are salted by the other text.
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("words_key"), F.lit(tasks(spark))))
    left = salted.select("hub", "salt").distinct().join(sets.toDF("hub", "ha", "ca"), "hub")
    right = salted.join(sets.toDF("words_key", "hb", "cb"), "words_key")
    links = cut(_links(right.join(left, ["hub", "salt"]).select("hub", "words_key", "ha", "ca", "hb", "cb")
                       .mapInArrow(_verified, "a binary, b binary")))
    labels = contract(links, []) if not links.isEmpty() else None

    def comp(frame: DataFrame) -> DataFrame:
        if labels is None:
            return frame.withColumn("comp", F.col("words_key"))
        return (frame.join(labels.toDF("words_key", "_root"), "words_key", "left")
                .withColumn("comp", F.coalesce("_root", "words_key")).drop("_root"))

    # Buckets of two texts are done. Of buckets with the same members one is enough.
    placed = comp(members.filter("size > 2"))
    parts = placed.groupBy("bucket", "comp").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.bit_xor(F.xxhash64("words_key")).alias("x"),
        F.bit_xor(F.xxhash64("words_key", F.lit(1))).alias("y"))
    open_ = (parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("comps"), F.max(F.struct("n", "comp"))["comp"].alias("major"), F.sum("weight").alias("total"),
        (F.sum("weight") - F.max(F.struct("n", "comp", "weight"))["weight"]).alias("rest"),
        F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("comps > 1")
        .groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "major", "total", "rest")).alias("b")).select("b.*"))
    deal = lambda c: F.pmod(F.xxhash64("words_key"), F.ceil(F.col(c) / CHUNK).cast("long"))
    spread = lambda c: F.sequence(F.lit(0).cast("long"), F.ceil(F.col(c) / CHUNK).cast("long") - 1)
    left_over = cut(placed.join(open_, "bucket"))
    if not left_over.isEmpty():
        is_minor = F.col("comp") != F.col("major")
        as_minor = left_over.filter(is_minor).select("bucket", "words_key", "comp", deal("rest").alias("i"), F.explode(spread("total")).alias("j"),
                                                     F.lit(True).alias("minor"), F.lit(False).alias("other"))
        as_other = left_over.select("bucket", "words_key", "comp", F.explode(spread("rest")).alias("i"), deal("total").alias("j"),
                                    F.lit(False).alias("minor"), F.lit(True).alias("other"))
        more = (as_minor.unionByName(as_other).join(sets, "words_key").groupBy("bucket", "i", "j")
                .applyInArrow(_cross, "a binary, b binary"))
        links = cut(links.unionByName(_links(more)).distinct())
        labels = contract(links, []) if not links.isEmpty() else None

    # The row that stays: smallest id, nulls last. Rows equal in id and text differ in their place alone.
    placed_rows = rows.withColumn("_place", F.monotonically_increasing_id())
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "_place")
    copies = comp(placed_rows.groupBy("words_key").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")))
    classes = copies.groupBy("comp").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"))
    known = copies.drop("first").join(classes.filter("class_size > 1"), "comp").select(
        "words_key", F.col("first.doc_id").alias("class_id"), "class_size", F.col("first._place").alias("_kept"))
    return (placed_rows.join(small(cut(known)), "words_key", "left")
            .select("doc_id", "text_key", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
                    (F.col("class_size").isNull() | (F.col("_place") == F.col("_kept"))).alias("kept")))


def drop_near(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each class one row stays, columns unchanged."""
    return keep_one(docs, near_classes(docs.select("doc_id", "text")).select("doc_id", "text_key", "kept"))


@query()
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near-duplicates."""
    return near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")
