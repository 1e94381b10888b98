"""Phrase collocations by Toivonen's sampling method.

A phrase is a run of words inside a piece of a text. Phrases of one to
LONGEST words that occur at least ``least`` times in their language are
frequent; the method finds all of them with their exact counts:

1. A sample of the documents proposes phrases, with a lowered threshold.
2. One pass over all documents counts the proposed phrases and their negative
   border. The border is every phrase whose first and last part (one word
   shorter) are both proposed; for single words it is every word.
3. A border phrase that turns out frequent was not proposed, so longer phrases
   around it were never counted. Such failures trigger a further pass, which
   counts what they open up, and what that opens up in turn; it closes the set.
4. The passes add up numbers by 64-bit hashes of phrases. A number by hash is
   never below a phrase's own, so no frequent phrase is lost. Each hash that
   reaches ``least`` comes with the place of one block that has it; a last pass
   takes its phrase from blocks of that place alone, one row per phrase however
   many tasks there are.
5. The last pass also adds up a second 64-bit hash of every occurrence, by
   buckets of first hashes. If a bucket's sums are what its phrases and numbers
   give, no two phrases shared a hash (but for a chance of 2^-64 that a shared
   one goes unnoticed). The phrases of any other bucket are counted one by one.

What is proposed or chosen travels as a Bloom filter with a few bytes per
phrase, 64 MB at most. Bits that phrases share let more phrases be counted,
never fewer, so results do not depend on them; neither do they depend on the
sample, which only decides whether the further pass is needed.

A pass numbers the words of a block of text and builds the hashes of k words
from neighbours of k-1 words, all in numpy; phrases of one hash are compared
word by word before they are counted together. A block has a bounded number of
words (a longer text goes through in several, overlapping by LONGEST - 1
words). Blocks send one row per distinct hash to a shuffle that adds them up,
so a phrase that is everywhere is one row per block.

Score: cutting a phrase in two gives floor(SCALE * a * n / (l * r)), and its
lowest cut counts; products are exact decimals of up to 38 digits.

Defined cases: a null or empty text has no words; a null language is UNKNOWN;
bytes other than A-Z are not lower-cased and need not be UTF-8; equal rows
count each; other columns are ignored; without frequent phrases the result is
empty.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.catalog import query
from lumenframe.llm.near import mix
from lumenframe.llm.rows import documents, text_key
from lumenframe.session import cut

LONGEST = 5
LEAST = 100
SCALE = 1000
TOP = 2000
UNKNOWN = "und"
SAMPLE = 16              # one document in so many proposes phrases
CAUTION = 0.65           # share of the expected sample count that is enough to propose
BITS = 1 << 29           # of a filter at most: 64 MB
FEW_BITS = 1 << 24       # of a filter at least: 2 MB, sent compressed
PROBES = 4               # bits per phrase of a filter that decides what is counted
SURE = 16                # bits per phrase of a filter that should let nothing else through
TURN = 8                 # probes from the same halves of a hash
PLACES = 1 << 12         # blocks have one of so many places
BUCKETS = 1 << 10        # of hashes whose numbers are verified together
SEEN = 1 << 30           # occurrences whose second hashes fit a sum
BLOCK = 1 << 18          # words that are counted together
HELD = 200_000           # phrases a task adds up before it sends them
GROUP = 4 << 20          # bytes of text whose words are numbered together
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
CUT_UP = bytes.maketrans(SEPARATORS, b"\n" * len(SEPARATORS))
STEP = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Numbers of words in order of appearance; 0 is the gap between pieces."""

    def __init__(self):
        super().__init__()
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self[word] = number = len(self.words) - 1
        return number


def word_ids(texts: Sequence[bytes], vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """Word numbers of texts, pieces apart by 0, in blocks. A block beyond the
    first of a run repeats the last LONGEST - 1 numbers before it."""
    out: list[int] = []
    for text in texts:
        for piece in text.lower().translate(CUT_UP).split(b"\n"):
            out.extend(map(vocabulary.__getitem__, piece.split()))
            out.append(0)
        while len(out) >= BLOCK + LONGEST:
            yield np.array(out[:BLOCK + LONGEST - 1], np.int64)
            out = out[BLOCK:]
    if out:
        yield np.array([*out, *[0] * (LONGEST - 1)], np.int64)


def known(bitmap: np.ndarray, hashes: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """Which hashes have their first ``probes`` bits in the filter (see ``bitmap_of``)."""
    last = np.uint64(len(bitmap) * 8 - 1)
    hit = lambda at: (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    left = np.flatnonzero(hit(hashes & last & np.uint64(0xFFFFFFFF)))
    for k in range(1, probes):
        h = hashes[left]
        if k >= TURN:
            h = h >> np.uint64(16) | h << np.uint64(48)
        left = left[hit((h & np.uint64(0xFFFFFFFF)) + np.uint64(k % TURN) * (h >> np.uint64(32)) & last)]
    out = np.zeros(len(hashes), bool)
    out[left] = True
    return out


def groups(ids: np.ndarray, size: int, value: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, count) of the distinct phrases of ``size`` words at the chosen places."""
    order = np.argsort(value[chosen], kind="stable")
    place, number = chosen[order], value[chosen][order]
    change = number[1:] != number[:-1]
    words = [ids[place + i] for i in range(size)]
    if any(((w[1:] != w[:-1]) & ~change).any() for w in words):   # two phrases with one hash: compare the words alone
        order = np.lexsort(words)
        place, words = place[order], [w[order] for w in words]
        change = np.any([w[1:] != w[:-1] for w in words], axis=0)
    start = np.flatnonzero(np.concatenate([[True], change]))
    return place[start], np.diff(np.append(start, len(place)))


def count_block(ids: np.ndarray, hashes: np.ndarray, bitmap: np.ndarray | None, before: np.ndarray | None, longest: int = LONGEST):
    """(size, columns of words, count, hash) of the distinct phrases that start in a block.

    ``hashes`` has a number per word. With a bitmap, phrases of two words on
    need both their parts counted and in it. With ``before``, phrases that were
    counted under that one are left out, and those that are new count as parts
    as well, whatever their number turns out to be: nothing is left for a
    further pass.
    """
    own = len(ids) - LONGEST + 1
    value, counted_now = hashes[ids], ids > 0
    counted_then = counted_now
    for size in range(1, longest + 1):
        if size > 1:
            # Neighbours that share all but their ends make the longer phrase.
            counted_now, counted_then = inside[:-1] & inside[1:], then[:-1] & then[1:]
            value = mix(value[:-1] * STEP + value[1:] + np.uint64(size))
        fresh = counted_now if before is None else counted_now & ~counted_then
        # There are fewer words than places.
        there = lambda bits: known(bits, hashes)[ids] if size == 1 else known(bits, value)  # noqa: E731, B023
        inside = counted_now if bitmap is None else counted_now & there(bitmap)
        then = inside
        if before is not None:
            inside |= fresh
            then = counted_then & there(before)
        if size == 1:
            if before is None:
                n = np.bincount(ids[:own], minlength=1)
                words = np.flatnonzero(n[1:]) + 1
                if len(words):
                    yield size, [words], n[words], hashes[words]
            continue
        chosen = np.flatnonzero(fresh[:own])
        if len(chosen):
            place, n = groups(ids, size, value, chosen)
            yield size, [ids[place + i] for i in range(size)], n, value[place]


def blocks(texts: Sequence[bytes], lang: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(word numbers, a hash per word, words) of the blocks of texts in one language."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    vocabulary, hashes = Vocabulary(), np.zeros(1, np.uint64)
    for ids in word_ids(texts, vocabulary):
        new = [xxhash.xxh64_intdigest(w, seed) for w in vocabulary.words[len(hashes):]]
        hashes = np.concatenate([hashes, np.array(new, np.uint64)])
        yield ids, hashes, vocabulary.words


def place_of(texts: Sequence[bytes], k: int) -> int:
    """Place of the k-th block of texts, the same in every pass."""
    return xxhash.xxh64_intdigest(texts[0], k) % PLACES


def spelled(columns: Sequence[np.ndarray], words: list[bytes]) -> list[bytes]:
    return list(map(b" ".join, zip(*[map(words.__getitem__, c.tolist()) for c in columns])))


def counts(texts: Sequence[bytes], lang: str, bitmap=None, buckets: np.ndarray | None = None) -> Iterator[tuple]:
    """(sizes, phrases, numbers) of the phrases of texts in one language that are in the bitmap; size 0 is the number of words.

    ``buckets``: a flag per bucket of hashes, to list some alone.
    """
    for ids, hashes, words in blocks(texts, lang):
        yield [0], [b""], [(ids[:len(ids) - LONGEST + 1] > 0).sum()]
        for size, columns, n, value in count_block(ids, hashes, bitmap, None):
            if bitmap is not None:
                own = known(bitmap, value, SURE)
                if buckets is not None:
                    own &= buckets[(value % np.uint64(BUCKETS)).astype(np.int64)]
                columns, n = [c[own] for c in columns], n[own]
            if len(n):
                yield [size] * len(n), spelled(columns, words), n


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of at most GROUP bytes, or one text."""
    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        size: Counter = Counter()
        for lang, value in zip(batch["lang"].to_pylist(), batch["text"]):
            text = value.as_buffer().to_pybytes()
            waiting.setdefault(lang, []).append(text)
            size[lang] += len(text)
            if size[lang] >= GROUP:
                yield lang, waiting.pop(lang)
                size[lang] = 0
        yield from waiting.items()


def hash_counts(docs: DataFrame, bitmap=None, before=None, longest: int = LONGEST) -> DataFrame:
    """(bits, at, n): how often phrases of one hash occur, of those that the bitmaps choose, and the place of a block with one.

    ``docs``: lang, text (binary).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, then = opened(bitmap), opened(before)
        for lang, texts in by_language(batches):
            for k, (ids, hashes, _) in enumerate(blocks(texts, lang)):
                at = place_of(texts, k)
                for _, _, n, value in count_block(ids, hashes, now, then, longest):
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.full(len(n), at, np.int32)),
                                                      pa.array(n, pa.int64())], ["bits", "at", "n"])
    return (docs.select("lang", "text").mapInArrow(run, "bits long, at int, n long")
            .groupBy("bits").agg(F.min("at").alias("at"), F.sum("n").alias("n")))


def second_hash(columns: Sequence[np.ndarray], hashes: np.ndarray) -> np.ndarray:
    value = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        value = mix(value * STEP + hashes[c] + np.uint64(1))
    return value


def names(docs: DataFrame, chosen, placed) -> DataFrame:
    """(lang, size, phrase, bits, low, high): the phrases of chosen hashes, each with the halves of its second hash.

    A phrase is listed by the blocks that ``placed`` has it for. Each task adds
    a row per bucket (size -1, number in ``bits``) with the sums of both halves
    over all occurrences, and per language the number of words (size 0, in ``low``).
    """
    columns_of = ["lang", "size", "phrase", "bits", "low", "high"]

    def batch(lang: str, size: int, phrase: list[bytes], bits: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(bits), pa.string()), pa.array([size] * len(bits), pa.int32()), pa.array(phrase, pa.binary()),
                                           *[pa.array(a, pa.int64()) for a in (bits, low, high)]], columns_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, there = opened(chosen), opened(placed)
        sums, seen, total = np.zeros((2, BUCKETS), np.int64), 0, Counter()
        summed = lambda: batch("", -1, [b""] * BUCKETS, np.arange(BUCKETS), *sums)
        for lang, texts in by_language(batches):
            seed, second = ~xxhash.xxh64_intdigest(lang.encode()) % (1 << 64), np.zeros(1, np.uint64)
            for k, (ids, hashes, words) in enumerate(blocks(texts, lang)):
                at = place_of(texts, k)
                second = np.concatenate([second, np.array([xxhash.xxh64_intdigest(w, seed) for w in words[len(second):]], np.uint64)])
                total[lang] += int((ids[:len(ids) - LONGEST + 1] > 0).sum())
                for size, columns, n, value in count_block(ids, hashes, now, None):
                    own = np.flatnonzero(known(now, value, SURE))
                    columns, n, value = [c[own] for c in columns], n[own], value[own]
                    check = second_hash(columns, second)
                    halves = [(check & np.uint64(0xFFFFFFFF)).astype(np.int64), (check >> np.uint64(32)).astype(np.int64)]
                    for s, half in zip(sums, halves):
                        np.add.at(s, (value % np.uint64(BUCKETS)).astype(np.int64), half * n)
                    seen += int(n.sum())
                    new = np.flatnonzero(known(there, value ^ np.uint64(at << 40 | at), SURE))
                    if len(new):
                        yield batch(lang, size, spelled([c[new] for c in columns], words), value[new].view(np.int64), *[h[new] for h in halves])
                if seen >= SEEN:
                    yield summed()
                    sums[:], seen = 0, 0
        if seen:
            yield summed()
        for lang, n in total.items():
            yield batch(lang, 0, [b""], *[np.array([x], np.int64) for x in (0, n, 0)])
    return docs.select("lang", "text").mapInArrow(run, "lang string, size int, phrase binary, bits long, low long, high long")


def phrase_counts(docs: DataFrame, bitmap, buckets: np.ndarray | None = None) -> DataFrame:
    """(lang, size, phrase, n): exact counts of the phrases whose hashes are in the bitmap and the buckets, and of all words (size 0).

    What is chosen repeats from block to block, so a task adds it up and sends
    it when it holds HELD phrases, or at its end.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = opened(bitmap), {}

        def out() -> pa.RecordBatch:
            lang, size, phrase = zip(*held)
            batch = pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(phrase, pa.binary()),
                                                pa.array(held.values(), pa.int64())], ["lang", "size", "phrase", "n"])
            held.clear()
            return batch
        for lang, texts in by_language(batches):
            for sizes, found, n in counts(texts, lang, now, buckets):
                size = int(sizes[0])
                for phrase, k in zip(found, map(int, n)):
                    key = (lang, size, phrase)
                    held[key] = held.get(key, 0) + k
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()
    rows = docs.select("lang", "text").mapInArrow(run, "lang string, size int, phrase binary, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def sent(spark: SparkSession, bitmap: bytes):
    return spark.sparkContext.broadcast(zlib.compress(bitmap, 1))


def opened(bitmap) -> np.ndarray | None:
    return bitmap and np.frombuffer(zlib.decompress(bitmap.value), np.uint8)


def bitmap_of(phrases: DataFrame, probes: int = PROBES, base: bytes = b"") -> bytes:
    """Bloom filter of the phrases' hashes, or ``base`` with them added: bit low + k * high of a hash's halves for every probe k.

    From probe TURN on the hash is turned by 16 bits and k starts anew, so that all its bits count. The filter has at least two bits per probe, up to BITS. Spark joins the bits; the
    driver sees BITS / 64 words at most. ``phrases`` should be materialised.
    """
    size = len(base) * 8 or min(BITS, max(FEW_BITS, 1 << (2 * probes * phrases.count()).bit_length()))
    turned = F.shiftrightunsigned("bits", 16).bitwiseOR(F.shiftleft("bits", 48))
    halves = lambda h: (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))
    at = F.explode(F.array(*[(low + high * (k % TURN)).bitwiseAND(size - 1) for k in range(probes)
                             for low, high in [halves(F.col("bits") if k < TURN else turned)]]))
    words = phrases.select(at.alias("at")).select(
        F.shiftright("at", 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.frombuffer(base, np.int64).copy() if base else np.zeros(size // 64, np.int64)
    bits[found["w"]] |= found["b"].to_numpy(np.int64)
    return bits.tobytes()


def frequent_phrases(docs: DataFrame, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(lang, size, phrase, n): every phrase with at least ``least`` occurrences in its language; size 0 has the number of words."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
                       F.pmod(F.xxhash64("doc_id", text_key()), F.lit(sample)).alias("_part"))
    spark, enough = docs.sparkSession, max(2, int(least / sample * CAUTION))
    # Passes are materialised before their bitmaps are dropped.
    bitmap = bitmap_of(cut(hash_counts(rows.filter("_part = 0"), longest=LONGEST - 1).filter(F.col("n") >= enough).select("bits")))
    now = sent(spark, bitmap)
    hot = cut(hash_counts(rows, now).filter(F.col("n") >= least))
    wider = bitmap_of(hot, base=bitmap)
    if wider != bitmap:
        # Frequent phrases that were not proposed open up longer ones.
        wide = sent(spark, wider)
        more = cut(hash_counts(rows, wide, now).filter(F.col("n") >= least))
        hot = cut(hot.unionByName(more).groupBy("bits").agg(F.min("at").alias("at"), F.sum("n").alias("n")))
        wide.destroy()
    now.destroy()
    # Hashes only choose: what they chose is named and verified, or counted phrase by phrase.
    at = F.col("at").cast("long")
    chosen = sent(spark, bitmap_of(hot, SURE))
    placed = sent(spark, bitmap_of(hot.select(F.col("bits").bitwiseXOR(F.shiftleft(at, 40)).bitwiseXOR(at).alias("bits")), SURE))
    found = cut(names(rows, chosen, placed))
    placed.destroy()
    named, doubtful = verified(hot, found)
    out = named.unionByName(found.filter("size = 0").groupBy("lang", "size", "phrase").agg(F.sum("low").alias("n")))
    if len(doubtful):
        buckets = np.zeros(BUCKETS, bool)
        buckets[doubtful] = True
        out = out.unionByName(cut(phrase_counts(rows, chosen, buckets).filter((F.col("n") >= least) & (F.col("size") > 0))))
    chosen.destroy()
    return out


def verified(hot: DataFrame, found: DataFrame) -> tuple[DataFrame, list[int]]:
    """(lang, size, phrase, n) of the hashes in ``hot`` (bits, n) with ``found`` names, and the buckets that are not among them.

    Those have a hash without a name or with several, or sums that do not agree.
    """
    bucket = F.col("bits").bitwiseAND(BUCKETS - 1).cast("int")
    name = F.struct("lang", "size", "phrase", "low", "high")
    texts = (found.filter("size > 0").groupBy("bits").agg(F.min(name).alias("name"), F.max(name).alias("other"))
             .select("bits", F.when(F.col("name") == F.col("other"), F.col("name")).alias("name")))
    named = cut(hot.select("bits", "n").join(texts, "bits", "left").withColumn("bucket", bucket))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    due = named.groupBy("bucket").agg(F.sum(exact("n") * exact("name.low")).alias("low"), F.sum(exact("n") * exact("name.high")).alias("high"),
                                      F.count_if(F.col("name").isNull()).alias("lost"))
    got = found.filter("size = -1").groupBy(bucket.alias("bucket")).agg(F.sum(exact("low")).alias("_low"), F.sum(exact("high")).alias("_high"))
    agree = (F.col("lost") == 0) & F.col("low").eqNullSafe(F.col("_low")) & F.col("high").eqNullSafe(F.col("_high"))
    doubtful = [r[0] for r in due.join(got, "bucket", "left").filter(~agree).select("bucket").collect()]
    return named.filter(~F.col("bucket").isin(doubtful)).select("name.lang", "name.size", "name.phrase", "n"), doubtful


def _part(words: Column, start: int | Column, length: int | Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, cover: int = 100, sample: int = SAMPLE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two words on, per language.

    A phrase inside a longer one with at least ``cover`` % of its count is dropped.
    """
    frequent = cut(frequent_phrases(docs, least, sample))
    phrases = frequent.filter("size > 0").select("lang", "size", F.col("phrase").cast("string").alias("phrase"), "n")
    totals = frequent.filter("size = 0").groupBy("lang").agg(F.sum("n").alias("total"))   # one row per language
    long = phrases.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = long.select("lang", "phrase", "size", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), F.lit(1), F.col("k")).alias("first"),
                        _part(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    count = lambda part, name: phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(name))
    both = parts.join(count("first", "l"), ["lang", "first"]).join(count("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c, digits=19: F.col(c).cast(f"decimal({digits},0)")
    score = F.call_function("div", exact("a", 16) * F.lit(SCALE).cast("decimal(4,0)") * exact("total", 18), exact("l") * exact("r"))
    scored = (both.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r", F.col("total").alias("n"))).alias("best")))
    # Every proper part of two words on inside a longer phrase, with the most frequent such phrase.
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.col("words"), i, m), " "))))
    within = (long.filter("size > 2").select("lang", F.explode(inside).alias("phrase"), "n")
              .groupBy("lang", "phrase").agg(F.max("n").alias("longer")))
    kept = scored.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    place = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    return (kept.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "best.n", "best.score"))


PHRASE_SQL = """
    WITH p AS (SELECT row_number() OVER () doc, coalesce(lang, 'und') lang, unnest(regexp_split_to_array(
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece
               FROM documents),
    w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') ws FROM p),
    n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) n FROM w GROUP BY lang),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) phrase
          FROM w, (SELECT unnest([1, 2, 3, 4, 5]) k) WHERE len(ws) >= k),
    f AS (SELECT lang, k, phrase, count(*) a FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') ws FROM f WHERE k > 1),
    cuts AS (SELECT c.*, unnest(range(1, k)) j FROM c),
    s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, l.a l, r.a r, n.n, (1000 * cuts.a::HUGEINT * n.n) // (l.a::HUGEINT * r.a) score
          FROM cuts JOIN n USING (lang) JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(ws[1:j], ' ')
          JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') phrase, max(a) longer
               FROM (SELECT lang, ws, a, k, m, unnest(range(1, k - m + 2)) i FROM c, (SELECT unnest([2, 3, 4]) m) WHERE m < k) GROUP BY ALL),
    kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * best.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM kept QUALIFY rank <= 2000
"""


@query(PHRASE_SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of every language."""
    return collocations(documents(spark, sf_dir))
