"""Phrases, hard negatives and fingerprints against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import fingerprints, negatives, phrases
from conftest import prose


# ------------------------------------------------------------------ phrases
def plain_phrases(rows, least, top, cover=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, all_counts in f.items():
        big = {p: a for p, a in all_counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in big.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        rows_ = []
        for p, a in big.items():
            if p in longer and 100 * longer[p] >= cover * a:
                continue
            cuts = [(1000 * a * n[lang] // (all_counts[p[:k]] * all_counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_.append((-score, -a, " ".join(p).encode(), all_counts[p[:k]], all_counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return Counter(out)


def phrase_rows(spark, rows):
    return spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(2)
    words = "red green blue le la und Der x ÄÖ \xa0 of the".split(" ")
    rows = [(rng.choice(["en", "de", None]), ". ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(6))) for _ in range(250)]
    rows += [("en", "Once upon a Time there\twas a  cat, once upon a time")] * 60
    return rows + [("en", None), (None, ""), ("de", " \t,;\n"), ("", "a b a b a b a b"), ("de", "ha " * 3000)]


@pytest.mark.parametrize("least,sample", [(12, 8), (30, 1), (5, 64)])
def test_phrases(spark, spoken, least, sample):
    got = phrases.collocations(phrase_rows(spark, spoken), least, 50, 100, sample).collect()
    assert Counter(map(tuple, got)) == plain_phrases(spoken, least, 50)
    assert [r for r in got if r["lang"] == "en"]


def test_phrase_cover_and_clashes(spark, spoken):
    docs = phrase_rows(spark, spoken).withColumns({"rank": F.lit(1), "phrase": F.lit("x"), "n": F.lit(2), "size": F.lit(3)})
    assert Counter(map(tuple, phrases.collocations(docs, 10, 40, 60).collect())) == plain_phrases(spoken, 10, 40, 60)


def test_border_failures_are_repaired(spark, spoken, monkeypatch):
    """A sample that proposes nothing costs passes, not phrases."""
    monkeypatch.setattr(phrases, "CAUTION", 1e9)
    got = phrases.collocations(phrase_rows(spark, spoken), 12, 50)
    assert Counter(map(tuple, got.collect())) == plain_phrases(spoken, 12, 50)


def test_shared_bits_lose_nothing(spark, spoken, monkeypatch):
    monkeypatch.setattr(phrases, "BITS", 64)
    assert Counter(map(tuple, phrases.collocations(phrase_rows(spark, spoken), 12, 50).collect())) == plain_phrases(spoken, 12, 50)


def test_blocks_do_not_matter(monkeypatch, spoken):
    texts = [(t or "").encode() for lang, t in spoken if lang == "en"]
    total = lambda: sum((Counter({(s, p): c for s, p, c in zip(sizes, found, n.tolist())})
                         for sizes, found, n in map(lambda r: (r[0], r[1], np.array(r[2])), phrases.counts(texts, "en"))), Counter())
    whole = total()
    monkeypatch.setattr(phrases, "BLOCK", 7)
    assert total() == whole


def test_equal_hashes_are_told_apart():
    """Words, not hashes, decide what is one phrase."""
    ids = np.array([1, 2, 0, 1, 3, 0, 1, 2, 0, 0, 0, 0, 0])
    hashes = np.array([0, 5, 9, 9, 0], np.uint64)
    found = {tuple(tuple(c.tolist()) for c in columns): n.tolist() for size, columns, n, _ in phrases.count_block(ids, hashes, None, None) if size == 2}
    assert found == {((1, 1), (2, 3)): [2, 1]}


def test_filters_keep_up_with_phrases(spark):
    """A filter of fixed size lets everything through once there are many phrases."""
    hashes = phrases.mix(np.arange(1, 3_000_001, dtype=np.uint64) * phrases.STEP)
    many = spark.range(1, 2_000_001).mapInPandas(lambda frames: (
        f.assign(bits=phrases.mix(f["id"].to_numpy(np.uint64) * phrases.STEP).view(np.int64))[["bits"]] for f in frames), "bits long").cache()
    few, sure = (np.frombuffer(phrases.bitmap_of(many, probes), np.uint8) for probes in (phrases.PROBES, phrases.SURE))
    assert phrases.known(few, hashes[:2_000_000]).all() and phrases.known(sure, hashes[:2_000_000], phrases.SURE).all()
    assert phrases.known(few, hashes[2_000_000:]).mean() < 0.05 and phrases.known(sure, hashes[2_000_000:], phrases.SURE).sum() < 10


def test_a_phrase_is_named_once_however_many_tasks(spark, spoken, monkeypatch):
    made, names = [], phrases.names

    def watched(*a):
        made.append(phrases.cut(names(*a)))
        return made[-1]
    monkeypatch.setattr(phrases, "names", watched)
    monkeypatch.setattr(phrases, "phrase_counts", lambda *a: 1 / 0)   # nothing is in doubt
    docs = phrase_rows(spark, spoken * 4).repartition(12)
    got = phrases.frequent_phrases(docs, 12).filter("size > 0").count()
    assert got and got <= made[0].filter("size > 0").count() < 1.5 * got


@pytest.mark.parametrize("change", [("n", "n + pmod(bits, 3)"), ("at", "CAST(pmod(bits, 2) * 5000 + at AS int)")])
def test_doubtful_hashes_are_counted_by_phrase(spark, spoken, monkeypatch, change):
    """Numbers that two phrases share, and places without the phrase."""
    hash_counts = phrases.hash_counts
    monkeypatch.setattr(phrases, "hash_counts", lambda *a, **k: hash_counts(*a, **k).withColumn(change[0], F.expr(change[1])))
    got = phrases.collocations(phrase_rows(spark, spoken), 12, 50)
    assert Counter(map(tuple, got.collect())) == plain_phrases(spoken, 12, 50)


def test_scores_pass_64_bits(spark):
    big = [("en", 0, b"", 3 * 10**15), ("en", 1, b"a", 10**12), ("en", 1, b"b", 10**12), ("en", 2, b"a b", 10**12 - 7)]
    frame = spark.createDataFrame(big, "lang string, size int, phrase binary, n long")
    import unittest.mock as mock
    with mock.patch.object(phrases, "frequent_phrases", lambda *a: frame):
        row = phrases.collocations(frame).collect()[0]
    assert row["score"] == 1000 * (10**12 - 7) * 3 * 10**15 // 10**24


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", "")]):
        assert phrases.collocations(phrase_rows(spark, rows)).count() == 0


# ------------------------------------------------------------------ hard negatives
def plain_negatives(rows, every=100, high=100):
    v = []
    for i, (ident, e, label) in enumerate(rows):
        if label is None or e is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        label = (label + 1) % 10 if ident is not None and ident % 7 == 0 else label
        v.append((i, ident, [int(np.floor(256 * float(x))) for x in e], label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    first = lambda rs: sorted(rs, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:5]
    out = []
    for i, ident, a, label in v:
        if ident is None or ident % every:
            continue
        scores = [(dot(a, b), j, m == label, k) for k, j, b, m in v if k != i]
        for ps, pid in first([(s, j) for s, j, same, _ in scores if same]):
            fits = first([(s, j) for s, j, same, _ in scores if not same and 80 * ps <= 100 * s <= high * ps])
            short = lambda x: x if abs(x) < 1 << 63 else None
            out += [(ident, pid, r, nid, short(ps), short(s)) for r, (s, nid) in enumerate(fits, 1)]
    return Counter(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


@pytest.fixture(scope="module")
def embedded():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) / 3 + (i % 3)).round(2).tolist(), int(rng.integers(0, 4))) for i in range(420)]
    rows += [(200, rows[200][1], rows[200][2])] * 8            # repeated rows, an anchor among them
    rows += [(None, rows[5][1], 1), (700, None, 1), (701, [1.0, None, 2.0], 1), (702, [float("nan")], 2),
             (703, [float("inf")] * 6, 2), (704, [1.0] * 6, None), (800, [], 3), (900, [2.0, 2.0], 1)]
    return rows


@pytest.mark.parametrize("at_once", [20_000, 3])
def test_negatives(spark, embedded, at_once):
    got = negatives.hard_negatives(vectors(spark, embedded), every=20, anchors_at_once=at_once)
    assert Counter(map(tuple, got.collect())) == plain_negatives(embedded, 20)


def test_negatives_small_tiles(spark, embedded, monkeypatch):
    """Tiles and trimming change nothing; kernels are called here, as workers have their own settings."""
    monkeypatch.setattr(negatives, "TILE", (4, 16))
    monkeypatch.setattr(negatives, "KEPT", 50)
    table = pa.table({"vec_id": pa.array([r[0] for r in embedded[:420]]), "_no": pa.array(range(420)),
                      "embedding": pa.array([r[1] for r in embedded[:420]], pa.list_(pa.float64())),
                      "_label": pa.array([r[2] for r in embedded[:420]], pa.int64())})
    block = negatives.Block(table, negatives.Packing(6, -300, 1200))
    found = pa.Table.from_batches(negatives._positives(block, table.to_batches(), 6)).to_pandas()
    ints = np.floor(np.array([r[1] for r in embedded[:420]]) * 256).astype(int)
    for no in (0, 17, 418):
        mine = found[found["no"] == no]
        same = sorted((-int(ints[no] @ ints[j]), j) for j in range(420) if embedded[j][2] == embedded[no][2])[:6]
        assert sorted(zip(-mine["score"], mine["id"])) == same and list(mine[mine["own"]]["id"]) in ([], [no])


@pytest.mark.parametrize("size", [1e3, 1e9, 1e30])
def test_wide_numbers(spark, size):
    """Scores of any width are exact: one field, or Python integers."""
    rng = np.random.default_rng(int(size) % 97)
    rows = [(i, (rng.normal(size=5) * size).tolist(), i % 2) for i in range(60)]
    got = negatives.hard_negatives(vectors(spark, rows), every=15)
    assert Counter(map(tuple, got.collect())) == plain_negatives(rows, 15)


def test_packed_fields():
    rng = np.random.default_rng(1)
    for low, high in ((-3, 4), (-150, 190), (-9000, 9000), (-10**9, 10**9)):
        p = negatives.Packing(7, low, high)
        a, c = rng.integers(low, high + 1, (4, 7)).astype(float), rng.integers(low, high + 1, (9, 7)).astype(float)
        x, y = p.shifted(a), p.shifted(c)
        sums = y.sum(axis=1).astype(np.int64) if p.exact else y.sum(axis=1)
        got = p.scores(x, p.pack(y), 9, sums)
        assert got.tolist() == [[sum(int(i) * int(j) for i, j in zip(u, w)) for w in c] for u in a]


def test_negatives_of_nothing(spark):
    for rows in ([], [(100, None, 1)], [(None, [1.0], 1)], [(100, [1.0], 1)], [(100, [], 1), (200, [], 1)]):
        assert negatives.hard_negatives(vectors(spark, rows).withColumn("rank", F.lit(1))).count() == 0


# ------------------------------------------------------------------ fingerprints
def plain_edit(rows):
    """(doc_id, n_chars, sha256 of the edited text) of every row."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest()))
    out = []
    for (ident, text), (_, after) in zip(order, order[1:] + order[:1]):
        t, half = text or "", len(text or "") // 2
        out.append((ident, len(t), hashlib.sha256((t[:len(t) - half] + (after or "")[:half]).encode()).hexdigest()))
    return Counter(out)


def test_fingerprints(spark, docs, texts):
    clash = docs.withColumns({"n_chars": F.lit(1), "part": F.lit(1), "head": F.lit("x"), "key": F.lit("y"), "place": F.lit(2)})
    got = fingerprints.edited_likeness(clash).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == plain_edit(texts)
    of = defaultdict(set)
    for r in got:
        if r["doc_id"] in (1, 2, 3, 18):
            of["same words"].add(r["fingerprint"])
        if r["doc_id"] in (6, 7, 8):
            of["empty"].add(r["fingerprint"])
    assert len(of["same words"]) == len(of["empty"]) == 1


def test_likeness_estimates_jaccard():
    rng = random.Random(8)
    for share in (0.0, 0.3, 0.7, 1.0):
        errors = []
        for _ in range(30):
            a = prose(rng, 200).split()
            keep = int(200 * share)
            b = a[:keep] + prose(rng, 200 - keep).split()
            sets = [{tuple(w[i:i + 5]) for i in range(196)} for w in (a, b)]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            errors.append(fingerprints.likeness(*(fingerprints.fingerprint(" ".join(w)) for w in (a, b))) - true)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.25


def test_one_and_no_document(spark, no_docs):
    assert fingerprints.edited_likeness(no_docs).count() == 0
    row = fingerprints.edited_likeness(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).collect()[0]
    assert row["edited_sha256"] == hashlib.sha256(b"abcd abcd").hexdigest() and row["near_next"] == 1.0


def test_near_copies(spark):
    """Bands and verification give the classes of all pairs of at least 0.8, one row kept of each."""
    rng = random.Random(12)
    rows = []
    for g in range(12):
        base = prose(rng, 150).split()
        for k in range(5):
            w = list(base)
            for i in rng.sample(range(150), [0, 1, 2, 6, 40][k]):
                w[i] = "changed"
            rows.append((len(rows), " ".join(w)))
    rows += [(7, rows[7][1]), (None, rows[0][1]), (100, None), (101, " "), (7, rows[9][1] + " more")]
    shingle = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            union = len(shingle[i] | shingle[j])
            if rows[i][1] == rows[j][1] or union and len(shingle[i] & shingle[j]) / union >= 0.8:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    want = Counter((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)
    got = fingerprints.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
