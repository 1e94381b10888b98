"""Near-duplicates, repeated passages and the pipeline against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import chunks, near
from lumenframe.llm.catalog import QUERIES
from lumenframe.llm.exact import drop_copies
from conftest import prose

SF = "/root/testdata/sf0.001"


def plain_similarity(a, b):
    """By the definition, term by term."""
    total = 0.0
    for i in set(a) & set(b):
        total += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b))
    return total


def words_of(text):
    import re
    return re.sub("[\x20\x09-\x0D]+", " ", (text or "").lower().strip(" \t\n\x0b\x0c\r"))


def plain_shingles(text):
    w = words_of(text).split(" ") if words_of(text) else []
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_classes(rows):
    ids = range(len(rows))
    parent = list(ids)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    sets = [plain_shingles(t) for _, t in rows]
    for a in ids:
        for b in range(a):
            if root(a) != root(b) and (words_of(rows[a][1]) == words_of(rows[b][1]) or (
                    set(sets[a]) & set(sets[b]) and plain_similarity(sets[a], sets[b]) >= near.THRESHOLD)):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in ids:
        groups[root(i)].append(rows[i][0])
    return Counter((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)


def test_similarity_and_signatures():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
        b = np.unique(rng.integers(0, 60, 40)).astype(np.uint64)
        ca, cb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
        want = plain_similarity(dict(zip(a.tolist(), ca.tolist())), dict(zip(b.tolist(), cb.tolist())))
        assert abs(near.similarity(a, ca, b, cb) - want) < 1e-9
        s = near.signatures([(near.mix(a), ca), (near.mix(b), cb)], 3000)
        assert abs((s[0] == s[1]).mean() - want) < 0.05


def test_edge_cases(docs, texts, no_docs):
    rows = near.near_classes(docs.withColumn("class_id", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in rows) == plain_classes(texts)
    assert near.near_classes(no_docs).count() == 0 and near.drop_near(no_docs).columns == no_docs.columns
    extra = docs.withColumns({"kept": F.lit(1), "text_key": F.lit(2)})
    out = near.drop_near(extra)
    assert out.columns == extra.columns and out.filter("doc_id = 12").count() == 1


@pytest.mark.parametrize("chunk", [1 << 18, 1500])
def test_loose_group_keeps_every_link(spark, monkeypatch, chunk):
    """Copies with one to four changed words: many pairs lie just under the threshold, so
    most links of a bucket are none of its central text's."""
    monkeypatch.setattr(near, "CHUNK", chunk)
    rng = random.Random(7)
    base, rows = prose(rng, 80).split(), []
    for i in range(50):
        w = list(base)
        for p in rng.sample(range(80), rng.choice([1, 1, 2, 3, 4])):
            w[p] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    got = near.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == plain_classes(rows)


def test_near_query(spark, documents_table):
    got = QUERIES["op3_near_dedup"](spark, SF).collect()
    want = plain_classes([(d.doc_id, d.text) for d in documents_table.collect()])
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want


def plain_boundaries(data):
    ends, last = [], -chunks.SHORTEST
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - 15):i + 1]:
            h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFF
        if h < 65536 // chunks.ONE_IN:
            if i + 1 - last >= chunks.SHORTEST and i + 1 < len(data):
                ends.append(i + 1)
            last = i + 1
    out, at = [], 0
    for e in [*ends, len(data)] if len(data) else []:
        while e - at > chunks.LONGEST:
            at += chunks.LONGEST
            out.append(at)
        out.append(e)
        at = e
    return out


def test_boundaries():
    rng = random.Random(4)
    for text in ["", "a", prose(rng, 500), "é" * 900, "ab" * 3000, "\x00" * 5000, prose(rng, 30) + "z" * 4000 + prose(rng, 30)]:
        assert chunks.boundaries(np.frombuffer(text.encode(), np.uint8)).tolist() == plain_boundaries(text.encode()), text[:20]


def test_repeated_passages(spark, no_docs):
    rng = random.Random(9)
    passage = prose(rng, 70)
    rows = [(i, prose(rng, 60)) for i in range(20)]
    rows += [(100, prose(rng, 30) + " " + passage + " " + prose(rng, 20)), (101, "é " + prose(rng, 11) + " " + passage), (102, passage + " " + prose(rng, 5)),
             (103, passage[:30] + "X" + passage[30:]), (104, None), (105, ""), (106, "copy " * 3), (106, "copy " * 3), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    text = dict(rows)
    spans = chunks.repeated_spans(df).collect()
    assert {r.doc_id for r in spans} == {100, 101, 102, 103, None}
    for r in spans:
        part = (text[r.doc_id] if r.doc_id else passage)[r.start:r.end]
        # a passage at the start or end of two texts may share a chunk there that 100 does not have
        assert r.first_doc_id in (100, 101, 102) and part in text[r.first_doc_id] and r.removed == (r.doc_id != r.first_doc_id)
    longest = {d: sum(r.end - r.start for r in spans if r.doc_id == d) for d in (100, 101, 102, 103)}
    assert min(longest.values()) > len(passage) - 160
    out = {r.doc_id: r.text for r in chunks.drop_repeats(df).filter("doc_id >= 100").collect()}
    gone = sum(r.end - r.start for r in spans if r.doc_id == 102 and r.removed)
    assert out[100] == text[100] and gone and len(out[102]) == len(text[102]) - gone and out[104] is None
    assert chunks.drop_repeats(df).columns == df.columns and chunks.repeated_spans(no_docs).count() == 0


def test_chunk_query(spark, documents_table):
    shared = defaultdict(set)
    for d in documents_table.collect():
        w = (d.text or "").split()
        for k in range(len(w) - 59):
            if len(set(w[k:k + 60])) > 20:
                shared[tuple(w[k:k + 60])].add(d.doc_id)
    must = {i for s in shared.values() if len(s) > 1 for i in s}
    assert must and must <= {r.doc_id for r in QUERIES["op6_chunk_dedup"](spark, SF).collect()}


def test_pipeline(spark, documents_table):
    import corpus_pipeline as p
    docs, sizes = documents_table, []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == documents_table.columns, name
        sizes.append(out.count())
        docs = out
    assert documents_table.count() > sizes[0] >= sizes[1] >= sizes[2] == sizes[3] > 0
    assert drop_copies(docs).count() == docs.count()
    want = stage_rows(p, spark, docs)
    assert sorted(map(tuple, p.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect())) == want
    empty = documents_table.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0


def stage_rows(p, spark, docs):
    return sorted(map(tuple, p.STAGES[-1][1](spark, docs, SF).select("doc_id", "start", "length", "ids_crc32").collect()))
