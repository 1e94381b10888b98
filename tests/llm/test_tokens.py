"""BPE and packing against the tokenizer library."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

from lumenframe.llm import bpe, packing
from lumenframe.llm.catalog import QUERIES
from lumenframe.llm.rows import tokenizer_path

SF = "/root/testdata/sf0.001"


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_random_text_equals_library(tokenizer):
    c = bpe.codec(open(tokenizer_path(), "rb").read())
    rng = random.Random(1)
    letters = "abe 'stredmll ΣσςİIıÀé1²½٣中ﬁ\n\t!?<|>_\x1c\x85 ​\U0001F600é"
    for _ in range(3000):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) + rng.choice(["", "", "<|endoftext|>x"])
        ids = tokenizer.encode(s, add_special_tokens=False).ids
        assert c.encode(s) == packed(ids), s
        assert c.decode(packed(ids)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_frame_and_edge_cases(docs, tokenizer):
    path = tokenizer_path()
    got = bpe.decode(bpe.encode(docs, path), path).collect()
    for r in got:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == packed(ids) and r.n_tokens == len(ids)
        assert r.decoded == tokenizer.decode(ids, skip_special_tokens=False)


def test_full_caches_change_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 2)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 2)
    c = bpe.Codec(open(tokenizer_path(), "rb").read())
    for s in ["many different words in one text", "and words in another text", "unbelievable internationalisation"] * 2:
        assert c.encode(s) == packed(tokenizer.encode(s, add_special_tokens=False).ids)


def test_stretches_and_long_pieces(tokenizer, monkeypatch):
    """Short stretches, pieces alone and in step, and small blocks of them all give the same ids."""
    rng = random.Random(6)
    texts = ["中文字" * 70 + " a", "x" * 5000, "no white space " * 40, " ", "", "éa" * 100 + " <|endoftext|> end", "tail   "]
    texts += ["".join(rng.choice("abcdeé中 .") for _ in range(rng.randrange(400))) for _ in range(80)]
    want = [packed(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    for name, value in (("STRETCH", 10), ("MANY", 1), ("MANY", 10**9), ("SHORT", 3), ("CELLS", 1), ("LONG", 20), ("LONGEST_CACHED", 2)):
        monkeypatch.setattr(bpe, name, value)
        assert list(bpe.Codec(open(tokenizer_path(), "rb").read()).encode_all(texts)) == want, name


def test_replaces_clashing_columns_and_takes_empty_tables(spark, no_docs):
    path = tokenizer_path()
    df = spark.createDataFrame([("a word", 7, "keep")], "text string, ids int, other string")
    row = bpe.encode(df, path).first()
    assert row.other == "keep" and row.n_tokens == 2 and len(row.ids) == 8
    assert bpe.encode(no_docs, path).count() == 0


def test_query(spark, tokenizer, documents_table):
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, SF).collect()}
    for d in documents_table.collect():
        ids = tokenizer.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def check_pieces(rows, documents, tokenizer, longest):
    left = defaultdict(list)
    for i, t in documents:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        left[i].append(ids)
    sequences = [r.sequence_id for r in rows]
    assert sorted(sequences) == list(range(len(rows)))
    by_doc = defaultdict(list)
    for r in rows:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= longest
        by_doc[r.doc_id].append(r)
    assert set(by_doc) == set(left)
    for i, texts in left.items():
        want = sorted((len(ids), a, zlib.crc32(packed(ids[a:a + n]))) for ids in texts for a, n in plain_pieces(len(ids), longest))
        assert sorted((r.doc_tokens, r.start, r.ids_crc32) for r in by_doc[i]) == want
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths)


def plain_pieces(n, longest):
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    for b in reversed(range(longest.bit_length() - 1)):
        if (n - at) >> b & 1:
            out.append((at, 1 << b))
            at += 1 << b
    return out


def test_packing(docs, texts, tokenizer):
    for longest in (4096, 64, 1):
        some = [t for t in texts if longest > 1 or len(t[1] or "") < 1000]
        df = docs.sparkSession.createDataFrame(some, "doc_id long, text string")
        check_pieces(packing.pack(df, tokenizer_path(), longest).collect(), some, tokenizer, longest)


def test_packing_query(spark, documents_table, tokenizer, no_docs):
    rows = QUERIES["op9_packing"](spark, SF).collect()
    check_pieces(rows, [(d.doc_id, d.text) for d in documents_table.collect()], tokenizer, 4096)
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


def test_pack_returns_the_ids_at_their_place(spark, tokenizer):
    from corpus_pipeline import STAGES
    # Equal ids with different texts: only the rows themselves tell what belongs together.
    some = [(1, "one text of some words"), (1, "another text under the same id"), (None, "no id at all"), (2, None), (3, "w x y " * 2000)]
    df = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    want = []
    for i, t in some:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want += [(str(i), a, n, packed(ids[a:a + n])) for a, n in plain_pieces(len(ids), 4096)]
    for rows in (packing.pack(df, tokenizer_path()).collect(), dict(STAGES)["packing"](spark, df, SF).collect()):
        assert sorted((str(r.doc_id), r.start, r.length, bytes(r.ids)) for r in rows) == sorted(want)
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.offset == 0 for r in rows)
        assert sorted(r.sequence_id for r in rows) == list(range(len(want)))
    assert "ids" not in QUERIES["op9_packing"](spark, SF).columns


def test_a_full_memory_keeps_what_is_in_use(monkeypatch):
    with open(tokenizer_path(), "rb") as f:
        content = f.read()
    want = list(bpe.Codec(content).encode_all(["common words stay", "rare ones go, common words stay"]))
    monkeypatch.setattr(bpe, "CACHE_PIECES", 6)
    codec = bpe.Codec(content)
    codec.learn({"common", "words"})
    seen, encode = [], codec.encode_pieces
    monkeypatch.setattr(codec, "encode_pieces", lambda pieces: encode(seen.extend(pieces) or seen[-len(pieces):]))
    codec.learn({"common", "words", "stay", "rare", "ones", "go", ","})
    assert sorted(seen) == sorted(["stay", "rare", "ones", "go", ","])   # forgot all and encoded the two again
    assert [next(codec.encode_all([t])) for t in ("common words stay", "rare ones go, common words stay")] == want
