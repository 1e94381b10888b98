"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For a sequence of symbols every prefix has one correct encoding, so it is
enough to remember the last token of each prefix. The tokens that may come
last are the vocabulary entries which end there (an Aho-Corasick automaton
lists them); of these exactly one is compatible with the last token of the
prefix before it. Back-pointers then give the ids without any merge loop, in
time linear in the length of the word.

Encoding follows the JSON tokenizer file: special tokens are cut out of the
raw text, then NFC, lower case, the splitting pattern, bytes as symbols and an
end-of-word mark on the last symbol.

Defined cases: a null or empty text has no ids and decodes to the empty text;
texts and words may have any length; bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import documents, tokenizer_path

SLICE = 4 << 20          # bytes in one batch of output
CACHE_PIECES = 200_000   # remembered per Python worker; a full memory keeps what is in use, never wrong
CACHE_PAIRS = 1 << 18
LONGEST_CACHED = 64
STRETCH = 1 << 20        # characters of text whose new pieces are encoded together
CELLS = 1 << 21          # places of all pieces that are encoded together
SHORT, LONG, MANY = 64, 4096, 32   # bytes of pieces: up to SHORT in step; up to LONG if there are MANY of them
SHIFT = 20               # a pair is its first token above this many bits of the second
MASK = (1 << SHIFT) - 1
SYMBOLS = 0x200          # bytes, and bytes at a word's end
END = 0x100              # distance from a symbol to the same symbol at a word's end

# White space of the normaliser's \s, and what str.split() takes besides it.
SPACE = "\t-\r\x20\x85\xa0  -     　"
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPLIT_SPACE = regex.compile(f"[{SPACE}]+")
ONE_SPACE = regex.compile(f"[{SPACE}]")
# A splitting pattern that this module knows, and faster forms of it. Letters, and numbers that are no digits, are
# what \\w has besides digits and the underscore.
USUAL = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ASCII_UNITS = re.compile("[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-z0-9]+")
WIDE_UNITS = re.compile("[^\\W\\d_]+|'(?:s|t|re|ve|m|ll|d)|\\d|(?:[^\\w\\s]|_)+")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte, as byte-level vocabularies write them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Parts and ranks of merged tokens, and ranks of pairs, as arrays."""

    def __init__(self, vocab: dict[str, int], merges: list):
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = (np.full(size, -1, np.int64) for _ in range(3))
        parts = np.array([[vocab[x] for x in (m if isinstance(m, list) else m.split(" "))] for m in merges], np.int64).reshape(-1, 2)
        tokens = np.array([vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges], np.int64)
        self.order = tokens
        self.left[tokens], self.right[tokens], self.rank[tokens] = parts[:, 0], parts[:, 1], np.arange(len(tokens))
        if (np.maximum(self.rank[parts[:, 0]], self.rank[parts[:, 1]]) >= np.arange(len(tokens))).any():
            raise ValueError("a merge uses a token that is merged later")
        pairs = parts[:, 0] << SHIFT | parts[:, 1]
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = np.append(pairs[order], 1 << 62), np.append(order, 0)

    def fits(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Do merges of a+b stop at (a, b)? Undo the later merge at the seam
        again and again; a pair that would have merged before it is a refusal.
        Of equal merges the left one comes first."""
        out = np.zeros(len(a), bool)
        limit = np.full(len(a), 1 << 60) if limit is None else limit
        at = np.arange(len(a))
        while len(at):
            pair = a << SHIFT | b
            place = np.searchsorted(self.pairs, pair)
            fine = (self.pairs[place] != pair) | (self.pair_rank[place] >= limit)
            at_a, at_b = self.rank[a], self.rank[b]
            first, second = at_a > at_b, (at_b >= 0) & (at_a <= at_b)
            out[at[fine & ~first & ~second]] = True
            limit = np.where(first, at_a, at_b + 1)
            a, b = np.where(first, self.right[a], a), np.where(second, self.left[b], b)
            on = fine & (first | second)
            at, a, b, limit = at[on], a[on], b[on], limit[on]
        return out


class Automaton:
    """Suffix automaton of token strings as arrays: state 0 is the root, every state has the longest token that ends there."""

    def __init__(self, strings: list[bytes], ends: np.ndarray, tokens: np.ndarray):
        length = np.array([len(x) for x in strings])
        longest = int(length.max(initial=0))
        symbols = np.zeros((len(strings), longest), np.int64)
        for i, x in enumerate(strings):
            symbols[i, :len(x)] = np.frombuffer(x, np.uint8)
        symbols[np.flatnonzero(ends), length[ends] - 1] += END
        state, levels, count = np.zeros(len(strings), np.int64), [], 1
        for depth in range(longest):
            on = np.flatnonzero(length > depth)
            keys, inverse = np.unique(state[on] * SYMBOLS + symbols[on, depth], return_inverse=True)
            levels.append((keys, np.arange(count, count + len(keys))))
            state[on] = count + inverse
            count += len(keys)
        self.token, self.depth = np.full(count, -1, np.int64), np.zeros(count, np.int64)
        self.token[state] = tokens
        for depth, (_, nodes) in enumerate(levels, 1):
            self.depth[nodes] = depth
        # States number their level's keys in order, and levels follow each other, so all keys are in order already.
        self.keys = np.concatenate([k for k, _ in levels] + [np.array([1 << 62])])
        self.root = np.zeros(SYMBOLS, np.int64)
        self.root[levels[0][0]] = levels[0][1]
        self.fail, self.shorter = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for keys, nodes in levels[1:]:
            self.fail[nodes] = self.advance(self.fail[keys // SYMBOLS], keys % SYMBOLS)
            behind = self.fail[nodes]
            self.shorter[nodes] = np.where(self.token[behind] >= 0, behind, self.shorter[behind])

    def advance(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states; a missing edge is looked for behind the failure link."""
        out = self.root[symbol]
        at = np.flatnonzero(state)
        state, symbol = state[at], symbol[at]
        while len(at):
            key = state * SYMBOLS + symbol
            place = np.searchsorted(self.keys, key)
            found = self.keys[place] == key
            out[at[found]] = place[found] + 1
            state = self.fail[state]
            on = ~found & (state > 0)
            at, state, symbol = at[on], state[on], symbol[on]
        return out

    def last_tokens(self, state: np.ndarray) -> np.ndarray:
        """States of the longest token that ends at a state, 0 if none does."""
        return np.where(self.token[state] >= 0, state, self.shorter[state])


class Codec:
    """Tables of one tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        if not self.suffix or spec["decoder"] is not None:
            raise ValueError("only word-end vocabularies without a decoder are read")
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in specials.items()}
        self.names = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.kind = np.dtype("<u2" if len(self.names) <= 1 << 16 else "<u4")   # ids while they are remembered
        self.special_ids = {t: np.array([i], self.kind).tobytes() for t, i in specials.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern, self.usual = regex.compile(pattern), pattern == USUAL
        self.merges = m = Merges(vocab, model["merges"])
        # A merged token is usable if encoding its own text gives it.
        usable = m.rank < 0
        alone = m.fits(m.left[m.order], m.right[m.order], m.rank[m.order])
        for t, fits, a, b in zip(m.order.tolist(), alone.tolist(), m.left[m.order].tolist(), m.right[m.order].tolist()):
            usable[t] = fits and usable[a] and usable[b]
        alphabet = byte_alphabet()
        used = [(bytes(alphabet[c] for c in t.removesuffix(self.suffix)), t.endswith(self.suffix), i) for t, i in vocab.items() if usable[i]]
        self.automaton = Automaton([x for x, _, _ in used], np.array([e for _, e, _ in used]), np.array([i for _, _, i in used]))
        self.seams, self.seam_fits = np.full(CACHE_PAIRS, -1, np.int64), np.zeros(CACHE_PAIRS, bool)
        self.known: dict[str, bytes] = dict(self.special_ids)

    def compatible(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """May ``token`` follow ``before``? Answers are remembered, the newest at a place."""
        seam = before << SHIFT | token
        slot = (seam * 0x9E3779B1 >> 13) & (CACHE_PAIRS - 1)
        new = np.flatnonzero(self.seams[slot] != seam)
        out = self.seam_fits[slot]
        if len(new):
            out[new] = self.merges.fits(before[new], token[new])
            self.seams[slot[new]], self.seam_fits[slot[new]] = seam[new], out[new]
        return out

    def encode_in_step(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, longest first, all prefixes of one length at a time."""
        length = np.array([len(x) for x in pieces])
        n, longest = len(pieces), int(length[0])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        start = np.cumsum(length) - length
        last, back = np.full((n, longest + 1), -1, np.int32), np.zeros((n, longest + 1), np.int32)
        last[:, 0] = 0
        auto, state = self.automaton, np.zeros(n, np.int64)
        alive = np.searchsorted(-length, -np.arange(1, longest + 1), "right").tolist()
        for end, k in enumerate(alive, 1):
            symbol = data[start[:k] + end - 1].astype(np.int64)
            symbol[length[:k] == end] += END
            state = auto.advance(state[:k], symbol)
            node = auto.last_tokens(state)
            open_ = np.flatnonzero(node)
            while len(open_):
                at = node[open_]
                token, size = auto.token[at], auto.depth[at]
                before = last[open_, end - size].astype(np.int64)
                fits = size == end
                inner = np.flatnonzero(~fits & (before >= 0))
                fits[inner] = self.compatible(before[inner], token[inner])
                done = open_[fits]
                last[done, end], back[done, end] = token[fits], size[fits]
                open_ = open_[~fits]
                node[open_] = auto.shorter[at[~fits]]
                open_ = open_[node[open_] > 0]
        # Back-pointers, all pieces together from their ends; ``count`` places every token.
        steps, at, place = [], np.arange(n), length.copy()
        count = np.zeros(n, np.int64)
        while len(at):
            steps.append((at, last[at, place[at]]))
            count[at] += 1
            place[at] -= back[at, place[at]]
            at = at[place[at] > 0]
        ends = np.cumsum(count)
        ids = np.empty(ends[-1], self.kind)
        for i, (at, token) in enumerate(steps):
            ids[ends[at] - 1 - i] = token
        raw, size = ids.tobytes(), self.kind.itemsize
        edge = [0, *(ends * size).tolist()]
        return [raw[a:b] for a, b in zip(edge, edge[1:])]

    @functools.cached_property
    def lists(self) -> tuple:
        """Tables for one piece at a time: rank, left, right, pairs and an automaton in memory of its own."""
        import ahocorasick
        m, auto = self.merges, ahocorasick.Automaton(ahocorasick.STORE_INTS)
        text = {0: ""}
        keys = self.automaton.keys[:-1]
        for node, parent, symbol in zip(range(1, len(keys) + 1), (keys // SYMBOLS).tolist(), (keys % SYMBOLS).tolist()):
            text[node] = text[parent] + chr(symbol)
            if self.automaton.token[node] >= 0:
                auto.add_word(text[node], len(text[node]) << SHIFT | int(self.automaton.token[node]))
        auto.make_automaton()
        return m.rank.tolist(), m.left.tolist(), m.right.tolist(), dict(zip(m.pairs.tolist(), m.pair_rank.tolist())), auto, {}

    def encode_alone(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, place by place."""
        rank, left, right, pairs, automaton, known = self.lists

        def fits(a: int, b: int) -> bool:
            limit = 1 << 60
            while pairs.get(a << SHIFT | b, limit) >= limit:
                at_a, at_b = rank[a], rank[b]
                if at_a > at_b:
                    limit, a = at_a, right[a]
                elif at_b >= 0:
                    limit, b = at_b + 1, left[b]
                else:
                    return True
            return False
        n = len(piece)
        symbols = piece[:-1].decode("latin-1") + chr(piece[-1] + END)
        last, back = array("i", [-1]) * (n + 1), array("i", [0]) * (n + 1)
        for end, match in automaton.iter(symbols):
            end += 1
            if back[end]:
                continue
            start, token = end - (match >> SHIFT), match & MASK
            if start:
                seam = last[start] << SHIFT | token
                if seam not in known:
                    if len(known) >= CACHE_PAIRS:
                        known.clear()
                    known[seam] = last[start] >= 0 and fits(last[start], token)
                if not known[seam]:
                    continue
            last[end], back[end] = token, match >> SHIFT
        ids = []
        while n:
            ids.append(last[n])
            n -= back[n]
        return np.array(ids[::-1], self.kind).tobytes()

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of split pieces by piece."""
        names = list(pieces)
        raw = list(map(str.encode, names))
        length = -np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(length, kind="stable").tolist()
        names, raw = list(map(names.__getitem__, order)), list(map(raw.__getitem__, order))
        long = int((length < -SHORT).sum())
        alone = int((length < -LONG).sum()) if long >= MANY else long
        out = dict(zip(names, map(self.encode_alone, raw[:alone])))
        while alone < len(raw):
            some = slice(alone, alone + max(1, CELLS // (len(raw[alone]) + 1)))
            out.update(zip(names[some], self.encode_in_step(raw[some])))
            alone = some.stop
        return out

    def units(self, text: str) -> list[str]:
        """Special tokens and pieces of a text in order. A unit of letters may hold numbers that are no digits; ``learn`` splits it."""
        if "<|" in text and self.special:
            out: list = []
            for part in self.special.split(text):
                out += [part] if part in self.special_ids else self.units(part) if "<|" not in part else self.plain_units(part)
            return out
        return self.plain_units(text)

    def plain_units(self, text: str) -> list[str]:
        if text.isascii():
            low = text.lower()
        else:
            # Letter by letter: a capital sigma has one lower case, wherever it stands.
            low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not self.usual or NOT_SPACE.search(low):
            return [p for run in SPLIT_SPACE.split(low) for p in self.pattern.findall(run)]
        return (ASCII_UNITS if low.isascii() else WIDE_UNITS).findall(low)

    def learn(self, units: set[str]) -> list[str]:
        """Make all ``units`` known; what is new is encoded together. Returns what is too long to be remembered."""
        new = units.difference(self.known)   # of a dictionary: looks the units up, where a keys view would go through all that is known
        if len(self.known) + len(new) > CACHE_PIECES:
            known = self.known
            self.known = self.special_ids | {u: known[u] for u in units.difference(new)}
        wide = [u for u in new if not u.isascii() and not u.isalpha()]
        parts = {u: p for u in wide if (p := self.pattern.findall(u)) != [u]}
        self.known |= self.encode_pieces(new if not parts else (new - parts.keys()).union(*parts.values()))
        for u, p in parts.items():
            self.known[u] = b"".join(map(self.known.__getitem__, p))
        return [u for u in new if len(u) > LONGEST_CACHED]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of every text, four little-endian bytes each. Texts go through in stretches of about STRETCH characters."""
        ready: list[bytes] = []      # of the text whose stretches are under way
        waiting: list[tuple[list[str], bool]] = []

        def flush() -> Iterator[bytes]:
            long = self.learn(set().union(*[units for units, _ in waiting]))
            of = self.known.__getitem__
            for units, closing in waiting:
                ready.append(b"".join(map(of, units)))
                if closing:
                    yield np.frombuffer(b"".join(ready) if len(ready) > 1 else ready[0], self.kind).astype("<u4").tobytes()
                    ready.clear()
            waiting.clear()
            for unit in long:
                self.known.pop(unit, None)
        size = 0
        for text in texts:
            for stretch, closing in stretches(text):
                waiting.append((self.units(stretch), closing))
                size += len(stretch) + 1
                if size >= STRETCH:
                    yield from flush()
                    size = 0
        yield from flush()

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """A text in pieces of about STRETCH characters that end before white space, and whether it is the last one."""
    start = 0
    while len(text) - start > STRETCH:
        space = ONE_SPACE.search(text, start + STRETCH)
        if not space:
            break
        yield text[start:space.start()], False
        start = space.start()
    yield text[start:] if start else text, True


_codecs: dict[str, Codec] = {}


def codec(content: bytes) -> Codec:
    """The codec of a file's content, built once per Python worker."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(content)
    return _codecs[key]


def content_of(spark: SparkSession, path: str):
    """The driver reads the file (under 2 MB) and ships it, so executors need no copy."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(spark: SparkSession, path: str) -> Callable[[Column | str], Column]:
    """Text column to ids: binary, little-endian unsigned 32-bit."""
    content = content_of(spark, path)

    @F.arrow_udf(T.BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        decoded = (str(t.as_buffer(), "utf-8", "replace") if t.is_valid else "" for t in texts)
        return pa.array(codec(content.value).encode_all(decoded), pa.binary())

    return lambda text: encode(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def decoder(spark: SparkSession, path: str) -> Callable[[Column | str], Column]:
    """Ids (as the encoder gives them) to text, special tokens included."""
    content = content_of(spark, path)

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        of = codec(content.value).decode
        return pa.array([of(t.as_buffer()) if t.is_valid else "" for t in ids], pa.string())

    return lambda ids: decode(F.col(ids) if isinstance(ids, str) else ids)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", n: str = "n_tokens") -> DataFrame:
    """``df`` with the ids of ``text`` and their number; columns of these names are replaced."""
    return df.withColumn(ids, encoder(df.sparkSession, path)(text)).withColumn(n, (F.octet_length(ids) / 4).cast("long"))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``."""
    return df.withColumn(text, decoder(df.sparkSession, path)(ids))


def round_trip(df: DataFrame, path: str, text: str = "text", keep: str = "doc_id") -> DataFrame:
    """(keep, ids, decoded): ids and the text decoded from them, by one worker a task and in slices of about SLICE bytes."""
    content = content_of(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(content.value)
        for batch in batches:
            rows, start, size = [], 0, 0
            texts = (str(t.as_buffer(), "utf-8", "replace") if t.is_valid else "" for t in batch[1])
            for i, ids in enumerate(of.encode_all(texts)):
                rows.append((ids, of.decode(ids)))
                size += 2 * len(ids)
                if size >= SLICE or i + 1 == batch.num_rows:
                    ids, decoded = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch[0].slice(start, len(rows)), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                                                     [keep, "ids", "decoded"])
                    rows, start, size = [], i + 1, 0
    kind = df.schema[keep].dataType.simpleString()
    return df.select(keep, F.col(text).cast("binary")).mapInArrow(run, f"`{keep}` {kind}, ids binary, decoded string")


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text decoded from them."""
    rows = round_trip(documents(spark, sf_dir), tokenizer_path())
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
