"""Byte-pair encoding and decoding over a contiguous rank array.

A word is held as part boundaries, part ids and the ranks of adjacent parts. The smallest rank is found by a scan,
its boundary is deleted and the two neighbouring ranks are refreshed, until no adjacent parts can merge. Words
longer than `SCAN_LIMIT` parts go through a heap that merges in exactly the same order, so a text without spaces
stays near-linear.

Defined results: a null text counts as empty (no ids); very long texts are encoded piecewise, with the same ids;
repeated rows each get their own result; a null doc_id is returned as null; empty tables give empty results;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import text_bytes, values

#: Fixed value: how byte-level vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SCAN_LIMIT = 256
#: Words whose ids a worker keeps, and characters of a word that is kept at all; past the former the cache starts anew.
CACHE_WORDS = 250_000
CACHE_CHARS = 64
#: Characters of a text from which its words are streamed rather than listed.
STREAM_CHARS = 2_000_000
NONE = 1 << 60


def default_vocabulary() -> str:
    """Place of the public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes, by rule: printable Latin-1 stays itself,
    the other bytes follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Words(dict):
    """Ids by word; a missing word is encoded when asked for, and kept if it is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str):
        found = self.encode(word.encode())
        if len(word) <= CACHE_CHARS:
            self[word] = found
        return found


class BpeCodec:
    """Encoder and decoder of a byte-level vocabulary given as the JSON text of a tokenizer file."""

    def __init__(self, source: str):
        data = json.loads(source)
        symbols, model = byte_symbols(), data["model"]
        as_bytes = lambda t: bytes(symbols[c] for c in t)
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in data["added_tokens"])])
        self.tokens: list[bytes] = [b""] * size
        for t, i in model["vocab"].items():
            self.tokens[i] = as_bytes(t)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.names = [str(i) for i in range(size)]
        ids = {t: i for i, t in enumerate(self.tokens)}
        self.first = [ids[bytes([b])] for b in range(256)]
        self.shift = size.bit_length()
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks.setdefault(ids[a] << self.shift | ids[b], rank)
            self.made.append(ids[a + b])
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = _Words(self.encode_word)

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        ids = [self.first[b] for b in word]
        if len(ids) > SCAN_LIMIT:
            return self._encode_long(ids)
        rank, shift, made = self.ranks.get, self.shift, self.made
        bounds = list(range(len(ids) + 1))
        ranks = [rank(a << shift | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            ids[i] = made[least]
            del ids[i + 1], bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(ids[i] << shift | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(ids[i - 1] << shift | ids[i], NONE)
        return tuple(ids)

    def _encode_long(self, ids: list[int]) -> tuple[int, ...]:
        n, rank, shift = len(ids), self.ranks.get, self.shift
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << shift | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.made[r], 0, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (k := rank(ids[x] << shift | ids[y], NONE)) != NONE:
                    heapq.heappush(heap, (k, x, ids[x], ids[y]))
        return tuple(x for x, ok in zip(ids, alive) if ok)

    def segments(self, text: str):
        """``(piece of ordinary text, id of the special token behind it or None)``."""
        at = 0
        if self.split:
            for m in self.split.finditer(text):
                yield text[at : m.start()], self.special[m[0]]
                at = m.end()
        yield text[at:], None

    def encode_iter(self, text: str):
        """Lists of ids, one after the other, that make up the encoding."""
        look = self.words.__getitem__
        for piece, special in self.segments(text):
            if len(piece) < STREAM_CHARS:
                yield list(chain.from_iterable(map(look, self.pattern.findall(piece))))
            else:
                found = (m[0] for m in self.pattern.finditer(piece))
                while part := list(islice(found, 100_000)):
                    yield list(chain.from_iterable(map(look, part)))
                    self.trim()
            if special is not None:
                yield [special]
        self.trim()

    def trim(self) -> None:
        if len(self.words) > CACHE_WORDS:
            self.words.clear()

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encode_iter(text or "")))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_CODECS: dict[str, BpeCodec] = {}


def codec(source: str) -> BpeCodec:
    """One codec per worker and vocabulary."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = BpeCodec(source)
    return _CODECS[key]


def broadcast_vocabulary(spark: SparkSession, path: str | None = None):
    """The tokenizer file as a broadcast value; its size is fixed (1.5 MB here), whatever the data."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id, ids array<int>, decoded string)`` per row: the operator's own outputs."""
    source = broadcast_vocabulary(df.sparkSession, vocabulary)

    def run(batches):
        c = codec(source.value)
        for batch in batches:
            keys = values(batch, "id")
            for i, t in text_bytes(batch):
                ids = c.encode((t or b"").decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i]], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([c.decode(ids)], pa.string())], ["id", "ids", "decoded"]
                )

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, ids array<int>, decoded string")


def _digest(c: BpeCodec, text: str) -> tuple[int, str, str]:
    n, named, plain, first = 0, hashlib.sha256(), hashlib.sha256(), True
    if len(text) < STREAM_CHARS:
        ids = c.encode(text)
        named.update(",".join(map(c.names.__getitem__, ids)).encode())
        plain.update(c.decode(ids).encode())
        return len(ids), named.hexdigest(), plain.hexdigest()
    import codecs

    decoder = codecs.getincrementaldecoder("utf-8")("replace")  # a character may be cut between lists
    for ids in c.encode_iter(text):
        if ids:
            named.update((("" if first else ",") + ",".join(map(c.names.__getitem__, ids))).encode())
            plain.update(decoder.decode(c.decode_bytes(ids)).encode())
            n, first = n + len(ids), False
    plain.update(decoder.decode(b"", final=True).encode())
    return n, named.hexdigest(), plain.hexdigest()


def digest_table(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of what they decode to: one narrow row per document."""
    source = broadcast_vocabulary(df.sparkSession, vocabulary)

    def run(batches):
        c = codec(source.value)
        for batch in batches:
            rows = [_digest(c, (t or b"").decode("utf-8", "replace")) for _, t in text_bytes(batch)]
            n, ids, plain = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values(batch, "id"), pa.int64()), pa.array(np.array(n, np.int64)), pa.array(ids, pa.string()), pa.array(plain, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
