"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text. Its low 16 bits depend on the last 16 bytes only. A chunk begins at a word
whose hash is not larger than those of the `RADIUS` words before and behind it; in a stretch that repeats itself every
period has such a word. A word of more than `LONG` bytes (text without spaces) is also cut within, at characters whose hash
is not larger than those of the `LONG_RADIUS` characters around, and weighs a word for every `LONG_WORD` bytes. So a boundary depends on its own neighbourhood and nothing else: an insertion moves the bytes behind it but changes
no boundary beyond a few words. Chunks are compared by a 128-bit digest; the occurrence in the document with the
smallest doc_id stays, and a later run of repeated chunks is cut out if it has at least `MIN_WORDS` words; below twice that, half
of them must have their first occurrence in one document. Both leave chance runs of short common phrases alone.

Defined results: null texts stay null; texts without words and shorter than the threshold stay as they are; rows
with a null doc_id take no part and stay as they are; rows that share a doc_id count as one document whose copies do
not delete each other; a text that repeats others throughout becomes empty; empty tables give empty results; further
columns are carried along, but a column named like one of the details (`ADDED`) is replaced by it, and a column ``n_chars``
follows a text that is cut. Columns whose names begin with ``__mr_`` are the operator's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import join_facts, text_bytes, values
from millrace.session import materialize

RADIUS = 3
MIN_WORDS = 25
LONG, LONG_RADIUS, LONG_WORD = 64, 8, 8
#: Gear values by rule: XXH64 of the byte, low 16 bits.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling gear hash at each byte: the sum of the last 16 gear values, each shifted by its age (modulo 2**16)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[step:] = h[:-step]
        h = h + (older << step)
    return h


def least(h: np.ndarray, radius: int) -> np.ndarray:
    """Marks of the values that no value within the radius is smaller than."""
    ok = np.ones(len(h), bool)
    for d in range(1, min(radius, len(h) - 1) + 1):
        ok[d:] &= h[d:] <= h[:-d]
        ok[:-d] &= h[:-d] <= h[d:]
    return ok


def boundaries(text: bytes, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which chunks begin, and the number of words of each chunk."""
    data = np.frombuffer(text, np.uint8)
    blank = SPACE[data]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]]) if len(data) else np.empty(0, np.int64)
    n = len(starts)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rolled = gear(data)
    ok = least(rolled[np.maximum(starts - 1, 0)], radius)
    ok[0] = True
    sizes = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1 - starts
    weights = np.where(sizes > LONG, sizes // LONG_WORD, 1)
    before = np.cumsum(weights) - weights
    at, count = starts[ok], before[ok]
    for k in np.flatnonzero(sizes > LONG).tolist():
        inner = starts[k] + 1 + np.flatnonzero(data[starts[k] + 1 : starts[k] + sizes[k]] & 0xC0 != 0x80)
        inner = inner[least(rolled[inner - 1], LONG_RADIUS)]
        at, count = np.r_[at, inner], np.r_[count, before[k] + (inner - starts[k]) // LONG_WORD]
    order = np.argsort(at, kind="stable")
    return at[order], np.diff(np.r_[count[order], weights.sum()])


def digests(text: bytes, starts: np.ndarray) -> list[bytes]:
    """128-bit digest of every chunk, without the white space behind it."""
    h, cuts = xxhash.xxh3_128_digest, [*starts.tolist(), len(text)]
    return [h(text[a:b].rstrip()) for a, b in zip(cuts, cuts[1:])]


def row_name(key: str, text: str) -> Column:
    """A row's name by its key and text: equal rows are one, rows that share a key only are not. Null without a key."""
    return F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")))


def chunk_table(df: DataFrame, key: str = "doc_id", text: str = "text", named: bool = False) -> DataFrame:
    """``(d1, d2, doc, ord)``: a row for every chunk of every document; ``d1, d2`` are the digest and ``doc`` the key, or the
    row's name with ``named``."""

    def run(batches):
        for batch in batches:
            keys, docs, ords, parts, size = values(batch, "id"), [], [], [], 0
            for i, t in text_bytes(batch):
                found = digests(t, boundaries(t)[0]) if t else []
                docs.append(np.full(len(found), keys[i], np.int64))
                ords.append(np.arange(len(found), dtype=np.int32))
                parts.append(b"".join(found))
                size += len(found)
                if size > 200_000:
                    yield rows(docs, ords, parts)
                    docs, ords, parts, size = [], [], [], 0
            if size:
                yield rows(docs, ords, parts)

    def rows(docs, ords, parts):
        d = np.frombuffer(b"".join(parts), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1])), pa.array(np.concatenate(docs)), pa.array(np.concatenate(ords))], ["d1", "d2", "doc", "ord"]
        )

    name = row_name(key, text) if named else F.col(key).cast("long")
    source = df.where(F.col(key).isNotNull()).select(name.alias("id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, "d1 long, d2 long, doc long, ord int")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, chunks array<struct<ord, first, d1>>)``: for each row, by name, its chunks that occur elsewhere before, or
    again in it, with the document of the first occurrence.

    Digests are counted with sums combined before the shuffle. What is gathered by name is a row's own chunks, once,
    however many rows share a key or are equal.
    """
    chunks = chunk_table(df, key, text)
    firsts = materialize(chunks.groupBy("d1", "d2").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = join_facts(chunk_table(df, key, text, named=True), firsts, ["d1", "d2"], "first", ["doc", "ord"]).where("first IS NOT NULL")
    # The first document keeps the first of its own occurrences, which `cut` sees for itself.
    return again.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("ord", "first", "d1"))).alias("chunks"))


def cut(text: bytes, own: int, found: list[dict], min_words: int = MIN_WORDS) -> tuple[bytes, int, int, int, list[int]]:
    """Text without repeated runs; its chunks, those removed, words removed and the documents that hold them first."""
    starts, words = boundaries(text)
    n, first, seen, repeated = len(starts), {}, set(), np.zeros(len(starts), bool)
    names = digests(text, starts)
    for x in found:  # rows of one doc_id may hold other texts: the digest tells which chunks are meant
        i = x["ord"]
        if i < n and i not in first and int.from_bytes(names[i][:8], "little", signed=True) == x["d1"]:
            first[i] = x["first"]
            repeated[i] = first[i] < own or names[i] in seen
            seen.add(names[i])
    edge = np.flatnonzero(np.diff(np.r_[False, repeated, False].astype(np.int8)))
    out, at, gone, removed, sources, ends = [], 0, 0, 0, set(), [*starts.tolist(), len(text)]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        shares: dict[int, int] = {}
        for i in range(a, b):
            shares[first[i]] = shares.get(first[i], 0) + int(words[i])
        size = int(words[a:b].sum())
        if size >= 2 * min_words or size >= min_words and 2 * max(shares.values()) >= size:
            out.append(text[at : ends[a]])
            at = ends[b]
            gone += b - a
            removed += size
            sources |= {first[i] for i in range(a, b)}
    left = b"".join(out) + text[at:]
    return left if left.split() else b"", n, gone, removed, sorted(sources)


ADDED = "n_chunks long, n_chunks_removed long, n_words_removed long, first_doc_ids array<long>"


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, details: bool = False, chars: str = "n_chars") -> DataFrame:
    """The rows of ``df`` with repeated passages cut out of ``text``.

    With ``details``, adds the number of chunks of a text that holds any found elsewhere, how many chunks and words are cut,
    and the documents that hold them first (zeros and an empty list where nothing repeats). A column named ``chars``
    becomes the number of characters where something is cut.
    """
    added = T.StructType.fromDDL(ADDED).fields if details else []
    own = [f for f in df.schema.fields if f.name not in {a.name for a in added}]
    found = repeats(df, key, text).select(F.col("doc").alias("__mr_doc"), F.col("chunks").alias("__mr_chunks"))
    rows = df.select(*[F.col(f"`{f.name}`") for f in own], F.col(key).cast("long").alias("__mr_own"), row_name(key, text).alias("__mr_row"))
    joined = rows.join(found, F.col("__mr_row") == F.col("__mr_doc"), "left")

    def run(batches):
        for batch in batches:
            keys, chunks = values(batch, "__mr_own"), values(batch, "__mr_chunks")
            rows, texts, sizes = [], [], []
            for i, t in text_bytes(batch, text):
                done = cut(t or b"", keys[i], chunks[i], min_words) if chunks[i] else (t, 0, 0, 0, [])
                rows.append(done[1:])
                texts.append(None if t is None else done[0])
                sizes.append(len(done[0].decode("utf-8", "replace")) if done[3] else None)
            made = {text: pa.array(texts, pa.binary()).cast(pa.string())}
            if chars in batch.schema.names:
                was = batch.column(batch.schema.get_field_index(chars))
                made[chars] = pc.coalesce(pa.array(sizes, pa.int64()).cast(was.type), was)
            kept = [made.get(f.name, batch.column(k)) for k, f in enumerate(own)]
            if details:
                kept += [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(kept, [f.name for f in schema.fields])

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in [*own, *added]])
    return joined.mapInArrow(run, schema)


def keep_rest(df: DataFrame) -> DataFrame:
    """`deduplicate` without the documents of which nothing is left."""
    out = deduplicate(df)
    before_empty = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    return out.where(~before_empty | F.col("text").isNull())
