"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised by the longest prefixes that the model's compiled character map has, every space becomes the
space mark, and breakpoints record where each stretch of the normalised text comes from. Pieces are merged by score within
stretches that no piece of the vocabulary can cross, and each piece is projected through the breakpoints to its span of
bytes in the original text.

Models are BPE with byte fallback; others (unigram, user-defined or unused pieces, spaces as suffix) end with a ValueError.

Defined results: a null text counts as empty (begin and end only); spans are bytes of the text's UTF-8; of the
bytes that stand for one unknown character the last holds its span and the others are empty, as in the library; the mark put before a text has
an empty span; very long texts are encoded piecewise with the same ids; repeated rows each get their own result; a null
doc_id is returned as null; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import text_bytes, values

#: The mark of a space, the kinds of pieces and the numbers of the fields of a model file that are read.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
#: Fixed value: what an unknown piece is decoded to when the model does not say.
UNKNOWN_SURFACE = " ⁇ "

SCAN_LIMIT = 128
#: Stretches whose ids a worker keeps, and characters of one that is kept at all; past the former the cache starts anew.
CACHE_STRETCHES, CACHE_CHARS = 250_000, 64
#: Characters of a text from which its stretches are streamed rather than listed.
STREAM_CHARS, STREAM_STRETCHES = 2_000_000, 100_000
#: Bytes of texts whose stretches are learned together, and stretches that are merged side by side.
LEARN_BYTES, BATCH = 1 << 20, 4096
NONE, LAST = 1 << 60, np.int32(2**31 - 1)


def default_model() -> str:
    """Place of the public model on this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes):
    """``(number, value)`` of a serialized message: integers, or bytes for everything with a length or a fixed width."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharMap:
    """Longest-prefix replacement by a compiled map: the size of a double-array trie, the trie, and the replacements, each ended by a zero."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.texts = compiled[4 + size :]
        leads = bytes(b for b in range(256) if self.units and self._step(self._child(0), b) is not None)
        self.lead = re.compile(b"[" + re.escape(leads) + b"]") if leads else None

    def _child(self, at: int) -> int:
        unit = self.units[at]
        return at ^ (unit >> 10 << ((unit & 1 << 9) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """End and replacement of the longest prefix of ``text[at:]`` that the map has."""
        base, best = self._child(0), None
        for k in range(at, len(text)):
            if (node := self._step(base, text[k])) is None:
                break
            base = self._child(node)
            if self.units[node] >> 8 & 1:  # a value hangs here
                best = k + 1, self.units[base] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.texts[best[1] : self.texts.index(b"\0", best[1])]

    def edits(self, text: bytes):
        """``(start, end, replacement)`` of every prefix that is replaced, from the left."""
        end = 0
        for m in self.lead.finditer(text) if self.lead else ():
            if m.start() >= end and (found := self.longest(text, m.start())):
                end = found[0]
                yield m.start(), *found


class Alignment:
    """Where a normalised text comes from: at ``at[k]`` begins a stretch from the source byte ``to[k]``, copied if ``copied[k]``, else put in its place."""

    def __init__(self, at: np.ndarray, to: np.ndarray, copied: np.ndarray):
        self.at, self.to, self.copied = at, to, copied

    def source(self, offsets: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.at, offsets, "right") - 1
        return self.to[k] + np.where(self.copied[k], offsets - self.at[k], 0)


class _Stretches(dict):
    """Ids by stretch; computed when asked for, and kept if the stretch is short."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, stretch: str):
        found = self.encode(stretch)
        if len(stretch) <= CACHE_CHARS:
            self[stretch] = found
        return found


class PieceCodec:
    """Encoder and decoder of a model file's bytes."""

    def __init__(self, model: bytes):
        message = list(fields(model))
        pieces = [dict(fields(v)) for n, v in message if n == PIECES]
        trainer = next((dict(fields(v)) for n, v in message if n == TRAINER), {})
        rules = next((dict(fields(v)) for n, v in message if n == NORMALIZER), {})
        kinds = [p.get(3, NORMAL) for p in pieces]
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0) or not rules.get(5, 1) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces can be used")
        self.pieces = [p[1].decode() for p in pieces]
        self.kinds, self.unknown = kinds, kinds.index(UNKNOWN)
        self.controls = {i for i, kind in enumerate(kinds) if kind == CONTROL}
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown_surface = trainer[44].decode() if 44 in trainer else UNKNOWN_SURFACE
        self.prefix, self.squeeze = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.map = CharMap(rules.get(2, b""))
        score = {i: struct.unpack("<f", p.get(2, bytes(4)))[0] for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.ids = {self.pieces[i]: i for i in score}
        self.ranks = {self.pieces[i]: order[s] for i, s in score.items()}  # the best score first; pieces of equal score share a rank
        self.byte_ids = [0] * 256
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        self.is_byte = np.array([kind == BYTE for kind in kinds])
        self.sizes = np.array([1 if kind == BYTE else len(p.encode()) for p, kind in zip(self.pieces, kinds)], np.int64)
        self.surfaces = [self._surface(i) for i in range(len(pieces))]
        # Stretches that no piece crosses: a mark never follows another character within a piece, and a character that no
        # longer piece holds stands by itself.
        joined = {c for p in self.ids if len(p) > 1 for c in p} - {MARK}
        inner = "".join(map(re.escape, sorted(joined)))
        apart = inner and all(MARK not in p.lstrip(MARK) for p in self.ids)
        self.pattern = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|[^{MARK}{inner}]" if apart else "(?s).+")
        self.stretches = _Stretches(self.encode_stretch)
        # Every way to make a piece of two others, by the pair's number: for stretches that are merged side by side.
        made = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    made[a * len(pieces) + b] = i
        self.pairs = np.array(sorted(made), np.int64)
        self.singles = {p for p in self.ids if len(p) == 1}
        self.made = np.array([made[k] for k in self.pairs.tolist()], np.int32)
        self.pair_ranks = np.array([self.ranks[self.pieces[i]] for i in self.made.tolist()], np.int32)

    # ---- normalisation

    def _edits(self, text: bytes) -> tuple[list[tuple[int, int, bytes]], int]:
        """Everything that does not stay as it is: mapped prefixes and the spaces between them, less those that are squeezed out; and where the text begins behind the latter."""
        out, at = [], 0
        for start, end, new in chain(self.map.edits(text), [(len(text), len(text), None)]):
            while (space := text.find(b" ", at, start)) >= 0:
                out.append((space, space + 1, b" "))
                at = space + 1
            if new is not None:
                out.append((start, end, new))
            at = end
        if not self.squeeze:
            return out, 0
        kept, last, after_space, head = [], 0, True, 0
        for start, end, new in out:
            after_space = after_space and start == last
            head = end if start == head and new == b" " else head
            new = new.lstrip(b" ") if after_space else new
            after_space = new.endswith(b" ") if new else after_space
            kept.append((start, end, new))
            last = end
        return kept, head

    def normalize(self, text: bytes) -> tuple[bytes, Alignment]:
        """The normalised text and the alignment of its bytes."""
        mark, head = MARK.encode(), 0
        if self.map.lead is None and not self.squeeze:
            starts = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            ends, sizes = starts + 1, np.full(len(starts), len(mark))
            body = text.replace(b" ", mark)
        else:
            edits, head = self._edits(text)
            parts, at = [], 0
            for start, end, new in edits:
                parts += [text[at:start], new.replace(b" ", mark)]
                at = end
            body = b"".join([*parts, text[at:]])
            starts, ends, sizes = (np.array(x, np.int64) for x in ([e[0] for e in edits], [e[1] for e in edits], [len(x) for x in parts[1::2]]))
        if not body:
            return b"", Alignment(np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool))
        shift = len(mark) * self.prefix
        moved = shift + np.r_[0, np.cumsum(sizes - (ends - starts))]
        at, to, copied = np.empty((3, 2 * len(starts) + 2), np.int64)
        at[:2], to[:2], copied[:2] = (0, shift), (head, 0), (0, 1)
        at[2::2], to[2::2], copied[2::2] = starts + moved[:-1], starts, 0
        at[3::2], to[3::2], copied[3::2] = ends + moved[1:], ends, 1
        norm = mark * self.prefix + body
        while self.squeeze and norm.endswith(mark):
            norm = norm[: -len(mark)]
        return norm, Alignment(at, to, copied.astype(bool))

    # ---- merging

    def encode_stretch(self, stretch: str) -> bytes:
        """Ids of a stretch's pieces as 32-bit integers."""
        ids = []
        for part in self._merged(list(stretch)):
            i = self.ids.get(part)
            if i is None:
                ids += [self.byte_ids[b] for b in part.encode()]
            else:
                ids.append(i)
        return array("I", ids).tobytes()

    def _merged(self, parts: list[str]) -> list[str]:
        """Adjacent parts are joined, the best score first and of equal ones the leftmost, until no two make a piece."""
        return (self._scan if len(parts) <= SCAN_LIMIT else self._heap)(parts)

    def _scan(self, parts: list[str]) -> list[str]:
        rank = self.ranks.get
        ranks = [rank(a + b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NONE)
        return parts

    def _heap(self, parts: list[str]) -> list[str]:
        n, rank = len(parts), self.ranks.get
        after, before = [*range(1, n), n], [*range(-1, n - 1)]
        heap = [(r, i, len(a), len(b)) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a + b, NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or not parts[i] or len(parts[i]) != a or len(parts[j]) != b:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank(parts[x] + parts[y], NONE)) != NONE:
                    heapq.heappush(heap, (r, x, len(parts[x]), len(parts[y])))
        return [p for p in parts if p]

    # ---- merging of many stretches side by side

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank, or LAST, and piece of each pair of ids; a negative id makes no pair."""
        key = a * np.int64(len(self.pieces)) + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], LAST), self.made[at]

    def learn(self, stretches) -> None:
        """Encodes the short ones of some lists of stretches that are not known yet, a step of all of them at a time."""
        singles, new = self.singles, set().union(*stretches).difference(self.stretches)
        new = [w for w in new if len(w) <= CACHE_CHARS]
        by_width: dict[int, list[str]] = {}
        for w in new if len(self.pairs) else ():
            if singles.issuperset(w):
                by_width.setdefault(len(w) + 3 & ~3, []).append(w)
        for width, words in by_width.items():
            for at in range(0, len(words), BATCH):
                self._learn(words[at : at + BATCH], width)

    def _learn(self, words: list[str], width: int) -> None:
        parts = np.full((len(words), width), -1, np.int32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        parts[np.arange(width) < sizes[:, None]] = list(map(self.ids.__getitem__, "".join(words)))
        rows = np.arange(len(words))
        ranks = self._look(parts[:, :-1], parts[:, 1:])[0]
        while len(rows):
            j = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = np.take_along_axis(ranks, j[:, None], 1)[:, 0] if ranks.shape[1] else np.full(len(rows), LAST)
            done = least == LAST
            if done.any():
                flat = parts[done]
                ends, raw = 4 * np.cumsum((flat >= 0).sum(axis=1)), flat[flat >= 0].astype("<u4").tobytes()
                begin = 0
                for i, end in zip(rows[done].tolist(), ends.tolist()):
                    self.stretches[words[i]] = raw[begin:end]
                    begin = end
                rows, parts, ranks, j = rows[~done], parts[~done], ranks[~done], j[~done]
                if not len(rows):
                    break
            # Every row left joins one pair, so all become one part shorter.
            here, cols = np.arange(len(rows)), np.arange(parts.shape[1] - 1)
            joined = self._look(parts[here, j], parts[here, j + 1])[1]
            parts = np.take_along_axis(parts, cols + (cols > j[:, None]), 1)
            parts[here, j] = joined
            ranks = np.take_along_axis(ranks, cols[:-1] + (cols[:-1] >= j[:, None]), 1)
            for left in (j - 1, j):
                some = np.flatnonzero((left >= 0) & (left < ranks.shape[1]))
                ranks[some, left[some]] = self._look(parts[some, left[some]], parts[some, left[some] + 1])[0]

    # ---- encoding

    def listed(self, norm: bytes) -> list[str] | None:
        """The stretches of a normalised text, or None for one that is streamed."""
        text = norm.decode()
        return self.pattern.findall(text) if len(text) < STREAM_CHARS else None

    def encode_iter(self, norm: bytes, stretches: list[str] | None):
        """Ids of a normalised text as bytes of 32-bit integers, one part after the other."""
        look = self.stretches.__getitem__
        if stretches is not None:
            yield b"".join(map(look, stretches))
        else:
            every = (m[0] for m in self.pattern.finditer(norm.decode()))
            while part := list(islice(every, STREAM_STRETCHES)):
                self.learn([part])
                yield b"".join(map(look, part))
                self.trim()
        self.trim()

    def trim(self) -> None:
        if len(self.stretches) > CACHE_STRETCHES:
            self.stretches.clear()

    def normalized(self, texts):
        """``(normalised text, alignment, stretches)`` of each text; the stretches of some `LEARN_BYTES` are learned together."""
        held, size = [], 0
        for text in texts:
            norm, alignment = self.normalize(text or b"")
            held.append((norm, alignment, self.listed(norm)))
            size += len(norm)
            if size > LEARN_BYTES:
                self.learn([x[2] for x in held if x[2]])
                yield from held
                held, size = [], 0
        self.learn([x[2] for x in held if x[2]])
        yield from held

    def encode_parts(self, norm: bytes, alignment: Alignment, stretches: list[str] | None):
        """``(ids, begins, ends)`` of a normalised text's pieces, without begin and end, one part after the other."""
        at, plain = 0, np.frombuffer(norm, np.uint8)
        for ids in self.encode_iter(norm, stretches):
            ids = np.frombuffer(ids, np.uint32)
            edges = at + np.r_[0, np.cumsum(self.sizes[ids])]
            at = int(edges[-1])
            if self.is_byte[ids].any():  # an edge within a character goes back to its first byte
                for _ in range(3):
                    edges[:-1] -= plain[edges[:-1]] >> 6 == 2
            spans = alignment.source(edges)
            yield ids, spans[:-1], spans[1:]

    def encode(self, text: str | bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(ids, begins, ends)`` of a whole text with begin and end ids."""
        raw = text.encode() if isinstance(text, str) else text or b""
        parts = [p for found in self.normalized([raw]) for p in self.encode_parts(*found)]
        edges = [np.array([self.begin]), *[p[0] for p in parts], np.array([self.end])]
        spans = [[np.zeros(1, np.int64), *[p[k] for p in parts], np.full(1, len(raw), np.int64)] for k in (1, 2)]
        return np.concatenate(edges).astype(np.uint32), np.concatenate(spans[0]), np.concatenate(spans[1])

    # ---- decoding

    def _surface(self, i: int) -> bytes:
        if self.kinds[i] == BYTE:
            return bytes([int(self.pieces[i][1:-1], 16)])
        if self.kinds[i] == CONTROL:
            return b""
        return (self.unknown_surface if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " ")).encode()

    def decode(self, ids) -> str:
        """The text of any list of ids: the mark before the text goes, bytes that make no character become U+FFFD each."""
        ids = np.asarray(ids).tolist()
        head, first = [], 0  # what the first pieces with a surface give, up to the piece that may lose its mark
        strip = self.prefix or self.squeeze
        while first < len(ids):
            i = ids[first]
            kind = self.kinds[i]
            first += 1
            if kind == CONTROL:
                continue
            if kind == BYTE:
                first -= 1
                break
            surface = self.surfaces[i]
            marked = strip and kind == NORMAL and surface[:1] == b" "
            head.append(surface[1:] if marked else surface)
            if self.squeeze and marked and len(surface) == 1:
                continue  # every mark at the beginning goes
            break
        rest = ids[first:]
        while rest and self.kinds[rest[-1]] == CONTROL:
            rest.pop()
        if self.controls.isdisjoint(rest):  # else bytes on both sides of one make no character
            try:
                return b"".join([*head, *map(self.surfaces.__getitem__, rest)]).decode()
            except UnicodeDecodeError:
                pass
        return self._decode_runs(b"".join(head), rest)

    def _decode_runs(self, head: bytes, ids: list[int]) -> str:
        out, run = [head.decode()], bytearray()
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.surfaces[i]
            else:
                out += [characters(run), self.surfaces[i].decode()]
                run.clear()
        return "".join([*out, characters(run)])


def characters(run: bytes | bytearray) -> str:
    """UTF-8 characters of a run of bytes; a byte that begins none is U+FFFD by itself."""
    out, at, run = [], 0, bytes(run)
    while at < len(run):
        try:
            out.append(run[at:].decode())
            break
        except UnicodeDecodeError as error:
            out += [run[at : at + error.start].decode(), "�"]
            at += error.start + 1
    return "".join(out)


_CODECS: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per worker and model."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def broadcast_model(spark: SparkSession, path: str | None = None):
    """The model file as a broadcast value; its size is fixed (0.5 MB here), whatever the data."""
    with open(path or default_model(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``(id, ids, pieces, begins, ends, decoded)`` per row: the operator's own outputs, a few rows at a time."""
    source = broadcast_model(df.sparkSession, model)

    def run(batches):
        c = codec(source.value)
        for batch in batches:
            keys = values(batch, "id")
            for i, t in text_bytes(batch):
                ids, begins, ends = c.encode(t)
                columns = [
                    pa.array([keys[i]], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([[c.pieces[x] for x in ids]], pa.list_(pa.string())),
                    pa.array([begins], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([c.decode(ids)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "ids", "pieces", "begins", "ends", "decoded"])

    return _source(df, key, text).mapInArrow(run, "id long, ids array<int>, pieces array<string>, begins array<long>, ends array<long>, decoded string")


def _digest(c: PieceCodec, norm: bytes, alignment: Alignment, stretches: list[str] | None) -> tuple[int, str, str, str]:
    named, spans = hashlib.sha256(struct.pack("<I", c.begin)), hashlib.sha256()
    every = [np.array([c.begin], "<u4")]
    for ids, begins, ends in c.encode_parts(norm, alignment, stretches):
        named.update(ids.tobytes())
        spans.update(np.stack([begins, ends], axis=1).tobytes())
        every.append(ids)
    named.update(struct.pack("<I", c.end))
    whole = np.concatenate([*every, np.array([c.end], "<u4")])
    return len(whole), named.hexdigest(), hashlib.sha256(c.decode(whole).encode()).hexdigest(), spans.hexdigest()


def digest_table(df: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256)`` per row; the spans are pairs of 64-bit byte offsets of the pieces."""
    source = broadcast_model(df.sparkSession, model)

    def run(batches):
        c = codec(source.value)
        for batch in batches:
            rows = [_digest(c, *found) for found in c.normalized(t for _, t in text_bytes(batch))]
            n, ids, plain, spans = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(values(batch, "id"), pa.int64()), pa.array(np.array(n, np.int64)), pa.array(ids, pa.string()), pa.array(plain, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"],
            )

    return _source(df, key, text).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
