"""Packed token-id sequences: best-fit-decreasing with a segment tree over free capacities.

Documents are encoded by the tiktoken library, each ends with one end-of-text id, and documents longer than a sequence are split without loss.
Within a window of tokens the pieces are placed from the longest down into the sequence with the least free room that
still holds them; a segment tree over room finds that sequence in logarithmic time. Every packed row holds its ids,
the cumulative lengths of its segments and position ids that restart at every segment.

Windows lie within an input partition, so nothing is shuffled and memory is bounded by `WINDOW_TOKENS`. Which documents
share a row thus follows from the partitions of the input: the same files and split size give the same rows, another
partitioning the same documents in other rows.

A window is written as a raw id matrix (``.bin``) with its index (``.json``: shape, cumulative lengths, position resets,
documents and offsets) to the shared folder by the task that packs it. A file is named by its task's attempt and by the
manifest row, so a repeated task never mixes with an earlier one.

Defined results: null and empty texts give one end-of-text id; ``<|endoftext|>`` within a text becomes that id, as the
vocabulary says; repeated rows are packed as often as they occur; a null doc_id is kept as null; very long texts fill
several rows; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import text_bytes, values
from millrace.llm.wordpiece import default_vocabulary
from millrace.session import materialize, new_shared_path

LENGTH = 2048
END_ID = 50256
PAD_ID = 50256
#: How an id is written: 16 bits hold every id of this vocabulary.
ID_TYPE = "<u2"
WINDOW_TOKENS = 2_000_000


#: How the vocabulary cuts a text, and its special token.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = {"<|endoftext|>": END_ID}
#: White space from which a run is cut out before the library's pattern sees it, which backtracks over such runs.
BLANKS = 4096
_ENCODERS: dict[int, object] = {}


def encoder(source: str):
    """The tiktoken encoding of a rank file's text, made once per worker."""
    import base64

    import tiktoken

    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in source.splitlines() if line.strip())}
        _ENCODERS[key] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        if _ENCODERS[key].max_token_value > np.iinfo(ID_TYPE).max:
            raise ValueError(f"ids of {ID_TYPE} do not hold this vocabulary")
    return _ENCODERS[key]


def encode(c, text: str) -> list[int]:
    """Ids of a whole text. A long run of white space is one piece, but for a last character that a word follows."""
    import regex

    if len(text) < BLANKS:
        return c.encode(text, allowed_special="all")
    out, at = [], 0
    for m in regex.finditer(rf"\s{{{BLANKS},}}+", text):
        end = m.end() if m.end() == len(text) or text.startswith(tuple(SPECIAL), m.end()) else m.end() - 1
        out += c.encode(text[at : m.start()], allowed_special="all")
        out += c._encode_single_piece(text[m.start() : end])
        at = end
    return out + c.encode(text[at:], allowed_special="all")


class RoomTree:
    """Multiset of sequences by free room, with the smallest room of at least ``need`` found in O(log length)."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = np.zeros(2 * self.size, np.int32).tolist()
        self.held: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.held[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return ``(row, room)`` of the tightest fit."""
        at = need + self.size
        if not self.count[at]:
            while at > 1 and not (at % 2 == 0 and self.count[at + 1]):  # up until something lies to the right
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.size
        self._add(room, -1)
        return self.held[room].pop(), room


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers, packed by best-fit-decreasing; equal lengths in their given order."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        row, room = found if found else (len(rows), length)
        if not found:
            rows.append([])
        rows[row].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], row)
    return rows


SCHEMA = (
    "window string, row int, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
    "doc_ids array<long>, doc_offsets array<long>, ids_sha256 string"
)
ARROW = pa.schema([
    ("window", pa.string()), ("row", pa.int32()), ("n_tokens", pa.int32()), ("input_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("doc_offsets", pa.list_(pa.int64())), ("ids_sha256", pa.string()),
])


def pack_window(name: str, docs: list[tuple[int | None, np.ndarray]], length: int, pad: int = PAD_ID):
    """A record batch with the packed rows of some documents."""
    pieces = [(key, at, ids[at : at + length]) for key, ids in docs for at in range(0, len(ids), length)]
    out: dict[str, list] = {f.name: [] for f in ARROW}
    for n, row in enumerate(best_fit([len(p[2]) for p in pieces], length)):
        ids = np.full(length, pad, ID_TYPE)
        cut = np.cumsum([0, *(len(pieces[i][2]) for i in row)])
        for i, a, b in zip(row, cut, cut[1:]):
            ids[a:b] = pieces[i][2]
        raw = ids.tobytes()
        for k, v in zip(out, (name, n, int(cut[-1]), raw, cut.tolist(), cut[:-1].tolist(), [pieces[i][0] for i in row], [pieces[i][1] for i in row], hashlib.sha256(raw).hexdigest())):
            out[k].append(v)
    return pa.RecordBatch.from_pydict(out, schema=ARROW)


def windows(df: DataFrame, key: str, text: str, length: int, vocabulary: str | None, window_tokens: int):
    """The source of `pack` and `write`, and a function from its Arrow batches to ``(number, packed rows)``."""
    with open(vocabulary or default_vocabulary(), encoding="ascii") as f:
        source = df.sparkSession.sparkContext.broadcast(f.read())  # below 1 MB, whatever the data

    def run(batches, part: int):
        c, n, held, size = encoder(source.value), 0, [], 0
        for batch in batches:
            keys = values(batch, "id")
            for i, t in text_bytes(batch):
                ids = np.array(encode(c, (t or b"").decode("utf-8", "replace")), np.int32)
                held.append((keys[i], np.append(ids, np.int32(END_ID))))
                size += len(ids) + 1
                if size >= window_tokens:
                    yield n, pack_window(f"{part:06d}-{n:06d}", held, length)
                    held, size, n = [], 0, n + 1
        if held:
            yield n, pack_window(f"{part:06d}-{n:06d}", held, length)

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")), run


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """One row per packed sequence. ``input_ids`` are ``length`` ids as `ID_TYPE`, padded behind ``n_tokens``."""
    source, packed = windows(df, key, text, length, vocabulary, window_tokens)

    def run(batches):
        from pyspark import TaskContext

        for _, rows in packed(batches, TaskContext.get().partitionId()):
            yield rows

    return source.mapInArrow(run, SCHEMA)


def positions(cu_seqlens, length: int) -> np.ndarray:
    """Position ids of a packed row: they restart at every segment and run on over the padding."""
    starts = np.zeros(length, np.int64)
    cut = [x for x in cu_seqlens if x < length]
    starts[cut] = cut
    return np.arange(length) - np.maximum.accumulate(starts)


def unpack(rows) -> dict[int | None, list[int]]:
    """Ids by document from collected packed rows (for checks of round trips)."""
    found: dict[int | None, list[tuple[int, list[int]]]] = {}
    for r in rows:
        ids = np.frombuffer(r["input_ids"], ID_TYPE)
        for doc, at, a, b in zip(r["doc_ids"], r["doc_offsets"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            found.setdefault(doc, []).append((at, ids[a:b].tolist()))
    return {k: [x for _, part in sorted(v) for x in part] for k, v in found.items()}


INDEX = ("n_tokens", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets")
MANIFEST = "window string, rows long, file string"


def write(df: DataFrame, uri: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: str | None = None, window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Pack and write; the manifest ``(window, rows, file)`` of the id matrices, each with its ``.json`` beside it."""
    source, packed = windows(df, key, text, length, vocabulary, window_tokens)

    def run(batches):
        from pyspark import TaskContext

        task, (fs, base) = TaskContext.get(), pafs.FileSystem.from_uri(uri)
        fs.create_dir(base, recursive=True)
        for n, rows in packed(batches, task.partitionId()):
            name = f"{base}/part-{task.partitionId():06d}-{n:06d}-{task.taskAttemptId()}"
            index = {"window": values(rows, "window")[0], "shape": [len(rows), length], "dtype": ID_TYPE} | {k: values(rows, k) for k in INDEX}
            with fs.open_output_stream(f"{name}.bin") as f:
                for raw in rows.column("input_ids"):
                    f.write(raw.as_buffer())
            with fs.open_output_stream(f"{name}.json") as f:
                f.write(json.dumps(index).encode())
            yield pa.RecordBatch.from_arrays([pa.array([index["window"]]), pa.array([len(rows)], pa.int64()), pa.array([f"{name}.bin"])], ["window", "rows", "file"])

    return materialize(source.mapInArrow(run, MANIFEST))


def read(manifest: DataFrame, uri: str) -> DataFrame:
    """The packed rows of written windows, as `pack` returns them."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for file in values(batch, "file"):
                with fs.open_input_stream(file.removesuffix(".bin") + ".json") as f:
                    index = json.loads(f.read())
                n, length = index["shape"]
                size = np.dtype(index["dtype"]).itemsize * length
                with fs.open_input_stream(file) as f:
                    raw = [f.read(size) for _ in range(n)]
                if any(len(r) != size for r in raw):
                    raise EOFError(f"{file} ends early")
                rows = {"window": [index["window"]] * n, "row": list(range(n)), "input_ids": raw, "ids_sha256": [hashlib.sha256(r).hexdigest() for r in raw]} | {k: index[k] for k in INDEX}
                yield pa.RecordBatch.from_pydict(rows, schema=ARROW)

    return manifest.select("file").mapInArrow(run, SCHEMA)


def report(df: DataFrame) -> DataFrame:
    """The packed sequences as read back from the files written, with a digest in the place of the id matrix.

    The files stay in the shared folder; they are the operator's output.
    """
    uri = new_shared_path(df.sparkSession, "packed")
    return read(write(df, uri), uri).drop("input_ids")
