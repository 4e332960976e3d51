"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification and components.

A fingerprint sums the bits of the XXH64 of every word shingle; two fingerprints are linked when they differ in at
most `MAX_BITS` bits. Cut into ``B`` blocks, a linked pair agrees in at least ``B - MAX_BITS`` of them, so a row for
every choice of that many blocks brings each linked pair together under some key. Rows that share a key are sorted
together and compared there; of the links found only a spanning forest leaves the task, never all pairs of a group.

Equal fingerprints are one node, so groups of copies shrink before any comparison. A key with more than `CROWDED`
fingerprints is not gathered: its task lets them pass and reports the key, whose rows are then spread over longer keys
that are complete for it.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a null doc_id gets its
fingerprint and a null component_id and links nothing; rows that share a doc_id are nodes of one document; ties
cannot arise since components are named by the smallest doc_id; empty tables give empty results; further columns
of the input are not read.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import text_bytes, values
from millrace.operators.components import connected_components
from millrace.session import materialize

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints expected under one key, if they were spread evenly; more blocks are cut when there would be more.
PER_KEY = 64
#: Groups up to this size are compared by shifted rows; larger ones by a search that visits each member once.
SHIFTED = 48
#: Fingerprints that a task gathers under one key; beyond it the key is refined.
CROWDED = 1 << 17


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit fingerprint of a whole UTF-8 text."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the white space of ASCII
    n = len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if n else 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: n - shingle + 1], ends[shingle - 1 :]
    total, counts, h = len(starts), np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, total, 1 << 16):
        part = b"".join([h(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist())])
        bits = np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp)`` per row; ``fp`` is the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for _, t in text_bytes(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(values(batch, "id"), pa.int64()), pa.array(found.view(np.int64))], ["id", "fp"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def plan_blocks(n: int, bits: int = MAX_BITS, per_key: int = PER_KEY) -> list[list[tuple[int, int]]]:
    """Choices of blocks, each a list of ``(offset, width)``; all are complete, more blocks give longer keys."""
    for blocks in range(bits + 1, 2 * bits + 1):
        width = 64 / blocks
        if n <= per_key * 2 ** math.floor(width * (blocks - bits)):
            break
    cuts = [round(i * width) for i in range(blocks + 1)]
    spans = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    return [list(c) for c in combinations(spans, blocks - bits)]


def block_keys(fps: DataFrame, choices) -> DataFrame:
    """A row ``(key, fp, rep)`` for each fingerprint and choice; the choice's number is part of the key."""

    def value(spans):
        out = F.lit(0).cast("long")
        for offset, width in spans:
            piece = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))
            out = F.shiftleft(out, width).bitwiseOR(piece)
        return out

    keys = F.array(*[F.struct(F.lit(i).alias("c"), value(spans).alias("v")) for i, spans in enumerate(choices)])
    return fps.select(F.explode(keys).alias("key"), "fp", "rep").select("key.c", "key.v", "fp", "rep")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def group_forest(fp: np.ndarray, rep: np.ndarray, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Spanning forest of the links within one group: a search that removes what it reaches from what is left."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _popcount(fp[left] ^ fp[at]) <= bits
            found = left[near]
            if len(found):
                edges.append(np.stack([np.full(len(found), rep[at]), rep[found]], axis=1))
                left = left[~near]
                queue.extend(found.tolist())
    return edges


def masks(spans: list[tuple[int, int]], bits: int = MAX_BITS) -> list[int]:
    """The longer keys that refine a key: its own blocks with every choice of half of ``2 * bits`` blocks of the other bits.

    A linked pair under the key differs in ``bits`` of the other bits at most and so agrees in one of these choices. With
    `MAX_BITS` a longer key fixes 36 bits or more.
    """
    own = sum(((1 << width) - 1) << offset for offset, width in spans)
    rest = np.array_split([i for i in range(64) if not own >> i & 1], 2 * bits)
    return [own | sum(1 << int(i) for block in choice for i in block) for choice in combinations(rest, bits)]


def refine(crowded: DataFrame, choices, bits: int = MAX_BITS) -> DataFrame:
    """Rows of crowded keys under the longer keys of `masks`; the number of the mask is part of the key."""
    longer = [np.array(masks(spans, bits), np.uint64).view(np.int64) for spans in choices]

    def run(batches):
        for batch in batches:
            for c, rows in batch.groupby("c"):
                for i, mask in enumerate(longer[c]):
                    yield rows.assign(c=np.int32(c * len(longer[c]) + i), v=rows["fp"] & mask)

    return crowded.select("c", "v", "fp", "rep").mapInPandas(run, "c int, v long, fp long, rep long")


def links(keyed: DataFrame, bits: int = MAX_BITS, most: int | None = None) -> DataFrame:
    """``(src, dst, c, v)``: for each key a spanning forest of the verified links among its fingerprints.

    A key with more than ``most`` fingerprints gives one row with that key and null ends instead.
    """

    def of(rows: pd.DataFrame):
        fp, rep = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
        new = np.r_[True, (rows["c"].to_numpy()[1:] != rows["c"].to_numpy()[:-1]) | (rows["v"].to_numpy()[1:] != rows["v"].to_numpy()[:-1])]
        group, sizes = np.cumsum(new) - 1, np.diff(np.r_[np.flatnonzero(new), len(rows)])
        out, starts = [], np.flatnonzero(new)
        small = np.flatnonzero(sizes[group] <= SHIFTED)
        f, r, g = fp[small], rep[small], group[small]
        for step in range(1, SHIFTED):
            if len(f) <= step:
                break
            hit = (g[step:] == g[:-step]) & (_popcount(f[step:] ^ f[:-step]) <= bits)
            if hit.any():
                out.append(np.stack([r[:-step][hit], r[step:][hit]], axis=1))
        for k in np.flatnonzero(sizes > SHIFTED):
            part = slice(starts[k], starts[k] + sizes[k])
            out += group_forest(fp[part], rep[part], bits)
        found = np.concatenate(out) if out else np.empty((0, 2), np.int64)
        return table(pa.array(found.min(axis=1)), pa.array(found.max(axis=1)))

    def table(src, dst, c=None, v=None):
        none = [None] * len(src)
        return pa.RecordBatch.from_arrays([src, dst, pa.array(none if c is None else [c], pa.int32()), pa.array(none if v is None else [v], pa.int64())], ["src", "dst", "c", "v"])

    def run(batches):
        held, full = None, None  # rows of the last key so far, which the next batch may go on with; a crowded key whose rows pass by
        for rows in (b.to_pandas() for b in batches):
            if full is not None:
                rows = rows[(rows["c"] != full[0]) | (rows["v"] != full[1])]
            if held is not None:
                rows = pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            key = int(rows["c"].iloc[-1]), int(rows["v"].iloc[-1])
            last = (rows["c"] == key[0]) & (rows["v"] == key[1])
            held, whole = rows[last], rows[~last]
            if len(whole):
                yield of(whole.reset_index(drop=True))
            if most is not None and len(held) > most:
                held, full = None, key
                yield table(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *key)
        if held is not None and len(held):
            yield of(held.reset_index(drop=True))

    return keyed.repartition("c", "v").sortWithinPartitions("c", "v", "fp").mapInArrow(run, "src long, dst long, c int, v long")


def all_links(nodes: DataFrame) -> DataFrame:
    """``(src, dst)``: spanning forests of all links between the nodes ``(fp, rep)``, which are read more than once."""
    choices = plan_blocks(nodes.count())
    keyed = block_keys(nodes, choices)
    found = materialize(links(keyed, most=CROWDED).distinct())
    edges, crowded = found.where("c IS NULL").select("src", "dst"), found.where("c IS NOT NULL").select("c", "v")
    if not crowded.isEmpty():
        edges = edges.unionByName(links(refine(keyed.join(crowded, ["c", "v"], "left_semi"), choices)).select("src", "dst"))
    return edges


def components(fps: DataFrame) -> DataFrame:
    """``(id, fp, component_id)`` for a table of ``(id, fp)``; ``fps`` is read more than once."""
    nodes = materialize(fps.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")))
    return named_components(fps, nodes, all_links(nodes))


def named_components(fps: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, fp, component_id)`` from the rows ``(id, fp)``, the nodes ``(fp, rep)`` and links between reps."""
    # Rows that share an id are one document: link the nodes that it lies on.
    twice = (
        fps.where("id IS NOT NULL").distinct().groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    own = fps.join(twice.select("id"), "id").join(nodes, "fp").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    found = connected_components(edges.unionByName(own))
    named = nodes.join(found, nodes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("c"))
    return fps.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("c")).alias("component_id"))


def near_duplicates(df: DataFrame) -> DataFrame:
    """One row per document: its fingerprint in 16 hexadecimal digits and its component."""
    found = components(materialize(fingerprints(df)))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """The documents without those that have a smaller near-duplicate; of rows that share a doc_id that with the smallest text stays.

    Near are fingerprints that differ in `MAX_BITS` bits at most, or with ``similar`` the sets of five-word shingles that are
    at least 0.8 alike, as `near` finds them. Rows with a null doc_id stay.
    """
    from millrace.llm import near

    found = materialize(near.components(df, key, text)) if similar else components(materialize(fingerprints(df, key, text)))
    gone = found.where("id <> component_id").select(F.col("id").alias("__mr_gone")).distinct()
    kept = df.join(gone, F.col(key).cast("long") == F.col("__mr_gone"), "left_anti")
    if found.where("id IS NOT NULL").groupBy("id").count().where("count > 1").isEmpty():
        return kept
    # A repeated key keeps its row with the smallest text; all but one row a task are dropped before the shuffle.
    order = Window.partitionBy(key).orderBy(text, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    one = kept.where(F.col(key).isNotNull()).withColumn("__mr_n", F.row_number().over(order)).where("__mr_n = 1").drop("__mr_n")
    return one.unionByName(kept.where(F.col(key).isNull()))
