"""The similarity form of the SimHash operator: links by the Jaccard similarity of word shingles.

Texts are compared by their sets of `SHINGLE`-word shingles, hashed to 64 bits. Equal sets are one node. Candidates are the
pairs that `simhash` links: fingerprints of the sets that share a pigeonhole block and differ in `simhash.MAX_BITS` bits
at most, all of them. At a similarity of 0.8 fingerprints of 64 bits differ in about ten, which no affordable choice of
blocks covers, so two nodes are candidates too where one of `BANDS` bands of `ROWS` MinHash values agrees; a pair at 0.8 does
with probability 0.98.

A band with up to `SMALL` nodes gives all its pairs. A larger one gives first the spanning tree of the highest agreement of
signatures, which is verified. Where its nodes then still lie in several components, their sets are brought to the band and every pair across
components whose signatures agree in `LIKELY` of their values is verified there; at 0.8 they do with probability
0.9997. Bands with more than two blocks of nodes are cut into blocks that meet in pairs, so none is gathered in a task. Every
link is verified on the whole sets.

Defined results: as those of `simhash.keep_one`; texts without words are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.common import join_facts, text_bytes, values
from millrace.operators.components import connected_components
from millrace.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 5
#: Nodes of a band whose pairs are all verified, and nodes of a block of a band that is cut.
SMALL, BLOCK = 48, 1024
#: Share of equal signature values from which a pair of a larger band can be 0.8 alike.
LIKELY = 0.6
#: Bytes of sets that a task of a cut band holds about: longer sets make smaller blocks.
HELD = 1 << 26
#: Bits of the map that says which documents may be asked for (2 MB, whatever the table).
MAP_BITS = 1 << 24
_RNG = np.random.default_rng(42)
FACTORS = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a whole text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(p, 42) for p in parts]), np.uint64))


def signature(found: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(found), 4096):
        out = np.minimum(out, ((found[at : at + 4096, None] * FACTORS + SHIFTS) >> np.uint64(32)).min(axis=0).astype(np.uint32))
    return out


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set, as a signed 64-bit number: a bit is 1 if set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        counts += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found)).view(np.int64)[0])


def name_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - 2**63


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp, sim, sig)`` per row; ``fp`` names the set and ``sim`` is its fingerprint."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t) for _, t in text_bytes(batch)]
            names, sims, sigs = [name_of(s) for s in sets], [fingerprint(s) for s in sets], [signature(s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(values(batch, "id"), pa.int64()), pa.array(names, pa.int64()), pa.array(sims, pa.int64()), pa.array(sigs, pa.binary())], ["id", "fp", "sim", "sig"])

    return _source(df, key, text).mapInArrow(run, "id long, fp long, sim long, sig binary")


def maybe_asked(rows: DataFrame, asked: DataFrame, bits: int | None = None) -> DataFrame:
    """The rows whose ``id`` is ``asked`` and few others, without a shuffle of ``rows``: ids are looked up in a broadcast bit map of fixed size.

    None that is asked for is lost; of the others about as many pass as the share of bits that are set, all if the map is full.
    """
    words = (bits or MAP_BITS) // 64
    at = F.pmod(F.xxhash64("id"), F.lit(64 * words))
    marks = asked.select(at.alias("at")).groupBy(F.expr("at div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("w"))
    dense = rows.sparkSession.range(words).select(F.col("id").alias("i")).join(marks, "i", "left").select("i", F.coalesce("w", F.lit(0)).alias("w"))
    whole = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("__map"))
    marked = rows.withColumn("__at", at)
    return marked.join(F.broadcast(whole), F.expr("shiftright(__map[CAST(__at div 64 AS INT)], CAST(__at % 64 AS INT)) & 1 = 1"), "left_semi").drop("__at")


def sets(df: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(fp, found)``: the sets as bytes of the documents whose ids are ``asked`` (read twice); other texts are neither shipped, but for a few, nor hashed."""

    def run(batches):
        for batch in batches:
            found = [shingles(t) for _, t in text_bytes(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], ["fp", "found"])

    some = maybe_asked(_source(df, key, text), asked).join(asked, "id", "left_semi").select("text")
    return some.mapInArrow(run, "fp long, found binary").groupBy("fp").agg(F.min("found").alias("found"))


def agreement(sig: np.ndarray, at: int, others: np.ndarray) -> np.ndarray:
    return (sig[others] == sig[at]).mean(axis=1)


def tree(sig: np.ndarray) -> list[tuple[int, int]]:
    """Spanning trees of the highest agreement among the rows of signatures; pairs below `LIKELY` are not linked."""
    left, out = np.arange(1, len(sig)), []
    best, by = agreement(sig, 0, left), np.zeros(len(left), np.int64)
    while len(left):
        i = int(best.argmax())
        at = int(left[i])
        if best[i] >= LIKELY:
            out.append((int(by[i]), at))
        left, best, by = np.delete(left, i), np.delete(best, i), np.delete(by, i)
        now = agreement(sig, at, left)
        nearer = now > best
        best, by = np.where(nearer, now, best), np.where(nearer, at, by)
    return out


def bucket_pairs(fp: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
    """Candidates within one band: all pairs of a small one, else the trees of the likely ones."""
    if len(fp) <= SMALL:
        i, j = np.triu_indices(len(fp), 1)
        return list(zip(fp[i].tolist(), fp[j].tolist()))
    return [(int(fp[i]), int(fp[j])) for i, j in tree(sig)]


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets are at least `SIMILARITY` alike."""
    small, large = sorted((len(x), len(y)))
    if small < SIMILARITY * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def across(fp: np.ndarray, sig: np.ndarray, component: np.ndarray, found: list) -> list[tuple[int, int]]:
    """Links that join components: every likely pair of nodes that are not joined yet is verified, the likeliest first."""
    out, component = [], component.copy()
    own = [np.frombuffer(x, np.uint64) for x in found]
    for i in range(len(fp)):
        rest = np.flatnonzero(component[i + 1 :] != component[i]) + i + 1
        score = agreement(sig, i, rest)
        for j in rest[np.argsort(-score, kind="stable")][: int((score >= LIKELY).sum())].tolist():
            if component[i] != component[j] and alike(own[i], own[j]):
                out.append((int(fp[i]), int(fp[j])))
                component[component == component[j]] = component[i]
    return out


def close(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: names of sets with equal fingerprints, and a spanning forest of the fingerprints that are linked."""
    sims = materialize(nodes.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("rep")))
    same = nodes.select("fp", "sim").join(sims.select(F.col("fp").alias("sim"), "rep"), "sim").where("fp <> rep").select(F.least("fp", "rep").alias("a"), F.greatest("fp", "rep").alias("b"))
    return same.unionByName(simhash.all_links(sims).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")))


def keyed(nodes: DataFrame) -> DataFrame:
    """``(key, fp)``: a row for each node and band."""

    def run(batches):
        for batch in batches:
            fp, sig = np.asarray(values(batch, "fp"), np.int64), values(batch, "sig")
            for band in range(BANDS):
                part = slice(4 * ROWS * band, 4 * ROWS * (band + 1))
                key = [xxhash.xxh64_intdigest(s[part], band) - 2**63 for s in sig]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp)], ["key", "fp"])

    return nodes.select("fp", "sig").mapInArrow(run, "key long, fp long")


def by_band(rows: DataFrame, sizes: DataFrame | None, of) -> DataFrame:
    """``(a, b)``: what ``of`` finds among the rows of each key; keys of ``sizes`` ``(key, blocks, n)`` (materialized) with ``n`` rows are cut into blocks that meet in pairs."""
    columns = [c for c in rows.columns if c != "key"]
    marked = (rows.withColumn("blocks", F.lit(None).cast("int")) if sizes is None else join_facts(rows, sizes, ["key"], "blocks", ["fp"])).withColumn("n", F.coalesce("blocks", F.lit(1)))
    own = marked.withColumn("o", F.pmod("fp", F.col("n")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    dealt = own.select("key", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), *columns)

    def pairs(t: pa.Table) -> pa.RecordBatch:
        label = np.stack([t[n].to_numpy() for n in ("key", "i", "j")], axis=1)
        edge, out = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]).any(axis=1), True]), []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a > 1:
                out += of(t.slice(a, b - a))
        ends = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    def run(batches):
        held = None  # rows of the last key so far, which the next batch may go on with
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not len(t):
                continue
            last = np.ones(len(t), bool)
            for n in ("key", "i", "j"):
                last &= t[n].to_numpy() == t[n][-1].as_py()
            first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            held = t.slice(first)
            if first:
                yield pairs(t.slice(0, first))
        if held is not None and len(held):
            yield pairs(held)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp").mapInArrow(run, "a long, b long")


def signature_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    sig = t["sig"].to_pylist()
    return t["fp"].to_numpy(), np.frombuffer(b"".join(sig), np.uint32).reshape(len(sig), -1)


def banded(rows: DataFrame, counts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(a, b)``: candidates of the rows of `keyed`, whose keys with over `SMALL` nodes are ``counts``. Signatures are brought to those keys only."""
    small = rows.join(counts.select("key"), "key", "left_anti")
    large = rows.join(counts.select("key"), "key", "left_semi").join(nodes.select("fp", "sig"), "fp").select("key", "fp", "sig")
    cut = materialize(counts.where(F.col("count") > 2 * BLOCK).select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), F.col("count").alias("n")))
    every = by_band(small, None, lambda t: bucket_pairs(t["fp"].to_numpy(), None))
    return every.unionByName(by_band(large, cut, lambda t: bucket_pairs(*signature_rows(t))))


def left_open(rows: DataFrame, counts: DataFrame, nodes: DataFrame, component: DataFrame, found: DataFrame) -> DataFrame:
    """``(a, b)``: the links that large bands lack whose nodes lie in several components ``(fp, c)``. Only their signatures and sets are shipped."""
    large = rows.select("key", "fp").join(counts.select("key"), "key", "left_semi").join(component, "fp", "left")
    large = materialize(large.select("key", "fp", F.coalesce("c", "fp").alias("c")))
    several = large.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key")
    open_ = materialize(large.join(several, "key", "left_semi"))
    whole = materialize(open_.join(nodes.select("fp", "sig"), "fp").join(found, "fp").select("key", "fp", "sig", "c", "found"))
    size = whole.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("found").cast("double")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("count") / BLOCK), F.ceil(2 * F.col("bytes") / HELD)).cast("int")
    cut = materialize(size.where((F.col("count") > 2 * BLOCK) | (F.col("bytes") > HELD)).select("key", blocks.alias("blocks"), F.col("count").alias("n")))
    return by_band(whole, cut, lambda t: across(*signature_rows(t), t["c"].to_numpy(), t["found"].to_pylist()))


def verified(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose whole sets are at least `SIMILARITY` alike."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(values(batch, "x"), values(batch, "y")):
                good.append(alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(found.select(F.col("fp").alias("a"), F.col("found").alias("x")), "a").join(found.select(F.col("fp").alias("b"), F.col("found").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` per row."""
    rows = materialize(signatures(df, key, text))
    nodes = materialize(rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.min("sim").alias("sim"), F.min("sig").alias("sig")))
    bands = keyed(nodes)
    counts = materialize(bands.groupBy("key").count().where(F.col("count") > SMALL))
    pairs = materialize(close(nodes).unionByName(banded(bands, counts, nodes)).distinct())
    reps = nodes.select("fp", "rep")
    # A node that no pair names agrees likely with none: its set is not asked for.
    asked = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    found = materialize(sets(df, materialize(reps.join(asked, "fp", "left_semi").select(F.col("rep").alias("id"))), key, text))
    links = materialize(verified(pairs, found))
    if not counts.isEmpty():
        component = connected_components(links, "a", "b").select(F.col("node").alias("fp"), F.col("component").alias("c"))
        links = links.unionByName(left_open(bands, counts, nodes, component, found))
    edges = (
        links.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("src")), "a")
        .join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("dst")), "b")
        .select("src", "dst")
    )
    return simhash.named_components(rows.select("id", "fp"), reps, edges)
