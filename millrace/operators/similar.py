"""Similar vectors at any size of a cluster: sequential removal by rounds, nearest neighbours, and groups without blocks from the caller.

Two tables are compared block by block: a task holds a block of bounded size of one side and sees the rows of the other a batch at a
time, and only what is asked leaves it (a flag or a few neighbours per row, a spanning forest), never all pairs.
Vectors that are null, empty, zero or hold a null or non-finite component are similar to nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.session import materialize

#: Rows of a block, and rows of which similarities are held at once.
BLOCK, SLICE = 2048, 512
#: Planes of a bucket's name at most: the number of bands then follows from threshold and recall alone, so what is shipped is in proportion to the rows.
BITS = 8
#: Rows of a block of a bucket of short vectors, components that a block holds or similarities held at once, and the short form of 1.
WIDE, HELD, SCALE = 1 << 14, 1 << 22, 32767


def usable(vector: Column) -> Column:
    """Whether a vector can be similar to anything."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit_rows(column) -> np.ndarray:
    """The vectors of an Arrow column at length 1. Those of other lengths than the longest are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.zeros((len(sizes), sizes.max(initial=0)))
    x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    x /= np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]


def streamed(left: DataFrame, right: DataFrame, begin, schema: str, block: int | None = None) -> DataFrame:
    """``begin(table)`` for every block of ``left`` ``(c, k, v)``; its ``see(table)`` gets all rows of ``right`` of the same cluster, a batch at a time, then ``result()`` is asked for.

    A task holds a block and a batch, whatever the size of the cluster; what leaves it is a result for each block.
    """
    size = block or BLOCK
    blocks = left.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n")).select(F.col("c").alias("__c"), "n")  # a row per cluster
    joined = lambda d: d.join(blocks, F.col("c") == F.col("__c"))
    own = joined(left).select("c", F.pmod(F.xxhash64("k"), F.col("n")).cast("int").alias("b"), F.lit(0).alias("side"), "k", "v")
    other = joined(right).select("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"), F.lit(1).alias("side"), "k", "v")
    rows = own.unionByName(other).repartition("c", "b").sortWithinPartitions("c", "b", "side")

    def runs(batches):
        """Batches cut where the block or the side changes."""
        for batch in batches:
            t = pa.Table.from_batches([batch])
            label = [t[n].to_numpy() for n in ("c", "b", "side")]
            cut = np.zeros(max(0, len(t) - 1), bool)
            for x in label:
                cut |= x[1:] != x[:-1]
            edges = [0, *(np.flatnonzero(cut) + 1).tolist(), len(t)]
            for a, z in zip(edges, edges[1:]):
                if z > a:
                    yield (label[0][a], int(label[1][a])), int(label[2][a]), t.slice(a, z - a).select(["c", "k", "v"])

    def run(batches):
        at, held, work = None, [], None
        for name, side, t in runs(batches):
            if name != at:
                if work is not None:
                    yield from work.result().to_batches()
                at, held, work = name, [], None
            if side == 0:
                held.append(t)
            else:
                if work is None and held:
                    work = begin(pa.concat_tables(held).combine_chunks())
                if work is not None:
                    work.see(t)
        if work is not None:
            yield from work.result().to_batches()

    return rows.mapInArrow(run, schema)


class _Side:
    """A block of rows that others are compared with."""

    def __init__(self, rows: pa.Table):
        self.rows, self.x, self.keys = rows, unit_rows(rows["v"]), rows["k"].to_numpy()

    def compared(self, t: pa.Table):
        """``(from row, similarities to t, keys of t, own keys)``, some rows at a time; keys are numbers that compare as keys do."""
        y, keys = unit_rows(t["v"]), t["k"].to_numpy()
        width = max(self.x.shape[1], y.shape[1])
        x, y = (np.pad(z, ((0, 0), (0, width - z.shape[1]))) for z in (self.x, y))
        every = np.unique(np.concatenate([self.keys, keys]))
        own, other = np.searchsorted(every, self.keys), np.searchsorted(every, keys)
        for at in range(0, len(x), SLICE):
            yield at, x[at : at + SLICE] @ y.T, other, own[at : at + SLICE]


class _Near(_Side):
    """Which rows are similar to some row seen."""

    def __init__(self, rows: pa.Table, threshold: float, inclusive: bool, earlier: bool):
        super().__init__(rows)
        self.threshold, self.inclusive, self.earlier, self.hit = threshold, inclusive, earlier, np.zeros(len(rows), bool)

    def see(self, t: pa.Table) -> None:
        for at, s, other, own in self.compared(t):
            near = s >= self.threshold if self.inclusive else s > self.threshold
            self.hit[at : at + len(s)] |= (near & (other < own[:, None]) if self.earlier else near).any(axis=1)

    def result(self) -> pa.Table:
        return self.rows.select(["c", "k"]).filter(pa.array(self.hit))


class _Top(_Side):
    """The ``k`` most similar other rows seen."""

    def __init__(self, rows: pa.Table, k: int, names: list[str]):
        super().__init__(rows)
        self.k, self.names = k, names
        self.row, self.score, self.found = np.zeros(0, np.int64), np.zeros(0), self.keys[:0]

    def see(self, t: pa.Table) -> None:
        keys, rows, scores, found = t["k"].to_numpy(), [self.row], [self.score], [self.found]
        for at, s, other, own in self.compared(t):
            s[own[:, None] == other] = -np.inf
            most = min(self.k, s.shape[1])
            least = -np.partition(-s, most - 1, axis=1)[:, most - 1]
            i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            rows.append(at + i)
            scores.append(s[i, j])
            found.append(keys[j])
        row, score, key = np.concatenate(rows), np.concatenate(scores), np.concatenate(found)
        order = np.lexsort((np.unique(key, return_inverse=True)[1], -score, row))
        row = row[order]
        first = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.row, self.score, self.found = np.concatenate(rows)[first], score[first], key[first]

    def result(self) -> pa.Table:
        kind = self.rows.schema.field("k").type
        rank = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1
        columns = [self.rows["k"].take(pa.array(self.row)), pa.array(self.found, kind), pa.array(self.score), pa.array(rank.astype(np.int32))]
        return pa.table(columns, names=self.names)


def near_earlier(left: DataFrame, right: DataFrame, threshold: float, inclusive: bool, earlier: bool, kinds: tuple[str, str], block: int | None = None) -> DataFrame:
    """``(c, k)`` of the rows of ``left`` that are similar to some row of ``right``, to one with a smaller key if ``earlier``."""
    return streamed(left, right, lambda rows: _Near(rows, threshold, inclusive, earlier), f"c {kinds[0]}, k {kinds[1]}", block)


def removed(df: DataFrame, cluster: str, key: str, vector: str, threshold: float, inclusive: bool = False, accepted: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """O-47, O-49: ``(key, cluster, duplicate)``. In key order a row is a duplicate if it is similar to a row of its cluster that was kept before it or is one of ``accepted``.

    The sequential answer by rounds: a row without an earlier similar row that is still open is kept, and open rows similar to
    one kept before them are duplicates. Every round decides the first open row of each cluster at least, and all members of a
    group of near copies but the first two rounds after it; what is open shrinks fast unless the table is a chain of rows each similar to the next
    in key order. Of equal vectors only the first can be kept, so the others are no part of the rounds. No size of a cluster ends the work.
    """
    kinds = dict(df.dtypes)[cluster], dict(df.dtypes)[key]
    rows = df.select(F.col(cluster).alias("c"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), usable(F.col(vector)).alias("ok"))
    given = rows.where("ok AND k IS NOT NULL AND c IS NOT NULL")
    first = materialize(given.groupBy("c", "v").agg(F.min("k").alias("k")))
    open_, kept = first.select("c", "k", "v"), []
    if accepted is not None:
        known = accepted.select(F.col(cluster).alias("c"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("c").isNotNull() & F.col("k").isNotNull())
        gone = near_earlier(open_, known, threshold, inclusive, False, kinds, block)
        open_ = materialize(open_.join(gone, ["c", "k"], "left_anti"))
    while not open_.isEmpty():
        waits = materialize(near_earlier(open_, open_, threshold, inclusive, True, kinds, block))
        now = materialize(open_.join(waits, ["c", "k"], "left_anti"))
        kept.append(now.select("c", "k"))
        if waits.isEmpty():
            break
        waiting = materialize(open_.join(waits, ["c", "k"], "left_semi"))
        gone = near_earlier(waiting, now, threshold, inclusive, True, kinds, block)
        open_ = materialize(waiting.join(gone, ["c", "k"], "left_anti"))
    whole = rows.where("NOT (ok AND k IS NOT NULL AND c IS NOT NULL)").select(F.col("k").alias(key), F.col("c").alias(cluster), F.lit(False).alias("duplicate"))
    stays = given.limit(0).select("c", "k")
    for part in kept:
        stays = stays.unionByName(part)
    marked = given.select("c", "k").join(stays.withColumn("__kept", F.lit(True)), ["c", "k"], "left")
    return marked.select(F.col("k").alias(key), F.col("c").alias(cluster), F.col("__kept").isNull().alias("duplicate")).unionByName(whole)


def neighbours(df: DataFrame, key: str, vector: str, block: str, k: int = 10, size: int | None = None) -> DataFrame:
    """T-3: ``(key, neighbour, similarity, rank)``: the ``k`` most similar other rows of each row's block; ties by key."""
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(block).alias("c"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("k").isNotNull() & F.col("c").isNotNull())

    names = [key, "neighbour", "similarity", "rank"]
    return streamed(rows, rows, lambda t: _Top(t, k, names), f"{key} {kind}, neighbour {kind}, similarity double, rank int", size)


# ---- groups without blocks


def bands_of(bits: int, threshold: float, recall: float) -> int:
    """Bands enough that a pair at ``threshold`` shares a bucket of ``bits`` planes with probability ``recall``."""
    same = (1 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-same))) if same < 1 else 1


def bands_for(n: int, threshold: float, recall: float, per_bucket: int = 64) -> tuple[int, int]:
    """``(bits, bands)``: buckets of about ``per_bucket`` unrelated rows, and bands enough that a pair at ``threshold`` shares one with probability ``recall``."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / per_bucket)) if n > per_bucket else 4)
    return bits, bands_of(bits, threshold, recall)


def forest(near: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of a symmetric relation: a search that visits each row once and tries it against all that are left."""
    left, out = np.arange(len(near)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = near[at, left]
            found = left[hit]
            out += [(at, x) for x in found.tolist()]
            left = left[~hit]
            queue.extend(found.tolist())
    return np.array(out, np.int64).reshape(-1, 2)


def join_trees(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``label`` (the smallest row of each row's tree) after the links ``i``, ``j``, and those of them that join trees: each tree is hung on a smaller one at a time."""
    used = []
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label, used
        i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        used.append(np.stack([i[first], j[first]], axis=1))
        up = np.arange(len(label))
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        label = up[label]


def slack_of(dim: int) -> float:
    """What a cosine of vectors in multiples of 1 / `SCALE`, multiplied in single precision, can be off at most."""
    e = math.sqrt(dim) / (2 * SCALE)
    return 2 * e + e * e + (dim + 4) * 2.0**-22


def short_links(x: np.ndarray, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """``(sure, unsure, all)`` of short unit vectors: a spanning forest of the links beyond doubt, and the pairs across its trees that only the whole
    vectors decide. ``all`` is False where those are more than ``most`` and are not all named."""
    n, slack = len(x), slack_of(x.shape[1])
    label, sure, unsure, whole = np.arange(n), [], [], True
    step, at = max(1, min(SLICE, HELD // max(n, 1))), 0
    while at < n:
        s = x[at : at + step] @ x[at:].T
        i, j = np.nonzero(s > threshold - slack)
        later = j > i
        i, j = i[later], j[later]
        beyond = s[i, j] > threshold + slack
        i, j = i + at, j + at
        label, used = join_trees(label, i[beyond], j[beyond])
        sure += used
        i, j = i[~beyond], j[~beyond]
        apart = label[i] != label[j]
        if whole and apart.any():
            unsure.append(np.stack([i[apart], j[apart]], axis=1))
            if sum(map(len, unsure)) > most:
                whole, unsure = False, []
        at += step
    pairs = np.concatenate(unsure) if unsure else np.zeros((0, 2), np.int64)
    return np.concatenate(sure) if sure else np.zeros((0, 2), np.int64), pairs[label[pairs[:, 0]] != label[pairs[:, 1]]], whole


def links(nodes: DataFrame, threshold: float, bits: int, bands: int, seed: int = 17, block: int | None = None, unsure: int = 4) -> DataFrame:
    """``(src, dst)``: spanning forests, within each bucket, of the pairs of ``nodes`` ``(k, v)`` above the threshold. ``nodes`` is read more than once.

    A bucket's name is the sides of ``bits`` random planes on which a vector lies. Buckets get unit vectors rounded to 16 bits a component, whose
    cosines are known within `slack_of`; pairs nearer to the threshold than that are verified on the whole vectors. A bucket with more than
    ``unsure`` such pairs a row is compared on whole vectors. Buckets above two blocks, counted, are cut into blocks that meet in pairs, so a
    bucket has no size at which it is lost or gathered.
    """
    kind = dict(nodes.dtypes)["k"]
    names = ["band", "bucket", "i", "j"]

    def keyed(what: str):
        """A row for each vector and band, with no vector (``none``), the ``short`` or the ``whole`` one."""

        def run(batches):
            planes: dict[int, np.ndarray] = {}
            for batch in batches:
                sizes = np.diff(batch.column("v").offsets.to_numpy())
                for dim in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == dim)) if (sizes != dim).any() else batch
                    x = unit_rows(part.column("v"))
                    if dim not in planes:
                        planes = planes if len(planes) < 16 else {}
                        planes[dim] = np.random.default_rng(seed).standard_normal((bands * bits, dim)).T
                    bucket = (x @ planes[dim] > 0).reshape(len(x), bands, bits) @ (1 << np.arange(bits, dtype=np.int64))
                    if what == "short":
                        data = np.rint(x * SCALE).astype("<i2")
                        offsets = np.arange(len(x) + 1, dtype=np.int32) * (2 * dim)
                        own = [part.column("k"), pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)])]
                    else:
                        own = [part.column("k"), part.column("v")] if what == "whole" else [pa.array(np.full(len(x), dim, np.int64))]
                    for band in range(bands):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), band, np.int32)), pa.array(bucket[:, band]), *own], ["band", "bucket", "k", "v"][: 2 + len(own)] if what != "none" else ["band", "bucket", "dim"])

        more = {"none": "dim long", "short": f"k {kind}, v binary", "whole": f"k {kind}, v array<double>"}[what]
        return nodes.select("k", "v").mapInArrow(run, f"band int, bucket long, {more}")

    counts = materialize(keyed("none").groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("dim").alias("parts")))  # 2 ** bits rows a band at most

    def dealt(found: DataFrame, size: int, parts: int) -> DataFrame:
        """Rows of each bucket together, those of large buckets once for each pair of blocks that they are in."""
        blocks = F.ceil(F.greatest(F.col("rows") / size, F.col("parts") / parts)).cast("int")
        hot = counts.where((F.col("rows") > 2 * size) | (F.col("parts") > 2 * parts)).select(F.col("band").alias("__b"), F.col("bucket").alias("__u"), blocks.alias("n"))
        marked = found.join(F.broadcast(hot), (F.col("band") == F.col("__b")) & (F.col("bucket") == F.col("__u")), "left").withColumn("n", F.coalesce("n", F.lit(1)))
        own = marked.withColumn("o", F.pmod(F.xxhash64("k"), F.col("n")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        pairs = own.select("band", "bucket", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), "k", "v")
        return pairs.repartition(*names).sortWithinPartitions(*names)

    def result(t: pa.Table, edges: list, sure: list, opened: list):
        """Edges by row, and buckets (by a row of theirs) that are left open."""
        e = np.concatenate(edges) if edges else np.zeros((0, 2), np.int64)
        ends = pa.array(np.r_[e[:, 0], np.zeros(len(opened), np.int64)], mask=np.arange(len(e) + len(opened)) >= len(e)), pa.array(np.r_[e[:, 1], np.zeros(len(opened), np.int64)], mask=np.arange(len(e) + len(opened)) >= len(e))
        at = pa.array(np.r_[np.zeros(len(e), np.int64), np.array(opened, np.int64)], mask=np.arange(len(e) + len(opened)) < len(e))
        flag = np.r_[np.concatenate(sure) if sure else np.zeros(0, bool), np.zeros(len(opened), bool)].astype(bool)
        columns = [t["k"].take(ends[0]).combine_chunks(), t["k"].take(ends[1]).combine_chunks(), pa.array(flag), t["band"].take(at).combine_chunks(), t["bucket"].take(at).combine_chunks()]
        return pa.RecordBatch.from_arrays(columns, ["src", "dst", "sure", "band", "bucket"])

    def edges_of(t: pa.Table, short: bool) -> pa.RecordBatch:
        label = np.stack([t[n].to_numpy() for n in names], axis=1)
        cuts = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]).any(axis=1), True])
        column = t["v"].combine_chunks()
        edges, sure, opened = [], [], []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if end - start > 1:
                part = column.slice(start, end - start)
                sizes = np.diff(part.offsets.to_numpy()) if not short else np.diff(np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1])
                for dim in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == dim)
                    own = part.take(pa.array(at))
                    if short:
                        x = np.frombuffer(own.buffers()[2], "<i2", count=len(at) * dim // 2).reshape(len(at), -1).astype(np.float32) / np.float32(SCALE)
                        beyond, maybe, whole = short_links(x, threshold, unsure * len(at))
                        edges += [start + at[beyond], start + at[maybe]]
                        sure += [np.ones(len(beyond), bool), np.zeros(len(maybe), bool)]
                        if not whole:
                            opened.append(start)
                    else:
                        x = unit_rows(own)
                        edges.append(start + at[forest(x @ x.T > threshold)])
                        sure.append(np.ones(len(edges[-1]), bool))
        return result(t, edges, sure, opened)

    def compared(rows: DataFrame, short: bool) -> DataFrame:
        def run(batches):
            held = None  # rows of the last bucket so far, which the next batch may go on with
            for batch in batches:
                t = pa.Table.from_batches([batch])
                t = t if held is None else pa.concat_tables([held, t])
                if not len(t):
                    continue
                last = np.ones(len(t), bool)
                for n in names:
                    last &= t[n].to_numpy() == t[n][-1].as_py()
                first = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
                held = t.slice(first)
                if first:
                    yield edges_of(t.slice(0, first).combine_chunks(), short)
            if held is not None and len(held):
                yield edges_of(held.combine_chunks(), short)

        return rows.mapInArrow(run, f"src {kind}, dst {kind}, sure boolean, band int, bucket long")

    def verify(batches):
        for batch in batches:
            x, y = unit_rows(batch.column("x")), unit_rows(batch.column("y"))
            yield batch.select(["src", "dst"]).filter(pa.array((x * y).sum(axis=1) > threshold))

    found = materialize(compared(dealt(keyed("short"), block or WIDE, HELD), True).distinct())
    out = found.where("sure").select("src", "dst")
    doubtful = found.where("src IS NOT NULL AND NOT sure").select("src", "dst").distinct()
    if not doubtful.isEmpty():
        ends = [nodes.select(F.col("k").alias(end), F.col("v").alias(v)) for end, v in (("src", "x"), ("dst", "y"))]
        out = out.unionByName(doubtful.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "x", "y").mapInArrow(verify, f"src {kind}, dst {kind}"))
    opened = found.where("src IS NULL").select("band", "bucket").distinct()
    if not opened.isEmpty():
        rows = dealt(keyed("whole").join(opened, ["band", "bucket"], "left_semi"), block or BLOCK, HELD)
        out = out.unionByName(compared(rows, False).select("src", "dst"))
    return out.distinct()


def similar_groups(df: DataFrame, key: str, vector: str, threshold: float = 0.85, recall: float = 0.95, block: int | None = None) -> DataFrame:
    """O-50 without blocks: ``(node, component)`` for groups of two or more rows that are linked by cosines above the threshold.

    A pair at the threshold is found with probability ``recall``, closer pairs with more; what is found is verified, so nothing is linked
    in vain. Equal vectors are one node. Vectors of different lengths are not linked.
    """
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")) & F.col("k").isNotNull())
    nodes = materialize(rows.groupBy("v").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n")))
    bits = min(BITS, bands_for(nodes.count(), threshold, recall)[0])
    bands = bands_of(bits, threshold, recall)
    found = connected_components(links(nodes.select("k", "v"), threshold, bits, bands, block=block))
    named = nodes.join(found, F.col("k") == F.col("node"), "left").where("node IS NOT NULL OR n > 1").select("v", F.coalesce("component", "k").alias("component"))
    return rows.join(named, "v").select(F.col("k").alias("node"), "component")
