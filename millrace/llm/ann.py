"""Approximate nearest neighbours over learned partitions.

A bounded sample of vectors is linked to its nearest neighbours; the graph is cut into balanced parts with few edges
between them; a small softmax classifier learns which parts hold a vector's neighbours. Every vector is indexed in its
most probable part. A query goes to the several most probable parts and is compared there with every vector, exactly,
in double precision. How many parts a query visits is chosen on held-out sample vectors so that the neighbours found
reach `TARGET_RECALL`.

Equal vectors are one index entry with the smallest ids that can appear in a result, so a vector that a third of the
rows share costs one entry; no result is lost by that. Parts are dealt out in blocks of bounded size, queries likewise.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part; nor do
vectors of another length than most of the sample, with which a cosine is not defined; a null vec_id takes no part; rows
that repeat an id and a vector count once; ties go to the smaller vec_id, however many rows tie; components may be as large
or small as a double can be; with fewer than `K` candidates all are returned; an empty table gives an
empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
EVERY = 50
#: Bound of the fitting sample and of the held-out vectors that choose the number of parts to visit.
SAMPLE, HELD_OUT = 6000, 600
TARGET_RECALL = 0.97
PER_PART = 8192
LEAST_PARTS, MOST_PARTS = 16, 96
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
LINKS = 10
#: More than products of unit vectors can be off by rounding.
ROUNDING = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two of their own: no digit is lost, and no square overflows or vanishes."""
    x = np.asarray(x, np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the vector ``a`` with the rows of ``b``, in extended precision and then rounded to double, so that cosines
    that are equal come out equal."""
    a, b = scaled(a[None]).astype(np.longdouble)[0], scaled(b).astype(np.longdouble)
    return ((b * a).sum(axis=1) / (np.sqrt((b * b).sum(axis=1)) * np.sqrt((a * a).sum()))).astype(np.float64)


def nearest(queries: np.ndarray, base: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Row numbers of the ``k`` largest inner products, in blocks."""
    out = []
    for at in range(0, len(queries), 1024):
        s = queries[at : at + 1024] @ base.T
        if skip_self:
            s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        kk = min(k, s.shape[1])
        top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, 0), np.int64)


def balanced_cut(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 0.1, rounds: int = 12) -> np.ndarray:
    """Parts of a neighbour graph, none above ``(1 + slack)`` times its fair share: a capacity-bound assignment to random
    centres, then moves that lower the number of cut edges as long as room is left."""
    n, cap = len(x), int(np.ceil(len(x) / parts * (1 + slack)))
    part, room = np.full(n, -1), np.full(parts, cap)
    score = x @ x[rng.choice(n, parts, replace=False)].T
    for i in np.argsort(-score.max(axis=1), kind="stable"):
        for p in np.argsort(-score[i], kind="stable"):
            if room[p]:
                part[i], room[p] = p, room[p] - 1
                break
    src, dst = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (src, part[dst]), 1)
        np.add.at(votes, (dst, part[src]), 1)
        gain = votes.max(axis=1) - votes[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            best = votes[i].argmax()
            if room[best]:
                room[part[i]] += 1
                room[best] -= 1
                part[i], moved = best, moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """Softmax classifier over parts: ``weights`` is (dimension + 1) x parts."""

    weights: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[:-1] + self.weights[-1]

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :n]


def train(x: np.ndarray, goal: np.ndarray, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Softmax regression on target distributions by Adam on the whole sample."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros((x1.shape[1], goal.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = x1 @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = x1.T @ (z / z.sum(axis=1, keepdims=True) - goal) / len(x) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(sample: np.ndarray, parts: int, seed: int = 7, target: float = TARGET_RECALL, k: int = K) -> Router:
    """Partition the sample's neighbour graph, train the router and choose how many parts queries visit."""
    x, rng = unit(sample), np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    held = min(HELD_OUT, len(x) // 5)
    test, base = x[:held], x[held:]
    parts = max(1, min(parts, len(base) // 8))
    if parts < 2:
        return Router(np.zeros((x.shape[1] + 1, 1)), 1)
    near = nearest(base, base, LINKS, skip_self=True)
    part = balanced_cut(base, near, parts, rng)
    goal = np.zeros((len(base), parts))
    np.add.at(goal, (np.repeat(np.arange(len(base)), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
    goal[np.arange(len(base)), part] += 0.5
    router = Router(train(base, goal), parts)
    lies = router.parts(base, 1)[:, 0]
    order, true = router.parts(test, parts), nearest(test, base, k)
    rank = np.argsort(order, axis=1, kind="stable")  # place of each part in a query's order
    need = np.take_along_axis(rank, lies[true], 1)
    router.probes = next(p for p in range(1, parts + 1) if p == parts or (need < p).mean() >= target)
    return router


def valid(df: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & v.isNotNull() & fine).select(F.col(key).cast("long").alias("id"), v.alias("v"))


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the nearest found for every query (ids divisible by ``every``)."""
    spark = df.sparkSession
    rows = valid(df, key, vector)
    picked = rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    lengths = picked.map(len)
    dim = int(lengths.mode().iloc[0]) if len(picked) else 0
    rows = rows.where(F.size("v") == dim)
    n = rows.count()
    sample = np.unique(np.stack(picked[lengths == dim]), axis=0) if n else np.empty((0, 0))
    router = fit(sample, int(np.clip(np.ceil(n / PER_PART), LEAST_PARTS, MOST_PARTS))) if len(sample) else Router(np.zeros((1, 1)), 1)
    shared = spark.sparkContext.broadcast(router)  # (dimension + 1) x parts doubles, bounded by MOST_PARTS
    parts = router.weights.shape[1]

    # Equal vectors become one entry with the k + 1 smallest ids: no other of them can be in a result.
    few = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    entries = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = rows.where(F.col("id") % every == 0).distinct()
    queries = asked.groupBy("v").agg(F.min("id").alias("q"))

    def place(n: int):
        def run(batches):
            r = shared.value
            for batch in batches:
                x = _matrix(batch.column(batch.schema.get_field_index("v")), dim)
                found = r.parts(unit(x), n) if len(x) else np.empty((0, n), np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.astype(np.int32).tolist(), pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

        return run

    index = entries.mapInArrow(place(1), "v array<double>, ids array<long>, parts array<int>").select("v", "ids", F.col("parts")[0].alias("part"))
    sizes = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row per part
    routed = queries.mapInArrow(place(router.probes), "v array<double>, q long, parts array<int>").select("v", "q", F.explode("parts").alias("part"))
    visits = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    blocks = F.create_map(*[F.lit(int(x)) for p in range(parts) for x in (p, -(-sizes.get(p, 1) // BLOCK_ROWS))])
    asks = F.create_map(*[F.lit(int(x)) for p in range(parts) for x in (p, -(-visits.get(p, 1) // BLOCK_QUERIES))])
    nb, nq = F.element_at(blocks, F.col("part")), F.element_at(asks, F.col("part"))
    left = index.select("v", "ids", "part", F.pmod(F.xxhash64("v"), nb).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), nq - 1)).alias("c"))
    right = routed.select("v", "q", "part", F.explode(F.sequence(F.lit(0), nb - 1)).alias("b"), F.pmod(F.xxhash64("v", F.lit(1)), nq).cast("int").alias("c"))

    def compare(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        a, b = np.stack(queries["v"]), np.stack(entries["v"])
        s, out = unit(a) @ unit(b).T, []
        ids, qs = entries["ids"].to_numpy(), queries["q"].to_numpy()
        # Every entry that may be among the k + 1 first, however many tie with the last of them, is ranked by its own score.
        least = np.partition(s, -min(k + 1, s.shape[1]), axis=1)[:, -min(k + 1, s.shape[1])] - ROUNDING
        for i in range(len(qs)):
            at = np.flatnonzero(s[i] >= least[i])
            found = ((x, c) for j, c in zip(at, cosines(a[i], b[at])) for x in ids[j])
            out += [(qs[i], x, c) for x, c in nsmallest(k + 1, found, key=lambda y: (-y[1], y[0]))]
        return pd.DataFrame(out, columns=["q", "id", "score"])

    found = left.groupBy("part", "b", "c").cogroup(right.groupBy("part", "b", "c")).applyInPandas(compare, "q long, id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")
    mine = asked.join(queries.withColumnRenamed("v", "w"), F.col("v") == F.col("w")).select(F.col("id").alias("query_id"), "q").distinct()
    pairs = mine.join(best, "q").where(F.col("id") != F.col("query_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = pairs.withColumn("rank", F.row_number().over(final).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim) if len(column) else np.empty((0, dim))
