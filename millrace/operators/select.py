"""Selection and sampling (O-53..O-57, T-*). Randomness is a keyed hash, so results do not depend on partitioning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import scans
from millrace.operators.batch import numbered
from millrace.session import materialize

#: Rows of one cluster that the sequential selection takes into one task; beyond it the caller must block further.
MAX_GROUP = 200_000
#: Fits of k-means that run side by side.
FITS = 10


def _unit(v) -> np.ndarray:
    x = np.stack(v).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def hash_uniform(*key: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) by hash of key and seed."""
    return (F.xxhash64(*key, F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / float(1 << 52)


def md5_uniform(key: Column, seed: int = 0) -> Column:
    """The same by MD5, for results that another engine must reproduce."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)


def mmr(df: DataFrame, cluster: str, key: str, vector: str, score: str, source: str, most: int = 100, target: float = 0.75, weight: float = 0.7, bonus: float = 0.1) -> DataFrame:
    """O-53: maximal marginal relevance per cluster, ``(key, cluster, pick)``; a cluster within ``most`` rows stays whole.

    Similarities to the picked rows are kept as running maxima, so a cluster of n rows costs n products a pick.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k").reset_index(drop=True)
        if len(pdf) > MAX_GROUP:
            raise ValueError(f"cluster has {len(pdf)} rows; split clusters to at most {MAX_GROUP}")
        if len(pdf) <= most:
            return pd.DataFrame({key: pdf["k"], cluster: pdf["c"], "pick": np.arange(1, len(pdf) + 1)})
        x, rel = _unit(pdf["v"]), 1 - np.abs(pdf["s"].to_numpy(float) - target)
        near, source_of = np.zeros(len(pdf)), pd.factorize(pdf["src"])[0]
        seen, open_, order = np.zeros(source_of.max() + 1), np.ones(len(pdf), bool), []
        for n in range(most):
            value = weight * rel + (1 - weight) * (1 - near) + bonus * (1 - seen[source_of] / max(n, 1))
            at = int(np.where(open_, value, -np.inf).argmax())
            order.append(at)
            open_[at] = False
            seen[source_of[at]] += 1
            sims = x @ x[at]
            near = sims if n == 0 else np.maximum(near, sims)
        return pd.DataFrame({key: pdf["k"][order], cluster: pdf["c"][order], "pick": np.arange(1, most + 1)})

    t = dict(df.dtypes)
    cols = df.select(F.col(cluster).alias("c"), F.col(key).alias("k"), F.col(vector).alias("v"), F.col(score).alias("s"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"))
    return cols.groupBy("c").applyInPandas(run, f"{key} {t[key]}, {cluster} {t[cluster]}, pick int")


def quota(df: DataFrame, cluster: str, order: list, cap: int) -> DataFrame:
    """O-55: the first ``cap`` rows of each cluster in arrival order; limits apply before the shuffle."""
    return df.withColumn("arrival", F.row_number().over(Window.partitionBy(cluster).orderBy(*order))).where(F.col("arrival") <= cap)


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """T-5: ``n`` rows of each stratum by hash order, all if fewer."""
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key)
    return df.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def shuffled_head(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """T-4: the first ``n`` rows of a seeded shuffle."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def log_samples(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """T-8: the rows that a step logs: the first ``n`` of a shuffle that depends on keys and seed only, whatever their order was."""
    return shuffled_head(df, key, n, seed)


def split_by_hash(df: DataFrame, key: str, test_share: float = 0.1, seed: int = 0) -> DataFrame:
    """T-10 / O-13: a stable train/test mark."""
    return df.withColumn("split", F.when(md5_uniform(F.col(key), seed) < test_share, "test").otherwise("train"))


def weighted_draws(groups: DataFrame, group: str, weight: str, draws: int, seed: int = 0) -> DataFrame:
    """T-6: ``(draw, group)``: ``draws`` groups with probability by weight, with replacement: uniforms of a hash meet the cumulative shares in one scan."""
    whole = groups.where(F.col(weight) > 0).select(F.col(group).alias("__g"), F.col(weight).cast("double").alias("__w"))
    shares = materialize(scans.affine(whole.withColumn("__o", F.lit(0)), "__o", ["__g"], F.lit(1), F.col("__w")))
    named = materialize(numbered(shares, ["__g"], "__i"))
    total = named.agg(F.sum("__w")).first()[0] or 0.0
    edges = named.select(F.lit(0).alias("__o"), (F.col("before") / (total or 1.0)).alias("__at"), F.lit(0).alias("__kind"), F.col("__i").alias("__v"))
    asked = groups.sparkSession.range(draws).select(F.lit(0).alias("__o"), md5_uniform(F.col("id"), seed).alias("__at"), F.lit(1).alias("__kind"), F.col("id").alias("__v"))
    carry, value = F.col("__kind"), F.when(F.col("__kind") == 0, F.col("__v")).otherwise(0)
    met = scans.affine(edges.unionByName(asked), "__o", ["__at", "__kind", "__v"], carry, value).where("__kind = 1")
    return met.select(F.col("__v").alias("draw"), F.col("after").cast("long").alias("__i")).join(named.select("__i", F.col("__g").alias(group)), "__i").select("draw", group)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """T-6: ``n`` rows without replacement, with probability by weight: the smallest exponential keys ``-ln(u) / weight``."""
    u = F.greatest(md5_uniform(F.col(key), seed), F.lit(2.0**-60))
    return df.where(F.col(weight) > 0).orderBy(-F.log(u) / F.col(weight), key).limit(n)


def draws_with_examples(df: DataFrame, group: str, key: str, draws: int, examples: int = 3, seed: int = 0) -> DataFrame:
    """T-6: ``(draw, group, place, key)``: groups drawn by their size, each with ``examples`` different rows of it, all if it has fewer.

    Rows of a group are numbered in the order of a hash; a draw takes neighbours in it from a hashed start on, so a draw reads as many rows as it
    gets and a large group costs no more.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = numbered(df.select(F.col(group).alias("__g"), F.col(key).alias("__k"), order.alias("__h")), ["__g", "__h", "__k"], "__n")
    held = materialize(rows)
    sizes = materialize(held.groupBy("__g").agg(F.count(F.lit(1)).alias("__size"), F.min("__n").alias("__first")))
    drawn = weighted_draws(sizes.select(F.col("__g").alias(group), "__size"), group, "__size", draws, seed)
    start = F.floor(md5_uniform(F.col("draw"), seed + 1) * F.col("__size"))
    places = drawn.join(sizes, F.col(group) == F.col("__g")).withColumn("place", F.explode(F.sequence(F.lit(0), F.least(F.lit(examples).cast("long"), F.col("__size")).cast("int") - 1)))
    at = places.select("draw", group, "place", (F.col("__first") + (start + F.col("place")) % F.col("__size")).alias("__at"))
    return at.join(held, F.col("__at") == F.col("__n")).select("draw", group, "place", F.col("__k").alias(key))


def kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, starts: int = 10, iterations: int = 300):
    """O-56: the best of several k-means|| fits; ``k`` falls to ``max(10, n // 5)`` when there are fewer rows.

    An iteration is a short job, so up to `FITS` fits run side by side; each is the same as alone, and holds a copy of the vectors in Spark's storage.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    n = data.count()
    k = k if n >= k else max(10, n // 5)
    fit = inheritable_thread_target(df.sparkSession)(lambda i: KMeans(k=k, seed=seed + i, maxIter=iterations).fit(data))
    with ThreadPool(max(1, min(FITS, starts))) as pool:
        fits = pool.map(fit, range(starts), chunksize=1)
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best, best.transform(data).withColumnRenamed("prediction", "cluster_id").drop("features")


def balanced_partitions(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """O-124: largest differencing (Karmarkar-Karp); with ``equal_size`` all parts get as many items."""
    import heapq

    if equal_size and len(lengths) % k:
        raise ValueError("equal parts need a multiple of k items")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    heap, tick = [], 0

    def push(parts):
        nonlocal tick
        parts.sort(key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), tick, parts))
        tick += 1

    step = k if equal_size else 1
    for at in range(0, len(order), step):
        items = order[at : at + step]
        push([(lengths[i], [i]) for i in items] + [(0, []) for _ in range(k - len(items))])
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        push([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))])
    return [sorted(p[1]) for p in heap[0][2]] if heap else [[] for _ in range(k)]


def greedy_partitions(lengths: list[int], k: int) -> list[list[int]]:
    """O-124, greedy: items in their given order to the part with the least load."""
    loads, parts = [0] * k, [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        p = loads.index(min(loads))
        loads[p] += n
        parts[p].append(i)
    return parts


def micro_batches(lengths: list[int], budget: int) -> list[list[int]]:
    """O-125: ``ceil(total / budget)`` balanced batches."""
    return balanced_partitions(lengths, max(1, -(-sum(lengths) // budget)))


def partition_batches(df: DataFrame, batch: str, row: str, length: str, k: int) -> DataFrame:
    """``(batch, row, part)``: every batch of sequences dealt to ``k`` parts of nearly equal length; a batch is one step's rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(row, ignore_index=True)
        part = np.empty(len(rows), np.int64)
        for p, members in enumerate(balanced_partitions(rows[length].tolist(), k)):
            part[members] = p
        return pd.DataFrame({batch: rows[batch], row: rows[row], "part": part})

    return df.select(batch, row, length).groupBy(batch).applyInPandas(run, f"{batch} long, {row} long, part long")


def budget_batches(df: DataFrame, batch: str, row: str, length: str, budget: int) -> DataFrame:
    """O-125: ``(batch, row, part, position)``: every step's rows in ``ceil(tokens / budget)`` balanced parts; ``position`` is a row's place
    in the new order (by part), so sorting by row undoes it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(row, ignore_index=True)
        parts = micro_batches(rows[length].tolist(), budget)
        order = [i for p in parts for i in p]
        part, position = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        position[order] = np.arange(len(rows))
        for p, members in enumerate(parts):
            part[members] = p
        return pd.DataFrame({batch: rows[batch], row: rows[row], "part": part, "position": position})

    return df.select(batch, row, length).groupBy(batch).applyInPandas(run, f"{batch} long, {row} long, part long, position long")
