"""Embedding space: nearest centroids, rarity, uniqueness and vector checks (O-31, O-40..O-46, O-58, O-59)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """``(cluster_id, centroid)``: the mean vector of each label."""
    parts = df.select(F.col(label).alias("cluster_id"), F.posexplode(vector).alias("i", "x"))
    means = parts.groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


#: Rows up to which a centroid table is sent to every task; beyond it the SQL form is used.
BROADCAST_CENTROIDS = 20_000


def assign(df: DataFrame, centroids: DataFrame, key: str, vector: str, normalize: bool = True) -> DataFrame:
    """O-40 (cosine against normalized centroids) or O-41 (raw product): ``(key, cluster_id, similarity)``; the smallest
    cluster_id wins a tie.

    The centroid table is checked to be small; then every Arrow batch is one matrix product. A larger table is
    joined in SQL, both sides in parallel.
    """
    size = centroids.limit(BROADCAST_CENTROIDS + 1).count()
    if size > BROADCAST_CENTROIDS:
        c = F.col("centroid")
        sim = dot(F.col("v"), c) / (norm(c) + 1e-12) if normalize else dot(F.col("v"), c)
        pairs = df.select(key, F.col(vector).alias("v")).crossJoin(centroids).select(key, "cluster_id", sim.alias("similarity"))
        best = F.max(F.struct("similarity", (-F.col("cluster_id")).alias("i")))
        return pairs.groupBy(key).agg(best.alias("b")).select(key, (-F.col("b.i")).alias("cluster_id"), F.col("b.similarity").alias("similarity"))
    table = centroids.orderBy("cluster_id").toPandas()
    matrix = np.stack(table["centroid"]).astype(np.float64) if size else np.empty((0, 0))
    if normalize and size:
        matrix = matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12)
    shared = df.sparkSession.sparkContext.broadcast((matrix, table["cluster_id"].to_numpy()))

    def run(batches):
        m, ids = shared.value
        for pdf in batches:
            if not len(pdf) or not len(ids):
                continue
            s = np.stack(pdf["v"]).astype(np.float64) @ m.T
            at = s.argmax(axis=1)
            yield pd.DataFrame({key: pdf[key], "cluster_id": ids[at], "similarity": s[np.arange(len(s)), at]})

    kind = dict(df.dtypes)[key]
    return df.where(F.col(vector).isNotNull()).select(key, F.col(vector).alias("v")).mapInPandas(run, f"{key} {kind}, cluster_id long, similarity double")


def dense_counts(df: DataFrame, cluster: str, k: int) -> DataFrame:
    """A-6: a row for every id in ``range(k)``; ids outside are ignored."""
    spark = df.sparkSession
    counts = df.where(F.col(cluster).between(0, k - 1)).groupBy(F.col(cluster).cast("long").alias("cluster_id")).agg(F.count(F.lit(1)).alias("c"))
    return spark.range(k).withColumnRenamed("id", "cluster_id").join(counts, "cluster_id", "left").select("cluster_id", F.coalesce("c", F.lit(0)).alias("count"))


def rarity(counts: DataFrame, count: str = "count") -> DataFrame:
    """O-43 / O-44: probability and ``exp(-count / mean)``, the mean over all clusters with a floor of 1e-8."""
    total = counts.agg(F.avg(count).alias("mean"), F.sum(count).alias("total"))
    return counts.crossJoin(total).select(
        "cluster_id", count, F.try_divide(F.col(count), F.col("total")).alias("probability"), F.exp(-F.col(count) / F.greatest(F.col("mean"), F.lit(1e-8))).alias("rarity")
    )


def batch_uniqueness(df: DataFrame, batch: str, cluster: str) -> Column:
    """O-45: ``1 - (same - 1) / (n - 1)``, 1 for a batch of one. A window column; see `batch_uniqueness_table` for large batches."""
    same, n = F.count(F.lit(1)).over(Window.partitionBy(batch, cluster)), F.count(F.lit(1)).over(Window.partitionBy(batch))
    return F.when(n <= 1, 1.0).otherwise(1 - (same - 1) / (n - 1))


def batch_uniqueness_table(df: DataFrame, batch: str, cluster: str) -> DataFrame:
    """O-45 by aggregation: ``(batch, cluster, same, uniqueness)``; counts combine before the shuffle."""
    same = df.groupBy(batch, cluster).agg(F.count(F.lit(1)).alias("same"))
    n = same.groupBy(batch).agg(F.sum("same").alias("n"))
    return same.join(n, batch).select(batch, cluster, "same", F.when(F.col("n") <= 1, 1.0).otherwise(1 - (F.col("same") - 1) / (F.col("n") - 1)).alias("uniqueness"))


def within_uniqueness(vector: Column, centroid: Column) -> Column:
    """O-46."""
    return (1 - dot(vector, centroid)) / 2


def vector_checks(df: DataFrame, vector: str, tolerance: float = 0.01) -> DataFrame:
    """O-31 / O-59: zero vectors, zero elements, vectors whose norm is not 1."""
    v = F.col(vector)
    zero = ~F.exists(v, lambda x: x != 0)
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(zero).alias("n_zero_rows"), F.sum(F.size(F.filter(v, lambda x: x == 0))).cast("long").alias("n_zero_elements"),
        F.count_if(~zero & (F.abs(norm(v) - 1) > tolerance)).alias("n_off_norm"), F.avg(norm(v)).alias("mean_norm"),
    )


def compare_vectors(a: Column, b: Column) -> dict[str, Column]:
    """O-58."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return {"cosine": cosine(a, b), "l2": F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)), "max_gap": F.array_max(gaps)}


def nonzero(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector holds a component other than zero."""
    return df.where(F.exists(vector, lambda x: x != 0))


#: Weights of the bonuses for rarity, uniqueness in the batch and uniqueness within the cluster.
BONUS = (0.1, 0.05, 0.05)


def diversity_bonus(mode: int, eligible: Column, rarity: Column, batch: Column, within: Column, scale: Column | None = None, weights=BONUS) -> Column:
    """Bonus by mode: 1 none, 2 rarity, 3 also the batch's uniqueness, 4 also the cluster's, 5 rarity without a weight.

    Rows that are not eligible get 0; ``scale`` multiplies the weighted modes. Rarity is that before the batch's update.
    """
    if mode == 1:
        return F.lit(0.0)
    parts = [w * c for w, c in zip(weights, (rarity, batch, within))][: mode - 1]
    total = rarity if mode == 5 else sum(parts[1:], parts[0]) * (F.lit(1.0) if scale is None else scale)
    return F.when(eligible, total).otherwise(0.0)


def diversity_score(df: DataFrame, cluster: str, text: str, counts: DataFrame, weight: float = 0.5) -> DataFrame:
    """O-46c: ``df`` with ``diversity_score``, the weighted rarity of its cluster by the given counts, which stay as they are;
    0 for blank texts and unknown clusters."""
    from millrace.functions.text import strip

    rare = rarity(counts).select(F.col("cluster_id").alias("__c"), F.col("rarity").alias("__r"))
    score = F.when(strip(F.col(text)) != "", weight * F.col("__r"))
    return df.join(rare, F.col(cluster) == F.col("__c"), "left").withColumn("diversity_score", F.coalesce(score, F.lit(0.0))).drop("__c", "__r")


def vector_moments(df: DataFrame, vector: str) -> DataFrame:
    """A-7: ``(position, mean, variance)`` over all vectors, the population variance."""
    parts = df.select(F.posexplode(vector).alias("position", "x"))
    x = F.col("x").cast("double")
    return parts.groupBy("position").agg(F.avg(x).alias("mean"), F.var_pop(x).alias("variance"))


def runs(df: DataFrame, order: str, hit: Column) -> DataFrame:
    """O-59: ``(first, last, length)`` of every run of rows that hold, with consecutive numbers; no window over the table, runs at the edges of
    partitions are joined by a scan over the rows that hold."""
    from millrace.operators import scans

    rows = df.where(hit).select(F.lit(0).alias("__g"), F.col(order).cast("long").alias("__i"))
    begins = scans.affine(rows, "__g", ["__i"], F.lit(0), F.col("__i") + 1)  # before: one more than the row before
    new = F.when((F.col("before") == 0) | (F.col("before") != F.col("__i")), 1).otherwise(0)
    first = begins.withColumn("__new", F.when(F.col("__i") == 0, 1).otherwise(new)).drop("before", "after")
    return scans.affine(first, "__g", ["__i"], F.lit(1), F.col("__new")).groupBy("after").agg(F.min("__i").alias("first"), F.max("__i").alias("last"), F.count(F.lit(1)).alias("length")).drop("after")
