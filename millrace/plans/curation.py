"""Balanced curation (O-54): band, assignment, deduplication and MMR per cluster, then statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.dedup import greedy_in_cluster
from millrace.operators.select import mmr
from millrace.operators.vectors import assign


def curate(df: DataFrame, centroids: DataFrame, key: str, vector: str, score: str, source: str, low: float = 0.3, high: float = 0.8, threshold: float = 0.95, most: int = 100, target: float = 0.75) -> DataFrame:
    """``(key, cluster_id, pick)`` of the selected rows."""
    band = df.where(F.col(score).between(low, high))
    placed = band.join(assign(band, centroids, key, vector).select(key, "cluster_id"), key)
    kept = greedy_in_cluster(placed, "cluster_id", key, vector, threshold).select(key)
    return mmr(placed.join(kept, key, "left_semi"), "cluster_id", key, vector, score, source, most, target)


def curation_stats(selected: DataFrame, scored: DataFrame, key: str, score: str) -> DataFrame:
    """Per cluster and overall (``ALL``): rows, mean and population deviation of the score."""
    rows = selected.join(scored.select(key, score), key)
    return rows.rollup("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"), F.grouping("cluster_id").alias("g")).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col("cluster_id").cast("string")).alias("cluster"), "n", "mean_score", "std_score"
    )
