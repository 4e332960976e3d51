"""Writers (O-13..O-18): idempotent, partitioned and resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, key: str, test_share: float = 0.1, seed: int = 0) -> None:
    """O-13: Parquet partitioned by a stable train/test mark."""
    from millrace.operators.select import split_by_hash

    split_by_hash(df, key, test_share, seed).write.mode("overwrite").partitionBy("split").parquet(path)


def publish(scored: DataFrame, solver_path: str, rollouts_path: str, low: float = 0.3, high: float = 0.8) -> None:
    """O-14: the filtered set and the full rollouts from one input."""
    from millrace.operators.filters import score_band

    scored = scored.persist()
    try:
        score_band(scored, low, high).write.mode("overwrite").parquet(solver_path)
        scored.write.mode("overwrite").parquet(rollouts_path)
    finally:
        scored.unpersist()


def save_clusters(assignments: DataFrame, centroids: DataFrame, path: str) -> None:
    """O-16: centroids, assignments and counts as three tables."""
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    assignments.write.mode("overwrite").parquet(f"{path}/assignments")
    assignments.groupBy("cluster_id").count().write.mode("overwrite").parquet(f"{path}/stats")


def load_clusters(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("centroids", "assignments", "stats")}


def append_iteration(df: DataFrame, path: str, iteration: int) -> None:
    """O-17: an iteration's rows; writing it again replaces it."""
    df.withColumn("iteration", F.lit(iteration)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("iteration").parquet(path)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """O-18: rows whose key has no output yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    """O-3 / O-15."""
    df.write.mode("overwrite").json(path)


def log_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """O-21: one step's metrics as JSON under ``step=...``; logging a step again replaces it. What shows them reads that folder."""
    metrics.write.mode("overwrite").json(f"{path}/step={step}")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All steps logged, with their ``step``."""
    return spark.read.json(path)


def save_batch(df: DataFrame, path: str) -> None:
    """O-122: a batch as Parquet, read again by `load_batch`. A data frame is built from records or columns by ``createDataFrame``."""
    df.write.mode("overwrite").parquet(path)


def load_batch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
