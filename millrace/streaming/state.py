"""State carried over micro-batches (ST-*): decayed counts, quotas and first occurrences.

The batch id is the only clock. The closed form of the decayed counts is what a stream must agree with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ema_closed_form(df: DataFrame, batch: str, cluster: str, k: int, alpha: float = 1.0, gamma: float = 0.9) -> DataFrame:
    """ST-1: counts after all batches: ``alpha * gamma^T + sum over batches of (1 - gamma) * gamma^(T - t) * n``.

    Batches are numbered by rank among those that are not empty.
    """
    from millrace.operators.batch import numbered

    per = df.groupBy(batch, F.col(cluster).cast("long").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    number = numbered(per.select(batch).distinct(), [batch], "t").withColumn("t", F.col("t") + 1)
    last = number.agg(F.coalesce(F.max("t"), F.lit(0)).alias("steps"))
    sums = per.join(number, batch).crossJoin(last).groupBy("cluster_id").agg(F.sum((1 - gamma) * F.pow(F.lit(gamma), F.col("steps") - F.col("t")) * F.col("n")).alias("s"))
    return df.sparkSession.range(k).withColumnRenamed("id", "cluster_id").join(sums, "cluster_id", "left").crossJoin(last).select(
        "cluster_id", (alpha * F.pow(F.lit(gamma), F.col("steps")) + F.coalesce("s", F.lit(0.0))).alias("count")
    )


def ema_initial(spark, k: int, alpha: float = 1.0, restored: DataFrame | None = None) -> DataFrame:
    """ST-2: ones times alpha, or a restored state if it has exactly ``k`` rows."""
    fresh = spark.range(k).select(F.col("id").alias("cluster_id"), F.lit(float(alpha)).alias("count"))
    return restored.select("cluster_id", "count") if restored is not None and restored.count() == k else fresh


def ema_step(state: DataFrame, batch: DataFrame, cluster: str, gamma: float = 0.9) -> DataFrame:
    """One batch: decay, then ``1 - gamma`` per item; an empty batch changes nothing."""
    n = batch.groupBy(F.col(cluster).cast("long").alias("cluster_id")).agg(F.count(F.lit(1)).alias("n"))
    any_rows = batch.agg((F.count(F.lit(1)) > 0).alias("some"))
    new = F.col("count") * gamma + (1 - gamma) * F.coalesce("n", F.lit(0))
    return state.join(n, "cluster_id", "left").crossJoin(any_rows).select("cluster_id", F.when(F.col("some"), new).otherwise(F.col("count")).alias("count"))


def ema_stream(stream: DataFrame, cluster: str, state_path: str, checkpoint: str, k: int, alpha: float = 1.0, gamma: float = 0.9):
    """ST-1 / ST-5 as a streaming query. Every batch writes its state under its own id, so a repeated batch starts from the
    state before it and the result is the same."""
    from pyspark.sql.utils import AnalysisException

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, None
        if batch_id:
            try:
                before = spark.read.parquet(f"{state_path}/batch={batch_id - 1}")
            except AnalysisException:
                before = None
        state = ema_initial(spark, k, alpha, before)
        ema_step(state, batch, cluster, gamma).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def restore_counts(spark, path: str, k: int, alpha: float = 1.0) -> DataFrame:
    """ST-2: the state of the last step in a folder of JSON logs ``{"step", "cluster_stats": {"cluster_counts": [...]}}``; ones times
    alpha if there is no log or the last one has another number of clusters."""
    from pyspark.sql.utils import AnalysisException

    schema = "step long, cluster_stats struct<cluster_counts: array<double>>"
    try:
        logs = spark.read.schema(schema).option("multiLine", True).json(path)
        last = logs.where("step IS NOT NULL").agg(F.max_by("cluster_stats.cluster_counts", "step").alias("c"))
        found = last.select(F.posexplode("c").alias("cluster_id", "count")).withColumn("cluster_id", F.col("cluster_id").cast("long"))
        return ema_initial(spark, k, alpha, found)
    except AnalysisException:
        return ema_initial(spark, k, alpha)


def step_entry(state: DataFrame, step: int) -> DataFrame:
    """ST-5: one log row of a state, as `restore_counts` reads it."""
    held = state.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "count"))).alias("s"), F.sum("count").alias("t"), F.count(F.lit(1)).alias("n"))
    counts = F.transform("s", lambda x: x["count"])
    stats = F.struct(counts.alias("cluster_counts"), F.transform("s", lambda x: x["count"] / F.col("t")).alias("cluster_probabilities"), F.col("t").alias("total_count"), F.col("n").alias("num_clusters"))
    return held.select(F.lit(step).cast("long").alias("step"), stats.alias("cluster_stats"))


def first_seen_stream(stream: DataFrame, key: Column, event: str | None = None, delay: str | None = None) -> DataFrame:
    """ST-3: the first row of each key. State is kept per key; with an event time and a delay, a key's state goes when the
    watermark has passed it, and a later row of the key counts as new."""
    keyed = stream.withColumn("__key", key)
    if event is None:
        return keyed.dropDuplicates(["__key"]).drop("__key")
    return keyed.withWatermark(event, delay or "0 seconds").dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def quota_stream(stream: DataFrame, cluster: str, key: str, cap: int, order: str | None = None) -> DataFrame:
    """ST-4: accept rows while their cluster has fewer than ``cap``; one counter of state per cluster.

    Within a batch rows are taken in the order of a column (the key if none is named), however they are cut into frames; of a
    batch no more rows are held than there is room.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    t = dict(stream.dtypes)

    def accept(group, frames, state: GroupState):
        used = state.get[0] if state.exists else 0
        room, held = max(0, cap - used), None
        for pdf in frames:
            rows = pdf if held is None else pd.concat([held, pdf])
            held = rows.sort_values(["o", "k"], kind="stable").head(room)
        if held is not None:
            state.update((used + len(held),))
            yield pd.DataFrame({cluster: held["c"], key: held["k"]})

    rows = stream.select(F.col(cluster).alias("c"), F.col(key).alias("k"), F.col(order or key).alias("o"))
    return rows.groupBy("c").applyInPandasWithState(accept, f"{cluster} {t[cluster]}, {key} {t[key]}", "used long", "append", GroupStateTimeout.NoTimeout)
