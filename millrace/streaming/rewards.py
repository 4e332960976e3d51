"""Diversity rewards that carry state (O-46b with ST-1): bonuses by the decayed counts before a batch, which the batch then updates.

A table whose batches are a column gets all rewards at once by a scan over its batches; a stream gets them a batch at a time. Both
agree, and a batch that is repeated finds the state before it and writes the same again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import scans, vectors
from millrace.operators.batch import numbered
from millrace.session import materialize
from millrace.streaming import state

#: Columns of what a batch is scored by.
PARTS = ("rarity", "uniqueness", "within")


def _bonus(mode: int, scale: str | None, weights) -> Column:
    return vectors.diversity_bonus(mode, F.col("__eligible"), *[F.col(c) for c in PARTS], None if scale is None else F.col(scale), weights)


def rewards(batch: DataFrame, counts: DataFrame, cluster: str, eligible: Column, within: Column, mode: int, scale: str | None = None, weights=vectors.BONUS) -> DataFrame:
    """One batch: its rows with `PARTS` and ``bonus``, by the counts before it. Rows that are not eligible get 0 and count for nothing."""
    rows = batch.withColumn("__eligible", F.coalesce(eligible, F.lit(False))).withColumn("within", within)
    rare = vectors.rarity(counts).select(F.col("cluster_id").alias("__c"), "rarity")
    taken = rows.where("__eligible").withColumn("__b", F.lit(0))
    same = vectors.batch_uniqueness_table(taken, "__b", cluster).select(F.col(cluster).alias("__d"), "uniqueness")
    joined = rows.join(rare, F.col(cluster) == F.col("__c"), "left").join(same, F.col(cluster) == F.col("__d"), "left").drop("__c", "__d")
    return joined.withColumn("bonus", _bonus(mode, scale, weights)).drop("__eligible")


def rewards_stream(stream: DataFrame, cluster: str, eligible: Column, within: Column, mode: int, state_path: str, out_path: str, checkpoint: str, k: int, scale: str | None = None, weights=vectors.BONUS, alpha: float = 1.0, gamma: float = 0.9):
    """A streaming query that writes each batch's rewards below ``out_path`` and then its counts below ``state_path``, both under its id.

    Every mode updates the counts, mode 1 too. The state of a batch is there once its rewards are; a repeated batch overwrites both.
    """
    from pyspark.sql.utils import AnalysisException

    def step(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, None
        if batch_id:
            try:
                before = spark.read.parquet(f"{state_path}/batch={batch_id - 1}")
            except AnalysisException:
                before = None
        held = batch.persist()
        try:
            counts = state.ema_initial(spark, k, alpha, before)
            rewards(held, counts, cluster, eligible, within, mode, scale, weights).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            state.ema_step(counts, held.where(F.coalesce(eligible, F.lit(False))), cluster, gamma).coalesce(1).write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def held_before(steps: DataFrame, group: str, gamma: float) -> DataFrame:
    """``steps`` ``(group, __t, __n)`` with ``held``: what earlier batches of the group left just before batch ``__t``, linear in the rows."""
    last = scans.affine(steps, group, ["__t"], F.lit(0), F.col("__t") + 1).withColumn("__gap", F.col("__t") + 1 - F.col("before")).drop("before", "after")
    decay = F.pow(F.lit(gamma), F.col("__gap"))  # from the batch of the row before; where there is none, nothing is carried
    out = scans.affine(last, group, ["__t"], decay, (1 - gamma) * F.col("__n"))
    return out.withColumn("held", F.col("before") * F.pow(F.lit(gamma), F.col("__gap") - 1)).drop("before", "after", "__gap")


def rewards_by_batch(df: DataFrame, batch: str, cluster: str, eligible: Column, within: Column, k: int, modes, scale: str | None = None, weights=vectors.BONUS, alpha: float = 1.0, gamma: float = 0.9) -> DataFrame:
    """``df`` with `PARTS` and ``bonus_<mode>``: what a stream of its batches, in the order of the column, gives each row.

    Batches are numbered among those with eligible rows. The counts before a batch are decayed sums over the batches before it: scans for
    each cluster and for the totals, linear in the rows by batch and cluster. Parts are null for rows that are not eligible.
    """
    rows = df.withColumn("__eligible", F.coalesce(eligible, F.lit(False))).withColumn("within", within)
    per = rows.where("__eligible").groupBy(F.col(batch).alias("__b"), F.col(cluster).cast("long").alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    per = materialize(per.where(F.col("__c").between(0, k - 1)))
    steps = per.join(numbered(per.select("__b").distinct(), ["__b"], "__t"), "__b")
    own = held_before(steps, "__c", gamma).select("__b", "__c", "__t", "__n", F.col("held").alias("__own"))
    totals = steps.groupBy("__b", "__t").agg(F.sum("__n").alias("__n")).withColumn("__g", F.lit(0))
    every = held_before(totals, "__g", gamma).select(F.col("__b").alias("__b2"), F.col("held").alias("__all"), F.col("__n").alias("__rows"))
    start = alpha * F.pow(F.lit(gamma), F.col("__t").cast("double"))
    known = own.join(every, F.col("__b") == F.col("__b2")).select(
        "__b", "__c",
        F.exp(-(start + F.col("__own")) / F.greatest((k * start + F.col("__all")) / k, F.lit(1e-8))).alias("rarity"),
        F.when(F.col("__rows") <= 1, 1.0).otherwise(1 - (F.col("__n") - 1) / (F.col("__rows") - 1)).alias("uniqueness"),
    )
    on = (F.col(batch) == F.col("__b")) & (F.col(cluster).cast("long") == F.col("__c")) & F.col("__eligible")
    out = rows.join(known, on, "left")
    return out.withColumns({f"bonus_{m}": _bonus(m, scale, weights) for m in modes}).drop("__b", "__c", "__eligible")
