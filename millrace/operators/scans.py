"""Scans in linear time over sequences of any length: affine recurrences whose sequences need not fit a row or a task.

``after = b + a * before``, where ``before`` is what the row before (in scan order) left, 0 at the first row of a group. Rows are dealt by ranges of
group and order, so a long sequence lies in several partitions. Each partition composes its rows to affine segments, the segments' totals (a row per
partition) give what comes into each partition, and one multiplication applies it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialize


def affine(df: DataFrame, group: str, order: list[str], a: Column, b: Column, reverse: bool = False, partitions: int | None = None) -> DataFrame:
    """``df`` with ``before`` and ``after`` by group in the order of columns, from the last row to the first with ``reverse``.

    A null ``a`` or ``b`` counts as 0; null groups are one group; rows that tie in the order are taken in an order of their own.
    """
    keep = [c for c in df.columns if c not in ("before", "after")]
    by = [F.col(group).desc(), *[F.col(c).desc() for c in order]] if reverse else [F.col(group).asc(), *[F.col(c).asc() for c in order]]
    given = df.select(*keep, F.coalesce(a.cast("double"), F.lit(0.0)).alias("__mr_a"), F.coalesce(b.cast("double"), F.lit(0.0)).alias("__mr_b"))
    dealt = (given.repartitionByRange(partitions, *by) if partitions else given.repartitionByRange(*by)).sortWithinPartitions(*by).withColumn("__mr_p", F.spark_partition_id())
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)

    def compose(batches):
        last, run, coefficient, first = None, 0.0, 1.0, True
        for batch in batches:
            out = {"__mr_x": [], "__mr_c": [], "__mr_y": [], "__mr_d": [], "__mr_f": []}
            new = batch[group].ne(batch[group].shift()) & ~(batch[group].isna() & batch[group].shift().isna())
            starts = new.to_numpy(copy=True)
            if len(batch):
                if last is not None:
                    starts[0] = not (batch[group].iloc[0] == last[0] or (pd.isna(batch[group].iloc[0]) and pd.isna(last[0])))
                else:
                    starts[0] = False  # the first segment may go on from the partition before
                last = (batch[group].iloc[-1],)
            for begins, x, y in zip(starts.tolist(), batch["__mr_a"].tolist(), batch["__mr_b"].tolist()):
                if begins:
                    run, coefficient, first = 0.0, 1.0, False
                for name, value in zip(out, (run, coefficient if first else 0.0)):
                    out[name].append(value)
                run, coefficient = y + x * run, x * coefficient
                out["__mr_y"].append(run)
                out["__mr_d"].append(coefficient if first else 0.0)
                out["__mr_f"].append(first)
            yield batch.assign(**out)

    held = materialize(dealt.mapInPandas(compose, f"{kind}, __mr_x double, __mr_c double, __mr_y double, __mr_d double, __mr_f boolean"))
    # Of each partition the first and last group and the total of what reaches its end: a row per partition.
    held_n = held.withColumn("__mr_n", F.monotonically_increasing_id())
    ends = held_n.groupBy("__mr_p").agg(
        F.min_by(F.struct(F.col(group).alias("g")), "__mr_n").alias("first"), F.max_by(F.struct(F.col(group).alias("g"), F.col("__mr_y").alias("y"), F.col("__mr_d").alias("d")), "__mr_n").alias("last")
    )
    carries, group_before, value = [], None, 0.0
    for r in sorted(ends.collect(), key=lambda r: r["__mr_p"]):
        comes = value if group_before is not None and group_before[0] == r["first"]["g"] else 0.0
        carries.append((r["__mr_p"], comes))
        group_before, value = (r["last"]["g"],), r["last"]["y"] + r["last"]["d"] * comes
    carried = F.broadcast(df.sparkSession.createDataFrame(carries, "__mr_q int, __mr_comes double"))
    joined = held.join(carried, F.col("__mr_p") == F.col("__mr_q"), "left")
    return joined.select(*keep, (F.col("__mr_x") + F.col("__mr_c") * F.col("__mr_comes")).alias("before"), (F.col("__mr_y") + F.col("__mr_d") * F.col("__mr_comes")).alias("after"))


def discounted(df: DataFrame, group: str, order: list[str], reward: Column, gamma: float, mask: Column | None = None) -> DataFrame:
    """W-3: ``df`` with ``returns``: the reward and ``gamma`` times what follows, of which nothing is carried on behind a masked row."""
    m = F.lit(1.0) if mask is None else mask.cast("double")
    out = affine(df.withColumn("__mr_r", reward.cast("double")), group, order, m * gamma, m * F.col("__mr_r"), reverse=True)
    return out.withColumn("returns", F.col("__mr_r") + gamma * F.col("before")).drop("__mr_r", "before", "after")


def gae(df: DataFrame, group: str, order: list[str], reward: Column, value: Column, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """W-4: ``df`` with ``advantage`` and ``return``. What is carried is ``gamma * (value + lam * advantage)`` of the next row, so no row looks ahead."""
    some = df.withColumns({"__mr_r": reward.cast("double"), "__mr_v": value.cast("double")})
    rest = F.col("__mr_r") - F.col("__mr_v")
    out = affine(some, group, order, F.lit(gamma * lam), gamma * F.col("__mr_v") + gamma * lam * rest, reverse=True)
    return out.withColumn("advantage", rest + F.col("before")).withColumn("return", F.col("advantage") + F.col("__mr_v")).drop("__mr_r", "__mr_v", "before", "after")


def positions(df: DataFrame, group: str, order: list[str], mask: Column) -> DataFrame:
    """W-9 on rows: ``df`` with ``position``: unmasked rows so far less one, 0 at least."""
    out = affine(df, group, order, F.lit(1.0), mask.cast("double"))
    return out.withColumn("position", F.greatest(F.lit(0), F.col("after").cast("long") - 1)).drop("before", "after")


# ---- sequences that are arrays: a pass over each


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def masked_scan(rewards: pd.Series, mask: pd.Series, gamma: pd.Series) -> pd.Series:
    """``r + gamma * next`` from the end of each array, of which nothing is carried on behind a masked place."""

    def one(rs, ms, g):
        if rs is None or ms is None:
            return None
        out, run = [0.0] * len(rs), 0.0
        for i in range(len(rs) - 1, -1, -1):
            out[i] = rs[i] + g * run
            run = out[i] * ms[i]
        return out

    return pd.Series([one(*x) for x in zip(rewards, mask, gamma)], dtype=object)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def running_positions(mask: pd.Series) -> pd.Series:
    return pd.Series([None if m is None else (m.astype("int64").cumsum() - 1).clip(min=0) for m in mask], dtype=object)
