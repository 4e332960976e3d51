"""Look-up joins (O-36, O-37)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_with_fallback(df: DataFrame, lookup: DataFrame, keys: list[str], value: str, fallback: Column) -> DataFrame:
    """O-36: the looked-up value, else the fallback."""
    right = lookup.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(value).alias("__v"))
    on = None
    for k in keys:
        on = F.col(k) == F.col(f"__{k}") if on is None else on & (F.col(k) == F.col(f"__{k}"))
    return df.join(right, on, "left").withColumn(value, F.coalesce("__v", fallback)).drop("__v", *[f"__{k}" for k in keys])


def probe(df: DataFrame, key: str, bank: DataFrame, bank_key: str, bank_value: str) -> DataFrame:
    """O-37: exact key, lower case, then with the ``concept:`` prefix; the first hit wins. One join on exploded candidates."""
    k = F.col(key)
    tries = F.array(F.struct(F.lit(0).alias("p"), k.alias("c")), F.struct(F.lit(1).alias("p"), F.lower(k).alias("c")), F.struct(F.lit(2).alias("p"), F.concat(F.lit("concept:"), F.lower(k)).alias("c")))
    cand = df.select(key).distinct().select(key, F.explode(tries).alias("t")).select(key, "t.p", "t.c")
    hit = cand.join(bank.select(F.col(bank_key).alias("c"), F.col(bank_value).alias("v")), "c").groupBy(key).agg(F.min_by("v", "p").alias(bank_value))
    return df.join(hit, key, "left")
