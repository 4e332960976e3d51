"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that Python holds at once; long texts are thus held a few at a time.
SLICE_ROWS = 256


def text_bytes(batch: pa.RecordBatch, name: str = "text"):
    """Yield ``(row, UTF-8 bytes or None)`` of a string column, a small slice at a time."""
    column = batch.column(batch.schema.get_field_index(name))
    for at in range(0, len(column), SLICE_ROWS):
        part = column.slice(at, SLICE_ROWS)
        for i, v in enumerate(pc.cast(part, pa.binary() if not pa.types.is_large_string(part.type) else pa.large_binary()).to_pylist()):
            yield at + i, v


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Keys at most that `join_facts` sends to every task: those with more than so small a share of the counted rows.
HOT_KEYS = 2000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], fact: str, own: list[str]) -> DataFrame:
    """``rows`` with the column ``fact`` of the row of ``facts`` (materialized: keys, fact, count ``n``) that has their keys, else null.

    A key with more than 1 / `HOT_KEYS` of all counted rows is frequent; there are fewer than `HOT_KEYS` such keys, whatever
    the data, so they are broadcast. Their rows are dealt by the columns ``own`` in the shuffle of the other keys, not to
    one task.
    """
    total = facts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT_KEYS > total
    hot = facts.where(often).select(*[F.col(k).alias(f"__mr_h_{k}") for k in keys], F.col(fact).alias("__mr_hot"))
    rest = facts.where(~often).select(*[F.col(k).alias(f"__mr_r_{k}") for k in keys], F.col(fact).alias("__mr_rest"))
    marked = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"__mr_h_{k}") for k in keys], "left")
    dealt = F.when(F.col("__mr_hot").isNotNull(), F.xxhash64(*own).cast(dict(rows.dtypes)[keys[0]])).otherwise(F.col(keys[0]))
    found = marked.withColumn("__mr_key", dealt).join(rest, [F.col("__mr_key") == F.col(f"__mr_r_{keys[0]}"), *[F.col(k) == F.col(f"__mr_r_{k}") for k in keys[1:]]], "left")
    return found.select(*rows.columns, F.coalesce("__mr_hot", "__mr_rest").alias(fact))
