"""Deduplication and canonical forms (O-47..O-52)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import dedup_key
from millrace.operators import similar
from millrace.operators.components import connected_components

def lexical(df: DataFrame, text: str, order: str) -> DataFrame:
    """O-48: the first row of every normalized text; ``order`` names rows. The key is hashed for the shuffle, minima combine
    before it, and only the names of the first rows are joined with the texts."""
    key = F.sha2(dedup_key(F.coalesce(F.col(text), F.lit(""))), 256)
    first = df.groupBy(key.alias("__k")).agg(F.min(order).alias("__first")).select("__first")
    return df.join(first, F.col(order) == F.col("__first"), "left_semi")


def lexical_groups(df: DataFrame, text: str, order: str) -> DataFrame:
    key = F.sha2(dedup_key(F.coalesce(F.col(text), F.lit(""))), 256).alias("k")
    return df.groupBy(key).agg(F.min(order).alias("first_id"), F.count(F.lit(1)).alias("n")).drop("k")


def greedy_in_cluster(df: DataFrame, cluster: str, key: str, vector: str, threshold: float = 0.95) -> DataFrame:
    """O-47: in key order, drop a row that is too similar to an earlier kept one; a dropped row suppresses nothing."""
    return similar.removed(df, cluster, key, vector, threshold).where("NOT duplicate").select(key, cluster)


def against_accepted(df: DataFrame, accepted: DataFrame, key: str, vector: str, block: str, threshold: float = 0.92) -> DataFrame:
    """O-49 against a given accepted set: ``(key, max_similarity, duplicate)``, compared within equal ``block`` values."""
    from millrace.operators.vectors import cosine

    a = accepted.select(F.col(block).alias("__b"), F.col(vector).alias("__w"))
    pairs = df.join(a, F.col(block) == F.col("__b"), "left").groupBy(key).agg(F.max(cosine(F.col(vector), F.col("__w"))).alias("max_similarity"))
    return pairs.withColumn("duplicate", F.coalesce(F.col("max_similarity") >= threshold, F.lit(False)))


def against_growing(df: DataFrame, key: str, vector: str, block: str, threshold: float = 0.92, accepted: DataFrame | None = None) -> DataFrame:
    """O-49: ``(key, block, duplicate)`` in key order: a row is a duplicate if it is at least ``threshold`` alike to an accepted
    row of its block, given or accepted before it."""
    return similar.removed(df, block, key, vector, threshold, inclusive=True, accepted=accepted)


def top_neighbours(df: DataFrame, key: str, vector: str, block: str, k: int = 10) -> DataFrame:
    """T-3: ``(key, neighbour, similarity, rank)``: the ``k`` most similar other rows of each row's block; ties by key."""
    return similar.neighbours(df, key, vector, block, k)


def similar_pairs(df: DataFrame, key: str, vector: str, block: str, threshold: float) -> DataFrame:
    """``(src, dst, similarity)`` above the threshold within blocks. Blocks are chosen by the caller and must be bounded."""
    from millrace.operators.vectors import cosine

    a = df.select(F.col(key).alias("src"), F.col(block).alias("b"), F.col(vector).alias("v"))
    b = df.select(F.col(key).alias("dst"), F.col(block).alias("b"), F.col(vector).alias("w"))
    return a.join(b, "b").where("src < dst").select("src", "dst", cosine(F.col("v"), F.col("w")).alias("similarity")).where(F.col("similarity") > threshold)


def similarity_groups(df: DataFrame, key: str, vector: str, block: str | None = None, threshold: float = 0.85, recall: float = 0.95) -> DataFrame:
    """O-50: components of the similarity graph, ``(node, component)`` for groups of two or more.

    Without blocks from the caller pairs are found by `similar.similar_groups`; with them all pairs of a block are compared.
    """
    if block is None:
        return similar.similar_groups(df, key, vector, threshold, recall)
    return connected_components(similar_pairs(df, key, vector, block, threshold))


def canonical(df: DataFrame, group: str, name: str, count: str) -> DataFrame:
    """O-51: the most frequent name of a group, then the shorter, then the first in order."""
    return df.groupBy(group).agg(F.min_by(name, F.struct((-F.col(count)).alias("c"), F.length(name).alias("l"), F.col(name).alias("n"))).alias("canonical"))


def remap_counts(counts: DataFrame, mapping: DataFrame, key: str, count: str) -> DataFrame:
    """O-52: counts summed again under canonical keys; unmapped keys stay."""
    m = mapping.select(F.col(key).alias("__k"), F.col("canonical").alias("__c"))
    return counts.join(m, F.col(key) == F.col("__k"), "left").groupBy(F.coalesce("__c", key).alias(key)).agg(F.sum(count).alias(count))


def first_in(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """W-10: the first row per group by an explicit order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def clean_names(counts: DataFrame, name: str, count: str, rules, groups=None, merges: DataFrame | None = None) -> DataFrame:
    """O-52: ``(name, canonical)`` of every name, by three passes with counts summed again at each: rules, then components of
    similar names (``groups`` makes ``(node, component)`` from the names left), each under its most frequent name, then
    ``merges (name, canonical)`` that a model gave."""
    from millrace.functions.text import apply_rules
    from millrace.session import materialize

    named = materialize(counts.select(F.col(name), F.col(count).alias("__n"), apply_rules(F.col(name), rules).alias("canonical")))
    if groups is not None:
        left = named.groupBy("canonical").agg(F.sum("__n").alias("__n"))
        found = groups(left.select(F.col("canonical").alias(name))).join(left, F.col("node") == F.col("canonical"))
        best = canonical(found, "component", "node", "__n").withColumnRenamed("canonical", "__best")
        mapping = found.join(best, "component").select(F.col("node").alias("__from"), "__best")
        named = named.join(mapping, F.col("canonical") == F.col("__from"), "left").select(name, "__n", F.coalesce("__best", "canonical").alias("canonical"))
    if merges is not None:
        m = merges.select(F.col(name).alias("__from"), F.col("canonical").alias("__to"))
        named = named.join(m, F.col("canonical") == F.col("__from"), "left").select(name, "__n", F.coalesce("__to", "canonical").alias("canonical"))
    return named.select(name, F.col("__n").alias(count), "canonical")


def reduction(cleaned: DataFrame, name: str) -> DataFrame:
    """O-52: names before and after, and the share that is gone."""
    out = cleaned.agg(F.count_distinct(name).alias("names"), F.count_distinct("canonical").alias("canonical_names"))
    return out.withColumn("reduction", F.coalesce(1 - F.try_divide("canonical_names", "names"), F.lit(0.0)))
