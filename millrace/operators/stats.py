"""Aggregations and reports (A-*). All group sizes are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))


def cluster_statistics(counts: DataFrame, size: str = "size", k: int | None = None) -> DataFrame:
    """A-1 / A-2: totals, coverage of ``k``, spread and percentiles (linear interpolation) of cluster sizes."""
    s = F.col(size)
    cover = [(F.count(F.lit(1)) / float(k)).alias("coverage")] if k else []
    return counts.agg(
        F.sum(s).alias("total"), F.count(F.lit(1)).alias("clusters"), *cover, F.min(s).alias("smallest"), F.max(s).alias("largest"), F.avg(s).alias("mean"), F.median(s).alias("median"),
        F.stddev_pop(s).alias("std"), *[F.percentile(s, F.lit(p / 100)).alias(f"p{p}") for p in (25, 75, 90, 95, 99)],
    )


def entropy(counts: DataFrame, size: str = "size", k: int | None = None, base: float | None = None) -> DataFrame:
    """A-3: Shannon entropy (natural log unless ``base``), its maximum for the active clusters (or ``k``), their ratio."""
    import math

    scale = 1 / math.log(base) if base else 1.0
    total = counts.agg(F.sum(size).alias("t"), F.count(F.lit(1)).alias("n"))
    p = F.col(size) / F.col("t")
    h = counts.crossJoin(total).groupBy("n").agg((-F.sum(p * F.log(p + 1e-10)) * scale).alias("entropy"))
    most = F.log(F.lit(float(k)) if k else F.col("n").cast("double")) * scale
    return h.select("entropy", most.alias("max_entropy"), F.try_divide(F.col("entropy"), most).alias("normalized"))


def gini(counts: DataFrame, size: str = "size", top: int = 10) -> DataFrame:
    """A-5: Gini coefficient, share of the ``top`` largest and ratio of the largest to the smallest.

    Sizes are ranked by ranges (`batch.numbered`); equal sizes may stand in any order.
    """
    from millrace.operators.batch import numbered

    ranked, n = numbered(counts.select(F.col(size).cast("double").alias("s")), ["s"], "i"), float(counts.count())
    i, s = F.col("i") + 1, F.col("s")
    return ranked.agg(
        (2 * F.sum(i * s) / (n * F.sum(s)) - (n + 1) / n).alias("gini") if n else F.lit(None).cast("double").alias("gini"),
        (F.sum(F.when(i > n - top, s).otherwise(0.0)) / F.sum(s)).alias("top_share"), (F.max(s) / F.min(s)).alias("max_min_ratio"),
    )


def top(df: DataFrame, by: str, key: str, n: int = 10, largest: bool = True) -> DataFrame:
    """A-4 / T-2 with an explicit tie key."""
    return df.orderBy(F.desc(by) if largest else F.asc(by), key).limit(n)


def score_bins(score: Column) -> Column:
    """A-12: five bins of 0.2 and 1.0 on its own."""
    out = F.when(score >= 1, "1.0")
    for lo in (0.8, 0.6, 0.4, 0.2):
        out = out.when(score >= lo, f"{lo:.1f}-{lo + 0.2:.1f}")
    return out.otherwise("0.0-0.2")


def unit_histogram(df: DataFrame, score: Column, bins: int = 20) -> DataFrame:
    """A-13: equal bins over [0, 1], the last one closed; empty bins are kept."""
    found = df.where(score.between(0, 1)).groupBy(F.least(F.floor(score * bins), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def range_histogram(df: DataFrame, value: str, bins: int = 11) -> DataFrame:
    """A-14: equal bins over the observed range."""
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)))
    return df.where(F.col(value).isNotNull()).crossJoin(edge).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def bucket(value: Column, edges: list[float]) -> Column:
    """A-15: ``[lo, hi)`` buckets by number, the last one closed."""
    out = F.when(value == edges[-1], len(edges) - 2)
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        out = out.when((value >= lo) & (value < hi), i)
    return out


def accuracy_rollup(df: DataFrame, category: str, correct: Column) -> DataFrame:
    """A-9 / A-10: accuracy per category and over all (``ALL``)."""
    hit = correct.cast("double")
    return df.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.grouping(category).alias("g")).select(
        F.when(F.col("g") == 1, "ALL").otherwise(F.col(category).cast("string")).alias("category"), "n", "accuracy"
    )


def cluster_accuracy(df: DataFrame, cluster: str, correct: Column) -> DataFrame:
    """A-11: mean and population variance of the clusters' accuracies."""
    by = df.groupBy(cluster).agg(F.avg(correct.cast("double")).alias("a"))
    return by.agg(F.count(F.lit(1)).alias("clusters"), F.avg("a").alias("mean_accuracy"), F.var_pop("a").alias("var_accuracy"))


def match_report(df: DataFrame, cluster: str, status: Column, least: int = 5) -> DataFrame:
    """A-8: counts by status per cluster, match rate, clusters with at least ``least`` rows."""
    d = df.withColumn("__s", status)
    out = d.groupBy(cluster).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("__s") == s).alias(s) for s in ("matched", "wrong", "mismatched", "error")])
    return out.where(F.col("total") >= least).withColumn("match_rate", F.col("matched") / F.col("total"))


def weighted_merge(df: DataFrame, cluster: str, mean: str, n: str, k: int) -> DataFrame:
    """A-21: per-step means merged by their counts; clusters never visited have zero visits and no mean."""
    merged = df.groupBy(F.col(cluster).cast("long").alias("cluster_id")).agg(F.sum(n).alias("visits"), (F.sum(F.col(mean) * F.col(n)) / F.sum(n)).alias("mean"))
    total = merged.agg(F.sum("visits").alias("t"))
    return df.sparkSession.range(k).withColumnRenamed("id", "cluster_id").join(merged, "cluster_id", "left").crossJoin(total).select(
        "cluster_id", F.coalesce("visits", F.lit(0)).alias("visits"), "mean", (100 * F.coalesce("visits", F.lit(0)) / F.col("t")).alias("share_pct")
    )


def first_last(df: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """A-23: mean per step, first against last step and the improvement."""
    m = df.groupBy(key, step).agg(F.avg(value).alias("m"))
    return m.groupBy(key).agg(F.min_by("m", step).alias("first_mean"), F.max_by("m", step).alias("last_mean"), F.count(F.lit(1)).alias("steps")).withColumn("improvement", F.col("last_mean") - F.col("first_mean"))


def masked(df: DataFrame, group: str, value: Column, mask: Column) -> DataFrame:
    """A-30: mean and Bessel variance of the unmasked values."""
    v = F.when(mask, value)
    return df.groupBy(group).agg(F.avg(v).alias("masked_mean"), F.var_samp(v).alias("masked_var"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-29: mean, maximum and minimum of each metric."""
    return df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def reward_counts(df: DataFrame, reward: str, near: float = 1e-6) -> DataFrame:
    """R-4: how many rewards are 1, 0, -1 (within ``near``) and other."""
    r = F.col(reward)
    hits = [F.coalesce(F.abs(r - x) < near, F.lit(False)) for x in (1.0, 0.0, -1.0)]
    named = zip(("reward_1", "reward_0", "reward_neg1"), hits)
    return df.agg(*[F.count_if(h).alias(n) for n, h in named], F.count_if(~(hits[0] | hits[1] | hits[2])).alias("reward_other"), F.count(F.lit(1)).alias("total"))


def step_log(df: DataFrame, step: str, cluster: str, score: str) -> DataFrame:
    """A-22: a row per step: rows, and their counts and mean scores by cluster."""
    by = df.groupBy(step, cluster).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("m"))
    entry = F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("k"), "n", "m")))
    out = by.groupBy(step).agg(F.sum("n").alias("num_questions"), entry.alias("e"))
    pick = lambda name: F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], x[name])))
    return out.select(step, "num_questions", pick("n").alias("distribution"), pick("m").alias("avg_scores"))


def adaptive_histogram(df: DataFrame, value: str, most: int = 50) -> DataFrame:
    """A-14: equal bins over the observed range, as many as there are distinct values but ``most`` at most."""
    bins = F.least(F.lit(most), F.greatest(F.lit(1), F.count_distinct(value)))
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), bins.alias("bins"))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1))
    return df.where(F.col(value).isNotNull()).crossJoin(edge).groupBy(at.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def worst(report: DataFrame, cluster: str, n: int = 10) -> DataFrame:
    """A-8: the clusters with the lowest match rate."""
    return report.orderBy("match_rate", F.desc("total"), cluster).limit(n)
