"""Reports over flat tables of questions, iterations and verdicts.

Traces are tables: a row per question with its seed and iteration, a row per iteration, or a row per seed. Every
report is one aggregate whose sums combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _share(hit: Column) -> Column:
    """Part of all rows for which ``hit`` is true; a null is not a hit."""
    return F.try_divide(F.count_if(hit), F.count(F.lit(1)))


def verification_report(df: DataFrame, bucket: str, checks: dict[str, Column]) -> DataFrame:
    """``(bucket, n, <check>_percentage...)`` for every bucket and, with a null bucket, over all rows."""
    shares = [(100 * _share(hit)).alias(f"{name}_percentage") for name, hit in checks.items()]
    known = df.withColumn(bucket, F.coalesce(F.col(bucket).cast("string"), F.lit("unknown")))
    return known.rollup(bucket).agg(F.count(F.lit(1)).alias("n"), *shares)


def shortfalls(report: DataFrame, bucket: str, least: dict[str, float]) -> DataFrame:
    """``report`` with the names of the checks whose percentage lies below its threshold, in the order given."""
    named = [F.when(F.col(f"{name}_percentage") < bound, F.lit(name)) for name, bound in least.items()]
    return report.select(bucket, F.concat_ws(",", *named).alias("below"))


def label_breakdown(df: DataFrame, bucket: str, labels: Iterable[str]) -> DataFrame:
    """``(bucket, label, value, n)``: how often each value of each label column occurs; nulls are not counted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(x).cast("string").alias("value")) for x in labels]))
    return df.select(bucket, pairs.alias("p")).where("p.value IS NOT NULL").groupBy(bucket, "p.label", "p.value").agg(F.count(F.lit(1)).alias("n"))


def iteration_summary(
    df: DataFrame, keys: list[str], valid: Column, r2: Column, r_m: Column, novelty: Column,
    asked: int, validity: float = 0.5, solvability: float = 0.5, novel: float = 0.3, valid_share: float = 0.5,
) -> DataFrame:
    """One row per iteration: its counts, means over the valid questions, and whether and why the chain ends there.

    All valid questions count if their mean ``r2`` exceeds ``validity``, none otherwise. Means over no question are 0.
    """

    def mean(c):
        return F.coalesce(F.avg(F.when(valid, c)), F.lit(0.0))

    out = df.groupBy(*keys).agg(
        F.when(mean(r2) > validity, F.count_if(valid)).otherwise(0).alias("num_valid"),
        F.count_if(valid & (r_m > solvability)).alias("num_solvable"),
        mean(r_m).alias("avg_r_m"),
        mean(novelty).alias("avg_novelty"),
    )
    reason = (
        F.when(F.col("num_valid") < asked * valid_share, "invalid_questions")
        .when(F.col("avg_r_m") < solvability, "too_difficult")
        .when(F.col("avg_novelty") < novel, "not_novel")
        .otherwise("continue")
    )
    return out.withColumn("decision", reason)


def best_next(df: DataFrame, keys: list[str], question: str, valid: Column, r2: Column, r_m: Column, novelty: Column, least_r_m: float = 0.6, least_r2: float = 0.7) -> DataFrame:
    """The valid question to go on with: the most novel of those above both bounds or, if there is none, of all.

    Ties go to the smaller ``question``.
    """
    premium = F.coalesce((r_m >= least_r_m) & (r2 >= least_r2), F.lit(False))
    score = F.struct(premium.alias("p"), F.coalesce(novelty, F.lit(0.0)).alias("n"))
    ranked = df.where(valid).select(*keys, F.col(question).alias("__mr_q"), score.alias("__mr_s"))
    best = ranked.groupBy(*keys).agg(F.max("__mr_s").alias("__mr_best"))
    top = ranked.join(best, keys).where("__mr_s = __mr_best")
    return top.groupBy(*keys).agg(F.min("__mr_q").alias(question), F.first("__mr_best.p").alias("premium"))


def experiment_metrics(iterations: DataFrame, seed: str, r_m: str = "avg_r_m", novelty: str = "avg_novelty") -> DataFrame:
    """One row over all iterations: counts, mean and population deviation of ``r_m``, of positive novelties and of depths."""
    x, positive = F.col(r_m), F.when(F.col(novelty) > 0, F.col(novelty))
    per_seed = iterations.groupBy(seed).agg(
        F.count(F.lit(1)).alias("depth"), F.sum(x).alias("__mr_r"), F.sum(x * x).alias("__mr_rr"), F.count(positive).alias("__mr_k"), F.sum(positive).alias("__mr_n"),
    )
    n = F.sum("depth")
    mean = F.try_divide(F.sum("__mr_r"), n)
    return per_seed.agg(
        F.count(F.lit(1)).alias("total_seeds"), n.alias("total_iterations"), mean.alias("mean_r_m"),
        F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.sum("__mr_rr"), n) - mean * mean)).alias("std_r_m"), F.coalesce(F.try_divide(F.sum("__mr_n"), F.sum("__mr_k")), F.lit(0.0)).alias("mean_novelty"),
        F.avg("depth").alias("mean_depth"), F.stddev_pop("depth").alias("std_depth"), F.max("depth").alias("max_depth"),
    )


def question_rates(df: DataFrame, valid: Column, r2: Column, r_m: Column, bound: float = 0.5) -> DataFrame:
    """Shares of questions with a valid format, verified as correct, and solvable."""
    return df.agg(
        F.count(F.lit(1)).alias("total_questions"), _share(valid).alias("format_success_rate"),
        F.try_divide(F.count_if(r2 > bound), F.count(r2)).alias("validity_rate"), _share(r_m > bound).alias("solvability_rate"),
    )


def means_by(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def endings(iterations: DataFrame, seed: str, iteration: str, reason: str) -> DataFrame:
    """One row per seed: its depth, and the number and reason of its last iteration."""
    last = F.max(F.struct(F.col(iteration).alias("i"), F.col(reason).alias("r"))).alias("last")
    out = iterations.groupBy(seed).agg(F.count(F.lit(1)).alias("depth"), last)
    return out.select(seed, "depth", F.col("last.i").alias("last_iteration"), F.col("last.r").alias("reason"))


def failures_by_reason(ends: DataFrame) -> DataFrame:
    """``(reason, count, avg_depth, share)`` over the rows of `endings`."""
    out = ends.groupBy("reason").agg(F.count(F.lit(1)).alias("count"), F.avg("depth").alias("avg_depth"))
    return out.withColumn("share", F.col("count") / out.agg(F.sum("count")).scalar())


def failures_by_iteration(ends: DataFrame, reasons: list[str]) -> DataFrame:
    """``(last_iteration, total, <reason>...)``: a column for each reason, zero where it does not occur."""
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in reasons]
    return ends.groupBy("last_iteration").agg(F.count(F.lit(1)).alias("total"), *counts)


def depth_histogram(ends: DataFrame) -> DataFrame:
    return ends.groupBy("depth").agg(F.count(F.lit(1)).alias("count"))


def question_scores(verdicts: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """One row per question with the means over its verdicts; a question without any has zeros."""
    return verdicts.groupBy(*keys).agg(F.count(scores[0]).alias("n_verdicts"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in scores])


def deep_chains(iterations: DataFrame, seed: str, more_than: int) -> DataFrame:
    """All iterations of the seeds that have more than ``more_than`` of them."""
    deep = iterations.groupBy(seed).count().where(F.col("count") > more_than).select(seed)
    return iterations.join(deep, seed, "left_semi")


def heat_map(df: DataFrame, row: str, column: str, values: list, score: str) -> DataFrame:
    """Mean score as a dense table: a row per ``row``, a column ``s<value>`` per value, null where nothing was measured."""
    return df.groupBy(row).agg(*[F.avg(F.when(F.col(column) == v, F.col(score))).alias(f"s{v}") for v in values])


def score_table(df: DataFrame, name: str, position: str, score: Column) -> DataFrame:
    """``(name, n, score)``: mean score times 100 in two digits; the last row of every set is its summary and is left out."""
    last = df.groupBy(name).agg(F.max(position).alias("__mr_last"))
    rows = df.join(last, name).where(F.col(position) < F.col("__mr_last"))
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score) * 100, 2).alias("score"))


def compare(df: DataFrame, model: str, first: str, second: str, scores: list[str]) -> DataFrame:
    """``(metric, first, second, difference, winner)`` of the mean scores of two models; equal means have winner "tie"."""
    pick = [F.avg(F.when(F.col(model) == m, F.col(c))).alias(f"{c}_{i}") for c in scores for i, m in enumerate((first, second))]
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"{c}_0").alias("first"), F.col(f"{c}_1").alias("second")) for c in scores])
    out = df.agg(*pick).select(F.inline(rows))
    winner = F.when(F.col("first") > F.col("second"), first).when(F.col("second") > F.col("first"), second).otherwise("tie")
    return out.withColumns({"difference": F.abs(F.col("first") - F.col("second")), "winner": winner})


def inverted_index(sets: DataFrame, key: str, items: str) -> DataFrame:
    """``(item, key, n_keys)``: the index in long form, so that a frequent item is not gathered; repeats count once."""
    rows = sets.select(F.explode(F.array_distinct(items)).alias("item"), key).distinct()
    return rows.join(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_keys")), "item")


def set_index(sets: DataFrame, key: str, items: str) -> DataFrame:
    """``(items, n_keys, first_key)`` by distinct set of items, whatever their order."""
    named = sets.select(F.concat_ws("|", F.array_sort(F.array_distinct(items))).alias("items"), key).distinct()
    return named.groupBy("items").agg(F.count(F.lit(1)).alias("n_keys"), F.min(key).alias("first_key"))


def explained_variance(df: DataFrame, returns: Column, values: Column, eps: float = 1e-5) -> DataFrame:
    """``1 - var(returns - values) / (var(returns) + eps)`` with sample variances."""
    return df.agg((1 - F.var_samp(returns - values) / (F.var_samp(returns) + eps)).alias("explained_variance"))


def length_report(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Mean, greatest and least length, and the share of rows that reach ``most``."""
    return df.agg(F.avg(length).alias("mean"), F.max(length).alias("max"), F.min(length).alias("min"), _share(length >= most).alias("clip_ratio"))


def throughput(df: DataFrame, step: str, tokens: Column, seconds: Column, devices: int = 1) -> DataFrame:
    """Per step: tokens, milliseconds per token, and tokens per second and device."""
    out = df.groupBy(step).agg(F.sum(tokens).alias("tokens"), F.max(seconds).alias("seconds"))
    return out.select(
        step, "tokens", F.try_divide(1000 * F.col("seconds"), F.col("tokens")).alias("ms_per_token"), F.try_divide(F.col("tokens"), F.col("seconds") * devices).alias("tokens_per_second")
    )
