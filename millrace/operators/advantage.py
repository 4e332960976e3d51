"""Group-relative analytics (W-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators import scans


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, sample deviation, sum and count joined to every row; combined before the shuffle, so hot groups are cheap."""
    s = df.groupBy(group).agg(F.avg(value).alias("g_mean"), F.stddev_samp(value).alias("g_std"), F.sum(value).alias("g_sum"), F.count(value).alias("g_n"))
    return df.join(s, group)


def z_score(df: DataFrame, group: str, value: str, eps: float = 1e-6) -> DataFrame:
    """W-1; null in groups of one."""
    return group_stats(df, group, value).withColumn("advantage", F.when(F.col("g_n") > 1, (F.col(value) - F.col("g_mean")) / (F.col("g_std") + eps)))


def leave_one_out(df: DataFrame, group: str, value: str) -> DataFrame:
    """W-2; null in groups of one."""
    return group_stats(df, group, value).withColumn("advantage", F.when(F.col("g_n") > 1, F.col(value) - (F.col("g_sum") - F.col(value)) / (F.col("g_n") - 1)))


def discounted(rewards: Column, gamma: float) -> Column:
    """W-3 on an array: the reverse scan ``r_t + gamma * next``, in one pass."""
    r = rewards.cast("array<double>")
    return scans.masked_scan(r, F.transform(r, lambda x: F.lit(1.0)), F.lit(float(gamma)))


def masked_returns(rewards: Column, mask: Column, gamma: float) -> Column:
    """W-3 with the mask: ``r_t + gamma * next``, where what is carried on is 0 behind a masked position; in one pass."""
    return scans.masked_scan(rewards.cast("array<double>"), mask.cast("array<double>"), F.lit(float(gamma)))


def reinforce_plus_plus(df: DataFrame, rewards: str, mask: str, gamma: float = 1.0, eps: float = 1e-8) -> DataFrame:
    """``df`` with ``returns`` and ``advantage``: masked returns whitened over all unmasked positions of the table, by sums alone."""
    out = df.withColumn("returns", masked_returns(F.col(rewards), F.col(mask), gamma))
    flat = out.select(F.explode(F.filter(F.zip_with("returns", mask, lambda r, m: F.when(m != 0, r)), lambda x: x.isNotNull())).alias("x"))
    sums = F.broadcast(flat.agg(F.avg("x").alias("__mr_mean"), F.sqrt(F.var_samp("x") + eps).alias("__mr_std")))  # one row
    whitened = F.zip_with("returns", mask, lambda r, m: (r - F.col("__mr_mean")) / F.col("__mr_std"))
    return out.crossJoin(sums).withColumn("advantage", whitened).drop("__mr_mean", "__mr_std")


def kl_full(log_p: Column, log_q: Column) -> Column:
    """W-6 "full": the sum of ``q * (log q - log p)`` over a position's whole distribution."""
    return F.aggregate(F.zip_with(log_p, log_q, lambda p, q: F.exp(q) * (q - p)), F.lit(0.0), lambda s, x: s + x)


def kl_penalized(score: Column, kl_value: Column, coefficient: float) -> Column:
    """W-6: a token's reward less its weighted divergence."""
    return score - coefficient * kl_value


def gae(df: DataFrame, group: str, order: list, reward: str, value: str, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """W-4: generalized advantage estimates as rows ``(group, t, advantage, return)`` in linear time, for sequences of any length."""
    some = df.select(group, *[c for c in order if c != group], F.col(reward).cast("double").alias("__reward"), F.col(value).cast("double").alias("__value"))
    at = scans.positions(scans.gae(some, group, order, F.col("__reward"), F.col("__value"), gamma, lam), group, order, F.lit(1))
    return at.select(group, (F.col("position") + 1).alias("t"), "advantage", "return")


def kl(log_p: Column, log_q: Column, kind: str = "kl") -> Column:
    """W-6."""
    d = log_p - log_q
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        return F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.exp(-d) + d - 1))
    raise ValueError(kind)


def clipped_policy_loss(log_p: Column, old_log_p: Column, advantage: Column, low: float = 0.2, high: float = 0.2) -> dict[str, Column]:
    """W-7 per row: loss and whether it is clipped."""
    ratio = F.exp(log_p - old_log_p)
    plain, cut = -advantage * ratio, -advantage * F.greatest(F.lit(1 - low), F.least(F.lit(1 + high), ratio))
    return {"loss": F.greatest(plain, cut), "clipped": cut > plain}


def clipped_value_loss(value: Column, old: Column, target: Column, clip: float = 0.5) -> dict[str, Column]:
    cut = F.greatest(old - clip, F.least(old + clip, value))
    a, b = (value - target) * (value - target), (cut - target) * (cut - target)
    return {"loss": 0.5 * F.greatest(a, b), "clipped": b > a}


def response_mask(ids: Column, end: int) -> Column:
    """W-8: 1 up to and with the first end id."""
    at = F.array_position(ids, F.lit(end))
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def position_ids(mask: Column) -> Column:
    """W-9: ``max(cumulative sum - 1, 0)``, in one pass."""
    return scans.running_positions(mask.cast("array<int>"))


def adaptive_kl(kls: Column, start: float, target: float, horizon: float, batch: int) -> Column:
    """W-12: the coefficient after each step's clipped proportional update, folded over an ordered array."""
    return F.aggregate(kls, F.lit(float(start)), lambda c, k: c * (1 + F.greatest(F.lit(-0.2), F.least(F.lit(0.2), k / target - 1)) * batch / horizon))


def warmup_constant(step: Column, warmup: int) -> Column:
    """W-13."""
    return F.least(F.lit(1.0), step / float(max(1, warmup)))


def warmup_cosine(step: Column, warmup: int, total: int, floor: float = 0.0, cycles: float = 0.5) -> Column:
    progress = (step - warmup) / float(max(1, total - warmup))
    wave = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(3.141592653589793 * cycles * 2) * progress)))
    return F.when(step < warmup, step / float(max(1, warmup))).otherwise(floor + (1 - floor) * wave)


#: O-128: names that `by_name` knows.
ESTIMATORS = ("gae", "grpo", "reinforce_plus_plus", "remax", "rloo")


def minus_baseline(value: Column, baseline: Column) -> Column:
    return value - baseline


def whiten(df: DataFrame, group: str, value: str, mask: Column, eps: float = 1e-8) -> DataFrame:
    """``df`` with ``whitened``: values in units of the deviation over the masked rows of the group, 0 outside the mask."""
    kept = F.when(mask, F.col(value))
    stats = df.groupBy(group).agg(F.avg(kept).alias("__mr_mean"), F.var_samp(kept).alias("__mr_var"))
    out = F.when(mask, (F.col(value) - F.col("__mr_mean")) / F.sqrt(F.col("__mr_var") + eps)).otherwise(0.0)
    return df.join(stats, group).withColumn("whitened", out).drop("__mr_mean", "__mr_var")


def by_name(df: DataFrame, kind: str, group: str, value: str, **more) -> DataFrame:
    """``df`` with ``advantage`` by one of the named estimators."""
    if kind == "grpo":
        return z_score(df, group, value)
    if kind == "rloo":
        return leave_one_out(df, group, value)
    if kind == "remax":
        return df.withColumn("advantage", minus_baseline(F.col(value), F.col(more["baseline"])))
    if kind == "gae":
        return gae(df, group, more["order"], value, more["value"], more.get("gamma", 0.99), more.get("lam", 0.95))
    if kind == "reinforce_plus_plus":
        return reinforce_plus_plus(df, value, more["mask"], more.get("gamma", 1.0))
    raise ValueError(f"no estimator is named {kind}; there are {', '.join(ESTIMATORS)}")
