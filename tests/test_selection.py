"""Linkage by chains against the nearest-pair rule, draws by weight, runs of rows."""

import time

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import penalty, select, vectors


def nearest_pair(d, threshold):
    """The rule as it is stated: the nearest two clusters are joined, of equal ones those that come first."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        near = min((sum(d[x, y] for x in a for y in b) / (len(a) * len(b)), min(a), min(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if min(a) < min(b))
        if near[0] >= threshold:
            break
        groups[near[3]] = groups[near[3]] + groups[near[4]]
        del groups[near[4]]
    label = np.zeros(len(d), int)
    for g in groups:
        label[g] = min(g)
    return label


def test_linkage_equals_the_nearest_pair_rule():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n, steps = int(rng.integers(1, 14)), int(rng.choice([0, 2, 4, 8]))
        d = np.triu(rng.random((n, n)), 1)
        d = np.round(d * steps) / steps if steps else d
        d, threshold = d + d.T, rng.random()
        assert (penalty.average_linkage(d, threshold) == nearest_pair(d, threshold)).all()
    assert len(penalty.average_linkage(np.zeros((0, 0)), 0.5)) == 0


def test_linkage_of_many_texts():
    d = np.triu(np.random.default_rng(1).random((5000, 5000)), 1)
    d = d + d.T
    began = time.process_time()
    penalty.average_linkage(d, 0.5)
    assert time.process_time() - began < 60


def test_draws_follow_the_weights(spark):
    weights = {"a": 1.0, "b": 2.0, "c": 5.0, "none": 0.0, "d": 12.0}
    df = spark.createDataFrame(list(weights.items()), "g string, w double")
    got = {r["g"]: r["count"] for r in select.weighted_draws(df, "g", "w", 20_000, 3).groupBy("g").count().collect()}
    assert sum(got.values()) == 20_000 and "none" not in got
    assert sum((got[g] - w * 1000) ** 2 / (w * 1000) for g, w in weights.items() if w) < 16.3  # chi-square of three degrees, 0.001
    assert select.weighted_draws(df.limit(0), "g", "w", 5).count() == 0


def test_sample_without_replacement(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 4.0).when(F.col("id") % 3 == 1, 1.0).otherwise(0.0).alias("w"))
    got = [r["id"] for r in select.weighted_sample(df, "id", "w", 300, 5).collect()]
    heavy = sum(i % 3 == 0 for i in got)
    assert len(set(got)) == 300 and all(i % 3 < 2 for i in got) and 200 < heavy < 270  # 4 in 5 at first, fewer as they go
    assert select.weighted_sample(df, "id", "w", 5000).count() == 2000


def test_draws_with_examples(spark):
    rows = [(i, "big" if i % 3 else "mid") for i in range(300)] + [(1000, "one")]
    df = spark.createDataFrame(rows, "k long, g string").repartition(4)
    got = {}
    for r in select.draws_with_examples(df, "g", "k", 500, 3, 7).collect():
        got.setdefault((r["draw"], r["g"]), []).append(r["k"])
    of = dict(rows)
    assert len(got) == 500 and all(len(set(v)) == (1 if g == "one" else 3) and all(of[k] == g for k in v) for (_, g), v in got.items())
    assert len({k for v in got.values() for k in v}) > 280  # examples come from the whole group


def test_runs(spark):
    rng = np.random.default_rng(4)
    zero = [bool(x) for x in rng.random(4000) < 0.7]
    zero[1000:2500] = [True] * 1500  # a run over several partitions
    df = spark.createDataFrame(list(enumerate(zero)), "i long, z boolean").repartition(9)
    want, start = [], None
    for i, z in enumerate([*zero, False]):
        if z and start is None:
            start = i
        elif not z and start is not None:
            want.append((start, i - 1, i - start))
            start = None
    assert sorted((r["first"], r["last"], r["length"]) for r in vectors.runs(df, "i", F.col("z")).collect()) == want
    assert vectors.runs(df.limit(0), "i", F.col("z")).count() == 0
