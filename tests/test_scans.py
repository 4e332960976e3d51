"""Scans over long sequences against plain loops, however the sequences are cut into partitions."""

import random
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators import advantage, scans


def rows_of(seed, n=3000):
    rng = random.Random(seed)
    # One group holds most rows, some hold one; a null group; null values.
    return [(rng.choice([7] * 12 + [None, 1, 2, 3, 100 + i]), i, rng.choice([None, rng.random()]), rng.choice([0, 1, 1])) for i in range(n)]


def slow(rows, reverse, step):
    """``{order: (before, after)}`` by a loop over each group."""
    out, last = {}, {}
    for g, i, v, m in sorted(rows, key=lambda r: r[1], reverse=reverse):
        before = last.get(g, 0.0)
        last[g] = step(before, v or 0.0, m)
        out[i] = (before, last[g])
    return out


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("partitions", [1, 16])
def test_affine(spark, reverse, partitions):
    rows = rows_of(partitions)
    df = spark.createDataFrame(rows, "g long, i int, v double, before int").repartition(5)
    got = scans.affine(df, "g", ["i"], 0.9 * F.col("before"), F.col("v"), reverse, partitions).collect()
    want = slow(rows, reverse, lambda before, v, m: v + 0.9 * m * before)
    assert len(got) == len(rows) and all(abs(r["before"] - want[r["i"]][0]) < 1e-9 and abs(r["after"] - want[r["i"]][1]) < 1e-9 for r in got)


def test_returns_and_advantages(spark):
    rows = rows_of(5)
    df = spark.createDataFrame(rows, "g long, i int, v double, m int").na.fill(0.0, ["v"]).repartition(5)
    want = slow(rows, True, lambda run, v, m: (v + 0.9 * run) * m)
    got = scans.discounted(df, "g", ["i"], F.col("v"), 0.9, F.col("m")).collect()
    assert all(abs(r["returns"] - ((r["v"] or 0) + 0.9 * want[r["i"]][0])) < 1e-9 for r in got)
    got = {r["i"]: r for r in scans.gae(df, "g", ["i"], F.col("m"), F.col("v"), 0.99, 0.95).collect()}
    run = {}
    for g, i, v, m in sorted(rows, key=lambda r: -r[1]):
        v, (next_v, next_a) = v or 0.0, run.get(g, (0.0, 0.0))
        a = m + 0.99 * next_v - v + 0.99 * 0.95 * next_a
        run[g] = v, a
        assert abs(got[i]["advantage"] - a) < 1e-9 and abs(got[i]["return"] - a - v) < 1e-9
    at = slow(rows, False, lambda n, v, m: n + m)
    assert all(r["position"] == max(0, at[r["i"]][1] - 1) for r in scans.positions(df, "g", ["i"], F.col("m")).collect())
    assert scans.affine(df.limit(0), "g", ["i"], F.lit(1), F.lit(1)).count() == 0


def test_one_sequence_of_a_million_steps(spark):
    took = []
    for n in (500_000, 1_000_000):
        began = time.monotonic()
        out = scans.discounted(spark.range(n).select(F.lit(1).alias("g"), "id"), "g", ["id"], F.lit(1.0), 0.5)
        (r,) = out.agg(F.count("*").alias("n"), F.sum("returns").alias("s"), F.max_by("returns", "id").alias("last")).collect()
        took.append(time.monotonic() - began)
        assert r["n"] == n and abs(r["s"] - (2 * n - 2)) < 1e-3 and r["last"] == 1.0
    assert took[1] < 4 * took[0] + 5


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1, 0, 1]), ([], []), (None, None)], "r array<double>, m array<int>")
    got = df.select(advantage.discounted(F.col("r"), 0.5).alias("d"), advantage.masked_returns(F.col("r"), F.col("m"), 0.5).alias("w"), advantage.position_ids(F.col("m")).alias("p")).collect()
    assert [tuple(r) for r in got] == [([2.75, 3.5, 3.0], [1.0, 3.5, 3.0], [0, 0, 1]), ([], [], []), (None, None, None)]
    long = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(1_000_000)), lambda x: F.lit(1)).alias("m"))
    assert long.select(F.element_at(advantage.position_ids(F.col("m")), -1)).first()[0] == 999_999
