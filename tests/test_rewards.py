"""Rewards that carry state: a stream of many batches equals the table's scan and a plain loop; a repeated batch changes nothing."""

import math
import random

from pyspark.sql import functions as F

from millrace.streaming import rewards

SCHEMA = "id long, b long, c long, s double, w double"


def loop(rows, mode, k=6, alpha=1.0, gamma=0.9):
    counts, out = [alpha] * k, {}
    for b in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == b]
        good = [r for r in own if r[3] is not None and r[3] >= 0.5]
        for r in own:
            out[r[0]] = 0.0
        for i, _, c, s, w in good:
            rare = math.exp(-counts[c] / (sum(counts) / k))
            same = 1.0 if len(good) <= 1 else 1 - (sum(g[2] == c for g in good) - 1) / (len(good) - 1)
            parts = [0.1 * rare, 0.05 * same, 0.05 * w]
            out[i] = 0.0 if mode == 1 else rare if mode == 5 else sum(parts[: mode - 1])
        if good:
            counts = [gamma * n + (1 - gamma) * sum(g[2] == j for g in good) for j, n in enumerate(counts)]
    return out, counts


def made(seed):
    rng = random.Random(seed)
    return [(i, b, rng.choice([0, 0, 0, 1, 2, 4]) if b % 3 else 5, rng.choice([None, rng.random()]), rng.random()) for i, b in enumerate(sorted(rng.randrange(12) for _ in range(300)))]


def test_by_batch_equals_the_loop(spark):
    rows = made(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = rewards.rewards_by_batch(df, "b", "c", F.col("s") >= 0.5, F.col("w"), 6, (1, 2, 3, 4, 5)).collect()
    for mode in (1, 2, 3, 4, 5):
        want, _ = loop(rows, mode)
        assert len(got) == len(rows) and all(abs(r[f"bonus_{mode}"] - want[r["id"]]) < 1e-9 for r in got)
    assert rewards.rewards_by_batch(df.limit(0), "b", "c", F.col("s") >= 0.5, F.col("w"), 6, (2,)).count() == 0


def test_stream_carries_its_state(spark, tmp_path):
    rows = made(2)
    for b in sorted({r[1] for r in rows}):  # a file for each batch, read in order of time
        spark.createDataFrame([r for r in rows if r[1] == b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for mode in (1, 4):
        base = tmp_path / f"m{mode}"

        def started():
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            return rewards.rewards_stream(stream, "c", F.col("s") >= 0.5, F.col("w"), mode, f"{base}/state", f"{base}/out", f"{base}/checkpoint", 6)

        started().trigger(availableNow=True).start().awaitTermination()
        want, counts = loop(rows, mode)
        read = lambda: {r["id"]: r["bonus"] for r in spark.read.parquet(f"{base}/out").collect()}
        first = read()
        assert len(first) == len(rows) and all(abs(first[i] - x) < 1e-9 for i, x in want.items())
        last = max(int(p.name[6:]) for p in (base / "state").iterdir() if p.name.startswith("batch="))
        held = lambda: [r["count"] for r in spark.read.parquet(f"{base}/state/batch={last}").orderBy("cluster_id").collect()]
        assert all(abs(a - b) < 1e-9 for a, b in zip(held(), counts))
        # The last batch is not committed: it runs again, from the state before it.
        for p in (base / "checkpoint/commits").iterdir():
            if p.name in (str(last), f".{last}.crc"):
                p.unlink()
        started().trigger(availableNow=True).start().awaitTermination()
        assert read() == first and all(abs(a - b) < 1e-9 for a, b in zip(held(), counts))
