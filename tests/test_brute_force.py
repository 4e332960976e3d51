"""Queries without SQL against plain Python, stateful streams, readers and the interfaces that callers fill."""

import hashlib
import json
import math
import os
import time
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.functions import grading, models
from millrace.operators import batch, dedup, graph, penalty, select, vote
from millrace.plans import queries as _filled  # noqa: F401
from millrace.plans.registry import QUERIES
from millrace.sources import readers, writers
from millrace.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def embeddings():
    return sorted(pq.read_table(f"{SF}/embeddings.parquet").to_pylist(), key=lambda r: r["vec_id"])


def unit(v):
    x = np.array(v, float)
    return x / np.linalg.norm(x)


def md5_uniform(key):
    import hashlib

    return int(hashlib.md5(f"0:{key}".encode()).hexdigest()[:13], 16) / 16**13


def slow_mmr(rows, most, target=0.75, weight=0.7, bonus=0.1):
    """Picks by definition from ``[(key, vector, score, source)]``."""
    rows, picked = sorted(rows, key=lambda r: r[0]), []
    if len(rows) <= most:
        return [r[0] for r in rows]
    while len(picked) < most:
        best = None
        for r in rows:
            if any(r is p for p in picked):
                continue
            near = max((float(unit(r[1]) @ unit(p[1])) for p in picked), default=0.0)
            share = sum(p[3] == r[3] for p in picked) / max(len(picked), 1)
            value = weight * (1 - abs(r[2] - target)) + (1 - weight) * (1 - near) + bonus * (1 - share)
            if best is None or value > best[0] + 1e-12:
                best = value, r
        picked.append(best[1])
    return [r[0] for r in picked]


def test_mmr(spark, embeddings):
    e = [(r["vec_id"], r["embedding"], md5_uniform(r["vec_id"]), r["vec_id"] % 4, r["label"]) for r in embeddings]
    df = spark.createDataFrame([(k, [float(x) for x in v], s, str(src), c) for k, v, s, src, c in e], "vec_id long, v array<double>, s double, src string, c int")
    for most in (3, 8):
        got = {}
        for r in sorted(select.mmr(df, "c", "vec_id", "v", "s", "src", most).collect(), key=lambda r: r["pick"]):
            got.setdefault(r["c"], []).append(r["vec_id"])
        assert got == {c: slow_mmr([x[:4] for x in e if x[4] == c], most) for c in {x[4] for x in e}}


def test_curation(spark, embeddings):
    e = [(r["vec_id"], unit(r["embedding"]), md5_uniform(r["vec_id"]), r["vec_id"] % 4, r["label"]) for r in embeddings]
    means = {c: np.mean([np.array(r["embedding"], float) for r in embeddings if r["label"] == c], axis=0) for c in {x[4] for x in e}}
    placed = {}
    for x in e:
        if 0.3 <= x[2] <= 0.8:
            placed.setdefault(max(sorted(means), key=lambda c: float(x[1] @ means[c] / np.linalg.norm(means[c]))), []).append(x)
    picked = {}
    for c, rows in placed.items():
        kept = []
        for x in sorted(rows, key=lambda x: x[0]):
            if all(float(x[1] @ k[1]) <= 0.95 for k in kept):
                kept.append(x)
        names = set(slow_mmr([k[:4] for k in kept], 20))
        picked[str(c)] = [k[2] for k in kept if k[0] in names]
    picked["ALL"] = [s for v in picked.values() for s in v]
    got = {r["cluster"]: (r["n"], r["mean_score"], r["std_score"]) for r in QUERIES["curate_full"](spark, SF).collect()}
    assert got.keys() == picked.keys()
    for c, v in picked.items():
        assert got[c][0] == len(v) and abs(got[c][1] - np.mean(v)) < 1e-9 and abs(got[c][2] - np.std(v)) < 1e-9


def test_kmeans_is_a_fixed_point(spark, embeddings):
    got = {r["vec_id"]: r["cluster_id"] for r in QUERIES["kmeans_clusters"](spark, SF).collect()}
    x, label = np.array([r["embedding"] for r in embeddings], float), np.array([got[r["vec_id"]] for r in embeddings])
    means = {c: x[label == c].mean(axis=0) for c in set(label.tolist())}
    names = sorted(means)
    nearest = np.argmin([((x - means[c]) ** 2).sum(axis=1) for c in names], axis=0)
    assert [names[i] for i in nearest] == label.tolist()
    inertia = sum(((x[label == c] - means[c]) ** 2).sum() for c in names)
    assert inertia < ((x - x.mean(axis=0)) ** 2).sum()


def test_vote_by_predicate(spark):
    events = sorted(pq.read_table(f"{SF}/events.parquet").to_pylist(), key=lambda r: r["event_id"])
    want = {}
    for user in {r["user_id"] for r in events}:
        classes = []
        for a in (r["event_type"] for r in events if r["user_id"] == user):
            hit = next((c for c in classes if c[0] == a or "no " in a and "no " in c[0]), None)
            if hit:
                hit[1] += 1
            else:
                classes.append([a, 1])
        best = max(classes, key=lambda c: c[1])
        want[str(user)] = (best[0], best[1], sum(c[1] for c in classes))
    assert {r["group"]: (r["answer"], r["votes"], r["n"]) for r in QUERIES["vote_predicate"](spark, SF).collect()} == want
    rows = [("q", "no real roots", 1), ("q", "No solution", 2), ("q", "5", 3), ("q", " ", 4), ("q", None, 5)]
    (r,) = vote.majority_by(spark.createDataFrame(rows, "g string, a string, o int"), "g", "a", "o", vote.no_rule).collect()
    assert (r["answer"], r["votes"], r["n"]) == ("no real roots", 2, 3)


def test_weighted_draws(spark):
    sizes = Counter(r["source"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist())
    draws = QUERIES["weighted_group_draws"](spark, SF).collect()
    assert sorted(r["draw"] for r in draws) == list(range(200))
    u = {i: int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:13], 16) / 16**13 for i in range(200)}  # draws are keyed by MD5, as their SQL is
    edges, at = [], 0
    for s in sorted(sizes):
        edges.append((at / sum(sizes.values()), (at := at + sizes[s]) / sum(sizes.values()), s))
    assert all(next(s for lo, hi, s in edges if lo <= u[r["draw"]] < hi) == r["source"] for r in draws)


def slow_bleu(h, r):
    if not h:
        return 0.0
    logs = []
    for k in range(1, 5):
        grams = [tuple(h[i : i + k]) for i in range(len(h) - k + 1)]
        other = Counter(tuple(r[i : i + k]) for i in range(len(r) - k + 1))
        hits = sum(min(c, other[g]) for g, c in Counter(grams).items())
        if k == 1 and not hits:
            return 0.0
        logs.append(math.log((hits or 0.1) / max(1, len(grams))))
    return (1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h))) * math.exp(sum(logs) / 4)


def test_bleu_distances():
    texts = [r["text"].split() for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()[:25]] + [[], ["a"], ["a", "b", "a", "b", "a"]]
    d = penalty.distances(texts)
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            assert abs(d[i, j] - (1 - slow_bleu(texts[i], texts[j]))) < 1e-9 and d[j, i] == d[i, j]


def test_partitions(spark):
    docs = {r["doc_id"]: r["n_chars"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    parts = {}
    for r in QUERIES["kk_partition"](spark, SF).collect():
        parts.setdefault(r["batch"], {}).setdefault(r["part"], []).append(docs[r["doc_id"]])
    assert sum(len(m) for p in parts.values() for m in p.values()) == len(docs)
    for p in parts.values():
        loads, largest = [sum(m) for m in p.values()], max(max(m) for m in p.values())
        assert max(loads) - min(loads) <= largest  # no part is ahead by more than one item
    got = {}
    for r in QUERIES["token_budget_batches"](spark, SF).collect():
        got.setdefault(r["batch"], []).append(r)
    for b, rows in got.items():
        size = sum(docs[r["doc_id"]] for r in rows)
        assert len({r["part"] for r in rows}) <= -(-size // 20_000) and sorted(r["position"] for r in rows) == list(range(len(rows)))
        order = sorted(rows, key=lambda r: r["position"])
        assert [r["part"] for r in order] == sorted(r["part"] for r in rows)


def test_concept_specs(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d")]
    e = spark.createDataFrame([*edges, *((y, x) for x, y in edges)], "src string, dst string")
    near = {}
    for x, y in [*edges, *((y, x) for x, y in edges)]:
        near.setdefault(x, set()).add(y)
    sets = spark.createDataFrame([(i, list("abcd")[: 1 + i % 4] + (["lonely"] if i % 5 == 0 else [])) for i in range(60)], "k long, items array<string>")
    given = {r["k"]: set(r["items"]) for r in sets.collect()}
    reach = {1: near}
    for h in (2, 3):
        reach[h] = {x: set().union(*(near[y] for y in reach[h - 1][x])) for x in near}
    modes = Counter()
    for mode in ("explicit", "implicit_2hop", "implicit_3hop", "mixed"):
        rows = graph.specs(sets, "k", "items", e, 3, mode).collect()
        assert len(rows) == 60
        for r in rows:
            new = [x for x in r["items"] if x not in given[r["k"]]]
            assert len(r["items"]) == min(3, len(given[r["k"]])) and len(new) <= 1
            h = graph.HOP_MODES.get(r["hop_mode"])
            if new:
                assert any(new[0] in reach[h].get(x, ()) for x in given[r["k"]])
            modes[r["hop_mode"]] += mode == "mixed"
    assert {"explicit", "implicit_2hop", "implicit_3hop"} <= set(modes) and modes["explicit"] > modes["implicit_3hop"]
    assert len(QUERIES["concept_specs"](spark, SF).collect()) == len({r["user_id"] for r in pq.read_table(f"{SF}/events.parquet").to_pylist()})
    assert graph.bundles(sets, "k", "items", e).count() == 60


def test_growing_dedup_with_accepted(spark):
    rows = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "x", [1.0, 0.1]), (3, "x", [0.0, 1.0]), (4, "y", [1.0, 0.0])], "k long, b string, v array<double>")
    given = spark.createDataFrame([(0, "x", [0.0, 2.0])], "k long, b string, v array<double>")
    got = {r["k"]: r["duplicate"] for r in dedup.against_growing(rows, "k", "v", "b", 0.92, given).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}
    plain = {r["k"]: r["duplicate"] for r in dedup.against_accepted(rows, given, "k", "v", "b").collect()}
    assert plain == {1: False, 2: False, 3: True, 4: False}
    best = dedup.canonical(spark.createDataFrame([("g", "long name", 3), ("g", "b", 3), ("g", "a", 3), ("g", "z", 1)], "g string, n string, c long"), "g", "n", "c").first()
    assert best["canonical"] == "a"
    cleaned = dedup.clean_names(spark.createDataFrame([("GCD", 2), ("gcd", 1), ("x", 1)], "name string, n long"), "name", "n", [("gcd", "gcd")])
    assert dedup.reduction(cleaned, "name").first()["reduction"] == pytest.approx(1 / 3)


# ---- streams


def feed(spark, tmp_path, batches, schema):
    """A stream that reads one file a batch, in order."""
    os.makedirs(f"{tmp_path}/in", exist_ok=True)
    for i, rows in enumerate(batches):
        name = f"{tmp_path}/in/{i}.json"
        with open(name, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.utime(name, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


def drain(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_quota_stream(spark, tmp_path):
    batches = [[{"c": "a", "k": k, "o": -k} for k in range(4)] + [{"c": "b", "k": 9, "o": 0}], [{"c": "a", "k": k, "o": k} for k in (20, 10, 30)], [{"c": "a", "k": 40, "o": 0}, {"c": "b", "k": 5, "o": 0}]]
    stream = feed(spark, tmp_path, batches, "c string, k long, o long")
    got = drain(state.quota_stream(stream, "c", "k", 5, "o"), tmp_path, "quota")
    # The first batch has room for all of a; the second for one, the least in its order; the third for none.
    assert sorted((r["c"], r["k"]) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 10), ("b", 5), ("b", 9)]


def test_quota_stream_does_not_depend_on_frames(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        stream = feed(spark, tmp_path, [[{"c": "a", "k": (k * 37) % 100, "o": 0} for k in range(100)]], "c string, k long, o long")
        got = drain(state.quota_stream(stream, "c", "k", 10), tmp_path, "quota_frames")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r["k"] for r in got) == list(range(10))


def test_first_seen_stream(spark, tmp_path):
    batches = [[{"t": "A b", "at": 0}, {"t": "c", "at": 1}], [{"t": " a  B", "at": 2}, {"t": "d", "at": 1000}], [{"t": "e", "at": 2000}], [{"t": "f", "at": 2000}], [{"t": "D", "at": 2001}]]
    from millrace.functions.text import dedup_key

    schema = "t string, at long"
    plain = drain(state.first_seen_stream(feed(spark, tmp_path / "x", batches, schema), dedup_key(F.col("t"))), tmp_path / "x", "seen")
    assert sorted(dedup_key_of(r["t"]) for r in plain) == ["a b", "c", "d", "e", "f"]
    timed = feed(spark, tmp_path / "y", batches, schema).withColumn("ts", F.timestamp_seconds("at"))
    late = drain(state.first_seen_stream(timed, dedup_key(F.col("t")), "ts", "10 seconds"), tmp_path / "y", "seen_late")
    assert sorted(dedup_key_of(r["t"]) for r in late) == ["a b", "c", "d", "d", "e", "f"]  # the first d's state has gone


def dedup_key_of(t):
    return " ".join(t.lower().split())


def test_restore(spark, tmp_path):
    counts = spark.createDataFrame([(0, 1.5), (1, 2.5)], "cluster_id long, count double")
    for step, df in ((1, counts.withColumn("count", F.lit(9.0))), (2, counts)):
        df = state.step_entry(df, step)
        os.makedirs(f"{tmp_path}/log", exist_ok=True)
        with open(f"{tmp_path}/log/{step}.json", "w") as f:
            f.write(df.toJSON().first())
    got = lambda k: sorted(tuple(r) for r in state.restore_counts(spark, f"{tmp_path}/log", k).collect())
    assert got(2) == [(0, 1.5), (1, 2.5)] and got(3) == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert state.restore_counts(spark, f"{tmp_path}/none", 2).count() == 2


# ---- readers and writers


def test_matrix_by_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MATRIX_BYTES", 4 * 8 * 100)
    m = np.random.default_rng(0).normal(size=(1003, 8)).astype("<f4")
    m.tofile(f"{tmp_path}/m.bin")
    got = sorted((r["index"], r["vector"]) for r in readers.read_matrix(spark, f"file://{tmp_path}/m.bin", 8).collect())
    assert [g[0] for g in got] == list(range(1003)) and np.array_equal(np.array([g[1] for g in got], "<f4"), m)
    assert readers.load_centroids(f"file://{tmp_path}/m.bin", spark, dim=8).count() == 1003
    nested = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), (None,)], "centroids array<array<double>>")
    assert sorted(tuple(r["centroid"]) for r in readers.load_centroids(nested, spark).collect()) == [(1.0, 2.0), (3.0, 4.0)]
    named = spark.createDataFrame([(1, [1.0])], "cluster_id long, centroid array<double>")
    assert readers.load_centroids(named, spark).first()["cluster_id"] == 1
    with pytest.raises(ValueError):
        readers.load_centroids(spark.range(1), spark)


def test_text_readers(spark, tmp_path):
    for name, lines in (("a", ['{"t": "é"}', "", "broken", '{"t": "y"}']), ("b", ['{"t": "z"}'])):
        with open(f"{tmp_path}/{name}.jsonl", "w", encoding="utf-8") as f:
            f.write("\n".join(lines) + "\n")
    rows = readers.read_limited(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl"], "t string", 3)
    assert [(r["t"], r["source_number"]) for r in rows.collect()] == [("é", 0), ("y", 0), ("z", 1)]
    assert [r["t"] for r in readers.read_limited(spark, [f"{tmp_path}/a.jsonl", f"{tmp_path}/b.jsonl"], "t string", 2).collect()] == ["é", "y"]
    writers.write_json(spark.createDataFrame([("ü\nß",)], "t string"), f"{tmp_path}/out")
    assert readers.read_jsonl(spark, f"{tmp_path}/out").first()["t"] == "ü\nß"
    with open(f"{tmp_path}/c.csv", "w") as f:
        f.write('Question,Answer\n"a, ""b""\nc",1\n')
    assert readers.read_csv(spark, f"{tmp_path}/c.csv", "q string, a string").first()["q"] == 'a, "b"\nc'
    df = spark.createDataFrame([("q", "so \\boxed{\\frac{1}{2}}"), ("r", None)], "problem string, solution string")
    assert [r["answer"] for r in readers.seed_rows(df).collect()] == ["\\frac{1}{2}", None]
    first = readers.first_answer_benchmark(spark.createDataFrame([("q", ["1", "2"])], "question string, final_answer array<string>"), repeat=2).collect()
    assert [(r["answer"], r["copy"]) for r in first] == [("1", 1), ("1", 2)]


def test_writers(spark, tmp_path):
    scored = spark.createDataFrame([("a", 0.5, "1"), ("b", 0.9, "2"), ("c", 0.5, "None")], "problem string, score double, answer string")
    writers.publish(scored, f"{tmp_path}/solver", f"{tmp_path}/all")
    assert [r["problem"] for r in spark.read.parquet(f"{tmp_path}/solver").collect()] == ["a"] and spark.read.parquet(f"{tmp_path}/all").count() == 3
    writers.save_clusters(spark.createDataFrame([(1, 0), (2, 0)], "id long, cluster_id long"), spark.createDataFrame([(0, [1.0])], "cluster_id long, centroid array<double>"), f"{tmp_path}/c")
    found = writers.load_clusters(spark, f"{tmp_path}/c")
    assert found["stats"].first()["count"] == 2 and found["assignments"].count() == 2
    for step, loss in ((1, 0.5), (2, 0.25), (2, 0.125)):
        writers.log_metrics(spark.createDataFrame([(loss,)], "loss double"), f"{tmp_path}/m", step)
    assert sorted((r["step"], r["loss"]) for r in writers.read_metrics(spark, f"{tmp_path}/m").collect()) == [(1, 0.5), (2, 0.125)]
    writers.save_batch(scored, f"{tmp_path}/b")
    assert sorted(writers.load_batch(spark, f"{tmp_path}/b").collect()) == sorted(scored.collect())
    named = spark.createDataFrame([("a", "train"), ("b", "test")], "x string, split string")
    named.write.parquet(f"{tmp_path}/named")
    assert [r["x"] for r in readers.read_named(spark, f"{tmp_path}/named@test").collect()] == ["b"]


def test_limit_over_sources_by_file_and_line(spark, tmp_path):
    want, n = [], 0
    for source in "ab":
        (tmp_path / source).mkdir()
        for f in range(3):
            lines = []
            for _ in range(700):
                good = n % 11 != 3
                lines.append('{"t": %d, "pad": "%s"}' % (n, "x" * (n % 90)) if good else "{broken")
                want += [n] if good else []
                n += 1
            (tmp_path / source / f"part-{f}.jsonl").write_text("\n".join(lines) + "\n")
    paths = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "missing")]  # the last is behind the limit and never read
    for split in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            for limit in (1, 1000, 2500):
                got = sorted((r["row"], r["t"]) for r in readers.read_limited(spark, paths, "t long, pad string", limit).collect())
                assert got == list(enumerate(want[:limit]))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


# ---- interfaces


def test_grading_in_time(spark):
    def grade(a, b):
        if a == "slow":
            time.sleep(5)
        return a == b[::-1]

    df = spark.createDataFrame([("ab", "ba"), ("slow", "x"), ("1/2", "0.5"), ("x", "y"), (None, "y")], "a string, b string")
    got = df.select(grading.verified(F.col("a"), F.col("b"), grade, 0.3).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, True, False, False]
    slow = df.select(grading.bounded(grade, 0.3)(F.col("a"), F.col("b")).alias("v")).where("a = 'slow'").collect()
    assert [r["v"] for r in slow] == ["TIMED_OUT"]


def test_embedder(spark):
    def backend(texts):
        if any("bad" in t for t in texts):
            raise TimeoutError
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(t,) for t in ("abc", "bad", None, "x", "")], "t string").coalesce(1)
    got = rows.select("t", models.embedder(backend, 2)(F.col("t")).alias("v")).collect()
    for r in got:
        n = sum(x * x for x in r["v"])
        assert abs(n - (0 if r["t"] in ("bad", None) else 1)) < 1e-9


def test_plugins(spark, tmp_path):
    with open(f"{tmp_path}/mine.py", "w") as f:
        f.write("def score(answers, golds):\n    return [float(a == g) for a, g in zip(answers, golds)]\n\n\ndef one(a, g):\n    return 2.0 * (a == g)\n")
    df = spark.createDataFrame([("a", "a"), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(models.plugin(f"{tmp_path}/mine.py", "score")("x", "y")).collect()] == [1.0, 0.0]
    assert [r[0] for r in df.select(models.plugin(f"{tmp_path}/mine.py", "one", batched=False)("x", "y")).collect()] == [2.0, 0.0]
    with pytest.raises(AttributeError):
        models.plugin(f"{tmp_path}/mine.py", "none")


def test_batch_edges(spark):
    empty = spark.createDataFrame([], "row long")
    assert batch.consistent(empty, "row") and batch.consistent(spark.range(5), "id") and not batch.consistent(spark.range(1, 5), "id")
    assert batch.split_list(empty, 3, ["row"]).count() == 0
    few = batch.split_list(spark.range(2), 5, ["id"]).collect()
    assert sorted(r["part"] for r in few) == [1, 2]
    with pytest.raises(KeyError):
        batch.rename(empty, {"none": "x"})
    rows = spark.createDataFrame([(None, 1), (3, 2), (3, 3), (1, 4)], "v int, k int")
    assert sorted((r["n"], r["k"]) for r in batch.numbered(rows, ["v", "k"], "n").collect()) == [(0, 1), (1, 4), (2, 2), (3, 3)]
