"""Operators on small literals and by their properties."""

import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import grading, models, rewards, text
from millrace.operators import advantage, batch, dedup, filters, penalty, select, stats, vectors, vote
from millrace.operators.components import connected_components
from millrace.sources import readers, writers
from millrace.streaming import state


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("value,last,first,every", [
    ("none", None, None, []), ("\\boxed{1}", "1", "1", ["1"]), ("\\boxed{1} and \\boxed{\\frac{1}{2}}", "\\frac{1}{2}", "1", ["1", "\\frac{1}{2}"]),
    ("\\boxed{1} \\boxed{2", "1", "1", ["1", ""]), ("\\boxed{}", "", "", [""]), ("\\boxed{a{b{c}}}", "a{b{c}}", "a{b{c}}", ["a{b{c}}"]), (None, None, None, []),
])
def test_boxed(value, last, first, every):
    got = text._boxes(value)
    assert (got[-1] if got else None) == last and (got[0] if got else None) == first and text._boxes(value, True) == every


def test_text_functions(spark):
    assert one(spark, " \\left( 1 \\right) $5$ \\text{A}", text.normalize_a) == "(1)5a"
    assert one(spark, "\\frac{1}{2}", text.normalize_a) == "(1)/(2)" and one(spark, None, text.normalize_a) == ""
    assert one(spark, "Wrong", text.normalize_d) == "WRONG" and one(spark, "$x$ \\cdot  Y", text.normalize_e) == "x y"
    assert one(spark, "score: 0.5", lambda t: text.named_score(t, "score")) == 0.5 and one(spark, "x", lambda t: text.named_score(t, "score")) == 0.0
    assert one(spark, "<Q>a</q><q>b</q>", lambda t: text.tag(t, "q")) == "a" and one(spark, "<q>a</q><q> b </q>", lambda t: text.tag_last(t, "q")) == "b"
    assert one(spark, "<q>open text", lambda t: text.tag_tolerant(t, "q")) == "open text"
    assert one(spark, "The answer is: (B).\nmore", text.bbeh_prediction) == "(b)"
    assert one(spark, "x <|im_start|>user y <|im_start|>assistant \\boxed{7}<|im_end|> \\boxed{8}", text.final_answer) == "7"
    assert one(spark, "a; b|c\n", text.active_concepts) == ["a", "b", "c"]
    assert one(spark, "Héllo,  Wörld_1 ß!", text.dedup_key) == "héllo wörld_1 ß"
    assert one(spark, 'so {"a": "x\\y"} end', lambda t: text.first_json(t, "a string"))["a"] == "x\\y"
    assert one(spark, "Hi {{ who }}, {{ other }}", lambda t: text.render(t, {"who": F.lit("$5 \\n")})) == "Hi $5 \\n, {{ other }}"
    assert one(spark, "rate limit hit", text.is_quota_error) and one(spark, "\\boxed{B}", text.choice_in_box) == "B"
    assert one(spark, "1, 2,,3", text.split_gold) == ["1", "2", "3"]
    assert one(spark, "(1)/(4)", lambda t: grading.equivalent(t, F.lit("0.25"))) and not one(spark, "1/0", lambda t: grading.equivalent(t, F.lit("2")))


def test_rewards(spark):
    assert one(spark, "w " * 25 + "\\boxed{1}", rewards.format_boxed) == 1.0 and one(spark, "\\boxed{1}", rewards.format_boxed) == 0.5 and one(spark, "x", rewards.format_boxed) == 0.0
    assert one(spark, "a <think> b </think> c", rewards.reasoning) == "b" and one(spark, "pre \\boxed{1}", rewards.reasoning) == "pre"
    assert one(spark, "First, x = 5\n\nThen y = 2x", rewards.step_count) == 2
    assert one(spark, "", rewards.length_multiplier) == 0.5 and one(spark, "same words again and more. " * 30, rewards.repetition_multiplier) == 0.3


def test_vote_variants(spark):
    df = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 3), ("q", "a", 4), ("q", "", 5), ("r", None, 1), ("s", "nan", 1)], "q string, a string, o int")
    got = {r["q"]: r for r in vote.majority(df, "q", F.col("a"), ["o"]).collect()}
    assert got["q"]["answer"] == "a" and (got["q"]["votes"], got["q"]["n"]) == (2, 4) and "r" not in got
    assert {r["q"]: r["n"] for r in vote.majority(df, "q", F.col("a"), ["o"], "all").collect()}["q"] == 5
    assert {r["q"]: r["score"] for r in vote.majority(df, "q", F.col("a"), ["o"], empty_is_class=True).collect()}["s"] == 0
    no = spark.createDataFrame([("q", "no solution", 1), ("q", "5", 2), ("q", "No real roots", 3)], "q string, a string, o int")
    (r,) = vote.majority_by(no, "q", "a", "o", vote.no_rule).collect()
    assert (r["answer"], r["votes"], r["n"]) == ("no solution", 2, 3)


def test_greedy_dedup_keeps_the_end_of_a_chain(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.9, 0.436]), (2, 0, [0.62, 0.785])]
    df = spark.createDataFrame(rows, "k long, c int, v array<double>")
    assert sorted(r["k"] for r in dedup.greedy_in_cluster(df, "c", "k", "v", 0.85).collect()) == [0, 2]


def test_mmr_and_quota(spark):
    rows = [(i, i % 2, [float(np.cos(i)), float(np.sin(i))], i / 20, i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, c int, v array<double>, s double, src long")
    assert {r["c"]: r["count"] for r in select.mmr(df, "c", "k", "v", "s", "src", 4).groupBy("c").count().collect()} == {0: 4, 1: 4}
    assert select.mmr(df, "c", "k", "v", "s", "src", 50).count() == 20
    assert max(r["count"] for r in select.quota(df, "c", ["k"], 3).groupBy("c").count().collect()) == 3
    assert select.weighted_draws(spark.createDataFrame([("a", 1), ("b", 3)], "g string, w int"), "g", "w", 400).where("g = 'b'").count() in range(240, 360)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=40), st.integers(1, 6))
def test_partitions_are_complete(lengths, k):
    for parts in (select.balanced_partitions(lengths, k), select.greedy_partitions(lengths, k)):
        assert len(parts) == k and sorted(i for p in parts for i in p) == list(range(len(lengths)))
    if len(lengths) % k == 0:
        assert {len(p) for p in select.balanced_partitions(lengths, k, True)} == {len(lengths) // k}


def test_group_relative(spark):
    df = spark.createDataFrame([(g, float(x)) for g in "ab" for x in (1, 2, 4, 9)] + [("c", 1.0)], "g string, v double")
    z = advantage.z_score(df, "g", "v").groupBy("g").agg(F.sum("advantage").alias("s")).collect()
    assert all(r["s"] is None if r["g"] == "c" else abs(r["s"]) < 1e-9 for r in z)
    assert abs(advantage.leave_one_out(df.where("g = 'a'"), "g", "v").agg(F.sum("advantage")).first()[0]) < 1e-9
    mask = spark.createDataFrame([([5, 7, 2, 9, 2],)], "ids array<int>").select(advantage.response_mask(F.col("ids"), 2).alias("m"))
    assert mask.first()["m"] == [1, 1, 1, 0, 0]
    pos = spark.createDataFrame([([0, 0, 1, 1, 1],)], "m array<int>").select(advantage.position_ids(F.col("m")).alias("p"))
    assert pos.first()["p"] == [0, 0, 0, 1, 2]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components(spark, pairs):
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = {x: x for p in pairs for x in p}
    for _ in range(40):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {k: v for k, v in want.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_batches(spark):
    df = spark.createDataFrame([(i, chr(97 + i)) for i in range(5)], "row long, v string")
    padded = batch.pad_to_divisor(df, 4, "row")
    assert padded.count() == 8 and batch.unpad(padded).count() == 5
    assert [r["v"] for r in batch.repeat(df, 2, "row", False).orderBy("position").collect()] == list("abcdeabcde")
    assert [r["values"] for r in batch.fold(df, 2, "row", "v").orderBy("batch").collect()] == [["a", "b"], ["c", "d"], ["e"]]
    a = spark.createDataFrame([([1, 2, 3],)], "a array<int>").select(batch.pad_array(F.col("a"), 5, 0).alias("r"), batch.pad_array(F.col("a"), 2, 0, True).alias("l")).first()
    assert a["r"] == [1, 2, 3, 0, 0] and a["l"] == [2, 3]
    with pytest.raises(Exception, match="differs"):
        batch.column_union(df, df.withColumn("v", F.lit("z")), "row").collect()
    assert batch.flatten(spark.createDataFrame([((1, (2,)),)], "s struct<x:int,t:struct<y:int>>")).columns == ["s/x", "s/t/y"]
    assert {r["n"] for r in batch.epochs(df, "row", 2, 2).groupBy("epoch").agg(F.count("*").alias("n")).collect()} == {5}


def test_sources(spark, tmp_path):
    (tmp_path / "a_0.json").write_text('[{"problem": "a long enough question"}, {"question": "short"}]')
    (tmp_path / "a_1.json").write_text('{"broken": ')
    got = readers.read_json_questions(spark, str(tmp_path / "a_*.json")).collect()
    assert [(r["question"], r["source"]) for r in got] == [("a long enough question", "a_0")]
    np.arange(12, dtype="<f4").tofile(tmp_path / "m.bin")
    assert [r["vector"] for r in readers.read_matrix(spark, str(tmp_path / "m.bin"), 4).orderBy("index").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    a = spark.createDataFrame([("p", "1", "0.5"), ("q", "None", "0.5"), ("r", "2", "bad"), ("s", " ", "1")], "problem string, answer string, score string")
    b = spark.createDataFrame([("t", "3", 0.7)], "question string, majority_answer string, max_voting_score double")
    assert sorted(r["problem"] for r in readers.pool({"a": a, "b": b}).collect()) == ["p", "t"]
    writers.append_iteration(a, str(tmp_path / "it"), 1)
    writers.append_iteration(a, str(tmp_path / "it"), 2)
    writers.append_iteration(a, str(tmp_path / "it"), 2)
    assert spark.read.parquet(str(tmp_path / "it")).count() == 8
    writers.write_split(a, str(tmp_path / "sp"), "problem", 0.5)
    assert spark.read.parquet(str(tmp_path / "sp")).count() == 4


def test_ema_stream_agrees_with_closed_form(spark, tmp_path):
    rng = random.Random(3)
    rows = [(b, rng.randrange(6)) for b in range(3) for _ in range(20)]
    for b in range(3):
        pd.DataFrame({"b": b, "c": [c for x, c in rows if x == b]}).to_parquet(tmp_path / f"in{b}.parquet")
    stream = spark.readStream.schema("b long, c long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path) + "/in*.parquet")
    q = state.ema_stream(stream, "c", f"{tmp_path}/state", f"{tmp_path}/cp", 8).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["cluster_id"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/state/batch=2").collect()}
    want = {r["cluster_id"]: r["count"] for r in state.ema_closed_form(spark.createDataFrame(rows, "b long, c long"), "b", "c", 8).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_penalty_and_linkage():
    assert penalty.bleu("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0) and penalty.bleu(["x"], ["y"]) == 0.0
    d = np.array([[0, 0.1, 0.9], [0.1, 0, 0.8], [0.9, 0.8, 0]])
    label = penalty.average_linkage(d, 0.5)
    assert label[0] == label[1] != label[2]


def test_share_penalty_of_every_whole_turn(spark):
    from millrace.plans import queries as _filled  # noqa: F401
    from millrace.plans.registry import QUERIES

    rng = random.Random(2)
    words = [[rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in range(30)]
    d = penalty.distances(words)
    assert all(d[i, j] == pytest.approx(1 - penalty.bleu(words[i], words[j])) for i in range(30) for j in range(i + 1, 30))
    sf = "/root/testdata/sf0.001"
    want = sorted((r["conv_id"], r["turn"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect())
    assert sorted((r["conv_id"], r["turn"]) for r in QUERIES["bleu_share_penalty"](spark, sf).collect()) == want
    start = " ".join("same" for _ in range(60))
    rows = [(i, 0, f"{start} " + " ".join(f"w{i}x{k}" for k in range(200))) for i in range(20)] + [(50, 0, None)] * 3
    df = penalty.batches(spark.createDataFrame(rows, "conv_id long, turn int, text string"), ["conv_id", "turn"], "text", 6)
    assert 1 < df.select("batch").distinct().count() <= 4
    got = penalty.share_penalty(df.withColumn("batch", F.lit(0)), "batch", ["conv_id", "turn", "copy"], "text").collect()
    assert len(got) == 23 and len({r["cluster"] for r in got}) == 23  # alike in their first 200 characters only


def test_kmeans_query_fits_as_the_survey_says(spark, monkeypatch):
    from pyspark.ml import clustering

    from millrace.plans import queries as _filled  # noqa: F401
    from millrace.plans.registry import QUERIES

    fits, real = [], clustering.KMeans.fit

    def recorded(self, data):
        fits.append((self.getSeed(), self.getMaxIter()))
        return real(self, data)

    monkeypatch.setattr(clustering.KMeans, "fit", recorded)
    assert QUERIES["kmeans_clusters"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(set(fits)) == 10 and {f[1] for f in fits} == {300}


def test_generator_reports_failures(spark):
    def backend(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    assert [r[0] for r in df.select(models.generator(backend)("p")).collect()] == ["A", None, "C"]


def test_filters_and_stats(spark):
    df = spark.createDataFrame([(0.1, "x"), (0.5, "None"), (0.6, "y"), (None, "z")], "score double, answer string")
    assert filters.score_band(df, 0.1, 0.6).count() == 2 and filters.band_or_all(df, "score", 0.9, 1.0).count() == 4 and filters.band_or_all(df, "score", 0.5, 1.0).count() == 2
    assert stats.unit_histogram(df, F.col("score")).agg(F.sum("n")).first()[0] == 3
    counts = spark.createDataFrame([(i, 5) for i in range(8)], "c int, size long")
    e = stats.entropy(counts, k=8, base=2).first()
    assert abs(e["entropy"] - 3) < 1e-6 and abs(stats.gini(counts).first()["gini"]) < 1e-9


def test_centroid_forms_agree(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    c = vectors.mean_centroids(e, "label", "embedding")
    fast = {r["vec_id"]: (r["cluster_id"], round(r["similarity"], 9)) for r in vectors.assign(e, c, "vec_id", "embedding").collect()}
    monkeypatch.setattr(vectors, "BROADCAST_CENTROIDS", 1)
    assert fast == {r["vec_id"]: (r["cluster_id"], round(r["similarity"], 9)) for r in vectors.assign(e, c, "vec_id", "embedding").collect()}


def test_pad_or_cut(spark):
    from millrace.operators import batch

    df = spark.createDataFrame([([1, 2, 3],), ([1],), ([],), (None,)], "a array<int>")
    got = df.select(batch.pad_or_cut(F.col("a"), 2, 0, True, "left").alias("l"), batch.pad_or_cut(F.col("a"), 2, 0, False, "right").alias("r")).collect()
    assert [tuple(r) for r in got] == [([2, 3], [1, 2]), ([0, 1], [1, 0]), ([0, 0], [0, 0]), (None, None)]
    assert df.where(F.size("a") < 3).select(batch.pad_or_cut(F.col("a"), 2, 0).alias("x")).collect()[0]["x"] == [0, 1]
    with pytest.raises(Exception, match="longer than 2"):
        df.select(batch.pad_or_cut(F.col("a"), 2, 0)).collect()


def test_kmeans_fits_run_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml import clustering

    from millrace.operators import select

    meet, real = threading.Barrier(3, timeout=60), clustering.KMeans.fit

    def met(self, data):
        meet.wait()  # breaks if the fits come one by one
        return real(self, data)

    monkeypatch.setattr(clustering.KMeans, "fit", met)
    df = spark.createDataFrame([(i, [float(i % 3), float(i)]) for i in range(60)], "k long, v array<double>")
    model, out = select.kmeans(df, "v", 3, starts=3, iterations=5)
    assert out.count() == 60 and not meet.broken
