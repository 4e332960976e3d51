"""Reports, bonuses and graph walks by literals: fallbacks, ties, nulls and empty tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from millrace.operators import advantage, filters, graph, reports, select, vectors

SCHEMA = "s long, it long, q long, valid boolean, r2 double, r_m double, nov double"
C = F.col


def steps(df, **more):
    return reports.iteration_summary(df, ["s", "it"], C("valid"), C("r2"), C("r_m"), C("nov"), asked=2, **more)


def test_iterations_end_for_the_first_reason(spark):
    rows = [
        (1, 0, 1, True, 0.9, 0.9, 0.9), (1, 0, 2, True, 0.9, 0.7, 0.5),  # goes on
        (1, 1, 3, False, 0.9, 0.9, 0.9), (1, 1, 4, False, 0.9, 0.9, 0.9),  # nothing valid
        (2, 0, 5, True, 0.9, 0.1, 0.0),  # too hard before it is not novel
        (3, 0, 6, True, 0.9, 0.8, 0.1),
        (4, 0, 7, True, 0.2, 0.8, 0.9),  # verified as wrong
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["s"], r["it"]): r for r in steps(df).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {(1, 0): "continue", (1, 1): "invalid_questions", (2, 0): "too_difficult", (3, 0): "not_novel", (4, 0): "invalid_questions"}
    assert got[1, 0]["num_valid"] == 2 and got[1, 1]["avg_r_m"] == 0.0
    ends = reports.endings(steps(df), "s", "it", "decision")
    assert {r["s"]: (r["depth"], r["last_iteration"]) for r in ends.collect()}[1] == (2, 1)
    assert sum(r["share"] for r in reports.failures_by_reason(ends).collect()) == pytest.approx(1)
    assert {r["s"] for r in reports.deep_chains(steps(df), "s", 1).collect()} == {1}
    none = df.where("s < 0")
    assert not steps(none).collect() and not reports.failures_by_reason(reports.endings(steps(none), "s", "it", "decision")).collect()
    assert reports.experiment_metrics(steps(none), "s").first()["total_seeds"] == 0


def test_best_next_prefers_the_premium_pool(spark):
    rows = [
        (1, 0, 1, True, 0.9, 0.9, 0.2), (1, 0, 2, True, 0.1, 0.1, 0.9), (1, 0, 3, False, 0.9, 0.9, 0.9),
        (2, 0, 5, True, 0.1, 0.9, 0.4), (2, 0, 4, True, None, 0.9, 0.4),  # no premium one; a tie
        (3, 0, 6, True, 0.9, 0.9, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = reports.best_next(df, ["s"], "q", C("valid"), C("r2"), C("r_m"), C("nov")).collect()
    assert {r["s"]: (r["q"], r["premium"]) for r in got} == {1: (1, True), 2: (4, False), 3: (6, True)}


def test_verification(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 0)], "b string, ok int")
    report = reports.verification_report(df, "b", {"ok": C("ok") == 1})
    assert {r["b"]: (r["n"], r["ok_percentage"]) for r in report.collect()} == {"a": (2, 50.0), "unknown": (1, 0.0), None: (3, pytest.approx(100 / 3))}
    assert {r["b"]: r["below"] for r in reports.shortfalls(report, "b", {"ok": 50}).collect()} == {"a": "", "unknown": "ok", None: "ok"}
    assert len(reports.label_breakdown(df, "b", ["ok"]).collect()) == 2


def test_tables_of_scores(spark):
    df = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 0.0), ("m", 2, 9.0), ("k", 0, 1.0)], "name string, i long, x double")
    assert [(r["name"], r["n"], r["score"]) for r in reports.score_table(df, "name", "i", C("x")).collect()] == [("m", 2, 50.0)]
    row = reports.compare(df, "name", "m", "k", ["x"]).first()
    assert row["winner"] == "m" and row["difference"] == pytest.approx(10 / 3 - 1)
    assert reports.heat_map(df, "name", "i", [0, 1], "x").where("name = 'k'").first()["s1"] is None


def test_indexes_and_mapping(spark):
    sets = spark.createDataFrame([(1, ["b", "a", "a"]), (2, ["a", "b"]), (3, ["c"]), (4, [])], "k long, items array<string>")
    assert {(r["item"], r["k"]): r["n_keys"] for r in reports.inverted_index(sets, "k", "items").collect()} == {("a", 1): 2, ("b", 1): 2, ("a", 2): 2, ("b", 2): 2, ("c", 3): 1}
    assert {(r["items"], r["n_keys"], r["first_key"]) for r in reports.set_index(sets, "k", "items").collect()} == {("a|b", 2, 1), ("c", 1, 3), ("", 1, 4)}
    mapping = spark.createDataFrame([("a", "b")], "`from` string, `to` string")
    assert {r["k"]: r["items"] for r in graph.apply_mapping(sets, "k", "items", mapping).collect()} == {1: ["b"], 2: ["b"], 3: ["c"]}


def test_walks_and_bundles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    edges = [*pairs, *[(b, a) for a, b in pairs]]
    df = spark.createDataFrame(edges, "src string, dst string")
    want = {}
    for x, y, z in itertools.product(edges, repeat=3):
        if x[1] == y[0] and y[1] == z[0]:
            want[x[0], z[1]] = want.get((x[0], z[1]), 0) + 1
    assert {(r["src"], r["dst"]): r["paths"] for r in graph.three_hop(df).collect()} == want
    sets = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["lonely"]), (3, [])], "k long, items array<string>")
    got = {r["k"]: r["items"] for r in graph.bundles(sets, "k", "items", df, size=2).collect()}
    assert set(got) == {1, 2} and got[2] == ["lonely"] and 1 <= len(got[1]) <= 2


def test_bonus_and_advantage(spark):
    one = spark.range(1).select(*[F.round(vectors.diversity_bonus(m, F.lit(True), F.lit(0.5), F.lit(1.0), F.lit(0.2)), 6).alias(f"m{m}") for m in range(1, 6)], vectors.diversity_bonus(2, F.lit(False), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("no")).first()
    assert list(one) == [0.0, 0.05, 0.1, 0.11, 0.5, 0.0]
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 99.0, False)], "g string, x double, m boolean")
    got = [round(r["whitened"], 5) for r in advantage.whiten(df, "g", "x", C("m")).orderBy("x").collect()]
    assert got == [-0.70711, 0.70711, 0.0]
    with pytest.raises(ValueError):
        advantage.by_name(df, "other", "g", "x")
    loo = advantage.by_name(df, "rloo", "g", "x").orderBy("x").select("advantage").collect()
    assert loo[0][0] == pytest.approx(1 - 51)


def test_records_and_parts(spark):
    df = spark.createDataFrame([(1, " ", "7", True), (2, "why", "8", True), (3, "no", "9", None)], "q long, cot string, a string, ok boolean")
    assert [tuple(r) for r in filters.sft_rows(df, "q", C("cot"), C("a"), C("ok")).orderBy("q").collect()] == [(1, "\\boxed{7}"), (2, "why")]
    assert tuple(filters.sft_counts(df, C("cot"), C("ok"), C("ok")).first()) == (3, 2, 1, 2, 2)
    rows = [(0, i, n) for i, n in enumerate([9, 8, 7, 1, 1])] + [(1, 9, 4)]
    got = select.partition_batches(spark.createDataFrame(rows, "b long, i long, n long"), "b", "i", "n", 2).collect()
    assert len(got) == 6
    loads = [sum(dict((i, n) for _, i, n in rows)[r["i"]] for r in got if r["b"] == 0 and r["part"] == p) for p in (0, 1)]
    assert sum(loads) == 26 and abs(loads[0] - loads[1]) <= 6
