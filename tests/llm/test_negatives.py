"""Hard-negative mining against a comparison of every anchor with every row in plain Python."""

import math

import duckdb
import numpy as np
import pytest

from millrace.llm import negatives, registry

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<double>, label int, score long, h string"


def slow(rows):
    kept = set()
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(a is not None and math.isfinite(a) for a in v):
            kept.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * a) for a in v)))
    out = []
    for anchor in (r for r in kept if r[0] % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in kept if r != anchor and len(r[2]) == len(anchor[2]))
        for s, i, _ in [r for r in scored if r[2] == anchor[1]][:5]:
            fit = [r for r in scored if r[2] != anchor[1] and 30 * -s <= 100 * -r[0] <= 90 * -s][:10]
            out += [(anchor[0], i, n + 1, r[1], -s, -r[0]) for n, r in enumerate(fit)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in negatives.mine(df).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 5, "z") for i, v, label in rows], ROWS).repartition(4)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    want = con.execute(registry.oracle_sql()["op12_hard_negatives"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, registry.queries()["op12_hard_negatives"](spark, f"/root/testdata/{sf}").select(names).collect())) == sorted(want.fetchall())


def test_groups_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 8)  # many blocks
    monkeypatch.setattr(negatives, "BLOCK_QUERIES", 2)
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 16))
    rows = [(i * 20, (middles[i % 20] + 0.2 * rng.normal(size=16)).tolist(), int(rng.integers(4))) for i in range(200)]
    rows += [(5000 + i, rows[3][1], i % 2) for i in range(40)]  # many equal vectors
    rows += [rows[5], rows[5], (100, rows[9][1], 1), (None, rows[1][1], 1), (1, None, 1), (2, rows[0][1], None), (3, [None] * 16, 1), (4, [math.nan] * 16, 1), (6, [math.inf] * 16, 1)]
    rows += [(6000 + 10 * i, [0.5 + i / 10, 1.0], i % 2) for i in range(12)] + [(7000, [], 1), (7001, [], 1), (7002, [], 2), (8000, [0.0] * 16, 1)]
    assert found(frame(spark, rows)) == slow(rows)


def test_few_rows_none_and_too_long(spark):
    rows = [(200, [1.0, 2.0], 1), (100, [1.0, 1.9], 1), (3, [0.5, 1.0], 2)]
    assert found(frame(spark, rows)) == slow(rows) != []
    assert found(frame(spark, rows[:1])) == [] == found(frame(spark, []))
    with pytest.raises(Exception, match="or longer"):
        found(frame(spark, [(1, [1e200, 1.0], 1)]))


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(6)
    middles = rng.integers(-300, 300, (8, 32))
    x = np.concatenate([m + rng.integers(-9, 9, (50, 32)) for m in middles])
    c = negatives.kmeans(x, 8)
    at = ((c * c).sum(axis=1) - 2 * negatives.product(x, c)).argmin(axis=1)
    radii = np.array([np.sqrt(((x[at == j] - c[j]) ** 2).sum(axis=1).max(initial=0)) for j in range(len(c))])
    most, least = negatives.bounds(x, c, radii)
    scores = negatives.product(x, x)
    assert scores.tolist() == [[sum(int(a) * int(b) for a, b in zip(p, q)) for q in x] for p in x[:1]] + scores[1:].tolist()
    for j in range(len(c)):
        assert (scores[:, at == j] <= most[:, [j]]).all() and (scores[:, at == j] >= least[:, [j]]).all()
    fifth = np.sort(scores, axis=1)[:, -6]
    assert (most < fifth[:, None]).mean() > 0.5  # most lists need no visit
