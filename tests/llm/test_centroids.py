"""Centroid clustering with bounds against a full search in plain Python."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from millrace.llm import centroids, registry

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<double>, x array<int>, cluster int, c string"


def slow(rows, k=centroids.K, rounds=centroids.ROUNDS, dim=centroids.DIM):
    kept = [(i, [math.floor(256 * a) for a in v]) for i, v in rows if v is not None and len(v) == dim and all(a is not None and math.isfinite(a) for a in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in named[:k]]
    if not c:
        return []
    for step in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, w)) for w in c] for _, v in kept]
        at = [row.index(min(row)) for row in d]
        if step < rounds:
            for j in range(len(c)):
                own = [v for (_, v), a in zip(kept, at) if a == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own)]
    least = [min(row) for row in d]
    sums = {j: sum(x for x, a in zip(least, at) if a == j) for j in set(at)}
    named = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c]
    return sorted(((i, a, x, sums[a], sum(least), named[a]) for (i, _), a, x in zip(kept, at, least)), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in centroids.cluster(df, **options).collect()), key=str)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = registry.queries()["op11_centroid_clusters"](spark, SF)
    want = con.execute(registry.oracle_sql()["op11_centroid_clusters"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())


def test_groups_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(12, 64))
    rows = [(int(i), (middles[i % 12] + 0.05 * rng.normal(size=64)).tolist()) for i in range(300)]
    rows += [(i, [float(i % 3)] * 64) for i in range(300, 360)]  # many equal vectors: ties, clusters that become empty
    rows += [rows[5], rows[5], (None, rows[7][1]), (7, rows[8][1]), (400, None), (401, []), (402, [0.1] * 63), (403, [None] + [0.1] * 63), (404, [math.nan] * 64), (405, [math.inf] * 64)]
    df = spark.createDataFrame([(i, v, [1], 9, "z") for i, v in rows], ROWS).repartition(5)
    for k in (40, 7, 1):
        assert found(df, k=k) == slow(rows, k=k)


def test_few_vectors_and_none(spark):
    rows = [(i, [i / 10] * 64) for i in range(3)]
    assert found(spark.createDataFrame([(i, v, [1], 9, "z") for i, v in rows], ROWS)) == slow(rows)
    empty = centroids.cluster(spark.createDataFrame([], ROWS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="a component is"):
        centroids.cluster(spark.createDataFrame([(1, [1e200] * 64, [1], 9, "z")], ROWS)).collect()


def test_bounds_certify_and_stay_exact():
    rng = np.random.default_rng(8)
    middles = rng.integers(-400, 400, (30, 64))
    x = np.concatenate([m + rng.integers(-20, 20, (40, 64)) for m in middles])
    c = middles + rng.integers(-30, 30, middles.shape)
    b, measured = centroids.Bounds(x, c, 7), []
    for _ in range(6):
        d = centroids.squared(x, c)
        at = d.argmin(axis=1)
        assert (b.cluster == at).all() and (b.upper**2 >= d[np.arange(len(x)), at] * (1 - 1e-15)).all()
        assert (b.lower <= np.sqrt(np.take_along_axis(d, b.near, 1))).all()
        moved = np.stack([x[at == j].sum(axis=0) // max(1, (at == j).sum()) if (at == j).any() else c[j] for j in range(len(c))])
        drift, c = centroids.above(((moved - c) ** 2).sum(axis=1)), moved
        b.used[:] = 0
        b.move(x, c, drift)
        measured.append((b.used > 0).mean())
    assert measured[-1] < 0.05  # groups that lie apart need no search
    big = rng.integers(-(1 << 27), 1 << 27, (20, 64))
    assert centroids.squared(big, big[:3]).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in big[:3]] for v in big]
