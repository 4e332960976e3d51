"""Sequential removal, neighbours and similarity groups without a size at which they stop, against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, similar

ROWS = "c long, k long, v array<double>, dim int, o_k long"


def frame(spark, rows):
    return spark.createDataFrame([(c, k, None if v is None else list(map(float, v)), 1, 2) for c, k, v in rows], ROWS).repartition(5)


def cosine(a, b):
    if a is None or b is None or not len(a) or None in list(a) or None in list(b) or not np.any(a) or not np.any(b) or len(a) != len(b):
        return -2.0
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def slow_removed(rows, threshold, accepted=()):
    out, kept = {}, {}
    for c, k, v in accepted:
        kept.setdefault(c, []).append(v)
    for c, k, v in sorted(rows, key=lambda r: r[1]):
        out[k] = any(cosine(v, w) > threshold for w in kept.setdefault(c, []))
        if not out[k]:
            kept[c].append(v)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(9, 12))
    rows = [(int(rng.integers(3)), i, middles[i % 9] + 0.35 * rng.normal(size=12)) for i in range(0, 300, 2)]
    rows += [(0, i, middles[1] + 0.01 * rng.normal(size=12)) for i in range(301, 400, 2)]  # near copies
    rows += [(1, i, middles[2]) for i in range(401, 460, 2)]  # equal vectors
    angle = np.linspace(0, 3, 15)  # a chain: each row is similar to the next ones only
    rows += [(2, 500 + i, np.r_[np.cos(a), np.sin(a), np.zeros(10)]) for i, a in enumerate(angle)]
    return rows + [(0, 900, np.zeros(12)), (0, 901, np.zeros(12)), (0, 902, None), (1, 903, [])]


@pytest.mark.parametrize("block", [None, 16])
def test_removed_equals_the_loop(spark, rows, block):
    threshold = 0.9 if block else 0.97
    got = similar.removed(frame(spark, rows), "c", "k", "v", threshold, block=block)
    assert {r["k"]: r["duplicate"] for r in got.collect()} == slow_removed(rows, threshold)


def test_removed_against_accepted(spark, rows):
    known = [(c, -1 - i, v) for i, (c, _, v) in enumerate(rows[:40:5])]
    got = similar.removed(frame(spark, rows), "c", "k", "v", 0.9, accepted=frame(spark, known), block=16)
    assert {r["k"]: r["duplicate"] for r in got.collect()} == slow_removed(rows, 0.9, known)
    assert similar.removed(frame(spark, []), "c", "k", "v", 0.9).count() == 0


def test_odd_rows_of_removal(spark):
    rows = [(None, 1, [1.0, 0.0]), (None, 2, [1.0, 0.0]), (1, None, [1.0, 0.0]), (1, 3, [float("nan"), 1.0]), (1, 4, [1.0, 0.0]), (1, 5, [1e200, 0.0])]
    got = similar.removed(frame(spark, rows), "c", "k", "v", 0.9).collect()
    assert sorted([(r["c"], r["k"], r["duplicate"]) for r in got], key=str) == sorted([(None, 1, False), (None, 2, False), (1, None, False), (1, 3, False), (1, 4, False), (1, 5, True)], key=str)


def test_neighbours_equal_the_loop(spark, rows):
    few = [r for r in rows if r[1] < 420]
    got = {}
    for r in similar.neighbours(frame(spark, rows), "k", "v", "c", 4, 16).collect():
        got.setdefault(r["k"], []).append((r["rank"], round(r["similarity"], 9)))
    for c, k, v in few[::7]:
        want = sorted((-cosine(v, w) for d, j, w in rows if d == c and j != k and cosine(v, w) > -2))[:4]
        assert sorted(got[k]) == [(i + 1, round(-s, 9)) for i, s in enumerate(want)]


def groups_of(rows, threshold):
    at = {k: k for _, k, _ in rows}
    root = lambda k: k if at[k] == k else root(at[k])
    good = [(k, np.asarray(v) / np.linalg.norm(v)) for _, k, v in rows if v is not None and len(v) and np.any(v)]
    x = np.stack([v for _, v in good])
    for i, j in np.argwhere(np.triu(x @ x.T > threshold, 1)).tolist():
        a, b = sorted((root(good[i][0]), root(good[j][0])))
        at[b] = a
    found = {k: root(k) for k, _ in good}
    return {k: c for k, c in found.items() if list(found.values()).count(c) > 1}


@pytest.mark.parametrize("block", [None, 8])
def test_groups(spark, rows, block):
    got = similar.similar_groups(frame(spark, rows), "k", "v", 0.93, 0.9999, block).collect()
    assert {r["node"]: r["component"] for r in got} == groups_of(rows, 0.93)


@pytest.mark.parametrize("unsure", [0, 100])
def test_pairs_that_short_vectors_leave_open(spark, unsure):
    c = 0.85
    rows = []
    for i in range(60):  # cosines of 0.85 but for a millionth, on both sides, and a sure copy of each end
        e = (-1) ** i * 1e-6
        v, w = np.zeros(64), np.zeros(64)
        v[i], w[i], w[(i + 1) % 64] = 1, c + e, np.sqrt(1 - (c + e) ** 2)
        v, w = (x @ np.linalg.qr(np.random.default_rng(i).normal(size=(64, 64)))[0] for x in (v, w))
        rows += [(0, 4 * i, v), (0, 4 * i + 1, w), (0, 4 * i + 2, v * 1.001 + 1e-3), (0, 4 * i + 3, w)]
    got = similar.links(frame(spark, rows[::2] + rows[1::4]).select("k", "v"), c, 2, 40, unsure=unsure)
    pairs = {tuple(sorted((r["src"], r["dst"]))) for r in got.collect()}
    at = {k: k for _, k, _ in rows}
    root = lambda k: k if at[k] == k else root(at[k])
    for a, b in pairs:
        at[max(root(a), root(b))] = min(root(a), root(b))
    want = groups_of(rows[::2] + rows[1::4], c)
    assert {k for k, g in want.items() if k % 4 == 1} and all(root(k) == g for k, g in want.items())
    assert all(root(k) == k for _, k, _ in rows[::2] + rows[1::4] if k not in want)


def test_trees_of_short_vectors_span_the_links():
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 16)), 30, axis=0) + 0.05 * rng.normal(size=(1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sure, unsure, whole = similar.short_links(np.rint(x * similar.SCALE).astype(np.float32) / similar.SCALE, 0.9, 5000)
    assert whole and len(sure) == 1160 and len({tuple(sorted((i // 30, j // 30))) for i, j in sure.tolist()}) == 40 and not len(unsure)
    assert not similar.short_links(np.eye(20, dtype=np.float32), 0.0, 50)[2]


def test_bytes_a_row_do_not_grow(spark):
    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(True)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    def a_row(n):
        rng, before = np.random.default_rng(5), shuffled()
        similar.similar_groups(spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(n, 64)).tolist())], "k long, v array<double>"), "k", "v", 0.85, 0.99).count()
        return (shuffled() - before) / n

    assert a_row(20_000) < 6_000


def test_recall_of_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    other = 0.852 * base + np.sqrt(1 - 0.852**2) * side  # every pair lies just above the threshold
    rows = [(0, 2 * i, v) for i, v in enumerate(base)] + [(0, 2 * i + 1, v) for i, v in enumerate(other)]
    got = {r["node"]: r["component"] for r in similar.similar_groups(frame(spark, rows), "k", "v", 0.85, 0.95).collect()}
    found = sum(got.get(2 * i) is not None and got.get(2 * i) == got.get(2 * i + 1) for i in range(1500)) / 1500
    assert found >= 0.94  # 0.95 is expected
    bits, bands = similar.bands_for(3000, 0.85, 0.95)
    assert bits == 6 and 1 - (1 - (1 - np.arccos(0.85) / np.pi) ** bits) ** bands >= 0.95


def test_operators_use_them(spark, rows):
    df = frame(spark, rows)
    kept = {r["k"] for r in dedup.greedy_in_cluster(df, "c", "k", "v", 0.9).collect()}
    assert kept == {k for k, gone in slow_removed(rows, 0.9).items() if not gone}
    assert dedup.similarity_groups(df.where(F.col("k") < 0), "k", "v").count() == 0
