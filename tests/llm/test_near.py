"""Near-dedup by similarity loses no link: families in large and cut bands against all pairs."""

import random

import numpy as np
import pytest

from millrace.llm import near


def all_pairs(texts):
    sets = [set(near.shingles(t.encode()).tolist()) for t in texts]
    out = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both >= near.SIMILARITY * (len(a) + len(sets[j]) - both):
                out.append((i, j))
    return out


def families(seed, n, size, words, changes):
    """Texts of one family differ from their source by some replaced words."""
    rng = random.Random(seed)
    out = []
    for f in range(n):
        source = [f"w{f}x{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            t = list(source)
            for _ in range(rng.choice(changes)):
                t[rng.randrange(words)] = f"n{rng.randrange(10**9)}"
            out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block", [1024, 40])
def test_families_are_whole(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = families(5, 3, 150, 200, [2, 3, 4, 5])  # most pairs lie on both sides of 0.8
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r["id"]: r["component_id"] for r in near.components(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(6)).collect()}
    pairs = all_pairs(texts)
    together = sum(got[i] == got[j] for i, j in pairs)
    assert len(pairs) > 3000 and together >= 0.98 * len(pairs)
    assert all(i // 150 == got[i] // 150 for i in got)


def test_every_likely_pair_of_a_band_is_tried():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    found = []
    for _ in range(120):
        s = base.copy()
        s[rng.choice(300, int(rng.integers(10, 36)), replace=False)] = rng.integers(0, 2**63, 1, dtype=np.uint64)
        found.append(np.unique(s))
    sig = np.stack([near.signature(s) for s in found])
    out = near.across(np.arange(120), sig, np.arange(120), [s.tobytes() for s in found])
    assert all(near.alike(found[a], found[b]) for a, b in out)
    at = list(range(120))
    root = lambda x: x if at[x] == x else root(at[x])
    for a, b in out:
        at[root(a)] = root(b)
    likely = [(i, j) for i in range(120) for j in range(i) if near.alike(found[i], found[j]) and (sig[i] == sig[j]).mean() >= near.LIKELY]
    assert likely and all(root(i) == root(j) for i, j in likely)


def test_trees_span_what_is_likely():
    rng = np.random.default_rng(9)
    sig = np.repeat(rng.integers(0, 2**32, (3, 50), dtype=np.uint32), 40, axis=0)
    sig[rng.random(sig.shape) < 0.1] = 7
    edges = near.tree(sig)
    assert len(edges) == 117 and all(i // 40 == j // 40 for i, j in edges)


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_and_signatures_of_documents_without_a_pair_are_not_shipped(spark, monkeypatch):
    monkeypatch.setattr(near, "MAP_BITS", 1 << 14, raising=False)
    rng = random.Random(4)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(300))) for i in range(1500)]
    rows += [(5000 + i, rows[i][1] + " more") for i in range(20)]
    df = near.materialize(spark.createDataFrame(rows, "doc_id long, text string"))
    before = shuffled(spark)
    got = {r["id"]: r["component_id"] for r in near.components(df).collect()}
    assert all(got[i] == i for i in range(1500)) and all(got[5000 + i] == i for i in range(20))
    assert shuffled(spark) - before < 0.5 * sum(len(t) for _, t in rows)


def test_map_of_asked_documents_loses_none(spark):
    rows = spark.range(-3000, 3000)
    asked = spark.range(-3000, 3000, 20)
    few = {r["id"] for r in near.maybe_asked(rows, asked).collect()}
    assert {r["id"] for r in asked.collect()} <= few and len(few) < 310
    full = {r["id"] for r in near.maybe_asked(rows, asked, 64).collect()}  # nearly all bits are set
    assert {r["id"] for r in asked.collect()} <= full and len(full) > 5000 and near.maybe_asked(rows, asked.limit(0)).count() == 0
