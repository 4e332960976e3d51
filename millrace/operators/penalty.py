"""Lexical diversity of a batch: BLEU distances and average-linkage clusters (R-5, R-6)."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Texts of one batch compared pairwise; a batch is one reward call.
MAX_BATCH = 5000
#: Texts expected in a batch where the operator deals them.
BATCH = 512


def bleu(hypothesis: list[str], reference: list[str], n: int = 4, epsilon: float = 0.1) -> float:
    """Sentence BLEU; zero precisions count as ``epsilon`` over their total (smoothing method 1)."""
    if not hypothesis:
        return 0.0
    logs = []
    for k in range(1, n + 1):
        h = Counter(tuple(hypothesis[i : i + k]) for i in range(len(hypothesis) - k + 1))
        r = Counter(tuple(reference[i : i + k]) for i in range(len(reference) - k + 1))
        hits, total = sum(min(c, r[g]) for g, c in h.items()), max(1, sum(h.values()))
        if k == 1 and not hits:
            return 0.0
        logs.append(math.log((hits or epsilon) / total))
    brevity = 1.0 if len(hypothesis) > len(reference) else math.exp(1 - len(reference) / len(hypothesis))
    return brevity * math.exp(sum(logs) / n)


def average_linkage(d: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of average-linkage clustering cut at a distance, by chains of nearest neighbours; a cluster is named by its first text.

    Of equal distances the pair whose names come first is nearer; with that order the chains find the merges of the nearest-pair rule, in
    time quadratic in the texts. Sums of distances are kept, so averages do not depend on the order of merges. A cluster whose
    nearest neighbour is at the threshold or beyond is done.
    """
    n, total = len(d), d.astype(float).copy()
    link, size, label, todo = d.astype(float).copy(), np.ones(n), np.arange(n), np.ones(n, bool)
    np.fill_diagonal(link, np.inf)
    chain: list[int] = []
    while chain or todo.any():
        if not chain:
            chain.append(int(todo.argmax()))
        at = chain[-1]
        near = int(link[at].argmin())  # the first of equal ones
        if link[at, near] >= threshold:
            todo[chain.pop()] = False
            link[at], link[:, at] = np.inf, np.inf
        elif len(chain) > 1 and near == chain[-2]:
            del chain[-2:]
            i, j = sorted((at, near))
            total[i] += total[j]
            total[:, i] = total[i]
            size[i] += size[j]
            merged = np.where(np.isinf(link[i]) | np.isinf(link[j]), np.inf, total[i] / (size[i] * size))
            merged[[i, j]] = np.inf
            link[j], link[:, j] = np.inf, np.inf
            link[i], link[:, i] = merged, merged
            label[label == j], todo[j] = i, False
        else:
            chain.append(near)
    return label


def distances(words: list[list[str]], n: int = 4, epsilon: float = 0.1) -> np.ndarray:
    """``1 - bleu`` of every pair, the earlier text as hypothesis; n-grams are counted once a text and matched by n-gram."""
    size, lengths = len(words), np.array([len(w) for w in words], float)
    logs, none = np.zeros((size, size)), np.zeros((size, size), bool)
    for k in range(1, n + 1):
        found: dict[tuple, list[tuple[int, int]]] = {}
        for i, w in enumerate(words):
            for g, c in Counter(zip(*[w[j:] for j in range(k)])).items():
                found.setdefault(g, []).append((i, c))
        hits = np.zeros((size, size))
        for held in found.values():
            if len(held) > 1:
                at, c = np.array(held).T
                hits[np.ix_(at, at)] += np.minimum.outer(c, c)
        if k == 1:
            none = hits == 0
        logs += np.log(np.where(hits > 0, hits, epsilon) / np.maximum(1, lengths - k + 1)[:, None])
    brevity = np.where(lengths[:, None] > lengths, 0.0, 1 - lengths / np.maximum(1, lengths)[:, None])
    d = np.triu(np.where(none, 1.0, 1 - np.exp(brevity + logs / n)), 1)
    return d + d.T


def batches(df: DataFrame, keys: list[str], text: str, size: int = BATCH) -> DataFrame:
    """``df`` with ``copy``, the number of a row among those of its keys, and ``batch``, a hash modulo the table's size over ``size``."""
    count = max(1, -(-df.count() // size))
    out = df.withColumn("copy", F.row_number().over(Window.partitionBy(*keys).orderBy(text)))
    return out.withColumn("batch", F.pmod(F.xxhash64(*keys, "copy"), F.lit(count)))


def share_penalty(df: DataFrame, batch: str, key: str | list[str], text: str, threshold: float = 0.5) -> DataFrame:
    """R-6: ``(batch, key, cluster, penalty)``, the penalty being the cluster's share of its batch."""
    keys = [key] if isinstance(key, str) else key

    def run(rows: pa.Table) -> pa.Table:
        if len(rows) > MAX_BATCH:
            raise ValueError(f"a batch of {len(rows)} texts; at most {MAX_BATCH}")
        rows = rows.sort_by([(k, "ascending") for k in keys])
        label = average_linkage(distances([(t or "").split() for t in rows["__t"].to_pylist()]), threshold)
        share = np.bincount(label)[label] / len(rows)
        return rows.drop_columns("__t").append_column("cluster", pa.array(label)).append_column("penalty", pa.array(share))

    t = dict(df.dtypes)
    kinds = ", ".join(f"{k} {t[k]}" for k in [batch, *keys])
    return df.select(batch, *keys, F.col(text).cast("string").alias("__t")).groupBy(batch).applyInArrow(run, f"{kinds}, cluster long, penalty double")
