"""Centroid clustering with adaptive distance bounds.

Lloyd rounds on integer vectors. Every vector carries its centroid with an upper bound of the distance to it, its several
next nearest centroids with a lower bound each, and one bound for all the others. A round moves the bounds by how far the
centroids moved: where the upper bound stays strictly below all others the vector is done; where it stays below those from
some place on, only the centroids before that place are measured; else all are. Distances are measured exactly in integers
and bounds are widened by more than their rounding, so the result is that of a full search, ties included. How many bounds
are kept shrinks from a fourth of the centroids to what the last round needed, an eighth at least.

The state is written to the shared folder each round and read by the next; the sums of a cluster change only by the
vectors that changed sides. What the driver holds are the centroids (`k` x ``dim`` integers).

Defined results: vectors that are null, of another length, or hold a null or non-finite component take no part; a null
key is clustered like any other, but does not start a centroid; rows that repeat a key are vectors of their own, and where their
keys tie for a start the smaller vector goes first; with fewer than `k` vectors there are as many centroids; clusters that
become empty keep their centroid and appear in no row; an empty table gives an empty result; further columns are not
read. A component of `LIMIT` or more in absolute value ends with an error, as distances then do not fit into 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize, new_shared_path, remove_shared

K, DIM, ROUNDS, SCALE, SALT = 40, 64, 5, 256, "2:"
#: Components from which squared distances could leave 64 bits.
LIMIT = float(1 << 19)
#: Bounds are widened by this share, thousands of times the rounding of a double.
SLACK = 1e-12
BLOCK = 1024


def integers(df: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """``(id, x)`` of the vectors that take part."""
    v = F.col(vector).cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    small = F.forall(v, lambda x: F.abs(x) < LIMIT)
    x = F.when(small, F.transform(v, lambda x: F.floor(x * scale).cast("int"))).otherwise(F.raise_error(F.lit(f"a component is {LIMIT:.0f} or more")))
    return df.where(v.isNotNull() & fine).select(F.col(key).cast("long").alias("id"), x.alias("x"))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c``, as 64-bit integers."""
    most = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    kind = np.float64 if most * most * max(1, x.shape[1]) < 1 << 52 else np.int64  # both exact, the first by fast products
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)


def above(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) * (1 + SLACK)


def below(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d) * (1 - SLACK)


class Bounds:
    """Bounds of some vectors: ``cluster``, ``upper``, ``near`` and ``lower`` (rows x bounds), ``rest`` for all other centroids, and the bounds ``used``."""

    def __init__(self, x: np.ndarray, c: np.ndarray, kept: int):
        n, kept = len(x), min(kept, max(0, len(c) - 1))
        self.cluster, self.upper, self.rest, self.used = np.zeros(n, np.int32), np.zeros(n), np.full(n, np.inf), np.zeros(n, np.int32)
        self.near, self.lower = np.zeros((n, kept), np.int32), np.zeros((n, kept))
        self.scan(x, c, np.arange(n))

    @classmethod
    def read(cls, batch: pa.RecordBatch, kept: int) -> Bounds:
        """From the columns of a state; bounds above ``kept`` go into the one of the rest."""
        self, n = cls.__new__(cls), batch.num_rows
        flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, kept))
        own = lambda name: batch.column(name).to_numpy(zero_copy_only=False).copy()
        self.cluster, self.upper, self.rest, self.used = own("cluster"), own("upper"), own("rest"), np.zeros(n, np.int32)
        near, lower = flat("near").astype(np.int32), flat("lower").astype(np.float64)
        self.near, self.lower = near[:, :kept].copy(), lower[:, :kept].copy()
        self.rest = np.minimum(self.rest, lower[:, kept:].min(axis=1, initial=np.inf))
        return self

    def scan(self, x: np.ndarray, c: np.ndarray, rows: np.ndarray) -> None:
        """All centroids are measured."""
        kept = self.near.shape[1]
        for at in range(0, len(rows), BLOCK):
            r = rows[at : at + BLOCK]
            d = squared(x[r], c)
            order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
            d = np.take_along_axis(d, order, 1)
            self.cluster[r], self.upper[r] = order[:, 0], above(d[:, 0])
            self.near[r], self.lower[r] = order[:, 1 : kept + 1], below(d[:, 1 : kept + 1])
            self.rest[r] = below(d[:, kept + 1]) if d.shape[1] > kept + 1 else np.inf
        self.used[rows] = kept

    def move(self, x: np.ndarray, c: np.ndarray, drift: np.ndarray) -> None:
        """To centroids that moved by at most ``drift`` each."""
        self.upper = self.upper * (1 + SLACK) + drift[self.cluster] * (1 + SLACK)
        self.lower = self.lower * (1 - SLACK) - drift[self.near] * (1 + SLACK)
        self.rest = self.rest * (1 - SLACK) - drift.max() * (1 + SLACK)
        # What all centroids from a place on are at least away.
        least = np.minimum.accumulate(np.c_[self.lower, self.rest][:, ::-1], axis=1)[:, ::-1]
        todo = np.flatnonzero(self.upper >= least[:, 0])
        for at in range(0, len(todo), BLOCK):
            r = todo[at : at + BLOCK]
            self.upper[r] = above(((x[r] - c[self.cluster[r]]) ** 2).sum(axis=1))
        todo = todo[self.upper[todo] >= least[todo, 0]]
        certain = self.upper[todo, None] < least[todo]
        place = np.where(certain.any(axis=1), certain.argmax(axis=1), -1)
        self.scan(x, c, todo[place < 0])
        for j in np.unique(place[place > 0]).tolist():
            self.reorder(x, c, todo[place == j], j)

    def reorder(self, x: np.ndarray, c: np.ndarray, rows: np.ndarray, j: int) -> None:
        """The own and the first ``j`` other centroids are measured; all others are known to be farther."""
        for at in range(0, len(rows), BLOCK):
            r = rows[at : at + BLOCK]
            some = np.c_[self.cluster[r], self.near[r, :j]]
            d = np.stack([((x[r] - c[some[:, i]]) ** 2).sum(axis=1) for i in range(j + 1)], axis=1)
            order = np.lexsort((some, d), axis=1)
            some, d = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1)
            self.cluster[r], self.upper[r] = some[:, 0], above(d[:, 0])
            self.near[r, :j], self.lower[r, :j] = some[:, 1:], below(d[:, 1:])
        self.used[rows] = j


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


STATE = "id long, x array<int>, was int, cluster int, upper double, near array<int>, lower array<double>, rest double, used int"


def assigned(state: DataFrame, c: np.ndarray, drift: np.ndarray | None, kept: int) -> DataFrame:
    """The state of all vectors with the centroids ``c``; without ``drift`` a first one from ``(id, x)``."""
    shared = state.sparkSession.sparkContext.broadcast((c, drift))  # k x dim integers

    def run(batches):
        c, drift = shared.value
        for batch in batches:
            x = matrix(batch.column("x"), c.shape[1])
            if drift is None:
                was, b = pa.nulls(len(x), pa.int32()), Bounds(x, c, kept)
            else:
                was, b = batch.column("cluster"), Bounds.read(batch, kept)
                b.move(x, c, drift)
            columns = [batch.column("id"), batch.column("x"), was, pa.array(b.cluster, pa.int32()), pa.array(b.upper), lists(b.near, pa.int32()), lists(b.lower, pa.float64()), pa.array(b.rest), pa.array(b.used)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "was", "cluster", "upper", "near", "lower", "rest", "used"])

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, dim: int) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and component sums that each cluster gained since the state before, a row per cluster; both combine before the shuffle."""
    moved = state.where("was IS NULL OR was <> cluster")
    sides = F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign")))
    signed = moved.select(F.explode(sides).alias("s"), "x").where("s.c IS NOT NULL").select("s.c", "s.sign", "x")
    sums = [F.sum(F.col("sign") * F.col("x")[i].cast("long")).alias(f"s{i}") for i in range(dim)]
    return {r["c"]: (r["n"], np.array([r[f"s{i}"] for i in range(dim)], np.int64)) for r in signed.groupBy("c").agg(F.sum("sign").alias("n"), *sums).collect()}


def measured(state: DataFrame, c: np.ndarray) -> DataFrame:
    """``(id, cluster, distance)`` of a state: the exact squared distance to the own centroid."""
    shared = state.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        c = shared.value
        for batch in batches:
            x, cluster = matrix(batch.column("x"), c.shape[1]), batch.column("cluster").to_numpy(zero_copy_only=False)
            d = [((x[at : at + BLOCK] - c[cluster[at : at + BLOCK]]) ** 2).sum(axis=1) for at in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.array(np.concatenate(d) if d else np.zeros(0, np.int64))], ["id", "cluster", "distance"])

    return state.select("id", "x", "cluster").mapInArrow(run, "id long, cluster int, distance long")


def fit(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, dim: int = DIM, rounds: int = ROUNDS, scale: int = SCALE, salt: str = SALT) -> tuple[DataFrame, np.ndarray]:
    """``(id, cluster, distance)`` of every vector, materialized, and the centroids."""
    spark, rows = df.sparkSession, integers(df, key, vector, dim, scale)
    named = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias("h"), "x")
    c = np.array([r["x"] for r in named.orderBy("h", "x").limit(k).collect()], np.int64).reshape(-1, dim)
    if not len(c):
        return spark.createDataFrame([], "id long, cluster int, distance long"), c
    kept, fewest = max(1, len(c) // 4), max(1, len(c) // 8)
    base = new_shared_path(spark, "clusters")
    counts, sums, drift, state = np.zeros(len(c), np.int64), np.zeros_like(c), None, rows
    for step in range(rounds + 1):
        assigned(state, c, drift, kept).write.parquet(f"{base}/{step}")
        state = spark.read.schema(STATE).parquet(f"{base}/{step}")
        if step:
            remove_shared(spark, f"{base}/{step - 1}")
        if step == rounds:
            break
        for i, (n, s) in changes(state, dim).items():
            counts[i], sums[i] = counts[i] + n, sums[i] + s
        moved = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
        drift, c = above(((moved - c) ** 2).sum(axis=1)), moved
        kept = min(kept, max(fewest, state.agg(F.max("used")).first()[0] or 0))
    found = materialize(measured(state, c))
    remove_shared(spark, base)
    return found, c


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", **fitting) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)``: a row per vector."""
    found, c = fit(df, key, vector, **fitting)
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per cluster
    facts = [(i, s, sum(sums.values()), hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, s in sums.items()]
    named = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The rounds written out, over distances to all centroids."""
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    parts = [
        f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{SALT}' || vec_id) AS h, v FROM kept ORDER BY h LIMIT {K}))",
    ]
    for t in range(ROUNDS + 1):
        parts.append(
            f"""a{t} AS (SELECT vec_id, kept.v, c, {dot("kept.v", "kept.v")} - 2 * {dot("kept.v", f"c{t}.v")} + {dot(f"c{t}.v", f"c{t}.v")} AS d FROM kept, c{t}
          QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""
        )
        if t < ROUNDS:
            parts.append(
                f"""m{t} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM
            (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(range({DIM})) AS i, unnest(v) AS x FROM a{t}) GROUP BY c, i) GROUP BY c),
          c{t + 1} AS (SELECT c{t}.c, coalesce(m{t}.v, c{t}.v) AS v FROM c{t} LEFT JOIN m{t} USING (c))"""
            )
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
      SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(list_transform(c{last}.v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
      FROM a{last} JOIN c{last} USING (c)"""
