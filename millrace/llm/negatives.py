"""Hard-negative mining over inverted lists.

Rows lie in the list of their nearest centroid, fitted by k-means on a bounded sample; a list stores the largest distance of its
rows to the centroid. By Cauchy-Schwarz no row of it scores more with an anchor than the centroid does by the anchor's length
times that radius, and none less than as much below. An anchor visits the lists with the highest bounds first; the k-th
score found there is the mark, and of the other lists those are visited whose bound is not strictly below it. Lists that lie
outside the window of scores are skipped. Nothing that could be in a result is skipped, so the search is exact; scores are integers.

Rows of a list are dealt out in blocks of bounded size, anchors likewise, and a task compares one block with another. The
index is written to the shared folder and deleted once the searches are done.

Defined results: rows with a null key, label or vector, or with a null or non-finite component take no part; rows that
repeat key, label and vector count once; rows that share a key but not the rest are rows of their own, each an anchor if the
key is one, and ordered by a hash of label and vector where score and key tie; vectors of different lengths are not compared;
where fewer rows qualify all of them are returned; a positive with a score below zero has no window and no rows; an empty
table gives an empty result; further columns are not read. A vector of length `LIMIT` or more ends with an error, as
products then do not fit into 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize, new_shared_path, remove_shared

EVERY, SHIFTED, LABELS, SCALE = 100, 7, 10, 256
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST, OF = 30, 90, 100
#: Length of a vector from which products with a window's share could leave 64 bits.
LIMIT = float(1 << 28)
#: Bounds of the fitting sample and of the number of lists.
SAMPLE, LEAST_LISTS, MOST_LISTS, PER_LIST = 8192, 16, 256, 4096
#: Lists that give an anchor its first mark.
FIRST = 2
BLOCK_ROWS, LEAST_ROWS, BLOCK_QUERIES = 4096, 256, 1024
SLACK = 1e-12
ALL = 1 << 61


def participants(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(id, h, label, x, length)``: distinct rows that take part; ``h`` tells rows of one key apart."""
    v, i = F.col(vector).cast("array<double>"), F.col(key).cast("long")
    fine = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    length = F.sqrt(F.aggregate(F.transform(v, lambda x: F.floor(x * SCALE).cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    small = F.forall(v, lambda x: F.abs(x * SCALE) < LIMIT)
    x = F.when(small, F.transform(v, lambda x: F.floor(x * SCALE).cast("int"))).otherwise(F.raise_error(F.lit(f"a vector is {LIMIT:.0f} or longer")))
    own = F.when(i % SHIFTED == 0, (F.col(label).cast("long") + 1) % LABELS).otherwise(F.col(label).cast("long"))
    rows = df.where(i.isNotNull() & F.col(label).isNotNull() & v.isNotNull() & fine).select(i.alias("id"), own.alias("label"), x.alias("x"), F.when(small, length).alias("length"))
    checked = rows.withColumn("length", F.when(F.col("length") < LIMIT, F.col("length")).otherwise(F.raise_error(F.lit(f"a vector is {LIMIT:.0f} or longer"))))
    return checked.withColumn("h", F.xxhash64("label", "x")).dropDuplicates(["id", "h"])


def kmeans(sample: np.ndarray, lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Integer centroids of a sample."""
    x = sample.astype(np.float64)
    c = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        at = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        c = np.stack([x[at == j].mean(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
    return np.unique(np.rint(c).astype(np.int64), axis=0)


@dataclass
class Lists:
    """Inverted lists: ``names`` of those that have rows, ``centroids`` and ``radii`` by list. Vectors of another length than most have a list for each length, around zero."""

    centroids: np.ndarray
    names: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names, centroids, radii of the lists that hold vectors of a length, and their rows."""
        own = self.names >= 0 if dim == self.centroids.shape[1] else self.names == -1 - dim
        names = self.names[own]
        return names, self.centroids[names] if len(names) and names[0] >= 0 else np.zeros((len(names), dim), np.int64), self.radii[own], self.rows[own]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers."""
    longest = [float(np.sqrt((y.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for y in (a, b)]
    kind = np.float64 if longest[0] * longest[1] < 1 << 51 else np.int64  # both exact, the first by fast products
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def lengths(column) -> np.ndarray:
    return np.diff(_whole(column).offsets.to_numpy())


def _whole(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return column


def groups(column):
    """``(row numbers, matrix)`` for each length of the vectors of a column."""
    column = _whole(column)
    sizes = lengths(column)
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        some = column if len(at) == len(column) else column.take(pa.array(at))
        yield at, some.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), dim)


def indexed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``rows`` with their list and the squared distance to its centroid."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_LISTS x dimension integers

    def run(batches):
        c = shared.value
        for batch in batches:
            name, r2 = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for at, x in groups(batch.column("x")):
                if x.shape[1] == c.shape[1]:
                    own = ((c * c).sum(axis=1) - 2 * product(x, c)).argmin(axis=1)
                    name[at], r2[at] = own, ((x - c[own]) ** 2).sum(axis=1)
                else:
                    name[at], r2[at] = -1 - x.shape[1], (x * x).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(name), pa.array(r2)], [*batch.schema.names, "list", "r2"])

    return rows.mapInArrow(run, "id long, h long, label long, x array<int>, list int, r2 long")


def bounds(x: np.ndarray, c: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most and the least that rows of each list can score with each row of ``x``."""
    middle, reach = product(x, c).astype(np.float64), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))[:, None] * radii * (1 + SLACK)
    slack = np.abs(middle) * SLACK + 1e-6
    return middle + reach + slack, middle - reach - slack


ASK = "a long, ah long, label long, x array<int>, list int, p array<int>, lo array<long>, hi array<long>"


def routed(asks: DataFrame, lists, first: bool) -> DataFrame:
    """The lists that each anchor visits, with the windows ``(p, lo, hi)`` that reach into each: the first few by bound, or all the others."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            columns = {n: batch.column(n).to_pylist() for n in ("a", "ah", "label", "p", "lo", "hi")}
            for at, x in groups(batch.column("x")):
                names, c, radii, _ = lists.value.of(x.shape[1])
                most, least = bounds(x, c, radii)
                for k, i in enumerate(at.tolist()):
                    lo, hi, mark = (np.array(y, np.float64)[:, None] for y in (columns["lo"][i], columns["hi"][i], columns["lo"][i]))
                    order = np.argsort(-most[k], kind="stable")
                    over = (most[k] >= mark) & (least[k] <= hi)  # windows x lists
                    # The first lists of a window do not depend on its mark: those with the highest bounds that do not lie above it.
                    reach = (least[k] <= hi)[:, order]
                    ahead = np.zeros_like(over)
                    ahead[:, order] = reach & (np.cumsum(reach, axis=1) <= FIRST)
                    go = over & (ahead if first else ~ahead)
                    for j in np.flatnonzero(go.any(axis=0)).tolist():
                        w = np.flatnonzero(go[:, j]).tolist()
                        row = (columns["a"][i], columns["ah"][i], columns["label"][i], x[k].astype(np.int32), int(names[j]), *([columns[n][i][y] for y in w] for n in ("p", "lo", "hi")))
                        for column, value in zip(out, row):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(y, k) for y, k in zip(out, kinds)], ["a", "ah", "label", "x", "list", "p", "lo", "hi"])

    return asks.select("a", "ah", "label", "x", "p", "lo", "hi").mapInArrow(run, ASK)


def best_of(scores: np.ndarray, ids: np.ndarray, hs: np.ndarray, at: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray:
    """Of the places ``at`` the first ``k`` with scores from ``lo`` to ``hi``: higher scores, then smaller ids."""
    s = scores[at]
    some = np.flatnonzero((s >= lo) & (s <= hi))
    if len(some) > k:
        cut = np.partition(s[some], len(some) - k)[len(some) - k]
        some = some[s[some] >= cut]
    some = at[some]
    return some[np.lexsort((hs[some], ids[some], -scores[some]))][:k]


def visited(index: DataFrame, asks: DataFrame, lists: Lists, k: int, same: bool) -> DataFrame:
    """``(a, ah, p, id, h, score)``: for each block the first ``k`` rows in each window, of the anchor's label or of other labels."""
    asks = materialize(asks)
    visits = {r["list"]: r["count"] for r in asks.groupBy("list").count().collect()}  # a row per list
    size = int(np.clip(lists.rows.mean() if len(lists.rows) else 1, LEAST_ROWS, BLOCK_ROWS))
    pair = [(n, -(-r // size), -(-visits.get(n, 0) // BLOCK_QUERIES)) for n, r in zip(lists.names.tolist(), lists.rows.tolist()) if visits.get(n)]
    spark = index.sparkSession
    # How many blocks a list's rows and its visits are dealt to: a row per list.
    dealt = F.broadcast(spark.createDataFrame(pair, "list int, nb int, nq int"))
    left = index.join(dealt, "list").select("id", "h", F.col("label").alias("own"), "x", "list", F.pmod(F.xxhash64("id", "h"), F.col("nb")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("c"))
    right = asks.join(dealt, "list").withColumn("c", F.pmod(F.xxhash64("a", "ah"), F.col("nq")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).drop("nb", "nq")
    names = ["a", "ah", "p", "id", "h", "score"]

    def compare(rows: pa.Table, asks: pa.Table) -> pa.Table:
        out = [[] for _ in names]
        if len(rows) and len(asks):
            x, q = ((_whole(t["x"]).flatten().to_numpy(zero_copy_only=False).astype(np.int64)).reshape(len(t), -1) for t in (rows, asks))
            scores = product(q, x)
            ids, hs, own = (rows[n].to_numpy() for n in ("id", "h", "own"))
            columns = [asks[n].to_pylist() for n in ("a", "ah", "label", "p", "lo", "hi")]
            for i, (a, ah, label, ps, los, his) in enumerate(zip(*columns)):
                at = np.flatnonzero((own == label) & ((ids != a) | (hs != ah)) if same else own != label)
                for p, lo, hi in zip(ps, los, his):
                    found = best_of(scores[i], ids, hs, at, lo, hi, k)
                    for column, value in zip(out, ([a] * len(found), [ah] * len(found), [p] * len(found), ids[found].tolist(), hs[found].tolist(), scores[i][found].tolist())):
                        column += value
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(y, t) for y, t in zip(out, kinds)], names=names)

    return left.groupBy("list", "b", "c").cogroup(right.groupBy("list", "b", "c")).applyInArrow(compare, "a long, ah long, p int, id long, h long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "ah", "p").orderBy(F.desc("score"), "id", "h")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def searched(index: DataFrame, asks: DataFrame, lists: Lists, k: int, same: bool) -> DataFrame:
    """The first ``k`` rows in every window of ``asks`` ``(a, ah, label, x, p, lo, hi)``: first lists, marks, then all lists that can beat them."""
    shared = asks.sparkSession.sparkContext.broadcast(lists)
    early = materialize(ranked(visited(index, routed(asks, shared, True), lists, k, same), k))
    marks = early.where(F.col("rank") == k).groupBy("a", "ah").agg(F.map_from_entries(F.collect_list(F.struct("p", "score"))).alias("marks"))  # a map of few windows
    raised = F.zip_with("p", "lo", lambda p, lo: F.greatest(lo, F.coalesce(F.element_at("marks", p), lo)))
    again = asks.join(marks, ["a", "ah"], "left").withColumn("lo", F.when(F.col("marks").isNull(), F.col("lo")).otherwise(raised))
    late = visited(index, routed(again, shared, False), lists, k, same)
    return materialize(ranked(early.drop("rank").unionByName(late), k))


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = EVERY) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``."""
    spark = df.sparkSession
    base = new_shared_path(spark, "negatives")
    participants(df, key, vector, label).write.parquet(f"{base}/rows")
    rows = spark.read.parquet(f"{base}/rows")
    dims = {r["d"]: r["count"] for r in rows.groupBy(F.size("x").alias("d")).count().collect()}  # a row per length of a vector
    dim = max(dims, key=lambda d: (dims[d], d), default=0)
    picked = rows.where(F.size("x") == dim).orderBy(F.xxhash64("id", "h"), "id").limit(SAMPLE).select("x").collect()
    wanted = int(np.clip(-(-dims.get(dim, 0) // PER_LIST), LEAST_LISTS, MOST_LISTS))
    centroids = kmeans(np.array([r["x"] for r in picked], np.int64).reshape(len(picked), dim), wanted) if picked else np.zeros((0, dim), np.int64)
    indexed(rows.select("id", "h", "label", "x"), centroids).write.parquet(f"{base}/index")
    index = spark.read.parquet(f"{base}/index")
    found = sorted(index.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("r2").alias("r2")).collect())  # a row per list
    lists = Lists(centroids, np.array([r["list"] for r in found], np.int64), np.sqrt(np.array([r["r2"] for r in found], np.float64)) * (1 + SLACK), np.array([r["n"] for r in found], np.int64))

    anchors = materialize(index.where(F.col("id") % every == 0).select(F.col("id").alias("a"), F.col("h").alias("ah"), "label", "x"))
    whole = anchors.select("*", F.array(F.lit(0)).alias("p"), F.array(F.lit(-ALL)).alias("lo"), F.array(F.lit(ALL)).alias("hi"))
    positives = searched(index, whole, lists, POSITIVES, True)
    window = F.struct(F.col("rank").alias("p"), F.expr(f"(score * {LEAST} + {OF - 1}) DIV {OF}").alias("lo"), F.expr(f"(score * {MOST}) DIV {OF}").alias("hi"))
    windows = positives.where("score >= 0").groupBy("a", "ah").agg(F.collect_list(window).alias("w"))  # POSITIVES at most
    asks = materialize(anchors.join(windows, ["a", "ah"]).select("a", "ah", "label", "x", "w.p", "w.lo", "w.hi"))
    negatives = searched(index, asks, lists, NEGATIVES, False)
    remove_shared(spark, base)
    pairs = positives.select("a", "ah", F.col("rank").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(pairs, ["a", "ah", "p"]).select(
        F.col("a").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def oracle() -> str:
    """Every anchor against every row."""
    return f"""WITH kept AS (
        SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
        FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
      scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0),
      positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES})
      SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
      FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= {OF} * score AND {OF} * score <= {MOST} * positive_score
      QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= {NEGATIVES}"""
