"""Co-occurrence graphs (G-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.rewards import let


def _pairs(items: str):
    """Ordered pairs of the distinct items of a set."""
    return let(
        F.array_sort(F.array_distinct(F.col(items))),
        lambda s: F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: F.struct(x.alias("src"), y.alias("dst"))))),
    )


def cooccurrence(sets: DataFrame, items: str, least: int = 1) -> DataFrame:
    """G-3: symmetric ``(src, dst, weight)`` over pairs within each set, pruned below ``least``.

    Pairs are made within the row of a set, so no join is needed; a set is one record's concepts.
    """
    pair = _pairs(items)
    one = sets.select(F.explode(pair).alias("p")).select(F.col("p.src").alias("a"), F.col("p.dst").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)
    both = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return one.select(both.alias("e"), "weight").select("e.src", "e.dst", "weight")


def two_hop(edges: DataFrame) -> DataFrame:
    """G-4: ``(src, dst, paths)`` over two edges; may return to the start."""
    a, b = edges.select("src", F.col("dst").alias("mid")), edges.select(F.col("src").alias("mid"), "dst")
    return a.join(b, "mid").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("paths"))


def sample_neighbor(edges: DataFrame, seed: int = 0) -> DataFrame:
    """G-4: one neighbour of each node by hash order."""
    return edges.groupBy("src").agg(F.min_by("dst", F.xxhash64("src", "dst", F.lit(seed))).alias("neighbor"))


def induced_density(sets: DataFrame, key: str, items: str, edges: DataFrame) -> DataFrame:
    """G-5: share of the pairs of each set that are edges; 0 for sets of fewer than two."""
    pair = _pairs(items)
    rows = sets.select(key, F.explode_outer(pair).alias("p")).select(key, "p.src", "p.dst")
    hit = edges.select("src", "dst", F.lit(1).alias("hit"))
    return rows.join(hit, ["src", "dst"], "left").groupBy(key).agg(F.coalesce(F.try_divide(F.sum(F.coalesce("hit", F.lit(0))), F.count("src")), F.lit(0.0)).cast("double").alias("density"))


def vocabulary(sets: DataFrame, items: str) -> DataFrame:
    """A-27: number of sets that hold each item."""
    return sets.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def prune(edges: DataFrame, valid: DataFrame, item: str = "item") -> DataFrame:
    """O-34: edges whose ends both are in a vocabulary."""
    v = valid.select(F.col(item).alias("__v"))
    return edges.join(v, F.col("src") == F.col("__v"), "left_semi").join(v, F.col("dst") == F.col("__v"), "left_semi")


def three_hop(edges: DataFrame) -> DataFrame:
    """``(src, dst, paths)``: the number of walks of three steps; walks are counted, not listed, after each step."""
    step = edges.select(F.col("src").alias("__mr_mid"), F.col("dst").alias("__mr_end"))
    near = two_hop(edges)
    return near.join(step, near["dst"] == F.col("__mr_mid")).groupBy("src", F.col("__mr_end").alias("dst")).agg(F.sum("paths").alias("paths"))


def apply_mapping(sets: DataFrame, key: str, items: str, mapping: DataFrame) -> DataFrame:
    """``(key, items)`` with every item replaced by its ``to`` where ``mapping (from, to)`` has one; repeats are dropped."""
    flat = sets.select(key, F.explode(items).alias("from"))
    named = flat.join(mapping, "from", "left").select(key, F.coalesce("to", "from").alias("item")).distinct()
    return named.groupBy(key).agg(F.array_sort(F.collect_list("item")).alias(items))


def bundles(sets: DataFrame, key: str, items: str, edges: DataFrame, size: int = 3, seed: int = 0) -> DataFrame:
    """``(key, items)``: up to ``size`` items of every set by keyed hash, the last of them swapped for a neighbour of it."""
    order = F.array_sort(F.transform(items, lambda x: F.struct(F.xxhash64(F.lit(seed), F.col(key), x).alias("h"), x.alias("x"))))
    picked = sets.select(key, F.slice(F.transform(order, lambda s: s["x"]), 1, size).alias("__mr_p")).where(F.size("__mr_p") > 0)
    last = F.element_at("__mr_p", -1)
    near = sample_neighbor(edges, seed)
    here, there = near.columns[0], near.columns[1]
    joined = picked.join(near.select(F.col(here).alias("__mr_at"), F.col(there).alias("__mr_to")), last == F.col("__mr_at"), "left")
    swapped = F.concat(F.slice("__mr_p", F.lit(1), F.size("__mr_p") - 1), F.array(F.coalesce("__mr_to", last)))
    return joined.select(key, F.array_distinct(swapped).alias(items))


def walk(starts: DataFrame, node: str, edges: DataFrame, hops: str | int, seed: int = 0) -> DataFrame:
    """``starts`` with ``reached``: the end of a walk of as many steps as ``hops`` says, each to a neighbour drawn for the walk
    by hash of its key columns, step and neighbour; null where a node has none. Walks that stand on one node draw from one
    row of candidates each, so the fan-out of a step is a node's degree and is reduced before the next."""
    keys = [c for c in starts.columns if c != node]
    most = hops if isinstance(hops, int) else 3
    out = starts.withColumn("reached", F.col(node))
    if not isinstance(hops, int):
        keys = [c for c in keys if c != hops]
    near = edges.select(F.col("src").alias("__mr_at"), F.col("dst").alias("__mr_to"))
    for step in range(1, most + 1):
        go = F.lit(True) if isinstance(hops, int) else F.col(hops) >= step
        cand = out.where(go & F.col("reached").isNotNull()).join(near, F.col("reached") == F.col("__mr_at"))
        drawn = cand.groupBy(*keys).agg(F.min_by("__mr_to", F.xxhash64(*keys, F.lit(seed), F.lit(step), "__mr_to")).alias("__mr_next"))
        stays = F.lit(False) if isinstance(hops, int) else F.col(hops) < step
        out = out.join(drawn, keys, "left").withColumn("reached", F.when(stays, F.col("reached")).otherwise(F.col("__mr_next"))).drop("__mr_next")
    return out


#: Shares of one, two and three steps in mixed mode.
HOP_RATIOS = (0.5, 0.3, 0.2)
HOP_MODES = {"explicit": 1, "implicit_2hop": 2, "implicit_3hop": 3}


def specs(sets: DataFrame, key: str, items: str, edges: DataFrame, size: int = 4, mode: str = "mixed", ratios=HOP_RATIOS, seed: int = 0) -> DataFrame:
    """G-6: ``(key, items, hop_mode)``: up to ``size`` items of every set drawn by hash, one of which, drawn likewise, is swapped for
    a node one, two or three steps away. Ratios of the mixed mode are normalized; if all are 0, they are even."""
    from millrace.operators.select import hash_uniform

    total = sum(ratios)
    shares = [r / total for r in ratios] if total > 0 else [1 / 3] * 3
    u = hash_uniform(key, F.lit("mode"), seed=seed)
    hops = F.when(u < shares[0], 1).when(u < shares[0] + shares[1], 2).otherwise(3) if mode == "mixed" else F.lit(HOP_MODES.get(mode, 1))
    order = F.array_sort(F.transform(items, lambda x: F.struct(F.xxhash64(F.lit(seed), F.col(key), x).alias("h"), x.alias("x"))))
    picked = sets.select(key, F.slice(F.transform(order, lambda s: s["x"]), 1, size).alias("__mr_p")).where(F.size("__mr_p") > 0)
    at = (F.floor(hash_uniform(key, F.lit("place"), seed=seed) * F.size("__mr_p")) + 1).cast("int")
    picked = picked.select(key, "__mr_p", at.alias("__mr_i"), hops.alias("__mr_hops"))
    there = walk(picked.select(key, "__mr_hops", F.element_at("__mr_p", F.col("__mr_i")).alias("node")), "node", edges, "__mr_hops", seed)
    joined = picked.join(there.select(key, "reached"), key)
    swapped = F.transform("__mr_p", lambda x, i: F.when((i + 1 == F.col("__mr_i")) & F.col("reached").isNotNull(), F.col("reached")).otherwise(x))
    named = F.element_at(F.array(*[F.lit(n) for n in HOP_MODES]), F.col("__mr_hops"))
    return joined.select(key, swapped.alias(items), F.when(F.col("reached").isNotNull(), named).otherwise(F.lit(mode)).alias("hop_mode"))
