"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token mass is summed by cell of (source, language, topic). Factors by source, language and topic are then fitted in
turn until each marginal of ``mass * factors`` agrees with its target, and documents are sampled with probabilities in
proportion to their cell's factors. Only sums by cell and by value are shuffled, combined before the shuffle, so a
source that holds most rows costs no more than another.

Targets are shares of the observed mass raised to a power (1 keeps the mix, 0 makes it even), or tables that the
caller gives. Sampling compares a hash of the doc_id with the probability: the same documents are drawn under any
partitioning, and equal ids are drawn together. `report` draws a document once at most and after `ROUNDS` rounds, as its
SQL says, so cells whose rate is above 1 fall short of their targets; `sample` fits until the marginals agree within
`TOLERANCE` (targets that the cells cannot meet end it where it stands still, with a warning) and draws a document as many times as its rate says, so that the targets are reached.

Defined results: a null source, language or topic is a value of its own; null and empty texts weigh one token, so
that they can be drawn; a null doc_id is hashed as the empty string; an empty table gives an empty result; further
columns are carried along, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialize

ROUNDS = 5
#: Largest difference of a marginal from its target where the fit of `sample` ends, and its rounds at most.
TOLERANCE, MOST_ROUNDS = 1e-6, 50
#: Powers of the observed shares that make the targets.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Expected share of the token mass in the sample, before `report` cuts probabilities at 1.
FRACTION = 0.6
#: Size up to which the fitted table of cells is broadcast.
BROADCAST_BYTES = 16 << 20
#: Cells up to which, counted, the rounds run in one task each; more are dealt out.
ONE_TASK_CELLS = 50_000
P = "__mr_x_"
DIMENSIONS = ("source", "lang", "topic")

#: Rule table of topics: the first pattern that the text has anywhere gives its topic.
TOPICS = (
    ("legal", r"[Ll]icen[sc]e|[Cc]opyright|[Ww]arrant"),
    ("markup", r"<[A-Za-z/!]|[{}]"),
    ("contact", r"@|https?://"),
    ("figures", r"[0-9]"),
)


def topic_of(text: Column) -> Column:
    out = F.when(text.rlike(TOPICS[0][1]), TOPICS[0][0])
    for name, pattern in TOPICS[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Words of the text, one at least."""
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def weigh(df: DataFrame, text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumns({
        P + "tokens": tokens_of(t), P + "topic": topic_of(t), P + "source": F.coalesce(F.col("source").cast("string"), F.lit("")), P + "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
    })


def fit(weighed: DataFrame, rounds: int = ROUNDS, powers: dict[str, float] | None = None, targets: dict[str, DataFrame] | None = None, tolerance: float | None = None) -> DataFrame:
    """``(source, lang, topic, mass, factor)`` by cell, columns prefixed; ``mass * factor`` sums to 1.

    With ``tolerance``, rounds go on until every marginal is that near to its target, the fit stands still or `MOST_ROUNDS` are over; the last two warn.

    ``targets`` may give tables ``(value, share)`` by dimension; otherwise the shares follow from ``powers``.
    """
    powers = powers or POWERS
    names = [P + d for d in DIMENSIONS]
    cells = weighed.groupBy(*names).agg(F.sum(P + "tokens").cast("double").alias(P + "mass")).withColumn(P + "factor", F.lit(1.0))
    for d in DIMENSIONS:
        if targets and d in targets:
            share = targets[d].select(F.col("value").alias(P + d), F.col("share").cast("double").alias(P + "goal_" + d))
        else:
            sums = cells.groupBy(P + d).agg(F.sum(P + "mass").alias("m"))
            raised = sums.select(P + d, F.pow("m", F.lit(powers[d])).alias("g"))
            share = raised.select(P + d, (F.col("g") / raised.agg(F.sum("g")).scalar()).alias(P + "goal_" + d))
        cells = cells.join(share, P + d)
    cells = materialize(cells)
    if cells.count() <= ONE_TASK_CELLS:  # one partition: the sums and joins of the rounds need no exchange
        cells = cells.coalesce(1)
    gap = None
    for _ in range(rounds if tolerance is None else MOST_ROUNDS):
        before, step = gap, cells.withColumn(P + "gap", F.lit(0.0))
        for d in DIMENSIONS:
            now = step.groupBy(P + d).agg(F.sum(F.col(P + "mass") * F.col(P + "factor")).alias(P + "now"))
            goal = F.col(P + "goal_" + d)
            step = step.join(now, P + d).withColumns({
                P + "gap": F.greatest(F.col(P + "gap"), F.abs(F.col(P + "now") - goal)), P + "factor": F.col(P + "factor") * goal / F.col(P + "now"),
            }).drop(P + "now")
        cells = materialize(step)  # lineage is cut once a round
        if tolerance is not None:
            gap = cells.agg(F.max(P + "gap")).first()[0] or 0.0
        cells = cells.drop(P + "gap")
        if tolerance is not None and (gap <= tolerance or before is not None and 0 <= before - gap <= 1e-3 * gap):
            break
    if tolerance is not None and gap > tolerance:
        warnings.warn(f"marginals differ from their targets by up to {gap}", stacklevel=2)
    return cells.select(*names, P + "mass", P + "factor")


def uniform(key: Column) -> Column:
    """Number in [0, 1) by hash of the key: 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(16**13)


def calibrate(df: DataFrame, key: str = "doc_id", fraction: float = FRACTION, **fitting) -> DataFrame:
    """``df`` with the prefixed columns tokens, topic, factor, probability, rate, sampled and copies.

    ``rate = fraction * all tokens * factor`` and ``probability = min(1, rate)``; ``copies`` is ``rate`` in expectation.
    """
    weighed = weigh(df)
    narrow = materialize(weighed.select(*[P + d for d in DIMENSIONS], P + "tokens").groupBy(*[P + d for d in DIMENSIONS]).agg(F.sum(P + "tokens").alias(P + "tokens")))
    cells = fit(narrow, **fitting)
    total = narrow.agg(F.sum(P + "tokens").cast("double")).scalar()
    rate = F.lit(float(fraction)) * total * F.col(P + "factor")
    rates = cells.select(*[P + d for d in DIMENSIONS], P + "factor", F.least(F.lit(1.0), rate).alias(P + "probability"), rate.alias(P + "rate"))
    # The texts need not be shuffled where the table of cells is small, and it is measured; beyond the bound the optimizer joins by key.
    held = rates.agg(F.coalesce(F.sum(sum((F.octet_length(P + d) for d in DIMENSIONS), F.lit(64))), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    whole = F.floor(P + "rate")
    return weighed.join(rates, [P + d for d in DIMENSIONS]).withColumns({
        P + "sampled": uniform(F.col(key)) < F.col(P + "probability"), P + "copies": (whole + (uniform(F.col(key)) < F.col(P + "rate") - whole).cast("long")).cast("int"),
    })


def report(df: DataFrame) -> DataFrame:
    """One row per document: its weight and whether it is drawn."""
    out = calibrate(df.select("doc_id", "text", "source", "lang"))
    return out.select(
        "doc_id", "source", "lang", F.col(P + "topic").alias("topic"), F.col(P + "tokens").alias("n_tokens"),
        F.round(F.col(P + "probability"), 6).alias("probability"), F.col(P + "sampled").alias("sampled"),
    )


def sample(df: DataFrame) -> DataFrame:
    """The drawn documents, as often as they are drawn, with their own columns only."""
    drawn = calibrate(df, tolerance=TOLERANCE).where(F.col(P + "copies") > 0)
    return drawn.withColumn(P + "copy", F.explode(F.sequence(F.lit(1), F.col(P + "copies")))).select(*df.columns)


def marginals(df: DataFrame, **fitting) -> DataFrame:
    """``(dimension, value, copies, once)``: expected shares of the tokens drawn, with copies (as targeted) and once at most."""
    out = calibrate(df, **({"tolerance": TOLERANCE} | fitting))
    sums = out.groupBy(*[P + d for d in DIMENSIONS]).agg(F.sum(F.col(P + "tokens") * F.col(P + "rate")).alias("c"), F.sum(F.col(P + "tokens") * F.col(P + "probability")).alias("o"))
    sums = materialize(sums)
    c, o = sums.agg(F.sum("c"), F.sum("o")).first()
    parts = [sums.groupBy(F.lit(d).alias("dimension"), F.col(P + d).alias("value")).agg((F.sum("c") / c).alias("copies"), (F.sum("o") / o).alias("once")) for d in DIMENSIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def oracle(rounds: int = ROUNDS) -> str:
    """The same fit in DuckDB SQL, its rounds written out."""
    topic = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE 'prose' END"
    parts = [
        "t AS (SELECT doc_id, source AS s0, lang AS l0, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)",
        f"w AS (SELECT doc_id, s0, l0, source, lang, {topic} AS topic, greatest(1, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS n FROM t)",
        "c AS (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS mass FROM w GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        parts.append(f"g_{d} AS (SELECT {d}, g / sum(g) OVER () AS goal FROM (SELECT {d}, pow(sum(mass), {POWERS[d]}) AS g FROM c GROUP BY {d}))")
    parts.append("r0 AS (SELECT *, 1.0::DOUBLE AS f FROM c)")
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            parts.append(f"r{k + 1} AS MATERIALIZED (SELECT r.source, r.lang, r.topic, mass, f * goal / sum(mass * f) OVER (PARTITION BY r.{d}) AS f FROM r{k} r JOIN g_{d} g ON r.{d} = g.{d})")
            k += 1
    return f"""WITH {', '.join(parts)},
p AS (SELECT source, lang, topic, least(1.0, {FRACTION} * sum(mass) OVER () * f) AS probability FROM r{k})
SELECT doc_id, s0 AS source, l0 AS lang, w.topic, CAST(n AS BIGINT) AS n_tokens, round(probability, 6) AS probability,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / CAST({16**13} AS DOUBLE) < probability AS sampled
FROM w JOIN p ON w.source = p.source AND w.lang = p.lang AND w.topic = p.topic"""
