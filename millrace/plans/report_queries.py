"""Registered queries of the reports, of records and bonuses, and of the remaining graph, advantage and batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import rewards, text
from millrace.operators import advantage, batch, dedup, filters, graph, reports, select, vectors
from millrace.plans.registry import query
from millrace.session import table
from millrace.streaming import rewards as stateful


def r6(c, name):
    return F.round(c, 6).alias(name)


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- traces (events: seed = user, iteration = day, question = event)

TRACE = """WITH q AS (SELECT event_id, user_id, CAST(day(ts) AS BIGINT) AS it, event_type <> 'view' AS valid, value - floor(value) AS r2,
value * 7 - floor(value * 7) AS r_m, value * 3 - floor(value * 3) AS novelty FROM events),
i AS (SELECT user_id, it, CASE WHEN coalesce(avg(r2) FILTER (valid), 0) > 0.4 THEN count(*) FILTER (valid) ELSE 0 END AS num_valid, count(*) FILTER (valid AND r_m > 0.4) AS num_solvable,
coalesce(avg(r_m) FILTER (valid), 0) AS avg_r_m, coalesce(avg(novelty) FILTER (valid), 0) AS avg_novelty FROM q GROUP BY ALL),
s AS (SELECT *, CASE WHEN num_valid < 1 THEN 'invalid_questions' WHEN avg_r_m < 0.4 THEN 'too_difficult' WHEN avg_novelty < 0.3 THEN 'not_novel' ELSE 'continue' END AS decision FROM i),
n AS (SELECT user_id, count(*) AS depth, max(it) AS last_iteration, arg_max(decision, it) AS reason FROM s GROUP BY 1)
"""


def trace(s, d):
    v = F.col("value")
    return table(s, d, "events").select(
        "event_id", "user_id", F.day("ts").cast("long").alias("it"), (F.col("event_type") != "view").alias("valid"),
        (v - F.floor(v)).alias("r2"), (v * 7 - F.floor(v * 7)).alias("r_m"), (v * 3 - F.floor(v * 3)).alias("novelty"),
    )


def iterations(s, d):
    c = F.col
    return reports.iteration_summary(trace(s, d), ["user_id", "it"], c("valid"), c("r2"), c("r_m"), c("novelty"), asked=2, validity=0.4, solvability=0.4)


def ends(s, d):
    return reports.endings(iterations(s, d), "user_id", "it", "decision")


@query("iteration_decision", TRACE + "SELECT user_id, it, num_valid, num_solvable, round(avg_r_m, 6) AS avg_r_m, round(avg_novelty, 6) AS avg_novelty, decision FROM s")
def iteration_decision(s, d):
    return rounded(iterations(s, d), "avg_r_m", "avg_novelty")


@query("best_next_question", TRACE + "SELECT user_id, it, event_id, premium FROM (SELECT user_id, it, event_id, r_m >= 0.6 AND r2 >= 0.7 AS premium, row_number() OVER (PARTITION BY user_id, it ORDER BY r_m >= 0.6 AND r2 >= 0.7 DESC, novelty DESC, event_id) AS k FROM q WHERE valid) WHERE k = 1")
def best_next(s, d):
    c = F.col
    return reports.best_next(trace(s, d), ["user_id", "it"], "event_id", c("valid"), c("r2"), c("r_m"), c("novelty"))


@query("experiment_metrics", TRACE + "SELECT (SELECT count(*) FROM n) AS total_seeds, count(*) AS total_iterations, round(avg(avg_r_m), 6) AS mean_r_m, round(stddev_pop(avg_r_m), 6) AS std_r_m, round(avg(avg_novelty) FILTER (avg_novelty > 0), 6) AS mean_novelty, (SELECT round(avg(depth), 6) FROM n) AS mean_depth, (SELECT round(stddev_pop(depth), 6) FROM n) AS std_depth, (SELECT max(depth) FROM n) AS max_depth FROM s")
def experiment(s, d):
    return rounded(reports.experiment_metrics(iterations(s, d), "user_id"), "mean_r_m", "std_r_m", "mean_novelty", "mean_depth", "std_depth")


@query("question_rates", TRACE + "SELECT count(*) AS total_questions, round(avg(valid::INT), 6) AS format_success_rate, round(avg((r2 > 0.5)::INT), 6) AS validity_rate, round(avg((r_m > 0.5)::INT), 6) AS solvability_rate FROM q")
def rates(s, d):
    out = reports.question_rates(trace(s, d), F.col("valid"), F.col("r2"), F.col("r_m"))
    return rounded(out, "format_success_rate", "validity_rate", "solvability_rate")


@query("per_iteration_means", TRACE + "SELECT it, round(avg(avg_r_m), 6) AS avg_r_m, round(avg(avg_novelty), 6) AS avg_novelty FROM s GROUP BY 1")
def per_iteration(s, d):
    return rounded(reports.means_by(iterations(s, d), "it", ["avg_r_m", "avg_novelty"]), "avg_r_m", "avg_novelty")


@query("failures_by_reason", TRACE + "SELECT reason, count(*) AS count, round(avg(depth), 6) AS avg_depth, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM n GROUP BY 1")
def by_reason(s, d):
    return rounded(reports.failures_by_reason(ends(s, d)), "avg_depth", "share")


REASONS = ["invalid_questions", "too_difficult", "not_novel", "continue"]


@query("failures_by_iteration", TRACE + "SELECT last_iteration, count(*) AS total, " + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in REASONS) + " FROM n GROUP BY 1")
def by_iteration(s, d):
    return reports.failures_by_iteration(ends(s, d), REASONS)


@query("depth_histogram", TRACE + "SELECT depth, count(*) AS count FROM n GROUP BY 1")
def depths(s, d):
    return reports.depth_histogram(ends(s, d))


@query("question_scores", TRACE + "SELECT user_id, it, count(r2) AS n_verdicts, round(avg(r2), 6) AS mean_r2, round(avg(r_m), 6) AS mean_r_m FROM q GROUP BY ALL")
def question_scores(s, d):
    return rounded(reports.question_scores(trace(s, d), ["user_id", "it"], ["r2", "r_m"]), "mean_r2", "mean_r_m")


@query("deep_chains", TRACE + "SELECT user_id, it, num_valid, decision FROM s WHERE user_id IN (SELECT user_id FROM n WHERE depth > 26)")
def deep(s, d):
    return reports.deep_chains(iterations(s, d), "user_id", 26).select("user_id", "it", "num_valid", "decision")


@query("concept_heat_map", TRACE + "SELECT user_id, " + ", ".join(f"round(avg(r_m) FILTER (it = {i}), 6) AS s{i}" for i in range(1, 32)) + " FROM q GROUP BY 1")
def heat(s, d):
    return rounded(reports.heat_map(trace(s, d), "user_id", "it", list(range(1, 32)), "r_m"), *[f"s{i}" for i in range(1, 32)])


@query("dataset_score_table", TRACE + "SELECT user_id, count(*) AS n, round(avg(valid::INT) * 100, 2) AS score FROM q WHERE (user_id, event_id) NOT IN (SELECT (user_id, max(event_id)) FROM q GROUP BY user_id) GROUP BY 1")
def score_table(s, d):
    return reports.score_table(trace(s, d), "user_id", "event_id", F.col("valid").cast("int"))


@query("model_comparison", "WITH m AS (SELECT avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'purchase') AS b FROM events) SELECT 'value' AS metric, round(a, 6) AS first, round(b, 6) AS second, round(abs(a - b), 6) AS difference, CASE WHEN a > b THEN 'click' WHEN b > a THEN 'purchase' ELSE 'tie' END AS winner FROM m")
def comparison(s, d):
    return rounded(reports.compare(table(s, d, "events"), "event_type", "click", "purchase", ["value"]), "first", "second", "difference")


# ---- verdicts (labels by source of the document)

VERDICTS = "WITH v AS (SELECT source, quality, toxic FROM documents JOIN labels USING (doc_id)), r AS (SELECT source, count(*) AS n, 100 * avg((quality = 1)::INT) AS a, 100 * avg((toxic = 0)::INT) AS b FROM v GROUP BY ROLLUP (source)) "


def verdicts(s, d):
    return table(s, d, "documents").select("doc_id", "source").join(table(s, d, "labels"), "doc_id")


def verdict_report(s, d):
    return reports.verification_report(verdicts(s, d), "source", {"valid": F.col("quality") == 1, "safe": F.col("toxic") == 0})


@query("verification_report", VERDICTS + "SELECT source, n, round(a, 6) AS valid_percentage, round(b, 6) AS safe_percentage FROM r")
def verification(s, d):
    return rounded(verdict_report(s, d), "valid_percentage", "safe_percentage")


@query("verification_shortfalls", VERDICTS + "SELECT source, concat_ws(',', CASE WHEN a < 85 THEN 'valid' END, CASE WHEN b < 95 THEN 'safe' END) AS below FROM r")
def shortfalls(s, d):
    return reports.shortfalls(verdict_report(s, d), "source", {"valid": 85, "safe": 95})


@query("label_breakdown", VERDICTS + "SELECT source, 'quality' AS label, quality::VARCHAR AS value, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT source, 'toxic', toxic::VARCHAR, count(*) FROM v GROUP BY ALL")
def breakdown(s, d):
    return reports.label_breakdown(verdicts(s, d), "source", ["quality", "toxic"])


# ---- measures of training steps (events: step = day, tokens = characters of the properties)


@query("explained_variance", "SELECT round(1 - var_samp(value - (value - floor(value))) / (var_samp(value) + 1e-5), 6) AS explained_variance FROM events")
def explained(s, d):
    v = F.col("value")
    return rounded(reports.explained_variance(table(s, d, "events"), v, v - F.floor(v)), "explained_variance")


@query("length_report", "SELECT round(avg(length(text)), 6) AS mean, max(length(text))::BIGINT AS max, min(length(text))::BIGINT AS min, round(avg((length(text) >= 2000)::INT), 6) AS clip_ratio FROM documents")
def lengths(s, d):
    return rounded(reports.length_report(table(s, d, "documents"), F.length("text").cast("long"), 2000), "mean", "clip_ratio")


@query("throughput", "SELECT day(ts)::BIGINT AS step, sum(length(props))::BIGINT AS tokens, round(1000 * max(value) / sum(length(props)), 6) AS ms_per_token, round(sum(length(props)) / (max(value) * 8), 6) AS tokens_per_second FROM events GROUP BY 1")
def throughput(s, d):
    e = table(s, d, "events").select(F.day("ts").cast("long").alias("step"), F.length("props").cast("long").alias("t"), "value")
    return rounded(reports.throughput(e, "step", F.col("t"), F.col("value"), 8), "ms_per_token", "tokens_per_second")


@query("masked_whiten", "SELECT event_id, round(CASE WHEN event_type <> 'view' THEN (value - avg(value) FILTER (event_type <> 'view') OVER w) / sqrt(var_samp(value) FILTER (event_type <> 'view') OVER w + 1e-8) ELSE 0 END, 6) AS whitened FROM events WINDOW w AS (PARTITION BY event_type)")
def whiten(s, d):
    return rounded(advantage.whiten(table(s, d, "events"), "event_type", "value", F.col("event_type") != "view").select("event_id", "whitened"), "whitened")


@query("advantage_remax", "SELECT event_id, round(value - b, 6)::DOUBLE AS advantage FROM events JOIN (SELECT user_id, min_by(value, event_id) AS b FROM events GROUP BY 1) USING (user_id)")
def remax(s, d):
    greedy = table(s, d, "events").groupBy("user_id").agg(F.min_by("value", "event_id").alias("b"))  # the first rollout stands for the greedy one
    e = table(s, d, "events").join(greedy, "user_id")
    return rounded(advantage.by_name(e, "remax", "user_id", "value", baseline="b").select("event_id", "advantage"), "advantage")


@query("adaptive_kl", "WITH RECURSIVE k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY d) AS t FROM (SELECT event_type, day(ts) AS d, avg(value) / 100 AS value FROM events GROUP BY ALL)), r(event_type, t, c) AS (SELECT DISTINCT event_type, 0::BIGINT, 0.2::DOUBLE FROM k UNION ALL SELECT k.event_type, k.t, r.c * (1 + greatest(-0.2, least(0.2, k.value / 0.5 - 1)) * 8 / 100.0) FROM r JOIN k ON k.event_type = r.event_type AND k.t = r.t + 1) SELECT event_type, round(arg_max(c, t), 6) AS coefficient FROM r GROUP BY 1")
def adaptive(s, d):
    daily = table(s, d, "events").groupBy("event_type", F.day("ts").alias("d")).agg((F.avg("value") / 100).alias("k"))
    seq = daily.groupBy("event_type").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "k"))), lambda x: x["k"]).alias("ks"))  # a value per day
    return seq.select("event_type", r6(advantage.adaptive_kl(F.col("ks"), 0.2, 0.5, 100.0, 8), "coefficient"))


# ---- records, bonuses, concepts


@query("record_flatten", "SELECT doc_id, coalesce(l.quality::VARCHAR, d.lang) AS verdict, d.source AS domain FROM documents d LEFT JOIN labels l USING (doc_id)")
def record(s, d):
    l = table(s, d, "labels").select("doc_id", F.struct(F.col("quality").cast("string").alias("verdict"), F.lit(None).cast("string").alias("domain")).alias("verified"))
    both = table(s, d, "documents").select("doc_id", "lang", "source").join(l, "doc_id", "left")
    return both.select("doc_id", *filters.flatten_record({"verdict": [F.col("verified.verdict"), F.col("lang")], "domain": [F.col("verified.domain"), F.col("source")]}))


@query("sft_counts", "SELECT count(*) AS total, count(*) FILTER (quality = 1) AS included, count(*) FILTER (quality IS DISTINCT FROM 1) AS filtered, count(*) FILTER (trim(text) <> '') AS has_cot, count(quality) AS has_verification FROM documents LEFT JOIN labels USING (doc_id)")
def sft_counts(s, d):
    both = table(s, d, "documents").select("doc_id", "text").join(table(s, d, "labels"), "doc_id", "left")
    return filters.sft_counts(both, F.col("text"), F.col("quality"), F.col("quality") == 1)


@query("sft_rows", "SELECT doc_id, md5(CASE WHEN trim(text) <> '' THEN text ELSE '\\boxed{' || lang || '}' END) AS completion FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def sft_rows(s, d):
    both = table(s, d, "documents").select("doc_id", "text", "lang").join(table(s, d, "labels"), "doc_id", "left")
    return filters.sft_rows(both, "doc_id", F.col("text"), F.col("lang"), F.col("quality") == 1).withColumn("completion", F.md5("completion"))


@query("nonzero_vectors", "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0")
def nonzero(s, d):
    return vectors.nonzero(table(s, d, "embeddings"), "embedding").select("vec_id")


BONUSES = """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), b AS (SELECT event_id, value - floor(value) AS s, exp(-n / (SELECT avg(n) FROM c)) AS rarity, value * 3 - floor(value * 3) AS u, value * 7 - floor(value * 7) AS w FROM events JOIN c USING (user_id))
SELECT event_id, 0::DOUBLE AS m1, """ + ", ".join(
    f"round(CASE WHEN s >= 0.5 THEN {x} ELSE 0 END, 6)::DOUBLE AS m{i}"
    for i, x in ((2, "0.1 * rarity * z"), (3, "(0.1 * rarity + 0.05 * u) * z"), (4, "(0.1 * rarity + 0.05 * u + 0.05 * w) * z"), (5, "rarity"))
) + " FROM (SELECT *, least(s, 1 - s) / 0.5 AS z FROM b)"


@query("diversity_modes", BONUSES)
def diversity(s, d):
    e, v = table(s, d, "events"), F.col("value")
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    known = e.join(counts, "user_id").select("event_id", (v - F.floor(v)).alias("s"), F.exp(-F.col("n") / counts.agg(F.avg("n")).scalar()).alias("rarity"), (v * 3 - F.floor(v * 3)).alias("u"), (v * 7 - F.floor(v * 7)).alias("w"))
    c, zone = F.col, F.least(F.col("s"), 1 - F.col("s")) / 0.5
    return known.select("event_id", *[r6(vectors.diversity_bonus(m, c("s") >= 0.5, c("rarity"), c("u"), c("w"), zone), f"m{m}") for m in range(1, 6)])

@query("diversity_rewards", """WITH e AS (SELECT event_id, event_id // 1000 AS b, user_id % 16 AS c, value - floor(value) AS s, value * 7 - floor(value * 7) AS w, value - floor(value) >= 0.5 AND event_type <> 'view' AS ok FROM events),
n AS (SELECT b, c, count(*) AS n FROM e WHERE ok GROUP BY ALL), steps AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i, sum(n) AS m FROM n GROUP BY b),
sums AS (SELECT a.b, n.c, sum(0.1 * pow(0.9, a.i - 1 - z.i) * n.n) AS held FROM steps a JOIN steps z ON z.i < a.i JOIN n ON n.b = z.b GROUP BY ALL),
k AS (SELECT a.b, m, x.c, pow(0.9, i) + coalesce(held, 0) AS held FROM steps a CROSS JOIN (SELECT unnest(range(20)) AS c) x LEFT JOIN sums ON sums.b = a.b AND sums.c = x.c),
r AS (SELECT b, c, m, exp(-held / (sum(held) OVER (PARTITION BY b) / 20)) AS rarity FROM k),
p AS (SELECT event_id, ok, w, least(s, 1 - s) / 0.5 AS z, rarity, CASE WHEN m <= 1 THEN 1 ELSE 1 - (n - 1) / (m - 1) END AS u FROM e LEFT JOIN n USING (b, c) LEFT JOIN r USING (b, c))
SELECT event_id, 0::DOUBLE AS bonus_1, round(CASE WHEN ok THEN 0.1 * rarity * z ELSE 0 END, 6)::DOUBLE AS bonus_2, round(CASE WHEN ok THEN (0.1 * rarity + 0.05 * u + 0.05 * w) * z ELSE 0 END, 6)::DOUBLE AS bonus_4, round(CASE WHEN ok THEN rarity ELSE 0 END, 6)::DOUBLE AS bonus_5 FROM p""")
def diversity_rewards(s, d):
    v = F.col("value")
    part = v - F.floor(v)
    e = table(s, d, "events").select("event_id", "event_type", "value", F.floor(F.col("event_id") / 1000).alias("b"), (F.col("user_id") % 16).alias("c"), (F.least(part, 1 - part) / 0.5).alias("zone"))
    out = stateful.rewards_by_batch(e, "b", "c", (part >= 0.5) & (F.col("event_type") != "view"), v * 7 - F.floor(v * 7), 20, (1, 2, 4, 5), "zone")
    return out.select("event_id", *[r6(F.col(f"bonus_{m}"), f"bonus_{m}") for m in (1, 2, 4, 5)])

@query("reward_additive", """SELECT event_id, CASE WHEN s IS NULL THEN -1 ELSE least(s, 1 - s) END::DOUBLE AS uncertainty, CASE WHEN s IS NULL OR event_type = 'error' THEN -1 ELSE round(least(s, 1 - s) + b, 6) END::DOUBLE AS additive
FROM (SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN round(value - floor(value), 6) END AS s, value * 3 - floor(value * 3) AS b FROM events)""")
def reward_additive(s, d):
    """Views have no score, errors no question."""
    v = F.col("value")
    score = F.when(F.col("event_type") != "view", F.round(v - F.floor(v), 6))
    total = rewards.additive(score, v * 3 - F.floor(v * 3), F.col("event_type") != "error")
    return table(s, d, "events").select("event_id", rewards.uncertainty(score).alias("uncertainty"), r6(total, "additive"))


@query("kl_full", """SELECT event_id, round(q * (ln(q) - ln(p)) + (1 - q) * (ln(1 - q) - ln(1 - p)), 6) AS kl FROM (SELECT event_id, 0.1 + 0.8 * (value - floor(value)) AS p, 0.1 + 0.8 * (value * 3 - floor(value * 3)) AS q FROM events)""")
def kl_full(s, d):
    v = F.col("value")
    p, q = 0.1 + 0.8 * (v - F.floor(v)), 0.1 + 0.8 * (v * 3 - F.floor(v * 3))
    return table(s, d, "events").select("event_id", r6(advantage.kl_full(F.array(F.log(p), F.log(1 - p)), F.array(F.log(q), F.log(1 - q))), "kl"))


SEQUENCE = "SELECT user_id, list(event_id % 50 ORDER BY event_id) AS ids FROM events GROUP BY 1"
LEFT = "CASE WHEN len(x) < 64 THEN list_concat(list_transform(range(64 - len(x)), lambda i: {0}), x) ELSE x[-64:] END"


@query("padded_ids", f"""SELECT user_id, array_to_string({LEFT.format(-1).replace('x', 'ids')}, ',') AS ids, list_sum({LEFT.format(0).replace('x', 'mask')})::BIGINT AS n_masked, ids[1:8] = cut[1:8] AS head_kept
FROM (SELECT user_id, ids, list_transform(ids, lambda i: 1) AS mask, ids[:64] AS cut FROM ({SEQUENCE}))""")
def padded_ids(s, d):
    seq = table(s, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x % 50).alias("ids"))
    ids, mask = F.col("ids"), F.transform("ids", lambda x: F.lit(1))
    left = batch.pad_or_cut(ids, 64, -1, left_pad=True, truncation="left")
    right = batch.pad_or_cut(ids, 64, -1, left_pad=False, truncation="right")
    n = F.aggregate(batch.pad_or_cut(mask, 64, 0, left_pad=True, truncation="left"), F.lit(0).cast("long"), lambda a, x: a + x)
    return seq.select("user_id", F.array_join(left.cast("array<string>"), ",").alias("ids"), n.alias("n_masked"), (F.slice(ids, 1, 8) == F.slice(right, 1, 8)).alias("head_kept"))


# ---- sets and graphs (sets: event types of a user)


def user_sets(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "event_type", F.pmod(F.floor("value"), F.lit(7))))).alias("items"))


SETS = "WITH s AS (SELECT DISTINCT user_id, event_type || ':' || CAST(floor(value) % 7 AS BIGINT) AS x FROM events)"
EDGES = SETS + ", e AS (SELECT a.x AS src, b.x AS dst FROM s a JOIN s b ON a.user_id = b.user_id AND a.x <> b.x GROUP BY ALL HAVING count(*) >= 100)"


@query("inverted_index", SETS + " SELECT x AS item, user_id, count(*) OVER (PARTITION BY x) AS n_keys FROM s")
def inverted(s, d):
    return reports.inverted_index(user_sets(s, d), "user_id", "items")


@query("set_index", SETS + ", k AS (SELECT user_id, string_agg(x, '|' ORDER BY x) AS items FROM s GROUP BY 1) SELECT items, count(*) AS n_keys, min(user_id) AS first_key FROM k GROUP BY 1")
def set_index(s, d):
    return reports.set_index(user_sets(s, d), "user_id", "items")


@query("three_hop", EDGES + " SELECT a.src, c.dst, count(*) AS paths FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src GROUP BY ALL")
def three_hop(s, d):
    return graph.three_hop(graph.cooccurrence(user_sets(s, d), "items", 100))


@query("canonical_sets", SETS + ", m AS (SELECT DISTINCT user_id, CASE WHEN x LIKE 'view:%' THEN 'view' ELSE x END AS x FROM s) SELECT user_id, string_agg(x, '|' ORDER BY x) AS items FROM m GROUP BY 1")
def canonical_sets(s, d):
    sets = user_sets(s, d)
    mapping = graph.vocabulary(sets, "items").where("item LIKE 'view:%'").select(F.col("item").alias("from"), F.lit("view").alias("to"))
    return graph.apply_mapping(sets, "user_id", "items", mapping).withColumn("items", F.concat_ws("|", "items"))


@query("concept_bundles")
def bundles(s, d):
    sets = user_sets(s, d)
    return graph.bundles(sets, "user_id", "items", graph.cooccurrence(sets, "items", 100)).withColumn("items", F.concat_ws("|", "items"))


@query("few_shot_examples", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE k <= 3 AND n >= 3")
def few_shot(s, d):
    docs = table(s, d, "documents").select("doc_id", "source")
    large = docs.groupBy("source").count().where("count >= 3").select("source")
    return select.stratified(docs.join(large, "source", "left_semi"), "source", "doc_id", 3).select("source", "doc_id")


# ---- sequences

IDS = "WITH a AS (SELECT user_id, list(event_id % 9 ORDER BY event_id) AS ids FROM events GROUP BY 1) "


def sequences(s, d):
    e = table(s, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id"))).alias("s"))
    return e.select("user_id", F.transform("s", lambda x: (x["event_id"] % 9).cast("int")).alias("ids"))


@query("pad_sequences", IDS + "SELECT user_id, array_to_string(list_resize(ids[1:40], 40, 0), ',') AS ids FROM a")
def pad(s, d):
    return sequences(s, d).select("user_id", F.concat_ws(",", F.transform(batch.pad_array(F.col("ids"), 40, 0), lambda x: x.cast("string"))).alias("ids"))


@query("response_mask", IDS + "SELECT user_id, coalesce(nullif(list_position(ids, 4), 0), len(ids))::BIGINT AS kept FROM a")
def response_mask(s, d):
    mask = advantage.response_mask(F.col("ids"), 4)
    return sequences(s, d).select("user_id", F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("kept"))


@query("position_ids", IDS + "SELECT user_id, greatest(0, len(list_filter(ids, lambda x: x > 4)) - 1)::BIGINT AS last FROM a")
def position_ids(s, d):
    at = advantage.position_ids(F.transform("ids", lambda x: (x > 4).cast("int")))
    return sequences(s, d).select("user_id", F.element_at(at, -1).cast("long").alias("last"))
