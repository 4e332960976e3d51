"""Registered queries of grading, votes, logs, neighbours, batches and readers, each with its SQL where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from millrace.functions import grading, models, text
from millrace.operators import advantage, batch, dedup, filters, graph, select, stats, vectors, vote
from millrace.plans.registry import query
from millrace.session import table
from millrace.sources import readers
from millrace.streaming import state

ARRIVAL = ["ts", "event_id"]
FIRST = "row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first)"


def r6(c, name):
    return F.round(c, 6).alias(name)


# ---- votes and grading


@query("vote_agreement", f"""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS a, CASE WHEN user_id % 2 = 0 THEN ' click ' ELSE 'purchase' END AS own FROM events),
c AS (SELECT user_id, a, count(*) AS votes, min((ts, event_id)) AS first FROM e WHERE a <> '' GROUP BY ALL), w AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS n, {FIRST} AS k FROM c),
g AS (SELECT user_id, count(*) FILTER (a <> '' AND a = trim(own)) AS agreed FROM e GROUP BY 1)
SELECT g.user_id, coalesce(w.a, '') AS answer, coalesce(votes, 0) AS votes, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(votes / n, 0), 6)::DOUBLE AS score, agreed, round(coalesce(agreed / n, 0), 6)::DOUBLE AS agreement FROM g LEFT JOIN w ON g.user_id = w.user_id AND k = 1""")
def vote_agreement(s, d):
    e = table(s, d, "events")
    answer, own = F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(""), F.when(F.col("user_id") % 2 == 0, " click ").otherwise("purchase")
    out = vote.agreement(e, "user_id", answer, own, ARRIVAL)
    return out.select("user_id", F.coalesce("answer", F.lit("")).alias("answer"), "votes", "n", r6(F.col("score"), "score"), "agreed", r6(F.col("agreement"), "agreement"))


@query("vote_any_case", f"""WITH c AS (SELECT user_id, lower(CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END) AS answer, count(*) AS votes, min((ts, event_id)) AS first FROM events GROUP BY ALL),
w AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS n, {FIRST} AS k FROM c) SELECT user_id, answer, votes, CAST(n AS BIGINT) AS n, round(votes / n, 6) AS score FROM w WHERE k = 1""")
def vote_any_case(s, d):
    mixed = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return vote.majority(table(s, d, "events"), "user_id", F.lower(mixed), ARRIVAL).withColumn("score", F.round("score", 6))


@query("difficulty_score", f"""WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS a, CASE WHEN user_id % 2 = 0 THEN 'click, search' ELSE '' END AS gold FROM events),
c AS (SELECT user_id, a, count(*) AS votes, min((ts, event_id)) AS first FROM e WHERE a <> '' GROUP BY ALL), w AS (SELECT * FROM (SELECT *, {FIRST} AS k FROM c) WHERE k = 1),
g AS (SELECT user_id, max(gold) AS gold, count(*) AS rollouts, count(*) FILTER (gold <> '' AND a IN ('click', 'search')) AS correct FROM e GROUP BY 1)
SELECT g.user_id, round(CASE WHEN gold <> '' THEN correct / rollouts ELSE coalesce(votes, 0) / rollouts END, 6)::DOUBLE AS p_succ, rollouts, correct, CASE WHEN gold <> '' THEN '' ELSE coalesce(w.a, '') END AS modal_answer FROM g LEFT JOIN w USING (user_id)""")
def difficulty(s, d):
    answer, gold = F.when(F.col("event_type") != "view", F.col("event_type")), F.when(F.col("user_id") % 2 == 0, "click, search")
    return vote.difficulty(table(s, d, "events"), "user_id", answer, gold, ARRIVAL).withColumn("p_succ", F.round("p_succ", 6))


def replies(s, d):
    letter = F.substring(F.lit("ABCD"), (F.col("conv_id") % 4 + 1).cast("int"), F.lit(1))
    reply = F.concat("text", F.when(F.col("turn") % 3 == 0, F.lit(" no letter")).otherwise(F.concat(F.lit(" Answer: "), letter)))
    return table(s, d, "conversations").select("conv_id", "turn", reply.alias("reply"), F.when(F.col("turn") % 2 == 0, "A").otherwise(letter).alias("gold"))


REPLIES = "(SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' no letter' ELSE ' Answer: ' || substr('ABCD', (conv_id % 4 + 1)::INT, 1) END AS reply, CASE WHEN turn % 2 = 0 THEN 'A' ELSE substr('ABCD', (conv_id % 4 + 1)::INT, 1) END AS gold FROM conversations)"
SCORED = f"(SELECT *, coalesce(extracted = gold, false)::INT::DOUBLE AS score FROM (SELECT *, CASE WHEN regexp_matches(reply, 'Answer:\\s*[A-D]') THEN regexp_extract(reply, 'Answer:\\s*([A-D])', 1) END AS extracted FROM {REPLIES}))"


@query("benchmark_scores", f"SELECT conv_id, turn, coalesce(extracted, '') AS extracted, score FROM {SCORED}")
def benchmark_scores(s, d):
    out = grading.benchmark_scores(replies(s, d), F.col("reply"), F.col("gold"), r"Answer:\s*([A-D])", choice=True)
    return out.select("conv_id", "turn", F.coalesce("extracted", F.lit("")).alias("extracted"), "score")


YES = "('0x' || substr(md5({}), 1, 8))::BIGINT % 2 = 0"


@query("second_opinion", f"SELECT conv_id, turn, CASE WHEN score < 0.5 AND {YES.format("'There is an answer: ' || reply || chr(10) || chr(10) || 'and the ground truth answer is: ' || gold || chr(10) || chr(10) || 'Is the answer correct? Reply with Yes or No only.'")} THEN 1 ELSE score END::DOUBLE AS score FROM {SCORED}")
def second_opinion(s, d):
    out = grading.benchmark_scores(replies(s, d), F.col("reply"), F.col("gold"), r"Answer:\s*([A-D])", choice=True)
    return grading.rechecked(out, F.col("reply"), F.col("gold"), "score", models.generator(models.yes_no_backend)).select("conv_id", "turn", "score")


@query("judged_answers", f"SELECT conv_id, turn, role = gold OR {YES.format("'Question: ' || reply || chr(10) || 'Answer: ' || role || chr(10) || 'Reference: ' || gold || chr(10) || 'Reply with Yes or No only.'")} AS verdict FROM (SELECT conv_id, turn, text AS reply, role, CASE WHEN turn % 2 = 0 THEN role ELSE 'x' END AS gold FROM conversations)")
def judged_answers(s, d):
    t = table(s, d, "conversations").select("conv_id", "turn", "text", "role", F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise("x").alias("gold"))
    return grading.judged(t, F.col("text"), F.col("role"), F.col("gold"), models.generator(models.yes_no_backend)).select("conv_id", "turn", "verdict")


def _same_start(a: str, b: str) -> bool:
    """Fails without an answer; never ends (within a regular expression that backtracks) for an answer that begins with 'loop'."""
    if not a:
        raise ValueError("nothing to grade")
    if a.startswith("loop"):
        re.match(r"(a|aa)+$", "a" * 200 + "b")
    return a[0] == b[0]


@query("bounded_grading", """SELECT conv_id, turn, CASE WHEN a = '' THEN 'FAILED' WHEN a = 'loop' THEN 'TIMED_OUT' WHEN a[1] = role[1] THEN 'True' ELSE 'False' END AS verdict
FROM (SELECT conv_id, turn, role, CASE WHEN conv_id = 0 AND turn = 1 THEN 'loop' WHEN turn % 3 = 0 THEN '' WHEN turn % 3 = 1 THEN 'user ' || turn ELSE 'assistant' END AS a FROM conversations)""")
def bounded_grading(s, d):
    a = F.when((F.col("conv_id") == 0) & (F.col("turn") == 1), "loop").when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.concat(F.lit("user "), "turn")).otherwise("assistant")
    return table(s, d, "conversations").select("conv_id", "turn", grading.bounded(_same_start, 2.0)(a, F.col("role")).alias("verdict"))


def _begins(a: str, b: str) -> bool:
    return b.startswith(a)


def _first_word(s, d):
    """Turns as rollouts of their conversation; the answer is the first word, two letters of it on every other turn, none where the text has none."""
    word = F.get(F.split("text", " "), F.lit(0))
    return table(s, d, "conversations").withColumn("a", F.when(F.col("turn") % 2 == 0, F.substring(word, 1, 2)).otherwise(word))


# In order of arrival: the first class that `{0}` says is the same, of the answers `a` of each conversation.
GRADED = """turns AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN substr(split_part(text, ' ', 1), 1, 2) ELSE split_part(text, ' ', 1) END AS a FROM conversations),
many AS (SELECT conv_id, a, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn), a) AS k FROM turns WHERE a <> '' GROUP BY conv_id, a),
steps AS (SELECT conv_id, 1 AS k, [a] AS reps, [n] AS votes FROM many WHERE k = 1
  UNION ALL SELECT conv_id, k, CASE WHEN hit IS NULL THEN list_append(reps, a) ELSE reps END, CASE WHEN hit IS NULL THEN list_append(votes, n) ELSE list_transform(votes, lambda v, i: CASE WHEN i = hit THEN v + n ELSE v END) END
  FROM (SELECT s.conv_id, m.k, reps, votes, a, n, list_position(list_transform(reps, lambda r: {0}), true) AS hit FROM steps s JOIN many m ON m.conv_id = s.conv_id AND m.k = s.k + 1)),
won AS (SELECT conv_id, reps[list_position(votes, list_max(votes))] AS answer, list_max(votes)::BIGINT AS votes, list_sum(votes)::BIGINT AS n FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1)"""
BEGINS, SAYS_NO = "starts_with(r, a) OR starts_with(a, r)", "contains(lower(r), 'no ') AND contains(lower(a), 'no ')"


@query("vote_graded", f"WITH RECURSIVE {GRADED.format(f'{BEGINS} OR {SAYS_NO}')} SELECT conv_id, answer, votes, n, round(votes / n, 6) AS score, 0::BIGINT AS timeouts FROM won")
def vote_graded(s, d):
    return vote.graded(_first_word(s, d), "conv_id", F.col("a"), ["turn", "a"], _begins).withColumn("score", F.round("score", 6))


@query("vote_graded_any_case", f"WITH RECURSIVE {GRADED.format(f'lower(r) = lower(a) OR {SAYS_NO} OR {BEGINS}')} SELECT conv_id, answer, votes, e.n AS n, round(votes / e.n, 6) AS score FROM won JOIN (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1) e USING (conv_id)")
def vote_graded_any_case(s, d):
    out = vote.graded(_first_word(s, d), "conv_id", F.col("a"), ["turn", "a"], _begins, rule=vote.any_case_rule, denominator="all")
    return out.withColumn("score", F.round("score", 6)).drop("timeouts")


@query("vote_graded_agreement", f"""WITH RECURSIVE {GRADED.format(f'r = a OR {BEGINS}')}, own AS (SELECT conv_id, min(split_part(text, ' ', 1)) AS own FROM conversations WHERE turn = 0 GROUP BY 1),
agreed AS (SELECT conv_id, count(*) FILTER (a <> '' AND (starts_with(a, own) OR starts_with(own, a))) AS agreed FROM turns JOIN own USING (conv_id) GROUP BY 1)
SELECT conv_id, coalesce(answer, '') AS answer, coalesce(votes, 0) AS votes, coalesce(n, 0) AS n, round(coalesce(votes / n, 0), 6)::DOUBLE AS score, agreed, round(coalesce(agreed / n, 0), 6)::DOUBLE AS agreement FROM agreed LEFT JOIN won USING (conv_id)""")
def vote_graded_agreement(s, d):
    t = _first_word(s, d)
    own = t.where("turn = 0").groupBy("conv_id").agg(F.min(F.get(F.split("text", " "), F.lit(0))).alias("own"))
    out = vote.graded_agreement(t.join(own, "conv_id"), "conv_id", F.col("a"), F.col("own"), ["turn"], _begins)
    return out.select("conv_id", "answer", "votes", "n", r6(F.col("score"), "score"), "agreed", r6(F.col("agreement"), "agreement"))


@query("prompt_step", "SELECT item_id, ('0x' || substr(md5('Solve: ' || text), 1, 8))::BIGINT % 7 || '' AS answer FROM benchmark")
def prompt_step(s, d):
    out = models.ask(table(s, d, "benchmark"), text.render(F.lit("Solve: {{ q }}"), {"q": F.col("text")}), models.generator(), {"answer": text.boxed_last})
    return out.select("item_id", "answer")


# ---- counts and logs


@query("reward_counts", "SELECT count(*) FILTER (abs(r - 1) < 1e-6) AS reward_1, count(*) FILTER (abs(r) < 1e-6) AS reward_0, count(*) FILTER (abs(r + 1) < 1e-6) AS reward_neg1, count(*) FILTER (NOT (abs(r - 1) < 1e-6 OR abs(r) < 1e-6 OR abs(r + 1) < 1e-6)) AS reward_other, count(*) AS total FROM (SELECT (event_id % 4 - 1)::DOUBLE AS r FROM events)")
def reward_counts(s, d):
    return stats.reward_counts(table(s, d, "events").select((F.col("event_id") % 4 - 1).cast("double").alias("r")), "r")


@query("step_log", "WITH e AS (SELECT event_id // 1000 AS step, user_id % 16 AS c, value FROM events) SELECT step, c AS cluster, count(*) AS n, round(avg(value), 4) AS mean, CAST(sum(count(*)) OVER (PARTITION BY step) AS BIGINT) AS num_questions FROM e GROUP BY step, c")
def step_log(s, d):
    e = table(s, d, "events").select(F.floor(F.col("event_id") / 1000).alias("step"), (F.col("user_id") % 16).alias("c"), "value")
    log = stats.step_log(e, "step", "c", "value")
    return log.select("step", "num_questions", "avg_scores", F.explode("distribution").alias("cluster", "n")).select("step", "cluster", "n", F.round(F.element_at("avg_scores", F.col("cluster")), 4).alias("mean"), "num_questions")


@query("adaptive_histogram", "WITH m AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, least(50, count(DISTINCT n_chars)) AS b FROM documents) SELECT least(floor((n_chars - lo) / (hi - lo) * b), b - 1)::BIGINT AS bin, count(*) AS n FROM documents, m GROUP BY 1")
def adaptive_histogram(s, d):
    return stats.adaptive_histogram(table(s, d, "documents"), "n_chars")


@query("worst_clusters", "SELECT user_id, round(m / total, 6)::DOUBLE AS match_rate FROM (SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'click') AS m FROM events GROUP BY 1 HAVING count(*) >= 5) ORDER BY m / total, total DESC, user_id LIMIT 10")
def worst_clusters(s, d):
    report = stats.match_report(table(s, d, "events"), "user_id", F.when(F.col("event_type") == "click", "matched").otherwise("wrong"))
    return stats.worst(report, "user_id").select("user_id", r6(F.col("match_rate"), "match_rate"))


@query("vector_moments", "SELECT p - 1 AS position, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM (SELECT generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def vector_moments(s, d):
    return vectors.vector_moments(table(s, d, "embeddings"), "embedding").select(F.col("position").cast("long").alias("position"), r6(F.col("mean"), "mean"), r6(F.col("variance"), "variance"))


@query("diversity_score", "WITH c AS (SELECT label, count(*) AS n FROM embeddings WHERE label < 8 GROUP BY 1), m AS (SELECT avg(n) AS m FROM c) SELECT vec_id, round(CASE WHEN vec_id % 5 = 0 OR n IS NULL THEN 0 ELSE 0.5 * exp(-n / m) END, 6)::DOUBLE AS score FROM embeddings LEFT JOIN c USING (label), m")
def diversity_score(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.when(F.col("vec_id") % 5 == 0, " \n").otherwise("q").alias("q"))
    counts = e.where("label < 8").groupBy(F.col("label").alias("cluster_id")).agg(F.count(F.lit(1)).alias("count"))
    return vectors.diversity_score(e, "label", "q", counts).select("vec_id", r6(F.col("diversity_score"), "score"))


# ---- neighbours and duplicates

SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("top_neighbours", f"SELECT vec_id, rank::INT AS rank, neighbour, round(s, 6) AS similarity FROM (SELECT a.vec_id, b.vec_id AS neighbour, {SIM} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {SIM} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) WHERE rank <= 10")
def top_neighbours(s, d):
    return dedup.top_neighbours(table(s, d, "embeddings"), "vec_id", "embedding", "label").withColumn("similarity", F.round("similarity", 6))


def _sequential(test: str) -> str:
    """In key order within a label, rows stay that are not near to a row kept before: a recursion over row numbers."""
    return f"""WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
near AS (SELECT b.label, b.i, list(a.i) FILTER (a.i IS NOT NULL) AS js FROM n b LEFT JOIN n a ON a.label = b.label AND a.i < b.i AND {SIM} {test} GROUP BY ALL),
r(label, i, kept) AS (SELECT DISTINCT label, 0::BIGINT, []::BIGINT[] FROM n UNION ALL
SELECT r.label, near.i, CASE WHEN near.js IS NULL OR len(list_intersect(near.js, r.kept)) = 0 THEN list_append(r.kept, near.i) ELSE r.kept END FROM r JOIN near ON near.label = r.label AND near.i = r.i + 1),
last AS (SELECT label, arg_max(kept, i) AS kept FROM r GROUP BY 1)"""


@query("greedy_dedup", _sequential("> 0.3") + " SELECT n.vec_id, n.label FROM n JOIN last USING (label) WHERE list_contains(kept, i)")
def greedy_dedup(s, d):
    return dedup.greedy_in_cluster(table(s, d, "embeddings"), "label", "vec_id", "embedding", 0.3)


@query("growing_dedup", _sequential(">= 0.25") + " SELECT n.vec_id, n.label, NOT list_contains(kept, i) AS duplicate FROM n JOIN last USING (label)")
def growing_dedup(s, d):
    return dedup.against_growing(table(s, d, "embeddings"), "vec_id", "embedding", "label", 0.25)


NAMES = ["Prime Numbers", "prime  number", "GCD (greatest common divisor)", "gcd", "Divisibility by 3", "divisibility rules", "Modular arithmetic properties", "sets", "Sets of points", "graph theory"]


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def names(s, d):
    n = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return table(s, d, "documents").groupBy(n.alias("name")).agg(F.count(F.lit(1)).alias("n"))


def _rules(x: str) -> str:
    quoted = lambda t: t.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_full_match({x}, '{quoted(p).removesuffix('$')}') THEN '{quoted(c)}'" for p, c in text.CONCEPT_RULES) + f" ELSE {x} END"


@query("concept_clean", f"""WITH RECURSIVE c AS (SELECT [{', '.join(repr(x) for x in NAMES)}][doc_id % {len(NAMES)} + 1] AS name, count(*) AS n FROM documents GROUP BY 1), k AS (SELECT name, n, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS x FROM c),
p AS (SELECT name, n, {_rules('x')} AS p1 FROM k), t AS (SELECT p1, sum(n) AS n, [{', '.join(f"(length(p1) - length(replace(p1, '{x}', '')))::DOUBLE" for x in LETTERS)}] AS v FROM p GROUP BY 1),
e AS (SELECT a.p1 AS u, b.p1 AS v FROM t a JOIN t b ON a.p1 <> b.p1 AND list_cosine_similarity(a.v, b.v) > 0.85), r(node, m) AS (SELECT u, u FROM e UNION SELECT e.v, r.m FROM r JOIN e ON r.node = e.u),
q AS (SELECT node, min(m) AS g FROM r GROUP BY 1), g AS (SELECT g, arg_min(p1, (-n, length(p1), p1)) AS best FROM q JOIN t ON p1 = node GROUP BY 1),
m AS (SELECT name, n, coalesce(best, p1) AS p2 FROM p LEFT JOIN q ON node = p1 LEFT JOIN g USING (g)) SELECT name, n, CASE WHEN p2 = 'graph theory' THEN 'graphs' ELSE p2 END AS canonical FROM m""")
def concept_clean(s, d):
    def alike(left):  # counts of letters stand for an embedding
        v = F.array(*[(F.length("name") - F.length(F.replace("name", F.lit(x), F.lit("")))).cast("double") for x in LETTERS])
        return dedup.similarity_groups(left.withColumn("v", v), "name", "v", threshold=0.85, recall=0.9999)

    merges = s.createDataFrame([("graph theory", "graphs")], "name string, canonical string")
    return dedup.clean_names(names(s, d), "name", "n", text.CONCEPT_RULES, alike, merges)


@query("concept_rules", f"WITH k AS (SELECT DISTINCT source || '' AS name FROM documents UNION SELECT unnest([{', '.join(repr(x) for x in NAMES)}])) SELECT name, {_rules('x')} AS canonical FROM (SELECT name, trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS x FROM k)")
def concept_rules(s, d):
    given = s.createDataFrame([(x,) for x in NAMES], "name string")
    return table(s, d, "documents").select(F.col("source").alias("name")).unionByName(given).distinct().select("name", text.apply_rules(F.col("name"), text.CONCEPT_RULES).alias("canonical"))


# ---- advantages


@query("reinforce_plus_plus", """WITH e AS (SELECT user_id, sqrt(abs(value) + 0.1) AS v, CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events),
g AS (SELECT *, coalesce(sum(1 - m) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e),
k AS (SELECT a.user_id, a.t, a.m, sum(b.v * pow(0.9, b.t - a.t)) AS ret FROM g a JOIN e b ON a.user_id = b.user_id AND b.t >= a.t AND NOT EXISTS (SELECT 1 FROM e z WHERE z.user_id = a.user_id AND z.m = 0 AND z.t > a.t AND z.t <= b.t) GROUP BY ALL)
SELECT user_id, t, round(ret, 4) AS returns, round((ret - avg(ret) FILTER (m = 1) OVER ()) / sqrt(var_samp(ret) FILTER (m = 1) OVER () + 1e-8), 4) AS advantage FROM k""")
def reinforce(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", F.sqrt(F.abs("value") + 0.1).alias("v"), F.when(F.col("event_type") == "view", 0).otherwise(1).alias("m"))
    seq = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "v", "m"))).alias("s"))
    seq = seq.select("user_id", F.transform("s", lambda x: x["v"]).alias("v"), F.transform("s", lambda x: x["m"]).alias("m"))
    out = advantage.by_name(seq, "reinforce_plus_plus", "user_id", "v", mask="m", gamma=0.9)
    rows = out.select("user_id", F.posexplode(F.arrays_zip("returns", "advantage")).alias("i", "z"))
    return rows.select("user_id", (F.col("i") + 1).cast("long").alias("t"), F.round("z.returns", 4).alias("returns"), F.round("z.advantage", 4).alias("advantage"))


@query("value_loss", "SELECT event_id, round(0.5 * greatest(pow(v - t, 2), pow(greatest(o - 0.5, least(o + 0.5, v)) - t, 2)), 6) AS loss, pow(greatest(o - 0.5, least(o + 0.5, v)) - t, 2) > pow(v - t, 2) AS clipped, round(t - 0.1 * (v - o), 6) AS penalized FROM (SELECT event_id, value AS v, value * 0.9 AS o, value % 3 AS t FROM events)")
def value_loss(s, d):
    v, o, t = F.col("value"), F.col("value") * 0.9, F.col("value") % 3
    out = advantage.clipped_value_loss(v, o, t)
    return table(s, d, "events").select("event_id", r6(out["loss"], "loss"), out["clipped"].alias("clipped"), r6(advantage.kl_penalized(t, v - o, 0.1), "penalized"))


# ---- batches


@query("split_list", "SELECT doc_id, ntile(7) OVER (ORDER BY n_chars, doc_id)::BIGINT AS part FROM documents")
def split_list(s, d):
    return batch.split_list(table(s, d, "documents").select("doc_id", "n_chars"), 7, ["n_chars", "doc_id"]).select("doc_id", F.col("part").cast("long").alias("part"))


@query("mini_batches", "SELECT e AS epoch, doc_id, (row_number() OVER (PARTITION BY e ORDER BY md5('3:' || e || ':' || doc_id), doc_id) - 1) // 64 AS batch FROM documents, range(3) t(e)")
def mini_batches(s, d):
    return batch.epochs(table(s, d, "documents").select("doc_id"), "doc_id", 3, 64, seed=3).select(F.col("epoch").cast("long").alias("epoch"), "doc_id", "batch")


@query("split_by_size", "SELECT doc_id AS row, floor(doc_id * (n // 48) / n)::BIGINT AS chunk FROM documents, (SELECT count(*) AS n FROM documents)")
def split_by_size(s, d):
    return batch.split_by_size(table(s, d, "documents").select(F.col("doc_id").alias("row")), 48, "row")


@query("nested_columns", "SELECT doc_id AS \"row\", source AS \"doc/name\", n_chars AS \"doc/at/size\" FROM documents")
def nested_columns(s, d):
    n = table(s, d, "documents").select(F.col("doc_id").alias("n"), F.col("source").alias("doc/name"), F.col("n_chars").alias("doc/at/size"))
    return batch.flatten(batch.unflatten(batch.rename(n, {"n": "row"})))


@query("fold_batches", "SELECT doc_id // 8 AS batch, array_to_string(list(n_chars ORDER BY doc_id), ',') AS chars FROM documents GROUP BY 1")
def fold_batches(s, d):
    return batch.fold(table(s, d, "documents").select("doc_id", "n_chars"), 8, "doc_id", "n_chars").select("batch", F.array_join("values", ",").alias("chars"))


@query("token_budget_batches")
def token_budget(s, d):
    docs = table(s, d, "documents").select(F.floor(F.col("doc_id") / 64).cast("long").alias("batch"), "doc_id", "n_chars")
    return select.budget_batches(docs, "batch", "doc_id", "n_chars", 20_000)


@query("concept_specs")
def concept_specs(s, d):
    sets = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "event_type", F.pmod(F.floor("value"), F.lit(7))))).alias("items"))
    return graph.specs(sets, "user_id", "items", graph.cooccurrence(sets, "items", 100))


# ---- readers over the test tables


@query("hash_answers", "SELECT c.text AS question, trim(split_part(c.text || ' #### ' || c.turn || ' ', '#### ', -1)) AS answer, k::INT AS copy FROM conversations c, range(1, 3) t(k)")
def hash_answers(s, d):
    t = table(s, d, "conversations").select(F.col("text").alias("question"), F.concat("text", F.lit(" #### "), "turn", F.lit(" ")).alias("answer"))
    return readers.hash_answer_benchmark(t, repeat=2)


@query("option_prompts", "SELECT text || chr(10) || '(A): ' || item_id || chr(10) || '(B): none' AS question, chr((item_id % 2 + 65)::INT) AS answer FROM benchmark ORDER BY md5('0:' || item_id), item_id LIMIT 30")
def option_prompts(s, d):
    t = table(s, d, "benchmark").select("item_id", "text", F.array(F.col("item_id").cast("string"), F.lit("none")).alias("options"), (F.col("item_id") % 2).cast("int").alias("index"))
    return readers.option_benchmark(t, "item_id", "text", "options", "index", n=30)


@query("corpus_counts", "SELECT source, kind, level, count(*) AS n FROM (SELECT 'docs' AS source, lang AS kind, source AS level, text FROM documents UNION ALL SELECT 'talk', role, '' || turn, text FROM conversations) WHERE length(text) BETWEEN 20 AND 800 GROUP BY ALL")
def corpus_counts(s, d):
    docs = table(s, d, "documents").select(F.col("text").alias("body"), F.col("lang").alias("type"), F.col("source").alias("level"))
    talk = table(s, d, "conversations").select(F.col("text").alias("body"), F.col("role").alias("subject"), F.col("turn").alias("difficulty"))
    return readers.corpus_counts(readers.corpus({"docs": docs, "talk": talk}, "body", 20, 800))


@query("unprocessed_rows", "SELECT doc_id FROM labels WHERE quality = 0")
def unprocessed(s, d):
    return filters.unprocessed(table(s, d, "labels"), "quality").select("doc_id")


@query("row_filters", "SELECT doc_id, regexp_matches(lower(text), '证明|box') OR contains(lower(source), 'text') AS ungradable, coalesce(p, 0.5) BETWEEN 0.4 AND 0.6 AS p_in_band, length(text) <= 800 AS short_enough, len(regexp_extract_all(text, '[^\\s\\v\\x{85}\\x{A0}\\p{Z}]+')) <= 120 AS within_words FROM (SELECT *, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 10) / 10.0 END AS p FROM documents)")
def row_filters(s, d):
    p = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 10) / 10.0)
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", filters.ungradable(t, F.col("source")).alias("ungradable"), filters.p_band(p, 0.4, 0.6).alias("p_in_band"), filters.short_enough(t).alias("short_enough"), filters.within_words(t, 120).alias("within_words"))


@query("vector_comparison", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS l2, round(list_max(list_transform(range(1, 65), lambda i: abs(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE))), 6) AS max_gap FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_comparison(s, d):
    e = table(s, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    out = vectors.compare_vectors(F.col("embedding"), F.col("other"))
    return e.join(b, "vec_id").select("vec_id", *[r6(c, n) for n, c in out.items()])


@query("log_samples", "SELECT doc_id, text FROM documents ORDER BY md5('5:' || doc_id), doc_id LIMIT 25")
def log_samples(s, d):
    return select.log_samples(table(s, d, "documents").select("doc_id", "text"), "doc_id", 25, seed=5)


# ---- state


@query("ema_steps", "WITH b AS (SELECT event_id % 3 AS b, user_id % 16 AS c, count(*) AS n FROM events GROUP BY ALL) SELECT k AS cluster_id, round(pow(0.9, 3) + coalesce((SELECT sum(0.1 * pow(0.9, 2 - b) * n) FROM b WHERE c = k), 0), 6) AS count FROM (SELECT unnest(range(20)) AS k)")
def ema_steps(s, d):
    e = table(s, d, "events").select((F.col("event_id") % 3).alias("b"), (F.col("user_id") % 16).alias("c"))
    now = state.ema_initial(s, 20)
    for b in range(3):
        now = state.ema_step(now, e.where(F.col("b") == b), "c")
    return now.withColumn("count", F.round("count", 6))
