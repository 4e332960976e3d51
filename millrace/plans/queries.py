"""The registered queries, by family, each with its oracle in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import grading, models, rewards, text
from millrace.operators import advantage, batch, components, dedup, filters, graph, joins, penalty, scans, select, stats, vectors, vote
from millrace.plans import curation, more_queries, report_queries, text_queries  # noqa: F401  register their own
from millrace.plans.registry import query
from millrace.session import table
from millrace.streaming import state


def r6(c, name):
    return F.round(c, 6).alias(name)


ARRIVAL = ["ts", "event_id"]

# ---- votes and grading (events: user = question, event type = answer)

FIRST = """WITH c AS (SELECT user_id, event_type AS answer, count(*) AS votes, min((ts, event_id)) AS first FROM events GROUP BY ALL),
r AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) AS k FROM c)
"""


@query("vote_majority", FIRST + "SELECT user_id, answer, votes, CAST(n AS BIGINT) AS n, round(votes / n, 6) AS score FROM r WHERE k = 1 AND votes / n BETWEEN 0.2 AND 0.8")
def vote_majority(s, d):
    won = vote.majority(table(s, d, "events"), "user_id", F.col("event_type"), ARRIVAL)
    return filters.score_band(won, 0.2, 0.8).withColumn("score", F.round("score", 6))


@query("vote_all_denominator", """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS a FROM events),
c AS (SELECT user_id, a AS answer, count(*) AS votes, min((ts, event_id)) AS first FROM e WHERE a <> '' GROUP BY ALL),
t AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) AS k FROM c)
SELECT user_id, answer, votes, n, round(votes / n, 6) AS score FROM r JOIN t USING (user_id) WHERE k = 1""")
def vote_all(s, d):
    a = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return vote.majority(table(s, d, "events"), "user_id", a, ARRIVAL, denominator="all").withColumn("score", F.round("score", 6))


@query("vote_empty_class", """WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS a FROM events),
c AS (SELECT user_id, a AS answer, count(*) AS votes, min((ts, event_id)) AS first FROM e GROUP BY ALL),
r AS (SELECT *, sum(votes) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) AS k FROM c)
SELECT user_id, answer, votes, CAST(n AS BIGINT) AS n, CASE WHEN answer = '' THEN 0 ELSE round(votes / n, 6) END AS score FROM r WHERE k = 1""")
def vote_empty(s, d):
    a = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return vote.majority(table(s, d, "events"), "user_id", a, ARRIVAL, empty_is_class=True).withColumn("score", F.round("score", 6))


@query("vote_score_bins", FIRST + """SELECT CASE WHEN s >= 1 THEN '1.0' WHEN s >= 0.8 THEN '0.8-1.0' WHEN s >= 0.6 THEN '0.6-0.8' WHEN s >= 0.4 THEN '0.4-0.6' WHEN s >= 0.2 THEN '0.2-0.4' ELSE '0.0-0.2' END AS bin,
count(*) AS n FROM (SELECT votes / n AS s FROM r WHERE k = 1) GROUP BY 1""")
def vote_bins(s, d):
    won = vote.majority(table(s, d, "events"), "user_id", F.col("event_type"), ARRIVAL)
    return won.groupBy(stats.score_bins(F.col("score")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("vote_predicate")
def vote_predicate(s, d):
    return vote.majority_by(table(s, d, "events"), "user_id", "event_type", "event_id", vote.no_rule)


@query("self_consistency_reward", FIRST + """SELECT e.event_id, CASE WHEN e.event_type = 'view' THEN -0.5 WHEN coalesce(m.votes, 0) < 2 THEN 0 WHEN e.event_type = m.answer THEN 1 ELSE 0 END::DOUBLE AS reward
FROM events e LEFT JOIN (WITH c2 AS (SELECT user_id, event_type AS answer, count(*) AS votes, min((ts, event_id)) AS first FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) AS k FROM c2) WHERE k = 1) m ON e.user_id = m.user_id""")
def consistency(s, d):
    a = F.when(F.col("event_type") != "view", F.col("event_type"))
    return vote.self_consistency(table(s, d, "events"), "user_id", a, ARRIVAL).select("event_id", F.col("reward").cast("double").alias("reward"))


@query("best_rollout", FIRST + """SELECT e.user_id, arg_min(e.props, (e.event_type <> r.answer, e.ts, e.event_id)) AS rollout FROM events e JOIN r ON e.user_id = r.user_id AND k = 1 WHERE trim(e.props) <> '' GROUP BY 1""")
def best_rollout(s, d):
    return vote.best_rollout(table(s, d, "events"), "user_id", F.col("event_type"), "props", ARRIVAL)


@query("upsert_retry", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def upsert(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    return vote.upsert(o, o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("R").alias("o_orderstatus")), "o_orderkey")


# Every form that the match knows, made of a turn's first word and number: eight kinds, in turn.
FUZZY = """SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN '(' || w[1] || ')' WHEN 1 THEN w[1] WHEN 2 THEN turn || '.0' WHEN 3 THEN w || '''s' WHEN 4 THEN '[' || w || ']' WHEN 6 THEN w || '?' ELSE w END AS p,
CASE turn % 8 WHEN 0 THEN w[1] WHEN 1 THEN '(' || w[1] || ')' WHEN 2 THEN turn || '' WHEN 3 THEN w || 's' WHEN 5 THEN '[' || w || ']' WHEN 7 THEN role ELSE w END AS r FROM (SELECT *, split_part(text, ' ', 1) AS w FROM conversations)"""


@query("fuzzy_match", f"""SELECT conv_id, turn, CASE WHEN p = r THEN true WHEN length(p) = 3 AND p[1] = '(' AND p[3] = ')' THEN p[2] = r WHEN length(r) = 3 AND r[1] = '(' AND r[3] = ')' THEN r[2] = p
ELSE coalesce(TRY_CAST(p AS DOUBLE) = TRY_CAST(r AS DOUBLE), false) OR replace(p, '''', '') = replace(r, '''', '') OR '[' || r || ']' = p OR '[' || p || ']' = r OR (p LIKE '%?' AND p[:-2] = r) END AS hit FROM ({FUZZY})""")
def fuzzy(s, d):
    w, kind, turn = F.get(F.split("text", " "), F.lit(0)), F.col("turn") % 8, F.col("turn").cast("string")
    first = F.substring(w, 1, 1)
    around = lambda a, x, b: F.concat(F.lit(a), x, F.lit(b))
    p = F.when(kind == 0, around("(", first, ")")).when(kind == 1, first).when(kind == 2, around("", turn, ".0")).when(kind == 3, around("", w, "'s"))
    p = p.when(kind == 4, around("[", w, "]")).when(kind == 6, around("", w, "?")).otherwise(w)
    r = F.when(kind == 0, first).when(kind == 1, around("(", first, ")")).when(kind == 2, turn).when(kind == 3, around("", w, "s"))
    r = r.when(kind == 5, around("[", w, "]")).when(kind == 7, F.col("role")).otherwise(w)
    return table(s, d, "conversations").select("conv_id", "turn", grading.fuzzy(p, r).alias("hit"))


@query("answer_equivalence", "SELECT conv_id, turn, conv_id % 5 = turn % 5 AS same FROM conversations")
def equivalence(s, d):
    """Halves written as quotients, in brackets, as decimals and as fractions, against decimals."""
    x, kind = (F.col("conv_id") % 5).cast("string"), F.col("turn") % 4
    around = lambda a, y, b: F.concat(F.lit(a), y, F.lit(b))
    a = F.when(kind == 0, around("", x, "/2")).when(kind == 1, around("(", x, ")/(2)")).when(kind == 2, (F.col("conv_id") % 5 / 2).cast("string")).otherwise(around("\\frac{", x, "}{2}"))
    return table(s, d, "conversations").select("conv_id", "turn", grading.equivalent(a, F.format_string("%.2f", F.col("turn") % 5 / 2)).alias("same"))


# ---- text (documents, conversations)


@query("answer_normalize_a", """SELECT conv_id, turn, role, md5(lower(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\p{Z}]+', '', 'g'),
'\\\\(text|mathrm|mathbf|mathit)\\{([^}]*)\\}', '\\2', 'g'), '\\\\frac\\{([^}]*)\\}\\{([^}]*)\\}', '(\\1)/(\\2)', 'g'), '\\\\(left|right)', '', 'g'), '$', ''))) AS h FROM conversations""")
def norm_a(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.md5(text.normalize_a(F.col("text"))).alias("h"))


@query("answer_normalize_b", "SELECT conv_id, turn, role, md5(lower(replace(regexp_replace(text, '[\\s\\x{85}\\x{A0}\\p{Z}]+', '', 'g'), '$', ''))) AS h FROM conversations")
def norm_b(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.md5(text.normalize_b(F.col("text"), True)).alias("h"))


@query("answer_normalize_d", "SELECT doc_id, md5(replace(replace(replace(replace(trim(text), '\\text{', ''), '}', ''), '\\', ''), ' ', '')) AS h FROM documents")
def norm_d(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(text.normalize_d(F.col("text"))).alias("h"))


@query("answer_normalize_e", "SELECT conv_id, turn, role, md5(lower(trim(regexp_replace(regexp_replace(replace(trim(text), '$', ''), '\\\\[a-zA-Z]+', '', 'g'), '\\s+', ' ', 'g')))) AS h FROM conversations")
def norm_e(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", "role", F.md5(text.normalize_e(F.col("text"))).alias("h"))


@query("tag_extract", "SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, trim(regexp_extract_all(html, '(?is)<p>(.*?)</p>', 1)[-1]) AS last_p FROM pages WHERE regexp_matches(html, '(?is)<title>(.*?)</title>')")
def tags(s, d):
    return table(s, d, "pages").select("page_id", text.tag(F.col("html"), "title").alias("title"), text.tag_last(F.col("html"), "p").alias("last_p")).where("title IS NOT NULL")


@query("lexical_dedup", """WITH k AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS k FROM documents) SELECT min(doc_id) AS doc_id FROM k GROUP BY k""")
def lexical(s, d):
    return dedup.lexical(table(s, d, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id")


@query("lexical_dedup_groups", """WITH k AS (SELECT doc_id, regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g') AS k FROM documents) SELECT min(doc_id) AS first_id, count(*) AS n FROM k GROUP BY k""")
def lexical_groups(s, d):
    return dedup.lexical_groups(table(s, d, "documents"), "text", "doc_id")


@query("content_hash_id", "SELECT doc_id, 'q_' || substr(md5(text || '_' || doc_id), 1, 12) || '_' || doc_id AS qid FROM documents")
def content_hash(s, d):
    return table(s, d, "documents").select("doc_id", text.content_id(F.col("text"), F.col("doc_id")).alias("qid"))


@query("question_format", """SELECT doc_id, NOT regexp_matches(text, '^<[a-zA-Z_]+>') AND length(trim(text)) >= 20 AND lower(text) NOT LIKE '%<answer>%' AND lower(text) NOT LIKE '%<transformation>%'
AND (regexp_matches(text, '[$\\\\=+\\-*/^]|find|calculate|solve|simplify|evaluate|determine|prove|show') OR regexp_matches(lower(text), '\\?|what|find|calculate|determine|solve|how|prove|show|given')) AS ok FROM documents""")
def question_format(s, d):
    return table(s, d, "documents").select("doc_id", filters.question_format_ok(F.col("text")).alias("ok"))


@query("option_prediction", "SELECT doc_id, CASE WHEN regexp_matches(t, '[A-J]') THEN regexp_extract_all(t, '[A-J]').list_sort()[1] ELSE chr((65 + ('0x' || substr(md5('' || doc_id), 1, 8))::BIGINT % 10)::INT) END AS letter FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(text) ELSE text END AS t FROM documents)")
def option_prediction(s, d):
    t = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    return table(s, d, "documents").select("doc_id", text.option_prediction(t, F.col("doc_id")).alias("letter"))


# ---- rewards over documents

W = "len(regexp_extract_all(text, '[^\\s\\x{85}\\x{A0}\\p{Z}]+'))"


@query("length_multiplier", f"SELECT doc_id, round(CASE WHEN text = '' THEN 0.5 WHEN n < 50 THEN 0.5 + 0.5 * n / 50.0 WHEN n > 800 THEN greatest(0.7, 1 - (n - 800) / 2000.0) ELSE 1 END, 6)::DOUBLE AS m FROM (SELECT doc_id, text, {W} AS n FROM documents)")
def length_multiplier(s, d):
    return table(s, d, "documents").select("doc_id", r6(rewards.length_multiplier(F.col("text")), "m"))


STEP = rewards.STEPS.replace(r"(?:^\s*+|\n[^\S\n]*+)", r"(?:^|\n)\s*")
#: Texts as documents, every fourth within a think block and every fourth with a box.
SOLVED = """(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<think> ' || text || '</think> so \\boxed{7}' WHEN 1 THEN text || ' = 12. \\boxed{x = 3}' ELSE text END AS text FROM documents)"""
REASONED = f"""(SELECT doc_id, CASE WHEN regexp_matches(text, '(?s)<think>.*?</think>') THEN trim(regexp_extract(text, '(?s)<think>(.*?)</think>', 1), chr(32) || chr(9) || chr(10) || chr(13))
WHEN trim(split_part(text, '\\boxed{{', 1), chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND contains(text, '\\boxed{{') THEN trim(split_part(text, '\\boxed{{', 1), chr(32) || chr(9) || chr(10) || chr(13))
ELSE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) END AS text FROM {SOLVED})"""


def solved(s, d):
    t, k = F.col("text"), F.col("doc_id") % 4
    return table(s, d, "documents").select("doc_id", F.when(k == 0, F.concat(F.lit("<think> "), t, F.lit("</think> so \\boxed{7}"))).when(k == 1, F.concat(t, F.lit(" = 12. \\boxed{x = 3}"))).otherwise(t).alias("text"))


QUALITY = f"""SELECT doc_id, text, len(regexp_extract_all(text, '{STEP}')) AS marks, {W} AS n, len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_replace(x, '\\s', '', 'g') <> '')) AS paras,
len(regexp_extract_all(text, '{rewards.EQUATIONS}')) + len(regexp_extract_all(text, '{rewards.LATEX}')) + len(regexp_extract_all(text, '{rewards.KEYWORDS}')) AS math,
len(regexp_extract_all(text, '{rewards.CALCULATIONS}')) + len(regexp_extract_all(text, '{rewards.RESULTS}')) AS calcs FROM documents WHERE text <> ''"""


@query("step_quality", f"""SELECT doc_id, round(least(1.0, math / greatest(1.0, n / 20)), 6) AS math_density, round(least(1.0, greatest(marks, paras, 1) / 5), 6) AS step_structure,
round(least(1.0, marks / 4), 6) AS logical_flow, round(least(1.0, calcs / 3), 6) AS calculation_presence FROM ({QUALITY})""")
def step_quality(s, d):
    t = F.col("text")
    cols = {"math_density": rewards.math_density, "step_structure": rewards.step_structure, "logical_flow": rewards.logical_flow, "calculation_presence": rewards.calculation_presence}
    return table(s, d, "documents").where("text <> ''").select("doc_id", *[r6(f(t), n) for n, f in cols.items()])


REPEAT = """WITH t AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda x: lower(trim(x))), lambda x: length(x) > 10) AS s, regexp_extract_all(lower(text), '[^\\s\\x{85}\\x{A0}\\p{Z}]+') AS w FROM documents),
u AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM t),
m AS (SELECT doc_id, CASE WHEN length(text) < 100 OR len(s) < 3 THEN 1.0 ELSE greatest(0.3, least(len(list_distinct(s)) / len(s), CASE WHEN len(w) > 20 THEN len(list_distinct(g)) / len(g) ELSE 1.0 END)) END AS m FROM u)"""


@query("repetition_multiplier", REPEAT + "SELECT doc_id, round(m, 6)::DOUBLE AS m FROM m")
def repetition(s, d):
    return table(s, d, "documents").select("doc_id", r6(rewards.repetition_multiplier(F.col("text")), "m"))


@query("process_reward", REPEAT.replace("FROM documents", f"FROM {REASONED}") + f""", q AS ({QUALITY.replace("FROM documents", f"FROM {REASONED}")})
SELECT doc_id, round((0.3 * least(1.0, math / greatest(1.0, n / 20)) + 0.3 * least(1.0, greatest(marks, paras, 1) / 5) + 0.2 * least(1.0, marks / 4) + 0.2 * least(1.0, calcs / 3))
* CASE WHEN n < 50 THEN 0.5 + 0.5 * n / 50.0 WHEN n > 800 THEN greatest(0.7, 1 - (n - 800) / 2000.0) ELSE 1 END * m, 6)::DOUBLE AS reward FROM q JOIN m USING (doc_id) UNION ALL SELECT doc_id, 0 FROM {REASONED} WHERE text = ''""")
def process(s, d):
    return solved(s, d).select("doc_id", r6(rewards.process_reward(F.col("text")), "reward"))


@query("reward_modes", """SELECT event_id, round(least(s, 1 - s), 6) AS m1, round(CASE WHEN s < 0.3 OR s > 0.9 THEN 0 ELSE greatest(0, 1 - abs(s - 0.75) / 0.4) * 1.5 END, 6)::DOUBLE AS m2, CASE WHEN s BETWEEN 0.49 AND 0.99 THEN 1.0 ELSE 0.0 END::DOUBLE AS m5
FROM (SELECT event_id, value - floor(value) AS s FROM events)""")
def reward_modes(s, d):
    sc, div = F.col("value") - F.floor("value"), F.lit(0.5)
    return table(s, d, "events").select("event_id", r6(rewards.moded(sc, div, 1), "m1"), r6(rewards.moded(sc, div, 2), "m2"), rewards.moded(sc, div, 5).alias("m5"))


# ---- filters and cascades


@query("score_band", "SELECT doc_id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 2000 AND source NOT IN ('', 'None')")
def band(s, d):
    return filters.score_band(table(s, d, "documents").select("doc_id", "n_chars", "source"), 500, 2000, "n_chars", answer="source").select("doc_id", "n_chars")


@query("band_or_all", "SELECT 'all' AS kind, event_id FROM events UNION ALL SELECT 'band', event_id FROM events WHERE value BETWEEN 10 AND 20")
def band_or_all(s, d):
    e = table(s, d, "events")
    kinds = {"all": filters.band_or_all(e, "value", 1e9, 2e9), "band": filters.band_or_all(e, "value", 10, 20)}
    return kinds["all"].select(F.lit("all").alias("kind"), "event_id").unionByName(kinds["band"].select(F.lit("band").alias("kind"), "event_id"))


@query("reject_cascade", """WITH k AS (SELECT doc_id, text, source, row_number() OVER (PARTITION BY regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g') ORDER BY doc_id) AS r FROM documents)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN text LIKE '<%' THEN 'format_invalid' WHEN length(trim(text)) < 10 THEN 'empty_or_too_short' WHEN r > 1 THEN 'lexical_duplicate' WHEN coalesce(l.quality, 1) = 0 THEN 'out_of_band' ELSE 'accepted' END AS reason
FROM k LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def cascade(s, d):
    docs, labels = table(s, d, "documents").select("doc_id", "text"), table(s, d, "labels").select("doc_id", "quality")
    firsts = dedup.lexical(docs, "text", "doc_id").select("doc_id", F.lit(True).alias("first"))
    t = F.col("text")
    reason = filters.first_reason({"format_invalid": t.startswith("<"), "empty_or_too_short": F.length(F.trim(t)) < 10, "lexical_duplicate": F.col("first").isNull(), "out_of_band": F.coalesce("quality", F.lit(1)) == 0})
    out = docs.join(firsts, "doc_id", "left").join(labels, "doc_id", "left").withColumn("reason", F.coalesce(reason, F.lit("accepted")))
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("quality_gate", "SELECT doc_id, l.doc_id IS NULL OR (l.toxic = 0 AND l.quality >= 1) AS pass FROM documents LEFT JOIN labels l USING (doc_id)")
def gate(s, d):
    l = table(s, d, "labels")
    summary = F.struct(F.lit("valid").alias("question_validity"), F.lit("correct").alias("answer_correctness"), F.lit("no").alias("answer_leakage"), F.lit("high").alias("cot_quality"), F.when(F.col("quality") >= 1, "good").otherwise("poor").alias("overall_quality"))
    l = l.select("doc_id", summary.alias("summary"), F.when(F.col("toxic") == 0, "success").otherwise("failed").alias("status"))
    out = table(s, d, "documents").select("doc_id").join(l, "doc_id", "left")
    return out.select("doc_id", filters.quality_gate(F.col("summary"), F.col("status"), True, True, True, "medium", "good").alias("pass"))


@query("row_slice", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def row_slice(s, d):
    return filters.row_slice(table(s, d, "documents").select("doc_id"), ["doc_id"], 100, 150)


# ---- vectors (embeddings; centroids are means by label)

CENT = """WITH p AS (SELECT label AS cluster_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), a AS (SELECT cluster_id, i, avg(x) AS m FROM p GROUP BY ALL),
c AS (SELECT cluster_id::BIGINT AS cluster_id, list(m ORDER BY i) AS v FROM a GROUP BY 1), n AS (SELECT *, sqrt(list_dot_product(v, v)) AS l FROM c),
s AS (SELECT vec_id, label, cluster_id, list_dot_product(embedding::DOUBLE[], v) AS raw, list_dot_product(embedding::DOUBLE[], v) / (l + 1e-12) AS cos FROM embeddings, n),
b AS (SELECT vec_id, label, arg_max(cluster_id, (cos, -cluster_id)) AS cluster_id, max(cos) AS sim FROM s GROUP BY ALL),
cnt AS (SELECT k.cluster_id, count(b.vec_id) AS count FROM (SELECT unnest(range(10)) AS cluster_id) k LEFT JOIN b USING (cluster_id) GROUP BY 1)
"""


def placed(s, d, normalize=True):
    e = table(s, d, "embeddings")
    return vectors.assign(e, vectors.mean_centroids(e, "label", "embedding"), "vec_id", "embedding", normalize)


@query("nearest_centroid", CENT + "SELECT vec_id, cluster_id, round(sim, 6) AS similarity FROM b")
def nearest(s, d):
    return placed(s, d).withColumn("similarity", F.round("similarity", 6))


@query("nearest_centroid_rawdot", CENT + "SELECT vec_id, arg_max(cluster_id, (raw, -cluster_id)) AS cluster_id, round(max(raw), 6) AS similarity FROM s GROUP BY 1")
def nearest_raw(s, d):
    return placed(s, d, False).withColumn("similarity", F.round("similarity", 6))


@query("cluster_dense_freq", CENT + "SELECT cluster_id, count FROM cnt")
def dense(s, d):
    return vectors.dense_counts(placed(s, d), "cluster_id", 10)


@query("rarity_reward", CENT + "SELECT cluster_id, count, round(count / sum(count) OVER (), 6) AS probability, round(exp(-count / greatest(avg(count) OVER (), 1e-8)), 6) AS rarity FROM cnt")
def rarity(s, d):
    out = vectors.rarity(vectors.dense_counts(placed(s, d), "cluster_id", 10))
    return out.select("cluster_id", "count", r6(F.col("probability"), "probability"), r6(F.col("rarity"), "rarity"))


@query("batch_uniqueness", CENT + "SELECT label::BIGINT AS batch, cluster_id, count(*) AS same, round(CASE WHEN sum(count(*)) OVER (PARTITION BY label) <= 1 THEN 1 ELSE 1 - (count(*) - 1) / (sum(count(*)) OVER (PARTITION BY label) - 1) END, 6) AS uniqueness FROM b GROUP BY label, cluster_id")
def uniqueness(s, d):
    rows = placed(s, d).join(table(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("batch")), "vec_id")
    return vectors.batch_uniqueness_table(rows, "batch", "cluster_id").withColumn("uniqueness", F.round("uniqueness", 6))


@query("within_cluster_uniqueness", CENT + "SELECT vec_id, round((1 - cos) / 2, 6) AS uniqueness FROM s WHERE cluster_id = label")
def within(s, d):
    e = table(s, d, "embeddings")
    c = vectors.mean_centroids(e, "label", "embedding").select(F.col("cluster_id").alias("label"), F.transform("centroid", lambda x: x / (vectors.norm(F.col("centroid")) + 1e-12)).alias("c"))
    return e.join(c, "label").select("vec_id", r6(vectors.within_uniqueness(F.col("embedding"), F.col("c")), "uniqueness"))


@query("vector_checks", """SELECT count(*) AS n, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS n_zero_rows, CAST(sum(len(list_filter(embedding, lambda x: x = 0))) AS BIGINT) AS n_zero_elements,
count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 0.01) AS n_off_norm, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm FROM embeddings""")
def vector_checks(s, d):
    return vectors.vector_checks(table(s, d, "embeddings"), "embedding").withColumn("mean_norm", F.round("mean_norm", 6))


@query("cluster_accuracy", CENT + "SELECT count(*) AS clusters, round(avg(a), 6) AS mean_accuracy, round(var_pop(a), 6) AS var_accuracy FROM (SELECT cluster_id, avg((cluster_id = label)::INT) AS a FROM b GROUP BY 1)")
def cluster_accuracy(s, d):
    rows = placed(s, d).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id")
    return stats.cluster_accuracy(rows, "cluster_id", F.col("label") == F.col("cluster_id")).select("clusters", r6(F.col("mean_accuracy"), "mean_accuracy"), r6(F.col("var_accuracy"), "var_accuracy"))


# Every third vector has a near copy with eight components moved by a hundredth, every fifth an exact one.
COPIES = """SELECT vec_id * 3 AS id, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id * 3 + 1, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i <= 8 THEN x + 0.01 ELSE x END) FROM embeddings WHERE vec_id % 3 = 0
UNION ALL SELECT vec_id * 3 + 2, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 5 = 0"""


@query("similarity_components", f"""WITH RECURSIVE t AS ({COPIES}), e AS (SELECT a.id AS u, b.id AS v FROM t a JOIN t b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) > 0.85),
r(n, m) AS (SELECT u, u FROM e UNION SELECT e.v, r.m FROM r JOIN e ON r.n = e.u) SELECT n AS node, min(m) AS component FROM r GROUP BY n""")
def similarity_components(s, d):
    t = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    near = t.where("vec_id % 3 = 0").select((F.col("vec_id") * 3 + 1).alias("id"), F.transform("v", lambda x, i: F.when(i < 8, x + 0.01).otherwise(x)).alias("v"))
    both = t.select((F.col("vec_id") * 3).alias("id"), "v").unionByName(near).unionByName(t.where("vec_id % 5 = 0").select((F.col("vec_id") * 3 + 2).alias("id"), "v"))
    return dedup.similarity_groups(both, "id", "v", threshold=0.85, recall=0.99)


# ---- selection


@query("quota_fill", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 20")
def quota(s, d):
    return select.quota(table(s, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 20).select("doc_id", "source")


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 30")
def stratified(s, d):
    return select.stratified(table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 30)


@query("shuffled_head", "SELECT item_id FROM benchmark ORDER BY md5('0:' || item_id), item_id LIMIT 20")
def shuffled(s, d):
    return select.shuffled_head(table(s, d, "benchmark").select("item_id"), "item_id", 20)


@query("train_test_split", f"SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5('0:' || doc_id), 1, 13)) AS BIGINT) / {16**13}::DOUBLE < 0.1 THEN 'test' ELSE 'train' END AS split FROM documents")
def split(s, d):
    return select.split_by_hash(table(s, d, "documents").select("doc_id"), "doc_id")


U = "(('0x' || substr(md5({}), 1, 13))::BIGINT / {}::DOUBLE)".format("{}", 16**13)
SHARES = "g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT source, n, (sum(n) OVER (ORDER BY source) - n) / (SELECT sum(n) FROM g) AS lo FROM g)"


@query("weighted_group_draws", f"""WITH {SHARES}, u AS (SELECT d AS draw, {U.format("'0:' || d")} AS u FROM range(200) t(d))
SELECT draw, source FROM u JOIN e ON lo <= u QUALIFY row_number() OVER (PARTITION BY draw ORDER BY lo DESC) = 1""")
def draws(s, d):
    return select.weighted_draws(stats.sizes(table(s, d, "documents"), "source"), "source", "size", 200)


@query("draws_with_examples", f"""WITH {SHARES}, u AS (SELECT d AS draw, {U.format("'0:' || d")} AS u, {U.format("'1:' || d")} AS v FROM range(200) t(d)),
w AS (SELECT draw, v, source, n FROM u JOIN e ON lo <= u QUALIFY row_number() OVER (PARTITION BY draw ORDER BY lo DESC) = 1),
k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) - 1 AS i FROM documents)
SELECT draw, w.source, place::INT AS place, doc_id FROM w CROSS JOIN range(3) t(place) JOIN k ON k.source = w.source AND k.i = (floor(v * n)::BIGINT + place) % n WHERE place < n""")
def draws_with_examples(s, d):
    return select.draws_with_examples(table(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 200).withColumn("place", F.col("place").cast("int"))


@query("zero_runs", """SELECT min(vec_id) AS first, max(vec_id) AS last, count(*) AS length FROM (SELECT vec_id, vec_id - row_number() OVER (ORDER BY vec_id) AS g FROM embeddings WHERE label < 4) GROUP BY g""")
def zero_runs(s, d):
    """Vectors of some labels are set to zero."""
    e = table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(F.col("label") < 4, 0.0).otherwise(x)).alias("v"))
    return vectors.runs(e, "vec_id", ~F.exists("v", lambda x: x != 0))


@query("mmr_select")
def mmr(s, d):
    e = table(s, d, "embeddings").withColumn("score", select.md5_uniform(F.col("vec_id"))).withColumn("source", F.pmod("vec_id", F.lit(4)))
    return select.mmr(e, "label", "vec_id", "embedding", "score", "source", 20)


@query("curate_full")
def curate(s, d):
    e = table(s, d, "embeddings").withColumn("score", select.md5_uniform(F.col("vec_id"))).withColumn("source", F.pmod("vec_id", F.lit(4)))
    c = vectors.mean_centroids(e, "label", "embedding")
    picked = curation.curate(e, c, "vec_id", "embedding", "score", "source", most=20)
    return curation.curation_stats(picked, e, "vec_id", "score")


@query("kmeans_clusters")
def kmeans(s, d):
    _, out = select.kmeans(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", 10)
    return out.select("vec_id", "cluster_id")


@query("bleu_share_penalty")
def bleu(s, d):
    turns = penalty.batches(table(s, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], "text")
    return penalty.share_penalty(turns, "batch", ["conv_id", "turn", "copy"], "text")


@query("mock_generation", "SELECT item_id, CAST(s AS INTEGER) AS sample, 'Therefore \\boxed{' || ('0x' || substr(md5(text || '#' || s), 1, 8))::BIGINT % 7 || '}' AS reply FROM benchmark, range(3) r(s)")
def mock(s, d):
    g = models.generator()
    return models.fan_out(table(s, d, "benchmark"), 3).withColumn("reply", g(F.concat_ws("#", "text", "sample"))).select("item_id", "sample", "reply")


# ---- statistics


@query("cluster_stats", "SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS clusters, round(count(*) / 20.0, 6)::DOUBLE AS coverage, min(c) AS smallest, max(c) AS largest, round(avg(c), 6) AS mean, round(median(c), 6)::DOUBLE AS median, round(stddev_pop(c), 6) AS std, " + ", ".join(f"round(quantile_cont(c, {p / 100}), 6)::DOUBLE AS p{p}" for p in (25, 75, 90, 95, 99)) + " FROM (SELECT user_id, count(*) AS c FROM events GROUP BY 1)")
def cluster_stats(s, d):
    out = stats.cluster_statistics(stats.sizes(table(s, d, "events"), "user_id"), k=20)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("cluster_entropy", "WITH c AS (SELECT source, count(*) AS c FROM documents GROUP BY 1), t AS (SELECT *, c / sum(c) OVER () AS p, count(*) OVER () AS n FROM c) SELECT round(-sum(p * ln(p + 1e-10)), 6) AS entropy, round(ln(max(n)), 6) AS max_entropy, round(-sum(p * ln(p + 1e-10)) / ln(max(n)), 6) AS normalized FROM t")
def entropy(s, d):
    out = stats.entropy(stats.sizes(table(s, d, "documents"), "source"))
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query("cluster_gini", "WITH c AS (SELECT user_id, count(*)::DOUBLE AS s FROM events GROUP BY 1), r AS (SELECT s, row_number() OVER (ORDER BY s) AS i, row_number() OVER (ORDER BY s DESC) AS d FROM c) SELECT round(2 * sum(i * s) / (count(*) * sum(s)) - (count(*) + 1) / count(*), 6) AS gini, round(sum(CASE WHEN d <= 10 THEN s ELSE 0 END) / sum(s), 6) AS top_share, round(max(s) / min(s), 6) AS max_min_ratio FROM r")
def gini(s, d):
    out = stats.gini(stats.sizes(table(s, d, "events"), "user_id"))
    return out.select(*[r6(F.col(c), c) for c in out.columns])


@query("cluster_topk", "SELECT user_id, count(*) AS size FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def topk(s, d):
    return stats.top(stats.sizes(table(s, d, "events"), "user_id"), "size", "user_id")


@query("unit_histogram", "WITH v AS (SELECT value - floor(value) AS s FROM events), h AS (SELECT least(floor(s * 20), 19)::BIGINT AS bin, count(*) AS n FROM v GROUP BY 1) SELECT b AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(20)) AS b) LEFT JOIN h ON b = bin")
def histogram(s, d):
    return stats.unit_histogram(table(s, d, "events"), F.col("value") - F.floor("value"))


@query("range_histogram", "WITH m AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT least(floor((n_chars - lo) / (hi - lo) * 11), 10)::BIGINT AS bin, count(*) AS n FROM documents, m GROUP BY 1")
def range_histogram(s, d):
    return stats.range_histogram(table(s, d, "documents"), "n_chars")


@query("difficulty_buckets", "WITH v AS (SELECT value - floor(value) AS s FROM events) SELECT CASE WHEN s < 0.2 THEN 0 WHEN s < 0.4 THEN 1 WHEN s < 0.6 THEN 2 WHEN s < 0.8 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM v GROUP BY 1")
def buckets(s, d):
    b = stats.bucket(F.col("value") - F.floor("value"), [0, 0.2, 0.4, 0.6, 0.8, 1.0])
    return table(s, d, "events").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("accuracy_rollup", "SELECT coalesce(l_returnflag, 'ALL') AS category, count(*) AS n, round(avg((l_quantity > 25)::INT), 6) AS accuracy FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def accuracy(s, d):
    return stats.accuracy_rollup(table(s, d, "lineitem"), "l_returnflag", F.col("l_quantity") > 25).withColumn("accuracy", F.round("accuracy", 6))


STATUS = {"click": "matched", "view": "wrong", "purchase": "mismatched"}


@query("validation_report", "SELECT user_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {v}" for k, v in STATUS.items()) + ", count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) AS error, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS match_rate FROM events GROUP BY 1 HAVING count(*) >= 5")
def validation(s, d):
    st = F.lit("error")
    for k, v in STATUS.items():
        st = F.when(F.col("event_type") == k, v).otherwise(st)
    return stats.match_report(table(s, d, "events"), "user_id", st).withColumn("match_rate", F.round("match_rate", 6))


@query("weighted_mean_merge", "WITH p AS (SELECT user_id % 16 AS c, event_type AS st, avg(value) AS m, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT c, sum(n) AS v, sum(m * n) / sum(n) AS m FROM p GROUP BY 1) SELECT k AS cluster_id, CAST(coalesce(v, 0) AS BIGINT) AS visits, round(m, 6) AS mean, round(100 * coalesce(v, 0) / sum(v) OVER (), 6) AS share_pct FROM (SELECT unnest(range(20)) AS k) LEFT JOIN g ON k = c")
def weighted(s, d):
    per = table(s, d, "events").groupBy((F.col("user_id") % 16).alias("c"), "event_type").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    return stats.weighted_merge(per, "c", "m", "n", 20).select("cluster_id", "visits", r6(F.col("mean"), "mean"), r6(F.col("share_pct"), "share_pct"))


@query("first_last_means", "WITH m AS (SELECT user_id, CAST(day(ts) AS BIGINT) AS st, avg(value) AS m FROM events GROUP BY ALL) SELECT user_id, round(arg_min(m, st), 6) AS first_mean, round(arg_max(m, st), 6) AS last_mean, count(*) AS steps, round(arg_max(m, st) - arg_min(m, st), 6) AS improvement FROM m GROUP BY 1")
def first_last(s, d):
    out = stats.first_last(table(s, d, "events").withColumn("st", F.dayofmonth("ts")), "user_id", "st", "value")
    return out.select("user_id", r6(F.col("first_mean"), "first_mean"), r6(F.col("last_mean"), "last_mean"), "steps", r6(F.col("improvement"), "improvement"))


@query("masked_moments", "SELECT user_id, round(avg(value) FILTER (event_type <> 'view'), 6) AS masked_mean, round(var_samp(value) FILTER (event_type <> 'view'), 6) AS masked_var FROM events GROUP BY 1")
def masked(s, d):
    out = stats.masked(table(s, d, "events"), "user_id", F.col("value"), F.col("event_type") != "view")
    return out.select("user_id", r6(F.col("masked_mean"), "masked_mean"), r6(F.col("masked_var"), "masked_var"))


@query("metric_summary", "SELECT round(avg(value), 6) AS value_mean, max(value) AS value_max, min(value) AS value_min FROM events")
def summary(s, d):
    return stats.summary(table(s, d, "events"), ["value"]).withColumn("value_mean", F.round("value_mean", 6))


# ---- group-relative analytics


@query("grpo_zscore", "SELECT event_id, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def zscore(s, d):
    return advantage.z_score(table(s, d, "events"), "user_id", "value").select("event_id", r6(F.col("advantage"), "advantage"))


@query("leave_one_out", "SELECT event_id, round(value - (sum(value) OVER w - value) / (count(*) OVER w - 1), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def loo(s, d):
    return advantage.leave_one_out(table(s, d, "events"), "user_id", "value").select("event_id", r6(F.col("advantage"), "advantage"))


SEQ = "WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)"


@query("discounted_return", SEQ + "SELECT a.user_id, a.t, round(sum(b.value / 7 * pow(0.9, b.t - a.t)), 6) AS ret FROM e a JOIN e b ON a.user_id = b.user_id AND b.t >= a.t GROUP BY ALL")
def discounted(s, d):
    e = table(s, d, "events").select("user_id", "ts", "event_id", (F.col("value") / 7).alias("v"))
    out = scans.positions(scans.discounted(e, "user_id", ARRIVAL, F.col("v"), 0.9), "user_id", ARRIVAL, F.lit(1))
    return out.select("user_id", (F.col("position") + 1).cast("long").alias("t"), F.round("returns", 6).alias("ret"))


@query("gae", SEQ + ", d AS (SELECT user_id, t, value / 100 AS v, value - floor(value) + 0.99 * coalesce(lead(value / 100) OVER (PARTITION BY user_id ORDER BY t), 0) - value / 100 AS dl FROM e) SELECT a.user_id, a.t, round(sum(b.dl * pow(0.99 * 0.95, b.t - a.t)), 5) AS advantage, round(sum(b.dl * pow(0.99 * 0.95, b.t - a.t)) + a.v, 5) AS \"return\" FROM d a JOIN d b ON a.user_id = b.user_id AND b.t >= a.t GROUP BY a.user_id, a.t, a.v")
def gae(s, d):
    e = table(s, d, "events").withColumn("rw", F.col("value") - F.floor("value")).withColumn("vl", F.col("value") / 100)
    return advantage.gae(e, "user_id", ARRIVAL, "rw", "vl").select("user_id", F.col("t").cast("long").alias("t"), F.round("advantage", 5).alias("advantage"), F.round("return", 5).alias("return"))


@query("kl_estimators", "SELECT event_id, round(x, 6) AS kl, round(abs(x), 6) AS abs, round(0.5 * x * x, 6) AS mse, round(greatest(-10, least(10, exp(-x) + x - 1)), 6) AS low_var_kl FROM (SELECT event_id, (value - floor(value)) - 0.5 AS x FROM events)")
def kl(s, d):
    p, q = F.col("value") - F.floor("value"), F.lit(0.5)
    return table(s, d, "events").select("event_id", *[r6(advantage.kl(p, q, k), k) for k in ("kl", "abs", "mse", "low_var_kl")])


@query("clipped_losses", "SELECT event_id, round(greatest(-a * exp(x), -a * greatest(0.8, least(1.2, exp(x)))), 6) AS loss, -a * greatest(0.8, least(1.2, exp(x))) > -a * exp(x) AS clipped FROM (SELECT event_id, (value - floor(value)) - 0.5 AS x, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS a FROM events)")
def clipped(s, d):
    out = advantage.clipped_policy_loss(F.col("value") - F.floor("value"), F.lit(0.5), F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0))
    return table(s, d, "events").select("event_id", r6(out["loss"], "loss"), out["clipped"].alias("clipped"))


@query("lr_schedules", "SELECT s AS step, least(1.0, s / 10.0)::DOUBLE AS constant, round(CASE WHEN s < 10 THEN s / 10.0 ELSE greatest(0, 0.5 * (1 + cos(pi() * (s - 10) / 90.0))) END, 6)::DOUBLE AS cosine FROM (SELECT DISTINCT event_id // 64 AS s FROM events)")
def schedules(s, d):
    st = F.col("step")  # batches of 64 events
    steps = table(s, d, "events").select(F.floor(F.col("event_id") / 64).cast("long").alias("step")).distinct()
    return steps.select(st, advantage.warmup_constant(st, 10).alias("constant"), r6(advantage.warmup_cosine(st, 10, 100), "cosine"))


# ---- graph (sets: event types per user, sources per language)


def user_sets(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "event_type", F.pmod(F.floor("value"), F.lit(7))))).alias("items"))


SETS = "WITH s AS (SELECT DISTINCT user_id, event_type || ':' || CAST(floor(value) % 7 AS BIGINT) AS x FROM events), e AS (SELECT a.x AS src, b.x AS dst, count(*) AS weight FROM s a JOIN s b ON a.user_id = b.user_id AND a.x <> b.x GROUP BY ALL HAVING count(*) >= 100)"


@query("cooccurrence_graph", SETS + " SELECT * FROM e")
def cooc(s, d):
    return graph.cooccurrence(user_sets(s, d), "items", 100)


@query("two_hop", SETS + " SELECT a.src, b.dst, count(*) AS paths FROM e a JOIN e b ON a.dst = b.src GROUP BY ALL")
def two_hop(s, d):
    return graph.two_hop(graph.cooccurrence(user_sets(s, d), "items", 100))


@query("induced_density", SETS + " , p AS (SELECT a.user_id, a.x AS src, b.x AS dst FROM s a JOIN s b ON a.user_id = b.user_id AND a.x < b.x) SELECT u.user_id, round(coalesce(count(e.src) / nullif(count(p.src), 0), 0), 6)::DOUBLE AS density FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN p USING (user_id) LEFT JOIN e ON p.src = e.src AND p.dst = e.dst GROUP BY 1")
def density(s, d):
    sets = user_sets(s, d)
    return graph.induced_density(sets, "user_id", "items", graph.cooccurrence(sets, "items", 100)).withColumn("density", F.round("density", 6))


@query("vocabulary_counts", "SELECT event_type || ':' || CAST(floor(value) % 7 AS BIGINT) AS item, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def vocabulary(s, d):
    return graph.vocabulary(user_sets(s, d), "items")


@query("semi_vocab", SETS + ", v AS (SELECT x FROM s GROUP BY 1 HAVING count(*) >= 120) SELECT * FROM e WHERE src IN (SELECT x FROM v) AND dst IN (SELECT x FROM v)")
def semi(s, d):
    sets = user_sets(s, d)
    return graph.prune(graph.cooccurrence(sets, "items", 100), graph.vocabulary(sets, "items").where("n >= 120"))


@query("connected_components", "WITH RECURSIVE e AS (SELECT DISTINCT user_id AS u, 1000000 + CAST(floor(value * 1000) AS BIGINT) AS v FROM events), b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(n, m) AS (SELECT u, u FROM e UNION SELECT b.v, r.m FROM r JOIN b ON r.n = b.u) SELECT n AS node, min(m) AS component FROM r GROUP BY n")
def comps(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("src"), (F.lit(1000000) + F.floor(F.col("value") * 1000)).cast("long").alias("dst"))
    return components.connected_components(e)


# ---- batches, joins, streams


# Documents as dense rows: doc_id counts from 0.


def doc_rows(s, d, *more):
    return table(s, d, "documents").select(F.col("doc_id").alias("row"), *more)


@query("repeat_interleave", "SELECT doc_id AS row, r AS rep, doc_id * 3 + r AS position FROM documents, range(3) t(r)")
def repeat(s, d):
    return batch.repeat(doc_rows(s, d), 3, "row").select("row", "rep", "position")


@query("pad_to_divisor", """SELECT doc_id AS row, source, false AS padded FROM documents
UNION ALL SELECT n + i, source, true FROM (SELECT count(*) AS n FROM documents), range(48) t(i) JOIN documents ON doc_id = i WHERE i < (48 - n % 48) % 48""")
def pad(s, d):
    return batch.pad_to_divisor(doc_rows(s, d, "source"), 48, "row")


@query("chunk_rows", "SELECT doc_id AS row, floor(doc_id * 7 / (SELECT count(*) FROM documents))::BIGINT AS chunk FROM documents")
def chunk(s, d):
    return batch.chunk(doc_rows(s, d), 7, "row")


@query("reorder_rows", "SELECT (SELECT max(doc_id) FROM documents) - doc_id AS position, source FROM documents")
def reorder(s, d):
    n = doc_rows(s, d, "source")
    order = n.select("row").crossJoin(F.broadcast(n.agg(F.max("row").alias("last")))).select((F.col("last") - F.col("row")).alias("position"), "row")  # one row
    return batch.reorder(n, order, "row").select("position", "source")


@query("column_union", "SELECT doc_id AS row, source, lang FROM documents")
def column_union(s, d):
    n = doc_rows(s, d, "source", "lang")
    return batch.column_union(n.select("row", "source"), n, "row")


@query("positional_join", "SELECT source, html[:9] AS head FROM documents JOIN pages ON doc_id = page_id")
def positional(s, d):
    pages = table(s, d, "pages").select(F.col("page_id").alias("row"), F.substring("html", 1, 9).alias("head"))
    return batch.zip_join(doc_rows(s, d, "source"), pages, "row").select("source", "head")


@query("resume_antijoin", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def resume(s, d):
    from millrace.sources.writers import remaining

    done = table(s, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return remaining(table(s, d, "customer").select("c_custkey"), done, "c_custkey")


@query("leftjoin_fallback", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'doc-' || d.doc_id) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def fallback(s, d):
    l = table(s, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return joins.left_with_fallback(table(s, d, "documents").select("doc_id"), l, ["doc_id"], "quality", F.concat(F.lit("doc-"), F.col("doc_id"))).select("doc_id", "quality")


@query("probe_join", "SELECT 'Name ' || doc_id AS name, doc_id AS found FROM documents")
def probe(s, d):
    name = F.concat(F.lit("Name "), F.col("doc_id"))
    key = F.when(F.col("doc_id") % 3 == 0, name).when(F.col("doc_id") % 3 == 1, F.lower(name)).otherwise(F.concat(F.lit("concept:"), F.lower(name)))
    n = table(s, d, "documents").select(name.alias("name"), key.alias("k"), F.col("doc_id").alias("found"))
    return joins.probe(n.select("name"), "name", n.select("k", "found"), "k", "found")


@query("ema_counts", "WITH b AS (SELECT event_id // 1000 AS b, user_id % 16 AS c, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT b, row_number() OVER (ORDER BY b) AS t FROM (SELECT DISTINCT b FROM b)), m AS (SELECT max(t) AS T FROM t) SELECT k AS cluster_id, round(pow(0.9, (SELECT T FROM m)) + coalesce((SELECT sum(0.1 * pow(0.9, (SELECT T FROM m) - t) * n) FROM b JOIN t USING (b) WHERE c = k), 0), 6) AS count FROM (SELECT unnest(range(20)) AS k)")
def ema(s, d):
    e = table(s, d, "events").select(F.floor(F.col("event_id") / 1000).alias("b"), (F.col("user_id") % 16).alias("c"))
    return state.ema_closed_form(e, "b", "c", 20).withColumn("count", F.round("count", 6))


@query("kk_partition")
def kk(s, d):
    docs = table(s, d, "documents").select(F.floor(F.col("doc_id") / 256).cast("long").alias("batch"), "doc_id", "n_chars")
    return select.partition_batches(docs, "batch", "doc_id", "n_chars", 8)
