"""Registered queries of text functions over conversations and documents with answers written into them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import grading, rewards, text
from millrace.plans.registry import query
from millrace.session import table

#: Stands for a turn's number among the endings.
TURN = None
ENDS = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def sql_strip(x: str) -> str:
    return f"trim({x}, {ENDS})"


def turn():
    return F.col("turn").cast("string")


def made(s, d, endings, base=None):
    """``(conv_id, turn, t)``: every turn with the ending of its number modulo their count behind it."""
    t = F.translate("text", "{}", "[]") if base is None else base
    out = None
    for i, e in enumerate(endings):
        hit, value = F.col("conv_id") % len(endings) == i, F.concat(t, *[turn() if x is TURN else F.lit(x) for x in e])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return table(s, d, "conversations").select("conv_id", "turn", out.alias("t"))


def made_sql(endings: list[str], base: str = "translate(text, '{}', '[]')") -> str:
    cases = " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(endings))
    return f"(SELECT conv_id, turn, {base} || CASE conv_id % {len(endings)} {cases} END AS t FROM conversations)"


BOXES = [(), (" so \\boxed{", TURN, "} holds"), (" \\boxed{1} then \\boxed{\\frac{", TURN, "}{2}}."), (" \\boxed{ a{b{", TURN, "}} }"), (" \\boxed{x} \\boxed{open", TURN), ("\\boxed{}",)]
BOXES_SQL = made_sql(["''", "' so \\boxed{' || turn || '} holds'", "' \\boxed{1} then \\boxed{\\frac{' || turn || '}{2}}.'", "' \\boxed{ a{b{' || turn || '}} }'", "' \\boxed{x} \\boxed{open' || turn", "'\\boxed{}'"])
BOX = r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


@query("boxed_answers", f"""SELECT conv_id, turn, {sql_strip("a[-1]")} AS last, a[1] AS first, md5(regexp_replace(t, '{BOX}', '', 'g')) AS rest,
'[' || array_to_string(CASE WHEN regexp_matches(t, '\\\\boxed\\{{[^{{}}]*$') THEN list_append(a, regexp_extract(t, '\\\\boxed\\{{([^{{}}]*)[^{{}}]$', 1)) ELSE a END, ', ') || ']' AS every, contains(t, '\\boxed{{') AS boxed
FROM (SELECT *, regexp_extract_all(t, '{BOX}', 1) AS a FROM {BOXES_SQL})""")
def boxed(s, d):
    every = F.concat(F.lit("["), F.array_join(text.boxed_all(F.col("t")), ", "), F.lit("]"))
    return made(s, d, BOXES).select("conv_id", "turn", text.boxed_last(F.col("t")).alias("last"), text.boxed_first(F.col("t")).alias("first"), F.md5(text.boxed_stripped(F.col("t"))).alias("rest"), every.alias("every"), text.has_boxed(F.col("t")).alias("boxed"))


@query("boxed_regex_last", f"SELECT conv_id, turn, regexp_extract_all(t, '{BOX}', 1)[-1] AS last FROM {BOXES_SQL}")
def boxed_regex(s, d):
    return made(s, d, BOXES).select("conv_id", "turn", text.boxed_regex_last(F.col("t")).alias("last"))


FINALS = [(), ("\nThe answer is: ", TURN, ".5\nbye"), (" Final answer : 7 \n"), (" \\boxed{ 3 } The answer is 4."), ("\n  last ", TURN, " \n\n")]
FINALS = [e if isinstance(e, tuple) else (e,) for e in FINALS]
FINALS_SQL = made_sql(["''", "chr(10) || 'The answer is: ' || turn || '.5' || chr(10) || 'bye'", "' Final answer : 7 ' || chr(10)", "' \\boxed{ 3 } The answer is 4.'", "chr(10) || '  last ' || turn || ' ' || chr(10) || chr(10)"])


@query("answer_cascade", f"""SELECT conv_id, turn, md5({sql_strip("CASE WHEN regexp_matches(t, '\\\\boxed\\{[^}]+\\}') THEN regexp_extract(t, '\\\\boxed\\{([^}]+)\\}', 1) WHEN regexp_matches(t, '[Tt]he answer is[:\\s]+[^\\n.]') THEN regexp_extract(t, '[Tt]he answer is[:\\s]+([^\\n.]+)', 1) WHEN regexp_matches(t, '[Ff]inal answer[:\\s]+[^\\n.]') THEN regexp_extract(t, '[Ff]inal answer[:\\s]+([^\\n.]+)', 1) ELSE string_split(" + sql_strip("t") + ", chr(10))[-1] END")}) AS answer FROM {FINALS_SQL}""")
def cascade(s, d):
    return made(s, d, FINALS).select("conv_id", "turn", F.md5(text.answer_cascade(F.col("t"))).alias("answer"))


CHATS = [("\nFinal Answer: 1\nFinal Answer: 2 < 3\n<|im_end|> \\boxed{no}",), ("<|im_start|>user q \\boxed{u}<|im_start|>assistant so \\boxed{", TURN, "}</s> \\boxed{late}"), ("Assistant: x Assistant:  The answer is: a<\nb\nThe answer is: <<c\n",), ("<|endoftext|>",)]
CHATS_SQL = made_sql(["chr(10) || 'Final Answer: 1' || chr(10) || 'Final Answer: 2 < 3' || chr(10) || '<|im_end|> \\boxed{no}'", "'<|im_start|>user q \\boxed{u}<|im_start|>assistant so \\boxed{' || turn || '}</s> \\boxed{late}'", "'Assistant: x Assistant:  The answer is: a<' || chr(10) || 'b' || chr(10) || 'The answer is: <<c' || chr(10)", "'<|endoftext|>'"])
CUT = f"""SELECT conv_id, turn, CASE WHEN contains(t, '<|im_start|>user') THEN regexp_replace(t, '(?s)^.*?<\\|im_start\\|>assistant', '<|im_start|>assistant') WHEN contains(t, 'Assistant:') THEN {sql_strip("string_split(t, 'Assistant:')[-1]")} ELSE t END AS t FROM {CHATS_SQL}"""
for _stop in ("</s>", "<|im_end|>", "<|endoftext|>"):
    CUT = f"""SELECT conv_id, turn, CASE WHEN contains(t, '{_stop}') THEN {sql_strip(f"split_part(t, '{_stop}', 1)")} ELSE t END AS t FROM ({CUT})"""


@query("final_answer", f"SELECT conv_id, turn, coalesce(nullif(regexp_extract_all(t, '{BOX}', 1)[-1], ''), regexp_extract_all(t, 'Final Answer:((?:[^<]|<[^<])*?)\\n', 1)[-1], regexp_extract_all(t, 'The answer is:((?:[^<]|<[^<])*?)\\n', 1)[-1]) AS answer FROM ({CUT})")
def final(s, d):
    return made(s, d, CHATS).select("conv_id", "turn", text.final_answer(F.col("t")).alias("answer"))


TAGS = [("<question> a ", TURN, " </question>"), ("<question>\n open </answer> \n",), ("<question><b>bold</b></question>",), ("<question>one<answer>two",), ("<question> </question>",), ()]
TAGS_SQL = made_sql(["'<question> a ' || turn || ' </question>'", "'<question>' || chr(10) || ' open </answer> ' || chr(10)", "'<question><b>bold</b></question>'", "'<question>one<answer>two'", "'<question> </question>'", "''"], "replace(text, '<', '(')")
RAW = f"""SELECT conv_id, turn, {sql_strip("CASE WHEN regexp_matches(t, '(?s)<question>.*?</question>') THEN regexp_extract(t, '(?s)<question>(.*?)</question>', 1) WHEN contains(t, '<question>') THEN regexp_extract(t, '(?s)<question>\\s*(.*?)(?:<[a-zA-Z_]+>|$)', 1) END")} AS r FROM {TAGS_SQL}"""


@query("tag_tolerant", f"""SELECT conv_id, turn, nullif({sql_strip("regexp_replace(r, '</?[a-zA-Z_]+>$', '')")}, '') AS content FROM (SELECT conv_id, turn, CASE WHEN NOT regexp_matches(r, '^<[a-zA-Z_]+>') THEN r END AS r FROM ({RAW}))""")
def tolerant(s, d):
    return made(s, d, TAGS, F.replace(F.col("text"), F.lit("<"), F.lit("("))).select("conv_id", "turn", text.tag_tolerant(F.col("t"), "question").alias("content"))


SCORES = [("Clarity: 7.5 of 10",), ("clarity = 3",), ("CLARITY: [", TURN, ".25]",), ("clarity: 1.2.3 clarity = 4",), ("none",)]
SCORES_SQL = made_sql(["'Clarity: 7.5 of 10'", "'clarity = 3'", "'CLARITY: [' || turn || '.25]'", "'clarity: 1.2.3 clarity = 4'", "'none'"])


@query("named_score", "SELECT conv_id, turn, coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(t, '(?i)clarity{p}', 1), '') AS DOUBLE)" for p in (":\\s*([\\d.]+)", "\\s*=\\s*([\\d.]+)", ":\\s*\\[([\\d.]+)\\]")) + f", 0.0)::DOUBLE AS score FROM {SCORES_SQL}")
def named(s, d):
    return made(s, d, SCORES).select("conv_id", "turn", text.named_score(F.col("t"), "clarity").alias("score"))


JSONS = [(' {"a": ', TURN, ', "b": "x\\frac{1}{2}"} tail',), (' {"a": 1, "b": "\\alpha"}',), ("no braces",), (" {broken",), (' {"a": 2, "b": {"c": 3}} ',)]
JSONS_SQL = made_sql(["' {\"a\": ' || turn || ', \"b\": \"x\\frac{1}{2}\"} tail'", "' {\"a\": 1, \"b\": \"\\alpha\"}'", "'no braces'", "' {broken'", "' {\"a\": 2, \"b\": {\"c\": 3}} '"])


@query("first_json", f"""SELECT conv_id, turn, coalesce(CAST(json_extract(j, '$.a') AS BIGINT), -1) AS a FROM (SELECT conv_id, turn, CASE WHEN json_valid(r) THEN r WHEN json_valid(regexp_replace(r, '\\\\([^"\\\\/bfnrtu])', '\\\\\\\\\\1', 'g')) THEN regexp_replace(r, '\\\\([^"\\\\/bfnrtu])', '\\\\\\\\\\1', 'g') END AS j
FROM (SELECT conv_id, turn, nullif(regexp_extract(t, '(?s)\\{{.*\\}}'), '') AS r FROM {JSONS_SQL}))""")
def first_json(s, d):
    return made(s, d, JSONS).select("conv_id", "turn", F.coalesce(text.first_json(F.col("t"), "a long, b string")["a"], F.lit(-1)).alias("a"))


@query("template_render", "SELECT conv_id, turn, md5('Q{{unknown}}: ' || text || ' [' || role || '] $1 \\ {\"turn\":' || turn || '}') AS h FROM conversations")
def render(s, d):
    row = {"text": F.col("text"), "role": F.col("role"), "meta": F.to_json(F.struct("turn"))}
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(text.render(F.lit("Q{{unknown}}: {{ text }} [{{role}}] $1 \\ {{meta }}"), row)).alias("h"))


@query("prompt_texts", "SELECT conv_id, turn, md5('system: ' || role || chr(10) || 'user: ' || text) AS chat, '(A): ' || role || chr(10) || '(B): ' || turn AS options FROM conversations")
def prompts(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(text.chat_prompt(F.col("role"), F.col("text"))).alias("chat"), text.options_text(F.array("role", turn())).alias("options"))


@query("answer_normalize_c", f"""SELECT conv_id, turn, md5(regexp_replace({sql_strip("trim(" + sql_strip("t") + ", '$')")}, '[\\s\\v]+', ' ', 'g')) AS h FROM (SELECT conv_id, turn, ' $$ ' || text || chr(9) || '$' AS t FROM conversations)""")
def norm_c(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(text.normalize_c(F.concat(F.lit(" $$ "), "text", F.lit("\t$")))).alias("h"))


BBEH = [(" The answer is: $\\boxed{A, B}$.",), ("The final answer is \\text{Yes **really**}\nmore.",), ("\nThe answer is 12.",), ("no prefix ",), ("The final answer is: texttt{Z}",)]
BBEH_SQL = made_sql(["' The answer is: $\\boxed{A, B}$.'", "'The final answer is \\text{Yes **really**}' || chr(10) || 'more.'", "chr(10) || 'The answer is 12.'", "'no prefix '", "'The final answer is: texttt{Z}'"])


def _bbeh() -> str:
    q = f"SELECT conv_id, turn, {sql_strip('t')} AS t FROM {BBEH_SQL}"
    for p in text.ANSWER_PREFIXES:
        q = f"""SELECT conv_id, turn, CASE WHEN contains(t, '{p}') THEN {sql_strip(f"string_split(t, '{p}')[-1]")} ELSE t END AS t FROM ({q})"""
    q = f"SELECT conv_id, turn, CASE WHEN t LIKE '%.' THEN left(t, -1) ELSE t END AS t FROM ({q})"
    q = f"SELECT conv_id, turn, CASE WHEN length(t) > 1 AND t LIKE '$%' AND t LIKE '%$' THEN t[2:-2] ELSE t END AS t FROM ({q})"
    for m in text.LATEX_MARKS:
        q = f"SELECT conv_id, turn, CASE WHEN contains(t, '{m}') AND t LIKE '%}}' THEN string_split(left(t, -1), '{m}')[2] ELSE t END AS t FROM ({q})"
    q = f"SELECT conv_id, turn, split_part(replace(replace(lower(t), ', ', ','), '**', ''), chr(10), 1) AS t FROM ({q})"
    return f"SELECT conv_id, turn, md5(CASE WHEN t LIKE '%.' THEN left(t, -1) ELSE t END) AS h FROM ({q})"


@query("bbeh_prediction", _bbeh())
def bbeh(s, d):
    return made(s, d, BBEH).select("conv_id", "turn", F.md5(text.bbeh_prediction(F.col("t"))).alias("h"))


@query("list_splits", f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: {sql_strip('x')}), lambda x: x <> ''), '|') AS golds,
array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[;|,\\n\\t]'), lambda x: {sql_strip('x')}), lambda x: x <> ''), '#') AS concepts, lower(role || ':' || turn) AS key,
regexp_matches(lower(text), 'quota|insufficient|rate limit|429') AS quota FROM conversations""")
def splits(s, d):
    t = F.col("text")
    return table(s, d, "conversations").select(
        "conv_id", "turn", F.array_join(text.split_gold(t), "|").alias("golds"), F.array_join(text.active_concepts(t), "#").alias("concepts"), text.concept_key(F.col("role"), turn()).alias("key"), text.is_quota_error(t).alias("quota")
    )


CHOICES = [("\\boxed{c}",), ("\\boxed{option B or D}",), ("\\boxed{12}",), ("",), (" \\boxed{\\text{ e }}",)]
CHOICES_SQL = made_sql(["'\\boxed{c}'", "'\\boxed{option B or D}'", "'\\boxed{12}'", "''", "' \\boxed{\\text{ e }}'"])


@query("choice_letters", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(upper(b), '\\b[A-Z]\\b') THEN regexp_extract(upper(b), '\\b([A-Z])\\b', 1) ELSE {sql_strip('b')} END AS letter, coalesce(regexp_matches({sql_strip('b')}, '^[A-Za-z]$'), false) AS single
FROM (SELECT conv_id, turn, regexp_extract_all(t, '{BOX}', 1)[-1] AS b FROM {CHOICES_SQL})""")
def choices(s, d):
    return made(s, d, CHOICES).select("conv_id", "turn", text.choice_in_box(F.col("t")).alias("letter"), F.coalesce(text.is_choice(text.boxed_regex_last(F.col("t"))), F.lit(False)).alias("single"))


FORMS = [("<think> a </think> \\boxed{1}",), (" b \\boxed{2}",), ("<think>x</think> <answer>y</answer>",), ("<think> open \\boxed{3}",)]
FORMS_SQL = made_sql(["'<think> a </think> \\boxed{1}'", "' b \\boxed{2}'", "'<think>x</think> <answer>y</answer>'", "'<think> open \\boxed{3}'"], "CASE WHEN turn = 0 THEN '' ELSE translate(text, '{}', '[]') END")


@query("format_rewards", f"""SELECT conv_id, turn, CASE WHEN NOT regexp_matches(t, '(?s)\\\\boxed\\{{.+\\}}') THEN 0 WHEN len(regexp_extract_all(split_part(t, '\\boxed{{', 1), '[^\\s\\v\\x{{85}}\\x{{A0}}\\p{{Z}}]+')) >= 20 THEN 1 ELSE 0.5 END::DOUBLE AS boxed,
regexp_full_match(t, '(?s)<think>.*</think>.*\\\\boxed\\{{.*\\}}.*')::INT::DOUBLE AS think, regexp_full_match(t, '(?s)<think>.*?</think>\\s*<answer>.*?</answer>')::INT::DOUBLE AS tags,
round(0.7 * (turn % 2) + 0.1 * regexp_full_match(t, '(?s)<think>.*</think>.*\\\\boxed\\{{.*\\}}.*')::INT + 0.2 * 0.5, 6)::DOUBLE AS blend FROM {FORMS_SQL}""")
def forms(s, d):
    base = F.when(F.col("turn") == 0, "").otherwise(F.translate("text", "{}", "[]"))
    blend = rewards.blend((F.col("turn") % 2).cast("double"), rewards.format_think(F.col("t")), F.lit(0.5))
    return made(s, d, FORMS, base).select("conv_id", "turn", rewards.format_boxed(F.col("t")).alias("boxed"), rewards.format_think(F.col("t")).alias("think"), rewards.format_think_answer(F.col("t")).alias("tags"), F.round(blend, 6).alias("blend"))


GOLDS = [("\\boxed{", TURN, "}"), ("\\boxed{\\frac{", TURN, "}{1}}"), ("\\boxed{x}",), ("none",)]
GOLDS_SQL = made_sql(["'\\boxed{' || turn || '}'", "'\\boxed{\\frac{' || turn || '}{1}}'", "'\\boxed{x}'", "'none'"])


@query("accuracy_reward", f"SELECT conv_id, turn, CASE WHEN b IS NULL THEN 0 ELSE (replace(replace(b, '\\frac{{', ''), '}}{{1}}', '') = turn::VARCHAR)::INT END::DOUBLE AS same, coalesce(b = turn::VARCHAR OR b = 'x', false)::INT::DOUBLE AS any_gold FROM (SELECT conv_id, turn, regexp_extract_all(t, '{BOX}', 1)[-1] AS b FROM {GOLDS_SQL})")
def accuracy(s, d):
    b = text.boxed_regex_last(F.col("t"))
    return made(s, d, GOLDS).select(
        "conv_id", "turn", F.coalesce(grading.equivalent(b, turn()), F.lit(False)).cast("double").alias("same"), F.coalesce(grading.correct(b, F.concat(turn(), F.lit(", x"))), F.lit(False)).cast("double").alias("any_gold")
    )
