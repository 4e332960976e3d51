"""Text functions on literals and on very long texts."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import rewards, text

BIG = 200_000
LONG = {
    "box": "\\boxed{" + "x" * BIG + "}",
    "nested": "\\boxed{" + "{a}" * (BIG // 3) + "}",
    "deeper": "\\boxed{" + "{{a}b}" * (BIG // 6) + "}",
    "open": "\\boxed{" + "{" * BIG,
    "boxes": "\\boxed{1}" * (BIG // 9),
    "named": "The answer is: " + "a" * BIG + "\n",
    "less": "Final Answer:" + "<a" * (BIG // 2) + "\n",
    "tags": "<q>" * (BIG // 3) + "</q>",
    "blank": " " * BIG + "x" + "\n" * BIG,
    "words": "step 1 = 2, the of. " * (BIG // 20),
    "chat": "<|im_start|>user " + "q" * BIG + "<|im_start|>assistant a</s>",
    "json": "{" + '"a": [' * 1000 + "x" * BIG + "}",
    "commas": "a, " * (BIG // 3),
}
FUNCTIONS = {
    "S-1": text.boxed_last, "S-2": text.boxed_all, "S-3": text.boxed_first, "S-4": text.boxed_regex_last, "S-5": text.answer_cascade, "S-6": text.final_answer, "S-7": lambda t: text.tag(t, "q"),
    "S-8": lambda t: text.tag_last(t, "q"), "S-9": lambda t: text.tag_tolerant(t, "q"), "S-10": lambda t: text.named_score(t, "step"), "S-11": text.boxed_stripped, "S-12": lambda t: text.first_json(t, "a string"),
    "S-13": lambda t: text.render(F.lit("{{ t }}"), {"t": t}), "S-15": text.dedup_key, "S-16": text.normalize_a, "S-17": text.normalize_b, "S-18": text.normalize_c, "S-19": text.normalize_d,
    "S-20": text.normalize_e, "S-21": text.bbeh_prediction, "S-22": text.split_gold, "S-25": text.choice_in_box, "S-29": text.active_concepts, "R-7": rewards.format_boxed, "R-7b": rewards.format_think_answer,
    "R-10": rewards.reasoning, "R-11": rewards.step_count, "R-14": rewards.repetition_multiplier, "R-15": rewards.process_reward,
}


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(list(LONG.items()), "name string, t string").repartition(8).persist()


@pytest.mark.parametrize("name", FUNCTIONS)
def test_long_texts(long, name):
    out = long.select(F.length(FUNCTIONS[name](F.col("t")).cast("string")).alias("n")).agg(F.max("n"), F.count(F.lit(1))).first()
    assert out[1] == len(LONG) and (out[0] or 0) >= 0


def test_long_boxes(long):
    got = {r["name"]: r["b"] for r in long.select("name", F.length(text.boxed_regex_last(F.col("t"))).alias("b")).collect()}
    assert (got["box"], got["nested"], got["deeper"], got["open"], got["boxes"]) == (BIG, BIG // 3 * 3, BIG // 6 * 6, None, 1)
    got = {r["name"]: r["b"] for r in long.select("name", F.length(text.final_answer(F.col("t"))).alias("b")).collect()}
    assert (got["named"], got["less"]) == (BIG + 1, BIG)


def one(spark, f, t):
    return spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]


def test_reasoning(spark):
    assert one(spark, rewards.reasoning, "<think>\n a \t</think> \\boxed{1}") == "a"
    assert one(spark, rewards.reasoning, "\n before \\boxed{1} \\boxed{2}") == "before"
    assert one(spark, rewards.reasoning, " \\boxed{1} x ") == "\\boxed{1} x"
    body = "First, x = 2. Then y = 3, so it follows."
    plain = one(spark, rewards.process_reward, body)
    assert plain > 0 and plain == one(spark, rewards.process_reward, f"<think>{body}</think> lots of = 5, words") == one(spark, rewards.process_reward, f"{body}\n\\boxed{{= 7}}")
    assert one(spark, rewards.process_reward, "<think> </think> Therefore x = 2.") == 0.0


def test_answers(spark):
    assert one(spark, text.answer_cascade, "The answer is 12\nmore") == "12"
    assert one(spark, text.answer_cascade, "THE ANSWER IS 12\n more ") == "more"  # only the first letter may be of either case
    assert one(spark, text.choice_in_box, "\\boxed{ d }") == "D" and one(spark, text.choice_in_box, "\\boxed{12}") == "12"
    assert one(spark, text.normalize_c, " $ a\t b $$ ") == "a b" and one(spark, text.normalize_c, None) == ""
    assert text.prompt_parts("[SYSTEM]\nbe brief\n[USER]\nhello") == ("be brief", "hello") and text.prompt_parts(" hello ") == ("", "hello")
    assert text.ontology_text({"algebra": ["ring", "field"]}) == "- algebra: ring, field"
