"""Majority vote over repeated answers (V-*) and group rewards (E-6..E-10).

Every operator takes the group key, the answer and an explicit order; a tie goes to the answer seen first.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, group: str, answer: Column, order: list, denominator: str = "non_empty", empty_is_class: bool = False) -> DataFrame:
    """``(group, answer, votes, n, score)`` per group: V-1 (non_empty), V-2 (all), V-3 (``empty_is_class``).

    Two aggregations: counts by answer combine before the shuffle, so a group with many answers costs no more.
    ``order`` gives the arrival order; its smallest value per answer breaks ties. For V-5 give the answer in lower case.
    """
    rows = df.select(F.col(group), answer.alias("answer"), F.struct(*order).alias("at"))
    blank = F.coalesce(F.trim("answer") == "", F.lit(True))
    counted = rows.where(F.lit(True) if empty_is_class else ~blank).groupBy(group, "answer").agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("at"))
    rank = F.struct((-F.col("votes")).alias("v"), "at")
    won = counted.groupBy(group).agg(F.min_by("answer", rank).alias("answer"), F.max("votes").alias("votes"), F.sum("votes").alias("n"))
    if denominator == "all":
        won = won.drop("n").join(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group)
    score = F.col("votes") / F.col("n")
    if empty_is_class:
        score = F.when(F.lower(F.trim("answer")).isin("", "nan") | F.col("answer").isNull(), 0.0).otherwise(score)
    return won.select(group, "answer", "votes", "n", score.alias("score"))


def majority_by(df: DataFrame, group: str, answer: str, order: str, same, schema: str = "group string, answer string, votes long, n long, score double") -> DataFrame:
    """V-1 with any pairwise predicate, which need not be transitive: each answer joins the first class whose
    representative it equals. Sequential within a group by nature; groups are rollouts of one question."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        classes: list[list] = []
        for a in pdf.sort_values("o", kind="stable")["a"]:
            if a is None or not str(a).strip():
                continue
            hit = next((c for c in classes if same(c[0], a)), None)
            hit.__setitem__(1, hit[1] + 1) if hit else classes.append([a, 1])
        n = sum(c[1] for c in classes)
        if not n:
            return pd.DataFrame({"group": [], "answer": [], "votes": [], "n": [], "score": []})
        best = max(classes, key=lambda c: c[1])
        return pd.DataFrame({"group": [str(pdf["g"].iloc[0])], "answer": [best[0]], "votes": [best[1]], "n": [n], "score": [best[1] / n]})

    return df.select(F.col(group).alias("g"), F.col(answer).alias("a"), F.col(order).alias("o")).groupBy("g").applyInPandas(run, schema)


def no_rule(a: str, b: str) -> bool:
    """The "no ..." rule: equal, or both say no."""
    return a == b or ("no " in a.lower() and "no " in b.lower())


def any_case_rule(a: str, b: str) -> bool:
    """V-5: equal in any case, or both say no."""
    return no_rule(a.lower(), b.lower())


GRADED = "answer string, votes long, n long, score double, timeouts long"


def graded(df: DataFrame, group: str, answer: Column, order: list, grade=None, seconds: float = 10.0, rule=no_rule, denominator: str = "non_empty") -> DataFrame:
    """``(group, answer, votes, n, score, timeouts)``: V-1, V-4 and V-5 with a grader, which need not be transitive.

    In order of arrival an answer joins the first class whose representative it equals by ``rule``, or by ``grade`` in either
    direction within ``seconds``; a comparison that is timed out goes on to the next class. What an answer joins depends only
    on the different answers before it, so equal ones are counted before the shuffle; those of a group then pass through
    one task in order, which holds the group's classes and no rows. ``denominator``: of non-empty answers, or of all rows.
    Null and blank answers have no class, groups without others no row.
    """
    rows = df.select(F.col(group).alias("g"), F.trim(answer).alias("a"), F.struct(*order).alias("at"))
    counted = rows.where("a <> ''").groupBy("g", "a").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    kind = dict(counted.dtypes)["g"]

    def run(batches):
        from millrace.functions.deadline import TIMED_OUT, Deadline
        from millrace.functions.grading import either_way

        def row(g, classes, late):
            n, best = sum(classes.values()), max(classes, key=classes.get)
            return pd.DataFrame({"g": [g], "answer": [best], "votes": [classes[best]], "n": [n], "score": [classes[best] / n], "timeouts": [late]})

        with Deadline(grade, seconds) as timed:
            last, classes, late = None, {}, 0  # a class by its representative, in order of creation
            for batch in batches:
                for g, a, n in zip(batch["g"], batch["a"], batch["n"]):
                    if classes and g != last:
                        yield row(last, classes, late)
                        classes, late = {}, 0
                    last = g
                    for known in classes:
                        said = "True" if rule(a, known) else either_way(timed, a, known) if grade else "False"
                        late += said == TIMED_OUT
                        if said == "True":
                            classes[known] += n
                            break
                    else:
                        classes[a] = n
            if classes:
                yield row(last, classes, late)

    won = counted.where("g IS NOT NULL").repartition("g").sortWithinPartitions("g", "at").select("g", "a", "n").mapInPandas(run, f"g {kind}, {GRADED}")
    out = won.withColumnRenamed("g", group)
    if denominator == "all":
        every = rows.groupBy(F.col("g").alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
        out = out.join(every, F.col(group) == F.col("__g")).withColumns({"n": F.col("__n"), "score": F.col("votes") / F.col("__n")}).drop("__g", "__n")
    return out


def graded_agreement(df: DataFrame, group: str, answer: Column, own: Column, order: list, grade, seconds: float = 10.0) -> DataFrame:
    """V-4 with a grader: `graded` by equality, and how many answers agree with the questioner's own; groups without an answer are rows of zeros.

    The verifier sees each different pair of answer and own answer of a group once.
    """
    from millrace.functions.grading import verified

    rows = df.select(F.col(group), F.trim(answer).alias("__a"), F.trim(own).alias("__own"), *[F.col(c) for c in order if c != group])
    won = graded(rows, group, F.col("__a"), order, grade, seconds, rule=lambda a, b: a == b)
    pairs = rows.groupBy(group, "__a", "__own").agg(F.count(F.lit(1)).alias("__n"))
    same = (F.col("__a") == F.col("__own")) | verified(F.col("__a"), F.col("__own"), grade, seconds)
    agreed = pairs.withColumn("__same", F.when(F.col("__a") != "", F.coalesce(same, F.lit(False))).otherwise(False)).groupBy(group)
    out = agreed.agg(F.sum(F.when(F.col("__same"), F.col("__n")).otherwise(0)).alias("agreed")).join(won, group, "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        group, F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("votes", F.lit(0)).alias("votes"), n.alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"),
        "agreed", F.coalesce(F.try_divide("agreed", n), F.lit(0.0)).alias("agreement"), F.coalesce("timeouts", F.lit(0)).alias("timeouts"),
    )


def self_consistency(df: DataFrame, group: str, answer: Column, order: list, least: int = 2, right: float = 1.0, wrong: float = 0.0, penalty: float = 0.5) -> DataFrame:
    """E-6: null answers are wrong with a penalty; without ``least`` agreeing answers all are wrong; else match the mode."""
    mode = majority(df, group, answer, order).select(group, F.col("answer").alias("mode"), F.col("votes").alias("mode_votes"))
    reward = F.when(F.col("given").isNull(), wrong - penalty).when(F.coalesce("mode_votes", F.lit(0)) < least, wrong).when(F.col("given") == F.col("mode"), right).otherwise(wrong)
    return df.withColumn("given", answer).join(mode, group, "left").withColumn("reward", reward)


def best_rollout(df: DataFrame, group: str, answer: Column, text: str, order: list) -> DataFrame:
    """E-8: the first rollout that gives the modal answer, else the first that is not blank."""
    mode = majority(df, group, answer, order).select(group, F.col("answer").alias("mode"))
    rank = F.struct(F.coalesce(F.col("given") != F.col("mode"), F.lit(True)).alias("other"), F.struct(*order).alias("at"))
    rows = df.withColumn("given", answer).join(mode, group, "left").where(F.trim(F.col(text)) != "")
    return rows.groupBy(group).agg(F.min_by(text, rank).alias("rollout"))


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` with the columns of ``new`` where the key occurs there."""
    marked = new.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__n_{c}") for c in new.columns if c != key], F.lit(True).alias("__hit"))
    cols = [F.when(F.col("__hit"), F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c) if c in new.columns and c != key else F.col(c) for c in base.columns]
    return base.join(marked, F.col(key) == F.col("__k"), "left").select(*cols)


def agreement(df: DataFrame, group: str, answer: Column, own: Column, order: list) -> DataFrame:
    """V-4: the majority per group and how many of its answers equal the questioner's own, by stripped text or as numbers.

    Groups without an answer give a row of zeros.
    """
    from millrace.functions.grading import rational
    from millrace.functions.text import strip

    rows = df.select("*", strip(answer).alias("__a"), strip(own).alias("__own"))
    won = majority(rows, group, F.col("__a"), order)
    same = (F.col("__a") == F.col("__own")) | F.coalesce(F.abs(rational(F.col("__a")) - rational(F.col("__own"))) < 1e-6, F.lit(False))
    agreed = rows.groupBy(group).agg(F.count_if((F.col("__a") != "") & same).alias("agreed"))
    out = agreed.join(won, group, "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        group, "answer", F.coalesce("votes", F.lit(0)).alias("votes"), n.alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"), "agreed", F.coalesce(F.try_divide("agreed", n), F.lit(0.0)).alias("agreement")
    )


def difficulty(df: DataFrame, group: str, answer: Column, gold: Column, order: list) -> DataFrame:
    """V-6: ``(group, p_succ, rollouts, correct, modal_answer)``.

    With a gold answer, the share of rollouts that are right; without, the share of the modal answer among all rollouts.
    A tie goes to the answer seen first.
    """
    from millrace.functions.grading import correct

    rows = df.select("*", F.coalesce(answer, F.lit("")).alias("__a"), F.coalesce(gold, F.lit("")).alias("__gold"))
    right = (F.col("__gold") != "") & F.coalesce(correct(F.col("__a"), F.col("__gold")), F.lit(False))
    counted = rows.groupBy(group).agg(F.max("__gold").alias("gold"), F.count(F.lit(1)).alias("rollouts"), F.count_if(right).alias("correct"))
    mode = majority(rows, group, F.col("__a"), order).select(group, "answer", "votes")
    out = counted.join(mode, group, "left")
    share = F.when(F.col("gold") != "", F.col("correct") / F.col("rollouts")).otherwise(F.coalesce("votes", F.lit(0)) / F.col("rollouts"))
    return out.select(group, share.alias("p_succ"), "rollouts", "correct", F.when(F.col("gold") != "", "").otherwise(F.coalesce("answer", F.lit(""))).alias("modal_answer"))
