"""Predicates and row filters (O-22..O-35)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_band(df: DataFrame, low: float, high: float, score: str = "score", diversity: str | None = None, least: float = 0.0, answer: str = "answer") -> DataFrame:
    """O-22: inclusive band; optional diversity floor; answers "" and "None" rejected."""
    keep = F.col(score).between(low, high) & F.col(answer).isNotNull() & ~F.col(answer).isin("", "None")
    return df.where(keep & (F.col(diversity) >= least) if diversity else keep)


def band_or_all(df: DataFrame, value: str, low: float = 0.3, high: float = 1.0) -> DataFrame:
    """O-22b: the band, or every row if nothing lies in it."""
    inside = F.coalesce(F.col(value).between(low, high), F.lit(False))
    hits = df.agg(F.count_if(inside).alias("__hits"))
    return df.crossJoin(hits).where(inside | (F.col("__hits") == 0)).drop("__hits")


def unprocessed(df: DataFrame, score: str = "score") -> DataFrame:
    """O-23: the rows whose score is 0."""
    return df.where(F.col(score) == 0)


def ungradable(question: Column, answer: Column) -> Column:
    """O-24."""
    q = F.lower(question)
    return q.contains("证明") | q.contains("box") | F.lower(answer).contains("text")


def p_band(p: Column, low: float, high: float) -> Column:
    """O-25: missing counts as 0.5."""
    return F.coalesce(p, F.lit(0.5)).between(low, high)


def first_reason(reasons: dict[str, Column]) -> Column:
    """O-26: the first reason whose condition holds, null if none does."""
    out = None
    for name, hit in reasons.items():
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


#: Ordinal levels.
COT_LEVELS = {"low": 0, "medium": 1, "high": 2}
OVERALL_LEVELS = {"poor": 0, "fair": 1, "good": 2, "excellent": 3}


def level(value: Column, levels: dict[str, int]) -> Column:
    out = None
    for k, v in levels.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(-1)


def quality_gate(summary: Column, status: Column, valid: bool = False, correct: bool = False, no_leak: bool = False, min_cot: str | None = None, min_overall: str | None = None) -> Column:
    """O-27: rows without a summary pass; otherwise the status and every asked condition must hold."""
    ok = status == "success"
    if valid:
        ok = ok & (summary["question_validity"] == "valid")
    if correct:
        ok = ok & (summary["answer_correctness"] == "correct")
    if no_leak:
        ok = ok & (summary["answer_leakage"] == "no")
    if min_cot:
        ok = ok & (level(summary["cot_quality"], COT_LEVELS) >= COT_LEVELS[min_cot])
    if min_overall:
        ok = ok & (level(summary["overall_quality"], OVERALL_LEVELS) >= OVERALL_LEVELS[min_overall])
    return summary.isNull() | F.coalesce(ok, F.lit(False))


def completion(cot: Column, answer: Column) -> Column:
    """O-29."""
    return F.when(F.trim(cot) != "", cot).otherwise(F.concat(F.lit("\\boxed{"), answer, F.lit("}")))


def question_format_ok(q: Column) -> Column:
    """O-30."""
    lower = F.lower(q)
    mathy = q.rlike(r"[$\\=+\-*/^]|find|calculate|solve|simplify|evaluate|determine|prove|show")
    asks = lower.rlike(r"\?|what|find|calculate|determine|solve|how|prove|show|given")
    return F.coalesce(~q.rlike("^<[a-zA-Z_]+>") & ~lower.contains("<transformation>") & ~lower.contains("<answer>") & (F.length(F.trim(q)) >= 20) & (mathy | asks), F.lit(False))


def short_enough(text: Column, most: int = 800) -> Column:
    """O-32."""
    return F.length(text) <= most


def within_words(text: Column, most: int) -> Column:
    """O-33 by a word proxy for tokens."""
    from millrace.functions.rewards import n_words

    return n_words(text) <= most


def row_slice(df: DataFrame, order: list, start: int, end: int) -> DataFrame:
    """O-35: rows ``start <= n < end`` in an explicit order."""
    return df.orderBy(*order).offset(start).limit(end - start)


def flatten_record(record: dict[str, list[Column]]) -> list[Column]:
    """One column per field: the first of its places (verified shape first, raw shape behind) that is not null."""
    return [F.coalesce(*places).alias(name) for name, places in record.items()]


def sft_rows(df: DataFrame, question: str, cot: Column, answer: Column, passes: Column) -> DataFrame:
    """``(question, completion)`` of the rows that pass the gate."""
    return df.where(passes).select(question, completion(cot, answer).alias("completion"))


def sft_counts(df: DataFrame, cot: Column, verdict: Column, passes: Column) -> DataFrame:
    """Rows in all, included and filtered, with a reasoning text and with a verdict."""
    ok = F.coalesce(passes, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("included"), F.count_if(~ok).alias("filtered"),
        F.count_if(F.trim(cot) != "").alias("has_cot"), F.count_if(verdict.isNotNull()).alias("has_verification"),
    )
