"""Answer equivalence (E-*): normalized equality, rational numbers and fuzzy matching. Nothing is ever evaluated as code."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.deadline import TIMED_OUT, Deadline
from millrace.functions.text import normalize_a, normalize_b, split_gold


def rational(t: Column) -> Column:
    """A plain number or a quotient ``a/b`` (brackets allowed) as double, else null."""
    t = F.translate(t, "() ", "")
    pair = F.split(t, "/")
    a, b = F.get(pair, F.lit(0)).try_cast("double"), F.get(pair, F.lit(1)).try_cast("double")
    return F.coalesce(t.try_cast("double"), F.when((F.size(pair) == 2) & (b != 0), F.try_divide(a, b)))


def equivalent(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """E-1 / E-2: equal after normalization, or equal as numbers."""
    x, y = normalize_a(a), normalize_a(b)
    return (x == y) | F.coalesce(F.abs(rational(x) - rational(y)) < tolerance, F.lit(False))


def correct(answer: Column, gold: Column) -> Column:
    """E-1 against any of several golds."""
    return F.exists(split_gold(gold), lambda g: normalize_b(answer) == normalize_b(g))


def fuzzy(p: Column, r: Column) -> Column:
    """E-4."""
    def inner(x):
        return F.substring(x, 2, 1)

    def bracketed(x):
        return (F.length(x) == 3) & x.startswith("(") & x.endswith(")")

    numbers = F.coalesce(p.try_cast("double") == r.try_cast("double"), F.lit(False))
    quotes = F.replace(p, F.lit("'"), F.lit("")) == F.replace(r, F.lit("'"), F.lit(""))
    brackets = (F.concat(F.lit("["), r, F.lit("]")) == p) | (F.concat(F.lit("["), p, F.lit("]")) == r)
    question = p.endswith("?") & (F.regexp_replace(p, r"\?$", "") == r)
    return F.when(p == r, True).when(bracketed(p), inner(p) == r).when(bracketed(r), inner(r) == p).otherwise(numbers | quotes | brackets | question)


def bounded(grade: Callable[[str, str], bool], seconds: float = 10.0):
    """E-3: an Arrow-batched UDF of a verifier given by the caller: ``"True"``, ``"False"``, ``"TIMED_OUT"`` or ``"FAILED"``.

    The verifier runs in a process beside the task, which is killed when a verdict takes longer than ``seconds``; see `deadline`.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with Deadline(grade, seconds) as timed:
            for a, b in parts:
                yield pd.Series([timed(x, y) for x, y in zip(a, b)], dtype=object)

    return run


def verified(a: Column, b: Column, grade, seconds: float = 10.0) -> Column:
    """E-1 with a symbolic verifier: equal by rule, or verified in either direction within the time. The verifier only
    sees the pairs that the rules leave open, and the second direction only where the first says no."""

    @F.pandas_udf("boolean")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        with Deadline(grade, seconds) as timed:
            for known, xs, ys in parts:
                yield pd.Series([bool(k) or (x is not None and y is not None and either_way(timed, x, y) == "True") for k, x, y in zip(known, xs, ys)], dtype=bool)

    return run(F.coalesce(equivalent(a, b), F.lit(False)), a, b)


def either_way(grade, a: str, b: str) -> str:
    """``"True"`` if one of both directions holds; a direction that is timed out ends the comparison, one that fails counts as no."""
    for x, y in ((a, b), (b, a)):
        said = grade(x, y)
        if said in ("True", TIMED_OUT):
            return said
    return "False"


def judged(df: DataFrame, question: Column, given: Column, gold: Column, generate) -> DataFrame:
    """E-5: ``df`` with ``verdict``: a model's yes or no on whether an answer means the same as the gold one; a failed call is no.

    ``generate`` is a UDF of `models.generator`; equal texts are settled without it.
    """
    ask = F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), given, F.lit("\nReference: "), gold, F.lit("\nReply with Yes or No only."))
    said = F.lower(F.trim(F.coalesce(generate(ask), F.lit("No")))).startswith("yes")
    return df.withColumn("verdict", F.when(equivalent(given, gold), True).otherwise(said))


def benchmark_scores(df: DataFrame, response: Column, gold: Column, pattern: str, choice: bool = False) -> DataFrame:
    """E-9: ``df`` with ``extracted`` and ``score`` (0 or 1): letter equality for multiple choice, else equivalence."""
    from millrace.functions.text import first_of

    out = df.withColumn("extracted", first_of(response, pattern))
    same = F.col("extracted") == gold.cast("string") if choice else equivalent(F.col("extracted"), gold.cast("string"))
    return out.withColumn("score", F.coalesce(same, F.lit(False)).cast("double"))


def rechecked(df: DataFrame, answer: Column, gold: Column, score: str, generate, below: float = 0.5) -> DataFrame:
    """E-10: rows with a score under ``below`` are asked again; a yes makes the score 1, a failed call counts as no."""
    ask = F.concat(F.lit("There is an answer: "), answer, F.lit("\n\nand the ground truth answer is: "), gold, F.lit("\n\nIs the answer correct? Reply with Yes or No only."))
    low = df.where(F.col(score) < below)
    again = low.withColumn(score, F.when(F.lower(F.coalesce(generate(ask), F.lit("No"))).contains("yes"), 1.0).otherwise(F.col(score)))
    return df.where(~(F.col(score) < below) | F.col(score).isNull()).unionByName(again)
