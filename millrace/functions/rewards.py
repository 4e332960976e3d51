"""Reward and quality scores (R-*) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import BLANKS, let, strip

#: What counts as mathematical reasoning.
EQUATIONS = r"[a-zA-Z_]\s*=\s*[\d\.\-\+\*/\(\)a-zA-Z\\]+"
LATEX = r"\\(?:frac|sqrt|sum|int|prod|lim|sin|cos|tan|log|ln|binom|cdot|times|div|pm|mp|leq|geq|neq|approx)\b"
CALCULATIONS = r"(?m)=\s*[\-]?\d+(?:\.\d+)?(?:\s*$|\s*[,\.])"
#: A marker at the start of the text or of a line; blank lines before it are passed over only once.
STEPS = r"(?i)(?:^\s*+|\n[^\S\n]*+)(?:step\s*\d+|first|second|third|next|then|therefore|thus|hence|so|finally|consequently|since|because|given\s+that|we\s+(?:know|have|get|find|can|need|see|note))\b"
KEYWORDS = r"(?i)\b(?:equation|substitut|simplif|factor|expand|combin|permut|probabilit|triangle|circle|angle|area|volume|perimeter|hypotenuse|quadratic|polynomial|derivative|integral|limit|sequence|series|modulo|remainder|divisible|prime|gcd|lcm|congruent|parallel|perpendicular)\b"
RESULTS = r"(?:=\s*[\-]?\d+(?:\.\d+)?(?:/\d+)?|\\frac\{[^}]+\}\{[^}]+\})"


def _n(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def words(t: Column) -> Column:
    """Words between white space of any kind."""
    t = strip(t)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANKS + "+"))


def n_words(t: Column) -> Column:
    return F.size(words(t))


def uncertainty(score: Column) -> Column:
    """R-1: ``min(s, 1 - s)``; -1 for an invalid (null) score."""
    return F.when(score.isNull(), -1.0).otherwise(F.least(score, 1 - score))


def zpd(score: Column, diversity: Column, weight: float = 1.0) -> Column:
    """R-2."""
    peak = F.greatest(F.lit(0.0), 1 - F.abs(score - 0.75) / 0.4)
    return F.when((score < 0.3) | (score > 0.9), 0.0).otherwise(peak * (1 + weight * diversity))


def moded(score: Column, diversity: Column, mode: int, weight: float = 1.0, low: float = 0.49, high: float = 0.99, least: float = 0.15) -> Column:
    """R-3."""
    if mode == 1:
        return F.least(score, 1 - score)
    if mode == 5:
        return F.when(score.between(low, high) & (diversity >= least), 1.0).otherwise(0.0)
    return zpd(score, diversity, weight)


def additive(score: Column, bonus: Column, valid: Column) -> Column:
    """R-3, the additive form: uncertainty and a diversity bonus; -1 without a question or for an invalid (null or negative) score."""
    return F.when(F.coalesce(valid & (score >= 0), F.lit(False)), F.least(score, 1 - score) + bonus).otherwise(-1.0)


def format_boxed(t: Column) -> Column:
    """R-7: 1 with 20 words before a non-empty box, 0.5 with fewer, 0 without a box."""
    before = F.regexp_extract(t, r"(?s)^(.*?)\\boxed\{.+\}", 1)
    return F.when(~t.rlike(r"(?s)\\boxed\{.+\}"), 0.0).when(n_words(before) >= 20, 1.0).otherwise(0.5)


def format_think(t: Column) -> Column:
    return F.when(t.rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$"), 1.0).otherwise(0.0)


def format_think_answer(t: Column) -> Column:
    return F.when(t.rlike(r"(?s)^<think>.*?</think>\s*<answer>.*?</answer>$"), 1.0).otherwise(0.0)


def blend(accuracy: Column, form: Column, process: Column, f: float = 0.1, p: float = 0.2) -> Column:
    """R-9."""
    return (1 - f - p) * accuracy + f * form + p * process


def reasoning(t: Column) -> Column:
    """R-10: think block, else what stands before a box, else everything."""
    before = strip(F.regexp_extract(t, r"(?s)^(.*?)\\boxed\{", 1))
    return F.when(t.rlike("(?s)<think>.*?</think>"), strip(F.regexp_extract(t, "(?s)<think>(.*?)</think>", 1))).when(before != "", before).otherwise(strip(t))


def paragraphs(t: Column) -> Column:
    return F.size(F.filter(F.split(t, r"\n\s*\n"), lambda x: strip(x) != ""))


def step_count(t: Column) -> Column:
    """R-11."""
    return F.when(t == "", 0).otherwise(F.greatest(_n(t, STEPS), paragraphs(t), F.lit(1)))


def _math(t: Column) -> Column:
    return _n(t, EQUATIONS) + _n(t, LATEX) + _n(t, KEYWORDS)


def _density(found: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), found / F.greatest(F.lit(1.0), n / 20))


def math_density(t: Column) -> Column:
    return _density(_math(t), n_words(t))


def step_structure(t: Column) -> Column:
    return F.least(F.lit(1.0), step_count(t) / 5.0)


def logical_flow(t: Column) -> Column:
    return F.least(F.lit(1.0), _n(t, STEPS) / 4.0)


def calculation_presence(t: Column) -> Column:
    return F.least(F.lit(1.0), (_n(t, CALCULATIONS) + _n(t, RESULTS)) / 3.0)


def _length(n: Column) -> Column:
    return F.when(n < 50, 0.5 + 0.5 * n / 50.0).when(n > 800, F.greatest(F.lit(0.7), 1 - (n - 800) / 2000.0)).otherwise(1.0)


def length_multiplier(t: Column) -> Column:
    """R-13."""
    return F.when(t == "", 0.5).otherwise(_length(n_words(t)))


def sentences(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"[.!?\n]+"), lambda x: F.lower(strip(x))), lambda x: F.length(x) > 10)


def _repetition(t: Column, s: Column, w: Column) -> Column:
    """R-14 from a text, its sentences and its words in lower case. Word triples are compared by their hashes."""
    triples = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    share = lambda x: F.size(F.array_distinct(x)) / F.size(x)
    ratio = F.when(F.size(w) > 20, let(triples(w), share)).otherwise(1.0)
    return F.when((F.length(t) < 100) | (F.size(s) < 3), 1.0).otherwise(F.greatest(F.lit(0.3), F.least(share(s), ratio)))


def repetition_multiplier(t: Column) -> Column:
    """R-14: share of unique sentences or word triples, whichever is smaller; at least 0.3; 1 for short texts."""
    return let(F.struct(sentences(t).alias("s"), words(F.lower(t)).alias("w")), lambda m: _repetition(t, m["s"], m["w"]))


def process_reward(t: Column, repetition: bool = True) -> Column:
    """R-15: the reward of a text's reasoning (R-10). Words, steps and matches are each found once."""

    def measured(r: Column) -> Column:
        return F.struct(
            r.alias("r"), words(F.lower(r)).alias("w"), _n(r, STEPS).alias("marks"), paragraphs(r).alias("paras"), _math(r).alias("math"),
            (_n(r, CALCULATIONS) + _n(r, RESULTS)).alias("calcs"), sentences(r).alias("s"),
        )

    def blend(m: Column) -> Column:
        one, n = F.lit(1.0), F.size(m["w"])
        steps = F.least(one, F.greatest(m["marks"], m["paras"], F.lit(1)) / 5.0)
        base = 0.30 * _density(m["math"], n) + 0.30 * steps + 0.20 * F.least(one, m["marks"] / 4.0) + 0.20 * F.least(one, m["calcs"] / 3.0)
        out = base * _length(n)
        return F.when(m["r"] == "", 0.0).otherwise(out * _repetition(m["r"], m["s"], m["w"]) if repetition else out)

    return let(reasoning(t), lambda r: let(measured(r), blend))
