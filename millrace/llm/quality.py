"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Every figure is computed over the whole text by built-in functions only: no Python, Arrow or RDD code runs.
Words are maximal runs outside ``[\\x20\\x09-\\x0D]``; lines are split at ``\\n``.

Defined results: a null text has no words (all counts 0, ``base_failed`` true, ``kept`` false); an empty text
likewise; stop words of all languages count, whatever the language column says (texts may mix them); repeated rows each get their own
result; an empty table gives an empty result; further columns are carried through untouched by `annotate`
callers because every helper column has a reserved prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the be to of and that have with in is for on it as are this by at from or an was not".split(),
    "de": "der die das und in zu den von mit ist auf für im dem nicht ein eine als auch es an".split(),
    "es": "el la de que y en los se del las por un una con no para su al lo es como".split(),
    "fr": "le la de et les des en un une du que est pour dans qui sur au pas par il ne ce".split(),
}


@dataclass(frozen=True)
class Rule:
    """``low <= metric <= high``; a missing bound is open. ``metric`` is SQL over the measured columns."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The method's verdict. A ratio whose denominator is 0 is null and passes; such texts fail the word count.
RULES = (
    Rule("word_count", "n_words", 50, None),
    Rule("mean_word_length", "word_chars / n_words", 2, 15),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.6),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.6),
    Rule("repeated_words", "n_repeat_words / n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", 1, None),
    # A share of 0.01; a table's cell marks are symbols, and a tenth of the words being symbols exempts it.
    Rule("stop_word_share", "(10 * n_stop_words + n_symbols) / n_words", 0.1, None),
    Rule("punctuation_ends", "n_bang_words / n_words", None, 0.3),
    Rule("letters", "n_letters / word_chars", 0.6, None),
)

P = "__mr_q_"


def compile_rules(rules=RULES) -> Column:
    """The names of the rules that fail, as one array expression over columns of `measure`."""
    import re

    def sql(r: Rule) -> str:
        metric = re.sub(r"[a-z_]+", lambda m: P + m[0], r.metric)
        if "/" in metric:
            metric = f"try_divide({metric.replace(' / ', ', ')})"
        tests = [f"({metric}) < {r.low}"] * (r.low is not None) + [f"({metric}) > {r.high}"] * (r.high is not None)
        return f"CASE WHEN {' OR '.join(tests)} THEN '{r.name}' END"

    return F.array_compact(F.array(*[F.expr(sql(r)) for r in rules]))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measured columns, each named with the prefix `P`."""
    t, words, tri = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(P + "words"), F.col(P + "tri")
    spaced = F.trim(F.translate(t, SPACES, " " * len(SPACES)))
    words_of = F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))
    n = F.size(words)
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    stops = sorted({w for v in STOP_WORDS.values() for w in v})
    stop_count = F.size(F.filter(words, lambda w: F.lower(w).isin(stops)))
    # Word windows: sort them by hash and number; each that has an equal neighbour covers three words. Equal hashes are only
    # taken for equal windows where the words agree.
    window = lambda i: [F.get(words, i + k) for k in range(3)]
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(*window(i)).alias("h"), i.alias("i"))))

    def alike(x: Column, y: Column) -> Column:
        agree = [a == b for a, b in zip(window(x["i"]), window(y["i"]))]
        return (x["h"] == y["h"]) & agree[0] & agree[1] & agree[2]

    same = F.filter(
        F.transform(tri, lambda x, k: F.when(alike(x, F.get(tri, k - 1)) | alike(x, F.get(tri, k + 1)), x["i"])),
        lambda x: x.isNotNull(),
    )
    at = F.col(P + "at")
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x
    )
    kept_lines = F.col(P + "lines")
    out = df.withColumns({P + "words": words_of, P + "lines": lines})
    out = out.withColumns({
        P + "n_words": n.cast("long"),
        P + "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
        P + "n_letters": F.length(F.regexp_replace(t, r"[^\p{L}\p{M}]+", "")).cast("long"),
        P + "n_symbols": _count(t, SYMBOLS).cast("long"),
        P + "n_lines": F.size(kept_lines).cast("long"),
        P + "n_dup_lines": (F.size(kept_lines) - F.size(F.array_distinct(kept_lines))).cast("long"),
        P + "n_bang_words": _count(t, "!?").cast("long") / 2,
        P + "n_stop_words": stop_count.cast("long"),
        P + "tri": F.coalesce(F.sort_array(windows), F.array().cast("array<struct<h:bigint,i:int>>")),
    }).drop(P + "lines")
    out = out.withColumn(P + "at", F.sort_array(same)).drop(P + "tri", P + "words")
    return out.withColumn(P + "n_repeat_words", covered.cast("long")).drop(P + "at")


def annotate(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """`measure` plus ``base_failed``, ``failed`` (rule names) and ``kept``, all prefixed."""
    out = measure(df, text)
    n, rep = F.col(P + "n_words"), F.col(P + "n_repeat_words")
    out = out.withColumns({P + "base_failed": (n < 50) | (100 * rep > 50 * n), P + "failed": compile_rules(rules)})
    return out.withColumn(P + "kept", ~F.col(P + "base_failed") & (F.size(P + "failed") == 0))


def report(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document with its figures and verdict."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return annotate(df).select(key, *[F.col(P + x).alias(x) for x in names])


def keep_good(df: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only."""
    # The explode of one verdict keeps the filter above it; pushed down, it would repeat the measuring inside itself.
    verdict = F.explode(F.array(F.col(P + "kept"))).alias(P + "verdict")
    return annotate(df).select(*df.columns, verdict).where(F.col(P + "verdict")).select(*df.columns)


def oracle(table: str = "documents") -> str:
    """The same figures in DuckDB SQL."""
    from millrace.llm import quality as q

    every = ", ".join(repr(s) for s in sorted({w for v in STOP_WORDS.values() for w in v}))
    bad = " OR ".join(
        f"coalesce({m} < {r.low}, false)" if side == "low" else f"coalesce({m} > {r.high}, false)"
        for r in q.RULES
        for side in ("low", "high")
        if getattr(r, side) is not None
        for m in [" / ".join(f"nullif({x.strip()}, 0)" if i else f"CAST({x.strip()} AS DOUBLE)" for i, x in enumerate(r.metric.split("/")))]
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
lines AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ln FROM t),
tri AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT l.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^\\p{{L}}\\p{{M}}]+', '', 'g')) AS n_letters, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(ln) AS n_lines, len(ln) - len(list_distinct(ln)) AS n_dup_lines, length(regexp_replace(text, '[^!?]+', '', 'g')) / 2.0 AS n_bang_words,
  len(list_filter(w, lambda x: lower(x) IN ({every}))) AS n_stop_words, coalesce(r.n, 0) AS n_repeat_words
  FROM lines l LEFT JOIN rep r ON l.doc_id = r.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, ({bad}) AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM v
"""
