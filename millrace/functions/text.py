"""Text extraction and normalization as column expressions (S-*)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the str methods of Python see it: the characters, and the same as a class for regular expressions.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(t: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.trim(t, F.lit(BLANK))


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# ---- boxed answers: unbounded nesting has no regular expression, so these scan braces in Arrow batches


def _boxes(text: str | None, keep_open: bool = False) -> list[str]:
    """Contents of every ``\\boxed{...}``; an unbalanced tail is dropped, or kept with ``keep_open``."""
    out, at, mark = [], 0, "\\boxed{"
    while text and (at := text.find(mark, at)) >= 0:
        start = i = at + len(mark)
        depth = 1
        while i < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            i += 1
        if depth == 0 or keep_open:
            out.append(text[start : i - 1])
        at = i if depth == 0 else len(text)
    return out


def _over(f, kind: str):
    """An Arrow-batched UDF, made when a query is built: workers import this module without a session."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(run, kind)


def boxed_last(t: Column) -> Column:
    """S-1: the last balanced box, stripped; null if there is none."""
    return _over(lambda x: next((b.strip() for b in reversed(_boxes(x))), None), "string")(t)


def boxed_all(t: Column) -> Column:
    """S-2: all boxes; an unbalanced one is kept without its last character."""
    return _over(lambda x: _boxes(x, True), "array<string>")(t)


def boxed_first(t: Column) -> Column:
    """S-3: the first balanced box."""
    return _over(lambda x: next(iter(_boxes(x)), None), "string")(t)


def boxed_stripped(t: Column) -> Column:
    """S-11: the text without its balanced boxes."""

    def strip(x):
        for b in _boxes(x):
            x = x.replace("\\boxed{" + b + "}", "", 1)
        return x

    return _over(strip, "string")(t)


def has_boxed(t: Column) -> Column:
    return t.contains("\\boxed{")


#: A box with at most two nested levels (S-4). Every repeat is possessive, so long texts cost no stack.
BOX_2 = r"\\boxed\{([^{}]*+(?:\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}[^{}]*+)*+)\}"


def last_of(t: Column, pattern: str, group: int = 1) -> Column:
    """The last match of a pattern, null if none."""
    return F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), group), F.lit(-1))


def first_of(t: Column, pattern: str, group: int = 1) -> Column:
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def boxed_regex_last(t: Column) -> Column:
    """S-4."""
    return last_of(t, BOX_2)


def answer_cascade(t: Column) -> Column:
    """S-5: box without braces, "The answer is", "Final answer", last line."""
    asked = [strip(first_of(t, p)) for p in (r"\\boxed\{([^}]+)\}", r"[Tt]he answer is[:\s]+([^\n.]+)", r"[Ff]inal answer[:\s]+([^\n.]+)")]
    return F.coalesce(*asked, strip(F.substring_index(strip(t), "\n", -1)))


def final_answer(t: Column) -> Column:
    """S-6: chat turns and stop tokens cut, then last box or last "Final Answer:" / "The answer is:" line."""
    tail = F.when(t.contains("<|im_start|>user"), F.regexp_replace(t, r"(?s)\A.*?<\|im_start\|>assistant", "<|im_start|>assistant")).when(
        t.contains("Assistant:"), strip(F.substring_index(t, "Assistant:", -1))
    ).otherwise(t)
    before = lambda stop: lambda x: F.when(x.contains(stop), strip(F.substring_index(x, stop, 1))).otherwise(x)
    for stop in ("</s>", "<|im_end|>", "<|endoftext|>"):
        tail = let(tail, before(stop))

    def found(x: Column) -> Column:
        box = boxed_regex_last(x)
        # Up to the first line break that does not follow "<"; "<<" ends the search.
        named = [last_of(x, rf"{name}:((?:[^<\n]|<[^<])*+)\n") for name in ("Final Answer", "The answer is")]
        return F.coalesce(F.when(box != "", box), *named)

    return let(tail, found)


def tag(t: Column, name: str) -> Column:
    """S-7: content of the first ``<name>…</name>``, any case."""
    return strip(first_of(t, f"(?is)<{name}>(.*?)</{name}>"))


def tag_last(t: Column, name: str) -> Column:
    """S-8."""
    return strip(last_of(t, f"(?is)<{name}>(.*?)</{name}>"))


def tag_tolerant(t: Column, name: str) -> Column:
    """S-9: also an unclosed tag; content before a leaked tag; trailing tags dropped; null when empty."""
    raw = F.coalesce(tag_strict(t, name), first_of(t, f"(?s)<{name}>\\s*(.*?)(?=<[a-zA-Z_]+>|$)"))
    raw = F.when(~strip(raw).rlike("^<[a-zA-Z_]+>"), strip(raw))
    out = strip(F.regexp_replace(raw, r"</?[a-zA-Z_]+>\z", ""))
    return F.when(out != "", out)


def tag_strict(t: Column, name: str) -> Column:
    return first_of(t, f"(?s)<{name}>(.*?)</{name}>")


def named_score(t: Column, name: str) -> Column:
    """S-10: ``name: x``, ``name = x`` or ``name: [x]``, else 0."""
    forms = (rf"(?i){name}:\s*([\d.]+)", rf"(?i){name}\s*=\s*([\d.]+)", rf"(?i){name}:\s*\[([\d.]+)\]")
    return F.coalesce(*[first_of(t, p).try_cast("double") for p in forms], F.lit(0.0))


def first_json(t: Column, schema: str) -> Column:
    """S-12: the outermost braces parsed, with stray backslashes doubled if that is what keeps them from parsing."""
    first, behind = F.instr(t, "{"), F.instr(F.reverse(t), "}")  # a pattern would begin anew at every brace
    raw = F.when((first > 0) & (behind > 0) & (F.length(t) - behind + 1 > first), F.substring(t, first, F.length(t) - behind - first + 2))
    mended = F.regexp_replace(raw, r'\\(?!["\\/bfnrtu])', r"\\\\")
    return F.when(F.get_json_object(raw, "$").isNotNull(), F.from_json(raw, schema)).otherwise(F.from_json(mended, schema))


def render(template: Column, values: dict[str, Column]) -> Column:
    """S-13: ``{{ name }}`` filled in, once each; unknown names stay. Give lists and maps through `F.to_json`."""
    for name, v in values.items():
        safe = F.replace(F.replace(v.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        template = F.regexp_replace(template, F.lit(r"\{\{\s*" + name + r"\s*\}\}"), safe)
    return template


def chat_prompt(system: Column, user: Column) -> Column:
    """S-14."""
    return F.concat(F.lit("system: "), system, F.lit("\nuser: "), user)


def options_text(options: Column) -> Column:
    """S-14: ``(A): x`` lines."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.lit("("), F.char(i + 65), F.lit("): "), x)), "\n")


def dedup_key(t: Column) -> Column:
    """S-15: lower case, white space to one space, trimmed, then everything but word characters and spaces dropped."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(t), r"(?U)\s+", " ")), r"(?U)[^\w\s]", "")


def normalize_a(t: Column) -> Column:
    """S-16."""
    t = F.regexp_replace(F.coalesce(t, F.lit("")), r"(?U)\s+", "")
    t = F.regexp_replace(t, r"\\(text|mathrm|mathbf|mathit)\{([^}]*)\}", "$2")
    t = F.regexp_replace(t, r"\\frac\{([^}]*)\}\{([^}]*)\}", "($1)/($2)")
    return F.lower(F.replace(F.regexp_replace(t, r"\\(left|right)", ""), F.lit("$"), F.lit("")))


def normalize_b(t: Column, lower: bool = False) -> Column:
    """S-17."""
    t = F.replace(F.regexp_replace(t, r"(?U)\s+", ""), F.lit("$"), F.lit(""))
    return F.lower(t) if lower else t


def normalize_c(t: Column) -> Column:
    """S-18: without white space and dollar signs at the ends; white space collapsed; null as empty."""
    inner = strip(F.trim(strip(F.coalesce(t, F.lit(""))), F.lit("$")))
    return F.regexp_replace(inner, BLANKS + "+", " ")


def normalize_d(t: Column) -> Column:
    """S-19."""
    t = strip(t)
    return F.when(F.lower(t) == "wrong", "WRONG").otherwise(F.translate(F.replace(t, F.lit("\\text{"), F.lit("")), "}\\ ", ""))


def normalize_e(t: Column) -> Column:
    """S-20."""
    t = F.regexp_replace(F.replace(strip(t), F.lit("$"), F.lit("")), r"\\[a-zA-Z]+", "")
    return F.lower(strip(F.regexp_replace(t, BLANKS + "+", " ")))


#: What stands before an answer, and what wraps it, in the order in which they are looked for.
ANSWER_PREFIXES = ("The answer is:", "The final answer is ", "The final answer is: ", "The answer is ")
LATEX_MARKS = ("boxed{", "text{", "texttt{")


def bbeh_prediction(t: Column) -> Column:
    """S-21: what follows the last answer prefix, without LaTeX wrapping, lower case, first line, no trailing dot."""
    no_dot = lambda x: F.regexp_replace(x, r"\.\z", "")
    behind = lambda prefix: lambda x: F.when(x.contains(prefix), strip(F.substring_index(x, prefix, -1))).otherwise(x)
    inside = lambda mark: lambda x: F.when(x.contains(mark) & x.endswith("}"), F.get(F.split(F.substring(x, F.lit(1), F.length(x) - 1), mark.replace("{", r"\{")), F.lit(1))).otherwise(x)
    t = strip(F.coalesce(t, F.lit("")))
    for prefix in ANSWER_PREFIXES:
        t = let(t, behind(prefix))
    t = let(no_dot(t), lambda x: F.when(x.startswith("$") & x.endswith("$") & (F.length(x) > 1), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    for mark in LATEX_MARKS:
        t = let(t, inside(mark))
    t = F.replace(F.replace(F.lower(t), F.lit(", "), F.lit(",")), F.lit("**"), F.lit(""))
    return no_dot(F.substring_index(t, "\n", 1))


def bbeh_reference(t: Column) -> Column:
    return F.replace(F.lower(strip(t)), F.lit(", "), F.lit(","))


def split_gold(t: Column) -> Column:
    """S-22."""
    return F.filter(F.transform(F.split(t, ","), strip), lambda x: x != "")


def concept_key(kind: Column, name: Column) -> Column:
    """S-23."""
    return F.lower(F.concat_ws(":", kind, name))


def apply_rules(name: Column, rules) -> Column:
    """S-24: the first rule that matches the whole name gives its canonical form, else the cleaned name."""
    clean = F.trim(F.regexp_replace(F.lower(name), r"\s+", " "))
    out = None
    for pattern, canonical in rules:
        hit = clean.rlike(f"^(?:{pattern})$")
        out = F.when(hit, canonical) if out is None else out.when(hit, canonical)
    return clean if out is None else out.otherwise(clean)


#: Concept names that mean the same, in order; the first whole match wins.
CONCEPT_RULES = [
    (r"divisibility\s+rules?\s+for\s+\d+(\s+and\s+\d+)?", "divisibility rules"),
    (r"divisibility\s+by\s+\d+(\s+and\s+\d+)?(\s+rule)?", "divisibility"),
    (r"divisibility\s+rules?$", "divisibility rules"),
    (r"divisibility\s+property(\s+of\s+(integers|remainders|consecutive integers))?", "divisibility"),
    (r"divisibility\s+of\s+integers", "divisibility"),
    (r"(definition\s+of\s+)?prime\s+numbers?$", "prime number"),
    (r"even\s+prime\s+number", "prime number"),
    (r"(pairwise\s+)?relatively\s+prime(\s+(numbers|integers))?", "coprimality"),
    (r"coprime(\s+integers)?", "coprimality"),
    (r"euler'?s\s+totient\s+(theorem|function)", "euler's totient function"),
    (r"fermat-euler'?s\s+theorem", "euler's theorem"),
    (r"euler'?s\s+theorem(\s+\(.*\))?", "euler's theorem"),
    (r"(modular\s+)?(multiplicative\s+)?inverse(\s+in\s+modular\s+arithmetic)?", "modular inverse"),
    (r"modular\s+multiplicative\s+inverse", "modular inverse"),
    (r"modular\s+arithmetic(\s+(properties|property|congruence|addition))?", "modular arithmetic"),
    (r"modular\s+arithmetic\s+for\s+.*", "modular arithmetic"),
    (r"modular\s+(addition|multiplication|subtraction)", "modular arithmetic"),
    (r"modular\s+equivalence", "modular congruence"),
    (r"modular\s+exponentiation", "modular exponentiation"),
    (r"congruence\s+(modulo\s+n|properties?|property\s+of\s+.*)", "modular congruence"),
    (r"congruence\s+properties?\s+of\s+modular\s+arithmetic", "modular congruence"),
    (r"prime\s+factorization(\s+and\s+divisors\s+relationship)?", "prime factorization"),
    (r"uniqueness\s+of\s+prime\s+factorization", "prime factorization"),
    (r"chinese\s+remainder\s+theorem", "chinese remainder theorem"),
    (r"greatest\s+common\s+divisor(\s+\(gcd\))?", "gcd"),
    (r"gcd(\s+\(greatest\s+common\s+divisor\))?", "gcd"),
    (r"least\s+common\s+multiple(\s+\(lcm\))?", "lcm"),
    (r"lcm(\s+\(least\s+common\s+multiple\))?", "lcm"),
    (r"(extended\s+)?euclidean\s+algorithm", "euclidean algorithm"),
    (r"fermat'?s\s+(little\s+)?theorem", "fermat's little theorem"),
    (r"base\s+conversion(\s+formula)?", "base conversion"),
    (r"positional\s+notation(\s+in\s+base\s+\d+)?", "positional notation"),
    (r"factorial(\s+function)?", "factorial"),
    (r"legendre'?s\s+formula(\s+for\s+factorials)?", "legendre's formula"),
    (r"(number\s+of\s+)?divisors?\s+(function\s+)?formula", "divisor function"),
    (r"number\s+of\s+divisors(\s+of\s+.*)?", "divisor counting"),
    (r"divisors?\s+from\s+prime\s+factorization", "divisor counting"),
    (r"perfect\s+square", "perfect square"),
    (r"perfect\s+cube", "perfect cube"),
    (r"pigeonhole\s+principle", "pigeonhole principle"),
    (r"floor\s+function", "floor function"),
    (r"ceiling\s+function", "ceiling function"),
    (r"sum\s+of\s+digits(\s+property)?", "digit sum"),
    (r"digit\s+sum", "digit sum"),
    (r"(cyclic\s+nature|periodicity)(\s+of\s+.*)?(\s+in\s+modular\s+arithmetic)?", "periodicity"),
    (r"cyclic\s+pattern(\s+of\s+.*)?", "periodicity"),
]


def choice_in_box(t: Column) -> Column:
    """S-25: a capital letter standing alone in the last box, in any case; else the whole content."""
    box = F.upper(strip(boxed_regex_last(t)))
    return F.coalesce(first_of(box, r"\b([A-Z])\b"), strip(boxed_regex_last(t)))


def is_choice(t: Column) -> Column:
    return strip(t).rlike("^[A-Za-z]$")


def option_prediction(t: Column, key: Column, letters: str = "ABCDEFGHIJ") -> Column:
    """S-26: first letter contained in the text; else one by hash of the key (where a random one is drawn elsewhere)."""
    out = F.when(F.lit(False), "")
    for x in letters:
        out = out.when(t.contains(x), x)
    drawn = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % len(letters)
    return out.otherwise(F.substring(F.lit(letters), (drawn + 1).cast("int"), F.lit(1)))


def content_id(text: Column, index: Column) -> Column:
    """S-28: ``q_<12 digits of MD5>_<index>``."""
    return F.concat(F.lit("q_"), F.substring(F.md5(F.concat_ws("_", text, index)), 1, 12), F.lit("_"), index.cast("string"))


def active_concepts(t: Column) -> Column:
    """S-29."""
    return F.filter(F.transform(F.split(t, r"[;|,\n\t]"), strip), lambda x: x != "")


def is_quota_error(t: Column) -> Column:
    """S-30."""
    return F.lower(t).rlike("quota|insufficient|rate limit|429")


def ontology_text(domains: dict[str, list[str]]) -> str:
    """S-27: a static list of concepts as text, a line per domain."""
    return "\n".join(f"- {domain}: {', '.join(names)}" for domain, names in domains.items())


def prompt_parts(text: str) -> tuple[str, str]:
    """S-31: the ``[SYSTEM]`` and ``[USER]`` parts of a prompt file; without marks the whole text is the user's."""
    head, mark, user = text.partition("[USER]")
    system = head.partition("[SYSTEM]")[2] if "[SYSTEM]" in head else ""
    return (system.strip(), user.strip()) if mark else ("", text.strip())
