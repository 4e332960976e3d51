"""The corpus pipeline against a version in plain Python: every stage on its own input, and the whole."""

import hashlib
import math
import random
import re

import pyarrow.parquet as pq
import pytest
from test_llm import components, slow_dedup

import corpus_pipeline
from millrace.llm import bpe, chunks, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def slow_rules(rows):
    import unicodedata

    stops, kept = {w for v in quality.STOP_WORDS.values() for w in v}, []
    for r in rows:
        text = r[1] or ""
        words, lines = plain_words(text), [x for x in text.split("\n") if plain_words(x)]
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = {t for t in set(tri) if tri.count(t) > 1}
        m = {
            "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in quality.SYMBOLS), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_letters": sum(unicodedata.category(c)[0] in "LM" for c in text), "n_bang_words": (text.count("!") + text.count("?")) / 2, "n_stop_words": sum(w.lower() in stops for w in words),
            "n_repeat_words": len({p for i, t in enumerate(tri) if t in often for p in (i, i + 1, i + 2)}),
        }
        if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]:
            continue
        found = [(x, eval(x.metric, {}, m)) for x in quality.RULES]
        if all((x.low is None or v >= x.low) and (x.high is None or v <= x.high) for x, v in found):
            kept.append(r)
    return kept


def slow_near(rows):
    """One row of each group whose five-word shingles are at least 0.8 alike, all pairs compared."""
    sets = []
    for r in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = plain_words(w)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    with_id = [i for i, r in enumerate(rows) if r[0] is not None]
    links = [(i, j) for i in with_id for j in with_id if i < j and (rows[i][0] == rows[j][0] or alike(sets[i], sets[j]))]
    root = components(len(rows), links)
    least = {}
    for i in with_id:
        least[root[i]] = min(least.get(root[i], rows[i][0]), rows[i][0])
    one = {}
    for i in with_id:
        if rows[i][0] == least[root[i]]:
            one[root[i]] = min(one.get(root[i], rows[i]), rows[i], key=lambda r: r[1])
    return list(one.values()) + [r for r in rows if r[0] is None]


def slow_substring(rows):
    out = []
    for r, (_, text, removed, _) in zip(rows, slow_dedup([r[:2] for r in rows])):
        if text is None or plain_words(text):
            out.append((r[0], text, r[2], r[3], len(text) if removed else r[4]))
    return out


def slow_mix(rows):
    def topic(t):
        return next((n for n, p in mixing.TOPICS if re.search(p, t)), "prose")

    cell = [(r[3] or "", r[2] or "", topic(r[1] or "")) for r in rows]
    size = [max(1, len(plain_words(r[1]))) for r in rows]
    mass = {}
    for c, n in zip(cell, size):
        mass[c] = mass.get(c, 0.0) + n
    factor, goals = dict.fromkeys(mass, 1.0), []
    for k, d in enumerate(mixing.DIMENSIONS):
        sums = {}
        for c, m in mass.items():
            sums[c[k]] = sums.get(c[k], 0.0) + m
        raised = {v: m ** mixing.POWERS[d] for v, m in sums.items()}
        goals.append({v: g / sum(raised.values()) for v, g in raised.items()})
    gap = None
    for _ in range(mixing.MOST_ROUNDS):
        before, gap = gap, 0.0
        for k, goal in enumerate(goals):
            now = {}
            for c, m in mass.items():
                now[c[k]] = now.get(c[k], 0.0) + m * factor[c]
            gap = max([gap, *(abs(now[v] - goal[v]) for v in now)])
            factor = {c: f * goal[c[k]] / now[c[k]] for c, f in factor.items()}
        if gap <= mixing.TOLERANCE or before is not None and 0 <= before - gap <= 1e-3 * gap:
            break
    out = []
    for r, c in zip(rows, cell):
        rate = mixing.FRACTION * sum(size) * factor[c]
        u = int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:13], 16) / 16**13
        out += [r] * (math.floor(rate) + (u < rate - math.floor(rate)))
    return out


def slow_encode(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocabulary())
    library.no_truncation()
    library.no_padding()
    out = []
    for r in rows:
        e = library.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((r[0], len(e), sha(",".join(map(str, e))), sha(library.decode(e, skip_special_tokens=False))))
    return out


SLOW = [slow_rules, slow_near, slow_substring, slow_mix, slow_encode]


@pytest.fixture(scope="module")
def corpus():
    """Documents of the test data with nulls, repeated rows and ids, near copies, odd texts and shared passages among them."""
    rng = random.Random(3)
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()]
    rows = [r for r in rows if r[1] and len(r[1]) < 3000 and max(map(len, r[1].encode().split()), default=0) <= chunks.LONG][:260]
    good = [r for r in slow_rules(rows) if len(r[1]) > 600]
    near = [(1000 + i, " ".join("changed" if k == 20 else w for k, w in enumerate(r[1].split(" "))), *r[2:]) for i, r in enumerate(good[:12])]
    passage = " ".join(rng.choice(good)[1].split()[:60])
    shared = [(2000 + i, r[1][::-1].replace("\n", " ") + " the of and to in is for on as it " + passage, *r[2:]) for i, r in enumerate(good[12:24])]
    odd = [(None, good[1][1], "en", None, 7), (None, good[1][1], None, "a", 7), (None, None, None, None, None), (good[2][0], good[3][1] + " more", None, None, None), good[4], good[4], (3000, None, "en", "a", 0), (3001, "", "en", "a", 0), (3001, "  ", "en", "a", 0)]
    return rows + near + shared + odd


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_stages_and_whole(spark, corpus, tmp_path):
    df = spark.createDataFrame(corpus, SCHEMA).repartition(6)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows, sizes = corpus, []
    for (name, stage), slow in zip(corpus_pipeline.STAGES, SLOW):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
        out = stage(spark, docs, str(tmp_path))
        if slow is not slow_encode:
            assert out.columns == docs.columns, name
        want = slow(rows)
        same(out.collect(), want)
        rows = want
        sizes.append(len(rows))
    assert len(corpus) > sizes[0] > sizes[1] >= sizes[2] > sizes[3] > 0
    same(corpus_pipeline.run(spark, str(tmp_path)).collect(), rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns(spark, corpus):
    extra = "key long, a long, fp string, chunks string, n_chunks long, kept string, verdict string, rate double, id string"
    rows = [(*r, 1, 2, "fp", "c", 3, "k", "v", 0.5, "id") for r in corpus]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {extra}")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0
