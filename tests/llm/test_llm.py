"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import json
import random
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from millrace.llm import ann, bpe, chunks, licenses, mixing, near, packing, quality, registry, simhash, warc, wordpiece
from millrace.llm.common import join_facts

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words long, id long, fp string"
ODD = [
    (1, None, None, None, None, 1, 1, "x"),
    (2, "", "en", "a", 0, 1, 1, "x"),
    (2, "", "en", "a", 0, 1, 1, "x"),
    (None, "no id here", "de", None, 0, 1, 1, "x"),
    (3, " \t\n", "xx", "a", 0, 1, 1, "x"),
    (4, "the of and to in is for on " * 40_000, "en", "a", 0, 1, 1, "x"),
    (5, "Ünïcode " + "é" * 3000, "fr", "b", 0, 1, 1, "x"),
    (6, "x" * 3000, "en", "b", 0, 1, 1, "x"),
    (7, "one\r\ntwo\x0bthree\x0cfour <|endoftext|> five", "en", "b", 0, 1, 1, "x"),
    (7, "another text under the same id", "en", "b", 0, 1, 1, "x"),
]


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def components(n, links):
    at = list(range(n))

    def root(x):
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for a, b in links:
        at[root(a)] = root(b)
    return [root(i) for i in range(n)]


# ---- SimHash


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, docs):
    rows = simhash.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs)
    for d in docs[:150]:
        assert got[d["doc_id"]]["fingerprint"] == f"{slow_fingerprint(d['text']):016x}"
    ids = sorted(got)
    fp = np.array([int(got[i]["fingerprint"], 16) for i in ids], np.uint64)
    links = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    root = components(len(ids), links.tolist())
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, ids[i]), ids[i])
    assert [got[i]["component_id"] for i in ids] == [least[r] for r in root]


@pytest.mark.parametrize("n", [10, 10**4, 10**6, 10**8, 10**10])
def test_blocks_are_complete(n):
    choices, rng = simhash.plan_blocks(n), random.Random(n)
    for _ in range(300):
        flipped = set(rng.sample(range(64), 4))
        assert any(all(not flipped & set(range(o, o + w)) for o, w in spans) for spans in choices)
    assert len({tuple(s) for s in choices}) == len(choices)


def test_refined_keys_are_complete():
    rng = random.Random(5)
    for n in (10, 10**10):
        for spans in simhash.plan_blocks(n)[:9]:
            own = sum(((1 << w) - 1) << o for o, w in spans)
            longer = simhash.masks(spans)
            assert all(m & own == own and m != own for m in longer)
            for _ in range(100):
                flips = sum(1 << i for i in rng.sample([i for i in range(64) if not own >> i & 1], 4))
                assert any(not m & flips for m in longer)


@pytest.mark.parametrize("most", [simhash.CROWDED, 60])
def test_simhash_dense_groups(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "CROWDED", most)
    rng = np.random.default_rng(3)
    fps = set()
    for _ in range(6):
        base = int(rng.integers(0, 2**63))
        for _ in range(250):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x - 2**64 if x >= 2**63 else x)
    fps = sorted(fps)
    rows = [(i, f) for i, f in enumerate(fps)]
    got = {r["id"]: r["component_id"] for r in simhash.components(spark.createDataFrame(rows, "id long, fp long")).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    root = components(len(u), np.argwhere(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4).tolist())
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert [got[i] for i in range(len(u))] == [least[r] for r in root]


def test_simhash_edges(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and not simhash.near_duplicates(none).collect()
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 4, 5, 6, 7]


def test_stage_links_similar_texts(spark, odd, docs):
    rng = random.Random(4)
    words = [d["text"].lower().split() for d in docs if d["text"]]
    words = [w for w in words if 60 <= len(w) <= 600][:400]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    rows, alike = [], {"0.80-0.85": [], "0.85-0.90": [], "0.90-0.95": [], "0.95-1.00": []}
    for i, w in enumerate(words):
        other = list(w)
        for at in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) // 40))):
            other[at] = f"new{at}x{i}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
        a, b = grams(w), grams(other)
        j = len(a & b) / len(a | b)
        for k, v in alike.items():
            if float(k[:4]) <= j < float(k[5:]):
                v.append(i)
    got = {r["id"]: r["component_id"] for r in near.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = {k: (sum(got[2 * i] == got[2 * i + 1] for i in v), len(v)) for k, v in alike.items()}
    print("linked, pairs by similarity:", recall)
    assert all(n >= 0.95 * m and m > 20 for n, m in recall.values())
    kept = simhash.keep_one(odd, similar=True)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id IS NOT NULL").collect()) == sorted((r[0], r[1]) for r in [ODD[0], *ODD[5:8], ODD[9]])
    # Every link found is exact: small buckets and large ones.
    base = " ".join(f"w{i}" for i in range(200))
    many = [(i, base + f" end{i}") for i in range(200)] + [(999, " ".join(f"w{i}" for i in range(120)))]
    found = {r["id"]: r["component_id"] for r in near.components(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert {found[i] for i in range(200)} == {0} and found[999] == 999


# ---- Quality rules


def slow_quality(text):
    for c in "\t\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {t for t in tri if tri.count(t) > 1}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len({p for i, t in enumerate(tri) if t in often for p in (i, i + 1, i + 2)})


def test_quality(spark, odd, none):
    texts = ["a b c a b c d", "a a a a a", "x\ny\nx\n\nx \n#*<>", "one two", "", "the " * 60, "p q r s p q r t p q"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.report(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_repeat_words"]) == slow_quality(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.report(df).collect()}[2] == 1
    got = quality.report(odd).collect()
    assert len(got) == len(ODD) and not quality.report(none).collect()
    assert all(r["base_failed"] and not r["kept"] for r in got)
    assert quality.keep_good(odd).columns == odd.columns


def test_stop_words_are_a_share(spark):
    keywords = " ".join(f"keyword{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000))
    rows = " ".join(f"cell{chr(97 + i % 26)}{chr(97 + i // 26)} |" for i in range(300))
    texts = [keywords + " the", rows + " the", keywords + " the of and" * 15]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality.report(df).collect()} == {0: False, 1: True, 2: True}


# ---- BPE


@pytest.fixture(scope="module")
def source():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_like_the_library(source, library, docs):
    c = bpe.BpeCodec(source)
    texts = [d["text"] for d in docs[:400]] + ["", " ", "\n\n  a\n", "<|endoftext|>", "a <|endoftext|>  <|endoftext|>b ", "x" * 5000, "ab" * 3000, "'s 'S don't I'LL", "１２³½Ⅷ", "a b　 c\x85d\x1ce\x1f"]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert c.encode(t) == e.ids, t[:80]
        assert c.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)


def test_bpe_every_character(source, library):
    c = bpe.BpeCodec(source)
    points = [p for p in range(0x20000) if not 0xD800 <= p < 0xE000] + list(range(0xE0000, 0xE0200))
    for at in range(0, len(points), 64):
        t = "".join(f"a{chr(p)}1 {chr(p)}{chr(p)}. " for p in points[at : at + 64])
        if c.encode(t) != library.encode(t, add_special_tokens=False).ids:
            bad = [hex(p) for p in points[at : at + 64] if c.encode(f"a{chr(p)}1 {chr(p)}{chr(p)}. ") != library.encode(f"a{chr(p)}1 {chr(p)}{chr(p)}. ", add_special_tokens=False).ids]
            raise AssertionError(bad)


def test_bpe_heap_merges_like_the_scan(source):
    c, rng = bpe.BpeCodec(source), random.Random(5)
    for _ in range(200):
        w = bytes(rng.choice(b"abcdeth ing\xc3\xa9") for _ in range(rng.randint(2, 200)))
        assert c._encode_long([c.first[b] for b in w]) == c.encode_word(w)


def test_bpe_query(odd, none, library, monkeypatch):
    monkeypatch.setattr(bpe, "STREAM_CHARS", 1000)
    rows = bpe.digest_table(odd).collect()
    assert len(rows) == len(ODD) and not bpe.digest_table(none).collect()

    def digest(t):
        e = library.encode(t or "", add_special_tokens=False)
        return len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()

    want = sorted((repr(r[0]), *digest(r[1])) for r in ODD)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows) == want
    codec = bpe.BpeCodec(open(bpe.default_vocabulary(), encoding="utf-8").read())
    assert sorted((repr(r[0]), *bpe._digest(codec, r[1] or "")) for r in ODD) == want  # streamed
    assert {r["decoded"] for r in bpe.encode_table(odd).collect()} == {r[1] or "" for r in ODD}


# ---- Token counts


def test_wordpiece_against_greedy(docs, odd, none):
    pieces = wordpiece.read_pieces(open(wordpiece.default_vocabulary()).read())
    c = wordpiece.PieceCounter(pieces)
    first, rest = {p for p in pieces if p[:1] == b" "}, {p for p in pieces if p[:1] != b" "}

    def greedy(word):
        word, n, vocabulary = b" " + word, 0, first
        while word:
            k = next(k for k in range(min(len(word), 130), 0, -1) if word[:k] in vocabulary)
            word, n, vocabulary = word[k:], n + 1, rest
        return n

    rng, words = random.Random(2), {w for d in docs[:60] for w in (d["text"] or "").encode().split()}
    words |= {bytes(rng.choice(b"aeihnorst\xc3\xa9.,0") for _ in range(rng.randint(1, 40))) for _ in range(2000)}
    for w in words:
        assert c.count_word(w) == greedy(w), w
    rows = wordpiece.token_counts(odd).collect()
    assert len(rows) == len(ODD) and not wordpiece.token_counts(none).collect()
    assert {(r["n_words"], r["n_tokens"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(0, 0)}


# ---- Chunks


def test_chunks_resist_shifts():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    a, b = " ".join(words).encode(), " ".join(["new", "words", *words[:200], "and", "more", *words[200:]]).encode()
    x, y = (chunks.digests(t, chunks.boundaries(t)[0]) for t in (a, b))
    starts = chunks.boundaries(a)[0].tolist()
    assert b"".join(a[i:j] for i, j in zip(starts, [*starts[1:], len(a)])) == a
    assert len(set(x) - set(y)) <= 6 and len(x) > 40


def test_substring_dedup(spark, odd, none):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n))
    passage = prose(60)
    rows = [(i, f"{prose(30 + i)}\n{passage} {prose(20)}" if i % 3 == 0 else prose(80)) for i in range(30)]
    rows.append((40, prose(10) + " " + passage + " " + prose(7) + "\n" + passage))
    got = {r["doc_id"]: r for r in chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), details=True).collect()}
    for i, text in rows:
        if i == 0 or i % 3 and i < 40:
            assert got[i]["text"] == text and got[i]["n_words_removed"] == 0
        else:
            assert got[i]["n_words_removed"] >= 25 and 0 in got[i]["first_doc_ids"] and passage not in got[i]["text"]
    assert got[40]["n_words_removed"] >= 2 * 25
    out = sorted((tuple(r) for r in chunks.deduplicate(odd).collect()), key=repr)
    assert [r for r in out if r[0] not in (4, 5, 6)] == sorted((r for r in ODD if r[0] not in (4, 5, 6)), key=repr)
    cut = [r for r in out if r[0] in (4, 5, 6)]  # texts that repeat themselves
    assert len(cut) == 3 and all(r[4] == len(r[1]) < 500 for r in cut) and not chunks.deduplicate(none).collect()
    assert chunks.keep_rest(odd).columns == odd.columns


def slow_dedup(rows, min_words=chunks.MIN_WORDS):
    """``[(doc, text, n_words_removed, firsts)]`` by definition, from rows ``(doc, text)``."""

    def cut_up(text):
        h = [sum(int(chunks.GEAR[text[i - k]]) << k for k in range(min(16, i + 1))) % 65536 for i in range(len(text))]
        blank = [b in b" \t\n\x0b\x0c\r" for b in text]
        starts = [i for i in range(len(text)) if not blank[i] and (i == 0 or blank[i - 1])]
        ends = [next((j for j in range(i, len(text)) if blank[j]), len(text)) for i in starts]
        low = lambda at, r: [all(at[i] <= at[j] for j in range(max(0, i - r), min(len(at), i + r + 1))) for i in range(len(at))]
        marks = [(s, n) for n, (s, ok) in enumerate(zip(starts, low([h[max(0, s - 1)] for s in starts], chunks.RADIUS))) if ok or n == 0]
        assert all(e - s <= chunks.LONG for s, e in zip(starts, ends))
        cuts = [*(s for s, _ in marks), len(text)]
        counts = [*(n for _, n in marks), len(starts)]
        return [(a, b, text[a:b].rstrip(), m - n) for a, b, n, m in zip(cuts, cuts[1:], counts, counts[1:])]

    first, times, made = {}, {}, [cut_up((t or "").encode()) if d is not None else [] for d, t in rows]
    for (d, _), parts in zip(rows, made):
        for _, _, name, _ in parts:
            first[name], times[name] = min(d, first.get(name, d)), times.get(name, 0) + 1
    out = []
    for (d, t), parts in zip(rows, made):
        seen, again = set(), []
        for _, _, name, _ in parts:
            again.append(times[name] > 1 and (first[name] < d or name in seen))
            seen.add(name)
        raw, gone, removed, firsts, i = (t or "").encode(), [], 0, set(), 0
        while i < len(parts):
            j = i
            while j < len(parts) and again[j]:
                j += 1
            run = parts[i:j]
            words, by = sum(p[3] for p in run), {}
            for p in run:
                by[first[p[2]]] = by.get(first[p[2]], 0) + p[3]
            if run and (words >= 2 * min_words or words >= min_words and 2 * max(by.values()) >= words):
                gone.append((run[0][0], run[-1][1]))
                removed += words
                firsts |= set(by)
            i = max(j, i + 1)
        for a, b in reversed(gone):
            raw = raw[:a] + raw[b:]
        out.append((d, None if t is None else raw.decode() if raw.split() else "" if gone else t, removed, sorted(firsts)))
    return out


def test_substring_dedup_against_brute_force(spark, docs):
    short = [(d["doc_id"], d["text"]) for d in docs if d["text"] and len(d["text"]) < 4000 and max(map(len, d["text"].encode().split()), default=0) <= chunks.LONG][:300]
    rows = [*short, (None, short[5][1]), (short[7][0], short[8][1]), (short[9][0], short[9][1]), (10**6, None), (10**6 + 1, ""), (10**6 + 2, short[3][1] + "\n" + short[3][1])]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, n_chunks string, n_words_removed long").repartition(5)
    got = chunks.deduplicate(df, details=True)
    assert len(set(got.columns)) == len(got.columns) == 6
    key = lambda r: repr(r)
    assert sorted(((r["doc_id"], r["text"], r["n_words_removed"], r["first_doc_ids"]) for r in got.collect()), key=key) == sorted(slow_dedup(rows), key=key)
    assert sum(r[2] > 0 for r in slow_dedup(rows)) > 20


def test_facts_join_with_frequent_keys(spark):
    rows = spark.createDataFrame([(f"k{min(i, 50) % 51}", i) for i in range(5000)] + [(None, -1)], "k string, i long")
    facts = rows.where("k IS NOT NULL").groupBy("k").agg({"i": "max", "*": "count"}).toDF("k", "n", "top")
    facts = spark.createDataFrame([(r["k"], r["top"], r["n"]) for r in facts.where("k <> 'k3'").collect()], "k string, top long, n long")
    want = {r["k"]: r["top"] for r in facts.collect()}
    got = join_facts(rows, facts, ["k"], "top", ["i"]).collect()
    assert len(got) == 5001 and all(r["top"] == want.get(r["k"]) for r in got)


def test_substring_dedup_of_stretches_without_minima(spark):
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))) for _ in range(n))
    for k, passage in enumerate((" ".join(["again"] * 80), " ".join(["one two three"] * 30), "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(400)), "".join(rng.choice("abc{};=()") for _ in range(900)))):
        rows = [(i, f"{prose(40)} {passage} {prose(40)}" if k < 2 else f"{prose(40)} x{i}{passage}y{i} {prose(40)}") for i in range(3)]
        got = {r["doc_id"]: r for r in chunks.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), details=True).collect()}
        for i in (1, 2):
            assert got[i]["n_words_removed"] >= 50 and len(got[i]["text"]) < len(rows[i][1]) - 0.6 * len(passage), (k, i)
            assert got[i]["text"][:60] == rows[i][1][:60] and got[i]["text"][-60:] == rows[i][1][-60:]
    starts, words = chunks.boundaries(("a " + "é" * 3000 + " b").encode())
    assert int(words.sum()) == 2 + 6000 // 8 and max(np.diff(starts)) <= 64


def test_substring_dedup_of_copies(spark):
    text = " ".join(f"word{i}" for i in range(300))
    df = spark.createDataFrame([(i, text) for i in range(5)] + [(0, text)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in chunks.deduplicate(df).collect())
    assert got == [(0, text), (0, text)] + [(i, "") for i in range(1, 5)]
    assert chunks.keep_rest(df).count() == 2


# ---- Mixing


def test_mixing_marginals(spark, odd, none):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    cells = mixing.fit(mixing.weigh(df), rounds=12).toPandas()
    mass = cells["__mr_x_mass"] * cells["__mr_x_factor"]
    assert abs(mass.sum() - 1) < 1e-9
    for d, power in mixing.POWERS.items():
        want = cells.groupby(f"__mr_x_{d}")["__mr_x_mass"].sum() ** power
        got = mass.groupby(cells[f"__mr_x_{d}"]).sum()
        assert np.allclose(got, want / want.sum(), atol=1e-4)
    assert len(mixing.report(odd).collect()) == len(ODD) and not mixing.report(none).collect()
    assert mixing.sample(odd).columns == odd.columns


def test_sample_reaches_its_targets(spark):
    # One source has a third, nineteen are even and ten have 0.1 % each; all in one language and topic.
    sizes = {"big": 1000, **{f"even{i}": 103 for i in range(19)}, **{f"rare{i}": 3 for i in range(10)}}
    rows = [(f"{s}-{i}", "word " * 40, "en", s) for s, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    drawn = {r["source"]: r["count"] for r in mixing.sample(df).groupBy("source").count().collect()}
    total, roots = sum(drawn.values()), sum(n**0.5 for n in sizes.values())
    assert abs(total / len(rows) - mixing.FRACTION) < 0.02
    share = 10 * 3**0.5 / roots
    assert abs(sum(n for s, n in drawn.items() if s.startswith("rare")) / total - share) < 0.015
    for r in mixing.marginals(df).where("dimension = 'source'").collect():
        assert abs(r["copies"] - sizes[r["value"]] ** 0.5 / roots) < 1e-5


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    small = sorted(mixing.report(df).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", -1)
    assert sorted(mixing.report(df).collect()) == small


# ---- Packing


def test_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(50):
        length = rng.choice([16, 33, 64])
        lengths = [rng.randint(1, length) for _ in range(rng.randint(1, 80))]
        rooms: list[int] = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(length - x)
        rows = packing.best_fit(lengths, length)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(length - sum(lengths[i] for i in r) for r in rows) == sorted(rooms)


def test_packing_is_lossless(spark, docs, library, tmp_path, none, odd):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    packed = packing.pack(df, length=256, window_tokens=20_000)
    rows = packed.collect()
    ids = packing.unpack(rows)
    for d in docs:
        if d["doc_id"] < 120:
            assert ids[d["doc_id"]] == library.encode(d["text"], add_special_tokens=False).ids + [packing.END_ID]
    for r in rows:
        p = packing.positions(r["cu_seqlens"], 256)
        assert all(p[x] == 0 for x in r["position_resets"]) and r["cu_seqlens"][-1] == r["n_tokens"] <= 256
    # What is written and read back is what is packed, whatever the folder holds from other attempts.
    uri = f"file://{tmp_path}/out"
    manifest = packing.write(df, uri, length=256, window_tokens=20_000)
    back = sorted(packing.read(manifest, uri).collect())
    assert back == sorted(rows) and sum(r["rows"] for r in manifest.collect()) == len(rows) and manifest.count() > 3
    for r in manifest.collect():
        index = json.load(open(r["file"].removesuffix("bin") + "json"))
        m = np.fromfile(r["file"], index["dtype"]).reshape(index["shape"])
        assert len(m) == r["rows"] == len(index["cu_seqlens"])
    assert sum(len(r["doc_ids"]) for r in packing.pack(odd, length=10**6).collect()) == len(ODD) and not packing.pack(none).collect()
    got = packing.report(odd).collect()
    assert sum(len(set(r["doc_ids"])) for r in got) >= 5 and "input_ids" not in packing.report(none).columns and not packing.report(none).collect()
    assert packing.unpack(packing.pack(odd.where("doc_id = 7 AND text LIKE 'one%'")).collect())[7].count(packing.END_ID) == 2


def test_packing_of_long_white_space(spark, library):
    texts = [f"a{c * 1_000_000}b" for c in " \n"] + [" " * 1_000_000, "x" * 300_000, "#" * 300_000]
    texts.append("a" + " \n\t" * 5000 + "<|endoftext|>" + " " * 5000 + "<|endoftext|> x" + "\n" * 4096 + "'s" + " " * 4097 + "\x1c" + " " * 4095 + "é")
    got = packing.unpack(packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window_tokens=100_000).collect())
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t, add_special_tokens=False).ids + [packing.END_ID], i


# ---- WARC


def test_warc_query(spark):
    rows = [(1, "http://a", "x"), (2, "http://b\r\nX: y", "x"), (3, "http://ü", ""), (4, None, None), (5, "u", "é" * 70000), (6, "u", "q\r\n\r\nWARC/1.1\r\n\r\n"), (None, "u", "x"), (None, "u", "alone"), (9, "u", "r"), (9, "u", "r"), (8, "u", "r")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "") or -1, p if p is not None else -1)
    want = []
    for p, _, h in rows:
        raw, top = (h or "").encode(), best[h or ""]
        refers = top if top >= 0 and p != top else None
        want.append((p, len(raw), warc.payload_digest(raw), "response" if refers is None else "revisit", refers))
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    assert not warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect()
    clash = spark.createDataFrame([(1, "u", "x", "y", 3, 5), (2, "u", "x", "z", 4, 6)], "page_id long, url string, html string, sha string, best long, n long")
    assert sorted((r["page_id"], r["refers_to"]) for r in warc.round_trip(clash).collect()) == [(1, 2), (2, None)]


def test_warc_normaliser(tmp_path):
    import gzip
    import io
    import zlib

    rng = random.Random(6)
    records = [warc.build_record(i, f"http://x/{i}", bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 3000, 2_500_000 if i == 3 else 5]))), None if i % 3 else i + 1) for i in range(12)]
    for whole in (gzip.compress(b"".join(records)), gzip.compress(b"".join(records[:5])) + gzip.compress(b"".join(records[5:]))):
        out = io.BytesIO()
        index = list(warc.normalise(io.BytesIO(whole), out))
        assert [zlib.decompress(out.getvalue()[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == records
    with pytest.raises(EOFError):
        list(warc.normalise(io.BytesIO(gzip.compress(b"".join(records))[:-2000]), io.BytesIO()))


# ---- Nearest neighbours


def test_ann_recall(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = np.array(t["vec_id"]), np.stack(t["embedding"].to_numpy()).astype(float)
    got = {}
    for r in ann.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    u, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    asked = np.flatnonzero(ids % 50 == 0)
    for i in asked:
        s = u @ u[i]
        s[i] = -9
        true = set(ids[np.argsort(-s)[:5]].tolist())
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(a[2] >= b[2] for a, b in zip(mine, mine[1:]))
        assert all(abs(m[2] - u[np.flatnonzero(ids == m[1])[0]] @ u[i]) < 1e-12 for m in mine)
        hits += len(true & {m[1] for m in mine})
    assert hits / 5 / len(asked) >= 0.9


def test_ann_edges(spark):
    rng = np.random.default_rng(0)
    same = [1.0, 2.0, 0.0]
    rows = [(i, same) for i in range(0, 60)] + [(100 + i, rng.normal(size=3).tolist()) for i in range(40)]
    rows += [(500, None), (550, [0.0, 0.0, 0.0]), (600, [1.0, None, 0.0]), (650, [float("nan"), 1.0, 1.0]), (700, [float("inf"), 1.0, 1.0]), (750, []), (None, same), (50, same)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r["vec_id"])
    assert by[0] == [1, 2, 3, 4, 5] and by[50] == [0, 1, 2, 3, 4] and set(by) == {0, 50, 100}
    assert len(by[100]) == 5
    few = ann.search(spark.createDataFrame([(0, same), (1, same)], "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)]
    assert not ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect()


def test_ann_ties_and_sizes(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=8)
    rows = [(i, (v * (i + 1)).tolist()) for i in range(300)] + [(1000 + 25 * i, rng.normal(size=8).tolist()) for i in range(40)]
    by = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    for q in range(0, 300, 50):
        assert by[q] == [(i, 1.0) for i in range(6) if i != q][:5]
    x = {0: [1e200, 1e200], 1: [1e200, 0.0], 2: [-1e-200, 1e-200], 3: [1e-200, 2e-200], 50: [1e308, 1e-308], 100: [5e-324, 5e-324]}
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.search(spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 3 * 5
    angle = lambda a: np.arctan2(a[1], a[0])
    for (a, b), score in got.items():
        assert abs(score - np.cos(angle(x[a]) - angle(x[b]))) < 1e-12, (a, b)


def test_balanced_cut():
    rng = np.random.default_rng(1)
    x = ann.unit(rng.normal(size=(800, 16)))
    part = ann.balanced_cut(x, ann.nearest(x, x, 10, skip_self=True), 8, rng)
    assert np.bincount(part, minlength=8).max() <= np.ceil(800 / 8 * 1.1)


# ---- Licenses


def test_licenses(spark, odd, none, docs):
    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        assert s.trigger.search(text), name
        found = [r[1] for r in s.scan("some prose here\n" + text + "\nmore prose follows")]
        assert found == [name], (name, found)
    assert not list(s.scan("A driver needs a licence to drive a car on public roads in most countries."))
    changed = licenses.TEMPLATES["MIT-text"].replace("free of charge", "for a fee")
    (row,) = s.scan(changed)
    assert row[1] == "MIT-text" and row[4] == ["free", "of", "charge"] and row[5] == ["for", "a", "fee"]
    long = ("filler words go on " * 3000) + licenses.TEMPLATES["GPL-3.0"] + " filler" * 3000
    assert [r[1] for r in s.scan(long)] == ["GPL-3.0"]
    rows = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    notices = {k: licenses.TEMPLATES[k] for k in ("Apache-2.0", "MIT", "GPL-3.0", "CC-BY-NC-4.0")}
    want = {(d["doc_id"], k) for d in docs for k, v in notices.items() if v in (d["text"] or "")}
    assert {(r["doc_id"], r["license_id"]) for r in rows} == want
    assert not licenses.scan(none).collect() and not licenses.scan(odd).collect()
    rows = [(None, licenses.TEMPLATES["MIT"]), (3, licenses.TEMPLATES["MIT"]), (3, licenses.TEMPLATES["MIT"]), (4, None), (5, "")]
    got = licenses.scan(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, license_id string, id long")).collect()
    assert sorted((r["doc_id"] or 0, r["line"], r["license_id"]) for r in got) == [(0, 0, "MIT"), (3, 0, "MIT"), (3, 0, "MIT")]


@pytest.mark.parametrize("width", [100, 72, 60, 40, 25])
def test_licenses_wrapped(width):
    import textwrap

    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        for mark in ("", "# ", " * "):
            wrapped = "\n".join(mark + line for line in textwrap.wrap(text, width))
            assert [r[1] for r in s.scan("x = 1\n" * 30 + wrapped + "\n" + "y = 2 of the\n" * 30)] == [name], (name, width)


def test_licenses_several_in_a_block():
    s, t = licenses.Scanner(), licenses.TEMPLATES
    for gap in (" ", "\n", " and for the pictures of this text: "):
        assert [r[1] for r in s.scan(t["MIT"] + gap + t["CC-BY-SA-4.0"])] == ["MIT", "CC-BY-SA-4.0"]
        assert [r[1] for r in s.scan(gap.join(t.values()))] == list(t)
        assert [r[1] for r in s.scan(gap.join([t["MIT"]] * 3))] == ["MIT"] * 3
    assert [r[:2] for r in s.scan("first\nsecond\n" + t["MIT"])] == [(2, "MIT")]


def test_registry():
    names = registry.queries()
    assert len(names) == 13 and set(registry.oracle_sql()) <= set(names)
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_combinations_cover():
    spans = simhash.plan_blocks(10)
    assert len(spans) == 5 and all(len(c) == 1 for c in spans) and len(list(combinations(range(5), 1))) == 5
