"""SentencePiece encoding against the library: ids, spans, decoded texts, normalisation by a compiled map."""

import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece

from millrace.llm import pieces, registry

SF = "/root/testdata/sf0.01"
PARTS = ["a", "b", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "ß", "中", "😀", "　", "\0", "ﬁ", "<s>", "<0x0A>", "Å", "\U0010fffe", "१", "xxxxx"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def codec():
    with open(pieces.default_model(), "rb") as f:
        return pieces.PieceCodec(f.read())


def drawn(parts, seed, n, longest):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(longest))) for _ in range(n)]


def test_ids_spans_and_text(codec, library):
    for t in ["", " ", "▁", *drawn(PARTS, 1, 2000, 60), *[" " * n for n in range(1, 60)], "ab" * 500, " " * 1000, "中" * 300 + "a" * 400, "\n" * 100]:
        ids, begins, ends = codec.encode(t)
        want = library.encode(t, add_bos=True, add_eos=True)
        assert ids.tolist() == want and codec.decode(ids) == library.decode(want)
        spans = [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist()))[1:-1] == spans and (begins[0], ends[0], ends[-1]) == (0, 0, len(t.encode()))


def test_decoding_of_any_ids(codec, library):
    rng = random.Random(3)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 259, 260, 29871, rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3, 259)]) for _ in range(rng.randrange(8))]
        assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("squeeze", [True, False])
def test_longest_prefix_normalisation(squeeze):
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", remove_extra_whitespaces=squeeze)
    spec = dict(pieces.fields(dict(pieces.fields(rules.serialized_model_proto()))[pieces.NORMALIZER]))
    with open(pieces.default_model(), "rb") as f:
        own = pieces.PieceCodec(f.read())
    own.map, own.squeeze = pieces.CharMap(spec[2]), squeeze
    for t in drawn([*PARTS, "①", "Å", "ｶﾞ", "ｶ", "﷽", "¨", "​", "\xa0", "\xad", " 　", "ﬃ", "㍿"], 5, 2000, 30):
        norm, alignment = own.normalize(t.encode())
        want, offsets = rules.normalize(t, with_offsets=True)
        edges = np.r_[0, np.cumsum([len(c.encode()) for c in norm.decode()])].astype(np.int64)
        begins = np.r_[0, np.cumsum([len(c.encode()) for c in t])]
        assert norm.decode() == want and alignment.source(edges).tolist() == [begins[o] for o in offsets]


def test_long_stretches_agree(codec):
    for t in drawn(["a", "b", "in", "th", "e", "▁", "中"], 7, 300, 40):
        assert codec._scan(list(t)) == codec._heap(list(t))


def test_stretches_side_by_side_agree(codec):
    for t in drawn(["a", "b", "in", "th", "e", "▁", "▁▁", "er", "中", "\U0010fffe", "on"], 9, 400, 40):
        words = codec.pattern.findall(t)
        codec.stretches.clear()
        codec.learn([words])
        assert all(codec.stretches[w] == codec.encode_stretch(w) for w in words)


def test_streamed_text(codec, library, monkeypatch):
    monkeypatch.setattr(pieces, "STREAM_CHARS", 50)
    monkeypatch.setattr(pieces, "STREAM_STRETCHES", 7)
    t = "Ünï words and  more ▁ words 中文\U0010fffe " * 40
    ids, begins, ends = codec.encode(t)
    assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
    assert list(zip(begins.tolist(), ends.tolist()))[1:-1] == [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]


def digests(library, t):
    ids = library.encode(t or "", add_bos=True, add_eos=True)
    named = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    return len(ids), named, hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_query(spark, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in registry.queries()["op13_sentencepiece_round_trip"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and all(got[r["doc_id"]] == digests(library, r["text"]) for r in docs)


def test_odd_rows(spark, library):
    rows = [(1, None, 1, "x"), (2, "", 1, "x"), (2, "", 1, "x"), (None, "no id", 1, "x"), (3, " \t\n", 1, "x"), (4, "the of and " * 100_000, 1, "x"), (5, " " * 300_000, 1, "x"), (6, "é" * 3000, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, pieces string").repartition(3)
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digest_table(df).collect()), key=str)
    assert got == sorted(((i, *digests(library, t)) for i, t, _, _ in rows), key=str)
    assert pieces.digest_table(df.limit(0)).count() == 0
    whole = {r["id"]: r for r in pieces.encode_table(df.where("doc_id in (3, 6)")).collect()}
    assert whole[3]["pieces"] == ["<s>", "▁▁", "<0x09>", "<0x0A>", "</s>"] and whole[3]["begins"] == [0, 0, 1, 2, 3] and whole[3]["decoded"] == " \t\n"


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.PieceCodec(b"")
