"""Shortest paths against the library's own encoding, and round trips."""

import random

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from rentlens.llm import piece_transducer as P  # noqa: E402

PATH = pt.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "   ", "\n", " \n ", "a\n\n b", "Hello  world", "  two", "end  ", "<0x0A> <s></s><unk>", "日本語 😀 é ñ ß", "\x00\t\r", "a" * 5000, "word " * 20_000, "don't STOP", "x́", "…—", "123456789"]


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_against_library(monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(4)
    letters = "abcdefé ßñ  <>0xA日語😀\n\tThe ing er on tion" + "".join(map(chr, range(32, 127)))
    texts = [t for t in TEXTS if t is not None] + ["".join(rng.choices(letters, k=rng.randint(1, 50))) for _ in range(3000)]
    t = P.PieceTransducer(PATH)
    for x in texts:
        assert ids(t.encode(x)) == model.encode(x), x
        assert t.decode(np.array(ids(t.encode(x)), dtype=int)) == x
    t.cuts = False
    t.known.clear()
    monkeypatch.setattr(P, "CACHE_CHUNKS", 5)
    monkeypatch.setattr(P, "CACHE_PAIRS", 5)
    for x in texts[:300]:
        if len(x) < 1000:
            assert ids(t.encode(x)) == model.encode(x), x


def test_unigram_costs_take_the_cheapest_path():
    t = P.PieceTransducer(PATH)
    t.is_bpe = False
    pieces = {"a": 5.0, "b": 5.0, "ab": 7.0, "aba": 9.0, "ba": 4.0}
    t.piece, t.cost = list(pieces), list(pieces.values())
    t.trie = {p: i for i, p in enumerate(pieces)}
    rng = random.Random(2)

    def cheapest(x):
        return min((pieces[p] + cheapest(x[len(p):]) for p in pieces if x.startswith(p)), default=0.0 if not x else float("inf"))
    for _ in range(200):
        x = "".join(rng.choices("ab", k=rng.randint(1, 9)))
        path = t._between(x)
        assert "".join(t.piece[i] for i in path) == x and sum(t.cost[i] for i in path) == cheapest(x)


def test_documents(spark):
    schema = "doc_id long, text string, ids string, n_ids string, t int"
    rows = [(i, t, "", "", 0) for i, t in enumerate(TEXTS)] + [(None, "x y", "", "", 0), (3, "   ", "", "", 0)]
    df = spark.createDataFrame(rows, schema)
    out = P.encode_documents(df, PATH)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r[0]: r[1] or "" for r in rows}
    assert all(ids(r.ids) == model.encode(texts[r.doc_id]) and r.n_ids == len(ids(r.ids)) for r in got)
    assert {r.doc_id: r.text for r in P.decode_documents(out, PATH).collect()} == texts
    assert P.encode_documents(df.limit(0), PATH).count() == 0
