"""Packing: the ids of the tokenizer, each in one piece, gapless sequences, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

pt = pytest.importorskip("public_tokenizers")
from rentlens.llm import harmonic_pack as H  # noqa: E402

PATH = pt.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello, it's THE end.", "don't can't I'LL we've 123 a1b2", "straße Été niño", "e\u0301 ﬁ ² \u00a0x\u2003y", "İstanbul ΟΔΟΣ ΣΑΣ",
         "<|endoftext|> a<|startoftext|>b", "tab\tnew\nline\x0b\x0c\rend", "\x1c\x85 ctrl\x00", "word " * 9000, "x" * 3000, "ª º µ ÷ × ¿¡«»", "!!!###$$$ a,b.c", "😀 日本語 テスト"]


def reference(t):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids + [2]


def test_ids(monkeypatch):
    for limit in (H.CACHE_WORDS, 2):
        monkeypatch.setattr(H, "CACHE_WORDS", limit)
        encode = H.word_encoder(PATH)
        for t in TEXTS:
            assert np.frombuffer(encode(t or ""), "<u4").tolist() == reference(t)[:-1], t


def test_cuts():
    for n in list(range(1, 9000, 7)) + [4096, 8192, 2048, 2049, 4095]:
        parts = H.cuts(n)
        assert sum(parts) == n and all(0 < p <= 4096 for p in parts) and len(parts) <= n // 4096 + 6
        for p in parts:
            assert p * (4096 // p) >= 4096 - max(H.SMALL, 4096 * H.SLACK, 4096 // p)


def check(rows, capacity):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append((r.start, r.length, r.doc_tokens))
    padded = real = 0
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert 0 < at <= capacity
        real += at
        padded += at if at & (at - 1) == 0 else capacity
    for d in docs.values():
        at = 0
        for start, length, total in sorted(d):
            assert start == at
            at += length
        assert at == total
    return real / padded


def test_documents(spark):
    rows = [(i, t, "a", 1, 2, "z") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, length long, k long, worker string")
    out = H.pack_documents(df, PATH, with_ids=True).collect()
    check(out, 4096)
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert ids.tolist() == reference(TEXTS[r.doc_id])[r.start:r.start + r.length] and zlib.crc32(r.ids) == r.ids_crc32
    assert H.pack_documents(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("worker_tokens", [1 << 22, 40_000, 3_000])
def test_rounds(spark, worker_tokens):
    rng = np.random.default_rng(3)
    rows = []
    for doc in range(1500):
        n = int(rng.integers(1, 3000)) if doc % 3 else 777
        at = 0
        for p in H.cuts(n):
            rows.append((doc if doc else None, at, p, 5, n))
            at += p
    cut = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    out = H.harmonic_pack(cut, worker_tokens=worker_tokens).collect()
    assert len(out) == len(rows) and len({(r.doc_id, r.start) for r in out}) == len(rows)
    assert check(out, 4096) > 0.97


def test_repeated_rows(spark):
    cut = spark.createDataFrame([(1, 0, 1365, 9, 1365)] * 700, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    out = H.harmonic_pack(cut, worker_tokens=50_000).collect()
    assert len(out) == 700 and len({(r.sequence_id, r.offset) for r in out}) == 700
