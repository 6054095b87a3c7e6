"""The whole pipeline against plain code on a small table."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from rentlens.llm import exact_dedup, pu_quality
from rentlens.llm.ball_simhash import drop_similar

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents, with planted exact and near copies of clean ones and rows without text."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").collect()}
    rows = [r.asDict() for r in docs.collect()]
    clean = [r for r in rows if r["doc_id"] in good and len((r["text"] or "").split()) > 120][:6]
    for i, r in enumerate(clean):
        rows.append(dict(r, doc_id=10_000 + i, text=r["text"].replace(" ", "\n")))
        words = r["text"].split(" ")
        rows.append(dict(r, doc_id=20_000 + i, text=" ".join(["changed", *words[1:]])))
    rows += [dict(clean[0], doc_id=30_000, text=None), dict(clean[0], doc_id=30_001, text="")]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, docs.schema).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingles(text):
    words = [w for w in exact_words(text)]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact_words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if not text.isspace() and text else []


def plain_stages(rows, model):
    kept = {i: t or "" for i, t in rows if model.score([t or ""])[0] >= 0.7}
    groups = defaultdict(list)
    for i, t in kept.items():
        groups["".join(c for c in t if c not in exact_dedup.WHITE)].append(i)
    once = {min(ids, key=lambda i: (-len(kept[i]), i)) for ids in groups.values()}
    sets = {i: shingles(" ".join(w for w in exact_words(kept[i]) if w)) for i in once}
    root = {i: i for i in once}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(once)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return kept, once, {i for i in once if find(i) == i}


def test_stages_keep_what_plain_code_keeps(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = pu_quality.fit(docs, labels)
    assert model.fitted
    kept, once, last = plain_stages([(r.doc_id, r.text) for r in docs.collect()], model)
    assert 20 < len(last) < len(once) < len(kept) < docs.count()
    stage = docs
    for (_, run), want in zip(corpus_pipeline.STAGES, (set(kept), once, last)):
        stage = run(spark, stage, folder)
        assert stage.columns == docs.columns
        stage = spark.createDataFrame(stage.collect(), docs.schema)
        assert {r.doc_id for r in stage.select("doc_id").collect()} == want


def test_run_packs_every_kept_text_once(spark, folder):
    from tokenizers import Tokenizer
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    last = plain_stages(list(rows.items()), pu_quality.fit(docs, labels))[2]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == last
    for i, parts in pieces.items():
        ids = np.array(tokenizer.encode(rows[i], add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at:at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_on_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, run in corpus_pipeline.STAGES:
        assert run(spark, docs.limit(0), folder).count() == 0
    assert drop_similar(docs.limit(0)).columns == docs.columns
