"""Context-tree weighting against a slow, literal version, and the unigram base line against plain counts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.llm import context_tree as T

TEXTS = ["the cat sat on the mat", "The  Cat\tsat", "", None, "mat the cat " * 30, "ähnlich äh ÄH", "zz", "cat", "on on on on", "unseen words here", "\n \x0b", "x" * 3000]


def bits_of(byte):
    node = 1
    for k in range(7, -1, -1):
        yield node, byte >> k & 1
        node = node * 2 + (byte >> k & 1)


def literal(train, texts, depth, limit):
    """Contexts as byte strings, counts in dictionaries, one decision node at a time."""
    seen = [(b"\n" * depth + T.plain(t or ""), depth) for t in train]
    follow = {}
    for s, d in seen:
        for i in range(d, len(s)):
            for k in range(depth + 1):
                follow.setdefault(s[i - k:i], Counter())[s[i]] += 1
    kept = {c for c, f in follow.items() if not c or sum(f.values()) >= limit}
    kids = {c: [k for k in kept if len(k) == len(c) + 1 and k.endswith(c)] for c in kept}

    def node_counts(f):
        out = {}
        for byte, n in f.items():
            for node, bit in bits_of(byte):
                out.setdefault(node, [0, 0])[bit] += n
        return out
    counts = {c: node_counts(follow[c]) for c in kept}
    rest = {}
    for c in kept:
        f = Counter(follow[c])
        for k in kids[c]:
            f.subtract(follow[k])
        rest[c] = node_counts({b: n for b, n in f.items() if n})
    kt = lambda z, o: math.lgamma(z + .5) + math.lgamma(o + .5) - math.log(math.pi) - math.lgamma(z + o + 1)
    get = lambda table, node: table.get(node, [0, 0])

    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    est = lambda t, node: (get(t, node)[1] + .5) / (sum(get(t, node)) + 1)

    def follow(c, node):
        z, o = get(rest[c], node)
        return z * math.log(1 - est(counts[c], node)) + o * math.log(est(counts[c], node))

    def pw(c, node):
        pe = kt(*get(counts[c], node))
        if not kids[c]:
            return pe
        below = math.log(.5) + add(kt(*get(rest[c], node)), follow(c, node)) + sum(pw(k, node) for k in kids[c])
        return math.log(.5) + add(pe, below)

    def one(history, node):
        """Probability of a one, from the root context down."""
        p, left, c = 0.0, 1.0, b""
        while True:
            if not kids[c]:
                return p + left * est(counts[c], node)
            w = math.exp(kt(*get(counts[c], node)) + math.log(.5) - pw(c, node))
            p, left = p + left * w * est(counts[c], node), left * (1 - w)
            longer = history[len(history) - len(c) - 1:]
            if longer not in kept:
                own = kt(*get(rest[c], node))
                alone = math.exp(own - add(own, follow(c, node)))
                return p + left * (alone * est(rest[c], node) + (1 - alone) * est(counts[c], node))
            c = longer
    out = []
    for t in texts:
        s, log = b"\n" * depth + T.plain(t or ""), 0.0
        for i in range(depth, len(s)):
            for node, bit in bits_of(s[i]):
                q = one(s[i - depth:i], node)
                log += math.log10(q if bit else 1 - q)
        out.append(log)
    return out


@pytest.mark.parametrize("depth,nodes", [(2, 1 << 15), (3, 40), (1, 3)])
def test_tree(spark, depth, nodes, monkeypatch):
    train = [t for i, t in enumerate(TEXTS[:10]) if i % 3]
    df = spark.createDataFrame([(t,) for t in train], "text string")
    grams = T.count_grams(df, frozenset(), depth).where("code is not null").select("code", "n")
    tree = T.tree_of(grams, depth, nodes)
    total = sum(len(T.plain(t or "")) for t in train)
    some = [t or "" for t in TEXTS[:10]]
    want = literal(train, some, depth, max(1, -(-total // nodes)))
    assert np.allclose(tree.score(some), want, rtol=1e-5)
    monkeypatch.setattr(T, "CHUNK", 50)
    assert np.allclose(tree.score(some), want, rtol=1e-5)
    cut = T.count_grams(df, frozenset(), depth).where("code is not null").select("code", "n")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, grams.collect()))
    # the probabilities of all next bytes add up to one in every state
    assert np.allclose((10.0 ** tree.log10.reshape(-1, 256).astype(float)).sum(1), 1, atol=1e-4)


@pytest.mark.parametrize("depth,most,weighed", [(5, 1 << 22, 1 << 18), (5, 40, 1), (3, 0, 50), (2, 30, 7), (1, 1 << 22, 1), (0, 20, 1)])
def test_every_context_counts(spark, depth, most, weighed, monkeypatch):
    monkeypatch.setattr(T, "HEAD_GRAMS", most)
    monkeypatch.setattr(T, "WEIGHED", weighed)
    rows = [(i, t) for i, t in enumerate(TEXTS[:11])] + [(9, TEXTS[9]), (None, "the dog sat")]
    is_train = lambda i: i is not None and i % 3 > 0
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = T.score_documents(df, F.col("doc_id") % 3 > 0, depth=depth).collect()
    want = literal([t for i, t in rows if is_train(i)], [t for _, t in rows], depth, 1)
    of = {(i, T.plain(t or "")): w for (i, t), w in zip(rows, want)}
    assert sorted((str(r.doc_id), round(r.score, 3)) for r in out) == sorted((str(i), round(w, 3)) for (i, _), w in zip(rows, want))
    assert len(of) == 12 and {r.n_bytes for r in out} == {len(t) for _, t in of}


def test_context_of_one_text_counts_in_a_large_corpus(spark):
    # one part in 65,536 of the bytes here is more than one occurrence
    rows = [(i, "one two three four " * 2_000) for i in range(4)] + [(8, "qxzvjk"), (9, "qxzvjk")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rare = [r.score for r in T.score_documents(df, F.col("doc_id") < 9).collect() if r.doc_id == 9]
    assert rare == pytest.approx(literal([t for i, t in rows if i < 9], ["qxzvjk"], 5, 1), rel=1e-4)


def base(rows, train):
    tokens = lambda t: T.plain(t or "")[:-1].split() + [None]
    c = Counter(w for i, t in rows if train(i) for w in tokens(t))
    n = sum(c.values())
    return {i: (len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in tokens(t))) for i, t in rows}


@pytest.mark.parametrize("head", [40_000, 3, 0])
def test_scores(spark, head, monkeypatch):
    monkeypatch.setattr(T, "frequent_words", lambda docs, i, t, words=head, f=T.frequent_words: f(docs, i, t, words) if words else frozenset())
    monkeypatch.setattr(T, "HEAD_SHARE", 1)
    rows = [(i * 3, t) for i, t in enumerate(TEXTS * 3)]
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    schema = "doc_id long, text string, t string, word string, n long, c long"
    df = spark.createDataFrame([(i, t, "q", "w", 1, 2) for i, t in rows], schema)
    out = T.score_documents(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).collect()
    want = base(rows, train)
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in out} == {i: w[:3] for i, w in want.items()}
    assert all(math.isclose(r.base_score, want[r.doc_id][3], rel_tol=1e-9) and r.score < 0 for r in out)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert T.score_documents(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    rows = [(None, "a b"), (None, "a b"), (5, "a c"), (5, "a c"), (5, None)]
    out = T.score_documents(spark.createDataFrame(rows, schema), F.lit(True)).collect()
    assert len(out) == 5 and {(r.doc_id, r.n_tokens, r.n_known) for r in out} == {(None, 3, 3), (5, 3, 3), (5, 1, 1)}
    want = math.log10(5 / 18) + math.log10(3 / 18) + math.log10(6 / 18)
    assert all(math.isclose(r.base_score, want) for r in out if r.n_tokens == 3) and all(r.train_tokens == 13 for r in out)
    nothing = T.score_documents(spark.createDataFrame(rows, schema), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isclose(r.bits_per_byte, 8, rel_tol=1e-5) for r in nothing)


def test_held_out_code_length(spark):
    from rentlens.llm.queries import QUERIES
    out = [r for r in QUERIES["op6_context_tree"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    # on 2 MB of training text the two are close; the tree is ahead on larger inputs (README)
    assert sum(r.score for r in out) > 1.05 * sum(r.base_score for r in out)
    assert -sum(r.score for r in out) * math.log2(10) / sum(r.n_bytes for r in out) < 2.3
