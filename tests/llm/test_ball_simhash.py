"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from rentlens.llm import ball_simhash as B


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    return root


TEXTS = ["", None, "One", "one two", "ONE two", "one two three", "É é É é", "a\u00a0b c\x1cd e", "x " * 20_000, "\t\n", "w0 w1 w2 w3 W4"]


def test_fingerprint(monkeypatch):
    for chunk in (50_000, 3):
        monkeypatch.setattr(B, "CHUNK", chunk)
        for t in [t for t in TEXTS if t is not None and len(t) < 1000]:
            assert B.fingerprint(t) % (1 << 64) == plain(t)
    monkeypatch.setattr(B, "CHUNK", 50_000)
    assert B.fingerprint(TEXTS[8]) % (1 << 64) == plain(TEXTS[8])


@pytest.mark.parametrize("radius", [2, 4])
def test_links(spark, radius):
    rng = random.Random(5)
    prints = {0}
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            prints.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    pairs = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = [(r.a, r.b) for r in B.near_links(spark.createDataFrame([(signed(f),) for f in prints], "fp long"), radius).collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= radius for a, b in links)
    ids = [signed(f) for f in prints]
    assert smallest(ids, links) == smallest(ids, [(signed(a), signed(b)) for a, b in pairs])
    with pytest.raises(ValueError):
        B.near_links(spark.createDataFrame([(1,)], "fp long"), 3)


def test_components(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [*TEXTS, *(" ".join(words[:k] + ["other"] + words[k:]) for k in range(0, 400, 40)), " ".join(words), " ".join(words)]
    rows = [(100 + 3 * i, t, "a", "b", "c", 1) for i, t in enumerate(texts)]
    rows += [rows[0], rows[5]]
    schema = "doc_id long, text string, fp string, t string, component_id string, root long"
    df = spark.createDataFrame(rows, schema)
    out = B.near_components(df).collect()
    fps = {r[0]: plain(r[1] or "") for r in rows}
    root = smallest(list(fps), [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out) == sorted((r[0], fps[r[0]], root[r[0]]) for r in rows)
    kept = B.drop_near_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(root.values())
    assert B.near_components(spark.createDataFrame([], schema)).count() == 0
    assert B.near_components(spark.createDataFrame([(None, None, "", "", "", 0)], schema)).collect()[0].component_id is None


def jaccard(a, b):
    p, q = ({" ".join(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(p & q) / len(p | q)


def test_similar_documents_are_dropped(spark):
    import corpus_pipeline
    rng = random.Random(3)
    rows, planted, unlike = [], [], []
    for k in range(240):
        words = [f"w{rng.randrange(3000)}" for _ in range(100 + k)]
        changed = list(words)
        for at in rng.sample(range(len(words)), 1 + k % 6):
            changed[at] = "other"
        a, b = " ".join(words), " ".join(changed)
        (planted if jaccard(a, b) >= 0.8 else unlike).append(1000 + k)
        rows += [(k, a), (1000 + k, b)]
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "One  two"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in corpus_pipeline.near_copies(spark, df, "").collect()]
    assert len(planted) > 150 and len(unlike) > 20
    assert sum(i not in kept for i in planted) >= 0.98 * len(planted)
    assert set(unlike) <= set(kept) and set(range(240)) <= set(kept)
    assert 5000 in kept and 5002 in kept and None in kept and not {5001, 5003} & set(kept)
    print("planted", len(planted), "dropped", sum(i not in kept for i in planted))


def test_buckets_are_measured_to_the_end(spark, monkeypatch):
    monkeypatch.setattr(B, "independent_prints", lambda t, words=5: (0, [7]))
    base = [[f"w{g}_{i}" for i in range(60)] for g in range(6)]
    rows = [(10 * k + g, " ".join([*base[g][:59], f"end{k}"])) for k in range(3) for g in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in B.drop_similar(df).collect()) == list(range(6))


def test_links_have_the_components_of_all_similar_pairs(spark, monkeypatch):
    """Also where no bucket brings a pair together, and where a chain runs over a document linked to its bucket's hub."""
    rng = random.Random(8)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(40) if g % 3 == 0 else rng.randrange(900)}" for _ in range(20 + 13 * g)]
        for k in range(10):
            rows.append((100 * k + g, " ".join(words)))
            words = list(words)
            for at in rng.sample(range(len(words)), 1 + (g + k) % 3):
                words[at] = f"new{rng.randrange(10_000)}"
    rows += [(5000, None), (5001, " "), (5002, "one two"), (5003, "ONE  two"), (5003, "one two"), (5003, rows[5][1]), (5004, "one two three"), (None, "one two"), (6, rows[0][1])]
    known = [(i, t or "") for i, t in rows if i is not None]
    same = lambda t: t.lower()
    pairs = [(i, j) for i, s in known for j, t in known if i > j and jaccard(same(s), same(t)) >= 0.8]
    want = smallest({i for i, _ in known}, pairs)
    assert any(want[i] != i and (i, want[i]) not in pairs for i in want)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for prints in (B.independent_prints, lambda t, words=5: (0, [7]), lambda t, words=5: (xxhash.xxh64_intdigest(t) >> 1, [rng.getrandbits(60)])):
        monkeypatch.setattr(B, "independent_prints", prints)
        assert smallest(want, [(r.a, r.b) for r in B.similar_links(df).collect()]) == want


def test_sketches_differ_in_no_more_than_the_sets():
    words = [f"w{i}" for i in range(300)]
    one = B.marks(" ".join(words))
    for at in range(0, 300, 30):
        words[at] = "x"
        other = B.marks(" ".join(words))
        bits = sum((int(p) ^ int(q)).bit_count() if (int(p) ^ int(q)) >= 0 else ((int(p) ^ int(q)) % (1 << 64)).bit_count() for p, q in zip(B.parity_sketch(one), B.parity_sketch(other)))
        assert 0 < bits <= len(np.setxor1d(one, other)) and len(B.parity_sketch(one)) == B.SKETCH


def test_only_links_stay_stored(spark):
    """Hashes, buckets and shingles of the search go from the shared folder once they have been read."""
    from pathlib import Path

    from rentlens.session import work_folder
    folder = Path(work_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    texts = [" ".join(f"w{g}_{i}" for i in range(60)) + f" end{k}" for g in range(6) for k in range(3)]
    kept = B.drop_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 18, 3))
    stored = [set(spark.read.parquet(str(f)).columns) for f in set(folder.iterdir()) - before if any(f.glob("*.parquet"))]
    assert stored and not any(c & {"prefix", "sketch", "kind", "value", "hub", "mark", "held"} for c in stored)
