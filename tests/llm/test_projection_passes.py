"""Embedding links against all pairs."""

import numpy as np
import pytest

from rentlens.llm import projection_passes as P

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, size int, leader string"


def truth(rows, threshold=P.THRESHOLD):
    good = {i: (np.array(v, float), lab) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = {i: set() for i, _, _ in rows}
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            (x, p), (y, q) = good[a], good[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a].add(b), links[b].add(a)
    root = {}
    for start in sorted(i for i in links if i is not None):
        todo = [start] if start not in root else []
        while todo:
            i = todo.pop()
            if i not in root:
                root[i] = start
                todo += links[i]
    return {i: len(x) for i, x in links.items()}, root


def near(rng, x, cos):
    y = rng.normal(size=len(x))
    y -= (y @ x) / (x @ x) * x
    return cos * x / np.linalg.norm(x) + np.sqrt(1 - cos * cos) * y / np.linalg.norm(y)


def run(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "a", "b", 1, "c") for i, v, lab in rows], SCHEMA)
    return df, {r.vec_id: (r.n_links, r.component_id) for r in P.near_links(df).collect()}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows, n = [], 0

    def add(v, label):
        nonlocal n
        n += 7
        rows.append((n, list(np.float32(v)), label))
    for _ in range(400):
        add(rng.normal(size=32), int(rng.integers(0, 3)))
    hub = rng.normal(size=32)
    for _ in range(300):  # a dense group, a group of copies, a wide group, chains and pairs
        add(near(rng, hub, rng.uniform(0.985, 0.999)), 1)
    copy = rng.normal(size=32)
    for k in range(150):
        add(copy * (1 + k % 3), 2)
    wide = rng.normal(size=32)
    for _ in range(60):
        add(near(rng, wide, rng.uniform(0.95, 0.99)), 0)
    for _ in range(40):
        x = rng.normal(size=32)
        add(x, 1)
        add(near(rng, x, 0.95), 1)
        add(near(rng, x, 0.95), 2)
    links, root = truth(rows)
    _, got = run(spark, rows)
    assert set(got) == set(links)
    assert all(got[i][0] <= links[i] for i in got)
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(links.values())
    assert sum(got[i][1] != root[i] for i in got) <= 0.01 * len(got)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0], 5), (2, [2, 0], 5), (3, [1, 0], 6), (4, [1, 0], None), (5, None, 5), (6, [0, 0], 5), (7, [nan, 1], 5), (8, [inf, 1], 5), (9, [1, None], 5),
            (10, [1, 0, 0], 5), (11, [], 5), (12, [1e30, 0], 5), (13, [1e-30, 0], 5), (14, [0, 1], 5)]
    links, root = truth(rows)
    df, got = run(spark, rows)
    assert {i: g[0] for i, g in got.items()} == links and {i: g[1] for i, g in got.items()} == root
    assert P.near_links(df.limit(0)).count() == 0
    twice = P.near_links(df.where("vec_id in (1, 2)").unionAll(df.where("vec_id = 1"))).collect()
    assert sorted(tuple(r) for r in twice) == [(1, 1, 1), (1, 1, 1), (2, 1, 1)]


def test_blocks_lose_no_neighbour(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 100)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=8)], 0, 8) for i in range(1000)], "id long, v array<double>, label int, dim int")
    rows = P._blocks(df, [3]).select("rank", "block").collect()
    assert sorted(r["rank"] for r in rows if r["rank"] // 100 == r["block"]) == list(range(1000))
    guests = {(r["rank"], r["block"]) for r in rows if r["rank"] // 100 != r["block"]}
    assert guests == {(k, k // 100 - 1) for k in range(100, 1000) if k % 100 < P.WINDOW}


@pytest.mark.parametrize("members", [512, 3])
def test_open_pairs_are_measured(spark, members, monkeypatch):
    monkeypatch.setattr(P, "MEMBERS", members)
    rng = np.random.default_rng(5)
    hub = rng.normal(size=16)
    rows = [(i, list(near(rng, hub, rng.uniform(0.94, 0.97))), 0) for i in range(40)]
    links, root = truth(rows)
    _, got = run(spark, rows)
    assert {i: g[0] for i, g in got.items()} == links and {i: g[1] for i, g in got.items()} == root


def spread(rng, n, dim, label, start):
    """A wide group too loose to be thinned, all pairs of which link, beside rows that link with little."""
    hub = rng.normal(size=dim)
    rows = [near(rng, hub, 0.976) for _ in range(n)] + [near(rng, rng.normal(size=dim), 0.9) for _ in range(n // 4)]
    return [(start + i, [float(c) for c in np.float32(v)], label) for i, v in enumerate(rows)]


@pytest.mark.parametrize("n", [400, 2600])
def test_wide_groups_are_counted_whole(spark, n):
    rows = spread(np.random.default_rng(n), n, 64, 0, 1)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= P.THRESHOLD).sum(1) - 1
    assert links.max() >= 0.99 * n
    _, got = run(spark, rows)
    assert [got[i][0] for i, _, _ in rows] == list(links)


@pytest.mark.parametrize("cell", [5, 40])
def test_blocks_lose_no_link(spark, cell, monkeypatch):
    monkeypatch.setattr(P, "CELL", cell)
    monkeypatch.setattr(P, "ASSIGN", 50)
    monkeypatch.setattr(P, "PIVOTS", 4)
    rng = np.random.default_rng(cell)
    rows = spread(rng, 60, 16, 0, 1)
    for k in range(12):  # chains whose ends lie far apart, and classes with members
        x = rng.normal(size=16)
        for j in range(12):
            rows.append((1000 + 20 * k + j, list(x), k % 2))
            x = near(rng, x, 0.995 if j % 3 else 0.935)
    links, root = truth(rows)
    _, got = run(spark, rows)
    assert {i: g[0] for i, g in got.items()} == links and {i: g[1] for i, g in got.items()} == root


def test_forest():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (50, 20), (300, 280), (300, 900)):
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(i, j):
                want[a] = want[b] = min(want[a], want[b])
        assert list(P._forest(i, j, n)) == want


def test_extreme_doubles_link_like_any_other(spark):
    rows = [(0, [1e200, 0.0], 1), (1, [2e200, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1e-200, 1e-201], 1), (4, [1e-200, 1e-201], 1), (5, [0.0, 1e-320], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in P.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (4, 0) for i in range(5)} | {5: (0, 5)}


def test_rounds_of_groups_lose_no_link_and_copy_blocks_less(spark, monkeypatch):
    for name, value in (("CELL", 5), ("ASSIGN", 50), ("PIVOTS", 4), ("GROUPS", 3), ("ONE_ROUND", 4)):
        monkeypatch.setattr(P, name, value)
    copies, drop = [], P.drop_stored
    monkeypatch.setattr(P, "drop_stored", lambda *tables: (copies.extend(t.select("block").collect() for t in tables if "partners" in t.columns), drop(*tables)))
    rows = spread(np.random.default_rng(9), 80, 16, 0, 1)
    links, root = truth(rows)
    _, got = run(spark, rows)
    assert {i: g[0] for i, g in got.items()} == links and {i: g[1] for i, g in got.items()} == root
    moved = [r.block for some in copies for r in some]
    # a block meets groups, of which there are three, not each of the other blocks
    assert len(set(moved)) > 12 and max(moved.count(b) for b in set(moved)) <= 3


def test_vectors_stay_floats_and_are_not_kept_in_steps(spark, monkeypatch):
    seen, stored = [], P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: seen.append(stored(df)) or seen[-1])
    rows = spread(np.random.default_rng(3), 60, 16, 0, 1) + [(500 + i, [1.0] * 15 + [i / 100], 0) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    P.near_links(df).collect()
    kept = [t for t in seen if {"v", "w"} & set(t.columns)]
    assert kept and all(t.schema["v"].dataType.simpleString() == "array<float>" for t in kept)
    left = 0
    for t in kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._jdf.inputFiles()[0]).getParent()
        left += path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert left <= 3
