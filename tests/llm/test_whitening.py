"""Whitening against the singular vectors of the centred rows in plain numpy."""

import math

import numpy as np
import pytest

from rentlens.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, id string, x string, v string, component int, n int, label int"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], v, "a", "b", "c", 1, 2, 3) for i, v in enumerate(vectors)], SCHEMA)


def plain(vectors, components=4):
    """vec number -> (deviation, whitened values), by the definition."""
    x = {i: [math.floor(256 * c) for c in v] for i, v in enumerate(vectors)}
    distinct = sorted(set(map(tuple, x.values())))
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[j] for v in distinct) for j in range(d)]
    centre = lambda v: np.array([(n * a - b) / n for a, b in zip(v, s)])
    rows = np.array([centre(v) for v in distinct])
    sizes, axes = np.linalg.svd(rows)[1:]
    values = sizes ** 2 / n
    out = {i: (sum((n * a - b) ** 2 for a, b in zip(v, s)), [float(centre(v) @ axes[k]) / max(math.sqrt(values[k]), 1e-300) for k in range(min(components, d))]) for i, v in x.items()}
    return n, out, [values[k] / values.sum() for k in range(min(components, d))]


def check(spark, vectors, components=4):
    n, want, explained = plain(vectors, components)
    got = W.whiten(frame(spark, vectors), components=components).collect()
    assert len(got) == len(vectors) * len(explained)
    sign = {}
    for r in got:
        k = r.component - 1
        assert r.n == n and r.deviation == (want[r.vec_id][0] if want[r.vec_id][0] < 2 ** 63 else None)
        assert r.explained == pytest.approx(explained[k], rel=1e-9) and r.identity_error < 1e-9
        theirs = want[r.vec_id][1][k]
        if abs(theirs) > 1e-3:
            sign.setdefault(k, np.sign(theirs * r.whitened))
        assert r.whitened * sign.get(k, 1) == pytest.approx(theirs, abs=1e-8)


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)) * np.linspace(3, 0.2, 12)
    vectors = [list(map(float, v)) for v in base] + [list(map(float, base[i % 5])) for i in range(200)]
    check(spark, vectors)


def test_far_from_the_origin_and_badly_conditioned(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6)) * [1e6, 1e4, 1e2, 10, 1, 1] + 1e9
    check(spark, [list(map(float, v)) for v in base], components=6)


def test_dependent_columns(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-500, 500, size=(60, 3)) / 256
    vectors = [[float(a), float(b), float(c), float(a + b), 7.0] for a, b, c in base]
    n, want, explained = plain(vectors)
    got = W.whiten(frame(spark, vectors), components=5).collect()
    live = [r for r in got if r.component <= 3]
    assert {r.whitened is None for r in got if r.component > 3} == {True} and all(r.identity_error < 1e-9 for r in got)
    by = {}
    for r in live:
        by.setdefault(r.component - 1, []).append((r.whitened, want[r.vec_id][1][r.component - 1]))
    for pairs in by.values():
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8


def test_fewer_rows_than_dimensions_and_one_row(spark):
    got = W.whiten(frame(spark, [[1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 0.0, 3.0, 4.0, 5.0]])).collect()
    assert {(r.component, None if r.whitened is None else round(abs(r.whitened), 9)) for r in got} == {(1, 1.0), (2, None), (3, None), (4, None)}
    got = W.whiten(frame(spark, [[1.0, 2.0], [1.0, 2.0]])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)] * 2


def test_rows_that_are_dropped(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, -0.0], None, [nan, 1.0], [inf, 1.0], [None, 1.0], [], [1.0, 2.0, 3.0], [1e300, 0.0], [0.5, 2.0], [0.25, 7.0]]
    out = W.whiten(frame(spark, vectors, [0, 1, 2, 3, 4, 5, 6, 7, None, 0]))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted((str(r.vec_id), r.component, r.n) for r in out.collect()) == sorted([("0", 1, 3), ("0", 2, 3)] * 2 + [("None", 1, 3), ("None", 2, 3)])
    assert W.whiten(frame(spark, [])).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    got = W.whiten(frame(spark, [[1e15, 0.0], [0.0, 3.0]])).collect()
    assert {r.deviation for r in got} == {None} and all(abs(abs(r.whitened) - 1) < 1e-9 for r in got if r.component == 1)


def test_solve_and_shift():
    rng = np.random.default_rng(1)
    r, y = np.triu(rng.normal(size=(5, 5))) + 4 * np.eye(5), rng.normal(size=(7, 5))
    assert np.allclose(W._solve(r, y) @ r, y)
    g = np.ones((3, 3))
    assert np.abs(W.shifted_upper(g, 10).T @ W.shifted_upper(g, 10) - g).max() < 1e-10 and (W.shifted_upper(0 * g, 10) == np.eye(3)).all()
