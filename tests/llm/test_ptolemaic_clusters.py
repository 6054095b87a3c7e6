"""Centroid clustering against the plain rounds in whole numbers."""

import hashlib
import math

import numpy as np

from rentlens.llm import ptolemaic_clusters as C

SCHEMA = "vec_id long, embedding array<double>, id string, x string, near string, cluster int, distance int, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", 1, 2, 3) for i, v in rows], SCHEMA)


def plain(rows, clusters=8, rounds=10, scale=1024):
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    order = sorted(x, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in x:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[k]) for col in zip(*groups[k])] if k in groups else c for k, c in enumerate(centroids)]
    placed = [(i, *near(v)[::-1]) for i, v in x]
    inertia = {}
    for _, k, g in placed:
        inertia[k] = inertia.get(k, 0) + g
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, g, inertia[k], sum(inertia.values()), names[k]) for i, k, g in placed), key=str)


def run(spark, rows, **options):
    return sorted((tuple(r) for r in C.cluster(frame(spark, rows), **options).collect()), key=str)


def floats(a):
    return [list(map(float, v)) for v in a]


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(8)
    middle = rng.normal(size=(5, 64))
    rows = list(enumerate(floats(middle[rng.integers(0, 5, 500)] + 0.4 * rng.normal(size=(500, 64)))))
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, clusters=3, rounds=2) == plain(rows, 3, 2)


def test_ties_repeats_and_few_rows(spark):
    grid = [[float(a), float(b)] + [0.0] * 62 for a in (0, 1, 2) for b in (0, 1, 2)]
    rows = [(i, grid[i % 9]) for i in range(60)] + [(None, grid[0]), (None, grid[1]), (3, grid[4])]
    assert run(spark, rows, scale=1.0) == plain(rows, scale=1)
    assert run(spark, rows[:3]) == plain(rows[:3])
    same = [(i, grid[4]) for i in range(20)]
    assert run(spark, same) == plain(same)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate([[float(v)] + [0.25] * 63 for v in rng.integers(-1_500_000, 1_500_000, 80)]))
    assert run(spark, rows) == plain(rows)
    far = [(0, [1e15] * 64), (1, [-1e15] * 64), (2, [0.0] * 64)]
    got = run(spark, far, clusters=1, rounds=0)
    assert {r[2] for r in got if r[2]} == set() and {r[4] for r in got} == {None}


def test_rows_that_are_dropped(spark):
    good, nan = [0.5] * 64, float("nan")
    rows = [(1, good), (2, None), (3, []), (4, [1.0] * 63), (5, [1.0] * 65), (6, [None] + good[1:]), (7, [nan] + good[1:]), (8, [float("inf")] + good[1:]), (9, [1e300] + good[1:])]
    assert run(spark, rows) == plain(rows[:1])
    out = C.cluster(frame(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(1)
    middle = rng.integers(-3000, 3000, (8, 64))
    x = middle[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 64))
    pivots = C.choose_pivots(middle)
    cached, near = pivots.distances(x), pivots.distances(middle)
    for k, c in enumerate(middle):
        assert (pivots.bound(cached, near[k]) <= C.squared(x, c)).all()
    at, best, measured = C.assign(x, cached, middle, pivots)
    gaps = np.stack([C.squared(x, c) for c in middle], 1)
    assert (at == gaps.argmin(1)).all() and (best == gaps.min(1)).all() and measured < 0.5 * gaps.size
