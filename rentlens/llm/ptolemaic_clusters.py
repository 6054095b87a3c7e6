"""Centroid clustering: Ptolemy's inequality over fixed pivot pairs rules centroids out, survivors are measured exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rentlens.llm.shared import summed
from rentlens.session import cut_lineage

CLUSTERS, ROUNDS, SIZE, SCALE = 8, 10, 64, 1024.0
#: Pivots, taken from the first centroids; every pair of them gives a bound.
PIVOTS = 4
#: Components from LIMIT on would leave a long and count as not finite. Below SMALL all distances are exact in longs.
LIMIT, SMALL = 2.0 ** 51, 1 << 27
ROWS = 4096
LONG = 1 << 63
#: Relative slack of a computed bound, far above the rounding of the few operations behind it.
SLACK = 2.0 ** -44


def grid(df: DataFrame, id_col: str, vector_col: str, size: int, scale: float) -> DataFrame:
    """``id, x`` of the rows whose vector has ``size`` finite components; ``x`` counts whole steps of 1 / scale."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LIMIT)))
    return rows.where(F.col("v").isNotNull() & (F.size("v") == size) & finite).select(
        "id", F.transform("v", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("x"))


def _in_longs(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether no squared distance between the two sets of rows can leave a long."""
    return x.shape[1] <= SIZE and max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0))) <= SMALL


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one point: longs where they surely hold, else Python integers."""
    if _in_longs(x, c):
        gap = x - c
        return np.einsum("ij,ij->i", gap, gap)
    gap = x.astype(object) - c.astype(object)
    return (gap * gap).sum(1)


@dataclass(frozen=True)
class Pivots:
    """Points fixed for all rounds and the pairs of them, with the distance of each pair."""
    points: np.ndarray
    pairs: tuple[tuple[int, int, float], ...]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.sqrt(squared(x, p).astype(np.float64)) for p in self.points], 1)

    def bound(self, rows: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        """A squared distance that each row surely has at least to the centroid, from pivot distances alone:
        |xp * cq - xq * cp| <= xc * pq for any two pivots p, q (Ptolemy)."""
        best = np.zeros(len(rows))
        for i, j, apart in self.pairs:
            left, right = rows[:, i] * centroid[j], rows[:, j] * centroid[i]
            best = np.maximum(best, (np.abs(left - right) - (left + right) * SLACK) / apart)
        return best * best * (1 - SLACK)


def choose_pivots(points: np.ndarray, count: int = PIVOTS) -> Pivots:
    """Farthest points first, from point 0 on. Points that coincide with one already chosen are left out."""
    chosen = [0]
    while len(chosen) < min(count, len(points)):
        near = np.min([squared(points, points[i]).astype(np.float64) for i in chosen], axis=0)
        if near.max() == 0:
            break
        chosen.append(int(near.argmax()))
    fixed = points[chosen]
    apart = Pivots(fixed, ()).distances(fixed)
    return Pivots(fixed, tuple((i, j, float(apart[i, j])) for i in range(len(fixed)) for j in range(i + 1, len(fixed))))


def assign(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances were measured.

    Each row is measured against the centroid of its least bound first; then, centroid by centroid, only the rows whose
    bound does not exceed their best so far.
    """
    near = pivots.distances(centroids)
    bounds = np.stack([pivots.bound(cached, c) for c in near], 1)
    best_at = bounds.argmin(1)
    best = np.empty(len(x), np.int64 if _in_longs(x, centroids) else object)
    measured = len(x)
    for k in range(len(centroids)):
        mine = np.flatnonzero(best_at == k)
        best[mine] = squared(x[mine], centroids[k])
    first = best_at.copy()
    for k in range(len(centroids)):
        open_ = np.flatnonzero((first != k) & (bounds[:, k] <= best.astype(np.float64) * (1 + SLACK)))
        if len(open_):
            gap = squared(x[open_], centroids[k])
            measured += len(open_)
            better = (gap < best[open_]) | ((gap == best[open_]) & (k < best_at[open_]))
            at = open_[better.astype(bool)]
            best[at], best_at[at] = gap[better.astype(bool)], k
    return best_at, best, measured


def _seeds(rows: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors of the smallest hashes of their ids; equal ids by their components. A null id counts as empty."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first: list[Row] = rows.select(key.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    return np.array([r["x"] for r in first], np.int64)


def _cells(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        flat = lambda c: part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
        yield part, flat("x").reshape(-1, size), flat("near")


def fit(rows: DataFrame, centroids: np.ndarray, pivots: Pivots, rounds: int) -> np.ndarray:
    """The centroids after all rounds over the stored table ``id, x, near``. A round is one pass: tasks add up counts
    and sums of their rows, in halves of 31 bits so that longs hold them; empty centroids stay."""
    size = centroids.shape[1]
    for _ in range(rounds):
        now = centroids

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            for b in batches:
                for _, x, near in _cells(b, size):
                    at, _, _ = assign(x, near, now, pivots)
                    out = np.zeros((len(now), 1 + 2 * size), np.int64)
                    for k in range(len(now)):
                        mine = x[at == k]
                        out[k] = np.concatenate([[len(mine)], (mine >> 31).sum(0), (mine & (2 ** 31 - 1)).sum(0)])
                    yield out

        totals = summed(rows, measure, np.int64).reshape(len(centroids), -1)
        centroids = np.array([
            [((h << 31) + l) // t[0] for h, l in zip(t[1:size + 1], t[size + 1:])] if t[0] else now[k].tolist()
            for k, t in enumerate(totals.tolist())], np.int64)
        if (centroids == now).all():
            break
    return centroids


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, clusters: int = CLUSTERS, rounds: int = ROUNDS,
            size: int = SIZE, scale: float = SCALE, salt: str = "3:") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept row.

    Distances of each row to a few fixed pivots are stored once beside its integers; each round bounds the distance to
    every centroid from them and measures only centroids that the bounds leave open, so the result is that of measuring
    all. Rows whose vector is null, of another size, or holds null or non-finite components are dropped (components
    from 2 ** 51 on too: no long holds their steps). Repeated rows count as often as they stand; ids may be null, text
    or repeated; other columns are ignored. Fewer rows than clusters give fewer clusters, an empty table an empty
    result. ``distance`` and the sums are null where a long cannot hold them. Once a round moves no centroid, the
    rounds left could not either and are not run. Only centroids and sums reach the driver.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance long"
    rows = grid(df, id_col, vector_col, size, scale)
    start = _seeds(rows, clusters, salt)
    if not len(start):
        empty = spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
        return empty.withColumnRenamed("id", id_col)
    pivots = choose_pivots(start)

    def cache(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                near = pivots.distances(part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                ends = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("x"), pa.ListArray.from_arrays(ends, pa.array(near.ravel()))],
                                                 names=["id", "x", "near"])

    stored = cut_lineage(rows.mapInArrow(cache, f"id {kind}, x array<long>, near array<double>"))
    final = fit(stored, start, pivots, rounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x, near in _cells(b, size):
                at, best, _ = assign(x, near, final, pivots)
                distance = [v if v < LONG else None for v in best.tolist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(at.astype(np.int32)), pa.array(distance, pa.int64())],
                                                 names=["id", "cluster", "distance"])

    placed = cut_lineage(stored.mapInArrow(place, schema))
    # one row for each cluster: a table of at most ``clusters`` rows
    inertia = {r["cluster"]: r["s"] for r in placed.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("s")).collect()}
    total = None if None in inertia.values() else sum(int(v) for v in inertia.values())
    fits = lambda v: None if v is None or v >= LONG else int(v)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final.tolist()]
    pick = lambda values, t: F.element_at(F.array(*[F.lit(v).cast(t) for v in values]), F.col("cluster") + 1)
    return placed.select(
        F.col("id").alias(id_col), "cluster", "distance", pick([fits(inertia.get(k)) for k in range(len(final))], "long").alias("cluster_inertia"),
        F.lit(fits(total)).cast("long").alias("inertia"), pick(names, "string").alias("centroid_sha256"))
