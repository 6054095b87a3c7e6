"""Embedding whitening by shifted CholeskyQR: Gram passes and triangular solves over the rows, then an SVD of R."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.llm.shared import summed
from rentlens.session import cut_lineage

#: Steps of an entry of one; entries from LIMIT on would leave a long and count as not finite.
SCALE, LIMIT = 256.0, 2.0 ** 54
#: Rounds of orthogonalisation; the first is always shifted.
PASSES = 3
#: Rows a task takes at a time.
ROWS = 4096
LONG = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums``; a row of ``vectors`` for each component, by falling ``values``
    (population variances). Components without variance have the value 0."""
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows of whitened values, NaN for components without variance."""
        scale = np.where(self.values > 0, np.sqrt(self.values), np.nan)
        return centred(x, self.n, self.sums) @ self.vectors.T / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of ``(n * x - sums) ** 2`` of each row; null where a long cannot hold it."""
        largest = self.n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in self.sums)
        if largest ** 2 * x.shape[1] < LONG:
            gap = self.n * x - np.array(self.sums, np.int64)
            return (gap * gap).sum(1).tolist()
        exact = ((np.array(row, object) * self.n - np.array(self.sums, object)) for row in x.tolist())
        return [v if v < LONG else None for v in (int((gap * gap).sum()) for gap in exact)]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - sums / n``: the whole part of the mean is taken off exactly, only its fraction is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([s % n / n for s in sums])
    return (x - whole).astype(np.float64) - part


def grid(df: DataFrame, id_col: str, vector_col: str, scale: float = SCALE) -> DataFrame:
    """``id, x`` of the rows whose vector is not null and has finite entries only; ``x`` counts whole steps of 1 / scale."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LIMIT)))
    return rows.where(F.col("v").isNotNull() & finite).select("id", F.transform("v", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("x"))


def _chunks(batches: Iterator[pa.RecordBatch], d: int, column: str = "x") -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.column(column).slice(at, ROWS).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _solve(r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``y @ inv(r)`` for an upper triangular ``r``, column by column from the left."""
    out = np.empty_like(y)
    for j in range(r.shape[0]):
        out[:, j] = (y[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _gram(fit: DataFrame, d: int, rows: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x in _chunks(batches, d):
            y = rows(x)
            yield y.T @ y
    return summed(fit, measure, np.float64).reshape(width, width)


def _upper(g: np.ndarray) -> np.ndarray:
    return np.linalg.cholesky(g).T


def shifted_upper(g: np.ndarray, n: int) -> np.ndarray:
    """The Cholesky factor of the Gram matrix plus a shift above its rounding error (Fukaya et al. 2020), so that it
    exists whatever the condition; a matrix of zeros has the factor one."""
    d, top = len(g), float(np.linalg.eigvalsh(g)[-1])
    if top <= 0:
        return np.eye(d)
    return _upper(g + min(11 * (n * d + d * (d + 1)) * 2.0 ** -53, 0.01) * top * np.eye(d))


def _root(g: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(g)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def fit_whitening(x: DataFrame, d: int, components: int, passes: int = PASSES) -> Whitening | None:
    """Fits on ``x``, a stored table of distinct vectors of size ``d``; none if it is empty.

    Each pass reads the rows, centres them, applies the triangular solves found so far, and sums the Gram matrix, d
    by d numbers a task, in two steps; its factor joins the composed R, so that rows = Q R holds at any time. The
    first factor is shifted, later ones where the plain factor does not exist (linearly dependent columns). The last
    Gram matrix enters with its Cholesky factor, or with its symmetric root if columns are dependent; either way
    R'R is the Gram matrix of the centred rows, to the precision of rows of condition one and not of its square.
    """
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in _chunks(batches, d):
            yield np.concatenate([[len(part)], (part >> 31).sum(0), (part & (2 ** 31 - 1)).sum(0)])
    totals = summed(x, measure, np.int64)
    if not len(totals):
        return None
    n, high, low = int(totals[0]), totals[1:d + 1].tolist(), totals[d + 1:].tolist()
    sums = tuple((h << 31) + l for h, l in zip(high, low))
    factors: list[np.ndarray] = []

    def rows(part: np.ndarray) -> np.ndarray:
        y = centred(part, n, sums)
        for r in factors:
            y = _solve(r, y)
        return y

    composed = np.eye(d)
    for k in range(passes):
        g = _gram(x, d, rows, d)
        last = k == passes - 1
        try:
            r = shifted_upper(g, n) if k == 0 and not last else _upper(g)
        except np.linalg.LinAlgError:
            r = _root(g) if last else shifted_upper(g, n)
        composed = r @ composed
        factors = [*factors, r]
    _, sizes, vectors = np.linalg.svd(composed)
    sizes = np.where(sizes > sizes[0] * d * 2.0 ** -50, sizes, 0.0)
    variances = sizes ** 2 / n
    total = variances.sum()
    heaviest = np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1)
    vectors = vectors * np.where(heaviest < 0, -1.0, 1.0)
    k = min(components, d)
    return Whitening(n, sums, variances[:k], vectors[:k], variances[:k] / total if total > 0 else np.zeros(k))


def identity_error(x: DataFrame, d: int, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit rows' covariance minus one, over components with variance."""
    live = model.values > 0
    if not live.any():
        return 0.0
    width = int(live.sum())
    g = _gram(x, d, lambda part: model.whiten(part)[:, live], width)
    return float(np.abs(g / model.n - np.eye(width)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = 4, scale: float = SCALE) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` for each kept row and component.

    Rows with a null vector, or with null or non-finite entries, are dropped; so are empty vectors and vectors of
    another size than most (of two sizes equally frequent, the larger one stays), since they share no covariance.
    Repeated rows count once in the fit and are all returned; ids may be null or repeated; other columns are
    ignored. ``whitened`` is null where a component has no variance, ``deviation`` where a long cannot hold it. An
    empty table gives an empty result. Only sums and d by d matrices reach the driver.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = grid(df, id_col, vector_col, scale)
    sizes = rows.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"id {kind}, component int, deviation long, whitened double, explained double"
    if sizes is None:
        out, n, error = spark.createDataFrame([], schema), 0, 0.0
    else:
        d = sizes["d"]
        rows = rows.where(F.size("x") == d)
        fit = cut_lineage(rows.select("x").distinct())
        model = fit_whitening(fit, d, components)
        n, error, k = model.n, identity_error(fit, d, model), len(model.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    w = model.whiten(x).ravel()
                    again = np.repeat(np.arange(len(x)), k)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                         pa.array(model.deviations(x), pa.int64()).take(pa.array(again)), pa.array(w, mask=np.isnan(w)),
                         pa.array(np.tile(model.explained, len(x)))], names=["id", "component", "deviation", "whitened", "explained"])

        out = rows.mapInArrow(run, schema)
    return out.select(F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
                      F.lit(error).alias("identity_error"))
