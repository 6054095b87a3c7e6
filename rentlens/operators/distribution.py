"""Exact order statistics per group without collecting a group in one task.

Values are filed under buckets that grow with the value (about 0.1 % wide), the
buckets are counted with map-side aggregation, and only the buckets that hold a
wanted rank are looked at value by value. Where such a bucket still holds more rows
than one task should sort, the rows of the wanted buckets are filed again under
equal parts of them, until none does. Window groups are bounded by the number of
buckets or parts, or by that many rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.session import cut_lineage

RESOLUTION = 1024
#: Rows of one bucket that are sorted in one task.
OPEN_ROWS = 1_000_000
PARTS = 1024
#: Parts of parts: a bucket spans less than 2^43 doubles, so no more rounds are ever needed.
ROUNDS = 4
MAX_DOUBLE = 1.7976931348623157e308
#: More than RESOLUTION times the logarithm of any double, in either direction.
LOWEST = 1 << 20


def bucket_of(value: Column) -> Column:
    """A number that never falls when the value rises, 0 for zero alone.

    Buckets are equally wide relative to the value at every magnitude, shares and
    rates as well as amounts. Infinities and NaN have buckets of their own.
    """
    step = F.floor(F.ln(F.least(F.abs(value), F.lit(MAX_DOUBLE))) * RESOLUTION) + LOWEST
    step = F.when(F.abs(value) > MAX_DOUBLE, 2 * LOWEST).otherwise(step)
    return F.when(F.isnan(value), 3 * LOWEST).when(value == 0, 0).when(value < 0, -step).otherwise(step)


def _with_ranks(hist: DataFrame, inside: Sequence[str], total: Column, start: Column, probs: dict[str, float]) -> DataFrame:
    """The buckets of a histogram that hold a wanted rank, with the ranks and the count of rows below them."""
    part = Window.partitionBy(*(inside or [F.lit(0)]))
    upto = start + F.sum("_n").over(part.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    hist = hist.withColumns({"_total": total, "_upto": upto}).withColumn("_below", F.col("_upto") - F.col("_n"))
    # Wanted ranks (0-based): floor and ceiling of p * (n - 1).
    wanted = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor((F.col("_total") - 1) * F.lit(p)), F.ceil((F.col("_total") - 1) * F.lit(p)))
        for p in probs.values()
    ])))
    here = F.filter(wanted, lambda r: (r >= F.col("_below")) & (r < F.col("_upto")))
    return hist.withColumn("_ranks", here).where(F.size("_ranks") > 0).drop("_upto")


def _counted_buckets(rows: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *more)


def _wanted_buckets(rows: DataFrame, groups: Sequence[str], probs: dict[str, float], open_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (groups, _b, _v, _c) and the buckets (groups, _b) that hold wanted ranks, each of at most ``open_rows`` rows
    or one value."""
    on = [*groups, "_b"]
    every = Window.partitionBy(*(groups or [F.lit(0)]))
    hits = cut_lineage(_with_ranks(_counted_buckets(rows, on).withColumn("_k", F.col("_b")), groups, F.sum("_n").over(every), F.lit(0), probs))
    for _ in range(ROUNDS):
        if not hits.where((F.col("_rows") > open_rows) & (F.col("_lo") < F.col("_hi"))).head(1):
            break
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS
        part = F.when(F.col("_lo") < F.col("_hi"), F.least(F.floor(share), F.lit(PARTS - 1))).otherwise(0)
        parts = rows.join(hits.select(*on, "_total", "_below", "_lo", "_hi"), on).withColumn("_k", part)
        parts = cut_lineage(parts.select(*on, "_k", "_v", "_c", "_total", F.col("_below").alias("_start")))
        first = lambda c: F.first(c).alias(c)
        hist = _counted_buckets(parts, [*on, "_k"], first("_total"), first("_start"))
        finer = (F.col("_b") * PARTS + F.col("_k")).alias("_b")
        hits = _with_ranks(hist, on, F.col("_total"), F.col("_start"), probs)
        hits = cut_lineage(hits.select(*groups, finer, "_n", "_rows", "_lo", "_hi", "_total", "_below", "_ranks"))
        rows = parts.select(*groups, finer, "_v", "_c")
    return rows, hits


def exact_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float], weight: str | None = None, open_rows: int = OPEN_ROWS,
) -> DataFrame:
    """Linear-interpolated percentiles: one row per group with a column per name.

    ``weight`` names a count column when the input is already counted by value.
    Null values are left out. Buckets of more than ``open_rows`` rows are split before
    they are sorted; the result does not depend on it.
    """
    w = F.col(weight) if weight else F.lit(1)
    rows = df.where(F.col(value).isNotNull()).select(
        *groups, F.col(value).cast("double").alias("_v"), w.cast("long").alias("_c")
    ).withColumn("_b", bucket_of(F.col("_v")))
    rows, hits = _wanted_buckets(rows, groups, probs, open_rows)
    on = [*groups, "_b"]
    counted = rows.groupBy(*on, "_v").agg(F.sum("_c").alias("_n"))
    picked = counted.join(hits.select(*on, "_below", "_total", "_ranks"), on)
    inside = Window.partitionBy(*on).orderBy("_v")
    picked = picked.withColumn(
        "_upto", F.col("_below") + F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_rank", F.explode(
        F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))))
    cols = {}
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(p)
        cols[f"_{name}_lo"] = F.max(F.when(F.col("_rank") == F.floor(at), F.col("_v")))
        cols[f"_{name}_hi"] = F.max(F.when(F.col("_rank") == F.ceil(at), F.col("_v")))
    stats = picked.groupBy(*groups).agg(
        F.max("_total").alias("_total"), *[c.alias(n) for n, c in cols.items()])
    out = {}
    for name, p in probs.items():
        at = (F.col("_total") - 1) * F.lit(p)
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out[name] = lo + (hi - lo) * (at - F.floor(at))
    return stats.select(*groups, *[c.alias(n) for n, c in out.items()])


def top_value(df: DataFrame, groups: Sequence[str], value: str, weight: Column | None = None,
              out: str | None = None) -> DataFrame:
    """Most frequent value per group, ties to the smallest value.

    Counting by (group, value) first keeps a hot group spread over all tasks; the
    choice itself is an aggregate with map-side combine, not a sorted window.
    """
    n = F.sum(weight) if weight is not None else F.count("*")
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.alias("_n"))
    return counted.groupBy(*groups).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("m"),
        F.count("*").alias("distinct_values"),
    ).select(*groups, F.col("m.v").alias(out or value), "distinct_values")
