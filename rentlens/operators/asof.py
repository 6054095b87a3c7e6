"""Point-in-time lookups of slowly published series.

A series is turned into a table that can be joined on equality, so the contract
side is never ranked, exploded or compared with every publication:

* date series: intervals [valid_from, valid_to) filed under each month they
  touch; the join is on the month (and keys) with a cheap date test on top;
* month series: one row per month with the newest known value carried forward.

A contract newer than the series is looked up in the last month of the series,
whose rows stay valid for good. The series side is left to Spark's own size
check (auto broadcast and adaptive execution): small series are broadcast, large
ones are shuffled on month and keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.functions import text as T


def date_intervals(series: DataFrame, date_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds valid_from and valid_to (null for the newest row) to a date series.

    A series holds one row per key and date, so one window group is as long as
    the publication calendar, whatever the number of contracts.
    """
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(date_col)
    return series.withColumns({"valid_from": F.col(date_col), "valid_to": F.lead(date_col).over(w)})


def asof_date_join(
    left: DataFrame, left_date: str, series: DataFrame, date_col: str,
    values: Sequence[str], keys: Sequence[str] = (),
) -> DataFrame:
    """Left join of the newest series row whose date is not after the left date."""
    spans = date_intervals(series.select(*keys, date_col, *[v for v in values if v != date_col]), date_col, keys)
    first = T.date_month_index(F.col("valid_from"))
    last = F.coalesce(T.date_month_index(F.col("valid_to")), first)
    filed = spans.withColumn("_month", F.explode(F.sequence(first, last)))
    right = filed.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_month",
        F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"),
        *[F.col(v).alias(f"_v_{v}") for v in values],
    )
    # The newest month of each key holds that key's open interval.
    if keys:
        newest = series.groupBy(*[F.col(k).alias(f"_n_{k}") for k in keys]).agg(
            F.max(T.date_month_index(F.col(date_col))).alias("_newest"))
        on = [F.col(k) == F.col(f"_n_{k}") for k in keys]
        probe = left.join(newest, on, "left").drop(*[f"_n_{k}" for k in keys])
        top = F.col("_newest")
    else:
        probe, top = left, series.select(F.max(T.date_month_index(F.col(date_col)))).scalar()
    probe = probe.withColumn("_probe", F.least(T.date_month_index(F.col(left_date)), top))
    cond = [F.col("_probe") == F.col("_month"), F.col(left_date) >= F.col("_from"),
            F.col("_to").isNull() | (F.col(left_date) < F.col("_to"))]
    cond += [F.col(k) == F.col(f"_k_{k}") for k in keys]
    joined = probe.join(right, cond, "left")
    taken = {v: F.col(f"_v_{v}") for v in values}
    drop = ["_probe", "_month", "_from", "_to", "_newest", *[f"_k_{k}" for k in keys], *[f"_v_{v}" for v in values]]
    return joined.withColumns(taken).drop(*drop)


def carried_forward(
    series: DataFrame, month_col: str, values: Sequence[str], keys: Sequence[str] = (), mark: str | None = None,
) -> DataFrame:
    """One row per key and month from the key's first month up to the newest month of
    the whole series, each value being the newest non-null one so far.

    ``mark`` names a column that receives the month a row's values come from.
    Grows with keys x months of the calendar, never with contracts.
    """
    idx = T.month_index(F.col(month_col))
    top = series.select(F.max(idx)).scalar()
    by_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_month")
    base = series.select(*keys, idx.alias("_month"), F.col(month_col).alias("_label"), *values)
    spans = base.withColumn("_next", F.lead("_month").over(by_key))
    until = F.coalesce(F.col("_next") - 1, F.greatest(top, F.col("_month")))
    filled = {v: F.last(v, ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0)) for v in values}
    dense = spans.withColumns(filled).withColumn("_month", F.explode(F.sequence(F.col("_month"), until)))
    label = [F.col("_label").alias(mark)] if mark else []
    return dense.select(*keys, F.col("_month"), *label, *values)


def asof_month_join(
    left: DataFrame, left_month: Column, series: DataFrame, month_col: str, values: Sequence[str],
    keys: Sequence[tuple[Column, str]] = (), mark: str | None = None, prefix: str = "",
) -> DataFrame:
    """Left join of the newest values whose month is not after the left month.

    ``keys`` pairs a left column expression with a series column.
    """
    names = [name for _, name in keys]
    dense = carried_forward(series, month_col, values, names, mark)
    top = series.select(F.max(T.month_index(F.col(month_col)))).scalar()
    out = ([mark] if mark else []) + list(values)
    right = dense.select(
        *[F.col(n).alias(f"_k_{n}") for n in names], "_month", *[F.col(v).alias(f"{prefix}{v}") for v in out]
    )
    probe = left.withColumns(
        {"_probe": F.least(T.month_index(left_month), top), **{f"_p_{n}": c for c, n in keys}}
    )
    cond = [F.col("_probe") == F.col("_month")] + [F.col(f"_p_{n}") == F.col(f"_k_{n}") for n in names]
    helper = ["_probe", "_month", *[f"_k_{n}" for n in names], *[f"_p_{n}" for n in names]]
    return probe.join(right, cond, "left").drop(*helper)


def pivot_series(series: DataFrame, month_col: str, name_col: str, value_col: str,
                 features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long series (key, month, feature, value) to one row per key and month."""
    return series.groupBy(*keys, month_col).pivot(name_col, list(features)).agg(F.first(value_col))


def longest_region_path(series: DataFrame) -> DataFrame:
    """Longest known path of every region name; equal lengths go to the larger text."""
    return series.groupBy("region_name").agg(
        F.max(F.struct(F.length("region_path").alias("n"), F.col("region_path"))).alias("m")
    ).select("region_name", F.col("m.region_path").alias("region_path"))


def region_level(path: Column, depth: int, separator: str = " > ") -> Column:
    """First ``depth`` parts of a path; null when the path is shorter."""
    parts = F.split(path, separator)
    return F.when(F.size(parts) >= depth, F.array_join(F.slice(parts, 1, depth), separator))


def region_asof_join(
    left: DataFrame, left_month: Column, path: Column, series: DataFrame, month_col: str,
    values: Sequence[str], keys: Sequence[tuple[Column, str]] = (), max_depth: int = 3,
) -> DataFrame:
    """As-of values of the contract's region; each value falls back on its own to the
    parent regions. ``<value>_region`` names the region used.

    One equality join per level instead of an explode of the contracts, so the
    contract table keeps its row count.
    """
    out = left
    for depth in range(max_depth, 0, -1):
        out = asof_month_join(
            out, left_month, series, month_col, values,
            keys=[*keys, (region_level(path, depth), "region_path")], prefix=f"_d{depth}_",
        )
    depths = range(max_depth, 0, -1)
    cols = {}
    for v in values:
        cols[v] = F.coalesce(*[F.col(f"_d{d}_{v}") for d in depths])
        cols[f"{v}_region"] = F.coalesce(
            *[F.when(F.col(f"_d{d}_{v}").isNotNull(), region_level(path, d)) for d in depths])
    return out.withColumns(cols).drop(*[f"_d{d}_{v}" for d in depths for v in values])
