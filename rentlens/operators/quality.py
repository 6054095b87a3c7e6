"""Data-quality checks. Violations come back as rows, never as driver errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import score as S
from rentlens.functions import text as T


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Only the required columns; a missing one is an error while the plan is built."""
    gone = missing_columns(df, required)
    if gone:
        raise ValueError(f"missing columns: {gone}")
    return df.select(*required)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > 1)


def duplicate_row_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: number of duplicate keys and of all rows that carry one."""
    return duplicate_keys(df, keys).agg(
        F.count("*").alias("duplicate_keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("duplicate_rows"))


def lag_violations(df: DataFrame, base_month: str, contract_month: str, lag: int) -> DataFrame:
    """Rows whose contract month is not the base month plus the publication lag."""
    expected = T.add_months(F.col(base_month), lag)
    return df.where(~F.col(contract_month).eqNullSafe(expected)).withColumn("expected_month", expected)


def null_profile(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """Per column: nulls, values that are no number, NaN or infinite values.

    One pass over the table: all counts are aggregates of the same scan.
    """
    aggs = []
    for c in numeric:
        raw, num = F.col(c), F.col(c).try_cast("double")
        aggs += [F.count_if(raw.isNull()).alias(f"{c}|nulls"),
                 F.count_if(raw.isNotNull() & num.isNull()).alias(f"{c}|not_numeric"),
                 F.count_if(F.isnan(num) | (F.abs(num) == float("inf"))).alias(f"{c}|not_finite")]
    for c in text:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"),
                 F.count_if(F.lit(False)).alias(f"{c}|not_numeric"), F.count_if(F.lit(False)).alias(f"{c}|not_finite")]
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"`{c}|{k}`").alias(k) for k in ("nulls", "not_numeric", "not_finite")])
        for c in [*numeric, *text]
    ])
    return wide.select(F.inline(rows))


def store_check(rows: DataFrame, version: Column, expected_version: str, width: int) -> DataFrame:
    """One row: does a loaded store carry the expected version, rows and column count?"""
    return rows.agg(F.count("*").alias("row_count"), F.max(version).alias("version")).withColumns({
        "version_ok": F.col("version").eqNullSafe(F.lit(expected_version)),
        "rows_ok": F.col("row_count") > 0,
        "width_ok": F.lit(len(rows.columns) == width),
    })


def request_reject(mode: Column, has_register: Column, housing_type: Column, ho_name: Column, contract_area: Column,
                   exclusive_area: Column, deposit: Column) -> Column:
    """Reject codes of a diagnosis request."""
    detached = housing_type == "DETACHED_MULTI"
    return S.codes(
        ((mode == "QUICK") & has_register, "REGISTER_NOT_ALLOWED"),
        ((mode == "DETAILED") & ~has_register, "REGISTER_REQUIRED"),
        (F.coalesce(deposit <= 0, F.lit(True)), "DEPOSIT_NOT_POSITIVE"),
        (~detached & T.blank_to_null(ho_name).isNull(), "UNIT_REQUIRED"),
        (detached & contract_area.isNull(), "CONTRACT_AREA_REQUIRED"),
        (~detached & exclusive_area.isNull(), "EXCLUSIVE_AREA_REQUIRED"),
        ((contract_area <= 0) | (exclusive_area <= 0), "AREA_NOT_POSITIVE"),
    )


def what_if_reject(mode: Column, claim: Column, scenario_claim: Column, remove_mortgage: Column,
                   trend: Column, sale_drop: Column, lease_drop: Column) -> Column:
    """Reject codes of a what-if request."""
    quick = mode == "QUICK"
    return S.codes(
        (~trend.between(0, 10), "TREND_OUT_OF_RANGE"),
        (~sale_drop.between(0, 50) | ~lease_drop.between(0, 50), "DROP_OUT_OF_RANGE"),
        (quick & (claim.isNotNull() | scenario_claim.isNotNull()), "CLAIM_NOT_ALLOWED"),
        (quick & remove_mortgage, "REMOVAL_NOT_ALLOWED"),
        (remove_mortgage & claim.isNull(), "CLAIM_UNKNOWN"),
    )


def set_difference(left: Column, right: Column) -> dict[str, Column]:
    """Both one-sided differences of two key sets, sorted, and whether they are equal."""
    only_left, only_right = F.array_except(left, right), F.array_except(right, left)
    return {
        "only_left": F.array_sort(only_left), "only_right": F.array_sort(only_right),
        "equal": (F.size(only_left) == 0) & (F.size(only_right) == 0),
    }
