"""Comparing resolved documents with expected values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T


def owner_matches(expected: Column, actual: Column) -> Column:
    """One expected name contains the actual one or is contained; shares equal when expected."""
    name = T.canonical(actual["name"])
    named = F.exists(expected["names"], lambda n: name.contains(T.canonical(n)) | T.canonical(n).contains(name))
    return named & (expected["share"].isNull() | (T.canonical(expected["share"]) == T.canonical(actual["share"])))


def owners_agree(expected: Column, actual: Column) -> Column:
    """Every expected owner has a match and the numbers of owners are equal."""
    return F.forall(expected, lambda e: F.exists(actual, lambda a: owner_matches(e, a))) & (F.size(expected) == F.size(actual))


def field_checks(expected: DataFrame, actual: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """One row per sample and field: passed or not. A sample without a result fails.

    ``fields`` maps a field name to a condition over columns ``e`` and ``a`` (the
    expected and the actual row as structs).
    """
    e = expected.select(F.col(key), F.struct(*expected.columns).alias("e"))
    a = actual.select(F.col(key), F.struct(*actual.columns).alias("a"))
    j = e.join(a, key, "left")
    resolved = F.col("a").isNotNull()
    rows = F.array(*[
        F.struct(resolved.alias("resolved"), F.lit(n).alias("field"), F.coalesce(c, F.lit(False)).alias("passed"))
        for n, c in fields.items()])
    return j.select(key, F.inline(rows))


def equal_amounts(expected: Column, actual: Column) -> Column:
    return F.array_sort(expected) == F.array_sort(actual)


def evaluation_summary(checks: DataFrame, key: str, extra: Sequence[str] = ()) -> DataFrame:
    """Samples, passed samples, field checks, passed field checks."""
    per = checks.groupBy(*extra, key).agg(
        F.min("passed").alias("_all"), F.count("*").alias("_n"), F.count_if("passed").alias("_ok"))
    return per.groupBy(*extra).agg(
        F.count("*").alias("samples"), F.count_if("_all").alias("samples_passed"),
        F.sum("_n").alias("field_checks"), F.sum("_ok").alias("field_checks_passed"))
