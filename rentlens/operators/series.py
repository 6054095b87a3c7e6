"""Economic series: cleaning of raw rows into keyed long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T

# Names of the price-index features and the raw labels they come from.
INDEX_EXACT = {
    ("가격지수", "원자료"): "RONE_가격지수",
    ("가격지수", "전기대비증감률"): "RONE_가격지수_전월비",
}
INDEX_CLASS = {"중위단위가격": "RONE_중위단위가격_천원㎡"}
INDEX_CLASS_PART = {("오피스텔가격", "평균단위당"): "RONE_평균단위가격_천원㎡"}
MACRO_FEATURES = {
    "선행지수_순환변동치": "KOSIS_선행지수_순환변동치",
    "경제심리지수": "KOSIS_경제심리지수",
    "건설기성액": "KOSIS_건설기성액",
}
INDEX_COLUMNS = {
    "거래유형": "transaction_type", "주택유형": "housing_type", "지역경로": "region_path",
    "최종지역명": "region_name", "규모": "size_band", "기준연월": "base_month",
}


def mapped_feature(cls: Column, detail: Column, exact: Mapping[tuple[str, str], str] = INDEX_EXACT,
                   by_class: Mapping[str, str] = INDEX_CLASS,
                   by_part: Mapping[tuple[str, str], str] = INDEX_CLASS_PART) -> Column:
    """Feature of an (indicator class, detail) pair; null when none applies."""
    expr = F.when(F.lit(False), F.lit(None).cast("string"))
    for (c, d), name in exact.items():
        expr = expr.when((cls == c) & (detail == d), name)
    for c, name in by_class.items():
        expr = expr.when(cls == c, name)
    for (c, part), name in by_part.items():
        expr = expr.when((cls == c) & detail.contains(part), name)
    return expr


def clean_index(raw: DataFrame, feature: Column, status: str, ok: str, value: str,
                renames: Mapping[str, str] = INDEX_COLUMNS) -> DataFrame:
    """Rows in normal state with a known feature and a numeric value, renamed."""
    return (
        raw.where(F.col(status) == ok)
        .withColumns({"feature_name": feature, "_value": F.col(value).try_cast("double")})
        .where(F.col("feature_name").isNotNull() & F.col("_value").isNotNull() & ~F.isnan("_value"))
        .select(*[F.col(a).alias(b) for a, b in renames.items()], "feature_name", F.col("_value").alias("value"))
    )


def price_index(raw: DataFrame) -> DataFrame:
    """The regional price index table from its raw file."""
    return clean_index(raw, mapped_feature(F.col("지표분류"), F.col("세부지표")), "값상태", "정상", "수치값")


def long_features(wide: DataFrame, ids: Sequence[str], names: Mapping[str, str], flag: str | None = None) -> DataFrame:
    """Wide measures to (ids, feature_name, value) rows, numeric values only.

    ``flag`` is a Y/N column that becomes the boolean ``provisional``.
    """
    numeric = wide.withColumns({c: F.col(c).try_cast("double") for c in names})
    keep = [*ids, *([flag] if flag else [])]
    long = numeric.unpivot(keep, list(names), "source_feature", "value")
    labels = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    out = long.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn(
        "feature_name", labels[F.col("source_feature")])
    extra = [(F.col(flag) == "Y").alias("provisional")] if flag else []
    return out.select(*ids, "feature_name", "value", *extra)


def macro_series(raw: DataFrame) -> DataFrame:
    """Macro indicators by contract month from their raw file."""
    usable = raw.where(F.col("KOSIS_가용여부") == "Y").select(
        F.col("계약연월").alias("contract_month"), F.col("원자료_기준연월").alias("base_month"),
        F.col("잠정치포함여부").alias("flag"), *MACRO_FEATURES)
    return long_features(usable, ["contract_month", "base_month"], MACRO_FEATURES, "flag")


def available_rates(raw: DataFrame, contract_month: str, base_month: str, value: str, provisional: str,
                    available: str) -> DataFrame:
    """Usable rates: available rows with both months and a numeric value."""
    return (
        raw.where(F.col(available) == "Y")
        .select(F.col(contract_month).alias("contract_month"), F.col(base_month).alias("base_month"),
                F.col(value).try_cast("double").alias("value"), (F.col(provisional) == "Y").alias("provisional"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .dropna(subset=["contract_month", "base_month"])
    )


def mortgage_rates(raw: DataFrame) -> DataFrame:
    return available_rates(raw, "계약연월", "주담대금리_기준연월", "주담대금리_적용값",
                           "주담대금리_잠정치여부", "주담대금리_가용여부")


def published_rates(raw: DataFrame, published: str, month: str, value: str) -> DataFrame:
    """Rates by publication date; rows without a valid date or number are dropped."""
    return raw.select(
        T.iso_date(F.col(published).cast("string")).alias("publication_date"),
        F.substring(F.col(month).cast("string"), 1, 7).alias("target_month"),
        F.col(value).try_cast("double").alias("value"),
    ).where(F.col("publication_date").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))


def funding_rates(raw: DataFrame) -> DataFrame:
    return published_rates(raw, "공시일", "대상연월", "신규취급액기준_COFIX")


def rows_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows"))


def build_summary(df: DataFrame, month: str) -> DataFrame:
    """Rows, distinct months, first and last month of a series."""
    return df.agg(
        F.count("*").alias("rows"), F.count_distinct(month).alias("months"),
        F.min(month).alias("first_month"), F.max(month).alias("last_month"))
