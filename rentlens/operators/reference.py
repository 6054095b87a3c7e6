"""Property reference: which building names stand on which parcel, how often."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators.distribution import top_value

KEYS = ["district", "bun", "ji", "housing_type", "model_name", "source_building_name"]
PARCEL = ["district", "bun", "ji", "housing_type"]

# Which housing type and name column each price model's source has.
SOURCE_MODELS = {
    "매매_아파트": ("APARTMENT", "단지명"),
    "매매_연립다세대": ("VILLA", "건물명"),
    "매매_오피스텔": ("OFFICETEL", "단지명"),
    "전세_아파트": ("APARTMENT", "단지명"),
    "전세_연립다세대": ("VILLA", "건물명"),
    "전세_오피스텔": ("OFFICETEL", "단지명"),
}


def normalised_rows(raw: DataFrame, housing_type: str, district: str = "시군구", bun: str = "본번",
                    ji: str = "부번", name: str = "단지명") -> DataFrame:
    """Cleaned keys and name with a row count; rows with an empty part are dropped.

    Rows are counted by their raw spelling first, so text is cleaned once per
    spelling and not once per transaction.
    """
    kind = F.col(housing_type) if housing_type in raw.columns else F.lit(housing_type)
    spelled = raw.select(
        F.col(district).alias("district"), F.col(bun).alias("bun"), F.col(ji).alias("ji"), kind.alias("housing_type"),
        F.col(name).alias("model_name"),
    ).groupBy("district", "bun", "ji", "housing_type", "model_name").agg(F.count("*").alias("sample_count"))
    out = spelled.select(
        T.squeeze(T.text(F.col("district"))).alias("district"), T.lot_number(F.col("bun")).alias("bun"),
        T.lot_number(F.col("ji")).alias("ji"), "housing_type",
        T.squeeze(T.text(F.col("model_name"))).alias("model_name"), F.lit("").alias("source_building_name"), "sample_count")
    return out.where((F.col("district") != "") & (F.col("bun") != "") & (F.col("ji") != "") & (F.col("model_name") != ""))


def build_reference(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources counted, united and summed."""
    parts = [normalised_rows(df, SOURCE_MODELS[key][0], name=SOURCE_MODELS[key][1]) for key, df in sources.items()]
    return count_reference(reduce(DataFrame.unionByName, parts))


def count_reference(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("sample_count").alias("sample_count"))


def ranked_names(reference: DataFrame, level: list[str], out: str) -> DataFrame:
    """Most sampled name per level, ties to the smallest, and the distinct names."""
    named = reference.withColumn("model_name", T.strip(F.col("model_name"))).where(F.col("model_name") != "")
    top = top_value(named, level, "model_name", F.col("sample_count"), out)
    return top.withColumnRenamed("distinct_values", f"{out}_names")
