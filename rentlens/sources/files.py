"""Readers for raw files and stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from rentlens.operators.quality import require_columns


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Named text columns of a CSV with a header (a byte-order mark is dropped).

    Values stay text: typed cleaning is done by the series operators.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).option("enforceSchema", False).csv(path)
    plain = raw.select([F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in raw.columns])
    return require_columns(plain, columns)


def read_parquet(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Required columns of parquet files; only they are read."""
    paths = [path] if isinstance(path, str) else list(path)
    return require_columns(spark.read.parquet(*paths), columns)


def file_counts(spark: SparkSession, pattern: str, keys: Sequence[str]) -> DataFrame:
    """Files found per model key under a glob: status FOUND, MISSING or DUPLICATE.

    Lists file names through Spark's own file source; contents are not read. A folder that
    Spark wrote counts as one file under the folder's name.
    """
    listing = spark.read.format("binaryFile").load(pattern).select("path")
    wanted = spark.createDataFrame([(k,) for k in keys], "model_key string")
    whole = F.regexp_replace("path", r"/part-[^/]*\z", "")
    name = F.url_decode(F.element_at(F.split(F.col("path"), "/"), -1))
    listed = listing.select(whole.alias("path")).distinct().select(name.alias("file"), "path")
    key = F.coalesce(*[F.when(F.contains(F.col("file"), F.lit(k)), F.lit(k)) for k in sorted(keys, key=len, reverse=True)])
    per = listed.withColumn("model_key", key).where("model_key is not null").groupBy("model_key").agg(
        F.count("*").alias("files"), F.min("path").alias("path"))
    n = F.coalesce("files", F.lit(0))
    return wanted.join(per, "model_key", "left").select(
        "model_key", n.alias("files"), F.when(n == 1, F.col("path")).alias("path"),
        F.when(n == 1, "FOUND").when(n == 0, "MISSING").otherwise("DUPLICATE").alias("status"))


def read_training(spark: SparkSession, folder: str, model_key: str, features: Sequence[str]) -> DataFrame:
    return read_parquet(spark, f"{folder}/train_{model_key}.parquet", features)


def read_table(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table over JDBC; filters and columns are pushed down by Spark.

    Pass partitionColumn, lowerBound, upperBound and numPartitions for a parallel read.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def typed(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of a stored table's schema, in order, cast strictly."""
    schema = TY.StructType.fromDDL(ddl)
    return require_columns(df, schema.fieldNames()).select(
        *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


# Stored tables of the engine.
PRICE_INDEX = (
    "transaction_type string, housing_type string, region_path string, region_name string, size_band string, "
    "base_month string, feature_name string, value double")
FUNDING_RATE = (
    "publication_date date, target_month string, value double")
MORTGAGE_RATE = (
    "contract_month string, base_month string, value double, provisional boolean")
MACRO = (
    "contract_month string, base_month string, feature_name string, value double, provisional boolean")
PROPERTY_REFERENCE = (
    "district string, bun string, ji string, housing_type string, model_name string, source_building_name string, "
    "sample_count bigint")
WATCHLIST = (
    "name string, age int, address string, address_sigungu string, return_debt_amount bigint, default_days int, "
    "enforcement_count int, posted_date date, crawled_at timestamp")
