"""Writers: full refresh with metadata, register results, watchlist checks, CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.functions import text as T


def refresh_table(df: DataFrame, folder: str, name: str, version: str, partition_by: str | None = None) -> DataFrame:
    """Full refresh of a stored table: the new version is written whole beside the
    old one, checked, and only then named in the metadata.

    Every load has a folder of its own, also one of a version that is loaded again, and
    readers follow the metadata, so a failed write leaves them on what they read.
    Returns the new metadata.
    """
    spark = df.sparkSession
    path = f"{folder}/{name}/{version}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    rows = spark.read.parquet(path).count()
    if rows == 0:
        raise ValueError(f"{name}: no rows to load")
    entry = spark.createDataFrame([(name, version, rows, path)], "source_name string, version string, row_count long, path string")
    return upsert_metadata(spark, folder, entry.withColumn("loaded_at", F.current_timestamp()))


def upsert_metadata(spark: SparkSession, folder: str, entry: DataFrame) -> DataFrame:
    """Metadata rows with the same source replaced, stored as a new step.

    Two loads that finish at once cannot both write the same step: the later one fails.
    """
    old = read_metadata(spark, folder)
    step, merged = 0, entry
    if old is not None:
        step = old.agg(F.max("step")).first()[0] + 1
        merged = old.drop("step").join(entry.select("source_name"), "source_name", "left_anti").unionByName(entry)
    merged.coalesce(1).write.parquet(f"{folder}/_metadata/step={step}")
    return read_metadata(spark, folder)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame | None:
    """Newest metadata, one row per source; null before the first load."""
    if not _exists(spark, f"{folder}/_metadata"):
        return None
    full = spark.read.parquet(f"{folder}/_metadata")
    return full.where(F.col("step") == full.select(F.max("step")).scalar())


def read_current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The version of a stored table that the metadata names."""
    row = read_metadata(spark, folder).where(F.col("source_name") == name).first()
    return spark.read.parquet(row["path"])


def write_table(df: DataFrame, url: str, table: str, batch: int = 5000, **options: str) -> None:
    """Full refresh of a database table, in batches, keeping its definition."""
    df.write.format("jdbc").mode("overwrite").options(
        url=url, dbtable=table, truncate="true", batchsize=str(batch), **options).save()


def owner_key(name: Column, jumin: Column) -> Column:
    return F.struct(T.strip(T.text(name)).alias("name"), T.strip(T.text(jumin)).alias("jumin_front"))


def row_id(*parts: Column) -> Column:
    """Stable id from the parts of a key; the same input gives the same id on every run."""
    return F.xxhash64(*parts)


SECTION_CODES = {"갑구": "GAP", "을구": "EUL"}  # fixed values


def register_tables(results: DataFrame) -> dict[str, DataFrame]:
    """Header, owner and right tables of nested register results.

    ``results``: analysis_id, header columns, current_owners and rights as arrays.
    Ids are derived from (analysis_id, position), so a retry writes the same rows.
    """
    header_id = row_id(F.col("analysis_id"))
    header = results.drop("current_owners", "rights").withColumn("registry_result_id", header_id)
    owners = results.select("analysis_id", header_id.alias("registry_result_id"),
                            F.posexplode("current_owners").alias("position", "o")).select(
        "analysis_id", "registry_result_id", row_id(F.col("analysis_id"), F.lit("owner"), F.col("position")).alias("registry_owner_id"), "o.*")
    codes = F.create_map(*[F.lit(x) for p in SECTION_CODES.items() for x in p])
    rights = results.select("analysis_id", header_id.alias("registry_result_id"), F.posexplode("rights").alias("position", "r")).select(
        "analysis_id", "registry_result_id", row_id(F.col("analysis_id"), F.lit("right"), F.col("position")).alias("registry_right_id"), "r.*")
    rights = rights.withColumn("section", F.coalesce(F.try_element_at(codes, F.col("section")), F.col("section")))
    return {"registry_results": header, "registry_owners": owners, "registry_rights": rights}


def attach_owner_ids(checks: DataFrame, owners: DataFrame) -> DataFrame:
    """Owner ids by (trimmed name, trimmed id front); the last owner of a pair counts."""
    ids = owners.groupBy("analysis_id", owner_key(F.col("name"), F.col("jumin_front")).alias("_key")).agg(
        F.max("registry_owner_id").alias("registry_owner_id"))
    return checks.withColumn("_key", owner_key(F.col("name"), F.col("jumin_front"))).join(
        ids, ["analysis_id", "_key"], "left").drop("_key")


def candidates_json(candidates: Column) -> Column:
    return F.when(F.size(candidates) > 0, F.to_json(candidates))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; the first header cell carries the byte-order mark."""
    first, *rest = df.columns
    marked = df.withColumnRenamed(first, "﻿" + first)
    marked.write.mode("overwrite").option("header", True).csv(path)
