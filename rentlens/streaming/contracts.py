"""Scoring contract requests as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.sql.streaming import StreamingQuery

from rentlens.operators import asof, scoring
from rentlens.sources import sinks


def read_contracts(spark: SparkSession, folder: str, schema: TY.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def write_arrival(requests: DataFrame, folder: str, files: int) -> None:
    """Adds requests to the folder that ``read_contracts`` reads, as at most so many files, each written by a task of its own."""
    requests.coalesce(files).write.mode("append").parquet(folder)


def score_stream(contracts: DataFrame, enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stateless: static lookups (``enrich``), indicators and score per request."""
    df = enrich(contracts) if enrich else contracts
    ok, _ = scoring.split_rejected(df)
    return scoring.with_score(scoring.with_indicators(ok))


def unique_requests(requests: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Requests without those whose key came before within the delay. The state holds one entry for each key until the
    watermark, which lags the newest event by ``delay``, has passed it; rows older than the watermark leave."""
    return requests.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def with_series(contracts: DataFrame, store: str, name: str, month: str, values: Sequence[str]) -> DataFrame:
    """As-of values of a monthly series, from the version that the store's metadata names when the run starts.

    All micro-batches of one run read the same version; the next run, from the same checkpoint, reads the newest. Adds
    the values, ``<name>_month`` and ``<name>_version``.
    """
    spark = contracts.sparkSession
    current = sinks.read_metadata(spark, store).where(F.col("source_name") == name).first()
    series = spark.read.parquet(current["path"])
    joined = asof.asof_month_join(contracts, F.col(month), series, "month", list(values), mark=f"{name}_month")
    return joined.withColumn(f"{name}_version", F.lit(current["version"]))


def write_scores(scored: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends scored requests to parquet; a restart goes on from the checkpoint, and
    each micro-batch is committed once by the file sink's log."""
    return (
        scored.writeStream.format("parquet").outputMode("append")
        .option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
