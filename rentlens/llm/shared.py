"""Helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def summed(df: DataFrame, measure: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], dtype: type) -> np.ndarray:
    """The sum of the equally long arrays that ``measure`` gives for the rows, flat; empty if there are none.

    A task adds up its own and passes one on; those meet in up to 64 groups before the driver adds the rest, so what
    the driver holds depends on the array alone.
    """
    def total(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        out = None
        for p in parts:
            out = p if out is None else out + p
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(dtype).tobytes()], pa.binary())], names=["part"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.asarray(p).ravel() for p in measure(batches))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total(np.frombuffer(cell.as_py(), dtype) for b in batches for cell in b.column("part"))

    parts = df.mapInArrow(own, "part binary").withColumn("k", F.spark_partition_id() % 64).repartition("k").select("part")
    rest = [np.frombuffer(r["part"], dtype) for r in parts.mapInArrow(merge, "part binary").collect()]
    return np.sum(rest, axis=0, dtype=dtype) if rest else np.zeros(0, dtype)


def _state(edges: DataFrame) -> tuple:
    """Row count and an order-free hash: two equal states mean that nothing moved."""
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: ``node, root`` for every node with a link, ``root`` being the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each round points the
    neighbours of a node at the smallest one, until every component is a star. All steps are joins and
    aggregates on node keys. Minima are stored before they are joined, so that a hub with a large share of
    the edges meets a plain exchange, which adaptive execution can split. Self links are ignored.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    pairs = cut_lineage(pairs)
    state = _state(pairs)
    while state[0]:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut_lineage(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = cut_lineage(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        pairs = cut_lineage(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct())
        now = _state(pairs)
        if now == state:
            break
        state = now
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
