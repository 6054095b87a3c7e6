"""Which names contain which others, by an index of their grams.

Names meet only where the outer one holds the rarest gram of the inner one, so the pairs tested are the hits of one gram
and not all names of a group. A group's rows are spread over its grams: no task holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3  # characters of a gram


def _pieces(name: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters; none where the name is shorter."""
    last = F.length(name) - size + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(name, i, F.lit(size)))
    return F.when(last >= 1, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def contained_names(inner: DataFrame, outer: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, inner, outer) of every distinct pair of a group whose outer name contains the inner one.

    Both sides carry the keys and ``name``, repeated or not. Names compare by characters of their UTF-8 text. Empty and
    null names and null keys are in no pair; equal names contain each other. An inner name is looked up by a gram of
    ``GRAM`` characters, or by its whole text where it is shorter; where one of its grams stands in no outer name of the
    group it is dropped before the lookup.
    """
    name = F.col("name")
    inner, outer = (df.where(name != "").select(*keys, "name").distinct() for df in (inner, outer))
    listed = outer.select(*keys, F.col("name").alias("outer"), F.explode(
        F.concat(*[_pieces(name, size) for size in range(1, GRAM + 1)])).alias("_gram"))
    counts = listed.groupBy(*keys, "_gram").agg(F.count("*").alias("_n"))
    grams = inner.withColumn("_grams", F.when(F.length(name) < GRAM, F.array(name)).otherwise(_pieces(name, GRAM)))
    asked = grams.select(*keys, F.col("name").alias("inner"), F.size("_grams").alias("_size"), F.explode("_grams").alias("_gram"))
    rarest = asked.join(counts, [*keys, "_gram"]).groupBy(*keys, "inner", "_size").agg(
        F.min(F.struct("_n", "_gram")).alias("_first"), F.count("*").alias("_found")).where("_found = _size")
    probes = rarest.select(*keys, "inner", F.col("_first._gram").alias("_gram"))
    return probes.join(listed, [*keys, "_gram"]).where(F.contains("outer", "inner")).select(*keys, "inner", "outer")
