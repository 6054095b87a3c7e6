import random

import numpy as np
from pyspark.sql import functions as F

from rentlens.operators import distribution

PROBS = {"low": 0.0, "p25": 0.25, "median": 0.5, "p99": 0.99, "high": 1.0}


def check(spark, values, open_rows):
    df = spark.createDataFrame(values, "g string, v double").repartition(4)
    got = {r.g: r for r in distribution.exact_percentiles(df, ["g"], "v", PROBS, open_rows=open_rows).collect()}
    by_group = {}
    for g, v in values:
        by_group.setdefault(g, []).append(v)
    assert set(got) == set(by_group)
    for g, vs in by_group.items():
        want = np.percentile(vs, [100 * p for p in PROBS.values()])
        assert np.allclose([got[g][n] for n in PROBS], want, rtol=1e-15, atol=0), g


def test_oversized_buckets_are_split(spark):
    rng = random.Random(1)
    near = [("near", 1e9 + rng.random() * 1e5) for _ in range(5_000)]
    # Clusters within clusters: every round leaves most rows in one part.
    nested = [("nested", 1.0 + 1e-4 * 2.0 ** -rng.randint(0, 38)) for _ in range(3_000)]
    same = [("same", 5.0)] * 2_000
    negative = [("negative", -1e9 - rng.random() * 1e5) for _ in range(2_000)]
    few = [("few", 1.0), ("few", 2.0), ("few", 1000.0)]
    for open_rows in (1, 50, 10**6):
        check(spark, near + nested + same + negative + few, open_rows)


def test_one_bucket_with_a_million_values(spark):
    """A group whose values all lie in one bucket is split, and no task sorts more than ``open_rows`` of them."""
    n = 1_000_001
    df = spark.range(n).select(F.lit("g").alias("g"), (F.lit(1e9) + F.col("id") / 4).alias("v"))
    rows = df.select("g", F.col("v").alias("_v"), F.lit(1).cast("long").alias("_c"), distribution.bucket_of(F.col("v")).alias("_b"))
    assert rows.select("_b").distinct().count() == 1
    _, hits = distribution._wanted_buckets(rows, ["g"], {"m": 0.5}, 10_000)
    assert [r._rows <= 10_000 for r in hits.collect()] == [True]
    assert distribution.exact_percentiles(df, ["g"], "v", {"m": 0.5}, open_rows=10_000).first().m == 1e9 + (n - 1) / 8


def test_infinities_and_empty_tables(spark):
    rows = [("g", v) for v in (float("-inf"), -1.0, 0.0, 3.0, float("inf"))]
    df = spark.createDataFrame(rows + [("h", None)], "g string, v double")
    got = distribution.exact_percentiles(df, ["g"], "v", {"m": 0.5, "h": 0.75}, open_rows=1).collect()
    assert [tuple(r) for r in got] == [("g", 0.0, 3.0)]
    assert distribution.exact_percentiles(df.limit(0), ["g"], "v", {"m": 0.5}).count() == 0
