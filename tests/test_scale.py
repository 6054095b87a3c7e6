"""Work and memory of a task that do not grow with the input."""

from pyspark.sql import functions as F

from rentlens.operators import merge
from rentlens.plans import register_queries as R
from rentlens.plans import series_queries
from rentlens.session import spread

CLAIMS = "claim_id long, merge_id long, document_index int, seq int, documents int"


def exchanges(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in x]


def test_inputs_larger_than_a_task_are_dealt_by_key(spark):
    df = spark.range(100).withColumn("k", F.col("id") % 50)
    assert exchanges(spread(df, 100, "k", task_rows=30)) == []
    dealt = spread(df, 100, "k", task_rows=10)
    assert dealt.rdd.getNumPartitions() == 10
    assert dealt.withColumn("part", F.spark_partition_id()).groupBy("k").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


def test_claims_of_merges_of_one_document_bypass_the_comparison(spark):
    rows = [(1, 1, 0, 1, 1), (2, 1, 0, 2, 1), (3, 2, 0, 1, 2), (4, 2, 7, 1, 2), (5, 2, 7, 2, 2), (6, 3, 0, 1, None)]
    c = spark.createDataFrame(rows, CLAIMS)
    s = c.where("documents > 1").drop("documents").withColumn("signature", F.when(F.col("claim_id") < 5, "a").otherwise("b"))
    kept = merge.greedy_dedupe(c, s.unionByName(s), alone=F.col("documents") == 1)
    assert sorted(r.claim_id for r in kept.collect()) == [1, 2, 3, 5, 6]
    kept = merge.greedy_dedupe(c, s.unionByName(s), walk_rows=1, alone=F.col("documents") == 1)
    assert sorted(r.claim_id for r in kept.collect()) == [1, 2, 3, 5, 6]


def test_lines_are_joined_to_documents_once(spark, tmp_path):
    day = "2024-01-0"
    o = spark.createDataFrame([(1, 9, "O", f"{day}1"), (2, 9, "F", f"{day}2"), (3, 8, "P", f"{day}3")], "o_orderkey long, o_custkey long, o_orderstatus string, d string")
    o.withColumn("o_orderdate", F.to_timestamp("d")).drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    li = spark.createDataFrame([(k, 7, i, 5, 30.0, "O", f) for k in (1, 2, 3) for i, f in ((1, "N"), (2, "A"))],
                               "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_quantity double, l_linestatus string, l_returnflag string")
    li.withColumn("l_shipdate", F.to_timestamp(F.lit("2024-03-01"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    claims, links = R.claim_rows(spark, str(tmp_path))
    assert sorted((r.doc_id, r.merge_id, r.documents, r.joint) for r in claims.collect()) == [(1, 1, 2, True), (2, 1, 2, True), (3, 3, 1, False)]
    assert links.count() == 3 and "Join" not in claims._jdf.queryExecution().optimizedPlan().toString()
    assert [r.doc_id for r in R.merged_deposits(spark, str(tmp_path)).join(claims, "claim_id").orderBy("doc_id").collect()] == [1, 3]


def test_lag_check_deals_both_sides_alike(spark, tmp_path, monkeypatch):
    o = spark.range(1, 61).select(F.col("id").alias("o_orderkey"), F.to_timestamp(F.lit("2024-01-05")).alias("o_orderdate"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    o.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.array(*[F.to_timestamp(F.lit(x)) for x in ("2024-02-01", "2024-02-02", "2024-03-01")])).alias("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(series_queries, "spread", lambda df, rows, *keys: spread(df, rows, *keys, task_rows=20))
    out = series_queries.publication_lag_check(spark, str(tmp_path))
    assert [tuple(r) for r in out.collect()] == [("2024-01", "2024-02", "2024-03", 60)]
    assert len(exchanges(out)) == 2 and all("9" in x for x in exchanges(out))
