"""Domain tables derived from the benchmark tables, each with its SQL twin.

Amounts are whole won (price x 1000), so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.functions import score as S
from rentlens.session import cut_lineage


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def won(c: Column, factor: int = 1000) -> Column:
    return F.round(c * factor).cast("long")


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def month_of(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


# ---- contracts -------------------------------------------------------------

DEPOSITS = """deposits AS (
  SELECT l_orderkey AS analysis_id, CAST(sum(CAST(round(l_extendedprice * 1000) AS BIGINT)) AS BIGINT) AS deposit
  FROM lineitem GROUP BY l_orderkey)"""
SEGMENTS = """segments AS (
  SELECT c_mktsegment AS segment, CAST(sum(CAST(round(o_totalprice * 1000) AS BIGINT)) AS BIGINT) // count(*) AS lease
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment)"""
CONTRACTS = f"""{DEPOSITS}, {SEGMENTS}, contracts AS (
  SELECT o_orderkey AS analysis_id, o_custkey AS custkey, o_orderstatus AS status,
    CAST(o_orderdate AS DATE) AS contract_date, strftime(o_orderdate, '%Y-%m') AS contract_month,
    CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'QUICK' ELSE 'DETAILED' END AS mode,
    CAST(round(o_totalprice * 1000) AS BIGINT) AS sale, lease, deposit,
    CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') OR o_orderstatus = 'P' THEN NULL
         ELSE CAST(round(greatest(c_acctbal, 0) * 10000) AS BIGINT) END AS claim,
    CAST(o_orderkey % 11 AS INTEGER) AS trend,
    CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 = 0 THEN ['SEIZURE', 'OWNER_MISMATCH', 'SEIZURE']
         WHEN o_custkey % 7 = 0 THEN ['TRUST_REGISTRATION'] ELSE CAST([] AS VARCHAR[]) END AS reasons
  FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN segments ON segment = c_mktsegment JOIN deposits ON analysis_id = o_orderkey)"""


def deposits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("analysis_id")).agg(
        F.sum(won(F.col("l_extendedprice"))).alias("deposit"))


def segment_leases(spark: SparkSession, d: str, stored: bool = False) -> Column:
    """Map of the lease price of each market segment; ``stored`` computes it now, once for all its readers.

    There are five segments: as one map value they need no join, which would send
    every contract to one of five partitions.
    """
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    sales = table(spark, d, "orders").join(c, "o_custkey").groupBy("segment").agg(
        F.sum(won(F.col("o_totalprice"))).alias("_s"), F.count("*").alias("_n"))
    leases = sales.select(F.struct("segment", F.call_function("div", "_s", "_n").alias("lease")).alias("e"))
    return (cut_lineage(leases) if stored else leases).select(F.map_from_entries(F.collect_list("e"))).scalar()


def contract_columns() -> list[Column]:
    quick = F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")
    strings = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    return [
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").cast("date").alias("contract_date"), month_of(F.col("o_orderdate")).alias("contract_month"),
        F.when(quick, "QUICK").otherwise("DETAILED").alias("mode"),
        won(F.col("o_totalprice")).alias("sale"), "lease", "deposit",
        F.when(~quick & (F.col("o_orderstatus") != "P"), won(F.greatest(F.col("c_acctbal"), F.lit(0.0)), 10_000)).alias("claim"),
        (F.col("o_orderkey") % 11).cast("int").alias("trend"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 3 == 0), strings("SEIZURE", "OWNER_MISMATCH", "SEIZURE"))
        .when(F.col("o_custkey") % 7 == 0, strings("TRUST_REGISTRATION")).otherwise(strings()).alias("reasons"),
    ]


def stored_lookups(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """Deposits and segment leases computed once and stored, so that a stream's batches only read them."""
    return cut_lineage(deposits(spark, d)), segment_leases(spark, d, stored=True)


def enrich_orders(orders: DataFrame, spark: SparkSession, d: str, lookups: tuple[DataFrame, Column] | None = None) -> DataFrame:
    """Orders with the static columns contracts need (customer, segment, deposit)."""
    sums, leases = lookups or (deposits(spark, d), segment_leases(spark, d))
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), "c_acctbal")
    dep = sums.withColumnRenamed("analysis_id", "o_orderkey")
    joined_rows = orders.join(c, "o_custkey").join(dep, "o_orderkey")
    return joined_rows.withColumn("lease", F.try_element_at(leases, F.col("segment"))).select(*contract_columns())


def contracts(spark: SparkSession, d: str) -> DataFrame:
    return enrich_orders(table(spark, d, "orders"), spark, d)


# ---- register payload of a contract ----------------------------------------

def _tri_sql(expr: str) -> str:
    return f"CASE ({expr}) % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'FALSE' ELSE 'UNKNOWN' END"


def _rare_sql(expr: str, mod: int) -> str:
    return f"CASE ({expr}) % {mod} WHEN 0 THEN 'TRUE' WHEN 1 THEN 'UNKNOWN' ELSE 'FALSE' END"


REGISTER = f"""{CONTRACTS}, register AS (
  SELECT *, {_rare_sql('analysis_id', 17)} AS seizure, {_rare_sql('custkey', 19)} AS provisional_seizure,
    {_rare_sql('analysis_id + 3', 23)} AS provisional_disposition, {_rare_sql('custkey + 5', 29)} AS auction_commenced,
    {_rare_sql('analysis_id + 7', 31)} AS trust_registration, {_rare_sql('custkey + 11', 13)} AS has_active_jeonse_right,
    {_tri_sql('analysis_id')} AS has_active_leasehold_registration, {_tri_sql('custkey + 1')} AS owner_matches_contract_party,
    CASE analysis_id % 4 WHEN 0 THEN 'NEEDS_REVIEW' ELSE 'SUCCESS' END AS parse_status,
    CASE custkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS parse_confidence,
    CASE custkey % 5 WHEN 0 THEN 'NOT_CHECKED' WHEN 1 THEN 'ERROR' ELSE 'CHECKED' END AS watchlist_check_status,
    analysis_id % 6 = 0 AS bad_landlord_matched, claim AS total_active_max_claim_amount
  FROM contracts)"""


def register(spark: SparkSession, d: str) -> DataFrame:
    return with_register(contracts(spark, d))


def with_register(df: DataFrame) -> DataFrame:
    """Contracts with the payload of their register."""
    tri = lambda e: F.when(e % 3 == 0, "TRUE").when(e % 3 == 1, "FALSE").otherwise("UNKNOWN")
    rare = lambda e, m: F.when(e % m == 0, "TRUE").when(e % m == 1, "UNKNOWN").otherwise("FALSE")
    a, c = F.col("analysis_id"), F.col("custkey")
    return df.withColumns({
        "seizure": rare(a, 17), "provisional_seizure": rare(c, 19), "provisional_disposition": rare(a + 3, 23),
        "auction_commenced": rare(c + 5, 29), "trust_registration": rare(a + 7, 31),
        "has_active_jeonse_right": rare(c + 11, 13), "has_active_leasehold_registration": tri(a),
        "owner_matches_contract_party": tri(c + 1),
        "parse_status": F.when(a % 4 == 0, "NEEDS_REVIEW").otherwise("SUCCESS"),
        "parse_confidence": F.when(c % 4 == 0, "LOW").when(c % 4 == 1, "MEDIUM").otherwise("HIGH"),
        "watchlist_check_status": F.when(c % 5 == 0, "NOT_CHECKED").when(c % 5 == 1, "ERROR").otherwise("CHECKED"),
        "bad_landlord_matched": a % 6 == 0, "total_active_max_claim_amount": F.col("claim"),
    })


# ---- SQL macros as text ----------------------------------------------------

BURDEN_POINTS = "CASE WHEN {r} < 0.7::DOUBLE THEN 0 WHEN {r} < 0.8::DOUBLE THEN 18 WHEN {r} < 0.9::DOUBLE THEN 31 WHEN {r} <= 1 THEN 40 ELSE 45 END"
GAP_POINTS = "CASE WHEN {g} < -0.05::DOUBLE THEN 0 WHEN {g} <= 0.05::DOUBLE THEN 14 WHEN {g} <= 0.15::DOUBLE THEN 31 ELSE 45 END"
FLOOR = ("greatest(CASE WHEN {r} > 1 THEN 100 WHEN {r} >= 1 THEN 80 END, CASE WHEN {g} >= 0.25::DOUBLE THEN 80 END, "
         "CASE WHEN {r} >= 0.8::DOUBLE AND {g} >= 0.05::DOUBLE THEN 56 END)")
GRADE = "CASE WHEN {s} <= 25 THEN 'LOW' WHEN {s} <= 55 THEN 'MEDIUM' WHEN {s} <= 79 THEN 'HIGH' ELSE 'CRITICAL' END"
REASONS = ("list_filter([CASE WHEN {r} > 1 THEN 'RECOVERY_SHORTFALL' END, CASE WHEN {r} = 1 THEN 'NO_RECOVERY_BUFFER' END, "
           "CASE WHEN {g} >= 0.25::DOUBLE THEN 'EXTREME_LEASE_DEVIATION' END, "
           "CASE WHEN {r} >= 0.8::DOUBLE AND {g} >= 0.05::DOUBLE THEN 'COMBINED_PRICE_RISK' END], lambda x: x IS NOT NULL)")


def rates_sql(source: str, sale="sale", lease="lease", deposit="deposit", claim="claim") -> str:
    """Adds r (scored rate) and g (gap rate) to a source."""
    return (f"SELECT *, (coalesce({claim}, 0) + {deposit})::DOUBLE / {sale}::DOUBLE AS r, "
            f"({deposit} - {lease})::DOUBLE / {lease}::DOUBLE AS g FROM {source}")


def total_sql(r: str = "r", g: str = "g", trend: str = "trend") -> str:
    base = f"least({BURDEN_POINTS.format(r=r)} + {GAP_POINTS.format(g=g)} + {trend}, 100)"
    return f"greatest({base}, {FLOOR.format(r=r, g=g)})"


SCORED = f"""rated AS ({rates_sql('contracts')}), scored AS (
  SELECT *, {BURDEN_POINTS.format(r='r')} AS price_burden, {GAP_POINTS.format(g='g')} AS lease_market_deviation,
    least({BURDEN_POINTS.format(r='r')} + {GAP_POINTS.format(g='g')} + trend, 100) AS base_total,
    {FLOOR.format(r='r', g='g')} AS policy_floor, {total_sql()} AS total, {REASONS.format(r='r', g='g')} AS floor_reasons
  FROM rated)"""
