"""Queries of the series, as-of, quality and reference families."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators import asof, match, quality, reference, series
from rentlens.plans import bindings as B
from rentlens.plans.catalog import query
from rentlens.session import cut_lineage, spread, work_folder
from rentlens.sources import sinks

# ---- price index rows from the event table ---------------------------------

INDEX_EXACT = {("click", "high"): "INDEX_LEVEL", ("view", "low"): "INDEX_CHANGE"}
INDEX_CLASS = {"purchase": "UNIT_PRICE"}
INDEX_PART = {("signup", "low"): "AVERAGE_UNIT_PRICE"}
INDEX_RENAMES = {"kind": "transaction_type", "house": "housing_type", "path": "region_path", "leaf": "region_name",
                 "band": "size_band", "month": "base_month"}
INDEX_RAW = """raw AS (
  SELECT CASE WHEN user_id % 2 = 0 THEN 'SALE' ELSE 'LEASE' END AS kind, 'H' || CAST(user_id % 4 AS VARCHAR) AS house,
    r_name || ' > ' || n_name AS path, n_name AS leaf, 'B' || CAST(user_id % 3 AS VARCHAR) AS band, strftime(ts, '%Y-%m-%d') AS month,
    event_type AS cls, CASE WHEN value >= 10 THEN 'high' ELSE 'low part' END AS detail,
    CASE WHEN event_id % 9 = 0 THEN '-' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS amount,
    CASE WHEN event_id % 11 = 0 THEN 'MISSING' ELSE 'NORMAL' END AS state, event_id
  FROM events JOIN nation ON n_nationkey = user_id % 25 JOIN region ON r_regionkey = n_regionkey)"""
INDEX_CLEAN = f"""{INDEX_RAW}, cleaned AS (
  SELECT event_id, kind AS transaction_type, house AS housing_type, path AS region_path, leaf AS region_name, band AS size_band, month AS base_month,
    CASE WHEN cls = 'click' AND detail = 'high' THEN 'INDEX_LEVEL' WHEN cls = 'view' AND detail = 'low' THEN 'INDEX_CHANGE' WHEN cls = 'purchase' THEN 'UNIT_PRICE'
         WHEN cls = 'signup' AND contains(detail, 'low') THEN 'AVERAGE_UNIT_PRICE' END AS feature_name, TRY_CAST(amount AS DOUBLE) AS value
  FROM raw WHERE state = 'NORMAL'), idx AS (SELECT * FROM cleaned WHERE feature_name IS NOT NULL AND value IS NOT NULL)"""


def index_raw(spark, d) -> DataFrame:
    e = B.table(spark, d, "events")
    n = B.table(spark, d, "nation").join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    u = F.col("user_id")
    return e.join(n, F.col("n_nationkey") == (u % 25)).select(
        F.when(u % 2 == 0, "SALE").otherwise("LEASE").alias("kind"), F.concat(F.lit("H"), (u % 4).cast("string")).alias("house"),
        F.concat_ws(" > ", "r_name", "n_name").alias("path"), F.col("n_name").alias("leaf"),
        F.concat(F.lit("B"), (u % 3).cast("string")).alias("band"), F.date_format("ts", "yyyy-MM-dd").alias("month"),
        F.col("event_type").alias("cls"), F.when(F.col("value") >= 10, "high").otherwise("low part").alias("detail"),
        F.when(F.col("event_id") % 9 == 0, "-").otherwise(B.won(F.col("value"), 100).cast("string")).alias("amount"),
        F.when(F.col("event_id") % 11 == 0, "MISSING").otherwise("NORMAL").alias("state"), "event_id")


def index_values(spark, d, keep_id: bool = False) -> DataFrame:
    feature = series.mapped_feature(F.col("cls"), F.col("detail"), INDEX_EXACT, INDEX_CLASS, INDEX_PART)
    renames = {**INDEX_RENAMES, **({"event_id": "event_id"} if keep_id else {})}
    return series.clean_index(index_raw(spark, d), feature, "state", "NORMAL", "amount", renames)


@query("price_index_rows", "P1 P2", f"WITH {INDEX_CLEAN} SELECT * FROM idx")
def price_index_rows(spark, d) -> DataFrame:
    return index_values(spark, d, keep_id=True)


@query("price_index_row_counts", "A6", f"WITH {INDEX_CLEAN} SELECT transaction_type, housing_type, count(*) AS rows FROM idx GROUP BY ALL")
def price_index_row_counts(spark, d) -> DataFrame:
    return series.rows_by(index_values(spark, d), "transaction_type", "housing_type")


INDEX_KEY = ["transaction_type", "housing_type", "region_path", "size_band", "base_month", "feature_name"]


@query("duplicate_index_keys", "P5", f"""WITH {INDEX_CLEAN}, k AS (SELECT {', '.join(INDEX_KEY)}, count(*) AS rows FROM idx GROUP BY ALL HAVING count(*) > 1)
SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(rows), 0) AS BIGINT) AS duplicate_rows FROM k""")
def duplicate_index_keys(spark, d) -> DataFrame:
    return quality.duplicate_row_count(index_values(spark, d), INDEX_KEY)


# ---- macro series ----------------------------------------------------------

MACRO_NAMES = {"order_value": "MACRO_ORDER_VALUE", "order_count": "MACRO_ORDER_COUNT", "open_share": "MACRO_OPEN_SHARE"}
MACRO_WIDE = """wide AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS base_month, strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m') AS contract_month,
    CASE WHEN month(min(o_orderdate)) % 3 = 0 THEN 'Y' ELSE 'N' END AS provisional_flag,
    CASE WHEN month(min(o_orderdate)) = 5 THEN '-' ELSE CAST(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS VARCHAR) END AS order_value,
    CAST(count(*) AS VARCHAR) AS order_count, CASE WHEN month(min(o_orderdate)) = 8 THEN NULL ELSE CAST(count(*) FILTER (o_orderstatus = 'O') AS VARCHAR) END AS open_share
  FROM orders GROUP BY date_trunc('month', o_orderdate), strftime(o_orderdate, '%Y-%m'))"""
MACRO_LONG = f"""{MACRO_WIDE}, macro AS (
  SELECT contract_month, base_month, feature_name, value, provisional FROM (
    SELECT contract_month, base_month, provisional_flag = 'Y' AS provisional, unnest(['MACRO_ORDER_VALUE', 'MACRO_ORDER_COUNT', 'MACRO_OPEN_SHARE']) AS feature_name,
      unnest([TRY_CAST(order_value AS DOUBLE), TRY_CAST(order_count AS DOUBLE), TRY_CAST(open_share AS DOUBLE)]) AS value FROM wide) WHERE value IS NOT NULL)"""


def macro_wide(spark, d) -> DataFrame:
    m = F.month(F.min("o_orderdate"))
    base = B.table(spark, d, "orders").withColumn("base_month", B.month_of(F.col("o_orderdate"))).groupBy("base_month").agg(
        F.when(m % 3 == 0, "Y").otherwise("N").alias("provisional_flag"),
        F.when(m == 5, "-").otherwise(F.sum(B.won(F.col("o_totalprice"), 100)).cast("string")).alias("order_value"),
        F.count("*").cast("string").alias("order_count"),
        F.when(m != 8, F.count_if(F.col("o_orderstatus") == "O").cast("string")).alias("open_share"))
    return base.withColumn("contract_month", T.add_months(F.col("base_month"), 2))


def macro_values(spark, d) -> DataFrame:
    return series.long_features(macro_wide(spark, d), ["contract_month", "base_month"], MACRO_NAMES, "provisional_flag")


@query("macro_long", "P3 W7", f"WITH {MACRO_LONG} SELECT * FROM macro")
def macro_long(spark, d) -> DataFrame:
    return macro_values(spark, d).orderBy("contract_month", "feature_name")


@query("macro_summary", "A6", f"WITH {MACRO_LONG} SELECT count(*) AS rows, count(DISTINCT contract_month) AS months, min(contract_month) AS first_month, max(contract_month) AS last_month FROM macro")
def macro_summary(spark, d) -> DataFrame:
    return series.build_summary(macro_values(spark, d), "contract_month")


@query("publication_lag_check", "P4 F3", """WITH m AS (
  SELECT DISTINCT l_orderkey, strftime(o_orderdate, '%Y-%m') AS base_month, strftime(l_shipdate, '%Y-%m') AS contract_month,
    strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m') AS expected_month FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT base_month, contract_month, expected_month, count(*) AS rows FROM m WHERE contract_month <> expected_month GROUP BY ALL""")
def publication_lag_check(spark, d) -> DataFrame:
    li = B.table(spark, d, "lineitem").select("l_orderkey", B.month_of(F.col("l_shipdate")).alias("contract_month"))
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), B.month_of(F.col("o_orderdate")).alias("base_month"))
    n = li.count()
    rows = spread(li, n, "l_orderkey").join(spread(o, n, "l_orderkey"), "l_orderkey").distinct()
    return quality.lag_violations(rows, "base_month", "contract_month", 2).groupBy(
        "base_month", "contract_month", "expected_month").agg(F.count("*").alias("rows"))


# ---- rates -----------------------------------------------------------------

RATE_RAW = """rate_months AS (
  SELECT date_trunc('month', l_shipdate) AS m, month(l_shipdate) AS mo, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2), rate_raw AS (
  SELECT strftime(m + INTERVAL 1 MONTH, '%Y-%m') AS contract_month, strftime(m, '%Y-%m') AS base_month, CASE WHEN mo = 4 THEN 'n/a' ELSE CAST(s AS VARCHAR) END AS amount,
    CASE WHEN mo % 4 = 0 THEN 'Y' ELSE 'N' END AS prov, CASE WHEN mo = 7 THEN 'N' ELSE 'Y' END AS avail FROM rate_months), mortgage AS (
  SELECT contract_month, base_month, TRY_CAST(amount AS DOUBLE) AS value, prov = 'Y' AS provisional FROM rate_raw WHERE avail = 'Y' AND TRY_CAST(amount AS DOUBLE) IS NOT NULL)"""


def rate_raw(spark, d) -> DataFrame:
    m = F.month("l_shipdate")
    li = B.table(spark, d, "lineitem").select(B.month_of(F.col("l_shipdate")).alias("base_month"), m.alias("m"), B.won(F.col("l_discount"), 100).alias("v"))
    g = li.groupBy("base_month", "m").agg(F.sum("v").cast("string").alias("s"))
    m = F.col("m")
    return g.select(T.add_months(F.col("base_month"), 1).alias("contract_month"), "base_month", F.when(m == 4, "n/a").otherwise(F.col("s")).alias("amount"),
                    F.when(m % 4 == 0, "Y").otherwise("N").alias("prov"), F.when(m == 7, "N").otherwise("Y").alias("avail"))


def mortgage_values(spark, d) -> DataFrame:
    return series.available_rates(rate_raw(spark, d), "contract_month", "base_month", "amount", "prov", "avail")


@query("mortgage_rate_rows", "P6", f"WITH {RATE_RAW} SELECT * FROM mortgage")
def mortgage_rate_rows(spark, d) -> DataFrame:
    return mortgage_values(spark, d)


# A month's rate is published on the first day anything was shipped in the month
# after it, so publication days are irregular.
FUNDING = """month_rate AS (
  SELECT date_trunc('month', l_shipdate) AS m, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY 1),
fund_raw AS (
  SELECT CASE WHEN month(a.m) = 9 THEN '-' ELSE strftime(b.first_day + 9, '%Y-%m-%d') END AS published, strftime(a.m, '%Y-%m-%d') AS target, CASE WHEN month(a.m) = 2 THEN '' ELSE CAST(a.s AS VARCHAR) END AS amount
  FROM month_rate a JOIN month_rate b ON b.m = a.m + INTERVAL 1 MONTH), funding AS (
  SELECT TRY_CAST(published AS DATE) AS publication_date, substr(target, 1, 7) AS target_month, TRY_CAST(amount AS DOUBLE) AS value FROM fund_raw
  WHERE TRY_CAST(published AS DATE) IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NOT NULL)"""


def fund_raw(spark, d) -> DataFrame:
    m = B.table(spark, d, "lineitem").select(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("m"), F.col("l_shipdate").cast("date").alias("day"),
                                             B.won(F.col("l_discount"), 100).alias("v")).groupBy("m").agg(F.min("day").alias("first_day"), F.sum("v").alias("s"))
    nxt = m.select(F.add_months("m", -1).alias("m"), F.col("first_day").alias("next_day"))
    return m.join(nxt, "m").select(
        F.when(F.month("m") == 9, "-").otherwise(F.date_add("next_day", 9).cast("string")).alias("published"), F.col("m").cast("string").alias("target"),
        F.when(F.month("m") == 2, "").otherwise(F.col("s").cast("string")).alias("amount"))


def funding_values(spark, d) -> DataFrame:
    return series.published_rates(fund_raw(spark, d), "published", "target", "amount")


@query("funding_rate_rows", "P7", f"WITH {FUNDING} SELECT strftime(publication_date, '%Y-%m-%d') AS publication_date, target_month, value FROM funding")
def funding_rate_rows(spark, d) -> DataFrame:
    return funding_values(spark, d).withColumn("publication_date", F.col("publication_date").cast("string"))


# ---- as-of lookups ---------------------------------------------------------

# A series is a stored table, as after a load: it is computed once, and its size is
# known when the contracts are joined to it.
stored = cut_lineage


def probes(spark, d) -> DataFrame:
    return B.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("custkey"), F.col("o_orderdate").cast("date").alias("contract_date"),
        B.month_of(F.col("o_orderdate")).alias("contract_month_asked"))


PROBES = "probes AS (SELECT o_orderkey AS analysis_id, o_custkey AS custkey, CAST(o_orderdate AS DATE) AS contract_date, strftime(o_orderdate, '%Y-%m') AS contract_month_asked FROM orders)"


@query("funding_rate_asof", "J3 W1", f"""WITH {FUNDING}, {PROBES}
SELECT analysis_id, strftime(publication_date, '%Y-%m-%d') AS publication_date, target_month, value FROM probes ASOF LEFT JOIN funding ON contract_date >= publication_date""")
def funding_rate_asof(spark, d) -> DataFrame:
    out = asof.asof_date_join(probes(spark, d), "contract_date", stored(funding_values(spark, d)), "publication_date", ["publication_date", "target_month", "value"])
    return out.select("analysis_id", F.col("publication_date").cast("string").alias("publication_date"), "target_month", "value")


@query("mortgage_rate_asof", "J4", f"""WITH {RATE_RAW}, {PROBES}
SELECT analysis_id, contract_month AS rate_month, base_month, value, provisional FROM probes ASOF LEFT JOIN mortgage ON contract_month_asked >= contract_month""")
def mortgage_rate_asof(spark, d) -> DataFrame:
    return asof.asof_month_join(probes(spark, d), F.col("contract_month_asked"), stored(mortgage_values(spark, d)), "contract_month",
                                ["base_month", "value", "provisional"], mark="rate_month").select("analysis_id", "rate_month", "base_month", "value", "provisional")


def macro_months(spark, d) -> DataFrame:
    return asof.pivot_series(macro_values(spark, d), "contract_month", "feature_name", "value", list(MACRO_NAMES.values()))


MACRO_ASOF = """macro_months AS (SELECT contract_month, max(value) FILTER (feature_name = 'MACRO_ORDER_VALUE') AS v1, max(value) FILTER (feature_name = 'MACRO_ORDER_COUNT') AS v2,
  max(value) FILTER (feature_name = 'MACRO_OPEN_SHARE') AS v3 FROM macro GROUP BY 1)"""


@query("macro_asof", "J5", f"""WITH {MACRO_LONG}, {MACRO_ASOF}, {PROBES}
SELECT analysis_id, contract_month AS macro_month, v1 AS "MACRO_ORDER_VALUE", v2 AS "MACRO_ORDER_COUNT", v3 AS "MACRO_OPEN_SHARE"
FROM probes ASOF LEFT JOIN macro_months ON contract_month_asked >= contract_month""")
def macro_asof(spark, d) -> DataFrame:
    """All features of the newest month; a feature that month lacks stays null."""
    return _macro_join(probes(spark, d), spark, d).select("analysis_id", "macro_month", *MACRO_NAMES.values())


def _macro_join(left: DataFrame, spark, d) -> DataFrame:
    names = list(MACRO_NAMES.values())
    packed = stored(macro_months(spark, d).select("contract_month", F.struct(*names).alias("m")))
    out = asof.asof_month_join(left, F.col("contract_month_asked"), packed, "contract_month", ["m"], mark="macro_month")
    return out.withColumns({n: F.col(f"m.{n}") for n in names}).drop("m")


# Regional index by month: nation level only for some nations, region level for all.
REGION_SERIES = """sales AS (SELECT r_name, n_name, n_nationkey, strftime(o_orderdate, '%Y-%m') AS base_month, CAST(round(o_totalprice * 100) AS BIGINT) AS v, o_orderstatus AS st FROM orders
  JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
region_series AS (
  SELECT r_name || ' > ' || n_name AS region_path, n_name AS region_name, base_month, CAST(sum(v) FILTER (st <> 'P' AND published) AS BIGINT) AS level, CASE WHEN n_nationkey % 2 = 0 THEN CAST(sum(v) FILTER (st = 'O' AND published) AS BIGINT) END AS change
  FROM (SELECT *, n_nationkey % 3 > 0 AND CAST(substr(base_month, 6, 2) AS INTEGER) % 2 = 1 AS published FROM sales) GROUP BY r_name, n_name, n_nationkey, base_month
  UNION ALL SELECT r_name, r_name, base_month, CASE WHEN substr(base_month, 6, 2) NOT IN ('02', '03') THEN CAST(sum(v) AS BIGINT) END, CASE WHEN substr(base_month, 6, 2) NOT IN ('02', '03') THEN CAST(count(*) AS BIGINT) END FROM sales GROUP BY r_name, base_month)"""


def region_sales(spark, d) -> DataFrame:
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = B.table(spark, d, "nation").join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return B.table(spark, d, "orders").join(c, "o_custkey").join(n, "n_nationkey").select(
        "r_name", "n_name", "n_nationkey", B.month_of(F.col("o_orderdate")).alias("base_month"), B.won(F.col("o_totalprice"), 100).alias("v"), F.col("o_orderstatus").alias("st"))


def region_series(spark, d) -> DataFrame:
    s = region_sales(spark, d)
    # A value that was not published is missing, as in the raw files; its orders are read all the same.
    published = (F.col("n_nationkey") % 3 > 0) & (F.substring("base_month", 6, 2).cast("int") % 2 == 1)
    odd = s.groupBy("r_name", "n_name", "n_nationkey", "base_month").agg(
        F.sum(F.when(published & (F.col("st") != "P"), F.col("v"))).alias("level"), F.sum(F.when(published & (F.col("st") == "O"), F.col("v"))).alias("open"))
    low = odd.select(F.concat_ws(" > ", "r_name", "n_name").alias("region_path"), F.col("n_name").alias("region_name"), "base_month", "level",
                     F.when(F.col("n_nationkey") % 2 == 0, F.col("open")).alias("change"))
    on = ~F.substring("base_month", 6, 2).isin("02", "03")
    top = s.groupBy("r_name", "base_month").agg(F.sum(F.when(on, F.col("v"))).alias("level"), F.nullif(F.count_if(on), F.lit(0)).alias("change"))
    return low.unionByName(top.select(F.col("r_name").alias("region_path"), F.col("r_name").alias("region_name"), "base_month", "level", "change"))


def region_probes(spark, d) -> DataFrame:
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = B.table(spark, d, "nation").join(B.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.concat_ws(" > ", "r_name", "n_name").alias("path"))
    return probes(spark, d).join(c, "custkey").join(n, "n_nationkey").drop("n_nationkey")


REGION_PROBES = f"""{PROBES}, region_probes AS (SELECT p.*, r_name || ' > ' || n_name AS path, r_name AS parent FROM probes p JOIN customer ON c_custkey = custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""


def _region_pick(value: str, path: str) -> str:
    return f"(SELECT max_by({value}, base_month) FROM region_series s WHERE s.region_path = p.{path} AND s.base_month <= p.contract_month_asked AND {value} IS NOT NULL)"


REGION_ASOF = f"""region_asof AS (SELECT analysis_id, contract_month_asked, coalesce({_region_pick('level', 'path')}, {_region_pick('level', 'parent')}) AS level,
  CASE WHEN {_region_pick('level', 'path')} IS NOT NULL THEN path WHEN {_region_pick('level', 'parent')} IS NOT NULL THEN parent END AS level_region,
  coalesce({_region_pick('change', 'path')}, {_region_pick('change', 'parent')}) AS change,
  CASE WHEN {_region_pick('change', 'path')} IS NOT NULL THEN path WHEN {_region_pick('change', 'parent')} IS NOT NULL THEN parent END AS change_region FROM region_probes p)"""


@query("region_index_asof", "J6", f"WITH {REGION_SERIES}, {REGION_PROBES}, {REGION_ASOF} SELECT analysis_id, level, level_region, change, change_region FROM region_asof")
def region_index_asof(spark, d) -> DataFrame:
    out = asof.region_asof_join(region_probes(spark, d), F.col("contract_month_asked"), F.col("path"), stored(region_series(spark, d)), "base_month", ["level", "change"], max_depth=2)
    return out.select("analysis_id", "level", "level_region", "change", "change_region")


_KEYED = "s.housing = p.housing AND s.band = p.band AND s.base_month <= p.contract_month_asked AND level IS NOT NULL"
KEYED_SERIES = f"""sized AS (SELECT *, CASE WHEN v < 15000000 THEN 'SMALL' ELSE 'LARGE' END AS band, st AS housing FROM sales), keyed AS (
  SELECT r_name || ' > ' || n_name AS region_path, housing, band, base_month, CASE WHEN n_nationkey % 3 > 0 THEN CAST(sum(v) AS BIGINT) END AS level FROM sized GROUP BY r_name, n_name, n_nationkey, housing, band, base_month
  UNION ALL SELECT r_name, housing, band, base_month, CAST(sum(v) AS BIGINT) FROM sized GROUP BY r_name, housing, band, base_month),
keyed_probes AS (SELECT *, CASE analysis_id % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P' ELSE 'none' END AS housing, CASE WHEN custkey % 2 = 0 THEN 'SMALL' ELSE 'LARGE' END AS band FROM region_probes)"""


@query("region_index_keys", "J6", f"""WITH {REGION_SERIES}, {REGION_PROBES}, {KEYED_SERIES}, picked AS (SELECT analysis_id, path, parent, (SELECT max_by(level, base_month) FROM keyed s WHERE s.region_path = p.path AND {_KEYED}) AS own,
  (SELECT max_by(level, base_month) FROM keyed s WHERE s.region_path = p.parent AND {_KEYED}) AS above FROM keyed_probes p)
SELECT analysis_id, coalesce(own, above) AS level, CASE WHEN own IS NOT NULL THEN path WHEN above IS NOT NULL THEN parent END AS level_region FROM picked""")
def region_index_keys(spark, d) -> DataFrame:
    """The index of a region, housing type and size band; a type without an index gives null."""
    s = region_sales(spark, d).withColumns({"band": F.when(F.col("v") < 15_000_000, "SMALL").otherwise("LARGE"), "housing": F.col("st")})
    low = s.groupBy(F.concat_ws(" > ", "r_name", "n_name").alias("region_path"), "n_nationkey", "housing", "band", "base_month").agg(
        F.sum(F.when(F.col("n_nationkey") % 3 > 0, F.col("v"))).alias("level")).drop("n_nationkey")
    top = s.groupBy(F.col("r_name").alias("region_path"), "housing", "band", "base_month").agg(F.sum("v").alias("level"))
    k = F.col("analysis_id") % 4
    p = region_probes(spark, d).withColumns({
        "asked_housing": F.when(k == 0, "F").when(k == 1, "O").when(k == 2, "P").otherwise("none"),
        "asked_band": F.when(F.col("custkey") % 2 == 0, "SMALL").otherwise("LARGE")})
    out = asof.region_asof_join(p, F.col("contract_month_asked"), F.col("path"), stored(low.unionByName(top)), "base_month", ["level"],
                                keys=[(F.col("asked_housing"), "housing"), (F.col("asked_band"), "band")], max_depth=2)
    return out.select("analysis_id", "level", "level_region")


@query("region_paths", "W2", f"""WITH {REGION_SERIES} SELECT region_name, max_by(region_path, lpad(CAST(length(region_path) AS VARCHAR), 5, '0') || region_path) AS region_path FROM region_series GROUP BY 1""")
def region_paths(spark, d) -> DataFrame:
    return asof.longest_region_path(region_series(spark, d))


@query("market_enrichment", "J7 U2", f"""WITH {REGION_SERIES}, {REGION_PROBES}, {REGION_ASOF}, {FUNDING}, {RATE_RAW}, {MACRO_LONG}, {MACRO_ASOF}, j AS (
  SELECT a.analysis_id, level, f.value AS funding_rate, m.value AS mortgage_rate, v2 AS "MACRO_ORDER_COUNT", m.provisional AS prov, level_region, p.path, k.v1 AS mv
  FROM region_asof a JOIN region_probes p USING (analysis_id)
  ASOF LEFT JOIN funding f ON p.contract_date >= f.publication_date
  ASOF LEFT JOIN mortgage m ON p.contract_month_asked >= m.contract_month
  ASOF LEFT JOIN macro_months k ON p.contract_month_asked >= k.contract_month)
SELECT analysis_id, level, funding_rate, mortgage_rate, "MACRO_ORDER_COUNT", array_to_string(list_sort(list_filter([
  CASE WHEN level IS NULL THEN 'INDEX_UNAVAILABLE' END, CASE WHEN level_region <> path THEN 'INDEX_REGION_FALLBACK' END, CASE WHEN funding_rate IS NULL THEN 'FUNDING_RATE_UNAVAILABLE' END,
  CASE WHEN mortgage_rate IS NULL THEN 'MORTGAGE_RATE_UNAVAILABLE' END, CASE WHEN prov THEN 'MORTGAGE_RATE_PROVISIONAL' END, CASE WHEN mv IS NULL THEN 'MACRO_VALUE_UNAVAILABLE' END], lambda x: x IS NOT NULL)), '|') AS warnings FROM j""")
def market_enrichment(spark, d) -> DataFrame:
    from rentlens.functions import score as S
    df = asof.region_asof_join(region_probes(spark, d), F.col("contract_month_asked"), F.col("path"), stored(region_series(spark, d)), "base_month", ["level"], max_depth=2)
    fund = stored(funding_values(spark, d).withColumnRenamed("value", "funding_rate"))
    df = asof.asof_date_join(df, "contract_date", fund, "publication_date", ["funding_rate"])
    rate = stored(mortgage_values(spark, d).select("contract_month", F.col("value").alias("mortgage_rate"), "provisional"))
    df = asof.asof_month_join(df, F.col("contract_month_asked"), rate, "contract_month", ["mortgage_rate", "provisional"])
    df = _macro_join(df, spark, d)
    warnings = F.array_sort(F.array_distinct(S.codes(
        (F.col("level").isNull(), "INDEX_UNAVAILABLE"), (F.col("level_region") != F.col("path"), "INDEX_REGION_FALLBACK"),
        (F.col("funding_rate").isNull(), "FUNDING_RATE_UNAVAILABLE"), (F.col("mortgage_rate").isNull(), "MORTGAGE_RATE_UNAVAILABLE"),
        (F.col("provisional"), "MORTGAGE_RATE_PROVISIONAL"), (F.col("MACRO_ORDER_VALUE").isNull(), "MACRO_VALUE_UNAVAILABLE"))))
    return df.select("analysis_id", "level", "funding_rate", "mortgage_rate", "MACRO_ORDER_COUNT", B.joined(warnings).alias("warnings"))


# ---- quality ---------------------------------------------------------------

@query("training_profile", "P24", """WITH t AS (
  SELECT CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_quantity AS VARCHAR) END AS a, CASE WHEN l_returnflag = 'R' THEN 'x' ELSE CAST(l_linenumber AS VARCHAR) END AS b,
    CASE WHEN l_discount = 0 THEN 'NaN'::DOUBLE WHEN l_discount = 0.1 THEN 'Infinity'::DOUBLE ELSE l_discount END AS c, CASE WHEN l_linestatus = 'O' THEN l_returnflag END AS d FROM lineitem)
SELECT 'a' AS column_name, count(*) FILTER (a IS NULL) AS nulls, count(*) FILTER (a IS NOT NULL AND TRY_CAST(a AS DOUBLE) IS NULL) AS not_numeric, 0::BIGINT AS not_finite FROM t
UNION ALL SELECT 'b', count(*) FILTER (b IS NULL), count(*) FILTER (b IS NOT NULL AND TRY_CAST(b AS DOUBLE) IS NULL), 0 FROM t
UNION ALL SELECT 'c', count(*) FILTER (c IS NULL), 0, count(*) FILTER (isnan(c) OR isinf(c)) FROM t
UNION ALL SELECT 'd', count(*) FILTER (d IS NULL), 0, 0 FROM t""")
def training_profile(spark, d) -> DataFrame:
    t = B.table(spark, d, "lineitem").select(
        F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("string")).alias("a"),
        F.when(F.col("l_returnflag") == "R", "x").otherwise(F.col("l_linenumber").cast("string")).alias("b"),
        F.when(F.col("l_discount") == 0, float("nan")).when(F.col("l_discount") == 0.1, float("inf")).otherwise(F.col("l_discount")).alias("c"),
        F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("d"))
    return quality.null_profile(t, ["a", "b", "c"], ["d"])


@query("store_checks", "S7", f"""WITH {RATE_RAW}, {FUNDING}
SELECT 'mortgage' AS store, count(*) AS row_count, 'v2' AS version, true AS version_ok, count(*) > 0 AS rows_ok, true AS width_ok FROM mortgage
UNION ALL SELECT 'funding', count(*), 'v1', false, count(*) > 0, false FROM funding""")
def store_checks(spark, d) -> DataFrame:
    """Two stores loaded and read back; the versions are those their metadata names."""
    folder = f"{work_folder(spark)}/stores-{uuid.uuid4().hex}"
    sinks.refresh_table(mortgage_values(spark, d), folder, "mortgage", "v2")
    metadata = sinks.refresh_table(funding_values(spark, d), folder, "funding", "v1")

    def check(store: str) -> DataFrame:
        version = metadata.where(F.col("source_name") == store).select("version").scalar()
        return quality.store_check(sinks.read_current(spark, folder, store), version, "v2", 4).withColumn("store", F.lit(store))
    return check("mortgage").unionByName(check("funding"))


# ---- property reference and matching ---------------------------------------

# District = brand, lot = size (written in several ways), name = part name with stray spaces.
def reference_source(spark, d) -> DataFrame:
    p = B.table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_name", "p_type")
    k = F.col("p_partkey")
    return B.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), "l_linenumber", F.col("l_linestatus").alias("flag")).join(p, "p_partkey").select(
        "flag",
        F.concat(F.lit("  "), F.replace("p_brand", F.lit("#"), F.lit("  　"))).alias("district"),
        F.when(k % 10 == 0, F.concat(F.lit("산"), F.col("p_size").cast("string"))).when(k % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0")))
        .otherwise(F.col("p_size").cast("string")).alias("lot"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string")).otherwise("12345").alias("sub"), "p_type",
        F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))).alias("name"))


REFERENCE = """reference AS (
  SELECT replace(p_brand, '#', ' ') AS district, lpad(CAST(p_size AS VARCHAR), 4, '0') AS bun, '12345' AS ji, p_type AS housing_type, p_name AS model_name, '' AS source_building_name, count(*) AS sample_count
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 10 <> 0 AND l_linenumber <> 7 GROUP BY ALL)"""


def property_reference_rows(spark, d) -> DataFrame:
    src = reference_source(spark, d)
    # Two sources united, as in a build from several files.
    parts = [reference.normalised_rows(src.where(cond).drop("flag"), "p_type", "district", "lot", "sub", "name")
             for cond in (F.col("flag") == "F", F.col("flag") != "F")]
    return reference.count_reference(reduce(DataFrame.unionByName, parts))


@query("property_reference", "A1 P8 U1", f"WITH {REFERENCE} SELECT * FROM reference")
def property_reference(spark, d) -> DataFrame:
    return property_reference_rows(spark, d)


def reference_no_type(spark, d) -> DataFrame:
    src = reference_source(spark, d)
    return reference.count_reference(reference.normalised_rows(
        src.withColumn("kind", F.when(F.col("p_type").isin("PROMO", "LARGE"), "VILLA").otherwise("APARTMENT")), "kind", "district", "lot", "sub", "name"))


REF2 = REFERENCE.replace("p_type AS housing_type", "CASE WHEN p_type IN ('PROMO', 'LARGE') THEN 'VILLA' ELSE 'APARTMENT' END AS housing_type")


@query("parcel_name_ranks", "A2 A3 W3", f"""WITH {REF2}, n AS (SELECT district, bun, ji, housing_type, model_name, CAST(sum(sample_count) AS BIGINT) AS s FROM reference GROUP BY ALL)
SELECT district, bun, ji, housing_type, arg_min(model_name, (-s, model_name)) AS top_name, count(*) AS top_name_names FROM n GROUP BY ALL""")
def parcel_name_ranks(spark, d) -> DataFrame:
    return reference.ranked_names(reference_no_type(spark, d), reference.PARCEL, "top_name")


def match_probes(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return B.table(spark, d, "part").select(
        k.alias("probe_id"), F.when(k % 13 == 0, "Nowhere").otherwise(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("district"),
        T.pad4(F.when(k % 11 == 0, F.col("p_size") + 5000).otherwise(F.col("p_size")).cast("string")).alias("bun"), F.lit("12345").alias("ji"),
        F.when(k % 97 == 0, "OFFICETEL").when(k % 5 == 0, "VILLA").otherwise("APARTMENT").alias("housing_type"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("")))).when(k % 4 == 2, F.concat(F.lit("unseen "), "p_name"))
        .otherwise(" ").alias("observed_name"))


MATCH_PROBES = """probes AS (SELECT p_partkey AS probe_id, CASE WHEN p_partkey % 13 = 0 THEN 'Nowhere' ELSE replace(p_brand, '#', ' ') END AS district,
  lpad(CAST(CASE WHEN p_partkey % 11 = 0 THEN p_size + 5000 ELSE p_size END AS VARCHAR), 4, '0') AS bun, '12345' AS ji,
  CASE WHEN p_partkey % 97 = 0 THEN 'OFFICETEL' WHEN p_partkey % 5 = 0 THEN 'VILLA' ELSE 'APARTMENT' END AS housing_type,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(replace(p_name, ' ', '')) WHEN 2 THEN 'unseen ' || p_name ELSE ' ' END AS observed_name FROM part)"""


@query("parcel_lookup", "J1", f"WITH {REF2}, {MATCH_PROBES} SELECT probe_id, district, bun, ji, housing_type, model_name, sample_count FROM probes LEFT JOIN reference USING (district, bun, ji, housing_type)")
def parcel_lookup(spark, d) -> DataFrame:
    found = match.parcel_lookup(match_probes(spark, d), match.parcel_names(reference_no_type(spark, d)))
    return found.select("probe_id", *reference.PARCEL, F.inline_outer("candidates")).select(
        "probe_id", *reference.PARCEL, "model_name", "sample_count")


@query("property_match", "J2", f"""WITH {REF2}, {MATCH_PROBES}, q AS (SELECT *, trim(coalesce(observed_name, '')) AS actual FROM probes), r AS (
  SELECT probe_id, q.housing_type, q.district, actual, ref.model_name, ref.sample_count, lower(replace(ref.model_name, ' ', '')) = lower(replace(actual, ' ', '')) AS hit
  FROM q LEFT JOIN reference ref USING (district, bun, ji, housing_type)), byname AS (
  SELECT probe_id, any_value(housing_type) AS housing_type, any_value(district) AS district, any_value(actual) AS actual, model_name, CAST(sum(sample_count) AS BIGINT) AS s, bool_or(hit) AS hit FROM r GROUP BY probe_id, model_name), per AS (
  SELECT probe_id, any_value(housing_type) AS housing_type, any_value(district) AS district, any_value(actual) AS actual, count(model_name) AS names, arg_min(model_name, (-s, model_name)) AS top,
    arg_min(model_name, (-s, model_name)) FILTER (hit AND actual <> '') AS named FROM byname GROUP BY probe_id),
dist AS (SELECT district, housing_type, arg_min(model_name, (-s, model_name)) AS dtop FROM (SELECT district, housing_type, model_name, CAST(sum(sample_count) AS BIGINT) AS s FROM reference GROUP BY ALL) GROUP BY ALL),
kind AS (SELECT housing_type, arg_min(model_name, (-s, model_name)) AS ktop FROM (SELECT housing_type, model_name, CAST(sum(sample_count) AS BIGINT) AS s FROM reference GROUP BY ALL) GROUP BY ALL),
m AS (SELECT *, CASE WHEN names = 1 THEN 'parcel' WHEN names > 1 AND named IS NOT NULL THEN 'building_name' WHEN names > 1 AND actual <> '' THEN 'ambiguous_observed_name' WHEN names > 1 THEN 'parcel_frequency'
  WHEN actual <> '' THEN 'unseen_address_name' WHEN dtop IS NOT NULL THEN 'district_frequency' WHEN ktop IS NOT NULL THEN 'type_frequency' ELSE 'no_reference' END AS method
  FROM per LEFT JOIN dist USING (district, housing_type) LEFT JOIN kind USING (housing_type))
SELECT probe_id, method, CASE method WHEN 'parcel' THEN top WHEN 'building_name' THEN named WHEN 'ambiguous_observed_name' THEN actual WHEN 'parcel_frequency' THEN top WHEN 'unseen_address_name' THEN actual
  WHEN 'district_frequency' THEN dtop WHEN 'type_frequency' THEN ktop END AS model_name,
  CASE WHEN method = 'ambiguous_observed_name' THEN 'PROPERTY_REFERENCE_AMBIGUOUS|UNSEEN_PROPERTY_NAME' WHEN method = 'parcel_frequency' THEN 'PROPERTY_REFERENCE_AMBIGUOUS|PROPERTY_NAME_FALLBACK'
    WHEN method = 'unseen_address_name' THEN 'UNSEEN_PROPERTY_NAME' WHEN method IN ('district_frequency', 'type_frequency') THEN 'PROPERTY_REFERENCE_NOT_FOUND|PROPERTY_NAME_FALLBACK' ELSE '' END AS warnings FROM m""")
def property_match(spark, d) -> DataFrame:
    return match.match_names(match_probes(spark, d), cut_lineage(reference_no_type(spark, d))).select(
        "probe_id", "method", "model_name", B.joined(F.col("warnings")).alias("warnings"))
