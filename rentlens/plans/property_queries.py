"""Queries of the feature, valuation, property and watchlist families."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators import checklist, features, property as prop, scoring, valuation, watchlist
from rentlens.plans import bindings as B
from rentlens.plans.catalog import query
from rentlens.session import cut_lineage, work_folder
from rentlens.sources import sinks

# ---- model routing, assembly, fallbacks -------------------------------------

HOUSE_SQL = "CASE p_type WHEN 'ECONOMY' THEN 'APARTMENT' WHEN 'SMALL' THEN 'VILLA' WHEN 'MEDIUM' THEN 'OFFICETEL' WHEN 'PROMO' THEN 'DETACHED_MULTI' WHEN 'LARGE' THEN 'APARTMENT' ELSE 'OTHER' END"


def house(c: Column) -> Column:
    return (F.when(c == "ECONOMY", "APARTMENT").when(c == "SMALL", "VILLA").when(c == "MEDIUM", "OFFICETEL").when(c == "PROMO", "DETACHED_MULTI")
            .when(c == "LARGE", "APARTMENT").otherwise("OTHER"))


def houses(spark, d) -> DataFrame:
    return B.table(spark, d, "part").withColumn("housing_type", house(F.col("p_type")))


_SUFFIX_SQL = "CASE housing_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in features.MODEL_SUFFIX.items()) + " END"


@query("model_routing", "P16", f"""WITH h AS (SELECT p_partkey, {HOUSE_SQL} AS housing_type FROM part), s AS (SELECT p_partkey, housing_type, {_SUFFIX_SQL} AS suffix FROM h)
SELECT p_partkey, housing_type, k.kind AS model_kind, k.pre || suffix AS model_key FROM s, (VALUES ('SALE', '매매_'), ('LEASE', '전세_')) k(kind, pre) WHERE suffix IS NOT NULL""")
def model_routing(spark, d) -> DataFrame:
    return features.per_model(houses(spark, d).select("p_partkey", "housing_type"))


@query("property_details", "P17 P18", f"""WITH h AS (SELECT *, {HOUSE_SQL} AS housing_type FROM part), x AS (
  SELECT p_partkey, housing_type, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS ex, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice / 10 END AS unit_area,
    CASE WHEN p_partkey % 5 = 0 THEN p_size - 3 END AS fl, p_size AS unit_floor, CASE WHEN p_partkey % 6 = 0 THEN (p_size - 4)::DOUBLE END AS ca,
    CASE WHEN p_partkey % 9 = 0 THEN '  ' ELSE ' ' || p_name || ' ' END AS nm, CASE p_partkey % 3 WHEN 0 THEN '다가구주택' WHEN 1 THEN '단독주택' ELSE '창고' END AS etc FROM h)
SELECT p_partkey, coalesce(ex, unit_area) AS exclusive_area, coalesce(fl, unit_floor) AS floor, ca AS contract_area,
  CASE WHEN housing_type = 'VILLA' THEN nullif(trim(nm), '') END AS building_name, CASE WHEN housing_type <> 'VILLA' THEN nullif(trim(nm), '') END AS complex_name,
  array_to_string(list_filter([CASE WHEN ex <= 0 THEN 'EXCLUSIVE_NOT_POSITIVE' END, CASE WHEN ca <= 0 THEN 'CONTRACT_NOT_POSITIVE' END], lambda z: z IS NOT NULL), '|') AS rejects,
  CASE WHEN housing_type = 'DETACHED_MULTI' THEN CASE WHEN contains(etc, '다가구') THEN '다가구' WHEN contains(etc, '단독') THEN '단독' END END AS sale_label,
  CASE WHEN housing_type = 'DETACHED_MULTI' THEN '단독다가구' END AS lease_label FROM x""")
def property_details(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    x = houses(spark, d).select(
        "p_partkey", "housing_type", F.when(k % 3 == 0, F.col("p_size").cast("double")).alias("ex"), F.when(k % 4 > 0, F.col("p_retailprice") / 10).alias("unit_area"),
        F.when(k % 5 == 0, F.col("p_size") - 3).alias("fl"), F.col("p_size").alias("unit_floor"), F.when(k % 6 == 0, (F.col("p_size") - 4).cast("double")).alias("ca"),
        F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("nm"),
        F.when(k % 3 == 0, "다가구주택").when(k % 3 == 1, "단독주택").otherwise("창고").alias("etc"))
    c = features.detail_columns(F.col("ex"), F.col("ca"), F.lit(None).cast("double"), F.col("fl"), F.col("unit_area"), F.col("unit_floor"), F.col("housing_type"), F.col("nm"))
    detached = F.col("housing_type") == "DETACHED_MULTI"
    label = lambda kind: F.when(detached, prop.detached_label(F.lit(kind), F.col("etc"), F.lit("")))
    return x.select(
        "p_partkey", c["전용면적(㎡)"].alias("exclusive_area"), c["층"].alias("floor"), c["계약면적(㎡)"].alias("contract_area"), c["건물명"].alias("building_name"),
        c["단지명"].alias("complex_name"), B.joined(features.area_reject(exclusive=F.col("ex"), contract=F.col("ca"))).alias("rejects"),
        label("SALE").alias("sale_label"), label("LEASE").alias("lease_label"))


@query("derived_features", "P19", """WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN p_size % 7 > 0 THEN 1950 + p_size END AS approval, p_retailprice AS gross,
  CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 5 = 1 THEN NULL ELSE p_size::DOUBLE END AS land FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(month(l_shipdate) AS INTEGER) AS contract_month, CAST(year(l_shipdate) - approval AS INTEGER) AS building_age, CASE WHEN land <> 0 THEN gross / land END AS area_ratio FROM x""")
def derived_features(spark, d) -> DataFrame:
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", "p_retailprice")
    s = F.col("p_size")
    x = B.table(spark, d, "lineitem").join(p, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.when(s % 7 > 0, s + 1950).alias("approval"), F.col("p_retailprice").alias("gross"),
        F.when(s % 5 == 0, 0.0).when(s % 5 == 1, F.lit(None).cast("double")).otherwise(s.cast("double")).alias("land")).distinct()
    c = features.derived_columns(F.col("l_shipdate"), F.col("approval"), F.col("gross"), F.col("land"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", c["계약월"].alias("contract_month"), c["최종건축연령"].alias("building_age"),
                    c["대지대비연면적비율_파생"].alias("area_ratio"))


# Feature rows: numbers as doubles, categories as text, with gaps of every kind.
FEATURES = ["price", "size", "age", "name", "kind", "대지권면적(㎡)"]
CATEGORICAL = ["name", "kind"]
FEATURE_ROWS = f"""feature_rows AS (SELECT p_partkey, 'M_' || p_type AS model_key,
  CASE WHEN p_partkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN p_partkey % 11 = 0 THEN 'Infinity'::DOUBLE ELSE p_retailprice END AS price,
  CASE WHEN p_partkey % 5 > 0 THEN p_size::DOUBLE END AS size, p_partkey % 2 = 0 AS age,
  CASE WHEN p_partkey % 6 = 0 THEN '   ' WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS name, CAST(p_partkey % 4 AS BIGINT) AS kind, NULL::DOUBLE AS "대지권면적(㎡)" FROM part)"""
DEFAULTS = """num AS (SELECT model_key, quantile_cont(price, 0.5) FILTER (isfinite(price)) AS price, quantile_cont(size, 0.5) AS size FROM feature_rows GROUP BY 1),
cats AS (SELECT model_key, trim(name) AS v, count(*) AS n FROM feature_rows WHERE trim(name) <> '' GROUP BY ALL), cat AS (SELECT model_key, arg_min(v, (-n, v)) AS name FROM cats GROUP BY 1),
kinds AS (SELECT model_key, CAST(kind AS VARCHAR) AS v, count(*) AS n FROM feature_rows GROUP BY ALL), kin AS (SELECT model_key, arg_min(v, (-n, v)) AS kind FROM kinds GROUP BY 1)"""


def feature_rows(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return B.table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("M_"), "p_type").alias("model_key"),
        F.when(k % 7 == 0, float("nan")).when(k % 11 == 0, float("inf")).otherwise(F.col("p_retailprice")).alias("price"),
        F.when(k % 5 > 0, F.col("p_size").cast("double")).alias("size"), (k % 2 == 0).alias("age"),
        F.when(k % 6 == 0, "   ").when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("name"), (k % 4).alias("kind"),
        F.lit(None).cast("double").alias("대지권면적(㎡)"))


def defaults(spark, d) -> DataFrame:
    return features.training_defaults(feature_rows(spark, d), "model_key", ["price", "size"], ["name", "kind"])


@query("training_defaults", "A4 A5 S15", f"""WITH {FEATURE_ROWS}, {DEFAULTS}
SELECT model_key, 'price' AS feature, price AS number, NULL::VARCHAR AS text FROM num UNION ALL SELECT model_key, 'size', size, NULL FROM num
UNION ALL SELECT model_key, 'name', NULL, name FROM cat UNION ALL SELECT model_key, 'kind', NULL, kind FROM kin""")
def training_defaults(spark, d) -> DataFrame:
    numeric = F.col("feature").isin("price", "size")
    return defaults(spark, d).select("model_key", "feature", F.when(numeric, F.col("value").cast("double")).alias("number"), F.when(~numeric, F.col("value")).alias("text"))


@query("feature_vectors", "P20 P21 J11", f"""WITH {FEATURE_ROWS}, {DEFAULTS}, x AS (SELECT f.*, n.price AS dp, n.size AS ds, c.name AS dn, k.kind AS dk FROM feature_rows f JOIN num n USING (model_key) JOIN cat c USING (model_key) JOIN kin k USING (model_key))
SELECT p_partkey, model_key, CASE WHEN isfinite(price) THEN price ELSE dp END AS price, coalesce(size, ds) AS size, -1.0::DOUBLE AS age, CASE WHEN trim(name) <> '' THEN name ELSE dn END AS name,
  CASE WHEN kind <> 0 THEN CAST(kind AS VARCHAR) ELSE dk END AS kind, -2.0::DOUBLE AS "대지권면적(㎡)",
  array_to_string(list_filter([CASE WHEN NOT isfinite(price) THEN 'price' END, CASE WHEN size IS NULL THEN 'size' END, 'age', CASE WHEN coalesce(trim(name), '') = '' THEN 'name' END, CASE WHEN kind = 0 THEN 'kind' END], lambda z: z IS NOT NULL), '|') AS fallback_features,
  '대지권면적(㎡)' AS unavailable_features FROM x""")
def feature_vectors(spark, d) -> DataFrame:
    # Defaults are a stored table of one row per model, small enough to be broadcast.
    wide = features.default_columns(cut_lineage(defaults(spark, d)), ["price", "size", "name", "kind"], CATEGORICAL).withColumns(
        {"default_age": F.lit(-1.0), "default_대지권면적(㎡)": F.lit(-2.0)})
    out = features.with_fallbacks(feature_rows(spark, d).join(wide, "model_key"), FEATURES, CATEGORICAL)
    return out.select("p_partkey", "model_key", *FEATURES, B.joined(F.col("fallback_features")).alias("fallback_features"),
                      B.joined(F.col("unavailable_features")).alias("unavailable_features"))


# Two contracts of different width: by the length of the type's name.
WIDE, NARROW = ["size", "kind", "price", "name", "age", "대지권면적(㎡)"], ["price", "name", "대지권면적(㎡)"]
CONTRACT = f"""contract AS (SELECT model_key, CAST(unnest(range(len(names))) AS INTEGER) AS ordinal, unnest(names) AS feature FROM (SELECT DISTINCT 'M_' || p_type AS model_key,
  CASE WHEN length(p_type) % 2 = 0 THEN {WIDE} ELSE {NARROW} END AS names FROM part))"""


def feature_contract(spark, d) -> DataFrame:
    names = lambda ns: F.array(*[F.lit(n) for n in ns])
    wide = F.length("p_type") % 2 == 0
    return B.table(spark, d, "part").select("p_type").distinct().select(
        F.concat(F.lit("M_"), "p_type").alias("model_key"), F.when(wide, names(WIDE)).otherwise(names(NARROW)).alias("features"),
        F.when(wide, names(["kind", "name"])).otherwise(names(["name"])).alias("categorical_features"))


@query("contract_vectors", "P20 P21 S15 J11", f"""WITH {FEATURE_ROWS}, {DEFAULTS}, {CONTRACT}, x AS (SELECT f.*, n.price AS dp, n.size AS ds, c.name AS dn, k.kind AS dk FROM feature_rows f JOIN num n USING (model_key) JOIN cat c USING (model_key) JOIN kin k USING (model_key)),
v AS (SELECT p_partkey, model_key, ordinal, feature, CASE feature WHEN 'price' THEN CASE WHEN isfinite(price) THEN price END WHEN 'size' THEN size END AS n, CASE feature WHEN 'name' THEN CASE WHEN trim(name) <> '' THEN name END WHEN 'kind' THEN CASE WHEN kind <> 0 THEN CAST(kind AS VARCHAR) END END AS t,
  CASE feature WHEN 'price' THEN dp WHEN 'size' THEN ds WHEN 'age' THEN -1.0::DOUBLE WHEN '대지권면적(㎡)' THEN -2.0::DOUBLE END AS fn, CASE feature WHEN 'name' THEN dn WHEN 'kind' THEN dk END AS ft FROM x JOIN contract USING (model_key))
SELECT p_partkey, model_key, ordinal, feature, coalesce(n, fn) AS number, coalesce(t, ft) AS text, n IS NULL AND t IS NULL AS fallback, n IS NULL AND t IS NULL AND feature = '대지권면적(㎡)' AS unavailable FROM v""")
def contract_vectors(spark, d) -> DataFrame:
    rows = model_vectors(spark, d).select("p_partkey", "model_key", "unavailable_features", F.inline("vector"))
    return rows.select("p_partkey", "model_key", "ordinal", "feature", "number", "text", "fallback",
                       F.array_contains("unavailable_features", F.col("feature")).alias("unavailable"))


@query("vector_reliability", "P35 P21", f"""WITH {FEATURE_ROWS}, v AS (SELECT *, length(model_key) % 2 = 0 AS wide, NOT isfinite(price) OR coalesce(trim(name), '') = '' AS short FROM feature_rows)
SELECT p_partkey, CASE WHEN short OR wide THEN 'LOW' ELSE 'MEDIUM' END AS reliability, CAST(NOT isfinite(price) AS INT) + CAST(coalesce(trim(name), '') = '' AS INT) + CASE WHEN wide THEN CAST(size IS NULL AS INT) + CAST(kind = 0 AS INT) + 1 ELSE 0 END AS fallbacks,
  'LAND_RIGHT_AREA_UNAVAILABLE' AS warnings FROM v""")
def vector_reliability(spark, d) -> DataFrame:
    """Reliability of each row's vector from the defaults that it really took, and the warnings of features without a source."""
    out = model_vectors(spark, d).withColumn("warnings", features.unavailable_warnings(F.col("unavailable_features")))
    return out.select("p_partkey", scoring.valuation_reliability(F.col("fallback_features"), F.col("warnings")).alias("reliability"),
                      F.size("fallback_features").alias("fallbacks"), B.joined(F.col("warnings")).alias("warnings"))


def model_vectors(spark, d) -> DataFrame:
    """Vectors as each model's contract lists them, with the defaults written to their file and read back."""
    contract = cut_lineage(feature_contract(spark, d))
    fixed = contract.select("model_key", F.explode(F.create_map(F.lit("age"), F.lit("-1.0"), F.lit("대지권면적(㎡)"), F.lit("-2.0"))).alias("feature", "value"))
    path = f"{work_folder(spark)}/defaults-{uuid.uuid4().hex}.json"
    features.write_defaults(defaults(spark, d).unionByName(fixed), path, "train-v1", "1", CATEGORICAL)
    policy = cut_lineage(features.feature_policy(contract, features.read_defaults(spark, path)))
    return features.contract_vectors(feature_rows(spark, d), policy, FEATURES)


# A feature contract made of the parts of each brand: names, flags and counts vary.
_FEATURE_NAME = ("CASE p_partkey % 14 WHEN 0 THEN '시군구' WHEN 1 THEN '주택유형' WHEN 2 THEN '층' WHEN 3 THEN '단지명' WHEN 4 THEN '건축물대장_' || p_type WHEN 5 THEN 'RONE_' || p_type WHEN 6 THEN '신규취급액기준_COFIX' "
                 "WHEN 7 THEN 'ECOS_' || p_type WHEN 8 THEN 'KOSIS_' || p_type WHEN 9 THEN '계약월' WHEN 10 THEN '연면적(㎡)' ELSE p_name END")


def _feature_name() -> Column:
    k = F.col("p_partkey") % 14
    plus = lambda p: F.concat(F.lit(p), "p_type")
    e = F.when(k == 0, "시군구").when(k == 1, "주택유형").when(k == 2, "층").when(k == 3, "단지명").when(k == 4, plus("건축물대장_")).when(k == 5, plus("RONE_"))
    return e.when(k == 6, "신규취급액기준_COFIX").when(k == 7, plus("ECOS_")).when(k == 8, plus("KOSIS_")).when(k == 9, "계약월").when(k == 10, "연면적(㎡)").otherwise(F.col("p_name"))


@query("feature_sources", "P22 A15", f"""WITH n AS (SELECT {_FEATURE_NAME} AS f FROM part)
SELECT CASE WHEN f = '시군구' THEN 'address' WHEN f = '주택유형' THEN 'property_resolver' WHEN f = '층' THEN 'property_detail' WHEN f = '단지명' THEN 'property_match' WHEN f LIKE '건축물대장%' OR f = '연면적(㎡)' THEN 'building_ledger'
  WHEN f LIKE 'RONE%' THEN 'rone' WHEN f LIKE '%COFIX' THEN 'cofix' WHEN f LIKE 'ECOS%' THEN 'ecos' WHEN f LIKE 'KOSIS%' THEN 'kosis' WHEN f = '계약월' THEN 'derived' ELSE 'unresolved' END AS source, count(*) AS features FROM n GROUP BY 1""")
def feature_sources(spark, d) -> DataFrame:
    return B.table(spark, d, "part").select(features.feature_source(_feature_name()).alias("source")).groupBy("source").agg(F.count("*").alias("features"))


CONTRACT = """contract AS (SELECT p_brand || '/' || p_type AS model_key, count(*) - CASE WHEN max(p_size) = 50 THEN 1 ELSE 0 END AS feature_count, list(p_name) AS features, list(CASE WHEN p_partkey % 15 = 0 THEN 'other' ELSE p_name END) AS categorical_features,
  list(CASE WHEN p_partkey % 6 = 0 THEN p_name ELSE 'gone' END) AS inactive_features FROM part GROUP BY 1)"""


def contract(spark, d) -> tuple[DataFrame, DataFrame]:
    k = F.col("p_partkey")
    p = B.table(spark, d, "part").withColumn("model_key", F.concat_ws("/", "p_brand", "p_type"))
    roles = F.array(
        F.struct(F.col("p_name").alias("feature"), F.lit("active").alias("role")),
        F.struct(F.when(k % 15 == 0, "other").otherwise(F.col("p_name")).alias("feature"), F.lit("categorical").alias("role")),
        F.struct(F.when(k % 6 == 0, F.col("p_name")).otherwise("gone").alias("feature"), F.lit("inactive").alias("role")))
    counts = p.groupBy("model_key").agg((F.count("*") - F.when(F.max("p_size") == 50, 1).otherwise(0)).alias("feature_count"))
    return p.select("model_key", F.inline(roles)), counts


@query("contract_checks", "P23 U3", f"""WITH {CONTRACT}
SELECT model_key, 'COUNT_MISMATCH' AS problem FROM contract WHERE feature_count <> len(features) UNION ALL SELECT model_key, 'DUPLICATE_FEATURE' FROM contract WHERE len(list_distinct(features)) <> len(features)
UNION ALL SELECT model_key, 'CATEGORICAL_NOT_ACTIVE' FROM contract WHERE NOT list_has_all(features, categorical_features) UNION ALL SELECT model_key, 'ACTIVE_AND_INACTIVE' FROM contract WHERE list_has_any(features, inactive_features)""")
def contract_checks(spark, d) -> DataFrame:
    return features.contract_violations(*contract(spark, d))


# ---- valuation -------------------------------------------------------------

@query("price_targets", "R1 R2", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS area, ln(l_extendedprice * 10000) AS t, ln(l_extendedprice * 10000 / l_quantity) AS u, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(t, 9) AS total_target, round(u, 9) AS unit_target, CAST(round_even(exp(t) / 100, 0) AS BIGINT) AS price_total,
  CASE WHEN l_linenumber <> 3 THEN CAST(round_even(exp(u) * area / 100, 0) AS BIGINT) END AS price_from_unit, CASE WHEN l_linenumber = 3 THEN 'AREA_NOT_POSITIVE' END AS price_reject FROM x""")
def price_targets(spark, d) -> DataFrame:
    # Prices are compared in units of 100 won: exp and ln differ in the last bit between engines.
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    area = F.when(F.col("l_linenumber") == 3, 0.0).otherwise(q)
    total, unit = valuation.log_target(p), valuation.log_target(p, q)
    whole, parts = valuation.price_columns(total), valuation.price_columns(unit, area)
    hundred = lambda c: F.rint(c / 100).cast("long")
    return B.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(total, 9).alias("total_target"), F.round(unit, 9).alias("unit_target"),
        hundred(whole["total_price"]).alias("price_total"), hundred(parts["total_price"]).alias("price_from_unit"), parts["price_reject"].alias("price_reject"))


@query("price_model", "R3")
def price_model(spark, d) -> DataFrame:
    """Prices every line item by a unit-price model fitted on the orders of the other fold."""
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size", "p_retailprice")
    rows = B.table(spark, d, "lineitem").join(p, "l_partkey").select(
        "l_orderkey", "l_linenumber", F.pmod("l_orderkey", F.lit(2)).alias("fold"), F.col("l_quantity").alias("area"), F.month("l_shipdate").alias("month"), "l_discount", "l_tax", "p_size", "p_retailprice",
        "p_brand", "p_type", valuation.log_target(F.col("l_extendedprice"), F.col("l_quantity")).alias("label"))
    numbers, names = ["area", "month", "l_discount", "l_tax", "p_size", "p_retailprice"], ["p_brand", "p_type"]
    models = [valuation.fit_price_model(rows.where(F.col("fold") != k), numbers, names) for k in (0, 1)]
    priced = [valuation.estimate(m, rows.where(F.col("fold") == k), "area") for k, m in enumerate(models)]
    return priced[0].unionByName(priced[1]).select("l_orderkey", "l_linenumber", "prediction", "unit_price", "total_price", "estimated_price", "price_reject")


# Eight models, sales and leases of four kinds: lists of different length, prices per area for sales of the first two kinds.
_MODEL_NUMBERS = ["area", "month", "l_discount", "l_tax", "p_size", "p_retailprice"]
_MODEL_KEY = "CASE WHEN l_orderkey % 2 = 0 THEN 'SALE_' ELSE 'LEASE_' END || p_size % 4"


def model_contract(spark) -> DataFrame:
    rows = []
    for i in range(4):
        names = ["p_brand", "p_type"][:1 + i % 2]
        rows.append((f"SALE_{i}", _MODEL_NUMBERS[:3 + i] + names, names, "area" if i < 2 else None))
        rows.append((f"LEASE_{i}", _MODEL_NUMBERS[i:] + names[:1], names[:1], "area"))
    return spark.createDataFrame(rows, "model_key string, features array<string>, categorical_features array<string>, area_feature string")


def model_rows(spark, d) -> DataFrame:
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", "p_size", "p_retailprice")
    key = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "SALE_").otherwise("LEASE_"), (F.col("p_size") % 4).cast("string"))
    return B.table(spark, d, "lineitem").join(p, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", key.alias("model_key"), F.col("l_quantity").alias("area"), F.month("l_shipdate").alias("month"), "l_discount", "l_tax",
        "p_size", "p_retailprice", "p_brand", "p_type", F.col("l_extendedprice").alias("price"))


@query("price_models", "R3")
def price_models(spark, d) -> DataFrame:
    """Fits and saves the eight models of a contract, reads the registry again, and prices every line item by its key's model."""
    folder = f"{work_folder(spark)}/models-{uuid.uuid4().hex}"
    rows = cut_lineage(model_rows(spark, d))
    valuation.fit_models(rows, model_contract(spark), folder, "v1", learner="linear")
    registry = valuation.read_registry(spark, folder, "v1")
    priced = valuation.price_by_model(valuation.predict_by_model(rows, registry), registry)
    return priced.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "model_key", "prediction", "unit_price", "total_price", "estimated_price", "price_reject")


@query("model_prices", "R2 R3", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 6 THEN 'OTHER' ELSE {_MODEL_KEY} END AS model_key, CASE WHEN l_linenumber = 3 THEN 0.0 ELSE l_quantity END AS area,
  CASE WHEN l_linenumber = 5 THEN 'Infinity'::DOUBLE ELSE ln(l_extendedprice * 10000) - CASE WHEN l_orderkey % 2 = 1 OR p_size % 4 < 2 THEN ln(l_quantity) ELSE 0 END END AS y FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT *, model_key <> 'OTHER' AND model_key NOT IN ('SALE_2', 'SALE_3') AS per_area, CASE WHEN model_key = 'OTHER' THEN 'MODEL_NOT_FOUND' WHEN NOT isfinite(y) THEN 'PREDICTION_NOT_FINITE'
  WHEN model_key NOT IN ('SALE_2', 'SALE_3') AND area <= 0 THEN 'AREA_NOT_POSITIVE' END AS price_reject FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, model_key, CASE WHEN price_reject IS NULL AND per_area THEN CAST(round_even(exp(y) / 100 + 0.137, 0) AS BIGINT) END AS unit_hundreds,
  CASE WHEN price_reject IS NULL THEN CAST(round_even(exp(y) * CASE WHEN per_area THEN area ELSE 1 END / 100 + 0.137, 0) AS BIGINT) END AS total_hundreds, price_reject FROM k""")
def model_prices(spark, d) -> DataFrame:
    """From given predictions to prices by each model's own target kind, compared in units of 100 won; the offset keeps
    values off binary ties, which engines round differently."""
    registry = [valuation.ModelEntry(r["model_key"], "v1", tuple(r["features"]), tuple(r["categorical_features"]), r["area_feature"], "") for r in model_contract(spark).collect()]
    n, area = F.col("l_linenumber"), F.col("area")
    per_area = (F.col("l_orderkey") % 2 == 1) | (F.col("p_size") % 4 < 2)
    y = F.when(n == 5, float("inf")).otherwise(F.log(F.col("price") * 10000) - F.when(per_area, F.log(area)).otherwise(0.0))
    rows = model_rows(spark, d).withColumn("prediction", y).withColumns({"model_key": F.when(n == 6, "OTHER").otherwise(F.col("model_key")), "area": F.when(n == 3, 0.0).otherwise(area)})
    hundred = lambda c: F.rint(F.col(c) / 100 + 0.137).cast("long")
    return valuation.price_by_model(rows, registry).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "model_key", hundred("unit_price").alias("unit_hundreds"),
                                                           hundred("total_price").alias("total_hundreds"), "price_reject")


# ---- address and ledger rows ------------------------------------------------

_SI = ["서울특별시", "부산광역시", "경기도", "강원도", "제주특별자치도"]
ADDRESS = """addr AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 10000000000 AS VARCHAR), 10, '0') AS code, CASE c_nationkey % 5 WHEN 0 THEN '서울특별시' WHEN 1 THEN '부산광역시' WHEN 2 THEN '경기도' WHEN 3 THEN '강원도' ELSE '제주특별자치도' END AS si,
  CASE WHEN c_custkey % 10 = 0 THEN '' ELSE '강남구' END AS sgg, '테스트동' AS emd, CASE WHEN c_custkey % 6 = 0 THEN '리' ELSE '' END AS li, CAST(c_custkey % 20000 AS VARCHAR) AS bun, CAST(c_custkey % 50 AS VARCHAR) AS ji,
  CAST(c_custkey % 2 AS VARCHAR) AS mt, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment || ' 아파트' ELSE '' END AS bd, CASE WHEN c_custkey % 3 > 0 THEN '101동, 102동,,상가동' ELSE '' END AS dongs FROM customer)"""


def addresses(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    si = F.coalesce(*[F.when(F.col("c_nationkey") % 5 == i, n) for i, n in enumerate(_SI)])
    return B.table(spark, d, "customer").select(
        "c_custkey", F.lpad((k * 7919 % 10_000_000_000).cast("string"), 10, "0").alias("admCd"), si.alias("siNm"), F.when(k % 10 == 0, "").otherwise("강남구").alias("sggNm"),
        F.lit("테스트동").alias("emdNm"), F.when(k % 6 == 0, "리").otherwise("").alias("liNm"), (k % 20000).cast("string").alias("lnbrMnnm"), (k % 50).cast("string").alias("lnbrSlno"),
        (k % 2).cast("string").alias("mtYn"), F.when(k % 4 > 0, F.concat("c_mktsegment", F.lit(" 아파트"))).otherwise("").alias("bdNm"),
        F.when(k % 3 > 0, "101동, 102동,,상가동").otherwise("").alias("detBdNmList"))


@query("address_keys", "P12", f"""WITH {ADDRESS}
SELECT c_custkey, code AS legal_dong_code, substr(code, 1, 5) AS sigungu_code, substr(code, 6, 5) AS bjdong_code, CASE WHEN mt = '1' THEN '1' ELSE '0' END AS plat_code, CASE WHEN length(bun) >= 4 THEN bun ELSE lpad(bun, 4, '0') END AS bun,
  lpad(ji, 4, '0') AS ji, concat_ws(' ', nullif(si, ''), nullif(sgg, ''), nullif(emd, ''), nullif(li, '')) AS district, nullif(bd, '') AS building_name, CASE WHEN dongs = '' THEN '' ELSE '101동|102동|상가동' END AS available_dongs FROM addr""")
def address_keys(spark, d) -> DataFrame:
    a = addresses(spark, d)
    cols = prop.address_keys({c: F.col(c) for c in a.columns if c != "c_custkey"})
    cols["available_dongs"] = B.joined(cols["available_dongs"])
    return a.select("c_custkey", *[c.alias(n) for n, c in cols.items()])


@query("address_regions", "P10", f"""WITH {ADDRESS}, a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN si || ' ' || sgg || ' 반여동 1-2' WHEN 1 THEN '대전 동구 동서대로 ' || c_custkey WHEN 2 THEN '미국도 하와이시 ' || c_custkey ELSE c_mktsegment END AS address FROM addr JOIN customer USING (c_custkey)), m AS (
  SELECT *, regexp_extract(address, '([가-힣]+(?:특별시|광역시|특별자치시|특별자치도|도))\\s*([가-힣]+?[시군구])', 1) AS l1, regexp_extract(address, '([가-힣]+(?:특별시|광역시|특별자치시|특별자치도|도))\\s*([가-힣]+?[시군구])', 2) AS l2,
    regexp_extract(address, '([가-힣]{{2,3}})\\s*([가-힣]+?[시군구])', 1) AS s1, regexp_extract(address, '([가-힣]{{2,3}})\\s*([가-힣]+?[시군구])', 2) AS s2 FROM a)
SELECT c_custkey, CASE WHEN l1 <> '' THEN substr(l1, 1, 2) || ' ' || l2 WHEN s1 <> '' THEN s1 || ' ' || s2 END AS region FROM m""")
def address_regions(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    a = addresses(spark, d).join(B.table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    address = (F.when(k % 4 == 0, F.concat("siNm", F.lit(" "), "sggNm", F.lit(" 반여동 1-2"))).when(k % 4 == 1, F.concat(F.lit("대전 동구 동서대로 "), k.cast("string")))
               .when(k % 4 == 2, F.concat(F.lit("미국도 하와이시 "), k.cast("string"))).otherwise(F.col("c_mktsegment")))
    return a.select("c_custkey", T.region_of(address).alias("region"))


@query("ledger_titles", "P13 P14", """WITH t AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE CAST(p_retailprice AS VARCHAR) END AS tot, CASE WHEN p_partkey % 5 = 0 THEN '0' WHEN p_partkey % 7 = 0 THEN '-' ELSE CAST(p_size AS VARCHAR) END AS plat,
  CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CAST(1950 + p_size AS VARCHAR) || '0312' END AS apr, CAST(p_partkey % 4 AS VARCHAR) AS ride, CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE '' END AS emg, CAST(p_size AS VARCHAR) AS hh, CAST(p_partkey % 60 AS VARCHAR) AS fm,
  CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE 'Y' END AS seis FROM part), c AS (
  SELECT p_partkey, CASE WHEN TRY_CAST(tot AS DOUBLE) > 0 THEN TRY_CAST(tot AS DOUBLE) END AS gross_area, CASE WHEN TRY_CAST(plat AS DOUBLE) > 0 THEN TRY_CAST(plat AS DOUBLE) END AS land_area, TRY_CAST(substr(apr, 1, 4) AS INTEGER) AS approval_year,
    TRY_CAST(ride AS INTEGER) AS passenger_lifts, TRY_CAST(emg AS INTEGER) AS emergency_lifts, greatest(TRY_CAST(hh AS INTEGER), TRY_CAST(fm AS INTEGER)) AS households,
    CASE WHEN coalesce(TRY_CAST(ride AS INTEGER), 0) + coalesce(TRY_CAST(emg AS INTEGER), 0) > 0 THEN 1 ELSE 0 END AS has_lift, nullif(trim(seis), '') AS seismic_design, p_name AS structure FROM t)
SELECT *, array_to_string(list_filter([CASE WHEN land_area IS NULL THEN 'LAND_AREA_MISSING' END, CASE WHEN gross_area IS NULL THEN 'GROSS_AREA_MISSING' END], lambda z: z IS NOT NULL), '|') AS blocking,
  array_to_string(list_filter([CASE WHEN seismic_design IS NULL THEN 'SEISMIC_DESIGN_UNKNOWN' END, CASE WHEN approval_year IS NULL THEN 'APPROVAL_YEAR_UNKNOWN' END], lambda z: z IS NOT NULL), '|') AS quality_warnings FROM c""")
def ledger_titles(spark, d) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    t = {"totArea": F.when(k % 8 == 0, "").otherwise(F.col("p_retailprice").cast("string")), "platArea": F.when(k % 5 == 0, "0").when(k % 7 == 0, "-").otherwise(s),
         "useAprDay": F.when(k % 9 == 0, "").otherwise(F.concat((F.col("p_size") + 1950).cast("string"), F.lit("0312"))), "bcRat": s, "grndFlrCnt": s, "ugrndFlrCnt": s,
         "rideUseElvtCnt": (k % 4).cast("string"), "emgenUseElvtCnt": F.when(k % 3 == 0, "1").otherwise(""), "hhldCnt": s, "fmlyCnt": (k % 60).cast("string"),
         "strctCdNm": F.col("p_name"), "mainPurpsCdNm": F.col("p_type"), "rserthqkDsgnApplyYn": F.when(k % 6 == 0, " ").otherwise("Y")}
    cols = prop.title_features(t)
    df = B.table(spark, d, "part").withColumns(cols)
    q = prop.ledger_quality(F.col("land_area"), F.col("gross_area"), F.col("approval_year"), F.col("seismic_design"))
    return df.select("p_partkey", "gross_area", "land_area", "approval_year", "passenger_lifts", "emergency_lifts", "households", "has_lift", "seismic_design", "structure",
                     *[B.joined(c).alias(n) for n, c in q.items()])


# Titles: parts; units: line items of a part. Purpose words come from type and flags.
_DETAIL = "CASE p_type WHEN 'ECONOMY' THEN ' 아 파트 ' WHEN 'SMALL' THEN '다세대주택, 아파트' WHEN 'MEDIUM' THEN '업무(오피스텔)' WHEN 'PROMO' THEN '다가구' ELSE '점포' END"
_MAIN = "CASE WHEN p_size % 3 = 0 THEN '단독 주택' ELSE '공동주택' END"
TITLE_TYPES = f"""titles AS (SELECT p_partkey, p_brand, p_name, p_size, CASE p_type WHEN 'MEDIUM' THEN 'OFFICETEL' WHEN 'SMALL' THEN 'VILLA' WHEN 'ECONOMY' THEN 'APARTMENT' WHEN 'PROMO' THEN 'DETACHED_MULTI'
  ELSE CASE WHEN p_size % 3 = 0 THEN 'DETACHED_MULTI' END END AS title_type FROM part)"""
UNIT_VOTES = """units AS (SELECT l_partkey, CASE WHEN l_linenumber <= 5 THEN '전유' ELSE '공용' END AS use_kind, CASE l_returnflag WHEN 'A' THEN 'VILLA' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'APARTMENT' END ELSE 'OFFICETEL' END AS vote FROM lineitem),
votes AS (SELECT l_partkey AS p_partkey, count(*) AS exclusive_units, CASE WHEN count(*) FILTER (vote = 'OFFICETEL') * 2 > count(*) THEN 'OFFICETEL' WHEN count(*) FILTER (vote = 'VILLA') * 2 > count(*) THEN 'VILLA' WHEN count(*) FILTER (vote = 'APARTMENT') * 2 > count(*) THEN 'APARTMENT' END AS unit_type
  FROM units WHERE use_kind = '전유' GROUP BY 1)"""


def titles(spark, d) -> DataFrame:
    t = F.col("p_type")
    detail = F.when(t == "ECONOMY", " 아 파트 ").when(t == "SMALL", "다세대주택, 아파트").when(t == "MEDIUM", "업무(오피스텔)").when(t == "PROMO", "다가구").otherwise("점포")
    main = F.when(F.col("p_size") % 3 == 0, "단독 주택").otherwise("공동주택")
    return B.table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_size", prop.title_housing_type(detail, main).alias("title_type"))


def unit_votes(spark, d) -> DataFrame:
    r = F.col("l_returnflag")
    units = B.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_linenumber") <= 5, " 전유 ").otherwise("공용").alias("use_kind"),
        F.when(r == "A", "공동주택").otherwise("").alias("main"),
        F.when(r == "A", "(연립주택)").when(r == "N", F.when(F.col("l_linestatus") == "O", "아파트").otherwise("상가")).otherwise("오피스텔").alias("etc"))
    return prop.unit_majority(units, ["p_partkey"], "use_kind", "main", "etc")


@query("title_housing_types", "P11", f"WITH {TITLE_TYPES} SELECT p_partkey, title_type FROM titles")
def title_housing_types(spark, d) -> DataFrame:
    return titles(spark, d).select("p_partkey", "title_type")


@query("unit_majority", "A7", f"WITH {UNIT_VOTES} SELECT * FROM votes")
def unit_majority(spark, d) -> DataFrame:
    return unit_votes(spark, d)


@query("housing_types", "J10", f"WITH {TITLE_TYPES}, {UNIT_VOTES} SELECT p_partkey, coalesce(title_type, unit_type) AS housing_type FROM titles LEFT JOIN votes USING (p_partkey)")
def housing_types(spark, d) -> DataFrame:
    return titles(spark, d).join(unit_votes(spark, d), "p_partkey", "left").select("p_partkey", F.coalesce("title_type", "unit_type").alias("housing_type"))


LEDGER = f"""{TITLE_TYPES}, ledger AS (SELECT p_partkey, p_brand AS parcel, p_size AS lot, CASE WHEN p_partkey % 5 = 0 THEN '부속건축물' ELSE '주건축물' END AS kind, p_name || CAST(100 + p_size % 5 AS VARCHAR) || '동' AS "bldNm",
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(100 + p_size % 5 AS VARCHAR) END AS "dongNm", title_type AS housing_type FROM titles)"""


def ledger(spark, d) -> DataFrame:
    k, n = F.col("p_partkey"), (F.col("p_size") % 5 + 100).cast("string")
    return titles(spark, d).select(
        "p_partkey", F.col("p_brand").alias("parcel"), F.col("p_size").alias("lot"), F.when(k % 5 == 0, "부속건축물").otherwise("주건축물").alias("kind"),
        F.concat("p_name", n, F.lit("동")).alias("bldNm"), F.when(k % 3 == 0, "").otherwise(n).alias("dongNm"), F.col("title_type").alias("housing_type"))


@query("title_selection", "J8", f"""WITH {LEDGER}, req AS (SELECT p_partkey AS request_id, p_brand AS parcel, p_size AS lot, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE upper(p_name) END AS building_name,
  CASE WHEN p_partkey % 3 = 1 THEN '제' || CAST(100 + p_size % 5 AS VARCHAR) || '동' WHEN p_partkey % 7 = 0 THEN '999동' END AS dong_name FROM part), j AS (
  SELECT request_id, count(*) AS title_count, min(t.p_partkey) AS title_part FROM req r JOIN ledger t ON r.parcel = t.parcel AND r.lot = t.lot AND t.kind = '주건축물' AND (building_name IS NULL OR contains(lower(replace("bldNm", ' ', '')), lower(replace(building_name, ' ', ''))))
    AND (dong_name IS NULL OR replace(replace(dong_name, '제', ''), '동', '') = "dongNm") GROUP BY 1)
SELECT request_id, title_part, title_count, CASE WHEN title_part IS NULL THEN 'NOT_FOUND' ELSE 'SELECTED' END AS title_status FROM req LEFT JOIN j USING (request_id)""")
def title_selection(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    req = B.table(spark, d, "part").select(
        k.alias("request_id"), F.col("p_brand").alias("parcel"), F.col("p_size").alias("lot"), F.when(k % 4 != 0, F.upper("p_name")).alias("building_name"),
        F.when(k % 3 == 1, F.concat(F.lit("제"), (F.col("p_size") % 5 + 100).cast("string"), F.lit("동"))).when(k % 7 == 0, "999동").alias("dong_name"))
    return prop.select_titles(req, ledger(spark, d), ["parcel", "lot"], "p_partkey").select(
        "request_id", F.col("title.p_partkey").alias("title_part"), "title_count", "title_status")


@query("title_candidates", "W4", f"""WITH {LEDGER}, m AS (SELECT * FROM ledger WHERE kind = '주건축물'), l AS (SELECT parcel, lot, bool_or("dongNm" <> '') AS labelled FROM m GROUP BY 1, 2), c AS (
  SELECT parcel, lot, CASE WHEN "dongNm" <> '' THEN "dongNm" ELSE lower(replace("bldNm", ' ', '')) END AS candidate, housing_type, "bldNm", "dongNm", p_partkey FROM m JOIN l USING (parcel, lot) WHERE housing_type IS NOT NULL AND ("dongNm" <> '' OR NOT labelled OR housing_type = 'DETACHED_MULTI'))
SELECT parcel, lot, candidate, housing_type, arg_max("bldNm", p_partkey) AS building_name, nullif(arg_max("dongNm", p_partkey), '') AS dong_name FROM c GROUP BY 1, 2, 3, 4""")
def title_candidates(spark, d) -> DataFrame:
    return prop.title_candidates(ledger(spark, d), ["parcel", "lot"], "p_partkey").sortWithinPartitions("parcel", "lot", F.coalesce("dong_name", F.lit("")))


@query("address_suggestions", "W8", """SELECT c_mktsegment || c_nationkey AS query, c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment || c_nationkey ORDER BY c_custkey) AS INTEGER) AS position FROM customer QUALIFY position <= 10""")
def address_suggestions(spark, d) -> DataFrame:
    c = B.table(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("query"), "c_custkey")
    return prop.first_suggestions(c, "query", "c_custkey")


UNIT_AREAS = """unit_rows AS (SELECT l_partkey AS parcel, l_suppkey AS building, l_linenumber AS unit, CASE WHEN l_returnflag = 'A' THEN '공용' ELSE '전유' END AS use_kind, CASE WHEN l_tax = 0 THEN '0' WHEN l_tax = 0.01 THEN 'x' ELSE CAST(l_quantity AS VARCHAR) END AS area, CAST(l_quantity AS INTEGER) AS floor FROM lineitem),
unit_areas AS (SELECT parcel, building, unit, coalesce(sum(TRY_CAST(area AS DOUBLE)) FILTER (use_kind = '전유'), 0) AS exclusive_area, coalesce(sum(TRY_CAST(area AS DOUBLE)) FILTER (use_kind <> '전유'), 0) AS common_area, coalesce(sum(TRY_CAST(area AS DOUBLE)), 0) AS total_area,
  count(*) AS row_count, count(*) FILTER (coalesce(TRY_CAST(area AS DOUBLE), 0) = 0) AS zero_area_count, max(floor) FILTER (use_kind = '전유') AS floor FROM unit_rows GROUP BY 1, 2, 3)"""


def unit_area_rows(spark, d) -> DataFrame:
    rows = B.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("parcel"), F.col("l_suppkey").alias("building"), F.col("l_linenumber").alias("unit"), F.when(F.col("l_returnflag") == "A", "공용").otherwise("전유").alias("use_kind"),
        F.when(F.col("l_tax") == 0, "0").when(F.col("l_tax") == 0.01, "x").otherwise(F.col("l_quantity").cast("string")).alias("area"), F.col("l_quantity").cast("int").alias("floor"))
    return prop.unit_areas(rows, ["parcel", "building", "unit"], "use_kind", "area", "floor")


@query("unit_areas", "A8", f"WITH {UNIT_AREAS} SELECT * FROM unit_areas")
def unit_areas(spark, d) -> DataFrame:
    return unit_area_rows(spark, d)


@query("unit_area_lookup", "J9", f"""WITH {UNIT_AREAS} SELECT l_orderkey, l_partkey, l_linenumber, exclusive_area, floor, exclusive_area IS NULL AS missed FROM lineitem LEFT JOIN unit_areas ON parcel = l_partkey AND building = l_suppkey AND unit = l_linenumber % 4 + 1""")
def unit_area_lookup(spark, d) -> DataFrame:
    probes = B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_partkey").alias("parcel"), F.col("l_suppkey").alias("building"), (F.col("l_linenumber") % 4 + 1).alias("unit"))
    return probes.join(unit_area_rows(spark, d), ["parcel", "building", "unit"], "left").select(
        "l_orderkey", "l_partkey", "l_linenumber", "exclusive_area", "floor", F.col("exclusive_area").isNull().alias("missed"))


# ---- snapshots ---------------------------------------------------------------

def snapshots(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    a = addresses(spark, d)
    key = prop.address_keys({c: F.col(c) for c in a.columns if c != "c_custkey"})
    fields = {
        "roadAddress": F.when(k % 17 == 0, "").otherwise(F.concat("siNm", F.lit(" "), k.cast("string"))), "legalDongCode": key["legal_dong_code"], "district": key["district"],
        "buildingName": key["building_name"], "sigunguCode": key["sigungu_code"], "bjdongCode": key["bjdong_code"], "platCode": key["plat_code"],
        "bun": F.when(k % 19 == 0, "XXXX").otherwise(T.pad4((k % 1000).cast("string"))), "ji": key["ji"], "housingType": F.lit("APARTMENT"), "dongName": F.when(k % 2 == 0, "101").otherwise(""),
        "hoName": (k % 30).cast("string"), "ledgerFeatureValues": F.when(k % 23 != 0, F.create_map(F.lit("gross"), k.cast("string"))).otherwise(F.create_map().cast("map<string,string>")),
        "ledgerTitle": F.create_map(F.lit("bldNm"), F.col("bdNm")), "ledgerTitleCount": F.lit(2), "qualityBlocking": F.array(F.lit("LAND_AREA_MISSING")),
        "unitArea": F.when(k % 3 > 0, F.struct((k % 11).cast("double").alias("exclusiveArea"), (k % 30).cast("int").alias("floor"))),
    }
    return a.select("c_custkey", F.when(k % 29 != 0, prop.snapshot_json(fields)).alias("snapshot_json"))


SNAP = f"""{ADDRESS}, snap AS (SELECT c_custkey, CASE WHEN c_custkey % 29 = 0 THEN 'SNAPSHOT_MISSING' WHEN c_custkey % 31 = 0 OR (c_custkey % 2 = 1 AND c_custkey % 5 = 0) THEN 'TARGET_CHANGED' WHEN c_custkey % 19 = 0 THEN 'LEDGER_KEY_INVALID' WHEN c_custkey % 17 = 0 THEN 'ADDRESS_MISSING'
  WHEN c_custkey % 23 = 0 THEN 'LEDGER_FEATURES_MISSING' WHEN c_custkey % 3 > 0 AND c_custkey % 11 = 0 THEN 'UNIT_AREA_INVALID' ELSE 'REUSED' END AS snapshot_state FROM addr)"""


@query("snapshot_reuse", "J20", f"WITH {SNAP} SELECT c_custkey, snapshot_state FROM snap")
def snapshot_reuse(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    req = B.table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("address"), F.when(k % 2 == 0, "101").when(k % 5 == 0, "102").alias("dong_name"),
        F.when(k % 31 == 0, "changed").otherwise(F.concat(F.lit(" "), (k % 30).cast("string"))).alias("ho_name"))
    return prop.reuse_snapshots(req, snapshots(spark, d), "c_custkey").select("c_custkey", "snapshot_state")


@query("snapshot_restore", "P36", f"""WITH {ADDRESS} SELECT c_custkey, CASE WHEN NOT stored THEN NULL WHEN c_custkey % 17 = 0 THEN '' ELSE si || ' ' || c_custkey END AS road_address, CASE WHEN stored AND c_custkey % 23 > 0 THEN CAST(c_custkey AS VARCHAR) END AS gross,
  CASE WHEN stored AND c_custkey % 3 > 0 THEN (c_custkey % 11)::DOUBLE END AS exclusive_area, CASE WHEN stored THEN 'LAND_AREA_MISSING' END AS blocking, CASE WHEN stored THEN nullif(bd, '') END AS building_name FROM (SELECT *, c_custkey % 29 > 0 AS stored FROM addr)""")
def snapshot_restore(spark, d) -> DataFrame:
    s = snapshots(spark, d).withColumn("s", prop.restored_snapshot(F.col("snapshot_json")))
    return s.select("c_custkey", F.col("s.roadAddress").alias("road_address"), F.try_element_at(F.col("s.ledgerFeatureValues"), F.lit("gross")).alias("gross"),
                    F.col("s.unitArea.exclusiveArea").alias("exclusive_area"), B.joined(F.col("s.qualityBlocking")).alias("blocking"), F.col("s.buildingName").alias("building_name"))


# ---- watchlist --------------------------------------------------------------

# Owners are customers, entries are suppliers; a name is the trailing number modulo 400.
WATCH_RAW = """watch_raw AS (SELECT s_suppkey, 'P' || s_suppkey % 400 AS name, CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE (1995 + s_suppkey % 6 - 1950 - s_suppkey % 45) || '세' END AS age, CASE WHEN s_suppkey % 8 = 0 THEN 'unknown' ELSE '서울특별시 강남구 ' || s_suppkey END AS address,
  format('{:,}', CAST(round(abs(s_acctbal) * 1000) AS BIGINT)) AS debt, CASE WHEN s_suppkey % 10 = 0 THEN '2001-02-30' ELSE (1995 + s_suppkey % 6) || '-06-15' END AS posted FROM supplier),
watch AS (SELECT s_suppkey, name, TRY_CAST(nullif(regexp_replace(age, '[^0-9]', '', 'g'), '') AS INTEGER) AS age, CASE WHEN address <> 'unknown' THEN '서울 강남구' END AS address_sigungu, CAST(regexp_replace(debt, '[^0-9]', '', 'g') AS BIGINT) AS return_debt_amount, TRY_CAST(posted AS DATE) AS posted_date FROM watch_raw)"""
OWNERS = """owners AS (SELECT c_custkey, c_nationkey AS doc, CASE WHEN c_custkey % 50 = 49 THEN '' ELSE 'P' || c_custkey % 1000 END AS name, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE lpad(CAST(50 + c_custkey % 45 AS VARCHAR), 2, '0') || lpad(CAST(1 + c_custkey % 14 AS VARCHAR), 2, '0') || '15-1******' END AS jumin_front FROM customer)"""
CHECKS = f"""{WATCH_RAW}, {OWNERS}, aged AS (SELECT c_custkey, name, jumin_front, 1950 + c_custkey % 45 AS y, 1 + c_custkey % 14 AS m FROM owners), hits AS (
  SELECT c_custkey, count(*) AS n, bool_or(coalesce(jumin_front <> '' AND m <= 12 AND year(posted_date) - y - CASE WHEN m > 6 THEN 1 ELSE 0 END = age, false)) AS high FROM aged JOIN watch USING (name) WHERE name <> '' GROUP BY 1),
checks AS (SELECT c_custkey, doc, CASE WHEN high THEN 'MATCH_HIGH' WHEN high IS NOT NULL THEN 'MATCH_NAME_ONLY' ELSE 'NO_MATCH' END AS match_status, coalesce(n, 0) AS candidate_count FROM owners LEFT JOIN hits USING (c_custkey))"""


def watch_rows(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    s = lambda c: c.cast("string")
    return B.table(spark, d, "supplier").select(
        "s_suppkey", F.concat(F.lit("P"), s(k % 400)).alias("name"), F.when(k % 9 == 0, "").otherwise(F.concat(s(k % 6 + 1995 - 1950 - k % 45), F.lit("세"))).alias("age"),
        F.when(k % 8 == 0, "unknown").otherwise(F.concat(F.lit("서울특별시 강남구 "), s(k))).alias("address"), F.format_number(F.round(F.abs("s_acctbal") * 1000), 0).alias("return_debt_amount"),
        F.lit("10일").alias("default_days"), F.lit("2").alias("enforcement_count"),
        F.when(k % 10 == 0, "2001-02-30").otherwise(F.concat(s(k % 6 + 1995), F.lit("-06-15"))).alias("posted_date"))


def watch(spark, d) -> DataFrame:
    return watchlist.clean_watchlist(watch_rows(spark, d))


def owners(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return B.table(spark, d, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("doc"), F.when(k % 50 == 49, "").otherwise(F.concat(F.lit("P"), (k % 1000).cast("string"))).alias("name"),
        F.when(k % 7 == 0, "").otherwise(F.concat(two(k % 45 + 50), two(k % 14 + 1), F.lit("15-1******"))).alias("jumin_front"))


@query("watchlist_clean", "P9", f"WITH {WATCH_RAW} SELECT name, age, address_sigungu, return_debt_amount, strftime(posted_date, '%Y-%m-%d') AS posted_date FROM watch")
def watchlist_clean(spark, d) -> DataFrame:
    return watch(spark, d).select("name", "age", "address_sigungu", "return_debt_amount", F.col("posted_date").cast("string").alias("posted_date"))


@query("watchlist_missing_regions", "A14", f"WITH {WATCH_RAW} SELECT count(*) AS rows, count(*) FILTER (address_sigungu IS NULL) AS missing_regions FROM watch")
def watchlist_missing_regions(spark, d) -> DataFrame:
    return watchlist.missing_regions(watch(spark, d))


@query("watchlist_matches", "J19 R21 F5", f"""WITH {CHECKS} SELECT c_custkey, match_status, CAST(candidate_count AS BIGINT) AS candidate_count, CASE match_status WHEN 'MATCH_HIGH' THEN true WHEN 'NO_MATCH' THEN false END AS matched,
  CASE match_status WHEN 'MATCH_HIGH' THEN 'EXACT' WHEN 'MATCH_NAME_ONLY' THEN 'MANUAL_REVIEW' END AS match_type FROM checks""")
def watchlist_matches(spark, d) -> DataFrame:
    return watchlist.match_owners(owners(spark, d), watch(spark, d), ["c_custkey"]).withColumns(
        watchlist.check_result(F.col("match_status"))).select("c_custkey", "match_status", "candidate_count", "matched", "match_type")


@query("watchlist_candidates", "J19", f"""WITH {WATCH_RAW}, {OWNERS} SELECT c_custkey, name, age, count(*) AS entries, CAST(sum(return_debt_amount) AS BIGINT) AS return_debt_amount, strftime(max(posted_date), '%Y-%m-%d') AS last_posted
FROM owners JOIN watch USING (name) WHERE name <> '' GROUP BY 1, 2, 3""")
def watchlist_candidates(spark, d) -> DataFrame:
    return watchlist.candidate_groups(owners(spark, d), watch(spark, d), ["c_custkey"]).withColumn("last_posted", F.col("last_posted").cast("string"))


# Three owners to a contract; what is stored of a check is read again from its table.
@query("watchlist_stored_checks", "S8 S9 J19 J23", f"""WITH {CHECKS}, g AS (SELECT c_custkey, age, count(*) AS entries, CAST(sum(return_debt_amount) AS BIGINT) AS debt, max(posted_date) AS last FROM owners JOIN watch USING (name) WHERE name <> '' GROUP BY 1, 2),
l AS (SELECT c_custkey, string_agg(coalesce(CAST(age AS VARCHAR), '-') || ':' || entries || ':' || debt || ':' || coalesce(strftime(last, '%Y-%m-%d'), '-'), '|' ORDER BY age NULLS FIRST) AS candidates FROM g GROUP BY 1)
SELECT c_custkey // 3 AS analysis_id, c_custkey, match_status, CASE match_status WHEN 'MATCH_HIGH' THEN true WHEN 'NO_MATCH' THEN false END AS matched, CASE match_status WHEN 'MATCH_HIGH' THEN 'EXACT' WHEN 'MATCH_NAME_ONLY' THEN 'MANUAL_REVIEW' END AS match_type,
  true AS has_owner, candidates FROM checks LEFT JOIN l USING (c_custkey)""")
def watchlist_stored_checks(spark, d) -> DataFrame:
    """Owners of stored results matched, their checks stored with the candidates of the match, read back and given the owners' ids."""
    o = owners(spark, d).withColumn("analysis_id", F.floor(F.col("c_custkey") / 3))
    results = o.groupBy("analysis_id").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "name", "jumin_front"))).alias("current_owners")).withColumn(
        "rights", F.array().cast("array<struct<section:string>>"))
    stored = cut_lineage(sinks.register_tables(results)["registry_owners"])
    checks = watchlist.checks_with_candidates(stored.drop("registry_result_id", "registry_owner_id", "position"), watch(spark, d), ["analysis_id", "c_custkey"])
    kept = cut_lineage(checks.withColumn("details_json", sinks.candidates_json(F.col("candidates"))).drop("candidates"))
    item = "array<struct<age:int,name:string,entries:bigint,return_debt_amount:bigint,last_posted:date>>"
    show = F.transform(F.from_json("details_json", item), lambda x: F.concat_ws(
        ":", *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in ("age", "entries", "return_debt_amount", "last_posted")]))
    return sinks.attach_owner_ids(kept, stored).select(
        "analysis_id", "c_custkey", "match_status", "matched", "match_type", F.col("registry_owner_id").isNotNull().alias("has_owner"), F.array_join(show, "|").alias("candidates"))


@query("watchlist_overall", "A11", f"""WITH {CHECKS}, r AS (SELECT doc, max(CASE match_status WHEN 'MATCH_HIGH' THEN 3 WHEN 'MATCH_NAME_ONLY' THEN 2 WHEN 'UNKNOWN' THEN 1 ELSE 0 END) AS k FROM checks GROUP BY 1)
SELECT doc_id, CASE k WHEN 3 THEN 'MATCH_HIGH' WHEN 2 THEN 'MATCH_NAME_ONLY' WHEN 0 THEN 'NO_MATCH' ELSE 'UNKNOWN' END AS overall_match_status FROM (SELECT s_suppkey AS doc_id FROM supplier) d LEFT JOIN r ON doc = doc_id""")
def watchlist_overall(spark, d) -> DataFrame:
    checks = watchlist.match_owners(owners(spark, d), watch(spark, d), ["c_custkey"]).withColumnRenamed("doc", "doc_id")
    docs = B.table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("doc_id"))
    return watchlist.overall_status(docs, checks, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "overall_match_status")


@query("checklist_rows", "P25", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'APARTMENT' WHEN 'O' THEN 'OFFICETEL' ELSE 'APARTMENT' END AS housing_type_code, CASE WHEN o_orderstatus = 'O' THEN '오피스텔' ELSE '아파트' END AS housing_type_name, 'NEW' AS contract_type,
  CASE WHEN o_orderkey % 2 = 0 THEN 'COMPANY' ELSE 'PERSON' END AS tenant_type, 'PERSON' AS landlord_type, o_orderkey % 3 = 0 AS fixed_date_confirmed, o_orderstatus = 'O' AND o_orderkey % 5 < 3 AS officetel_residential_marked, false AS landlord_proxy_contract,
  CASE WHEN o_orderkey % 4 > 0 THEN 'No ' || o_custkey || ' Road' END AS contract_address FROM orders""")
def checklist_rows(spark, d) -> DataFrame:
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    none = F.lit(None).cast("string")
    cols = checklist.checklist_columns({
        "housing_type_code": F.when(st == "F", "APARTMENT").when(st == "O", "OFFICETEL"), "contract_type": none, "tenant_type": F.when(k % 2 == 0, "COMPANY"), "landlord_type": none,
        "fixed_date_confirmed": F.when(k % 3 == 0, True), "officetel_residential_marked": k % 5 < 3, "landlord_proxy_contract": F.lit(None).cast("boolean"),
        "contract_address": F.when(k % 4 > 0, F.concat(F.lit("  No　 "), F.col("o_custkey").cast("string"), F.lit("\t Road ")))})
    return B.table(spark, d, "orders").select("o_orderkey", *[c.alias(n) for n, c in cols.items()])
