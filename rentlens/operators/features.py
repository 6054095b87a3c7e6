"""Model features: contract, sources, assembly, fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators.distribution import exact_percentiles, top_value

# Feature names by source, and features that have no source yet.
MODEL_SUFFIX = {"APARTMENT": "아파트", "VILLA": "연립다세대", "OFFICETEL": "오피스텔", "DETACHED_MULTI": "단독다가구"}
DETAIL_FEATURES = ("전용면적(㎡)", "계약면적(㎡)", "대지권면적(㎡)", "층")
LEDGER_FEATURES = ("연면적(㎡)", "대지면적(㎡)")
MATCH_FEATURES = ("단지명", "건물명")
DERIVED_FEATURES = ("최종건축연령", "거래시점건축연령_파생", "대지대비연면적비율_파생", "계약월", "계약월_파생")
UNAVAILABLE = {"대지권면적(㎡)": "LAND_RIGHT_AREA_UNAVAILABLE"}

CONTRACT_JSON = "map<string, struct<feature_count:int, features:array<string>, categorical_features:array<string>, " \
    "inactive_features:array<string>, target:struct<area_feature:string, inverse_primary:string>>>"
DEFAULTS_JSON = "struct<version:string, feature_manifest_version:string, models:map<string, map<string,string>>>"


def _whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.from_json("value", schema).alias("doc"))


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """Feature contract file as one row per model: lists, counts, target."""
    doc = _whole_json(spark, path, CONTRACT_JSON)
    return doc.select(F.explode("doc").alias("model_key", "m")).select("model_key", "m.*")


def contract_rows(models: DataFrame) -> DataFrame:
    """One row per model and feature, in contract order."""
    return models.select(
        "model_key", "categorical_features", F.posexplode("features").alias("ordinal", "feature")
    ).select("model_key", "ordinal", "feature",
             F.array_contains("categorical_features", F.col("feature")).alias("categorical"))


def read_defaults(spark: SparkSession, path: str) -> DataFrame:
    """Fallback defaults file as (model_key, feature, value) rows, values as text."""
    doc = _whole_json(spark, path, DEFAULTS_JSON)
    models = doc.select(F.explode("doc.models").alias("model_key", "values"))
    return models.select("model_key", F.explode("values").alias("feature", "value"))


def contract_entries(models: DataFrame) -> DataFrame:
    """Contract lists as rows (model_key, feature, role); role is active, categorical or inactive."""
    part = lambda col, role: models.select("model_key", F.explode(col).alias("feature"), F.lit(role).alias("role"))
    return part("features", "active").unionByName(part("categorical_features", "categorical")).unionByName(
        part("inactive_features", "inactive"))


def contract_violations(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """Rule breaches per model as rows (model_key, problem).

    ``entries`` as from contract_entries, ``counts``: model_key, feature_count.
    Roles are counted per feature, then per model; no list is compared whole.
    """
    role = lambda r: F.count_if(F.col("role") == r)
    per = entries.groupBy("model_key", "feature").agg(
        role("active").alias("a"), role("categorical").alias("c"), role("inactive").alias("i"))
    m = per.groupBy("model_key").agg(
        F.sum("a").alias("_n"), F.max(F.col("a") > 1).alias("_dup"), F.max((F.col("c") > 0) & (F.col("a") == 0)).alias("_cat"),
        F.max((F.col("a") > 0) & (F.col("i") > 0)).alias("_both"))
    none = F.lit(None).cast("string")
    problems = F.filter(F.array(
        F.when(F.col("feature_count") != F.coalesce("_n", F.lit(0)), "COUNT_MISMATCH").otherwise(none),
        F.when(F.col("_dup"), "DUPLICATE_FEATURE").otherwise(none),
        F.when(F.col("_cat"), "CATEGORICAL_NOT_ACTIVE").otherwise(none),
        F.when(F.col("_both"), "ACTIVE_AND_INACTIVE").otherwise(none),
    ), lambda x: x.isNotNull())
    return counts.join(m, "model_key", "left").select("model_key", F.explode(problems).alias("problem"))


def contract_totals(models: DataFrame, model_count: int, feature_total: int) -> DataFrame:
    return models.agg(F.count("*").alias("models"), F.sum(F.size("features")).alias("features")).withColumns({
        "models_ok": F.col("models") == model_count, "features_ok": F.col("features") == feature_total})


def feature_source(name: Column) -> Column:
    """Which source a feature comes from, by its name."""
    return (
        F.when(name == "시군구", "address")
        .when(name == "주택유형", "property_resolver")
        .when(name.isin(*DETAIL_FEATURES), "property_detail")
        .when(name.isin(*MATCH_FEATURES), "property_match")
        .when(name.isin(*LEDGER_FEATURES) | name.startswith("건축물대장_"), "building_ledger")
        .when(name.startswith("RONE_"), "rone")
        .when(name == "신규취급액기준_COFIX", "cofix")
        .when(name.startswith("ECOS_"), "ecos")
        .when(name.startswith("KOSIS_"), "kosis")
        .when(name.isin(*DERIVED_FEATURES), "derived")
        .otherwise("unresolved")
    )


def model_keys(housing_type: Column, suffix=MODEL_SUFFIX) -> dict[str, Column]:
    """Sale and lease model key of a housing type; null for an unknown type."""
    names = F.create_map(*[F.lit(x) for pair in suffix.items() for x in pair])
    end = F.try_element_at(names, housing_type)
    return {"sale_key": F.concat(F.lit("매매_"), end), "lease_key": F.concat(F.lit("전세_"), end)}


def per_model(df: DataFrame, housing_type: str = "housing_type", suffix=MODEL_SUFFIX) -> DataFrame:
    """Each contract once for its sale model and once for its lease model."""
    keys = model_keys(F.col(housing_type), suffix)
    pair = F.array(
        F.struct(F.lit("SALE").alias("model_kind"), keys["sale_key"].alias("model_key")),
        F.struct(F.lit("LEASE").alias("model_kind"), keys["lease_key"].alias("model_key")))
    return df.select("*", F.inline(pair)).where(F.col("model_key").isNotNull())


def detail_columns(exclusive: Column, contract_area: Column, land_right: Column, floor: Column,
                   unit_area: Column, unit_floor: Column, housing_type: Column, name: Column) -> dict[str, Column]:
    """Property detail features: the user's value goes before the ledger's unit value."""
    clean = T.blank_to_null(name)
    villa = housing_type == "VILLA"
    return {
        "전용면적(㎡)": F.coalesce(exclusive.cast("double"), unit_area),
        "층": F.coalesce(floor, unit_floor),
        "계약면적(㎡)": contract_area.cast("double"),
        "대지권면적(㎡)": land_right.cast("double"),
        "건물명": F.when(villa, clean),
        "단지명": F.when(~villa, clean),
    }


def area_reject(**areas: Column) -> Column:
    from rentlens.functions import score as S
    return S.codes(*[(c <= 0, f"{name.upper()}_NOT_POSITIVE") for name, c in areas.items()])


def derived_columns(contract_date: Column, approval_year: Column, gross: Column, land: Column) -> dict[str, Column]:
    """Derived features. They replace source values of the same name even when null."""
    age = F.year(contract_date) - approval_year
    return {
        "계약월": F.month(contract_date), "계약월_파생": F.month(contract_date),
        "최종건축연령": age, "거래시점건축연령_파생": age,
        "대지대비연면적비율_파생": F.when(land != 0, gross / land),
    }


def valid_number(c: Column) -> Column:
    """A finite number; booleans are not numbers."""
    d = c.try_cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))


def valid_category(c: Column, kind: str = "string") -> Column:
    """Non-blank text; a numeric 0 or a false counts as missing."""
    present = T.strip(T.text(c)) != ""
    if kind in ("int", "bigint", "double", "float"):
        return present & (c != 0)
    if kind == "boolean":
        return present & c
    return present


def with_fallbacks(df: DataFrame, features: Sequence[str], categorical: Sequence[str], default: str = "default_",
                   unavailable: Sequence[str] = tuple(UNAVAILABLE)) -> DataFrame:
    """Replaces invalid feature values by ``<default><name>`` columns.

    Adds fallback_features and unavailable_features (names in contract order). A
    boolean in a numeric feature is invalid.
    """
    types = dict(df.dtypes)
    valid = {}
    for name in features:
        c = F.col(f"`{name}`")
        if name in categorical:
            valid[name] = valid_category(c, types[name])
        else:
            valid[name] = F.lit(False) if types[name] == "boolean" else valid_number(c)
    cols = {}
    for name in features:
        fallback, c = F.col(f"`{default}{name}`"), F.col(f"`{name}`")
        kind = "string" if name in categorical else "double"
        cols[name] = F.when(valid[name], c.cast(kind)).otherwise(fallback.cast(kind))
    none = F.lit(None).cast("string")
    used = lambda names: F.filter(
        F.array(*[F.when(~valid[n], F.lit(n)).otherwise(none) for n in names]).cast("array<string>"),
        lambda x: x.isNotNull())
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in features and not c.startswith(default)],
        *[c.alias(n) for n, c in cols.items()],
        used([n for n in features if n not in unavailable]).alias("fallback_features"),
        used([n for n in features if n in unavailable]).alias("unavailable_features"),
    )


def feature_policy(models: DataFrame, defaults: DataFrame) -> DataFrame:
    """One row per model: its features in contract order, each with its role and default.

    ``models``: model_key, features, categorical_features; ``defaults``: model_key, feature, value. It grows with the
    contract only.
    """
    rows = contract_rows(models).join(defaults.select("model_key", "feature", "value"), ["model_key", "feature"], "left")
    return rows.groupBy("model_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "feature", "categorical", "value"))).alias("policy"))


def contract_vectors(df: DataFrame, policy: DataFrame, sources: Sequence[str], unavailable: Sequence[str] = tuple(UNAVAILABLE)) -> DataFrame:
    """Adds the vector that each row's own model asks for; the contract, not the code, says which features and in what order.

    ``df`` carries model_key and the ``sources`` columns, named as features; ``policy`` as from ``feature_policy``. Adds
    vector (ordinal, feature, categorical, number, text, fallback), categorical_indices, fallback_features,
    unavailable_features and missing_features: features without a value or a default. A row of an unknown or null model
    keeps nulls in all five.
    """
    types = dict(df.dtypes)
    col = lambda c: F.col(f"`{c}`")
    number = lambda c: F.lit(None).cast("double") if types[c] == "boolean" else F.when(valid_number(col(c)), col(c).try_cast("double"))
    text = lambda c: F.when(valid_category(col(c), types[c]), col(c).cast("string"))
    by_name = lambda value, kind: F.create_map(*[x for c in sources for x in (F.lit(c), value(c))]).cast(f"map<string,{kind}>")
    at = lambda values, f: F.try_element_at(values, f["feature"])

    def filled(f: Column) -> Column:
        n, t = F.when(~f["categorical"], at(F.col("_numbers"), f)), F.when(f["categorical"], at(F.col("_texts"), f))
        return F.struct(
            f["ordinal"].alias("ordinal"), f["feature"].alias("feature"), f["categorical"].alias("categorical"),
            F.coalesce(n, F.when(~f["categorical"], f["value"].try_cast("double"))).alias("number"),
            F.coalesce(t, F.when(f["categorical"], f["value"])).alias("text"), (n.isNull() & t.isNull()).alias("fallback"))

    named = lambda test: F.transform(F.filter("vector", test), lambda v: v["feature"])
    out = df.withColumns({"_numbers": by_name(number, "double"), "_texts": by_name(text, "string")}).join(policy, "model_key", "left")
    empty = lambda v: v["number"].isNull() & v["text"].isNull()
    return out.withColumn("vector", F.transform("policy", filled)).withColumns({
        "categorical_indices": F.transform(F.filter("vector", lambda v: v["categorical"]), lambda v: v["ordinal"]),
        "fallback_features": named(lambda v: v["fallback"] & ~v["feature"].isin(*unavailable)),
        "unavailable_features": named(lambda v: v["fallback"] & v["feature"].isin(*unavailable)),
        "missing_features": named(empty),
    }).drop("_numbers", "_texts", "policy")


def model_table(vectors: DataFrame, features: Sequence[str], categorical: Sequence[str], model_key: str, keys: Sequence[str]) -> DataFrame:
    """The vectors of one model as a table with a typed column for each of its features."""
    field = lambda i, n: F.col("vector")[i]["text" if n in categorical else "number"].alias(n)
    return vectors.where(F.col("model_key") == model_key).select(*keys, *[field(i, n) for i, n in enumerate(features)])


def write_defaults(defaults: DataFrame, path: str, version: str, manifest_version: str, categorical: Sequence[str]) -> None:
    """The defaults file as ``read_defaults`` takes it: one JSON document, numbers as numbers, texts as texts.

    It holds one value per model and feature. A later run replaces the file.
    """
    as_text = F.variant_get(F.to_variant_object(F.array("value")), "$[0]", "variant")
    value = F.when(F.col("feature").isin(*categorical), as_text).otherwise(F.try_parse_json("value"))
    per_model = defaults.where(F.col("value").isNotNull()).groupBy("model_key").agg(
        F.map_from_entries(F.collect_list(F.struct("feature", value.alias("value")))).alias("values"))
    doc = per_model.agg(F.map_from_entries(F.collect_list(F.struct("model_key", "values"))).alias("models"))
    out = doc.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(manifest_version).alias("feature_manifest_version"), "models")).alias("value"))
    out.coalesce(1).write.mode("overwrite").text(path)


def default_columns(defaults: DataFrame, features: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Defaults as one wide row per model (model_key, default_<feature>...)."""
    wide = defaults.groupBy("model_key").pivot("feature", list(features)).agg(F.first("value"))
    return wide.select("model_key", *[
        F.col(f"`{n}`").cast("string" if n in categorical else "double").alias(f"default_{n}") for n in features])


def unavailable_warnings(names: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in UNAVAILABLE.items() for x in pair])
    return F.transform(names, lambda n: F.coalesce(F.try_element_at(known, n), F.lit("PROPERTY_FEATURE_UNAVAILABLE")))


def training_defaults(df: DataFrame, model: str, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Defaults of a training set: exact median of finite numbers, most frequent
    non-blank text (ties to the smallest). Rows (model_key, feature, value)."""
    num = df.select(F.col(model).alias("model_key"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in numeric]).unpivot(
        ["model_key"], [*numeric], "feature", "v")
    num = num.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") != float("inf")))
    medians = exact_percentiles(num, ["model_key", "feature"], "v", {"value": 0.5}).select(
        "model_key", "feature", F.col("value").cast("string").alias("value"))
    cat = df.select(F.col(model).alias("model_key"), *[T.blank_to_null(F.col(f"`{c}`")).alias(c) for c in categorical]).unpivot(
        ["model_key"], [*categorical], "feature", "value")
    modes = top_value(cat, ["model_key", "feature"], "value").drop("distinct_values")
    return medians.unionByName(modes)
