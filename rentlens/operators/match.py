"""Property-name matching: parcel, building name, then frequency fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import score as S
from rentlens.functions import text as T
from rentlens.operators.distribution import top_value
from rentlens.operators.reference import PARCEL, ranked_names


def parcel_names(reference: DataFrame) -> DataFrame:
    """One row per parcel with its reference rows as a sorted array ``candidates``: the most sampled first, then by value.

    A parcel's array holds its distinct names, not its transactions.
    """
    rows = [c for c in reference.columns if c not in PARCEL]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("sample_count")).alias("_rank"), *rows)))
    return reference.groupBy(*PARCEL).agg(F.transform(ranked, lambda r: F.struct(*[r[c].alias(c) for c in rows])).alias("candidates"))


def parcel_lookup(probes: DataFrame, names: DataFrame) -> DataFrame:
    """Adds the ``candidates`` of each probe's parcel (null where it has none); ``names`` as from ``parcel_names``.

    One row for each probe: a caller that needs a row per name unfolds the array itself.
    """
    return probes.join(names, PARCEL, "left")


def match_names(probes: DataFrame, reference: DataFrame, observed: str = "observed_name") -> DataFrame:
    """Adds model_name, method and warnings to probes with parcel keys.

    The reference is reduced to one row per parcel, per (parcel, name key), per
    district and per type first; the probes then meet each of the four by an
    equality join that cannot multiply rows.
    """
    ref = reference.withColumn("model_name", T.strip(F.col("model_name"))).where(F.col("model_name") != "")
    parcel = ranked_names(ref, PARCEL, "parcel_top")
    by_name = top_value(ref.withColumn("_name", T.name_key(F.col("model_name"))), [*PARCEL, "_name"],
                        "model_name", F.col("sample_count"), "name_top").drop("distinct_values")
    district = ranked_names(ref, ["district", "housing_type"], "district_top").drop("district_top_names")
    # Housing types are a handful of codes: their top names travel as one map value
    # instead of a join on a key that every probe shares.
    kind = ranked_names(ref, ["housing_type"], "type_top").select(
        F.map_from_entries(F.collect_list(F.struct("housing_type", "type_top")))).scalar()

    actual = T.strip(T.text(F.col(observed)))
    df = probes.withColumns({"_actual": actual, "_name": T.name_key(actual)})
    df = df.join(parcel, PARCEL, "left").join(by_name, [*PARCEL, "_name"], "left")
    df = df.join(district, ["district", "housing_type"], "left")
    df = df.withColumn("type_top", F.try_element_at(kind, F.col("housing_type")))

    known = F.col("parcel_top").isNotNull()
    single = known & (F.col("parcel_top_names") == 1)
    named = F.col("_actual") != ""
    method = (
        F.when(single, "parcel")
        .when(known & named & F.col("name_top").isNotNull(), "building_name")
        .when(known & named, "ambiguous_observed_name")
        .when(known, "parcel_frequency")
        .when(named, "unseen_address_name")
        .when(F.col("district_top").isNotNull(), "district_frequency")
        .when(F.col("type_top").isNotNull(), "type_frequency")
        .otherwise("no_reference")
    )
    m = F.col("method")
    model = (
        F.when(m.isin("parcel", "parcel_frequency"), F.col("parcel_top"))
        .when(m == "building_name", F.col("name_top"))
        .when(m.isin("ambiguous_observed_name", "unseen_address_name"), F.col("_actual"))
        .when(m == "district_frequency", F.col("district_top"))
        .when(m == "type_frequency", F.col("type_top"))
    )
    warnings = S.codes(
        (m.isin("ambiguous_observed_name", "parcel_frequency"), "PROPERTY_REFERENCE_AMBIGUOUS"),
        (m.isin("district_frequency", "type_frequency"), "PROPERTY_REFERENCE_NOT_FOUND"),
        (m.isin("ambiguous_observed_name", "unseen_address_name"), "UNSEEN_PROPERTY_NAME"),
        (m.isin("parcel_frequency", "district_frequency", "type_frequency"), "PROPERTY_NAME_FALLBACK"),
    )
    helper = ["_actual", "_name", "parcel_top", "parcel_top_names", "name_top", "district_top", "type_top"]
    return df.withColumn("method", method).withColumns({"model_name": model, "warnings": warnings}).drop(*helper)
