"""Contract scoring: indicators, score, register floor, deposit limit, what-if."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import score as S


def inputs(sale="sale", lease="lease", deposit="deposit", claim="claim", mode="mode", trend="trend") -> S.PriceInputs:
    return S.PriceInputs(F.col(sale), F.col(lease), F.col(deposit), F.col(claim), F.col(mode) == "DETAILED", F.col(trend))


def with_indicators(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumns(S.indicator_columns(inputs(**names)))


def _with_rates(df: DataFrame, p: S.PriceInputs) -> DataFrame:
    # As columns of their own the two rates are computed once per row, not once per use.
    return df.withColumns({"_rate": S.basis_rate(p.sale, p.deposit, p.claim), "_gap": S.gap_rate(p.lease, p.deposit)})


def with_score(df: DataFrame, **names: str) -> DataFrame:
    p = inputs(**names)
    return _with_rates(df, p).withColumns(S.score_columns(p, F.col("_rate"), F.col("_gap"))).drop("_rate", "_gap")


def split_rejected(df: DataFrame, **names: str) -> tuple[DataFrame, DataFrame]:
    """(rows that can be scored, rows with reject reasons)."""
    marked = df.withColumn("reject_reasons", S.input_reject(inputs(**names)))
    bad = F.size("reject_reasons") > 0
    return marked.where(~bad).drop("reject_reasons"), marked.where(bad)


def with_register_result(df: DataFrame, flags: dict[str, Column], owner: Column, landlord: Column,
                         score: str = "total", mode: str = "mode") -> DataFrame:
    """Adds warnings, missing checks and the final score; quick mode passes through."""
    detailed = F.col(mode) == "DETAILED"
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "warnings": F.when(detailed, S.register_warnings(flags, owner, landlord)).otherwise(none),
        "register_missing": F.when(detailed, S.register_missing(flags, owner, landlord)).otherwise(none),
    })
    final = S.with_register_floor(F.col(score), F.col("warnings"))
    return df.withColumns({
        "final_score": final,
        "register_floor": F.when(F.size("warnings") > 0, S.REGISTER_FLOOR),
        "register_floor_applied": final != F.col(score),
        "final_grade": S.grade(final),
    })


def register_inputs(df: DataFrame) -> DataFrame:
    """Register payload columns to scoring inputs: claim only from a trusted parse,
    tri-state text to booleans, watchlist only when it was checked."""
    trusted = (F.col("parse_status") == "SUCCESS") & F.col("parse_confidence").isin("HIGH", "MEDIUM")
    cols = {n: S.tri_state(F.col(n)) for n in list(S.RIGHT_FLAGS)[:5]}
    return df.withColumns({
        "active_max_claim_amount": F.when(trusted, F.col("total_active_max_claim_amount")),
        **{f"is_{n}": c for n, c in cols.items()},
        "is_senior_lease_right": S.tri_state(F.col("has_active_jeonse_right"))
        | S.tri_state(F.col("has_active_leasehold_registration")),
        "is_owner_match": S.tri_state(F.col("owner_matches_contract_party")),
        "is_bad_landlord": F.when(F.col("watchlist_check_status") == "CHECKED", F.col("bad_landlord_matched")),
    })


def register_flag_columns() -> dict[str, Column]:
    return {n: F.col(f"is_{n}") for n in S.RIGHT_FLAGS}


def assembled(df: DataFrame) -> DataFrame:
    """Final floor, reasons and rights adjustment of a scored contract."""
    return df.withColumns({
        "score_floor": F.greatest(F.col("policy_floor"), F.col("register_floor")),
        "all_floor_reasons": F.array_distinct(F.concat("floor_reasons", "warnings")),
        "rights_adjustment": F.col("final_score") - F.col("total"),
        "score_floor_applied": F.col("final_score") != F.col("base_total"),
    })


def with_deposit_limit(df: DataFrame, reasons: Column, sale="sale", lease="lease", deposit="deposit", claim="claim",
                       mode="mode", trend="trend") -> DataFrame:
    limit = S.round_limit(S.deposit_limit(F.col(sale), F.col(lease), F.col(claim), F.col(trend)))
    return df.withColumn("recommended_limit", limit).withColumns(S.limit_columns(
        F.col(mode), F.col(sale), F.col(lease), F.col(deposit), F.col(claim), F.col(trend), reasons, F.col("recommended_limit")))


def valuation_reliability(fallbacks: Column, warnings: Column) -> Column:
    return F.when(F.size(fallbacks) > 0, "LOW").when(F.size(warnings) > 0, "MEDIUM").otherwise("HIGH")


def severity_columns(sale_change: Column, lease_change: Column) -> dict[str, Column]:
    return {"sale_price_decline": S.decline_severity(sale_change), "lease_price_decline": S.decline_severity(lease_change)}


def with_trend(df: DataFrame, sale: str, lease: str) -> DataFrame:
    """Adds market_trend of two severities, null where severity_rejects names one that cannot be scored."""
    rejects = S.severity_reject(F.col(sale), F.col(lease))
    return df.withColumn("severity_rejects", rejects).withColumn(
        "market_trend", F.when(F.size("severity_rejects") == 0, S.trend_points(F.col(sale), F.col(lease))))


def evaluated(df: DataFrame, prefix: str, sale: str, lease: str, deposit: str, claim: str, reasons: str = "reasons",
              mode: str = "mode", trend: str = "trend") -> DataFrame:
    """Adds <prefix>score, grade, floor, floor_reasons and rights_adjustment."""
    p = inputs(sale, lease, deposit, claim, mode, trend)
    cols = S.score_columns(p, F.col("_rate"), F.col("_gap"))
    blocked = F.size(reasons) > 0
    df = _with_rates(df, p).withColumn("_total", cols["total"])
    total = F.col("_total")
    final = F.when(blocked, F.greatest(total, F.lit(S.REGISTER_FLOOR))).otherwise(total)
    return df.withColumns({
        f"{prefix}score": final,
        f"{prefix}grade": S.grade(final),
        f"{prefix}floor": F.greatest(cols["policy_floor"], F.when(blocked, S.REGISTER_FLOOR)),
        f"{prefix}floor_reasons": F.array_distinct(F.concat(cols["floor_reasons"], F.col(reasons))),
        f"{prefix}rights_adjustment": final - total,
    }).drop("_rate", "_gap", "_total")


SCENARIO = "struct<scenario:string, sale_drop:int, lease_drop:int, deposit_change:int, scenario_claim:bigint, remove_mortgage:boolean>"


def with_scenarios(df: DataFrame, scenarios: Sequence[tuple]) -> DataFrame:
    """Each contract once per scenario of a fixed, short list.

    A scenario is (name, sale drop %, lease drop %, deposit change %, claim or
    None, remove mortgage).
    """
    rows = F.array(*[F.struct(*[F.lit(v) for v in s]).cast(SCENARIO) for s in scenarios])
    return df.select("*", F.inline(rows))


def what_if(df: DataFrame) -> DataFrame:
    """Baseline and scenario scores of contracts that carry scenario columns."""
    claim = F.when(F.col("remove_mortgage"), F.lit(0).cast("long")).otherwise(
        F.coalesce(F.col("scenario_claim"), F.col("claim")))
    df = df.withColumns({
        "scenario_sale": S.price_after_drop(F.col("sale"), F.col("sale_drop")),
        "scenario_lease": S.price_after_drop(F.col("lease"), F.col("lease_drop")),
        "scenario_active_claim": claim,
        "reasons": F.array_distinct("reasons"),
    })
    df = evaluated(df, "baseline_", "sale", "lease", "deposit", "claim")
    df = evaluated(df, "scenario_", "scenario_sale", "scenario_lease", "scenario_deposit", "scenario_active_claim")
    df = df.withColumns({
        "score_change": F.col("scenario_score") - F.col("baseline_score"),
        "grade_changed": F.col("scenario_grade") != F.col("baseline_grade"),
        "register_blockers_remain": F.size("reasons") > 0,
    })
    return with_deposit_limit(df, F.col("reasons"), "scenario_sale", "scenario_lease", "scenario_deposit",
                              "scenario_active_claim")
