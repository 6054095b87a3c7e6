"""Risk rules as Column expressions.

All rates are doubles. Points are small integers that Python's half-even
``round`` turns into literals when the plan is built; only the market trend is
rounded per row, with ``rint`` (half-even as well, and inside codegen).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, bands, floors, grades and limits of the rule set.
WEIGHT_PRICE, WEIGHT_GAP, WEIGHT_TREND = 45, 45, 10
# (upper bound, bound included, severity); the last band is open.
BURDEN_BANDS = ((0.7, False, 0.0), (0.8, False, 0.4), (0.9, False, 0.7), (1.0, True, 0.9), (None, True, 1.0))
GAP_BANDS = ((-0.05, False, 0.0), (0.05, True, 0.3), (0.15, True, 0.7), (None, True, 1.0))
GRADES = ((25, "LOW"), (55, "MEDIUM"), (79, "HIGH"), (None, "CRITICAL"))
REGISTER_FLOOR = 80
TARGET_SCORE = 25
LIMIT_UNIT = 1_000_000
DROP_RATES = (0, 10, 20)
# Register flags in input order with their warning codes.
RIGHT_FLAGS = {
    "seizure": "SEIZURE",
    "provisional_seizure": "PROVISIONAL_SEIZURE",
    "provisional_disposition": "PROVISIONAL_DISPOSITION",
    "auction_commenced": "AUCTION_COMMENCED",
    "trust_registration": "TRUST_REGISTRATION",
    "senior_lease_right": "SENIOR_LEASE_RIGHT",
}


def _banded(value: Column, bands, result) -> Column:
    expr = None
    for bound, included, severity in bands:
        if bound is None:
            return expr.otherwise(result(severity))
        test = (value <= bound) if included else (value < bound)
        expr = F.when(test, result(severity)) if expr is None else expr.when(test, result(severity))


def _double(c: Column) -> Column:
    return c.cast("double")


def int_div(a: Column, b: int) -> Column:
    """Integer division of non-negative amounts."""
    return F.call_function("div", a, F.lit(b))


def codes(*pairs: tuple[Column, str]) -> Column:
    """Codes whose condition holds, in the given order."""
    none = F.lit(None).cast("string")
    return F.filter(F.array(*[F.when(cond, F.lit(code)).otherwise(none) for cond, code in pairs]), lambda x: x.isNotNull())


def decline_severity(change: Column) -> Column:
    """0 for a rise or an unknown change, else half the fall, at most 1."""
    return F.when(change < 0, F.least(F.abs(change) / 2.0, F.lit(1.0))).otherwise(F.lit(0.0))


def burden_severity(rate: Column) -> Column:
    return _banded(rate, BURDEN_BANDS, lambda s: F.lit(float(s)))


def gap_severity(rate: Column) -> Column:
    return _banded(rate, GAP_BANDS, lambda s: F.lit(float(s)))


def burden_points(rate: Column) -> Column:
    return _banded(rate, BURDEN_BANDS, lambda s: F.lit(round(WEIGHT_PRICE * s)))


def gap_points(rate: Column) -> Column:
    return _banded(rate, GAP_BANDS, lambda s: F.lit(round(WEIGHT_GAP * s)))


def trend_points(sale_severity: Column, lease_severity: Column) -> Column:
    return F.rint(F.lit(float(WEIGHT_TREND)) * (sale_severity + lease_severity) / 2).cast("int")


def severity_reject(sale_severity: Column, lease_severity: Column) -> Column:
    """Reason codes of market severities outside 0 to 1; a missing one or NaN is outside."""
    outside = lambda c: F.coalesce((c < 0) | (c > 1), F.lit(True))
    return codes((outside(sale_severity), "SALE_DECLINE_OUT_OF_RANGE"), (outside(lease_severity), "LEASE_DECLINE_OUT_OF_RANGE"))


def verdict(rate: Column) -> Column:
    return F.when(rate < 0.7, "SAFE").when(rate < 0.8, "CAUTION").otherwise("RISK")


def grade(score: Column) -> Column:
    expr = None
    for top, name in GRADES:
        if top is None:
            return expr.otherwise(name)
        expr = F.when(score <= top, name) if expr is None else expr.when(score <= top, name)


def burden_rate(sale: Column, deposit: Column, claim: Column) -> Column:
    """Claim plus deposit over sale price; null while the claim is unknown."""
    return _double(claim + deposit) / _double(sale)


def lease_rate(sale: Column, deposit: Column) -> Column:
    return _double(deposit) / _double(sale)


def gap_rate(lease: Column, deposit: Column) -> Column:
    return _double(deposit - lease) / _double(lease)


def basis_rate(sale: Column, deposit: Column, claim: Column) -> Column:
    """The rate that is scored: burden when known, else deposit over sale price."""
    return _double(F.coalesce(claim, F.lit(0)) + deposit) / _double(sale)


def floor_points(rate: Column, gap: Column) -> Column:
    """Policy floor; null when no rule applies."""
    return F.greatest(
        F.when(rate > 1.0, 100).when(rate >= 1.0, 80),
        F.when(gap >= 0.25, 80),
        F.when((rate >= 0.8) & (gap >= 0.05), 56),
    )


def floor_reasons(rate: Column, gap: Column) -> Column:
    return codes(
        (rate > 1.0, "RECOVERY_SHORTFALL"),
        (rate == 1.0, "NO_RECOVERY_BUFFER"),
        (gap >= 0.25, "EXTREME_LEASE_DEVIATION"),
        ((rate >= 0.8) & (gap >= 0.05), "COMBINED_PRICE_RISK"),
    )


@dataclass(frozen=True)
class PriceInputs:
    """The columns one contract is scored from."""

    sale: Column
    lease: Column
    deposit: Column
    claim: Column
    collateral_expected: Column
    trend: Column


def input_reject(p: PriceInputs) -> Column:
    """Reason codes of inputs that cannot be scored."""
    return codes(
        (F.coalesce(F.least(p.sale, p.lease, p.deposit) <= 0, F.lit(True))
         | p.sale.isNull() | p.lease.isNull() | p.deposit.isNull(), "PRICE_NOT_POSITIVE"),
        (p.claim < 0, "CLAIM_NEGATIVE"),
    )


def indicator_columns(p: PriceInputs) -> dict[str, Column]:
    burden = p.claim + p.deposit
    recoverable = p.sale - p.claim
    cols = {
        "lease_to_sale_rate": lease_rate(p.sale, p.deposit),
        "lease_price_gap_rate": gap_rate(p.lease, p.deposit),
        "collateral_burden_amount": burden,
        "collateral_burden_rate": burden_rate(p.sale, p.deposit, p.claim),
        "recoverable_amount": recoverable,
        "deposit_shortfall": F.when(p.claim.isNotNull(), F.greatest(p.deposit - recoverable, F.lit(0))),
        "remaining_collateral_capacity": p.sale - burden,
        "claim_missing": p.claim.isNull() & p.collateral_expected,
    }
    for drop in DROP_RATES:
        cols[f"drop_{drop}"] = _double(burden) / (_double(p.sale) * (1 - drop / 100))
    return cols


def score_columns(p: PriceInputs, rate: Column, gap: Column) -> dict[str, Column]:
    """Score parts from the scored rate and the gap rate (best given as columns, as
    both are used many times)."""
    pb, gp = burden_points(rate), gap_points(gap)
    base = F.least(pb + gp + p.trend, F.lit(100))
    total = F.greatest(base, floor_points(rate, gap))
    return {
        "price_burden": pb,
        "lease_market_deviation": gp,
        "market_trend": p.trend,
        "base_total": base,
        "policy_floor": floor_points(rate, gap),
        "floor_reasons": floor_reasons(rate, gap),
        "total": total,
        "policy_adjustment": total - base,
        "grade": grade(total),
        "provisional_collateral_basis": p.claim.isNull() & p.collateral_expected,
    }


def total_score(sale: Column, lease: Column, deposit: Column, claim: Column, trend: Column) -> Column:
    rate, gap = basis_rate(sale, deposit, claim), gap_rate(lease, deposit)
    return F.greatest(F.least(burden_points(rate) + gap_points(gap) + trend, F.lit(100)), floor_points(rate, gap))


def _largest(guess: Column, holds) -> Column:
    """Largest integer for which a monotone predicate holds, known to lie within
    one of the guess (a double product is off by less than one won)."""
    expr = None
    for step in (1, 0, -1):
        candidate = guess + step
        expr = F.when(holds(candidate), candidate) if expr is None else expr.when(holds(candidate), candidate)
    return expr.otherwise(guess - 2)


def deposit_limit(sale: Column, lease: Column, claim: Column, trend: Column) -> Column:
    """Largest deposit whose total score stays within the target, before rounding.

    The score is a step function that only rises with the deposit, so its largest
    allowed deposit is the smaller of two band edges. Every pair of bands that can
    meet the target gives one candidate; the result is the best of them, 0 when
    none reaches one won. No search loop is needed, and the edges are settled with
    the very comparisons the score uses.
    """
    owed = F.coalesce(claim, F.lit(0))

    def burden_edge(bound: float, included: bool) -> Column:
        guess = F.floor(_double(sale) * bound).cast("long") - owed
        def holds(d):
            r = _double(owed + d) / _double(sale)
            return (r <= bound) if included else (r < bound)
        return _largest(guess, holds)

    def gap_edge(bound: float, included: bool) -> Column:
        guess = lease + F.floor(_double(lease) * bound).cast("long")
        def holds(d):
            r = _double(d - lease) / _double(lease)
            return (r <= bound) if included else (r < bound)
        return _largest(guess, holds)

    best = []
    for b_bound, b_in, b_sev in BURDEN_BANDS:
        for g_bound, g_in, g_sev in GAP_BANDS:
            spare = TARGET_SCORE - round(WEIGHT_PRICE * b_sev) - round(WEIGHT_GAP * g_sev)
            if b_bound is None or g_bound is None or spare < 0:
                continue
            edge = F.least(burden_edge(b_bound, b_in), gap_edge(g_bound, g_in))
            best.append(edge if spare >= WEIGHT_TREND else F.when(trend <= spare, edge))
    return F.greatest(F.lit(0).cast("long"), *best)


def round_limit(raw: Column) -> Column:
    return F.when(raw < LIMIT_UNIT, raw).otherwise(int_div(raw, LIMIT_UNIT) * LIMIT_UNIT)


def limit_basis(mode: Column, claim: Column) -> Column:
    return (
        F.when(mode == "QUICK", "PRICE_MARKET_ONLY")
        .when(claim.isNotNull(), "PRICE_MARKET_AND_REGISTRY")
        .otherwise("PRICE_MARKET_REGISTRY_UNCONFIRMED")
    )


def limit_columns(mode: Column, sale: Column, lease: Column, deposit: Column, claim: Column,
                  trend: Column, reasons: Column, limit: Column) -> dict[str, Column]:
    """What follows from a recommended limit (best given as a column)."""
    reflected = (mode == "DETAILED") & claim.isNotNull()
    distinct = F.array_distinct(reasons)
    return {
        "reduction_required": F.greatest(deposit - limit, F.lit(0)),
        "within_recommended_limit": deposit <= limit,
        "score_at_limit": total_score(sale, lease, F.greatest(limit, F.lit(1)), claim, trend),
        "calculation_basis": limit_basis(mode, claim),
        "registry_reflected": reflected,
        "provisional": ~reflected,
        "adjustment_can_resolve_final_risk": F.size(distinct) == 0,
        "unresolved_risk_reasons": distinct,
    }


def register_warnings(flags: dict[str, Column], owner_matches: Column, bad_landlord: Column) -> Column:
    pairs = [(flags[name] == F.lit(True), code) for name, code in RIGHT_FLAGS.items()]
    pairs += [(owner_matches == F.lit(False), "OWNER_MISMATCH"), (bad_landlord == F.lit(True), "BAD_LANDLORD_MATCH")]
    return F.array_sort(codes(*pairs))


def register_missing(flags: dict[str, Column], owner_matches: Column, bad_landlord: Column) -> Column:
    pairs = [(flags[name].isNull(), code) for name, code in RIGHT_FLAGS.items()]
    pairs += [(owner_matches.isNull(), "OWNER_MATCH"), (bad_landlord.isNull(), "BAD_LANDLORD_WATCHLIST")]
    return F.array_sort(codes(*pairs))


def with_register_floor(score: Column, warnings: Column) -> Column:
    return F.when(F.size(warnings) > 0, F.greatest(score, F.lit(REGISTER_FLOOR))).otherwise(score)


def price_after_drop(price: Column, rate: Column) -> Column:
    """Price after a percentage drop, rounded down, at least one won."""
    return F.greatest(int_div(price * (F.lit(100) - rate), 100), F.lit(1))


def tri_state(c: Column) -> Column:
    return F.when(c == "TRUE", True).when(c == "FALSE", False)
