import random

import pytest
from pyspark.sql import functions as F

from rentlens.functions import score as S
from rentlens.operators import scoring

CONTRACT = "sale long, lease long, deposit long, claim long, mode string, trend int"


def scored(spark, *rows):
    df = spark.createDataFrame(list(rows), CONTRACT)
    return scoring.with_score(scoring.with_indicators(df)).collect()


def plain_total(sale, lease, deposit, claim, trend):
    """The rule set in plain Python, for comparison."""
    rate = ((claim or 0) + deposit) / sale
    gap = (deposit - lease) / lease
    pb = 0 if rate < 0.7 else 18 if rate < 0.8 else 31 if rate < 0.9 else 40 if rate <= 1 else 45
    gp = 0 if gap < -0.05 else 14 if gap <= 0.05 else 31 if gap <= 0.15 else 45
    total = min(pb + gp + trend, 100)
    if rate > 1:
        total = max(total, 100)
    elif rate >= 1:
        total = max(total, 80)
    if gap >= 0.25:
        total = max(total, 80)
    if rate >= 0.8 and gap >= 0.05:
        total = max(total, 56)
    return total


def plain_limit(sale, lease, deposit, claim, trend):
    lo, hi, best = 1, max(sale, deposit, 1), 0
    while lo <= hi:
        mid = (lo + hi) // 2
        if plain_total(sale, lease, mid, claim, trend) <= 25:
            best, lo = mid, mid + 1
        else:
            hi = mid - 1
    return best


def test_known_scores(spark):
    a, b, c = scored(spark, (400_000_000, 180_000_000, 200_000_000, None, "QUICK", 0),
                     (280_000_000, 170_000_000, 200_000_000, 100_000_000, "DETAILED", 4),
                     (100_000_000, 80_000_000, 60_000_000, 30_000_000, "DETAILED", 0))
    assert (a.total, a.grade, a.provisional_collateral_basis) == (31, "MEDIUM", False)
    assert (b.price_burden, b.lease_market_deviation, b.base_total, b.policy_floor, b.total) == (45, 45, 94, 100, 100)
    assert b.floor_reasons == ["RECOVERY_SHORTFALL", "COMBINED_PRICE_RISK"]
    assert c.price_burden == 40  # 45 * 0.9 = 40.5, half-even


def test_missing_claim_keeps_collateral_block_null(spark):
    (r,) = scored(spark, (400_000_000, 180_000_000, 200_000_000, None, "DETAILED", 0))
    assert r.collateral_burden_amount is None and r.drop_20 is None and r.deposit_shortfall is None
    assert r.claim_missing and r.provisional_collateral_basis


def test_severity(spark):
    df = spark.createDataFrame([(-1.0,), (-0.5,), (0.0,), (None,), (-9.0,)], "x double")
    assert [r[0] for r in df.select(S.decline_severity(F.col("x"))).collect()] == [0.5, 0.25, 0.0, 0.0, 1.0]
    pairs = spark.createDataFrame([(0.3, 0.5), (0.05, 0.05), (0.15, 0.15)], "a double, b double")
    assert [r[0] for r in pairs.select(S.trend_points(F.col("a"), F.col("b"))).collect()] == [round(10 * 0.8 / 2), round(0.5), round(1.5)]


def test_deposit_limit_known(spark):
    df = spark.createDataFrame([(400_000_000, 180_000_000, 200_000_000, None, "QUICK", 0),
                                (400_000_000, 180_000_000, 200_000_000, 200_000_000, "DETAILED", 0)], CONTRACT)
    rows = scoring.with_deposit_limit(df, F.array().cast("array<string>")).collect()
    assert [(r.recommended_limit, r.reduction_required) for r in rows] == [(189_000_000, 11_000_000), (119_000_000, 81_000_000)]
    assert rows[0].calculation_basis == "PRICE_MARKET_ONLY" and rows[0].provisional
    assert rows[1].registry_reflected and rows[1].score_at_limit <= 25


def test_deposit_limit_equals_bisection(spark):
    rng = random.Random(5)
    rows = [(rng.choice([10, 997, 10**6, 10**9, 10**12]) * rng.randint(1, 999), rng.choice([7, 10**6, 10**9]) * rng.randint(1, 999),
             rng.randint(1, 10**9), rng.choice([None, 0, rng.randint(0, 10**9)]), "DETAILED", rng.randint(0, 10)) for _ in range(3000)]
    df = spark.createDataFrame(rows, CONTRACT)
    got = df.select(*df.columns, S.deposit_limit(*[F.col(c) for c in ("sale", "lease", "claim", "trend")]).alias("limit")).collect()
    for r in got:
        assert r.limit == plain_limit(r.sale, r.lease, r.deposit, r.claim, r.trend), r


def test_scores_equal_plain_rules_at_band_edges(spark):
    sale = 1_000_000
    rows = [(sale, lease, dep, None, "QUICK", 3) for dep in (699_999, 700_000, 800_000, 899_999, 900_000, 1_000_000, 1_000_001)
            for lease in (560_000, 666_667, 736_842, 736_843, 800_000, 1_052_631)]
    for r in scored(spark, *rows):
        assert r.total == plain_total(r.sale, r.lease, r.deposit, None, r.trend)


def what_if_rows(spark, reasons, scenario):
    df = spark.createDataFrame([(400_000_000, 180_000_000, 200_000_000, None, "QUICK", 0, reasons)], CONTRACT + ", reasons array<string>")
    df = scoring.with_scenarios(df, [scenario]).withColumn("scenario_deposit", F.lit(180_000_000).cast("long"))
    return scoring.what_if(df).first()


def test_what_if(spark):
    r = what_if_rows(spark, [], ("x", 10, 0, 0, None, False))
    assert (r.baseline_score, r.scenario_score, r.scenario_grade, r.score_change) == (31, 14, "LOW", -17)
    b = what_if_rows(spark, ["SEIZURE", "SEIZURE"], ("x", 10, 0, 0, None, False))
    assert (b.scenario_score, b.scenario_grade, b.scenario_rights_adjustment, b.unresolved_risk_reasons) == (80, "CRITICAL", 66, ["SEIZURE"])


def test_price_drop_floors(spark):
    df = spark.createDataFrame([(199, 10), (1, 50), (333_333_333, 7)], "p long, d int")
    assert [r[0] for r in df.select(S.price_after_drop(F.col("p"), F.col("d"))).collect()] == [179, 1, 333_333_333 * 93 // 100]


@pytest.mark.parametrize("mode,expected", [("QUICK", ([], [])), ("DETAILED", (["BAD_LANDLORD_MATCH", "OWNER_MISMATCH", "SEIZURE"], ["TRUST_REGISTRATION"]))])
def test_register_floor(spark, mode, expected):
    df = spark.createDataFrame([(10, mode)], "total int, mode string")
    flags = {n: F.lit(False) for n in S.RIGHT_FLAGS} | {"seizure": F.lit(True), "trust_registration": F.lit(None).cast("boolean")}
    r = scoring.with_register_result(df, flags, F.lit(False), F.lit(True)).first()
    assert (r.warnings, r.register_missing) == expected
    assert r.final_score == (10 if mode == "QUICK" else 80)
