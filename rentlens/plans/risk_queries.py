"""Queries of the scoring family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import score as S
from rentlens.functions import text as T
from rentlens.operators import quality, report, scoring
from rentlens.plans import bindings as B
from rentlens.plans.catalog import query

_IND = ["lease_to_sale_rate", "lease_price_gap_rate", "collateral_burden_amount", "collateral_burden_rate",
        "recoverable_amount", "deposit_shortfall", "remaining_collateral_capacity", "claim_missing", "drop_0", "drop_10", "drop_20"]


@query("risk_indicators", "R4", f"""WITH {B.CONTRACTS}
SELECT analysis_id, deposit::DOUBLE / sale::DOUBLE AS lease_to_sale_rate, (deposit - lease)::DOUBLE / lease::DOUBLE AS lease_price_gap_rate,
  claim + deposit AS collateral_burden_amount, (claim + deposit)::DOUBLE / sale::DOUBLE AS collateral_burden_rate,
  sale - claim AS recoverable_amount, CASE WHEN claim IS NOT NULL THEN greatest(deposit - (sale - claim), 0) END AS deposit_shortfall,
  sale - (claim + deposit) AS remaining_collateral_capacity, claim IS NULL AND mode = 'DETAILED' AS claim_missing,
  (claim + deposit)::DOUBLE / (sale::DOUBLE * 1.0::DOUBLE) AS drop_0, (claim + deposit)::DOUBLE / (sale::DOUBLE * 0.9::DOUBLE) AS drop_10,
  (claim + deposit)::DOUBLE / (sale::DOUBLE * 0.8::DOUBLE) AS drop_20
FROM contracts""")
def risk_indicators(spark, d) -> DataFrame:
    return scoring.with_indicators(B.contracts(spark, d)).select("analysis_id", *_IND)


_SCORE_OUT = ["price_burden", "lease_market_deviation", "market_trend", "base_total", "policy_floor", "total",
              "policy_adjustment", "grade", "provisional_collateral_basis"]
SCORE_SQL = f"""WITH {B.CONTRACTS}, {B.SCORED}
SELECT analysis_id, price_burden, lease_market_deviation, trend AS market_trend, base_total, policy_floor, total,
  total - base_total AS policy_adjustment, {B.GRADE.format(s='total')} AS grade,
  claim IS NULL AND mode = 'DETAILED' AS provisional_collateral_basis, array_to_string(floor_reasons, '|') AS floor_reasons
FROM scored"""


def score_output(df: DataFrame) -> DataFrame:
    return df.select("analysis_id", *_SCORE_OUT, B.joined(F.col("floor_reasons")).alias("floor_reasons"))


@query("risk_score", "R6 R7 R8 R9 R10", SCORE_SQL)
def risk_score(spark, d) -> DataFrame:
    return score_output(scoring.with_score(B.contracts(spark, d)))


@query("scoring_input_rejects", "R4 R8", f"""WITH {B.DEPOSITS}, raw AS (
  SELECT o_orderkey AS analysis_id, CAST(round((o_totalprice - 20000) * 1000) AS BIGINT) AS sale,
    coalesce(deposit, 0) - 30000000 AS deposit, CAST(round(c_acctbal * 10000) AS BIGINT) AS claim
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN deposits ON analysis_id = o_orderkey), marked AS (
  SELECT *, list_filter([CASE WHEN sale <= 0 OR deposit <= 0 THEN 'PRICE_NOT_POSITIVE' END,
    CASE WHEN claim < 0 THEN 'CLAIM_NEGATIVE' END], lambda x: x IS NOT NULL) AS reasons FROM raw)
SELECT analysis_id, sale, deposit, claim, array_to_string(reasons, '|') AS reject_reasons FROM marked WHERE len(reasons) > 0""")
def scoring_input_rejects(spark, d) -> DataFrame:
    c = B.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    dep = B.deposits(spark, d).withColumnRenamed("analysis_id", "o_orderkey")
    raw = B.table(spark, d, "orders").join(c, "o_custkey").join(dep, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("analysis_id"), B.won(F.col("o_totalprice") - 20000).alias("sale"),
        F.lit(1).cast("long").alias("lease"), (F.coalesce("deposit", F.lit(0)) - 30_000_000).alias("deposit"),
        B.won(F.col("c_acctbal"), 10_000).alias("claim"), F.lit("DETAILED").alias("mode"), F.lit(0).alias("trend"))
    _, bad = scoring.split_rejected(raw)
    return bad.select("analysis_id", "sale", "deposit", "claim", B.joined(F.col("reject_reasons")).alias("reject_reasons"))


@query("market_severity", "R5", """WITH m AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus = 'F' AS lease_side, CAST(sum(CAST(round(o_totalprice * 1000) AS BIGINT)) AS BIGINT) AS v
  FROM orders GROUP BY ALL), w AS (
  SELECT month, CAST(sum(v) FILTER (NOT lease_side) AS BIGINT) AS sale_value, CAST(sum(v) FILTER (lease_side) AS BIGINT) AS lease_value FROM m GROUP BY month), c AS (
  SELECT month, (sale_value - lag(sale_value) OVER (ORDER BY month))::DOUBLE / sale_value::DOUBLE * 10 AS sale_change,
    (lease_value - lag(lease_value) OVER (ORDER BY month))::DOUBLE / lease_value::DOUBLE * 10 AS lease_change FROM w), s AS (
  SELECT *, CASE WHEN sale_change < 0 THEN least(abs(sale_change) / 2.0::DOUBLE, 1) ELSE 0 END AS sale_price_decline,
    CASE WHEN lease_change < 0 THEN least(abs(lease_change) / 2.0::DOUBLE, 1) ELSE 0 END AS lease_price_decline FROM c)
SELECT *, CAST(round_even(10.0::DOUBLE * (sale_price_decline + lease_price_decline) / 2, 0) AS INTEGER) AS market_trend FROM s""")
def market_severity(spark, d) -> DataFrame:
    o = B.table(spark, d, "orders").select(B.month_of(F.col("o_orderdate")).alias("month"), B.won(F.col("o_totalprice")).alias("v"),
                                           (F.col("o_orderstatus") == "F").alias("lease_side"))
    m = o.groupBy("month").agg(F.sum(F.when(~F.col("lease_side"), F.col("v"))).alias("sale_value"),
                               F.sum(F.when(F.col("lease_side"), F.col("v"))).alias("lease_value"))
    # A month joins the month before it; no window over the whole series.
    prev = m.select(T.add_months(F.col("month"), 1).alias("month"), F.col("sale_value").alias("ps"), F.col("lease_value").alias("pl"))
    change = lambda now, before: (F.col(now) - F.col(before)).cast("double") / F.col(now).cast("double") * 10
    c = m.join(prev, "month", "left").select("month", change("sale_value", "ps").alias("sale_change"), change("lease_value", "pl").alias("lease_change"))
    return c.withColumns(scoring.severity_columns(F.col("sale_change"), F.col("lease_change"))).withColumn(
        "market_trend", S.trend_points(F.col("sale_price_decline"), F.col("lease_price_decline")))


@query("severity_ranges", "R5 R8", """WITH x AS (SELECT o_orderkey AS analysis_id, (o_orderkey % 13 - 1) / 10.0::DOUBLE AS sale_decline, CASE WHEN o_custkey % 17 > 0 THEN (o_custkey % 12) / 10.0::DOUBLE END AS lease_decline FROM orders), y AS (
  SELECT *, sale_decline BETWEEN 0 AND 1 AS sale_ok, coalesce(lease_decline BETWEEN 0 AND 1, false) AS lease_ok FROM x)
SELECT analysis_id, sale_decline, lease_decline, CASE WHEN sale_ok AND lease_ok THEN '' WHEN sale_ok THEN 'LEASE_DECLINE_OUT_OF_RANGE' WHEN lease_ok THEN 'SALE_DECLINE_OUT_OF_RANGE' ELSE 'SALE_DECLINE_OUT_OF_RANGE|LEASE_DECLINE_OUT_OF_RANGE' END AS severity_rejects,
  CASE WHEN sale_ok AND lease_ok THEN CAST(round_even(10.0::DOUBLE * (sale_decline + lease_decline) / 2, 0) AS INTEGER) END AS market_trend FROM y""")
def severity_ranges(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = B.table(spark, d, "orders").select(k.alias("analysis_id"), ((k % 13 - 1) / 10.0).alias("sale_decline"), F.when(c % 17 > 0, (c % 12) / 10.0).alias("lease_decline"))
    return scoring.with_trend(x, "sale_decline", "lease_decline").withColumn("severity_rejects", B.joined(F.col("severity_rejects")))


# Rates in 997ths: none is a tie at two decimals.
@query("displayed_rates", "F4 F16", """WITH x AS (SELECT o_orderkey AS analysis_id, CASE WHEN o_custkey % 19 > 0 THEN (o_orderkey * 31 + o_custkey) % 1994 / 997.0::DOUBLE END AS rate FROM orders)
SELECT analysis_id, round(rate * 100, 2) AS percent, CASE WHEN rate IS NULL THEN '확인 필요' ELSE format('{:.2f}%', rate * 100) END AS label FROM x""")
def displayed_rates(spark, d) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = B.table(spark, d, "orders").select(k.alias("analysis_id"), F.when(c % 19 > 0, (k * 31 + c) % 1994 / F.lit(997.0)).alias("rate"))
    return x.select("analysis_id", T.percent2(F.col("rate")).alias("percent"), T.rate_label(F.col("rate")).alias("label"))


_BOOLS = {"is_seizure": "seizure", "is_provisional_seizure": "provisional_seizure", "is_provisional_disposition": "provisional_disposition",
          "is_auction_commenced": "auction_commenced", "is_trust_registration": "trust_registration", "is_owner_match": "owner_matches_contract_party"}
_TRI = "CASE {c} WHEN 'TRUE' THEN true WHEN 'FALSE' THEN false END"
ADAPTED = f"""adapted AS (SELECT *, {', '.join(f"{_TRI.format(c=c)} AS {n}" for n, c in _BOOLS.items())},
  CASE WHEN has_active_jeonse_right = 'TRUE' OR has_active_leasehold_registration = 'TRUE' THEN true
       WHEN has_active_jeonse_right = 'FALSE' AND has_active_leasehold_registration = 'FALSE' THEN false END AS is_senior_lease_right,
  CASE WHEN watchlist_check_status = 'CHECKED' THEN bad_landlord_matched END AS is_bad_landlord,
  CASE WHEN parse_status = 'SUCCESS' AND parse_confidence IN ('HIGH', 'MEDIUM') THEN total_active_max_claim_amount END AS active_max_claim_amount
  FROM register)"""
_ADAPT_OUT = ["active_max_claim_amount", *_BOOLS, "is_senior_lease_right", "is_bad_landlord"]


@query("register_adapter", "P34", f"WITH {B.REGISTER}, {ADAPTED} SELECT analysis_id, {', '.join(_ADAPT_OUT)} FROM adapted")
def register_adapter(spark, d) -> DataFrame:
    return scoring.register_inputs(B.register(spark, d)).select("analysis_id", *_ADAPT_OUT)


def _codes_sql(pairs: list[tuple[str, str]]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in pairs) + "], lambda x: x IS NOT NULL))"


_WARN = [(f"is_{n}", c) for n, c in S.RIGHT_FLAGS.items()] + [("is_owner_match = false", "OWNER_MISMATCH"), ("is_bad_landlord", "BAD_LANDLORD_MATCH")]
_MISS = [(f"is_{n} IS NULL", c) for n, c in S.RIGHT_FLAGS.items()] + [("is_owner_match IS NULL", "OWNER_MATCH"), ("is_bad_landlord IS NULL", "BAD_LANDLORD_WATCHLIST")]
# Scores are taken from the trusted claim, as the register adapter passes it on.
FLOORED = f"""{ADAPTED}, claimed AS (SELECT * EXCLUDE (claim), active_max_claim_amount AS claim FROM adapted), {B.SCORED.replace('FROM contracts)', 'FROM claimed)')}, floored AS (
  SELECT *, CASE WHEN mode = 'DETAILED' THEN {_codes_sql(_WARN)} ELSE CAST([] AS VARCHAR[]) END AS warnings,
    CASE WHEN mode = 'DETAILED' THEN {_codes_sql(_MISS)} ELSE CAST([] AS VARCHAR[]) END AS register_missing FROM scored), finals AS (
  SELECT *, CASE WHEN len(warnings) > 0 THEN greatest(total, 80) ELSE total END AS final_score,
    CASE WHEN len(warnings) > 0 THEN 80 END AS register_floor,
    list_sort(list_distinct(list_concat(CASE WHEN claim IS NULL AND mode = 'DETAILED' THEN ['ACTIVE_MAX_CLAIM_AMOUNT'] ELSE CAST([] AS VARCHAR[]) END, register_missing))) AS missing_checks
  FROM floored)"""


def finals(spark, d) -> DataFrame:
    return assessed(B.register(spark, d))


def assessed(register: DataFrame) -> DataFrame:
    """Contracts with register flags, score, register floor and missing checks."""
    df = scoring.register_inputs(register).withColumn("claim", F.col("active_max_claim_amount"))
    df = scoring.with_score(scoring.with_indicators(df))
    df = scoring.with_register_result(df, scoring.register_flag_columns(), F.col("is_owner_match"), F.col("is_bad_landlord"))
    return df.withColumn("missing_checks", F.array_sort(F.array_union(
        S.codes((F.col("claim_missing"), "ACTIVE_MAX_CLAIM_AMOUNT")), "register_missing")))


@query("register_floor", "R12 U2", f"""WITH {B.REGISTER}, {FLOORED}
SELECT analysis_id, total, final_score, register_floor, final_score <> total AS register_floor_applied, {B.GRADE.format(s='final_score')} AS final_grade,
  array_to_string(warnings, '|') AS warnings, array_to_string(missing_checks, '|') AS missing_checks FROM finals""")
def register_floor(spark, d) -> DataFrame:
    return finals(spark, d).select(
        "analysis_id", "total", "final_score", "register_floor", "register_floor_applied", "final_grade",
        B.joined(F.col("warnings")).alias("warnings"), B.joined(F.col("missing_checks")).alias("missing_checks"))


@query("final_assembly", "R16 W5", f"""WITH {B.REGISTER}, {FLOORED}
SELECT analysis_id, greatest(policy_floor, register_floor) AS score_floor, final_score - total AS rights_adjustment, final_score <> base_total AS score_floor_applied,
  array_to_string(list_concat(floor_reasons, warnings), '|') AS all_floor_reasons FROM finals""")
def final_assembly(spark, d) -> DataFrame:
    return scoring.assembled(finals(spark, d)).select(
        "analysis_id", "score_floor", "rights_adjustment", "score_floor_applied", B.joined(F.col("all_floor_reasons")).alias("all_floor_reasons"))


# Bisection in SQL, independent of the closed form used on the Spark side.
def _limit_sql(source: str, sale="sale", lease="lease", deposit="deposit", claim="claim") -> str:
    r = f"(coalesce({claim}, 0) + mid)::DOUBLE / {sale}::DOUBLE"
    g = f"(mid - {lease})::DOUBLE / {lease}::DOUBLE"
    return f"""bisect AS (
  SELECT key, {sale}, {lease}, {claim}, trend, 1::BIGINT AS lo, greatest({sale}, {deposit}, 1)::BIGINT AS hi, 0::BIGINT AS best FROM {source}
  UNION ALL
  SELECT key, {sale}, {lease}, {claim}, trend, CASE WHEN ok THEN mid + 1 ELSE lo END, CASE WHEN ok THEN hi ELSE mid - 1 END, CASE WHEN ok THEN mid ELSE best END
  FROM (SELECT *, {B.total_sql('(' + r + ')', '(' + g + ')')} <= 25 AS ok FROM (SELECT *, (lo + hi) // 2 AS mid FROM bisect WHERE lo <= hi))),
limits AS (SELECT key, CASE WHEN best < 1000000 THEN best ELSE best // 1000000 * 1000000 END AS recommended_limit FROM bisect WHERE lo > hi)"""


@query("deposit_limit", "R13", f"""WITH RECURSIVE {B.CONTRACTS}, keyed AS (SELECT *, analysis_id AS key FROM contracts), {_limit_sql('keyed')}, l AS (
  SELECT *, greatest(recommended_limit, 1) AS d1 FROM keyed JOIN limits USING (key)), s AS (
  SELECT *, (coalesce(claim, 0) + d1)::DOUBLE / sale::DOUBLE AS r, (d1 - lease)::DOUBLE / lease::DOUBLE AS g FROM l)
SELECT analysis_id, recommended_limit, greatest(deposit - recommended_limit, 0) AS reduction_required, deposit <= recommended_limit AS within_recommended_limit,
  {B.total_sql()} AS score_at_limit,
  CASE WHEN mode = 'QUICK' THEN 'PRICE_MARKET_ONLY' WHEN claim IS NOT NULL THEN 'PRICE_MARKET_AND_REGISTRY' ELSE 'PRICE_MARKET_REGISTRY_UNCONFIRMED' END AS calculation_basis,
  mode <> 'DETAILED' OR claim IS NULL AS provisional, len(reasons) = 0 AS adjustment_can_resolve_final_risk FROM s""")
def deposit_limit(spark, d) -> DataFrame:
    return scoring.with_deposit_limit(B.contracts(spark, d), F.col("reasons")).select(
        "analysis_id", "recommended_limit", "reduction_required", "within_recommended_limit", "score_at_limit",
        "calculation_basis", "provisional", "adjustment_can_resolve_final_risk")


SCENARIOS = (
    ("PRICES_DOWN_10", 10, 0, 0, None, False),
    ("LEASES_DOWN_15", 0, 15, 0, None, False),
    ("DEPOSIT_CUT_20", 0, 0, -20, None, False),
    ("MORTGAGE_REMOVED", 5, 5, 0, None, True),
    ("CLAIM_100M", 0, 0, 10, 100_000_000, False),
)
_SCEN_SQL = ", ".join(
    f"({s[0]!r}, {s[1]}, {s[2]}, {s[3]}, {'NULL' if s[4] is None else s[4]}::BIGINT, {str(s[5]).lower()})" for s in SCENARIOS)
WHAT_IF_ROWS = f"""scenarios(scenario, sale_drop, lease_drop, deposit_change, scenario_claim, remove_mortgage) AS (VALUES {_SCEN_SQL}), asked AS (
  SELECT *, deposit * (100 + deposit_change) // 100 AS scenario_deposit, analysis_id * 10 + CASE scenario WHEN 'PRICES_DOWN_10' THEN 0 WHEN 'LEASES_DOWN_15' THEN 1
    WHEN 'DEPOSIT_CUT_20' THEN 2 WHEN 'MORTGAGE_REMOVED' THEN 3 ELSE 4 END AS key FROM contracts, scenarios)"""
_QUICK_BAD = "(mode = 'QUICK' AND (claim IS NOT NULL OR scenario_claim IS NOT NULL))"


def _evaluated_sql(p: str, source: str, sale: str, lease: str, deposit: str, claim: str) -> str:
    r, g = f"(coalesce({claim}, 0) + {deposit})::DOUBLE / {sale}::DOUBLE", f"({deposit} - {lease})::DOUBLE / {lease}::DOUBLE"
    return (f"SELECT *, CASE WHEN len(reasons) > 0 THEN greatest({p}total, 80) ELSE {p}total END AS {p}score, greatest({p}pf, CASE WHEN len(reasons) > 0 THEN 80 END) AS {p}floor "
            f"FROM (SELECT *, {B.total_sql('(' + r + ')', '(' + g + ')')} AS {p}total, {B.FLOOR.format(r='(' + r + ')', g='(' + g + ')')} AS {p}pf FROM {source})")


def asked(spark, d) -> DataFrame:
    df = scoring.with_scenarios(B.contracts(spark, d), SCENARIOS)
    return df.withColumn("scenario_deposit", S.int_div(F.col("deposit") * (F.lit(100) + F.col("deposit_change")), 100))


def _reject() -> F.Column:
    c = F.col
    return quality.what_if_reject(c("mode"), c("claim"), c("scenario_claim"), c("remove_mortgage"), c("trend"), c("sale_drop"), c("lease_drop"))


@query("what_if", "R14", f"""WITH RECURSIVE {B.CONTRACTS}, {WHAT_IF_ROWS}, ok AS (
  SELECT *, greatest(sale * (100 - sale_drop) // 100, 1) AS ssale, greatest(lease * (100 - lease_drop) // 100, 1) AS slease,
    CASE WHEN remove_mortgage THEN 0 ELSE coalesce(scenario_claim, claim) END AS sclaim FROM asked
  WHERE NOT {_QUICK_BAD} AND NOT (remove_mortgage AND (mode = 'QUICK' OR claim IS NULL))), b AS ({_evaluated_sql('b_', 'ok', 'sale', 'lease', 'deposit', 'claim')}),
s AS ({_evaluated_sql('s_', 'b', 'ssale', 'slease', 'scenario_deposit', 'sclaim')}), {_limit_sql('ok', 'ssale', 'slease', 'scenario_deposit', 'sclaim')}
SELECT analysis_id, scenario, ssale AS scenario_sale, slease AS scenario_lease, scenario_deposit, sclaim AS scenario_active_claim, b_score AS baseline_score, s_score AS scenario_score,
  b_floor AS baseline_floor, s_floor AS scenario_floor, s_score - s_total AS scenario_rights_adjustment, s_score - b_score AS score_change,
  {B.GRADE.format(s='s_score')} <> {B.GRADE.format(s='b_score')} AS grade_changed, len(reasons) > 0 AS register_blockers_remain, recommended_limit,
  greatest(scenario_deposit - recommended_limit, 0) AS reduction_required FROM s JOIN limits USING (key)""")
def what_if(spark, d) -> DataFrame:
    ok = asked(spark, d).where(F.size(_reject()) == 0)
    return scoring.what_if(ok).select(
        "analysis_id", "scenario", "scenario_sale", "scenario_lease", "scenario_deposit", "scenario_active_claim", "baseline_score",
        "scenario_score", "baseline_floor", "scenario_floor", "scenario_rights_adjustment", "score_change", "grade_changed",
        "register_blockers_remain", "recommended_limit", "reduction_required")


@query("what_if_rejects", "R15", f"""WITH {B.CONTRACTS}, {WHAT_IF_ROWS}, m AS (
  SELECT *, list_filter([CASE WHEN {_QUICK_BAD} THEN 'CLAIM_NOT_ALLOWED' END, CASE WHEN mode = 'QUICK' AND remove_mortgage THEN 'REMOVAL_NOT_ALLOWED' END,
    CASE WHEN remove_mortgage AND claim IS NULL THEN 'CLAIM_UNKNOWN' END], lambda x: x IS NOT NULL) AS rr FROM asked)
SELECT analysis_id, scenario, array_to_string(rr, '|') AS reject_reasons FROM m WHERE len(rr) > 0""")
def what_if_rejects(spark, d) -> DataFrame:
    df = asked(spark, d).withColumn("reject_reasons", _reject()).where(F.size("reject_reasons") > 0)
    return df.select("analysis_id", "scenario", B.joined(F.col("reject_reasons")).alias("reject_reasons"))


@query("request_rejects", "P15", f"""WITH {B.CONTRACTS}, r AS (
  SELECT *, CASE custkey % 4 WHEN 0 THEN 'DETACHED_MULTI' WHEN 1 THEN 'VILLA' ELSE 'APARTMENT' END AS housing_type, claim IS NOT NULL AS has_register,
    CASE WHEN analysis_id % 5 > 0 THEN CAST(analysis_id % 30 AS VARCHAR) END AS ho_name, CASE WHEN analysis_id % 3 > 0 THEN (analysis_id % 40) - 2 END AS contract_area,
    CASE WHEN analysis_id % 7 > 0 THEN custkey % 90 END AS exclusive_area FROM contracts), m AS (
  SELECT *, list_filter([CASE WHEN mode = 'QUICK' AND has_register THEN 'REGISTER_NOT_ALLOWED' END, CASE WHEN mode = 'DETAILED' AND NOT has_register THEN 'REGISTER_REQUIRED' END,
    CASE WHEN deposit <= 0 THEN 'DEPOSIT_NOT_POSITIVE' END, CASE WHEN housing_type <> 'DETACHED_MULTI' AND ho_name IS NULL THEN 'UNIT_REQUIRED' END,
    CASE WHEN housing_type = 'DETACHED_MULTI' AND contract_area IS NULL THEN 'CONTRACT_AREA_REQUIRED' END,
    CASE WHEN housing_type <> 'DETACHED_MULTI' AND exclusive_area IS NULL THEN 'EXCLUSIVE_AREA_REQUIRED' END,
    CASE WHEN contract_area <= 0 OR exclusive_area <= 0 THEN 'AREA_NOT_POSITIVE' END], lambda x: x IS NOT NULL) AS rr FROM r)
SELECT analysis_id, mode, housing_type, array_to_string(rr, '|') AS reject_reasons FROM m WHERE len(rr) > 0""")
def request_rejects(spark, d) -> DataFrame:
    a, c = F.col("analysis_id"), F.col("custkey")
    df = B.contracts(spark, d).withColumns({
        "housing_type": F.when(c % 4 == 0, "DETACHED_MULTI").when(c % 4 == 1, "VILLA").otherwise("APARTMENT"),
        "ho_name": F.when(a % 5 > 0, (a % 30).cast("string")), "contract_area": F.when(a % 3 > 0, a % 40 - 2),
        "exclusive_area": F.when(a % 7 > 0, c % 90)})
    df = df.withColumn("rr", quality.request_reject(
        F.col("mode"), F.col("claim").isNotNull(), F.col("housing_type"), F.col("ho_name"), F.col("contract_area"),
        F.col("exclusive_area"), F.col("deposit"))).where(F.size("rr") > 0)
    return df.select("analysis_id", "mode", "housing_type", B.joined(F.col("rr")).alias("reject_reasons"))


# ---- report rows -----------------------------------------------------------

@query("report_price_scenarios", "R11 R17", f"""WITH {B.REGISTER}, {FLOORED}, drops(position, drop_rate, f, label) AS (
  VALUES (0, 0, 1.0::DOUBLE, '현재 시세'), (1, 10, 0.9::DOUBLE, '매매가 10% 하락'), (2, 20, 0.8::DOUBLE, '매매가 20% 하락')), x AS (
  SELECT *, (claim + deposit)::DOUBLE / (sale::DOUBLE * f) AS burden_rate FROM finals, drops WHERE claim IS NOT NULL)
SELECT analysis_id, position, label, drop_rate AS price_drop_rate, CAST(round_even(sale::DOUBLE * f, 0) AS BIGINT) AS dropped_price, burden_rate,
  CASE WHEN burden_rate < 0.7::DOUBLE THEN 'SAFE' WHEN burden_rate < 0.8::DOUBLE THEN 'CAUTION' ELSE 'RISK' END AS verdict FROM x""")
def report_price_scenarios(spark, d) -> DataFrame:
    return report.price_scenarios(finals(spark, d), ["analysis_id"])


# Written out here and not taken from the operators, so that a changed text or severity is seen.
NOTICE_TEXTS = """known(code, title, description, severity) AS (VALUES
  ('SENIOR_LEASE_RIGHT', '선순위 전세권 확인', '보증금보다 먼저 변제받는 전세권이 살아 있습니다.', 'HIGH'),
  ('OWNER_MISMATCH', '임대인과 소유자 불일치', '계약서의 임대인 이름이 등기 명의인과 다릅니다.', 'CRITICAL'),
  ('BAD_LANDLORD_MATCH', '악성임대인 명단 일치', '등기 명의인이 공개된 상습 미반환 명단에 있습니다.', 'CRITICAL'),
  ('AUCTION_COMMENCED', '경매개시 확인', '말소되지 않은 경매 절차가 진행 중입니다.', 'CRITICAL'),
  ('SEIZURE', '압류 확인', '말소되지 않은 압류가 남아 있습니다.', 'HIGH'),
  ('PROVISIONAL_SEIZURE', '가압류 확인', '말소되지 않은 가압류가 남아 있습니다.', 'HIGH'),
  ('PROVISIONAL_DISPOSITION', '가처분 확인', '말소되지 않은 가처분이 남아 있습니다.', 'HIGH'),
  ('TRUST_REGISTRATION', '신탁등기 확인', '신탁된 부동산이므로 누가 임대할 권한을 갖는지 신탁원부로 살펴야 합니다.', 'HIGH')),
gaps(code, title, description, severity) AS (VALUES
  ('OWNER_MATCH', '임대인·소유자 일치 미확인', '임대인이 등기 명의인인지 아직 대조하지 못했습니다.', 'INFO'),
  ('BAD_LANDLORD_WATCHLIST', '악성임대인 명단 조회 미완료', '명단과의 대조가 끝나지 않았습니다.', 'INFO'),
  ('ACTIVE_MAX_CLAIM_AMOUNT', '근저당 채권최고액 미확인', '남은 근저당의 한도 금액을 읽지 못했습니다.', 'INFO'),
  ('SEIZURE', '압류 여부 미확인', '압류가 있는지 읽지 못했습니다.', 'INFO'),
  ('PROVISIONAL_SEIZURE', '가압류 여부 미확인', '가압류가 있는지 읽지 못했습니다.', 'INFO'),
  ('PROVISIONAL_DISPOSITION', '가처분 여부 미확인', '가처분이 있는지 읽지 못했습니다.', 'INFO'),
  ('AUCTION_COMMENCED', '경매개시 여부 미확인', '경매 절차가 있는지 읽지 못했습니다.', 'INFO'),
  ('TRUST_REGISTRATION', '신탁등기 여부 미확인', '신탁 여부를 읽지 못했습니다.', 'INFO'),
  ('SENIOR_LEASE_RIGHT', '선순위 전세권 여부 미확인', '앞선 전세권이나 임차권이 있는지 읽지 못했습니다.', 'INFO'))"""


@query("report_notices", "R18", f"""WITH {B.REGISTER}, {FLOORED}, {NOTICE_TEXTS}, u AS (
  SELECT analysis_id, generate_subscripts(warnings, 1) - 1 AS position, unnest(warnings) AS code, true AS warned FROM finals
  UNION ALL SELECT analysis_id, len(warnings) + generate_subscripts(missing_checks, 1) - 1, unnest(missing_checks), false FROM finals)
SELECT analysis_id, CAST(position AS INTEGER) AS position, u.code, coalesce(k.title, m.title) AS title, coalesce(k.description, m.description) AS description,
  coalesce(k.severity, m.severity) AS severity
FROM u LEFT JOIN known k ON u.code = k.code AND warned LEFT JOIN gaps m ON u.code = m.code AND NOT warned""")
def report_notices(spark, d) -> DataFrame:
    return report.notices(finals(spark, d), ["analysis_id"])


@query("report_metrics", "R19 F16", f"""WITH {B.REGISTER}, {FLOORED}, u AS (
  SELECT analysis_id, unnest([
    {{'k': 0, 'metric': 'salePrice', 'section': 'valuation', 'value': sale::DOUBLE, 'on': true}}, {{'k': 1, 'metric': 'leasePrice', 'section': 'valuation', 'value': lease::DOUBLE, 'on': true}},
    {{'k': 2, 'metric': 'deposit', 'section': 'valuation', 'value': deposit::DOUBLE, 'on': true}}, {{'k': 3, 'metric': 'deposit', 'section': 'collateral', 'value': deposit::DOUBLE, 'on': mode = 'DETAILED'}},
    {{'k': 4, 'metric': 'collateralBurden', 'section': 'collateral', 'value': (claim + deposit)::DOUBLE, 'on': mode = 'DETAILED'}},
    {{'k': 5, 'metric': 'collateralRate', 'section': 'collateral', 'value': (claim + deposit)::DOUBLE / sale::DOUBLE * 100, 'on': mode = 'DETAILED'}},
    {{'k': 6, 'metric': 'shortfall', 'section': 'collateral', 'value': CASE WHEN claim IS NOT NULL THEN greatest(deposit - (sale - claim), 0) END::DOUBLE, 'on': mode = 'DETAILED'}},
    {{'k': 7, 'metric': 'total', 'section': 'riskScore', 'value': final_score::DOUBLE, 'on': true}}, {{'k': 8, 'metric': 'base', 'section': 'riskScore', 'value': base_total::DOUBLE, 'on': final_score <> base_total}},
    {{'k': 9, 'metric': 'priceBurden', 'section': 'riskScore', 'value': price_burden::DOUBLE, 'on': true}}, {{'k': 10, 'metric': 'leaseMarketDeviation', 'section': 'riskScore', 'value': lease_market_deviation::DOUBLE, 'on': true}},
    {{'k': 11, 'metric': 'marketTrend', 'section': 'riskScore', 'value': trend::DOUBLE, 'on': true}}, {{'k': 12, 'metric': 'policyAdjustment', 'section': 'riskScore', 'value': (total - base_total)::DOUBLE, 'on': total <> base_total}},
    {{'k': 13, 'metric': 'rightsAdjustment', 'section': 'riskScore', 'value': (final_score - total)::DOUBLE, 'on': final_score <> total}}]) AS m FROM finals)
SELECT analysis_id, m.section AS section, m.metric AS metric, m.value AS value FROM u WHERE m.on""")
def report_metrics(spark, d) -> DataFrame:
    # Values before rounding for display: engines round the second decimal differently.
    return report.metrics(finals(spark, d), ["analysis_id"]).select("analysis_id", "section", "metric", F.col("exact").alias("value"))


@query("report_actions", "R20", f"""WITH {B.REGISTER}, {FLOORED}, u AS (
  SELECT analysis_id, list_filter([CASE WHEN mode = 'QUICK' THEN '정밀진단으로 추가 확인' END, CASE WHEN mode = 'DETAILED' THEN '등기부등본 재발급' END,
    CASE WHEN mode = 'DETAILED' AND len(warnings) > 0 THEN '계약 진행 보류' END, CASE WHEN mode = 'DETAILED' AND len(missing_checks) > 0 THEN '미확인 항목 확인' END,
    '보증보험 가입 확인'], lambda x: x IS NOT NULL) AS a FROM finals)
SELECT analysis_id, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS position, unnest(a) AS label FROM u""")
def report_actions(spark, d) -> DataFrame:
    return report.actions(finals(spark, d), ["analysis_id"]).select("analysis_id", "position", "label")


@query("money_labels", "F4", f"""WITH {B.CONTRACTS}, v AS (SELECT analysis_id, deposit - lease AS amount FROM contracts), p AS (
  SELECT *, abs(amount) AS a, CAST(round_even((abs(amount) % 100000000)::DOUBLE / 10000, 0) AS BIGINT) AS m FROM v), q AS (
  SELECT *, a // 100000000 + CASE WHEN m = 10000 THEN 1 ELSE 0 END AS eok, CASE WHEN m = 10000 THEN 0 ELSE m END AS man FROM p)
SELECT analysis_id, CASE WHEN amount < 0 THEN '-' ELSE '' END || CASE WHEN eok > 0 AND man > 0 THEN eok || '억 ' || format('{{:,}}', man) || '만원'
  WHEN eok > 0 THEN eok || '억원' WHEN man > 0 THEN format('{{:,}}', man) || '만원' ELSE format('{{:,}}', a) || '원' END AS label FROM q""")
def money_labels(spark, d) -> DataFrame:
    return B.contracts(spark, d).select("analysis_id", T.money_label(F.col("deposit") - F.col("lease")).alias("label"))


@query("contract_risk", "R4 R8 R9 R10 R12 R13 R16 P34 P35", f"""WITH RECURSIVE {B.REGISTER}, {FLOORED}, keyed AS (SELECT *, analysis_id AS key FROM finals), {_limit_sql('keyed')}
SELECT analysis_id, mode, sale, lease, deposit, claim, base_total, total, final_score, {B.GRADE.format(s='final_score')} AS final_grade, array_to_string(warnings, '|') AS warnings,
  array_to_string(list_concat(floor_reasons, warnings), '|') AS all_floor_reasons, recommended_limit,
  CASE WHEN len(missing_checks) > 2 THEN 'LOW' WHEN len(warnings) > 0 THEN 'MEDIUM' ELSE 'HIGH' END AS check_completeness
FROM keyed JOIN limits USING (key)""")
def contract_risk(spark, d) -> DataFrame:
    df = scoring.with_deposit_limit(scoring.assembled(finals(spark, d)), F.col("warnings"))
    many = F.when(F.size("missing_checks") > 2, F.col("missing_checks")).otherwise(F.array().cast("array<string>"))
    return df.select(
        "analysis_id", "mode", "sale", "lease", "deposit", "claim", "base_total", "total", "final_score", "final_grade",
        B.joined(F.col("warnings")).alias("warnings"), B.joined(F.col("all_floor_reasons")).alias("all_floor_reasons"),
        "recommended_limit", scoring.valuation_reliability(many, F.col("warnings")).alias("check_completeness"))
