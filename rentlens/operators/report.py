"""Report content as rows: scenarios, notices, metrics, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import score as S
from rentlens.functions import text as T

# Notice titles and severities by code. The sentences are our own; callers may pass others.
NOTICES = {
    "SENIOR_LEASE_RIGHT": ("선순위 전세권 확인", "보증금보다 먼저 변제받는 전세권이 살아 있습니다.", "HIGH"),
    "OWNER_MISMATCH": ("임대인과 소유자 불일치", "계약서의 임대인 이름이 등기 명의인과 다릅니다.", "CRITICAL"),
    "BAD_LANDLORD_MATCH": ("악성임대인 명단 일치", "등기 명의인이 공개된 상습 미반환 명단에 있습니다.", "CRITICAL"),
    "AUCTION_COMMENCED": ("경매개시 확인", "말소되지 않은 경매 절차가 진행 중입니다.", "CRITICAL"),
    "SEIZURE": ("압류 확인", "말소되지 않은 압류가 남아 있습니다.", "HIGH"),
    "PROVISIONAL_SEIZURE": ("가압류 확인", "말소되지 않은 가압류가 남아 있습니다.", "HIGH"),
    "PROVISIONAL_DISPOSITION": ("가처분 확인", "말소되지 않은 가처분이 남아 있습니다.", "HIGH"),
    "TRUST_REGISTRATION": ("신탁등기 확인", "신탁된 부동산이므로 누가 임대할 권한을 갖는지 신탁원부로 살펴야 합니다.", "HIGH"),
}
MISSING = {
    "OWNER_MATCH": ("임대인·소유자 일치 미확인", "임대인이 등기 명의인인지 아직 대조하지 못했습니다."),
    "BAD_LANDLORD_WATCHLIST": ("악성임대인 명단 조회 미완료", "명단과의 대조가 끝나지 않았습니다."),
    "ACTIVE_MAX_CLAIM_AMOUNT": ("근저당 채권최고액 미확인", "남은 근저당의 한도 금액을 읽지 못했습니다."),
    "SEIZURE": ("압류 여부 미확인", "압류가 있는지 읽지 못했습니다."),
    "PROVISIONAL_SEIZURE": ("가압류 여부 미확인", "가압류가 있는지 읽지 못했습니다."),
    "PROVISIONAL_DISPOSITION": ("가처분 여부 미확인", "가처분이 있는지 읽지 못했습니다."),
    "AUCTION_COMMENCED": ("경매개시 여부 미확인", "경매 절차가 있는지 읽지 못했습니다."),
    "TRUST_REGISTRATION": ("신탁등기 여부 미확인", "신탁 여부를 읽지 못했습니다."),
    "SENIOR_LEASE_RIGHT": ("선순위 전세권 여부 미확인", "앞선 전세권이나 임차권이 있는지 읽지 못했습니다."),
}
UNKNOWN_NOTICE = ("위험사항 확인", " 위험사항이 확인됐습니다.", "HIGH")
UNKNOWN_MISSING = ("추가 확인 필요", " 항목을 확인해 주세요.")
DROP_LABELS = {0: "현재 시세", 10: "매매가 10% 하락", 20: "매매가 20% 하락"}
# Actions in output order: label, text, when they apply.
ACTIONS = (
    ("정밀진단으로 추가 확인", "등기 서류를 올리면 담보와 소유 관계까지 살펴볼 수 있습니다.", "QUICK"),
    ("등기부등본 재발급", "서명하는 날 새로 뗀 서류에서 바뀐 권리가 없는지 살피세요.", "DETAILED"),
    ("계약 진행 보류", "드러난 권리 문제가 말소된 뒤에 계약하세요.", "WARNED"),
    ("미확인 항목 확인", "읽지 못한 항목을 채운 다음 결정하세요.", "MISSING"),
    ("보증보험 가입 확인", "반환 보증에 들 수 있는지와 그 한도를 알아보세요.", "ALWAYS"),
)
GRADE_LABELS = {"LOW": "낮음", "MEDIUM": "보통", "HIGH": "주의", "CRITICAL": "위험"}


def _rows(df: DataFrame, keys: list[str], items: list[tuple[Column, dict[str, Column]]], order: str) -> DataFrame:
    """Rows of the items whose condition holds, in order. One narrow pass."""
    structs = [F.when(cond, F.struct(*[c.alias(n) for n, c in cols.items()])) for cond, cols in items]
    kept = F.filter(F.array(*structs), lambda s: s.isNotNull())
    return df.select(*keys, F.posexplode(kept).alias(order, "_r")).select(*keys, order, "_r.*")


def price_scenarios(df: DataFrame, keys: list[str], sale: str = "sale") -> DataFrame:
    """Sale price, burden rate and verdict per price drop; none while the claim is unknown."""
    items = []
    for drop in S.DROP_RATES:
        rate = F.col(f"drop_{drop}")
        items.append((rate.isNotNull(), {
            "label": F.lit(DROP_LABELS[drop]), "price_drop_rate": F.lit(drop),
            "dropped_price": F.rint(F.col(sale).cast("double") * (1 - drop / 100)).cast("long"),
            "burden_rate": rate, "verdict": S.verdict(rate)}))
    return _rows(df, keys, items, "position")


def notices(df: DataFrame, keys: list[str], warnings: str = "warnings", missing: str = "missing_checks") -> DataFrame:
    """Notice rows of warning codes (with severity), then of missing checks (INFO)."""
    known = F.create_map(*[x for code, (t, d, s) in NOTICES.items()
                           for x in (F.lit(code), F.struct(F.lit(t).alias("title"), F.lit(d).alias("description"), F.lit(s).alias("severity")))])
    gaps = F.create_map(*[x for code, (t, d) in MISSING.items()
                          for x in (F.lit(code), F.struct(F.lit(t).alias("title"), F.lit(d).alias("description"), F.lit("INFO").alias("severity")))])
    other = lambda code, spec: F.struct(
        F.lit(spec[0]).alias("title"), F.concat(code, F.lit(spec[1])).alias("description"),
        F.lit(spec[2] if len(spec) > 2 else "INFO").alias("severity"))
    listed = F.concat(
        F.transform(F.col(warnings), lambda c: F.struct(c.alias("code"), F.coalesce(F.try_element_at(known, c), other(c, UNKNOWN_NOTICE)).alias("n"))),
        F.transform(F.col(missing), lambda c: F.struct(c.alias("code"), F.coalesce(F.try_element_at(gaps, c), other(c, UNKNOWN_MISSING)).alias("n"))))
    return df.select(*keys, F.posexplode(listed).alias("position", "_n")).select(*keys, "position", "_n.code", "_n.n.*")


def metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Metric rows by section; values are doubles, units as text. ``exact`` is the value before rounding for display."""
    detailed, always = F.col("mode") == "DETAILED", F.lit(True)
    adjusted = F.col("final_score") != F.col("base_total")
    policy = F.col("policy_adjustment") != 0
    rights = (F.col("final_score") - F.col("total")) != 0
    price_label = F.when(detailed, "담보 회수부담").otherwise("계약가격 부담")

    def m(cond, section, key, label, value, unit, exact=None):
        label = label if isinstance(label, Column) else F.lit(label)
        return cond, {"section": F.lit(section), "metric": F.lit(key), "label": label,
                      "value": value.cast("double"), "unit": F.lit(unit),
                      "exact": (value if exact is None else exact).cast("double")}

    c = F.col
    items = [
        m(always, "valuation", "salePrice", "예상 매매가", c("sale"), "원"),
        m(always, "valuation", "leasePrice", "예상 전세가", c("lease"), "원"),
        m(always, "valuation", "deposit", "계약 보증금", c("deposit"), "원"),
        m(detailed, "collateral", "deposit", "계약 보증금", c("deposit"), "원"),
        m(detailed, "collateral", "collateralBurden", "담보부담액", c("collateral_burden_amount"), "원"),
        m(detailed, "collateral", "collateralRate", "담보부담률", T.percent2(c("collateral_burden_rate")), "%", c("collateral_burden_rate") * 100),
        m(detailed, "collateral", "shortfall", "보증금 부족액", c("deposit_shortfall"), "원"),
        m(always, "riskScore", "total", "최종점수", c("final_score"), "점"),
        m(adjusted, "riskScore", "base", "기본 가중점수", c("base_total"), "점"),
        m(always, "riskScore", "priceBurden", price_label, c("price_burden"), "점"),
        m(always, "riskScore", "leaseMarketDeviation", "주변 전세수준 이탈", c("lease_market_deviation"), "점"),
        m(always, "riskScore", "marketTrend", "시장 추세", c("market_trend"), "점"),
        m(policy, "riskScore", "policyAdjustment", "가격 위험 하한 조정", c("policy_adjustment"), "점"),
        m(rights, "riskScore", "rightsAdjustment", "등기 권리 하한 조정", c("final_score") - c("total"), "점"),
    ]
    return _rows(df, keys, items, "position")


def actions(df: DataFrame, keys: list[str], warnings: str = "warnings", missing: str = "missing_checks") -> DataFrame:
    """Recommended actions in order."""
    detailed = F.col("mode") == "DETAILED"
    when = {
        "QUICK": ~detailed, "DETAILED": detailed, "ALWAYS": F.lit(True),
        "WARNED": detailed & (F.size(warnings) > 0), "MISSING": detailed & (F.size(missing) > 0),
    }
    return _rows(df, keys, [(when[w], {"label": F.lit(a), "description": F.lit(d)}) for a, d, w in ACTIONS], "position")


def nested_report(df: DataFrame, keys: list[str], **parts: DataFrame) -> DataFrame:
    """One row per contract with each part as a sorted array of structs.

    Every part holds a fixed, small number of rows per contract.
    """
    out = df.select(*keys)
    for name, rows in parts.items():
        cols = [c for c in rows.columns if c not in keys]
        out = out.join(
            rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), keys, "left")
    return out
