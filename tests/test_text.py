import datetime as dt

from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators import checklist, property as prop, rights


def values(spark, expr, rows):
    df = spark.createDataFrame([(x,) for x in rows], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_keys(spark):
    assert values(spark, T.lot_number, ["12.0", "12345", "산12", None, " 7 ", "0"]) == ["0012", "12345", "", "", "0007", "0000"]
    assert values(spark, T.squeeze, ["a 　 b\t", " x "]) == ["a b", "x"]
    assert values(spark, T.name_key, ["화서　아파트 A", None]) == ["화서아파트a", ""]
    assert values(spark, T.canonical, ["제 1-2호 Ab!", None, "é한"]) == ["제12호ab", "", "한"]
    assert values(spark, T.party_key, ["김 갑 800101-1234567"]) == ["김갑"]


def test_numbers_and_dates(spark):
    assert values(spark, T.clean_integer, ["476,000,000", "", "법인"]) == [476_000_000, None, None]
    assert values(spark, T.iso_date, ["2024-02-30", "2024-02-29", " 2024-1-5 ", "x"]) == [None, dt.date(2024, 2, 29), dt.date(2024, 1, 5), None]
    assert values(spark, T.loose_date, ["2026년 8월 2일", "2024-01-02", "12일"]) == ["2026-08-02", "2024-01-02", None]
    assert values(spark, T.first_decimal, ["전유 59.83㎡", "1,059", "x"]) == [59.83, 1059.0, None]
    assert values(spark, lambda c: T.add_months(c, 2), ["2024-11", "2024-12", "bad"]) == ["2025-01", "2025-02", None]


def test_age(spark):
    df = spark.createDataFrame([("800101-1", dt.date(2024, 6, 15)), ("240616", dt.date(2024, 6, 15)), ("240615", dt.date(2024, 6, 15)),
                                ("801301", dt.date(2024, 6, 15)), ("8001", dt.date(2024, 6, 15)), ("230101", dt.date(2024, 1, 1))], "b string, d date")
    assert [r[0] for r in df.select(T.birth_age(F.col("b"), F.col("d"))).collect()] == [44, 99, 100, None, None, 1]


def test_regions(spark):
    assert values(spark, T.region_of, ["부산광역시 해운대구 반여동 1", "대전 동구 동서대로 2", "Nowhere", None, "경기도 수원시 팔달구"]) == [
        "부산 해운대구", "대전 동구", None, None, "경기 수원시"]


def test_purpose_rules(spark):
    assert values(spark, T.target_ranks, ["7번(1)근저당권설정, 7번(2)근저당권설정 등기말소", "3 번 변경 3번", "1-1번 이전"]) == [["7(1)", "7(2)"], ["3"], ["1-1"]]
    kinds = values(spark, lambda c: T.right_kind(T.compact(c)), ["1 근저당권이전", "2 소유권이전청구권가등기", "근저당권 설정", "3번 압류 말소", "가압류", "압류", "기타"])
    assert kinds == ["MORTGAGE_TRANSFER", "PROVISIONAL_REGISTRATION", "MORTGAGE", "CANCELLATION", "PROVISIONAL_SEIZURE", "SEIZURE", "OTHER"]


def test_support(spark):
    df = spark.createDataFrame([("제101호", "제1301호"), ("제101호", "접수 제101호"), ("2024-01-02", "2024년 1월 2일"), ("2024-01-02", "2024년 01월 02일"), ("7", "x 7 y"), ("", "x")], "v string, t string")
    assert [r[0] for r in df.select(T.value_supported(F.col("v"), F.col("t"))).collect()] == [False, True, False, True, True, False]
    text = F.lit("7\n(1)근저당권설정\n  12 소유권\n1-1 변경")
    rank = lambda r: T.rank_supported(F.lit(r), T.line_heads(text), T.split_heads(text))
    row = spark.range(1).select(rank("7(1)"), rank("7(2)"), rank("12"), rank("1-1번"), rank("1"), rank("")).first()
    assert list(row) == [True, False, True, True, False, False]


def test_address_support(spark):
    a = lambda addr, src: T.tokens_in_order(T.address_tokens(F.lit(addr)), T.address_tokens(F.lit(src)))
    src = "이은의 주소 수원시 (팔달구) 인계동 384 주공 113-105"
    row = spark.range(1).select(a("수원시 인계동 384 105", src), a("인계동 수원시 384", src), a("수원시 384", src)).first()
    assert list(row) == [True, False, False]


def test_share(spark):
    df = spark.createDataFrame([("1/2", "지분 2분의 1"), ("2분의 1", "지분 2분의 1"), ("1/3", "지분 2분의 1"), (None, "x")], "s string, t string")
    assert [r[0] for r in df.select(T.share_fraction(F.col("s"), F.col("t"))).collect()] == ["1/2", "1/2", None, None]


def test_labels(spark):
    df = spark.createDataFrame([(189_000_000,), (100_000_000,), (99_999_999,), (-50_000,), (4_999,), (None,)], "v long")
    assert [r[0] for r in df.select(T.money_label(F.col("v"))).collect()] == ["1억 8,900만원", "1억원", "1억원", "-5만원", "4,999원", "확인 필요"]
    assert spark.range(1).select(T.rate_label(F.lit(0.4525))).first()[0] == "45.25%"
    assert values(spark, T.file_tag, ["registry] [PAGE 99].pdf", " "]) == ["registry_ _PAGE 99_.pdf", "unnamed.pdf"]


def test_sections(spark):
    gap, eul = T.section_texts(F.col("x"))
    df = spark.createDataFrame([("a【 갑 구 】own[을구]other",), ("【을구】x",), ("none",), ("[갑구] y",)], "x string")
    assert [tuple(r) for r in df.select(gap, eul).collect()] == [("own", "other"), (None, "x"), (None, None), (" y", None)]


def test_units(spark):
    addr = "인천광역시 미추홀구 주안동 75-89 스타캐슬 제6층 제602호"
    cols = rights.unit_columns(F.lit("CONDOMINIUM"), F.lit(addr), F.lit("주안"), F.lit("6"), F.lit("602"), F.lit("59.83"))
    assert list(spark.range(1).select(*cols.values()).first()) == [None, 6, "602", 59.83]
    land = rights.unit_columns(F.lit("LAND"), F.lit(addr), F.lit("주안"), F.lit("6"), F.lit("602"), F.lit("59.83"))
    assert list(spark.range(1).select(*land.values()).first()) == [None] * 4


def test_excerpt_takes_neighbours_of_first_hit(spark):
    text = F.lit("one\n\ntwo 100호\nthree\nfour\nfive 100호")
    assert spark.range(1).select(T.excerpt(text, [F.lit("제100호"), F.lit("100")])).first()[0] == "one | two 100호 | three"


def test_structure(spark):
    good = ("등기사항전부증명서(말소사항 포함)\n고유번호 1234-5678-001234\n[집합건물] 서울특별시 중구\n【 표 제 부 】\n【 갑 구 】\n순위번호 등기목적 접수 등기원인 권리자 및 기타사항\n【 을 구 】\n기록사항 없음")
    df = spark.createDataFrame([(good,), ("등기사항전부증명서 부동산 전세계약서 보증금",), ("  ",)], "full_text string")
    got = rights.document_structure(df).collect()
    assert [r.structure_status for r in got] == ["VALID_REGISTRY", "INVALID_DOCUMENT", "UNREADABLE"]
    assert got[0].missing_signals == [] and got[2].missing_signals == ["text_layer"]


def test_ledger_helpers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(prop.title_housing_type(F.lit("업무시설(오피스텔), 아파트"), F.lit(""))) == "OFFICETEL"
    assert one(prop.title_housing_type(F.lit("점포"), F.lit("단독 주택"))) == "DETACHED_MULTI"
    assert one(prop.title_housing_type(F.lit("점포"), F.lit("공동주택"))) is None
    assert one(prop.detached_label(F.lit("SALE"), F.lit("다가구주택"), F.lit(None).cast("string"))) == "다가구"
    c = checklist.checklist_columns({k: F.lit(None).cast("string") for k in ("housing_type_code", "contract_type", "tenant_type", "landlord_type", "contract_address")}
                                    | {f: F.lit(True) for f in checklist.FLAGS})
    assert one(c["housing_type_name"]) == "아파트" and one(c["officetel_residential_marked"]) is False


def test_percent(spark):
    df = spark.createDataFrame([(0.45678,), (1 / 3,), (None,)], "x double")
    assert [r[0] for r in df.select(T.percent2(F.col("x"))).collect()] == [45.68, 33.33, None]


def test_excerpt_takes_any_number_of_values(spark):
    text = F.lit("\n".join(f"line {c}{c}" for c in "abcdefghij"))
    more = F.array(*[F.lit(c * 2) for c in "acegi"])
    assert spark.range(1).select(T.excerpt(text, [F.lit("zz")], more)).first()[0].count(" | ") == 9


def test_excerpt_splits_at_every_line_end(spark):
    from pyspark.sql import functions as F
    for end in ("\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " "):
        df = spark.createDataFrame([(end.join(["first", "second", "wanted", "after", "last"]),)], "p string")
        assert df.select(T.excerpt(F.col("p"), [F.lit("wanted")])).first()[0] == "second | wanted | after"
