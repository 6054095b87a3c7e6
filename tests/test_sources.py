import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from rentlens.operators import features, series, watchlist
from rentlens.sources import files, payloads, sinks


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "fund.csv"
    path.write_text("﻿공시일,대상연월,신규취급액기준_COFIX,기타\n2024-02-15,2024-01-31,3.5,x\n2024-02-30,2024-01,3.1,x\n2024-03-15,2024-02,-,x\n", encoding="utf-8")
    raw = files.read_csv(spark, str(path), ["공시일", "대상연월", "신규취급액기준_COFIX"])
    rows = series.funding_rates(raw).collect()
    assert [(str(r.publication_date), r.target_month, r.value) for r in rows] == [("2024-02-15", "2024-01", 3.5)]
    with pytest.raises(ValueError):
        files.read_csv(spark, str(path), ["없음"])


def test_raw_series(spark):
    index = spark.createDataFrame([
        ("매매", "아파트", "전국 > 서울", "서울", "전체", "2024-01", "가격지수", "원자료", "99.1", "정상"), ("매매", "아파트", "전국", "전국", "전체", "2024-01", "가격지수", "전기대비증감률", "x", "정상"),
        ("매매", "오피스텔", "전국", "전국", "전체", "2024-01", "오피스텔가격", "평균단위당 매매", "12", "정상"), ("매매", "아파트", "전국", "전국", "전체", "2024-01", "중위단위가격", "a", "7", "결측")],
        ["거래유형", "주택유형", "지역경로", "최종지역명", "규모", "기준연월", "지표분류", "세부지표", "수치값", "값상태"])
    got = series.price_index(index).collect()
    assert sorted((r.feature_name, r.value) for r in got) == [("RONE_가격지수", 99.1), ("RONE_평균단위가격_천원㎡", 12.0)]
    assert set(files.typed(series.price_index(index), files.PRICE_INDEX).columns) == set(TY.StructType.fromDDL(files.PRICE_INDEX).fieldNames())
    macro = spark.createDataFrame([("2024-03", "2024-01", "Y", "Y", "1.5", "-", "2")], ["계약연월", "원자료_기준연월", "잠정치포함여부", "KOSIS_가용여부", "선행지수_순환변동치", "경제심리지수", "건설기성액"])
    assert sorted((r.feature_name, r.value, r.provisional) for r in series.macro_series(macro).collect()) == [
        ("KOSIS_건설기성액", 2.0, True), ("KOSIS_선행지수_순환변동치", 1.5, True)]
    rate = spark.createDataFrame([("2024-02", "2024-01", "4.1", "N", "Y"), (None, "2024-01", "4", "N", "Y"), ("2024-03", "2024-02", "4", "N", "N")],
                                 ["계약연월", "주담대금리_기준연월", "주담대금리_적용값", "주담대금리_잠정치여부", "주담대금리_가용여부"])
    assert [(r.contract_month, r.value, r.provisional) for r in series.mortgage_rates(rate).collect()] == [("2024-02", 4.1, False)]


def test_contract_and_defaults_files(spark, tmp_path):
    model = {"feature_count": 2, "features": ["층", "단지명"], "categorical_features": ["단지명"], "inactive_features": [], "target": {"area_feature": "층", "inverse_primary": "exp(y_pred)"}}
    (tmp_path / "c.json").write_text(json.dumps({"매매_아파트": model}, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "d.json").write_text(json.dumps({"version": "v1", "models": {"매매_아파트": {"층": 9.0, "단지명": "현대"}}}, ensure_ascii=False), encoding="utf-8")
    models = features.read_contract(spark, str(tmp_path / "c.json"))
    rows = features.contract_rows(models).orderBy("ordinal").collect()
    assert [(r.feature, r.categorical) for r in rows] == [("층", False), ("단지명", True)]
    assert features.contract_totals(models, 1, 2).first().features_ok
    wide = features.default_columns(features.read_defaults(spark, str(tmp_path / "d.json")), ["층", "단지명"], ["단지명"]).first()
    assert (wide["default_층"], wide["default_단지명"]) == (9.0, "현대")


def test_files_per_model(spark, tmp_path):
    for name in ("06_a_매매_아파트.parquet", "06_전세_아파트_1.parquet", "06_전세_아파트_2.parquet"):
        spark.createDataFrame([(1, 2)], "a int, b int").coalesce(1).toPandas().to_parquet(tmp_path / name)
    got = {r.model_key: (r.files, r.status) for r in files.file_counts(spark, f"{tmp_path}/06_*.parquet", ["매매_아파트", "전세_아파트", "매매_오피스텔"]).collect()}
    assert got == {"매매_아파트": (1, "FOUND"), "전세_아파트": (2, "DUPLICATE"), "매매_오피스텔": (0, "MISSING")}
    assert files.read_parquet(spark, str(tmp_path / "06_a_매매_아파트.parquet"), ["b"]).columns == ["b"]


def test_xml_file(spark, tmp_path):
    items = ("<item><deposit>31,500</deposit><monthlyRent>0</monthlyRent><excluUseAr>71.35</excluUseAr><dealYear>2023</dealYear><dealMonth>11</dealMonth><dealDay>8</dealDay><umdNm>솔내동</umdNm><aptNm>버들아파트</aptNm></item>"
             "<item><deposit>4,200</deposit><monthlyRent>45</monthlyRent></item><item><deposit>32,700</deposit><monthlyRent>0</monthlyRent><cdealDay>20231203</cdealDay></item>")
    (tmp_path / "rent.xml").write_text(f"<response><body><items>{items}</items></body></response>", encoding="utf-8")
    rows = payloads.rent_transactions(payloads.read_xml_items(spark, str(tmp_path / "rent.xml")), []).collect()
    assert [(r.deposit, r.area, str(r.contract_date), r.legal_dong, r.building_name) for r in rows] == [(315_000_000, 71.35, "2023-11-08", "솔내동", "버들아파트")]


def test_html_watchlist(spark):
    cells = ["홍 길동", "44", "서울특별시 강남구 1", "123,400,000", "2020-01-01", "100", "-", "-", "2", "2024-06-15"]
    row = "<tr>" + "".join(f"<td class='x'> <b>{c}</b>&nbsp;</td>" for c in cells) + "</tr>"
    page = f"<table><tr><th>name</th></tr>{row}<tr><td>short</td></tr></table><p>3 / 17</p>"
    df = spark.createDataFrame([(1, page)], "id int, html string")
    clean = watchlist.clean_watchlist(payloads.table_rows(df, ["id"], "html")).first()
    assert (clean.name, clean.age, clean.return_debt_amount, clean.address_sigungu, str(clean.posted_date)) == ("홍 길동", 44, 123_400_000, "서울 강남구", "2024-06-15")
    assert df.select(payloads.page_total(F.col("html"))).first()[0] == 17


def test_refresh_keeps_the_old_version_until_the_new_one_is_whole(spark, tmp_path):
    folder = str(tmp_path)
    a = spark.createDataFrame([(1,), (2,)], "x int")
    sinks.refresh_table(a, folder, "rates", "v1")
    sinks.refresh_table(a, folder, "index", "v1")
    with pytest.raises(ValueError):
        sinks.refresh_table(a.where("x > 9"), folder, "rates", "v2")
    assert sinks.read_current(spark, folder, "rates").count() == 2
    meta = sinks.refresh_table(a.union(a), folder, "rates", "v3")
    assert {r.source_name: (r.version, r.row_count) for r in meta.collect()} == {"rates": ("v3", 4), "index": ("v1", 2)}
    assert sinks.read_current(spark, folder, "rates").count() == 4


def test_csv_sink_round_trip(spark, tmp_path):
    sinks.write_csv(spark.createDataFrame([("a", 1)], "name string, n int"), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), ["name", "n"]).first().name == "a"


def test_register_tables_have_stable_ids(spark):
    df = spark.createDataFrame([("A1", "SUCCESS", [(" 홍길동 ", "800101"), ("김", "")], [("갑구", "SEIZURE")])],
                               "analysis_id string, parse_status string, current_owners array<struct<name:string,jumin_front:string>>, rights array<struct<section:string,kind:string>>")
    one, two = sinks.register_tables(df), sinks.register_tables(df)
    assert one["registry_owners"].collect() == two["registry_owners"].collect()
    assert one["registry_rights"].first().section == "GAP" and one["registry_results"].columns == ["analysis_id", "parse_status", "registry_result_id"]
    checks = spark.createDataFrame([("A1", "홍길동", "800101 "), ("A1", "다른", "")], "analysis_id string, name string, jumin_front string")
    got = {r.name: r.registry_owner_id for r in sinks.attach_owner_ids(checks, one["registry_owners"]).collect()}
    assert got["홍길동"] is not None and got["다른"] is None


def test_stream_restarts_without_repeating_rows(spark, tmp_path):
    from rentlens.streaming import contracts as stream
    ddl = "id int, sale long, lease long, deposit long, claim long, mode string, trend int"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    row = lambda i, dep: (i, 400_000_000, 180_000_000, dep, None, "QUICK", 0)
    for batch in ([row(1, 200_000_000), row(2, -5)], [row(3, 180_000_000)]):
        spark.createDataFrame(batch, ddl).write.mode("append").parquet(src)
        q = stream.write_scores(stream.score_stream(stream.read_contracts(spark, src, TY.StructType.fromDDL(ddl))), out, state)
        q.awaitTermination()
    assert {r.id: r.total for r in spark.read.parquet(out).collect()} == {1: 31, 3: 14}


def test_unreadable_list_keeps_its_row(spark):
    body = lambda item: '{"response": {"header": {"resultCode": "00"}, "body": {"items": {"item": ' + item + "}}}}"
    rows = [(1, body('[{"a": "x"}]')), (2, body("[1, 2]")), (3, body('""')), (4, "no json")]
    out = payloads.ledger_rows(spark.createDataFrame(rows, "k int, p string"), ["k"], "p", "struct<a:string>").collect()
    assert {(r.k, r.result_code) for r in out} == {(1, "00"), (2, "UNREADABLE"), (4, "UNREADABLE")}


def test_reload_of_the_current_version(spark, tmp_path):
    first = sinks.refresh_table(spark.range(3).toDF("x"), str(tmp_path), "t", "v1").collect()[0]
    again = sinks.refresh_table(spark.range(5).toDF("x"), str(tmp_path), "t", "v1").collect()[0]
    assert first.path != again.path and spark.read.parquet(first.path).count() == 3 and spark.read.parquet(again.path).count() == 5
    with pytest.raises(ValueError):
        sinks.refresh_table(spark.range(0).toDF("x"), str(tmp_path), "t", "v1")
    assert spark.read.parquet(again.path).count() == 5


def test_arrivals_are_written_and_read_by_several_tasks(spark, tmp_path):
    from rentlens.streaming import contracts
    folder = tmp_path / "requests"
    requests = spark.range(0, 1000, 1, 4).selectExpr("id", "timestamp_seconds(1700000000 + id) AS at")
    contracts.write_arrival(requests, str(folder), 4)
    contracts.write_arrival(requests.where("id < 100").union(requests.where("id < 50")), str(folder), 4)
    files = list(folder.glob("*.parquet"))
    assert len(files) > 4
    unique = contracts.unique_requests(contracts.read_contracts(spark, str(folder), requests.schema, files_per_batch=4), "id", "at", "30 days")
    contracts.write_scores(unique, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1000))
