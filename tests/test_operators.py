import datetime as dt
import random
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.operators import asof, comparables, distribution, features, match, merge, property as prop, quality, valuation, watchlist


def test_exact_percentiles_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([-5, 0, 7, rng.randint(-10**6, 10**9)]))) for _ in range(4000)] + [
        (f"g{rng.randint(0, 40)}", rng.uniform(-3, 3)) for _ in range(2000)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.g: r for r in distribution.exact_percentiles(df, ["g"], "v", probs).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None:
            by[g].append(v)
    assert set(got) == set(by)
    for g, vs in by.items():
        for n, p in probs.items():
            assert got[g][n] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)


def test_top_value_breaks_ties_by_the_smallest(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("b", "z"), ("b", "z"), ("b", "a")], "g string, v string")
    assert {r.g: (r.v, r.distinct_values) for r in distribution.top_value(df, ["g"], "v").collect()} == {"a": ("x", 2), "b": ("z", 2)}


def test_asof_date_join_equals_brute_force(spark):
    rng = random.Random(1)
    day0 = dt.date(2020, 1, 1)
    series = sorted({(rng.choice("ab"), day0 + dt.timedelta(rng.randint(0, 900))) for _ in range(60)})
    series = [(k, d, float(i)) for i, (k, d) in enumerate(series)]
    left = [(i, rng.choice("abc"), day0 + dt.timedelta(rng.randint(-40, 1400))) for i in range(500)]
    s, l = spark.createDataFrame(series, "k string, d date, v double"), spark.createDataFrame(left, "i int, k string, t date")
    got = {r.i: r.v for r in asof.asof_date_join(l, "t", s, "d", ["v"], ["k"]).collect()}
    for i, k, t in left:
        older = [(d, v) for kk, d, v in series if kk == k and d <= t]
        assert got[i] == (max(older)[1] if older else None)
    assert len(got) == len(left)
    plain = [(d, v) for d, v in {d: v for _, d, v in series}.items()]
    got = {r.i: r.v for r in asof.asof_date_join(l, "t", spark.createDataFrame(plain, "d date, v double"), "d", ["v"]).collect()}
    for i, _, t in left:
        older = [x for x in plain if x[0] <= t]
        assert got[i] == (max(older)[1] if older else None)


def test_match_reaches_every_rung(spark):
    ref = spark.createDataFrame([
        ("d", "0001", "0000", "APARTMENT", " Alpha ", "", 3), ("d", "0002", "0000", "APARTMENT", "Beta", "", 2), ("d", "0002", "0000", "APARTMENT", "Gamma", "", 2),
        ("d", "0002", "0000", "APARTMENT", "ga mma", "", 5), ("e", "0003", "0000", "APARTMENT", "Beta", "", 9), ("d", "0009", "0000", "VILLA", "V", "", 1)],
        "district string, bun string, ji string, housing_type string, model_name string, source_building_name string, sample_count long")
    probes = spark.createDataFrame([
        (1, "d", "0001", "0000", "APARTMENT", "x"), (2, "d", "0002", "0000", "APARTMENT", "GA MMA"), (3, "d", "0002", "0000", "APARTMENT", "new"),
        (4, "d", "0002", "0000", "APARTMENT", None), (5, "d", "7777", "0000", "APARTMENT", " new "), (6, "d", "7777", "0000", "APARTMENT", ""),
        (7, "zz", "7777", "0000", "APARTMENT", None), (8, "zz", "1", "0000", "OFFICETEL", None)],
        "id int, district string, bun string, ji string, housing_type string, observed_name string")
    got = {r.id: (r.method, r.model_name, len(r.warnings)) for r in match.match_names(probes, ref).collect()}
    assert got == {1: ("parcel", "Alpha", 0), 2: ("building_name", "ga mma", 0), 3: ("ambiguous_observed_name", "new", 2), 4: ("parcel_frequency", "ga mma", 2),
                   5: ("unseen_address_name", "new", 1), 6: ("district_frequency", "ga mma", 2), 7: ("type_frequency", "Beta", 2), 8: ("no_reference", None, 0)}


def test_watchlist_with_a_hot_name(spark):
    hot = [("Kim", a, dt.date(2020 + i % 3, 6, 15)) for i, a in enumerate(range(20, 60))]
    entries = spark.createDataFrame(hot + [("Lee", None, dt.date(2020, 1, 1))], "name string, age int, posted_date date")
    people = [("Kim", "800101-1"), ("Kim", ""), ("Kim", "809901"), ("Lee", "800101"), ("Park", "800101"), ("", "800101"), (None, None)] + [("Kim", f"{y:02d}0616") for y in range(0, 100, 7)]
    owners = spark.createDataFrame([(i, n, j) for i, (n, j) in enumerate(people)], "id int, name string, jumin_front string")

    def expected(name, jumin):
        rows = [e for e in hot + [("Lee", None, dt.date(2020, 1, 1))] if e[0] == name]
        if not name or not rows:
            return "NO_MATCH"
        for _, age, posted in rows:
            head = (jumin or "").split("-")[0]
            if age is None or len(head) != 6:
                continue
            yy = int(head[:2])
            year = 1900 + yy if posted.year - 1900 - yy <= 100 else 2000 + yy
            try:
                born = dt.date(year, int(head[2:4]), int(head[4:]))
            except ValueError:
                continue
            if posted.year - born.year - ((posted.month, posted.day) < (born.month, born.day)) == age:
                return "MATCH_HIGH"
        return "MATCH_NAME_ONLY"

    got = {r.id: r for r in watchlist.match_owners(owners, entries, ["id"]).collect()}
    assert {i: r.match_status for i, r in got.items()} == {i: expected(*p) for i, p in enumerate(people)}
    assert got[0].candidate_count == 40 and got[5].candidate_count == 0


def comparable(spark, extra=()):
    deals = [(100_000_000 + 10_000_000 * i, 59.8 + 0.1 * i, dt.date(2026, i + 1, 10), "화서동", "화서 아파트") for i in range(6)] + list(extra)
    t = spark.createDataFrame(deals, "deposit long, area double, contract_date date, legal_dong string, building string")
    from rentlens.functions import text as T
    t = t.withColumn("building", T.name_key(F.col("building")))
    c = spark.createDataFrame([(1, 135_000_000, 59.8, dt.date(2026, 6, 30), "화서동", "화서아파트"), (2, 1, 10.0, dt.date(2026, 6, 30), "화서동", "x"),
                               (3, 120_000_000, 59.8, dt.date(2026, 6, 30), "화서동", "other")],
                              "id int, deposit long, area double, contract_date date, legal_dong string, building string")
    return {r.id: r for r in comparables.compare(c, t, (("SAME_BUILDING", ("legal_dong", "building")), ("SAME_DONG", ("legal_dong",)))).collect()}, t


def test_comparables(spark):
    got, t = comparable(spark)
    r = got[1]
    assert (r.comparable_status, r.scope, r.sample_count) == ("AVAILABLE", "SAME_BUILDING", 6)
    assert (r.percentile_25, r.median, r.percentile_75, r.user_deposit_percentile) == (112_500_000, 125_000_000, 137_500_000, 66.7)
    assert (r.minimum, r.maximum) == (100_000_000, 150_000_000)
    assert got[2].comparable_status == "UNAVAILABLE" and got[2].sample_count == 0
    assert (got[3].scope, got[3].sample_count, got[3].user_deposit_percentile) == ("SAME_DONG", 6, 50.0)
    rule = comparables.ComparableRule()
    place = ["legal_dong", "building"]
    bins = comparables.histogram(comparables.cell_rows(comparables.counted(t, place, rule), place, rule), place, rule.bins)
    cell = bins.where((F.col("month") == 2026 * 12 + 5) & (F.col("band") == 11)).collect()
    assert sum(b["count"] for b in cell) == 6 and len(cell) == 5


def test_comparables_counts_repeated_deposits(spark):
    got, _ = comparable(spark, [(135_000_000, 60.0, dt.date(2026, 6, 1), "화서동", "화서 아파트")] * 3)
    assert got[1].sample_count == 9 and got[1].user_deposit_percentile == round(700 / 9, 1) and got[1].median == 135_000_000


def test_hot_district_reaches_a_cell_as_one_row_for_each_deposit(spark):
    """Buildings, repeated deals and repeated contracts of one district and month are summed before the cell shuffle."""
    n = F.col("id")
    t = spark.range(20_000).select(
        ((n % 50 + 1) * 1_000_000).alias("deposit"), F.lit(61.0).alias("area"), F.lit(dt.date(2026, 6, 1)).alias("contract_date"),
        F.lit("d").alias("legal_dong"), F.concat(F.lit("b"), (n % 400).cast("string")).alias("building"))
    rule = comparables.ComparableRule(window_months=2)
    counts = comparables.counted(t, ["legal_dong", "building"], rule)
    asks = t.select("legal_dong", F.lit(12).cast("long").alias("band"), F.lit(2026 * 12 + 5).alias("month"), "deposit")
    rows = comparables.cell_rows(counts, ["legal_dong"], rule, asks)
    assert rows.count() == 50 * 3 * 2 and rows.agg(F.sum("n")).first()[0] == 20_000 * 6
    stats = comparables.asked_statistics(rows, ["legal_dong"]).collect()
    assert len(stats) == 50 and {r.sample_count for r in stats} == {20_000}
    assert {r.deposit: r.not_above for r in stats} == {k * 1_000_000: k * 400 for k in range(1, 51)}


def test_only_asked_cells_get_copies(spark):
    """Asked cells are those of all cells, row for row; others are not made."""
    rng = random.Random(5)
    t = spark.createDataFrame([(rng.randint(1, 6) * 10**6, rng.uniform(40, 70), dt.date(2026, rng.randint(1, 9), 3), rng.choice(["d", "e", None])) for _ in range(300)],
                              "deposit long, area double, contract_date date, legal_dong string")
    rule = comparables.ComparableRule(window_months=3)
    asks = spark.createDataFrame([("d", 11, 2026 * 12 + m, 10**6 * m) for m in (2, 2, 5)] + [("e", 9, 2026 * 12 + 8, 7), ("x", 9, 2026 * 12, 1), (None, 11, 2026 * 12 + 2, 1)],
                                 "legal_dong string, band long, month int, deposit long")
    counts = comparables.counted(t, ["legal_dong"], rule)
    cell = lambda r: (r.legal_dong, r.band, r.month)
    wanted = {cell(r) for r in asks.collect()}
    every = comparables.cell_rows(counts, ["legal_dong"], rule, asks).collect()
    got = comparables.asked_rows(counts, ["legal_dong"], rule, asks).collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in every if cell(r) in wanted and (r.legal_dong is not None or r.asked))
    assert {cell(r) for r in got} == wanted


def test_window_statistics_make_no_row_for_each_month(spark, monkeypatch):
    """The same statistics as those of all copied rows, from few rows; windows reach over the ends of runs and batches."""
    rng = random.Random(6)
    t = spark.createDataFrame([(rng.randint(1, 40) * 10**6, rng.uniform(40, 70), dt.date(2025 + i % 2, rng.randint(1, 12), 3), rng.choice(["d", "e", None]), rng.choice("xyz")) for i in range(900)],
                              "deposit long, area double, contract_date date, legal_dong string, building string")
    rule = comparables.ComparableRule(window_months=4)
    counts = comparables.counted(t, ["legal_dong", "building"], rule)
    asks = spark.createDataFrame([(rng.choice(["d", "e", "x", None]), rng.choice("xyz"), rng.randint(6, 15), 2025 * 12 + rng.randint(0, 30), rng.randint(0, 45) * 10**6) for _ in range(400)],
                                 "legal_dong string, building string, band long, month int, deposit long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for place in (["legal_dong"], ["legal_dong", "building"]):
            plain = comparables.asked_statistics(comparables.asked_rows(counts, place, rule, asks), place).where("sample_count > 0").dropna(subset=place)
            got = comparables.window_statistics(counts, place, rule, asks)
            assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_bands_and_months_are_copied_at_edges_only(spark, monkeypatch, tmp_path):
    rng = random.Random(8)
    t = spark.createDataFrame([(i * 10_000, rng.uniform(0, 50), dt.date(2024 + i % 2, i % 12 + 1, 3), "d") for i in range(4_000)],
                              "deposit long, area double, contract_date date, legal_dong string")
    slide = comparables._slide

    def counting(group, window):
        work = slide(group, window)

        def run(batches):
            def seen():
                for b in batches:
                    (tmp_path / uuid.uuid4().hex).write_text(str(b.num_rows))
                    yield b
            return work(seen())
        return run
    monkeypatch.setattr(comparables, "_slide", counting)
    got = comparables.compare(t, t, (("SAME_DONG", ("legal_dong",)),), comparables.ComparableRule(window_months=6))
    assert got.where("comparable_status = 'AVAILABLE'").count() == 4_000
    # 4,000 questions, 4,000 counts and the ranges of 10 bands and 24 months; with a copy for each band there were over 12,000 counts
    assert 8_000 <= sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 4_000 + 2.2 * 4_240


def test_steps_of_the_ladder_do_not_stay_on_disk(spark, monkeypatch):
    seen, store = [], comparables.cut_lineage
    monkeypatch.setattr(comparables, "cut_lineage", lambda df: seen.append(store(df)) or seen[-1])
    comparable(spark)
    left = 0
    for t in seen:
        path = spark._jvm.org.apache.hadoop.fs.Path(t._jdf.inputFiles()[0]).getParent()
        left += path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    assert len(seen) > 3 and left == 1


def test_histogram_of_all_cells_equals_that_of_their_rows(spark):
    rng = random.Random(7)
    t = spark.createDataFrame([(rng.randint(1, 40) * 10**6, rng.uniform(40, 70), rng.choice([None, dt.date(2026, rng.randint(1, 9), 3)]), rng.choice(["d", "e", None])) for _ in range(500)],
                              "deposit long, area double, contract_date date, legal_dong string")
    rule = comparables.ComparableRule(window_months=3)
    counts = comparables.counted(t, ["legal_dong"], rule)
    plain = comparables.histogram(comparables.cell_rows(counts, ["legal_dong"], rule), ["legal_dong"], rule.bins)
    got = comparables.all_cells_histogram(counts, ["legal_dong"], rule)
    assert got.columns == plain.columns and sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    # no window or sort over the deposits of a cell
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_trees_hold_no_slots_that_never_change(spark):
    rng = random.Random(8)
    rows = spark.createDataFrame([(float(i % 50), rng.choice("abc"), "same", rng.random() + i % 50) for i in range(400)], "x double, g string, h string, label double")
    model = valuation.fit_price_model(rows, ["x"], ["g", "h"], trees=3)
    assert 1 <= model.stages[-1].numFeatures <= 4
    got = valuation.estimate(model, rows)
    assert got.columns[:4] == rows.columns and "_slots" not in got.columns and got.where("price_reject is null").count() == 400
    plain = valuation.fit_price_model(rows, ["x"], ["h"], trees=3)
    assert valuation.estimate(plain, rows).count() == 400


def test_buckets_rise_with_the_value_at_every_magnitude(spark):
    values = [float("-inf"), -1e308, -2.0, -1e-3, -5e-324, 0.0, 5e-324, 1e-300, 1e-4, 4e-4, 9e-4, 0.5, 1.0, 1.01, 1e9, 1.01e9, 1.7976931348623157e308, float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = [r.b for r in df.select("i", distribution.bucket_of(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(set(got))


def greedy(claims, sigs):
    kept, seen = [], defaultdict(set)
    for merge_id, doc, seq, cid in sorted(claims):
        s = sigs.get(cid, set())
        if doc > 0 and s & seen[merge_id]:
            continue
        kept.append(cid)
        seen[merge_id] |= s
    return kept


def test_greedy_dedupe_equals_a_sequential_walk(spark):
    rng = random.Random(9)
    claims, sigs = [], {}
    for i in range(400):
        m = 0 if i % 3 == 0 else rng.randint(1, 30)  # one hot merge group
        claims.append((m, rng.randint(0, 3), i, f"c{i}"))
        sigs[f"c{i}"] = {f"s{rng.randint(0, 60 if m == 0 else 5)}" for _ in range(rng.randint(0, 3))}
    c = spark.createDataFrame(claims, "merge_id int, document_index int, seq int, claim_id string")
    merges = {cid: m for m, _, _, cid in claims}
    s = spark.createDataFrame([(cid, merges[cid], x) for cid, xs in sigs.items() for x in xs], "claim_id string, merge_id int, signature string")
    assert sorted(r.claim_id for r in merge.greedy_dedupe(c, s.join(c.drop("merge_id"), "claim_id")).collect()) == sorted(greedy(claims, sigs))


MERGE = "claim_id string, merge_id int, doc_id int, document_index int, seq int, rank_no string, receipt_no string, registered_at string, creditor string, debtor string, amount long, status string, joint boolean"


@pytest.mark.parametrize("joint,receipts,dates,count,total", [
    (True, ("제100호", "제200호"), ("2020-01-02", "2020-01-02"), 1, 650), (False, ("제100호", "제200호"), ("2020-01-02", "2020-01-02"), 2, 1300),
    (False, ("제100호", "제100호"), ("2020-01-02", "2021-01-02"), 2, 1300), (False, ("제100호", "제100 호"), ("2020-01-02", "2020-01-02"), 1, 650)])
def test_land_and_building_claims(spark, joint, receipts, dates, count, total):
    rows = [(f"c{i}", 1, 10 + i, i, 1, "1", receipts[i], dates[i], "은행", "홍길동 800101-1234567", 650, "ACTIVE", joint) for i in range(2)]
    claims = spark.createDataFrame(rows, MERGE)
    links = spark.createDataFrame([], "doc_id int, rank_no string, registered_at string, receipt_no string, amount long")
    r = merge.merged_totals(merge.greedy_dedupe(claims, merge.claim_signatures(claims, links))).first()
    assert (r.active_mortgage_count, r.total_active_max_claim_amount) == (count, total)


def test_shared_amendment_joins_claims(spark):
    rows = [(f"c{i}", 1, 10 + i, i, 1, "1", f"제{i}호", "2020-01-02", None, f"d{i}", 132, "ACTIVE", True) for i in range(2)]
    claims = spark.createDataFrame(rows, MERGE)
    links = spark.createDataFrame([(10, "1", "2025-11-03", "제5호", None), (11, "1", "2025-11-03", "제5호", None)], "doc_id int, rank_no string, registered_at string, receipt_no string, amount long")
    assert merge.merged_totals(merge.greedy_dedupe(claims, merge.claim_signatures(claims, links))).first().active_mortgage_count == 1


def test_merge_check_codes(spark):
    docs = spark.createDataFrame([
        (1, 1, 0, "BUILDING", "가 1-2"), (1, 2, 1, "LAND", "가1 2"), (2, 3, 0, "BUILDING", "가"), (2, 4, 1, "LAND", "나"), (3, 5, 0, "LAND", "가"), (3, 6, 1, "LAND", "가"),
        (4, 7, 0, "LAND", "가"), (4, 8, 1, "BUILDING", "가"), (5, 9, 0, "CONDOMINIUM", None)], "merge_id int, doc_id int, document_index int, document_type string, property_address string")
    owners = spark.createDataFrame([(i, "홍 길동", "800101", "1/2") for i in range(1, 8)] + [(8, "다른", "800101", "1/2")], "doc_id int, name string, jumin_front string, share string")
    got = {r.merge_id: (r.reject_code, r.primary_doc) for r in merge.merge_check(docs, owners).collect()}
    assert got == {1: (None, 1), 2: ("REGISTRY_PROPERTY_MISMATCH", 3), 3: ("REGISTRY_DOCUMENT_SET_INVALID", 5), 4: ("REGISTRY_OWNER_MISMATCH", 8), 5: (None, 9)}


def test_fallbacks(spark):
    df = spark.createDataFrame([(1, float("nan"), 0, " ", True), (2, 2.5, 3, "x", False)], "id int, a double, k int, name string, flag boolean").withColumns(
        {"default_a": F.lit(9.0), "default_k": F.lit("K"), "default_name": F.lit("N"), "default_flag": F.lit(1.0)})
    got = features.with_fallbacks(df, ["a", "k", "name", "flag"], ["k", "name"]).orderBy("id").collect()
    assert (got[0].a, got[0].k, got[0].name, got[0].flag, got[0].fallback_features) == (9.0, "K", "N", 1.0, ["a", "k", "name", "flag"])
    assert (got[1].a, got[1].k, got[1].name, got[1].fallback_features) == (2.5, "3", "x", ["flag"])
    one = features.derived_columns(F.lit(dt.date(2026, 8, 1)), F.lit(1991), F.lit(100.0), F.lit(0.0))
    assert list(spark.range(1).select(one["계약월"], one["최종건축연령"], one["대지대비연면적비율_파생"]).first()) == [8, 35, None]


def test_prices(spark):
    c = valuation.price_columns(F.log(F.lit(1000.0)), F.lit(10.0))
    r = spark.range(1).select(*[x.alias(n) for n, x in c.items()]).first()
    assert r.unit_price == pytest.approx(1000) and r.estimated_price == 10_000 and r.price_reject is None
    bad = valuation.price_columns(F.lit(1.0), F.lit(0.0))
    assert spark.range(1).select(bad["price_reject"]).first()[0] == "AREA_NOT_POSITIVE"


def test_unit_majority(spark):
    rows = [("a", "전유", "아파트")] * 2 + [("a", "전유", "상가")] * 2 + [("b", "전유", "아파트")] * 3 + [("b", "전유", "상가")] * 2 + [("b", "공용", "상가")] * 9
    df = spark.createDataFrame(rows, "k string, u string, e string").withColumn("m", F.lit(""))
    assert {r.k: r.unit_type for r in prop.unit_majority(df, ["k"], "u", "m", "e").collect()} == {"a": None, "b": "APARTMENT"}


def test_quality(spark):
    df = spark.createDataFrame([("2024-01", "2024-03"), ("2024-12", "2025-02"), ("2024-01", "2024-02"), (None, "2024-02")], "b string, c string")
    assert Counter(r.c for r in quality.lag_violations(df, "b", "c", 2).collect()) == {"2024-02": 2}
    with pytest.raises(ValueError):
        quality.require_columns(df, ["b", "zz"])


def test_contract_rules(spark):
    models = spark.createDataFrame([("m", 3, ["a", "a", "b"], ["z"], ["b"]), ("ok", 2, ["a", "b"], ["a"], [])],
                                   "model_key string, feature_count int, features array<string>, categorical_features array<string>, inactive_features array<string>")
    got = features.contract_violations(features.contract_entries(models), models.select("model_key", "feature_count")).collect()
    assert sorted(r.problem for r in got) == ["ACTIVE_AND_INACTIVE", "CATEGORICAL_NOT_ACTIVE", "DUPLICATE_FEATURE"] and {r.model_key for r in got} == {"m"}


def test_models_per_key_are_saved_with_their_contract_and_price_by_it(spark, tmp_path):
    from pyspark.sql import functions as F
    from rentlens.operators import valuation as V
    # y = ln(price * 10^4 / area) for the first key, ln(price * 10^4) for the second, both linear in their features
    rows = spark.range(400).selectExpr("id", "IF(id % 2 = 0, 'A', 'B') AS model_key", "CAST(10 + id % 7 AS DOUBLE) AS area", "CAST(id % 5 AS DOUBLE) AS x", "CAST(id % 3 AS DOUBLE) AS z", "concat('c', id % 4) AS c")
    rows = rows.withColumn("price", F.when(F.col("model_key") == "A", F.exp(F.col("x") / 10) * F.col("area")).otherwise(F.exp(F.col("z") / 10 + F.col("x") / 20)))
    rows = rows.unionByName(spark.createDataFrame([(900, "C", 1.0, 1.0, 1.0, "c", 1.0)], rows.schema))
    contract = spark.createDataFrame([("A", ["x"], [], "area"), ("B", ["z", "x", "c"], ["c"], None)], "model_key string, features array<string>, categorical_features array<string>, area_feature string")
    V.fit_models(rows, contract, str(tmp_path), "v1", learner="linear")
    V.fit_models(rows, contract.limit(1), str(tmp_path), "v2", learner="linear")
    assert [e.model_key for e in V.read_registry(spark, str(tmp_path), "v2")] == ["A"]
    registry = V.read_registry(spark, str(tmp_path), "v1")
    assert [(e.model_key, e.features, e.categorical, e.area_feature) for e in registry] == [("A", ("x",), (), "area"), ("B", ("z", "x", "c"), ("c",), None)]
    out = {r.id: r for r in V.price_by_model(V.predict_by_model(rows, registry), registry).collect()}
    assert len(out) == 401 and out[900].price_reject == "MODEL_NOT_FOUND" and out[900].prediction is None
    for r in out.values():
        if r.model_key != "C":
            assert abs(r.total_price / (r.price * 10_000) - 1) < 0.05
            assert (r.unit_price is None) == (r.model_key == "B")


def test_reference_is_built_from_all_sources(spark):
    from rentlens.operators import reference as R
    cols = "`시군구` string, `본번` string, `부번` string, `{}` string"
    flats = spark.createDataFrame([("A  시", "12.0", "3", "솔 빌"), ("A 시", "12", "3", "솔 빌"), ("A 시", "산12", "3", "솔 빌")], cols.format("단지명"))
    villas = spark.createDataFrame([("A 시", "12", "3", "솔 빌"), ("A 시", "12", "3", None)], cols.format("건물명"))
    out = R.build_reference({"매매_아파트": flats, "전세_아파트": flats, "매매_연립다세대": villas}).collect()
    assert sorted((r.district, r.bun, r.ji, r.housing_type, r.model_name, r.sample_count) for r in out) == [
        ("A 시", "0012", "0003", "APARTMENT", "솔 빌", 4), ("A 시", "0012", "0003", "VILLA", "솔 빌", 1)]
