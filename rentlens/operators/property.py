"""Address and building-ledger rows: keys, housing type, title choice, unit areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import score as S
from rentlens.functions import text as T
from rentlens.operators.name_index import contained_names
from rentlens.session import cut_lineage

# Purpose words per housing type, in the order they are tried.
HOUSING_WORDS = (
    ("OFFICETEL", ("오피스텔",)),
    ("VILLA", ("연립주택", "다세대주택", "연립", "다세대")),
    ("APARTMENT", ("아파트",)),
    ("DETACHED_MULTI", ("단독주택", "다가구주택", "다중주택", "다가구", "단독")),
)
MAIN_BUILDING = "주건축물"
EXCLUSIVE_USE = "전유"

LedgerKey = ["sigungu_code", "bjdong_code", "plat_code", "bun", "ji"]


def address_keys(item: dict[str, Column]) -> dict[str, Column]:
    """Parcel key, district text and building names of an address row."""
    code = T.strip(T.text(item["admCd"]))
    lot = lambda name: T.lot_number(item[name])
    names = F.filter(F.transform(F.split(T.text(item["detBdNmList"]), ","), T.strip), lambda x: x != "")
    return {
        "legal_dong_code": code,
        "sigungu_code": F.substring(code, 1, 5),
        "bjdong_code": F.substring(code, 6, 5),
        "plat_code": F.when(item["mtYn"] == "1", "1").otherwise("0"),
        "bun": lot("lnbrMnnm"),
        "ji": lot("lnbrSlno"),
        "district": F.concat_ws(" ", *[T.blank_to_null(item[c]) for c in ("siNm", "sggNm", "emdNm", "liNm")]),
        "building_name": T.blank_to_null(item["bdNm"]),
        "available_dongs": names,
    }


def title_features(t: dict[str, Column]) -> dict[str, Column]:
    """Model features of a title row; text that is no number becomes null."""
    num = lambda c: T.strip(T.text(t[c])).try_cast("double")
    count = lambda c: T.strip(T.text(t[c])).try_cast("int")
    lifts = F.coalesce(count("rideUseElvtCnt"), F.lit(0)) + F.coalesce(count("emgenUseElvtCnt"), F.lit(0))
    area = lambda c: F.when(num(c) > 0, num(c))
    return {
        "gross_area": area("totArea"),
        "land_area": area("platArea"),
        "approval_year": F.substring(T.strip(T.text(t["useAprDay"])), 1, 4).try_cast("int"),
        "coverage_ratio": num("bcRat"),
        "floors_above": count("grndFlrCnt"),
        "floors_below": count("ugrndFlrCnt"),
        "passenger_lifts": count("rideUseElvtCnt"),
        "emergency_lifts": count("emgenUseElvtCnt"),
        "households": F.greatest(count("hhldCnt"), count("fmlyCnt")),
        "has_lift": (lifts > 0).cast("int"),
        "structure": T.blank_to_null(t["strctCdNm"]),
        "main_use": T.blank_to_null(t["mainPurpsCdNm"]),
        "seismic_design": T.blank_to_null(t["rserthqkDsgnApplyYn"]),
    }


def ledger_quality(land_area: Column, gross_area: Column, approval_year: Column, seismic: Column) -> dict[str, Column]:
    """Blocking and warning codes of ledger values.

    LAND_AREA_MISSING and SEISMIC_DESIGN_UNKNOWN are the known codes; the two
    others are this library's choice, in the same style.
    """
    return {
        "blocking": S.codes((land_area.isNull(), "LAND_AREA_MISSING"), (gross_area.isNull(), "GROSS_AREA_MISSING")),
        "quality_warnings": S.codes(
            (seismic.isNull(), "SEISMIC_DESIGN_UNKNOWN"), (approval_year.isNull(), "APPROVAL_YEAR_UNKNOWN")),
    }


def _word_cascade(text: Column, words=HOUSING_WORDS) -> Column:
    expr = None
    for kind, names in words:
        test = None
        for w in names:
            test = text.contains(w) if test is None else test | text.contains(w)
        expr = F.when(test, kind) if expr is None else expr.when(test, kind)
    return expr


def title_housing_type(detail: Column, main: Column, words=HOUSING_WORDS, detached_main: str = "단독주택") -> Column:
    """Housing type from the detailed purpose, else from the main one; null if neither tells."""
    return F.coalesce(
        _word_cascade(T.compact(detail), words),
        F.when(T.compact(main).contains(detached_main), words[-1][0]),
    )


def unit_housing_type(main: Column, detail: Column, words=HOUSING_WORDS) -> Column:
    return _word_cascade(F.concat(T.compact(main), T.compact(detail)), words)


def unit_majority(units: DataFrame, keys: Sequence[str], use: str, main: str, detail: str,
                  words=HOUSING_WORDS, exclusive: str = EXCLUSIVE_USE) -> DataFrame:
    """Housing type held by more than half of all exclusive-use units of a building.

    One conditional count per type: no vote is ranked, as two types can never
    both hold a majority.
    """
    kind = unit_housing_type(F.col(main), F.col(detail), words)
    own = units.where(T.strip(T.text(F.col(use))) == exclusive).select(*keys, kind.alias("_kind"))
    votes = {k: F.count_if(F.col("_kind") == k).alias(f"_n_{i}") for i, (k, _) in enumerate(words)}
    counted = own.groupBy(*keys).agg(F.count("*").alias("exclusive_units"), *votes.values())
    winner = F.coalesce(*[F.when(F.col(f"_n_{i}") * 2 > F.col("exclusive_units"), k) for i, (k, _) in enumerate(words)])
    return counted.withColumn("unit_type", winner).drop(*[f"_n_{i}" for i in range(len(words))])


def dong_key(c: Column) -> Column:
    """Unit-building label as compared: no spaces, leading '제' or trailing '동'."""
    return F.regexp_replace(F.regexp_replace(T.name_key(c), "^제", ""), r"동\z", "")


def select_titles(requests: DataFrame, titles: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The title of each request: a main building on the same parcel whose name and
    unit-building label fit. Requests without one keep null title columns.

    ``requests`` carries request_id, building_name and dong_name, ``titles``
    carries kind, bldNm and dongNm. Names fit when one contains the other; no asked name
    fits every title, a title without a name only such an ask. Equal questions about a
    parcel are asked once and its titles are reduced to one row for each name and label;
    names then meet through their grams (``name_index``), not all titles of the parcel.
    The first fitting title in ``order`` is taken.
    """
    asks = requests.withColumns({
        "_name": T.name_key(F.col("building_name")), "_dong": dong_key(F.col("dong_name"))})
    ask_keys = [*keys, "_name", "_dong"]
    others = [c for c in titles.columns if c not in keys]
    first = F.struct(F.col(order).alias("at"), F.struct(*others).alias("title"))
    main = titles.where(F.col("kind") == MAIN_BUILDING).withColumns({
        "_name": T.name_key(F.col("bldNm")), "_dong": dong_key(F.col("dongNm"))})
    # One row for each name and label of a parcel, and one for the parcel's name with any label.
    named = cut_lineage(main.groupBy(*ask_keys).agg(F.min_by(first, order).alias("_first"), F.count("*").alias("_n")))
    asked = asks.select(*ask_keys).distinct()
    names, wanted = (df.select(*keys, F.col("_name").alias("name")) for df in (named, asked))
    either = contained_names(wanted, names, keys).union(
        contained_names(names, wanted, keys).select(*keys, "outer", "inner")).distinct()
    # An ask without a name fits every title: it meets the counts by label only.
    either = either.select(*keys, F.col("inner").alias("_name"), F.col("outer").alias("_title"))
    fits = asked.where("_name <> ''").join(either, [*keys, "_name"])
    labels = named.withColumnRenamed("_name", "_title")
    chosen = lambda df, by: df.groupBy(*by).agg(F.min_by("_first", "_first.at").alias("_first"), F.sum("_n").alias("_n"))
    any_label = chosen(labels, [*keys, "_title"])
    hits = fits.where("_dong = ''").join(any_label, [*keys, "_title"]).unionByName(
        fits.where("_dong <> ''").join(labels, [*keys, "_title", "_dong"])).drop("_title")
    unnamed = asked.where("_name = ''")
    by_label = chosen(named, [*keys, "_dong"])
    whole = chosen(by_label, keys)
    best = chosen(hits, ask_keys).unionByName(
        unnamed.where("_dong = ''").join(whole, list(keys))).unionByName(
        unnamed.where("_dong <> ''").join(by_label, [*keys, "_dong"]))
    best = best.select(*ask_keys, F.col("_first.title").alias("title"), F.col("_n").alias("title_count"))
    return asks.join(best, ask_keys, "left").drop("_name", "_dong").withColumn(
        "title_status", F.when(F.col("title_count").isNull(), "NOT_FOUND").otherwise("SELECTED"))


def title_candidates(titles: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Distinct (label, housing type) choices of each parcel, the last row per choice.

    Titles without a label are left out of parcels that use labels, except
    detached houses.
    """
    main = titles.where((F.col("kind") == MAIN_BUILDING) & F.col("housing_type").isNotNull())
    labelled = titles.where(F.col("kind") == MAIN_BUILDING).groupBy(*keys).agg(
        F.max(T.strip(T.text(F.col("dongNm"))) != "").alias("_labelled"))
    dong = T.strip(T.text(F.col("dongNm")))
    rows = main.join(labelled, list(keys)).where(
        (dong != "") | ~F.col("_labelled") | (F.col("housing_type") == "DETACHED_MULTI"))
    label = F.when(dong != "", dong).otherwise(T.name_key(F.col("bldNm")))
    return rows.withColumn("candidate", label).groupBy(*keys, "candidate", "housing_type").agg(
        F.max_by(F.struct(T.blank_to_null(F.col("bldNm")).alias("building_name"), F.nullif(dong, F.lit("")).alias("dong_name")),
                 F.col(order)).alias("_last")
    ).select(*keys, "candidate", "housing_type", "_last.building_name", "_last.dong_name")


def first_suggestions(df: DataFrame, query: str, order: str, limit: int = 10) -> DataFrame:
    """First ``limit`` address suggestions per query (the service's own page size)."""
    from pyspark.sql import Window
    w = Window.partitionBy(query).orderBy(order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def unit_areas(rows: DataFrame, keys: Sequence[str], use: str, area: str, floor: str,
               exclusive: str = EXCLUSIVE_USE) -> DataFrame:
    """Exclusive, common and total area per unit, with row and zero-area counts."""
    a = F.col(area).try_cast("double")
    own = T.strip(T.text(F.col(use))) == exclusive
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(own, a)), F.lit(0.0)).alias("exclusive_area"),
        F.coalesce(F.sum(F.when(~own, a)), F.lit(0.0)).alias("common_area"),
        F.coalesce(F.sum(a), F.lit(0.0)).alias("total_area"),
        F.count("*").alias("row_count"),
        F.count_if(F.coalesce(a, F.lit(0.0)) == 0).alias("zero_area_count"),
        F.max(F.when(own, F.col(floor))).alias("floor"),
    )


def detached_label(model_kind: Column, detail: Column, main: Column) -> Column:
    """Housing label of a detached house: lease models use the joint label, sale
    models tell multi-family from single; null when neither word is there."""
    purpose = F.concat_ws(" ", T.text(detail), T.text(main))
    return (
        F.when(model_kind == "LEASE", "단독다가구")
        .when(purpose.contains("다가구"), "다가구")
        .when(purpose.contains("단독"), "단독")
    )


# ---- snapshots -------------------------------------------------------------

SNAPSHOT_SCHEMA = (
    "roadAddress string, jibunAddress string, legalDongCode string, district string, buildingName string, "
    "sigunguCode string, bjdongCode string, platCode string, bun string, ji string, housingType string, "
    "dongName string, hoName string, ledgerFeatureValues map<string,string>, ledgerTitle map<string,string>, "
    "ledgerTitleCount int, qualityBlocking array<string>, qualityWarnings array<string>, "
    "unitArea struct<dongName:string,hoName:string,floor:int,exclusiveArea:double,commonArea:double,totalArea:double>"
)


def snapshot_json(fields: dict[str, Column]) -> Column:
    """A resolved property as nested JSON; absent fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def restored_snapshot(raw: Column) -> Column:
    return F.from_json(raw, SNAPSHOT_SCHEMA)


def snapshot_problem(s: str) -> Column:
    """First reason why a restored snapshot cannot be used; null when it can."""
    c = lambda name: F.col(f"{s}.{name}")
    digits = lambda name, n: F.coalesce(c(name).rlike(rf"^[0-9]{{{n}}}\z"), F.lit(False))
    key_ok = digits("sigunguCode", 5) & digits("bjdongCode", 5) & digits("bun", 4) & digits("ji", 4) & F.coalesce(
        c("platCode").isin("0", "1", "2"), F.lit(False))
    return (
        F.when(F.col(s).isNull(), "SNAPSHOT_MISSING")
        .when(~key_ok, "LEDGER_KEY_INVALID")
        .when((T.text(c("roadAddress")) == "") | (T.text(c("district")) == ""), "ADDRESS_MISSING")
        .when(F.coalesce(F.size(c("ledgerFeatureValues")), F.lit(0)) <= 0, "LEDGER_FEATURES_MISSING")
        .when(c("unitArea.exclusiveArea") <= 0, "UNIT_AREA_INVALID")
    )


def reuse_snapshots(requests: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Adds the snapshot and why it is or is not reused (REUSED or a reason code).

    A snapshot fits a request with the same unit labels; rows that are not REUSED
    feed the resolving path.
    """
    snap = snapshots.select(key, restored_snapshot(F.col("snapshot_json")).alias("snapshot"))
    df = requests.join(snap, key, "left")
    same = T.blank_to_null(F.col("snapshot.dongName")).eqNullSafe(T.blank_to_null(F.col("dong_name"))) & T.blank_to_null(
        F.col("snapshot.hoName")).eqNullSafe(T.blank_to_null(F.col("ho_name"))) & T.blank_to_null(F.col("address")).isNotNull()
    problem = snapshot_problem("snapshot")
    state = (
        F.when(F.col("snapshot").isNull(), "SNAPSHOT_MISSING").when(~same, "TARGET_CHANGED").otherwise(
            F.coalesce(problem, F.lit("REUSED")))
    )
    return df.withColumn("snapshot_state", state)
