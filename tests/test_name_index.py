import random

from pyspark.sql import functions as F

from rentlens.operators import property as prop
from rentlens.operators.name_index import contained_names

ASK = "request_id int, parcel string, building_name string, dong_name string"
TITLE = "parcel string, kind string, bldNm string, dongNm string, no int"


def test_contained_names_against_all_pairs(spark):
    rng = random.Random(7)
    word = lambda: rng.choice([None, "", "".join(rng.choice("가나a😀") for _ in range(rng.randint(1, 5)))])
    inner, outer = ([(rng.choice(["p", "q", None]), word()) for _ in range(200)] for _ in range(2))
    df = lambda rows: spark.createDataFrame(rows, "parcel string, name string")
    got = [tuple(r) for r in contained_names(df(inner), df(outer), ["parcel"]).collect()]
    assert sorted(got) == sorted({(p, a, b) for p, a in inner for q, b in outer if p and p == q and a and b and a in b})


def plain_titles(asks, titles):
    out = {}
    key = lambda v: (v or "").replace(" ", "").lower()
    label = lambda v: (lambda x: x[:-1] if x.endswith("동") else x)(key(v).removeprefix("제"))
    for i, parcel, name, dong in asks:
        e, d = key(name), label(dong)
        hits = [t for t in titles if t[0] == parcel and parcel is not None and t[1] == "주건축물" and d in ("", label(t[3]))
                and (e == "" or (key(t[2]) != "" and (key(t[2]) in e or e in key(t[2]))))]
        out[i] = (min((t[4] for t in hits), default=None), len(hits) or None)
    return out


def chosen(spark, asks, titles):
    out = prop.select_titles(spark.createDataFrame(asks, ASK), spark.createDataFrame(titles, TITLE), ["parcel"], "no")
    rows = out.select("request_id", "title.no", "title_count", "title_status").collect()
    assert all((r.title_status == "SELECTED") == (r.no is not None) for r in rows)
    assert len(rows) == len(asks)
    return {r.request_id: (r.no, r.title_count) for r in rows}


def test_titles_against_all_pairs(spark):
    rng = random.Random(3)
    word = lambda: rng.choice([None, "", " "] + ["".join(rng.choice("가나Ab 1") for _ in range(rng.randint(1, 4))) for _ in range(6)])
    dong = lambda: rng.choice([None, "", "1", "제1동", "2동", "가"])
    parcel = lambda: rng.choice(["p", "q", None])
    asks = [(i, parcel(), word(), dong()) for i in range(150)]
    titles = [(parcel(), rng.choice(["주건축물", "주건축물", "부속건축물"]), word(), dong(), i) for i in range(150)]
    assert chosen(spark, asks, titles) == plain_titles(asks, titles)
    assert chosen(spark, asks, []) == {i: (None, None) for i in range(150)}


def test_one_parcel_with_many_titles(spark):
    """All titles on one parcel and every title asked for: names meet where they share the rarest gram."""
    n = 100_000
    titles = spark.range(n).select(
        F.lit("p").alias("parcel"), F.lit("주건축물").alias("kind"), F.sha1(F.col("id").cast("string")).alias("bldNm"),
        F.lit("").alias("dongNm"), F.col("id").cast("int").alias("no"))
    asks = titles.where("no % 50 = 0").select(
        F.col("no").alias("request_id"), "parcel", F.concat(F.lit("한 "), "bldNm").alias("building_name"), F.lit(None).cast("string").alias("dong_name"))
    out = prop.select_titles(asks, titles, ["parcel"], "no")
    assert out.agg(F.count("*"), F.count_if(F.col("title.no") == F.col("request_id")), F.max("title_count")).first()[:] == (n // 50, n // 50, 1)
