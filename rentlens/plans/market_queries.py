"""Queries of the comparables, evaluation, payload and streaming families."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.operators import comparables, distribution, evaluate, quality, scoring
from rentlens.plans import bindings as B
from rentlens.plans.catalog import query
from rentlens.plans.risk_queries import FLOORED, SCORE_SQL, assessed, score_output
from rentlens.session import cut_lineage, work_folder
from rentlens.sources import files, payloads, sinks
from rentlens.streaming import contracts as stream

# ---- comparables: line items are transactions and contracts alike ------------

RULE = comparables.ComparableRule(band_width=5.0, window_months=6, min_sample=4, bins=4)
LADDER = (("SAME_BUILDING", ("district", "building")), ("SAME_DISTRICT", ("district",)))
MARKET = """deals AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand AS district, lower(replace(p_name, ' ', '')) AS building, l_quantity AS area, CAST(l_shipdate AS DATE) AS contract_date,
    CAST(round(l_extendedprice / 5) AS BIGINT) * 5000 AS deposit, CAST(floor(l_quantity / 5) AS BIGINT) AS band, year(l_shipdate) * 12 + month(l_shipdate) - 1 AS month FROM lineitem JOIN part ON p_partkey = l_partkey),
cells AS (SELECT district, building, b AS band, m AS month, deposit, area, contract_date FROM (SELECT district, building, deposit, area, contract_date, unnest([band - 1, band, band + 1]) AS b, month FROM deals) , LATERAL (SELECT unnest([month, month + 1, month + 2, month + 3, month + 4, month + 5]) AS m))"""
_STATS = """count(*) AS n, min(deposit) AS lo, max(deposit) AS hi, min(area) AS area_lo, max(area) AS area_hi, min(contract_date) AS d0, max(contract_date) AS d1,
  quantile_cont(deposit::DOUBLE, 0.25) AS q1, quantile_cont(deposit::DOUBLE, 0.5) AS q2, quantile_cont(deposit::DOUBLE, 0.75) AS q3"""


def deals(spark, d) -> DataFrame:
    p = B.table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("district"), F.lower(F.replace("p_name", F.lit(" "), F.lit(""))).alias("building"))
    return B.table(spark, d, "lineitem").join(p, "l_partkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "district", "building", F.col("l_quantity").alias("area"), F.col("l_shipdate").cast("date").alias("contract_date"),
        (F.round(F.col("l_extendedprice") / 5).cast("long") * 5000).alias("deposit"))


@query("market_comparables", "J21 A12", f"""WITH {MARKET}, bs AS (SELECT district, building, band, month, {_STATS} FROM cells GROUP BY 1, 2, 3, 4), ds AS (SELECT district, band, month, {_STATS} FROM cells GROUP BY 1, 2, 3),
bb AS (SELECT c.district, c.building, c.band, c.month, a.deposit AS ask, count(*) FILTER (c.deposit <= a.deposit) AS k FROM cells c JOIN (SELECT DISTINCT district, building, band, month, deposit FROM deals) a USING (district, building, band, month) GROUP BY 1, 2, 3, 4, 5),
db AS (SELECT c.district, c.band, c.month, a.deposit AS ask, count(*) FILTER (c.deposit <= a.deposit) AS k FROM cells c JOIN (SELECT DISTINCT district, band, month, deposit FROM deals) a USING (district, band, month) GROUP BY 1, 2, 3, 4)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN bs.n >= 4 THEN 'SAME_BUILDING' WHEN ds.n >= 4 THEN 'SAME_DISTRICT' END AS scope, CASE WHEN bs.n >= 4 OR ds.n >= 4 THEN 'AVAILABLE' ELSE 'INSUFFICIENT' END AS comparable_status,
  CASE WHEN bs.n >= 4 THEN bs.n ELSE ds.n END AS sample_count, CASE WHEN bs.n >= 4 THEN bs.lo WHEN ds.n >= 4 THEN ds.lo END AS minimum, CASE WHEN bs.n >= 4 THEN bs.hi WHEN ds.n >= 4 THEN ds.hi END AS maximum,
  CASE WHEN bs.n >= 4 THEN bs.q1 WHEN ds.n >= 4 THEN ds.q1 END AS percentile_25, CASE WHEN bs.n >= 4 THEN bs.q2 WHEN ds.n >= 4 THEN ds.q2 END AS median, CASE WHEN bs.n >= 4 THEN bs.q3 WHEN ds.n >= 4 THEN ds.q3 END AS percentile_75,
  CASE WHEN bs.n >= 4 THEN bs.area_lo WHEN ds.n >= 4 THEN ds.area_lo END AS area_min, CASE WHEN bs.n >= 4 THEN bs.area_hi WHEN ds.n >= 4 THEN ds.area_hi END AS area_max,
  strftime(CASE WHEN bs.n >= 4 THEN bs.d0 WHEN ds.n >= 4 THEN ds.d0 END, '%Y-%m-%d') AS period_start, strftime(CASE WHEN bs.n >= 4 THEN bs.d1 WHEN ds.n >= 4 THEN ds.d1 END, '%Y-%m-%d') AS period_end,
  round_even(CASE WHEN bs.n >= 4 THEN bb.k * 100.0::DOUBLE / bs.n WHEN ds.n >= 4 THEN db.k * 100.0::DOUBLE / ds.n END, 1) AS user_deposit_percentile
FROM deals x JOIN bs USING (district, building, band, month) JOIN ds ON ds.district = x.district AND ds.band = x.band AND ds.month = x.month
JOIN bb ON bb.district = x.district AND bb.building = x.building AND bb.band = x.band AND bb.month = x.month AND bb.ask = x.deposit JOIN db ON db.district = x.district AND db.band = x.band AND db.month = x.month AND db.ask = x.deposit""")
def market_comparables(spark, d) -> DataFrame:
    t = deals(spark, d)
    out = comparables.compare(t, t, LADDER, RULE)
    return out.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "scope", "comparable_status", "sample_count", "minimum", "maximum", "percentile_25", "median", "percentile_75",
        "area_min", "area_max", F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), "user_deposit_percentile")


@query("comparable_bins", "A12", f"""WITH {MARKET}, s AS (SELECT district, band, month, min(deposit) AS lo, max(deposit) AS hi FROM cells GROUP BY 1, 2, 3), w AS (
  SELECT district, band, month, lo, hi, (hi - lo)::DOUBLE / 4 AS width, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((deposit - lo) / ((hi - lo)::DOUBLE / 4)) AS INTEGER), 3) END AS bin FROM cells JOIN s USING (district, band, month))
SELECT district, band, month, bin, min(CAST(floor(lo + width * bin) AS BIGINT)) AS lower_bound, max(CASE WHEN bin = 3 THEN hi ELSE CAST(floor(lo + width * (bin + 1)) AS BIGINT) END) AS upper_bound, count(*) AS count FROM w GROUP BY 1, 2, 3, 4""")
def comparable_bins(spark, d) -> DataFrame:
    counts = comparables.counted(deals(spark, d), ["district"], RULE)
    return comparables.all_cells_histogram(counts, ["district"], RULE)


@query("price_percentiles", "A4 A12", """SELECT p_brand, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def price_percentiles(spark, d) -> DataFrame:
    p = B.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    out = distribution.exact_percentiles(B.table(spark, d, "lineitem").join(p, "l_partkey"), ["p_brand"], "l_extendedprice", probs)
    return out.select("p_brand", *[F.round(n, 4).alias(n) for n in probs])


# ---- evaluation: labels against values read from the documents -----------------

EVALUATION = """actual AS (SELECT doc_id, CASE WHEN n_chars % 10 > 0 THEN lang END AS lang, CASE WHEN n_chars % 10 > 0 THEN n_chars END AS n_chars, CASE WHEN n_chars % 10 > 0 THEN CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END END AS quality FROM documents),
checks AS (SELECT l.doc_id, a.doc_id IS NOT NULL AS resolved, unnest([{'field': 'quality', 'passed': coalesce(l.quality = a.quality, false)}, {'field': 'length', 'passed': coalesce(abs(a.n_chars - length(d.text)) <= 0.001, false)},
  {'field': 'owners', 'passed': coalesce(l.toxic = 0 AND a.lang <> 'es', false)}, {'field': 'amounts', 'passed': coalesce(a.lang = 'en', false)}]) AS c FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN actual a ON a.doc_id = l.doc_id)"""


def checks(spark, d) -> DataFrame:
    docs = B.table(spark, d, "documents")
    owner = lambda name, share: F.struct(F.array(F.lit(name), F.lit("Nobody")).alias("names"), share.alias("share"))
    expected = B.table(spark, d, "labels").join(docs.select("doc_id", F.length("text").alias("length")), "doc_id").select(
        "doc_id", "quality", "length", F.array(owner("Kim Il", F.lit(None).cast("string")), owner("Lee", F.when(F.col("toxic") == 0, "1/2").otherwise("1/3"))).alias("owners"),
        F.array(F.lit(2), F.lit(1)).alias("amounts"))
    person = lambda name, share: F.struct(F.lit(name).alias("name"), F.lit(share).alias("share"))
    pair = F.array(person("KIM", "1/2"), person("Mr. Lee", "1 / 2"))
    read = lambda c: F.when(F.col("n_chars") % 10 > 0, c)  # of the others nothing could be read
    actual = docs.select(
        "doc_id", read(F.when(F.contains(F.col("text"), F.lit("the")), 1).otherwise(0)).alias("quality"), read(F.col("n_chars")).alias("length"),
        read(F.when(F.col("lang") == "es", F.slice(pair, 1, 1)).otherwise(pair)).alias("owners"),
        read(F.when(F.col("lang") == "en", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("amounts"))
    e, a = F.col("e"), F.col("a")
    return evaluate.field_checks(expected, actual, "doc_id", {
        "quality": e["quality"] == a["quality"], "length": F.abs(e["length"] - a["length"]) <= 0.001,
        "owners": evaluate.owners_agree(e["owners"], a["owners"]), "amounts": evaluate.equal_amounts(e["amounts"], a["amounts"])})


@query("evaluation_checks", "J22", f"WITH {EVALUATION} SELECT doc_id, resolved, c.field AS field, c.passed AS passed FROM checks")
def evaluation_checks(spark, d) -> DataFrame:
    return checks(spark, d)


@query("evaluation_summary", "A13", f"""WITH {EVALUATION}, p AS (SELECT doc_id, bool_and(c.passed) AS al, count(*) AS n, count(*) FILTER (c.passed) AS ok FROM checks GROUP BY 1)
SELECT count(*) AS samples, count(*) FILTER (al) AS samples_passed, CAST(sum(n) AS BIGINT) AS field_checks, CAST(sum(ok) AS BIGINT) AS field_checks_passed FROM p""")
def evaluation_summary(spark, d) -> DataFrame:
    return evaluate.evaluation_summary(checks(spark, d), "doc_id")


@query("key_set_differences", "U3", """WITH p AS (SELECT c_nationkey % 5 AS g, list(DISTINCT c_mktsegment || c_nationkey) FILTER (c_acctbal > 7000) AS l, list(DISTINCT c_mktsegment || c_nationkey) FILTER (c_acctbal <= 7000) AS r FROM customer GROUP BY 1), q AS (
  SELECT g, list_sort(list_filter(coalesce(l, CAST([] AS VARCHAR[])), lambda x: NOT list_contains(coalesce(r, CAST([] AS VARCHAR[])), x))) AS ol, list_sort(list_filter(coalesce(r, CAST([] AS VARCHAR[])), lambda x: NOT list_contains(coalesce(l, CAST([] AS VARCHAR[])), x))) AS orr FROM p)
SELECT g, array_to_string(ol, '|') AS only_left, array_to_string(orr, '|') AS only_right, len(ol) = 0 AND len(orr) = 0 AS equal FROM q""")
def key_set_differences(spark, d) -> DataFrame:
    """Two key sets per group; a key is a (segment, nation) pair, of which there are 125."""
    key = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))
    p = B.table(spark, d, "customer").groupBy((F.col("c_nationkey") % 5).alias("g")).agg(
        F.collect_set(F.when(F.col("c_acctbal") > 7000, key)).alias("l"), F.collect_set(F.when(F.col("c_acctbal") <= 7000, key)).alias("r"))
    cols = quality.set_difference(F.col("l"), F.col("r"))
    return p.select("g", B.joined(cols["only_left"]).alias("only_left"), B.joined(cols["only_right"]).alias("only_right"), cols["equal"].alias("equal"))


# ---- payload text -----------------------------------------------------------------

# Event props become answers: an object for odd events, a list of two for every third,
# a failed code or broken text for some.
def _answers(spark, d, path: tuple[str, str], ok: tuple[str, str]) -> DataFrame:
    e, one = F.col("event_id"), F.col("props")
    item = F.when(e % 3 == 0, F.concat(F.lit("["), one, F.lit(", "), one, F.lit("]"))).when(e % 13 == 0, F.lit('""')).otherwise(one)
    head, tail = path
    body = F.concat(F.lit(head), F.when(e % 7 == 0, ok[1]).otherwise(ok[0]), F.lit(tail), item, F.lit("}}}" if "items" in tail else "}}"))
    return B.table(spark, d, "events").select("event_id", F.when(e % 17 == 0, "not json").otherwise(body).alias("payload"))


@query("ledger_payload_rows", "S10", """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 17 = 0 THEN 'UNREADABLE' WHEN event_id % 7 = 0 THEN '30' ELSE '00' END AS result_code,
  CASE WHEN event_id % 17 = 0 OR event_id % 7 = 0 THEN [NULL] WHEN event_id % 3 = 0 THEN [0, 1] WHEN event_id % 13 = 0 THEN CAST([] AS INTEGER[]) ELSE [0] END AS pos FROM events), u AS (SELECT *, unnest(pos) AS position FROM e)
SELECT event_id, result_code, position, CASE WHEN position IS NOT NULL THEN k END AS k FROM u""")
def ledger_payload_rows(spark, d) -> DataFrame:
    head, tail = '{"response": {"header": {"resultCode": "', '"}, "body": {"items": {"item": '
    a = _answers(spark, d, (head, tail), ("00", "30"))
    a = a.withColumn("payload", F.when(F.startswith("payload", F.lit("{")), F.concat("payload", F.lit("}"))).otherwise(F.col("payload")))
    return payloads.ledger_rows(a, ["event_id"], "payload", "struct<k:bigint>")


@query("address_payload_rows", "S11", """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 17 > 0 THEN CASE WHEN event_id % 7 = 0 THEN 'E0001' ELSE '0' END END AS error_code, CASE WHEN event_id % 17 > 0 THEN 5::BIGINT END AS total_count,
  CASE WHEN event_id % 17 = 0 THEN [NULL] WHEN event_id % 3 = 0 THEN [0, 1] WHEN event_id % 13 = 0 THEN [NULL] ELSE [0] END AS pos FROM events), u AS (SELECT *, unnest(pos) AS position FROM e)
SELECT event_id, error_code, total_count, position, CASE WHEN position IS NOT NULL THEN k END AS k FROM u""")
def address_payload_rows(spark, d) -> DataFrame:
    a = _answers(spark, d, ('{"results": {"common": {"totalCount": "5", "errorCode": "', '"}, "juso": '), ("0", "E0001"))
    return payloads.address_rows(a, ["event_id"], "payload", "struct<k:bigint>")


@query("rent_payload_rows", "S12", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS BIGINT) * 10000 AS deposit, l_quantity AS area, CASE WHEN l_linenumber = 7 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS contract_date, l_returnflag AS legal_dong, CASE WHEN l_linestatus = 'F' THEN 'A-' || l_suppkey END AS building_name
FROM lineitem WHERE l_tax > 0.02 AND l_discount <> 0.05""")
def rent_payload_rows(spark, d) -> DataFrame:
    s = lambda c: F.col(c).cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    day = F.col("l_shipdate")
    item = F.concat(
        F.lit("<response><body><items><item>"), tag("deposit", F.format_number(F.bround("l_extendedprice", 0).cast("long"), 0)), tag("monthlyRent", F.when(F.col("l_tax") > 0.02, "0").otherwise("45")),
        tag("excluUseAr", s("l_quantity")), tag("dealYear", F.year(day).cast("string")), tag("dealMonth", F.month(day).cast("string")),
        tag("dealDay", F.when(F.col("l_linenumber") == 7, "31x").otherwise(F.dayofmonth(day).cast("string"))), tag("umdNm", F.col("l_returnflag")),
        F.when(F.col("l_linestatus") == "F", tag("aptNm", F.concat(F.lit("A-"), s("l_suppkey")))).otherwise(""),
        F.when(F.col("l_discount") == 0.05, tag("cdealDay", F.lit("20260701"))).otherwise(""), F.lit("</item></items></body></response>"))
    p = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", item.alias("payload"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return payloads.rent_transactions(payloads.xml_items(p, keys, "payload"), keys).withColumn("contract_date", F.col("contract_date").cast("string"))


@query("html_table_rows", "S13", r"""WITH r AS (SELECT page_id, generate_subscripts(rs, 1) - 1 AS row_no, unnest(rs) AS row FROM (SELECT page_id, regexp_extract_all(html, '(?is)<ul(?:\s[^>]*)?>(.*?)</ul\s*>', 1) AS rs FROM pages)), c AS (
  SELECT *, regexp_extract_all(row, '(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>', 1) AS cs FROM r), t AS (SELECT page_id, row_no, list_transform(cs, lambda x: trim(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'))) AS ts FROM c WHERE len(cs) = 6)
SELECT page_id, CAST(row_no AS INTEGER) AS row_no, ts[1] AS c1, ts[2] AS c2, ts[3] AS c3, ts[4] AS c4, ts[5] AS c5, ts[6] AS c6 FROM t""")
def html_table_rows(spark, d) -> DataFrame:
    return payloads.table_rows(B.table(spark, d, "pages"), ["page_id"], "html", [f"c{i}" for i in range(1, 7)], row_tag="ul", cell_tag="li")


@query("html_page_totals", "S13", r"""SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(html, '(?s)<[^>]*>', '', 'g') || ' ' || page_id || ' / ' || (page_id + 3), '([0-9]+)\s*/\s*([0-9]+)', 2), '') AS INTEGER), 1) AS total FROM pages""")
def html_page_totals(spark, d) -> DataFrame:
    s = lambda c: c.cast("string")
    k = F.col("page_id")
    return B.table(spark, d, "pages").select("page_id", payloads.page_total(F.concat("html", F.lit(" "), s(k), F.lit(" / "), s(k + 3))).alias("total"))


# ---- stored files --------------------------------------------------------------------

@query("csv_round_trip", "S1 S14", """SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, c_nationkey::VARCHAR AS c_nationkey FROM customer""")
def csv_round_trip(spark, d) -> DataFrame:
    """Customers written as CSV with a byte-order mark and read back as text."""
    path, columns = f"{work_folder(spark)}/csv-{uuid.uuid4().hex}", ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]
    sinks.write_csv(B.table(spark, d, "customer").select(*columns), path)
    return files.read_csv(spark, path, columns)


@query("training_files", "S2 S4", """SELECT 'model_' || p_size % 2 AS model_key, p_partkey, p_retailprice FROM part""")
def training_files(spark, d) -> DataFrame:
    """Training rows stored by model key and read back with the wanted columns only."""
    folder, part, keys = f"{work_folder(spark)}/training-{uuid.uuid4().hex}", B.table(spark, d, "part"), {0: "model_0", 1: "model_1"}
    for k, key in keys.items():
        part.where(F.col("p_size") % 2 == k).write.parquet(f"{folder}/train_{key}.parquet")
    read = [files.read_training(spark, folder, key, ["p_partkey", "p_retailprice"]).withColumn("model_key", F.lit(key)) for key in keys.values()]
    return read[0].unionByName(read[1])


MODEL_FILES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "UNKNOWN")


@query("training_file_counts", "S3", f"""SELECT k AS model_key, CAST(CASE WHEN n IS NULL THEN 0 WHEN k = 'SMALL' THEN 2 ELSE 1 END AS BIGINT) AS files, CASE WHEN n IS NULL THEN 'MISSING' WHEN k = 'SMALL' THEN 'DUPLICATE' ELSE 'FOUND' END AS status,
  CASE WHEN k <> 'SMALL' THEN n END AS rows FROM (SELECT unnest({list(MODEL_FILES)}) AS k) LEFT JOIN (SELECT p_type AS k, count(*) AS n FROM part GROUP BY 1) USING (k)""")
def training_file_counts(spark, d) -> DataFrame:
    """Training files of each model found by name: one of them twice, those without rows not at all."""
    folder, part = f"{work_folder(spark)}/training-{uuid.uuid4().hex}", B.table(spark, d, "part")
    for key in MODEL_FILES:
        rows = part.where(F.col("p_type") == key).select("p_partkey", "p_retailprice")
        for name in (f"06_{key}", f"06_{key}_1")[:0 if rows.isEmpty() else 2 if key == "SMALL" else 1]:
            rows.write.parquet(f"{folder}/{name}.parquet")
    found = files.file_counts(spark, f"{folder}/06_*.parquet", MODEL_FILES)
    read = files.read_parquet(spark, f"{folder}/06_*.parquet", ["p_partkey"]).select(
        F.regexp_replace(F.input_file_name(), "^.*:/*|/part-.*$", "").alias("path")).groupBy("path").agg(F.count("*").alias("rows"))
    return found.withColumn("path", F.regexp_replace("path", "^.*:/*", "")).join(read, "path", "left").select("model_key", "files", "status", "rows")


@query("store_reload", "S6", """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders""")
def store_reload(spark, d) -> DataFrame:
    """A version loaded, loaded again under its own name, and read through the metadata."""
    folder, rows = f"{work_folder(spark)}/store-{uuid.uuid4().hex}", B.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    sinks.refresh_table(rows.where("o_orderstatus = 'F'"), folder, "orders", "v1")
    sinks.refresh_table(rows, folder, "orders", "v1")
    return sinks.read_current(spark, folder, "orders")


# ---- streaming ----------------------------------------------------------------------

@query("stream_scores", "Z1", SCORE_SQL)
def stream_scores(spark, d) -> DataFrame:
    """Orders read as a file stream, enriched from stored lookups, scored and appended."""
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    lookups = B.stored_lookups(spark, d)
    orders = spark.readStream.schema(B.table(spark, d, "orders").schema).option("pathGlobFilter", "orders.parquet").parquet(d)
    scored = score_output(stream.score_stream(orders, lambda o: B.enrich_orders(o, spark, d, lookups)))
    q = stream.write_scores(scored, f"{base}/out", f"{base}/state")
    q.awaitTermination()
    return spark.read.schema(scored.schema).parquet(f"{base}/out")


# A third of the requests arrives before the rates are published anew, the others after it.
STREAM_RATES = """rates AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(round(o_totalprice * 1000) AS BIGINT)) AS BIGINT) // count(*) AS rate FROM orders GROUP BY 1),
published AS (SELECT 'v1' AS version, month, rate FROM rates WHERE right(month, 2) NOT IN ('03', '04', '12') UNION ALL SELECT 'v2', month, rate + 1000 FROM rates)"""


@query("stream_assessments", "Z1", f"""WITH {B.REGISTER}, {FLOORED}, {STREAM_RATES}, r AS (SELECT *, CASE WHEN analysis_id % 3 = 0 THEN 'v1' ELSE 'v2' END AS version FROM finals)
SELECT analysis_id, total, final_score, register_floor, array_to_string(warnings, '|') AS warnings, p.rate AS rate, p.month AS rates_month, r.version AS rates_version
FROM r ASOF LEFT JOIN published p ON r.version = p.version AND r.contract_month >= p.month""")
def stream_assessments(spark, d) -> DataFrame:
    """Requests in several micro-batches and two runs: repeated ones leave by state, rates are looked up as of the contract's
    month in the version published when the run starts, and scores carry the register floor."""
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    source, store, out, state = (f"{base}/{n}" for n in ("requests", "store", "out", "state"))
    orders = B.table(spark, d, "orders")
    arrival = F.col("o_orderkey") % 3
    requests = cut_lineage(orders.withColumn("arrival", arrival.cast("int")).withColumn(
        "requested_at", F.timestamp_seconds(1_700_000_000 + arrival * 86_400 + F.col("o_orderkey") % 3600)))
    sums, leases = B.stored_lookups(spark, d)
    rates = cut_lineage(orders.groupBy(B.month_of(F.col("o_orderdate")).alias("month")).agg(
        F.call_function("div", F.sum(B.won(F.col("o_totalprice"))), F.count("*")).alias("rate")))

    # an arrival is written by as many tasks as read the requests, and its files are one micro-batch
    parts = max(1, requests.rdd.getNumPartitions())

    def run() -> None:
        stream_in = stream.unique_requests(stream.read_contracts(spark, source, requests.schema, files_per_batch=parts), "o_orderkey", "requested_at", "30 days")
        contracts = B.enrich_orders(stream_in, spark, d, (sums, leases))
        done = assessed(B.with_register(stream.with_series(contracts, store, "rates", "contract_month", ["rate"])))
        stream.write_scores(done.select(*kept, B.joined(F.col("warnings")).alias("warnings")), out, state).awaitTermination()

    def arrives(df: DataFrame) -> None:
        stream.write_arrival(df, source, parts)

    kept = ["analysis_id", "total", "final_score", "register_floor", "rate", "rates_month", "rates_version"]
    sinks.refresh_table(rates.where(~F.substring("month", 6, 2).isin("03", "04", "12")), store, "rates", "v1")
    arrives(requests.where("arrival = 0"))
    run()
    sinks.refresh_table(rates.withColumn("rate", F.col("rate") + 1000), store, "rates", "v2")
    # requests sent a second time, a day later
    again = requests.where("arrival = 0 AND o_custkey % 5 = 0").withColumn("requested_at", F.col("requested_at") + F.expr("INTERVAL 1 DAY"))
    arrives(requests.where("arrival = 1").unionByName(again))
    arrives(requests.where("arrival = 2"))
    run()
    return spark.read.parquet(out)
