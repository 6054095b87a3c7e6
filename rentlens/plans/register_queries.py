"""Queries of the register family: rights, evidence, merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators import evidence, merge, rights
from rentlens.plans import bindings as B
from rentlens.plans.catalog import CATALOG, query
from rentlens.session import cut_lineage, spread
from rentlens.sources import sinks

# ---- rights from line items (document = order) ------------------------------

RIGHTS = """rights_raw AS (
  SELECT l_orderkey AS doc_id, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 10000000000 + l_partkey AS seq, CASE WHEN l_linestatus = 'F' THEN '갑구' ELSE '을구' END AS section,
    CAST(l_linenumber AS VARCHAR) AS rank_no, l_linenumber - 1 AS target,
    CASE WHEN l_returnflag = 'R' THEN 'CANCELLATION' WHEN l_returnflag = 'A' THEN 'MORTGAGE_AMEND' WHEN l_tax = 0 THEN 'JEONSE_RIGHT' WHEN l_tax = 0.01 THEN 'LEASEHOLD_REGISTRATION' WHEN l_tax = 0.02 THEN 'SEIZURE'
      WHEN l_tax = 0.03 THEN 'TRUST' ELSE 'MORTGAGE' END AS kind,
    '제' || l_partkey || '호' AS receipt_no, strftime(l_shipdate, '%Y-%m-%d') AS registered_at, CASE WHEN l_discount > 0 THEN 'H' || l_suppkey END AS holder, CASE WHEN l_discount <> 0.01 THEN 'D' || l_partkey % 7 END AS debtor,
    CASE WHEN l_quantity > 3 THEN CAST(l_quantity AS BIGINT) * 1000000 END AS amount, CASE WHEN l_discount >= 0.06 THEN 'J' || l_suppkey % 2 END AS joint_collateral_id FROM lineitem)"""
STATUS = """rights AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM rights_raw c WHERE c.kind = 'CANCELLATION' AND c.doc_id = r.doc_id AND c.section = r.section AND CAST(c.target AS VARCHAR) = r.rank_no) THEN 'CANCELLED' ELSE 'ACTIVE' END AS status FROM rights_raw r)"""
AMENDED = """base AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rank_no ORDER BY seq DESC) = 1 AS is_last FROM rights WHERE kind = 'MORTGAGE'),
amends AS (SELECT doc_id, CAST(target AS VARCHAR) AS rank_no, arg_max(amount, seq) FILTER (amount IS NOT NULL) AS na, arg_max(holder, seq) FILTER (holder IS NOT NULL) AS nh, arg_max(debtor, seq) FILTER (debtor IS NOT NULL) AS nd FROM rights WHERE kind = 'MORTGAGE_AMEND' GROUP BY 1, 2),
amended AS (SELECT b.* EXCLUDE (amount, holder, debtor), coalesce(CASE WHEN is_last THEN na END, amount) AS amount, coalesce(CASE WHEN is_last THEN nh END, holder) AS holder, coalesce(CASE WHEN is_last THEN nd END, debtor) AS debtor
  FROM base b LEFT JOIN amends a USING (doc_id, rank_no))"""
TOTALS = """once AS (SELECT DISTINCT doc_id, joint_collateral_id, amount, CASE WHEN joint_collateral_id IS NULL THEN seq END AS own FROM amended WHERE status = 'ACTIVE'),
totals AS (SELECT doc_id, count(*) AS active_mortgage_count, CASE WHEN count(amount) = count(*) THEN CAST(sum(amount) AS BIGINT) END AS total_active_max_claim_amount FROM once GROUP BY 1)"""


def rights_raw(spark, d) -> DataFrame:
    c = F.col
    target = (c("l_linenumber") - 1).cast("string")
    new = (F.when(c("l_tax") == 0, "전세권 설정").when(c("l_tax") == 0.01, "주택임차권").when(c("l_tax") == 0.02, "압류").when(c("l_tax") == 0.03, "신탁").otherwise("근저당권 설정"))
    purpose = F.when(c("l_returnflag") == "R", F.concat(target, F.lit("번근저당권설정 등기말소"))).when(
        c("l_returnflag") == "A", F.concat(target, F.lit(" 번 근저당권 변경"))).otherwise(new)
    day = F.date_diff(c("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return B.table(spark, d, "lineitem").select(
        c("l_orderkey").alias("doc_id"), (day * 10_000_000_000 + c("l_partkey")).alias("seq"), F.when(c("l_linestatus") == "F", "갑구").otherwise("을구").alias("section"),
        c("l_linenumber").cast("string").alias("rank_no"), purpose.alias("purpose"), F.concat(F.lit("제"), c("l_partkey").cast("string"), F.lit("호")).alias("receipt_no"),
        c("l_shipdate").cast("date").cast("string").alias("registered_at"), F.when(c("l_discount") > 0, F.concat(F.lit("H"), c("l_suppkey").cast("string"))).alias("holder"),
        F.when(c("l_discount") != 0.01, F.concat(F.lit("D"), (c("l_partkey") % 7).cast("string"))).alias("debtor"),
        F.when(c("l_quantity") > 3, c("l_quantity").cast("long") * 1_000_000).alias("amount"),
        F.when(c("l_discount") >= 0.06, F.concat(F.lit("J"), (c("l_suppkey") % 2).cast("string"))).alias("joint_collateral_id"),
    ).withColumn("target_rank_nos", T.target_ranks(c("purpose")))


def statused(spark, d) -> DataFrame:
    return rights.with_status(rights.with_kind(rights_raw(spark, d)))


def stored_rights(spark, d) -> DataFrame:
    """Rights with status, stored once for the steps that read them several times."""
    return cut_lineage(statused(spark, d))


@query("right_kinds", "P29 F6", f"WITH {RIGHTS}, {STATUS} SELECT doc_id, seq, kind, CASE WHEN kind IN ('CANCELLATION', 'MORTGAGE_AMEND') THEN CAST(target AS VARCHAR) ELSE '' END AS targets FROM rights_raw")
def right_kinds(spark, d) -> DataFrame:
    return rights.with_kind(rights_raw(spark, d)).select("doc_id", "seq", "kind", B.joined(F.col("target_rank_nos")).alias("targets"))


@query("right_status", "J12", f"WITH {RIGHTS}, {STATUS} SELECT doc_id, seq, section, rank_no, kind, status FROM rights")
def right_status(spark, d) -> DataFrame:
    return statused(spark, d).select("doc_id", "seq", "section", "rank_no", "kind", "status")


@query("amended_mortgages", "J13", f"WITH {RIGHTS}, {STATUS}, {AMENDED} SELECT doc_id, seq, rank_no, amount, holder, debtor, status FROM amended")
def amended_mortgages(spark, d) -> DataFrame:
    return rights.amended_mortgages(stored_rights(spark, d)).select("doc_id", "seq", "rank_no", "amount", "holder", "debtor", "status")


@query("mortgage_totals", "A9", f"WITH {RIGHTS}, {STATUS}, {AMENDED}, {TOTALS} SELECT * FROM totals")
def mortgage_totals(spark, d) -> DataFrame:
    return rights.mortgage_totals(rights.amended_mortgages(stored_rights(spark, d)))


_FLAGS = {"seizure": "SEIZURE", "provisional_seizure": "PROVISIONAL_SEIZURE", "provisional_disposition": "PROVISIONAL_DISPOSITION", "auction_commenced": "AUCTION", "trust_registration": "TRUST"}
_LEASES = {"has_active_jeonse_right": "JEONSE_RIGHT", "has_leasehold_registration": "LEASEHOLD_REGISTRATION"}
FLAGGED = f"""agg AS (SELECT doc_id, count(*) AS verified, count(*) FILTER (section = '갑구') AS g, count(*) FILTER (section = '을구') AS e, bool_or(kind = 'CANCELLATION') AS cancel,
  {', '.join(f"bool_or(status = 'ACTIVE' AND kind = '{k}') AS f_{n}" for n, k in (_FLAGS | _LEASES).items())} FROM rights GROUP BY 1)"""
SUMMARISED = f"""summary AS (SELECT doc_id, gap_section_status, eul_section_status, {', '.join(f"CASE WHEN gap_section_status = 'PARSE_FAILED' THEN 'UNKNOWN' WHEN f_{n} THEN 'TRUE' ELSE 'FALSE' END AS {n}" for n in _FLAGS)},
  {', '.join(f"CASE WHEN eul_section_status = 'PARSE_FAILED' THEN 'UNKNOWN' WHEN f_{n} THEN 'TRUE' ELSE 'FALSE' END AS {n}" for n in _LEASES)},
  CASE WHEN eul_section_status <> 'PARSE_FAILED' THEN coalesce(active_mortgage_count, 0) END AS active_mortgage_count,
  CASE WHEN eul_section_status <> 'PARSE_FAILED' THEN CASE WHEN active_mortgage_count IS NULL THEN 0 ELSE total_active_max_claim_amount END END AS total_active_max_claim_amount,
  coalesce(verified, 0) AS verified_right_count, coalesce(cancel, false) AS has_cancellation_mention FROM st)"""
SUMMARY = f"""docs AS (SELECT o_orderkey AS doc_id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '소유권 가압 류 1' ELSE '소유권이전' END AS gap_text, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '기록  사항 없음' ELSE '근저당' END AS eul_text FROM orders),
{FLAGGED},
st AS (SELECT *, CASE WHEN gap_text IS NOT NULL AND (coalesce(g, 0) > 0 OR NOT contains(replace(gap_text, ' ', ''), '압류')) THEN 'EXTRACTED' ELSE 'PARSE_FAILED' END AS gap_section_status,
  CASE WHEN coalesce(e, 0) > 0 THEN 'EXTRACTED' WHEN eul_text LIKE '기록%' THEN 'CONFIRMED_NONE' ELSE 'PARSE_FAILED' END AS eul_section_status FROM docs LEFT JOIN agg USING (doc_id) LEFT JOIN totals USING (doc_id)),
{SUMMARISED}"""
_SUM_OUT = ["doc_id", "gap_section_status", "eul_section_status", *_FLAGS, *_LEASES, "active_mortgage_count", "total_active_max_claim_amount", "verified_right_count", "has_cancellation_mention"]


def summary(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    docs = B.table(spark, d, "orders").select(
        k.alias("doc_id"), F.when(k % 6 == 1, "소유권 가압 류 1").when(k % 6 > 1, "소유권이전").alias("gap_text"),
        F.when(k % 5 == 1, "기록  사항 없음").when(k % 5 > 1, "근저당").alias("eul_text"))
    return rights.rights_summary(docs, stored_rights(spark, d))


@query("rights_summary", "P33", f"WITH {RIGHTS}, {STATUS}, {AMENDED}, {TOTALS}, {SUMMARY} SELECT * FROM summary")
def rights_summary(spark, d) -> DataFrame:
    return summary(spark, d).select(*_SUM_OUT)


PARSED = """parsed AS (SELECT *, verified_right_count + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS extracted, doc_id % 7 > 0 AS core FROM summary), statuses AS (
  SELECT *, NOT core AND gap_section_status = 'PARSE_FAILED' AND eul_section_status = 'PARSE_FAILED' AS failed, NOT core OR gap_section_status <> 'EXTRACTED' OR eul_section_status = 'PARSE_FAILED' AS partial,
    (coalesce(active_mortgage_count, 0) <> 0 AND total_active_max_claim_amount IS NULL) OR verified_right_count <> extracted AS review FROM parsed), ladder AS (
  SELECT *, CASE WHEN failed THEN 'FAILED' WHEN partial THEN 'PARTIAL' WHEN review THEN 'NEEDS_REVIEW' ELSE 'SUCCESS' END AS parse_status, CASE WHEN failed THEN 'UNKNOWN' WHEN partial THEN 'LOW' WHEN review THEN 'MEDIUM' ELSE 'HIGH' END AS parse_confidence FROM statuses)"""


def parsed(spark, d) -> DataFrame:
    s = summary(spark, d).withColumn("extracted_right_count", F.col("verified_right_count") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0))
    return s.withColumns(rights.parse_status(
        F.col("doc_id") % 7 > 0, F.col("gap_section_status"), F.col("eul_section_status"), F.col("active_mortgage_count"),
        F.col("total_active_max_claim_amount"), F.col("verified_right_count"), F.col("extracted_right_count")))


@query("parse_status", "P32", f"WITH {RIGHTS}, {STATUS}, {AMENDED}, {TOTALS}, {SUMMARY}, {PARSED} SELECT doc_id, parse_status, parse_confidence FROM ladder")
def parse_status(spark, d) -> DataFrame:
    return parsed(spark, d).select("doc_id", "parse_status", "parse_confidence")


# ---- merging: the orders of one customer in one month ------------------------

GROUPS = """groups AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, min(o_orderkey) AS first_doc, count(*) AS n FROM orders GROUP BY 1, 2),
mdocs AS (SELECT first_doc AS merge_id, o_orderkey AS doc_id, CASE WHEN o_orderkey = first_doc THEN 0 ELSE o_orderkey END AS document_index, CASE WHEN o_orderkey % 4 = 0 THEN 'CONDOMINIUM' WHEN o_orderkey % 2 = 0 THEN 'LAND' ELSE 'BUILDING' END AS document_type,
  CASE WHEN o_orderkey % 7 = 0 THEN ' A-' || first_doc ELSE 'a ' || first_doc END AS property_address, CASE WHEN o_orderkey % 6 = 0 THEN 'Kim' ELSE 'Lee' END AS owner, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus, n
  FROM orders o JOIN groups g ON g.o_custkey = o.o_custkey AND g.m = date_trunc('month', o_orderdate))"""


def merge_docs(spark, d) -> DataFrame:
    o = B.table(spark, d, "orders").withColumn("m", F.trunc(F.col("o_orderdate").cast("date"), "month"))
    g = o.groupBy("o_custkey", "m").agg(F.min("o_orderkey").alias("merge_id"), F.count("*").alias("n"))
    k, first = F.col("o_orderkey"), F.col("merge_id").cast("string")
    return o.join(g, ["o_custkey", "m"]).select(
        "merge_id", k.alias("doc_id"), F.when(k == F.col("merge_id"), 0).otherwise(k).alias("document_index"),
        F.when(k % 4 == 0, "CONDOMINIUM").when(k % 2 == 0, "LAND").otherwise("BUILDING").alias("document_type"),
        F.when(k % 7 == 0, F.concat(F.lit(" A-"), first)).otherwise(F.concat(F.lit("a "), first)).alias("property_address"),
        F.when(k % 6 == 0, "Kim").otherwise("Lee").alias("owner"), F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_orderstatus", "n")


@query("merge_check", "J14 W9", f"""WITH {GROUPS}, o AS (SELECT merge_id, owner, count(DISTINCT doc_id) AS k FROM mdocs GROUP BY 1, 2), ol AS (SELECT merge_id, min(k) AS least FROM o GROUP BY 1), g AS (
  SELECT merge_id, count(*) AS documents, list_sort(list_distinct(list(document_type))) AS types, arg_max(doc_id, CASE document_type WHEN 'CONDOMINIUM' THEN 3 WHEN 'BUILDING' THEN 2 ELSE 1 END * 1000000000000 - document_index) AS primary_doc,
    count(DISTINCT lower(regexp_replace(property_address, '[^0-9A-Za-z]', '', 'g'))) AS addresses FROM mdocs GROUP BY 1)
SELECT merge_id, documents, primary_doc, CASE WHEN documents = 1 THEN NULL WHEN addresses <> 1 THEN 'REGISTRY_PROPERTY_MISMATCH' WHEN types <> ['BUILDING', 'LAND'] THEN 'REGISTRY_DOCUMENT_SET_INVALID' WHEN least <> documents THEN 'REGISTRY_OWNER_MISMATCH' END AS reject_code
FROM g JOIN ol USING (merge_id)""")
def merge_check(spark, d) -> DataFrame:
    docs = merge_docs(spark, d)
    owners = docs.select("doc_id", F.col("owner").alias("name"), F.lit("800101").alias("jumin_front"), F.lit("1/2").alias("share"))
    return merge.merge_check(docs, owners)


CLAIM_ROWS = f"""{GROUPS}, joints AS (SELECT merge_id, bool_and(o_orderstatus <> 'P') AS joint FROM mdocs GROUP BY 1), lines AS (
  SELECT m.merge_id, m.doc_id, m.document_index, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 10000000000 + l_partkey AS seq, CAST(l_linenumber AS VARCHAR) AS rank_no,
    CASE WHEN l_partkey % 6 > 0 THEN l_partkey % 3 || ' 호' END AS receipt_no, CASE WHEN l_suppkey % 9 > 0 THEN strftime(l_shipdate, '%Y') END AS registered_at, 'Bank ' || l_suppkey % 2 AS creditor, CASE WHEN l_partkey % 4 > 0 THEN 'D' || l_partkey % 2 || ' 800101-1234567' END AS debtor,
    CASE WHEN l_quantity > 2 THEN CAST(l_quantity AS BIGINT) // 10 * 1000000 END AS amount, CASE WHEN l_linestatus = 'F' THEN 'CANCELLED' ELSE 'ACTIVE' END AS status, l_returnflag AS flag, joint
  FROM lineitem JOIN mdocs m ON m.doc_id = l_orderkey JOIN joints USING (merge_id)),
claims AS (SELECT *, doc_id || '/' || seq AS claim_id FROM lines WHERE flag <> 'A'), links AS (SELECT doc_id, rank_no, registered_at, receipt_no, amount FROM lines WHERE flag = 'A')"""
CLAIM_SIGNATURES = """sig AS (SELECT DISTINCT claim_id, sg FROM (
  SELECT claim_id, 'R' || registered_at || '|' || replace(receipt_no, ' ', '') || '|' || amount || status AS sg FROM claims
  UNION ALL SELECT claim_id, 'P' || creditor || '|' || split_part(debtor, ' ', 1) || '|' || amount || status FROM claims WHERE joint
  UNION ALL SELECT claim_id, 'A' || l.registered_at || '|' || l.receipt_no || '|' || coalesce(l.amount, c.amount) || status FROM claims c JOIN links l USING (doc_id, rank_no) WHERE joint) WHERE sg IS NOT NULL)"""
DEPOSIT_SIGNATURES = """sig AS (SELECT DISTINCT claim_id, sg FROM (
  SELECT claim_id, 'R' || registered_at || '|' || replace(receipt_no, ' ', '') || '|' || amount || status AS sg FROM claims
  UNION ALL SELECT claim_id, 'P' || registered_at || '|' || creditor || '|' || amount || status FROM claims) WHERE sg IS NOT NULL)"""
WALK = """items AS (SELECT c.*, coalesce(s.sigs, CAST([] AS VARCHAR[])) AS sigs, row_number() OVER (PARTITION BY merge_id ORDER BY document_index, seq, c.claim_id) AS rn FROM claims c LEFT JOIN (SELECT claim_id, list(sg) AS sigs FROM sig GROUP BY 1) s USING (claim_id)),
walk AS (SELECT merge_id, rn, claim_id, document_index = 0 OR true AS kept, sigs AS seen FROM items WHERE rn = 1
  UNION ALL SELECT merge_id, rn, claim_id, kept, CASE WHEN kept THEN list_concat(seen, sigs) ELSE seen END FROM (
    SELECT i.merge_id, i.rn, i.claim_id, i.sigs, w.seen, i.document_index = 0 OR NOT list_has_any(i.sigs, w.seen) AS kept FROM walk w JOIN items i ON i.merge_id = w.merge_id AND i.rn = w.rn + 1)),
kept_claims AS (SELECT c.* FROM claims c JOIN walk w USING (claim_id) WHERE w.kept)"""
CLAIMS = f"{CLAIM_ROWS}, {CLAIM_SIGNATURES}, {WALK}"


def claim_rows(spark, d) -> tuple[DataFrame, DataFrame]:
    """Claims of all merges with the number of their merge's documents, and the amendments of their ranks. Lines are
    joined to their documents once and stored; several steps read them."""
    c = F.col
    s = lambda x: x.cast("string")
    docs = merge_docs(spark, d)
    joints = docs.groupBy("merge_id").agg(F.min(c("o_orderstatus") != "P").alias("joint"))
    li = B.table(spark, d, "lineitem")
    n = li.count()
    li = spread(li.select("l_orderkey", "l_shipdate", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag"), n, "l_orderkey").withColumnRenamed("l_orderkey", "doc_id")
    day = F.date_diff(c("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    placed = docs.select("merge_id", "doc_id", "document_index", c("n").alias("documents")).join(joints, "merge_id")
    lines = li.join(spread(placed, n, "doc_id"), "doc_id").select(
        "merge_id", "documents", "doc_id", "document_index", (day * 10_000_000_000 + c("l_partkey")).alias("seq"), s(c("l_linenumber")).alias("rank_no"),
        F.when(c("l_partkey") % 6 > 0, F.concat(s(c("l_partkey") % 3), F.lit(" 호"))).alias("receipt_no"), F.when(c("l_suppkey") % 9 > 0, s(F.year("l_shipdate"))).alias("registered_at"),
        F.concat(F.lit("Bank "), s(c("l_suppkey") % 2)).alias("creditor"), F.when(c("l_partkey") % 4 > 0, F.concat(F.lit("D"), s(c("l_partkey") % 2), F.lit(" 800101-1234567"))).alias("debtor"),
        F.when(c("l_quantity") > 2, F.call_function("div", c("l_quantity").cast("long"), F.lit(10)) * 1_000_000).alias("amount"),
        F.when(c("l_linestatus") == "F", "CANCELLED").otherwise("ACTIVE").alias("status"), c("l_returnflag").alias("flag"), "joint")
    lines = cut_lineage(lines)
    claims = lines.where(c("flag") != "A").withColumn("claim_id", F.concat_ws("/", s(c("doc_id")), s(c("seq"))))
    links = lines.where(c("flag") == "A").select("doc_id", "rank_no", "registered_at", "receipt_no", "amount")
    return claims, links


def kept_claims(spark, d) -> DataFrame:
    claims, links = claim_rows(spark, d)
    return merge.greedy_dedupe(claims, merge.claim_signatures(claims.where(F.col("documents") > 1), links), alone=F.col("documents") == 1)


@query("merge_dedupe", "J15 F14", f"WITH RECURSIVE {CLAIMS} SELECT merge_id, claim_id, amount, status FROM kept_claims")
def merge_dedupe(spark, d) -> DataFrame:
    return kept_claims(spark, d).select("merge_id", "claim_id", "amount", "status")


@query("merged_totals", "A10", f"""WITH RECURSIVE {CLAIMS} SELECT merge_id, count(*) FILTER (status = 'ACTIVE') AS active_mortgage_count,
  CASE WHEN count(*) FILTER (status = 'ACTIVE' AND amount IS NULL) = 0 THEN coalesce(CAST(sum(amount) FILTER (status = 'ACTIVE') AS BIGINT), 0) END AS total_active_max_claim_amount FROM kept_claims GROUP BY 1""")
def merged_totals(spark, d) -> DataFrame:
    return merge.merged_totals(kept_claims(spark, d))


_ALL_FLAGS = [*_FLAGS, *_LEASES]


@query("merge_rollup", "A10", f"""WITH {RIGHTS}, {STATUS}, {AMENDED}, {TOTALS}, {SUMMARY}, {PARSED}, {GROUPS}, j AS (SELECT m.merge_id, m.day, l.* FROM mdocs m JOIN ladder l USING (doc_id)), r AS (SELECT merge_id,
  {', '.join(f"CASE WHEN bool_or({n} = 'TRUE') THEN 'TRUE' WHEN bool_or({n} = 'UNKNOWN') THEN 'UNKNOWN' ELSE 'FALSE' END AS {n}" for n in _ALL_FLAGS)},
  CASE WHEN bool_or(gap_section_status = 'PARSE_FAILED') THEN 'PARSE_FAILED' ELSE 'EXTRACTED' END AS gap_section_status,
  CASE WHEN bool_or(eul_section_status = 'PARSE_FAILED') THEN 'PARSE_FAILED' WHEN bool_and(eul_section_status = 'CONFIRMED_NONE') THEN 'CONFIRMED_NONE' ELSE 'EXTRACTED' END AS eul_section_status,
  min(day) AS issue_date, bool_or(has_cancellation_mention) AS has_cancellation_mention, max(CASE parse_status WHEN 'SUCCESS' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 WHEN 'PARTIAL' THEN 2 ELSE 3 END) AS ps,
  max(CASE parse_confidence WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 2 ELSE 3 END) AS pc, CAST(sum(extracted) AS BIGINT) AS extracted_right_count, CAST(sum(verified_right_count) AS BIGINT) AS verified_right_count FROM j GROUP BY 1)
SELECT * EXCLUDE (ps, pc), CASE ps WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'NEEDS_REVIEW' WHEN 2 THEN 'PARTIAL' ELSE 'FAILED' END AS parse_status, CASE pc WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNKNOWN' END AS parse_confidence FROM r""")
def merge_rollup(spark, d) -> DataFrame:
    docs = parsed(spark, d).join(merge_docs(spark, d).select("doc_id", "merge_id", F.col("day").alias("issue_date")), "doc_id")
    return merge.merge_rollup(docs, _ALL_FLAGS)


@query("merged_deposits", "J15", f"WITH RECURSIVE {CLAIM_ROWS}, {DEPOSIT_SIGNATURES}, {WALK} SELECT merge_id, claim_id, amount, status FROM kept_claims")
def merged_deposits(spark, d) -> DataFrame:
    """The claims read as deposit rights of their creditors."""
    rows = claim_rows(spark, d)[0].withColumnRenamed("creditor", "holder")
    signatures = merge.deposit_signatures(rows.where(F.col("documents") > 1))
    return merge.greedy_dedupe(rows, signatures, alone=F.col("documents") == 1).select("merge_id", "claim_id", "amount", "status")


@query("merged_status", "A10", f"""WITH r AS ({CATALOG['merge_rollup'].sql}), t AS ({CATALOG['merged_totals'].sql}), j AS (
  SELECT r.*, coalesce(active_mortgage_count, 0) AS n, CASE WHEN active_mortgage_count IS NULL THEN 0 ELSE total_active_max_claim_amount END AS total FROM r LEFT JOIN t USING (merge_id))
SELECT merge_id, n AS active_mortgage_count, total AS total_active_max_claim_amount, CASE WHEN total IS NULL AND parse_status = 'SUCCESS' THEN 'NEEDS_REVIEW' ELSE parse_status END AS parse_status,
  CASE WHEN total IS NULL AND parse_status = 'SUCCESS' THEN 'MEDIUM' ELSE parse_confidence END AS parse_confidence FROM j""")
def merged_status(spark, d) -> DataFrame:
    return merge.settled_status(merge_rollup(spark, d), merged_totals(spark, d)).select(
        "merge_id", "active_mortgage_count", "total_active_max_claim_amount", "parse_status", "parse_confidence")


# ---- document text ------------------------------------------------------------

SIGNALS = (
    rights.Signal("the", any_of=("the", "The")), rights.Signal("tion", any_of=("tion",)), rights.Signal("number", pattern="[0-9]{4}"),
    rights.Signal("both", all_of=("an", "en", "ou")), rights.Signal("capitals", pattern="[A-Z]{2}"),
)


@query("document_structure", "P26 F2", r"""WITH c AS (SELECT doc_id, regexp_replace(text, '[\s\p{Z}\x{85}\x{1c}-\x{1f}]+', '', 'g') AS t FROM documents), f AS (
  SELECT doc_id, t, list_filter([CASE WHEN contains(t, 'the') OR contains(t, 'The') THEN 'the' END, CASE WHEN contains(t, 'tion') THEN 'tion' END, CASE WHEN regexp_matches(t, '[0-9]{4}') THEN 'number' END,
    CASE WHEN contains(t, 'an') AND contains(t, 'en') AND contains(t, 'ou') THEN 'both' END, CASE WHEN regexp_matches(t, '[A-Z]{2}') THEN 'capitals' END], lambda x: x IS NOT NULL) AS s FROM c)
SELECT doc_id, CASE WHEN t = '' THEN 'UNREADABLE' WHEN len(s) = 5 THEN 'VALID_REGISTRY' WHEN len(s) + 1 >= 4 THEN 'REVIEW_REQUIRED' ELSE 'INVALID_DOCUMENT' END AS structure_status,
  CASE WHEN t = '' THEN '' ELSE array_to_string(list_concat(['text_layer'], s), '|') END AS signals, CASE WHEN t = '' THEN 'text_layer' ELSE array_to_string(list_filter(['the', 'tion', 'number', 'both', 'capitals'], lambda x: NOT list_contains(s, x)), '|') END AS missing_signals FROM f""")
def document_structure(spark, d) -> DataFrame:
    out = rights.document_structure(B.table(spark, d, "documents"), "text", SIGNALS, review_at=4)
    return out.select("doc_id", "structure_status", B.joined(F.col("signals")).alias("signals"), B.joined(F.col("missing_signals")).alias("missing_signals"))


# Register headers and unit fields over the customer table.
HEADERS = r"""heads AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '집합건물' WHEN 1 THEN '토지' ELSE '건물' END AS kind, '주안동 ' || c_custkey || '-9 ' || c_mktsegment || ' 제' || c_custkey % 7 || '동 제' || c_custkey % 20 || '층 제' || c_custkey % 99 || '호' AS addr,
  CASE WHEN c_custkey % 3 > 0 THEN '열람일시 : 2026년 ' || (1 + c_custkey % 12) || '월 3일' ELSE '' END AS issued FROM customer),
full_text AS (SELECT *, 'top' || chr(10) || ' [ ' || kind || ' ]  ' || addr || '  ' || chr(10) || CASE WHEN c_custkey % 5 > 0 THEN '【 갑 구 】 own ' || c_custkey || chr(10) ELSE '' END || CASE WHEN c_custkey % 6 > 0 THEN '[을구] other' || chr(10) ELSE '' END || issued AS t FROM heads)"""


def header_texts(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    df = B.table(spark, d, "customer").select(
        "c_custkey", F.when(k % 4 == 0, "집합건물").when(k % 4 == 1, "토지").otherwise("건물").alias("kind"),
        F.concat(F.lit("주안동 "), s(k), F.lit("-9 "), F.col("c_mktsegment"), F.lit(" 제"), s(k % 7), F.lit("동 제"), s(k % 20), F.lit("층 제"), s(k % 99), F.lit("호")).alias("addr"),
        F.when(k % 3 > 0, F.concat(F.lit("열람일시 : 2026년 "), s(k % 12 + 1), F.lit("월 3일"))).otherwise("").alias("issued"))
    return df.withColumn("t", F.concat(
        F.lit("top\n [ "), "kind", F.lit(" ]  "), "addr", F.lit("  \n"), F.when(k % 5 > 0, F.concat(F.lit("【 갑 구 】 own "), s(k), F.lit("\n"))).otherwise(""),
        F.when(k % 6 > 0, F.lit("[을구] other\n")).otherwise(""), "issued"))


@query("document_headers", "P27 P28 P30", f"""WITH {HEADERS}
SELECT c_custkey, CASE kind WHEN '집합건물' THEN 'CONDOMINIUM' WHEN '토지' THEN 'LAND' ELSE 'BUILDING' END AS document_type, addr AS property_address, CASE WHEN c_custkey % 3 > 0 THEN '2026-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-03' END AS issue_date,
  CASE WHEN c_custkey % 5 > 0 THEN ' own ' || c_custkey || chr(10) || CASE WHEN c_custkey % 6 > 0 THEN '' ELSE issued END END AS gap_text, CASE WHEN c_custkey % 6 > 0 THEN ' other' || chr(10) || issued END AS eul_text FROM full_text""")
def document_headers(spark, d) -> DataFrame:
    df = header_texts(spark, d)
    gap, eul = T.section_texts(F.col("t"))
    return df.select("c_custkey", rights.document_type(F.col("t")).alias("document_type"), rights.header_address(F.col("t")).alias("property_address"),
                     rights.header_issue_date(F.col("t")).alias("issue_date"), gap.alias("gap_text"), eul.alias("eul_text"))


@query("unit_fields", "P31 F8", f"""WITH {HEADERS}
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 1 THEN '5' ELSE CAST(c_custkey % 7 AS VARCHAR) END END AS dong_name, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 5 = 0 THEN -2 ELSE c_custkey % 20 END END AS floor_no,
  CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 2 = 1 THEN '7' ELSE CAST(c_custkey % 99 AS VARCHAR) END END AS ho_name, CASE WHEN c_custkey % 4 = 0 THEN 1059.83 + c_custkey END::DOUBLE AS exclusive_area FROM heads""")
def unit_fields(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    df = header_texts(spark, d)
    cols = rights.unit_columns(
        rights.document_type(F.col("t")), F.col("addr"), F.when(k % 3 == 0, "주안동").when(k % 3 == 1, " 제5동 ").otherwise(none), F.when(k % 5 == 0, "지하 -2층").otherwise(none),
        F.when(k % 2 == 1, "제7호").otherwise(none), F.concat(F.format_number(k + 1059, 0), F.lit(".83㎡")))
    return df.select("c_custkey", *[c.alias(n) for n, c in cols.items()])


# ---- evidence: a page is a line of a document ---------------------------------

_CANON = "lower(regexp_replace({x}, '[^0-9A-Za-z가-힣]', '', 'g'))"
_NOSEP = r"regexp_replace({x}, '[\s,./:()\-년월일]', '', 'g')"
PAGES = f"""lines AS (SELECT doc_id, string_split(text, chr(10)) AS ls, n_chars FROM documents),
pages_t AS (SELECT doc_id, generate_subscripts(ls, 1) AS page_no, unnest(ls) AS text FROM lines), forms AS (SELECT *, {_CANON.format(x='text')} AS canon, {_NOSEP.format(x='text')} AS nosep FROM pages_t)"""


def lines(spark, d) -> DataFrame:
    return B.table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("ls"), "n_chars")


def page_rows(spark, d) -> DataFrame:
    return lines(spark, d).select("doc_id", F.posexplode("ls").alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


@query("value_evidence", "J16 F1", f"""WITH {PAGES}, vals AS (SELECT doc_id, 1 AS value_id, replace(ls[-1], ' ', '--') AS value, false AS num FROM lines UNION ALL SELECT doc_id - 1, 2, ls[1], false FROM lines WHERE doc_id > 0 UNION ALL SELECT doc_id, 3, CAST(n_chars % 100 + 10 AS VARCHAR), true FROM lines),
keyed AS (SELECT *, {_CANON.format(x='value')} AS vc, CASE WHEN regexp_full_match(value, '[0-9\\s,./:()\\-]+') AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 2 THEN regexp_replace(value, '[^0-9]', '', 'g') END AS vn FROM vals),
hits AS (SELECT k.doc_id, value_id, min(page_no) AS page_no FROM keyed k JOIN forms f ON f.doc_id = k.doc_id AND ((vc <> '' AND contains(canon, vc)) OR coalesce(contains(nosep, vn), false)) GROUP BY 1, 2)
SELECT doc_id, value_id, CAST(page_no AS INTEGER) AS page_no FROM vals LEFT JOIN hits USING (doc_id, value_id)""")
def value_evidence(spark, d) -> DataFrame:
    ls = lines(spark, d)
    v = lambda doc, i, value, num: ls.select(doc.alias("doc_id"), F.lit(i).alias("value_id"), value.alias("value"), F.lit(num).alias("is_number"))
    k = F.col("doc_id")
    values = v(k, 1, F.replace(F.element_at("ls", -1), F.lit(" "), F.lit("--")), False).unionByName(v(k - 1, 2, F.element_at("ls", 1), False).where("doc_id >= 0")).unionByName(
        v(k, 3, (F.col("n_chars") % 100 + 10).cast("string"), True))
    return evidence.locate_values(values, page_rows(spark, d)).select("doc_id", "value_id", "page_no")


MARKERS = ("tion", "the", "ment")
_PS = "({c} <> '' AND contains({p}, {c})) OR ((contains({c}, 'tion') OR contains({c}, 'the') OR contains({c}, 'ment')) AND (NOT contains({c}, 'tion') OR contains({p}, 'tion')) AND (NOT contains({c}, 'the') OR contains({p}, 'the')) AND (NOT contains({c}, 'ment') OR contains({p}, 'ment')))"
RIGHT_EVIDENCE = f"""{PAGES}, asks AS (
  SELECT doc_id, 1 AS seq, ls[-1] AS purpose, NULL AS receipt_no, NULL AS holder, ls[1] AS registered_at FROM lines
  UNION ALL SELECT doc_id, 2, 'tion the', ls[2], ls[-1], NULL FROM lines UNION ALL SELECT doc_id, 3, right(ls[1], 9) || left(ls[2], 9), NULL, ls[3], NULL FROM lines WHERE len(ls) > 1
  UNION ALL SELECT doc_id, 4, 'ment', ls[-1], NULL, ls[1] FROM lines),
fulls AS (SELECT doc_id, {_CANON.format(x='text')} AS fc FROM documents),
r AS (SELECT a.*, {_CANON.format(x='purpose')} AS pc, coalesce({_CANON.format(x='receipt_no')}, '') AS rc, coalesce({_CANON.format(x='holder')}, '') AS hc, coalesce({_CANON.format(x='registered_at')}, '') AS dc, fc FROM asks a JOIN fulls USING (doc_id) WHERE purpose <> ''),
r2 AS (SELECT *, rc <> '' AND contains(fc, rc) AS receipt_ok FROM r WHERE {_PS.format(c='pc', p='fc')}),
spans AS (SELECT doc_id, page_no AS first_page, 1 AS n_pages, canon FROM forms UNION ALL SELECT a.doc_id, a.page_no, 2, a.canon || b.canon FROM forms a JOIN forms b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1),
j AS (SELECT r2.*, first_page, n_pages, canon, {_PS.format(c='pc', p='canon')} AS semantic, pc <> '' AND contains(canon, pc) AS exact, receipt_ok AND contains(canon, rc) AS rhere FROM r2 JOIN spans s ON s.doc_id = r2.doc_id),
lv AS (SELECT *, CASE WHEN bool_or(n_pages = 1 AND exact) OVER w THEN 2 WHEN bool_or(n_pages = 1 AND semantic) OVER w THEN 3 ELSE 4 END AS lvl FROM j WINDOW w AS (PARTITION BY doc_id, seq)),
q AS (SELECT DISTINCT doc_id, seq, p FROM (SELECT doc_id, seq, first_page AS p FROM lv WHERE n_pages = 1 AND ((lvl = 2 AND exact) OR (lvl = 3 AND semantic)) UNION ALL SELECT doc_id, seq, unnest([first_page, first_page + 1]) FROM lv WHERE n_pages = 2 AND lvl = 4 AND semantic)),
rp AS (SELECT DISTINCT doc_id, seq, first_page AS p FROM lv WHERE n_pages = 1 AND rhere),
c0 AS (SELECT lv.*, EXISTS (SELECT 1 FROM q WHERE q.doc_id = lv.doc_id AND q.seq = lv.seq AND q.p = first_page) AS q0, EXISTS (SELECT 1 FROM q WHERE q.doc_id = lv.doc_id AND q.seq = lv.seq AND q.p = first_page + 1) AS q1,
  EXISTS (SELECT 1 FROM rp WHERE rp.doc_id = lv.doc_id AND rp.seq = lv.seq AND rp.p = first_page) AS p0, EXISTS (SELECT 1 FROM rp WHERE rp.doc_id = lv.doc_id AND rp.seq = lv.seq AND rp.p = first_page + 1) AS p1 FROM lv WHERE semantic),
cand AS (SELECT *, CASE WHEN receipt_ok THEN 10 ELSE 4 END + CASE WHEN hc <> '' AND contains(canon, hc) THEN 1 ELSE 0 END + CASE WHEN dc <> '' AND contains(canon, dc) THEN 1 ELSE 0 END AS score FROM c0
  WHERE CASE WHEN receipt_ok THEN CASE WHEN n_pages = 1 THEN q0 AND p0 ELSE (p0 AND q1) OR (p1 AND q0) END ELSE CASE WHEN n_pages = 1 THEN q0 ELSE q0 OR q1 END END),
best AS (SELECT *, max(score * 10 - n_pages) OVER (PARTITION BY doc_id, seq) AS top FROM cand), tied AS (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS ties FROM best WHERE score * 10 - n_pages = top)"""


def right_asks(spark, d) -> DataFrame:
    none = F.lit(None).cast("string")
    ls = lines(spark, d)
    at = lambda i: F.try_element_at("ls", F.lit(i))
    tail, head = F.substring(at(1), F.greatest(F.length(at(1)) - 8, F.lit(1)), F.lit(9)), F.substring(at(2), F.lit(1), F.lit(9))
    row = lambda seq, purpose, receipt, holder, reg: F.struct(
        F.lit(seq).alias("seq"), purpose.alias("purpose"), receipt.alias("receipt_no"), holder.alias("holder"), reg.alias("registered_at"))
    rows = F.array(row(1, at(-1), none, none, at(1)), row(2, F.lit("tion the"), at(2), at(-1), none),
                   row(3, F.concat(tail, head), none, at(3), none), row(4, F.lit("ment"), at(-1), none, at(1)))
    return ls.select("doc_id", F.inline(rows)).select(
        "doc_id", "seq", F.lit("갑구").alias("section"), F.lit("zz9").alias("rank_no"), "purpose", "receipt_no", "registered_at", "holder",
        none.alias("debtor"), F.lit(None).cast("long").alias("amount"), F.array().cast("array<string>").alias("target_rank_nos"), none.alias("joint_collateral_id"))


@query("right_evidence", "J17 W6 W10 F10", f"WITH {RIGHT_EVIDENCE} SELECT doc_id, seq, CAST(first_page AS INTEGER) AS first_page, n_pages, score FROM tied WHERE ties = 1")
def right_evidence(spark, d) -> DataFrame:
    sections = B.table(spark, d, "documents").select("doc_id", F.col("text").alias("gap_text"), F.lit(None).cast("string").alias("eul_text"))
    out = evidence.locate_rights(right_asks(spark, d), page_rows(spark, d), sections, markers=MARKERS)
    return out.select("doc_id", "seq", "first_page", "n_pages", "score")


# ---- register documents written from line items: ranks, receipts, amounts, targets, entries cut by a page's end ----

ENTRY_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def entries_sql(order: Sequence[str] = ENTRY_ORDER) -> str:
    return f"""e0 AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(order)}) AS n, l_partkey AS p, l_suppkey AS s, CAST(floor(l_extendedprice) AS BIGINT) AS price, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem),
e1 AS (SELECT *, CASE WHEN n % 4 = 3 THEN (n - 1) || '(1)' ELSE CAST(n AS VARCHAR) END AS rank_no, CAST(n - 1 AS VARCHAR) AS target,
  CASE p % 6 WHEN 0 THEN '근저당권설정' WHEN 1 THEN '가압류' WHEN 2 THEN (n - 1) || '번근저당권설정등기말소' WHEN 3 THEN '근저당권변경' WHEN 4 THEN '전세권설정' ELSE '가처분 이전' END AS purpose FROM e0),
e2 AS (SELECT *, replace(rank_no, '(', chr(10) || '(') || ' ' || CASE WHEN p % 6 = 3 AND s % 2 = 0 THEN target || '번 ' WHEN p % 6 = 3 THEN target || ' 번의 ' ELSE '' END AS lead,
  ' 제' || p || '호 ' || shipped || chr(10) || '채권최고액 금' || format('{{:,}}', price) || '원 권리자 은행' || s || chr(10) AS rest FROM e1),
e3 AS (SELECT *, CASE WHEN p % 5 = 0 THEN lead || left(purpose, 3) ELSE lead || CASE WHEN p % 7 = 0 THEN replace(purpose, '권', '권 ') ELSE purpose END || rest END AS own, CASE WHEN p % 5 = 0 THEN substr(purpose, 4) || rest ELSE '' END AS over FROM e2)"""


PAGES_AND_ASKS = """pg AS (SELECT doc_id, n AS page_no, coalesce(lag(over) OVER (PARTITION BY doc_id ORDER BY n), '') || own || CASE WHEN lead(n) OVER (PARTITION BY doc_id ORDER BY n) IS NULL THEN over ELSE '' END AS text FROM entries),
asked AS (SELECT doc_id, n AS seq, CASE WHEN p % 6 IN (1, 5) THEN '갑구' ELSE '을구' END AS section, CASE WHEN p % 11 = 0 THEN 'zz' ELSE rank_no || CASE WHEN p % 3 = 0 THEN ' 번 ' ELSE '' END END AS rank_no, purpose, CASE WHEN s % 3 > 0 THEN '제 ' || p || ' 호' END AS receipt_no,
  shipped AS registered_at, '은행' || s AS holder, CASE WHEN p % 9 = 0 THEN '없는 이름' END AS debtor, CASE WHEN s % 5 > 0 THEN price + CASE WHEN p % 13 = 0 THEN 1 ELSE 0 END END AS amount, CASE WHEN p % 6 IN (2, 3) THEN [target] ELSE CAST([] AS VARCHAR[]) END AS targets FROM e1)"""


def _supported_sql(c: str, p: str) -> str:
    marks = " AND ".join(f"(NOT contains({c}, '{m}') OR contains({p}, '{m}'))" for m in T.PURPOSE_MARKERS)
    lead = f"regexp_extract({c}, '^([0-9]+)번', 1)"
    return f"(({c} <> '' AND contains({p}, {c})) OR ((regexp_matches({c}, '{'|'.join(T.PURPOSE_MARKERS)}') OR {lead} <> '') AND {marks} AND ({lead} = '' OR contains({p}, {lead} || '번'))))"


# Follows entries, pages and asks, and sect: the canonical text of both sections (gc, ec; null where there is none).
LOCATED = f"""pf AS (SELECT *, {_CANON.format(x='text')} AS canon, max(page_no) OVER (PARTITION BY doc_id) AS last FROM pg),
r AS (SELECT *, {_CANON.format(x='purpose')} AS pc, coalesce({_CANON.format(x='receipt_no')}, '') AS rc, {_CANON.format(x='registered_at')} AS dc, {_CANON.format(x='holder')} AS hc, coalesce({_CANON.format(x='debtor')}, '') AS bc,
  list_distinct(list_concat(targets, regexp_extract_all(purpose, '([0-9]+)\\s*번', 1))) AS tg, regexp_replace(trim(rank_no), '\\s*번\\s*$', '') AS rk
  FROM (SELECT asked.*, CASE WHEN section = '갑구' THEN gc ELSE ec END AS fc FROM asked JOIN sect USING (doc_id)) WHERE fc IS NOT NULL),
r2 AS (SELECT *, rc <> '' AND contains(fc, rc) AS receipt_ok FROM r WHERE {_supported_sql('pc', 'fc')}),
spans AS (SELECT doc_id, page_no AS first_page, 1 AS n_pages, canon, text FROM pf UNION ALL SELECT a.doc_id, a.page_no, 2, a.canon || b.canon, a.text || chr(10) || b.text FROM pf a JOIN pf b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 1),
j AS (SELECT r2.*, first_page, n_pages, canon, text, {_supported_sql('pc', 'canon')} AS semantic, contains(canon, pc) AS exact, receipt_ok AND contains(canon, rc) AS rhere,
  len(list_filter(tg, lambda t: NOT starts_with(pc, t || '번') AND contains(canon, t || '번' || pc))) > 0 AS anchored FROM r2 JOIN spans s ON s.doc_id = r2.doc_id),
lv AS (SELECT *, CASE WHEN bool_or(n_pages = 1 AND anchored) OVER w THEN 1 WHEN bool_or(n_pages = 1 AND exact) OVER w THEN 2 WHEN bool_or(n_pages = 1 AND semantic) OVER w THEN 3 ELSE 4 END AS lvl FROM j WINDOW w AS (PARTITION BY doc_id, seq)),
q AS (SELECT DISTINCT doc_id, seq, p FROM (SELECT doc_id, seq, first_page AS p FROM lv WHERE n_pages = 1 AND ((lvl = 1 AND anchored) OR (lvl = 2 AND exact) OR (lvl = 3 AND semantic)) UNION ALL SELECT doc_id, seq, unnest([first_page, first_page + 1]) FROM lv WHERE n_pages = 2 AND lvl = 4 AND semantic)),
qp AS (SELECT doc_id, seq, list(p) AS qs FROM q GROUP BY ALL), rp AS (SELECT doc_id, seq, list(first_page) AS rs FROM lv WHERE n_pages = 1 AND rhere GROUP BY ALL),
c0 AS (SELECT lv.*, list_contains(qs, first_page) AS q0, list_contains(qs, first_page + 1) AS q1, coalesce(list_contains(rs, first_page), false) AS p0, coalesce(list_contains(rs, first_page + 1), false) AS p1
  FROM lv JOIN qp USING (doc_id, seq) LEFT JOIN rp USING (doc_id, seq) WHERE semantic),
cand AS (SELECT *, CASE WHEN regexp_matches(rk, '^[0-9]+\\([0-9]+\\)$') THEN regexp_matches(text, '(^|\\n)[ \\t]*' || replace(replace(rk, '(', '[ \\t]*\\n[ \\t]*\\('), ')', '\\)')) ELSE regexp_matches(text, '(^|\\n)\\s*' || rk || '(\\s|$)') END AS rank_found,
  list_filter(tg, lambda t: contains(pc, t || '번') OR regexp_matches(text, '(^|[^0-9])' || t || '\\s*번')) AS target_found FROM c0
  WHERE CASE WHEN receipt_ok THEN CASE WHEN n_pages = 1 THEN q0 AND p0 ELSE (p0 AND q1) OR (p1 AND q0) END ELSE CASE WHEN n_pages = 1 THEN q0 ELSE q0 OR q1 END END AND (amount IS NULL OR contains(canon, CAST(amount AS VARCHAR)))),
scored AS (SELECT *, CASE WHEN receipt_ok THEN 10 ELSE 4 END + CASE WHEN rank_found THEN 2 ELSE 0 END + CAST(contains(canon, dc) AS INT) + CAST(contains(canon, hc) AS INT) + CAST(bc <> '' AND contains(canon, bc) AS INT) + CAST(amount IS NOT NULL AS INT) + len(target_found) AS score FROM cand),
best AS (SELECT *, max(score * 10 - n_pages) OVER (PARTITION BY doc_id, seq) AS top FROM scored), tied AS (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS ties FROM best WHERE score * 10 - n_pages = top)"""


WHOLE = "whole AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY page_no) AS t FROM pg GROUP BY 1)"


def register_entries(spark, d, order: Sequence[str] = ENTRY_ORDER) -> DataFrame:
    """Entries of a register document for each order, and what is asked for each of them."""
    n, p, s = F.col("n"), F.col("p"), F.col("s")
    text = lambda *parts: F.concat(*[x.cast("string") if not isinstance(x, str) else F.lit(x) for x in parts])
    w = Window.partitionBy("doc_id").orderBy(*[F.expr(c) for c in order])
    li = B.table(spark, d, "lineitem").withColumn("doc_id", F.col("l_orderkey")).withColumn("n", F.row_number().over(w))
    e = li.select("doc_id", "n", F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.floor("l_extendedprice").cast("long").alias("price"),
                  F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"))
    e = e.withColumns({"rank": F.when(n % 4 == 3, text(n - 1, "(1)")).otherwise(text(n)), "target": text(n - 1), "purpose": F.element_at(F.array(
        F.lit("근저당권설정"), F.lit("가압류"), text(n - 1, "번근저당권설정등기말소"), F.lit("근저당권변경"), F.lit("전세권설정"), F.lit("가처분 이전")), (p % 6 + 1).cast("int"))})
    before = F.when((p % 6 == 3) & (s % 2 == 0), text(F.col("target"), "번 ")).when(p % 6 == 3, text(F.col("target"), " 번의 ")).otherwise("")
    lead = F.concat(F.replace(F.col("rank"), F.lit("("), F.lit("\n(")), F.lit(" "), before)
    rest = text(" 제", p, "호 ", F.col("shipped"), "\n채권최고액 금", F.format_number("price", 0), "원 권리자 은행", s, "\n")
    cut = p % 5 == 0
    shown = F.when(p % 7 == 0, F.replace("purpose", F.lit("권"), F.lit("권 "))).otherwise(F.col("purpose"))
    return e.withColumns({"own": F.when(cut, F.concat(lead, F.left("purpose", F.lit(3)))).otherwise(F.concat(lead, shown, rest)),
                          "over": F.when(cut, F.concat(F.expr("substr(purpose, 4)"), rest)).otherwise("")})


def register_pages(entries: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("n")
    rest = F.when(F.lead("n").over(w).isNull(), F.col("over")).otherwise("")
    return entries.select("doc_id", F.col("n").alias("page_no"), F.concat(F.coalesce(F.lag("over").over(w), F.lit("")), F.col("own"), rest).alias("text"))


def register_asks(entries: DataFrame) -> DataFrame:
    p, s = F.col("p"), F.col("s")
    return entries.select(
        "doc_id", F.col("n").alias("seq"), F.when((p % 6).isin(1, 5), "갑구").otherwise("을구").alias("section"),
        F.when(p % 11 == 0, "zz").otherwise(F.concat("rank", F.when(p % 3 == 0, " 번 ").otherwise(""))).alias("rank_no"), "purpose",
        F.when(s % 3 > 0, F.concat(F.lit("제 "), p.cast("string"), F.lit(" 호"))).alias("receipt_no"), F.col("shipped").alias("registered_at"),
        F.concat(F.lit("은행"), s.cast("string")).alias("holder"), F.when(p % 9 == 0, "없는 이름").alias("debtor"),
        F.when(s % 5 > 0, F.col("price") + F.when(p % 13 == 0, 1).otherwise(0)).alias("amount"),
        F.when((p % 6).isin(2, 3), F.array("target")).otherwise(F.array().cast("array<string>")).alias("target_rank_nos"), F.lit(None).cast("string").alias("joint_collateral_id"))


@query("right_evidence_full", "J17 W6 W10 F10", f"""WITH {entries_sql()}, entries AS (SELECT * FROM e3), {PAGES_AND_ASKS}, {WHOLE},
sect AS (SELECT doc_id, {_CANON.format(x='t')} AS gc, CASE WHEN doc_id % 9 > 0 THEN gc END AS ec FROM whole), {LOCATED} SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(first_page AS INTEGER) AS first_page, n_pages, CAST(score AS INTEGER) AS score, rank_found, array_to_string(target_found, '|') AS target_found, purpose, rank_no FROM tied WHERE ties = 1""")
def right_evidence_full(spark, d) -> DataFrame:
    """Ranks, receipts, amounts, targets, anchors and the real markers, over documents of several pages."""
    entries = cut_lineage(register_entries(spark, d))
    pages = cut_lineage(register_pages(entries))
    whole = evidence.join_pages(pages)
    sections = whole.select("doc_id", F.col("full_text").alias("gap_text"), F.when(F.col("doc_id") % 9 > 0, F.col("full_text")).alias("eul_text"))
    out = evidence.locate_rights(register_asks(entries), pages, sections)
    return out.select("doc_id", "seq", "first_page", "n_pages", "score", "rank_found", B.joined(F.col("target_found")).alias("target_found"), "purpose", "rank_no")


OWNER_EVIDENCE = f"""{PAGES}, words AS (SELECT doc_id, string_split(ls[1], ' ') AS w1, string_split(coalesce(ls[2], ''), ' ') AS w2, ls FROM lines), asks AS (SELECT doc_id, w1[1] AS name, CASE WHEN doc_id % 3 > 0 THEN coalesce(w1[4], '') ELSE 'absent words' END AS jumin,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ls[2] WHEN 2 THEN concat_ws(' ', w1[-1], w2[1], w2[3]) ELSE concat_ws(' ', w1[1], w1[3], w1[5]) END AS address FROM words),
a AS (SELECT *, {_CANON.format(x='name')} AS nc, {_CANON.format(x='jumin')} AS jc, {_CANON.format(x="coalesce(address, '')")} AS ac, regexp_extract_all(lower(coalesce(address, '')), '([가-힣a-z]+|[0-9]+)') AS toks FROM asks),
nx AS (SELECT f.*, n.text AS next_text, n.canon AS next_canon FROM forms f LEFT JOIN forms n ON n.doc_id = f.doc_id AND n.page_no = f.page_no + 1),
hit AS (SELECT a.*, page_no, text, next_text, canon, next_canon, string_split(canon, nc) AS pieces FROM a JOIN nx ON nx.doc_id = a.doc_id AND nc <> '' AND contains(canon, nc)),
idn AS (SELECT * FROM hit WHERE jumin = '' OR (jc <> '' AND len(list_filter(range(1, len(pieces)), lambda n: contains(
  substr(canon, CAST(greatest(coalesce(list_sum(list_transform(pieces[1:n], lambda x: length(x))), 0) + (n - 1) * length(nc) - 700, 0) AS BIGINT) + 1,
    CAST(coalesce(list_sum(list_transform(pieces[1:n], lambda x: length(x))), 0) + (n - 1) * length(nc) AS BIGINT) - CAST(greatest(coalesce(list_sum(list_transform(pieces[1:n], lambda x: length(x))), 0) + (n - 1) * length(nc) - 700, 0) AS BIGINT) + length(nc) + 700), jc))) > 0)),
ok AS (SELECT doc_id, page_no, CASE WHEN coalesce(address, '') = '' OR (ac <> '' AND contains(canon, ac)) OR (len(toks) >= 3 AND list_reduce(regexp_extract_all(lower(text), '([가-힣a-z]+|[0-9]+)'), lambda i, t: CAST(CASE WHEN toks[CAST(i AS INTEGER) + 1] = t THEN CAST(i AS INTEGER) + 1 ELSE CAST(i AS INTEGER) END AS VARCHAR), '0') = CAST(len(toks) AS VARCHAR)) THEN 1
  WHEN next_text IS NOT NULL AND ((ac <> '' AND contains(canon || next_canon, ac)) OR (len(toks) >= 3 AND list_reduce(regexp_extract_all(lower(text || chr(10) || next_text), '([가-힣a-z]+|[0-9]+)'), lambda i, t: CAST(CASE WHEN toks[CAST(i AS INTEGER) + 1] = t THEN CAST(i AS INTEGER) + 1 ELSE CAST(i AS INTEGER) END AS VARCHAR), '0') = CAST(len(toks) AS VARCHAR))) THEN 2 END AS n_pages FROM idn)"""


@query("owner_evidence", "J18 F12", f"WITH {OWNER_EVIDENCE} SELECT doc_id, CAST(min(page_no) AS INTEGER) AS first_page, arg_min(n_pages, page_no) AS n_pages FROM ok WHERE n_pages IS NOT NULL GROUP BY 1")
def owner_evidence(spark, d) -> DataFrame:
    k = F.col("doc_id")
    at = lambda c, i: F.try_element_at(F.col(c), F.lit(i))
    w = lines(spark, d).select("doc_id", "ls", F.split(at("ls", 1), " ", -1).alias("w1"), F.split(F.coalesce(at("ls", 2), F.lit("")), " ", -1).alias("w2"))
    none = F.lit(None).cast("string")
    owners = w.select(
        "doc_id", F.lit(1).alias("owner_seq"), at("w1", 1).alias("name"), F.when(k % 3 > 0, F.coalesce(at("w1", 4), F.lit(""))).otherwise("absent words").alias("jumin_front"),
        F.when(k % 4 == 0, none).when(k % 4 == 1, at("ls", 2)).when(k % 4 == 2, F.concat_ws(" ", at("w1", -1), at("w2", 1), at("w2", 3)))
        .otherwise(F.concat_ws(" ", at("w1", 1), at("w1", 3), at("w1", 5))).alias("address"), none.alias("share"))
    return evidence.locate_owners(owners, page_rows(spark, d)).select("doc_id", "first_page", "n_pages")


# ---- small text rules -----------------------------------------------------------

@query("evidence_excerpts", "F13 F17", f"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls, source, {_CANON.format(x="string_split(text, chr(10))[-1]")} AS vc, regexp_replace(string_split(text, chr(10))[-1], '[^0-9]', '', 'g') AS vd FROM documents),
h AS (SELECT *, list_position(list_transform(ls, lambda s: (vc <> '' AND contains({_CANON.format(x='s')}, vc)) OR (length(vd) >= 2 AND contains(regexp_replace(s, '[^0-9]', '', 'g'), vd))), true) AS p FROM l)
SELECT doc_id, '[FILE ' || source || '_x.pdf] ' || CASE WHEN coalesce(p, 0) = 0 THEN '' ELSE array_to_string(ls[greatest(p - 1, 1):p + 1], ' | ') END AS raw_text FROM h""")
def evidence_excerpts(spark, d) -> DataFrame:
    last = F.element_at(F.split("text", "\n", -1), -1)
    # Only ASCII edge characters are trimmed here, as the SQL side does.
    return B.table(spark, d, "documents").select(
        "doc_id", merge.tagged_evidence(F.concat(F.lit(" "), "source", F.lit("][x.pdf ")), T.excerpt(F.col("text"), [last])).alias("raw_text"))


@query("rank_evidence", "F11 F18", """WITH p AS (SELECT l_orderkey, l_partkey, l_linenumber, l_partkey % 9 AS a, l_suppkey % 4 AS b, '  ' || l_partkey % 9 || ' x' || chr(10) || l_partkey % 5 || chr(10) || ' (' || l_suppkey % 3 || ')y' || chr(10) || l_linenumber || '번 z' AS t FROM lineitem)
SELECT l_orderkey, l_partkey, l_linenumber, l_linenumber = l_partkey % 9 OR l_linenumber = l_partkey % 5 AS plain_found, regexp_matches(t, '(?m)^[ ]*' || b || '[ ]*$\\n[ ]*\\(' || b || '\\)') AS split_found, regexp_matches(t, '(^|[^0-9])' || b || '\\s*번') AS target_found FROM p""")
def rank_evidence(spark, d) -> DataFrame:
    s = lambda c: c.cast("string")
    c = F.col
    df = B.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (c("l_suppkey") % 4).alias("b"), F.concat(
        F.lit("  "), s(c("l_partkey") % 9), F.lit(" x\n"), s(c("l_partkey") % 5), F.lit("\n ("), s(c("l_suppkey") % 3), F.lit(")y\n"), s(c("l_linenumber")), F.lit("번 z")).alias("t"))
    heads, split = T.line_heads(c("t")), T.split_heads(c("t"))
    both = F.concat(s(c("b")), F.lit("("), s(c("b")), F.lit(")"))
    return df.select("l_orderkey", "l_partkey", "l_linenumber", T.rank_supported(s(c("l_linenumber")), heads, split).alias("plain_found"),
                     T.rank_supported(both, heads, split).alias("split_found"), evidence.target_supported(s(c("b")), F.lit("x"), c("t"), F.lit(True)).alias("target_found"))


@query("text_normalisation", "F7 F9 F15", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 4 = 0 THEN (o_custkey % 9 + 1) || '/' || (o_custkey % 7 + 2) WHEN o_orderkey % 4 = 1 AND o_custkey % 2 = 0 THEN (o_custkey % 9 + 1) || '/' || (o_custkey % 7 + 2) END AS share,
  lower(replace(o_orderpriority, ' ', '')) AS name FROM orders""")
def text_normalisation(spark, d) -> DataFrame:
    s = lambda c: c.cast("string")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    a, b = s(F.col("o_custkey") % 9 + 1), s(F.col("o_custkey") % 7 + 2)
    date = F.when(k % 5 > 0, F.concat(s(F.year(day)), F.lit("년 "), s(F.month(day)), F.lit(" 월"), s(F.dayofmonth(day)), F.lit("일"))).otherwise("no date 12")
    korean, slash = F.concat(b, F.lit(" 분의 "), a), F.concat(F.lit(" "), a, F.lit(" / "), b)
    share = F.when(k % 4 == 0, korean).when(k % 4 == 1, slash)
    page = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("지분 "), b, F.lit("분의 "), a, F.lit(" 끝"))).when(k % 4 == 0, F.concat(F.lit("지분 "), b, F.lit("분의"), a)).otherwise("none")
    return B.table(spark, d, "orders").select("o_orderkey", T.loose_date(date).alias("day"), T.share_fraction(share, page).alias("share"), T.name_key(F.concat(F.lit("　"), F.col("o_orderpriority"))).alias("name"))


# ---- stored register results ------------------------------------------------------

def nested_results(spark, d) -> DataFrame:
    """One result per order with its owners and rights; an order has few lines."""
    r = statused(spark, d).groupBy(F.col("doc_id").alias("analysis_id")).agg(F.array_sort(F.collect_list(
        F.struct("seq", "section", "kind", "rank_no", "receipt_no", "amount", "status"))).alias("rights"))
    o = B.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.col("o_orderstatus").alias("parse_status"), F.array(
            F.struct(F.concat(F.lit(" C"), F.col("o_custkey").cast("string")).alias("name"), F.lit("800101 ").alias("jumin_front")),
            F.struct(F.lit("Joint").alias("name"), F.lit("").alias("jumin_front"))).alias("current_owners"))
    return o.join(r, "analysis_id")


@query("register_rights_table", "S8", f"WITH {RIGHTS}, {STATUS} SELECT doc_id AS analysis_id, CASE section WHEN '갑구' THEN 'GAP' ELSE 'EUL' END AS section, kind, rank_no, receipt_no, amount, status FROM rights JOIN orders ON o_orderkey = doc_id")
def register_rights_table(spark, d) -> DataFrame:
    return sinks.register_tables(nested_results(spark, d))["registry_rights"].select("analysis_id", "section", "kind", "rank_no", "receipt_no", "amount", "status")


@query("watchlist_owner_ids", "S9 J23", f"""WITH o AS (SELECT o_orderkey AS analysis_id, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT analysis_id, 'C' || o_custkey AS name, true AS has_owner, '[{{"name":"C' || o_custkey || '"}}]' AS details_json FROM o
UNION ALL SELECT analysis_id, 'Other', false, NULL FROM o""")
def watchlist_owner_ids(spark, d) -> DataFrame:
    results = nested_results(spark, d)
    owners = sinks.register_tables(results)["registry_owners"]
    checks = owners.where(F.col("name") != "Joint").select("analysis_id", T.strip(F.col("name")).alias("name"), F.lit(" 800101").alias("jumin_front"), F.array(F.struct(T.strip(F.col("name")).alias("name"))).alias("candidates"))
    other = results.select("analysis_id", F.lit("Other").alias("name"), F.lit("").alias("jumin_front"), F.array().cast("array<struct<name:string>>").alias("candidates"))
    out = sinks.attach_owner_ids(checks.unionByName(other), owners)
    return out.select("analysis_id", "name", F.col("registry_owner_id").isNotNull().alias("has_owner"), sinks.candidates_json(F.col("candidates")).alias("details_json"))
