"""Whole-document resolution: register documents written from line items, resolved to one row each.

A document has its header, owners and ownership entries first, then the other rights, one entry to a page; the last page
carries the notes of issue. What is asked of it (headers, owners, rights) is right, wrong, blank or missing by turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators import evidence, resolve
from rentlens.plans import register_queries as R
from rentlens.plans.catalog import query
from rentlens.session import cut_lineage

ORDER = ("l_partkey % 6 NOT IN (1, 5)", *R.ENTRY_ORDER)
AS_OF = "2026-09-01"

# Texts by document id (k). Kind of property, address, area; each in SQL that both engines read alike.
_K = "CAST({k} AS STRING)"
KIND = "CASE {k} % 3 WHEN 0 THEN '집합건물' WHEN 1 THEN '토지' ELSE '건물' END"
ADDRESS = (f"concat('다온도 새솔시 한솔동 ', {_K}, CASE WHEN {{k}} % 4 < 3 THEN concat(' 제', CAST(101 + {{k}} % 4 AS STRING), '동') ELSE '' END,"
           " ' 제', CAST({k} % 20 + 1 AS STRING), '층 제', CAST(300 + {k} % 20 AS STRING), '호')")
AREA = "concat(CAST(30 + {k} % 50 AS STRING), '.', CAST(5 + {k} % 3 AS STRING))"
DAY = "CAST(10 + {k} % 18 AS STRING)"
HEAD = (f"concat('[', {KIND}, '] ', {ADDRESS}, chr(10), '전유부분 ', {AREA}, '㎡', chr(10), '【갑구】', chr(10),"
        f" '소유자 김', {_K}, ' 900101-******* 지분 2분의 1 새솔시 가람길 ', {_K}, chr(10),"
        f" '소유자 박', {_K}, ' 920202-******* 지분 2분의 1 새솔시 나루길 ', {_K}, chr(10))")
EUL_HEAD = "concat('【을구】', chr(10))"
ISSUED = f"concat(CASE WHEN {{k}} % 5 < 2 THEN '작성일 : ' ELSE '열람일시 : ' END, '2026년 ', CASE WHEN {{k}} % 2 = 0 THEN '08' ELSE '8' END, '월 ', {DAY}, '일', chr(10))"
TAIL = (f"concat(CASE WHEN {{last}} AND {{k}} % 9 > 0 THEN concat({EUL_HEAD}, CASE WHEN {{k}} % 2 = 0 THEN '기록 사항 없음' ELSE '-' END, chr(10)) ELSE '' END,"
        f" CASE WHEN {{k}} % 10 = 0 THEN concat('공동담보목록 제', {_K}, '호', chr(10)) ELSE '' END, {ISSUED})")
# What is asked of the header, by value.
HEADERS = {
    "property_address": f"CASE {{k}} % 4 WHEN 0 THEN '가림도 없는시 1' WHEN 1 THEN NULL ELSE concat(' ', {ADDRESS}, ' ') END",
    "issue_date": f"CASE WHEN {{k}} % 5 = 0 THEN '1999-01-01' WHEN {{k}} % 7 > 0 THEN concat('2026-08-', {DAY}) END",
    "dong_name": "CASE WHEN {k} % 7 = 0 THEN '한솔동' WHEN {k} % 5 > 0 THEN concat('제', CAST(101 + {k} % 4 AS STRING), '동') END",
    "floor": "CASE WHEN {k} % 4 = 3 THEN '77층' ELSE concat('제', CAST({k} % 20 + 1 AS STRING), '층') END",
    "ho_name": "CASE WHEN {k} % 6 < 5 THEN concat(CAST(300 + {k} % 20 AS STRING), '호') END",
    "exclusive_area_sqm": f"CASE WHEN {{k}} % 8 = 0 THEN '123456.75' ELSE {AREA} END",
}
# Owners asked: (name, id, address). Where the id or the address stands nowhere the owner is not found.
OWNERS = (
    (f"concat('김', {_K})", "'900101-*******'", f"CASE WHEN {{k}} % 11 = 0 THEN '' WHEN {{k}} % 7 = 0 THEN '없는 주소' ELSE concat('새솔시 가람길 ', {_K}) END"),
    (f"concat('박', {_K})", "CASE WHEN {k} % 5 = 0 THEN 'zz0000-*******' ELSE '920202-*******' END", f"concat('새솔시 나루길 ', {_K})"),
)
COLUMNS = ("doc_id", "document_type", "property_address", "issue_date", "dong_name", "floor_no", "ho_name", "exclusive_area", "has_joint_collateral_mention",
           "owner_count", "extracted_right_count", *R._SUM_OUT[1:], "parse_status", "parse_confidence")


def _unit(column: str, value: str, suffix: str, number: str) -> str:
    """A condominium's unit label: the value without its affixes, else the one in the address."""
    own = f"nullif(regexp_replace(regexp_replace({value}, '^제', ''), '{suffix}$', ''), '')"
    own = f"CASE WHEN {own} <> '한솔' THEN {own} END" if suffix == "동" else own
    found = f"nullif(regexp_extract(property_address, '제({number})\\s*{suffix}', 1), '')"
    return f"CASE WHEN document_type = 'CONDOMINIUM' THEN coalesce({own}, {found}) END AS {column}"


RESOLVED = f"""{R.entries_sql(ORDER)}, e4 AS (SELECT *, p % 6 NOT IN (1, 5) AS eul, lag(p % 6 NOT IN (1, 5), 1, false) OVER w AS before, lead(n) OVER w IS NULL AS is_last FROM e3 WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
entries AS (SELECT * EXCLUDE (own, over), CASE WHEN n = 1 THEN {HEAD.format(k='doc_id')} ELSE '' END || CASE WHEN eul AND NOT before AND doc_id % 9 > 0 THEN {EUL_HEAD} ELSE '' END || own AS own,
  over || CASE WHEN is_last THEN {TAIL.format(k='doc_id', last='NOT eul')} ELSE '' END AS over FROM e4), {R.PAGES_AND_ASKS}, {R.WHOLE},
parts AS (SELECT doc_id, t, string_split(string_split(t, '【갑구】')[2], '【을구】')[1] AS gap_text, string_split(t, '【을구】')[2] AS eul_text FROM whole),
sect AS (SELECT doc_id, {R._CANON.format(x='gap_text')} AS gc, {R._CANON.format(x='eul_text')} AS ec FROM parts), {R.LOCATED},
named AS (SELECT *, CASE WHEN contains(purpose, '말소') THEN 'CANCELLATION' WHEN purpose = '근저당권변경' THEN 'MORTGAGE_AMEND' WHEN purpose = '근저당권설정' THEN 'MORTGAGE' WHEN purpose = '가압류' THEN 'PROVISIONAL_SEIZURE'
  WHEN purpose = '전세권설정' THEN 'JEONSE_RIGHT' ELSE 'PROVISIONAL_DISPOSITION' END AS kind FROM tied WHERE ties = 1),
rights_raw AS (SELECT doc_id, seq, section, trim(rank_no) AS rank_no, kind, target_found[1] AS target, amount, CASE WHEN contains(canon, hc) THEN holder END AS holder, CASE WHEN bc <> '' AND contains(canon, bc) THEN debtor END AS debtor, NULL AS joint_collateral_id
  FROM named WHERE rank_found OR (kind IN ('CANCELLATION', 'MORTGAGE_AMEND') AND len(target_found) > 0)),
{R.STATUS}, {R.AMENDED}, {R.TOTALS}, {R.FLAGGED},
vals AS ({' UNION ALL '.join(f"SELECT doc_id, '{c}' AS value_id, {sql.format(k='doc_id')} AS value FROM whole" for c, sql in HEADERS.items())}),
keyed AS (SELECT *, {R._CANON.format(x='value')} AS vc, CASE WHEN regexp_full_match(value, '[0-9\\s,./:()\\-]+') AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 2 THEN regexp_replace(value, '[^0-9]', '', 'g') END AS vn FROM vals WHERE value IS NOT NULL),
forms AS (SELECT doc_id, canon, {R._NOSEP.format(x='text')} AS nosep FROM pf),
kept AS (SELECT DISTINCT k.doc_id, value_id, trim(value) AS value FROM keyed k JOIN forms f ON f.doc_id = k.doc_id AND (contains(canon, vc) OR coalesce(contains(nosep, vn), false))),
wide AS (SELECT doc_id, {', '.join(f"max(value) FILTER (value_id = '{c}') AS v_{c}" for c in HEADERS)} FROM kept GROUP BY 1),
headed AS (SELECT p.*, w.* EXCLUDE (doc_id), CASE doc_id % 3 WHEN 0 THEN 'CONDOMINIUM' WHEN 1 THEN 'LAND' ELSE 'BUILDING' END AS document_type, coalesce(v_property_address, {ADDRESS.format(k='doc_id')}) AS property_address,
  coalesce(v_issue_date, CASE WHEN doc_id % 5 > 1 THEN '2026-08-' || {DAY.format(k='doc_id')} END) AS issue_date, doc_id % 10 = 0 AS has_joint_collateral_mention FROM parts p LEFT JOIN wide w USING (doc_id)),
owned AS (SELECT doc_id, doc_id % 13 > 0 AS asked_owners, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE CAST(doc_id % 7 > 0 OR doc_id % 11 = 0 AS INT) + CAST(doc_id % 5 > 0 AS INT) END AS owner_count, doc_id % 11 > 0 AS addressed FROM whole),
asks_n AS (SELECT doc_id, count(*) AS extracted_right_count FROM asked GROUP BY 1),
st AS (SELECT *, CASE WHEN coalesce(g, 0) > 0 OR NOT regexp_matches(regexp_replace(gap_text, '\\s', '', 'g'), '압류|가처분|경매개시결정|신탁|가등기') THEN 'EXTRACTED' ELSE 'PARSE_FAILED' END AS gap_section_status,
  CASE WHEN coalesce(e, 0) > 0 THEN 'EXTRACTED' WHEN regexp_matches(eul_text, '기록\\s*사항\\s*없음') THEN 'CONFIRMED_NONE' ELSE 'PARSE_FAILED' END AS eul_section_status FROM parts LEFT JOIN agg USING (doc_id) LEFT JOIN totals USING (doc_id)), {R.SUMMARISED},
units AS (SELECT *, {_unit('dong_name', 'v_dong_name', '동', '[0-9]+')}, CASE WHEN document_type = 'CONDOMINIUM' THEN CAST(regexp_extract(coalesce(v_floor, regexp_extract(property_address, '제([0-9]+)층', 1)), '[0-9]+', 0) AS BIGINT) END AS floor_no,
  {_unit('ho_name', 'v_ho_name', '호', '[0-9]+')}, CASE WHEN document_type = 'CONDOMINIUM' THEN CAST(v_exclusive_area_sqm AS DOUBLE) END AS exclusive_area FROM headed),
rated AS (SELECT *, owner_count = 2 AND asked_owners AND addressed AND (document_type <> 'CONDOMINIUM' OR exclusive_area IS NOT NULL) AS core,
  (coalesce(active_mortgage_count, 0) <> 0 AND total_active_max_claim_amount IS NULL) OR verified_right_count <> extracted_right_count AS review FROM units JOIN owned USING (doc_id) JOIN asks_n USING (doc_id) JOIN summary USING (doc_id)),
graded AS (SELECT *, CASE WHEN NOT core AND gap_section_status = 'PARSE_FAILED' AND eul_section_status = 'PARSE_FAILED' THEN 1 WHEN NOT core OR gap_section_status = 'PARSE_FAILED' OR eul_section_status = 'PARSE_FAILED' THEN 2 WHEN review THEN 3 ELSE 4 END AS step FROM rated),
resolved AS (SELECT *, ['FAILED', 'PARTIAL', 'NEEDS_REVIEW', 'SUCCESS'][step] AS parse_status, ['UNKNOWN', 'LOW', 'MEDIUM', 'HIGH'][step] AS parse_confidence FROM graded)"""


def _expr(sql: str, **names: str):
    return F.expr(sql.format(k="doc_id", **names))


def document_pages(entries: DataFrame) -> DataFrame:
    """Pages with the header on the first, the headings before their sections and the notes on the last."""
    w = Window.partitionBy("doc_id").orderBy("n")
    eul = ~(F.col("p") % 6).isin(1, 5)
    starts = eul & ~F.lag(eul, 1, False).over(w) & (F.col("doc_id") % 9 > 0)
    e = entries.withColumns({"_eul": eul, "_starts": starts, "_last": F.lead("n").over(w).isNull()})
    own = F.concat(F.when(F.col("n") == 1, _expr(HEAD)).otherwise(""), F.when(F.col("_starts"), F.expr(EUL_HEAD)).otherwise(""), "own")
    over = F.concat("over", F.when(F.col("_last"), _expr(TAIL, last="NOT _eul")).otherwise(""))
    return R.register_pages(e.withColumns({"own": own, "over": over}))


def header_asks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *[_expr(sql).alias(c) for c, sql in HEADERS.items()])


def owner_asks(docs: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(i).alias("owner_seq"), _expr(name).alias("name"), _expr(front).alias("jumin_front"), _expr(address).alias("address"), F.lit("1/2").alias("share"))
            for i, (name, front, address) in enumerate(OWNERS, 1)]
    return docs.where("doc_id % 13 > 0").select("doc_id", F.inline(F.array(*rows)))


@query("resolved_documents", "P30 P32 P33 J17 J18", f"WITH {RESOLVED} SELECT {', '.join(COLUMNS)} FROM resolved")
def resolved_documents(spark, d) -> DataFrame:
    """Pages, headers, owners and rights of every document to its resolved row."""
    entries = cut_lineage(R.register_entries(spark, d, ORDER))
    pages = cut_lineage(document_pages(entries))
    docs = entries.select("doc_id").distinct()
    gap, eul = T.section_texts(F.col("full_text"))
    sections = evidence.join_pages(pages).select("doc_id", gap.alias("gap_text"), eul.alias("eul_text"))
    rights = R.register_asks(entries)
    checked = cut_lineage(resolve.resolved_rights(rights, pages, sections))
    out = resolve.resolve_documents(pages, header_asks(docs), owner_asks(docs), rights, checked, F.lit(AS_OF).cast("date"))
    return out.select(*COLUMNS)
