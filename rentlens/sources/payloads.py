"""Payload text (JSON, XML, HTML) to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T

RENT_ITEM = ("deposit string, monthlyRent string, excluUseAr string, dealYear string, dealMonth string, dealDay string, "
             "umdNm string, aptNm string, cdealDay string")
WATCHLIST_CELLS = ("name", "age", "address", "return_debt_amount", "default_start_date", "default_days",
                   "subrogation_date", "subrogation_amount", "enforcement_count", "posted_date")


def object_or_list(payload: Column, path: str, item: str) -> Column:
    """Array of items at a JSON path that holds either a list or a single object."""
    raw = F.get_json_object(payload, path)
    lone = F.from_json(raw, item)
    many = F.from_json(raw, f"array<{item}>")
    empty = F.array().cast(f"array<{item}>")
    return (
        F.when(raw.isNull() | (T.strip(raw) == ""), empty)
        .when(F.ltrim(raw).startswith("["), F.coalesce(many, empty))
        .otherwise(F.array(lone))
    )


def ledger_rows(payloads: DataFrame, keys: Sequence[str], payload: str, item: str, ok: str = "00") -> DataFrame:
    """Item rows of building-ledger answers. An answer with another result code gives
    one row that carries only the code, as does one without a readable code or whose
    list cannot be read (UNREADABLE)."""
    p = F.col(payload)
    code = F.coalesce(F.get_json_object(p, "$.response.header.resultCode"), F.lit("UNREADABLE"))
    raw = F.get_json_object(p, "$.response.body.items.item")
    broken = F.ltrim(raw).startswith("[") & F.from_json(raw, f"array<{item}>").isNull()
    code = F.when((code == ok) & F.coalesce(broken, F.lit(False)), "UNREADABLE").otherwise(code)
    items = F.when(code == ok, object_or_list(p, "$.response.body.items.item", item)).otherwise(
        F.array().cast(f"array<{item}>"))
    return payloads.select(*keys, code.alias("result_code"), F.posexplode_outer(items).alias("position", "item")).select(
        *keys, "result_code", "position", "item.*").where((F.col("result_code") != ok) | F.col("position").isNotNull())


def address_rows(payloads: DataFrame, keys: Sequence[str], payload: str, item: str) -> DataFrame:
    """Address rows with the total count and error code of their answer."""
    p = F.col(payload)
    return payloads.select(
        *keys, F.get_json_object(p, "$.results.common.errorCode").alias("error_code"),
        F.get_json_object(p, "$.results.common.totalCount").try_cast("long").alias("total_count"),
        F.posexplode_outer(object_or_list(p, "$.results.juso", item)).alias("position", "item"),
    ).select(*keys, "error_code", "total_count", "position", "item.*")


def rent_transactions(items: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lease-only, not cancelled transactions with the deposit in won.

    ``items`` carries the text columns of RENT_ITEM.
    """
    rent = T.clean_integer(F.col("monthlyRent"))
    live = T.blank_to_null(F.col("cdealDay")).isNull()
    return items.where((rent == 0) & live).select(
        *keys, (T.clean_integer(F.col("deposit")) * 10_000).alias("deposit"),
        T.strip(F.col("excluUseAr")).try_cast("double").alias("area"),
        T.date_from_parts(*[T.strip(F.col(c)) for c in ("dealYear", "dealMonth", "dealDay")]).alias("contract_date"),
        T.blank_to_null(F.col("umdNm")).alias("legal_dong"), T.blank_to_null(F.col("aptNm")).alias("building_name"))


def xml_items(payloads: DataFrame, keys: Sequence[str], payload: str, item: str = RENT_ITEM) -> DataFrame:
    """Rows of <item> elements of XML answers held as text."""
    schema = f"body struct<items:struct<item:array<struct<{item.replace(' string', ':string')}>>>>"
    doc = F.from_xml(F.col(payload), schema)
    return payloads.select(*keys, F.explode(doc["body"]["items"]["item"]).alias("item")).select(*keys, "item.*")


def read_xml_items(spark, path: str, item: str = RENT_ITEM) -> DataFrame:
    """Rows of <item> elements of XML files."""
    return spark.read.format("xml").option("rowTag", "item").schema(item).load(path)


def plain_text(html: Column) -> Column:
    """Text of an HTML fragment: tags out, the common entities decoded, ends stripped."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return T.strip(out)


def table_rows(pages: DataFrame, keys: Sequence[str], html: str, names: Sequence[str] = WATCHLIST_CELLS,
               row_tag: str = "tr", cell_tag: str = "td", cells: int | None = None) -> DataFrame:
    """Rows of an HTML page that hold exactly the expected number of cells."""
    width = cells or len(names)
    block = lambda tag: F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>")
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.col(html), block(row_tag), 1)).alias("row_no", "_row"))
    split = rows.withColumn("_cells", F.regexp_extract_all(F.col("_row"), block(cell_tag), 1)).where(F.size("_cells") == width)
    return split.select(*keys, "row_no", *[
        plain_text(F.element_at("_cells", i + 1)).alias(n) for i, n in enumerate(names)])


def page_total(html: Column) -> Column:
    """Page total of an 'n / m' label in the page text; 1 without one."""
    found = F.regexp_extract(F.regexp_replace(html, r"(?s)<[^>]*>", ""), r"([0-9]+)\s*/\s*([0-9]+)", 2)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("int"), F.lit(1))
