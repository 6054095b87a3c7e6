"""From page texts and extracted values to a resolved register document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators import evidence, rights as R

HEADER_VALUES = ("property_address", "issue_date", "dong_name", "floor", "ho_name", "exclusive_area_sqm")


def verified_headers(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """Header values of each document; a value no page supports becomes null."""
    long = headers.select("doc_id", *[F.col(c).cast("string").alias(c) for c in HEADER_VALUES]).unpivot(
        "doc_id", list(HEADER_VALUES), "value_id", "value").withColumn("is_number", F.lit(False))
    found = evidence.locate_values(long.where(F.col("value").isNotNull()), pages)
    kept = F.when(F.col("page_no").isNotNull(), T.strip(F.col("value")))
    wide = found.groupBy("doc_id").pivot("value_id", list(HEADER_VALUES)).agg(F.max(kept))
    return headers.select("doc_id").join(wide, "doc_id", "left")


def resolved_rights(rights: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Extracted rights that the pages support, with kind and status."""
    return R.with_status(R.accepted_rights(evidence.locate_rights(rights, pages, sections)))


def resolve_documents(pages: DataFrame, headers: DataFrame, owners: DataFrame, rights: DataFrame,
                      checked_rights: DataFrame, as_of: Column) -> DataFrame:
    """One row per document: address, unit, owners' count, section status, flags,
    totals, parse status and confidence.

    ``headers``: doc_id and HEADER_VALUES; ``owners``: current owners as for
    locate_owners; ``rights``: extracted rights; ``checked_rights``: the stored
    result of resolved_rights, which several steps read.
    """
    full = evidence.join_pages(pages)
    gap, eul = T.section_texts(F.col("full_text"))
    docs = full.withColumns({"gap_text": gap, "eul_text": eul, "document_type": R.document_type(F.col("full_text"))})
    h = verified_headers(headers, pages)
    d = docs.join(h, "doc_id", "left")
    address = F.coalesce(F.col("property_address"), R.header_address(F.col("full_text")))
    issued = T.loose_date(F.coalesce(F.col("issue_date"), R.header_issue_date(F.col("full_text"))))
    d = d.withColumns({"property_address": address, "issue_date": issued,
                       "has_joint_collateral_mention": F.contains(F.col("full_text"), F.lit("공동담보"))})
    d = d.withColumns(R.unit_columns(
        F.col("document_type"), F.col("property_address"), F.col("dong_name"), F.col("floor"), F.col("ho_name"),
        F.col("exclusive_area_sqm"))).drop("floor", "exclusive_area_sqm")
    asked = owners.groupBy("doc_id").agg(F.count("*").alias("_owners"))
    real = evidence.verified_owners(owners, pages, as_of).groupBy("doc_id").agg(
        F.count("*").alias("owner_count"), F.min(F.col("address") != "").alias("_addressed"))
    extracted = rights.groupBy("doc_id").agg(F.count("*").alias("extracted_right_count"))
    d = d.join(asked, "doc_id", "left").join(real, "doc_id", "left").join(extracted, "doc_id", "left")
    d = R.rights_summary(d, checked_rights).withColumns({
        "owner_count": F.coalesce("owner_count", F.lit(0)),
        "extracted_right_count": F.coalesce("extracted_right_count", F.lit(0))})
    core = (
        F.col("property_address").isNotNull() & (F.col("owner_count") > 0) & (F.col("owner_count") == F.col("_owners"))
        & F.col("_addressed") & ((F.col("document_type") != "CONDOMINIUM") | F.col("exclusive_area").isNotNull()))
    return d.withColumns(R.parse_status(
        core, F.col("gap_section_status"), F.col("eul_section_status"), F.col("active_mortgage_count"),
        F.col("total_active_max_claim_amount"), F.col("verified_right_count"), F.col("extracted_right_count"),
    )).drop("_owners", "_addressed", "full_text", "gap_text", "eul_text")
