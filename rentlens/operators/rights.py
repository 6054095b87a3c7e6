"""Title-register rights: structure, cancellations, amendments, totals, status."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import score as S
from rentlens.functions import text as T


@dataclass(frozen=True)
class Signal:
    """A structure signal: any of some words, all of some words, or a pattern."""

    name: str
    any_of: Sequence[str] = ()
    all_of: Sequence[str] = ()
    pattern: str | None = None

    def holds(self, compact: Column) -> Column:
        if self.pattern:
            return compact.rlike(self.pattern)
        out = None
        for w in self.any_of or self.all_of:
            c = compact.contains(w)
            out = c if out is None else (out | c if self.any_of else out & c)
        return out


# What a register document must show.
REGISTER_SIGNALS = (
    Signal("registry_title", any_of=("등기사항전부증명서", "등기사항증명서")),
    Signal("property_type", pattern=r"\[(집합건물|건물|토지)\]"),
    Signal("unique_number", pattern=r"고유번호[:：]?[0-9]{4}-[0-9]{4}-[0-9]+"),
    Signal("title_section", any_of=("【표제부】", "[표제부]")),
    Signal("gap_section", any_of=("【갑구】", "[갑구]")),
    Signal("eul_section", any_of=("【을구】", "[을구]")),
    Signal("registry_table_columns", all_of=("순위번호", "등기목적", "접수", "등기원인", "권리자및기타사항")),
)
REVIEW_AT = 5  # fixed value: signals (with the text layer) that still earn a review
# Words of the ownership section that must lead to a right, and the flags of kinds.
GAP_RISK_WORDS = ("압류", "가압류", "가처분", "경매개시결정", "신탁", "가등기")
FLAG_KINDS = {
    "seizure": "SEIZURE",
    "provisional_seizure": "PROVISIONAL_SEIZURE",
    "provisional_disposition": "PROVISIONAL_DISPOSITION",
    "auction_commenced": "AUCTION",
    "trust_registration": "TRUST",
}


def document_structure(docs: DataFrame, text: str = "full_text", signals: Sequence[Signal] = REGISTER_SIGNALS,
                       review_at: int = REVIEW_AT) -> DataFrame:
    """Adds structure_status, signals and missing_signals to documents."""
    compact = F.col("_compact")
    found = S.codes(*[(s.holds(compact), s.name) for s in signals])
    required = F.array(*[F.lit(s.name) for s in signals])
    df = docs.withColumn("_compact", T.compact(F.col(text))).withColumn("_found", found)
    readable = F.col("_compact") != ""
    missing = F.array_except(required, "_found")
    layer = F.array(F.lit("text_layer"))
    none = F.array().cast("array<string>")
    return df.withColumns({
        "signals": F.when(readable, F.concat(layer, F.col("_found"))).otherwise(none),
        "missing_signals": F.when(readable, missing).otherwise(layer),
        "structure_status": F.when(~readable, "UNREADABLE").when(F.size(missing) == 0, "VALID_REGISTRY")
        .when(F.size("_found") + 1 >= review_at, "REVIEW_REQUIRED").otherwise("INVALID_DOCUMENT"),
    }).drop("_compact", "_found")


def document_type(full: Column) -> Column:
    return F.when(full.rlike(r"[\[【]\s*집합건물\s*[\]】]"), "CONDOMINIUM").when(
        full.rlike(r"[\[【]\s*토지\s*[\]】]"), "LAND").otherwise("BUILDING")


def header_address(full: Column) -> Column:
    found = F.regexp_extract(full, r"(?m)^\s*[\[【]\s*(?:집합건물|건물|토지)\s*[\]】]\s*(.+?)\s*$", 1)
    return F.nullif(T.strip(found), F.lit(""))


def header_issue_date(full: Column) -> Column:
    p = r"(?:열람|발급)일시\s*:\s*([0-9]{4})\s*년\s*([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일"
    part = lambda i: F.lpad(F.regexp_extract(full, p, i), 2 if i > 1 else 4, "0")
    return F.when(full.rlike(p), F.concat_ws("-", part(1), part(2), part(3)))


def unit_columns(doc_type: Column, address: Column, dong: Column, floor: Column, ho: Column, area: Column) -> dict[str, Column]:
    """Unit fields of condominiums from verified values, else from the address."""
    own = T.unit_label(dong, "동")
    own = F.when(~T.is_legal_dong(own, address), own)
    condo = doc_type == "CONDOMINIUM"
    return {
        "dong_name": F.when(condo, F.coalesce(own, T.unit_from_address(address, "동"))),
        "floor_no": F.when(condo, F.coalesce(T.first_integer(floor), T.first_integer(T.unit_from_address(address, "층")))),
        "ho_name": F.when(condo, F.coalesce(T.unit_label(ho, "호"), T.unit_from_address(address, "호"))),
        "exclusive_area": F.when(condo, T.first_decimal(area)),
    }


def with_kind(rights: DataFrame) -> DataFrame:
    compacted = rights.withColumn("_compact", T.compact(F.col("purpose")))
    return compacted.withColumn("kind", T.right_kind(F.col("_compact"))).drop("_compact")


def accepted_rights(located: DataFrame) -> DataFrame:
    """Located rights that count: their rank stands in the text, or they act on a
    supported target. Optional values the text does not support become null."""
    df = with_kind(located).withColumns(
        {"_c": T.canonical(F.col("text")), "_n": T.without_separators(F.col("text"))})
    linked = F.col("kind").isin("CANCELLATION", "MORTGAGE_AMEND", "MORTGAGE_TRANSFER")
    df = df.where(F.col("rank_found") | (linked & (F.size("target_found") > 0)))

    def kept(name: str) -> Column:
        c = F.col(name)
        return F.when((c != "") & T.key_supported(T.canonical(c), T.number_key(c), F.col("_c"), F.col("_n")), T.strip(c))

    return df.withColumns({
        "rank_no": T.strip(F.col("rank_no")),
        "receipt_no": kept("receipt_no"), "registered_at": T.loose_date(kept("registered_at")),
        "holder": kept("holder"), "debtor": kept("debtor"), "joint_collateral_id": kept("joint_collateral_id"),
        "target_rank_nos": F.transform("target_found", T.strip),
    }).drop("_c", "_n", "text", "target_found", "target_candidates", "rank_found")


def with_status(rights: DataFrame) -> DataFrame:
    """ACTIVE or CANCELLED: a cancellation in the same section names the rank.

    One pass: a cancellation that is itself cancelled still cancels its target.
    """
    gone = rights.where(F.col("kind") == "CANCELLATION").select(
        "doc_id", "section", F.explode("target_rank_nos").alias("rank_no")).distinct().withColumn("_gone", F.lit(True))
    return rights.join(gone, ["doc_id", "section", "rank_no"], "left").withColumn(
        "status", F.when(F.col("_gone"), "CANCELLED").otherwise("ACTIVE")).drop("_gone")


def amendment_links(rights: DataFrame) -> DataFrame:
    """One row per amendment and mortgage rank it changes."""
    return rights.where(F.col("kind") == "MORTGAGE_AMEND").select(
        "doc_id", F.explode("target_rank_nos").alias("rank_no"), "seq", "amount", "holder", "debtor",
        "registered_at", "receipt_no")


def amended_mortgages(rights: DataFrame) -> DataFrame:
    """Base mortgages after their amendments: the last non-null amount, holder and
    debtor wins, field by field, even if the amendment is cancelled. When two base
    mortgages share a rank, only the last takes the amendments."""
    base = rights.where(F.col("kind") == "MORTGAGE")
    fields = ("amount", "holder", "debtor")
    last = base.select("doc_id", "rank_no", F.col("seq").alias("_base"), *[
        F.lit(None).cast(rights.schema[f].dataType).alias(f) for f in fields], F.lit(None).cast("long").alias("_amend"))
    changes = amendment_links(rights).select(
        "doc_id", "rank_no", F.lit(None).cast("long").alias("_base"), *fields, F.col("seq").cast("long").alias("_amend"))
    newest = last.withColumn("_base", F.col("_base").cast("long")).unionByName(changes).groupBy("doc_id", "rank_no").agg(
        F.max("_base").alias("_last"),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("_amend"))).alias(f"_new_{f}") for f in fields])
    df = base.join(newest, ["doc_id", "rank_no"], "left")
    mine = F.col("seq") == F.col("_last")
    return df.withColumns({
        f: F.coalesce(F.when(mine, F.col(f"_new_{f}")), F.col(f)) for f in fields
    }).drop("_last", *[f"_new_{f}" for f in fields])


def mortgage_totals(mortgages: DataFrame) -> DataFrame:
    """Active mortgage count and total claim per document.

    Entries of one joint collateral with one amount count once; an unknown amount
    makes the total unknown. Two aggregates, no ordering of a document's rights.
    """
    joint = F.nullif(F.col("joint_collateral_id"), F.lit(""))
    active = mortgages.where(F.col("status") == "ACTIVE").select(
        "doc_id", joint.alias("_joint"), "amount", F.when(joint.isNull(), F.col("seq")).alias("_own"))
    once = active.groupBy("doc_id", "_joint", "amount", "_own").agg(F.count("*").alias("_entries"))
    known = F.count("amount") == F.count("*")
    return once.groupBy("doc_id").agg(
        F.count("*").alias("active_mortgage_count"),
        F.when(known, F.coalesce(F.sum("amount"), F.lit(0))).alias("total_active_max_claim_amount"))


def rights_summary(docs: DataFrame, rights: DataFrame, section_names=("갑구", "을구"), empty_note_chars: int | None = None) -> DataFrame:
    """Section status, flags, counts and totals per document.

    ``docs``: doc_id, gap_text, eul_text; ``rights``: accepted rights with status. The note that a section has no
    entries is looked for in the whole section, or in its first ``empty_note_chars`` characters.
    """
    gap_name, eul_name = section_names
    active = F.col("status") == "ACTIVE"
    counts = rights.groupBy("doc_id").agg(
        F.count("*").alias("verified_right_count"),
        F.count_if(F.col("section") == gap_name).alias("_gap"),
        F.count_if(F.col("section") == eul_name).alias("_eul"),
        F.max(F.col("kind") == "CANCELLATION").alias("has_cancellation_mention"),
        *[F.max(active & (F.col("kind") == k)).alias(f"_f_{n}") for n, k in FLAG_KINDS.items()],
        F.max(active & (F.col("kind") == "JEONSE_RIGHT")).alias("_f_has_active_jeonse_right"),
        F.max(active & (F.col("kind") == "LEASEHOLD_REGISTRATION")).alias("_f_has_leasehold_registration"))
    totals = mortgage_totals(amended_mortgages(rights))
    df = docs.join(counts, "doc_id", "left").join(totals, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    gap_compact = T.compact(F.col("gap_text"))
    marker = None
    for w in GAP_RISK_WORDS:
        marker = gap_compact.contains(w) if marker is None else marker | gap_compact.contains(w)
    gap = F.when(F.col("gap_text").isNotNull() & ((zero("_gap") > 0) | ~marker), "EXTRACTED").otherwise("PARSE_FAILED")
    eul_text = F.col("eul_text") if empty_note_chars is None else F.substring("eul_text", 1, empty_note_chars)
    nothing = eul_text.rlike(r"기록\s*사항\s*없음")
    eul = F.when(zero("_eul") > 0, "EXTRACTED").when(nothing, "CONFIRMED_NONE").otherwise("PARSE_FAILED")
    df = df.withColumns({"gap_section_status": gap, "eul_section_status": eul})
    flag = lambda name, status: F.when(F.col(status) == "PARSE_FAILED", "UNKNOWN").when(
        F.coalesce(F.col(f"_f_{name}"), F.lit(False)), "TRUE").otherwise("FALSE")
    read = F.col("eul_section_status") != "PARSE_FAILED"
    cols = {n: flag(n, "gap_section_status") for n in FLAG_KINDS}
    cols |= {n: flag(n, "eul_section_status") for n in ("has_active_jeonse_right", "has_leasehold_registration")}
    no_mortgage = F.col("active_mortgage_count").isNull()
    cols |= {
        "total_active_max_claim_amount": F.when(
            read, F.when(no_mortgage, F.lit(0)).otherwise(F.col("total_active_max_claim_amount"))),
        "verified_right_count": zero("verified_right_count"),
        "has_cancellation_mention": F.coalesce("has_cancellation_mention", F.lit(False)),
    }
    df = df.withColumns(cols).withColumn(
        "active_mortgage_count", F.when(read, zero("active_mortgage_count")))
    return df.drop("_gap", "_eul", *[c for c in df.columns if c.startswith("_f_")])


def parse_status(core_verified: Column, gap: Column, eul: Column, mortgages: Column, total: Column,
                 verified: Column, extracted: Column) -> dict[str, Column]:
    """Parse status and confidence ladder."""
    core = F.coalesce(core_verified, F.lit(False))
    sections = (gap == "EXTRACTED") & eul.isin("EXTRACTED", "CONFIRMED_NONE")
    failed = ~core & (gap == "PARSE_FAILED") & (eul == "PARSE_FAILED")
    open_claim = (F.coalesce(mortgages, F.lit(0)) != 0) & total.isNull()
    review = open_claim | (verified != extracted)
    pick = lambda a, b, c, d: F.when(failed, a).when(~core | ~sections, b).when(review, c).otherwise(d)
    return {
        "parse_status": pick("FAILED", "PARTIAL", "NEEDS_REVIEW", "SUCCESS"),
        "parse_confidence": pick("UNKNOWN", "LOW", "MEDIUM", "HIGH"),
    }
