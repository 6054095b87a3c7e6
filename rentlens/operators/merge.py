"""Merging the registers of one property (land and building)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.session import cut_lineage, spread

# Order of documents, statuses and confidences.
DOCUMENT_PRIORITY = {"CONDOMINIUM": 3, "BUILDING": 2, "LAND": 1}
STATUS_RANK = {"SUCCESS": 0, "NEEDS_REVIEW": 1, "PARTIAL": 2, "FAILED": 3}
CONFIDENCE_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "UNKNOWN": 3}


def _rank(c: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in table.items() for x in p])[c], F.lit(0))


def merge_check(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """Can the documents of each merge_id be merged? (null code when they can).

    ``docs``: merge_id, doc_id, document_index, document_type, property_address;
    ``owners``: doc_id, name, jumin_front, share. Owner sets are compared by
    counting: every distinct owner of the merge must occur in every document.
    """
    d = docs.groupBy("merge_id").agg(
        F.count("*").alias("documents"),
        F.count_distinct(T.canonical(F.col("property_address"))).alias("_addresses"),
        F.max(T.canonical(F.col("property_address")) == "").alias("_blank"),
        F.max(F.col("document_type") == "LAND").alias("_land"), F.max(F.col("document_type") == "BUILDING").alias("_building"),
        F.max(~F.coalesce(F.col("document_type").isin("LAND", "BUILDING"), F.lit(False))).alias("_other"),
        F.max_by("doc_id", F.struct(_rank(F.col("document_type"), DOCUMENT_PRIORITY), -F.col("document_index"))).alias("primary_doc"))
    who = F.concat_ws("|", T.canonical(F.col("name")), T.digits(F.col("jumin_front")), T.canonical(F.col("share")))
    per_owner = docs.select("merge_id", "doc_id").join(owners, "doc_id").select(
        "merge_id", who.alias("_who"), "doc_id").distinct().groupBy("merge_id", "_who").agg(F.count("*").alias("_in"))
    o = per_owner.groupBy("merge_id").agg(F.min("_in").alias("_least"))
    single = F.col("documents") == 1
    code = (
        F.when(single, F.lit(None).cast("string"))
        .when(F.col("_blank") | (F.col("_addresses") != 1), "REGISTRY_PROPERTY_MISMATCH")
        .when(~(F.col("_land") & F.col("_building")) | F.col("_other"), "REGISTRY_DOCUMENT_SET_INVALID")
        .when(F.coalesce(F.col("_least") != F.col("documents"), F.lit(True)), "REGISTRY_OWNER_MISMATCH")
    )
    return d.join(o, "merge_id", "left").select("merge_id", "documents", "primary_doc", code.alias("reject_code"))


def _signature(kind: str, needed: Sequence[Column], parts: Sequence[Column]) -> Column:
    ok = reduce(lambda a, b: a & b, [F.coalesce(n, F.lit(False)) for n in needed])
    text = F.concat_ws("\u0001", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts])
    return F.when(ok, text)


CLAIM_KEYS = ("claim_id", "merge_id", "document_index", "seq")


def claim_signatures(claims: DataFrame, links: DataFrame) -> DataFrame:
    """(claim_id, merge_id, document_index, seq, signature) rows of mortgage claims; a row may come twice.

    ``claims``: claim_id, merge_id, document_index, seq, doc_id, rank_no, receipt_no, registered_at,
    creditor, debtor, amount, status, joint (both documents mention joint
    collateral); ``links``: doc_id, rank_no, registered_at, receipt_no, amount of
    the amendments of a rank.
    """
    c = lambda n: F.col(n)
    receipt, creditor, debtor = T.canonical(c("receipt_no")), T.party_key(c("creditor")), T.party_key(c("debtor"))
    known = c("amount").isNotNull()
    own = F.array(
        _signature("RECEIPT", [known, receipt != "", c("registered_at") != ""], [c("registered_at"), receipt, c("amount"), c("status")]),
        _signature("PARTIES", [c("joint"), known, creditor != "", debtor != ""], [creditor, debtor, c("amount"), c("status")]),
    )
    base = claims.select(*CLAIM_KEYS, F.explode(own).alias("signature"))
    l = links.select("doc_id", "rank_no", F.col("registered_at").alias("_at"), F.col("receipt_no").alias("_no"), F.col("amount").alias("_sum"))
    linked_amount = F.coalesce(c("_sum"), c("amount"))
    amended = claims.where("joint").join(l, ["doc_id", "rank_no"]).select(
        *CLAIM_KEYS,
        _signature("AMENDMENT", [c("_at") != "", c("_no") != "", linked_amount.isNotNull()],
                   [c("_at"), c("_no"), linked_amount, c("status")]).alias("signature"))
    return base.unionByName(amended).where(c("signature").isNotNull())


def deposit_signatures(rights: DataFrame) -> DataFrame:
    """The same rows for deposit rights (holder, amount, receipt)."""
    c = lambda n: F.col(n)
    receipt, holder, known = T.canonical(c("receipt_no")), T.party_key(c("holder")), c("amount").isNotNull()
    own = F.array(
        _signature("RECEIPT", [known, receipt != "", c("registered_at") != ""], [c("registered_at"), receipt, c("amount"), c("status")]),
        _signature("PARTY", [known, c("registered_at") != "", holder != ""], [c("registered_at"), holder, c("amount"), c("status")]))
    return rights.select(*CLAIM_KEYS, F.explode(own).alias("signature")).where(c("signature").isNotNull())


#: Signature rows of a merge that one task walks in order; larger merges are settled in rounds.
WALK_ROWS = 200_000


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Claims dropped, from signature rows sorted by merge and position. What is kept in memory is one merge's
    signatures so far and one claim's."""
    merge = claim = None
    index, mine, seen, gone = 0, set(), set(), []

    def settle() -> None:
        if index > 0 and mine & seen:
            gone.append(claim)
        else:
            seen.update(mine)

    for b in batches:
        kind = b.schema.field("claim_id").type
        for row in zip(*[b.column(c).to_pylist() for c in ("merge_id", "claim_id", "document_index", "signature")]):
            if row[:2] != (merge, claim):
                settle()
                if row[0] != merge:
                    seen.clear()
                merge, claim, index = row[:3]
                mine.clear()
            mine.add(row[3])
        yield pa.RecordBatch.from_arrays([pa.array(gone, kind)], names=["claim_id"])
        gone.clear()
    settle()
    if gone:
        yield pa.RecordBatch.from_arrays([pa.array(gone, kind)], names=["claim_id"])


def _settle_in_rounds(keyed: DataFrame) -> DataFrame:
    """Claims dropped from merges of any size: in each round a claim with no earlier open claim on any of its
    signatures is kept and the claims sharing with it are dropped; as many rounds as the longest chain."""
    keyed = keyed.distinct().withColumn("pos", F.struct("document_index", "seq", "claim_id"))
    first = keyed.where(F.col("document_index") == 0).select("merge_id", "signature").distinct()
    later = keyed.where(F.col("document_index") > 0)
    hit_first = later.join(first, ["merge_id", "signature"], "left_semi").select("claim_id").distinct()
    dropped = hit_first
    open_rows = later.join(hit_first, "claim_id", "left_anti")
    # Only signatures that two or more open claims share can still decide anything.
    shared = open_rows.groupBy("merge_id", "signature").agg(F.count("*").alias("_n")).where("_n > 1").select("merge_id", "signature")
    open_rows = cut_lineage(open_rows.join(shared, ["merge_id", "signature"], "left_semi"))
    # Every round settles at least the first open claim of each group.
    while not open_rows.isEmpty():
        heads = open_rows.groupBy("merge_id", "signature").agg(F.min("pos").alias("head"))
        won = open_rows.join(heads, ["merge_id", "signature"]).groupBy("claim_id").agg(
            F.min(F.col("pos") == F.col("head")).alias("won"))
        marked = open_rows.join(won, "claim_id")
        taken = marked.where("won").select("merge_id", "signature", F.lit(True).alias("taken")).distinct()
        hit = marked.join(taken, ["merge_id", "signature"], "left").groupBy("claim_id").agg(
            F.max(F.coalesce("taken", F.lit(False))).alias("hit"))
        # One table per round holds the rows with their claim's state.
        settled = cut_lineage(marked.join(hit, "claim_id"))
        dropped = dropped.unionByName(settled.where(~F.col("won") & F.col("hit")).select("claim_id").distinct())
        open_rows = settled.where(~F.col("won") & ~F.col("hit")).drop("won", "hit")
    return dropped


def greedy_dedupe(claims: DataFrame, signatures: DataFrame, accepted: DataFrame | None = None, walk_rows: int = WALK_ROWS,
                  alone: Column | None = None) -> DataFrame:
    """Claims left after dropping, in order, every claim of a later document that
    shares a signature with a claim kept before it.

    ``claims``: claim_id, merge_id, document_index, seq; ``signatures``: the same with a
    signature per row; ``accepted``: the result of ``merge_check`` - claims of merges that it rejects are not merged
    and leave. The first document is kept whole. A dropped claim does not protect or drop others. ``alone``: marks
    claims of merges with the first document only; they stay without being compared, and need no signatures.

    A merge is the registers of one property, so its claims sit in one bounded group: they are shuffled once, sorted,
    and walked in order with the signatures seen so far as state, whatever the length of a chain. Merges of more than
    ``walk_rows`` signature rows are settled in rounds over all of them at once.
    """
    if accepted is not None:
        ok = accepted.where(F.col("reject_code").isNull()).select("merge_id")
        claims, signatures = (df.join(ok, "merge_id", "left_semi") for df in (claims, signatures))
    keyed = cut_lineage(signatures.select("merge_id", "signature", "claim_id", "document_index", "seq"))
    large = cut_lineage(keyed.groupBy("merge_id").agg(F.count("*").alias("_n")).where(F.col("_n") > walk_rows).select("merge_id"))
    oversized = not large.isEmpty()
    rows = keyed.join(large, "merge_id", "left_anti") if oversized else keyed
    kind = keyed.schema["claim_id"].dataType.simpleString()
    rows = spread(rows.select("merge_id", "claim_id", "document_index", "seq", "signature").repartition("merge_id"), keyed.count(), "merge_id")
    dropped = rows.sortWithinPartitions("merge_id", "document_index", "seq", "claim_id").mapInArrow(_walk, f"claim_id {kind}")
    if oversized:
        dropped = dropped.unionByName(_settle_in_rounds(keyed.join(large, "merge_id", "left_semi")))
    if alone is None:
        return claims.join(dropped, "claim_id", "left_anti")
    alone = F.coalesce(alone, F.lit(False))
    return claims.where(~alone).join(dropped, "claim_id", "left_anti").unionByName(claims.where(alone))


def merged_totals(kept: DataFrame) -> DataFrame:
    """Active count and total claim of merged claims; one unknown amount makes the
    total unknown. Joint collateral inside a document is not reapplied here."""
    active = F.col("status") == "ACTIVE"
    n, known = F.count_if(active), F.count_if(active & F.col("amount").isNotNull())
    total = F.coalesce(F.sum(F.when(active, F.col("amount"))), F.lit(0))
    return kept.groupBy("merge_id").agg(
        n.alias("active_mortgage_count"), F.when(n == known, total).alias("total_active_max_claim_amount"))


def merged_flag(values: Column) -> Column:
    """Aggregate: TRUE if any is, else UNKNOWN if any is, else FALSE."""
    return F.when(F.max(values == "TRUE"), "TRUE").when(F.max(values == "UNKNOWN"), "UNKNOWN").otherwise("FALSE")


def merged_section(values: Column, eul: bool = False) -> Column:
    """Aggregate: a failed part fails the whole; confirmed none only if all are."""
    out = F.when(F.max(values == "PARSE_FAILED"), "PARSE_FAILED")
    if eul:
        out = out.when(F.min(values == "CONFIRMED_NONE"), "CONFIRMED_NONE")
    return out.otherwise("EXTRACTED")


def merge_rollup(docs: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Per merge_id: flags, section status, earliest issue date, worst status and
    confidence, count sums."""
    return docs.groupBy("merge_id").agg(
        *[merged_flag(F.col(f)).alias(f) for f in flags],
        merged_section(F.col("gap_section_status")).alias("gap_section_status"),
        merged_section(F.col("eul_section_status"), True).alias("eul_section_status"),
        F.min(F.nullif(F.col("issue_date"), F.lit(""))).alias("issue_date"),
        F.max("has_cancellation_mention").alias("has_cancellation_mention"),
        F.max_by("parse_status", _rank(F.col("parse_status"), STATUS_RANK)).alias("parse_status"),
        F.max_by("parse_confidence", _rank(F.col("parse_confidence"), CONFIDENCE_RANK)).alias("parse_confidence"),
        F.sum("extracted_right_count").alias("extracted_right_count"),
        F.sum("verified_right_count").alias("verified_right_count"))


def settled_status(rollup: DataFrame, totals: DataFrame) -> DataFrame:
    """A merge whose total is unknown is no success."""
    df = rollup.join(totals, "merge_id", "left")
    none = F.col("active_mortgage_count").isNull()
    total = F.when(none, F.lit(0)).otherwise(F.col("total_active_max_claim_amount"))
    unsure = total.isNull() & (F.col("parse_status") == "SUCCESS")
    return df.withColumns({
        "active_mortgage_count": F.coalesce("active_mortgage_count", F.lit(0)),
        "total_active_max_claim_amount": total,
        "parse_confidence": F.when(unsure, "MEDIUM").otherwise(F.col("parse_confidence")),
        "parse_status": F.when(unsure, "NEEDS_REVIEW").otherwise(F.col("parse_status")),
    })


def tagged_evidence(filename: Column, raw: Column) -> Column:
    return F.concat(F.lit("[FILE "), T.file_tag(filename), F.lit("] "), raw)
