"""Where in the page texts an extracted value, right or owner is found.

Pages come as (doc_id, page_no, text) with page numbers from 1 without gaps. The
page numbers kept per right grow with the pages of one document. Page forms are computed once per page; (value, page) pairs are tested inside the
join, so only hits leave it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T
from rentlens.operators.evidence_index import find_owners, find_terms
from rentlens.session import cut_lineage

OWNER_WINDOW = 700       # fixed value: characters around a name searched for the id


def page_forms(pages: DataFrame) -> DataFrame:
    return pages.withColumns({"canon": T.canonical(F.col("text")), "nosep": T.without_separators(F.col("text"))})


def join_pages(pages: DataFrame) -> DataFrame:
    """One full text per document, pages in order."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("full_text"))


def locate_values(values: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_no, the first page that supports each value (null when none does).

    ``values`` carries doc_id, value_id, value and is_number.
    """
    keyed = values.withColumns({
        "_canon": T.canonical(F.col("value")),
        "_number": F.when(F.col("is_number"), T.number_key(F.col("value"), True)).otherwise(T.number_key(F.col("value"))),
    })
    v, p = keyed.select("doc_id", "value_id", "_canon", "_number").alias("v"), page_forms(pages).alias("p")
    hit = T.key_supported(F.col("v._canon"), F.col("v._number"), F.col("p.canon"), F.col("p.nosep"))
    found = v.join(p, (F.col("v.doc_id") == F.col("p.doc_id")) & hit).groupBy("v.doc_id", "value_id").agg(
        F.min("page_no").alias("page_no"))
    return values.join(found, ["doc_id", "value_id"], "left")


def target_supported(target: Column, purpose_canon: Column, text: Column, purpose_found: Column) -> Column:
    """Is a target rank named by the purpose, or by the text that holds the purpose?"""
    key = T.canonical(target)
    pattern = F.concat(F.lit(r"(?<![0-9])\Q"), target, F.lit(r"\E\s*번"))
    return (key != "") & (F.contains(purpose_canon, F.concat(key, F.lit("번"))) | (purpose_found & F.rlike(text, pattern)))


def with_targets(rights: DataFrame) -> DataFrame:
    """Given target ranks, then those named in the purpose, distinct, in order."""
    given = F.coalesce(F.col("target_rank_nos"), F.array().cast("array<string>"))
    return rights.withColumn("target_candidates", F.array_distinct(F.concat(given, T.target_ranks(F.col("purpose")))))


#: Page numbers under which a document's sections are asked as pages; they have no neighbours.
SECTION_PAGES = (-1, -3)


def right_terms(markers=T.PURPOSE_MARKERS) -> Column:
    """What is looked for on behalf of a right: an array of ``role, idx, form, needle``.

    Roles: P the purpose, M a marker word or leading rank that the purpose names, A a target rank before the purpose,
    Q the receipt, V a value (idx 0 to 4, the amount last), T a target rank, R the rank.
    """
    canon = F.col("_canon")
    term = lambda role, idx, form, needle: F.struct(F.lit(role).alias("role"), F.lit(idx).alias("idx") if isinstance(idx, int) else idx.cast("int").alias("idx"),
                                                    F.lit(form).alias("form"), needle.alias("needle"))
    fixed = [term("P", 0, "C", canon), term("P", 0, "N", T.number_key(F.col("purpose")))]
    fixed += [term("M", i, "C", F.when(canon.contains(m), F.lit(m))) for i, m in enumerate(markers)]
    fixed += [term("M", len(markers), "C", F.col("_leading"))]
    for role, idx, name in [("Q", 0, "receipt_no"), ("V", 0, "registered_at"), ("V", 1, "holder"), ("V", 2, "debtor"), ("V", 3, "joint_collateral_id")]:
        fixed += [term(role, idx, "C", T.canonical(F.col(name))), term(role, idx, "N", T.number_key(F.col(name)))]
    fixed += [term("V", 4, "C", F.col("_amount")), term("V", 4, "N", T.number_key(F.col("_amount"), True))]
    fixed += [term("R", 0, "R", F.regexp_replace(T.strip(T.text(F.col("rank_no"))), r"\s*번\s*\z", ""))]
    anchors = F.transform(
        F.filter("target_candidates", lambda t: ~F.startswith(canon, F.concat(T.canonical(t), F.lit("번")))),
        lambda t: term("A", 0, "C", F.concat(T.canonical(t), F.lit("번"), canon)))
    targets = F.transform("target_candidates", lambda t, i: term("T", i, "T", t))
    return F.filter(F.concat(F.array(*fixed), anchors, targets), lambda t: t["needle"].isNotNull() & (t["needle"] != ""))


def _spot(first: Column, n: int) -> Column:
    return F.struct(first.alias("first_page"), F.lit(n).alias("n_pages"))


def _on_pages(found: Column) -> Column:
    """Per right: where its purpose stands as a whole or by its words, its receipt, and its purpose after a target."""
    of = lambda role: F.filter(found, lambda x: x["role"] == role)
    union = lambda rows, side: F.array_distinct(F.flatten(F.transform(rows, lambda x: x[side])))
    groups = F.struct(of("P").alias("P"), of("M").alias("M"), of("Q").alias("Q"), of("A").alias("A"))

    def body(g: Column) -> Column:
        # the pages that hold every required word
        common = lambda side: F.when((F.col("_required") > 0) & (F.size(g["M"]) == F.col("_required")), F.aggregate(
            F.slice(g["M"], 2, 64), F.element_at(g["M"], 1)[side], lambda have, x: F.array_intersect(have, x[side]))).otherwise(
            F.array().cast("array<int>"))
        exact = union(g["P"], "ones")
        return F.struct(exact.alias("exact"), F.array_union(exact, common("ones")).alias("ones"), F.array_union(union(g["P"], "twos"), common("twos")).alias("twos"),
                        union(g["Q"], "ones").alias("receipts"), union(g["A"], "ones").alias("anchored"))

    return T.let(groups, body)


def _spots(v: Column) -> Column:
    """The pages and pairs of pages that may be a right's place. Its purpose's pages are those after a target, else
    those with the whole purpose, else those with its words, else both pages of pairs that hold it together; a receipt
    that the section supports must stand on the same page or the next."""
    real = lambda c: F.filter(c, lambda p: p > 0)
    some = lambda c: F.when(F.size(c) > 0, c)
    receipt = F.array_contains(v["receipts"], F.col("_section"))
    purposes = F.coalesce(some(real(v["anchored"])), some(real(v["exact"])), some(real(v["ones"])),
                          F.array_union(v["twos"], F.transform(v["twos"], lambda p: p + 1)))
    on = lambda pages, p: F.array_contains(pages, p)

    def body(u: Column) -> Column:
        single = F.filter(u["ones"], lambda p: on(u["q"], p) & (~u["receipt"] | on(u["at"], p)))
        double = F.filter(u["twos"], lambda p: F.when(
            u["receipt"], (on(u["at"], p) & on(u["q"], p + 1)) | (on(u["at"], p + 1) & on(u["q"], p))).otherwise(on(u["q"], p) | on(u["q"], p + 1)))
        return F.struct(u["receipt"].alias("receipt"), F.concat(
            F.transform(single, lambda p: _spot(p, 1)), F.transform(double, lambda p: _spot(p, 2))).alias("spots"))

    chosen = F.struct(receipt.alias("receipt"), real(v["receipts"]).alias("at"), purposes.alias("q"), real(v["ones"]).alias("ones"), v["twos"].alias("twos"))
    return F.when(F.array_contains(v["ones"], F.col("_section")), T.let(chosen, body))


def _best_spot() -> Column:
    """The one spot of the highest score, the single page of two equally scored; null without one or if two are left.
    Every step's values are bound once, so the expression does not grow with the steps."""
    named = F.transform("target_candidates", lambda t: F.struct(
        (T.canonical(t) != "").alias("real"), F.contains(F.col("_canon"), F.concat(T.canonical(t), F.lit("번"))).alias("named"), t.alias("t")))

    def scored(v: Column, s: Column) -> Column:
        there = F.filter(v["found"], lambda x: x["role"].isin("V", "T", "R") & F.array_contains(
            F.when(s["n_pages"] == 1, x["ones"]).otherwise(x["twos"]), s["first_page"]))

        def body(u: Column) -> Column:
            held = lambda role: F.array_distinct(F.transform(F.filter(u["there"], lambda x: x["role"] == role), lambda x: x["idx"]))
            targets = F.transform(F.filter(v["named"], lambda t, i: t["real"] & (
                t["named"] | F.exists(u["there"], lambda x: (x["role"] == "T") & (x["idx"] == i)))), lambda t: t["t"])
            return T.let(F.struct(held("V").alias("values"), F.exists(u["there"], lambda x: x["role"] == "R").alias("rank"), targets.alias("targets")), lambda w: F.struct(
                (F.when(v["at"]["receipt"], 10).otherwise(4) + F.when(w["rank"], 2).otherwise(0) + F.size(w["values"]) + F.size(w["targets"])).alias("score"),
                s["first_page"].alias("first_page"), s["n_pages"].alias("n_pages"), w["rank"].alias("rank"), w["targets"].alias("targets"),
                (F.col("amount").isNull() | F.array_contains(w["values"], 4)).alias("ok")))

        return T.let(F.struct(there.alias("there")), body)

    quality = lambda s: s["score"] * 10 - s["n_pages"]

    def choose(spots: Column) -> Column:
        kept = F.filter(spots, lambda s: s["ok"])
        return T.let(F.struct(kept.alias("kept"), F.array_max(F.transform(kept, quality)).alias("top")), lambda k: T.let(
            F.filter(k["kept"], lambda s: quality(s) == k["top"]), lambda best: F.when(F.size(best) == 1, F.try_element_at(best, F.lit(1)))))

    view = F.struct(F.col("_found").alias("found"), named.alias("named"), T.let(_on_pages(F.col("_found")), _spots).alias("at"))
    return T.let(view, lambda v: T.let(F.transform(v["at"]["spots"], lambda s: scored(v, s)), choose))


def locate_rights(rights: DataFrame, pages: DataFrame, sections: DataFrame, section_names=("갑구", "을구"),
                  markers=T.PURPOSE_MARKERS) -> DataFrame:
    """The one best page or page pair of every right; rights without one drop out.

    ``rights``: doc_id, seq (together a key), section, rank_no, purpose, receipt_no, registered_at,
    holder, debtor, amount, target_rank_nos, joint_collateral_id.
    ``sections``: doc_id, gap_text, eul_text. Adds first_page, n_pages, score,
    raw_text, rank_found and target_found (the supported target ranks).

    All that a right asks for is looked for in one walk over its document; page numbers come back, a few lists a right,
    and the choice is made in one row. Texts are joined to the chosen pages only.
    """
    leading = F.regexp_extract(F.col("_canon"), "^([0-9]+)번", 1)
    r = with_targets(rights).where(F.col("purpose") != "").withColumn("_canon", T.canonical(F.col("purpose"))).withColumns({
        "_leading": F.when(leading != "", F.concat(leading, F.lit("번"))),
        "_amount": F.when(F.col("amount") != 0, F.col("amount").cast("string"))})
    required = reduce(lambda a, b: a + b, [F.col("_canon").contains(m).cast("int") for m in markers]) + F.col("_leading").isNotNull().cast("int")
    r = r.withColumns({"_required": required, "_section": F.element_at(F.create_map(*[
        F.lit(x) for pair in zip(section_names, SECTION_PAGES) for x in pair]), F.col("section"))}).where(F.col("_section").isNotNull())
    asked = pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "text").unionByName(sections.select("doc_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("page_no"), F.col(c).alias("text")) for n, c in zip(SECTION_PAGES, ("gap_text", "eul_text"))]))))
    found = find_terms(r, asked, right_terms(markers)).where(F.size("_found") > 0)
    best = found.withColumn("_best", _best_spot()).where(F.col("_best").isNotNull()).withColumns({
        "first_page": F.col("_best.first_page"), "n_pages": F.col("_best.n_pages"), "score": F.col("_best.score"),
        "rank_found": F.col("_best.rank"), "target_found": F.col("_best.targets")})
    kept = [c for c in rights.columns if c != "target_rank_nos"]
    best = cut_lineage(best.select(*kept, "target_candidates", "_amount", "first_page", "n_pages", "score", "rank_found", "target_found"))

    page = lambda name, shift: pages.select("doc_id", (F.col("page_no") - shift).cast("int").alias("first_page"), F.col("text").alias(name))
    second = best.where("n_pages = 2").select("doc_id", "first_page").distinct().join(page("text_2", 1), ["doc_id", "first_page"]).withColumn("n_pages", F.lit(2))
    j = best.join(page("text_1", 0), ["doc_id", "first_page"]).join(second, ["doc_id", "first_page", "n_pages"], "left")
    values = [F.col(c) for c in ("purpose", "receipt_no", "rank_no", "registered_at", "holder", "debtor", "_amount",
                                 "joint_collateral_id")]
    start = F.col("first_page")
    raw = raw_text([("text_1", start), ("text_2", start + 1)], values, F.col("target_candidates"))
    return j.select(*kept, "target_candidates", "first_page", "n_pages", "score", raw.alias("raw_text"), "rank_found",
                    "target_found", F.concat_ws("\n", "text_1", "text_2").alias("text"))


def raw_text(parts, values: list[Column], more: Column | None = None) -> Column:
    """'[PAGE n] lines' of the given page texts, joined by a space."""
    out = []
    for text, page in parts:
        cut = T.excerpt(F.col(text), values, more)
        out.append(F.when(cut != "", F.concat(F.lit("[PAGE "), page.cast("string"), F.lit("] "), cut)))
    return F.concat_ws(" ", *out)


def locate_owners(owners: DataFrame, pages: DataFrame) -> DataFrame:
    """The first page where an owner's name has the id near it and the address on the
    same page or, failing that, over it and the next page. Others drop out.

    ``owners``: doc_id, owner_seq, name, jumin_front, address, share.
    """
    named = F.coalesce(F.col("name") != "", F.lit(False))
    keys = {"_name": F.when(named, T.canonical(F.col("name"))), "_jumin": F.col("jumin_front"), "_id": T.canonical(F.col("jumin_front")),
            "_id_no": T.number_key(F.col("jumin_front")), "_address": F.col("address"), "_address_canon": T.canonical(F.col("address")),
            "_address_no": T.number_key(F.col("address")), "_tokens": T.address_tokens(F.col("address"))}
    found = find_owners(owners.withColumns(keys), pages, list(keys), OWNER_WINDOW)
    raw = raw_text([("_t1", F.col("first_page")), ("_t2", F.col("first_page") + 1)],
                   [F.col(c) for c in ("name", "jumin_front", "address", "share")])
    kept = ["doc_id", "owner_seq", *(c for c in owners.columns if c not in ("doc_id", "owner_seq"))]
    return found.select(*kept, "first_page", "n_pages", raw.alias("raw_text"), F.concat_ws("\n", "_t1", "_t2").alias("text"))


def verified_owners(owners: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Located owners; id, address and share are kept only where the pages support them."""
    df = locate_owners(owners, pages).withColumns(
        {"_c": T.canonical(F.col("text")), "_n": T.without_separators(F.col("text"))})
    jumin = T.strip(T.text(F.col("jumin_front")))
    jumin = F.when(F.contains(T.digits(F.col("text")), F.substring(T.digits(jumin), 1, 6)), jumin).otherwise("")
    address = T.strip(T.text(F.col("address")))
    address = F.when(T.address_supported(address, F.col("text"), F.col("_c"), F.col("_n")), address).otherwise("")
    return df.withColumns({
        "name": T.strip(F.col("name")), "jumin_front": jumin, "address": address,
        "share": T.share_fraction(F.col("share"), F.col("text")),
    }).withColumn("age", F.when(F.col("jumin_front") != "", T.birth_age(F.col("jumin_front"), as_of))).drop("_c", "_n", "text")
