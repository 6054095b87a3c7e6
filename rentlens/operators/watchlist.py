"""Landlord watchlist: cleaning, matching of owners, overall status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import text as T

# Ranking of match results and what each one means.
STATUS_RANK = {"MATCH_HIGH": 3, "MATCH_NAME_ONLY": 2, "UNKNOWN": 1, "NO_MATCH": 0}


def clean_watchlist(raw: DataFrame, loaded_at: Column | None = None) -> DataFrame:
    """Typed watchlist rows; the region is taken from the address again."""
    return raw.select(
        "name", T.clean_integer(F.col("age")).cast("int").alias("age"), "address",
        T.region_of(F.col("address")).alias("address_sigungu"),
        T.clean_integer(F.col("return_debt_amount")).alias("return_debt_amount"),
        T.clean_integer(F.col("default_days")).cast("int").alias("default_days"),
        T.clean_integer(F.col("enforcement_count")).cast("int").alias("enforcement_count"),
        T.iso_date(F.col("posted_date")).alias("posted_date"),
        (loaded_at if loaded_at is not None else F.current_timestamp()).alias("crawled_at"))


def missing_regions(watchlist: DataFrame) -> DataFrame:
    return watchlist.agg(F.count("*").alias("rows"), F.count_if(F.col("address_sigungu").isNull()).alias("missing_regions"))


def match_owners(owners: DataFrame, watchlist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds match_status and candidate_count to owners.

    HIGH when an entry of the same name has the owner's age at its posting date,
    NAME_ONLY when only the name fits. Names meet a table with one row per name.
    The age test runs on distinct (name, id) and distinct (name, age, posted) that
    share the two-digit birth year, so a name that fills a third of both tables costs
    no more than the birthdays and posting days of one year.
    """
    by_name = watchlist.where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("_candidates"))
    entries = watchlist.where(F.col("age").isNotNull() & F.col("posted_date").isNotNull()).select(
        "name", F.col("age").alias("_age"), F.col("posted_date").alias("_posted")).distinct()
    # An age at a date leaves two possible birth years.
    entries = entries.withColumn("_yy", F.explode(F.sequence(F.lit(0), F.lit(1)))).withColumn(
        "_yy", F.pmod(F.year("_posted") - F.col("_age") - F.col("_yy"), F.lit(100)))
    probe = owners.where(F.col("jumin_front").rlike("^[0-9]{6}")).select("name", "jumin_front").distinct().withColumn(
        "_yy", F.substring("jumin_front", 1, 2).cast("int"))
    fits = T.birth_age(F.col("jumin_front"), F.col("_posted")) == F.col("_age")
    high = probe.join(entries, ["name", "_yy"]).where(fits).select("name", "jumin_front").distinct().withColumn("_high", F.lit(True))
    named = F.coalesce(F.col("name") != "", F.lit(False))
    out = owners.join(by_name, "name", "left").join(high, ["name", "jumin_front"], "left")
    status = F.when(~named | F.col("_candidates").isNull(), "NO_MATCH").when(F.col("_high"), "MATCH_HIGH").otherwise("MATCH_NAME_ONLY")
    return out.withColumns({
        "match_status": status, "candidate_count": F.when(named, F.coalesce("_candidates", F.lit(0))).otherwise(0),
    }).drop("_high", "_candidates")


def candidate_groups(owners: DataFrame, watchlist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Watchlist entries behind each named match, one row per owner and age.

    Entries are counted per (name, age) before owners meet them, so a frequent name
    gives an owner as many rows as there are ages, not as there are entries.
    """
    entries = watchlist.where(F.col("name").isNotNull()).groupBy("name", "age").agg(
        F.count("*").alias("entries"), F.sum("return_debt_amount").alias("return_debt_amount"), F.max("posted_date").alias("last_posted"))
    return owners.where(F.col("name") != "").select(*keys, "name").join(entries, "name")


def checks_with_candidates(owners: DataFrame, watchlist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Owners with their match and the array ``candidates`` behind it, by age; null where there is none.

    An array holds one element per age of the name, so it is bounded by the ages people have.
    """
    each = candidate_groups(owners, watchlist, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.struct("age", "name", "entries", "return_debt_amount", "last_posted"))).alias("candidates"))
    out = match_owners(owners, watchlist, keys).join(each, list(keys), "left")
    return out.withColumns(check_result(F.col("match_status")))


def check_result(status: Column) -> dict[str, Column]:
    """Matched flag and match type of a match status."""
    return {
        "matched": F.when(status == "MATCH_HIGH", True).when(status == "NO_MATCH", False),
        "match_type": F.when(status == "MATCH_HIGH", "EXACT").when(status == "MATCH_NAME_ONLY", "MANUAL_REVIEW"),
    }


def overall_status(docs: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """Highest-ranked status per document; UNKNOWN outranks NO_MATCH, and a document
    without owners is UNKNOWN."""
    ranks = F.create_map(*[F.lit(x) for p in STATUS_RANK.items() for x in p])
    best = checks.groupBy(key).agg(F.max_by("match_status", ranks[F.col("match_status")]).alias("_best"))
    return docs.join(best, key, "left").withColumn("overall_match_status", F.coalesce("_best", F.lit("UNKNOWN"))).drop("_best")
