"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm.shared import text_of
from rentlens.session import cut_lineage

#: Code points of the squeezed text that the second step looks at.
PREFIX_CHARS = 256
#: Bits of the candidate filter for each surviving group, and the most bits in all (32 MB).
BITS_PER_GROUP, MOST_BITS = 16, 1 << 28

WHITE = " \t\n\x0b\x0c\r"


def squeezed(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09 to 0x0D."""
    return F.translate(text, WHITE, "")


def _slot(bits: int) -> Column:
    return F.pmod(F.xxhash64("n_squeezed", "head"), F.lit(bits))


def candidate_filter(groups: DataFrame, bits: int) -> DataFrame:
    """A bitmap over hashed (n_squeezed, head): ``bucket, bitmap``, at most ``bits / 8`` bytes in all."""
    s = _slot(bits)
    return groups.groupBy(F.bitmap_bucket_number(s).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(s)).alias("bitmap"))


def _is_set(bits: int) -> Column:
    """Whether the row's bit is set in the joined ``bitmap``."""
    pos = F.bitmap_bit_position(_slot(bits))
    byte = F.conv(F.hex(F.substr(F.col("bitmap"), (F.shiftright(pos, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.coalesce(F.getbit(byte, pos % 8) == 1, F.lit(False))


def progressive_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, n_chars, full_hash``.

    1. Rows are grouped by the length of the squeezed text; lengths that occur once leave.
    2. The rest are grouped by length and the hash of a prefix; pairs that occur once leave.
    3. Only rows of surviving pairs are hashed whole (SHA-256) and grouped by that hash.

    Steps 1 and 2 run on a stored table of three numbers per row. For step 3 the surviving pairs become a
    bitmap of a fixed size bound, so the text is hashed where it is read and never shuffled; rows that pass the
    bitmap by chance end as groups of one. The row with the most code points stays, then the smallest id.
    ``digest_all`` also fills ``full_hash`` for rows that left earlier, for callers who publish digests.

    Null texts count as empty; empty texts are equal to each other. Repeated rows count as separate rows of
    their group, ``kept`` being true for each row that carries the kept id. A null id comes after all others.
    An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).select(
        "id", F.length("t").cast("long").alias("n_chars"), squeezed(F.col("t")).alias("s"))
    keyed = base.withColumns({"n_squeezed": F.length("s"), "head": F.xxhash64(F.substring("s", 1, prefix_chars))})
    keys = cut_lineage(keyed.select("n_squeezed", "head"))
    lengths = cut_lineage(keys.groupBy("n_squeezed").count().where("count > 1").select("n_squeezed"))
    groups = cut_lineage(keys.join(lengths, "n_squeezed", "left_semi").groupBy("n_squeezed", "head").count().where("count > 1"))

    bits = 1 << 15
    wanted = BITS_PER_GROUP * groups.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    bitmap = candidate_filter(groups, bits)
    # the bound of the broadcast side is MOST_BITS / 8 bytes, whatever the input
    marked = keyed.withColumn("bucket", F.bitmap_bucket_number(_slot(bits))).join(F.broadcast(bitmap), "bucket", "left")
    digest = F.sha2(F.col("s").cast("binary"), 256)
    marked = marked.withColumn("candidate", _is_set(bits))
    rows = cut_lineage(marked.select(
        "id", "n_chars", "n_squeezed", "candidate",
        (digest if digest_all else F.when(F.col("candidate"), digest)).alias("full_hash")))

    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id")))
    full = cut_lineage(rows.where("candidate").groupBy("n_squeezed", "full_hash").agg(F.count("*").alias("group_size"), best.alias("best"))
                       .where("group_size > 1").select("n_squeezed", "full_hash", "group_size", F.col("best.id").alias("keep_id")))
    grouped = rows.where("candidate").join(full, ["n_squeezed", "full_hash"], "left")
    single = rows.where("not candidate").withColumns({"group_size": F.lit(None).cast("long"), "keep_id": F.lit(None).cast(rows.schema["id"].dataType)})
    out = grouped.unionByName(single)
    alone = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), "n_chars", "full_hash")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with their columns. Rows repeated with the same id stay together."""
    verdicts = progressive_dedup(docs, id_col, text_col, **options)
    # only ids that leave are joined: they are the smaller side, and the text side keeps its order
    gone = verdicts.where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]), "left_anti")
