"""Merkle fixity audit of archive replicas: compare roots, descend only where they differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.session import cut_lineage

#: Bytes of an offset range (a leaf) and children of a node.
RANGE_BYTES, FAN_OUT = 1 << 16, 16


def hash_records(records: DataFrame, payload: Column, archive_col: str, offset_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """``archive, offset, sha`` of each record, and the columns ``carry``. A null payload has a hash of its own, other
    than that of no bytes."""
    sha = F.coalesce(F.sha2(payload.cast("binary"), 256), F.lit("null"))
    return records.select(F.col(archive_col).alias("archive"), F.col(offset_col).cast("long").alias("offset"), sha.alias("sha"), *carry)


def _same(a: DataFrame, b: DataFrame, cols: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def _digest(order: list[str], *fields: str) -> Column:
    """One hash over a node's members in order. A node holds the records of one range or ``FAN_OUT`` children."""
    line = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in fields])
    members = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in order], line.alias("line"))))
    return F.sha2(F.array_join(F.transform(members, lambda m: m["line"]), "\n").cast("binary"), 256)


def build_tree(sides: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> tuple[DataFrame, list[DataFrame]]:
    """From ``side, archive, offset, sha``: the stored records, and the stored nodes of each level, leaves first.

    Records that agree in all four are one line with a count, so a record repeated any number of times stays one.
    """
    lines = sides.groupBy("side", "archive", "offset", "sha").agg(F.count("*").alias("copies"))
    lines = cut_lineage(lines.withColumn("node", F.floor(F.col("offset") / range_bytes)))
    levels = [cut_lineage(lines.groupBy("side", "archive", "node").agg(_digest(["offset", "sha"], "offset", "sha", "copies").alias("hash")))]
    last = levels[0].agg(F.max("node").alias("n"), F.min("node").alias("m")).first()
    low, high = last["m"] or 0, last["n"] or 0
    while (low, high) not in ((0, 0), (-1, 0), (-1, -1)) or len(levels) == 1:
        up = levels[-1].withColumns({"child": F.col("node"), "node": F.floor(F.col("node") / fan_out)})
        levels.append(cut_lineage(up.groupBy("side", "archive", "node").agg(_digest(["child"], "child", "hash").alias("hash"))))
        low, high = low // fan_out, high // fan_out
    return lines, levels


def _differing(nodes: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Keys whose values differ between the two sides, or that only one has."""
    of = lambda side, name: F.max(F.when(F.col("side") == side, F.col(value))).alias(name)
    return nodes.groupBy(*by).agg(of(0, "ours"), of(1, "theirs")).where(~F.col("ours").eqNullSafe(F.col("theirs")))


def audit(primary: DataFrame, replica: DataFrame, *, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """``archive, offset, fault, ours, theirs``: the faults of the replica, and one row ``intact`` for each archive
    without any. Both inputs hold ``archive, offset, sha`` (see ``hash_records``).

    Records are hashed, hashes of ordered offset ranges form the leaves and ``fan_out`` nodes each the next level,
    up to one root for an archive. Only children of nodes that differ are looked at, down to the records of the
    ranges that differ; a fault is ``missing``, ``extra`` or ``changed``, with the hash of the offset's records on
    either side.

    An archive that one side lacks differs as a whole. Records at one offset are compared together, counts
    included. Null archives and offsets are keys of their own (null offsets form one range), negative offsets are
    ordered before the others. Two empty inputs give an empty result.
    """
    sides = primary.select(F.lit(0).alias("side"), "archive", "offset", "sha").unionAll(replica.select(F.lit(1).alias("side"), "archive", "offset", "sha"))
    lines, levels = build_tree(sides, range_bytes, fan_out)
    bad = _differing(levels[-1], ("archive", "node"), "hash").select("archive", "node")
    for nodes in reversed(levels[:-1]):
        bad = cut_lineage(bad)
        inside = nodes.withColumn("parent", F.floor(F.col("node") / fan_out))
        inside = inside.join(bad, inside["archive"].eqNullSafe(bad["archive"]) & inside["parent"].eqNullSafe(bad["node"]), "left_semi")
        bad = _differing(inside, ("archive", "node"), "hash").select("archive", "node")
    bad = cut_lineage(bad)
    suspects = lines.join(bad, _same(lines, bad, ("archive", "node")), "left_semi")
    records = suspects.groupBy("side", "archive", "offset").agg(_digest(["sha"], "sha", "copies").alias("list"), F.count("*").alias("kinds"), F.max("copies").alias("most"), F.max("sha").alias("sha"))
    # one record once is named by its own hash, several at one offset by the hash of their list
    records = records.withColumn("value", F.when((F.col("kinds") == 1) & (F.col("most") == 1), F.col("sha")).otherwise(F.col("list")))
    kind = F.when(F.col("theirs").isNull(), "missing").when(F.col("ours").isNull(), "extra").otherwise("changed")
    faults = cut_lineage(_differing(records, ("archive", "offset"), "value").select("archive", "offset", kind.alias("fault"), "ours", "theirs"))
    archives, hit = levels[-1].select("archive").distinct(), faults.select("archive").distinct()
    intact = archives.join(hit, _same(archives, hit, ("archive",)), "left_anti")
    return faults.unionAll(intact.select("archive", F.lit(None).cast("long"), F.lit("intact"), F.lit(None).cast("string"), F.lit(None).cast("string")))
