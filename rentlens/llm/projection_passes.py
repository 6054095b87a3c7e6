"""Embedding near-duplicates: sorted projection passes thin dense groups, blocks around pivots find every link."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.shared import components
from rentlens.session import cut_lineage, drop_stored

THRESHOLD = 0.93
#: Neighbours after a vector in an order that it is compared with, bits of a sort key.
WINDOW, KEY_BITS = 64, 60
#: Ranks a task takes at a time, rounds of thinning, and times the whole thinning is repeated on what is left.
BLOCK, ROUNDS, REPEATS, SEED = 1024, 8, 2, 11
MEMBERS = 512
#: Leaders of a block of the link step or so, pivots a larger cell is split around, times it is split, and rows a task
#: assigns at a time. They decide only what is measured together, never what is found.
CELL, PIVOTS, LEVELS, ASSIGN = 1024, 16, 12, 4096
#: Bytes of the blocks that one side of a task of the link step holds, groups a label's blocks are dealt into at least,
#: blocks whose pairs are measured in one round, and copies of a block made in each of several rounds (or so).
GROUP_BYTES, GROUPS, ONE_ROUND, ROUND_COPIES = 1 << 24, 8, 256, 2
#: Slack of the bounds in radians, above the rounding of an angle.
SLACK = 1e-7


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. The largest component is scaled to one first, so that no square overflows or vanishes."""
    x = np.asarray(x, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, v, label`` of the rows that can link: a label, and a vector of finite numbers that is not zero. Floats stay
    floats where they are stored and moved; they are measured as doubles."""
    v = F.col(vector_col).cast("array<float>" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(label_col).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).alias("id"), v.alias("v"), F.col(label_col).alias("label"), F.size(v).alias("dim"))


def _hashed(df: DataFrame, passes: list[int]) -> DataFrame:
    """Each vector once for each pass, with its key: the signs of random projections, one after the other."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, part in b.groupby("dim"):
                x = np.stack(part["v"].to_numpy()).astype(float)
                x = x / np.abs(x).max(1, keepdims=True)
                for p in passes:
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng((SEED, p, int(dim))).normal(size=(int(dim), KEY_BITS))
                    bits = (x @ planes[p, dim] >= 0).astype(np.int64)
                    yield part.assign(**{"pass": p, "key": bits @ (1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64))})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, pass int, key long")


def _in_order(df: DataFrame, passes: list[int]) -> DataFrame:
    """The vectors in the order of each pass (label, size, key), stored."""
    order = ["pass", "label", "dim", "key", "id"]
    rows = _hashed(df, passes).repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))


def _blocks(df: DataFrame, passes: list[int]) -> DataFrame:
    return _dealt(_in_order(df, passes))


def _dealt(rows: DataFrame) -> DataFrame:
    """The ordered vectors dealt into blocks of consecutive ranks.

    A block also gets the first ``WINDOW`` rows of the next one as guests, so that no neighbour is lost at an edge.
    Ranks come from a range-partitioned sort and the sizes of its partitions, of which there are few.
    """
    parts = rows.groupBy("part").agg((F.max("at") + 1).alias("n"))
    # one row for each partition of the sort, so both this window and the broadcast are small
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = rows.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("rank", F.col("before") + F.col("at"))
    own = F.call_function("div", "rank", F.lit(BLOCK))
    guest = (F.col("rank") % BLOCK < WINDOW) & (own > 0)
    return ranked.withColumn("block", F.explode(F.when(guest, F.array(own, own - 1)).otherwise(F.array(own)))).drop("part", "at", "before")


def _banded(b: pd.DataFrame, use: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> pd.DataFrame:
    """Calls ``use(i, j, cos)`` for every own row i of a block and its neighbours j in the window."""
    b = b.sort_values("rank", ignore_index=True)
    # a pass, label or size change ends a window
    group = (b[["pass", "label", "dim"]].ne(b[["pass", "label", "dim"]].shift())).any(axis=1).cumsum().to_numpy()
    own = (b["rank"] // BLOCK == b["block"]).to_numpy()
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        x = _unit(np.stack(b["v"].to_numpy()[at]))
        for s in range(0, len(at), 256):
            left = np.arange(s, min(s + 256, len(at)))
            right = np.arange(s, min(s + 256 + WINDOW, len(at)))
            cos = x[left] @ x[right].T
            gap = right[None, :] - left[:, None]
            ok = (gap > 0) & (gap <= WINDOW) & own[at[left]][:, None]
            i, j = np.nonzero(ok)
            use(at[left[i]], at[right[j]], cos[i, j])
    return b


def _thin(active: DataFrame, number: int, near: float) -> DataFrame:
    """``id, leader``, stored: vectors that give way to a neighbour of higher priority within ``near`` in the order of one pass.

    Only a vector that gives way to nobody in its window leads; the priority is a hash of the id.
    """
    def run(b: pd.DataFrame) -> pd.DataFrame:
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        b = _banded(b, lambda i, j, c: pairs.append((i[c >= near], j[c >= near])))
        i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, int) for k in (0, 1))
        ids, rank = b["id"].to_numpy(), b["priority"].to_numpy()
        swap = (rank[i] > rank[j]) | ((rank[i] == rank[j]) & (ids[i] > ids[j]))
        high, low = np.where(swap, i, j), np.where(swap, j, i)
        differs = ids[high] != ids[low]
        return pd.DataFrame({"id": ids[low][differs], "p": rank[high][differs], "leader": ids[high][differs]})

    stored = _in_order(active.withColumn("priority", F.xxhash64("id")), [number])
    found = _dealt(stored).groupBy("block").applyInPandas(run, "id long, p long, leader long")
    gone = cut_lineage(found.groupBy("id").agg(F.max(F.struct("p", "leader")).alias("best")).select("id", F.col("best.leader").alias("leader")))
    drop_stored(stored)
    return gone


def _tight(vectors: DataFrame, first_pass: int, near: float) -> DataFrame:
    """``id, leader`` for vectors within ``near`` of a leader that stands for them.

    Rounds thin the vectors out: who gives way points at the neighbour and leaves; windows then reach further among
    the rest. In the end everyone follows its pointers to a leader and is measured against it directly.
    """
    active, pointers = vectors, []
    for r in range(ROUNDS):
        gone = _thin(active, first_pass + r, near)
        if gone.isEmpty():
            break
        pointers.append(gone)
        before, active = active, cut_lineage(active.join(gone, "id", "left_anti"))
        if before is not vectors:
            drop_stored(before)
    if not pointers:
        return vectors.select("id", F.col("id").alias("leader")).limit(0)
    chain = pointers[-1]
    for p in reversed(pointers[:-1]):
        further = chain.select(F.col("id").alias("leader"), F.col("leader").alias("to"))
        step = p.join(further, "leader", "left").select("id", F.coalesce("to", "leader").alias("leader"))
        chain = cut_lineage(step.unionAll(chain))
    heads = active.select(F.col("id").alias("leader"), F.col("v").alias("w"))
    out = cut_lineage(vectors.select("id", "v").join(chain, "id").join(heads, "leader").where(cosine(F.col("v"), F.col("w")) >= near).select("id", "leader"))
    drop_stored(active)
    return out


def cosine(a, b):
    """Cosine in double precision; vectors are scaled by their largest component first, so nothing overflows."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    big = lambda x: F.array_max(F.transform(x, F.abs))
    scaled = lambda x: F.transform(x, lambda c: c / big(x))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, c: s + c)
    return dot(scaled(a), scaled(b)) / F.sqrt(dot(scaled(a), scaled(a)) * dot(scaled(b), scaled(b)))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def _cells(classes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The leaders with their ``cell``, stored: labels split around pivots again and again, until cells hold ``CELL``
    leaders or so, and the stored tables they are read from. Finished cells are set apart at each level, so that about
    one copy of the leaders is stored.

    The pivot of a slot is the leader of the cell with the smallest hash among those that fall on it.
    """
    key = ["label", "dim", "cell"]
    rows = classes.withColumn("cell", F.lit(0).cast("long"))
    done, columns = [], rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    for level in range(LEVELS):
        sizes = cut_lineage(rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > CELL))
        if sizes.isEmpty():
            break
        done.append(cut_lineage(rows.join(sizes, key, "left_anti")))
        many = rows.join(sizes, key).withColumn("chunks", F.ceil(F.col("n") / ASSIGN))
        mark = F.xxhash64("id", F.lit(level))
        pivots = many.groupBy(*key, "chunks", F.pmod(mark, F.lit(PIVOTS)).alias("slot")).agg(F.min_by("v", F.struct(mark, "id")).alias("v"))
        dealt = many.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks"))).drop("n", "chunks")
        pivots = cut_lineage(pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks"))

        def assign(b: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
            if b.empty:
                return b[columns]
            around = around.sort_values("slot")
            slot = around["slot"].to_numpy()[_angles(_unit(np.stack(b["v"].to_numpy())), _unit(np.stack(around["v"].to_numpy()))).argmin(1)]
            # cells whose numbers happen to be equal would be measured together, no more
            return b.assign(cell=b["cell"].to_numpy() * 1_000_003 + slot + 1)[columns]
        at = [*key, "chunk"]
        before, rows = rows, cut_lineage(dealt.groupBy(*at).cogroup(pivots.groupBy(*at)).applyInPandas(assign, fields))
        if level:
            drop_stored(before)
    parts = [*done, rows] if done else [cut_lineage(rows)]
    return reduce(DataFrame.unionByName, parts), parts


def _leader_blocks(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``block, packed``: the leaders of a cell, dealt by hash where it is still too large; and ``block, label, dim,
    centre, reach, group``. Blocks of near cells are in one group (of a label and size).

    No member of the block's classes is further than ``reach`` from ``centre``.
    """
    key = ["label", "dim", "cell"]
    rows, stored = _cells(classes)
    parts = rows.groupBy(*key).agg(F.ceil(F.count("*") / CELL).alias("parts"))
    dealt = rows.join(parts, key).withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))).drop("parts")

    def pack(b: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(b["v"].to_numpy())
        x = _unit(v)
        centre = x.mean(0)
        centre = centre / np.linalg.norm(centre) if centre.any() else x[0]
        reach = (_angles(x, centre[None])[:, 0] + b["radius"].to_numpy()).max()
        packed = [b["id"].to_numpy(np.int64).tobytes(), b["size"].to_numpy(np.int64).tobytes(), b["radius"].to_numpy(float).tobytes(), v.tobytes()]
        return pd.DataFrame({"label": b["label"][:1], "dim": b["dim"][:1], "cell": b["cell"][:1], "centre": [centre], "reach": [reach], "packed": [packed]})
    kind = classes.schema["label"].dataType.simpleString()
    blocks = dealt.groupBy(*key, "part").applyInPandas(pack, f"label {kind}, dim int, cell long, centre array<double>, reach double, packed array<binary>")
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))
    drop_stored(*stored)
    # one row for each block in this window, which leaves the vectors behind
    of_label = Window.partitionBy("label", "dim")
    size = F.least(F.greatest(F.floor(F.lit(GROUP_BYTES) / (F.col("dim") * 8 * CELL)), F.lit(1)), F.ceil(F.count("*").over(of_label) / GROUPS))
    place = F.row_number().over(of_label.orderBy("cell", "block")) - 1
    return blocks, cut_lineage(blocks.select("block", "label", "dim", "centre", "reach", F.call_function("div", place.cast("long"), size).alias("group")))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the edges (i, j) lead to."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        moved = a != b
        if not moved.any():
            return root
        i, j, a, b = i[moved], j[moved], a[moved], b[moved]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _link_blocks(classes: DataFrame, threshold: float) -> DataFrame:
    """What all pairs of leaders say: ``id, n, hub`` (with how many vectors a leader's class links whole in one pair of
    groups of blocks, and the smallest leader it is linked with there), and ``id, other`` (classes some members of which
    may link).

    Two blocks are measured unless the triangle inequality says that no members of theirs can link. A task has all
    measured pairs of two groups, so a block is copied once for each group it meets, not for each block; many blocks go
    in rounds, each of which makes a copy or two. Whole links leave as counts and a spanning forest, at most a row for
    each leader and pair of groups.
    """
    angle = math.acos(threshold)
    blocks, places = _leader_blocks(classes)
    side = lambda x: places.select(F.col("block").alias(x), "label", "dim", F.col("centre").alias(f"c{x}"), F.col("reach").alias(f"r{x}"), F.col("group").alias(f"g{x}"))
    apart = F.acos(F.greatest(F.least(cosine(F.col("ca"), F.col("cb")), F.lit(1.0)), F.lit(-1.0)))
    pairs = side("a").join(side("b"), ["label", "dim"]).where("ga < gb OR (ga = gb AND a <= b)").where((F.col("a") == F.col("b")) | (apart <= angle + F.col("ra") + F.col("rb") + SLACK))
    pairs = pairs.select("label", "dim", "ga", "gb", "a", "b")
    task = ["label", "dim", "ga", "gb"]
    none = F.lit(None).cast("long")
    # a block once for each task that needs it, with the blocks it is measured with as the first of a pair
    needed = pairs.select(*task, F.col("a").alias("block"), "b").unionAll(pairs.select(*task, F.col("b").alias("block"), none.alias("b")))
    needed = cut_lineage(needed.groupBy(*task, "block").agg(F.collect_list("b").alias("partners")))
    kind = np.float32 if classes.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def measured(x, y, spread, sizes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Whole links and pairs still open, by rows of 256: the row of x, that of y, whether whole."""
        for s in range(0, len(x), 256):
            cos = x[s:s + 256] @ y.T
            wide = spread(slice(s, s + 256))
            far = np.arccos(np.clip(cos, -1, 1))
            whole = np.where(wide == 0, cos >= threshold, far + wide <= angle - SLACK)
            maybe = (far <= angle + wide + SLACK) & ~whole & sizes(slice(s, s + 256))
            for found, is_whole in ((whole, True), (maybe, False)):
                i, j = np.nonzero(found)
                yield i + s, j, is_whole

    def run(b: pd.DataFrame) -> pd.DataFrame:
        held = {}
        for block, (ids, size, radius, v) in zip(b["block"], b["packed"]):
            ids = np.frombuffer(ids, np.int64)
            held[block] = ids, np.frombuffer(size, np.int64), np.frombuffer(radius), _unit(np.frombuffer(v, kind).reshape(len(ids), -1))
        first = dict(zip(held, np.cumsum([0, *(len(h[0]) for h in held.values())]).tolist()))
        ids = np.concatenate([h[0] for h in held.values()])
        # nodes by their ids, so that the smallest of a tree is the smallest id
        order = np.argsort(ids)
        node = np.empty(len(ids), int)
        node[order] = np.arange(len(ids))
        n, root, opened = np.zeros(len(ids)), np.arange(len(ids)), []
        for one, partners in zip(b["block"], b["partners"]):
            for two in partners:
                (ids_a, size_a, radius_a, x), (ids_b, size_b, radius_b, y) = held[one], held[two]
                spread = lambda s: radius_a[s, None] + radius_b[None]
                many = lambda s: (size_a[s, None] > 1) | (size_b[None] > 1)
                links = []
                for i, j, whole in measured(x, y, spread, many):
                    if one == two:
                        i, j = i[j > i], j[j > i]
                    if whole:
                        links.append((i, j))
                    else:
                        opened.append((ids_a[i], ids_b[j]))
                i, j = (np.concatenate([h[t] for h in links]) for t in (0, 1))
                n[first[one]:first[one] + len(ids_a)] += np.bincount(i, size_b[j], len(ids_a))
                n[first[two]:first[two] + len(ids_b)] += np.bincount(j, size_a[i], len(ids_b))
                # a pair's links are kept as the forest of all links so far
                root = _forest(np.concatenate([node[first[one] + i], np.arange(len(ids))]), np.concatenate([node[first[two] + j], root]), len(ids))
        at = np.flatnonzero(n)
        a, other = (np.concatenate([np.zeros(0, np.int64), *(o[t] for o in opened)]) for t in (0, 1))
        return pd.concat([pd.DataFrame({"id": ids[at], "n": n[at].astype(np.int64), "other": ids[order][root[node[at]]]}), pd.DataFrame({"id": a, "n": 0, "other": other})])

    sizes = places.agg(F.max("group").alias("last"), F.count("*").alias("n")).first()
    rounds = 1 if sizes["n"] <= ONE_ROUND else -(-(sizes["last"] + 2) // ROUND_COPIES)
    found = []
    for r in range(rounds):
        mine = needed.where(F.pmod(F.col("ga") + F.col("gb"), F.lit(rounds)) == r).repartition(*task)
        # rows with n = 0 are classes still to be measured
        found.append(cut_lineage(mine.join(blocks.select("block", "packed"), "block").groupBy(*task).applyInPandas(run, "id long, n long, other long")))
    drop_stored(blocks, needed)
    return reduce(DataFrame.unionAll, found)


def near_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
               threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id, n_links, component_id``.

    Dense groups are thinned first, by passes: vectors are ordered by the concatenated signs of random projections
    within their label, each is compared with a bounded window of neighbours, and those within half the threshold's
    angle of one leader become a class, all of whose pairs link by the triangle inequality, so they count without
    being written out. Passes decide only which vectors form a class.

    Links between classes are complete: each label is split around pivots into blocks of leaders, and every two blocks
    that can hold a link by the triangle inequality are measured whole. A pair of classes that can only link whole
    counts by its sizes, any other is measured member by member, in blocks that give counts only. So exactly the pairs
    with a cosine of at least ``threshold`` count, up to rounding. Where leaders are spread so evenly that no two
    blocks can be told apart, the comparisons grow with the square of the leaders of a label.

    Rows that cannot link (no label; null, zero, or with null or non-finite components) have no links and are their
    own component. Vectors of different length link with nothing. Ids are unique numbers; rows repeated with the same
    id are taken once for the links and each given the result. An empty table gives an empty result.
    """
    angle = math.acos(threshold)
    near = math.cos(angle / 2) + 1e-9
    vectors = cut_lineage(valid_vectors(df, id_col, vector_col, label_col).where("id is not null").dropDuplicates(["id"]))
    member = vectors.select("id", F.col("id").alias("leader")).limit(0)
    rest = vectors
    for r in range(REPEATS):
        tight = _tight(rest, 1000 * (r + 1), near)
        leads = tight.select(F.col("leader").alias("id")).distinct()
        member = member.unionAll(tight).unionAll(leads.select("id", F.col("id").alias("leader")))
        before, rest = rest, cut_lineage(rest.join(tight, "id", "left_anti").join(leads, "id", "left_anti"))
        if before is not vectors:
            drop_stored(before)
    member = cut_lineage(member.unionAll(rest.select("id", F.col("id").alias("leader"))))

    heads = cut_lineage(member.select("leader").distinct().join(vectors.withColumnRenamed("id", "leader"), "leader"))
    drop_stored(rest)
    of_class = cut_lineage(member.where("id <> leader").join(vectors.select("id", "v"), "id").join(heads.select("leader", F.col("v").alias("w")), "leader")
                           .select("id", "leader", "v", F.acos(F.least(cosine(F.col("v"), F.col("w")), F.lit(1.0))).alias("apart")))
    drop_stored(vectors)
    sizes = of_class.groupBy("leader").agg((F.count("*") + 1).alias("size"), F.max("apart").alias("radius"))
    classes = cut_lineage(heads.join(sizes, "leader", "left").select(
        F.col("leader").alias("id"), "v", "label", "dim", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("radius", F.lit(0.0)).alias("radius")))

    found = _link_blocks(classes, threshold)
    whole = found.where("n > 0")
    of_leader = whole.groupBy("id").agg(F.sum("n").alias("n_whole")).withColumnRenamed("id", "leader")

    open_pairs = found.where("n = 0").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    parts = _member_parts(member, of_class, heads, open_pairs)
    counted = cut_lineage(_count_parts(parts, open_pairs, threshold))
    single = counted.groupBy("id").agg(F.sum("n").alias("n_open"))
    linked = whole.select(F.col("id").alias("a"), F.col("other").alias("b")).unionAll(counted.where("n > 0").select("a", "b").distinct())
    roots = components(linked)

    counts = member.join(classes.select(F.col("id").alias("leader"), "size"), "leader").join(of_leader, "leader", "left").join(single, "id", "left")
    counts = counts.join(roots.select(F.col("node").alias("leader"), "root"), "leader", "left").withColumn("root", F.coalesce("root", "leader"))
    counts = cut_lineage(counts.select("id", (F.col("size") - 1 + F.coalesce("n_whole", F.lit(0)) + F.coalesce("n_open", F.lit(0))).alias("n_links"), "root"))
    smallest = cut_lineage(counts.groupBy("root").agg(F.min("id").alias("component_id")))
    result = cut_lineage(counts.join(smallest, "root").select("id", "n_links", "component_id"))
    return df.select(F.col(id_col).alias("id")).join(result, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def _member_parts(member: DataFrame, of_class: DataFrame, heads: DataFrame, open_pairs: DataFrame) -> DataFrame:
    """``leader, part, ids, vs``: the members of classes in open pairs, at most ``MEMBERS`` or so to a part."""
    wanted = open_pairs.select(F.col("a").alias("leader")).unionAll(open_pairs.select(F.col("b").alias("leader"))).distinct()
    rows = of_class.select("id", "leader", "v").unionAll(heads.select(F.col("leader").alias("id"), "leader", "v")).join(wanted, "leader", "left_semi")
    sizes = rows.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = rows.join(sizes, "leader").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return cut_lineage(dealt.groupBy("leader", "part").agg(F.collect_list(F.struct("id", "v")).alias("rows")))


def _count_parts(parts: DataFrame, open_pairs: DataFrame, threshold: float) -> DataFrame:
    """``a, b, id, n``: for each member of a class in an open pair, how many members of the other class it links with."""
    left = parts.select(F.col("leader").alias("a"), F.col("rows").alias("ours"))
    right = parts.select(F.col("leader").alias("b"), F.col("rows").alias("theirs"))
    # pairs of parts of linked classes: as many as the classes' windows found, times their numbers of parts
    blocks = open_pairs.join(left, "a").join(right, "b").repartition("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (_unit(np.array([m["v"] for m in r[k]])) for k in ("ours", "theirs"))
                hit = x @ y.T >= threshold
                ids = [m["id"] for k in ("ours", "theirs") for m in r[k]]
                n = np.concatenate([hit.sum(1), hit.sum(0)])
                yield pa.RecordBatch.from_arrays([pa.array([r["a"]] * len(ids), pa.int64()), pa.array([r["b"]] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "id", "n"])
    return blocks.mapInArrow(run, "a long, b long, id long, n long")
