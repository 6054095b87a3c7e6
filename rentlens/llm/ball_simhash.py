"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.shared import components, text_of
from rentlens.session import cut_lineage, drop_stored

SHINGLE_WORDS, RADIUS, SEED = 3, 2, 42
#: Shingles hashed at a time, so that a long text needs no more memory than a short one.
CHUNK = 50_000
#: Of the similarity join: words of a shingle, least Jaccard similarity, independent fingerprints and the minima of
#: each, and rounds in which the members of a bucket are measured against its smallest.
SIMILAR_WORDS, SIMILAR, PRINTS, MINIMA, STARS = 5, 0.8, 16, 5, 2
#: Longs of a parity sketch, for how many shingles of a text one more is asked to be shared in its prefix, and rows
#: whose shingles a task holds at a time.
SKETCH, SHARED_EVERY, ROWS = 16, 20, 256


def _shingle_hashes(w: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles, ``CHUNK`` at a time; fewer words are one shingle."""
    n = max(1, len(w) - words + 1)
    for start in range(0, n, CHUNK):
        stop = min(n, start + CHUNK)
        parts = [w[start + i:stop + i] for i in range(words)] if len(w) >= words else [[x] for x in w]
        yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*parts))), np.uint64, stop - start)


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash, signed, of the word shingles of the ASCII-lower-cased text; 0 without words.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and the six ASCII white-space characters only.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return _simhash(_shingle_hashes(w, words), max(1, len(w) - words + 1)) if w else 0


def _simhash(chunks: Iterable[np.ndarray], n: int) -> int:
    ones = np.zeros(64, np.int64)
    for hashes in chunks:
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp`` for every row. Null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = pa.array([fingerprint(t, words) for t in b.column("t").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(id_col), prints], names=[id_col, "fp"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("t")).mapInArrow(run, f"{id_col} {kind}, fp long")


def ball(half: int) -> list[int]:
    """All masks of at most ``half`` bits, signed."""
    masks = [sum(1 << i for i in c) for k in range(half + 1) for c in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links between distinct fingerprints (``fp``) whose transitive closure is that of all pairs
    at most ``radius`` bits apart.

    Every fingerprint is sent to all values within half the radius, and two fingerprints within the radius
    meet at one of them. For an even radius all that meet are within it: each group, which holds at most one
    ball of fingerprints (65 for radius 2), is then linked as a star around its smallest member instead of
    by all its pairs. An odd radius would let pairs one bit too far apart meet; it is refused.
    """
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("the radius has to be 2 or 4")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    sent = prints.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = sent.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("hub")).where("fp > hub")
    return met.distinct().where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= radius).select(
        F.col("fp").alias("a"), F.col("hub").alias("b"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``id, fp, component_id`` (smallest id reachable over links, itself included).

    Copies share a fingerprint, so links are looked for between distinct fingerprints only and each document
    then takes the component of its own. Null and empty texts have fingerprint 0, which links like any other.
    Repeated rows each give a row; null ids count for no minimum. An empty table gives an empty result; other
    columns are ignored.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    firsts = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    roots = components(near_links(firsts.select("fp"), radius))
    rooted = cut_lineage(firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    labels = cut_lineage(rooted.join(smallest, "root").select("fp", "component_id"))
    return prints.join(labels, "fp").select(id_col, "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns."""
    gone = near_components(docs, id_col, text_col, **options).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, PRINTS * MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def independent_prints(text: str, words: int = SIMILAR_WORDS) -> tuple[int, list[int]]:
    """The SimHash, and ``PRINTS`` fingerprints each of which two texts share with probability J ** ``MINIMA``, J being
    the Jaccard similarity of their shingles: it is made of the minima of as many hash functions."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0, list(range(PRINTS))
    chunks = list(_shingle_hashes(w, words))
    least = np.full(PRINTS * MINIMA, ~np.uint64(0))
    for hashes in chunks:
        for at in range(0, len(hashes), 2048):
            mixed = (hashes[at:at + 2048] ^ _ODD[0][:, None]) * _ODD[1][:, None]
            np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.astype("<u8").reshape(PRINTS, MINIMA)
    return _simhash(chunks, max(1, len(w) - words + 1)), [xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)]


def _shingles(text: str, words: int) -> set[bytes]:
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))}


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs ``a, b`` (ids) whose texts have a shingle similarity of at least ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = _shingles(x.as_py(), words), _shingles(y.as_py(), words)
                both = len(p & q)
                keep.append(both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in "ab"], names=["a", "b"])
    kind = texts.schema["id"].dataType.simpleString()
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("x")), "a")
    return one.join(texts.select(F.col("id").alias("b"), F.col("t").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(run, f"a {kind}, b {kind}")


def marks(text: str, words: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending; a text without words has one."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(np.concatenate(list(_shingle_hashes(w or [b""], words))))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` longs whose bits are the parities of the hashes dealt to them: two sets differ in at least as many
    hashes as their sketches differ in bits."""
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(int), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _prefix(n: int, least: float) -> tuple[int, int]:
    """How many of n marks, in any common order, hold k of those shared with a similar text of the same size or larger
    (k grows with n), and how many marks any partner shares at least."""
    need = math.ceil(least * n - 1e-9)
    return min(n, n - need + n // SHARED_EVERY + 1), need // SHARED_EVERY + 1


def _marks_of(some: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """``row, n, mark`` for rows ``row, n, id, same``, from the texts of their ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                got = [marks(t, words) for t in b.column("t").to_pylist()]
                same = [_digest(g) == x for g, x in zip(got, b.column("same").to_pylist())]
                keep = pa.array([i for i, x in enumerate(same) if x], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("row").take(keep), b.column("n").take(keep), _lists([g for g, x in zip(got, same) if x])], names=["row", "n", "marks"])
    found = some.select("row", "n", "id", "same").join(texts, "id").select("row", "n", "same", "t").mapInArrow(run, "row long, n int, marks array<long>")
    # rows repeated with their id and text give a row's marks more than once
    return found.dropDuplicates(["row"]).select("row", "n", F.explode("marks").alias("mark"))


def _digest(hashes: np.ndarray) -> str:
    return xxhash.xxh128_hexdigest(hashes.astype("<u8").tobytes())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64)))


def _set_links(docs: DataFrame, texts: DataFrame, found: DataFrame, words: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Two times ``a, b``: links from each row to the smallest id with equal ``marks``, and the pairs of such ids, not
    of one component of ``found``, that may have a similarity of at least ``least``; none that has it is missing.

    ``docs``: row (a number of its own), id, n, same (a digest of the marks), prefix (their first ones), partner (how
    many of those any partner shares at least), sketch. Of n marks a similar text has at least ceil(least * n). So two
    similar texts share the k smallest of their common marks in their first n - ceil(least * n) + k, whatever the order
    of marks. First in the order of the hashes, with k growing with n: texts whose prefix holds fewer marks of others
    than any partner needs have no partner and go. Then, for those left, rare marks first and k = 1: marks of one text
    only come first and meet nobody, and pairs meet at the rare marks after them. Each set of marks takes part once, by
    its smallest id. ``texts`` has the texts by id. ``docs`` is a stored table and is removed once it has been read.
    """
    groups = docs.groupBy("same").agg(F.min(F.struct("id", "row")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    later = cut_lineage(docs.select("same", "row", "id").join(groups, "same").where(F.col("row") != F.col("first.row")).select("row", "id", F.col("first.id").alias("first")))
    copies = later.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    sets = docs.drop("fp", "prints").join(later.select("row"), "row", "left_anti")
    need = F.ceil(F.lit(least) * F.col("n") - 1e-9).cast("int")
    shared = lambda some: some.withColumn("texts", F.count("*").over(Window.partitionBy("mark"))).where("texts > 1")
    prefix = shared(sets.select("row", "partner", F.explode("prefix").alias("mark")))
    left = cut_lineage(prefix.groupBy("row", "partner").agg(F.count("*").alias("held")).where("held >= partner").select("row"))
    sets = cut_lineage(sets.drop("prefix", "partner").join(left, "row"))
    drop_stored(docs, left)

    of_text = Window.partitionBy("row")
    rare = shared(_marks_of(sets, texts, words)).withColumns(
        {"held": F.count("*").over(of_text), "place": F.row_number().over(of_text.orderBy("texts", "mark"))})
    rare = rare.where(F.col("place") <= F.col("held") - need + 1).select("row", "mark")
    roots = components(found.unionAll(copies)).select(F.col("node").alias("id"), "root")
    known = sets.select("row", "id", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    rare = cut_lineage(rare.join(known, "row"))
    x, y = rare.alias("x"), rare.alias("y")
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH)), F.lit(0))
    near = ((F.col("x.row") < F.col("y.row")) & (F.col("x.root") != F.col("y.root")) & (F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n") - 1e-9)
            & (differ <= (F.col("x.n") + F.col("y.n")) * F.lit((1 - least) / (1 + least)) + 1e-6))
    pairs = x.join(y, (F.col("x.mark") == F.col("y.mark")) & near).select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b")).distinct()
    pairs = cut_lineage(pairs)
    drop_stored(sets, rare)
    return copies, pairs


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = SIMILAR_WORDS, least: float = SIMILAR) -> DataFrame:
    """``a, b``: links between documents whose components are those of all pairs with a Jaccard similarity of their
    word shingles of at least ``least``.

    First documents meet in buckets, at a value within one bit of both SimHashes or at one of the independent
    fingerprints, and are measured against the bucket's smallest id; those that are not linked meet again, ``STARS``
    rounds in all. That links most of what is similar with few pairs, but neither do all similar documents meet nor are
    all that meet measured. So then every pair of documents of different components that may still be similar is
    measured (``_set_links``). Links of different texts are measured on the whole texts.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda p: p - (1 << 64) if p >> 63 else p
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                got = [(*independent_prints(t, words), marks(t, words)) for t in b.column("t").to_pylist()]
                sizes = [_prefix(len(g[2]), least) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array([g[0] for g in got], pa.int64()), pa.array([[signed(p) for p in g[1]] for g in got], pa.list_(pa.int64())),
                     pa.array([len(g[2]) for g in got], pa.int32()), pa.array([_digest(g[2]) for g in got]), _lists([g[2][:q] for g, (q, _) in zip(got, sizes)]),
                     pa.array([k for _, k in sizes], pa.int32()), pa.array([parity_sketch(g[2]) for g in got], pa.list_(pa.int64()))],
                    names=["id", "fp", "prints", "n", "same", "prefix", "partner", "sketch"])
    columns = f"id {kind}, fp long, prints array<long>, n int, same string, prefix array<long>, partner int, sketch array<long>"
    prints = cut_lineage(texts.mapInArrow(run, columns).withColumn("row", F.monotonically_increasing_id()))
    masks = F.array(*[F.lit(m).cast("long") for m in ball(RADIUS // 2)])
    sent = prints.select("id", F.posexplode("prints").alias("kind", "value")).unionAll(
        prints.select("id", F.explode(masks).alias("mask"), "fp").select("id", F.lit(-1).alias("kind"), F.col("fp").bitwiseXOR(F.col("mask")).alias("value")))
    key = ["kind", "value"]

    def meet(m: DataFrame) -> DataFrame:
        hubs = cut_lineage(m.groupBy(*key).agg(F.min("id").alias("hub"), F.max("id").alias("_last")).where("hub <> _last").drop("_last"))
        out = cut_lineage(m.join(hubs, key).where("id <> hub").select(*key, "id", "hub"))
        drop_stored(hubs)
        return out
    met = meet(sent)
    links = prints.sparkSession.createDataFrame([], f"a {kind}, b {kind}")
    for last in range(STARS - 1, -1, -1):
        pairs = met.select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
        found = cut_lineage(_verified(pairs, texts, words, least).distinct())
        links = links.unionAll(found)
        if last:
            left = cut_lineage(met.join(found.select(F.col("a").alias("id"), F.col("b").alias("hub")), ["id", "hub"], "left_anti").select(*key, "id"))
            drop_stored(met)
            met = meet(left)
            drop_stored(left)
            if met.isEmpty():
                break
    drop_stored(met)
    copies, pairs = _set_links(prints, texts, links, words, least)
    return links.unionAll(copies).unionAll(cut_lineage(_verified(pairs, texts, words, least))).distinct()


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those linked to one of a smaller id by ``similar_links``, directly or over others; with
    their columns. Null ids are kept; an empty table stays empty."""
    gone = components(similar_links(docs, id_col, text_col, **options)).where("node <> root").select(F.col("node").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
