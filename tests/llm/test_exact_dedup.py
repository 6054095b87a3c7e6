"""Exact dedup against a plain grouping."""

import hashlib
from collections import defaultdict

from rentlens.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, lang string, count long, id string, t string, s string, n_squeezed string, head string, bucket string"


def rows(texts):
    return [(i, t, "x", 7, "a", "b", "c", "d", "e", "f") for i, t in texts]


def expected(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        t = t or ""
        groups["".join(c for c in t if c not in E.WHITE)].append((i, len(t)))
    out = []
    for s, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), i == keep, hashlib.sha256(s.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


def run(spark, pairs, **options):
    out = E.progressive_dedup(spark.createDataFrame(rows(pairs), SCHEMA), digest_all=True, **options)
    return sorted((tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "full_hash").collect()), key=str)


def test_against_grouping(spark):
    long = "wort " * 40_000
    pairs = [(5, "a b"), (2, "ab"), (9, "a  b"), (3, "a\u00a0b"), (4, None), (6, ""), (7, " \t\n"), (8, long), (1, long + "x"), (10, "x" + long),
             (11, long.replace(" ", "\n")), (12, "äb"), (13, "ä b"), (None, "ab"), (14, "prefix equal 1"), (15, "prefix equal 2"), (16, "A B"), (17, "😀"), (18, "😀 ")]
    assert run(spark, pairs) == expected(pairs)
    assert run(spark, pairs, prefix_chars=2) == expected(pairs)


def test_repeated_rows_and_hot_group(spark):
    pairs = [(i % 300, f"text {i % 7}") for i in range(600)] + [(1000 + i, "copy") for i in range(900)]
    assert run(spark, pairs) == expected(pairs)


def test_only_survivors_are_hashed(spark):
    pairs = [(1, "one"), (2, "two2"), (3, "same"), (4, "sa me"), (5, "sane!!")]
    out = E.progressive_dedup(spark.createDataFrame(rows(pairs), SCHEMA)).collect()
    assert {r.doc_id for r in out if r.full_hash} == {3, 4}


def test_empty_and_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert E.progressive_dedup(df).count() == 0
    df = spark.createDataFrame(rows([(1, "a"), (2, "a "), (3, None), (None, None)]), SCHEMA)
    kept = E.drop_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {2, 3}


def test_text_ids_and_a_clashing_column(spark):
    df = spark.createDataFrame([("b", "x y", 1), ("a", "xy", 2), ("c", "z", 3)], "doc_id string, text string, _gone int")
    assert {(r.doc_id, r.keep_id) for r in E.progressive_dedup(df).collect()} == {("b", "b"), ("a", "b"), ("c", "c")}
    kept = E.drop_copies(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {"b", "c"}
