"""Needles of many asks found in one walk over each document."""

import pyarrow as pa
from pyspark.sql import functions as F

from rentlens.operators import evidence_index as X
from rentlens.operators.evidence_index import find_terms

TERMS = "array<struct<role:string,idx:int,form:string,needle:string>>"
ASKS = [
    (1, 1, [("P", 0, "C", "gage"), ("V", 0, "N", "1234"), ("T", 0, "T", "3"), ("R", 0, "R", "7(1)")]),
    (1, 2, [("V", 1, "C", "acrossseam"), ("Q", 0, "C", "nowhere")]),
    (2, 1, [("P", 0, "C", "gage")]),
    (3, 1, [("P", 0, "C", "gage")]),
    (None, 1, [("P", 0, "C", "gage")]),
]
PAGES = [
    (1, 1, "Mort-Gage 12,3\n13번 3 \n7"), (1, 2, "(1) x\n3\n번 acr"), (1, 3, "oss seam\n 12-34"), (1, 5, "gage"), (1, -1, "gage 1234"),
    (2, 1, None), (2, 2, "Gag"), (2, 3, "E"), (4, 1, "gage"), (None, 1, "gage"),
]


def found(spark, asks=ASKS, pages=PAGES):
    a = spark.createDataFrame(asks, f"doc_id long, seq int, terms {TERMS}")
    p = spark.createDataFrame(pages, "doc_id long, page_no int, text string")
    return find_terms(a, p, F.col("terms"))


def test_needles_on_pages_and_over_their_ends(spark):
    got = {(r.doc_id, r.seq): sorted((x.role, x.idx, x.ones, x.twos) for x in r._found) for r in found(spark).collect()}
    assert got == {
        (1, 1): [("P", 0, [-1, 1, 5], [1]), ("R", 0, [], [1]), ("T", 0, [2], [1, 2]), ("V", 0, [3], [2])],
        (1, 2): [("V", 1, [], [2])],
        (2, 1): [("P", 0, [], [2])], (3, 1): []}


def test_asks_and_pages_are_shuffled_once_and_needles_not_at_all(spark):
    plan = found(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_more_needles_than_characters(spark):
    words = [f"w{i:04d}" for i in range(300)]
    asks = [(1, i, [("P", 0, "C", w), ("V", 0, "C", w[-2:])]) for i, w in enumerate(words)]
    got = {r.seq: [(x.role, x.ones) for x in r._found] for r in found(spark, asks, [(1, 1, " ".join(words[10:20])), (1, 2, words[299])]).collect()}
    assert [s for s in got if ("P", [1]) in got[s]] and {s for s in got if any(x[0] == "P" for x in got[s])} == {*range(10, 20), 299}
    assert ("V", [1]) in got[110] and ("V", [2]) in got[199]


def test_columns_are_taken_over_with_their_nulls():
    assert X._strings(pa.array(["a", None, "가"])[1:]) == [None, "가"] and X._strings(pa.array([], pa.string())) == []
    assert X._lists(pa.array([["x"], None, [], ["y", "z"], [None]], pa.list_(pa.string()))[1:]) == [None, [], ["y", "z"], [None]]
