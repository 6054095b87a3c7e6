"""Fixity audit against a plain comparison."""

import random
from collections import Counter

import pytest

from rentlens.llm import merkle_fixity as M

SCHEMA = "archive string, offset long, sha string"


def plain(a, b):
    """{(archive, offset): fault} and the archives without any."""
    by = lambda rows: {k: Counter(s for x, o, s in rows if (x, o) == k) for k in {(x, o) for x, o, _ in rows}}
    ours, theirs = by(a), by(b)
    faults = {k: "missing" if k not in theirs else "extra" if k not in ours else "changed" for k in ours.keys() | theirs.keys() if ours.get(k) != theirs.get(k)}
    return faults, {x for x, _, _ in a + b} - {k[0] for k in faults}


@pytest.mark.parametrize("range_bytes,fan_out", [(1 << 16, 16), (100, 2), (1000, 3)])
def test_against_plain(spark, range_bytes, fan_out):
    rng = random.Random(range_bytes)
    a = [(f"f{i % 5}", rng.randrange(0, 40_000), f"s{rng.randrange(9)}") for i in range(300)]
    a += [("hot", i * 7, "s") for i in range(900)] + [("same", 3, "x")] * 4 + [("same", 9, "y")] + [(None, 5, "z"), ("nul", None, "q"), ("neg", -5, "n")]
    b = [r for r in a if rng.random() > 0.02 or r[0] in ("f1", "same")]
    b = [(x, o, s + "!") if rng.random() < 0.02 and x != "f1" else (x, o, s) for x, o, s in b] + [("f2", 123_456, "new"), ("other", 0, "o"), ("same", 3, "x")]
    out = M.audit(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), range_bytes=range_bytes, fan_out=fan_out).collect()
    faults, intact = plain(a, b)
    assert {(r.archive, r.offset): r.fault for r in out if r.fault != "intact"} == faults
    assert {r.archive for r in out if r.fault == "intact"} == intact and len(out) == len(faults) + len(intact)


def test_only_differing_branches_are_read(spark):
    a = [("f", i * 10, f"s{i}") for i in range(2000)]
    b = a[:777] + [("f", 7770, "bad")] + a[778:]
    lines, levels = M.build_tree(spark.createDataFrame([(0, *r) for r in a] + [(1, *r) for r in b], "side int, " + SCHEMA), 100, 4)
    assert len(levels) > 4 and levels[-1].count() == 2
    for nodes in levels:
        assert M._differing(nodes, ("archive", "node"), "hash").count() == 1


def test_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([("f", 0, "s")], SCHEMA)
    assert M.audit(none, none).count() == 0
    assert [tuple(r) for r in M.audit(one, none).collect()] == [("f", 0, "missing", "s", None)]
    assert [tuple(r) for r in M.audit(none, one).collect()] == [("f", 0, "extra", None, "s")]
    records = spark.createDataFrame([("a", 0, None, "x", "y"), ("a", 9, b"", "x", "y"), ("a", 20, b"z" * 1_000_000, "x", "y")], "file string, at long, body binary, sha string, archive string")
    from pyspark.sql import functions as F
    hashed = M.hash_records(records, F.col("body"), "file", "at")
    assert len({r.sha for r in hashed.collect()}) == 3 and M.audit(hashed, hashed).collect()[0].fault == "intact"
