"""The classifier on held-out labels, and its parts."""

import math

import numpy as np
import pytest

from rentlens.llm import pu_quality as P
from rentlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_features_are_finite():
    for t in ["", " ", "\n\n", "a", "é" * 100_000, "!!! ???", "x " * 50_000, "\x00\x01", "😀"]:
        f = P.features(t)
        assert f.shape == P.features("").shape and np.isfinite(f).all()


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(2, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3))
    unlabelled = np.concatenate([pos[:2100], neg[:900]])
    prior = P.estimate_prior(pos[2100:], rng.permutation(unlabelled))
    assert abs(prior - 0.7) < 0.06
    net = P._fit_network(pos[2100:], unlabelled, prior)
    assert (net.margin(rng.normal(2, 1, (500, 3))) > 0).mean() > 0.97 and (net.margin(rng.normal(-2, 1, (500, 3))) < 0).mean() > 0.97


def test_held_out_accuracy(spark):
    out = {r.doc_id: r for r in QUERIES["op3_pu_quality"](spark, FOLDER).collect()}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    held = [r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if out[r.doc_id].held_out]
    right = [out[r.doc_id].predicted == r.quality for r in held]
    assert len(held) > 50 and sum(right) / len(right) > 0.95
    assert sum(1 for r in held if r.quality and not out[r.doc_id].predicted) <= 0.03 * len(held)


def test_only_text_and_positive_labels_count(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    from pyspark.sql import functions as F
    a = P.fit(docs, labels, rows=200)
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("s"), "n_chars": F.lit(1), "quality": F.lit(0), "t": F.lit("x"), "trusted": F.lit(True)})
    hidden = P.fold("doc_id", 4) == 2
    # held-out labels, negative ones and the other column may say anything
    changed = labels.withColumns({"quality": F.when(hidden, 1 - F.col("quality")).otherwise(F.col("quality")), "toxic": F.lit(1)}).where(hidden | (F.col("quality") == 1))
    b = P.fit(other, changed.unionByName(labels.where(~hidden & (F.col("quality") == 1))), rows=200)
    assert np.array_equal(a.out, b.out) and a.prior == b.prior


def test_edges(spark):
    schema = "doc_id long, text string, score double, t string, _id long"
    docs = spark.createDataFrame([(1, None, 0.0, "", 1), (2, "", 0.0, "", 1), (2, "", 0.0, "", 1), (None, "abc " * 20_000, 0.0, "", 1)], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = P.fit(docs, none)
    scores = [r.s for r in docs.select(P.score(model).alias("s")).collect()]
    assert scores == [0.5] * 4
    # nothing to learn from: no document is judged
    assert P.keep_good(docs, none).count() == 4 and P.keep_good(docs, none, threshold=0.5).columns == docs.columns
    assert P.keep_good(docs.limit(0), none).count() == 0
    model = P.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"), rows=300)
    got = [r.s for r in docs.select(P.score(model).alias("s")).collect()]
    assert all(0 <= s <= 1 for s in got) and got[0] == got[1] == got[2]
    assert math.isfinite(model.prior)
    with pytest.raises(Exception):
        P.fit(docs.drop("text"), none)


def test_risk_is_the_literal_one_and_the_fit_lowers_it():
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(1, 1, (300, 2)), np.concatenate([rng.normal(1, 1, (150, 2)), rng.normal(-1, 1, (150, 2))])
    prior = 0.5
    loss = lambda z: math.log(1 + math.exp(-z))

    def literal(net):
        fp, fu = [float(net.margin(r[None])[0]) for r in pos], [float(net.margin(r[None])[0]) for r in unl]
        plus = prior * sum(loss(z) for z in fp) / len(fp)
        minus = sum(loss(-z) for z in fu) / len(fu) - prior * sum(loss(-z) for z in fp) / len(fp)
        assert P.pu_risk(np.array(fp), np.array(fu), prior) == pytest.approx((plus, minus))
        return plus + max(0.0, minus)

    net = P._fit_network(pos, unl, prior)
    blank = P.Scorer(net.mean, net.scale, 0 * net.hidden, 0 * net.hidden_bias, 0 * net.out, 0.0, prior)
    assert literal(blank) == pytest.approx(math.log(2)) and literal(net) < 0.75 * literal(blank)


def test_sample_does_not_depend_on_order(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    from pyspark.sql import functions as F
    learn = P.fold("doc_id", 4) != 2
    a = P.sample(docs, labels, "doc_id", "text", learn, 100)
    b = P.sample(docs.unionByName(docs.where("doc_id < 5")).dropDuplicates(["doc_id"]).orderBy(F.rand(1)).repartition(7), labels.repartition(3), "doc_id", "text", learn, 100)
    assert len(a[0]) == len(a[1]) == 100 and all(np.array_equal(x, y) for x, y in zip(a, b))
