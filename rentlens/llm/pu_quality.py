"""Quality classifier learnt from trusted positives and unlabelled text (non-negative PU risk)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rentlens.llm.shared import fold, text_of

#: Most rows of each kind that the fit reads: trusted positives and unlabelled documents.
SAMPLE_ROWS = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 24, 60, 512, 0.01, 1e-3, 7
#: Words looked at together where repetition is measured, so that it does not depend on the length of the text.
WINDOW = 100
SYMBOLS = b"!#$%&*|<>{}[]()/\\:;@=_+-~^\"'`.,?"

_CLASS = np.full(256, 6)
for _name, _members in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13), (32,), range(128, 256))):
    _CLASS[list(_members)] = _name


def features(text: str) -> np.ndarray:
    """Shares of byte classes and symbols, word shapes and repetition; a fixed small number of doubles."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = [words[i:i + WINDOW] for i in range(0, len(words), WINDOW)]
    distinct = sum(len(set(w)) for w in windows) / n
    top = sum(max(Counter(w).values()) for w in windows) / n
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    ends = Counter(w[-1:] for w in words)
    letters = max(1, counts[65:91].sum() + counts[97:123].sum())
    shape = [math.log1p(len(words)), sum(map(len, words)) / n / 10, distinct, top, repeats, counts[65:91].sum() / letters,
             sum(c for e, c in ends.items() if not e.isalnum() and e[0] < 128) / n, sum(1 for w in words if len(w) == 1) / n,
             math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(max(map(len, words), default=0))]
    by_class = np.bincount(_CLASS, weights=counts, minlength=7) / size
    # square roots spread small shares out: one symbol a word and one a page are far apart
    return np.concatenate([shape, np.sqrt(by_class), np.sqrt(counts[list(SYMBOLS)] / size)])


@dataclass(frozen=True)
class Scorer:
    """A small network over standardised features; ``prior`` is the estimated share of positives."""
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float
    fitted: bool = True

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def score(self, texts) -> np.ndarray:
        x = np.stack([features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the PU risk of margins under the logistic loss: prior times the positives' risk, and the risk on
    negatives, estimated as that of the unlabelled rows less that of the positives among them (it may fall below zero,
    where the non-negative risk counts it as zero)."""
    return prior * float(_softplus(-positive).mean()), float(_softplus(unlabelled).mean() - prior * _softplus(positive).mean())


def _fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Scorer:
    """Minimises the non-negative PU risk of Kiryo et al. (2017) with the logistic loss, or, without a prior, the
    plain risk of telling positives from unlabelled rows.

    Where the estimated risk on negatives falls below zero, the step goes up its gradient instead.
    """
    rng = np.random.default_rng(SEED)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-6
    norm = lambda x: np.clip((x - mean) / scale, -6, 6)
    p_all, u_all = norm(positive), norm(unlabelled)
    d = p_all.shape[1]
    params = [rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(u_all))
        for start in range(0, len(order), BATCH):
            u = u_all[order[start:start + BATCH]]
            p = p_all[rng.integers(0, len(p_all), len(u))]
            hp, hu = np.tanh(p @ params[0] + params[1]), np.tanh(u @ params[0] + params[1])
            fp, fu = hp @ params[2] + params[3], hu @ params[2] + params[3]
            if prior is None:
                gp, gu = -_sigmoid(-fp) / len(p), _sigmoid(fu) / len(u)
            elif pu_risk(fp, fu, prior)[1] >= 0:
                gp, gu = -prior * _sigmoid(-fp) / len(p) - prior * _sigmoid(fp) / len(p), _sigmoid(fu) / len(u)
            else:
                gp, gu = prior * _sigmoid(fp) / len(p), -_sigmoid(fu) / len(u)
            dp, du = np.outer(gp, params[2]) * (1 - hp**2), np.outer(gu, params[2]) * (1 - hu**2)
            grads = [p.T @ dp + u.T @ du + DECAY * params[0], dp.sum(0) + du.sum(0), hp.T @ gp + hu.T @ gu + DECAY * params[2], np.array([gp.sum() + gu.sum()])]
            step += 1
            rate = RATE * 0.5 * (1 + math.cos(math.pi * epoch / EPOCHS))
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Scorer(mean, scale, params[0], params[1], params[2], float(params[3][0]), prior or 0.5)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled rows.

    A classifier of positives against unlabelled rows is fitted on one half of each. On the other half, any set of
    rows holds at least prior times its share of positives, so the smallest ratio of the two shares over the sets
    "score above t" estimates the prior from above. Sets with fewer than half of the positives are left out, their
    ratio being noise.
    """
    net = _fit_network(positive[::2], unlabelled[::2], None)
    sp, su = np.sort(net.margin(positive[1::2])), np.sort(net.margin(unlabelled[1::2]))
    cuts = np.quantile(sp, np.linspace(0, 0.5, 51))
    above = lambda s: 1 - np.searchsorted(s, cuts) / max(1, len(s))
    u, p = np.maximum(above(su), 1e-9), above(sp)
    # one standard error up, since the smallest of many noisy ratios lies too low
    error = np.sqrt((1 - u) / (u * len(su)) + (1 - p) / (p * len(sp)))
    return float(np.clip((u / p * (1 + error)).min(), 0.05, 0.99))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, learn: Column, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most ``rows`` trusted positives and ``rows`` unlabelled documents, the first by hash of the id,
    then id, then features, so that no order of arrival counts. Only features leave the tasks that read the texts."""
    # the side that is broadcast holds at most ``rows`` ids
    trusted = labels.where(learn & (F.col("quality") == 1)).select(F.col(id_col).alias("_id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("t"))
    kind = texts.schema["_id"].dataType.simpleString()
    # a share of the ids that surely holds ``rows`` documents where there are as many; the order settles which
    wanted = (rows + 8 * math.sqrt(rows)) / max(1, docs.count())
    buckets = 1 << 30
    place = F.pmod(F.xxhash64("_id", F.lit("unlabelled")), F.lit(buckets))
    some = texts.where(place < math.ceil(min(1.0, wanted) * buckets))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_id": b["_id"], "x": [features(t) for t in b["t"]]})

    featured = lambda df: df.mapInPandas(run, f"_id {kind}, x array<double>")
    known = featured(texts.join(F.broadcast(trusted), "_id", "left_semi")).groupBy("_id").agg(F.min("x").alias("x"))
    some = featured(some).orderBy(place, "_id", "x").limit(rows)
    # rows arrive in any order; sorted, the fit does not depend on it
    matrix = lambda df: np.array(sorted(map(tuple, df.select("x").toPandas()["x"]))).reshape(-1, len(features("")))
    rng = np.random.default_rng(SEED)
    return rng.permutation(matrix(known)), rng.permutation(matrix(some))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold_mod: int = 4, held_out: int = 2, rows: int = SAMPLE_ROWS) -> Scorer:
    """Learns from positives outside the held-out fold and from unlabelled documents.

    Negative labels are not used. The fit reads a bounded sample (``rows`` of each kind) into the driver, which is
    all that ever gets there; the same input gives the same model. With fewer than 4 of either kind there is no
    model (``fitted`` is false) and every text scores the same one half.
    """
    positive, unlabelled = sample(docs, labels, id_col, text_col, fold(id_col, fold_mod) != held_out, rows)
    if len(positive) < 4 or len(unlabelled) < 4:
        d = len(features(""))
        return Scorer(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0, 0.5, fitted=False)
    return _fit_network(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(model: Scorer, text_col: str = "text") -> Column:
    """Probability that a text is of good quality. Only the text goes in; null counts as empty."""
    @pandas_udf("double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(t) if len(t) else [], dtype="float64")
    return run(text_of(text_col))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that score ``threshold`` or more, with their columns.

    Null texts count as empty; rows are judged one by one, so repeated rows share a verdict; an empty table stays
    empty. Where too few positives or documents are there to fit a model, nothing is known and all rows stay.
    """
    model = fit(docs, labels, id_col, text_col, **options)
    return docs.where(score(model, text_col) >= threshold) if model.fitted else docs
