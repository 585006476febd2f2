"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other; a later model gets, besides the words,
the log-odds that earlier models gave.  While it is trained those come from out-of-fold
predictions, so it sees them as unsure as they will be on new documents.

A document's features are its words and the beginnings of its words (``PREFIXES``
letters), each present or not.  The features that separate a category best, by the z-score
of their log-odds ratio, enter its model, scaled by that ratio.

Defined results: a text that is null or has no letter gets the probabilities of a text
without any known feature; documents without a label are predicted all the same; of
several labels of one document a positive one counts; a category without both kinds of
labels has the constant probability of its share (0 without any label); repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.letters import batches, runs, span_hash
from tidemark.llm.shared import saved
from tidemark.llm.words import mix

#: At most so many labelled documents are learned from, those with the least hash of their id.
FIT_DOCUMENTS = 6000
FEATURES = 400
CANDIDATES = 2000
FOLDS = 3
ROUNDS = 120
DECAY = 1e-5
PREFIXES = (3, 4, 5, 6, 7)
THRESHOLD = 0.5

_SIEVE = 1 << 20


class Linear(NamedTuple):
    keys: np.ndarray  # sorted 64-bit features
    weights: np.ndarray
    chain: np.ndarray  # of the log-odds of the categories before
    intercept: float


def features(texts: list[str], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) without repeats; with ``keep`` only those features."""
    sieve = None
    if keep is not None:
        sieve = np.zeros(_SIEVE, bool)
        sieve[keep & np.uint64(_SIEVE - 1)] = True
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for run in runs(texts):
        sums = run.hashes()
        size = run.end - run.start
        for length in (0, *PREFIXES):  # 0: the word
            use = slice(None) if not length else np.flatnonzero(size >= length)
            text, start = run.text[use], run.start[use]
            end = start + length if length else run.end
            hashed = span_hash(sums, start, end) ^ mix(np.uint64([length + 1]))
            if sieve is not None:
                near = sieve[hashed & np.uint64(_SIEVE - 1)]
                text, hashed = text[near], hashed[near]
                exact = np.isin(hashed, keep)
                text, hashed = text[exact], hashed[exact]
            found.append((text, hashed))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, hashed = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])] if len(text) else np.zeros(0, bool)
    return text[new], hashed[new]


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _fit_linear(doc: np.ndarray, key: np.ndarray, before: np.ndarray, y: np.ndarray, most: int) -> Linear:
    """Logistic regression by accelerated gradient descent; doc numbers index ``y`` and ``before``."""
    positive, n = y.sum(), len(y)
    if positive in (0, n):
        p = positive / n if n else 0.0
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(before.shape[1]), float(_log_odds(np.array(p))))
    keys, at = np.unique(key, return_inverse=True)
    with_ = np.bincount(at, weights=y[doc], minlength=len(keys)) + 0.5
    without = np.bincount(at, weights=1 - y[doc], minlength=len(keys)) + 0.5
    ratio = np.log(with_ / (positive + 1)) - np.log(without / (n - positive + 1))
    z = np.where(with_ + without > 4, np.abs(ratio) / np.sqrt(1 / with_ + 1 / without), 0)
    best = np.sort(np.lexsort((keys, -z))[: min(most, (z > 0).sum())])
    place = np.full(len(keys), -1)
    place[best] = np.arange(len(best))
    column = place[at]
    x = np.zeros((n, len(best) + before.shape[1] + 1), np.float32)
    x[doc[column >= 0], column[column >= 0]] = ratio[best][column[column >= 0]]
    x[:, len(best) : -1] = before
    x[:, -1] = 1
    w = np.zeros(x.shape[1], np.float32)
    w[: len(best)] = 0.1
    w[-1] = _log_odds(np.array(positive / n))
    target, held = y.astype(np.float32), np.full(len(w), DECAY, np.float32)
    held[-1] = 0
    square = np.ones(len(w), np.float32)
    for _ in range(30):  # the largest curvature, by power iteration
        square = x.T @ (x @ (square / np.linalg.norm(square)))
    step = np.float32(0.8 / (np.linalg.norm(square) / (4 * n) + DECAY))
    ahead, momentum = w, 1.0
    for _ in range(ROUNDS):
        slope = x.T @ (_sigmoid(x @ ahead) - target) / np.float32(n) + held * ahead
        following = ahead - step * slope
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = following + np.float32((momentum - 1) / faster) * (following - w)
        w, momentum = following, faster
    w = w.astype(float)
    return Linear(keys[best], w[: len(best)] * ratio[best], w[len(best) : -1], float(w[-1]))


def _apply(model: Linear, doc: np.ndarray, key: np.ndarray, before: np.ndarray) -> np.ndarray:
    out = before @ model.chain + model.intercept
    if len(model.keys):
        at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
        hit = model.keys[at] == key
        out = out + np.bincount(doc[hit], weights=model.weights[at[hit]], minlength=len(before))
    return out


def fit_chain(doc: np.ndarray, key: np.ndarray, labels: np.ndarray, folds: int = FOLDS, most: int = FEATURES) -> list[Linear]:
    """One model per column of ``labels``; each learns from out-of-fold log-odds of those before it."""
    n = len(labels)
    fold = np.arange(n) % folds
    before = np.zeros((n, 0))
    chain = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        chain.append(_fit_linear(doc, key, before, y, most))
        out = np.zeros(n)
        for f in range(folds) if k + 1 < labels.shape[1] else ():
            rows = np.flatnonzero(fold != f)
            number = np.full(n, -1)
            number[rows] = np.arange(len(rows))
            inside = number[doc] >= 0
            part = _fit_linear(number[doc[inside]], key[inside], before[rows], y[rows], most)
            out = np.where(fold == f, _apply(part, doc, key, before), out)
        before = np.c_[before, np.clip(out, -9, 9)]
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], fit_documents: int = FIT_DOCUMENTS, seed: int = 1) -> list[Linear]:
    """Learn the categories, conditions on the columns of ``labels`` (doc_id, ...), in their order.

    The rows that are learned from, at most ``fit_documents`` with a few features each, meet in
    one task, and only the models come back; features travel as bytes of 64-bit numbers.
    """
    names = list(categories)
    wanted = labels.select("doc_id", *(F.coalesce(c.cast("int"), F.lit(0)).alias(f"y{i}") for i, c in enumerate(categories.values()))).where("doc_id is not null")
    wanted = wanted.groupBy("doc_id").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))))
    wanted = wanted.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(fit_documents)
    texts = saved(docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"]))
    ys = [f"y{i}" for i in range(len(names))]
    kept = texts.sparkSession.sparkContext.broadcast(_candidates(texts, ys))

    def extract(parts):
        for part in parts:
            for first, held in batches(part["text"].tolist()):
                text, found = features(held, kept.value)
                ends = np.searchsorted(text, np.arange(len(held) + 1))
                yield part.iloc[first : first + len(held)][["doc_id", *ys]].assign(found=[found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id", ignore_index=True)
        key = np.frombuffer(b"".join(rows["found"]), np.uint64)
        doc = np.repeat(np.arange(len(rows)), rows["found"].map(len).to_numpy() // key.itemsize)
        chain = fit_chain(doc, key, rows[ys].to_numpy())
        return pd.DataFrame([(k, m.keys.tobytes(), m.weights.tobytes(), m.chain.tobytes(), m.intercept) for k, m in enumerate(chain)], columns=["k", "keys", "weights", "chain", "intercept"])

    schema = ", ".join(["doc_id long", *(f"{y} int" for y in ys), "found binary"])
    models = texts.mapInPandas(extract, schema).groupBy().applyInPandas(learn, "k int, keys binary, weights binary, chain binary, intercept double")
    found = [Linear(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["weights"]), np.frombuffer(r["chain"]), r["intercept"]) for r in sorted(models.collect(), key=lambda r: r["k"])]
    kept.unpersist()
    return found or fit_chain(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, len(ys)), np.int64))


def _candidates(texts: DataFrame, ys: list[str]) -> np.ndarray:
    """The features that enter the choice of the models: for each category ``CANDIDATES`` that separate it best in all rows."""

    def count(parts):
        for part in parts:
            for first, held in batches(part["text"].tolist()):
                text, found = features(held)
                keys, at = np.unique(found, return_inverse=True)
                labels = part.iloc[first : first + len(held)][ys].to_numpy(float)
                sums = {y: np.bincount(at, weights=labels[text, i], minlength=len(keys)).astype(np.int64) for i, y in enumerate(ys)}
                yield pd.DataFrame({"feature": keys.view(np.int64), "n": np.bincount(at, minlength=len(keys)), **sums})

    schema = ", ".join(["feature long", "n long", *(f"{y} long" for y in ys)])
    counts = texts.mapInPandas(count, schema).groupBy("feature").agg(F.sum("n").alias("n"), *(F.sum(y).alias(y) for y in ys)).where("n >= 4")
    counts = saved(counts)
    totals = texts.agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).first()
    chosen = []
    for y in ys:
        positive, n = totals[y] or 0, totals["n"]
        with_, without = F.col(y) + 0.5, F.col("n") - F.col(y) + 0.5
        ratio = F.log(with_ / (positive + 1)) - F.log(without / (n - positive + 1))
        z = F.abs(ratio) / F.sqrt(1 / with_ + 1 / without)
        chosen += [r.feature for r in counts.orderBy(z.desc(), "feature").select("feature").limit(CANDIDATES).collect()]
    return np.unique(np.array(chosen, np.int64)).view(np.uint64)


def predict(docs: DataFrame, chain: list[Linear], names: list[str]) -> DataFrame:
    """The columns of ``docs`` with p_<category> for every category; a column that has such a name already is replaced."""
    chain_of = docs.sparkSession.sparkContext.broadcast(chain)
    columns = [f"p_{name}" for name in names]
    base = docs.drop(*columns).withColumn("text", F.col("text").cast("string"))
    place = base.columns.index("text")

    def run(parts):
        chain = chain_of.value
        keep = np.unique(np.concatenate([np.zeros(0, np.uint64), *(m.keys for m in chain)]))
        for part in parts:
            odds = [np.zeros((0, len(chain)))]
            for _, held in batches(part.column(place).to_pylist()):
                doc, key = features(held, keep)
                before = np.zeros((len(held), 0))
                for model in chain:
                    before = np.c_[before, np.clip(_apply(model, doc, key, before), -50, 50)]
                odds.append(before)
            found = _sigmoid(np.concatenate(odds))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[:, k]) for k in range(len(columns)))], names=[*part.schema.names, *columns])

    return base.mapInArrow(run, T.StructType([*base.schema, *(T.StructField(c, T.DoubleType()) for c in columns)]))


def categories() -> dict[str, Column]:
    """Conditions on the labels, in the order of the chain."""
    low, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return {"low_quality": low, "toxic": toxic, "toxic_low_quality": low & toxic}


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, the probabilities, and ``rejected``: whether the document is toxic.

    Columns of ``docs`` with the names of these are replaced.
    """
    wanted = categories()
    model = fit(docs, labels, wanted)
    return predict(docs, model, list(wanted)).withColumn("rejected", F.col("p_toxic") >= threshold)
