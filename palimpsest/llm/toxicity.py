"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each model sees the words of the text and the probabilities of
all earlier categories. While training, those earlier probabilities come from out-of-fold predictions, so a
later model learns how far they can be trusted on unseen text.

Features are the distinct words of a text and their beginnings of three to six letters, plus four shape
numbers (length, share of distinct words, word length, share of symbols). A fit keeps the words and
beginnings whose log odds between both classes are significant; a model is an L2-regularized logistic
regression over them.

The chain is fitted in one task on at most ``max_train`` labelled rows, chosen by a hash of their ids; that
bound is what makes the model small enough to send to every task. Scoring is one pass over whole texts
without a shuffle.

Defined results: null text is empty; documents need no label; a label row with a null label or id is not
used; several labels of one document count as toxic if any is, and as the lowest quality; repeated rows score
alike. Without labels, or with one class only, a category has its base rate for every text (0 without
labels).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TRAIN = 5000
FOLDS = 3
MIN_DOCS = 3
MIN_Z = 3.5
KEEP = 3000
STEPS = 300
L2 = 1e-3
SHAPE_L2 = 0.01
WORD_ENTRIES = 250_000
WORD = re.compile(r"\w+")
SHAPE = 4


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def word_features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in range(3, min(6, len(word)) + 1))]


def shape(text: str | None, words: list[str], distinct: int) -> list[float]:
    n = max(1, len(words))
    letters = sum(map(len, words))
    visible = max(1, len(text or "") - (text or "").count(" ") - (text or "").count("\n"))
    return [float(np.log1p(len(words))), distinct / n, letters / n, max(0.0, 1 - letters / visible)]


#: The chain over the given labels: poor text first, then toxic text, then text that is both.
CATEGORIES = ["low_quality", "toxic", "toxic_low_quality"]


def label_categories(labels: DataFrame) -> DataFrame:
    """The given labels (quality 0/1, toxic 0/1) as the categories of the chain, 0/1 each."""
    poor, toxic = 1 - F.col("quality"), F.col("toxic")
    return labels.select("doc_id", poor.alias("low_quality"), toxic.alias("toxic"), (poor * toxic).alias("toxic_low_quality"))


class Sparse:
    """Rows of feature numbers with values, as flat arrays."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n: int) -> None:
        self.rows, self.cols, self.values, self.n = rows, cols, values, n

    def take(self, rows: np.ndarray) -> Sparse:
        place = np.full(self.n, -1, np.int32)
        place[rows] = np.arange(len(rows), dtype=np.int32)
        keep = place[self.rows] >= 0
        return Sparse(place[self.rows[keep]], self.cols[keep], self.values[keep], len(rows))

    def select(self, features: np.ndarray, total: int) -> Sparse:
        place = np.full(total, -1, np.int32)
        place[features] = np.arange(len(features), dtype=np.int32)
        keep = place[self.cols] >= 0
        return Sparse(self.rows[keep], place[self.cols[keep]], self.values[keep], self.n)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.n) if len(self.rows) else np.zeros(self.n)

    def back(self, g: np.ndarray, d: int) -> np.ndarray:
        return np.bincount(self.cols, self.values * g[self.rows], d) if len(self.rows) else np.zeros(d)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def significant(x: Sparse, y: np.ndarray, total: int) -> np.ndarray:
    """Features whose presence speaks for either class beyond chance, the strongest first."""
    pos = np.bincount(x.cols, y[x.rows].astype(float), total)
    neg = np.bincount(x.cols, 1.0 - y[x.rows], total)
    p, n = y.sum(), (1 - y).sum()
    a, b, c, d = pos + 0.5, neg + 0.5, p - pos + 0.5, n - neg + 0.5
    z = np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    z[pos + neg < MIN_DOCS] = 0
    best = np.argsort(-z, kind="stable")[:KEEP]
    return best[z[best] > MIN_Z]


def fit_linear(x: Sparse, dense: np.ndarray, y: np.ndarray, total: int) -> dict:
    """One model: feature numbers, weights, dense weights with their scale, bias."""
    rate = float(y.mean()) if len(y) else 0.0
    if rate in (0.0, 1.0):
        return {"constant": rate}
    chosen = significant(x, y, total)
    xs = x.select(chosen, total)
    mean, std = dense.mean(axis=0), dense.std(axis=0) + 1e-9
    z = (dense - mean) / std
    d, k, n = len(chosen), dense.shape[1], len(y)
    w, v, bias = np.zeros(d), np.zeros(k), float(np.log(rate / (1 - rate)))
    sw, sv, sb = np.full(d, 1e-8), np.full(k, 1e-8), 1e-8
    for _ in range(STEPS):
        g = (sigmoid(xs.dot(w) + z @ v + bias) - y) / n
        gw, gv, gb = xs.back(g, d) + L2 / n * w, g @ z + SHAPE_L2 * v, g.sum()
        sw, sv, sb = sw + gw**2, sv + gv**2, sb + gb**2
        w, v, bias = w - 0.5 * gw / np.sqrt(sw), v - 0.1 * gv / np.sqrt(sv), bias - 0.1 * gb / np.sqrt(sb)
    return {"features": chosen, "w": w, "v": v, "bias": bias, "mean": mean, "std": std}


def predict(model: dict, x: Sparse, dense: np.ndarray, total: int) -> np.ndarray:
    if "constant" in model:
        return np.full(x.n, model["constant"])
    return sigmoid(x.select(model["features"], total).dot(model["w"]) + (dense - model["mean"]) / model["std"] @ model["v"] + model["bias"])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities, half way to the next one below."""
    order = np.argsort(-p, kind="stable")
    ranked, hits = p[order], np.cumsum(y[order])
    if not len(p) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + hits[-1])
    f1[:-1][ranked[:-1] == ranked[1:]] = -1
    at = int(np.argmax(f1))
    below = ranked[at + 1] if at + 1 < len(p) else 0.0
    return float(min(0.9, max(0.1, (ranked[at] + below) / 2)))


def fit_chain(texts: list[str | None], labels: np.ndarray) -> list[dict]:
    """Models of all categories (columns of ``labels``), in order, with feature names."""
    names: dict[str, int] = {}
    rows, cols, values, dense = [], [], [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        distinct = set(words)
        found = Counter(names.setdefault(f, len(names)) for w in sorted(distinct) for f in word_features(w))
        rows.append(np.full(len(found), i, np.int32))
        cols.append(np.fromiter(found.keys(), np.int32, len(found)))
        values.append(np.log1p(np.fromiter(found.values(), np.float32, len(found))))
        dense.append(shape(text, words, len(distinct)))
    n, total = len(texts), len(names)
    x = Sparse(*(np.concatenate(a) if a else np.zeros(0, t) for a, t in ((rows, np.int32), (cols, np.int32), (values, np.float32))), n)
    del rows, cols, values
    often = np.flatnonzero(np.bincount(x.cols, minlength=total) >= MIN_DOCS)
    x, total, listed = x.select(often, total), len(often), list(names)
    names.clear()
    seen = np.array(dense, float).reshape(n, SHAPE)
    fold = np.arange(n) % FOLDS
    models = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        ahead = np.zeros(n)
        for f in range(FOLDS):
            train, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(train) and len(held):
                part = fit_linear(x.take(train), seen[train], y[train], total)
                ahead[held] = predict(part, x.take(held), seen[held], total)
        model = fit_linear(x, seen, y, total)
        model["threshold"] = best_threshold(ahead, y)
        if "features" in model:
            model["names"] = [listed[often[j]] for j in model.pop("features")]
        models.append(model)
        seen = np.column_stack([seen, ahead])
    return models


def fitted(docs: DataFrame, labels: DataFrame, categories: list[str], key: str, text: str, max_train: int) -> list[dict]:
    """Fit the chain in one task on a bounded sample of labelled rows; the driver gets the models."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts).sort_values(["_pick", "_text"], na_position="first")
            models = fit_chain(rows["_text"].tolist(), rows[categories].to_numpy())
            as_list = lambda v: v.tolist() if isinstance(v, np.ndarray) else v
            yield pd.DataFrame({"model": [json.dumps({k: as_list(v) for k, v in m.items()}) for m in models], "at": range(len(models))})

    sample = (
        labels.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), *categories)
        .groupBy("_key").agg(*[F.max(c).alias(c) for c in categories]).dropna()
        .withColumn("_pick", F.xxhash64("_key")).orderBy("_pick").limit(max_train)
    )
    # at most max_train slim rows: their size is bounded
    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).join(F.broadcast(sample), "_key")
    # rows of repeated ids stay within the bound, too
    got = rows.select("_pick", "_text", *categories).orderBy("_pick").limit(max_train).coalesce(1).mapInPandas(fit, "model string, at int").orderBy("at").collect()
    return [json.loads(r["model"]) for r in got] or [{"constant": 0.0}] * len(categories)


class Scorer:
    """Probabilities of all categories for one text after another."""

    def __init__(self, models: list[dict]) -> None:
        self.models = models
        self.places: dict[str, list[tuple[int, float]]] = {}
        for c, m in enumerate(models):
            for name, w in zip(m.get("names", ()), m.get("w", ())):
                self.places.setdefault(name, []).append((c, w))
        self.memo: dict[str, tuple[str, ...]] = {}

    def features(self, word: str) -> tuple[str, ...]:
        found = self.memo.get(word)
        if found is None:
            found = tuple(f for f in word_features(word) if f in self.places)
            if len(self.memo) < WORD_ENTRIES:
                self.memo[word] = found
        return found

    def score(self, text: str | None) -> list[float]:
        words = words_of(text)
        distinct = set(words)
        found: Counter = Counter()
        memo = self.memo
        for w in distinct:
            hits = memo.get(w)
            if hits is None:
                hits = self.features(w)
            if hits:
                found.update(hits)
        sums = [0.0] * len(self.models)
        for name in sorted(found):
            value = float(np.log1p(found[name]))
            for c, w in self.places[name]:
                sums[c] += w * value
        seen = shape(text, words, len(distinct))
        for s, m in zip(sums, self.models):
            if "constant" in m:
                p = m["constant"]
            else:
                z = s + m["bias"] + sum((x - a) / b * v for x, a, b, v in zip(seen, m["mean"], m["std"], m["v"]))
                p = float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))
            seen.append(p)
        return seen[SHAPE:]


def probabilities(text: Column, models: list[dict]) -> Column:
    """Array of category probabilities of a text."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(models)
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype=object)

    return of(text)


def scored(
    docs: DataFrame, labels: DataFrame, categories: list[str], decide: str, key: str = "doc_id", text: str = "text",
    max_train: int = MAX_TRAIN, threshold: float | None = None,
) -> DataFrame:
    """``docs`` with p_<category> for every category and ``rejected``: p of ``decide`` reaches ``threshold``
    (without one, the cut that was best out of fold)."""
    models = fitted(docs, labels, categories, key, text, max_train)
    if threshold is None:
        threshold = models[categories.index(decide)].get("threshold", 0.5)
    drop = {"_p", "rejected", *(f"p_{c}" for c in categories)}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in drop]
    p = F.col("_p")
    return docs.select(*keep, probabilities(F.col(text), models).alias("_p")).select(
        *keep, *[p[i].alias(f"p_{c}") for i, c in enumerate(categories)], (p[categories.index(decide)] >= threshold).alias("rejected")
    )
