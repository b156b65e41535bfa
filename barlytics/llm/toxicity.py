"""Toxicity scores: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features are words, neighbouring pairs and pairs with one word between, hashed to a
fixed number of places and counted once per text. Every coordinate has its own rate,
and the L1 term leaves few weights, so what tasks receive is small: at most ``PLACES``
numbers, in practice some hundred.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlytics.llm.tables import SLICE, drawn, holds, release, slices, strings

BITS = 20
PLACES = 1 << BITS
#: Expected number of labelled rows that the model is fitted on, at most.
MAX_TRAIN = 16_000
#: Rate, its smoothing, the two penalties, passes, and the weight of a toxic row.
ALPHA, BETA, L1, L2, EPOCHS, POSITIVE = 2.0, 1.0, 10.0, 1.0, 4, 4.0

_WORD = re.compile(r"\w+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Words whose hash a worker remembers.
REMEMBERED = 200_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = zlib.crc32(word.encode())
        if len(self) < REMEMBERED:
            self[word] = h
        return h


_hashes = _Hashes()


def _forget() -> None:
    _hashes.clear(), _models.clear()


def places(text: str) -> np.ndarray:
    """Places of a text's features, repeats included."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)) + np.uint64(1)
    first = h * _MIX[0]
    keys = [first, first[:-1] * _MIX[1] + h[1:] * _MIX[2], first[:-2] * _MIX[3] + h[2:] * _MIX[1]]
    key = np.concatenate(keys)
    key ^= key >> np.uint64(29)
    return ((key * _MIX[2]) >> np.uint64(64 - BITS)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal; weights are zero where the sum of gradients is within L1."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)  # the last place is the bias

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return float(-self.z[PLACES] / ((self.beta + np.sqrt(self.n[PLACES])) / self.alpha))

    def learn(self, at: np.ndarray, y: int) -> None:
        w, b = self.weights(at), self.bias()
        g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y) * (POSITIVE if y else 1.0)
        for i, v in ((at, w), (PLACES, b)):
            sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
            self.z[i] += g - sigma * v
            self.n[i] += g * g


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_train: int = MAX_TRAIN) -> dict[int, float]:
    """Non-zero weights by place, the bias under ``PLACES``; empty without labelled rows.

    Rows are drawn by a hash of their doc_id, at a rate that makes ``max_train`` the
    expected number. They are few, so one task goes through them in the order of that
    hash. Rows without label and held-out rows never take part; a doc_id with several
    labels counts with the largest, one with several texts with the first in order, so
    repeated rows do not outweigh others and the bound holds for what the task keeps.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    draw = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    rate = min(1.0, max_train / max(known.count(), 1))
    rows = known.filter(drawn(draw, rate)).join(docs.select("doc_id", "text"), "doc_id").filter(F.col("text").isNotNull())

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds("toxicity", _forget)
        seen, last = [], None
        for part in slices(batches):
            for doc, t, y in zip(part["doc_id"].to_pylist(), strings(part["text"]), part["__y"].to_pylist()):
                if doc != last:
                    seen.append((np.unique(places(t)).astype(np.int32), y))
                last = doc
        model = Ftrl()
        for _ in range(EPOCHS if seen else 0):
            for at, y in seen:
                model.learn(at, y)
        w = model.weights(np.arange(PLACES))
        at = np.flatnonzero(w)
        if seen:
            at, w = np.append(at, PLACES), np.append(w[at], model.bias())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w, pa.float64())], ["place", "weight"])

    one = rows.select("text", "__y", draw.alias("__h"), "doc_id").repartition(1).sortWithinPartitions("__h", "doc_id", "text")
    return {r["place"]: r["weight"] for r in one.select("doc_id", "text", "__y").mapInArrow(train, "place long, weight double").collect()}


def _score(texts: pa.Array, model: dict[int, float]) -> pa.Array:
    holds("toxicity", _forget)
    weights, bias = _dense(model)
    release()
    out = []
    for i in range(0, len(texts), SLICE):
        for text in strings(texts.slice(i, SLICE)):
            at = places(text)
            at = np.unique(at[weights[at] != 0])
            out.append(weights[at].sum() + bias)
    return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, dtype=float), -30, 30))), pa.float64())


_models: dict[int, tuple[dict, np.ndarray, float]] = {}


def _dense(model: dict[int, float]) -> tuple[np.ndarray, float]:
    """The weights as an array, kept while a task uses the same model."""
    if id(model) not in _models:
        weights = np.zeros(PLACES + 1)
        for place, w in model.items():
            weights[place] = w
        _models.clear()
        _models[id(model)] = (model, weights[:PLACES], float(weights[PLACES]))
    return _models[id(model)][1:]


def score(text: Column, model: dict[int, float]) -> Column:
    """Probability of a toxic text; a null or empty text has the score of the bias."""

    def run(texts: pa.Array) -> pa.Array:
        return _score(texts, model)

    return F.arrow_udf(run, "double").asNondeterministic()(text.cast("string"))
