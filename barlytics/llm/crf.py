"""A linear-chain conditional random field with two labels over string features."""

from __future__ import annotations

import math
import random
from typing import NamedTuple

import numpy as np


class Model(NamedTuple):
    #: Score of label 1 against label 0, by feature.
    weights: dict[str, float]
    #: Score of each pair of neighbouring labels, 0-0, 0-1, 1-0, 1-1.
    steps: tuple[float, float, float, float]
    #: Score of label 1 at the begin and at the end.
    begin: float
    end: float


def viterbi(scores: list[float], model: Model) -> list[int]:
    """The likeliest labels of a chain with the given scores of label 1."""
    if not scores:
        return []
    s00, s01, s10, s11 = model.steps
    a, b = 0.0, scores[0] + model.begin
    back = []
    for s in scores[1:]:
        from0, from1 = b + s10 > a + s00, b + s11 > a + s01
        a, b, row = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + s, (from0, from1)
        back.append(row)
    label = int(b + model.end > a)
    labels = [label]
    for row in reversed(back):
        label = int(row[label])
        labels.append(label)
    return labels[::-1]


def marginals(scores: np.ndarray, steps: np.ndarray, begin: float, end: float) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels of each place, and of the label pairs summed over the chain."""
    n = len(scores)
    emit = np.stack([np.zeros(n), scores], axis=1)
    emit[0, 1] += begin
    emit[-1, 1] += end
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = emit[0]
    for t in range(1, n):
        forward[t] = emit[t] + np.logaddexp(forward[t - 1][0] + steps[0], forward[t - 1][1] + steps[1])
    for t in range(n - 2, -1, -1):
        right = emit[t + 1] + backward[t + 1]
        backward[t] = np.logaddexp(steps[:, 0] + right[0], steps[:, 1] + right[1])
    total = np.logaddexp(*forward[-1])
    single = np.exp(forward + backward - total)
    pairs = np.zeros((2, 2))
    for t in range(1, n):
        pairs += np.exp(forward[t - 1][:, None] + steps + (emit[t] + backward[t])[None, :] - total)
    return single, pairs


def train(chains: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4, seed: int = 1) -> Model:
    """Maximum likelihood by AdaGrad over chains of (features of each place, labels)."""
    names = sorted({f for features, _ in chains for place in features for f in place})
    number = {f: i for i, f in enumerate(names)}
    data = [([np.array([number[f] for f in place]) for place in features], np.array(labels)) for features, labels in chains if labels]
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-6)
    steps, s2 = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    ends, e2 = np.zeros(2), np.full(2, 1e-6)
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(data)
        for places, labels in data:
            single, pairs = marginals(np.array([w[p].sum() for p in places]), steps, *ends)
            error = labels - single[:, 1]
            at = np.concatenate(places)
            used, inverse = np.unique(at, return_inverse=True)
            g = np.bincount(inverse, np.repeat(error, [len(p) for p in places])) - l2 * w[used]
            g2[used] += g * g
            w[used] += rate * g / np.sqrt(g2[used])
            seen = np.zeros((2, 2))
            np.add.at(seen, (labels[:-1], labels[1:]), 1)
            for value, square, gradient in ((steps, s2, seen - pairs), (ends, e2, error[[0, -1]])):
                square += gradient * gradient
                value += rate * gradient / np.sqrt(square)
    kept = {f: float(w[i]) for f, i in number.items() if not math.isclose(w[i], 0, abs_tol=1e-4)}
    return Model(kept, tuple(steps.ravel().tolist()), *ends.tolist())
