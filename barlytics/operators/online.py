"""Ordered replays per key: online models.

A replay reads the rows of a key in order and keeps a small state. Rows are
hash-partitioned by key, sorted inside the partition and streamed in Arrow
batches, so memory holds one batch however long a key is. Keys run in parallel;
one model is sequential by definition, so rows are reduced before the replay wherever
the rule allows it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T


def replay(
    df: DataFrame, keys: list[str], order: list[str], start: Callable[[], dict],
    step: Callable[[dict, tuple], tuple | None], schema: T.StructType | str,
) -> DataFrame:
    """Run ``step(state, row) -> output row or None`` over each key in order.

    ``row`` is a namedtuple of the input columns; the state lives as long as
    the key. Output rows follow ``schema``.
    """
    names = [f.name for f in (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields]
    key_at = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name="Row"):
                key = tuple(row[i] for i in key_at)
                if key != current:
                    current, state = key, start()
                made = step(state, row)
                if made is not None:
                    out.append(made)
            yield pd.DataFrame(out, columns=names)

    ready = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ready.mapInPandas(run, schema)


def _dot(w, x) -> float:
    return float(np.dot(w, np.asarray(x, dtype=float)))


def _sgd(state: dict, x, scaled_error: np.ndarray | float, base: float, decay: float = 0.001) -> None:
    """One step on the weights; the bias (first weight) is not decayed."""
    rate = base / np.sqrt(1 + state["n"] / 100)
    shrink = decay * state["w"]
    shrink[0] = 0.0
    state["w"] = state["w"] + rate * (scaled_error - shrink)
    state["n"] += 1


def new_model(size: int = 7) -> Callable[[], dict]:
    return lambda: {"n": 0, "w": np.zeros(size)}


def probability(w, x) -> float:
    z = max(-30.0, min(30.0, _dot(w, x)))
    return 1.0 / (1.0 + np.exp(-z))


def learn_label(state: dict, x, y: float) -> None:
    x = np.asarray(x, dtype=float)
    _sgd(state, x, (y - probability(state["w"], x)) * x, 0.05)


def forecast(w, x, limit: float = 2.0) -> float:
    return max(-limit, min(limit, _dot(w, x)))


def learn_reward(state: dict, x, reward: float) -> None:
    x = np.asarray(x, dtype=float)
    error = max(-3.0, min(3.0, reward - forecast(state["w"], x)))
    _sgd(state, x, error * x / max(1.0, float(np.dot(x, x))), 0.15)


def _learned(df: DataFrame, keys, order, known: str, label: str, outputs: list[T.StructField], learn: Callable, show: Callable) -> DataFrame:
    """Rows with ``show(state, x)`` of the model that knows the labels available by then.

    Each row gives two events: its own, at the first order column, and its label,
    at ``known``. Labels that become known at the time of a row come before it; a
    null ``known`` or label is never learned.
    """
    keys, order = list(keys), list(order)
    event = lambda at, y: df.select(
        *keys, F.col(at).alias("_at"), F.lit(y is None).alias("_scores"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        "id", "x", (F.lit(None) if y is None else F.col(y)).cast("double").alias("_y"),
    )
    events = event(order[0], None).unionByName(event(known, label).filter(F.col("_at").isNotNull() & F.col("_y").isNotNull()))
    schema = T.StructType([events.schema[k] for k in keys] + [events.schema["id"], *outputs, T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def step(state, row):
        if not row[scores]:
            learn(state, row.x, row[y_at])
            return None
        return (*row[:len(keys)], row.id, *show(state, row.x), state["w"].tolist())

    scores, y_at = events.columns.index("_scores"), events.columns.index("_y")
    return replay(events, keys, ["_at", "_scores", *[f"_o{i}" for i in range(len(order))], "id"], new_model(), step, schema)


def online_logistic(df: DataFrame, keys, order, known: str, warmup: int = 30) -> DataFrame:
    """Score every row with the labels that are known by then.

    ``df``: keys, order columns (time first), ``id, x (array<double>), y`` and the
    time at which ``y`` becomes known. Adds the number of labels learned and
    the weights that made the score; no score before ``warmup`` labels.
    """
    show = lambda state, x: (probability(state["w"], x) if state["n"] >= warmup else None, state["n"])
    outputs = [T.StructField("score", T.DoubleType()), T.StructField("model_n", T.LongType())]
    return _learned(df, keys, order, known, "y", outputs, learn_label, show)


def online_reward_regression(df: DataFrame, keys, order, known: str) -> DataFrame:
    """Forecast every reward with the rewards that are known by then."""
    show = lambda state, x: (forecast(state["w"], x), state["n"])
    outputs = [T.StructField("forecast", T.DoubleType()), T.StructField("forecast_n", T.LongType())]
    return _learned(df, keys, order, known, "reward_r", outputs, learn_reward, show)


def model_hash(weights: str = "weights", n: str = "model_n"):
    """Hash of a model state; stable inside this library."""
    return F.sha2(F.to_json(F.struct(F.col(n).alias("n"), F.col(weights).alias("weights"))), 256)
