"""Chronological evaluation of a classifier on a scored table."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from barlytics.functions.scalar import num
from barlytics.operators.blocks import POS, depth, prefix, with_position
from barlytics.operators.cohorts import exact_quantiles
from barlytics.operators.grid import floor_bucket
from barlytics.operators.gaps import cooldown
from barlytics.session import cut

HOUR = 3_600_000
THRESHOLDS = [round(0.35 + 0.01 * i, 3) for i in range(56)]


def clean_dataset(df: DataFrame, features: list[str], label: str, ret: str, ambiguous: str | None = None) -> DataFrame:
    """Drop ambiguous rows; features that are not finite numbers become 0."""
    missing = [c for c in [*features, label, ret] if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    if ambiguous and ambiguous in df.columns:
        df = df.filter(F.coalesce(F.col(ambiguous).cast("int"), F.lit(0)) == 0)

    def finite(c):
        v = num(F.col(c))
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)

    return df.withColumns(
        {**{c: finite(c) for c in features}, label: F.coalesce(num(F.col(label)).cast("int"), F.lit(0)), ret: num(F.col(ret), 0.0)}
    )


def split_bounds(df: DataFrame, time: str = "asof_ms", train: float = 0.6, val: float = 0.2, gap_ms: int = 72 * HOUR, chunk_ms: int = 4096 * HOUR) -> DataFrame:
    """One row with the four borders of the purged split over distinct times."""
    times = df.select(time).distinct()
    placed = with_position(times, [], time, floor_bucket(time, chunk_ms))
    n = F.col("_n")
    i = F.greatest(F.lit(1), F.floor(n * F.lit(train)))
    j = F.least(F.greatest(i + 1, F.floor(n * F.lit(train + val))), n - 1)
    total = times.agg(F.count(F.lit(1))).scalar()
    marked = placed.withColumn("_n", total).withColumns({"_i": i, "_j": j})
    b = marked.agg(
        F.max(F.when(F.col("pos") == F.col("_i"), F.col(time))).alias("val_start"),
        F.max(F.when(F.col("pos") == F.col("_j"), F.col(time))).alias("test_start"),
    )
    return b.select(
        (F.col("val_start") - gap_ms).alias("train_end"), "val_start", (F.col("test_start") - gap_ms).alias("val_end"), "test_start"
    )


def purged_split(df: DataFrame, time: str = "asof_ms", **kw) -> DataFrame:
    """Label rows train, val or test; rows inside the purge gaps drop out."""
    b = split_bounds(df, time, **kw)
    row = b.select(F.struct(*b.columns).alias("b")).scalar()
    t, c = F.col(time), lambda k: F.col(f"_b.{k}")
    side = F.when(t <= c("train_end"), "train").when(t.between(c("val_start"), c("val_end")), "val").when(t >= c("test_start"), "test")
    return df.withColumn("_b", row).withColumn("split", side).drop("_b").filter("split is not null")


#: Bins of a feature, as many as the trees would make themselves, and distinct rows for a task of a round.
BINS, TASK_ROWS = 32, 16_384


@dataclass(frozen=True)
class Classifier:
    """Boosted trees over the bins of each feature; ``edges`` has the bins' inner borders."""

    edges: list[list[float]]
    trees: GBTClassificationModel


def _binned(df: DataFrame, values: list[Column], edges: list[list[float]]) -> DataFrame:
    """Adds the vector ``features``: the bin of each value."""
    names, bins = ([f"_{kind}{i}" for i in range(len(values))] for kind in "vb")
    named = df.withColumns({n: v.cast("double") for n, v in zip(names, values)})
    splits = [[-math.inf, *e, math.inf] for e in edges]
    found = Bucketizer(splitsArray=splits, inputCols=names, outputCols=bins, handleInvalid="keep").transform(named)
    return found.withColumn("features", array_to_vector(F.array(*bins))).drop(*names, *bins)


def fit_classifier(
    train: DataFrame, features: list[str], label: str, max_iter: int = 300, depth: int = 4,
    min_rows: int = 40, step_size: float = 0.05, seed: int = 42,
) -> Classifier:
    """Boosted trees on the feature columns.

    Trees split between ``BINS`` bins of a feature in any case. Bins are made once, from all rows,
    and rows that agree in all bins and the label become one weighted row, so that the hundreds of rounds
    go through the distinct rows only. A leaf has at least ``min_rows`` rows, as a share of the weight.
    """
    shares = [i / BINS for i in range(1, BINS)]
    found = train.agg(*[F.percentile_approx(F.col(c).cast("double"), shares) for c in features]).first()
    # A border belongs to the bin above it; one at the least value would leave the bin below empty. A constant feature has any border.
    least = train.agg(*[F.min(F.col(c).cast("double")) for c in features]).first()
    edges = [sorted({e for e in of or [] if low < e < math.inf}) or [0.0] for of, low in zip(found, least)]
    rows = _binned(train, [F.col(c) for c in features], edges).select(vector_to_array("features").alias("bins"), F.col(label).cast("double").alias("label"))
    alike = cut(rows.groupBy("bins", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    distinct, n = alike.agg(F.count(F.lit(1)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    gbt = GBTClassifier(
        # Too few rows for two leaves: no split. The half row keeps rounding out of the comparison.
        maxIter=max_iter, maxDepth=depth if n >= 2 * min_rows else 0, minInstancesPerNode=1,
        minWeightFractionPerNode=(min_rows - 0.5) / n if n >= 2 * min_rows else 0.0, stepSize=step_size, seed=seed,
        featuresCol="features", labelCol="label", weightCol="weight",
    )
    data = alike.select(array_to_vector("bins").alias("features"), "label", "weight").repartition(distinct // TASK_ROWS + 1)
    return Classifier(edges, gbt.fit(data))


def _scored(model: Classifier, df: DataFrame, values: list[Column], out: str) -> DataFrame:
    scored = model.trees.transform(_binned(df, values, model.edges))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def predict(model: Classifier, df: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    return _scored(model, df, [F.col(c) for c in features], out)


def threshold_metrics(
    df: DataFrame, thresholds, p: str = "p", y: str = "y", ret: str = "ret", time: str = "asof_ms", symbol: str = "symbol",
    tie: str = "doc_id", gap_ms: int = 12 * HOUR, cost: float = 0.12,
) -> DataFrame:
    """Alerts with cooldown, precision, lift and returns at each threshold.

    ``thresholds`` is a list or an array column. Each row is repeated for the
    thresholds it reaches; the cooldown then runs per (threshold, symbol).
    """
    grid = F.array(*[F.lit(float(t)) for t in thresholds]) if not isinstance(thresholds, Column) else thresholds
    slim = df.select(symbol, time, tie, F.col(p).alias("_p"), y, ret).withColumn("_ts", grid)
    reached = slim.select(
        symbol, time, tie, y, ret, F.explode(F.filter("_ts", lambda t: t <= F.col("_p"))).alias("threshold")
    )
    kept = cut(cooldown(reached, ["threshold", symbol], time, gap_ms, tie))
    net = kept.withColumn("_net", F.col(ret) - cost)
    body = net.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("alerts"), F.avg(F.col(y).cast("double")).alias("precision"), F.avg("_net").alias("avg_return")
    ).join(exact_quantiles(net, "_net", [0.5], ["threshold"]).select("threshold", F.col("p50").alias("median_return")), "threshold")
    sums = df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("base")).alias("s")).scalar()
    every = df.select(grid.alias("_ts")).limit(1).select(F.explode("_ts").alias("threshold")).distinct()
    j = every.join(body, "threshold", "left").withColumn("_s", sums)
    return j.select(
        "threshold", F.coalesce(F.col("alerts"), F.lit(0)).alias("alerts"),
        (F.coalesce(F.col("alerts"), F.lit(0)) / F.col("_s.n")).alias("coverage"), "precision",
        F.when(F.col("_s.base") > 0, F.col("precision") / F.col("_s.base")).alias("lift"), "avg_return", "median_return",
    )


def choose_threshold(metrics: DataFrame, df: DataFrame, p: str = "p", min_alerts: int = 20) -> DataFrame:
    """Best eligible threshold, else the clipped 90 % quantile of the scores."""
    good = (F.col("alerts") >= min_alerts) & (F.col("avg_return") > 0)
    # Equal on all three: the lowest threshold, as a forward search would pick.
    rank = F.struct("precision", "avg_return", -F.col("coverage"), -F.col("threshold"))
    fallback = exact_quantiles(df, p, [0.9]).select(F.greatest(F.lit(0.5), F.least(F.lit(0.95), F.col("p90")))).scalar()
    return metrics.agg(
        F.max_by("threshold", F.when(good, rank)).alias("_t"), F.count_if(good).alias("eligible")
    ).select(F.coalesce("_t", fallback).alias("threshold"), "eligible")


def _by_score(df: DataFrame, p: str, y: str, keys) -> DataFrame:
    """Positives and negatives per distinct score (ties stay together)."""
    return df.groupBy(*keys, F.col(p).alias("_p")).agg(
        F.sum(F.col(y).cast("bigint")).alias("_pos"), F.sum(1 - F.col(y).cast("bigint")).alias("_neg")
    )


def roc_auc(df: DataFrame, p: str = "p", y: str = "y", by=()) -> DataFrame:
    """Area under the ROC curve from ranks; null with only one class."""
    by = list(by)
    scores = prefix(depth(_by_score(df, p, y, by), by, "_p"), by, "_p", F.col("_depth"), {"_below": ("_neg", "sum")}, few=True)
    won = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return scores.groupBy(*by).agg(F.sum(F.col("_pos") + F.col("_neg")).alias("n"), F.when(pairs > 0, won / pairs).alias("roc_auc"))


def average_precision(df: DataFrame, p: str = "p", y: str = "y", by=()) -> DataFrame:
    """Precision weighted by the recall each distinct score adds."""
    return _precision(_by_score(df, p, y, by), by)


def _precision(tally: DataFrame, by) -> DataFrame:
    by = list(by)
    rows = tally.withColumns({"_down": -F.col("_p"), "_all": F.col("_pos") + F.col("_neg")})
    cum = prefix(depth(rows, by, "_down"), by, "_down", F.col("_depth"), {"_tp": ("_pos", "sum"), "_seen": ("_all", "sum")}, few=True)
    precision = (F.col("_tp") + F.col("_pos")) / (F.col("_seen") + F.col("_all"))
    total = F.sum("_pos")
    return cum.groupBy(*by).agg(
        F.sum("_all").alias("n"), F.when(total > 0, F.sum(precision * F.col("_pos")) / total).alias("average_precision")
    )


def top_quantile_slices(df: DataFrame, qs=(0.90, 0.95, 0.98), p: str = "p", **kw) -> DataFrame:
    """Alert metrics at the score quantiles, labelled by the share on top."""
    points = cut(exact_quantiles(df, p, list(qs)))
    cut_points = F.array(*[F.col(f"p{int(round(q * 100))}") for q in qs])
    m = threshold_metrics(df, points.select(cut_points).scalar(), p, **kw)
    slices = F.array(*[F.lit(f"top_{int(round((1 - q) * 100))}pct") for q in qs])
    names = points.select(F.explode(F.arrays_zip(slices.alias("slice"), cut_points.alias("threshold"))).alias("z")).select("z.slice", "z.threshold")
    return names.join(m, "threshold")


#: Fixed values of the round function of ``shuffled_place``: a prime below 2**31 and three factors.
MIX_PRIME, MIX_A, MIX_B, MIX_C = 2_147_483_647, 1_103_515_245, 48_271, 69_621


def _mixed(x: int, salt: int) -> int:
    """A number below ``MIX_PRIME`` from two numbers."""
    line = (x * MIX_B + salt * MIX_C) % MIX_PRIME
    return (line * line + salt * MIX_A) % MIX_PRIME


def shuffle_rounds(n: int) -> int:
    """Rounds that mix ``n`` places: four for each bit of the number."""
    return 4 * max(n - 1, 1).bit_length()


def _folded(x: np.ndarray, times: int) -> np.ndarray:
    """The same remainders by ``MIX_PRIME`` in 31 bits, since 2**31 leaves 1; three folds end at ``MIX_PRIME`` or below."""
    for _ in range(times):
        x = (x & MIX_PRIME) + (x >> 31)
    return x


def _shuffled(x: np.ndarray, n: int, trial: int) -> np.ndarray:
    """The places that a trial gives to the places ``x``; numbers are below 2**47, so products fit 63 bits."""
    for r in range(1, shuffle_rounds(n) + 1):
        salt = trial * 1000 + r
        mirror = _mixed(salt, n) % n - x
        mirror += (mirror >> 63) & n
        line = _folded(np.maximum(x, mirror) * MIX_B + salt * MIX_C % MIX_PRIME, 2)
        mixed = _folded(line * line + salt * MIX_A % MIX_PRIME, 3)
        x = np.where((mixed >> 3 & 1).astype(bool) & (mixed != MIX_PRIME), mirror, x)
    return x


def shuffled_place(place: Column, n: int, trial: Column) -> Column:
    """Where a seeded permutation of the numbers below ``n`` takes ``place`` in a trial.

    Each round pairs a place with the one that mirrors it around a keyed point and swaps the pair
    or not, by a keyed bit of its larger member. A round is its own inverse, so the result is a
    permutation for every ``n``: nothing is sorted, and no number outside has to be walked back.
    The rounds of a batch are array operations: a row's dozens of rounds cost about a microsecond.
    """
    @F.pandas_udf("long")
    def places(place: pd.Series, trial: pd.Series) -> pd.Series:
        x, t = place.to_numpy(np.int64), trial.to_numpy(np.int64)
        out = np.empty_like(x)
        for one in np.unique(t):
            here = np.flatnonzero(t == one)
            out[here] = _shuffled(x[here], n, int(one))
        return pd.Series(out)

    return places(place.cast("bigint"), trial.cast("bigint"))


def importance(
    score: Callable[[DataFrame], DataFrame], df: DataFrame, features: list[str], y: str, order: str, repeats: int = 3,
    top: int | None = None, trials_at_once: int = 32,
) -> DataFrame:
    """Drop in average precision when one feature is shuffled among the rows.

    ``score`` adds ``p`` to rows with the features in the array ``_x``. ``order`` is a number,
    one for each row, that fixes the rows' numbering. The rows are numbered once; in a
    (feature, repeat) trial each row gives its value to the row at its ``shuffled_place``, so what
    moves for a trial is a number and a value for each row; both sides are shuffled, neither is broadcast.
    Groups of ``trials_at_once`` trials are done one after the other, which bounds the shuffled bytes. No rows: no result.
    """
    base = df.select(F.col(order).cast("bigint").alias("_o"), F.col(y).alias("_y"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"))
    base = cut(base)
    rows = cut(with_position(depth(base, [], "_o"), [], "_o", F.col("_depth"), few=True).drop("_depth", "_o"))
    n, trials = max(rows.count(), 1), len(features) * repeats
    which = F.floor(F.col("_trial") / repeats).cast("int")
    groups = []
    for first in range(0, trials, trials_at_once):
        last = min(first + trials_at_once, trials) - 1
        given = rows.select(POS, "_x", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("_trial")).select(
            "_trial", shuffled_place(F.col(POS), n, F.col("_trial").cast("bigint")).alias(POS), F.element_at("_x", which + 1).alias("_given"),
        )
        changed = F.transform("_x", lambda v, i: F.when(i == which, F.col("_given")).otherwise(v))
        # Merged: by the size of its files the table may pass for small, but its rows in memory would pass whole through the driver.
        scored = score(given.join(rows.hint("merge"), POS).select("_trial", "_y", changed.alias("_x")))
        # Written before the scans over it, which would each shuffle and score the rows anew.
        groups.append(cut(_precision(cut(_by_score(scored, "p", "_y", ["_trial"])), ["_trial"])))
    scores = reduce(DataFrame.unionAll, groups).withColumn("_f", which)
    usual = _precision(cut(_by_score(score(rows), "p", "_y", [])), []).select("average_precision").scalar()
    names = F.array(*[F.lit(c) for c in features])
    ranked = (
        scores.groupBy("_f").agg(F.avg("average_precision").alias("_ap"))
        .select(F.element_at(names, F.col("_f") + 1).alias("feature"), (usual - F.col("_ap")).alias("importance"))
        .orderBy(F.desc("importance"), "feature")
    )
    return ranked if top is None else ranked.limit(top)


def permutation_importance(
    model: Classifier, df: DataFrame, features: list[str], y: str, row_id: str, repeats: int = 3, top: int | None = None,
) -> DataFrame:
    """``importance`` of a fitted model's features; rows are numbered by a hash of ``row_id``."""
    numbered = df.select(F.col(y), *features, F.xxhash64(row_id).alias("_order"))
    return importance(lambda rows: predict_array(model, rows), numbered, features, y, "_order", repeats, top)


def predict_array(model: Classifier, df: DataFrame, x: str = "_x") -> DataFrame:
    return _scored(model, df, [F.element_at(x, i + 1) for i in range(len(model.edges))], "p")


def promotable(test: DataFrame, min_alerts: int = 20, min_precision: float = 0.50, min_return: float = 0.20) -> DataFrame:
    """Whether the test slice at the chosen threshold is good enough."""
    ok = (
        (F.col("alerts") >= min_alerts) & (F.coalesce("precision", F.lit(0.0)) >= min_precision)
        & (F.coalesce("avg_return", F.lit(-999.0)) >= min_return)
    )
    return test.withColumn("promotable", ok)
