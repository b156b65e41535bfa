"""Train on the past, choose the threshold in the middle, judge on the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlytics.operators import cohorts, evaluate as ev
from barlytics.session import cut

# The columns of the learning rows that the classifier reads, as the table names them.
FEATURES = [
    "direction_sign", "activity_score", "activity_rank", "quote_volume_24h", "price_change_24h_pct",
    "taker_buy_ratio_24h", "taker_buy_ratio_1h", "market_regime_score", "market_breadth_pct",
    "market_median_change_24h_pct", "btc_change_24h_pct", "eth_change_24h_pct", "liquid_symbol_count",
    "directional_momentum_3h", "directional_momentum_12h", "directional_momentum_24h",
    "directional_distance_from_1h_sma10_pct", "directional_distance_from_4h_sma10_pct", "sma1h10_slope_pct",
    "sma4h10_slope_pct", "volume_expansion_1h", "directional_momentum_15m", "directional_momentum_45m",
    "directional_momentum_180m", "distance_from_15m_sma4_pct", "distance_from_15m_sma12_pct", "volume_expansion_15m",
    "atr_1h_pct", "realized_vol_12h_pct", "relative_strength_vs_btc_24h", "relative_strength_vs_eth_24h",
    "retest_ready", "trigger_like_1h", "confirmation_15m", "anti_chase_abs_12h_pct",
]


def slice_report(df: DataFrame, threshold, tie: str, **kw) -> DataFrame:
    """One row: size, ranking quality and alert metrics at the threshold."""
    whole = ev.roc_auc(df).withColumn("_k", F.lit(1))
    ap = ev.average_precision(df).select("average_precision", F.lit(1).alias("_k"))
    error = cohorts.brier(df, "p", "y").select("brier", F.lit(1).alias("_k"))
    alerts = ev.threshold_metrics(df, F.array(threshold), tie=tie, **kw).withColumn("_k", F.lit(1))
    return whole.join(ap, "_k").join(error, "_k").join(alerts, "_k").drop("_k")


def evaluate(
    rows: DataFrame, label: str, ret: str, row_id: str, features=FEATURES, ambiguous: str | None = None,
    max_iter: int = 300, min_rows: int = 40, **split,
) -> dict[str, DataFrame]:
    """Split, fit, score, choose and judge; ``rows`` has symbol and asof_ms."""
    clean = ev.clean_dataset(rows, list(features), label, ret, ambiguous)
    clean = clean.withColumnsRenamed({label: "y", ret: "ret"})
    parts = cut(ev.purged_split(clean.select(row_id, "symbol", "asof_ms", "y", "ret", *features), **split))
    model = ev.fit_classifier(parts.filter("split = 'train'"), list(features), "y", max_iter, min_rows=min_rows)
    scored = cut(ev.predict(model, parts, list(features)))
    val, test = scored.filter("split = 'val'"), scored.filter("split = 'test'")
    choices = cut(ev.threshold_metrics(val, ev.THRESHOLDS, tie=row_id))
    best = cut(ev.choose_threshold(choices, val))
    chosen = best.select("threshold").scalar()
    reports = None
    for name, part in (("train", scored.filter("split = 'train'")), ("val", val), ("test", test)):
        one = slice_report(part, chosen, row_id).withColumn("slice", F.lit(name))
        reports = one if reports is None else reports.unionByName(one)
    return {
        "threshold": best, "threshold_table": choices, "slices": reports,
        "top_slices": ev.top_quantile_slices(test, tie=row_id),
        "importance": ev.permutation_importance(model, test, list(features), "y", row_id),
        "promotable": ev.promotable(ev.threshold_metrics(test, F.array(chosen), tie=row_id)),
    }
