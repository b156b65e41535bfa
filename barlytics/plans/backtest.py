"""Historical backtest: bars to triggers, labelled outcomes, report and gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlytics.operators import cohorts, labels
from barlytics.plans import setups
from barlytics.session import cut
from barlytics.sources import sinks

MINUTE, HOUR = 60_000, 3_600_000
STEPS = (5 * MINUTE, HOUR, 4 * HOUR)
TARGET_PCT = 5.0
STOP_GRID_PCT = (3.0, 4.0, 5.0, 6.0, 8.0)
HORIZONS_MS = (4 * HOUR, 12 * HOUR, 24 * HOUR, 48 * HOUR)
DIMENSIONS = ("market_regime", "quality_bucket")


def find_triggers(fine_bars: DataFrame, coarse_bars: DataFrame, step: int, coarse_step: int, lead: str, second: str) -> DataFrame:
    """Scored entries into the trigger state, written once."""
    fine = cut(setups.fine_features(fine_bars, step))
    rows = setups.feature_core(setups.align(fine, setups.coarse_features(coarse_bars, coarse_step), step))
    return cut(setups.triggers(rows, setups.context_from_fine(fine, lead, second, step), step))


def label_triggers(
    hits: DataFrame, bars: DataFrame, step: int, target: float = TARGET_PCT, stops=STOP_GRID_PCT, horizons_ms=HORIZONS_MS,
    bucket_ms: int | None = None, window: str = "open", complete: bool = True,
) -> DataFrame:
    """Outcome of each trigger per horizon and stop; incomplete ones drop out."""
    anchors = hits.select("trigger_id", "symbol", "bias", "asof_ms", F.col("price").alias("entry_price"), *DIMENSIONS)
    # Half the longest horizon: an anchor meets at most four buckets.
    bucket_ms = bucket_ms or max(horizons_ms) // 2
    facts = labels.path_facts(anchors, bars, "trigger_id", [target], list(stops), list(horizons_ms), bucket_ms, window, step, carry=DIMENSIONS)
    if complete:
        facts = labels.complete_anchors(facts, horizons_ms, step)
    return labels.horizon_table(facts, "trigger_id", target, list(stops), list(horizons_ms), window, carry=DIMENSIONS)


def report_tables(outcomes: DataFrame, stops=STOP_GRID_PCT, horizons_ms=HORIZONS_MS, min_samples: int = 20, min_rate: float = 0.60) -> dict[str, DataFrame]:
    """Cohorts, stop grid, quantiles of the winners and the gate."""
    outcomes = cut(outcomes)
    last = outcomes.filter(F.col("horizon_ms") == max(horizons_ms))
    one_stop = F.col("stop_pct") == float(min(stops))
    winners = last.filter(one_stop & F.col("target_reached")).withColumn("drawdown", F.abs("mae_before_target_pct"))
    summary = cohorts.stop_summary(last)
    groups = cohorts.gate_groups(last.filter(one_stop), DIMENSIONS, min_samples, min_rate)
    return {
        "cohorts": cohorts.cohort_report(outcomes.filter(one_stop), DIMENSIONS),
        "stop_grid": summary,
        "best_stop": cohorts.best_stop(summary),
        "drawdown": cohorts.exact_quantiles(winners, "drawdown", [0.5, 0.75, 0.9, 0.95]),
        "minutes_to_target": cohorts.exact_quantiles(winners, "minutes_to_target", [0.5, 0.75, 0.9]),
        "gate_groups": groups,
        "gate_status": cohorts.gate_status(groups),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """The report tables as one nested document.

    Every table has one row per cohort, stop or gate cell, never per trigger.
    """
    spark = tables["cohorts"].sparkSession
    doc = spark.range(1).select(F.lit("backtest-v1").alias("version"))
    for name, t in tables.items():
        doc = doc.withColumn(name, t.agg(F.collect_list(F.struct(*t.columns))).scalar())
    sinks.write_report(doc, path)


def run(tiny: DataFrame, fine: DataFrame, coarse: DataFrame, out: str, lead: str = "BTCUSDT", second: str = "ETHUSDT", steps=STEPS) -> None:
    """Bars of three frames in; trigger and outcome tables and a report out."""
    hits = find_triggers(fine, coarse, steps[1], steps[2], lead, second)
    outcomes = cut(label_triggers(hits, tiny, steps[0]))
    hits.drop("quality_components").write.mode("overwrite").parquet(f"{out}/triggers")
    outcomes.write.mode("overwrite").parquet(f"{out}/outcomes")
    write_report(report_tables(outcomes), f"{out}/report")
