"""Whole paths: backtest report, training, live streams."""

import importlib
import json

import pytest
from conftest import SF
from pyspark.sql import functions as F

from barlytics import catalog
from barlytics.catalog import market, paths
from barlytics.catalog.base import COARSE, DAY, FINE, LEAD, SECOND, TINY, frames
from barlytics.operators import joins
from barlytics.plans import backtest, live, training
from barlytics.sources import sinks


def test_backtest_report(spark, tmp_path):
    sf = SF.replace("0.001", "0.01")
    tiny, hits = market.trigger_rows(spark, sf)
    outcomes = backtest.label_triggers(hits, tiny, TINY, paths.TARGET, paths.STOPS, paths.HORIZONS, paths.BUCKET)
    tables = backtest.report_tables(outcomes, paths.STOPS, paths.HORIZONS, min_samples=5)
    backtest.write_report(tables, str(tmp_path / "report"))
    doc = json.loads(next((tmp_path / "report").glob("part-*")).read_text())
    overall = [c for c in doc["cohorts"] if c["cohort"] == "overall"]
    assert len(overall) == 3 and all(c["samples"] == 73 for c in overall)
    assert {s["stop_pct"] for s in doc["stop_grid"]} == set(paths.STOPS)
    assert doc["gate_status"][0]["total"] == 73


def test_reports_have_one_row(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_report(spark.range(2), str(tmp_path / "r"))


def test_training_separates_a_learnable_label(spark):
    n = 3000
    rows = spark.range(n).select(
        F.col("id").cast("string").alias("row_id"), F.concat(F.lit("S"), (F.col("id") % 6).cast("string")).alias("symbol"),
        (F.col("id") * 3_600_000).alias("asof_ms"), F.rand(1).alias("a"), F.rand(2).alias("b"),
    ).withColumn("won", (F.col("a") > 0.6).cast("int")).withColumn("gain", F.when(F.col("won") == 1, 5.0).otherwise(-1.5))
    out = training.evaluate(rows, "won", "gain", "row_id", ["a", "b"], max_iter=5, min_rows=5)
    slices = {r.slice: r for r in out["slices"].collect()}
    assert slices["test"].roc_auc > 0.99 and slices["test"].precision > 0.95
    assert out["promotable"].first().promotable
    assert out["importance"].first().feature == "a"
    assert out["top_slices"].count() == 3


def test_the_built_table_trains(spark):
    """From bars to a judged classifier, with every feature the classifier reads."""
    from barlytics.catalog.base import DAY
    from barlytics.catalog.paths import GOAL_NAMES, learning_table

    rows = learning_table(spark, SF)
    assert set(training.FEATURES) <= set(rows.columns)
    out = training.evaluate(rows, GOAL_NAMES["target"], GOAL_NAMES["sim_return"], "row_id", ambiguous=GOAL_NAMES["ambiguous"], max_iter=3, min_rows=5, gap_ms=30 * DAY)
    slices = {r.slice: r for r in out["slices"].collect()}
    assert set(slices) == {"train", "val", "test"} and all(r.n > 0 for r in slices.values())
    assert out["promotable"].count() == 1


def candidate(pair, score, price):
    return {
        "pair": pair, "bias": "LONG", "score": score, "current_price": price, "oi_change_15m_pct": 0.5, "oi_change_1h_pct": 0.2,
        "oi_change_4h_pct": 1.0, "oi_change_24h_pct": 1.0, "spot_buy_sell_ratio_1h": 1.2, "spot_net_flow_1h_usd": 9000.0,
        "spot_volume_1h_usd": 200000.0, "price_change_1h_spot_pct": 0.5, "price_change_4h_spot_pct": 1.0,
        "price_change_24h_futures_pct": 2.0, "warnings": [], "blockers": [],
    }


def drop(path, at, watch, trades, threshold=78, cache=0):
    path.mkdir(exist_ok=True)
    doc = {"generated_at_ms": at, "cache_age_seconds": cache, "thresholds": {"minimum_candidate_score": threshold}, "watchlist": watch, "trade_candidates": trades}
    (path / f"{at}.json").write_text(json.dumps(doc))


def test_live_scans(spark, tmp_path):
    landing, out = tmp_path / "scans", str(tmp_path / "out")
    now = F.lit(1_000_000)
    once = {"availableNow": True}
    drop(landing, 900_000, [candidate("A", 60, 1.0), candidate("B", 80, 2.0)], [candidate("A", 80, 1.0)])
    live.start_machine(spark, str(landing), out, "confirm", now, once).awaitTermination()
    live.start_state_table(spark, str(landing), out, now, once).awaitTermination()
    # A later scan, and one that is too old to count.
    drop(landing, 950_000, [candidate("A", 85, 1.1)], [])
    drop(landing, 500_000, [candidate("B", 95, 2.0)], [])
    live.start_machine(spark, str(landing), out, "confirm", now, once).awaitTermination()
    live.start_state_table(spark, str(landing), out, now, once).awaitTermination()
    events = spark.read.schema("event string, pair string, timestamp_ms long, detail string").json(f"{out}/confirm").collect()
    assert [(e.event, e.pair, e.timestamp_ms, e.detail) for e in events] == [("SIGNAL_CONFIRMED", "A", 950_000, "two_scan")]
    state = {r.pair: r.current_price for r in sinks.read_newest(spark, f"{out}/pairs", "pair", "scan_ms").collect()}
    assert state == {"A": 1.1, "B": 2.0}


def test_each_scan_brings_its_threshold(spark, tmp_path):
    """A strict scan refuses what a lenient one lets pass."""
    landing, out = tmp_path / "scans", str(tmp_path / "out")
    now, once = F.lit(1_000_000), {"availableNow": True}
    for at, threshold in ((900_000, 90), (950_000, 90)):
        drop(landing, at, [], [candidate("STRICT", 85, 1.0)], threshold)
    for at, threshold in ((910_000, 70), (960_000, 70)):
        drop(landing, at, [], [candidate("LENIENT", 75, 1.0)], threshold)
    live.start_machine(spark, str(landing), out, "confirm", now, once).awaitTermination()
    live.start_machine(spark, str(landing), out, "arm", now, once).awaitTermination()
    shape = "event string, pair string, timestamp_ms long"
    assert [tuple(r) for r in spark.read.schema(shape).json(f"{out}/confirm").collect()] == [("SIGNAL_CONFIRMED", "LENIENT", 960_000)]
    assert {(r.event, r.pair) for r in spark.read.schema(shape).json(f"{out}/arm").collect()} == {("SHADOW_ARMED", "LENIENT")}


def test_a_scan_that_comes_too_late_is_shown(spark, tmp_path):
    landing, out = tmp_path / "scans", str(tmp_path / "out")
    for at in (960_000, 940_000, 970_000):
        drop(landing, at, [], [candidate("A", 85, 1.0)])
        live.start_machine(spark, str(landing), out, "confirm", F.lit(1_000_000), {"availableNow": True}).awaitTermination()
    events = spark.read.schema("event string, timestamp_ms long").json(f"{out}/confirm").collect()
    assert sorted(tuple(e) for e in events) == [("LATE_INPUT", 940_000), ("SIGNAL_CONFIRMED", 970_000)]


def test_labels_wait_until_they_are_ripe(spark, tmp_path):
    """Three deliveries: each pair is labelled once, one only by the third."""
    out, waiting, seen = str(tmp_path / "out"), str(tmp_path / "waiting"), []

    def label(due):
        seen.append(sorted((r.trigger_id, r.horizon_ms) for r in due.collect()))
        return due.select("trigger_id", "horizon_ms", F.lit("x").alias("result"))

    deliveries = [[("a", 0), ("b", 90)], [("c", 120)], [("d", 400)]]
    for i, rows in enumerate(deliveries):
        live.settle(spark.createDataFrame(rows, "trigger_id string, asof_ms long"), i, out, waiting, [50, 300], label)
    assert seen == [[("a", 50)], [], [("a", 300), ("b", 50), ("b", 300), ("c", 50)]]
    # the same delivery again changes nothing
    live.settle(spark.createDataFrame(deliveries[2], "trigger_id string, asof_ms long"), 2, out, waiting, [50, 300], label)
    assert spark.read.parquet(out).count() == 5
    assert {r.trigger_id for r in spark.read.parquet(f"{waiting}/batch=2").collect()} == {"c", "d"}


def test_gate_fails_closed(spark):
    signals = spark.createDataFrame([(1, "MIXED", "50-59"), (2, "MIXED", None), (3, "RISK_ON", "50-59")], "id int, market_regime string, quality_bucket string")
    gate = spark.createDataFrame([("MIXED", "50-59")], "market_regime string, quality_bucket string")
    got = {r.id: (r.allowed, r.gate_reason) for r in joins.gate_join(signals, gate).collect()}
    assert got[1] == (True, "approved: MIXED / 50-59")
    assert got[2][0] is False and "no context" in got[2][1]
    assert got[3] == (False, "not approved: RISK_ON / 50-59")
    off = joins.gate_join(signals, gate, enabled=F.lit(False)).collect()
    assert not any(r.allowed for r in off) and "gate is off" in off[0].gate_reason


def test_a_hot_symbol_spreads_over_blocks(spark):
    """Window partitions stay bounded however long one series is."""
    from barlytics.operators import indicators as ind
    from barlytics.operators.blocks import roll

    bars = spark.range(20_000).select(F.lit("HOT").alias("symbol"), (F.col("id") * DAY).alias("open_time_ms"), F.rand(3).alias("close"))
    plan = roll(bars, {"m": ind.sma("close", 20)}, DAY, block_rows=1_000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "_block" in text
    assert plan.filter("m is not null").count() == 20_000 - 19


def test_frames_come_from_one_scan(spark):
    tiny, fine, coarse = frames(spark, SF, TINY, FINE, COARSE)
    assert tiny.agg(F.sum("trades")).first()[0] == fine.agg(F.sum("trades")).first()[0] == coarse.agg(F.sum("trades")).first()[0]
    assert {r.symbol for r in fine.select("symbol").distinct().collect()} >= {LEAD, SECOND}


def test_trees_read_each_distinct_row_once(spark):
    """Rows that agree in bins and label count by their number: copies change nothing, and leaves keep their least size."""
    from barlytics.operators import evaluate as ev

    rows = spark.range(2000).select((F.col("id") % 50 / 10).alias("a"), (F.col("id") % 7).cast("double").alias("b"), ((F.col("id") * 31 % 50) % 3 == 0).cast("int").alias("y"))
    model = ev.fit_classifier(rows, ["a", "b"], "y", max_iter=1, min_rows=60)
    assert len(model.edges[0]) <= 31 and len(model.edges[1]) == 6
    once = ev.predict(model, rows, ["a", "b"]).groupBy("p").count().collect()
    assert len(once) > 2 and min(r["count"] for r in once) >= 60
    copies = rows.crossJoin(spark.range(9).select())
    again = ev.predict(ev.fit_classifier(copies, ["a", "b"], "y", max_iter=1, min_rows=540), rows, ["a", "b"]).groupBy("p").count().collect()
    assert sorted((round(r.p, 12), r["count"]) for r in again) == sorted((round(r.p, 12), r["count"]) for r in once)
    few = ev.fit_classifier(rows.limit(119), ["a", "b"], "y", max_iter=1, min_rows=60)
    assert ev.predict(few, rows, ["a", "b"]).select("p").distinct().count() == 1


@pytest.mark.parametrize("name,module,made", [("c12_late_entry_gate", "catalog.base", "ticks"), ("a09_dataset_meta", "catalog.base", "ticks"), ("t13_matured_labels", "operators.pyramid", "build")])
def test_inputs_are_made_once(spark, monkeypatch, name, module, made):
    """One scan of the ticks for all frames of a query, one pyramid for all deliveries."""
    module, calls = importlib.import_module(f"barlytics.{module}"), []
    make = getattr(module, made)
    monkeypatch.setattr(module, made, lambda *a, **k: calls.append(1) or make(*a, **k))
    catalog.QUERIES[name](spark, SF)
    assert len(calls) == 1
