"""File readers on files as other tools write them."""

import gzip
import json

from barlytics.session import folders
from barlytics.sources import files, sinks


def bar(t, close=1.0):
    return {
        "open_time_ms": t, "open": 1.0, "high": 2.0, "low": 0.5, "close": close, "volume": 3.0, "close_time_ms": t + 4,
        "quote_volume": 4.0, "trades": 5, "taker_buy_base_volume": 1.0, "taker_buy_quote_volume": 2.0,
    }


def write_gz(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as fh:
        fh.write("".join(json.dumps(r) + "\n" for r in rows))


def test_candle_files(spark, tmp_path):
    write_gz(tmp_path / "BTCUSDT" / "5m_90d.jsonl.gz", [bar(0), bar(5)])
    write_gz(tmp_path / "BTCUSDT" / "5m_30d.jsonl.gz", [bar(0, 9.0)])
    write_gz(tmp_path / "ETHUSDT" / "5m_30d.jsonl.gz", [bar(0, 7.0)])
    write_gz(tmp_path / "ETHUSDT" / "5m_60d.jsonl.gz", [bar(0, 8.0)])
    got = {(r.symbol, r.interval, r.days, r.open_time_ms, r.close) for r in files.read_bars(spark, str(tmp_path), 90).collect()}
    assert got == {("BTCUSDT", "5m", 90, 0, 1.0), ("BTCUSDT", "5m", 90, 5, 1.0), ("ETHUSDT", "5m", 60, 0, 8.0)}


def test_event_log_rules(spark, tmp_path):
    rows = [
        {"event": "SWING_CONTINUATION_TRIGGER", "symbol": "X", "bias": "long", "timestamp_ms": 5, "trigger_price": 1.0},
        {"event": "SWING_CONTINUATION_TRIGGER", "symbol": "X", "bias": "LONG", "timestamp_ms": 5, "trigger_price": 2.0},
        {"event": "SWING_CONTINUATION_TRIGGER", "symbol": "X", "bias": "NEUTRAL", "timestamp_ms": 6, "trigger_price": 2.0},
        {"event": "SWING_CONTINUATION_TRIGGER", "symbol": "X", "bias": "SHORT", "timestamp_ms": 7},
        {"event": "SWING_BIAS_CHANGE", "symbol": "X", "bias": "SHORT", "timestamp_ms": 8, "trigger_price": 1.0},
        {"event": "SWING_CONTINUATION_TRIGGER", "trigger_id": "own", "symbol": "Y", "bias": "SHORT", "timestamp_ms": 9, "trigger_price": 3.0},
    ]
    lines = [json.dumps(r) for r in rows]
    lines.insert(2, "{not json")
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    read = lambda keep: {r.trigger_id: r.trigger_price for r in files.read_events(spark, str(tmp_path), "SWING_CONTINUATION_TRIGGER", keep).collect()}
    assert read("last") == {"X-5": 2.0, "own": 3.0}
    assert read("first") == {"X-5": 1.0, "own": 3.0}


def test_scan_document(spark, tmp_path):
    doc = {
        "generated_at_ms": 1, "cache_age_seconds": 0, "thresholds": {"minimum_candidate_score": 78},
        "watchlist": [{"pair": "A", "score": 70, "warnings": ["w"]}, {"pair": "B", "score": 60}],
        "trade_candidates": [{"pair": "A", "score": 80, "spot_volume_1h_usd": None}],
    }
    (tmp_path / "scan.json").write_text(json.dumps(doc, indent=2))
    got = sorted((r.pair, r.section, r.score, r.threshold) for r in files.read_scan(spark, str(tmp_path / "scan.json")).collect())
    assert got == [("A", 0, 70.0, 78.0), ("A", 1, 80.0, 78.0), ("B", 0, 60.0, 78.0)]


def test_newest_rows_by_key(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda *r: spark.createDataFrame(r, "k string, t long, v int")
    sinks.append_newest(rows(("a", 1, 1), ("a", 3, 3), ("b", 2, 2)), path, "k", "t", 0)
    for _ in range(2):  # the same delivery twice
        sinks.append_newest(rows(("a", 2, 9), ("c", 5, 5), ("b", 4, 4)), path, "k", "t", 1)
    want = [("a", 3, 3), ("b", 4, 4), ("c", 5, 5)]
    newest = lambda: sorted(map(tuple, sinks.read_newest(spark, path, "k", "t").collect()))
    assert newest() == want
    sinks.compact_newest(spark, path, "k", "t")
    assert newest() == want and len(folders(spark, path, "batch=*")) == 1
    sinks.append_newest(rows(("a", 9, 1)), path, "k", "t", 2)
    assert newest() == [("a", 9, 1), *want[1:]]


def test_only_chosen_files_are_read(spark, tmp_path):
    for name, price in (("1h_30d", 1.0), ("1h_90d", 2.0), ("4h_30d", 3.0)):
        (tmp_path / "S1").mkdir(exist_ok=True)
        (tmp_path / "S1" / f"{name}.jsonl").write_text(json.dumps({"open_time_ms": 1, "close": price}) + "\n")
    (tmp_path / "S1" / "1h_30d.jsonl").write_text("x" * 100)  # would give a null row
    got = files.read_bars(spark, str(tmp_path), 90)
    assert sorted((r.interval, r.days, r.close) for r in got.collect()) == [("1h", 90, 2.0), ("4h", 30, 3.0)]
    assert len(got.inputFiles()) == 2



def test_stored_series_are_few_files(spark, tmp_path):
    """Years of daily bars fit one slice, so a folder does not hold a file of every task."""
    day = 86_400_000
    bars = spark.range(3 * 1200).selectExpr(
        "concat('S', id % 3) symbol", "'1d' interval", "90 days", f"(id div 3 + 19000) * {day} open_time_ms", "1.0d open", "2.0d high", "0.5d low",
        "1.0d close", "3.0d volume", f"(id div 3 + 19001) * {day} - 1 close_time_ms", "4.0d quote_volume", "5L trades", "1.0d taker_buy_base_volume", "2.0d taker_buy_quote_volume",
    )
    name, path = "spark.sql.adaptive.coalescePartitions.enabled", str(tmp_path / "store")
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        files.store_bars(bars, path)
    finally:
        spark.conf.set(name, old)
    assert len(folders(spark, path, "interval=*/symbol=*/part-*")) == 3
    assert files.read_stored_bars(spark, path).select(*bars.columns).exceptAll(bars).count() == 0
    assert files.read_stored_bars(spark, path).count() == 3600
