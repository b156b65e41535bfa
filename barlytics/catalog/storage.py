"""Queries that write derived tables in the file layouts and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlytics import schema as S
from barlytics.catalog.base import FINE, HOUR, TINY, bars, candidates, more_fields, ms, query, stored_bars, table
from barlytics.catalog.market import trigger_rows
from barlytics.operators import grid
from barlytics.sources import files, sinks
from barlytics.streaming.streams import table_dir


def candle_tree(spark, sf):
    """Candle files of two frames; the tiny frame also in a longer version."""
    root = table_dir(spark, "candles")
    fine, tiny = stored_bars(spark, sf, FINE), stored_bars(spark, sf, TINY)
    named = fine.withColumn("file", F.lit("3d_90d.jsonl.gz")).unionByName(tiny.withColumn("file", F.lit("1d_90d.jsonl.gz")))
    longer = tiny.filter("symbol <> 'S1'").withColumn("open", F.col("open") + 1).withColumn("file", F.lit("1d_120d.jsonl.gz"))
    (named.unionByName(longer).repartition("symbol", "file").write.partitionBy("symbol", "file").option("compression", "gzip").json(root))
    return root


COLS = "symbol, open_time_ms, open, high, low, close, volume, close_time_ms, quote_volume, trades, taker_buy_base_volume, taker_buy_quote_volume"


@query("s01_read_bars", f"SELECT {COLS}, '3d' AS interval, 90 AS days FROM fine_bars UNION ALL SELECT {COLS}, '1d', 90 FROM tiny_bars")
def s01(spark, sf):
    root = candle_tree(spark, sf)
    store = table_dir(spark, "stored")
    files.store_bars(files.read_bars(spark, root, 90), store)
    return files.read_stored_bars(spark, store)


@query(
    "s02_resolve_interval_file",
    "SELECT DISTINCT symbol, '3d' AS interval, 90 AS days FROM fine_bars UNION ALL SELECT DISTINCT symbol, '1d', CASE WHEN symbol = 'S1' THEN 90 ELSE 120 END FROM tiny_bars",
)
def s02(spark, sf):
    return files.resolve_interval_file(files.candle_files(spark, candle_tree(spark, sf)), 120)


@query(
    "s03_read_manifest",
    f"SELECT symbol, '3d' AS interval, min(open_time_ms) AS start_ms, max(open_time_ms) + {FINE} AS end_exclusive_ms, count(*) AS actual_rows, 90::BIGINT AS days FROM fine_bars GROUP BY symbol",
)
def s03(spark, sf):
    path = table_dir(spark, "manifest")
    per = bars(spark, sf).groupBy("symbol").agg(
        F.min("open_time_ms").alias("start_ms"), (F.max("open_time_ms") + FINE).alias("end_exclusive_ms"), F.count(F.lit(1)).alias("actual_rows")
    )
    entry = F.struct("symbol", F.lit("3d").alias("interval"), "start_ms", "end_exclusive_ms", "actual_rows")
    # One entry per file: the document is as long as the list of symbols.
    sinks.write_report(per.agg(F.lit(90).alias("days"), F.lit("PASS").alias("status"), F.collect_list(entry).alias("files")), path)
    return files.read_manifest(spark, path).select("symbol", "interval", "start_ms", "end_exclusive_ms", "actual_rows", "days")


@query("s04_klines_to_bars", f"SELECT {COLS} FROM fine_bars")
def s04(spark, sf):
    raw = bars(spark, sf).select("symbol", F.to_json(F.array(*[F.col(c).cast("string") for c in files.KLINE])).alias("kline"))
    return files.klines_to_bars(raw)




def _log(spark, sf):
    path = table_dir(spark, "log")
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    line = F.to_json(F.struct(
        F.when(F.col("event_type").isin("click", "view"), "SWING_CONTINUATION_TRIGGER").otherwise("SWING_STATE_TRANSITION").alias("event"),
        F.concat(F.lit("P"), (F.col("user_id") % 20).cast("string")).alias("symbol"),
        F.when(F.col("k") % 3 == 0, "long").otherwise("SHORT").alias("bias"),
        (ms("ts") - F.pmod(ms("ts"), F.lit(6 * HOUR))).alias("timestamp_ms"),
        F.when(F.col("k") % 10 != 1, F.col("value")).alias("trigger_price"), F.col("event_id").cast("double").alias("swing_score"),
    ))
    broken = F.when(F.col("k") % 10 == 2, F.concat(F.lit("{broken "), line)).otherwise(line)
    e.orderBy("event_id").select(broken.alias("value")).write.text(path)
    return path


def events_sql(order: str) -> str:
    return f"""SELECT trigger_id, symbol, bias, timestamp_ms, trigger_price, swing_score FROM (SELECT *, row_number() OVER (PARTITION BY trigger_id ORDER BY {order}) AS rn FROM (
  SELECT concat('P', user_id % 20, '-', t - t % {6 * HOUR}) AS trigger_id, concat('P', user_id % 20) AS symbol, CASE WHEN k % 3 = 0 THEN 'LONG' ELSE 'SHORT' END AS bias, t - t % {6 * HOUR} AS timestamp_ms,
    value AS trigger_price, CAST(event_id AS DOUBLE) AS swing_score, event_id
  FROM (SELECT *, epoch_us(ts) // 1000 AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) WHERE event_type IN ('click', 'view') AND k % 10 NOT IN (1, 2))) WHERE rn = 1"""


def _events_query(name: str, keep: str, order: str):
    def run(spark, sf):
        log = files.read_events(spark, _log(spark, sf), "SWING_CONTINUATION_TRIGGER", keep)
        return log.select("trigger_id", "symbol", "bias", "timestamp_ms", "trigger_price", "swing_score")

    query(name, events_sql(order))(run)


_events_query("s05_read_events_last", "last", "event_id DESC")
_events_query("s05_read_events_first", "first", "event_id")
_events_query("s05_read_events_newest", "newest", "timestamp_ms DESC, event_id DESC")


@query(
    "s06_read_scan",
    "SELECT scan_ms AS generated_at_ms, CAST(score >= 78 AS INT) AS section, pair, bias, round(score, 6) AS score, 80.0::DOUBLE AS threshold, spot_volume_1h_usd, "
    "CASE WHEN score >= 78 THEN 'STRONG' ELSE 'WEAK' END AS strength, oi_change_1h_pct / 8 AS funding_rate_pct, oi_change_24h_pct / 4 AS basis_pct, 'void below ' || pair AS invalidation FROM candidates",
)
def s06(spark, sf):
    path = table_dir(spark, "scans")
    c = candidates(spark, sf).withColumns(more_fields())
    names = [f.name for f in S.CANDIDATE.fields if f.name in c.columns]
    entry = F.struct(*names)
    pick = lambda cond: F.filter(F.collect_list(F.when(cond, entry)), lambda x: x.isNotNull())
    # A scan document holds each pair at most once.
    docs = c.groupBy(F.col("scan_ms").alias("generated_at_ms")).agg(
        F.lit(5.0).alias("cache_age_seconds"), F.struct(F.lit(80.0).alias("minimum_candidate_score")).alias("thresholds"),
        pick(F.col("score") < 78).alias("watchlist"), pick(F.col("score") >= 78).alias("trade_candidates"),
    )
    docs.write.json(path)
    out = files.read_scan_lines(spark, path)
    return out.select("generated_at_ms", "section", "pair", "bias", F.round("score", 6).alias("score"), "threshold", "spot_volume_1h_usd", "strength", "funding_rate_pct", "basis_pct", "invalidation")


@query("s07_append_events", "SELECT CASE WHEN bias = 'LONG' THEN 'SIGNAL_CONFIRMED' ELSE 'SIGNAL_EXPIRED' END AS event, strftime(make_timestamp(asof_ms * 1000), '%Y-%m-%d') AS day, trigger_id, asof_ms AS timestamp_ms FROM trigger_rows")
def s07(spark, sf):
    path = table_dir(spark, "event-log")
    _, t = trigger_rows(spark, sf)
    for side, name in (("LONG", "SIGNAL_CONFIRMED"), ("SHORT", "SIGNAL_EXPIRED")):
        sinks.append_events(t.filter(F.col("bias") == side).select(F.lit(name).alias("event"), "trigger_id", F.col("asof_ms").alias("timestamp_ms")), path)
    return spark.read.schema("trigger_id string, timestamp_ms bigint, event string, day string").json(path).select("event", "day", "trigger_id", "timestamp_ms")


def _daily(name: str, day_from: str):
    def run(spark, sf):
        path = table_dir(spark, "daily")
        log = table(spark, sf, "events").select("event_id", ms("ts").alias("generated_at_ms")).withColumn("o", F.struct("generated_at_ms", "event_id"))
        snaps = grid.one_per_bucket(log, 900_000).drop("o")
        sinks.write_daily_snapshots(snaps, path, day_from)
        back = spark.read.schema("event_id bigint, generated_at_ms bigint, bucket_start_ms bigint, day string").json(path)
        return back.groupBy("day").agg(F.count(F.lit(1)).alias("snapshots"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))

    src = "b" if day_from == "bucket_start_ms" else "generated_at_ms"
    query(
        name,
        f"""SELECT strftime(make_timestamp({src} * 1000), '%Y-%m-%d') AS day, count(*) AS snapshots, min(event_id) AS first_id, max(event_id) AS last_id FROM (
  SELECT *, row_number() OVER (PARTITION BY b ORDER BY generated_at_ms, event_id) AS rn FROM (SELECT *, generated_at_ms - generated_at_ms % 900000 AS b FROM scan_log)) WHERE rn = 1 GROUP BY 1""",
    )(run)


_daily("s08_daily_by_bucket", "bucket_start_ms")
_daily("s08_daily_by_scan_time", "generated_at_ms")


@query("s09_write_report", "SELECT 'bars' AS version, count(*) AS rows, count(DISTINCT symbol) AS symbols, min(low) AS low, max(high) AS high FROM fine_bars")
def s09(spark, sf):
    path = table_dir(spark, "report")
    per = bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("l"), F.max("high").alias("h"))
    report = per.agg(
        F.lit("bars").alias("version"), F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("symbols")).alias("counts"),
        F.struct(F.min("l").alias("low"), F.max("h").alias("high")).alias("range"),
    )
    sinks.write_report(report, path)
    back = spark.read.schema("version string, counts struct<rows:bigint,symbols:bigint>, range struct<low:double,high:double>").json(path)
    return back.select("version", "counts.*", "range.*")


@query("s10_compact_snapshot", "SELECT symbol, open_time_ms, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) AS rn FROM fine_bars) WHERE rn = 1")
def s10(spark, sf):
    path = table_dir(spark, "state")
    b = stored_bars(spark, sf)
    half = b.agg(F.percentile_approx("open_time_ms", 0.5)).scalar()
    rows = b.select("symbol", "open_time_ms", "close")
    sinks.append_newest(rows.filter(F.col("open_time_ms") <= half), path, "symbol", "open_time_ms", 0)
    sinks.append_newest(rows.filter(F.col("open_time_ms") > half), path, "symbol", "open_time_ms", 1)
    sinks.compact_newest(spark, path, "symbol", "open_time_ms")
    return sinks.read_newest(spark, path, "symbol", "open_time_ms")
