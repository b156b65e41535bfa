"""Queries for state machines: batch replays and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlytics.catalog.base import DAY, FINE, HOUR, TINY, candidates, cte, ms, query, rnd, table
from barlytics.catalog.market import trigger_rows
from barlytics.catalog.paths import BUCKET, HORIZONS, STOPS, TARGET, anchors
from barlytics.catalog.scalars import position_sql
from barlytics.catalog.series import core
from barlytics.operators import labels as lab
from barlytics.plans import account
from barlytics.plans.live import settle
from barlytics.session import cut
from barlytics.streaming import machines as mc, streams

# Scans are hourly here, so the cooldown and the life of an armed setup are
# longer than their defaults.
COOLDOWN, TTL = 150 * 60_000, 6 * HOUR

cte(
    "confirm_rows",
    "SELECT *, score >= req AND len(blockers) = 0 AND spot AND oi_change_15m_pct > 0 AS ok, row_number() OVER (PARTITION BY pair ORDER BY scan_ms) AS rn FROM gate_cols",
)
CONFIRM = f"""WITH RECURSIVE m AS (
  SELECT pair, 0::BIGINT AS rn, 0::BIGINT AS now_ms, false AS active, 0::BIGINT AS since, '' AS cbias, 0::DOUBLE AS cscore, 0::DOUBLE AS cprice, 0::DOUBLE AS prev, 0::DOUBLE AS mfe, 0::DOUBLE AS mae, 0::BIGINT AS until, 0::BIGINT AS streak, NULL::VARCHAR AS event
  FROM (SELECT DISTINCT pair FROM confirm_rows)
  UNION ALL SELECT pair, rn, now_ms, CASE WHEN active THEN NOT closes ELSE confirms END, CASE WHEN confirms THEN now_ms ELSE since END, CASE WHEN confirms THEN bias ELSE cbias END, CASE WHEN confirms THEN score ELSE cscore END,
    CASE WHEN confirms THEN price ELSE cprice END, CASE WHEN active OR confirms THEN score ELSE prev END, CASE WHEN active THEN round(greatest(mfe, ret), 6) WHEN confirms THEN 0 ELSE mfe END, CASE WHEN active THEN round(least(mae, ret), 6) WHEN confirms THEN 0 ELSE mae END,
    CASE WHEN active AND closes THEN now_ms + {COOLDOWN} WHEN confirms THEN 0 ELSE until END, CASE WHEN active THEN CASE WHEN closes THEN 0 ELSE streak END WHEN cooling THEN 0 ELSE run END,
    CASE WHEN active AND closes THEN CASE WHEN flags = 0 THEN 'SIGNAL_EXPIRED' ELSE 'SIGNAL_DETERIORATED' END WHEN confirms THEN 'SIGNAL_CONFIRMED' END
  FROM (SELECT *, flags > 0 OR old AS closes, NOT active AND NOT cooling AND ok AND (score >= 90 OR run >= 2) AS confirms FROM (
    SELECT m.pair, r.rn, r.scan_ms AS now_ms, m.active, m.since, m.cbias, m.cscore, m.cprice, m.prev, m.mfe, m.mae, m.until, m.streak, r.ok, r.bias, r.score, r.current_price AS price, r.scan_ms < m.until AS cooling,
      CASE WHEN r.ok THEN m.streak + 1 ELSE 0 END AS run, CASE WHEN m.cbias = 'SHORT' THEN (m.cprice / r.current_price - 1) * 100 ELSE (r.current_price / m.cprice - 1) * 100 END AS ret,
      (r.bias <> m.cbias)::INT + (CASE WHEN m.cbias = 'LONG' THEN r.inv_long ELSE r.inv_short END)::INT + (CASE WHEN m.cbias = 'LONG' THEN r.rev_long ELSE r.rev_short END)::INT
        + (r.score <= 70 OR (m.prev - r.score >= 10 AND r.score < 78))::INT AS flags, r.scan_ms - m.since >= {6 * HOUR} AS old
    FROM m JOIN confirm_rows r ON r.pair = m.pair AND r.rn = m.rn + 1)))
SELECT event, now_ms AS timestamp_ms, pair, round(cprice, 9) AS confirmed_price, round(cscore, 9) AS confirmed_score, round(mfe, 6) + 0.0 AS mfe_pct, round(mae, 6) + 0.0 AS mae_pct FROM m WHERE event IS NOT NULL"""


def _confirm_view(ev):
    out = ev.select("event", "timestamp_ms", "pair", "confirmed_price", "confirmed_score", "mfe_pct", "mae_pct")
    return rnd(out.withColumns({c: F.col(c) + 0.0 for c in ("mfe_pct", "mae_pct")}))


@query("t01_confirm_and_monitor", CONFIRM)
def t01(spark, sf):
    rows = mc.confirm_input(candidates(spark, sf))
    return _confirm_view(mc.batch(mc.confirm_and_monitor(cooldown_ms=COOLDOWN), rows, ["pair"], ["scan_ms"], mc.CONFIRM_EVENTS))


def _machine(rows, name: str, keys, order, step, schema: str):
    """A table arriving in time order through a streaming state machine."""
    return streams.arrive(cut(rows), name, order[0], lambda s: streams.stateful(s, keys, order, step, schema))


@query("t01_confirm_and_monitor_stream", CONFIRM)
def t01s(spark, sf):
    rows = mc.confirm_input(candidates(spark, sf))
    return _confirm_view(_machine(rows, "confirm", ["pair"], ["scan_ms"], mc.confirm_and_monitor(cooldown_ms=COOLDOWN), mc.CONFIRM_EVENTS))


FP = "concat_ws('|', current_price, spot_buy_sell_ratio_1h, spot_net_flow_1h_usd, coalesce(CAST(spot_volume_1h_usd AS VARCHAR), ''), oi_change_15m_pct, oi_change_1h_pct, price_change_1h_spot_pct)"
cte(
    "arm_rows",
    f"""SELECT *, score >= req AND len(blockers) = 0 AND spot AND oi_change_15m_pct > 0 AND coalesce(spot_volume_1h_usd >= min_vol, false) AS base_ok,
  len(blockers) = 0 AND spot AND oi_change_15m_pct > -0.25 AND coalesce(spot_volume_1h_usd >= min_vol, false) AS sound, {FP} AS fp, row_number() OVER (PARTITION BY pair ORDER BY scan_ms) AS rn FROM gate_cols""",
)
ARM = f"""WITH RECURSIVE m AS (
  SELECT pair, 0::BIGINT AS rn, 0::BIGINT AS now_ms, false AS active, false AS armed, 0::BIGINT AS since, 0::DOUBLE AS aprice, 0::DOUBLE AS ascore, 0 AS evid, '' AS lastfp, 0::DOUBLE AS areq, '' AS hbias, 0::DOUBLE AS hprice, '' AS lvl, NULL::VARCHAR AS event, NULL::INT AS shown
  FROM (SELECT DISTINCT pair FROM arm_rows)
  UNION ALL SELECT pair, rn, now_ms, CASE WHEN active THEN newlvl <> 'EXIT_THESIS_BROKEN' ELSE confirms END, NOT active AND (arms OR (armed AND NOT deep AND NOT expires AND NOT fails AND NOT confirms)),
    CASE WHEN arms THEN now_ms ELSE since END, CASE WHEN arms THEN price ELSE aprice END, CASE WHEN arms THEN score ELSE ascore END, CASE WHEN arms THEN 1 ELSE evid2 END, CASE WHEN NOT active THEN fp ELSE lastfp END, CASE WHEN arms THEN req ELSE areq END,
    CASE WHEN confirms THEN bias ELSE hbias END, CASE WHEN confirms THEN price ELSE hprice END, CASE WHEN active THEN newlvl WHEN confirms THEN 'HOLD' ELSE lvl END,
    CASE WHEN active THEN CASE WHEN newlvl <> lvl THEN 'SHADOW_POSITION_STATE' END WHEN arms THEN 'SHADOW_ARMED' WHEN expires THEN 'SHADOW_ARM_EXPIRED' WHEN fails THEN 'SHADOW_FALSE_START' WHEN confirms THEN 'SHADOW_CONFIRMED' END,
    CASE WHEN arms THEN 1 WHEN confirms THEN evid2 END
  FROM (SELECT *, NOT active AND armed AND NOT deep AND NOT expires AND NOT fails AND evid2 >= need AND move >= trig AND allowed AND NOT is_chased AS confirms FROM (
    SELECT *, NOT active AND armed AND NOT deep AND NOT expires AND (NOT sound OR score < areq - 6 OR (ascore - score >= 10 AND score < areq)) AS fails FROM (
     SELECT m.pair, r.rn, r.scan_ms AS now_ms, m.active, m.armed, m.since, m.aprice, m.ascore, m.lastfp, m.areq, m.hbias, m.hprice, m.lvl, r.bias, r.score, r.current_price AS price, r.req, r.sound, r.fp, r.is_chased,
      r.regime = 'COUNTERTREND_DEEP' AS deep, NOT m.active AND NOT m.armed AND r.regime <> 'COUNTERTREND_DEEP' AND r.base_ok AS arms,
      NOT m.active AND m.armed AND r.regime <> 'COUNTERTREND_DEEP' AND r.scan_ms - m.since > {TTL} AS expires, m.evid + (m.armed AND r.fp <> m.lastfp)::INT AS evid2,
      CASE WHEN r.regime = 'TREND_CONTINUATION' THEN 2 ELSE 3 END AS need, CASE WHEN r.regime = 'TREND_CONTINUATION' THEN 0.5 ELSE 0.75 END AS trig, r.regime = 'TREND_CONTINUATION' OR r.reclaims AS allowed,
      CASE WHEN r.bias = 'LONG' THEN (r.current_price / m.aprice - 1) * 100 ELSE -(r.current_price / m.aprice - 1) * 100 END AS move,
      CASE WHEN m.hbias = 'LONG' THEN {position_sql('LONG', 'm.hprice').replace('severe_', 'r.severe_').replace('bad_', 'r.bad_').replace('spot_long', 'r.spot_long').replace('regime_', 'r.regime_').replace('current_price', 'r.current_price')}
        ELSE {position_sql('SHORT', 'm.hprice').replace('severe_', 'r.severe_').replace('bad_', 'r.bad_').replace('spot_short', 'r.spot_short').replace('regime_', 'r.regime_').replace('current_price', 'r.current_price')} END AS newlvl
     FROM m JOIN arm_rows r ON r.pair = m.pair AND r.rn = m.rn + 1))))
SELECT event, now_ms AS timestamp_ms, pair, lvl AS level, shown AS evidence_count FROM m WHERE event IS NOT NULL"""
ARM = ARM.replace("SELECT event, now_ms AS timestamp_ms, pair, lvl AS level, shown", "SELECT event, now_ms AS timestamp_ms, pair, CASE WHEN event = 'SHADOW_POSITION_STATE' THEN lvl END AS level, shown")


def _arm_view(ev):
    level = F.when(F.col("event") == "SHADOW_POSITION_STATE", F.substring_index("detail", " -> ", -1))
    return ev.select("event", "timestamp_ms", "pair", level.alias("level"), "evidence_count")


@query("t02_arm_confirm_manage", ARM)
def t02(spark, sf):
    rows = mc.arm_input(candidates(spark, sf))
    return _arm_view(mc.batch(mc.arm_confirm_manage(ttl_ms=TTL), rows, ["pair"], ["scan_ms"], mc.ARM_EVENTS))


@query("t02_arm_confirm_manage_stream", ARM)
def t02s(spark, sf):
    rows = mc.arm_input(candidates(spark, sf))
    return _arm_view(_machine(rows, "arm", ["pair"], ["scan_ms"], mc.arm_confirm_manage(ttl_ms=TTL), mc.ARM_EVENTS))


LAGS = "lag(setup_state) OVER z AS ls, lag(bias) OVER z AS lb"
SWINGS = f"""SELECT event, symbol, asof_ms AS timestamp_ms, bias, from_value, to_value, price FROM (
  SELECT 'SWING_FIRST_SEEN' AS event, symbol, asof_ms, bias, NULL AS from_value, setup_state AS to_value, price FROM c WHERE ls IS NULL
  UNION ALL SELECT 'SWING_STATE_TRANSITION', symbol, asof_ms, bias, ls, setup_state, price FROM c WHERE ls <> setup_state
  UNION ALL SELECT 'SWING_BIAS_CHANGE', symbol, asof_ms, bias, lb, bias, price FROM c WHERE lb <> bias
  UNION ALL SELECT 'SWING_CONTINUATION_TRIGGER', symbol, asof_ms, bias, ls, setup_state, price FROM c WHERE setup_state = 'CONTINUATION_TRIGGER' AND (ls IS NULL OR ls <> setup_state))"""
SWINGS = f"WITH c AS (SELECT *, {LAGS} FROM core WINDOW z AS (PARTITION BY symbol ORDER BY asof_ms)) {SWINGS}"


def _scans(spark, sf):
    return core(spark, sf).select("symbol", F.col("asof_ms").alias("timestamp_ms"), "bias", "setup_state", "price")


@query("t03_swing_events", SWINGS)
def t03(spark, sf):
    from barlytics.plans.states import swing_events

    return swing_events(cut(_scans(spark, sf)), FINE)


@query("t03_swing_events_stream", SWINGS)
def t03s(spark, sf):
    return _machine(_scans(spark, sf), "scans", ["symbol"], ["timestamp_ms"], mc.swing_step, mc.SWING_EVENTS)


# --- paper account: every trigger is a signal -------------------------------

TP, SL, REST = 2.0, 2.5, 20 * DAY
_FAV = "CASE WHEN side = 'LONG' THEN (high / e - 1) * 100 ELSE (1 - low / e) * 100 END"
_ADV = "CASE WHEN side = 'LONG' THEN (1 - low / e) * 100 ELSE (high / e - 1) * 100 END"
cte(
    "acc_signals",
    f"""SELECT *, early IS NULL AS fit FROM (SELECT trigger_id AS id, symbol, bias AS side, at_ms, CASE WHEN asof_ms < (SELECT min(asof_ms) FROM trigger_rows) + {100 * DAY} THEN 'PRE_ACTIVATION'
  WHEN at_ms - asof_ms > 600000 THEN 'STALE_AT_OBSERVATION' WHEN CAST(substring(symbol, 2) AS BIGINT) % 5 = 4 THEN 'IDENTITY_NOT_VERIFIED_CRYPTO' END AS early
 FROM (SELECT *, asof_ms + CASE WHEN pos % 9 = 0 THEN 900000 ELSE 60000 END AS at_ms FROM trigger_rows))""",
)
cte("acc_runs", f"SELECT symbol, open_time_ms AS t, open, high, low, open_time_ms - pos * {DAY} AS run FROM tiny_pos")
cte(
    "acc_paths",
    f"""SELECT *, CASE WHEN side = 'LONG' THEN 1 ELSE -1 END * (open / e - 1) * 100 AS gap, {_FAV} AS fav, {_ADV} AS adv FROM (
 SELECT s.symbol, s.at_ms, s.side, en.open AS e, en.t AS entry, b.t, b.open, b.high, b.low FROM acc_signals s
 JOIN acc_runs en ON en.symbol = s.symbol AND en.t = s.at_ms - s.at_ms % {DAY} + {DAY} AND s.fit JOIN acc_runs b ON b.symbol = en.symbol AND b.run = en.run AND b.t >= en.t)""",
)
cte("acc_marks", f"SELECT *, min(CASE WHEN gap <= -{SL} OR gap >= {TP} OR fav >= {TP} - 1e-9 OR adv >= {SL} - 1e-9 THEN t END) OVER (PARTITION BY symbol, at_ms) AS x FROM acc_paths")
cte(
    "acc_ends",
    f"""SELECT symbol, at_ms, any_value(e) AS e, any_value(entry) AS entry, any_value(x) AS x, greatest(0, max(adv)) AS mae, greatest(0, max(fav)) AS mfe, max(t) AS seen,
  max(CASE WHEN gap <= -{SL} THEN 'STOP' WHEN gap >= {TP} THEN 'TARGET' WHEN fav >= {TP} - 1e-9 AND adv >= {SL} - 1e-9 THEN 'AMBIGUOUS_LOSS' WHEN fav >= {TP} - 1e-9 THEN 'TARGET' ELSE 'STOP' END) FILTER (WHERE t = x) AS status,
  max(CASE WHEN gap <= -{SL} THEN least(-{SL}, gap) WHEN gap >= {TP} OR (fav >= {TP} - 1e-9 AND adv < {SL} - 1e-9) THEN {TP} ELSE -{SL} END::DOUBLE) FILTER (WHERE t = x) AS gross
FROM acc_marks WHERE x IS NULL OR t <= x GROUP BY symbol, at_ms""",
)
# One usable signal follows another at the first time at which the symbol is free again.
cte(
    "acc_fit",
    f"""SELECT s.symbol, s.at_ms, min(s.id) AS id, CASE WHEN any_value(n.x) IS NOT NULL THEN greatest(s.at_ms + {REST}, any_value(n.x) + {DAY}) END AS free
FROM acc_signals s LEFT JOIN acc_ends n ON s.symbol = n.symbol AND s.at_ms = n.at_ms WHERE s.fit GROUP BY s.symbol, s.at_ms""",
)
ACC_TAKEN = """acc_taken AS (
  SELECT symbol, min(at_ms) AS at_ms FROM acc_fit GROUP BY symbol
  UNION ALL SELECT t.symbol, (SELECT min(n.at_ms) FROM acc_fit n WHERE n.symbol = t.symbol AND n.at_ms >= f.free) FROM acc_taken t
  JOIN acc_fit f ON f.symbol = t.symbol AND f.at_ms = t.at_ms WHERE (SELECT min(n.at_ms) FROM acc_fit n WHERE n.symbol = t.symbol AND n.at_ms >= f.free) IS NOT NULL),
acc_held AS (SELECT f.*, n.* EXCLUDE (symbol, at_ms) FROM acc_taken t JOIN acc_fit f ON f.symbol = t.symbol AND f.at_ms = t.at_ms LEFT JOIN acc_ends n ON n.symbol = t.symbol AND n.at_ms = t.at_ms)"""
ADMITTED = f"""WITH RECURSIVE {ACC_TAKEN}
SELECT symbol, id, side, at_ms AS timestamp_ms, reason, CASE WHEN reason = 'ACCEPTED' THEN at_ms - at_ms % {DAY} + {DAY} END AS entry_ms FROM (
 SELECT s.*, CASE WHEN s.early IS NOT NULL THEN s.early WHEN h.id = s.id THEN 'ACCEPTED' WHEN h.id < s.id THEN 'POSITION_ALREADY_OPEN' WHEN p.at_ms IS NOT NULL AND (p.x IS NULL OR p.x + {DAY} > s.at_ms) THEN 'POSITION_ALREADY_OPEN'
   ELSE 'SYMBOL_COOLDOWN' END AS reason
 FROM acc_signals s LEFT JOIN acc_held h ON h.symbol = s.symbol AND h.at_ms = s.at_ms ASOF LEFT JOIN acc_held p ON p.symbol = s.symbol AND p.at_ms < s.at_ms)"""
TRACKED = f"""WITH RECURSIVE {ACC_TAKEN}
SELECT h.symbol, h.id, s.side, h.x + {DAY} AS timestamp_ms, h.entry AS entry_ms, round(h.e, 9) AS entry_price, h.status, round(h.mae, 9) AS mae_pct, round(h.mfe, 9) AS mfe_pct,
  round(h.gross - 0.12 - 0.01 * ceil((h.x + {DAY} - h.entry) / {HOUR}.0 / 8), 9) AS net_return_pct, round(h.gross - 0.50 - 0.01 * ceil((h.x + {DAY} - h.entry) / {HOUR}.0 / 8), 9) AS stressed_net_return_pct
FROM acc_held h JOIN acc_signals s ON s.id = h.id WHERE h.x IS NOT NULL"""


def _paper_rows(spark, sf):
    """Judged signals and closed bars."""
    tiny, t = trigger_rows(spark, sf)
    signals = t.select(
        F.col("trigger_id").alias("id"), "symbol", "bias", F.col("asof_ms").alias("timestamp_ms"),
        (F.col("asof_ms") + F.when(F.col("pos") % 9 == 0, 900_000).otherwise(60_000)).alias("observed_ms"), *account.FEATURES,
    )
    registry = tiny.select("symbol").distinct().withColumn("classification", F.when(F.substring("symbol", 2, 20).cast("bigint") % 5 == 4, "OTHER").otherwise("CRYPTO"))
    return account.judged(signals, registry, t.agg(F.min("asof_ms") + 100 * DAY).scalar()), tiny.select("symbol", "open_time_ms", "open", "high", "low", "close")


def _events(signals, bars):
    return account.account(signals, bars, TINY, TP, SL, REST)


def _tracked(events):
    return rnd(events.filter("kind = 'OUTCOME'").select(
        "symbol", "id", "side", "timestamp_ms", "entry_ms", "entry_price", "status", "mae_pct", "mfe_pct", "net_return_pct", "stressed_net_return_pct"
    ))


@query("t04_admit", ADMITTED)
def t04(spark, sf):
    return _events(*_paper_rows(spark, sf)).filter("kind = 'ADMISSION'").select("symbol", "id", "side", "timestamp_ms", "reason", "entry_ms")


@query("t05_track_open_positions", TRACKED)
def t05(spark, sf):
    return _tracked(_events(*_paper_rows(spark, sf)))


@query("t05_track_open_positions_stream", TRACKED)
def t05s(spark, sf):
    """Signals and bars arrive together; a delivery gives out the events that it causes."""
    signals, bars = _paper_rows(spark, sf)
    own, prices = signals.columns, bars.columns
    both = cut(signals).withColumn("_signal", F.lit(True)).unionByName(bars.withColumn("at_ms", F.col("open_time_ms") + TINY).withColumn("_signal", F.lit(False)), allowMissingColumns=True)
    kept = streams.table_dir(spark, "account")

    def job(batch, batch_id, out):
        account.deliver(batch, batch_id, out, kept, lambda rows: _events(rows.filter("_signal").select(*own), rows.filter("not _signal").select(*prices)))

    return _tracked(streams.arrive(both, "account", "at_ms", job=job, parts=3))


# --- event-time operators on the event stream ------------------------------


def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "t10_late_data",
    f"""SELECT event_id, CASE WHEN age < 0 THEN 'FUTURE_TIMESTAMP' WHEN age > 600000 THEN 'STALE_AT_OBSERVATION' ELSE 'ON_TIME' END AS lateness
FROM (SELECT event_id, (CAST(json_extract_string(props, '$.k') AS BIGINT) - 10) * 15000 AS age FROM events)""",
)
def t10(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    ev = _event_stream(spark, sf).withColumn("event_ms", ms("ts")).withColumn("observed_ms", F.col("event_ms") + (k - 10) * 15_000)
    return streams.drain(streams.label_late(ev, "event_ms", "observed_ms").select("event_id", "lateness"), "late")


@query(
    "t11_tumbling_snapshots",
    """SELECT * FROM (SELECT (epoch_us(ts) // 1000000) // 900 * 900000 AS bucket_ms, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1)
WHERE bucket_ms + 900000 <= (SELECT max(epoch_us(ts) // 1000) - 600000 FROM events)""",
)
def t11(spark, sf):
    first = streams.first_per_bucket(_event_stream(spark, sf), "ts", values=["event_id"])
    return streams.drain(first.select(ms("bucket_start").alias("bucket_ms"), "event_id"), "buckets")


@query("t12_processed_ids", "SELECT DISTINCT concat(user_id, '-', event_type) AS trigger_id FROM events")
def t12(spark, sf):
    ev = _event_stream(spark, sf).withColumn("trigger_id", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    return streams.drain(streams.once_per_id(ev, "trigger_id", "ts", "60 days").select("trigger_id"), "ids")


@query(
    "t13_matured_labels",
    f"""SELECT trigger_id, horizon_ms, result FROM outcomes_all WHERE stop_pct = {STOPS[0]} AND asof_ms + horizon_ms <= (SELECT max(asof_ms) FROM anchors)""",
)
def t13(spark, sf):
    tiny, a = anchors(spark, sf)  # both from written tables
    blocks = lab.path_blocks(tiny, HORIZONS, "open", TINY)  # all deliveries read this one
    waiting = streams.table_dir(spark, "waiting")

    def label(due):
        facts = lab.path_facts(due.drop("horizon_ms").distinct(), tiny, "trigger_id", [TARGET], STOPS[:1], HORIZONS, BUCKET, "open", TINY, blocks=blocks)
        rows = lab.horizon_table(facts, "trigger_id", TARGET, STOPS[:1], HORIZONS)
        return rows.join(due.select("trigger_id", "horizon_ms"), ["trigger_id", "horizon_ms"]).select("trigger_id", "horizon_ms", "result")

    def job(batch, batch_id, out):
        settle(batch, batch_id, out, waiting, HORIZONS, label)

    return streams.arrive(a, "matured", "asof_ms", job=job, parts=3).select("trigger_id", "horizon_ms", "result")
