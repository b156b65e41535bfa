"""Queries over forward paths: labels, exits, cohort reports, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlytics.catalog.base import COARSE, DAY, FINE, HOUR, LEAD, SECOND, TINY, cte, frames, query, rnd, stored_bars
from barlytics.catalog.market import HORIZON, R9, ml_rows, trigger_rows
from barlytics.functions import scalar as sc
from barlytics.operators import cohorts, grid, labels as lab
from barlytics.plans import backtest, dataset
from barlytics.session import cut

# Fixture prices span about 5 %, so barriers and horizons are smaller and longer
# than the defaults of the library.
TARGET, STOPS = 2.0, [1.0, 1.5, 2.0, 3.0]
HORIZONS = [10 * DAY, 30 * DAY, 60 * DAY]
BUCKET = 30 * DAY
CARRY = ("market_regime", "quality_bucket")

cte("anchors", "SELECT trigger_id, symbol, bias, asof_ms, price AS entry_price, market_regime, quality_bucket FROM trigger_rows")
FAV = "CASE WHEN bias = 'SHORT' THEN (1 - low / entry_price) * 100 ELSE (high / entry_price - 1) * 100 END"
ADV = "CASE WHEN bias = 'SHORT' THEN (1 - high / entry_price) * 100 ELSE (low / entry_price - 1) * 100 END"
RET = "CASE WHEN bias = 'SHORT' THEN (1 - {0} / entry_price) * 100 ELSE ({0} / entry_price - 1) * 100 END"
cte("horizon_list", f"SELECT unnest({HORIZONS})::BIGINT AS horizon_ms")
cte("stop_list", f"SELECT unnest({STOPS})::DOUBLE AS stop_pct")
cte(
    "pairs",
    f"""SELECT *, {FAV} AS fav, {ADV} AS adv FROM (SELECT a.*, h.horizon_ms, b.open_time_ms AS t, b.high, b.low, b.close FROM anchors a CROSS JOIN horizon_list h
JOIN tiny_bars b ON a.symbol = b.symbol AND b.open_time_ms >= a.asof_ms AND b.open_time_ms < a.asof_ms + h.horizon_ms)""",
)
FIRST = "min(t) FILTER (WHERE fav >= {0})"


def outcome_sql(pairs: str, stop_join: str = "CROSS JOIN stop_list") -> str:
    return f"""SELECT *, CASE WHEN result = 'TARGET_FIRST' THEN {TARGET} WHEN result IN ('STOP_FIRST', 'AMBIGUOUS') THEN -stop_pct
  ELSE greatest(-stop_pct, least({TARGET}, close_return_pct)) END::DOUBLE AS sim_return_pct,
  (first_target_ms - asof_ms) / 60000.0::DOUBLE AS minutes_to_target FROM (
 SELECT *, CASE WHEN first_target_ms IS NULL AND first_stop_ms IS NULL THEN 'OPEN' WHEN first_stop_ms IS NULL OR first_target_ms < first_stop_ms THEN 'TARGET_FIRST'
   WHEN first_target_ms IS NULL OR first_stop_ms < first_target_ms THEN 'STOP_FIRST' ELSE 'AMBIGUOUS' END AS result FROM (
  SELECT trigger_id, symbol, bias, asof_ms, market_regime, quality_bucket, horizon_ms, stop_pct, count(*) AS bars, min(t) FILTER (WHERE fav >= {TARGET}) AS first_target_ms,
   min(t) FILTER (WHERE adv <= -stop_pct) AS first_stop_ms, greatest(0, max(fav)) AS mfe_pct, least(0, min(adv)) AS mae_pct,
   least(0, min(adv) FILTER (WHERE t <= ft)) AS mae_upto, arg_max({RET.format('close')}, t) AS close_return_pct
  FROM (SELECT *, min(CASE WHEN fav >= {TARGET} THEN t END) OVER (PARTITION BY trigger_id, horizon_ms) AS ft FROM {pairs}) {stop_join} GROUP BY ALL))"""


cte("outcomes_all", outcome_sql("pairs"))
cte(
    "complete_ids",
    f"""SELECT trigger_id FROM (SELECT trigger_id, horizon_ms, count(*) AS bars FROM pairs GROUP BY ALL) GROUP BY trigger_id
HAVING count(*) = {len(HORIZONS)} AND bool_and(bars >= greatest(1, horizon_ms // {DAY} - 2))""",
)
cte("outcomes", "SELECT * FROM outcomes_all WHERE trigger_id IN (SELECT trigger_id FROM complete_ids)")


def anchors(spark, sf):
    tiny, t = trigger_rows(spark, sf)
    return tiny, t.select("trigger_id", "symbol", "bias", "asof_ms", F.col("price").alias("entry_price"), *CARRY)


def facts(spark, sf, window: str = "open"):
    tiny, a = anchors(spark, sf)
    return lab.path_facts(
        a, tiny, "trigger_id", [TARGET], STOPS, HORIZONS, BUCKET, window, TINY, carry=CARRY
    )


def outcomes(spark, sf):
    tiny, hits = trigger_rows(spark, sf)
    return backtest.label_triggers(hits, tiny, TINY, TARGET, STOPS, HORIZONS, BUCKET)


ID = ["trigger_id", "horizon_ms"]
ONE = f"stop_pct = {STOPS[0]}"


@query("l01_mfe_mae", f"SELECT trigger_id, horizon_ms, round(mfe_pct, 4) AS mfe_pct, round(mae_pct, 4) + 0.0 AS mae_pct, round(close_return_pct, 4) + 0.0 AS close_return_pct FROM outcomes WHERE {ONE}")
def l01(spark, sf):
    return rnd(outcomes(spark, sf).filter(ONE).select(*ID, "mfe_pct", "mae_pct", "close_return_pct"), 4)


@query("l02_first_touch", f"SELECT trigger_id, horizon_ms, first_target_ms IS NOT NULL AS target_reached, first_target_ms, round(minutes_to_target, 2) AS minutes_to_target FROM outcomes WHERE {ONE}")
def l02(spark, sf):
    return rnd(outcomes(spark, sf).filter(ONE).select(*ID, "target_reached", "first_target_ms", "minutes_to_target"), 2)


@query("l03_mae_before_target", f"SELECT trigger_id, horizon_ms, CASE WHEN first_target_ms IS NOT NULL THEN round(mae_upto, 4) + 0.0 END AS mae_before_target_pct FROM outcomes WHERE {ONE}")
def l03(spark, sf):
    return rnd(outcomes(spark, sf).filter(ONE).select(*ID, "mae_before_target_pct"), 4)


@query("l04_stop_grid", "SELECT trigger_id, horizon_ms, stop_pct, result, round(sim_return_pct, 4) + 0.0 AS sim_return_pct FROM outcomes")
def l04(spark, sf):
    return rnd(outcomes(spark, sf).select(*ID, "stop_pct", "result", "sim_return_pct"), 4)


cte(
    "tracker_pairs",
    f"""SELECT *, {FAV} AS fav, {ADV} AS adv FROM (SELECT a.*, h.horizon_ms, b.open_time_ms AS t, b.high, b.low, b.close FROM anchors a CROSS JOIN horizon_list h
JOIN tiny_bars b ON a.symbol = b.symbol AND b.open_time_ms >= (a.asof_ms + {DAY - 1}) // {DAY} * {DAY} AND b.open_time_ms <= a.asof_ms + h.horizon_ms)""",
)
cte("tracker_outcomes", outcome_sql("tracker_pairs"))


@query(
    "l05_stop_path_full",
    f"""SELECT trigger_id, horizon_ms, stop_pct, result, bars, first_target_ms IS NOT NULL AS target_reached, first_stop_ms IS NOT NULL AS stop_reached, first_target_ms, first_stop_ms,
  CASE WHEN result <> 'OPEN' THEN least(first_target_ms, first_stop_ms) END AS resolution_ms, round(greatest(0, first_target_ms - asof_ms) / 60000.0, 2) AS minutes_to_target,
  round(greatest(0, first_stop_ms - asof_ms) / 60000.0, 2) AS minutes_to_stop
FROM (SELECT *, first_target_ms AS ft, first_stop_ms AS fs FROM tracker_outcomes)""".replace("greatest(0, first_target_ms - asof_ms)", "CASE WHEN first_target_ms IS NOT NULL THEN greatest(0, first_target_ms - asof_ms) END").replace("greatest(0, first_stop_ms - asof_ms)", "CASE WHEN first_stop_ms IS NOT NULL THEN greatest(0, first_stop_ms - asof_ms) END"),
)
def l05(spark, sf):
    o = lab.horizon_table(facts(spark, sf, "ceil"), "trigger_id", TARGET, STOPS, HORIZONS, "ceil")
    timed = {
        c: F.when(F.col(r), F.round(c, 2)) for c, r in (("minutes_to_target", "target_reached"), ("minutes_to_stop", "stop_reached"))
    }
    return o.withColumns(timed).select(
        *ID, "stop_pct", "result", "bars", "target_reached", "stop_reached", "first_target_ms", "first_stop_ms",
        "resolution_ms", "minutes_to_target", "minutes_to_stop",
    )


# --- learning labels -------------------------------------------------------

BARRIERS = [(1.0, 0.5), (2.0, 1.5), (3.0, 2.0)]
ML_HORIZONS = [20 * DAY, 40 * DAY, 60 * DAY]
cte("ml_anchors", "SELECT concat(symbol, '-', asof_ms) AS row_id, symbol, direction AS bias, asof_ms, entry_price FROM ml_features")
cte("barrier_list", "SELECT unnest([%s]) AS b" % ", ".join(f"{{'t': {t}::DOUBLE, 's': {s}::DOUBLE}}" for t, s in BARRIERS))
cte(
    "ml_pairs",
    f"""SELECT *, {FAV} AS fav, {ADV} AS adv, t - (min(t) OVER (PARTITION BY row_id)) + {DAY} AS elapsed, (min(t) OVER (PARTITION BY row_id)) - {DAY} AS origin FROM (
  SELECT a.*, b.close_time_ms AS t, b.high, b.low, b.close FROM ml_anchors a JOIN tiny_bars b ON a.symbol = b.symbol AND b.close_time_ms >= a.asof_ms AND b.close_time_ms < a.asof_ms + {HORIZON} + 1)""",
)
cte(
    "ml_labels",
    f"""SELECT *, CASE WHEN path = 'TARGET_FIRST' THEN target_pct WHEN path IN ('STOP_FIRST', 'AMBIGUOUS') THEN -stop_pct ELSE close_return_pct END AS sim_return_pct,
  CASE WHEN path IN ('TARGET_FIRST', 'AMBIGUOUS') THEN (tt - origin) / 60000.0::DOUBLE END AS time_to_target_min,
  CASE WHEN path IN ('TARGET_FIRST', 'AMBIGUOUS') THEN mae_upto END AS mae_before_target_pct FROM (
 SELECT *, CASE WHEN tt IS NULL AND ts IS NULL THEN 'OPEN' WHEN ts IS NULL OR tt < ts THEN 'TARGET_FIRST' WHEN tt IS NULL OR ts < tt THEN 'STOP_FIRST' ELSE 'AMBIGUOUS' END AS path FROM (
  SELECT row_id, origin, horizon_ms, target_pct, stop_pct, min(t) FILTER (WHERE fav >= target_pct) AS tt, min(t) FILTER (WHERE adv <= -stop_pct) AS ts,
   greatest(0, max(fav)) AS mfe_pct, least(0, min(adv)) AS mae_pct, arg_max({RET.format('close')}, t) AS close_return_pct, least(0, min(adv) FILTER (WHERE t <= ft)) AS mae_upto
  FROM (SELECT p.*, h.horizon_ms, l.b.t AS target_pct, l.b.s AS stop_pct, min(CASE WHEN fav >= l.b.t THEN p.t END) OVER (PARTITION BY row_id, h.horizon_ms, l.b.t) AS ft
    FROM ml_pairs p CROSS JOIN (SELECT unnest({ML_HORIZONS})::BIGINT AS horizon_ms) h CROSS JOIN barrier_list l WHERE p.elapsed <= h.horizon_ms) GROUP BY ALL))""",
)


def ml_facts(spark, sf):
    tiny, rows, ctx = ml_rows(spark, sf)
    return facts_of(tiny, rows), ctx


def facts_of(tiny, rows):
    a = rows.select(
        F.concat_ws("-", "symbol", F.col("asof_ms").cast("string")).alias("row_id"), "symbol", F.col("direction").alias("bias"), "asof_ms", "entry_price"
    )
    return lab.path_facts(
        cut(a), tiny, "row_id", [t for t, _ in BARRIERS], [s for _, s in BARRIERS], ML_HORIZONS, BUCKET, "close", TINY
    )


def ml_labels(spark, sf):
    f, _ = ml_facts(spark, sf)
    return lab.label_grid(f, "row_id", BARRIERS, ML_HORIZONS)


LID = ["row_id", "horizon_ms", "target_pct"]


@query(
    "l06_path_label",
    """SELECT row_id, horizon_ms, target_pct, stop_pct, path, round(time_to_target_min, 4) AS time_to_target_min, round(mae_before_target_pct, 6) + 0.0 AS mae_before_target_pct,
  round(close_return_pct, 6) + 0.0 AS close_return_pct, round(sim_return_pct, 6) + 0.0 AS sim_return_pct FROM ml_labels""",
)
def l06(spark, sf):
    return rnd(ml_labels(spark, sf).select(
        *LID, "stop_pct", "path", "time_to_target_min", "mae_before_target_pct", "close_return_pct", "sim_return_pct"
    ), 6)


GOAL, STOP_AT, WITHIN = *BARRIERS[1], ML_HORIZONS[1]
GOAL_NAMES = {k: dataset.label_name(k, GOAL, STOP_AT, WITHIN) for k in ("target", "ambiguous", "sim_return")}


def learning_table(spark, sf):
    tiny, rows, _ = ml_rows(spark, sf)
    rows = cut(rows)
    labels = lab.label_grid(facts_of(tiny, rows), "row_id", BARRIERS, ML_HORIZONS)
    return dataset.learning_rows(rows, labels, BARRIERS, ML_HORIZONS)


@query(
    "c06_learning_rows",
    f"""SELECT f.row_id, f.symbol, f.asof_ms, f.bias AS direction, CAST(path = 'TARGET_FIRST' AS INT) AS {GOAL_NAMES['target']}, CAST(path = 'AMBIGUOUS' AS INT) AS {GOAL_NAMES['ambiguous']},
  round(sim_return_pct, 6) + 0.0 AS {GOAL_NAMES['sim_return']}
FROM ml_anchors f JOIN ml_labels l ON f.row_id = l.row_id WHERE target_pct = {GOAL} AND horizon_ms = {WITHIN}""",
)
def c06b(spark, sf):
    return rnd(learning_table(spark, sf).select("row_id", "symbol", "asof_ms", "direction", *GOAL_NAMES.values()), 6)


PIV = [(t, h) for t, _ in BARRIERS for h in ML_HORIZONS]


@query(
    "l07_label_grid",
    "SELECT row_id, " + ", ".join(
        f"max(CAST(path = 'TARGET_FIRST' AS INT)) FILTER (WHERE target_pct = {t} AND horizon_ms = {h}) AS target{t:g}_{h // DAY}d, "
        f"max(CAST(tt IS NOT NULL AS INT)) FILTER (WHERE target_pct = {t} AND horizon_ms = {h}) AS eventual{t:g}_{h // DAY}d" for t, h in PIV
    ) + " FROM ml_labels GROUP BY row_id",
)
def l07(spark, sf):
    on = lambda t, h: (F.col("target_pct") == t) & (F.col("horizon_ms") == h)
    return ml_labels(spark, sf).groupBy("row_id").agg(
        *[F.max(F.when(on(t, h), F.col("target_before_stop"))).alias(f"target{t:g}_{h // DAY}d") for t, h in PIV],
        *[F.max(F.when(on(t, h), F.col("eventual_target"))).alias(f"eventual{t:g}_{h // DAY}d") for t, h in PIV],
    )


PRIMARY = f"target_pct = {BARRIERS[1][0]} AND horizon_ms = {ML_HORIZONS[1]}"


@query("l08_clean_volatile", f"SELECT row_id, CAST(path = 'TARGET_FIRST' AS INT) AS clean, CAST(tt IS NOT NULL AND path IN ('STOP_FIRST', 'AMBIGUOUS') AS INT) AS volatile FROM ml_labels WHERE {PRIMARY}")
def l08(spark, sf):
    return lab.clean_volatile(ml_labels(spark, sf).filter(PRIMARY)).select("row_id", "clean", "volatile")


@query("l09_complete_window", "SELECT trigger_id FROM complete_ids")
def l09(spark, sf):
    return lab.complete_anchors(facts(spark, sf), HORIZONS, DAY).select("trigger_id")


NOW_SQL = "(SELECT max(asof_ms) FROM anchors)"
DONE_SQL = f"(a.asof_ms // {FINE} % 2 = 0 AND h.horizon_ms = {HORIZONS[0]})"


@query(
    "l10_matured",
    f"SELECT a.trigger_id, h.horizon_ms FROM anchors a CROSS JOIN horizon_list h WHERE {NOW_SQL} - a.asof_ms >= h.horizon_ms AND NOT {DONE_SQL}",
)
def l10(spark, sf):
    _, a = anchors(spark, sf)
    done = a.filter(F.floor(F.col("asof_ms") / FINE) % 2 == 0).select("trigger_id", F.lit(HORIZONS[0]).cast("bigint").alias("horizon_ms"))
    return lab.matured(a, done, HORIZONS, a.agg(F.max("asof_ms")).scalar()).select("trigger_id", "horizon_ms")


@query(
    "a14_pending_outcomes",
    f"""SELECT h.horizon_ms, count(*) FILTER (WHERE {NOW_SQL} - a.asof_ms >= h.horizon_ms AND NOT {DONE_SQL}) AS pending
FROM anchors a CROSS JOIN horizon_list h GROUP BY h.horizon_ms""",
)
def a14(spark, sf):
    _, a = anchors(spark, sf)
    done = a.filter(F.floor(F.col("asof_ms") / FINE) % 2 == 0).select("trigger_id", F.lit(HORIZONS[0]).cast("bigint").alias("horizon_ms"))
    return cohorts.pending_outcomes(a, done, HORIZONS, a.agg(F.max("asof_ms")).scalar())


# --- paper trades ----------------------------------------------------------

TP, SL = 2.0, 2.5
cte("trades_in", f"SELECT trigger_id AS id, symbol, bias AS side, asof_ms - asof_ms % {DAY} + {DAY} AS entry_ms FROM trigger_rows")
cte("runs", f"SELECT *, open_time_ms - pos * {DAY} AS run_id FROM tiny_pos WHERE open_time_ms + {DAY} <= (SELECT max(open_time_ms) FROM tiny_bars)")
cte(
    "trade_pairs",
    f"""SELECT *, fav >= {TP} - 1e-9 AS ht, adv >= {SL} - 1e-9 AS hs FROM (SELECT *, CASE WHEN side = 'LONG' THEN (o / entry_price - 1) * 100 ELSE -(o / entry_price - 1) * 100 END AS opening,
  CASE WHEN side = 'LONG' THEN (high / entry_price - 1) * 100 ELSE (1 - low / entry_price) * 100 END AS fav,
  CASE WHEN side = 'LONG' THEN (1 - low / entry_price) * 100 ELSE (high / entry_price - 1) * 100 END AS adv FROM (
  SELECT t.*, e.open AS entry_price, b.open_time_ms AS t, b.open AS o, b.high, b.low FROM trades_in t JOIN runs e ON t.symbol = e.symbol AND t.entry_ms = e.open_time_ms
  JOIN runs b ON b.symbol = t.symbol AND b.run_id = e.run_id AND b.open_time_ms >= t.entry_ms))""",
)
cte(
    "trade_exits",
    f"""SELECT id, arg_min(CASE WHEN opening >= {TP} OR (opening > -{SL} AND ht AND NOT hs) THEN 'TARGET' WHEN opening > -{SL} AND opening < {TP} AND ht AND hs THEN 'AMBIGUOUS_LOSS' ELSE 'STOP' END, t) AS status, min(t) AS x,
  arg_min(CASE WHEN opening <= -{SL} THEN least(-{SL}, opening) WHEN opening >= {TP} OR (opening > -{SL} AND ht AND NOT hs) THEN {TP} ELSE -{SL} END::DOUBLE, t) AS gross
FROM trade_pairs WHERE opening <= -{SL} OR opening >= {TP} OR ht OR hs GROUP BY id""",
)
cte(
    "trades_out",
    f"""SELECT i.id, i.symbol, i.side, i.entry_ms, p.entry_price, CASE WHEN p.entry_price IS NULL THEN 'PENDING' ELSE coalesce(x.status, 'OPEN') END AS status, x.x AS resolved_bar_ms,
  coalesce(p.mae, 0) AS mae_pct, coalesce(p.mfe, 0) AS mfe_pct, x.gross AS gross_return_pct, (x.x + {DAY} - i.entry_ms) / {HOUR}.0::DOUBLE AS holding_hours,
  x.gross - (0.12 + 0.01 * ceil((x.x + {DAY} - i.entry_ms) / {HOUR}.0 / 8)) AS net_return_pct, x.gross - (0.5 + 0.01 * ceil((x.x + {DAY} - i.entry_ms) / {HOUR}.0 / 8)) AS stressed_net_return_pct
FROM trades_in i LEFT JOIN trade_exits x ON i.id = x.id LEFT JOIN (SELECT q.id, any_value(q.entry_price) AS entry_price, greatest(0, max(q.adv)) AS mae, greatest(0, max(q.fav)) AS mfe
  FROM trade_pairs q LEFT JOIN trade_exits y ON q.id = y.id WHERE y.x IS NULL OR q.t <= y.x GROUP BY q.id) p ON i.id = p.id""",
)


def trades(spark, sf):
    tiny, t = trigger_rows(spark, sf)
    entries = t.select(F.col("trigger_id").alias("id"), "symbol", F.col("bias").alias("side"), grid.next_bucket("asof_ms", DAY).alias("entry_ms"))
    now = tiny.agg(F.max("open_time_ms")).scalar()
    return t, lab.gap_aware_exit(entries, tiny, TINY, now, TP, SL)


@query(
    "l11_gap_aware_exit",
    f"SELECT id, symbol, side, entry_ms, round(entry_price, 9) AS entry_price, status, resolved_bar_ms, {R9(['mae_pct', 'mfe_pct', 'gross_return_pct'])}, holding_hours FROM trades_out",
)
def l11(spark, sf):
    _, t = trades(spark, sf)
    return rnd(t.drop("net_return_pct", "stressed_net_return_pct"))


@query("l12_costs", "SELECT id, round(holding_hours, 6) AS holding_hours, round(net_return_pct, 6) AS net_return_pct, round(stressed_net_return_pct, 6) AS stressed_net_return_pct FROM trades_out WHERE resolved_bar_ms IS NOT NULL")
def l12(spark, sf):
    _, t = trades(spark, sf)
    return rnd(t.filter("resolved_bar_ms is not null").select("id", "holding_hours", "net_return_pct", "stressed_net_return_pct"), 6)


# --- cohorts and gates -----------------------------------------------------


@query("a03_rate_summary", f"SELECT horizon_ms, count(*) AS samples, count(first_target_ms) AS target_hits, round(count(first_target_ms) / count(*), 4) AS target_hit_rate FROM outcomes WHERE {ONE} GROUP BY horizon_ms")
def a03(spark, sf):
    return cohorts.rate_summary(outcomes(spark, sf).filter(ONE))


@query(
    "a04_cohort_report",
    f"""SELECT horizon_ms, CASE WHEN grouping(market_regime) = 1 AND grouping(quality_bucket) = 1 THEN 'overall' WHEN grouping(quality_bucket) = 1 THEN 'by_market_regime'
  WHEN grouping(market_regime) = 1 THEN 'by_quality_bucket' ELSE 'by_market_regime_quality_bucket' END AS cohort, coalesce(market_regime, '*') AS market_regime, coalesce(quality_bucket, '*') AS quality_bucket,
  count(*) AS samples, count(first_target_ms) AS target_hits, round(count(first_target_ms) / count(*), 4) AS target_hit_rate
FROM outcomes WHERE {ONE} GROUP BY GROUPING SETS ((horizon_ms), (horizon_ms, market_regime), (horizon_ms, quality_bucket), (horizon_ms, market_regime, quality_bucket))""",
)
def a04(spark, sf):
    return cohorts.cohort_report(outcomes(spark, sf).filter(ONE))


LAST = f"horizon_ms = {HORIZONS[-1]}"
cte(
    "stop_sums",
    f"""SELECT stop_pct, count(*) AS samples, count(*) FILTER (WHERE result = 'TARGET_FIRST') AS target_first, count(*) FILTER (WHERE result = 'STOP_FIRST') AS stop_first,
  count(*) FILTER (WHERE result = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (WHERE result = 'OPEN') AS open_at_end, round(count(*) FILTER (WHERE result = 'TARGET_FIRST') / count(*), 4) AS target_first_rate,
  round(avg(sim_return_pct), 4) AS average_simulated_return_pct, round(median(sim_return_pct), 4) AS median_simulated_return_pct FROM outcomes WHERE {LAST} GROUP BY stop_pct""",
)


@query("a05_stop_summary", "SELECT * FROM stop_sums")
def a05(spark, sf):
    return cohorts.stop_summary(outcomes(spark, sf).filter(LAST))


QS = [0.5, 0.75, 0.9, 0.95]


@query(
    "a06_quantiles",
    f"""SELECT count(m) AS samples, {', '.join(f'round(quantile_cont(m, {q}), 4) AS p{int(q * 100)}' for q in QS)}, {', '.join(f'round(quantile_cont(w, {q}), 4) AS minutes_p{int(q * 100)}' for q in QS)}
FROM (SELECT abs(mae_upto) AS m, minutes_to_target AS w FROM outcomes WHERE {ONE} AND {LAST} AND first_target_ms IS NOT NULL)""",
)
def a06(spark, sf):
    won = outcomes(spark, sf).filter(ONE).filter(LAST).filter("target_reached")
    won = cut(won.select(F.abs("mae_before_target_pct").alias("m"), "minutes_to_target"))
    names = [f"p{int(q * 100)}" for q in QS]
    drawdown = cohorts.exact_quantiles(won, "m", QS)
    minutes = cohorts.exact_quantiles(won, "minutes_to_target", QS)
    row = minutes.select(F.struct(*names).alias("m")).scalar()
    return rnd(drawdown.withColumn("_m", row).select("samples", *names, *[F.col(f"_m.{n}").alias(f"minutes_{n}") for n in names]), 4)


@query("a07_best_stop", "SELECT (SELECT stop_pct FROM stop_sums ORDER BY average_simulated_return_pct DESC, stop_pct LIMIT 1) AS best_stop_pct")
def a07(spark, sf):
    return cohorts.best_stop(cohorts.stop_summary(outcomes(spark, sf).filter(LAST)))


cte(
    "gate_rows",
    f"""SELECT market_regime, quality_bucket, count(*) AS samples, count(first_target_ms) AS target_hits, round(count(first_target_ms) / count(*), 4) AS target_hit_rate,
  count(*) >= 5 AND count(first_target_ms) / count(*) >= 0.60 AS allowed FROM outcomes WHERE {ONE} AND {LAST} GROUP BY market_regime, quality_bucket""",
)


def gate(spark, sf):
    return cohorts.gate_groups(outcomes(spark, sf).filter(ONE).filter(LAST), min_samples=5)


@query("a08_gate_groups", "SELECT * FROM gate_rows")
def a08(spark, sf):
    return gate(spark, sf)


@query("a08_gate_status", "SELECT CAST(coalesce(sum(samples), 0) AS BIGINT) AS total, count(*) FILTER (WHERE allowed) AS allowed_groups, coalesce(sum(samples), 0) >= 50 AND count(*) FILTER (WHERE allowed) > 0 AS enabled FROM gate_rows")
def a08s(spark, sf):
    return cohorts.gate_status(gate(spark, sf), min_total=50)


# Low enough that some values pass on the fixture.
RATE = 0.02


@query(
    "a08_marginal_gate",
    f"""SELECT 'market_regime' AS dimension, market_regime AS value, count(*) AS samples FROM outcomes WHERE {ONE} AND {LAST} GROUP BY market_regime HAVING count(*) >= 5 AND count(first_target_ms) / count(*) >= {RATE}
UNION ALL SELECT 'quality_bucket', quality_bucket, count(*) FROM outcomes WHERE {ONE} AND {LAST} GROUP BY quality_bucket HAVING count(*) >= 5 AND count(first_target_ms) / count(*) >= {RATE}""",
)
def a08m(spark, sf):
    return cohorts.marginal_gate(outcomes(spark, sf).filter(ONE).filter(LAST), min_samples=5, min_rate=RATE)


@query(
    "a08_marginal_status",
    f"""WITH o AS (SELECT * FROM outcomes WHERE {ONE} AND {LAST}),
a AS (SELECT market_regime FROM o GROUP BY 1 HAVING count(*) >= 5 AND count(first_target_ms) / count(*) >= {RATE}),
b AS (SELECT quality_bucket FROM o GROUP BY 1 HAVING count(*) >= 5 AND count(first_target_ms) / count(*) >= {RATE})
SELECT (SELECT count(*) FROM a) AS allowed_market_regime, (SELECT count(*) FROM b) AS allowed_quality_bucket, (SELECT count(*) FROM o) AS total,
  (SELECT count(*) FROM o) >= 50 AND (SELECT count(*) FROM a) > 0 AND (SELECT count(*) FROM b) > 0 AS ready_for_review, false AS enabled""",
)
def a08ms(spark, sf):
    rows = outcomes(spark, sf).filter(ONE).filter(LAST)
    return cohorts.marginal_status(rows, cohorts.marginal_gate(rows, min_samples=5, min_rate=RATE), min_total=50)


@query(
    "a09_dataset_meta",
    f"""SELECT count(l.row_id) AS row_count, (SELECT count(*) FROM sample_grid) AS timestamp_count, count(*) FILTER (WHERE path = 'TARGET_FIRST') AS positive_count, count(*) FILTER (WHERE path = 'AMBIGUOUS') AS ambiguous_count,
  round(count(*) FILTER (WHERE path = 'TARGET_FIRST') / greatest(1, count(l.row_id))::DOUBLE, 9) AS positive_rate, round(count(l.row_id) / (SELECT count(*) FROM sample_grid), 9) AS mean_candidates_per_timestamp,
  (SELECT count(*) FROM ml_context WHERE market_regime = 'RISK_ON') AS regime_risk_on, (SELECT count(*) FROM sample_grid g LEFT JOIN ml_context c ON g.asof_ms = c.asof_ms WHERE coalesce(market_regime, 'MIXED') = 'MIXED') AS regime_mixed,
  (SELECT count(*) FROM ml_context WHERE market_regime = 'RISK_OFF') AS regime_risk_off FROM ml_labels l WHERE {PRIMARY}""",
)
def a09(spark, sf):
    tiny, found, ctx = ml_rows(spark, sf)
    rows = lab.label_grid(facts_of(tiny, found), "row_id", BARRIERS, ML_HORIZONS, carry=("asof_ms",)).filter(PRIMARY)
    times = grid.asof_grid(grid.common_window(tiny, 30 * COARSE, HORIZON), FINE)
    return rnd(cohorts.dataset_meta(times, ctx, rows, "target_before_stop", "ambiguous"))


@query("a15_latest_in_log", "SELECT symbol, open_time_ms, close, trades FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms DESC) AS rn FROM fine_bars) WHERE rn = 1")
def a15(spark, sf):
    from barlytics.catalog.base import bars

    return cohorts.latest_in_log(bars(spark, sf).select("symbol", "open_time_ms", "close", "trades"), "open_time_ms", ["symbol"])


cte("all_frames", "SELECT symbol, '1d' AS interval, open_time_ms FROM tiny_bars UNION ALL SELECT symbol, '3d', open_time_ms FROM fine_bars UNION ALL SELECT symbol, '12d', open_time_ms FROM coarse_bars")
MINIMUM = {"1d": 2000, "3d": 600, "12d": 208}


@query(
    "a16_symbol_completeness",
    f"""SELECT *, skip_reason IS NULL AS usable, count(*) FILTER (WHERE skip_reason IS NULL) OVER () >= 5 AS enough FROM (SELECT *, CASE WHEN rows_1d = 0 OR rows_3d = 0 OR rows_12d = 0 THEN 'missing interval file'
  WHEN rows_1d < 2000 OR rows_3d < 600 OR rows_12d < 208 THEN 'insufficient history' END AS skip_reason FROM (SELECT symbol, {', '.join(f"count(*) FILTER (WHERE interval = '{k}') AS rows_{k}" for k in MINIMUM)} FROM all_frames GROUP BY symbol))""",
)
def a16(spark, sf):
    tiny, fine, coarse = frames(spark, sf, TINY, FINE, COARSE)
    named = None
    for df, name in ((tiny, "1d"), (fine, "3d"), (coarse, "12d")):
        part = df.select("symbol", F.lit(name).alias("interval"))
        named = part if named is None else named.unionByName(part)
    return cohorts.symbol_completeness(named, MINIMUM)
