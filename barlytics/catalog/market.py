"""Queries over the cross-section: context, scores, ranks, state changes, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlytics.catalog.base import (
    COARSE, DAY, FINE, HOUR, LEAD, SECOND, TINY, candidates, cte, frames, query, rnd, stored_bars, table,
)
from barlytics.catalog.scalars import CAND, KEY
from barlytics.catalog.series import DAILY_ALL, RSI_REC, STOCH, core, day_sql, ema_sql, since, win
from barlytics.functions import gates, rules, scalar as sc
from barlytics.operators import grid, indicators as ind, joins
from barlytics.operators.blocks import prefix, roll
from barlytics.operators.grid import floor_bucket
from barlytics.plans import backtest, dataset, setups as plan, states
from barlytics.session import cut

# --- context ---------------------------------------------------------------

cte("times", "SELECT DISTINCT asof_ms FROM fine_feat")
cte(
    "known",
    """SELECT t.asof_ms, s.symbol, f.chg24, f.pos FROM times t CROSS JOIN (SELECT DISTINCT symbol FROM fine_feat) s
ASOF JOIN fine_feat f ON s.symbol = f.symbol AND t.asof_ms > f.close_time_ms""",
)
cte(
    "context",
    f"""SELECT asof_ms, count(*) AS liquid_universe_count, count(*) FILTER (WHERE chg24 > 0) AS advancers_24h,
  count(*) FILTER (WHERE chg24 < 0) AS decliners_24h, count(*) FILTER (WHERE chg24 = 0) AS unchanged_24h,
  round(100.0 * count(*) FILTER (WHERE chg24 > 0) / count(*), 2) AS breadth_positive_pct, round(median(chg24), 3) + 0.0 AS median_24h_change_pct,
  round(coalesce(max(chg24) FILTER (WHERE symbol = '{LEAD}'), 0), 3) + 0.0 AS btc_24h_change_pct,
  round(coalesce(max(chg24) FILTER (WHERE symbol = '{SECOND}'), 0), 3) + 0.0 AS eth_24h_change_pct
FROM known WHERE pos >= 24 GROUP BY asof_ms""",
)
RANKED = """(CASE WHEN breadth_positive_pct >= 65 THEN 2 WHEN breadth_positive_pct >= 55 THEN 1 WHEN breadth_positive_pct <= 35 THEN -2 WHEN breadth_positive_pct <= 45 THEN -1 ELSE 0 END
  + CASE WHEN median_24h_change_pct >= 1 THEN 2 WHEN median_24h_change_pct > 0 THEN 1 WHEN median_24h_change_pct <= -1 THEN -2 WHEN median_24h_change_pct < 0 THEN -1 ELSE 0 END
  + CASE WHEN btc_24h_change_pct >= 0.5 THEN 1 WHEN btc_24h_change_pct <= -0.5 THEN -1 ELSE 0 END
  + CASE WHEN eth_24h_change_pct >= 0.5 THEN 1 WHEN eth_24h_change_pct <= -0.5 THEN -1 ELSE 0 END)"""
cte(
    "regimes",
    """SELECT *, CASE WHEN market_regime_score >= 3 THEN 'RISK_ON' WHEN market_regime_score <= -3 THEN 'RISK_OFF' ELSE 'MIXED' END AS market_regime
FROM (SELECT *, %s AS market_regime_score FROM context)""" % RANKED,
)


def context(spark, sf):
    fine = cut(plan.fine_features(stored_bars(spark, sf), FINE))
    return plan.context_from_fine(fine, LEAD, SECOND, FINE)


@query("a01_market_context", "SELECT * FROM context")
def a01(spark, sf):
    return context(spark, sf)


@query("c09_market_regime_ranked", "SELECT asof_ms, market_regime, CAST(market_regime_score AS INT) AS market_regime_score FROM regimes")
def c09(spark, sf):
    return plan.with_regime(context(spark, sf)).select("asof_ms", "market_regime", "market_regime_score")


# --- learning-row universe -------------------------------------------------

DAY_BARS, HOUR_BARS, HORIZON = 24, 12, 60 * DAY
MIN_TURNOVER = 1.0
D = day_sql(DAY_BARS)
cte(
    "base_frame",
    f"""SELECT symbol, close_time_ms AS b_close_ms, close AS entry_price, {', '.join(f'{e} AS {c}' for c, e in D.items())},
  {since(11, f"sum(taker_buy_quote_volume) {win(11)} / sum(quote_volume) {win(11)}")} AS taker_buy_ratio_1h FROM tiny_pos QUALIFY pos >= {DAY_BARS}""",
)
cte(
    "sample_grid",
    f"""SELECT unnest(generate_series(start_ms - start_ms % {FINE} + {FINE} + 1, end_ms, {FINE})) AS asof_ms
FROM window_bounds WHERE start_ms - start_ms % {FINE} + {FINE} + 1 <= end_ms""",
)
cte(
    "liquid",
    f"""SELECT *, row_number() OVER (PARTITION BY asof_ms ORDER BY activity_score DESC, symbol) AS activity_rank FROM (
  SELECT g.asof_ms, s.symbol, b.* EXCLUDE (symbol), least(quote_volume_24h / 25e6, 20) + least(abs(price_change_24h_pct), 6) * 2
    - CASE WHEN abs(price_change_24h_pct) >= 12 THEN 10 ELSE 0 END AS activity_score
  FROM sample_grid g CROSS JOIN (SELECT DISTINCT symbol FROM tiny_bars) s
  ASOF JOIN base_frame b ON s.symbol = b.symbol AND g.asof_ms > b.b_close_ms) WHERE quote_volume_24h >= {MIN_TURNOVER}""",
)
cte(
    "ml_context",
    f"""SELECT *, CASE WHEN market_regime_score >= 3 THEN 'RISK_ON' WHEN market_regime_score <= -3 THEN 'RISK_OFF' ELSE 'MIXED' END AS market_regime FROM (
  SELECT asof_ms, a / greatest(1, a + d)::DOUBLE * 100 AS market_breadth_pct, med AS market_median_change_24h_pct, btc AS btc_change_24h_pct,
    eth AS eth_change_24h_pct, n AS liquid_symbol_count,
    CASE WHEN 100.0 * a / n >= 55 THEN 1 WHEN 100.0 * a / n <= 45 THEN -1 ELSE 0 END + sign(med)::INT + sign(btc)::INT + sign(eth)::INT AS market_regime_score
  FROM (SELECT asof_ms, count(*) AS n, count(*) FILTER (WHERE price_change_24h_pct > 0) AS a, count(*) FILTER (WHERE price_change_24h_pct < 0) AS d,
    median(price_change_24h_pct) AS med, coalesce(max(price_change_24h_pct) FILTER (WHERE symbol = '{LEAD}'), 0) AS btc,
    coalesce(max(price_change_24h_pct) FILTER (WHERE symbol = '{SECOND}'), 0) AS eth FROM liquid GROUP BY asof_ms))""",
)


def universe(spark, sf):
    tiny = stored_bars(spark, sf, TINY)
    times = grid.asof_grid(grid.common_window(tiny, 30 * COARSE, HORIZON), FINE)
    return dataset.universe(dataset.base_frame(tiny, TINY, DAY_BARS, HOUR_BARS), times, TINY, MIN_TURNOVER)


R9 = lambda cols: ", ".join(f"round({c}, 9) + 0.0 AS {c}" for c in cols)
CTX_NUM = ["market_breadth_pct", "market_median_change_24h_pct", "btc_change_24h_pct", "eth_change_24h_pct"]


@query(
    "a02_market_context_ml",
    f"SELECT asof_ms, market_regime, CAST(market_regime_score AS INT) AS market_regime_score, liquid_symbol_count, {R9(CTX_NUM)} FROM ml_context",
)
def a02(spark, sf):
    return rnd(plan.market_context_ml(universe(spark, sf), LEAD, SECOND))


@query("c07_activity_score", "SELECT asof_ms, symbol, round(activity_score, 9) AS activity_score FROM liquid")
def c07(spark, sf):
    return rnd(universe(spark, sf).select("asof_ms", "symbol", "activity_score"))


@query("c10_market_regime_votes", "SELECT market_regime, CAST(market_regime_score AS INT) AS market_regime_score, count(*) AS n FROM ml_context GROUP BY ALL")
def c10(spark, sf):
    ctx = plan.market_context_ml(universe(spark, sf), LEAD, SECOND)
    return ctx.groupBy("market_regime", "market_regime_score").agg(F.count(F.lit(1)).alias("n"))


@query("w18_activity_rank_top_n", "SELECT asof_ms, symbol, CAST(activity_rank AS INT) AS activity_rank FROM liquid WHERE activity_rank <= 3")
def w18(spark, sf):
    return plan.top_n(universe(spark, sf), ["asof_ms"], "activity_score", 3).select("asof_ms", "symbol", "activity_rank")


SMA10P = lambda c, n: since(n - 1, f"avg({c}) {win(n - 1)}")
OLD10 = since(14, f"avg(close) {win(14, 5)}")
LAGC = lambda k: f"lag(close, {k}) OVER (PARTITION BY symbol ORDER BY open_time_ms)"
VEX = f"CASE WHEN avg(quote_volume) {win(14, 3)} > 0 THEN avg(quote_volume) {win(2)} / avg(quote_volume) {win(14, 3)} ELSE 0 END"
cte(
    "trade_frame",
    f"""SELECT symbol, close_time_ms AS f_close_ms, close AS f_close, {SMA10P('close', 10)} AS f_sma10, {SMA10P('close', 20)} AS f_sma20, {OLD10} AS f_sma10_old,
  max(high) {win(11)} AS f_high12, min(low) {win(11)} AS f_low12, {LAGC(1)} AS f_prev, (close / {LAGC(3)} - 1) * 100 AS momentum_3h_pct,
  (close / {LAGC(12)} - 1) * 100 AS momentum_12h_pct, {VEX} AS volume_expansion_1h, avg(tr) {win(13)} / close * 100 AS atr_1h_pct,
  stddev_pop(lr) {win(11)} * sqrt(count(lr) {win(11)}) * 100 AS realized_vol_12h_pct FROM fine_tr QUALIFY pos >= 29""",
)
cte(
    "trend_frame",
    f"""SELECT symbol, close_time_ms AS h_close_ms, close AS h_close, {SMA10P('close', 10)} AS h_sma10, {SMA10P('close', 20)} AS h_sma20, {OLD10} AS h_sma10_old,
  (close / {LAGC(6)} - 1) * 100 AS momentum_24h_pct
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM coarse_bars) QUALIFY pos >= 24""",
)
cte(
    "confirm_frame",
    f"""SELECT symbol, close_time_ms AS c_close_ms, close AS c_close, {LAGC(1)} AS c_prev, {SMA10P('close', 4)} AS c_sma4, {SMA10P('close', 12)} AS c_sma12,
  (close / {LAGC(1)} - 1) * 100 AS momentum_15m_pct, (close / {LAGC(3)} - 1) * 100 AS momentum_45m_pct, (close / {LAGC(12)} - 1) * 100 AS momentum_180m_pct,
  {VEX} AS volume_expansion_15m
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM mid_bars) QUALIFY pos >= 19""",
)
P = lambda a, b: f"({a} / {b} - 1) * 100"
cte(
    "ml_features",
    f"""SELECT *, retest_ready * go AS trigger_like_1h FROM (
 SELECT *, direction_sign * momentum_3h_pct AS directional_momentum_3h, direction_sign * momentum_12h_pct AS directional_momentum_12h,
  direction_sign * momentum_24h_pct AS directional_momentum_24h, direction_sign * momentum_15m_pct AS directional_momentum_15m,
  direction_sign * momentum_45m_pct AS directional_momentum_45m, direction_sign * momentum_180m_pct AS directional_momentum_180m,
  direction_sign * distance_from_1h_sma10_pct AS directional_distance_from_1h_sma10_pct, direction_sign * distance_from_4h_sma10_pct AS directional_distance_from_4h_sma10_pct,
  direction_sign * (price_change_24h_pct - btc_change_24h_pct) AS relative_strength_vs_btc_24h, direction_sign * (price_change_24h_pct - eth_change_24h_pct) AS relative_strength_vs_eth_24h,
  CAST(CASE WHEN direction = 'LONG' THEN pullback_from_12h_high_pct BETWEEN -4 AND -0.75 AND distance_from_1h_sma10_pct BETWEEN -1.5 AND 1
    ELSE bounce_from_12h_low_pct BETWEEN 0.75 AND 4 AND distance_from_1h_sma10_pct BETWEEN -1 AND 1.5 END AS INT) AS retest_ready,
  CAST(volume_expansion_1h >= 0.9 AND CASE WHEN direction = 'LONG' THEN f_close > f_prev AND f_close >= f_sma10 ELSE f_close < f_prev AND f_close <= f_sma10 END AS INT) AS go,
  CAST(volume_expansion_15m >= 0.9 AND CASE WHEN direction = 'LONG' THEN c_close > c_prev AND c_close >= c_sma4 ELSE c_close < c_prev AND c_close <= c_sma4 END AS INT) AS confirmation_15m,
  abs(momentum_12h_pct) AS anti_chase_abs_12h_pct
 FROM (SELECT *, CASE WHEN direction = 'LONG' THEN 1.0 ELSE -1.0 END::DOUBLE AS direction_sign, {P('f_close', 'f_high12')} AS pullback_from_12h_high_pct,
   {P('f_close', 'f_low12')} AS bounce_from_12h_low_pct, {P('f_close', 'f_sma10')} AS distance_from_1h_sma10_pct, {P('h_close', 'h_sma10')} AS distance_from_4h_sma10_pct,
   {P('f_sma10', 'f_sma10_old')} AS sma1h10_slope_pct, {P('h_sma10', 'h_sma10_old')} AS sma4h10_slope_pct,
   {P('c_close', 'c_sma4')} AS distance_from_15m_sma4_pct, {P('c_close', 'c_sma12')} AS distance_from_15m_sma12_pct
  FROM (SELECT l.*, x.* EXCLUDE (asof_ms), f.* EXCLUDE (symbol), h.* EXCLUDE (symbol), c.* EXCLUDE (symbol), CASE
     WHEN f_close > f_sma10 AND f_sma10 > f_sma20 AND h_close > h_sma10 AND h_sma10 > h_sma20 AND f_sma10 > f_sma10_old AND h_sma10 > h_sma10_old THEN 'LONG'
     WHEN f_close < f_sma10 AND f_sma10 < f_sma20 AND h_close < h_sma10 AND h_sma10 < h_sma20 AND f_sma10 < f_sma10_old AND h_sma10 < h_sma10_old THEN 'SHORT' END AS direction
    FROM liquid l JOIN ml_context x ON l.asof_ms = x.asof_ms
    ASOF JOIN trade_frame f ON l.symbol = f.symbol AND l.asof_ms > f.f_close_ms
    ASOF JOIN trend_frame h ON l.symbol = h.symbol AND l.asof_ms > h.h_close_ms
    ASOF JOIN confirm_frame c ON l.symbol = c.symbol AND l.asof_ms > c.c_close_ms
    WHERE l.activity_rank <= 20) WHERE direction IS NOT NULL))""",
)
ML_NUM = [
    "direction_sign", "entry_price", "activity_score", "price_change_24h_pct", "taker_buy_ratio_24h", "taker_buy_ratio_1h",
    "momentum_3h_pct", "momentum_12h_pct", "momentum_24h_pct", "directional_momentum_3h", "directional_momentum_12h", "directional_momentum_24h",
    "pullback_from_12h_high_pct", "bounce_from_12h_low_pct", "distance_from_1h_sma10_pct", "directional_distance_from_1h_sma10_pct",
    "distance_from_4h_sma10_pct", "directional_distance_from_4h_sma10_pct", "sma1h10_slope_pct", "sma4h10_slope_pct", "volume_expansion_1h",
    "momentum_15m_pct", "momentum_45m_pct", "momentum_180m_pct", "directional_momentum_15m", "directional_momentum_45m", "directional_momentum_180m",
    "distance_from_15m_sma4_pct", "distance_from_15m_sma12_pct", "volume_expansion_15m", "atr_1h_pct", "realized_vol_12h_pct",
    "relative_strength_vs_btc_24h", "relative_strength_vs_eth_24h", "anti_chase_abs_12h_pct", *CTX_NUM,
]
ML_INT = ["retest_ready", "trigger_like_1h", "confirmation_15m", "activity_rank", "market_regime_score"]


def ml_rows(spark, sf):
    tiny, fine, coarse = frames(spark, sf, TINY, FINE, COARSE)
    rows, ctx = dataset.feature_rows(
        tiny, fine, coarse, TINY, FINE, COARSE, LEAD, SECOND, FINE, 3, DAY_BARS, HOUR_BARS, 30 * COARSE, HORIZON, MIN_TURNOVER
    )
    return tiny, rows, ctx


@query(
    "c06_directional_features",
    f"""SELECT asof_ms, symbol, direction, market_regime, liquid_symbol_count, round(quote_volume_24h, 2) AS quote_volume_24h,
  {', '.join(f'CAST({c} AS INT) AS {c}' for c in ML_INT)}, {', '.join(f'round({c}, 8) + 0.0 AS {c}' for c in ML_NUM)} FROM ml_features""",
)
def c06(spark, sf):
    _, rows, _ = ml_rows(spark, sf)
    return rows.select(
        "asof_ms", "symbol", "direction", "market_regime", "liquid_symbol_count", F.round("quote_volume_24h", 2).alias("quote_volume_24h"),
        *[F.col(c).cast("int").alias(c) for c in ML_INT], *[F.round(c, 8).alias(c) for c in ML_NUM],
    )


# --- quality score and ranking ---------------------------------------------


def cuts(v: str, steps: list[tuple[float, float]], other: float) -> str:
    return "CASE " + " ".join(f"WHEN {v} >= {a} THEN {b}" for a, b in steps) + f" ELSE {other} END"


cte(
    "scored_rows",
    f"""SELECT *, CASE WHEN bias = 'NEUTRAL' THEN 0 ELSE round(greatest(0, least(100, 18 + trend + st + di + vo + li + rs + re + ch + wa))::DOUBLE, 2) END AS swing_quality_score_v1 FROM (
 SELECT *, {cuts('d24', [(5, 16), (2, 12), (0.5, 7), (0, 3)], -10)} + {cuts('d12', [(3, 10), (1, 7), (0, 3)], -7)}
   + CASE WHEN d3 >= 0.5 THEN 7 WHEN d3 >= 0 THEN 3 WHEN d3 <= -1.5 THEN -6 ELSE -2 END AS trend,
  CASE setup_state WHEN 'CONTINUATION_TRIGGER' THEN 15 WHEN 'RETEST_READY' THEN 12 ELSE 4 END AS st,
  CASE WHEN ad <= 0.75 THEN 6 WHEN ad <= 1.5 THEN 3 WHEN ad <= 2.5 THEN 0 ELSE -5 END AS di,
  CASE WHEN volume_expansion_1h >= 1.5 THEN 10 WHEN volume_expansion_1h >= 1 THEN 6 WHEN volume_expansion_1h >= 0.7 THEN 2 WHEN volume_expansion_1h < 0.5 THEN -6 ELSE -2 END AS vo,
  CASE WHEN quote_volume_24h >= 100e6 THEN 6 WHEN quote_volume_24h >= 50e6 THEN 4 WHEN quote_volume_24h >= 20e6 THEN 2 WHEN quote_volume_24h < 10e6 THEN -4 ELSE 0 END AS li,
  CASE WHEN rs_market >= 5 THEN 8 WHEN rs_market >= 2 THEN 6 WHEN rs_market >= 0 THEN 2 WHEN rs_market <= -2 THEN -6 ELSE 0 END
   + CASE WHEN rs_btc >= 4 THEN 4 WHEN rs_btc >= 1 THEN 2 WHEN rs_btc <= -2 THEN -4 ELSE 0 END AS rs,
  CASE WHEN (bias = 'LONG' AND market_regime = 'RISK_ON') OR (bias = 'SHORT' AND market_regime = 'RISK_OFF') THEN 7
    WHEN (bias = 'LONG' AND market_regime = 'RISK_OFF') OR (bias = 'SHORT' AND market_regime = 'RISK_ON') THEN -10 ELSE 0 END AS re,
  CASE WHEN d12 >= 8 THEN -12 WHEN d12 >= 6 THEN -7 ELSE 0 END + CASE WHEN bias = 'LONG' AND (pullback_from_12h_high_pct > -0.5 OR pullback_from_12h_high_pct < -7) THEN -4
    WHEN bias = 'SHORT' AND (bounce_from_12h_low_pct < 0.5 OR bounce_from_12h_low_pct > 7) THEN -4 ELSE 0 END AS ch,
  -5 * len(list_filter(warnings, lambda w: contains(w, 'participation is weak') OR contains(w, 'extended')))
   - 2 * len(list_filter(warnings, lambda w: NOT (contains(w, 'participation is weak') OR contains(w, 'extended')))) AS wa
 FROM (SELECT *, s * momentum_3h_pct AS d3, s * momentum_12h_pct AS d12, s * momentum_24h_pct AS d24, abs(distance_from_1h_sma10_pct) AS ad,
   s * (price_change_24h_pct - btc_24h_change_pct) AS rs_btc, s * (price_change_24h_pct - median_24h_change_pct) AS rs_market
  FROM (SELECT c.*, r.* EXCLUDE (asof_ms), CASE WHEN bias = 'LONG' THEN 1 ELSE -1 END AS s FROM core c JOIN regimes r ON c.asof_ms = r.asof_ms)))""",
)


def scored_setups(spark, sf):
    fine_bars, coarse_bars = frames(spark, sf, FINE, COARSE)
    fine = cut(plan.fine_features(fine_bars, FINE))
    rows = plan.feature_core(plan.align(fine, plan.coarse_features(coarse_bars, COARSE), FINE))
    ctx = plan.with_regime(plan.context_from_fine(fine, LEAD, SECOND, FINE))
    return plan.score_rows(rows.join(ctx, "asof_ms"))


RS = """CASE WHEN bias <> 'NEUTRAL' THEN round(rs_btc, 3) + 0.0 END AS relative_strength_vs_btc_pct,
  CASE WHEN bias <> 'NEUTRAL' THEN round(rs_market, 3) + 0.0 END AS relative_strength_vs_market_pct"""


@query(
    "c08_quality_score",
    f"""SELECT symbol, asof_ms, swing_quality_score_v1, {RS}, CASE WHEN bias <> 'NEUTRAL' THEN trend::DOUBLE END AS trend_momentum,
  CASE WHEN bias <> 'NEUTRAL' THEN rs::DOUBLE END AS relative_strength, CASE WHEN bias <> 'NEUTRAL' THEN ch::DOUBLE END AS anti_chase FROM scored_rows""",
)
def c08(spark, sf):
    part = lambda c: F.col("quality_components")[c].alias(c)
    return scored_setups(spark, sf).select(
        "symbol", "asof_ms", "swing_quality_score_v1", "relative_strength_vs_btc_pct", "relative_strength_vs_market_pct",
        part("trend_momentum"), part("relative_strength"), part("anti_chase"),
    )


@query(
    "w17_rank_by",
    """SELECT asof_ms, symbol, swing_quality_score_v1, CAST(row_number() OVER (PARTITION BY asof_ms ORDER BY swing_quality_score_v1 DESC,
  CASE WHEN pos % 4 = 0 THEN 9999 ELSE pos % 4 END, symbol) AS INT) AS swing_quality_rank_v1 FROM scored_rows WHERE bias <> 'NEUTRAL'""",
)
def w17(spark, sf):
    rows = scored_setups(spark, sf).filter("bias <> 'NEUTRAL'").withColumn("activity_rank", F.col("pos") % 4)
    return plan.rank_by(rows, ["asof_ms"], "swing_quality_score_v1", "activity_rank").select(
        "asof_ms", "symbol", "swing_quality_score_v1", "swing_quality_rank_v1"
    )


cte(
    "trigger_rows",
    """SELECT *, concat(symbol, '-', asof_ms) AS trigger_id, CASE WHEN swing_quality_score_v1 BETWEEN 0 AND 49 THEN '0-49' WHEN swing_quality_score_v1 BETWEEN 50 AND 59 THEN '50-59'
  WHEN swing_quality_score_v1 BETWEEN 60 AND 69 THEN '60-69' WHEN swing_quality_score_v1 BETWEEN 70 AND 79 THEN '70-79' WHEN swing_quality_score_v1 BETWEEN 80 AND 100 THEN '80-100' ELSE 'other' END AS quality_bucket
FROM (SELECT *, lag(setup_state) OVER (PARTITION BY symbol ORDER BY asof_ms) AS prev_state FROM scored_rows)
WHERE setup_state = 'CONTINUATION_TRIGGER' AND (prev_state IS NULL OR prev_state <> 'CONTINUATION_TRIGGER') AND bias <> 'NEUTRAL'""",
)


def trigger_rows(spark, sf):
    """Triggers with scores plus the finest bars they are labelled on."""
    tiny, fine, coarse = frames(spark, sf, TINY, FINE, COARSE)
    return tiny, backtest.find_triggers(fine, coarse, FINE, COARSE, LEAD, SECOND)


@query("w21_edge_trigger", f"SELECT trigger_id, symbol, bias, asof_ms, price, swing_score, swing_quality_score_v1, quality_bucket, market_regime, {RS} FROM trigger_rows")
def w21(spark, sf):
    _, t = trigger_rows(spark, sf)
    return t.select(
        "trigger_id", "symbol", "bias", "asof_ms", "price", "swing_score", "swing_quality_score_v1", "quality_bucket",
        "market_regime", "relative_strength_vs_btc_pct", "relative_strength_vs_market_pct",
    )


@query(
    "w19_first_seen",
    "SELECT symbol, asof_ms, bias, setup_state, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY asof_ms) AS rn FROM core) WHERE rn = 1",
)
def w19(spark, sf):
    return states.first_seen(core(spark, sf), "asof_ms").select("symbol", "asof_ms", "bias", "setup_state", "price")


@query(
    "w20_state_transitions",
    """SELECT * FROM (SELECT symbol, asof_ms, 'SWING_STATE_TRANSITION' AS event, lag(setup_state) OVER z AS from_value, setup_state AS to_value FROM core WINDOW z AS (PARTITION BY symbol ORDER BY asof_ms)
UNION ALL SELECT symbol, asof_ms, 'SWING_BIAS_CHANGE', lag(bias) OVER z, bias FROM core WINDOW z AS (PARTITION BY symbol ORDER BY asof_ms)) WHERE from_value IS NOT NULL AND from_value <> to_value""",
)
def w20(spark, sf):
    ev = states.swing_events(core(spark, sf).withColumn("timestamp_ms", F.col("asof_ms")), FINE)
    return ev.filter(F.col("event").isin("SWING_STATE_TRANSITION", "SWING_BIAS_CHANGE")).select(
        "symbol", F.col("timestamp_ms").alias("asof_ms"), "event", "from_value", "to_value"
    )


# --- streaks, excursions, logs over scans ----------------------------------

cte(
    "streaks",
    f"""SELECT {CAND}, ok, CASE WHEN ok THEN row_number() OVER (PARTITION BY pair, island, ok ORDER BY scan_ms) ELSE 0 END AS streak FROM (
  SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY pair ORDER BY scan_ms) AS island FROM (
    SELECT {CAND}, score >= req AND len(blockers) = 0 AND spot AND oi_change_15m_pct > 0 AS ok FROM gate_cols))""",
)


@query("w22_qualifying_streak", f"SELECT {CAND}, ok, streak, ok AND streak >= 2 AS confirmed FROM streaks")
def w22(spark, sf):
    df = candidates(spark, sf).select(*KEY, gates.entry_gate(78.0)["ok"].alias("ok"))
    return states.streaks(cut(df), ["pair"], "scan_ms", 4096 * HOUR).select(
        *KEY, "ok", "streak", (F.col("ok") & (F.col("streak") >= 2)).alias("confirmed")
    )


@query(
    "w23_running_excursion",
    f"""SELECT {CAND}, round(ret, 6) + 0.0 AS ret, round(greatest(0, max(ret) OVER z), 6) AS mfe_pct, round(least(0, min(ret) OVER z), 6) + 0.0 AS mae_pct FROM (
  SELECT {CAND}, (current_price / first_value(current_price) OVER z - 1) * 100 AS ret FROM candidates WINDOW z AS (PARTITION BY pair ORDER BY scan_ms))
WINDOW z AS (PARTITION BY pair ORDER BY scan_ms)""",
)
def w23(spark, sf):
    df = cut(candidates(spark, sf))
    entry = df.groupBy("pair").agg(F.min_by("current_price", "scan_ms").alias("entry"))
    rows = df.join(joins.broadcast_if_small(entry), "pair").withColumn(
        "ret", sc.directional_return("entry", "current_price", F.lit("LONG"), "inverse")
    )
    out = states.excursions(rows, ["pair"], "scan_ms", "ret", 4096 * HOUR)
    return out.select(*KEY, *[(F.round(c, 6) + 0.0).alias(c) for c in ("ret", "mfe_pct", "mae_pct")])


LEVELS = {"tp2": 2.0, "tp3": 3.0, "tp4": 4.0, "sl1": -1.0, "sl15": -1.5, "sl2": -2.0}
HITS = ", ".join(f"min(scan_ms) FILTER (WHERE ret {'>=' if v > 0 else '<='} {v}) AS {k}_hit_at_ms" for k, v in LEVELS.items())


@query(
    "w24_first_hit_times",
    f"""SELECT pair, {HITS} FROM (SELECT {CAND}, (current_price / first_value(current_price) OVER (PARTITION BY pair ORDER BY scan_ms) - 1) * 100 AS ret FROM candidates) GROUP BY pair""",
)
def w24(spark, sf):
    df = candidates(spark, sf)
    entry = df.groupBy("pair").agg(F.min_by("current_price", "scan_ms").alias("entry"))
    rows = df.join(joins.broadcast_if_small(entry), "pair").withColumn("ret", (F.col("current_price") / F.col("entry") - 1.0) * 100.0)
    return rows.groupBy("pair").agg(*states.first_hits("ret", "scan_ms", LEVELS))


REASON = "CASE WHEN score < 78 THEN 'LOW' WHEN oi_change_15m_pct <= 0 THEN 'OI' WHEN score >= 300 THEN 'ACCEPTED' ELSE 'WAIT' END"


@query(
    "w25_change_only_log",
    f"""SELECT {CAND}, reason FROM (SELECT *, lag(reason) OVER z AS prev, coalesce(max((reason = 'ACCEPTED')::INT) OVER (PARTITION BY pair ORDER BY scan_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
  FROM (SELECT {CAND}, {REASON} AS reason FROM candidates) WINDOW z AS (PARTITION BY pair ORDER BY scan_ms)) WHERE done = 0 AND (prev IS NULL OR prev <> reason)""",
)
def w25(spark, sf):
    reason = F.expr(REASON)
    df = cut(candidates(spark, sf).select(*KEY, reason.alias("reason")))
    return states.change_log(df, ["pair"], "scan_ms", "reason", 4096 * HOUR).select(*KEY, "reason")


# --- joins by key ----------------------------------------------------------


@query(
    "j04_lookup_snapshot",
    f"""SELECT c.pair, c.scan_ms, c.bias, p.bias AS pool_bias, p.current_price AS pool_price, x.breadth_positive_pct FROM candidates c
LEFT JOIN (SELECT * FROM candidates WHERE scan_ms = (SELECT max(scan_ms) FROM candidates)) p ON c.pair = p.pair
CROSS JOIN (SELECT * FROM context ORDER BY asof_ms DESC LIMIT 1) x""",
)
def j04(spark, sf):
    df = cut(candidates(spark, sf))
    last = df.agg(F.max("scan_ms")).scalar()
    pool = df.filter(F.col("scan_ms") == last).select("pair", F.col("bias").alias("pool_bias"), F.col("current_price").alias("pool_price"))
    ctx = context(spark, sf).agg(F.max_by("breadth_positive_pct", "asof_ms").alias("breadth_positive_pct"))
    return joins.lookup_snapshot(df.select(*KEY, "bias"), pool, ctx, ["pair"])


@query(
    "j05_gate_join",
    """SELECT s.symbol, s.asof_ms, coalesce(g.samples >= 20, false) AS allowed,
  CASE WHEN g.samples >= 20 THEN concat('approved: ', s.market_regime, ' / ', s.quality_bucket) ELSE concat('not approved: ', s.market_regime, ' / ', s.quality_bucket) END AS gate_reason
FROM trigger_rows s LEFT JOIN (SELECT market_regime, quality_bucket, count(*) AS samples FROM trigger_rows GROUP BY ALL HAVING count(*) >= 20) g
ON s.market_regime = g.market_regime AND s.quality_bucket = g.quality_bucket""",
)
def j05(spark, sf):
    _, t = trigger_rows(spark, sf)
    allowed = t.groupBy("market_regime", "quality_bucket").agg(F.count(F.lit(1)).alias("samples")).filter("samples >= 20")
    return joins.gate_join(t, allowed).select("symbol", "asof_ms", "allowed", "gate_reason")


@query(
    "j06_overlay",
    """SELECT pair, scan_ms, score FROM candidates WHERE scan_ms % 7200000 <> 0 OR NOT (score >= 78)
UNION ALL SELECT pair, scan_ms, score + 1000 FROM candidates WHERE scan_ms % 7200000 = 0 AND score >= 78""",
)
def j06(spark, sf):
    df = cut(candidates(spark, sf).select(*KEY, "score"))
    high = df.filter((F.col("scan_ms") % 7_200_000 == 0) & (F.col("score") >= 78)).withColumn("score", F.col("score") + 1000)
    return joins.overlay(df, high, KEY)


@query("j07_unprocessed", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j07(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unprocessed(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz")), done, "o_orderkey")


@query("j08_exclude_bases", "SELECT symbol, open_time_ms, close FROM (SELECT concat(symbol, 'USDT') AS symbol, open_time_ms, close FROM fine_bars) WHERE symbol NOT IN ('S3USDT', 'USDCUSDT')")
def j08(spark, sf):
    from barlytics.catalog.base import bars

    b = bars(spark, sf).select(F.concat("symbol", F.lit("USDT")).alias("symbol"), "open_time_ms", "close")
    return joins.exclude_bases(b, ["S3", *states.STABLE_BASES], "USDT")


@query("j09_verified_only", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def j09(spark, sf):
    registry = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_regionkey") == 1, "CRYPTO").otherwise("OTHER").alias("classification"))
    return joins.verified_only(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), registry, "c_nationkey", "CRYPTO")


@query("j10_context_join", "SELECT c.symbol, c.asof_ms, r.market_regime, r.breadth_positive_pct FROM core c JOIN regimes r ON c.asof_ms = r.asof_ms")
def j10(spark, sf):
    fine_bars, coarse_bars = frames(spark, sf, FINE, COARSE)
    fine = cut(plan.fine_features(fine_bars, FINE))
    rows = plan.feature_core(plan.align(fine, plan.coarse_features(coarse_bars, COARSE), FINE)).select("symbol", "asof_ms")
    ctx = plan.with_regime(plan.context_from_fine(fine, LEAD, SECOND, FINE)).select("asof_ms", "market_regime", "breadth_positive_pct")
    return joins.context_join(rows, ctx)


@query(
    "j11_reconcile",
    """SELECT symbol, open_time_ms, field, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT a.symbol, a.open_time_ms, 'close' AS field FROM fine_bars a JOIN tiny_bars b ON a.symbol = b.symbol AND a.open_time_ms = b.open_time_ms WHERE NOT abs(a.close - b.close) <= greatest(1e-9 * greatest(abs(a.close), abs(b.close)), 1e-9)
  UNION ALL SELECT a.symbol, a.open_time_ms, 'open' FROM fine_bars a JOIN tiny_bars b ON a.symbol = b.symbol AND a.open_time_ms = b.open_time_ms WHERE NOT abs(a.open - b.open) <= greatest(1e-9 * greatest(abs(a.open), abs(b.open)), 1e-9)
  UNION ALL SELECT a.symbol, a.open_time_ms, 'trades' FROM fine_bars a JOIN tiny_bars b ON a.symbol = b.symbol AND a.open_time_ms = b.open_time_ms WHERE a.trades <> b.trades
  UNION ALL SELECT coalesce(a.symbol, b.symbol), coalesce(a.open_time_ms, b.open_time_ms), '<missing>' FROM fine_bars a FULL JOIN tiny_bars b ON a.symbol = b.symbol AND a.open_time_ms = b.open_time_ms WHERE a.symbol IS NULL OR b.symbol IS NULL) GROUP BY ALL""",
)
def j11(spark, sf):
    tiny, fine = frames(spark, sf, TINY, FINE)
    d = joins.reconcile(fine, tiny, ["symbol", "open_time_ms"], ["open", "close"], ["trades"])
    return d.groupBy("symbol", "open_time_ms", "field").agg(F.count(F.lit(1)).alias("n"))


@query("j13_missing_keys", "SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j13(spark, sf):
    present = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_keys(table(spark, sf, "customer"), present, "c_custkey")


# --- exhaustion gate -------------------------------------------------------

HEAT = "CASE WHEN bias = 'LONG' THEN {0} ELSE 100 - {0} END"
cte(
    "late",
    """SELECT *, CASE WHEN bias IN ('LONG', 'SHORT') THEN (pts >= 4 AND (c7 >= 12 OR e20 >= 6)) OR (heat >= 78 AND e20 >= 8) ELSE true END AS blocked,
  CASE WHEN bias IN ('LONG', 'SHORT') THEN pts ELSE 99 END AS risk_points FROM (SELECT *,
  CASE WHEN heat >= 72 THEN 2 WHEN heat >= 65 THEN 1 ELSE 0 END + CASE WHEN sheat >= 90 THEN 1 ELSE 0 END + CASE WHEN c7 >= 20 THEN 2 WHEN c7 >= 12 THEN 1 ELSE 0 END
  + CASE WHEN e20 >= 10 THEN 2 WHEN e20 >= 6 THEN 1 ELSE 0 END + CASE WHEN e50 >= 18 THEN 1 ELSE 0 END + CASE WHEN worst <= -2 THEN 1 ELSE 0 END AS pts
FROM (SELECT pair, scan_ms, bias, CASE WHEN bias = 'LONG' THEN score / 5 ELSE 100 - score / 5 END AS heat,
  CASE WHEN bias = 'LONG' THEN score / 4 ELSE 100 - score / 4 END AS sheat,
  CASE WHEN bias = 'LONG' THEN 1 ELSE -1 END * price_change_24h_futures_pct * 2 AS c7, CASE WHEN bias = 'LONG' THEN 1 ELSE -1 END * oi_change_24h_pct AS e20,
  CASE WHEN bias = 'LONG' THEN 1 ELSE -1 END * oi_change_24h_pct * 1.5 AS e50,
  CASE WHEN bias = 'LONG' THEN least(spot_volume_1h_usd / 10000 - 5, price_change_1h_spot_pct) ELSE -greatest(spot_volume_1h_usd / 10000 - 5, price_change_1h_spot_pct) END AS worst
 FROM (SELECT * REPLACE (CASE WHEN score > 400 THEN 'NONE' ELSE bias END AS bias) FROM candidates)))""",
)


@query("c11_late_entry_risk", f"SELECT {CAND}, blocked, risk_points FROM late")
def c11(spark, sf):
    df = candidates(spark, sf).withColumn("bias", F.when(F.col("score") > 400, "NONE").otherwise(F.col("bias")))
    r = rules.late_entry_risk(
        "bias", F.col("score") / 5, F.col("score") / 4, F.col("price_change_24h_futures_pct") * 2, "oi_change_24h_pct",
        F.col("oi_change_24h_pct") * 1.5, F.col("spot_volume_1h_usd") / 10_000 - 5, "price_change_1h_spot_pct",
    )
    return df.select(*KEY, r["blocked"].alias("blocked"), r["risk_points"].alias("risk_points"))


@query(
    "c12_late_entry_gate",
    f"""WITH RECURSIVE {DAILY_ALL}
SELECT trigger_id, daily_rsi14 IS NOT NULL AND NOT coalesce((pts >= 4 AND (c7 >= 12 OR e20 >= 6)) OR (heat >= 78 AND e20 >= 8), true) AS allowed,
  CASE WHEN daily_rsi14 IS NULL THEN 'no daily context' WHEN (pts >= 4 AND (c7 >= 12 OR e20 >= 6)) OR (heat >= 78 AND e20 >= 8) THEN 'too late into the move' ELSE 'not too late' END AS reason
FROM (SELECT *, CASE WHEN heat >= 72 THEN 2 WHEN heat >= 65 THEN 1 ELSE 0 END + CASE WHEN sheat >= 90 THEN 1 ELSE 0 END + CASE WHEN c7 >= 20 THEN 2 WHEN c7 >= 12 THEN 1 ELSE 0 END
  + CASE WHEN e20 >= 10 THEN 2 WHEN e20 >= 6 THEN 1 ELSE 0 END + CASE WHEN e50 >= 18 THEN 1 ELSE 0 END + CASE WHEN worst <= -2 THEN 1 ELSE 0 END AS pts FROM (
  SELECT trigger_id, daily_rsi14, CASE WHEN bias = 'LONG' THEN daily_rsi14 ELSE 100 - daily_rsi14 END AS heat, CASE WHEN bias = 'LONG' THEN daily_stoch_rsi14 ELSE 100 - daily_stoch_rsi14 END AS sheat,
    g * daily_change_7d_pct AS c7, g * distance_from_daily_ema20_pct AS e20, g * distance_from_daily_ema50_pct AS e50,
    CASE WHEN bias = 'LONG' THEN least(round(rs_btc, 3), round(rs_market, 3)) ELSE -greatest(round(rs_btc, 3), round(rs_market, 3)) END AS worst
  FROM (SELECT t.trigger_id, t.bias, t.rs_btc, t.rs_market, d.*, CASE WHEN t.bias = 'LONG' THEN 1 ELSE -1 END AS g FROM trigger_rows t ASOF LEFT JOIN daily d ON t.symbol = d.symbol AND t.asof_ms > d.daily_close_ms)))""",
)
def c12(spark, sf):
    fine, coarse = frames(spark, sf, FINE, COARSE)
    t = backtest.find_triggers(fine, coarse, FINE, COARSE, LEAD, SECOND)
    daily = ind.daily_contexts(fine, FINE)
    return states.late_entry_gate(t, daily, "asof_ms", 512 * FINE).select("trigger_id", "allowed", "reason")
