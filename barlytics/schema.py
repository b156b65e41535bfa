"""Row types of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

BAR = T.StructType(
    [
        T.StructField("open_time_ms", T.LongType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
        T.StructField("close_time_ms", T.LongType()),
        T.StructField("quote_volume", T.DoubleType()),
        T.StructField("trades", T.LongType()),
        T.StructField("taker_buy_base_volume", T.DoubleType()),
        T.StructField("taker_buy_quote_volume", T.DoubleType()),
    ]
)

CANDIDATE = T.StructType(
    [
        T.StructField("pair", T.StringType()),
        T.StructField("bias", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("current_price", T.DoubleType()),
        T.StructField("oi_change_15m_pct", T.DoubleType()),
        T.StructField("oi_change_1h_pct", T.DoubleType()),
        T.StructField("oi_change_4h_pct", T.DoubleType()),
        T.StructField("oi_change_24h_pct", T.DoubleType()),
        T.StructField("spot_buy_sell_ratio_1h", T.DoubleType()),
        T.StructField("spot_net_flow_1h_usd", T.DoubleType()),
        T.StructField("spot_volume_1h_usd", T.DoubleType()),
        T.StructField("price_change_1h_spot_pct", T.DoubleType()),
        T.StructField("price_change_4h_spot_pct", T.DoubleType()),
        T.StructField("price_change_24h_futures_pct", T.DoubleType()),
        T.StructField("strength", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("funding_rate_pct", T.DoubleType()),
        T.StructField("cross_exchange_median_funding_pct", T.DoubleType()),
        T.StructField("binance_funding_minus_median_pct", T.DoubleType()),
        T.StructField("basis_pct", T.DoubleType()),
        T.StructField("oi_change_5m_pct", T.DoubleType()),
        T.StructField("open_interest_usd", T.DoubleType()),
        T.StructField("futures_volume_change_24h_pct", T.DoubleType()),
        T.StructField("invalidation", T.StringType()),
        T.StructField("reasons", T.ArrayType(T.StringType())),
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("blockers", T.ArrayType(T.StringType())),
    ]
)

SCAN = T.StructType(
    [
        T.StructField("generated_at_ms", T.LongType()),
        T.StructField("cache_age_seconds", T.DoubleType()),
        T.StructField(
            "thresholds",
            T.StructType([T.StructField("minimum_candidate_score", T.DoubleType())]),
        ),
        T.StructField("watchlist", T.ArrayType(CANDIDATE)),
        T.StructField("trade_candidates", T.ArrayType(CANDIDATE)),
    ]
)

POOL_ROW = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("bias", T.StringType()),
        T.StructField("setup_state", T.StringType()),
        T.StructField("swing_score", T.DoubleType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("momentum_3h_pct", T.DoubleType()),
        T.StructField("momentum_12h_pct", T.DoubleType()),
        T.StructField("momentum_24h_pct", T.DoubleType()),
        T.StructField("pullback_from_12h_high_pct", T.DoubleType()),
        T.StructField("bounce_from_12h_low_pct", T.DoubleType()),
        T.StructField("distance_from_1h_sma10_pct", T.DoubleType()),
        T.StructField("volume_expansion_1h", T.DoubleType()),
        T.StructField("quote_volume_24h", T.DoubleType()),
        T.StructField("price_change_24h_pct", T.DoubleType()),
        T.StructField("activity_score", T.DoubleType()),
        T.StructField("activity_rank", T.LongType()),
        T.StructField("retest_reason", T.StringType()),
        T.StructField("warnings", T.ArrayType(T.StringType())),
    ]
)

MARKET_CONTEXT = T.StructType(
    [
        T.StructField("liquid_universe_count", T.LongType()),
        T.StructField("advancers_24h", T.LongType()),
        T.StructField("decliners_24h", T.LongType()),
        T.StructField("unchanged_24h", T.LongType()),
        T.StructField("breadth_positive_pct", T.DoubleType()),
        T.StructField("median_24h_change_pct", T.DoubleType()),
        T.StructField("btc_24h_change_pct", T.DoubleType()),
        T.StructField("eth_24h_change_pct", T.DoubleType()),
    ]
)

SWING_SCAN = T.StructType(
    [
        T.StructField("generated_at_ms", T.LongType()),
        T.StructField("version", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("analysis_pool", T.ArrayType(POOL_ROW)),
        T.StructField("market_context", MARKET_CONTEXT),
    ]
)

TRIGGER_EVENT = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("trigger_id", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("bias", T.StringType()),
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("trigger_price", T.DoubleType()),
        T.StructField("swing_score", T.DoubleType()),
    ]
)

FILE_ENTRY = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("interval", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_exclusive_ms", T.LongType()),
        T.StructField("expected_rows", T.LongType()),
        T.StructField("actual_rows", T.LongType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("days", T.LongType()),
        T.StructField("symbols", T.ArrayType(T.StringType())),
        T.StructField("eligible_symbols", T.ArrayType(T.StringType())),
        T.StructField("status", T.StringType()),
        T.StructField("files", T.ArrayType(FILE_ENTRY)),
    ]
)
