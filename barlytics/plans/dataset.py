"""Learning rows: sample grid x liquid symbols, four frames, context, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barlytics.functions import rules
from barlytics.functions.scalar import pct_change
from barlytics.operators.blocks import roll
from barlytics.operators.grid import asof_grid, common_window, resample
from barlytics.operators.indicators import (
    atr_pct_stages, day_snapshot, lagged, momentum, realized_vol_stages, rolling_max, rolling_min,
    sma, sma_lagged, taker_buy_ratio, volume_expansion,
)
from barlytics.operators.joins import asof_joins
from barlytics.plans.setups import market_context_ml, top_n
from barlytics.session import cut

BUCKET_STEPS = 128


def base_frame(bars: DataFrame, step: int, day_bars: int = 288, hour_bars: int = 12) -> DataFrame:
    """Finest frame: day snapshot, buy share of the last hour, entry price."""
    stage = {**day_snapshot(day_bars), "taker_buy_ratio_1h": taker_buy_ratio(hour_bars)}
    return roll(bars, stage, step).filter(F.col("pos") >= day_bars).select(
        "symbol", F.col("close_time_ms").alias("b_close_ms"), F.col("close").alias("entry_price"),
        "quote_volume_24h", "price_change_24h_pct", "taker_buy_ratio_24h", "taker_buy_ratio_1h",
    )


def confirm_frame(bars: DataFrame, step: int) -> DataFrame:
    stage = {
        "c_prev": lagged("close", 1), "c_sma4": sma("close", 4), "c_sma12": sma("close", 12),
        "momentum_15m_pct": momentum("close", 1), "momentum_45m_pct": momentum("close", 3),
        "momentum_180m_pct": momentum("close", 12), "volume_expansion_15m": volume_expansion("quote_volume"),
    }
    return roll(bars, stage, step).filter(F.col("pos") >= 19).select(
        "symbol", F.col("close_time_ms").alias("c_close_ms"), F.col("close").alias("c_close"), *stage
    )


def trade_frame(bars: DataFrame, step: int) -> DataFrame:
    first = {
        "f_sma10": sma("close", 10), "f_sma20": sma("close", 20), "f_sma10_old": sma_lagged("close", 10, 5),
        "f_high12": rolling_max("high", 12), "f_low12": rolling_min("low", 12), "f_prev": lagged("close", 1),
        "momentum_3h_pct": momentum("close", 3), "momentum_12h_pct": momentum("close", 12),
        "volume_expansion_1h": volume_expansion("quote_volume"),
    }
    tr, vol = atr_pct_stages(14), realized_vol_stages(12)
    stages = [{**first, **tr[0], **vol[0]}, {**tr[1], **vol[1]}]
    return roll(bars, stages, step).filter(F.col("pos") >= 29).select(
        "symbol", F.col("close_time_ms").alias("f_close_ms"), F.col("close").alias("f_close"), *first,
        F.col("atr_pct").alias("atr_1h_pct"), F.col("realized_vol_pct").alias("realized_vol_12h_pct"),
    )


def trend_frame(bars: DataFrame, step: int) -> DataFrame:
    stage = {
        "h_sma10": sma("close", 10), "h_sma20": sma("close", 20), "h_sma10_old": sma_lagged("close", 10, 5),
        "momentum_24h_pct": momentum("close", 6),
    }
    return roll(bars, stage, step).filter(F.col("pos") >= 24).select(
        "symbol", F.col("close_time_ms").alias("h_close_ms"), F.col("close").alias("h_close"), *stage
    )


def universe(base: DataFrame, grid_times: DataFrame, step: int, min_turnover: float) -> DataFrame:
    """Liquid symbols at every sample time.

    A bar is the newest one of its symbol from its close until the next close.
    Each bar therefore fills its own stretch of the sample grid; no symbol by
    time product is formed first.
    """
    span = grid_times.agg(F.min("asof_ms").alias("lo"), F.max("asof_ms").alias("hi"), (F.count(F.lit(1))).alias("n"))
    span = span.withColumn("step", F.when(F.col("n") > 1, (F.col("hi") - F.col("lo")) / (F.col("n") - 1)).otherwise(1).cast("bigint"))
    spans = span.select(F.struct("lo", "hi", "step").alias("s")).scalar()
    pos = base.withColumnRenamed("b_close_ms", "open_time_ms")
    nxt = roll(
        pos.withColumn("open_time_ms", -F.col("open_time_ms")), {"_neg_next": lagged("open_time_ms", 1)}, step
    ).withColumn("b_close_ms", -F.col("open_time_ms")).withColumn("_next", -F.col("_neg_next"))
    s = lambda c: F.col(f"_s.{c}")
    # First and last sample time t with close < t <= next close.
    lo = F.greatest(s("lo"), s("lo") + (F.floor((F.col("b_close_ms") - s("lo")) / s("step")) + 1) * s("step"))
    hi = F.least(s("hi"), s("lo") + F.floor((F.coalesce(F.col("_next"), s("hi")) - s("lo")) / s("step")) * s("step"))
    held = nxt.filter(F.col("quote_volume_24h") >= min_turnover).withColumn("_s", spans).withColumns({"_lo": lo, "_hi": hi})
    return (
        held.filter("_lo <= _hi")
        .withColumn("asof_ms", F.explode(F.sequence("_lo", "_hi", s("step"))))
        .withColumn("activity_score", rules.activity_score("quote_volume_24h", "price_change_24h_pct"))
        .select(
            "asof_ms", "symbol", "entry_price", "quote_volume_24h", "price_change_24h_pct",
            "taker_buy_ratio_24h", "taker_buy_ratio_1h", "activity_score",
        )
    )


def directional(rows: DataFrame) -> DataFrame:
    """Direction, setup flags and signed features; rows without trend drop out."""
    bias = rules.trend_bias(
        "f_close", "f_sma10", "f_sma20", "f_sma10_old", "h_close", "h_sma10", "h_sma20", "h_sma10_old"
    )
    df = rows.withColumn("direction", bias).filter("direction <> 'NEUTRAL'")
    long = F.col("direction") == "LONG"
    sign = F.when(long, 1.0).otherwise(-1.0)
    df = df.withColumns(
        {
            "direction_sign": sign,
            "pullback_from_12h_high_pct": pct_change("f_close", "f_high12", "nonzero"),
            "bounce_from_12h_low_pct": pct_change("f_close", "f_low12", "nonzero"),
            "distance_from_1h_sma10_pct": pct_change("f_close", "f_sma10", "nonzero"),
            "distance_from_4h_sma10_pct": pct_change("h_close", "h_sma10", "nonzero"),
            "sma1h10_slope_pct": pct_change("f_sma10", "f_sma10_old", "nonzero"),
            "sma4h10_slope_pct": pct_change("h_sma10", "h_sma10_old", "nonzero"),
            "distance_from_15m_sma4_pct": pct_change("c_close", "c_sma4", "nonzero"),
            "distance_from_15m_sma12_pct": pct_change("c_close", "c_sma12", "nonzero"),
        }
    )
    ready = rules.retest_ready("direction", "pullback_from_12h_high_pct", "bounce_from_12h_low_pct", "distance_from_1h_sma10_pct")
    go = rules.resumed("direction", "f_close", "f_prev", "f_sma10", "volume_expansion_1h")
    confirm = rules.resumed("direction", "c_close", "c_prev", "c_sma4", "volume_expansion_15m")
    signed = {
        "directional_momentum_3h": "momentum_3h_pct", "directional_momentum_12h": "momentum_12h_pct",
        "directional_momentum_24h": "momentum_24h_pct", "directional_momentum_15m": "momentum_15m_pct",
        "directional_momentum_45m": "momentum_45m_pct", "directional_momentum_180m": "momentum_180m_pct",
        "directional_distance_from_1h_sma10_pct": "distance_from_1h_sma10_pct",
        "directional_distance_from_4h_sma10_pct": "distance_from_4h_sma10_pct",
    }
    change = F.col("price_change_24h_pct")
    df = df.withColumns({k: F.col("direction_sign") * F.col(v) for k, v in signed.items()}).withColumns(
        {
            "relative_strength_vs_btc_24h": F.col("direction_sign") * (change - F.col("btc_change_24h_pct")),
            "relative_strength_vs_eth_24h": F.col("direction_sign") * (change - F.col("eth_change_24h_pct")),
            "retest_ready": ready.cast("int"),
            "trigger_like_1h": (ready & go).cast("int"),
            "confirmation_15m": confirm.cast("int"),
            "anti_chase_abs_12h_pct": F.abs("momentum_12h_pct"),
        }
    )
    inner = [c for c in df.columns if c[:2] in ("f_", "h_", "c_", "b_")]
    return df.drop(*inner)


def feature_rows(
    tiny: DataFrame, fine: DataFrame, coarse: DataFrame, tiny_step: int, fine_step: int, coarse_step: int,
    lead: str, second: str, sample_step: int, k: int = 3, day_bars: int = 288, hour_bars: int = 12,
    warmup_ms: int | None = None, horizon_ms: int = 72 * 3_600_000, min_turnover: float = 10_000_000.0, n: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """The feature table and the context of every sample time."""
    warmup_ms = 30 * coarse_step if warmup_ms is None else warmup_ms
    times = asof_grid(common_window(tiny, warmup_ms, horizon_ms), sample_step)
    base = base_frame(tiny, tiny_step, day_bars, hour_bars)
    liquid = cut(top_n(universe(base, times, tiny_step, min_turnover), ["asof_ms"], "activity_score", None))
    context = market_context_ml(liquid, lead, second)
    rows = liquid.filter(F.col("activity_rank") <= n).join(context, "asof_ms")
    frames = [
        (trade_frame(fine, fine_step), "f_close_ms"), (trend_frame(coarse, coarse_step), "h_close_ms"),
        (confirm_frame(resample(tiny, tiny_step, k), tiny_step * k), "c_close_ms"),
    ]
    rows = asof_joins(rows, frames, "asof_ms", BUCKET_STEPS * max(fine_step, tiny_step * k)).dropna(subset=[close for _, close in frames])
    return directional(rows), context


def label_name(kind: str, target: float, stop: float, horizon_ms: int, unit_ms: int = 3_600_000) -> str:
    """Column name of a label of the learning table."""
    tag = lambda x: f"{x:g}".replace(".", "_")
    return f"{kind}{tag(target)}_stop{tag(stop)}_{horizon_ms // unit_ms}h"


def learning_rows(features: DataFrame, labels: DataFrame, barriers, horizons_ms) -> DataFrame:
    """The table the classifier learns from: features, and what came after each row.

    ``labels`` has a row per (row_id, horizon, barrier), as ``labels.label_grid`` makes
    them; they become columns, shrunk to one row per row_id before the join.
    """
    columns = []
    for target, stop in barriers:
        for h in horizons_ms:
            on = (F.col("target_pct") == target) & (F.col("stop_pct") == stop) & (F.col("horizon_ms") == h)
            made = {
                "target": F.col("target_before_stop"), "ambiguous": (F.col("path") == "AMBIGUOUS").cast("int"), "sim_return": F.col("sim_return_pct"),
            }
            columns += [F.max(F.when(on, v)).alias(label_name(k, target, stop, h)) for k, v in made.items()]
    wide = labels.groupBy("row_id").agg(*columns)
    row_id = F.concat_ws("-", "symbol", F.col("asof_ms").cast("string"))
    return features.withColumn("row_id", row_id).join(wide, "row_id")
