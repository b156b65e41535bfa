"""Bars to setups: rolling features, as-of alignment, rules, context, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barlytics.functions import rules
from barlytics.functions.scalar import quality_bucket
from barlytics.operators.blocks import roll
from barlytics.operators.indicators import (
    change_over, lagged, momentum, rolling_max, rolling_min, rolling_sum, sma, sma_lagged, volume_expansion,
)
from barlytics.operators.joins import asof_join

BUCKET_STEPS = 128


def fine_features(bars: DataFrame, step: int, **kw) -> DataFrame:
    """Rolling features of the trading frame, known after each bar closes."""
    stage = {
        "sma10": sma("close", 10),
        "sma20": sma("close", 20),
        "sma10_old": sma_lagged("close", 10, 5),
        "high12": rolling_max("high", 12),
        "low12": rolling_min("low", 12),
        "prev_close": lagged("close", 1),
        "m3": momentum("close", 3),
        "m12": momentum("close", 12),
        "vexp": volume_expansion("quote_volume"),
        "qv24": rolling_sum("quote_volume", 24, partial=True),
        "chg24": change_over("close", 24, default=0.0),
    }
    return roll(bars, stage, step, **kw).withColumn("asof_ms", F.col("close_time_ms") + 1)


def coarse_features(bars: DataFrame, step: int, **kw) -> DataFrame:
    """Rolling features of the higher frame, named for the as-of join."""
    stage = {
        "h_sma10": sma("close", 10),
        "h_sma20": sma("close", 20),
        "h_sma10_old": sma_lagged("close", 10, 5),
        "m24": momentum("close", 6),
    }
    return roll(bars, stage, step, **kw).select(
        "symbol", F.col("close_time_ms").alias("h_close_time_ms"), F.col("close").alias("h_close"),
        F.col("pos").alias("h_pos"), "h_sma10", "h_sma20", "h_sma10_old", "m24",
    )


def align(fine: DataFrame, coarse: DataFrame, step: int) -> DataFrame:
    """Fine rows with the last coarse row closed before their as-of time."""
    return asof_join(fine, coarse, "asof_ms", "h_close_time_ms", step * BUCKET_STEPS)


def feature_core(
    aligned: DataFrame, min_fine: int = 30, min_coarse: int = 25, quote_volume: str = "qv24",
) -> DataFrame:
    """Bias, setup state, score and rounded features per row with enough history.

    The rules see unrounded values; what is stored is rounded.
    """
    r = rules
    df = aligned.filter((F.col("pos") >= min_fine - 1) & (F.col("h_pos") >= min_coarse - 1))
    df = df.withColumns(
        {
            "bias": r.trend_bias("close", "sma10", "sma20", "sma10_old", "h_close", "h_sma10", "h_sma20", "h_sma10_old"),
            "_pull": (F.col("close") / F.col("high12") - 1.0) * 100.0,
            "_bounce": (F.col("close") / F.col("low12") - 1.0) * 100.0,
            "_dist": (F.col("close") / F.col("sma10") - 1.0) * 100.0,
        }
    )
    ready = r.retest_ready("bias", "_pull", "_bounce", "_dist")
    go = r.resumed("bias", "close", "prev_close", "sma10", "vexp")
    df = df.withColumn("setup_state", r.setup_state(ready, go))
    return df.select(
        "symbol", "open_time_ms", "asof_ms", "pos",
        "bias", "setup_state",
        r.retest_reason("bias", "setup_state").alias("retest_reason"),
        F.col("close").alias("price"),
        F.round("m3", 3).alias("momentum_3h_pct"),
        F.round("m12", 3).alias("momentum_12h_pct"),
        F.round("m24", 3).alias("momentum_24h_pct"),
        F.round("_pull", 3).alias("pullback_from_12h_high_pct"),
        F.round("_bounce", 3).alias("bounce_from_12h_low_pct"),
        F.round("_dist", 3).alias("distance_from_1h_sma10_pct"),
        F.round("vexp", 2).alias("volume_expansion_1h"),
        r.swing_score("bias", "m3", "m12", "m24", "vexp", quote_volume).alias("swing_score"),
        r.swing_warnings("m12", "vexp").alias("warnings"),
        r.anti_chase_state("m12").alias("anti_chase_state"),
        F.round(quote_volume, 2).alias("quote_volume_24h"),
        F.round("chg24", 3).alias("price_change_24h_pct"),
        F.col("close_time_ms").alias("last_fine_close_ms"),
        F.col("h_close_time_ms").alias("last_coarse_close_ms"),
    )


def setups(fine_bars: DataFrame, coarse_bars: DataFrame, step: int, coarse_step: int, **kw) -> DataFrame:
    """Feature rows at the close of every fine bar."""
    fine = fine_features(fine_bars, step)
    coarse = coarse_features(coarse_bars, coarse_step)
    return feature_core(align(fine, coarse, step), **kw)


def market_context(
    changes: DataFrame, lead: str, second: str, by: str = "asof_ms",
    symbol: str = "symbol", change: str = "chg24",
) -> DataFrame:
    """Breadth, median move and the two lead changes per as-of time."""
    c = F.col(change)
    named = lambda s: F.round(F.coalesce(F.max(F.when(F.col(symbol) == s, c)), F.lit(0.0)), 3)
    return changes.groupBy(by).agg(
        F.count(c).alias("liquid_universe_count"),
        F.count_if(c > 0).alias("advancers_24h"),
        F.count_if(c < 0).alias("decliners_24h"),
        F.count_if(c == 0).alias("unchanged_24h"),
        F.coalesce(F.round(100.0 * F.count_if(c > 0) / F.nullif(F.count(c), F.lit(0)), 2), F.lit(50.0)).alias("breadth_positive_pct"),
        F.coalesce(F.round(F.median(c), 3), F.lit(0.0)).alias("median_24h_change_pct"),
        named(lead).alias("btc_24h_change_pct"),
        named(second).alias("eth_24h_change_pct"),
    )


def market_context_ml(rows: DataFrame, lead: str, second: str, by: str = "asof_ms") -> DataFrame:
    """Context whose breadth leaves out unchanged symbols, with a vote regime.

    The regime still votes on advancers over all symbols.
    """
    c = F.col("price_change_24h_pct")
    named = lambda s: F.coalesce(F.max(F.when(F.col("symbol") == s, c)), F.lit(0.0))
    agg = rows.groupBy(by).agg(
        F.count_if(c > 0).alias("_adv"), F.count_if(c < 0).alias("_dec"),
        F.count(c).alias("liquid_symbol_count"),
        F.coalesce(F.median(c), F.lit(0.0)).alias("market_median_change_24h_pct"),
        named(lead).alias("btc_change_24h_pct"), named(second).alias("eth_change_24h_pct"),
    )
    regime, score = rules.market_regime_votes(
        100.0 * F.col("_adv") / F.col("liquid_symbol_count"),
        "market_median_change_24h_pct", "btc_change_24h_pct", "eth_change_24h_pct",
    )
    breadth = F.col("_adv") / F.greatest(F.lit(1), F.col("_adv") + F.col("_dec")) * 100.0
    return agg.select(
        by, regime.alias("market_regime"), score.alias("market_regime_score"),
        breadth.alias("market_breadth_pct"), "market_median_change_24h_pct",
        "btc_change_24h_pct", "eth_change_24h_pct", "liquid_symbol_count",
    )


def with_regime(ctx: DataFrame) -> DataFrame:
    regime, score = rules.market_regime_ranked(
        "breadth_positive_pct", "median_24h_change_pct", "btc_24h_change_pct", "eth_24h_change_pct"
    )
    return ctx.withColumn("market_regime", regime).withColumn("market_regime_score", score)


def last_known(fine: DataFrame, values: list[str], step: int, keys=("symbol",)) -> DataFrame:
    """Each bar's values at every grid time until the next bar of its symbol.

    A symbol keeps its last closed bar over gaps and after its end, up to the
    last time of the table. Every bar fills its own stretch of the grid, so the
    time by symbol grid comes about without a cross join.
    """
    keys = list(keys)
    held = roll(
        fine.select(*keys, "open_time_ms", "asof_ms", "pos", *values),
        {"_from": lagged("asof_ms", 1), **{f"_v_{c}": lagged(c, 1) for c in values}, "_p": lagged("pos", 1)},
        step, keys,
    )
    closed = held.filter(F.col("_from").isNotNull()).select(
        *keys, F.col("_from"), (F.col("asof_ms") - step).alias("_to"), F.col("_p").alias("pos"),
        *[F.col(f"_v_{c}").alias(c) for c in values],
    )
    end = fine.agg(F.max("asof_ms")).scalar()
    last = fine.groupBy(*keys).agg(F.max_by(F.struct("asof_ms", "pos", *values), "pos").alias("x")).select(
        *keys, F.col("x.asof_ms").alias("_from"), end.alias("_to"), "x.pos", *[f"x.{c}" for c in values]
    )
    grid = F.sequence("_from", "_to", F.lit(step).cast("bigint"))
    return closed.unionByName(last).select(*keys, "pos", *values, F.explode(grid).alias("asof_ms"))


def context_from_fine(fine: DataFrame, lead: str, second: str, step: int) -> DataFrame:
    """Market context per as-of time; a symbol counts with its last closed bar."""
    return market_context(last_known(fine, ["chg24"], step).filter(F.col("pos") >= 24), lead, second)


def score_rows(rows: DataFrame, regime: str = "market_regime") -> DataFrame:
    """Add quality score, parts, relative strength; needs features and context."""
    parts = rules.quality(
        "bias", "momentum_3h_pct", "momentum_12h_pct", "momentum_24h_pct", "price_change_24h_pct",
        "setup_state", "distance_from_1h_sma10_pct", "volume_expansion_1h", "quote_volume_24h",
        "pullback_from_12h_high_pct", "bounce_from_12h_low_pct", "warnings",
        "btc_24h_change_pct", "median_24h_change_pct", regime,
    )
    return rows.withColumns(parts)


def edges(rows: DataFrame, step: int, keys=("symbol",)) -> DataFrame:
    """Rows that enter the trigger state; the row before counts, whatever its bias.

    Feature rows carry the bar position, so the row before is one halo row away.
    """
    before = roll(rows, {"_prev": lagged("setup_state", 1)}, step, keys)
    enters = (F.col("setup_state") == rules.TRIGGER) & (
        F.col("_prev").isNull() | (F.col("_prev") != rules.TRIGGER)
    )
    return before.filter(enters & F.col("bias").isin("LONG", "SHORT")).drop("_prev")


def triggers(features: DataFrame, context: DataFrame, step: int) -> DataFrame:
    """Scored entries into the trigger state with their market context."""
    hits = edges(features, step)
    scored = score_rows(hits.join(with_regime(context), "asof_ms"))
    return scored.withColumn("quality_bucket", quality_bucket("swing_quality_score_v1", "closed")).withColumn(
        "trigger_id", F.concat_ws("-", "symbol", F.col("asof_ms").cast("string"))
    )


def rank_by(rows: DataFrame, by, score: str, tie: str, out: str = "swing_quality_rank_v1") -> DataFrame:
    """Rank per scan: score down, then tie-break up (missing or 0 sorts last)."""
    order = F.coalesce(F.when(F.col(tie) != 0, F.col(tie)), F.lit(9999))
    w = Window.partitionBy(*by).orderBy(F.desc(score), order, "symbol")
    return rows.withColumn(out, F.row_number().over(w))


def top_n(rows: DataFrame, by, score: str, n: int | None = 20, out: str = "activity_rank") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), "symbol")
    ranked = rows.withColumn(out, F.row_number().over(w))
    return ranked if n is None else ranked.filter(F.col(out) <= n)
