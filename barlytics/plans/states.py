"""State changes, streaks and logs along each key, as windows over batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlytics.functions import rules
from barlytics.operators.blocks import prefix
from barlytics.operators.grid import floor_bucket
from barlytics.operators.joins import asof_join

# Bases of stable coins.
STABLE_BASES = ["USDC", "FDUSD", "TUSD", "USDP", "DAI", "BUSD", "USDE", "USD1", "PYUSD"]

EVENT_COLUMNS = ["event", "symbol", "timestamp_ms", "bias", "from_value", "to_value", "price"]


def first_seen(rows: DataFrame, time: str, keys=("symbol",)) -> DataFrame:
    values = [c for c in rows.columns if c not in keys]
    firsts = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), time).alias("v"))
    return firsts.select(*keys, "v.*")


def swing_events(rows: DataFrame, step: int, keys=("symbol",), chunk_steps: int = 65_536) -> DataFrame:
    """First sight, state changes, bias changes and entries into the trigger.

    ``rows``: symbol, timestamp_ms, bias, setup_state, price, one row per scan.
    """
    held = rows.select(*keys, "timestamp_ms", "bias", "setup_state", "price").withColumn(
        "_now", F.struct("bias", "setup_state")
    )
    seen = prefix(held, keys, "timestamp_ms", floor_bucket("timestamp_ms", step * chunk_steps), {"_old": ("_now", "lag")})
    state, bias = F.col("setup_state"), F.col("bias")
    old_state, old_bias = F.col("_old.setup_state"), F.col("_old.bias")
    none = F.lit(None).cast("string")

    def event(cond: Column, name: str, a: Column, b: Column) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("event"), a.alias("from_value"), b.alias("to_value")))

    found = F.array(
        event(F.col("_old").isNull(), "SWING_FIRST_SEEN", none, state),
        event(old_state.isNotNull() & (state != old_state), "SWING_STATE_TRANSITION", old_state, state),
        event(old_bias.isNotNull() & (bias != old_bias), "SWING_BIAS_CHANGE", old_bias, bias),
        event(
            (state == rules.TRIGGER) & (old_state.isNull() | (old_state != rules.TRIGGER)),
            "SWING_CONTINUATION_TRIGGER", old_state, state,
        ),
    )
    return seen.withColumn("_e", F.explode(F.filter(found, lambda x: x.isNotNull()))).select(
        "_e.event", *keys, "timestamp_ms", "bias", "_e.from_value", "_e.to_value", "price"
    )


def streaks(rows: DataFrame, keys, time: str, chunk_ms: int, ok: str = "ok") -> DataFrame:
    """Length of the unbroken run of ``ok`` rows ending at each row."""
    numbered = rows.withColumn("_one", F.lit(1))
    counted = prefix(numbered, keys, time, floor_bucket(time, chunk_ms), {"_n": ("_one", "sum")})
    marked = counted.withColumn("_at_fail", F.when(~F.col(ok), F.col("_n")))
    last = prefix(marked, keys, time, floor_bucket(time, chunk_ms), {"_last": ("_at_fail", "last")})
    run = F.col("_n") - F.coalesce(F.col("_last"), F.lit(-1))
    return last.withColumn("streak", F.when(F.col(ok), run).otherwise(0)).drop("_one", "_n", "_at_fail", "_last")


def excursions(rows: DataFrame, keys, time: str, ret: str, chunk_ms: int) -> DataFrame:
    """Best and worst return so far, never below 0 and never above 0."""
    seen = prefix(rows, keys, time, floor_bucket(time, chunk_ms), {"_hi": (ret, "max"), "_lo": (ret, "min")})
    return seen.withColumns(
        {
            "mfe_pct": F.greatest(F.lit(0.0), "_hi", ret),
            "mae_pct": F.least(F.lit(0.0), "_lo", ret),
        }
    ).drop("_hi", "_lo")


def first_hits(ret: str, time: str, levels: dict[str, float]) -> list[Column]:
    r = F.col(ret)
    return [
        F.min(F.when(r >= v if v > 0 else r <= v, F.col(time))).alias(f"{k}_hit_at_ms") for k, v in levels.items()
    ]


def change_log(rows: DataFrame, keys, time: str, reason: str, chunk_ms: int, final: str = "ACCEPTED") -> DataFrame:
    """Rows whose reason differs from the one before; nothing after ``final``."""
    marked = rows.withColumn("_done", (F.col(reason) == final).cast("int"))
    seen = prefix(
        marked, keys, time, floor_bucket(time, chunk_ms), {"_prev": (reason, "lag"), "_any": ("_done", "max")}
    )
    fresh = F.col("_prev").isNull() | (F.col("_prev") != F.col(reason))
    return seen.filter(fresh & (F.coalesce(F.col("_any"), F.lit(0)) == 0)).drop("_done", "_prev", "_any")


def late_entry_gate(signals: DataFrame, daily: DataFrame, time: str, bucket_ms: int, keys=("symbol",)) -> DataFrame:
    """Exhaustion gate over the daily context; missing context refuses.

    ``daily`` has the context at every bar; a signal meets the last one that
    closed before its ``time``.
    """
    j = asof_join(signals, daily, time, "daily_close_ms", bucket_ms, keys)
    risk = rules.late_entry_risk(
        "bias", "daily_rsi14", "daily_stoch_rsi14", "daily_change_7d_pct",
        "distance_from_daily_ema20_pct", "distance_from_daily_ema50_pct",
        "relative_strength_vs_btc_pct", "relative_strength_vs_market_pct",
    )
    known = F.col("daily_rsi14").isNotNull()
    blocked = F.coalesce(risk["blocked"], F.lit(True))
    return j.withColumns(
        {
            "allowed": known & ~blocked,
            "reason": F.when(~known, "no daily context")
            .when(blocked, "too late into the move")
            .otherwise("not too late"),
            "risk_points": F.when(known, risk["risk_points"]),
            "risk_reasons": F.when(known, risk["reasons"]),
        }
    )
