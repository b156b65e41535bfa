"""Rolling indicators over bars, as ``Roll`` expressions for ``blocks.roll``."""

from __future__ import annotations


from pyspark.sql import DataFrame, functions as F

from barlytics.functions.scalar import pct_change, safe_div
from barlytics.operators.blocks import POS, Frame, Roll, fold_linear, roll, with_position
from barlytics.session import cut


def _from(n: int, value):
    return F.when(F.col(POS) >= n, value)


def _framed(need: int, first: int, value, *frames: Frame) -> Roll:
    """A value of frames, null before row ``first``."""
    return Roll(need, lambda w: _from(first, value(*[f.over(w) for f in frames])), frames)


def _plain(value):
    return value


def sma(col: str, n: int) -> Roll:
    return _framed(n - 1, n - 1, _plain, Frame(col, "avg", n))


def sma_lagged(col: str, n: int, back: int) -> Roll:
    """The mean of ``n`` values, as it stood ``back`` rows ago."""
    first = n + back - 1
    return _framed(first, first, _plain, Frame(col, "avg", n, back))


def rolling_max(col: str, n: int) -> Roll:
    return _framed(n - 1, n - 1, _plain, Frame(col, "max", n))


def rolling_min(col: str, n: int) -> Roll:
    return _framed(n - 1, n - 1, _plain, Frame(col, "min", n))


def rolling_sum(col: str, n: int, partial: bool = False) -> Roll:
    """Sum of ``n`` values; ``partial`` also gives shorter sums at the start."""
    return _framed(n - 1, 0 if partial else n - 1, _plain, Frame(col, "sum", n))


def lagged(col: str, k: int) -> Roll:
    return Roll(k, lambda w: F.lag(col, k).over(w))


def momentum(col: str, k: int) -> Roll:
    return Roll(k, lambda w: (F.col(col) / F.lag(col, k).over(w) - 1.0) * 100.0)


def change_over(col: str, k: int, default: float | None = None) -> Roll:
    """Percent change against ``k`` rows ago, 0 for a non-positive base."""
    def build(w):
        value = pct_change(F.col(col), F.lag(col, k).over(w))
        return F.when(F.col(POS) >= k, value) if default is None else (
            F.when(F.col(POS) >= k, value).otherwise(F.lit(default))
        )

    return Roll(k, build)


def volume_expansion(col: str, recent: int = 3, previous: int = 12) -> Roll:
    """Recent mean over the mean of the rows just before; 0 without a base."""
    first = recent + previous - 1
    value = lambda new, old: F.when(old > 0, new / old).otherwise(0.0)
    return _framed(first, first, value, Frame(col, "avg", recent), Frame(col, "avg", previous, recent))


def true_range() -> Roll:
    def build(w):
        before = F.lag("close", 1).over(w)
        return F.when(
            before.isNotNull(),
            F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
        )

    return Roll(1, build)


def atr_pct_stages(n: int = 14) -> list[dict[str, Roll]]:
    """Mean true range over the last close, in percent; 0 without history."""
    mean = Frame("_tr", "avg", n)

    def build(w):
        return F.when(F.col(POS) >= n, safe_div(mean.over(w), F.col("close")) * 100.0).otherwise(0.0)

    return [{"_tr": true_range()}, {"atr_pct": Roll(n - 1, build, (mean,))}]


def realized_vol_stages(n: int = 12) -> list[dict[str, Roll]]:
    """Population deviation of log returns times root count, in percent."""
    def log_return(w):
        before = F.lag("close", 1).over(w)
        usable = (before > 0) & (F.col("close") > 0)
        return F.when(usable, F.log(F.col("close") / before))

    def build(w):
        frame = w.rowsBetween(-(n - 1), 0)
        count = F.count("_lr").over(frame)
        vol = F.stddev_pop("_lr").over(frame) * F.sqrt(count) * 100.0
        return F.when((F.col(POS) >= n) & (count >= 2), vol).otherwise(0.0)

    return [{"_lr": Roll(1, log_return)}, {"realized_vol_pct": Roll(n - 1, build)}]


def day_snapshot(n: int = 288) -> dict[str, Roll]:
    """Turnover, change and taker buy share over the last ``n`` bars.

    The change compares with the bar before the window, so ``n + 1`` bars are
    needed; rows with fewer give null.
    """
    change = lambda w: _from(n, pct_change(F.col("close"), F.lag("close", n).over(w), "nonzero"))
    turnover, bought = Frame("quote_volume", "sum", n), Frame("taker_buy_quote_volume", "sum", n)
    return {
        "quote_volume_24h": _framed(n, n, _plain, turnover),
        "price_change_24h_pct": Roll(n, change),
        "taker_buy_ratio_24h": _framed(n, n, lambda b, q: safe_div(b, q, 0.5), bought, turnover),
    }


def taker_buy_ratio(n: int = 12) -> Roll:
    frames = Frame("taker_buy_quote_volume", "sum", n), Frame("quote_volume", "sum", n)
    return _framed(n - 1, n - 1, lambda b, q: safe_div(b, q, 0.5), *frames)


def numbered(bars: DataFrame, step: int, keys=("symbol",), time="open_time_ms", chunk_rows: int = 65_536) -> DataFrame:
    return with_position(
        bars, keys, time, F.col(time) - F.pmod(F.col(time), F.lit(step * chunk_rows))
    )


def ema(bars: DataFrame, period: int, step: int, col="close", out="ema", keys=("symbol",), block_rows=None) -> DataFrame:
    """Exponential mean seeded by the plain mean of the first ``period`` values.

    Returns the keys, ``pos`` and the mean, null until the seed.
    """
    alpha = 2.0 / (period + 1.0)
    df = bars if POS in bars.columns else numbered(bars, step, keys)
    return fold_linear(df, keys, {out: col}, 1.0 - alpha, alpha, period, block_rows)


def rsi_wilder(bars: DataFrame, step: int, n: int = 14, col="close", out="rsi", keys=("symbol",), block_rows=None) -> DataFrame:
    """RSI with Wilder smoothing for the rows from ``pos`` 1, null up to ``n``.

    The smoothing is a linear recurrence, so it runs through ``fold_linear``
    on the changes (which start at the second row).
    """
    df = bars if POS in bars.columns else numbered(bars, step, keys)
    change = F.col(col) - F.col("_prev")
    moves = (
        roll(df.select(*keys, POS, col), {"_prev": lagged(col, 1)}, step, keys)
        .filter(F.col(POS) >= 1)
        .select(
            *keys, (F.col(POS) - 1).alias(POS),
            F.greatest(change, F.lit(0.0)).alias("gain"), F.greatest(-change, F.lit(0.0)).alias("loss"),
        )
    )
    folded = fold_linear(moves, keys, {"g": "gain", "l": "loss"}, (n - 1.0) / n, 1.0 / n, n, block_rows)
    g, l = F.col("g"), F.col("l")
    value = F.when(g.isNull(), None).when(l == 0, F.when(g > 0, 100.0).otherwise(50.0)).otherwise(
        100.0 - 100.0 / (1.0 + g / l)
    )
    return folded.select(*keys, (F.col(POS) + 1).alias(POS), value.alias(out))


def stoch_rsi(rsi_col: str = "rsi", n: int = 14, warm: int = 14) -> Roll:
    """Place of the RSI in its own last ``n`` values; 50 for a flat window."""
    def build(w):
        frame = w.rowsBetween(-(n - 1), 0)
        lo, hi = F.min(rsi_col).over(frame), F.max(rsi_col).over(frame)
        value = F.when(hi == lo, 50.0).otherwise((F.col(rsi_col) - lo) / (hi - lo) * 100.0)
        return F.when(F.col(POS) >= warm + n - 1, value)

    return Roll(n - 1, build)


def _context_parts(daily: DataFrame, step: int, keys, week: int) -> list[DataFrame]:
    """Change, oscillators and both means of every bar, each by key and ``pos``."""
    df = cut(numbered(daily.select(*keys, "open_time_ms", "close_time_ms", "close"), step, keys))
    return [
        roll(df, {"_c7": momentum("close", week)}, step, keys).select(*keys, POS, "close_time_ms", "close", "_c7"),
        roll(rsi_wilder(df, step, keys=keys), {"_stoch": stoch_rsi()}, step, keys).select(*keys, POS, "rsi", "_stoch"),
        ema(df, 20, step, out="_e20", keys=keys), ema(df, 50, step, out="_e50", keys=keys),
    ]


def _context(rows: DataFrame, keys) -> DataFrame:
    away = lambda e: F.round((F.col("close") / F.col(e) - 1.0) * 100.0, 2)
    return rows.select(
        *keys,
        F.round("close", 10).alias("daily_close"),
        F.round("rsi", 2).alias("daily_rsi14"),
        F.round("_stoch", 2).alias("daily_stoch_rsi14"),
        F.round("_c7", 2).alias("daily_change_7d_pct"),
        F.round("_e20", 10).alias("daily_ema20"),
        F.round("_e50", 10).alias("daily_ema50"),
        away("_e20").alias("distance_from_daily_ema20_pct"),
        away("_e50").alias("distance_from_daily_ema50_pct"),
        (F.col(POS) + 1).alias("daily_candles_used"),
    )


def daily_contexts(daily: DataFrame, step: int, keys=("symbol",), minimum: int = 55, week: int = 7) -> DataFrame:
    """Higher-timeframe context at every bar from the ``minimum``-th, with its ``daily_close_ms``."""
    keys = list(keys)
    rows, *others = _context_parts(daily, step, keys, week)
    for other in others:
        rows = rows.join(other, [*keys, POS])
    rows = rows.filter(F.col(POS) >= minimum - 1)
    return _context(rows, [*keys, F.col("close_time_ms").alias("daily_close_ms")])


def daily_context(daily: DataFrame, step: int, keys=("symbol",), minimum: int = 55, week: int = 7) -> DataFrame:
    """Higher-timeframe context at the last bar of each symbol."""
    keys = list(keys)

    def newest(rows):
        values = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), POS).alias("x")).select(*keys, "x.*")

    rows, *others = map(newest, _context_parts(daily, step, keys, week))
    for other in others:
        rows = rows.join(other.drop(POS), keys)
    return _context(rows.filter(F.col(POS) >= minimum - 1), keys)
