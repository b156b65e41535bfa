"""Time grids and resampling on epoch-millisecond columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlytics.functions.scalar import _c
from barlytics.operators.blocks import prefix

BAR_VALUES = [
    "open", "high", "low", "close", "volume", "quote_volume", "trades",
    "taker_buy_base_volume", "taker_buy_quote_volume",
]


def floor_bucket(ms, step: int) -> Column:
    ms = _c(ms)
    return ms - F.pmod(ms, F.lit(step).cast("bigint"))


def ceil_bucket(ms, step: int) -> Column:
    return floor_bucket(_c(ms) + F.lit(step - 1), step)


def next_bucket(ms, step: int) -> Column:
    """Start of the bucket strictly after ``ms``."""
    return floor_bucket(ms, step) + F.lit(step).cast("bigint")


def _tick_key(t: Column, seq: Column, step: int, seq_bits: int, tick_ms: int) -> Column:
    """One sortable number from the time inside the bucket and the sequence.

    A number keeps the first/last-tick aggregates in the hash aggregate, where
    a struct key would force a sort of all ticks before the partial step. Both
    parts share one long when they fit, else a (slower) decimal.
    """
    slots = -(-step // tick_ms)
    offset = F.floor(F.pmod(t, F.lit(step).cast("bigint")) / tick_ms)
    if (slots - 1).bit_length() + seq_bits <= 63:
        return offset * F.lit(2**seq_bits) + seq
    dec = lambda c: c.cast("decimal(38,0)")
    return dec(offset) * F.lit("1" + "0" * 19).cast("decimal(20,0)") + dec(seq)


def ticks_to_bars(
    ticks: DataFrame,
    step: int,
    keys=("symbol",),
    time: str = "t_ms",
    seq: str = "seq",
    seq_bits: int = 43,
    tick_ms: int = 1,
) -> DataFrame:
    """OHLCV bars from ticks ``(symbol, t_ms, seq, price, qty, quote, taker_*)``.

    One shuffle, after map-side partial aggregation: what moves is at most one
    row per symbol, bucket and task, however many ticks a symbol has. ``seq``
    orders the ticks of one time; it is unique there and fits ``seq_bits``.
    Times are multiples of ``tick_ms``.
    """
    return (
        ticks.withColumn("open_time_ms", floor_bucket(time, step))
        .withColumn("_key", _tick_key(F.col(time), F.col(seq), step, seq_bits, tick_ms))
        .groupBy(*keys, "open_time_ms")
        .agg(
            F.min_by("price", "_key").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_key").alias("close"),
            F.sum("qty").alias("volume"),
            F.sum("quote").alias("quote_volume"),
            F.count(F.lit(1)).alias("trades"),
            F.sum("taker_base").alias("taker_buy_base_volume"),
            F.sum("taker_quote").alias("taker_buy_quote_volume"),
        )
        .withColumn("close_time_ms", F.col("open_time_ms") + F.lit(step - 1).cast("bigint"))
    )


def rollup(bars: DataFrame, step: int, keys=("symbol",)) -> DataFrame:
    """Coarser bars from finer ones; a bucket needs only one bar to exist."""
    return _aggregate_bars(bars, step, keys).withColumn(
        "close_time_ms", F.col("open_time_ms") + F.lit(step - 1).cast("bigint")
    )


def resample(bars: DataFrame, base_step: int, k: int, keys=("symbol",)) -> DataFrame:
    """Coarser bars, kept only where exactly ``k`` contiguous bars exist.

    Contiguity is read off hash aggregates: ``k`` rows, one residue modulo the
    step, and a bit mask with each of the ``k`` slots of the bucket set.
    """
    if not 1 <= k <= 62:
        raise ValueError("k must be between 1 and 62")
    full = (F.col("_n") == k) & (F.col("_slots") == F.lit(2**k - 1)) & (F.col("_r0") == F.col("_r1"))
    return (
        _aggregate_bars(bars, base_step * k, keys, base_step)
        .filter(full)
        .select(
            *keys, F.col("_first").alias("open_time_ms"), *BAR_VALUES,
            F.col("_close_time").alias("close_time_ms"),
        )
    )


def _aggregate_bars(bars: DataFrame, step: int, keys, base_step: int | None = None) -> DataFrame:
    t = F.col("open_time_ms")
    extra = []
    if base_step is not None:
        slot = F.floor((t - F.col("_bucket")) / base_step).cast("int")
        residue = F.pmod(t, F.lit(base_step))
        extra = [
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), slot)).alias("_slots"),
            F.min(residue).alias("_r0"),
            F.max(residue).alias("_r1"),
            F.count(F.lit(1)).alias("_n"),
            F.min(t).alias("_first"),
            F.max("close_time_ms").alias("_close_time"),
        ]
    return (
        bars.withColumn("_bucket", floor_bucket("open_time_ms", step))
        .groupBy(*keys, "_bucket")
        .agg(
            F.min_by("open", t).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", t).alias("close"),
            *[F.sum(c).alias(c) for c in BAR_VALUES[4:]],
            *extra,
        )
        .withColumnRenamed("_bucket", "open_time_ms")
    )


def asof_grid(bounds: DataFrame, step: int, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """One row per sample time: the step boundary after ``start``, plus 1 ms."""
    first = next_bucket(start, step) + 1
    return bounds.filter(first <= F.col(end)).select(
        F.explode(F.sequence(first, F.col(end), F.lit(step).cast("bigint"))).alias("asof_ms")
    )


def common_window(bars: DataFrame, warmup_ms: int, horizon_ms: int, keys=("symbol",)) -> DataFrame:
    """The span in which every symbol has warm-up behind and horizon ahead."""
    per = bars.groupBy(*keys).agg(
        (F.min("close_time_ms") + F.lit(warmup_ms)).alias("_s"),
        (F.max("close_time_ms") - F.lit(horizon_ms)).alias("_e"),
    )
    return per.agg(F.max("_s").alias("start_ms"), F.min("_e").alias("end_ms"))


def checkpoints(
    fine: DataFrame, coarse: DataFrame, n: int = 24, step: int = 3_600_000,
    coarse_step: int = 14_400_000, offset: int = 300_000,
    fine_skip: int = 30, coarse_skip: int = 25, keys=("symbol",),
) -> DataFrame:
    """``n`` evenly spread sample times per symbol, snapped to ``step`` + offset.

    ``fine`` and ``coarse`` carry the bar position in ``pos``.
    """
    def edge(df, skip, tag):
        return df.groupBy(*keys).agg(
            F.coalesce(F.max(F.when(F.col("pos") == skip, F.col("open_time_ms"))), F.lit(0)).alias(f"_{tag}_open"),
            F.max("close_time_ms").alias(f"_{tag}_close"),
        )

    both = edge(fine, fine_skip, "f").join(edge(coarse, coarse_skip, "c"), list(keys))
    earliest = F.greatest("_f_open", "_c_open")
    latest = F.least(F.col("_f_close") + 1, F.col("_c_close") + F.lit(coarse_step))
    point = F.expr(
        f"((_e + (_i * (_l - _e)) div {n + 1}) div {step}) * {step} + {offset}"
    )
    return (
        both.select(*keys, earliest.alias("_e"), latest.alias("_l"))
        .filter("_l > _e")
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint"))))
        .withColumn("asof_ms", point)
        .filter("_e < asof_ms and asof_ms <= _l")
        .select(*keys, "asof_ms")
        .distinct()
    )


def one_per_bucket(
    snaps: DataFrame, step: int, rule: str = "monotone",
    time: str = "generated_at_ms", arrival: str | None = None,
    keys=(), arrival_chunk: int = 65_536,
) -> DataFrame:
    """First snapshot per bucket in arrival order.

    ``monotone`` skips a bucket not above every earlier one; ``equality`` skips
    only a repeat of the bucket just before. When arrival order is time order
    both are the first row of each bucket, so rows spread over the buckets.
    """
    b = snaps.withColumn("bucket_start_ms", floor_bucket(time, step))
    if arrival is None:
        w = Window.partitionBy(*keys, "bucket_start_ms").orderBy(time)
        return b.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    kind = "max" if rule == "monotone" else "lag"
    seen = prefix(
        b, keys, arrival, floor_bucket(arrival, arrival_chunk),
        {"_before": ("bucket_start_ms", kind)},
    )
    moved = F.col("bucket_start_ms") > F.col("_before")
    if rule != "monotone":
        moved = F.col("bucket_start_ms") != F.col("_before")
    return seen.filter(F.col("_before").isNull() | moved).drop("_before")
