"""A paper account as joins and columns: which signals are admitted, and how their trades end.

What a signal's trade would do does not depend on the account, so the exits of all usable
signals come from one walk over the bars. A trade frees its symbol at its exit or at the end of the
cooldown, whichever is later; the first usable signal from then on is the next one admitted.
So the admitted signals are those that these followers reach from the first one of a symbol,
found by pointer doubling, and every other signal's reason is read off the last admitted one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlytics.functions.scalar import feature_vector
from barlytics.operators.gaps import closure
from barlytics.operators.grid import next_bucket
from barlytics.operators.joins import asof_join, broadcast_if_small
from barlytics.operators.labels import gap_aware_exit
from barlytics.session import cut

HOUR = 3_600_000

# Columns of the events, features of a signal and their scales.
EVENTS = (
    "kind string, symbol string, id string, side string, timestamp_ms bigint, reason string, entry_ms bigint, "
    "entry_price double, status string, mae_pct double, mfe_pct double, net_return_pct double, stressed_net_return_pct double, data_error string"
)
FEATURES = ["momentum_3h_pct", "momentum_12h_pct", "momentum_24h_pct", "distance_from_1h_sma10_pct", "volume_expansion_1h", "swing_score"]
SCALES = (10, 20, 30, 5, 3, 100)


def judged(signals: DataFrame, registry: DataFrame, start: Column, max_age_ms: int = 600_000) -> DataFrame:
    """Signals with the reason that a row alone gives (``early``), and whether their features are usable.

    ``signals``: id, symbol, bias, timestamp_ms, observed_ms and the features; ``registry``: symbol, classification.
    """
    s = signals.join(broadcast_if_small(registry.select("symbol", "classification")), "symbol", "left")
    age = F.col("observed_ms") - F.col("timestamp_ms")
    early = (
        F.when(F.col("timestamp_ms") < start, "PRE_ACTIVATION").when(age < 0, "FUTURE_TIMESTAMP")
        .when(age > max_age_ms, "STALE_AT_OBSERVATION")
        .when(F.coalesce(F.col("classification") != "CRYPTO", F.lit(True)), "IDENTITY_NOT_VERIFIED_CRYPTO")
        .when(~F.coalesce(F.col("bias").isin("LONG", "SHORT"), F.lit(False)), "INVALID_SIDE")
    )
    return s.select(
        "symbol", F.col("observed_ms").alias("at_ms"), F.col("id").cast("string").alias("id"), F.col("bias").alias("side"),
        early.alias("early"), feature_vector(FEATURES, SCALES).isNotNull().alias("usable"),
    )


def account(
    signals: DataFrame, bars: DataFrame, step: int, target: float = 5.0, stop: float = 6.0, cooldown_ms: int = 24 * HOUR,
) -> DataFrame:
    """Events of all symbols' accounts over ``signals`` (see ``judged``) and closed ``bars``.

    One trade at a time in a symbol, entered at the open of the bar after its signal; a bar counts when
    it closes, before signals of the same instant. A trade that meets a missing bar stays
    open and says so once. A repeated id says something only if its reason changes, and nothing
    more once it is admitted. Ids have one timestamp each, and the cooldown is longer than
    the age up to which a signal counts, so no id can be admitted twice.
    """
    signals = cut(signals)
    usable = signals.filter("early is null and usable").groupBy("symbol", "at_ms").agg(F.min(F.struct("id", "side")).alias("_s"))
    usable = usable.select("symbol", "at_ms", "_s.id", "_s.side")
    asked = usable.select(F.concat_ws("@", "symbol", F.col("at_ms").cast("string")).alias("id"), "symbol", "side", next_bucket("at_ms", step).alias("entry_ms"), "at_ms", F.col("id").alias("signal_id"))
    ends = cut(gap_aware_exit(asked, bars, step, bars.agg(F.max("open_time_ms") + step).scalar(), target, stop, run_end=True).withColumnRenamed("id", "_trade").withColumnRenamed("signal_id", "id"))
    freed = F.col("resolved_bar_ms") + step
    free = ends.filter("resolved_bar_ms is not null").select("symbol", "at_ms", F.greatest(F.col("at_ms") + cooldown_ms, freed).alias("_free"))
    follow = asof_join(free, ends.select("symbol", F.col("at_ms").alias("_next")), "_free", "_next", cooldown_ms * 16, strict=False, forward=True)
    first = ends.groupBy("symbol").agg(F.min("at_ms").alias("at_ms"))
    taken = closure(first, follow.filter("_next is not null").select("symbol", "at_ms", "_next"), ["symbol"], "at_ms")
    taken = cut(ends.join(taken, ["symbol", "at_ms"], "left_semi"))
    return _admissions(signals, taken, step, cooldown_ms).unionByName(_outcomes(taken, step)).unionByName(_stalled(taken, bars, step))


def _none(**kinds: str) -> list[Column]:
    return [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]


def _admissions(signals: DataFrame, taken: DataFrame, step: int, cooldown_ms: int) -> DataFrame:
    last = taken.select("symbol", F.col("at_ms").alias("_last"), (F.col("resolved_bar_ms") + step).alias("_freed"))
    rows = asof_join(signals, last, "at_ms", "_last", cooldown_ms * 16)
    here = taken.select("symbol", "at_ms", F.col("id").alias("_here"), "entry_ms")
    known = taken.select("symbol", "id", F.col("at_ms").alias("_admitted"))
    rows = rows.join(here, ["symbol", "at_ms"], "left").join(known, ["symbol", "id"], "left")
    same = Window.partitionBy("symbol", "id").orderBy("at_ms", F.col("early").isNotNull())
    # The row that is admitted: of equal rows the first one without an early reason.
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("symbol", "id", "at_ms").orderBy(F.col("early").isNotNull(), ~F.col("usable"))))
    admitted = F.col("early").isNull() & F.col("usable") & (F.col("_here") == F.col("id")) & (F.col("_nth") == 1)
    held = F.col("_last").isNotNull() & (F.col("_freed").isNull() | (F.col("_freed") > F.col("at_ms")))
    reason = (
        F.when(admitted, "ACCEPTED").when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("_here") < F.col("id"), "POSITION_ALREADY_OPEN").when(held, "POSITION_ALREADY_OPEN")
        .when(F.col("at_ms") - F.col("_last") < cooldown_ms, "SYMBOL_COOLDOWN").otherwise("INVALID_FEATURES")
    )
    rows = rows.withColumn("reason", reason)
    silent = F.col("_admitted").isNotNull() & ((F.col("at_ms") > F.col("_admitted")) | ((F.col("at_ms") == F.col("_admitted")) & (F.col("reason") != "ACCEPTED")))
    rows = rows.filter(~silent).withColumn("_before", F.lag("reason").over(same)).filter(~F.col("reason").eqNullSafe(F.col("_before")))
    accepted = F.col("reason") == "ACCEPTED"
    return rows.select(
        F.lit("ADMISSION").alias("kind"), "symbol", "id", "side", F.col("at_ms").alias("timestamp_ms"), "reason", F.when(accepted, F.col("entry_ms")).alias("entry_ms"),
        *_none(entry_price="double"), F.when(accepted, "PENDING").alias("status"),
        *_none(mae_pct="double", mfe_pct="double", net_return_pct="double", stressed_net_return_pct="double", data_error="string"),
    )


def _outcomes(taken: DataFrame, step: int) -> DataFrame:
    return taken.filter("resolved_bar_ms is not null").select(
        F.lit("OUTCOME").alias("kind"), "symbol", "id", "side", (F.col("resolved_bar_ms") + step).alias("timestamp_ms"), *_none(reason="string"), "entry_ms",
        "entry_price", "status", "mae_pct", "mfe_pct", "net_return_pct", "stressed_net_return_pct", *_none(data_error="string"),
    )


def _stalled(taken: DataFrame, bars: DataFrame, step: int) -> DataFrame:
    """Open trades whose next bar is missing although later ones are there."""
    open_trades = taken.filter("resolved_bar_ms is null").withColumn("_missing", F.coalesce(F.col("run_end_ms") + step, F.col("entry_ms")))
    later = asof_join(open_trades, bars.select("symbol", F.col("open_time_ms").alias("_later")), "_missing", "_later", step * 512, strict=False, forward=True)
    return later.filter("_later is not null").select(
        F.lit("STALLED").alias("kind"), "symbol", "id", "side", (F.col("_later") + step).alias("timestamp_ms"), *_none(reason="string"), "entry_ms", "entry_price", "status",
        "mae_pct", "mfe_pct", *_none(net_return_pct="double", stressed_net_return_pct="double"), F.lit("MISSING_BAR").alias("data_error"),
    )


def deliver(batch: DataFrame, batch_id: int, out: str, kept: str, work) -> None:
    """Adds a delivery in time order to ``kept`` and writes the events that it causes.

    Rows carry ``at_ms``, the time at which they count. ``work`` gives the events of all rows so
    far; those from the delivery's first time on are its own. A repeated delivery overwrites its folders.
    """
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{kept}/batch={batch_id}")
    since = batch.agg(F.min("at_ms")).first()[0]
    if since is None:
        return
    rows = spark.read.parquet(f"{kept}/batch=*")
    work(rows).filter(F.col("timestamp_ms") >= since).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
