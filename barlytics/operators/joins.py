"""Joins over time and keys: as-of, forward range, gates, overlays, diffs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlytics.functions.scalar import first_reason
from barlytics.operators.grid import floor_bucket

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def broadcast_if_small(df: DataFrame, limit_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint for a side whose planned size is below the limit.

    A side of unknown or larger size stays unhinted: the plan then uses a
    shuffle join, or AQE broadcasts it after measuring it.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= limit_bytes else df


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    bucket_ms: int,
    keys=("symbol",),
    strict: bool = True,
    forward: bool = False,
    salts: int = 1,
) -> DataFrame:
    """The last right row before each left row, per key (all left rows stay)."""
    return asof_joins(left, [(right, right_time)], left_time, bucket_ms, keys, strict, forward, salts)


def asof_joins(
    left: DataFrame,
    rights: list[tuple[DataFrame, str]],
    left_time: str,
    bucket_ms: int,
    keys=("symbol",),
    strict: bool = True,
    forward: bool = False,
    salts: int = 1,
) -> DataFrame:
    """The last row of each (right, time) before each left row, per key.

    ``strict`` wants the right time below the left one, otherwise equal times
    match too. ``forward`` looks for the first right row after instead. All
    inputs are worked out and shuffled once, to windows of one key and one time bucket; the
    last row of earlier buckets comes in as one row per bucket, however far
    back it lies. With ``salts`` the left rows of a bucket spread over that
    many tasks, each with a copy of its right rows: for left sides with far
    more rows than the right. Column names other than the keys are distinct.
    """
    keys = list(keys)
    sign = -1 if forward else 1
    values = [[c for c in r.columns if c not in keys] for r, _ in rights]
    kind = lambda df, cols: df.select(F.struct(*cols).alias("s")).schema["s"].dataType
    left_kind, kinds = kind(left, left.columns), [kind(r, v) for (r, _), v in zip(rights, values)]
    salted = ["_salt"] if salts > 1 else []

    def rows(df, time, which, side):
        own = F.struct(*(left.columns if which is None else values[which]))
        salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(salts))
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
        return df.select(
            *keys, (F.col(time) * sign).cast("bigint").alias("_t"), F.lit(side).alias("_side"),
            (own if which is None else F.lit(None).cast(left_kind)).alias("_left"),
            *[(own if which == i else F.lit(None).cast(k)).alias(f"_r{i}") for i, k in enumerate(kinds)],
            *[(salt if which is None else copies).alias(c) for c in salted],
        )

    # Of two rows at one time the left one sorts first in a strict join.
    own = 0 if strict else 1
    met = rows(left, left_time, None, own)
    for i, (right, time) in enumerate(rights):
        met = met.unionByName(rows(right, time, i, 1 if strict else 0))
    # Both uses below read this one exchange, so both must ask for the same rows and the same columns, whole. The
    # filter takes what the joins below would drop: left to itself, the optimizer puts it before one of the uses only.
    met = met.withColumn("_bucket", floor_bucket("_t", bucket_ms))
    for c in (*keys, "_bucket"):
        met = met.filter(F.col(c).isNotNull())
    met = met.repartition(*keys, "_bucket", *salted)
    here = Window.partitionBy(*keys, "_bucket", *salted).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = met.withColumns({f"_h{i}": F.last(f"_r{i}", ignorenulls=True).over(here) for i in range(len(kinds))})
    found = found.filter(F.col("_left").isNotNull()).select(*keys, "_bucket", "_left", *[f"_h{i}" for i in range(len(kinds))])
    # Last row of each right bucket, carried on to the buckets with left rows.
    ends = met.groupBy(*keys, "_bucket").agg(
        F.max(F.col("_left").isNotNull() & (F.col("_side") == own)).alias("_asks"),
        *[F.max_by(f"_r{i}", F.when(F.col(f"_r{i}").isNotNull(), F.col("_t"))).alias(f"_e{i}") for i in range(len(kinds))],
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumns({f"_b{i}": F.last(f"_e{i}", ignorenulls=True).over(earlier) for i in range(len(kinds))})
    carried = carried.filter("_asks").select(*keys, "_bucket", *[f"_b{i}" for i in range(len(kinds))])
    last = [F.coalesce(f"_h{i}", f"_b{i}") for i in range(len(kinds))]
    # A field taken from the bare struct would be cut out of it before the exchange of this use alone.
    whole = F.when(F.col("_left").isNotNull(), F.col("_left"))
    return found.join(carried, [*keys, "_bucket"]).select(
        *[whole[c].alias(c) for c in left.columns], *[last[i][c].alias(c) for i, cols in enumerate(values) for c in cols]
    )


def forward_join(
    anchors: DataFrame,
    bars: DataFrame,
    start: Column,
    end: Column,
    bucket_ms: int,
    time: str = "open_time_ms",
    keys=("symbol",),
    end_inclusive: bool = False,
) -> DataFrame:
    """Every bar whose ``time`` lies in ``[start, end)`` of an anchor.

    Anchors are repeated for the few time buckets their span covers and meet
    the bars on ``(key, bucket)``, so one busy symbol spreads over its buckets
    and no pair outside the neighbourhood is formed. Bar columns come back as a
    struct ``bar``.
    """
    keys = list(keys)
    last = end if end_inclusive else end - 1
    a = (
        anchors.withColumn("_s", start)
        .withColumn("_e", last)
        .filter("_s <= _e")
        .withColumn(
            "_b",
            F.explode(
                F.sequence(
                    floor_bucket("_s", bucket_ms), floor_bucket("_e", bucket_ms),
                    F.lit(bucket_ms).cast("bigint"),
                )
            ),
        )
    )
    b = bars.select(
        *keys, floor_bucket(time, bucket_ms).alias("_b"),
        F.col(time).alias("_bt"), F.struct(*[c for c in bars.columns if c not in keys]).alias("bar"),
    )
    return (
        a.join(b, [*keys, "_b"])
        .filter("_bt >= _s and _bt <= _e")
        .drop("_b", "_bt", "_s", "_e")
    )


def lookup_snapshot(triggers: DataFrame, pool: DataFrame, context: DataFrame, keys=("symbol",)) -> DataFrame:
    """Pool row of the same symbol (or nulls) plus the one-row market context."""
    ctx = context.select(F.struct(*context.columns).alias("c")).scalar()
    return triggers.join(pool, list(keys), "left").withColumn("_ctx", ctx).select(
        "*", *[F.col(f"_ctx.{c}").alias(c) for c in context.columns]
    ).drop("_ctx")


def gate_join(
    signals: DataFrame, gate: DataFrame, on=("market_regime", "quality_bucket"),
    enabled: Column | None = None,
) -> DataFrame:
    """Look up approved combinations; anything not found is refused.

    ``gate`` holds one row per approved combination, ``enabled`` says whether
    the gate is switched on. Adds ``allowed`` and ``gate_reason``.
    """
    on = list(on)
    marked = gate.select(*on).distinct().withColumn("_approved", F.lit(True))
    enabled = F.lit(True) if enabled is None else enabled
    known = None
    for c in on:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    combo = F.concat_ws(" / ", *on)
    out = signals.join(broadcast_if_small(marked), on, "left")
    reason = F.coalesce(
        first_reason(
            (~enabled, "gate is off: nothing has been approved"),
            (~known, "gate is on, but the signal has no context"),
            (F.col("_approved").isNotNull(), F.concat(F.lit("approved: "), combo)),
        ),
        F.concat(F.lit("not approved: "), combo),
    )
    allowed = enabled & known & F.col("_approved").isNotNull()
    return out.withColumn("gate_reason", reason).withColumn("allowed", allowed).drop("_approved")


def overlay(low: DataFrame, high: DataFrame, keys) -> DataFrame:
    """Union in which a row of ``high`` replaces the row of ``low`` per key."""
    keys = list(keys)
    both = low.withColumn("_p", F.lit(0)).unionByName(high.withColumn("_p", F.lit(1)))
    values = [c for c in low.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*values), "_p").alias("_v"))
    return best.select(*keys, "_v.*")


def unprocessed(events: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return events.join(done.select(key), key, "left_anti")


def exclude_bases(df: DataFrame, bases: list[str], quote: str, symbol: str = "symbol") -> DataFrame:
    """Drop symbols whose base (the symbol without its quote suffix) is listed."""
    base = F.regexp_replace(F.col(symbol), f"{quote}$", "")
    return df.filter(~base.isin(*bases))


def verified_only(df: DataFrame, registry: DataFrame, key: str, wanted: str, cls: str = "classification") -> DataFrame:
    """Rows whose key is registered with the wanted class."""
    good = registry.filter(F.col(cls) == wanted).select(key)
    return df.join(broadcast_if_small(good), key, "left_semi")


def context_join(rows: DataFrame, context: DataFrame, on: str = "asof_ms") -> DataFrame:
    return rows.join(context, on)


def is_close(a: Column, b: Column, rel: float, absolute: float) -> Column:
    """Near-equality with a relative and an absolute tolerance."""
    limit = F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return (a == b) | (F.abs(a - b) <= limit)


def reconcile(
    saved: DataFrame, recomputed: DataFrame, keys,
    numeric: list[str], exact: list[str] = (), rel: float = 1e-9, absolute: float = 1e-9,
) -> DataFrame:
    """Field-by-field differences of two tables, one row per difference.

    Rows missing on one side appear once, with field ``<missing>``.
    """
    keys = list(keys)
    s = saved.select(*keys, F.struct(*numeric, *exact).alias("_s"))
    r = recomputed.select(*keys, F.struct(*numeric, *exact).alias("_r"))
    both = s.join(r, keys, "full_outer")
    text = lambda c: c.cast("string")

    def entry(name, bad):
        a, b = F.col(f"_s.{name}"), F.col(f"_r.{name}")
        return F.when(bad, F.struct(F.lit(name).alias("field"), text(a).alias("saved"), text(b).alias("recomputed")))

    both_there = F.col("_s").isNotNull() & F.col("_r").isNotNull()
    items = [
        F.when(
            ~both_there,
            F.struct(
                F.lit("<missing>").alias("field"),
                F.when(F.col("_s").isNotNull(), F.lit("present")).alias("saved"),
                F.when(F.col("_r").isNotNull(), F.lit("present")).alias("recomputed"),
            ),
        )
    ]
    for c in numeric:
        a, b = F.col(f"_s.{c}").cast("double"), F.col(f"_r.{c}").cast("double")
        same = (a.isNull() & b.isNull()) | F.coalesce(is_close(a, b, rel, absolute), F.lit(False))
        items.append(entry(c, both_there & ~same))
    for c in exact:
        items.append(entry(c, both_there & ~F.col(f"_s.{c}").eqNullSafe(F.col(f"_r.{c}"))))
    found = F.filter(F.array(*items), lambda x: x.isNotNull())
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")


def reward_join(sent: DataFrame, trades: DataFrame, cutoff_ms: int, now_ms: int) -> DataFrame:
    """Delivered calls with a resolved trade, rewarded in units of planned risk.

    ``sent``: id, sent_ms. Calls whose exit bar starts before the delivery are
    kept with ``excluded`` set and no reward; labels still in the future are
    left out.
    """
    final = ("TARGET", "STOP", "AMBIGUOUS_LOSS")
    j = sent.filter(F.col("sent_ms") >= cutoff_ms).join(
        trades.filter(F.col("status").isin(*final)), "id"
    )
    early = F.col("resolved_bar_ms") < F.col("sent_ms")
    return (
        j.withColumn("excluded", F.when(early, F.lit("EXIT_CANDLE_PRECEDES_DELIVERY")))
        .filter(early | (F.col("label_available_ms") <= now_ms))
        .withColumn("reward_r", F.when(~early, F.col("net_return_pct") / F.col("stop_pct")))
        .withColumn("stressed_reward_r", F.when(~early, F.col("stressed_net_return_pct") / F.col("stop_pct")))
    )


def missing_keys(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.select(key).distinct().join(present.select(key), key, "left_anti")


def latest_per_key(df: DataFrame, keys, order: Column | str) -> DataFrame:
    """The row with the largest ``order`` per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order) if isinstance(order, str) else order.desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
