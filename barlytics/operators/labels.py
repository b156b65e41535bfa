"""Labels from the price path after each anchor.

All horizons, targets and stops of an anchor come out of one walk over a pyramid of
highs and lows: extremes, counts and last closes of each horizon, first hit times and the
worst move up to a target. First-hit times then decide every (target, stop, horizon)
combination without another join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlytics.functions.scalar import _c, clamp, directional_return
from barlytics.operators.grid import ceil_bucket
from barlytics.operators.indicators import numbered
from barlytics.operators import pyramid
from barlytics.operators.joins import asof_join
from barlytics.session import cut

HOUR = 3_600_000


def tag(x: float) -> str:
    return f"{x:g}".replace(".", "_")


def favorable_adverse(entry, bias, high, low) -> tuple[Column, Column]:
    fav = F.when(_c(bias) == "SHORT", (1.0 - _c(low) / _c(entry)) * 100.0).otherwise((_c(high) / _c(entry) - 1.0) * 100.0)
    adv = F.when(_c(bias) == "SHORT", (1.0 - _c(high) / _c(entry)) * 100.0).otherwise((_c(low) / _c(entry) - 1.0) * 100.0)
    return fav, adv


def path_blocks(bars: DataFrame, horizons_ms, window: str = "open", step: int = 300_000, keys=("symbol",)) -> DataFrame:
    """The written pyramid that ``path_facts`` reads for these horizons."""
    time = "close_time_ms" if window == "close" else "open_time_ms"
    return pyramid.build(bars, step, pyramid.height(max(horizons_ms) / step), time, keys)


def path_facts(
    anchors: DataFrame, bars: DataFrame, anchor_id: str, targets, stops, horizons_ms,
    bucket_ms: int, window: str = "open", step: int = 300_000, keys=("symbol",), carry=(), blocks: DataFrame | None = None,
) -> DataFrame:
    """Per anchor: first hit times, extremes, counts and last close per horizon.

    One pass over a pyramid of highs and lows (see ``pyramid``): an anchor meets rows whose number
    grows with the logarithm of its longest horizon. ``blocks`` is that pyramid, where several calls
    share one (see ``path_blocks``).

    Anchors carry ``entry_price, bias, asof_ms``. ``window`` picks the bars:

    * ``open``  - open time in ``[asof, asof + h)``
    * ``ceil``  - open time in ``[asof rounded up to step, asof + h]``
    * ``close`` - close time from the first one at/after ``asof``; the first
      bar counts as one ``step`` of elapsed time.
    """
    longest = max(horizons_ms)
    if window == "close":
        firsts = bars.select(*keys, F.col("close_time_ms").alias("first_ms"))
        anchors = asof_join(anchors, firsts, "asof_ms", "first_ms", bucket_ms, keys, strict=False, forward=True)
        anchors = anchors.filter(F.col("first_ms").isNotNull() & (F.col("first_ms") <= F.col("asof_ms") + longest))
        origin = F.col("first_ms") - F.lit(step)
        start, inclusive = F.col("first_ms"), True
        end = F.least(origin + F.lit(longest), F.col("asof_ms") + F.lit(longest))
    elif window == "ceil":
        origin, inclusive = F.col("asof_ms"), True
        start, end = ceil_bucket("asof_ms", step), F.col("asof_ms") + F.lit(longest)
    else:
        origin, inclusive = F.col("asof_ms"), False
        start, end = F.col("asof_ms"), F.col("asof_ms") + F.lit(longest)

    edge = [origin + F.lit(h) + F.lit(int(inclusive)) for h in horizons_ms]
    last = end + F.lit(int(inclusive))
    order = sorted(range(len(horizons_ms)), key=lambda i: horizons_ms[i])
    ends = [F.least(edge[i], last).cast("bigint") for i in order]
    levels = pyramid.height(longest / step)
    blocks = path_blocks(bars, horizons_ms, window, step, keys) if blocks is None else blocks
    barriers = [pyramid.Barrier(f"target_{tag(T)}", lambda fav, adv, T=T: fav >= T, path=True) for T in targets]
    barriers += [pyramid.Barrier(f"stop_{tag(S)}", lambda fav, adv, S=S: adv <= -S) for S in stops]
    anchors = anchors.withColumns({"_origin": origin, "_start": start.cast("bigint")})
    own = ["asof_ms", "_origin", *[c for c in carry if c != "asof_ms"]]
    facts = pyramid.walk(anchors, blocks, anchor_id, F.col("_start"), ends, barriers, step, levels, keys, own)
    names = {"_origin": "origin_ms"}
    for k, i in enumerate(order):
        names |= {f"n_{k}": f"bars_{horizons_ms[i]}"} | {f"{c}_{k}": f"{c}_{horizons_ms[i]}" for c in ("fav", "adv", "close")}
    facts = facts.withColumnsRenamed(names)
    worst = {f"mae_to_target_{tag(T)}": F.when(F.col(f"t_target_{tag(T)}").isNotNull(), F.least(F.lit(0.0), f"adv_target_{tag(T)}")) for T in targets}
    return facts.withColumns(worst).drop(*[f"{c}_target_{tag(T)}" for c in ("fav", "adv") for T in targets])


def resolve(target_time, stop_time) -> Column:
    """Path state from the two first-hit times (null when not hit)."""
    tt, ts = _c(target_time), _c(stop_time)
    return (
        F.when(tt.isNull() & ts.isNull(), "OPEN")
        .when(ts.isNull() | (tt < ts), "TARGET_FIRST")
        .when(tt.isNull() | (ts < tt), "STOP_FIRST")
        .otherwise("AMBIGUOUS")
    )


def path_return(state, target, stop, close_return, clamp_open: bool) -> Column:
    state = _c(state)
    open_value = clamp(close_return, -_c(stop), _c(target)) if clamp_open else _c(close_return)
    return (
        F.when(state == "TARGET_FIRST", _c(target).cast("double"))
        .when(state.isin("STOP_FIRST", "AMBIGUOUS"), -_c(stop).cast("double"))
        .otherwise(open_value)
    )


def _combinations(facts: DataFrame, anchor_id: str, barriers, horizons_ms, inclusive: bool, carry) -> DataFrame:
    """One row per anchor, (target, stop) and horizon with its raw facts.

    First-hit times beyond the horizon read as not hit.
    """
    items = [
        F.struct(
            F.lit(h).cast("bigint").alias("horizon_ms"),
            F.lit(float(target)).alias("target_pct"), F.lit(float(stop)).alias("stop_pct"),
            F.col(f"bars_{h}").alias("bars"), F.col(f"fav_{h}").alias("_fav"), F.col(f"adv_{h}").alias("_adv"),
            F.col(f"close_{h}").alias("_close"), F.col(f"t_target_{tag(target)}").alias("_tt"),
            F.col(f"t_stop_{tag(stop)}").alias("_ts"), F.col(f"mae_to_target_{tag(target)}").alias("_mae"),
        )
        for h in horizons_ms
        for target, stop in barriers
    ]
    rows = facts.select(
        anchor_id, "symbol", "bias", "entry_price", "asof_ms", "origin_ms", *[c for c in carry if c != "asof_ms"],
        F.explode(F.array(*items)).alias("o"),
    ).select("*", "o.*").drop("o").filter("bars > 0")
    edge = F.col("origin_ms") + F.col("horizon_ms")
    inside = lambda c: F.when(F.col(c) <= edge if inclusive else F.col(c) < edge, F.col(c))
    return rows.withColumns({"_tt": inside("_tt"), "_ts": inside("_ts")}).withColumns(
        {
            "_state": resolve("_tt", "_ts"),
            "mfe_pct": F.greatest(F.lit(0.0), "_fav"),
            "mae_pct": F.least(F.lit(0.0), "_adv"),
            "close_return_pct": directional_return("entry_price", "_close", "bias"),
        }
    )


def horizon_table(
    facts: DataFrame, anchor_id: str, target: float, stops, horizons_ms, window: str = "open", carry=(),
) -> DataFrame:
    """Long outcome table: one row per anchor, horizon and stop."""
    o = _combinations(facts, anchor_id, [(target, s) for s in stops], horizons_ms, window != "open", carry)
    minutes = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) - F.col("asof_ms"), F.lit(0)) / 60000.0)
    return o.select(
        anchor_id, "symbol", "bias", *carry, "horizon_ms", "stop_pct", "bars",
        F.col("_tt").isNotNull().alias("target_reached"), F.col("_ts").isNotNull().alias("stop_reached"),
        F.col("_tt").alias("first_target_ms"), F.col("_ts").alias("first_stop_ms"),
        F.when(F.col("_state") != "OPEN", F.least("_tt", "_ts")).alias("resolution_ms"),
        minutes("_tt").alias("minutes_to_target"), minutes("_ts").alias("minutes_to_stop"),
        F.when(F.col("_tt").isNotNull(), F.col("_mae")).alias("mae_before_target_pct"),
        "mfe_pct", "mae_pct", "close_return_pct", F.col("_state").alias("result"),
        path_return("_state", "target_pct", "stop_pct", "close_return_pct", True).alias("sim_return_pct"),
    )


def label_grid(facts: DataFrame, anchor_id: str, barriers, horizons_ms, carry=()) -> DataFrame:
    """Long label table: one row per anchor, (target, stop) pair and horizon.

    An open path returns the raw close return; an ambiguous bar also counts as
    the time to target; a target after a stop still counts as eventual.
    """
    o = _combinations(facts, anchor_id, barriers, horizons_ms, True, carry)
    timed = F.col("_state").isin("TARGET_FIRST", "AMBIGUOUS")
    return o.select(
        anchor_id, *carry, "target_pct", "stop_pct", "horizon_ms",
        F.col("_tt").isNotNull().cast("int").alias("eventual_target"),
        F.col("_state").alias("path"),
        (F.col("_state") == "TARGET_FIRST").cast("int").alias("target_before_stop"),
        (F.col("_state") == "AMBIGUOUS").cast("int").alias("ambiguous"),
        F.when(timed, (F.col("_tt") - F.col("origin_ms")) / 60000.0).alias("time_to_target_min"),
        F.when(timed, F.col("_mae")).alias("mae_before_target_pct"),
        "mfe_pct", "mae_pct", "close_return_pct",
        path_return("_state", "target_pct", "stop_pct", "close_return_pct", False).alias("sim_return_pct"),
    )


def clean_volatile(labels: DataFrame) -> DataFrame:
    """Winners that reached the target first, and those that got there late."""
    late = (F.col("eventual_target") == 1) & F.col("path").isin("STOP_FIRST", "AMBIGUOUS")
    return labels.withColumn("clean", F.col("target_before_stop")).withColumn("volatile", late.cast("int"))


def complete_anchors(facts: DataFrame, horizons_ms, step: int, slack: int = 2) -> DataFrame:
    """Anchors whose every horizon has its bars, up to ``slack`` missing."""
    ok = F.lit(True)
    for h in horizons_ms:
        ok = ok & (F.col(f"bars_{h}") >= max(1, h // step - slack))
    return facts.filter(ok)


def matured(triggers: DataFrame, done: DataFrame, horizons_ms, now: Column, anchor_id: str = "trigger_id") -> DataFrame:
    """(trigger, horizon) pairs that are old enough and not evaluated yet."""
    due = triggers.withColumn(
        "horizon_ms", F.explode(F.array(*[F.lit(h).cast("bigint") for h in horizons_ms]))
    ).filter(now - F.col("asof_ms") >= F.col("horizon_ms"))
    return due.join(done.select(anchor_id, "horizon_ms"), [anchor_id, "horizon_ms"], "left_anti")


def holding_costs(hours, fee: float) -> Column:
    return F.lit(fee) + 0.01 * F.ceil(_c(hours) / 8)


def with_runs(bars: DataFrame, step: int) -> DataFrame:
    """Bars with the id of their unbroken run.

    Inside a run both time and position advance evenly, so time minus position
    times step stays constant; a gap raises it.
    """
    return numbered(bars, step).withColumn("run_id", F.col("open_time_ms") - F.col("pos") * F.lit(step))


def gap_aware_exit(
    trades: DataFrame, bars: DataFrame, step: int, now: Column, target: float = 5.0, stop: float = 6.0, run_end: bool = False,
) -> DataFrame:
    """Exit of each paper trade at its first deciding bar.

    ``trades``: id, symbol, side, entry_ms. A trade opens at the open of the
    bar at ``entry_ms`` and follows the unbroken run of closed bars from there.
    Opening gaps decide first; both barriers in one bar are an ambiguous loss.

    Bars hold ``low <= open <= high``, so a bar decides exactly if its high or low reaches a
    barrier. The first such bar is found in a pyramid of highs and lows, with rows that grow with
    the logarithm of the run, then that bar alone tells how the trade ends. ``id`` names a trade. With
    ``run_end`` the last bar of the run is added as ``run_end_ms``.
    """
    eps = 1e-9
    closed = with_runs(bars, step).filter(F.col("open_time_ms") + step <= now)
    closed = cut(closed.select("symbol", "open_time_ms", "open", "high", "low", "close", "run_id"))
    runs = closed.groupBy("symbol", "run_id").agg(F.max("open_time_ms").alias("_run_end"))
    entry = closed.select("symbol", F.col("open_time_ms").alias("entry_ms"), F.col("open").alias("entry_price"), "run_id")
    live = cut(trades.join(entry.join(runs, ["symbol", "run_id"]).drop("run_id"), ["symbol", "entry_ms"], "left"))
    pending = live.filter("_run_end is null").drop("_run_end", "entry_price")
    live = live.filter("_run_end is not null")
    longest = live.agg(F.max((F.col("_run_end") - F.col("entry_ms")) / step)).first()[0] or 1
    levels = pyramid.height(longest)
    exits = pyramid.Barrier("exit", lambda fav, adv: (fav >= target - eps) | (adv <= -(stop - eps)), path=True)
    found = pyramid.walk(
        live.withColumn("bias", F.col("side")), pyramid.build(closed, step, levels), "id", F.col("entry_ms"),
        [F.col("_run_end") + 1], [exits], step, levels, carry=["side", "entry_ms"],
    )
    reached = F.col("t_exit").isNotNull()
    found = found.select(
        "id", F.col("t_exit").alias("_exit"), F.greatest(F.lit(0.0), F.when(reached, F.col("fav_exit")).otherwise(F.col("fav_0"))).alias("_mfe"),
        F.greatest(F.lit(0.0), -F.when(reached, F.col("adv_exit")).otherwise(F.col("adv_0"))).alias("_mae"),
    )
    bar = closed.select("symbol", F.col("open_time_ms").alias("_exit"), F.struct("open", "high", "low").alias("_bar"))
    out = live.join(found, "id").join(bar, ["symbol", "_exit"], "left")
    e, sign = F.col("entry_price"), F.when(F.col("side") == "LONG", 1.0).otherwise(-1.0)
    opening = sign * (F.col("_bar.open") / e - 1.0) * 100.0
    fav, adv = favorable_adverse("entry_price", "side", F.col("_bar.high"), F.col("_bar.low"))
    gap_stop, gap_target = opening <= -stop, opening >= target
    hit_t, hit_s = fav >= target - eps, -adv >= stop - eps
    won = gap_target | (~gap_stop & hit_t & ~hit_s)
    both = ~gap_stop & ~gap_target & hit_t & hit_s
    status = F.when(won, "TARGET").when(both, "AMBIGUOUS_LOSS").otherwise("STOP")
    paid = F.when(gap_stop, F.least(F.lit(-stop), opening)).when(won, F.lit(target)).otherwise(F.lit(-stop))
    out = out.withColumn("_o", F.when(F.col("_exit").isNotNull(), F.struct(status.alias("_status"), paid.alias("_gross"))))
    hours = (F.col("_exit") + F.lit(step) - F.col("entry_ms")) / F.lit(float(HOUR))
    gross = F.col("_o._gross")
    cols = [c for c in trades.columns]
    done = out.select(
        *cols, "entry_price",
        F.coalesce(F.col("_o._status"), F.lit("OPEN")).alias("status"),
        F.col("_exit").alias("resolved_bar_ms"), F.col("_mae").alias("mae_pct"), F.col("_mfe").alias("mfe_pct"),
        gross.alias("gross_return_pct"), F.when(F.col("_exit").isNotNull(), hours).alias("holding_hours"),
        (gross - holding_costs(hours, 0.12)).alias("net_return_pct"),
        (gross - holding_costs(hours, 0.50)).alias("stressed_net_return_pct"), *([F.col("_run_end").alias("run_end_ms")] if run_end else []),
    )
    waiting = pending.select(
        *cols, F.lit(None).cast("double").alias("entry_price"), F.lit("PENDING").alias("status"),
        F.lit(None).cast("bigint").alias("resolved_bar_ms"), F.lit(0.0).alias("mae_pct"), F.lit(0.0).alias("mfe_pct"),
        *[F.lit(None).cast("double").alias(c) for c in ("gross_return_pct", "holding_hours", "net_return_pct", "stressed_net_return_pct")],
        *([F.lit(None).cast("bigint").alias("run_end_ms")] if run_end else []),
    )
    return done.unionByName(waiting)
