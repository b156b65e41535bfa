"""Summaries of labelled triggers, paper trades and reward ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barlytics.operators.blocks import depth, prefix


def rate_summary(outcomes: DataFrame, by=("horizon_ms",), hit: str = "target_reached") -> DataFrame:
    """Samples, hits and hit rate per group of one-row-per-trigger outcomes."""
    return outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col(hit)).alias("target_hits"),
        F.round(F.count_if(F.col(hit)) / F.count(F.lit(1)), 4).alias("target_hit_rate"),
    )


def cohort_report(outcomes: DataFrame, dims=("market_regime", "quality_bucket"), horizon: str = "horizon_ms", hit: str = "target_reached") -> DataFrame:
    """Rates overall, per dimension and per combination, for each horizon.

    One pass with grouping sets. ``cohort`` names the level, absent dimensions
    read ``*``.
    """
    a, b = dims
    sets = [[F.col(horizon)], [F.col(horizon), F.col(a)], [F.col(horizon), F.col(b)], [F.col(horizon), F.col(a), F.col(b)]]
    g = outcomes.groupingSets(sets, F.col(horizon), F.col(a), F.col(b)).agg(
        F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"),
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col(hit)).alias("target_hits"),
    )
    all_a, all_b = F.col("_ga") == 1, F.col("_gb") == 1
    level = F.when(all_a & all_b, "overall").when(all_b, f"by_{a}").when(all_a, f"by_{b}").otherwise(f"by_{a}_{b}")
    return g.select(
        horizon, level.alias("cohort"),
        F.when(all_a, "*").otherwise(F.col(a)).alias(a), F.when(all_b, "*").otherwise(F.col(b)).alias(b),
        "samples", "target_hits", F.round(F.col("target_hits") / F.col("samples"), 4).alias("target_hit_rate"),
    )


def stop_summary(outcomes: DataFrame, by=("stop_pct",), ret: str = "sim_return_pct") -> DataFrame:
    """Counts of the four path results with mean and median return per stop."""
    by = list(by)
    is_ = lambda name: F.count_if(F.col("result") == name)
    sums = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        is_("TARGET_FIRST").alias("target_first"), is_("STOP_FIRST").alias("stop_first"),
        is_("AMBIGUOUS").alias("ambiguous"), is_("OPEN").alias("open_at_end"),
        F.round(is_("TARGET_FIRST") / F.count(F.lit(1)), 4).alias("target_first_rate"),
        F.round(F.avg(ret), 4).alias("average_simulated_return_pct"),
    )
    middle = exact_quantiles(outcomes, ret, [0.5], by).select(*by, F.round("p50", 4).alias("median_simulated_return_pct"))
    return sums.join(middle, by)


def exact_quantiles(df: DataFrame, column: str, points: list[float], by=()) -> DataFrame:
    """Exact quantiles with linear interpolation per group, one column each.

    Rows shrink to counts per distinct value; ranks come from a prefix sum over
    bins of equal depth, so no task holds all values of a group.
    """
    by = list(by)
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = prefix(depth(counts, by, "_v"), by, "_v", F.col("_depth"), {"_below": ("_n", "sum")}, few=True)
    if by:
        sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
        ranked = ranked.join(sizes, by)
    else:
        ranked = ranked.withColumn("_all", counts.agg(F.sum("_n")).scalar())

    def at(rank):
        return F.max(F.when((F.col("_below") <= rank) & (rank < F.col("_below") + F.col("_n")), F.col("_v")))

    ends, shown = [], []
    for i, q in enumerate(points):
        place = (F.col("_all") - 1) * F.lit(q)
        ends += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}")]
        share = (F.col("samples") - 1) * F.lit(q)
        share = share - F.floor(share)
        shown.append((F.col(f"_lo{i}") * (1 - share) + F.col(f"_hi{i}") * share).alias(f"p{int(round(q * 100))}"))
    return ranked.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("samples"), *ends).select(*by, "samples", *shown)


def best_stop(summary: DataFrame, value: str = "average_simulated_return_pct", stop: str = "stop_pct") -> DataFrame:
    """The stop with the highest mean return; the tightest one wins ties."""
    return summary.agg(F.max_by(stop, F.struct(F.coalesce(F.col(value), F.lit(-999.0)), -F.col(stop))).alias("best_stop_pct"))


def gate_groups(outcomes: DataFrame, dims=("market_regime", "quality_bucket"), min_samples: int = 20, min_rate: float = 0.60, hit: str = "target_reached") -> DataFrame:
    """Samples, wins and rate per combination and whether it is approved."""
    rate = F.col("target_hits") / F.col("samples")
    return (
        outcomes.groupBy(*dims).agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col(hit)).alias("target_hits"))
        .withColumn("target_hit_rate", F.round(rate, 4))
        .withColumn("allowed", (F.col("samples") >= min_samples) & (rate >= min_rate))
    )


def gate_status(groups: DataFrame, min_total: int = 100) -> DataFrame:
    """One row: totals and whether the gate may be enabled."""
    return groups.agg(
        F.coalesce(F.sum("samples"), F.lit(0)).alias("total"),
        F.count_if("allowed").alias("allowed_groups"),
    ).withColumn("enabled", (F.col("total") >= min_total) & (F.col("allowed_groups") > 0))


def marginal_gate(outcomes: DataFrame, dims=("market_regime", "quality_bucket"), min_samples: int = 20, min_rate: float = 0.55, hit: str = "target_reached") -> DataFrame:
    """Approved values of each dimension on its own."""
    a, b = dims
    g = outcomes.groupingSets([[F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(
        F.grouping(a).alias("_ga"), F.count(F.lit(1)).alias("samples"), F.avg(F.col(hit).cast("double")).alias("_rate")
    )
    return g.filter((F.col("samples") >= min_samples) & (F.col("_rate") >= min_rate)).select(
        F.when(F.col("_ga") == 1, b).otherwise(a).alias("dimension"),
        F.when(F.col("_ga") == 1, F.col(b)).otherwise(F.col(a)).alias("value"), "samples",
    )


def marginal_status(outcomes: DataFrame, gate: DataFrame, dims=("market_regime", "quality_bucket"), min_total: int = 100) -> DataFrame:
    """One row: all samples, approved values by dimension, and whether the gate is ready for review.

    It is ready with enough samples and an approved value in each dimension;
    it is never switched on here.
    """
    approved = gate.agg(*[F.count_if(F.col("dimension") == d).alias(f"allowed_{d}") for d in dims])
    ready = F.col("total") >= min_total
    for d in dims:
        ready = ready & (F.col(f"allowed_{d}") > 0)
    total = outcomes.agg(F.count(F.lit(1))).scalar()
    return approved.withColumn("total", total).withColumn("ready_for_review", ready).withColumn("enabled", F.lit(False))


def dataset_meta(times: DataFrame, context: DataFrame, rows: DataFrame, positive: str, ambiguous: str) -> DataFrame:
    """Counts and rates of a learning table; empty sample times count too."""
    per_time = rows.groupBy("asof_ms").agg(
        F.count(F.lit(1)).alias("n"), F.sum(positive).alias("pos"), F.sum(ambiguous).alias("amb")
    )
    # A sample time without any liquid symbol has no context and reads MIXED.
    j = times.join(per_time, "asof_ms", "left").join(context.select("asof_ms", "market_regime"), "asof_ms", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    regime = F.coalesce(F.col("market_regime"), F.lit("MIXED"))
    return j.agg(
        zero("n").alias("row_count"), F.count(F.lit(1)).alias("timestamp_count"),
        zero("pos").alias("positive_count"), zero("amb").alias("ambiguous_count"),
        (zero("pos") / F.greatest(F.lit(1), zero("n"))).alias("positive_rate"),
        (zero("n") / F.count(F.lit(1))).alias("mean_candidates_per_timestamp"),
        *[F.count_if(regime == r).alias(f"regime_{r.lower()}") for r in ("RISK_ON", "MIXED", "RISK_OFF")],
    )


def admission_counts(log: DataFrame, key: str = "id", time: str = "observed_ms", reason: str = "reason") -> DataFrame:
    latest = log.groupBy(key).agg(F.max_by(reason, time).alias(reason))
    return latest.groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


def recent_admissions(log: DataFrame, n: int = 20, key: str = "id", time: str = "observed_ms") -> DataFrame:
    values = [c for c in log.columns if c != key]
    latest = log.groupBy(key).agg(F.max_by(F.struct(*values), time).alias("v")).select(key, "v.*")
    return latest.orderBy(F.desc(time), key).limit(n)


def side_panels(trades: DataFrame, by: str = "side", select_at: float = 0.6) -> DataFrame:
    """Entries, results, net means and prequential error per side."""
    closed = ~F.col("status").isin("PENDING", "OPEN")
    won = F.col("status") == "TARGET"
    scored, chosen = closed & F.col("score").isNotNull(), F.col("score") >= select_at
    error = F.pow(F.col("score") - won.cast("double"), 2)
    return trades.groupBy(by).agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(closed).alias("resolved"), F.count_if(~closed).alias("open_or_pending"),
        F.count_if(closed & won).alias("wins"), F.count_if(scored).alias("scored_resolved"),
        F.avg(F.when(scored, error)).alias("prequential_brier"),
        F.avg(F.when(scored, F.lit(0.25))).alias("fixed_half_brier_baseline"),
        F.avg(F.when(closed, F.col("net_return_pct"))).alias("mean_net_pct"),
        F.count_if(chosen).alias("selected_entries"), F.count_if(closed & chosen).alias("selected_resolved"),
        F.avg(F.when(closed & chosen, F.col("stressed_net_return_pct"))).alias("selected_mean_stressed_pct"),
        F.count_if(F.col("data_error").isNotNull()).alias("data_errors"),
    )


def brier(df: DataFrame, p: str, y: str, by=()) -> DataFrame:
    """Mean squared error of a probability, beside that of a fixed half."""
    err = lambda x: F.avg(F.pow(x - F.col(y).cast("double"), 2))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), err(F.col(p)).alias("brier"), err(F.lit(0.5)).alias("fixed_half_brier"))


def reward_report(sent: DataFrame, rewards: DataFrame, cutoff_ms, warmup: int = 30) -> DataFrame:
    """One row over a reward ledger made by ``reward_join``.

    ``rewards`` also carries ``forecast_n, forecast_r``, the forecast frozen at
    delivery.
    """
    scored, won = F.col("reward_r").isNotNull(), F.col("status") == "TARGET"
    valid = scored & (F.coalesce(F.col("forecast_n"), F.lit(0)) >= warmup)
    body = rewards.agg(
        F.count_if(scored).alias("scored_outcomes"), F.count_if(F.col("excluded").isNotNull()).alias("excluded"),
        F.count(F.lit(1)).alias("_recorded"),
        F.count_if(scored & won).alias("wins"), F.count_if(scored & ~won).alias("losses"),
        F.coalesce(F.sum("reward_r"), F.lit(0.0)).alias("total_reward_r"), F.avg("reward_r").alias("mean_reward_r"),
        F.coalesce(F.sum("stressed_reward_r"), F.lit(0.0)).alias("total_stressed_reward_r"),
        F.count_if(valid).alias("evaluated_forecasts_after_warmup"),
        F.avg(F.when(valid, F.pow(F.col("forecast_r") - F.col("reward_r"), 2))).alias("forward_squared_error"),
        F.avg(F.when(valid, F.pow(F.col("reward_r"), 2))).alias("zero_reward_baseline_squared_error"),
    )
    calls = sent.filter(F.col("sent_ms") >= cutoff_ms).agg(F.count(F.lit(1))).scalar()
    return body.withColumn("sent_calls", calls).withColumn("pending", F.col("sent_calls") - F.col("_recorded")).drop("_recorded")


def pending_outcomes(triggers: DataFrame, done: DataFrame, horizons_ms, now: Column, anchor_id: str = "trigger_id") -> DataFrame:
    """Old enough but unevaluated triggers per horizon (0 where there are none)."""
    hs = F.array(*[F.lit(h).cast("bigint") for h in horizons_ms])
    marked = triggers.select(anchor_id, "asof_ms", F.explode(hs).alias("horizon_ms")).join(
        done.select(anchor_id, "horizon_ms").withColumn("_done", F.lit(True)), [anchor_id, "horizon_ms"], "left"
    )
    due = (now - F.col("asof_ms") >= F.col("horizon_ms")) & F.col("_done").isNull()
    return marked.groupBy("horizon_ms").agg(F.count_if(due).alias("pending"))


def latest_in_log(log: DataFrame, time: Column | str, keys=()) -> DataFrame:
    """The last record of each log, with all its columns."""
    values = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), time).alias("v")).select(*keys, "v.*")


def symbol_completeness(bars: DataFrame, minimum: dict[str, int], min_symbols: int = 5, interval: str = "interval") -> DataFrame:
    """Whether each symbol has enough bars on every frame, and why not.

    ``bars`` holds all frames with their name in ``interval``. ``enough`` says
    whether enough symbols are usable for a broad-market run.
    """
    names = list(minimum)
    wide = bars.groupBy("symbol").agg(*[F.count_if(F.col(interval) == n).alias(f"rows_{n}") for n in names])
    missing, short = F.lit(False), F.lit(False)
    for n in names:
        missing = missing | (F.col(f"rows_{n}") == 0)
        short = short | (F.col(f"rows_{n}") < minimum[n])
    marked = wide.withColumn(
        "skip_reason", F.when(missing, "missing interval file").when(short, "insufficient history")
    ).withColumn("usable", F.col("skip_reason").isNull())
    enough = marked.agg(F.count_if("usable") >= min_symbols).scalar()
    return marked.withColumn("enough", enough)


