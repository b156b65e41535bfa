"""Literal cases of the rules, exits, models and state machines."""

import pytest
from pyspark.sql import functions as F

from barlytics.functions import rules, scalar as sc
from barlytics.operators import cohorts, joins, labels, online
from barlytics.operators.quality import lookahead_check
from barlytics.plans import account
from barlytics.streaming import machines as mc, streams

BAR = 300_000


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


# --- drift and exhaustion --------------------------------------------------


def test_drift(spark):
    inv = lambda e, p, b: sc.directional_return(F.lit(e), F.lit(p), F.lit(b), "inverse")
    r = one(spark, long=inv(100.0, 101.0, "LONG"), short=inv(100.0, 99.0, "SHORT"))
    assert r.long == pytest.approx(1.0) and r.short == pytest.approx(1.010101, abs=1e-6)
    values = [-0.2, 0.2, 0.7, 1.4, 2.4, 3.4, 5.0]
    row = one(spark, **{f"v{i}": sc.drift_bucket(F.lit(v)) for i, v in enumerate(values)})
    assert list(row) == ["against_trigger", "0_to_0.5", "0.5_to_1", "1_to_2", "2_to_3", "3_to_5", "5_plus"]
    for price, blocked in ((105.1, True), (93.9, True), (102.5, False)):
        assert one(spark, b=sc.late_against(inv(100.0, price, "LONG"), F.lit(5.0), F.lit(6.0))["blocked"]).b is blocked


@pytest.mark.parametrize(
    "case,blocked",
    [
        (("LONG", 68, 100, 28, 11.5, 20, -3.7, -2.2), True),
        (("LONG", 57, 63, 5.5, 2.8, 5, 2.0, 3.1), False),
        (("SHORT", 27, 4, -24, -12, -20, 2.5, 3.0), True),
        (("LONG", 66, 95, 4, 2, 3, None, None), False),
        (("NONE", 50, 50, 0, 0, 0, None, None), True),
    ],
)
def test_late_entry(spark, case, blocked):
    bias, *nums = case
    lits = [F.lit(None).cast("double") if v is None else F.lit(float(v)) for v in nums]
    r = one(spark, **rules.late_entry_risk(F.lit(bias), *lits))
    assert r.blocked is blocked
    assert (r.risk_points == 99) == (bias == "NONE")
    if bias != "NONE" and blocked:
        assert r.risk_points >= 4 and len(r.reasons) >= 4


def test_feature_vector(spark):
    vec = lambda *v: sc.feature_vector([F.lit(x).cast("double") for x in v], mc.PAPER_SCALES)
    assert one(spark, x=vec(5, 10, 15, 2.5, 30, 50)).x == [1.0, 0.5, 0.5, 0.5, 0.5, 3.0, 0.5]
    assert one(spark, x=vec(5, 10, 15, 2.5, None, 50)).x is None
    assert one(spark, x=vec(5, 10, 15, 2.5, float("inf"), 50)).x is None


# --- exits -----------------------------------------------------------------


def paper_bars(*ohl, start=BAR, step=BAR):
    return [("X", start + i * step, float(o), float(h), float(l), float(o)) for i, (o, h, l) in enumerate(ohl)]


EXITS = [
    ("target", "LONG", [(100, 110, 99)], 10 * BAR, "TARGET", 5 - 0.13),
    ("both", "LONG", [(100, 106, 93)], 10 * BAR, "AMBIGUOUS_LOSS", -6.13),
    ("gap stop", "LONG", [(100, 101, 99), (90, 91, 89)], 10 * BAR, "STOP", -10.13),
    ("gap target", "LONG", [(100, 101, 99), (108, 109, 90)], 10 * BAR, "TARGET", 4.87),
    ("forming", "LONG", [(100, 110, 99)], 2 * BAR - 1, "PENDING", None),
    ("short", "SHORT", [(100, 101, 94)], 10 * BAR, "TARGET", 4.87),
    ("open", "LONG", [(100, 101, 99)], 10 * BAR, "OPEN", None),
]


@pytest.mark.parametrize("name,side,ohl,now,status,net", EXITS)
def test_exit_cases(spark, name, side, ohl, now, status, net):
    bars = spark.createDataFrame(paper_bars(*ohl), "symbol string, open_time_ms long, open double, high double, low double, close double")
    trades = spark.createDataFrame([("t", "X", side, BAR)], "id string, symbol string, side string, entry_ms long")
    r = labels.gap_aware_exit(trades, bars, BAR, F.lit(now)).first()
    assert r.status == status
    assert r.net_return_pct == (None if net is None else pytest.approx(net))


def test_exit_starts_one_bar_late(spark):
    bars = spark.createDataFrame(paper_bars((100, 110, 99), start=2 * BAR), "symbol string, open_time_ms long, open double, high double, low double, close double")
    trades = spark.createDataFrame([("t", "X", "LONG", BAR)], "id string, symbol string, side string, entry_ms long")
    assert labels.gap_aware_exit(trades, bars, BAR, F.lit(9 * BAR)).first().status == "PENDING"


def test_exit_after_a_long_time(spark):
    """Long holding times resolve like short ones; gaps stop a trade."""
    ohl = [(100, 100.5, 99.5)] * 700 + [(100, 106, 99.5)]
    rows = paper_bars(*ohl) + [("Y", t, o, h, l, c) for _, t, o, h, l, c in paper_bars(*ohl) if t != 300 * BAR]
    bars = spark.createDataFrame(rows, "symbol string, open_time_ms long, open double, high double, low double, close double")
    trades = spark.createDataFrame([("x", "X", "LONG", BAR), ("y", "Y", "LONG", BAR)], "id string, symbol string, side string, entry_ms long")
    got = {r.id: (r.status, r.resolved_bar_ms) for r in labels.gap_aware_exit(trades, bars, BAR, F.lit(10**12)).collect()}
    assert got == {"x": ("TARGET", 701 * BAR), "y": ("OPEN", None)}


# --- rewards and models ----------------------------------------------------


def test_rewards(spark):
    cols = "id string, symbol string, side string, status string, resolved_bar_ms long, label_available_ms long, stop_pct double, net_return_pct double, stressed_net_return_pct double"
    trades = spark.createDataFrame(
        [
            ("a", "X", "LONG", "STOP", 200, 300, 6.0, -6.13, -6.5), ("b", "X", "LONG", "TARGET", 200, 300, 6.0, 4.87, 4.5),
            ("early", "X", "LONG", "STOP", 50, 300, 6.0, -6.13, -6.5), ("open", "X", "LONG", "OPEN", None, None, 6.0, None, None),
            ("old", "X", "LONG", "STOP", 200, 300, 6.0, -6.13, -6.5),
        ],
        cols,
    )
    sent = spark.createDataFrame([("a", 100), ("b", 100), ("early", 100), ("open", 100), ("old", 10)], "id string, sent_ms long")
    rewards = joins.reward_join(sent, trades, 50, 1000)
    got = {r.id: (r.excluded, r.reward_r) for r in rewards.collect()}
    assert set(got) == {"a", "b", "early"}
    assert got["a"][1] == pytest.approx(-6.13 / 6) and got["b"][1] == pytest.approx(4.87 / 6)
    assert got["early"] == ("EXIT_CANDLE_PRECEDES_DELIVERY", None)
    report = cohorts.reward_report(sent, rewards.withColumn("forecast_n", F.lit(0)).withColumn("forecast_r", F.lit(0.0)), 50).first()
    assert (report.sent_calls, report.scored_outcomes, report.pending, report.excluded, report.wins, report.losses) == (4, 2, 1, 1, 1, 1)
    assert report.total_reward_r == pytest.approx((-6.13 + 4.87) / 6)


def test_models_are_isolated_and_warm_up(spark):
    rows = [(side, i, [1.0] + [0.1 * (i % 5)] * 6, float(side == "LONG")) for side in ("LONG", "SHORT") for i in range(40)]
    df = spark.createDataFrame(rows, "side string, id long, x array<double>, y double").withColumn("known", F.col("id") + 1)
    out = {(r.side, r.id): r for r in online.online_logistic(df, ["side"], ["id"], "known").collect()}
    assert out[("LONG", 29)].score is None and out[("LONG", 30)].score > 0.5 > out[("SHORT", 30)].score
    assert out[("LONG", 39)].model_n == 39
    np_state = online.new_model()()
    for side, i, x, y in rows[:39]:
        online.learn_label(np_state, x, y)
    assert out[("LONG", 39)].weights == pytest.approx(np_state["w"].tolist())


def test_a_label_counts_from_the_time_it_is_known(spark):
    """Reward of a call sent at 0 that resolves at 25 must not act on calls before 25."""
    x = [1.0] + [0.0] * 6
    rows = [("a", 0, 25, x, 3.0), ("b", 10, 12, x, -1.0), ("c", 20, None, x, 9.0), ("d", 25, 90, x, 9.0), ("e", 30, 91, x, None)]
    df = spark.createDataFrame(rows, "id string, t long, known long, x array<double>, reward_r double").withColumn("side", F.lit("LONG"))
    got = {r.id: r for r in online.online_reward_regression(df, ["side"], ["t"], "known").collect()}
    assert [got[i].forecast_n for i in "abcde"] == [0, 0, 1, 2, 2]
    state = online.new_model()()
    online.learn_reward(state, x, -1.0)
    assert got["c"].forecast == pytest.approx(online.forecast(state["w"], x))
    online.learn_reward(state, x, 3.0)
    assert got["d"].forecast == got["e"].forecast == pytest.approx(online.forecast(state["w"], x))


def test_reward_learner_bounds_the_update_not_the_loss():
    st = online.new_model()()
    online.learn_reward(st, [1.0] + [0.0] * 6, -50.0)
    assert st["w"][0] == pytest.approx(0.15 * -3.0) and st["n"] == 1


# --- arm, confirm, manage --------------------------------------------------

CAND = (
    "pair string, scan_ms long, bias string, score double, current_price double, oi_change_15m_pct double, oi_change_1h_pct double, oi_change_4h_pct double, "
    "oi_change_24h_pct double, spot_buy_sell_ratio_1h double, spot_net_flow_1h_usd double, spot_volume_1h_usd double, price_change_1h_spot_pct double, "
    "price_change_4h_spot_pct double, price_change_24h_futures_pct double, warnings array<string>, blockers array<string>"
)


def scan(t, price, score, oi24=2.0, p24=3.0, volume=500_000.0, warnings=(), flow=50_000.0, ratio=1.2, oi15=0.5, bias="LONG"):
    return ("P", t, bias, float(score), price, oi15, 0.4, 1.0, oi24, ratio, flow, volume, 0.6, 1.2, p24, list(warnings), [])


def arm_events(spark, *rows):
    df = mc.arm_input(spark.createDataFrame(list(rows), CAND))
    return [(r.event, r.timestamp_ms) for r in mc.batch(mc.arm_confirm_manage(), df, ["pair"], ["scan_ms"], mc.ARM_EVENTS).orderBy("timestamp_ms").collect()]


def test_arm_dip_confirm(spark):
    got = arm_events(spark, scan(1_000_000, 0.37144, 82), scan(1_300_000, 0.36982, 76), scan(1_600_000, 0.37765, 82))
    assert got == [("SHADOW_ARMED", 1_000_000), ("SHADOW_CONFIRMED", 1_600_000)]


def test_deep_countertrend_is_not_armed(spark):
    assert arm_events(spark, scan(1, 1.0, 90, oi24=-22.58, p24=-21.8)) == []


def test_thin_spot_waits(spark):
    row = scan(1, 1.0, 90, volume=72_352.0, warnings=["Low open interest"])
    assert arm_events(spark, row) == []
    why = mc.arm_input(spark.createDataFrame([row], CAND)).first().why
    assert "spot turnover 72,352, at least 100,000 asked" in why


def test_arm_expiry_and_false_start(spark):
    assert arm_events(spark, scan(0, 1.0, 82), scan(31 * 60_000, 1.01, 82))[1][0] == "SHADOW_ARM_EXPIRED"
    assert arm_events(spark, scan(0, 1.0, 82), scan(60_000, 1.01, 82, flow=-1.0))[1][0] == "SHADOW_FALSE_START"


def test_repeated_scan_is_no_new_evidence(spark):
    same = lambda t: scan(t, 1.0, 82)
    got = arm_events(spark, same(0), same(60_000), same(120_000))
    assert got == [("SHADOW_ARMED", 0)]


def confirm_events(spark, *rows):
    df = mc.confirm_input(spark.createDataFrame(list(rows), CAND))
    out = mc.batch(mc.confirm_and_monitor(), df, ["pair"], ["scan_ms"], mc.CONFIRM_EVENTS).orderBy("timestamp_ms").collect()
    return [(r.event, r.detail) for r in out]


def test_confirmation_needs_two_scans_or_a_high_score(spark):
    assert confirm_events(spark, scan(0, 1.0, 80)) == []
    assert confirm_events(spark, scan(0, 1.0, 80), scan(300_000, 1.0, 80)) == [("SIGNAL_CONFIRMED", "two_scan")]
    assert confirm_events(spark, scan(0, 1.0, 91)) == [("SIGNAL_CONFIRMED", "immediate_90_plus")]


def test_expiry_only_by_age(spark):
    late = 6 * 3_600_000
    assert confirm_events(spark, scan(0, 1.0, 91), scan(late, 1.0, 91))[1][0] == "SIGNAL_EXPIRED"
    ended = confirm_events(spark, scan(0, 1.0, 91), scan(late, 1.0, 60))[1]
    assert ended[0] == "SIGNAL_DETERIORATED" and "score down to 60.0 after 91.0" in ended[1]


def test_cooldown_resets_the_streak(spark):
    rows = [scan(0, 1.0, 91), scan(60_000, 1.0, 60), scan(120_000, 1.0, 95), scan(46 * 60_000 + 60_000, 1.0, 80)]
    assert [e for e, _ in confirm_events(spark, *rows)] == ["SIGNAL_CONFIRMED", "SIGNAL_DETERIORATED"]


# --- paper account ---------------------------------------------------------

SIGNAL = "id string, symbol string, bias string, timestamp_ms long, observed_ms long, momentum_3h_pct double, momentum_12h_pct double, momentum_24h_pct double, distance_from_1h_sma10_pct double, volume_expansion_1h double, swing_score double"
PRICE = "symbol string, open_time_ms long, open double, high double, low double, close double"


def signal(i, t, symbol="X", bias="LONG", seen=None, m=1.0):
    return (i, symbol, bias, t, t if seen is None else seen, m, 1.0, 1.0, 1.0, 1.0, 50.0)


def paper(spark, signals, bars, start=0):
    registry = spark.createDataFrame([("X", "CRYPTO"), ("S", "STOCK")], "symbol string, classification string")
    rows = account.judged(spark.createDataFrame(signals, SIGNAL), registry, F.lit(start))
    return account.account(rows, spark.createDataFrame(bars, PRICE), BAR).orderBy("timestamp_ms", "id").collect()


def test_admission_reasons(spark):
    signals = [
        signal("old", 10), signal("future", 5_000_000, seen=4_000_000), signal("stale", 1_000_000, seen=1_700_000),
        signal("stock", 2_000_000, "S"), signal("side", 2_100_000, bias="NEUTRAL"), signal("bad", 2_200_000, m=float("nan")),
        signal("ok", 2_300_000), signal("ok", 2_300_000, seen=2_400_000), signal("second", 2_500_000),
    ]
    got = {(e.id, e.reason) for e in paper(spark, signals, [("X", 0, 1.0, 1.0, 1.0, 1.0)], start=100) if e.kind == "ADMISSION"}
    assert got == {
        ("old", "PRE_ACTIVATION"), ("future", "FUTURE_TIMESTAMP"), ("stale", "STALE_AT_OBSERVATION"),
        ("stock", "IDENTITY_NOT_VERIFIED_CRYPTO"), ("side", "INVALID_SIDE"), ("bad", "INVALID_FEATURES"),
        ("ok", "ACCEPTED"), ("second", "POSITION_ALREADY_OPEN"),
    }


def test_account_cooldown_and_outcome(spark):
    day = 86_400_000
    bars = paper_bars((100, 110, 99), start=BAR) + paper_bars((100, 101, 99), start=2 * day)
    ev = paper(spark, [signal("a", 1), signal("b", 3 * BAR), signal("c", day + BAR)], bars)
    assert [(e.id, e.reason) for e in ev if e.kind == "ADMISSION"] == [("a", "ACCEPTED"), ("b", "SYMBOL_COOLDOWN"), ("c", "ACCEPTED")]
    assert [(e.id, e.status, round(e.net_return_pct, 2)) for e in ev if e.kind == "OUTCOME"] == [("a", "TARGET", 4.87)]
    assert [(e.id, e.data_error) for e in ev if e.kind == "STALLED"] == [("c", "MISSING_BAR")]


def test_an_accepted_id_stays_silent_for_good(spark):
    day = 86_400_000
    bars = paper_bars((100, 110, 99), start=BAR) + paper_bars((100, 110, 99), start=day + 2 * BAR)
    signals = [signal("a", 1), signal("x", 2), signal("b", day + BAR + 1), signal("a", 1, seen=day + 5 * BAR), signal("x", 2, seen=day + 5 * BAR), signal("x", 2, seen=day + 6 * BAR)]
    ev = paper(spark, signals, bars)
    assert [(e.id, e.reason) for e in ev if e.kind == "ADMISSION"] == [
        ("a", "ACCEPTED"), ("x", "POSITION_ALREADY_OPEN"), ("b", "ACCEPTED"), ("x", "STALE_AT_OBSERVATION"),
    ]


@pytest.mark.parametrize("name,side,ohl,now,status,net", [c for c in EXITS if c[5] is not None])
def test_account_exits_match_the_batch_rule(spark, name, side, ohl, now, status, net):
    ev = [e for e in paper(spark, [signal("a", 1, bias=side)], paper_bars(*ohl)) if e.kind == "OUTCOME"]
    assert [(e.status, e.net_return_pct) for e in ev] == [(status, pytest.approx(net))]


# --- streams, labels, look-ahead -------------------------------------------


def test_stream_equals_batch_over_many_triggers(spark):
    rows = []
    for t in range(60):
        score = 70 + (t * 7) % 25
        rows.append(scan(t * 300_000, 1.0 + (t % 11) * 0.01, score, flow=50_000.0 if t % 4 else -50_000.0))
    for mk, step, schema in (
        (mc.confirm_input, mc.confirm_and_monitor(), mc.CONFIRM_EVENTS), (mc.arm_input, mc.arm_confirm_manage(), mc.ARM_EVENTS),
    ):
        df = mk(spark.createDataFrame(rows, CAND))
        want = sorted(map(str, mc.batch(step, df, ["pair"], ["scan_ms"], schema).collect()))
        got = streams.arrive(df, "test", "scan_ms", lambda s: streams.stateful(s, ["pair"], ["scan_ms"], step, schema), parts=4)
        got = sorted(map(str, got.collect()))
        assert got == want and want


def test_late_rows_are_shown_and_armed_setups_end_without_a_further_scan(spark):
    """Deliveries out of order; the watermark of other pairs ends a setup that hears no more."""
    other = lambda t, score: ("Q", *scan(t, 1.0, score)[1:])
    hour, day = 3_600_000, 86_400_000
    deliveries = [[scan(day, 1.0, 82), other(day, 60)], [other(day + 2 * hour, 60)], [other(day + hour, 60), other(day + 5 * hour, 60)], [other(day + 9 * hour, 60)]]
    out = streams.table_dir(spark, "late")
    for i, rows in enumerate(deliveries):
        df = mc.arm_input(spark.createDataFrame(rows, CAND))
        df.write.parquet(f"{out}/landing/part={i}")
        source = spark.readStream.schema(df.schema).parquet(f"{out}/landing/part=*")
        events = streams.stateful(source, ["pair"], ["scan_ms"], mc.arm_confirm_manage(), mc.ARM_EVENTS, mc.arm_timers(), "3 hours")
        writer = events.writeStream.format("parquet").option("path", f"{out}/data").outputMode("append")
        streams._run_available(writer.option("checkpointLocation", f"{out}/offsets"), spark)
    got = sorted((r.event, r.pair, r.timestamp_ms) for r in spark.read.parquet(f"{out}/data").collect())
    assert got == [("LATE_INPUT", "Q", day + hour), ("SHADOW_ARMED", "P", day), ("SHADOW_ARM_EXPIRED", "P", day + 30 * 60_000 + 1)]


def test_longer_horizons_hit_at_least_as_often(spark):
    from conftest import SF

    from barlytics.catalog.paths import outcomes

    rates = {r.horizon_ms: r.target_hits for r in cohorts.rate_summary(outcomes(spark, SF)).collect()}
    hits = [rates[h] for h in sorted(rates)]
    assert hits == sorted(hits)


def test_lookahead_check_finds_a_leak(spark):
    from conftest import SF

    from barlytics.catalog.base import COARSE, FINE, frames
    from barlytics.catalog.checks import features_at

    fine, coarse = frames(spark, SF, FINE, COARSE)
    middle = fine.filter("symbol = 'S1'").agg(F.percentile_approx("close_time_ms", 0.5)).first()[0]
    points = spark.createDataFrame([("S1", middle + 1_000)], "symbol string, asof_ms long")

    def leaky(f, c, p):
        late = p.select("symbol", (F.col("asof_ms") + FINE).alias("asof_ms"))
        return features_at(f, c, late).withColumn("asof_ms", F.col("asof_ms") - FINE)

    def far(f, c, p):
        # reads one price 200 bars ahead
        ahead = f.select("symbol", (F.col("close_time_ms") - 200 * FINE).alias("_t"), F.col("close").alias("_far"))
        near = p.join(ahead, "symbol").filter(F.col("_t").between(F.col("asof_ms") - FINE, F.col("asof_ms"))).groupBy("symbol", "asof_ms").agg(F.max("_far").alias("_far"))
        return features_at(f, c, p).join(near, ["symbol", "asof_ms"], "left").withColumn("price", F.coalesce("_far", "price")).drop("_far")

    check = lambda fn: {r.code for r in lookahead_check(fine, coarse, points, FINE, COARSE, fn, ["price"], ["bias"]).collect()}
    assert check(features_at) == set()
    assert check(far) == {"LOOKAHEAD_LEAK_DETECTED"}
    assert "LOOKAHEAD_LEAK_DETECTED" in check(leaky) and "1H_FUTURE_CANDLE_USED" in check(leaky)
