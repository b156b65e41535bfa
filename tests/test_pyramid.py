"""Covering rows, extremes and first passages against plain Python over all bars."""

import random

import pytest
from pyspark.sql import functions as F

from barlytics.operators import labels, pyramid

STEP = 10
BARS = "symbol string, open_time_ms long, close_time_ms long, open double, high double, low double, close double"


def series(symbol, n, seed, gaps=0.1):
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        if rng.random() < gaps:
            continue
        o = price
        price *= 1 + rng.uniform(-0.01, 0.01)
        out.append((symbol, i * STEP, i * STEP + STEP - 1, o, max(o, price) * (1 + rng.random() / 200), min(o, price) * (1 - rng.random() / 200), price))
    return out


@pytest.fixture(scope="module")
def rows():
    return series("A", 700, 1) + series("B", 90, 2, 0.5)


def moves(side, entry, bar):
    up, down = (bar[4] / entry - 1.0) * 100.0, (bar[5] / entry - 1.0) * 100.0
    return ((1.0 - bar[5] / entry) * 100.0, (1.0 - bar[4] / entry) * 100.0) if side == "SHORT" else (up, down)


@pytest.mark.parametrize("levels", [1, 2, 3, 5])
def test_covering_rows_hold_each_bar_once_and_are_few(spark, levels):
    rng = random.Random(levels)
    spans = [(a, a + rng.choice([0, 1, 3, 80, 700, 5000, 40000])) for a in (rng.randrange(-3000, 30000) for _ in range(120))]
    df = spark.createDataFrame(spans, "s long, e long").select("*", pyramid.covering(F.col("s"), F.col("e"), STEP, levels).alias("rows"))
    for r in df.collect():
        times = []
        for x in r["rows"]:
            part = STEP * pyramid.FAN ** (x["level"] - 1)
            at = [x["block"] + k * part for k in range(pyramid.FAN)]
            for t in at if x["level"] > 1 else range(x["block"], x["block"] + STEP * pyramid.FAN):
                if x["from"] <= t < x["to"]:
                    times += [t] if x["level"] == 1 else range(t, t + part)
        assert sorted(times) == list(range(r["s"], r["e"]))
        full = -(-(r["e"] - r["s"]) // (STEP * pyramid.FAN**levels))
        assert len(r["rows"]) <= 2 * (levels - 1) + full + 1


def test_rows_grow_with_the_logarithm_of_the_span(spark):
    met = []
    for slots in (8, 64, 512, 4096, 32768, 262144):
        levels = pyramid.height(slots)
        span = spark.range(1).select(F.size(pyramid.covering(F.lit(12345), F.lit(12345 + slots * STEP), STEP, levels)).alias("n"))
        met.append(span.first()["n"])
    assert all(n <= 2 * k + 8 for k, n in enumerate(met, 1))


@pytest.mark.parametrize("window", ["open", "ceil", "close"])
@pytest.mark.parametrize("horizons", [[70, 30], [5000, 100, 900]])
def test_path_facts(spark, rows, window, horizons):
    bars = spark.createDataFrame(rows, BARS)
    rng = random.Random(3)
    asked = [(f"t{i}", rng.choice("AB"), rng.choice(["LONG", "SHORT"]), 100 * (1 + rng.uniform(-0.02, 0.02)), rng.randrange(-200, 7200)) for i in range(150)]
    anchors = spark.createDataFrame(asked, "trigger_id string, symbol string, bias string, entry_price double, asof_ms long")
    targets, stops = [0.5, 2.0, 6.0], [1.0, 4.0]
    got = {r["trigger_id"]: r for r in labels.path_facts(anchors, bars, "trigger_id", targets, stops, horizons, 500, window, STEP).collect()}
    expected = {}
    for name, symbol, side, entry, asof in asked:
        mine = [b for b in rows if b[0] == symbol]
        at = 2 if window == "close" else 1
        if window == "close":
            later = [b[2] for b in mine if b[2] >= asof]
            if not later or later[0] > asof + max(horizons):
                continue
            origin = later[0] - STEP
            path = [b for b in mine if b[2] >= asof and b[2] <= min(origin, asof) + max(horizons)]
            inside = lambda b, h: b[2] <= origin + h  # noqa: B023
        elif window == "ceil":
            origin = asof
            path = [b for b in mine if -(-asof // STEP) * STEP <= b[1] <= asof + max(horizons)]
            inside = lambda b, h: b[1] <= origin + h  # noqa: B023
        else:
            origin = asof
            path = [b for b in mine if asof <= b[1] < asof + max(horizons)]
            inside = lambda b, h: b[1] < origin + h  # noqa: B023
        if not path:
            continue
        move = [moves(side, entry, b) for b in path]
        want = {"origin_ms": origin}
        for h in horizons:
            near = [k for k, b in enumerate(path) if inside(b, h)]
            want |= {f"bars_{h}": len(near), f"fav_{h}": max((move[k][0] for k in near), default=None), f"adv_{h}": min((move[k][1] for k in near), default=None)}
            want[f"close_{h}"] = path[near[-1]][6] if near else None
        for t in targets:
            hit = next((k for k in range(len(path)) if move[k][0] >= t), None)
            want[f"t_target_{labels.tag(t)}"] = None if hit is None else path[hit][at]
            want[f"mae_to_target_{labels.tag(t)}"] = None if hit is None else min(0.0, *(m[1] for m in move[: hit + 1]))
        for s in stops:
            want[f"t_stop_{labels.tag(s)}"] = next((b[at] for b, m in zip(path, move) if m[1] <= -s), None)
        expected[name] = want
    assert got.keys() == expected.keys()
    for name, want in expected.items():
        assert {k: got[name][k] for k in want} == want


def test_exits(spark, rows):
    bars = spark.createDataFrame(rows, BARS)
    asked = [(f"x{i}", b[0], "LONG" if i % 2 else "SHORT", b[1]) for i, b in enumerate(rows[::7])] + [("none", "A", "LONG", 10**9)]
    trades = spark.createDataFrame(asked, "id string, symbol string, side string, entry_ms long")
    got = {r["id"]: r for r in labels.gap_aware_exit(trades, bars, STEP, F.lit(10**6), 2.0, 2.5).collect()}
    assert got.pop("none")["status"] == "PENDING"
    assert len({r["status"] for r in got.values()}) >= 3
    for name, symbol, side, start in asked[:-1]:
        run, t = {b[1]: b for b in rows if b[0] == symbol}, start
        entry, mae, mfe, status, at = run[start][3], 0.0, 0.0, "OPEN", None
        sign = 1 if side == "LONG" else -1
        while t in run and status == "OPEN":
            bar = run[t]
            fav, adv = moves(side, entry, bar)
            mae, mfe = max(mae, -adv), max(mfe, fav)
            opening = sign * (bar[3] / entry - 1.0) * 100.0
            if opening <= -2.5:
                status, at = "STOP", t
            elif opening >= 2.0:
                status, at = "TARGET", t
            elif fav >= 2.0 - 1e-9 or -adv >= 2.5 - 1e-9:
                status, at = ("AMBIGUOUS_LOSS" if fav >= 2.0 - 1e-9 and -adv >= 2.5 - 1e-9 else "TARGET" if fav >= 2.0 - 1e-9 else "STOP"), t
            t += STEP
        r = got[name]
        assert (r["status"], r["resolved_bar_ms"], r["mae_pct"], r["mfe_pct"]) == (status, at, mae, mfe)
