"""Blocked windows, scans and joins give the same rows as the plain ones."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlytics.operators import evaluate as ev, gaps, grid, indicators as ind, joins, online
from barlytics.operators.blocks import SHORT, Frame, Roll, depth, fold_linear, prefix, roll, with_position
from barlytics.operators.cohorts import exact_quantiles

STEP = 10


@pytest.fixture(scope="module")
def series(spark):
    """One hot symbol with gaps, two short ones."""
    rng = random.Random(5)
    rows = []
    for symbol, n in (("HOT", 900), ("A", 40), ("B", 3)):
        t = 0
        for _ in range(n):
            t += STEP * rng.choice([1, 1, 1, 2, 7, 90])
            rows.append((symbol, t, rng.uniform(90, 110), rng.uniform(1, 5)))
    pdf = pd.DataFrame(rows, columns=["symbol", "open_time_ms", "close", "quote_volume"])
    return pdf, spark.createDataFrame(pdf).repartition(7).cache()


def as_frame(df, *cols):
    return df.select("symbol", "open_time_ms", *cols).toPandas().sort_values(["symbol", "open_time_ms"]).reset_index(drop=True)


def test_positions(series):
    pdf, df = series
    got = as_frame(with_position(df, ["symbol"], "open_time_ms", grid.floor_bucket("open_time_ms", 170)), "pos")
    want = pdf.sort_values(["symbol", "open_time_ms"])
    assert got["pos"].tolist() == want.groupby("symbol").cumcount().tolist()


@pytest.mark.parametrize("block", [24, 31, 64, 100_000])
def test_roll_blocks(series, block):
    pdf, df = series
    stages = [{"m": ind.sma("close", 10), "lag": ind.lagged("close", 3)}, {"m2": ind.sma("m", 5), "v": ind.volume_expansion("quote_volume")}]
    got = as_frame(roll(df, stages, STEP, block_rows=block), "m", "lag", "v")
    want = pdf.sort_values(["symbol", "open_time_ms"]).reset_index(drop=True)
    g = want.groupby("symbol")
    np.testing.assert_allclose(got["m"], g["close"].transform(lambda s: s.rolling(10).mean()), rtol=1e-12)
    np.testing.assert_allclose(got["lag"], g["close"].shift(3))
    v = g["quote_volume"].transform(lambda s: s.rolling(3).mean() / s.shift(3).rolling(12).mean())
    np.testing.assert_allclose(got["v"], v, rtol=1e-12)


@pytest.mark.parametrize("rows", [SHORT, SHORT + 1, 97, 500])
@pytest.mark.parametrize("block", [64, 4096])
def test_long_frames(series, rows, block):
    """Frames made of two running values equal plain ones: nulls, short series, blocks and a look back included."""
    pdf, df = series
    df = df.withColumn("odd", F.when(F.pmod(F.col("open_time_ms"), F.lit(30)) == 0, F.col("close")))
    kinds = ["max", "min", "sum", "count", "avg"]
    frames = {f"{k}{back}": Frame("odd", k, rows, back) for k in kinds for back in (0, 5)}
    stage = {name: Roll(rows + f.back - 1, f.over, (f,)) for name, f in frames.items()}
    two = {"twice": Roll(rows - 1, Frame("max0", "min", rows).over, (Frame("max0", "min", rows),))}
    got = as_frame(roll(df, [stage, two], STEP, block_rows=block), *stage, "twice", "pos")
    want = pdf.sort_values(["symbol", "open_time_ms"]).reset_index(drop=True)
    want["odd"] = want["close"].where(want["open_time_ms"] % 30 == 0)
    over = lambda c, k, shift: want.groupby("symbol")[c].transform(
        lambda s: getattr(s.rolling(rows, 1), {"avg": "mean"}.get(k, k))().shift(shift))
    want["max0"] = over("odd", "max", 0)
    for name, f in frames.items():
        mine, plain = got[name].astype(float), over("odd", f.kind, f.back)
        # pandas counts nothing as a sum of 0.
        plain = plain.where(over("odd", "count", f.back) > 0) if f.kind == "sum" else plain
        seen = got["pos"] >= f.back
        np.testing.assert_allclose(mine[seen], plain[seen], rtol=1e-12, err_msg=name)
    np.testing.assert_allclose(got["twice"].astype(float), over("max0", "min", 0), rtol=1e-12)


def test_work_of_long_frames_does_not_grow(series):
    """No frame of the plan is as long as the window, and bars move once for the numbering and once for the blocks."""
    _, df = series
    plan = lambda n: roll(df, {"m": ind.rolling_max("close", n), "s": ind.sma("close", n)}, STEP)._jdf.queryExecution().executedPlan().toString()
    short, long = plan(SHORT), plan(288)
    swept = lambda p: [m for m in re.findall(r"RowFrame, (-\d+), ([^)]+)", p) if m[0] != m[1]]  # a lag has one row
    assert swept(short) and not swept(long)
    assert long.count("Exchange") == short.count("Exchange")
    assert plan(288).count("Window") == plan(5000).count("Window")


@pytest.mark.parametrize("chunk", [30, 500, 10**9])
def test_prefix_chunks(series, chunk):
    pdf, df = series
    df = df.withColumn("odd", F.when(F.pmod(F.col("open_time_ms"), F.lit(30)) == 0, F.col("close")))
    specs = {"hi": ("close", "max"), "lo": ("close", "min"), "s": ("close", "sum"), "last": ("odd", "last"), "lag": ("odd", "lag")}
    got = as_frame(prefix(df, ["symbol"], "open_time_ms", grid.floor_bucket("open_time_ms", chunk), specs), *specs)
    want = pdf.sort_values(["symbol", "open_time_ms"]).reset_index(drop=True)
    want["odd"] = want["close"].where(want["open_time_ms"] % 30 == 0)
    g = want.groupby("symbol")
    np.testing.assert_allclose(got["hi"], g["close"].transform(lambda s: s.cummax().shift()))
    np.testing.assert_allclose(got["lo"], g["close"].transform(lambda s: s.cummin().shift()))
    np.testing.assert_allclose(got["s"], g["close"].transform(lambda s: s.cumsum().shift(fill_value=0.0)), rtol=1e-9)
    np.testing.assert_allclose(got["last"].astype(float), g["odd"].transform(lambda s: s.ffill().shift()))
    np.testing.assert_allclose(got["lag"].astype(float), g["odd"].shift())


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_recurrence_blocks(series, block):
    pdf, df = series
    df = ind.numbered(df, STEP)
    got = fold_linear(df, ["symbol"], {"y": "close"}, 0.9, 0.1, 20, block).toPandas().sort_values(["symbol", "pos"])
    want = []
    for _, part in pdf.sort_values(["symbol", "open_time_ms"]).groupby("symbol"):
        y = None
        for i, x in enumerate(part["close"]):
            if i == 19:
                y = part["close"].iloc[:20].mean()
            elif i > 19:
                y = 0.9 * y + 0.1 * x
            want.append(np.nan if y is None else y)
    np.testing.assert_allclose(got["y"].astype(float), want, rtol=1e-10)


def test_rsi_edges(spark):
    rows = [("UP", i, 100.0 + i) for i in range(20)] + [("FLAT", i, 100.0) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, open_time_ms long, close double")
    got = {r.symbol: r.rsi for r in ind.rsi_wilder(df, 1, block_rows=4).filter("pos = 19").collect()}
    assert got == {"UP": 100.0, "FLAT": 50.0}


@pytest.mark.parametrize("bucket", [40, 1000, 10**9])
@pytest.mark.parametrize("strict,forward", [(True, False), (False, False), (False, True)])
def test_asof_buckets(spark, series, bucket, strict, forward):
    pdf, df = series
    left = spark.createDataFrame([(s, t) for s in ("HOT", "A", "B", "NONE") for t in range(0, 3000, 35)], "symbol string, t long")
    right = df.select("symbol", F.col("open_time_ms").alias("rt"), "close")
    got = joins.asof_join(left, right, "t", "rt", bucket, strict=strict, forward=forward).toPandas()
    got = got.sort_values(["symbol", "t"]).reset_index(drop=True)
    want = pd.merge_asof(
        left.toPandas().sort_values("t"), pdf.rename(columns={"open_time_ms": "rt"})[["symbol", "rt", "close"]].sort_values("rt"),
        left_on="t", right_on="rt", by="symbol", allow_exact_matches=not strict, direction="forward" if forward else "backward",
    ).sort_values(["symbol", "t"]).reset_index(drop=True)
    assert len(got) == len(want)
    np.testing.assert_allclose(got["rt"].astype(float), want["rt"].astype(float))
    np.testing.assert_allclose(got["close"].astype(float), want["close"])


@pytest.mark.parametrize("wanted", [["symbol", "t", "rt", "close"], ["t", "close"]])
def test_asof_works_out_its_inputs_once(spark, wanted):
    """What one use drops early must not make a second exchange, with all that lies below it."""
    symbol = (F.col("id") % 7).cast("string").alias("symbol")
    left = spark.range(1000).select(symbol, F.col("id").alias("t"), F.rand(1).alias("v"))
    right = spark.range(1000).select(symbol, (F.col("id") * 3).alias("rt"), F.rand(2).alias("close"), F.rand(3).alias("more"))
    got = joins.asof_join(left, right, "t", "rt", 100).select(*wanted)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


@pytest.mark.parametrize("bucket", [15, 200])
@pytest.mark.parametrize("inclusive", [True, False])
def test_forward_buckets(spark, series, bucket, inclusive):
    pdf, df = series
    left = spark.createDataFrame([(s, t) for s in ("HOT", "A") for t in range(0, 3000, 50)], "symbol string, t long")
    got = joins.forward_join(left, df, F.col("t"), F.col("t") + 120, bucket, end_inclusive=inclusive)
    got = sorted((r.symbol, r.t, r.bar.open_time_ms) for r in got.collect())
    both = left.toPandas().merge(pdf, on="symbol")
    end = both["t"] + 120
    inside = both[(both["open_time_ms"] >= both["t"]) & ((both["open_time_ms"] <= end) if inclusive else (both["open_time_ms"] < end))]
    assert got == sorted(map(tuple, inside[["symbol", "t", "open_time_ms"]].itertuples(index=False, name=None)))


def test_resample_needs_contiguous_bars(spark):
    rows = []
    for symbol, times in {"FULL": [0, 5, 10], "GAP": [0, 10], "DUP": [0, 5, 5], "ODD": [0, 7, 10], "LATE": [1, 6, 11]}.items():
        rows += [(symbol, t, 1.0, 2.0, 0.5, 1.5, 1.0, t + 4, 1.0, 1, 1.0, 1.0) for t in times]
    cols = "symbol string, open_time_ms long, open double, high double, low double, close double, volume double, close_time_ms long, quote_volume double, trades long, taker_buy_base_volume double, taker_buy_quote_volume double"
    out = grid.resample(spark.createDataFrame(rows, cols), 5, 3)
    assert sorted((r.symbol, r.open_time_ms) for r in out.collect()) == [("FULL", 0), ("LATE", 1)]


def test_tick_keys_long_and_decimal(spark):
    rows = [("S", t, s, float(p), 1.0, 1.0, 0.0, 0.0) for t, s, p in [(100, 9, 1), (100, 3, 2), (160, 4, 3), (160, 8, 4), (130, 99, 5)]]
    df = spark.createDataFrame(rows, "symbol string, t_ms long, seq long, price double, qty double, quote double, taker_base double, taker_quote double")
    for bits in (10, 62):
        r = grid.ticks_to_bars(df, 1000, seq_bits=bits).first()
        assert (r.open, r.close, r.high, r.low, r.trades) == (2.0, 4.0, 5.0, 1.0, 5)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 500), "v": np.round(rng.normal(0, 3, 500), 2)})
    got = exact_quantiles(spark.createDataFrame(pdf), "v", [0.1, 0.5, 0.95], ["g"]).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got.loc[g, ["p10", "p50", "p95"]].astype(float), np.quantile(part["v"], [0.1, 0.5, 0.95]), atol=1e-9)


def test_auc_and_ap_with_ties(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    p = np.round(np.clip(0.3 * y + rng.random(300) * 0.7, 0, 1), 1)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap = 0.0
    for s in np.unique(p):
        take = p >= s
        ap += y[take].mean() * ((p == s) & (y == 1)).sum() / y.sum()
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(auc)
    assert ev.average_precision(df).first().average_precision == pytest.approx(ap)


@pytest.mark.parametrize("chunk", [7, 64, 100_000])
def test_values_without_keys_are_carried_by_groups_of_chunks(spark, chunk):
    rng = random.Random(chunk)
    rows = sorted((t, rng.choice([None, rng.randrange(100)])) for t in rng.sample(range(-3000, 9000), 2500))
    df = spark.createDataFrame(rows, "t long, v long")
    cut_at = F.col("t") - F.pmod(F.col("t"), F.lit(chunk))
    specs = {"a": ("v", "max"), "b": ("v", "min"), "c": ("v", "sum"), "d": ("v", "last"), "e": ("v", "lag")}
    out = prefix(df, [], "t", cut_at, specs)
    got = {r["t"]: tuple(r[c] for c in "abcde") for r in out.collect()}
    seen = []
    for k, (t, v) in enumerate(rows):
        want = (max(seen, default=None), min(seen, default=None), sum(seen), seen[-1] if seen else None, rows[k - 1][1] if k else None)
        assert got[t] == want
        seen += [v] if v is not None else []
    placed = with_position(df, [], "t", cut_at)
    assert [r["pos"] for r in placed.orderBy("t").collect()] == list(range(len(rows)))
    for plan in (out, placed):
        assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()
    assert prefix(df.filter("false"), [], "t", cut_at, specs).count() == 0


def test_close_scores_still_spread(spark):
    """Scores within a millionth of each other fill many bins; results are those of the ranks."""
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 4000)
    p = 0.5 + np.round((y * 0.2 + rng.random(4000)) * 1e-6, 10)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    sizes = [r["count"] for r in depth(df.select("p").distinct(), [], "p").groupBy("_depth").count().collect()]
    assert len(sizes) > 200 and max(sizes) < 100
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(want)


def test_cooldown_is_greedy(spark):
    rng = random.Random(8)
    rows = [(s, rng.randrange(0, 5000), i) for s in ("HOT", "HOT", "HOT", "A") for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, t long, id long")
    got = sorted((r.symbol, r.t, r.id) for r in gaps.cooldown(df, ["symbol"], "t", 60, "id").collect())
    want, last = [], {}
    for s, t, i in sorted(set(rows)):
        if s not in last or t - last[s] >= 60:
            want.append((s, t, i))
            last[s] = t
    assert got == want


def test_cooldown_of_one_hot_key_in_many_tasks(spark):
    """Long runs, pauses, null keys, rows of one time; a chunk of one key is a window partition."""
    rng, t, rows = random.Random(9), 0, []
    for i in range(3000):
        t += rng.choice([0, 1, 1, 2, 3, 7] + [80] * (i % 500 == 0))
        rows.append(("HOT", t, i))
    rows += [(None, k * 10, 5000 + k) for k in range(40)] + [("X", -500 + k * 9, 6000 + k) for k in range(120)] + [("N", None, 1)]
    df = spark.createDataFrame(rows, "symbol string, t long, id long")
    for gap in (1, 20, 90, 5000):
        got = sorted(((r.symbol or "", r.t, r.id) for r in gaps.cooldown(df, ["symbol"], "t", gap, "id").collect()))
        want, last = [], {}
        for s, at, i in sorted((s or "", at, i) for s, at, i in rows if at is not None):
            if s not in last or at - last[s] >= gap:
                want.append((s, at, i))
                last[s] = at
        assert got == want
    chunks = gaps.followers(df.filter("t is not null").select("symbol", "t").distinct(), ["symbol"], "t", 20)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "_chunk" in plan and not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert gaps.cooldown(df.filter("false"), ["symbol"], "t", 20, "id").count() == 0


def test_replay_keeps_state_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")

        def step(st, r):
            st["n"] = st.get("n", 0) + 1
            return (r.k, r.id, st["n"])

        out = online.replay(df, ["k"], ["id"], dict, step, "k long, id long, n int").collect()
        assert all(r.n == r.id // 3 + 1 for r in out)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_shuffled_places_are_permutations(spark, n):
    """Every place is taken once in every trial, trials differ, and values go far and wide."""
    trials = 6
    df = spark.range(n).select("id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(trials - 1).cast("bigint"))).alias("t"))
    got = df.select("t", "id", ev.shuffled_place(F.col("id"), n, F.col("t")).alias("to")).toPandas()
    for _, part in got.groupby("t"):
        assert sorted(part["to"]) == list(range(n))
    if n == 1000:
        orders = [tuple(p.sort_values("id")["to"]) for _, p in got.groupby("t")]
        assert len(set(orders)) == trials
        for order in orders:
            assert abs(np.corrcoef(range(n), order)[0, 1]) < 0.12
            assert sum(i == x for i, x in enumerate(order)) < 12


def test_importance_of_used_and_unused_features(spark):
    """A feature that decides the score loses precision when shuffled; one that it does not read loses none."""
    rows = spark.range(2000).select("id", F.rand(3).alias("a"), F.rand(4).alias("b")).withColumn("y", (F.col("a") > 0.7).cast("int"))
    score = lambda df: df.withColumn("p", F.element_at("_x", 1))
    got = {r.feature: r.importance for r in ev.importance(score, rows, ["a", "b"], "y", "id", trials_at_once=4).collect()}
    assert 0.6 < got["a"] < 0.75 and abs(got["b"]) < 1e-12
    assert ev.importance(score, rows.filter("false"), ["a", "b"], "y", "id").filter("importance is not null").count() == 0


def test_importance_scores_each_row_once_a_trial(spark):
    """The scans over the scores read a written table; they do not shuffle and score the rows anew."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def told(v):
        seen.add(1)
        return v

    rows = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 2).cast("int").alias("y"))
    score = lambda df: df.withColumn("p", told(F.element_at("_x", 1)))
    assert ev.importance(score, rows, ["a", "b"], "y", "id", trials_at_once=4).count() == 2
    assert seen.value == 300 * (2 * 3 + 1)


def test_importance_sends_no_rows_through_the_driver(spark):
    """The rows meet their givers in a merge, also where the written table is so small that Spark would broadcast it."""
    plans = []

    def score(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df.withColumn("p", F.element_at("_x", 1))

    rows = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    assert ev.importance(score, rows, ["a"], "y", "id").count() == 1
    assert "SortMergeJoin" in plans[0] and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("n", [5, 1000, 5_000_011])
def test_shuffled_places_follow_the_plain_rounds(spark, n):
    """Array operations give what whole numbers of any size give."""
    p, a, b, c = ev.MIX_PRIME, ev.MIX_A, ev.MIX_B, ev.MIX_C
    mixed = lambda x, s: (((x * b + s * c) % p) ** 2 + s * a) % p

    def plain(x, trial):
        for r in range(1, ev.shuffle_rounds(n) + 1):
            salt = trial * 1000 + r
            mirror = (mixed(salt, n) - x) % n
            x = mirror if mixed(max(x, mirror), salt) >> 3 & 1 else x
        return x

    df = spark.range(0, n, max(n // 50, 1)).select("id", F.explode(F.array(F.lit(0), F.lit(7))).alias("t"))
    for r in df.select("id", "t", ev.shuffled_place(F.col("id"), n, F.col("t")).alias("to")).collect():
        assert r["to"] == plain(r["id"], r["t"])


def test_depth_counts_the_edges_below(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("g"), F.round(F.rand(5), 2).alias("v"))
    edges = {r.g: r.e for r in rows.groupBy("g").agg(F.percentile_approx("v", [i / 256 for i in range(1, 256)]).alias("e")).collect()}
    for r in depth(rows, ["g"], "v").collect():
        assert r._depth == sum(e <= r.v for e in edges[r.g])
