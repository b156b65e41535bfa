"""Queries for chronological evaluation and online learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlytics.catalog.base import DAY, HOUR, candidates, cte, query, rnd, scored
from barlytics.catalog.paths import trades
from barlytics.catalog.scalars import CAND, FEATURES, KEY, VECTOR, signals_next
from barlytics.functions import scalar as sc
from barlytics.operators import cohorts, evaluate as ev, gaps, joins, online
from barlytics.session import cut

# --- cleaning and splitting ------------------------------------------------

RAW = ["oi_change_15m_pct", "oi_change_1h_pct", "spot_volume_1h_usd"]


@query(
    "m01_clean_dataset",
    f"""SELECT {CAND}, oi_change_15m_pct, CASE WHEN oi_change_1h_pct = 0 THEN 0 ELSE round(10 / oi_change_1h_pct, 9) END AS oi_change_1h_pct, round(coalesce(spot_volume_1h_usd, 0), 6) AS spot_volume_1h_usd,
  CAST(bias = 'LONG' AS INT) AS y, round(score, 9) AS ret FROM candidates WHERE price_change_1h_spot_pct <> 3""",
)
def m01(spark, sf):
    inverse = F.when(F.col("oi_change_1h_pct") == 0, F.lit(float("inf"))).otherwise(10 / F.nullif(F.col("oi_change_1h_pct"), F.lit(0.0)))
    df = candidates(spark, sf).withColumns(
        {"oi_change_1h_pct": inverse, "y": (F.col("bias") == "LONG").cast("int"), "ret": F.col("score"),
         "amb": (F.col("price_change_1h_spot_pct") == 3).cast("int")}
    )
    return rnd(ev.clean_dataset(df, RAW, "y", "ret", "amb").select(*KEY, *RAW, "y", "ret"))


cte(
    "split_times",
    "SELECT asof_ms, row_number() OVER (ORDER BY asof_ms) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT asof_ms FROM scored)",
)
cte(
    "split_b",
    f"""SELECT max(asof_ms) FILTER (WHERE pos = i) AS val_start, max(asof_ms) FILTER (WHERE pos = j) AS test_start FROM (
  SELECT *, least(greatest(i + 1, CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT)), n - 1) AS j FROM (SELECT *, greatest(1, CAST(floor(n * 0.6::DOUBLE) AS BIGINT)) AS i FROM split_times))""",
)
cte(
    "split_rows",
    f"""SELECT s.*, CASE WHEN asof_ms <= val_start - {72 * HOUR} THEN 'train' WHEN asof_ms BETWEEN val_start AND test_start - {72 * HOUR} THEN 'val' WHEN asof_ms >= test_start THEN 'test' END AS split
FROM scored s, split_b""",
)


@query("m02_purged_split", "SELECT doc_id, split FROM split_rows WHERE split IS NOT NULL")
def m02(spark, sf):
    return ev.purged_split(cut(scored(spark, sf))).select("doc_id", "split")


@query(
    "m02_split_sizes",
    "SELECT split, count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, min(asof_ms) AS first_ms, max(asof_ms) AS last_ms FROM split_rows WHERE split IS NOT NULL GROUP BY split",
)
def m02b(spark, sf):
    return ev.purged_split(cut(scored(spark, sf))).groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"), F.min("asof_ms").alias("first_ms"), F.max("asof_ms").alias("last_ms")
    )


# --- classifier on candidate rows: does the next scan price rise? -----------

MODEL_FEATURES = [
    "score", "oi_change_15m_pct", "oi_change_1h_pct", "spot_buy_sell_ratio_1h", "spot_net_flow_1h_usd",
    "price_change_1h_spot_pct", "price_change_4h_spot_pct", "price_change_24h_futures_pct",
]


def _model_rows(spark, sf):
    df = signals_next(spark, sf).filter("pool_price is not null")
    move = sc.directional_return("current_price", "pool_price", F.lit("LONG"))
    df = df.withColumns({"y": (move > 0).cast("int"), "ret": move, "asof_ms": F.col("scan_ms"), "symbol": F.col("pair")})
    df = df.withColumn("doc_id", F.concat_ws("-", "pair", F.col("scan_ms").cast("string")))
    # Written before the split, which reads the rows for its borders too.
    return cut(ev.purged_split(cut(ev.clean_dataset(df.select(*MODEL_FEATURES, "y", "ret", "asof_ms", "symbol", "doc_id"), MODEL_FEATURES, "y", "ret")), gap_ms=24 * HOUR))


_models: dict[tuple[str, str], object] = {}


def _fitted(rows, sf):
    """The classifier with all its trees, fitted once per session and folder."""
    key = (rows.sparkSession.sparkContext.applicationId, sf)
    if key not in _models:
        _models[key] = ev.fit_classifier(rows.filter("split = 'train'"), MODEL_FEATURES, "y")
    return _models[key]


@query("m03_fit_classifier")
def m03(spark, sf):
    rows = _model_rows(spark, sf)
    scored_rows = cut(ev.predict(_fitted(rows, sf), rows, MODEL_FEATURES).select("split", "y", "p"))
    return ev.roc_auc(scored_rows, by=["split"]).join(ev.average_precision(scored_rows, by=["split"]).drop("n"), "split")


@query("m10_permutation_importance")
def m10(spark, sf):
    rows = _model_rows(spark, sf)
    return ev.permutation_importance(_fitted(rows, sf), rows.filter("split = 'val'"), MODEL_FEATURES, "y", "doc_id")


# The same with a written rule in place of a fitted model, so that SQL can work out every figure:
# the numbering, the permutation of each trial, the scores and what the precision loses.
RULE_FEATURES = ["score", "price_change_1h_spot_pct", "oi_change_1h_pct"]
MIXED = f"((({{x}}) % {ev.MIX_PRIME} * {ev.MIX_B} + {{s}} * {ev.MIX_C}) % {ev.MIX_PRIME})"


def mixed_sql(x: str, s: str) -> str:
    line = MIXED.format(x=x, s=s)
    return f"(({line} * {line} + {s} * {ev.MIX_A} % {ev.MIX_PRIME}) % {ev.MIX_PRIME})"


def rule_sql(a: str, b: str, c: str) -> str:
    return f"0.5::DOUBLE - {a} / 100 + {b} / 50 + {c} / 1000"


cte(
    "rule_rows",
    """SELECT row_number() OVER (ORDER BY scan_ms + CAST(substr(pair, 2) AS BIGINT)) - 1 AS pos, count(*) OVER () AS n, pool_price > current_price AS y,
  score AS x0, price_change_1h_spot_pct AS x1, oi_change_1h_pct AS x2 FROM signals_next
WHERE pool_price IS NOT NULL AND score IS NOT NULL AND price_change_1h_spot_pct IS NOT NULL AND oi_change_1h_pct IS NOT NULL""",
)
cte(
    "rule_places",
    f"""WITH RECURSIVE walk AS (
  SELECT trial, pos, n, pos AS x, 0 AS r FROM rule_rows, generate_series(0, {3 * len(RULE_FEATURES) - 1}) AS g(trial)
  UNION ALL
  SELECT trial, pos, n, CASE WHEN ({mixed_sql('greatest(x, mirror)', 'salt')} >> 3) % 2 = 1 THEN mirror ELSE x END, r + 1 FROM (
    SELECT *, (({mixed_sql('salt', 'n')} - x) % n + n) % n AS mirror FROM (SELECT *, trial * 1000 + r + 1 AS salt FROM walk WHERE r < 4 * length(bin(greatest(n - 1, 1))))))
SELECT trial, pos, x AS place FROM walk WHERE r = 4 * length(bin(greatest(n - 1, 1)))""",
)


def ap_sql(rows: str) -> str:
    """Average precision by trial of rows with a score and a label."""
    return f"""SELECT trial, sum(up * tp / seen) / sum(up) AS ap FROM (
  SELECT trial, up, sum(up) OVER z AS tp, sum(n) OVER z AS seen FROM (
    SELECT trial, p, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS up, count(*) AS n FROM ({rows}) GROUP BY trial, p)
  WINDOW z AS (PARTITION BY trial ORDER BY p DESC)) GROUP BY trial"""


cte("rule_usual", ap_sql(f"SELECT 0 AS trial, y, {rule_sql('x0', 'x1', 'x2')} AS p FROM rule_rows"))
cte(
    "rule_trials",
    ap_sql(
        "SELECT trial, t.y, "
        + rule_sql(*[f"(CASE WHEN trial // 3 = {i} THEN g.x{i} ELSE t.x{i} END)" for i in range(3)])
        + " AS p FROM rule_places w JOIN rule_rows g ON g.pos = w.pos JOIN rule_rows t ON t.pos = w.place"
    ),
)


@query(
    "m10_importance_by_rule",
    f"SELECT {RULE_FEATURES}[t.trial // 3 + 1] AS feature, round(any_value(u.ap) - avg(t.ap), 9) + 0.0 AS importance FROM rule_trials t, rule_usual u GROUP BY t.trial // 3",
)
def m10r(spark, sf):
    rows = signals_next(spark, sf).filter("pool_price is not null").dropna(subset=RULE_FEATURES).select(
        *RULE_FEATURES, (F.col("pool_price") > F.col("current_price")).cast("int").alias("y"),
        (F.col("scan_ms") + F.substring("pair", 2, 9).cast("bigint")).alias("at"),
    )
    x = [F.element_at("_x", i + 1) for i in range(3)]
    rule = lambda df: df.withColumn("p", F.lit(0.5) - x[0] / 100 + x[1] / 50 + x[2] / 1000)
    return rnd(ev.importance(rule, rows, RULE_FEATURES, "y", "at", trials_at_once=4)).withColumn("importance", F.col("importance") + F.lit(0.0))


@query("m11_model_promotable")
def m11m(spark, sf):
    rows = _model_rows(spark, sf)
    s = cut(ev.predict(_fitted(rows, sf), rows, MODEL_FEATURES))
    val, test = s.filter("split = 'val'"), s.filter("split = 'test'")
    best = ev.choose_threshold(ev.threshold_metrics(val, ev.THRESHOLDS), val)
    return ev.promotable(ev.threshold_metrics(test, F.array(best.select("threshold").scalar())))


# What SQL can say about the fitted model: sizes, labels, and that all figures are in bounds.
cte(
    "model_split",
    f"""WITH t AS (SELECT scan_ms, row_number() OVER (ORDER BY scan_ms) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT scan_ms FROM signals_next WHERE pool_price IS NOT NULL)),
b AS (SELECT max(scan_ms) FILTER (WHERE pos = i) AS val_start, max(scan_ms) FILTER (WHERE pos = j) AS test_start FROM (
  SELECT *, least(greatest(i + 1, CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS BIGINT)), n - 1) AS j FROM (SELECT *, greatest(1, CAST(floor(n * 0.6::DOUBLE) AS BIGINT)) AS i FROM t)))
SELECT pool_price > current_price AS y, CASE WHEN scan_ms <= val_start - {24 * HOUR} THEN 'train' WHEN scan_ms BETWEEN val_start AND test_start - {24 * HOUR} THEN 'val' WHEN scan_ms >= test_start THEN 'test' END AS split
FROM signals_next, b WHERE pool_price IS NOT NULL""",
)


@query(
    "m03_classifier_checks",
    "SELECT split, count(*) AS rows, count(*) FILTER (WHERE y) AS positives, count(*) AS scored, true AS bounded, true AS better_than_base FROM model_split WHERE split IS NOT NULL GROUP BY split",
)
def m03c(spark, sf):
    rows = _model_rows(spark, sf)
    s = cut(ev.predict(_fitted(rows, sf), rows, MODEL_FEATURES))
    y, p = F.col("y").cast("double"), F.col("p")
    body = s.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"), F.count_if(p.between(0.0, 1.0)).alias("scored"),
        (F.avg((p - y) ** 2) < F.avg(y) * (1 - F.avg(y))).alias("better_than_base"),
    )
    figures = ev.roc_auc(s, by=["split"]).drop("n").join(ev.average_precision(s, by=["split"]).drop("n"), "split")
    bounded = F.col("roc_auc").between(0.5, 1.0) & F.col("average_precision").between(0.0, 1.0)
    return body.join(figures.select("split", bounded.alias("bounded")), "split")


@query("m10_importance_checks", f"SELECT unnest({MODEL_FEATURES}) AS feature, true AS bounded")
def m10c(spark, sf):
    return m10(spark, sf).select("feature", F.col("importance").between(-1.0, 1.0).alias("bounded"))


@query("m11_model_checks", "SELECT count(*) AS test_rows, true AS known_threshold, true AS consistent FROM model_split WHERE split = 'test'")
def m11c(spark, sf):
    n = _model_rows(spark, sf).filter("split = 'test'").agg(F.count(F.lit(1))).scalar()
    c = F.col("alerts")
    return m11m(spark, sf).select(
        n.alias("test_rows"), F.col("threshold").between(0.35, 0.95).alias("known_threshold"),
        (c.between(0, n) & (F.abs(F.col("coverage") - c / n) < 1e-9) & (F.col("promotable") <= (c >= 20))).alias("consistent"),
    )


# --- threshold metrics -----------------------------------------------------

GAP = 12 * HOUR
TH = ev.THRESHOLDS


def cooled(rows: str, keys: str, t: str, gap: int, tie: str, name: str) -> str:
    """SQL fragments for a greedy cooldown: ``<name>_kept`` has keys and time."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ka = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""{name}_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, {t} ORDER BY {tie}) AS rn FROM ({rows})) WHERE rn = 1),
{name}_n AS MATERIALIZED (SELECT {ka}, a.{t}, b.{t} AS nxt FROM {name}_d a ASOF LEFT JOIN {name}_d b ON {on} AND a.{t} + {gap} <= b.{t}),
{name}_k AS (SELECT {keys}, min({t}) AS {t} FROM {name}_d GROUP BY {keys} UNION ALL
  SELECT {ka}, b.nxt FROM {name}_k a JOIN {name}_n b ON {on} AND a.{t} = b.{t} WHERE b.nxt IS NOT NULL),
{name}_kept AS (SELECT a.* FROM {name}_d a JOIN {name}_k b ON {on} AND a.{t} = b.{t})"""


def metrics_sql(src: str, th: str, tag: str) -> str:
    return f"""{cooled(f"SELECT s.*, h.threshold FROM {src} s, {th} h WHERE s.p >= h.threshold", "threshold, symbol", "asof_ms", GAP, "doc_id", tag)},
{tag}_m AS (SELECT h.threshold, count(k.doc_id) AS alerts, count(k.doc_id) / (SELECT count(*) FROM {src}) AS coverage, avg(k.y) AS precision, avg(k.y) / (SELECT avg(y) FROM {src}) AS lift,
  avg(k.ret - 0.12) AS avg_return, median(k.ret - 0.12) AS median_return FROM {th} h LEFT JOIN {tag}_kept k ON h.threshold = k.threshold GROUP BY h.threshold)"""


cte("th_list", f"SELECT unnest({TH})::DOUBLE AS threshold")
MCOLS = "round(coverage, 9) AS coverage, round(precision, 9) AS precision, round(lift, 9) AS lift, round(avg_return, 9) AS avg_return, round(median_return, 9) AS median_return"


@query("m04_threshold_metrics", f"WITH RECURSIVE {metrics_sql('scored', 'th_list', 'th')} SELECT threshold, alerts, {MCOLS} FROM th_m")
def m04(spark, sf):
    return rnd(ev.threshold_metrics(cut(scored(spark, sf)), TH))


@query(
    "m05_choose_threshold",
    f"""WITH RECURSIVE {metrics_sql('scored', 'th_list', 'th')} SELECT round(coalesce((SELECT threshold FROM th_m WHERE alerts >= 20 AND avg_return > 0 ORDER BY precision DESC, avg_return DESC, coverage, threshold LIMIT 1),
  greatest(0.5, least(0.95, (SELECT quantile_cont(p, 0.9) FROM scored)))), 9) AS threshold, (SELECT count(*) FROM th_m WHERE alerts >= 20 AND avg_return > 0) AS eligible""",
)
def m05(spark, sf):
    s = cut(scored(spark, sf))
    return rnd(ev.choose_threshold(ev.threshold_metrics(s, TH), s))


cte(
    "auc_rows",
    """SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2.0 AS r,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS ra FROM scored""",
)
AUC = "(sum({0}) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0)"


@query(
    "m06_roc_auc",
    f"SELECT 'all' AS symbol, count(*) AS n, round({AUC.format('ra')}::DOUBLE, 9) AS roc_auc FROM auc_rows UNION ALL SELECT symbol, count(*), round({AUC.format('r')}::DOUBLE, 9) FROM auc_rows GROUP BY symbol",
)
def m06(spark, sf):
    s = cut(scored(spark, sf))
    return rnd(ev.roc_auc(s).withColumn("symbol", F.lit("all")).unionByName(ev.roc_auc(s, by=["symbol"])))


AP = """SELECT {0} AS symbol, CAST(sum(n) AS BIGINT) AS n, round((sum(tp_at * 1.0::DOUBLE / seen * pos) / nullif(sum(pos), 0))::DOUBLE, 9) AS average_precision FROM (
  SELECT *, sum(pos) OVER (PARTITION BY {1} ORDER BY p DESC) AS tp_at, sum(n) OVER (PARTITION BY {1} ORDER BY p DESC) AS seen FROM (SELECT {1} AS g, p, sum(y) AS pos, count(*) AS n, {1} FROM scored GROUP BY ALL)) GROUP BY ALL"""
AP_ALL = AP.format("'all'", "1").replace("PARTITION BY 1", "PARTITION BY g").replace("SELECT 1 AS g, p, sum(y) AS pos, count(*) AS n, 1 FROM", "SELECT 1 AS g, p, sum(y) AS pos, count(*) AS n FROM")


@query("m07_average_precision", f"{AP_ALL} UNION ALL {AP.format('symbol', 'symbol')}")
def m07(spark, sf):
    s = cut(scored(spark, sf))
    return rnd(ev.average_precision(s).withColumn("symbol", F.lit("all")).unionByName(ev.average_precision(s, by=["symbol"])))


@query("m08_brier", "SELECT symbol, count(*) AS n, round(avg((p - y) ** 2), 9) AS brier, round(avg((0.5 - y) ** 2), 9) AS fixed_half_brier FROM scored GROUP BY symbol")
def m08(spark, sf):
    return rnd(cohorts.brier(scored(spark, sf), "p", "y", ["symbol"]))


cte("slice_list", "SELECT unnest(['top_10pct', 'top_5pct', 'top_2pct']) AS slice, unnest([quantile_cont(p, 0.9), quantile_cont(p, 0.95), quantile_cont(p, 0.98)]) AS threshold FROM scored")


@query("m09_top_quantile_slices", f"WITH RECURSIVE {metrics_sql('scored', 'slice_list', 'sl')} SELECT s.slice, round(m.threshold, 9) AS threshold, alerts, {MCOLS} FROM sl_m m JOIN slice_list s ON s.threshold = m.threshold")
def m09(spark, sf):
    return rnd(ev.top_quantile_slices(cut(scored(spark, sf))))


@query(
    "m11_promotable",
    f"WITH RECURSIVE {metrics_sql('scored', 'th_list', 'th')} SELECT threshold, alerts, {MCOLS}, alerts >= 20 AND coalesce(precision, 0) >= 0.5 AND coalesce(avg_return, -999) >= 0.2 AS promotable FROM th_m",
)
def m11(spark, sf):
    return rnd(ev.promotable(ev.threshold_metrics(cut(scored(spark, sf)), TH)))


# --- cooldowns -------------------------------------------------------------


@query("t06_cooldown", f"WITH RECURSIVE {cooled('SELECT * FROM scored', 'symbol', 'asof_ms', 100 * HOUR, 'doc_id', 'cd')} SELECT doc_id, symbol, asof_ms FROM cd_kept")
def t06(spark, sf):
    df = scored(spark, sf).select("symbol", "asof_ms", "doc_id")
    return gaps.cooldown(df, ["symbol"], "asof_ms", 100 * HOUR, "doc_id")


@query("t07_rate_limit", f"WITH RECURSIVE {cooled('SELECT pair, scan_ms, score FROM candidates', 'pair', 'scan_ms', DAY, 'score', 'rl')} SELECT pair, scan_ms FROM rl_kept")
def t07(spark, sf):
    df = candidates(spark, sf).select(*KEY, "score")
    return gaps.rate_limit(df, "pair", "scan_ms", DAY, "score").select(*KEY)


# --- online models: one per pair and side ----------------------------------

cte(
    "model_rows",
    f"""SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY known_ms, scan_ms) AS rn FROM (SELECT pair, scan_ms, scan_ms + (1 + (scan_ms // {HOUR}) % 5) * {HOUR} AS known_ms, bias AS side, [1.0::DOUBLE, {VECTOR}] AS x, CAST(pool_price > current_price AS DOUBLE) AS y,
  (pool_price / current_price - 1) * 100 / 6 AS reward FROM signals_next WHERE pool_price IS NOT NULL)""",
)


def _online_rows(spark, sf):
    df = signals_next(spark, sf).filter("pool_price is not null")
    return df.select(
        "pair", F.col("bias").alias("side"), "scan_ms", F.col("scan_ms").alias("id"),
        # The outcome is known one to five hours later, often after later scans.
        (F.col("scan_ms") + (1 + F.floor(F.col("scan_ms") / HOUR) % 5) * HOUR).alias("known_ms"),
        sc.feature_vector(FEATURES, (10, 20, 30, 5, 3, 100)).alias("x"),
        (F.col("pool_price") > F.col("current_price")).cast("double").alias("y"),
        ((F.col("pool_price") / F.col("current_price") - 1.0) * 100.0 / 6.0).alias("reward_r"),
    )


def weights_sql(rate: str, err: str) -> str:
    one = [f"w[{i}] + {rate} * ({err} * x[{i}]{'' if i == 1 else f' - 0.001 * w[{i}]'})" for i in range(1, 8)]
    return f"[{', '.join(one)}]"


ZERO = "[0.0::DOUBLE, 0, 0, 0, 0, 0, 0]"
DOT = " + ".join(f"w[{i}] * x[{i}]" for i in range(1, 8))


KNOWN = """SELECT s.pair, s.side, s.scan_ms, s.x, count(l.rn) AS n FROM model_rows s
  LEFT JOIN model_rows l ON l.pair = s.pair AND l.side = s.side AND l.known_ms <= s.scan_ms GROUP BY ALL"""
_MW, _RX = DOT.replace("w[", "m.w[").replace("x[", "r.x["), DOT.replace("w[", "r.x[").replace("* x[", "* r.x[")


@query(
    "t08_online_logistic",
    f"""WITH RECURSIVE m(pair, side, rn, w) AS (
  SELECT DISTINCT pair, side, 0::BIGINT, {ZERO} FROM model_rows UNION ALL
  SELECT pair, side, rn, {weights_sql('rate', '(y - p)')} FROM (
    SELECT m.pair, m.side, r.rn, m.w, r.x, r.y, 0.05 / sqrt(1 + (r.rn - 1) / 100.0) AS rate, 1 / (1 + exp(-greatest(-30, least(30, {_MW})))) AS p
    FROM m JOIN model_rows r ON r.pair = m.pair AND r.side = m.side AND r.rn = m.rn + 1))
SELECT r.pair, r.side, r.scan_ms AS id, r.n AS model_n, round(CASE WHEN r.n >= 30 THEN 1 / (1 + exp(-greatest(-30, least(30, {_MW})))) END, 7) AS score, round(list_sum(m.w), 7) + 0.0 AS weight_sum
FROM ({KNOWN}) r JOIN m ON m.pair = r.pair AND m.side = r.side AND m.rn = r.n""",
)
def t08(spark, sf):
    out = online.online_logistic(_online_rows(spark, sf), ["pair", "side"], ["scan_ms"], "known_ms")
    total = F.aggregate("weights", F.lit(0.0), lambda a, v: a + v)
    return rnd(out.select("pair", "side", "id", "model_n", "score", (total + 0.0).alias("weight_sum")), 7)


@query(
    "t09_online_reward_regression",
    f"""WITH RECURSIVE m(pair, side, rn, w) AS (
  SELECT DISTINCT pair, side, 0::BIGINT, {ZERO} FROM model_rows UNION ALL
  SELECT pair, side, rn, {weights_sql('rate', 'err / norm')} FROM (SELECT *, greatest(-3, least(3, reward - f)) AS err FROM (
    SELECT m.pair, m.side, r.rn, m.w, r.x, r.reward, 0.15 / sqrt(1 + (r.rn - 1) / 100.0) AS rate, greatest(1, {_RX}) AS norm, greatest(-2, least(2, {_MW})) AS f
    FROM m JOIN model_rows r ON r.pair = m.pair AND r.side = m.side AND r.rn = m.rn + 1)))
SELECT r.pair, r.side, r.scan_ms AS id, r.n AS forecast_n, round(greatest(-2, least(2, {_MW})), 7) + 0.0 AS forecast, round(list_sum(m.w), 7) + 0.0 AS weight_sum
FROM ({KNOWN}) r JOIN m ON m.pair = r.pair AND m.side = r.side AND m.rn = r.n""",
)
def t09(spark, sf):
    out = online.online_reward_regression(_online_rows(spark, sf), ["pair", "side"], ["scan_ms"], "known_ms")
    total = F.aggregate("weights", F.lit(0.0), lambda a, v: a + v)
    return rnd(out.select("pair", "side", "id", "forecast_n", (F.col("forecast") + 0.0).alias("forecast"), (total + 0.0).alias("weight_sum")), 7)


# --- paper trades and rewards ----------------------------------------------

cte(
    "trade_book",
    f"""SELECT o.*, CASE WHEN (entry_ms // {DAY}) % 3 > 0 THEN 0.35 + ((entry_ms // {DAY}) % 7) * 0.05 END AS score, CASE WHEN status = 'PENDING' THEN 'MISSING_BAR' END AS data_error,
  CASE WHEN (entry_ms // {DAY}) % 5 = 0 THEN coalesce(resolved_bar_ms, entry_ms) + {DAY} ELSE entry_ms END AS sent_ms, resolved_bar_ms + {DAY} AS label_available_ms, 2.5 AS stop_pct, (entry_ms // {DAY}) % 60 AS forecast_n,
  ((entry_ms // {DAY}) % 9 - 4) / 10.0 AS forecast_r FROM trades_out o""",
)


def trade_book(spark, sf):
    _, t = trades(spark, sf)
    d = F.floor(F.col("entry_ms") / DAY)
    return t.withColumns(
        {
            "score": F.when(d % 3 > 0, 0.35 + (d % 7) * 0.05),
            "data_error": F.when(F.col("status") == "PENDING", "MISSING_BAR"),
            "sent_ms": F.when(d % 5 == 0, F.coalesce("resolved_bar_ms", "entry_ms") + DAY).otherwise(F.col("entry_ms")),
            "label_available_ms": F.col("resolved_bar_ms") + DAY, "stop_pct": F.lit(2.5),
            "forecast_n": d % 60, "forecast_r": (d % 9 - 4) / 10.0,
        }
    )


@query(
    "a11_side_panels",
    """SELECT side, count(*) AS entries, count(*) FILTER (WHERE c) AS resolved, count(*) FILTER (WHERE NOT c) AS open_or_pending, count(*) FILTER (WHERE status = 'TARGET') AS wins,
  count(*) FILTER (WHERE c AND score IS NOT NULL) AS scored_resolved, round(avg((score - (status = 'TARGET')::INT) ** 2) FILTER (WHERE c AND score IS NOT NULL), 6) AS prequential_brier,
  CAST(avg(0.25) FILTER (WHERE c AND score IS NOT NULL) AS DOUBLE) AS fixed_half_brier_baseline, round(avg(net_return_pct) FILTER (WHERE c), 6) AS mean_net_pct, count(*) FILTER (WHERE score >= 0.6) AS selected_entries,
  count(*) FILTER (WHERE c AND score >= 0.6) AS selected_resolved, round(avg(stressed_net_return_pct) FILTER (WHERE c AND score >= 0.6), 6) AS selected_mean_stressed_pct, count(data_error) AS data_errors
FROM (SELECT *, status NOT IN ('PENDING', 'OPEN') AS c FROM trade_book) GROUP BY side""",
)
def a11(spark, sf):
    return rnd(cohorts.side_panels(trade_book(spark, sf)), 6)


@query("a12_brier", "SELECT side, count(*) AS n, round(avg((score - (status = 'TARGET')::INT) ** 2), 6) AS brier, round(avg((0.5 - (status = 'TARGET')::INT) ** 2), 6) AS fixed_half_brier FROM trade_book WHERE status NOT IN ('PENDING', 'OPEN') AND score IS NOT NULL GROUP BY side")
def a12(spark, sf):
    t = trade_book(spark, sf).filter("status not in ('PENDING', 'OPEN') and score is not null").withColumn("y", F.col("status") == "TARGET")
    return rnd(cohorts.brier(t, "score", "y", ["side"]), 6)


BOUND = f"(SELECT min(sent_ms) + {200 * DAY} AS cutoff, max(sent_ms) - {100 * DAY} AS now FROM trade_book)"
cte(
    "rewards",
    f"""SELECT *, CASE WHEN resolved_bar_ms < sent_ms THEN 'EXIT_CANDLE_PRECEDES_DELIVERY' END AS excluded, CASE WHEN resolved_bar_ms >= sent_ms THEN net_return_pct / stop_pct END AS reward_r,
  CASE WHEN resolved_bar_ms >= sent_ms THEN stressed_net_return_pct / stop_pct END AS stressed_reward_r
FROM trade_book, {BOUND} WHERE sent_ms >= cutoff AND status IN ('TARGET', 'STOP', 'AMBIGUOUS_LOSS') AND (resolved_bar_ms < sent_ms OR label_available_ms <= now)""",
)


def _ledger(spark, sf):
    """Delivered calls and trades; the borders follow from the delivered calls."""
    book = cut(trade_book(spark, sf))
    sent = book.select("id", "sent_ms")
    first, last = sent.agg(F.min("sent_ms") + 200 * DAY).scalar(), sent.agg(F.max("sent_ms") - 100 * DAY).scalar()
    return sent, joins.reward_join(sent, book.drop("sent_ms"), first, last), first


@query("j12_reward_join", "SELECT id, sent_ms, excluded, round(reward_r, 6) AS reward_r, round(stressed_reward_r, 6) AS stressed_reward_r FROM rewards")
def j12(spark, sf):
    _, r, _ = _ledger(spark, sf)
    return rnd(r.select("id", "sent_ms", "excluded", "reward_r", "stressed_reward_r"), 6)


@query(
    "a13_reward_report",
    f"""SELECT count(reward_r) AS scored_outcomes, count(excluded) AS excluded, count(*) FILTER (WHERE reward_r IS NOT NULL AND status = 'TARGET') AS wins, count(*) FILTER (WHERE reward_r IS NOT NULL AND status <> 'TARGET') AS losses,
  round(sum(reward_r), 6) AS total_reward_r, round(avg(reward_r), 6) AS mean_reward_r, round(sum(stressed_reward_r), 6) AS total_stressed_reward_r, count(*) FILTER (WHERE reward_r IS NOT NULL AND forecast_n >= 30) AS evaluated_forecasts_after_warmup,
  round(avg((forecast_r - reward_r) ** 2) FILTER (WHERE forecast_n >= 30), 6) AS forward_squared_error, round(avg(reward_r ** 2) FILTER (WHERE forecast_n >= 30), 6) AS zero_reward_baseline_squared_error,
  (SELECT count(*) FROM trade_book, {BOUND} WHERE sent_ms >= cutoff) AS sent_calls, (SELECT count(*) FROM trade_book, {BOUND} WHERE sent_ms >= cutoff) - count(*) AS pending FROM rewards""",
)
def a13(spark, sf):
    sent, r, cutoff = _ledger(spark, sf)
    return rnd(cohorts.reward_report(sent, r, cutoff), 6)
