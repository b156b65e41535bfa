"""Queries for projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlytics.catalog.base import HOUR, candidates, cte, more_fields, ms, query, rnd, table
from barlytics.functions import gates, scalar as sc

KEY = ("pair", "scan_ms")

# --- numbers ---------------------------------------------------------------

cte(
    "event_nums",
    "SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS ks, event_type FROM events",
)


def _events(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select(
        "event_id", "value", k.cast("bigint").alias("k"), k.alias("ks"), "event_type"
    )


@query(
    "p01_num",
    """SELECT event_id, TRY_CAST(CASE WHEN k % 5 = 0 THEN concat(ks, 'x') ELSE ks END AS DOUBLE) AS v_null,
  coalesce(TRY_CAST(CASE WHEN k % 5 = 0 THEN concat(ks, 'x') ELSE ks END AS DOUBLE), 0) AS v_zero FROM event_nums""",
)
def p01(spark, sf):
    raw = F.when(F.col("k") % 5 == 0, F.concat("ks", F.lit("x"))).otherwise(F.col("ks"))
    return _events(spark, sf).select("event_id", sc.num(raw).alias("v_null"), sc.num(raw, 0.0).alias("v_zero"))


@query("p02_clamp", "SELECT event_id, greatest(10.0::DOUBLE, least(100.0::DOUBLE, value)) AS v FROM event_nums")
def p02(spark, sf):
    return _events(spark, sf).select("event_id", sc.clamp("value", 10, 100).alias("v"))


@query(
    "p03_pct_change",
    """SELECT event_id, CASE WHEN k - 20 <= 0 THEN 0 ELSE round((value / (k - 20) - 1) * 100, 9) END AS positive_base,
  CASE WHEN k - 20 = 0 THEN 0 ELSE round((value / (k - 20) - 1) * 100, 9) END AS nonzero_base FROM event_nums""",
)
def p03(spark, sf):
    base = F.col("k") - 20
    return rnd(_events(spark, sf).select(
        "event_id", sc.pct_change("value", base).alias("positive_base"),
        sc.pct_change("value", base, "nonzero").alias("nonzero_base"),
    ))


@query("p04_safe_div", "SELECT event_id, CASE WHEN k <> 0 THEN round(value / k, 9) ELSE 0.5 END AS v FROM event_nums")
def p04(spark, sf):
    return rnd(_events(spark, sf).select("event_id", sc.safe_div("value", "k", 0.5).alias("v")))


CAND = "pair, scan_ms"


@query(
    "p05_directed",
    f"""SELECT {CAND}, CASE WHEN bias = 'LONG' THEN spot_volume_1h_usd ELSE -spot_volume_1h_usd END AS keep_null,
  CASE WHEN bias = 'LONG' THEN coalesce(spot_volume_1h_usd, 0) ELSE 0 - coalesce(spot_volume_1h_usd, 0) END AS fill_zero FROM candidates""",
)
def p05(spark, sf):
    return candidates(spark, sf).select(
        *KEY, sc.directed("spot_volume_1h_usd", "bias").alias("keep_null"),
        (sc.directed("spot_volume_1h_usd", "bias", zero_fill=True) + 0.0).alias("fill_zero"),
    )


@query(
    "p06_directional_return",
    f"""SELECT {CAND}, round(CASE WHEN bias = 'SHORT' THEN (1 - current_price / 103) * 100 ELSE (current_price / 103 - 1) * 100 END, 9) + 0.0 AS linear,
  round(CASE WHEN bias = 'SHORT' THEN (103 / current_price - 1) * 100 ELSE (current_price / 103 - 1) * 100 END, 9) + 0.0 AS inverse,
  round(CASE WHEN bias = 'LONG' THEN (current_price / 103 - 1) * 100 ELSE -(current_price / 103 - 1) * 100 END, 9) + 0.0 AS anchor FROM candidates""",
)
def p06(spark, sf):
    e = F.lit(103.0)
    return rnd(candidates(spark, sf).select(
        *KEY, sc.directional_return(e, "current_price", "bias").alias("linear"),
        sc.directional_return(e, "current_price", "bias", "inverse").alias("inverse"),
        sc.move_from_anchor(e, "current_price", "bias").alias("anchor"),
    ))


@query(
    "p07_trade_levels",
    f"""SELECT {CAND}, round(current_price * CASE WHEN bias = 'SHORT' THEN 0.95 ELSE 1.05 END, 6) AS tp,
  round(current_price * CASE WHEN bias = 'SHORT' THEN 1.06 ELSE 0.94 END, 6) AS sl FROM candidates""",
)
def p07(spark, sf):
    tp, sl = sc.trade_levels("current_price", "bias", 5.0, 6.0)
    return rnd(candidates(spark, sf).select(*KEY, tp.alias("tp"), sl.alias("sl")), 6)


@query(
    "p08_format_price",
    """SELECT event_id, CASE WHEN p >= 100 THEN printf('%.2f', p) WHEN p >= 1 THEN printf('%.4f', p)
  WHEN p >= 0.01 THEN printf('%.6f', p) ELSE printf('%.8f', p) END AS shown
FROM (SELECT event_id, value / 7 * CASE k % 4 WHEN 0 THEN 100 WHEN 1 THEN 1 WHEN 2 THEN 0.01 ELSE 0.0001 END::DOUBLE AS p FROM event_nums)""",
)
def p08(spark, sf):
    m = F.col("k") % 4
    p = F.col("value") / 7 * F.when(m == 0, 100.0).when(m == 1, 1.0).when(m == 2, 0.01).otherwise(0.0001)
    return _events(spark, sf).select("event_id", sc.format_price(p).alias("shown"))


@query("p09_select_snapshot", f"SELECT {CAND}, bias, score, current_price, array_to_string(warnings, ';') AS warnings, CASE WHEN score >= 78 THEN 'STRONG' ELSE 'WEAK' END AS strength, oi_change_1h_pct / 8 AS funding_rate_pct, oi_change_24h_pct / 4 AS basis_pct, 'void below ' || pair AS invalidation FROM candidates")
def p09(spark, sf):
    df = candidates(spark, sf).withColumns(more_fields())
    wanted = ["bias", "score", "current_price", "strength", "funding_rate_pct", "basis_pct", "invalidation", "open_interest_usd", "warnings"]
    return df.select(*KEY, sc.snapshot(df.columns, wanted).alias("s")).select(*KEY, "s.*").withColumn(
        "warnings", F.array_join("warnings", ";")
    )


# --- candidate gates -------------------------------------------------------

FLOW, BS, VOL = "spot_net_flow_1h_usd", "spot_buy_sell_ratio_1h", "spot_volume_1h_usd"


def deep_sql(sign: str) -> str:
    return f"""coalesce({sign} price_change_24h_futures_pct <= -8, false) OR (coalesce(oi_change_24h_pct <= -8, false)
  AND ({sign} price_change_4h_spot_pct IS NULL OR {sign} price_change_4h_spot_pct < 1))"""


def regime_sql(sign: str) -> str:
    votes = f"""(coalesce({sign} price_change_4h_spot_pct >= 0.5, false)::INT + coalesce({sign} price_change_24h_futures_pct >= -2, false)::INT
  + coalesce(oi_change_4h_pct >= 0, false)::INT + coalesce(oi_change_24h_pct >= 0, false)::INT)"""
    return f"CASE WHEN {deep_sql(sign)} THEN 'COUNTERTREND_DEEP' WHEN {votes} >= 3 THEN 'TREND_CONTINUATION' ELSE 'COUNTERTREND' END"


def spot_sql(bias: str) -> str:
    return f"coalesce({FLOW} > 0 AND {BS} >= 1.05, false)" if bias == "LONG" else f"coalesce({FLOW} < 0 AND {BS} <= 0.95, false)"


def reversal_sql(bias: str) -> str:
    return f"coalesce({FLOW} < 0 AND {BS} < 0.95, false)" if bias == "LONG" else f"coalesce({FLOW} > 0 AND {BS} > 1.05, false)"


def tally_sql(bias: str) -> tuple[str, str]:
    s = "" if bias == "LONG" else "-"
    bad = f"((NOT {spot_sql(bias)})::INT + coalesce(oi_change_4h_pct < 0, false)::INT + coalesce({s} price_change_4h_spot_pct < 0, false)::INT)"
    severe = f"(coalesce(oi_change_24h_pct < -8, false)::INT + coalesce({s} price_change_24h_futures_pct < -8, false)::INT + ({deep_sql(s)})::INT)"
    return bad, severe


def by_bias(long: str, short: str) -> str:
    return f"CASE WHEN bias = 'LONG' THEN {long} ELSE {short} END"


LB, LS = tally_sql("LONG")
SB, SS = tally_sql("SHORT")
cte(
    "gate_cols",
    f"""SELECT *, len(list_filter(warnings, lambda w: lower(w) LIKE '%low open interest%')) > 0 AS low_oi,
  CASE WHEN len(list_filter(warnings, lambda w: lower(w) LIKE '%low open interest%')) > 0 THEN 82.0 ELSE 78.0 END::DOUBLE AS req,
  CASE WHEN len(list_filter(warnings, lambda w: lower(w) LIKE '%low open interest%')) > 0 THEN 100000 ELSE 50000 END AS min_vol,
  {spot_sql('LONG')} AS spot_long, {spot_sql('SHORT')} AS spot_short, {by_bias(spot_sql('LONG'), spot_sql('SHORT'))} AS spot,
  {reversal_sql('LONG')} AS rev_long, {reversal_sql('SHORT')} AS rev_short,
  coalesce(oi_change_15m_pct <= -0.25, false) AND {reversal_sql('LONG')} AS inv_long,
  coalesce(oi_change_15m_pct <= -0.25, false) AND {reversal_sql('SHORT')} AS inv_short,
  {by_bias(regime_sql(''), regime_sql('-'))} AS regime, {regime_sql('')} AS regime_long, {regime_sql('-')} AS regime_short,
  {LB} AS bad_long, {LS} AS severe_long, {SB} AS bad_short, {SS} AS severe_short,
  {by_bias('price_change_1h_spot_pct', '-price_change_1h_spot_pct')} >= 4 AS is_chased,
  {by_bias('price_change_4h_spot_pct', '-price_change_4h_spot_pct')} >= 0.5 AND oi_change_4h_pct >= 0
    AND (oi_change_24h_pct IS NULL OR oi_change_24h_pct > -8) AS reclaims,
  concat(CAST(round(CAST(score AS DECIMAL(18,4)), 1) AS VARCHAR)) AS score_text
FROM candidates""",
)


def nums(mid: str) -> str:
    return f"concat(' {mid} (ratio ', printf('%.3f', {BS}), ', flow ', format('{{:,}}', CAST(round({FLOW}) AS BIGINT)), ')')"


LIQ_TEXT = f"""CASE WHEN {VOL} IS NULL THEN 'spot turnover unknown' WHEN {VOL} < min_vol THEN
  concat('spot turnover ', format('{{:,}}', CAST(round({VOL}) AS BIGINT)), ', at least ', format('{{:,}}', min_vol), ' asked') END"""
SPOT_TEXT = f"CASE WHEN NOT spot THEN concat(lower(bias), {nums('lacks spot backing')}) END"
SCORE_TEXT = "CASE WHEN score < req THEN concat('score ', score_text, ', asked ', req) END"
BLOCK_TEXT = "CASE WHEN len(blockers) > 0 THEN 'blockers are set' END"


def texts(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


ENTRY = texts(SCORE_TEXT, BLOCK_TEXT, f"CASE WHEN NOT spot THEN concat(lower(bias), {nums('not backed by spot')}) END",
              "CASE WHEN NOT oi_change_15m_pct > 0 THEN 'no growth of 15m open interest' END")
BASE = texts(SCORE_TEXT, BLOCK_TEXT, SPOT_TEXT, "CASE WHEN NOT oi_change_15m_pct > 0 THEN '15m open interest does not grow' END", LIQ_TEXT)
HEALTH = texts(
    "CASE WHEN score < req - 6 THEN concat('score ', score_text, ', to persist ', req - 6) END", BLOCK_TEXT, SPOT_TEXT,
    "CASE WHEN NOT oi_change_15m_pct > -0.25 THEN '15m open interest shrinks' END", LIQ_TEXT,
)


@query("p10_low_oi", f"SELECT {CAND}, low_oi, req AS required_score FROM gate_cols")
def p10(spark, sf):
    return candidates(spark, sf).select(
        *KEY, sc.low_oi("warnings").alias("low_oi"), gates.required_score(78.0).alias("required_score")
    )


@query("p11_spot_ok", f"SELECT {CAND}, spot AS ok, {SPOT_TEXT} AS reason FROM gate_cols")
def p11(spark, sf):
    return candidates(spark, sf).select(*KEY, gates.spot_ok("bias").alias("ok"), gates.spot_reason("bias").alias("reason"))


@query("p12_oi_expanding", f"SELECT {CAND}, oi_change_15m_pct > 0 AS ok FROM candidates")
def p12(spark, sf):
    return candidates(spark, sf).select(*KEY, gates.oi_expanding().alias("ok"))


@query("p13_liquidity_ok", f"SELECT {CAND}, coalesce({VOL} >= min_vol, false) AS ok, {LIQ_TEXT} AS reason FROM gate_cols")
def p13(spark, sf):
    return candidates(spark, sf).select(*KEY, gates.liquidity_ok().alias("ok"), gates.liquidity_reason().alias("reason"))


def _gate(name: str, sql_items: str, fn, with_score: bool = True):
    score = ", req AS required_score" if with_score else ""
    sql = f"SELECT {CAND}, len({sql_items}) = 0 AS ok{score}, array_to_string({sql_items}, '; ') AS reasons FROM gate_cols"

    def run(spark, sf):
        g = fn()
        cols = [g["ok"].alias("ok")] + ([g["required_score"].alias("required_score")] if with_score else [])
        return candidates(spark, sf).select(*KEY, *cols, F.array_join(g["reasons"], "; ").alias("reasons"))

    query(name, sql)(run)


_gate("p14_entry_gate", ENTRY, lambda: gates.entry_gate(78.0))
_gate("p15_base_quality", BASE, lambda: gates.base_quality("bias", 78.0))
_gate("p16_structural_health", HEALTH, lambda: gates.structural_health("bias", gates.required_score(78.0)), False)


@query("p17_formal_invalidation", f"SELECT {CAND}, inv_long, inv_short, rev_long, rev_short FROM gate_cols")
def p17(spark, sf):
    side = lambda fn, b: fn(F.lit(b))
    return candidates(spark, sf).select(
        *KEY, side(gates.formal_invalidation, "LONG").alias("inv_long"), side(gates.formal_invalidation, "SHORT").alias("inv_short"),
        side(gates.spot_reversal, "LONG").alias("rev_long"), side(gates.spot_reversal, "SHORT").alias("rev_short"),
    )


@query(
    "p18_evidence_fingerprint",
    """SELECT count(*) AS rows, count(DISTINCT (pair, current_price, spot_buy_sell_ratio_1h, spot_net_flow_1h_usd, coalesce(spot_volume_1h_usd, -1),
  oi_change_15m_pct, oi_change_1h_pct, price_change_1h_spot_pct)) AS prints FROM candidates""",
)
def p18(spark, sf):
    df = candidates(spark, sf).select("pair", gates.evidence_fingerprint().alias("fp"))
    per = df.groupBy("pair", "fp").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("prints"))


@query("p19_anti_chase_flag", f"SELECT {CAND}, is_chased AS chased FROM gate_cols")
def p19(spark, sf):
    return candidates(spark, sf).select(*KEY, gates.chased("bias").alias("chased"))


@query("p20_candidate_regime", f"SELECT {CAND}, regime, reclaims FROM gate_cols")
def p20(spark, sf):
    return candidates(spark, sf).select(*KEY, gates.candidate_regime("bias").alias("regime"), gates.reclaim_ok("bias").alias("reclaims"))


def position_sql(bias: str, entry: str) -> str:
    t = bias.lower()
    move = f"({'' if bias == 'LONG' else '-'}(current_price / {entry} - 1) * 100 >= 0)"
    return f"""CASE WHEN severe_{t} >= 2 AND NOT spot_{t} THEN 'EXIT_THESIS_BROKEN' WHEN bad_{t} >= 3 OR (severe_{t} >= 1 AND bad_{t} >= 2) THEN 'REDUCE'
  WHEN bad_{t} >= 1 OR regime_{t} <> 'TREND_CONTINUATION' THEN 'HOLD_PROTECT' WHEN {move} THEN 'HOLD_STRONG' ELSE 'HOLD' END"""


@query(
    "p21_position_state",
    f"SELECT {CAND}, {position_sql('LONG', '103')} AS long_state, {position_sql('SHORT', '103')} AS short_state FROM gate_cols",
)
def p21(spark, sf):
    state = lambda b: gates.position_state(F.lit(b), F.lit(103.0))
    return candidates(spark, sf).select(*KEY, state("LONG").alias("long_state"), state("SHORT").alias("short_state"))


@query(
    "p22_fresh",
    f"""SELECT event_id, t - now_ms AS skew, t > 0 AND (now_ms - t) / 1000.0 BETWEEN -60 AND 240 AND k * 2 <= 130 AS fresh FROM (
  SELECT e.event_id, epoch_us(e.ts) // 1000 AS t, k, (epoch_us(e.ts) // 1000) - (epoch_us(e.ts) // 1000) % {HOUR} + 300000 AS now_ms
  FROM events e JOIN event_nums n ON e.event_id = n.event_id)""",
)
def p22(spark, sf):
    df = table(spark, sf, "events").select("event_id", ms("ts").alias("t"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    df = df.withColumn("now_ms", F.col("t") - F.pmod("t", F.lit(HOUR)) + 300_000)
    return df.select("event_id", (F.col("t") - F.col("now_ms")).alias("skew"), gates.fresh("t", F.col("k") * 2, "now_ms").alias("fresh"))


FEATURES = ["oi_change_15m_pct", "oi_change_1h_pct", "oi_change_4h_pct", "price_change_1h_spot_pct", "spot_buy_sell_ratio_1h", "score"]
VECTOR = ", ".join(f"greatest(-3.0::DOUBLE, least(3.0::DOUBLE, {c} / {s}.0::DOUBLE))" for c, s in zip(FEATURES, (10, 20, 30, 5, 3, 100)))


@query(
    "p23_feature_vector",
    f"""SELECT {CAND}, CASE WHEN spot_volume_1h_usd IS NOT NULL THEN round(list_sum([1.0::DOUBLE, {VECTOR}]), 9) END AS total,
  CASE WHEN spot_volume_1h_usd IS NOT NULL THEN 7 END AS size FROM candidates""",
)
def p23(spark, sf):
    # A row without spot volume plays the row with a missing feature.
    df = candidates(spark, sf).withColumn("score", F.when(F.col("spot_volume_1h_usd").isNotNull(), F.col("score")))
    df = df.withColumn("x", sc.feature_vector(FEATURES, (10, 20, 30, 5, 3, 100)))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return rnd(df.select(*KEY, total.alias("total"), F.when(F.col("x").isNotNull(), F.size("x")).alias("size")))


DRIFT = "CASE WHEN bias = 'SHORT' THEN (103 / current_price - 1) * 100 ELSE (current_price / 103 - 1) * 100 END"
BUCKET = "CASE WHEN d < 0 THEN 'against_trigger' WHEN d < 0.5 THEN '0_to_0.5' WHEN d < 1 THEN '0.5_to_1' WHEN d < 2 THEN '1_to_2' WHEN d < 3 THEN '2_to_3' WHEN d < 5 THEN '3_to_5' ELSE '5_plus' END"


@query("p24_drift_bucket", f"SELECT bucket, count(*) AS n FROM (SELECT {BUCKET} AS bucket FROM (SELECT {DRIFT} AS d FROM candidates)) GROUP BY bucket")
def p24(spark, sf):
    d = sc.directional_return(F.lit(103.0), "current_price", "bias", "inverse")
    return candidates(spark, sf).groupBy(sc.drift_bucket(d).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p25_quality_bucket",
    f"""SELECT {CAND}, CASE WHEN score < 50 THEN '0-49' WHEN score < 60 THEN '50-59' WHEN score < 70 THEN '60-69' WHEN score < 80 THEN '70-79' ELSE '80-100' END AS half_open,
  CASE WHEN score BETWEEN 0 AND 49 THEN '0-49' WHEN score BETWEEN 50 AND 59 THEN '50-59' WHEN score BETWEEN 60 AND 69 THEN '60-69'
    WHEN score BETWEEN 70 AND 79 THEN '70-79' WHEN score BETWEEN 80 AND 100 THEN '80-100' ELSE 'other' END AS closed FROM candidates""",
)
def p25(spark, sf):
    return candidates(spark, sf).select(
        *KEY, sc.quality_bucket("score").alias("half_open"), sc.quality_bucket("score", "closed").alias("closed")
    )


@query(
    "p26_evaluate_entry_drift",
    f"""SELECT {CAND}, d >= 5 OR d <= -6 AS blocked, CASE WHEN d >= 5 THEN 'already beyond the target'
  WHEN d <= -6 THEN 'already beyond the stop'
  ELSE 'drift noted, no limit in force' END AS reason,
  round(d, 4) + 0.0 AS directional_drift_pct, {BUCKET} AS drift_bucket FROM (SELECT {CAND}, {DRIFT} AS d FROM candidates)""",
)
def p26(spark, sf):
    d = sc.directional_return(F.lit(103.0), "current_price", "bias", "inverse")
    return candidates(spark, sf).withColumns(sc.late_against(d, F.lit(5.0), F.lit(6.0))).select(
        *KEY, "blocked", "reason", "directional_drift_pct", "drift_bucket"
    )


# Signals against the next scan of the same pair, which plays the live pool.
cte(
    "signals_next",
    f"""SELECT *, lead(bias) OVER z AS pool_bias, lead(current_price) OVER z AS pool_price, lead(spot_volume_1h_usd) OVER z * 1000 AS pool_volume,
  lead(CASE WHEN oi_change_15m_pct > 0 THEN 'CONTINUATION_TRIGGER' ELSE 'TREND_ONLY' END) OVER z AS pool_state,
  lead(scan_ms) OVER z AS next_ms, lead(price_change_1h_spot_pct) OVER z AS lead_change,
  (SELECT min(scan_ms) FROM candidates) + {24 * HOUR} AS start_ms
FROM candidates WINDOW z AS (PARTITION BY pair ORDER BY scan_ms)""",
)


def signals_next(spark, sf):
    from barlytics.operators.blocks import prefix
    from barlytics.operators.grid import floor_bucket
    from barlytics.session import cut

    df = cut(candidates(spark, sf))
    state = F.when(F.col("oi_change_15m_pct") > 0, "CONTINUATION_TRIGGER").otherwise("TREND_ONLY")
    live = F.struct(
        F.col("bias").alias("pool_bias"), F.col("current_price").alias("pool_price"),
        (F.col("spot_volume_1h_usd") * 1000).alias("pool_volume"), state.alias("pool_state"),
        F.col("scan_ms").alias("next_ms"), F.col("price_change_1h_spot_pct").alias("lead_change"),
    )
    # The next row is the one before in reversed time.
    back = df.withColumns({"_live": live, "_rev": -F.col("scan_ms")})
    seen = prefix(back, ["pair"], "_rev", floor_bucket("_rev", 4096 * HOUR), {"_next": ("_live", "lag")})
    start = df.agg(F.min("scan_ms") + 24 * HOUR).scalar()
    return seen.select(*df.columns, "_next.*").withColumn("start_ms", start)


ELIGIBLE = f"""CASE WHEN bias <> 'SHORT' THEN 'not a short' WHEN scan_ms < start_ms THEN 'older than the start'
  WHEN NOT coalesce(next_ms - scan_ms BETWEEN 0 AND {2 * HOUR}, false) THEN 'trigger time out of range'
  WHEN pool_bias IS NULL THEN 'symbol not in the pool'
  WHEN pool_bias <> 'SHORT' OR pool_state <> 'CONTINUATION_TRIGGER' THEN 'setup is over'
  WHEN pool_volume IS NULL THEN 'pool row without usable numbers' WHEN abs(pool_price / current_price - 1) * 100 > 2 THEN 'price too far from the entry'
  WHEN pool_volume < 10000000 THEN 'turnover too small' WHEN NOT lead_change <= 4 THEN 'lead symbol against it or unknown' END"""


@query("p27_signal_eligible", f"SELECT {CAND}, r AS reason, r IS NULL AS ok FROM (SELECT {CAND}, {ELIGIBLE} AS r FROM signals_next)")
def p27(spark, sf):
    df = signals_next(spark, sf).withColumns(
        {"timestamp_ms": F.col("scan_ms"), "trigger_price": F.col("current_price"), "last_alert_ms": F.lit(None).cast("bigint")}
    )
    df = df.drop("scan_ms").withColumn("scan_ms", F.col("next_ms"))
    now = F.col("next_ms")
    start = F.col("start_ms")
    why = sc.short_signal_reason(now, start, 2 * HOUR, 2.0)
    out = df.select("pair", F.col("timestamp_ms").alias("scan_ms"), why.alias("reason"))
    return out.withColumn("ok", F.col("reason").isNull())


@query(
    "p27_paper_signal_eligible",
    f"""SELECT {CAND}, CASE WHEN scan_ms < start_ms THEN 'older than the start' WHEN bias <> 'LONG' THEN 'trade is not open'
  WHEN NOT next_ms - scan_ms BETWEEN 0 AND {HOUR} THEN 'entered too long ago' WHEN pool_price IS NULL THEN 'current price unusable'
  WHEN abs(pool_price / current_price - 1) * 100 > 2 THEN 'price too far from the entry' END AS reason FROM signals_next""",
)
def p27b(spark, sf):
    df = signals_next(spark, sf)
    status = F.when(F.col("bias") == "LONG", "OPEN").otherwise("STOP")
    df = df.select(
        "pair", "scan_ms", "start_ms", "next_ms", status.alias("status"), F.col("scan_ms").alias("predicted_ms"),
        F.col("scan_ms").alias("entry_ms"), F.col("current_price").alias("entry_price"), F.col("pool_price").alias("current_price"),
    )
    return df.select("pair", "scan_ms", sc.paper_signal_reason("next_ms", F.col("start_ms"), HOUR, 2.0).alias("reason"))


@query(
    "p28_with_default_params",
    "SELECT pair, scan_ms, (SELECT coalesce(TRY_CAST(min(r_name) AS DOUBLE), 5) FROM region) AS target_pct, (SELECT CAST(max(r_regionkey) + 2 AS DOUBLE) FROM region) AS live_stop_pct FROM candidates",
)
def p28(spark, sf):
    cfg = table(spark, sf, "region").agg(F.min("r_name").alias("target_pct"), (F.max("r_regionkey") + 2).alias("live_stop_pct"))
    return sc.with_default_params(candidates(spark, sf).select(*KEY), cfg, {"target_pct": 5.0, "live_stop_pct": 6.0})
