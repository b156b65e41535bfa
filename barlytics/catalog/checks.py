"""Queries for data-quality checks, admission logs, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlytics.catalog.base import COARSE, DAY, FINE, HOUR, LEAD, SECOND, TINY, bars, candidates, cte, frames, query, rnd, scored, stored_bars, table
from barlytics.catalog.market import RS, context, scored_setups
from barlytics.catalog.scalars import CAND, KEY
from barlytics.catalog.series import core
from barlytics.operators import cohorts, grid, joins, quality as q
from barlytics.operators.indicators import numbered
from barlytics.plans import setups as plan
from barlytics.session import cut

# --- bar audit: bars with planted faults -----------------------------------

cte(
    "faulty",
    """SELECT symbol, '1d' AS interval, open_time_ms, open, CASE WHEN trades % 7 = 0 THEN low - 1 ELSE high END AS high, low, close,
  CASE WHEN trades % 11 = 0 THEN -volume ELSE volume END AS volume, quote_volume FROM tiny_bars""",
)
cte("faulty_all", "SELECT * FROM faulty UNION ALL SELECT f.* FROM faulty f JOIN tiny_bars b ON f.symbol = b.symbol AND f.open_time_ms = b.open_time_ms WHERE b.trades % 13 = 0 AND b.symbol <> 'S2'")
cte("faulty_seq", "SELECT *, open_time_ms - lag(open_time_ms) OVER (PARTITION BY symbol ORDER BY open_time_ms) AS delta FROM faulty_all")
cte(
    "faults",
    f"""SELECT symbol, interval, open_time_ms, delta, unnest(list_filter([CASE WHEN delta = 0 THEN 'DUPLICATE' END, CASE WHEN delta <> {DAY} THEN 'GAP_OR_BAD_STEP' END,
  CASE WHEN least(open, high, low, close) <= 0 OR high < greatest(open, close) OR low > least(open, close) OR high < low THEN 'BAD_OHLC' END, CASE WHEN volume < 0 OR quote_volume < 0 THEN 'NEGATIVE_VOLUME' END], lambda x: x IS NOT NULL)) AS code FROM faulty_seq""",
)
cte(
    "audit",
    f"""SELECT *, CASE WHEN error_count = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT r.symbol, r.interval, expected_rows, actual_rows, actual_rows <> expected_rows AS row_count_error, coalesce(e.n, 0) + (actual_rows <> expected_rows)::INT AS error_count
FROM (SELECT symbol, interval, count(*) AS actual_rows, (SELECT (max(open_time_ms) - min(open_time_ms)) // {DAY} + 1 FROM tiny_bars) AS expected_rows FROM faulty_all GROUP BY ALL) r LEFT JOIN (SELECT symbol, count(*) AS n FROM faults GROUP BY symbol) e ON r.symbol = e.symbol)""",
)


def faulty(spark, sf):
    b = stored_bars(spark, sf, TINY).withColumn("interval", F.lit("1d"))
    n = F.col("trades")
    again = b.filter((n % 13 == 0) & (F.col("symbol") != "S2"))
    f = b.unionByName(again).withColumns(
        {"high": F.when(n % 7 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.when(n % 11 == 0, -F.col("volume")).otherwise(F.col("volume"))}
    )
    span = b.agg((F.floor((F.max("open_time_ms") - F.min("open_time_ms")) / DAY) + 1).alias("n")).scalar()
    return f, f.select("symbol", "interval").distinct().withColumn("expected_rows", span)


@query("q01_audit_bars", "SELECT symbol, interval, expected_rows, actual_rows, row_count_error, error_count, status FROM audit")
def q01(spark, sf):
    return q.audit_bars(*_args(faulty(spark, sf)))[0]


def _args(pair):
    return pair[0], TINY, pair[1]


@query(
    "q01_first_faults",
    f"""SELECT symbol, interval, code, count(*) AS n, min(open_time_ms) AS first_ms FROM (
  SELECT symbol, interval, pos, open_time_ms, unnest(list_filter([CASE WHEN delta = 0 THEN 'DUPLICATE' END, CASE WHEN delta <> {DAY} THEN 'GAP_OR_BAD_STEP' END,
   CASE WHEN least(open, high, low, close) <= 0 OR high < greatest(open, close) OR low > least(open, close) OR high < low THEN 'BAD_OHLC' END, CASE WHEN volume < 0 OR quote_volume < 0 THEN 'NEGATIVE_VOLUME' END], lambda x: x IS NOT NULL)) AS code
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) AS pos FROM faulty_seq)) GROUP BY ALL""",
)
def q01b(spark, sf):
    faults = q.audit_bars(*_args(faulty(spark, sf)))[1]
    return faults.groupBy("symbol", "interval", "code").agg(F.count(F.lit(1)).alias("n"), F.min("open_time_ms").alias("first_ms"))


@query("q02_eligible_symbols", "SELECT symbol, status = 'PASS' AS eligible, error_count AS errors FROM audit")
def q02(spark, sf):
    return q.eligible_symbols(q.audit_bars(*_args(faulty(spark, sf)))[0])


@query(
    "q02_universe_status",
    f"""SELECT complete_symbol_count, total_errors, critical_missing, CASE WHEN complete_symbol_count >= least(45, total) AND critical_missing = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
  SELECT count(*) FILTER (WHERE status = 'PASS') AS complete_symbol_count, CAST(sum(error_count) AS BIGINT) AS total_errors, count(*) AS total, count(*) FILTER (WHERE symbol IN ('{LEAD}', '{SECOND}') AND status <> 'PASS') AS critical_missing FROM audit)""",
)
def q02b(spark, sf):
    symbols = cut(q.eligible_symbols(q.audit_bars(*_args(faulty(spark, sf)))[0]))
    critical = symbols.filter(F.col("symbol").isin(LEAD, SECOND)).select("symbol")
    return q.universe_status(symbols, critical)


# --- scan audits -----------------------------------------------------------

cte(
    "pools",
    """SELECT scan_ms, CASE WHEN oi_change_15m_pct = -3 THEN NULL ELSE concat('Q', CAST(substr(pair, 2) AS INT) % 17) END AS symbol, current_price - 100.5 AS price,
  CASE WHEN bias = 'SHORT' THEN spot_net_flow_1h_usd ELSE 1000 END AS quote_volume_24h, CASE WHEN oi_change_15m_pct = 4 THEN NULL ELSE CAST(floor(score) AS BIGINT) % 40 END AS activity_rank FROM candidates""",
)
cte("declared", f"SELECT scan_ms, count(*) + CASE WHEN (scan_ms // {HOUR}) % 5 = 0 THEN 1 ELSE 0 END AS declared_count FROM pools GROUP BY scan_ms")
POOL_SQL = """SELECT scan_ms, symbol, 'SYMBOL_MISSING' AS code FROM pools WHERE symbol IS NULL UNION ALL SELECT scan_ms, symbol, 'PRICE_INVALID' FROM pools WHERE symbol IS NOT NULL AND NOT price > 0
UNION ALL SELECT scan_ms, symbol, 'VOLUME_INVALID' FROM pools WHERE symbol IS NOT NULL AND NOT quote_volume_24h >= 0 UNION ALL SELECT scan_ms, symbol, 'ACTIVITY_RANK_INVALID' FROM pools WHERE symbol IS NOT NULL AND activity_rank IS NULL
UNION ALL SELECT p.scan_ms, NULL, 'ANALYSIS_POOL_COUNT_MISMATCH' FROM (SELECT scan_ms, count(*) AS n FROM pools GROUP BY scan_ms) p JOIN declared d ON p.scan_ms = d.scan_ms WHERE d.declared_count <> n
UNION ALL SELECT scan_ms, NULL, 'DUPLICATE_SYMBOLS' FROM pools GROUP BY scan_ms HAVING count(symbol) > count(DISTINCT symbol)
UNION ALL SELECT scan_ms, NULL, 'DUPLICATE_ACTIVITY_RANK' FROM pools GROUP BY scan_ms HAVING count(activity_rank) FILTER (WHERE symbol IS NOT NULL) = count(*) AND count(DISTINCT activity_rank) < count(*)"""


def pools(spark, sf):
    c = candidates(spark, sf)
    pool = cut(c.select(
        "scan_ms",
        F.when(F.col("oi_change_15m_pct") == -3, None).otherwise(F.concat(F.lit("Q"), (F.substring("pair", 2, 9).cast("int") % 17).cast("string"))).alias("symbol"),
        (F.col("current_price") - 100.5).alias("price"),
        F.when(F.col("bias") == "SHORT", F.col("spot_net_flow_1h_usd")).otherwise(1000.0).alias("quote_volume_24h"),
        F.when(F.col("oi_change_15m_pct") == 4, None).otherwise(F.floor("score") % 40).alias("activity_rank"),
    ))
    extra = F.when(F.floor(F.col("scan_ms") / HOUR) % 5 == 0, 1).otherwise(0)
    return pool, pool.groupBy("scan_ms").agg(F.count(F.lit(1)).alias("n")).select("scan_ms", (F.col("n") + extra).alias("declared_count"))


@query("q03_audit_pool", POOL_SQL)
def q03(spark, sf):
    return q.audit_pool(*pools(spark, sf)).select("scan_ms", "symbol", "code")


cte(
    "odd_context",
    f"""SELECT asof_ms, CASE WHEN s % 11 = 0 THEN NULL ELSE liquid_universe_count END AS n, advancers_24h + CASE WHEN s % 7 = 0 THEN 1 ELSE 0 END AS adv, decliners_24h AS de, unchanged_24h AS fl,
  breadth_positive_pct + CASE WHEN s % 5 = 0 THEN 0.5 ELSE 0 END AS breadth FROM (SELECT *, asof_ms // {FINE} AS s FROM context)""",
)


def odd_context(spark, sf):
    s = F.floor(F.col("asof_ms") / FINE)
    return context(spark, sf).withColumns(
        {"liquid_universe_count": F.when(s % 11 == 0, None).otherwise(F.col("liquid_universe_count")),
         "advancers_24h": F.col("advancers_24h") + F.when(s % 7 == 0, 1).otherwise(0),
         "breadth_positive_pct": F.col("breadth_positive_pct") + F.when(s % 5 == 0, 0.5).otherwise(0.0)}
    )


CTX_SQL = """SELECT asof_ms, 'MARKET_COUNTS_INVALID' AS code FROM odd_context WHERE n IS NULL UNION ALL SELECT asof_ms, 'MARKET_COUNTS_DONT_SUM' FROM odd_context WHERE adv + de + fl <> n
UNION ALL SELECT asof_ms, 'BREADTH_MISMATCH' FROM odd_context WHERE n > 0 AND NOT abs(round(100.0 * adv / n, 2) - breadth) <= greatest(1e-4 * greatest(abs(round(100.0 * adv / n, 2)), abs(breadth)), 1e-4)"""


@query("q04_audit_context", CTX_SQL)
def q04(spark, sf):
    return q.audit_context(odd_context(spark, sf)).select("asof_ms", "code")


@query(
    "q08_audit_status",
    f"SELECT count(*) AS errors, 0::BIGINT AS warnings, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ({CTX_SQL})",
)
def q08(spark, sf):
    return q.audit_status(q.audit_context(odd_context(spark, sf)))


# Saved rankings: the true ones with some scores, prices and ranks spoiled.
SPOIL = {"score": 6, "price": 9, "rank": 10}
cte(
    "saved_rank",
    f"""SELECT *, rk AS ordinal, swing_quality_score_v1 + CASE WHEN m % 6 = 0 THEN 7 ELSE 0 END AS saved_score, price + CASE WHEN m % 9 = 0 THEN 1 ELSE 0 END AS saved_price, rk + CASE WHEN m % 10 = 0 THEN 1 ELSE 0 END AS saved_rk,
  CASE WHEN m % 8 = 0 THEN 'X' ELSE symbol END AS saved_symbol FROM (SELECT *, pos AS m, row_number() OVER (PARTITION BY asof_ms ORDER BY swing_quality_score_v1 DESC, symbol) AS rk FROM scored_rows WHERE bias <> 'NEUTRAL')""",
)
cte(
    "found_rank",
    "SELECT *, row_number() OVER z AS want, lag(saved_score) OVER z AS above FROM saved_rank WHERE saved_symbol <> 'X' WINDOW z AS (PARTITION BY asof_ms ORDER BY ordinal)",
)


@query(
    "q05_audit_rankings",
    """SELECT code, count(*) AS n FROM (SELECT 'RANKED_SYMBOL_NOT_IN_POOL' AS code FROM saved_rank WHERE saved_symbol = 'X' UNION ALL SELECT 'RANK_SOURCE_FIELD_MISMATCH' FROM found_rank WHERE saved_price <> price
UNION ALL SELECT 'QUALITY_SCORE_MISMATCH' FROM found_rank WHERE saved_score <> swing_quality_score_v1 UNION ALL SELECT 'QUALITY_RANK_SEQUENCE_INVALID' FROM found_rank WHERE saved_rk <> want
UNION ALL SELECT 'QUALITY_SORT_INVALID' FROM found_rank WHERE saved_score > above) GROUP BY code""",
)
def q05(spark, sf):
    rows = scored_setups(spark, sf).withColumns({"scan_ms": F.col("asof_ms"), "activity_rank": F.col("pos")})
    rows = cut(rows)
    ranked = plan.rank_by(rows.filter("bias <> 'NEUTRAL'").withColumn("_t", F.lit(1)), ["scan_ms"], "swing_quality_score_v1", "_t")
    m = F.col("pos")
    saved = ranked.withColumn("ordinal", F.col("swing_quality_rank_v1")).withColumns(
        {
            "swing_quality_score_v1": F.col("swing_quality_score_v1") + F.when(m % 6 == 0, 7.0).otherwise(0.0),
            "price": F.col("price") + F.when(m % 9 == 0, 1.0).otherwise(0.0),
            "swing_quality_rank_v1": F.col("swing_quality_rank_v1") + F.when(m % 10 == 0, 1).otherwise(0),
            "symbol": F.when(m % 8 == 0, "X").otherwise(F.col("symbol")),
        }
    )
    return q.audit_rankings(saved, rows).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q06_audit_staleness",
    f"""SELECT log, unnest(list_filter([CASE WHEN now - g > {2 * FINE} THEN 'STALE' END, CASE WHEN state <> b THEN 'STATE_BUCKET_MISMATCH' END], lambda x: x IS NOT NULL)) AS code FROM (
  SELECT concat(event_type, '-', user_id) AS log, max(epoch_us(ts) // 1000) AS g, max(epoch_us(ts) // 1000) - max(epoch_us(ts) // 1000) % {FINE} AS b, max(epoch_us(ts) // 1000) - max(epoch_us(ts) // 1000) % {FINE} + (count(*) % 2) * {FINE} AS state,
    (SELECT max(epoch_us(ts) // 1000) FROM events) AS now FROM events GROUP BY event_type, user_id)""",
)
def q06(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("log"), F.unix_millis(F.col("ts").cast("timestamp")).alias("generated_at_ms")
    )
    bucket = grid.floor_bucket("generated_at_ms", FINE)
    latest = e.groupBy("log").agg(F.max("generated_at_ms").alias("generated_at_ms"), F.count(F.lit(1)).alias("n")).withColumns(
        {"bucket_start_ms": bucket, "state_bucket_ms": bucket + (F.col("n") % 2) * FINE}
    )
    return q.audit_staleness(latest, e.agg(F.max("generated_at_ms")).scalar(), FINE).select("log", "code")


@query(
    "q07_audit_objective",
    "SELECT o_orderkey AS scan_ms, unnest(list_filter([CASE WHEN o_orderstatus <> 'O' THEN 'holding_window' END, CASE WHEN o_orderpriority <> '5-LOW' THEN 'target_move' END], lambda x: x IS NOT NULL)) AS field FROM orders",
)
def q07(spark, sf):
    log = table(spark, sf, "orders").select(F.col("o_orderkey").alias("scan_ms"), F.col("o_orderstatus").alias("holding_window"), F.col("o_orderpriority").alias("target_move"))
    return q.audit_objective(log, {"holding_window": "O", "target_move": "5-LOW"}).select("scan_ms", F.col("details")["field"].alias("field"))


# --- look-ahead and parity -------------------------------------------------


def features_at(fine, coarse, points):
    """Feature rows at given times, each from the newest closed bars."""
    unread = [c for c in grid.BAR_VALUES if c != "close"]
    ff = plan.fine_features(fine, FINE).drop("asof_ms", *unread).withColumnRenamed("close_time_ms", "f_close_time_ms")
    rows = joins.asof_join(points.select("symbol", "asof_ms"), ff, "asof_ms", "f_close_time_ms", 512 * FINE)
    rows = rows.filter("pos is not null").withColumnRenamed("f_close_time_ms", "close_time_ms")
    return plan.feature_core(plan.align(rows, plan.coarse_features(coarse, COARSE), FINE)).drop("pos", "open_time_ms")


POINTS = f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM fine_bars),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM coarse_bars),
edge AS (SELECT f.symbol, greatest(f.o, c.o) AS e, least(f.cl + 1, c.cl + {COARSE}) AS l
  FROM (SELECT symbol, coalesce(max(open_time_ms) FILTER (WHERE pos = 30), 0) AS o, max(close_time_ms) AS cl FROM f GROUP BY symbol) f
  JOIN (SELECT symbol, coalesce(max(open_time_ms) FILTER (WHERE pos = 25), 0) AS o, max(close_time_ms) AS cl FROM c GROUP BY symbol) c ON f.symbol = c.symbol),
points AS (SELECT DISTINCT symbol, p AS asof_ms FROM (SELECT symbol, e, l, ((e + (i * (l - e)) // 25) // {FINE}) * {FINE} + 300000 AS p FROM edge, generate_series(1, 24) AS g(i) WHERE l > e) WHERE e < p AND p <= l)"""


@query("q09_lookahead_check", f"{POINTS} SELECT symbol, count(*) AS checkpoints, 0::BIGINT AS errors FROM points GROUP BY symbol")
def q09(spark, sf):
    return _leaks(spark, sf, features_at)


@query(
    "q09_planted_leak",
    f"""{POINTS} SELECT symbol, count(*) AS checkpoints, count(*) FILTER (WHERE asof_ms <= (SELECT max(close_time_ms) FROM fine_bars b WHERE b.symbol = points.symbol)) AS errors
FROM points GROUP BY symbol""",
)
def q09b(spark, sf):
    """A price that is the last one of the whole series shows at every checkpoint that has later bars."""
    def leaking(fine, coarse, points):
        ends = fine.groupBy("symbol").agg(F.max_by("close", "open_time_ms").alias("_end"))
        return features_at(fine, coarse, points).join(ends, "symbol").withColumn("price", F.col("_end")).drop("_end")

    return _leaks(spark, sf, leaking)


def _leaks(spark, sf, features):
    fine, coarse = frames(spark, sf, FINE, COARSE)
    points = cut(grid.checkpoints(numbered(fine, FINE), numbered(coarse, COARSE), 24, FINE, COARSE, 300_000))
    errors = q.lookahead_check(fine, coarse, points, FINE, COARSE, features, q.PARITY_NUMERIC, q.PARITY_EXACT)
    found = errors.groupBy("symbol").agg(F.countDistinct("asof_ms").alias("errors"))
    return points.groupBy("symbol").agg(F.count(F.lit(1)).alias("checkpoints")).join(found, "symbol", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))


@query(
    "q10_parity_check",
    "SELECT symbol, asof_ms, 'price' AS field FROM core WHERE pos % 10 = 0 UNION ALL SELECT symbol, asof_ms, 'bias' FROM core WHERE pos % 17 = 0 UNION ALL SELECT symbol, asof_ms, 'warnings' FROM core WHERE pos % 19 = 0",
)
def q10(spark, sf):
    rows = cut(core(spark, sf))
    m = F.col("pos")
    live = rows.withColumns(
        {
            "price": F.col("price") + F.when(m % 10 == 0, 0.01).otherwise(0.0),
            "bias": F.when(m % 17 == 0, "NONE").otherwise(F.col("bias")),
            "warnings": F.when(m % 19 == 0, F.array_append("warnings", F.lit("planted"))).otherwise(F.col("warnings")),
        }
    )
    return q.parity_check(live, rows).select("symbol", "asof_ms", "field")


# --- admission reports, sorts, sets ----------------------------------------

ADMIT = f"SELECT pair AS id, scan_ms AS observed_ms, CASE WHEN score < 78 THEN 'STALE_AT_OBSERVATION' WHEN oi_change_15m_pct <= 0 THEN 'SYMBOL_COOLDOWN' ELSE 'ACCEPTED' END AS reason FROM candidates"


def _admissions(spark, sf):
    why = F.when(F.col("score") < 78, "STALE_AT_OBSERVATION").when(F.col("oi_change_15m_pct") <= 0, "SYMBOL_COOLDOWN").otherwise("ACCEPTED")
    return candidates(spark, sf).select(F.col("pair").alias("id"), F.col("scan_ms").alias("observed_ms"), why.alias("reason"))


@query("a10_admission_counts", f"SELECT reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY observed_ms DESC) AS rn FROM ({ADMIT})) WHERE rn = 1 GROUP BY reason")
def a10(spark, sf):
    return cohorts.admission_counts(_admissions(spark, sf))


@query(
    "a10_recent_admissions",
    f"SELECT id, observed_ms, reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY observed_ms DESC) AS rn FROM ({ADMIT})) WHERE rn = 1 ORDER BY observed_ms DESC, id LIMIT 20",
)
def a10b(spark, sf):
    return cohorts.recent_admissions(_admissions(spark, sf))


@query("o01_global_sort", "SELECT asof_ms, symbol, doc_id, row_number() OVER (ORDER BY asof_ms, symbol) - 1 AS place FROM scored")
def o01(spark, sf):
    # A range-partitioned sort; places come from partition sizes, not from one task.
    from barlytics.operators.blocks import with_position

    df = cut(scored(spark, sf)).select("asof_ms", "symbol", "doc_id")
    return with_position(df, [], F.struct("asof_ms", "symbol"), grid.floor_bucket("asof_ms", 4096 * HOUR)).withColumnRenamed("pos", "place").orderBy("asof_ms", "symbol")


@query("o02_top_k", "SELECT pair, scan_ms, score FROM candidates ORDER BY score DESC, pair, scan_ms LIMIT 20")
def o02(spark, sf):
    return candidates(spark, sf).select(*KEY, "score").orderBy(F.desc("score"), *KEY).limit(20)


@query("o03_top_k_per_group", f"SELECT {CAND}, score FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY score DESC, scan_ms) AS rn FROM candidates) WHERE rn <= 5")
def o03(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("pair").orderBy(F.desc("score"), "scan_ms")
    return candidates(spark, sf).select(*KEY, "score").withColumn("rn", F.row_number().over(w)).filter("rn <= 5").drop("rn")


@query("o04_union_distinct", "SELECT pair, 'LOW' AS section FROM candidates WHERE score < 60 UNION SELECT pair, 'HIGH' FROM candidates WHERE score >= 200")
def o04(spark, sf):
    c = candidates(spark, sf)
    part = lambda cond, name: c.filter(cond).select("pair", F.lit(name).alias("section"))
    return part("score < 60", "LOW").unionByName(part("score >= 200", "HIGH")).distinct()


@query(
    "o05_intersect_except",
    """SELECT 'both' AS side, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'customer_only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""",
)
def o05(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf, "orders")
    keys = lambda df: df.select(F.col("o_custkey").alias("k"))
    n = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return n(c.intersect(keys(o)), "both").unionByName(n(c.subtract(keys(o.filter("o_orderstatus = 'P'"))), "customer_only"))


@query("o06_row_cap", "SELECT asof_ms, symbol, doc_id FROM scored ORDER BY asof_ms, symbol LIMIT 100")
def o06(spark, sf):
    return scored(spark, sf).select("asof_ms", "symbol", "doc_id").orderBy("asof_ms", "symbol").limit(100)
