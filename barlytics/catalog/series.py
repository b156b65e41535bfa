"""Queries over bars: grids, rolling indicators, as-of joins, setups."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlytics.catalog.base import (
    COARSE, DAY, FINE, HOUR, LEAD, SECOND, TINY, bars, cte, frames, ms, query, rnd, stored_bars, table, ticks,
)
from barlytics.operators import grid, indicators as ind, joins
from barlytics.operators.blocks import roll
from barlytics.plans import setups as plan
from barlytics.session import cut

# --- grids and resampling --------------------------------------------------

EVENT_MS = "SELECT event_id, epoch_us(ts) // 1000 AS t FROM events"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", ms("ts").alias("t"))


@query("r01_floor_bucket", f"SELECT event_id, t - t % 900000 AS bucket FROM ({EVENT_MS})")
def r01(spark, sf):
    return _events(spark, sf).select("event_id", grid.floor_bucket("t", 900_000).alias("bucket"))


@query("r02_ceil_bucket", f"SELECT event_id, (t + 299999) - (t + 299999) % 300000 AS bucket FROM ({EVENT_MS})")
def r02(spark, sf):
    return _events(spark, sf).select("event_id", grid.ceil_bucket("t", 300_000).alias("bucket"))


@query("r03_next_bucket", f"SELECT event_id, t - t % 300000 + 300000 AS bucket FROM ({EVENT_MS})")
def r03(spark, sf):
    return _events(spark, sf).select("event_id", grid.next_bucket("t", 300_000).alias("bucket"))


cte(
    "mid_bars",
    f"""SELECT symbol, min(open_time_ms) AS open_time_ms, first(open ORDER BY open_time_ms) AS open,
  max(high) AS high, min(low) AS low, last(close ORDER BY open_time_ms) AS close, sum(volume) AS volume,
  max(close_time_ms) AS close_time_ms, round(sum(quote_volume), 2) AS quote_volume, CAST(sum(trades) AS BIGINT) AS trades,
  sum(taker_buy_base_volume) AS taker_buy_base_volume, round(sum(taker_buy_quote_volume), 2) AS taker_buy_quote_volume
FROM tiny_bars GROUP BY symbol, open_time_ms - open_time_ms % {FINE}
HAVING count(*) = 3 AND count(DISTINCT open_time_ms) = 3 AND max(open_time_ms) - min(open_time_ms) = {2 * TINY}""",
)


@query("r04_resample", "SELECT * FROM mid_bars")
def r04(spark, sf):
    return rnd(grid.resample(bars(spark, sf, TINY), TINY, 3), 2, keep=("open", "high", "low", "close"))


@query("r05_ticks_to_bars", "SELECT * FROM fine_bars")
def r05(spark, sf):
    return bars(spark, sf, FINE)


cte(
    "window_bounds",
    f"""SELECT max(s) AS start_ms, min(e) AS end_ms FROM (
  SELECT symbol, min(close_time_ms) + {30 * COARSE} AS s, max(close_time_ms) - {60 * DAY} AS e FROM tiny_bars GROUP BY symbol)""",
)


@query(
    "r06_asof_grid",
    f"""SELECT unnest(generate_series(start_ms - start_ms % {FINE} + {FINE} + 1, end_ms, {FINE})) AS asof_ms
FROM window_bounds WHERE start_ms - start_ms % {FINE} + {FINE} + 1 <= end_ms""",
)
def r06(spark, sf):
    return grid.asof_grid(grid.common_window(bars(spark, sf, TINY), 30 * COARSE, 60 * DAY), FINE)


@query("r07_common_window", "SELECT * FROM window_bounds")
def r07(spark, sf):
    return grid.common_window(bars(spark, sf, TINY), 30 * COARSE, 60 * DAY)


@query(
    "r08_checkpoints",
    f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM fine_bars),
c AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM coarse_bars),
edge AS (
  SELECT f.symbol, greatest(f.o, c.o) AS e, least(f.cl + 1, c.cl + {COARSE}) AS l
  FROM (SELECT symbol, coalesce(max(open_time_ms) FILTER (WHERE pos = 30), 0) AS o, max(close_time_ms) AS cl FROM f GROUP BY symbol) f
  JOIN (SELECT symbol, coalesce(max(open_time_ms) FILTER (WHERE pos = 25), 0) AS o, max(close_time_ms) AS cl FROM c GROUP BY symbol) c
  ON f.symbol = c.symbol)
SELECT DISTINCT symbol, p AS asof_ms FROM (
  SELECT symbol, e, l, ((e + (i * (l - e)) // 25) // {FINE}) * {FINE} + 300000 AS p
  FROM edge, generate_series(1, 24) AS g(i) WHERE l > e)
WHERE e < p AND p <= l""",
)
def r08(spark, sf):
    fine, coarse = frames(spark, sf, FINE, COARSE)
    return grid.checkpoints(
        ind.numbered(fine, FINE), ind.numbered(coarse, COARSE), 24, FINE, COARSE, 300_000
    )


cte("scan_log", f"SELECT event_id, epoch_us(ts) // 1000 AS generated_at_ms FROM events")


@query(
    "r09_one_per_bucket",
    """SELECT event_id, generated_at_ms, b AS bucket_start_ms FROM (
  SELECT *, generated_at_ms - generated_at_ms % 900000 AS b,
    row_number() OVER (PARTITION BY generated_at_ms - generated_at_ms % 900000 ORDER BY generated_at_ms, event_id) AS rn FROM scan_log)
WHERE rn = 1""",
)
def r09(spark, sf):
    log = table(spark, sf, "events").select("event_id", ms("ts").alias("generated_at_ms"))
    return grid.one_per_bucket(log.withColumn("o", F.struct("generated_at_ms", "event_id")), 900_000).drop("o")


# Arrival order by event id while the clock of each event is shifted by its
# user, so that late rows occur and the two rules differ.
cte("shuffled_log", "SELECT event_id, epoch_us(ts) // 1000 - (user_id % 7) * 600000 AS generated_at_ms FROM events")


def _shuffled(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", (ms("ts") - (F.col("user_id") % 7) * 600_000).alias("generated_at_ms")
    )


@query(
    "r09_one_per_bucket_monotone",
    """SELECT event_id, generated_at_ms, b AS bucket_start_ms FROM (
  SELECT *, max(b) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM (SELECT *, generated_at_ms - generated_at_ms % 900000 AS b FROM shuffled_log))
WHERE m IS NULL OR b > m""",
)
def r09m(spark, sf):
    return grid.one_per_bucket(_shuffled(spark, sf), 900_000, "monotone", arrival="event_id")


@query(
    "r09_one_per_bucket_equality",
    """SELECT event_id, generated_at_ms, b AS bucket_start_ms FROM (
  SELECT *, lag(b) OVER (ORDER BY event_id) AS m
  FROM (SELECT *, generated_at_ms - generated_at_ms % 900000 AS b FROM shuffled_log))
WHERE m IS NULL OR b <> m""",
)
def r09e(spark, sf):
    return grid.one_per_bucket(_shuffled(spark, sf), 900_000, "equality", arrival="event_id")


# --- rolling windows -------------------------------------------------------

cte("fine_pos", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM fine_bars")
cte("tiny_pos", "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM tiny_bars")
W = "OVER (PARTITION BY symbol ORDER BY open_time_ms ROWS BETWEEN {} PRECEDING AND {})"


def win(a: int, b: int = 0) -> str:
    return W.format(a, "CURRENT ROW" if b == 0 else f"{b} PRECEDING")


def wq(name: str, stages, out: dict[str, str], step: int = FINE):
    """Register a rolling query; ``out`` maps a column to its SQL over fine bars."""
    src = "fine_pos" if step == FINE else "tiny_pos"
    cols = ", ".join(f"round({e}, 9) + 0.0 AS {c}" for c, e in out.items())

    def fn(spark, sf):
        df = roll(stored_bars(spark, sf, step), stages, step)
        return rnd(df.select("symbol", "open_time_ms", *[F.col(c) + F.lit(0.0) for c in out]).toDF("symbol", "open_time_ms", *out))

    query(name, f"SELECT symbol, open_time_ms, {cols} FROM {src}")(fn)


def since(n: int, e: str) -> str:
    return f"CASE WHEN pos >= {n} THEN {e} END"


LAG = "lag({}, {}) OVER (PARTITION BY symbol ORDER BY open_time_ms)"
SMA10 = since(9, f"avg(close) {win(9)}")
SMA10_OLD = since(14, f"avg(close) {win(14, 5)}")

wq("w01_sma", {"sma10": ind.sma("close", 10), "sma20": ind.sma("close", 20)},
   {"sma10": SMA10, "sma20": since(19, f"avg(close) {win(19)}")})
wq("w02_sma_lagged", {"sma10_old": ind.sma_lagged("close", 10, 5)}, {"sma10_old": SMA10_OLD})
wq("w03_rolling_high_low", {"high12": ind.rolling_max("high", 12), "low12": ind.rolling_min("low", 12)},
   {"high12": since(11, f"max(high) {win(11)}"), "low12": since(11, f"min(low) {win(11)}")})


def derived(name: str, stages, extra, sql_out: dict[str, str], step: int = FINE):
    """As ``wq``, with columns computed from the rolled ones."""
    src = "fine_pos" if step == FINE else "tiny_pos"
    cols = ", ".join(f"round({e}, 9) + 0.0 AS {c}" for c, e in sql_out.items())

    def fn(spark, sf):
        df = roll(stored_bars(spark, sf, step), stages, step).withColumns(extra())
        return rnd(df.select("symbol", "open_time_ms", *sql_out))

    query(name, f"SELECT symbol, open_time_ms, {cols} FROM {src}")(fn)


from barlytics.functions.scalar import pct_change  # noqa: E402

derived(
    "w04_pullback_bounce",
    {"h": ind.rolling_max("high", 12), "l": ind.rolling_min("low", 12)},
    lambda: {"pullback": pct_change("close", "h"), "bounce": pct_change("close", "l")},
    {"pullback": since(11, f"(close / max(high) {win(11)} - 1) * 100"), "bounce": since(11, f"(close / min(low) {win(11)} - 1) * 100")},
)
derived(
    "w05_distance_from_sma", {"s": ind.sma("close", 10)},
    lambda: {"distance": pct_change("close", "s")}, {"distance": f"(close / {SMA10} - 1) * 100"},
)
wq("w06_momentum", {"m1": ind.momentum("close", 1), "m3": ind.momentum("close", 3), "m6": ind.momentum("close", 6), "m12": ind.momentum("close", 12)},
   {f"m{k}": f"(close / {LAG.format('close', k)} - 1) * 100" for k in (1, 3, 6, 12)})
VEXP = f"CASE WHEN avg(quote_volume) {win(14, 3)} > 0 THEN avg(quote_volume) {win(2)} / avg(quote_volume) {win(14, 3)} ELSE 0 END"
wq("w07_volume_expansion", {"vexp": ind.volume_expansion("quote_volume")}, {"vexp": since(14, VEXP)})
derived(
    "w08_sma_slope", {"a": ind.sma("close", 10), "b": ind.sma_lagged("close", 10, 5)},
    lambda: {"slope": pct_change("a", "b")},
    {"slope": f"CASE WHEN pos >= 14 THEN ({SMA10} / {SMA10_OLD} - 1) * 100 END"},
)
cte(
    "fine_tr",
    f"""SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN pc > 0 AND close > 0 THEN ln(close / pc) END AS lr
FROM (SELECT *, {LAG.format('close', 1)} AS pc FROM fine_pos)""",
)


@query("w09_atr_pct", f"SELECT symbol, open_time_ms, round(CASE WHEN pos >= 14 THEN avg(tr) {win(13)} / close * 100 ELSE 0 END, 9) AS atr_pct FROM fine_tr")
def w09(spark, sf):
    return rnd(roll(stored_bars(spark, sf), ind.atr_pct_stages(14), FINE).select("symbol", "open_time_ms", "atr_pct"))


@query(
    "w10_realized_vol",
    f"""SELECT symbol, open_time_ms, round(CASE WHEN pos >= 12 AND count(lr) {win(11)} >= 2
  THEN stddev_pop(lr) {win(11)} * sqrt(count(lr) {win(11)}) * 100 ELSE 0 END, 9) AS realized_vol_pct FROM fine_tr""",
)
def w10(spark, sf):
    return rnd(roll(stored_bars(spark, sf), ind.realized_vol_stages(12), FINE).select("symbol", "open_time_ms", "realized_vol_pct"))


def day_sql(n: int) -> dict[str, str]:
    q = f"sum(quote_volume) {win(n - 1)}"
    return {
        "quote_volume_24h": since(n, q),
        "price_change_24h_pct": since(n, f"(close / {LAG.format('close', n)} - 1) * 100"),
        "taker_buy_ratio_24h": since(n, f"CASE WHEN {q} <> 0 THEN sum(taker_buy_quote_volume) {win(n - 1)} / {q} ELSE 0.5 END"),
    }


derived("w11_rolling_24h", ind.day_snapshot(288), lambda: {"quote_volume_24h": F.round("quote_volume_24h", 2)},
        {**day_sql(288), "quote_volume_24h": f"round({since(288, f'sum(quote_volume) {win(287)}')}, 2)"}, TINY)
wq("w12_taker_buy_ratio", {"r12": ind.taker_buy_ratio(12), "r288": ind.taker_buy_ratio(288)},
   {f"r{n}": since(n - 1, f"sum(taker_buy_quote_volume) {win(n - 1)} / sum(quote_volume) {win(n - 1)}") for n in (12, 288)}, TINY)

# --- recursive indicators --------------------------------------------------


def ema_sql(p: int, src: str = "fine_pos") -> str:
    a = 2.0 / (p + 1)
    return f"""SELECT symbol, {p - 1} AS pos, avg(close) AS v FROM {src} WHERE pos < {p} GROUP BY symbol HAVING count(*) = {p}
  UNION ALL SELECT b.symbol, b.pos, {a!r} * b.close + (1 - {a!r}) * e.v FROM e{p} e JOIN {src} b ON b.symbol = e.symbol AND b.pos = e.pos + 1"""


@query(
    "w13_ema",
    f"""WITH RECURSIVE e20(symbol, pos, v) AS ({ema_sql(20)})
SELECT f.symbol, f.open_time_ms, round(e20.v, 9) AS ema20 FROM fine_pos f LEFT JOIN e20 ON f.symbol = e20.symbol AND f.pos = e20.pos""",
)
def w13(spark, sf):
    b = ind.numbered(stored_bars(spark, sf), FINE)
    return rnd(b.join(ind.ema(b, 20, FINE, out="ema20"), ["symbol", "pos"]).select("symbol", "open_time_ms", "ema20"))


RSI_REC = """g(symbol, pos, gain, loss) AS (
  SELECT symbol, pos, greatest(close - pc, 0), greatest(pc - close, 0) FROM (
    SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY open_time_ms) AS pc FROM fine_pos) WHERE pc IS NOT NULL),
w(symbol, pos, ag, al) AS (
  SELECT symbol, 14, avg(gain), avg(loss) FROM g WHERE pos <= 14 GROUP BY symbol HAVING count(*) = 14
  UNION ALL SELECT g.symbol, g.pos, (w.ag * 13 + g.gain) / 14, (w.al * 13 + g.loss) / 14
  FROM w JOIN g ON g.symbol = w.symbol AND g.pos = w.pos + 1),
r AS (SELECT symbol, pos, CASE WHEN al = 0 THEN CASE WHEN ag > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + ag / al) END AS rsi FROM w)"""


@query(
    "w14_rsi_wilder",
    f"WITH RECURSIVE {RSI_REC} SELECT f.symbol, f.open_time_ms, round(r.rsi, 9) AS rsi14 FROM fine_pos f LEFT JOIN r ON f.symbol = r.symbol AND f.pos = r.pos",
)
def w14(spark, sf):
    b = ind.numbered(stored_bars(spark, sf), FINE)
    return rnd(b.join(ind.rsi_wilder(b, FINE, out="rsi14"), ["symbol", "pos"], "left").select("symbol", "open_time_ms", "rsi14"))


STOCH = """s AS (SELECT symbol, pos, rsi, min(rsi) OVER z AS lo, max(rsi) OVER z AS hi FROM r
  WINDOW z AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
st AS (SELECT symbol, pos, rsi, CASE WHEN pos >= 27 THEN CASE WHEN hi = lo THEN 50.0 ELSE (rsi - lo) / (hi - lo) * 100 END END AS stoch FROM s)"""


@query(
    "w15_stoch_rsi",
    f"WITH RECURSIVE {RSI_REC}, {STOCH} SELECT f.symbol, f.open_time_ms, round(st.stoch, 6) AS stoch_rsi14 FROM fine_pos f LEFT JOIN st ON f.symbol = st.symbol AND f.pos = st.pos",
)
def w15(spark, sf):
    b = ind.numbered(stored_bars(spark, sf), FINE)
    stoch = roll(ind.rsi_wilder(b, FINE), {"stoch_rsi14": ind.stoch_rsi()}, FINE)
    return rnd(b.join(stoch, ["symbol", "pos"], "left").select("symbol", "open_time_ms", "stoch_rsi14"), 6)


DAILY = f"""e20(symbol, pos, v) AS ({ema_sql(20)}), e50(symbol, pos, v) AS ({ema_sql(50)}), {RSI_REC}, {STOCH},
daily AS (
  SELECT b.symbol, round(b.close, 10) AS daily_close, round(st.rsi, 2) AS daily_rsi14, round(st.stoch, 2) AS daily_stoch_rsi14,
    round((b.close / b7.close - 1) * 100, 2) AS daily_change_7d_pct, round(e20.v, 10) AS daily_ema20, round(e50.v, 10) AS daily_ema50,
    round((b.close / e20.v - 1) * 100, 2) AS distance_from_daily_ema20_pct, round((b.close / e50.v - 1) * 100, 2) AS distance_from_daily_ema50_pct,
    b.pos + 1 AS daily_candles_used
  FROM fine_pos b JOIN (SELECT symbol, max(pos) AS pos FROM fine_pos GROUP BY symbol) m ON b.symbol = m.symbol AND b.pos = m.pos
  JOIN fine_pos b7 ON b7.symbol = b.symbol AND b7.pos = b.pos - 7
  JOIN e20 ON e20.symbol = b.symbol AND e20.pos = b.pos JOIN e50 ON e50.symbol = b.symbol AND e50.pos = b.pos
  JOIN st ON st.symbol = b.symbol AND st.pos = b.pos WHERE b.pos >= 54)"""
#: The context at every bar instead of the last one.
DAILY_ALL = DAILY.replace("SELECT b.symbol, round(b.close", "SELECT b.symbol, b.close_time_ms AS daily_close_ms, round(b.close").replace(
    "FROM fine_pos b JOIN (SELECT symbol, max(pos) AS pos FROM fine_pos GROUP BY symbol) m ON b.symbol = m.symbol AND b.pos = m.pos", "FROM fine_pos b"
)


@query("w16_daily_context", f"WITH RECURSIVE {DAILY} SELECT * REPLACE (round(daily_ema20, 9) AS daily_ema20, round(daily_ema50, 9) AS daily_ema50) FROM daily")
def w16(spark, sf):
    return rnd(ind.daily_context(stored_bars(spark, sf), FINE))


# --- as-of joins -----------------------------------------------------------

cte(
    "fine_feat",
    f"""SELECT *, close_time_ms + 1 AS asof_ms, {SMA10} AS sma10, {since(19, f"avg(close) {win(19)}")} AS sma20, {SMA10_OLD} AS sma10_old,
  {since(11, f"max(high) {win(11)}")} AS high12, {since(11, f"min(low) {win(11)}")} AS low12, {LAG.format('close', 1)} AS prev_close,
  (close / {LAG.format('close', 3)} - 1) * 100 AS m3, (close / {LAG.format('close', 12)} - 1) * 100 AS m12,
  {since(14, VEXP)} AS vexp, sum(quote_volume) {win(23)} AS qv24,
  CASE WHEN pos >= 24 THEN (close / {LAG.format('close', 24)} - 1) * 100 ELSE 0 END AS chg24
FROM fine_pos""",
)
cte(
    "coarse_feat",
    f"""SELECT symbol, close_time_ms AS h_close_time_ms, close AS h_close, pos AS h_pos, {SMA10} AS h_sma10,
  {since(19, f"avg(close) {win(19)}")} AS h_sma20, {SMA10_OLD} AS h_sma10_old, (close / {LAG.format('close', 6)} - 1) * 100 AS m24
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS pos FROM coarse_bars)""",
)
cte(
    "aligned",
    "SELECT f.*, c.* EXCLUDE (symbol) FROM fine_feat f ASOF LEFT JOIN coarse_feat c ON f.symbol = c.symbol AND f.asof_ms > c.h_close_time_ms",
)


@query(
    "j01_asof_join",
    """SELECT o.symbol, o.o_orderkey, o.t_ms, b.close_time_ms AS bar_close_ms, b.close FROM (
  SELECT concat('S', o_custkey % 5) AS symbol, o_orderkey, epoch_ms(o_orderdate) AS t_ms FROM orders) o
ASOF LEFT JOIN fine_bars b ON o.symbol = b.symbol AND o.t_ms > b.close_time_ms""",
)
def j01(spark, sf):
    left = table(spark, sf, "orders").select(
        F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("symbol"), "o_orderkey", ms("o_orderdate").alias("t_ms")
    )
    right = stored_bars(spark, sf).select("symbol", F.col("close_time_ms").alias("bar_close_ms"), "close")
    return joins.asof_join(left, right, "t_ms", "bar_close_ms", 128 * FINE, salts=4)


@query(
    "j02_asof_join_many",
    """SELECT f.symbol, f.asof_ms, t.close_time_ms AS t_close_ms, m.close_time_ms AS m_close_ms, c.h_close_time_ms AS c_close_ms
FROM fine_feat f ASOF LEFT JOIN tiny_bars t ON f.symbol = t.symbol AND f.asof_ms > t.close_time_ms
ASOF LEFT JOIN mid_bars m ON f.symbol = m.symbol AND f.asof_ms > m.close_time_ms
ASOF LEFT JOIN coarse_feat c ON f.symbol = c.symbol AND f.asof_ms > c.h_close_time_ms""",
)
def j02(spark, sf):
    tiny, fine, coarse = frames(spark, sf, TINY, FINE, COARSE)
    out = fine.select("symbol", (F.col("close_time_ms") + 1).alias("asof_ms"))
    sides = ((tiny, "t_close_ms"), (grid.resample(tiny, TINY, 3), "m_close_ms"), (coarse, "c_close_ms"))
    rights = [(df.select("symbol", F.col("close_time_ms").alias(name)), name) for df, name in sides]
    return joins.asof_joins(out, rights, "asof_ms", 128 * FINE)


@query(
    "j03_forward_join",
    f"""SELECT a.symbol, a.asof_ms, count(*) AS bars, max(b.high) AS high, min(b.low) AS low FROM fine_feat a
JOIN tiny_bars b ON a.symbol = b.symbol AND b.open_time_ms >= a.asof_ms AND b.open_time_ms < a.asof_ms + {30 * DAY} GROUP BY a.symbol, a.asof_ms""",
)
def j03(spark, sf):
    tiny, fine = frames(spark, sf, TINY, FINE)
    anchors = fine.select("symbol", (F.col("close_time_ms") + 1).alias("asof_ms"))
    pairs = joins.forward_join(anchors, tiny.select("symbol", "open_time_ms", "high", "low"), F.col("asof_ms"), F.col("asof_ms") + 30 * DAY, 15 * DAY)
    return pairs.groupBy("symbol", "asof_ms").agg(
        F.count(F.lit(1)).alias("bars"), F.max("bar.high").alias("high"), F.min("bar.low").alias("low")
    )


# --- setups ----------------------------------------------------------------

PULL, BOUNCE, DIST = "(close / high12 - 1) * 100", "(close / low12 - 1) * 100", "(close / sma10 - 1) * 100"
cte(
    "with_bias",
    f"""SELECT *, {PULL} AS pull, {BOUNCE} AS bounce, {DIST} AS dist, CASE
  WHEN close > sma10 AND sma10 > sma20 AND h_close > h_sma10 AND h_sma10 > h_sma20 AND sma10 > sma10_old AND h_sma10 > h_sma10_old THEN 'LONG'
  WHEN close < sma10 AND sma10 < sma20 AND h_close < h_sma10 AND h_sma10 < h_sma20 AND sma10 < sma10_old AND h_sma10 < h_sma10_old THEN 'SHORT'
  ELSE 'NEUTRAL' END AS bias FROM aligned WHERE pos >= 29 AND h_pos >= 24""",
)
cte(
    "with_state",
    """SELECT *, CASE
  WHEN bias = 'LONG' AND pull BETWEEN -4 AND -0.75 AND dist BETWEEN -1.5 AND 1 THEN
    CASE WHEN close > prev_close AND close >= sma10 AND vexp >= 0.9 THEN 'CONTINUATION_TRIGGER' ELSE 'RETEST_READY' END
  WHEN bias = 'SHORT' AND bounce BETWEEN 0.75 AND 4 AND dist BETWEEN -1 AND 1.5 THEN
    CASE WHEN close < prev_close AND close <= sma10 AND vexp >= 0.9 THEN 'CONTINUATION_TRIGGER' ELSE 'RETEST_READY' END
  ELSE 'TREND_ONLY' END AS setup_state FROM with_bias""",
)
SWING = """round(greatest(0, least(100,
  CASE WHEN bias <> 'NEUTRAL' THEN 25 ELSE 0 END
  + CASE WHEN (bias = 'LONG' AND m3 > 0) OR (bias = 'SHORT' AND m3 < 0) THEN 10 ELSE 0 END
  + CASE WHEN (bias = 'LONG' AND m12 > 0) OR (bias = 'SHORT' AND m12 < 0) THEN 10 ELSE 0 END
  + CASE WHEN (bias = 'LONG' AND m24 > 0) OR (bias = 'SHORT' AND m24 < 0) THEN 10 ELSE 0 END
  + CASE WHEN vexp >= 1.5 THEN 20 WHEN vexp >= 1.1 THEN 10 WHEN vexp < 0.7 THEN -8 ELSE 0 END
  + CASE WHEN qv24 >= 50e6 THEN 10 WHEN qv24 >= 10e6 THEN 6 ELSE 0 END
  + CASE WHEN abs(m12) >= 8 THEN -20 WHEN abs(m12) >= 5 THEN -10 ELSE 0 END))::DOUBLE, 1)"""
cte(
    "core",
    f"""SELECT symbol, open_time_ms, asof_ms, pos, bias, setup_state,
  CASE WHEN bias = 'LONG' AND setup_state = 'CONTINUATION_TRIGGER' THEN 'pullback over, buyers are back'
    WHEN bias = 'LONG' AND setup_state = 'RETEST_READY' THEN 'uptrend holds, price back at its mean'
    WHEN bias = 'SHORT' AND setup_state = 'CONTINUATION_TRIGGER' THEN 'bounce over, sellers are back'
    WHEN bias = 'SHORT' AND setup_state = 'RETEST_READY' THEN 'downtrend holds, price back at its mean' END AS retest_reason,
  close AS price, round(m3, 3) + 0.0 AS momentum_3h_pct, round(m12, 3) + 0.0 AS momentum_12h_pct, round(m24, 3) + 0.0 AS momentum_24h_pct,
  round(pull, 3) + 0.0 AS pullback_from_12h_high_pct, round(bounce, 3) + 0.0 AS bounce_from_12h_low_pct, round(dist, 3) + 0.0 AS distance_from_1h_sma10_pct,
  round(vexp, 2) AS volume_expansion_1h, {SWING} AS swing_score,
  list_filter([CASE WHEN vexp < 0.7 THEN 'little spot volume behind the move' END,
    CASE WHEN abs(m12) >= 8 THEN printf('12h move already extended: %+.2f%%', m12) WHEN abs(m12) >= 5 THEN printf('12h move somewhat extended: %+.2f%%', m12) END],
    lambda x: x IS NOT NULL) AS warnings,
  CASE WHEN abs(m12) >= 8 THEN 'EXTREME' WHEN abs(m12) >= 5 THEN 'EXTENDED' ELSE 'CLEAN' END AS anti_chase_state,
  round(qv24, 2) AS quote_volume_24h, round(chg24, 3) + 0.0 AS price_change_24h_pct,
  close_time_ms AS last_fine_close_ms, h_close_time_ms AS last_coarse_close_ms
FROM with_state""",
)


def core(spark, sf):
    fine, coarse = frames(spark, sf, FINE, COARSE)
    return plan.setups(fine, coarse, FINE, COARSE)


@query("c01_trend_structure", "SELECT symbol, asof_ms, bias FROM core")
def c01(spark, sf):
    return core(spark, sf).select("symbol", "asof_ms", "bias")


@query("c02_setup_state", "SELECT symbol, asof_ms, setup_state, retest_reason FROM core")
def c02(spark, sf):
    return core(spark, sf).select("symbol", "asof_ms", "setup_state", "retest_reason")


@query("c03_swing_score", "SELECT symbol, asof_ms, swing_score, array_to_string(warnings, '; ') AS warnings FROM core")
def c03(spark, sf):
    return core(spark, sf).select("symbol", "asof_ms", "swing_score", F.array_join("warnings", "; ").alias("warnings"))


@query("c04_anti_chase_state", "SELECT anti_chase_state, count(*) AS n FROM core GROUP BY anti_chase_state")
def c04(spark, sf):
    return core(spark, sf).groupBy("anti_chase_state").agg(F.count(F.lit(1)).alias("n"))


@query("c05_feature_core", "SELECT * REPLACE (array_to_string(warnings, '; ') AS warnings) FROM core WHERE bias <> 'NEUTRAL'")
def c05(spark, sf):
    return core(spark, sf).filter("bias <> 'NEUTRAL'").withColumn("warnings", F.array_join("warnings", "; "))
