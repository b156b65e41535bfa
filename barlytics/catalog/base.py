"""Registry of queries and the derived input tables they share.

The given tables hold no candles. Ticks come from ``lineitem``, scans from
``events``, scored rows from ``documents`` and ``labels``; bars and everything
above are computed from them. Each derived table exists twice: as a Spark plan
and as a named SQL fragment for the checking engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlytics.operators import grid
from barlytics.session import cut, prepare

DAY = 86_400_000
HOUR = 3_600_000
# Frames of the fixture bars: 1 day, 3 days and 12 days stand in for the
# 5-minute, 1-hour and 4-hour candles (same 1:4 ratio of the upper two).
TINY, FINE, COARSE = DAY, 3 * DAY, 12 * DAY
LEAD, SECOND = "S0", "S1"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query, with its SQL twin when there is one."""
    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn

    return put


def cte(name: str, body: str) -> None:
    CTE[name] = body


def compose(sql: str) -> str:
    """Put the named fragments a statement refers to in front of it."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_][a-z0-9_]*\b", text)):
            if word in CTE and word not in order and word not in pending:
                pending.add(word)
                visit(CTE[word])
                pending.discard(word)
                order.append(word)

    pending: set[str] = set()
    visit(sql)
    own = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    head = ",\n".join(f"{n} AS ({CTE[n]})" for n in order)
    if not head:
        return sql
    if own:
        return f"WITH {'RECURSIVE ' if own.group(1) else ''}{head},\n{sql[own.end():]}"
    return f"WITH {head}\n{sql}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ms(c: str):
    return F.unix_millis(F.col(c).cast("timestamp"))


def rnd(df: DataFrame, digits: int = 9, keep=()) -> DataFrame:
    """Round every double column (sum order differs between engines)."""
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" and c not in keep else F.col(c)
            for c, t in df.dtypes
        ]
    )


# --- ticks and bars --------------------------------------------------------

cte(
    "ticks",
    """SELECT concat('S', l_suppkey % greatest(5, (SELECT max(l_suppkey) + 1 FROM lineitem) // 20)) AS symbol, epoch_ms(l_shipdate) AS t_ms,
  (l_orderkey * 8 + l_linenumber) * 262144 + l_partkey % 262144 AS seq, 100 + l_extendedprice / 20000 AS price,
  l_quantity AS qty, l_extendedprice AS quote,
  CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS taker_base,
  CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS taker_quote
FROM lineitem""",
)


def _bars_sql(step: int) -> str:
    return f"""SELECT symbol, t_ms - t_ms % {step} AS open_time_ms,
  first(price ORDER BY t_ms, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY t_ms, seq) AS close, round(sum(qty), 4) AS volume,
  t_ms - t_ms % {step} + {step - 1} AS close_time_ms, round(sum(quote), 2) AS quote_volume,
  count(*) AS trades, round(sum(taker_base), 4) AS taker_buy_base_volume,
  round(sum(taker_quote), 2) AS taker_buy_quote_volume
FROM ticks GROUP BY symbol, t_ms - t_ms % {step}"""


cte("tiny_bars", _bars_sql(TINY))
cte("fine_bars", _bars_sql(FINE))
cte("coarse_bars", _bars_sql(COARSE))


def n_keys(df: DataFrame, column: str, least: int, share: int) -> Column:
    """Number of series that a table is folded into; it grows with the table."""
    return F.greatest(F.lit(least).cast("bigint"), F.floor((df.agg(F.max(column)).scalar() + 1) / share))


def _symbol(series: Column) -> Column:
    return F.concat(F.lit("S"), series.cast("string"))


def ticks(spark: SparkSession, sf: str, named: bool = True) -> DataFrame:
    """Ticks with their symbol, or with its number (``series``)."""
    items = table(spark, sf, "lineitem")
    buyer = F.col("l_returnflag") == "R"
    series = F.col("l_suppkey") % n_keys(items, "l_suppkey", 5, 20)
    return items.select(
        _symbol(series).alias("symbol") if named else series.alias("series"),
        ms("l_shipdate").alias("t_ms"),
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2**18 + F.col("l_partkey") % 2**18).alias("seq"),
        (100 + F.col("l_extendedprice") / 20000).alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("quote"),
        F.when(buyer, F.col("l_quantity")).otherwise(0.0).alias("taker_base"),
        F.when(buyer, F.col("l_extendedprice")).otherwise(0.0).alias("taker_quote"),
    )


def _settle(bars: DataFrame) -> DataFrame:
    return bars.select(
        "symbol", "open_time_ms", "open", "high", "low", "close",
        F.round("volume", 4).alias("volume"), "close_time_ms",
        F.round("quote_volume", 2).alias("quote_volume"), "trades",
        F.round("taker_buy_base_volume", 4).alias("taker_buy_base_volume"),
        F.round("taker_buy_quote_volume", 2).alias("taker_buy_quote_volume"),
    )


def bars(spark: SparkSession, sf: str, step: int = FINE) -> DataFrame:
    """Bars of one frame from one scan of the ticks (not written).

    The ticks are grouped by the number of their series; only bars get its name.
    """
    made = grid.ticks_to_bars(ticks(spark, sf, named=False), step, keys=("series",), seq_bits=61, tick_ms=DAY)
    return _settle(made.withColumn("symbol", _symbol(F.col("series"))))


def stored_bars(spark: SparkSession, sf: str, step: int = FINE) -> DataFrame:
    """Bars of one frame, written once because the plan reads them repeatedly."""
    return cut(bars(spark, sf, step))


def frames(spark: SparkSession, sf: str, *steps: int) -> list[DataFrame]:
    """Several frames from one scan: the finest is written, the rest rolled up."""
    base = stored_bars(spark, sf, min(steps))
    return [base if s == min(steps) else _settle(grid.rollup(base, s)) for s in steps]


# --- derivatives scans -----------------------------------------------------

cte(
    "scan_rows",
    f"""SELECT concat('P', user_id % greatest(20, (SELECT max(user_id) + 1 FROM events) // 7)) AS pair, epoch_us(ts) // 1000 - (epoch_us(ts) // 1000) % {HOUR} AS scan_ms,
  event_id, ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  event_type = 'error' AS is_error
FROM events""",
)
cte(
    "scan_last",
    """SELECT pair, scan_ms, value, k, is_error FROM (
  SELECT *, row_number() OVER (PARTITION BY pair, scan_ms ORDER BY ts DESC, event_id DESC) AS rn FROM scan_rows
) WHERE rn = 1""",
)
cte(
    "candidates",
    """SELECT pair, scan_ms, CASE WHEN is_error THEN 'SHORT' ELSE 'LONG' END AS bias,
  CAST(50 + value AS DOUBLE) AS score, CAST(100 + value / 25 AS DOUBLE) AS current_price,
  CAST(k - 50 AS DOUBLE) AS oi_change_15m_pct, (k - 40) / 10.0::DOUBLE AS oi_change_1h_pct,
  (k - 30) / 5.0::DOUBLE AS oi_change_4h_pct, (k - 20) / 4.0::DOUBLE AS oi_change_24h_pct,
  CAST(0.8 + (k % 50) / 100.0::DOUBLE AS DOUBLE) AS spot_buy_sell_ratio_1h,
  CAST((value - 35) * 1000 AS DOUBLE) AS spot_net_flow_1h_usd,
  CASE WHEN k % 13 = 5 THEN NULL ELSE value * 2000 END AS spot_volume_1h_usd,
  CAST(k % 11 - 5 AS DOUBLE) AS price_change_1h_spot_pct, CAST(k % 7 - 2 AS DOUBLE) AS price_change_4h_spot_pct,
  CAST(k % 23 - 10 AS DOUBLE) AS price_change_24h_futures_pct,
  CASE WHEN k % 10 = 0 THEN ['Low open interest today'] ELSE []::VARCHAR[] END AS warnings,
  CASE WHEN k % 17 = 0 THEN ['blocked'] ELSE []::VARCHAR[] END AS blockers
FROM scan_last""",
)


def scan_rows(spark: SparkSession, sf: str) -> DataFrame:
    hour = ms("ts") - F.pmod(ms("ts"), F.lit(HOUR))
    events = table(spark, sf, "events")
    return events.select(
        F.concat(F.lit("P"), (F.col("user_id") % n_keys(events, "user_id", 20, 7)).cast("string")).alias("pair"),
        hour.alias("scan_ms"), "event_id", "ts", "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.col("event_type") == "error").alias("is_error"),
    )


def candidate_columns(rows: DataFrame) -> DataFrame:
    k, v = F.col("k"), F.col("value")
    no_text = F.array().cast("array<string>")
    d = lambda c: c.cast("double")
    return rows.select(
        "pair", "scan_ms", F.when(F.col("is_error"), "SHORT").otherwise("LONG").alias("bias"),
        (50 + v).alias("score"), (100 + v / 25).alias("current_price"),
        d(k - 50).alias("oi_change_15m_pct"), (d(k - 40) / 10.0).alias("oi_change_1h_pct"),
        (d(k - 30) / 5.0).alias("oi_change_4h_pct"), (d(k - 20) / 4.0).alias("oi_change_24h_pct"),
        (0.8 + d(k % 50) / 100.0).alias("spot_buy_sell_ratio_1h"),
        ((v - 35) * 1000).alias("spot_net_flow_1h_usd"),
        F.when(k % 13 == 5, None).otherwise(v * 2000).alias("spot_volume_1h_usd"),
        d(k % 11 - 5).alias("price_change_1h_spot_pct"), d(k % 7 - 2).alias("price_change_4h_spot_pct"),
        d(k % 23 - 10).alias("price_change_24h_futures_pct"),
        F.when(k % 10 == 0, F.array(F.lit("Low open interest today"))).otherwise(no_text).alias("warnings"),
        F.when(k % 17 == 0, F.array(F.lit("blocked"))).otherwise(no_text).alias("blockers"),
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The last candidate per pair and hourly scan."""
    key = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(38,0)") * F.lit(
        "1" + "0" * 15
    ).cast("decimal(16,0)") + F.col("event_id").cast("decimal(38,0)")
    last = (
        scan_rows(spark, sf).withColumn("_key", key).groupBy("pair", "scan_ms")
        .agg(*[F.max_by(c, "_key").alias(c) for c in ("value", "k", "is_error")])
    )
    return candidate_columns(last)


def more_fields() -> dict[str, Column]:
    """Further fields of a candidate, derived from its others."""
    return {
        "strength": F.when(F.col("score") >= 78, "STRONG").otherwise("WEAK"), "funding_rate_pct": F.col("oi_change_1h_pct") / 8,
        "basis_pct": F.col("oi_change_24h_pct") / 4, "invalidation": F.concat(F.lit("void below "), F.col("pair")),
    }


# --- scored rows -----------------------------------------------------------

cte(
    "scored",
    f"""SELECT d.doc_id, d.source AS symbol, d.doc_id * {HOUR} AS asof_ms, l.quality AS y,
  d.n_chars / (SELECT max(n_chars) FROM documents)::DOUBLE AS p,
  CASE WHEN l.quality = 1 THEN 5.0 ELSE -1.5 END::DOUBLE AS ret
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    top = docs.agg(F.max("n_chars").cast("double")).scalar()
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select(
        "doc_id", F.col("source").alias("symbol"), (F.col("doc_id") * HOUR).alias("asof_ms"),
        F.col("quality").alias("y"), (F.col("n_chars") / top).alias("p"),
        F.when(F.col("quality") == 1, 5.0).otherwise(-1.5).alias("ret"),
    )
