"""Greedy gap rules without a replay: keep a row if the last kept one is far enough back.

The rule is sequential by definition, but each row's follower, the first row of its key at least
a gap later, depends on nothing before it. So the kept rows are those that followers
reach from the first one, and reachability is found by pointer doubling: with the follower
``2 ** k`` steps ahead known for every row, the rows reached so far reach as many again.

A row at least a gap after the row before it is kept whatever happened earlier. It starts a
run, and followers never leave a run, so the number of rounds grows with the logarithm of the
kept rows of the longest run. Rows meet in chunks of time, so one key with most of the rows
is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlytics.operators.grid import floor_bucket
from barlytics.session import cut

#: Gaps in a chunk of time; a chunk sees one more gap on either side.
CHUNK_GAPS = 16


def followers(times: DataFrame, keys, time: str, gap_ms: int) -> DataFrame:
    """Each distinct (keys, time) with ``_starts``, whether it starts a run, and ``_next``, its follower in the run.

    One exchange: a row takes part where it lies and asks where its gap ends. A follower in the
    run is less than a gap behind that place, since neighbours in a run are closer than a gap.
    """
    keys = list(keys)
    width = gap_ms * CHUNK_GAPS
    none = F.lit(None).cast("bigint")

    def events(at: Column, row: Column, asks: Column, place: Column) -> DataFrame:
        return times.select(*keys, at.cast("bigint").alias("_at"), row.cast("bigint").alias("_row"), asks.cast("bigint").alias("_asks"), place.alias("_chunk"))

    t = F.col(time)
    chunk = floor_bucket(t, width)
    near = F.array_compact(F.array(chunk, F.when(t - chunk < gap_ms, chunk - width), F.when(chunk + width - t <= gap_ms, chunk + width)))
    rows = events(t, t, none, F.explode(near))
    asked = events(t + gap_ms, none, t, floor_bucket(t + gap_ms, width))
    met = rows.unionByName(asked)
    part = Window.partitionBy(*keys, "_chunk")
    # At one time the row comes first for who looks ahead from there, and last for who looks back.
    ahead = part.orderBy(F.desc("_at"), F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    back = part.orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("_before", F.last("_row", ignorenulls=True).over(back)).withColumn("_after", F.last("_row", ignorenulls=True).over(ahead))
    inside = F.col("_row").isNotNull() & (F.col("_chunk") == floor_bucket("_at", width))
    starts = F.col("_before").isNull() | (F.col("_at") - F.col("_before") >= gap_ms)
    follows = F.when(F.col("_after") - F.coalesce("_before", F.col("_asks")) < gap_ms, F.col("_after"))
    return met.select(
        *keys, F.coalesce("_asks", F.when(inside, F.col("_row"))).alias(time), F.when(inside, starts).alias("_starts"), F.when(F.col("_asks").isNotNull(), follows).alias("_next")
    ).filter(F.col(time).isNotNull())


def reached(times: DataFrame, keys, time: str, gap_ms: int) -> DataFrame:
    """The distinct (keys, time) that the rule keeps."""
    keys = list(keys)
    on = [*keys, time]
    facts = cut(followers(times, keys, time, gap_ms))
    return closure(facts.filter("_starts").select(*on), facts.filter("_next is not null").select(*on, "_next"), keys, time)


def closure(kept: DataFrame, jumps: DataFrame, keys, time: str) -> DataFrame:
    """What ``kept`` (keys, time) reaches over ``jumps`` (keys, time, _next), itself included; jumps go forward in time."""
    keys = list(keys)
    on = [*keys, time]
    jumps = cut(jumps)
    while not jumps.isEmpty():
        more = kept.join(jumps, on).select(*keys, F.col("_next").alias(time))
        kept = cut(kept.unionByName(more))
        ahead = jumps.select(*keys, F.col(time).alias("_next"), F.col("_next").alias("_then"))
        jumps = cut(jumps.join(ahead, [*keys, "_next"]).select(*on, F.col("_then").alias("_next")))
    return kept


def cooldown(df: DataFrame, keys, time: str, gap_ms: int, tie: str) -> DataFrame:
    """Rows kept by a greedy rule: at least ``gap_ms`` since the last kept one.

    Of several rows of a key at one time only the first (by ``tie``) can be kept. Rows with a
    null key form keys of their own value; rows with a null time are not kept.
    """
    keys = list(keys)
    if gap_ms <= 0:
        raise ValueError("the gap must be positive")
    values = [c for c in df.columns if c not in keys and c != time]
    slim = df.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.min_by(F.struct(*values), tie).alias("_v")).select(*keys, time, "_v.*")
    # Keys are compared as one hashable value, so that null keys meet each other in joins.
    named = cut(slim.withColumn("_key", F.to_json(F.struct(*keys))))
    kept = reached(named.select("_key", time), ["_key"], time, gap_ms)
    return named.join(kept, ["_key", time], "left_semi").select(*df.columns)


def rate_limit(df: DataFrame, channel: str, time: str, gap_ms: int, tie: str) -> DataFrame:
    """At most one row per channel and gap."""
    return cooldown(df, [channel], time, gap_ms, tie)
