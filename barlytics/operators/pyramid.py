"""First passages and extremes of price paths over a pyramid of highs and lows.

A row of the pyramid is a block of ``FAN ** level`` steps of time and holds its up to ``FAN``
parts, bars on the first level and smaller blocks above, each with high, low, last close and
count. A span of time is covered by a few rows of it: on each level at most one at either end,
of which only some parts lie inside, and full blocks on the top level. So an anchor meets
a number of rows that grows with the logarithm of its horizon, not with its bars.

The first part that crosses a barrier is read off the covering rows in time order. Where it
is a block, the search goes on in the row of that block, one level at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from barlytics.operators.grid import floor_bucket
from barlytics.session import cut

FAN = 8
#: A part's time and level in one number that sorts by time.
LEVELS = 16


def height(slots: float) -> int:
    """Levels for spans of so many steps: at most ``FAN`` full blocks of the top level cover one."""
    levels = 1
    while FAN ** (levels + 1) < slots:
        levels += 1
    return levels


def _low_high(entry: Column, bias: Column, high: Column, low: Column) -> tuple[Column, Column]:
    fav = F.when(bias == "SHORT", (1.0 - low / entry) * 100.0).otherwise((high / entry - 1.0) * 100.0)
    adv = F.when(bias == "SHORT", (1.0 - high / entry) * 100.0).otherwise((low / entry - 1.0) * 100.0)
    return fav, adv


def build(bars: DataFrame, step: int, levels: int, time: str = "open_time_ms", keys=("symbol",)) -> DataFrame:
    """The rows (keys, level, block, parts) over bars (keys, time, high, low, close), written once.

    A level takes one shuffle of the level below, which is an eighth of what lies under it.
    A block is named by its first time.
    """
    part = lambda at, high, low, n, end, close: F.struct(
        F.col(at).cast("bigint").alias("at"), F.col(high).alias("high"), F.col(low).alias("low"), n.cast("bigint").alias("n"),
        F.col(end).cast("bigint").alias("end"), F.col(close).alias("close"),
    )
    below, out = bars.select(*keys, F.col(time).alias("_at"), part(time, "high", "low", F.lit(1), time, "close").alias("_part")), None
    for level in range(1, levels + 1):
        rows = below.groupBy(*keys, floor_bucket("_at", step * FAN**level).alias("block")).agg(F.sort_array(F.collect_list("_part")).alias("parts"))
        rows = cut(rows.select(*keys, F.lit(level).alias("level"), "block", "parts"))
        out = rows if out is None else out.unionByName(rows)
        whole = rows.select(
            *keys, "block", F.array_max(F.transform("parts", lambda x: x["high"])).alias("high"), F.array_min(F.transform("parts", lambda x: x["low"])).alias("low"),
            F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("n"), F.element_at("parts", -1).alias("last"),
        )
        whole = whole.select("*", "last.end", "last.close")
        below = whole.select(*keys, F.col("block").alias("_at"), part("block", "high", "low", F.col("n"), "end", "close").alias("_part"))
    return out


def covering(start: Column, end: Column, step: int, levels: int) -> Column:
    """Rows (level, block, from, to) whose parts at ``from <= at < to`` are what lies in ``[start, end)``."""
    row = lambda level, block: F.struct(F.lit(level).alias("level"), block.alias("block"), start.alias("from"), end.alias("to"))
    wide = step * FAN
    first, last = floor_bucket(start, wide), floor_bucket(end - 1, wide)
    none = F.array().cast("array<struct<level:int,block:bigint,from:bigint,to:bigint>>")
    # What a level leaves to the next one are full blocks of its own width.
    found, open_span = [], start < end
    for level in range(1, levels + 1):
        top = level == levels
        ends = F.array(row(level, first), row(level, last))
        if top:
            here = F.transform(F.sequence(first, last, F.lit(wide).cast("bigint")), lambda b: row(level, b))
        else:
            here = F.when(first == last, F.array(row(level, first))).otherwise(ends)
        found.append(F.when(open_span, here).otherwise(none))
        if not top:
            start, end = first + wide, last
            open_span = open_span & (start < end)
            wide *= FAN
            first, last = floor_bucket(start, wide), floor_bucket(end - 1, wide)
    return F.concat(*found)


@dataclass(frozen=True)
class Barrier:
    """A crossing to look for: true of ``(best, worst)`` move of a part, in percent of the entry price.

    It must stay true when the best move grows or the worst falls, so a block crosses
    exactly if one of its bars does. With ``path`` the extremes up to the crossing are wanted too.
    """

    name: str
    crossed: Callable[[Column, Column], Column]
    path: bool = False


def _first(parts: Column, entry: Column, bias: Column, barrier: Barrier) -> Column:
    return F.filter(parts, lambda x: barrier.crossed(*_low_high(entry, bias, x["high"], x["low"])))[0]


def _up_to(parts: Column, entry: Column, bias: Column, part: Column, level: Column) -> tuple[Column, Column]:
    """Best and worst move of the parts before ``part``, with it if it is a bar."""
    before = F.filter(parts, lambda x: (x["at"] < part["at"]) | ((x["at"] == part["at"]) & (level == 1)))
    return _low_high(entry, bias, F.array_max(F.transform(before, lambda x: x["high"])), F.array_min(F.transform(before, lambda x: x["low"])))


def walk(
    anchors: DataFrame, pyramid: DataFrame, anchor_id: str, start: Column, ends: list[Column], barriers: list[Barrier],
    step: int, levels: int, keys=("symbol",), carry=(),
) -> DataFrame:
    """Extremes of each anchor from ``start`` to each of ``ends`` (growing, exclusive), and its first crossings.

    ``anchors``: keys, id, ``entry_price, bias`` and ``carry``. Returns the id, keys, ``entry_price,
    bias``, carry and for end ``i`` ``n_i, fav_i, adv_i, close_i``; for each barrier
    ``t_<name>`` and, if asked for, ``fav_<name>, adv_<name>`` up to the crossing. Anchors without a bar drop out.
    """
    def numbered(rows: Column, i: int) -> Column:
        return F.transform(rows, lambda r: F.struct(F.lit(i).alias("span"), *[r[c].alias(c) for c in ("level", "block", "from", "to")]))

    spans, begin = [], start
    for i, end in enumerate(ends):
        spans.append(numbered(covering(begin, end, step, levels), i))
        begin = F.greatest(begin, end)
    own = [anchor_id, *keys, "bias", "entry_price", *carry]
    asked = anchors.select(*own, F.explode(F.concat(*spans)).alias("_r")).select(*own, "_r.*")
    met = asked.join(pyramid, [*keys, "level", "block"])
    entry, bias = F.col("entry_price"), F.col("bias")
    met = met.withColumn("parts", F.filter("parts", lambda x: (x["at"] >= F.col("from")) & (x["at"] < F.col("to")))).filter(F.size("parts") > 0)
    fav, adv = _low_high(entry, bias, F.array_max(F.transform("parts", lambda x: x["high"])), F.array_min(F.transform("parts", lambda x: x["low"])))
    met = met.withColumns({"_fav": fav, "_adv": adv})
    codes = {}
    for b in barriers:
        hit = F.when(b.crossed(F.col("_fav"), F.col("_adv")), _first(F.col("parts"), entry, bias, b))
        codes[f"_hit_{b.name}"] = hit
    met = met.withColumns(codes)
    rows = met.select(
        *own, "span", F.greatest("from", "block").alias("_at"), "_fav", "_adv",
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, x: n + x["n"]).alias("_n"), F.element_at("parts", -1)["end"].alias("_end"), F.element_at("parts", -1)["close"].alias("_close"),
        *[(F.col(f"_hit_{b.name}")["at"] * LEVELS + F.col("level") - 1).alias(f"_c_{b.name}") for b in barriers],
        *[x.alias(f"_{k}_{b.name}") for b in barriers if b.path for k, x in zip(("f", "a"), _up_to(F.col("parts"), entry, bias, F.col(f"_hit_{b.name}"), F.col("level")))],
    )
    # One exchange by anchor serves the window and the aggregate. A crossing row sees the extremes before it; of several
    # crossing rows the first one has seen least, so the least of the extremes is its own.
    before = Window.partitionBy(anchor_id).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    paths = [b for b in barriers if b.path]
    if paths:
        rows = rows.withColumns({"_pf": F.max("_fav").over(before), "_pa": F.min("_adv").over(before)})
    aggs = []
    for i in range(len(ends)):
        inside = F.col("span") <= i
        aggs += [
            F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias(f"n_{i}"), F.max(F.when(inside, F.col("_fav"))).alias(f"fav_{i}"),
            F.min(F.when(inside, F.col("_adv"))).alias(f"adv_{i}"), F.max_by("_close", F.when(inside, F.col("_end"))).alias(f"close_{i}"),
        ]
    aggs += [F.min(f"_c_{b.name}").alias(f"_c_{b.name}") for b in barriers]
    for b in paths:
        hit = F.col(f"_c_{b.name}").isNotNull()
        aggs += [
            F.min(F.when(hit, F.coalesce(F.greatest("_pf", f"_f_{b.name}"), F.lit(float("-inf"))))).alias(f"fav_{b.name}"),
            F.max(F.when(hit, F.coalesce(F.least("_pa", f"_a_{b.name}"), F.lit(float("inf"))))).alias(f"adv_{b.name}"),
        ]
    facts = rows.groupBy(*own).agg(*aggs)
    if levels > 1:
        facts = _descend(cut(facts), pyramid, anchor_id, barriers, levels, keys)
    return facts.withColumns({f"t_{b.name}": F.floor(F.col(f"_c_{b.name}") / LEVELS).cast("bigint") for b in barriers}).drop(*[f"_c_{b.name}" for b in barriers])


def _descend(facts: DataFrame, pyramid: DataFrame, anchor_id: str, barriers: list[Barrier], levels: int, keys) -> DataFrame:
    """``facts`` with every crossing followed down to its bar: a join of one row for each crossing and level."""
    none = F.lit(None).cast("double")
    items = [
        F.struct(F.lit(i).alias("which"), F.col(f"_c_{b.name}").alias("code"), (F.col(f"fav_{b.name}") if b.path else none).alias("best"), (F.col(f"adv_{b.name}") if b.path else none).alias("worst"))
        for i, b in enumerate(barriers)
    ]
    own = [anchor_id, *keys, "bias", "entry_price"]
    rows = facts.select(*own, F.explode(F.array(*items)).alias("_i")).select(*own, "_i.*").filter("code is not null")
    entry, bias = F.col("entry_price"), F.col("bias")
    for _ in range(levels - 1):
        rows = rows.withColumns({"level": F.pmod("code", F.lit(LEVELS)).cast("int"), "block": F.floor(F.col("code") / LEVELS).cast("bigint")})
        met = rows.join(pyramid, [*keys, "level", "block"], "left")  # a bar has no row and stays
        hit = reduce(lambda other, ib: F.when(F.col("which") == ib[0], _first(F.col("parts"), entry, bias, ib[1])).otherwise(other), enumerate(barriers), F.lit(None))
        met = met.withColumn("_hit", F.when(F.col("parts").isNotNull(), hit))
        fav, adv = _up_to(F.col("parts"), entry, bias, F.col("_hit"), F.col("level"))
        found = F.col("_hit").isNotNull()
        rows = met.select(
            *own, "which", F.when(found, F.col("_hit")["at"] * LEVELS + F.col("level") - 1).otherwise(F.col("code")).alias("code"),
            F.when(found, F.greatest("best", fav)).otherwise(F.col("best")).alias("best"), F.when(found, F.least("worst", adv)).otherwise(F.col("worst")).alias("worst"),
        )
    picked = []
    for i, b in enumerate(barriers):
        picked.append(F.max(F.when(F.col("which") == i, F.col("code"))).alias(f"_c_{b.name}"))
        if b.path:
            picked += [F.max(F.when(F.col("which") == i, F.col(c))).alias(f"{n}_{b.name}") for c, n in (("best", "fav"), ("worst", "adv"))]
    crossings = rows.groupBy(anchor_id).agg(*picked)
    replaced = [f"_c_{b.name}" for b in barriers] + [f"{n}_{b.name}" for b in barriers if b.path for n in ("fav", "adv")]
    return facts.drop(*replaced).join(crossings, anchor_id, "left")
