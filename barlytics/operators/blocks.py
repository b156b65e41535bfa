"""Window work on long series, split into bounded blocks.

A window partitioned by symbol alone puts a whole series into one task. The two
helpers here give the same results with partitions of bounded length:

* ``roll`` numbers the rows of each series, cuts the numbers into blocks and
  copies the last rows of a block to the next one, so that each rolling frame is
  complete inside its block. Frames count rows, not time, so gaps are safe.
* ``prefix`` computes everything-before-me values by a scan inside time chunks
  plus one small row per chunk that carries the state of the earlier chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

POS = "pos"


#: Frames up to this many rows are left to the window operator, which goes through the
#: frame anew for each row; longer ones are made of two running values.
SHORT = 64


@dataclass(frozen=True)
class Frame:
    """``max``, ``min``, ``sum``, ``count`` or ``avg`` of a column over ``rows`` rows, as it stood ``back`` rows ago."""

    column: str
    kind: str
    rows: int
    back: int = 0

    @property
    def name(self) -> str:
        return f"_{self.kind}_{self.rows}_{self.column}"

    @property
    def long(self) -> bool:
        return self.rows > SHORT

    def over(self, w: WindowSpec) -> Column:
        if self.long:
            return F.lag(self.name, self.back).over(w) if self.back else F.col(self.name)
        make = {**_AGG, "count": F.count, "avg": F.avg}[self.kind]
        return make(self.column).over(w.rowsBetween(-(self.rows + self.back - 1), -self.back))


@dataclass(frozen=True)
class Roll:
    """A rolling expression, the number of earlier rows it looks at, and the frames it uses."""

    need: int
    build: Callable[[WindowSpec], Column]
    frames: tuple[Frame, ...] = ()


#: Groups into which the chunks of a series without keys are put.
GROUPS = 256

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


def _over(col, kind: str, w: WindowSpec) -> Column:
    return _AGG[kind](col).over(w) if kind in _AGG else F.last(col, ignorenulls=True).over(w)


def _joined(here: Column, earlier: Column, kind: str) -> Column:
    if kind == "sum":
        return F.coalesce(here, F.lit(0)) + F.coalesce(earlier, F.lit(0))
    return {"max": F.greatest, "min": F.least}.get(kind, F.coalesce)(here, earlier)


def scan_chunks(rows: DataFrame, keys, kinds: dict[str, str], few: bool = False) -> DataFrame:
    """Each column of ``kinds`` over all earlier ``_chunk`` rows of the key (null before the first).

    With keys a window holds the chunk rows of one key; so it does without, where the chunks are ``few``:
    bins of ``depth``, at most ``GROUPS`` at any size. Otherwise chunks are put into up to
    ``GROUPS`` groups of consecutive ones; a window holds the chunks of a group, and the
    groups' totals, one row each, are sent to the groups behind.
    """
    keys = list(keys)
    if keys or few:
        before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        return rows.select(*keys, "_chunk", *[_over(F.col(c), kind, before).alias(c) for c, kind in kinds.items()])
    shares = [i / GROUPS for i in range(1, GROUPS)]
    edges = sorted(set(rows.agg(F.percentile_approx("_chunk", shares)).first()[0] or []))
    group = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("_chunk"))) if edges else F.lit(0)
    rows = rows.withColumn("_group", group)
    inside = Window.partitionBy("_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c, kind: _AGG[kind](c) if kind in _AGG else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_chunk")))
    totals = rows.groupBy("_group").agg(*[own(c, kind).alias(c) for c, kind in kinds.items()])
    ahead = F.explode(F.sequence(F.col("_group") + 1, F.lit(len(edges))))
    sent = totals.filter(F.col("_group") < len(edges)).select(ahead.alias("_to"), "*")
    gone = lambda c, kind: _AGG[kind](c) if kind in _AGG else F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_group")))
    earlier = sent.groupBy(F.col("_to").alias("_group")).agg(*[gone(c, kind).alias(f"_e_{c}") for c, kind in kinds.items()])
    local = rows.select("_group", "_chunk", *[_over(F.col(c), kind, inside).alias(c) for c, kind in kinds.items()])
    both = local.join(earlier, "_group", "left")
    return both.select("_chunk", *[_joined(F.col(c), F.col(f"_e_{c}"), kind).alias(c) for c, kind in kinds.items()])


def depth(df: DataFrame, by, column: str, parts: int = GROUPS) -> DataFrame:
    """Adds ``_depth``: which of ``parts`` bins of about equally many rows of the group the value lies in.

    Edges are approximate quantiles, so bins follow the values however close they lie; equal
    values share a bin.
    """
    by = list(by)
    edges = df.groupBy(*by).agg(F.sort_array(F.percentile_approx(column, [i / parts for i in range(1, parts)])).alias("_edges"))
    near = df.join(edges, by) if by else df.withColumn("_edges", edges.scalar())
    # Halving finds the number of edges at or below the value; a filter would call its condition for each of them.
    bits = F.array(*[F.lit(2**i) for i in reversed(range((parts - 1).bit_length()))])
    further = lambda at, bit: F.when(F.get("_edges", at + bit - 1) <= F.col(column), at + bit).otherwise(at)
    return near.withColumn("_depth", F.when(F.col("_edges").isNotNull(), F.aggregate(bits, F.lit(0), further))).drop("_edges")


def with_position(df: DataFrame, keys, time: str, chunk: Column, few: bool = False) -> DataFrame:
    """Number the rows of each key from 0 in time order, without one long window.

    Rows are numbered inside time chunks and shifted by the row counts of the
    earlier chunks. The counts are one small row per key and chunk.
    """
    keys = list(keys)
    base = df.withColumn("_chunk", chunk)
    offsets = scan_chunks(base.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_off")), keys, {"_off": "sum"}, few)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(time)
    return (
        base.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(POS, (F.coalesce("_off", F.lit(0)) + F.col("_rn") - 1).cast("bigint"))
        .drop("_chunk", "_rn", "_off")
    )


def sliding(df: DataFrame, keys, rows: int, frames) -> DataFrame:
    """Adds the values of ``frames``, all ``rows`` rows long, over ``pos``; also adds ``_sub``.

    The numbers are cut into pieces of ``rows`` rows. A frame is the end of one piece and the
    start of the next, so two running values, one from each side of a piece, make it: the work
    for a row does not depend on ``rows``, and sums are added up, never taken off again.
    The first frames of a key are shorter; nulls are left out as in a plain frame.
    """
    keys = list(keys)
    df = df.withColumn("_sub", F.floor(F.col(POS) / rows))
    ends = {"max": ("max",), "min": ("min",), "sum": ("sum",), "count": ("count",), "avg": ("sum", "count")}
    parts = sorted({(end, f.column) for f in frames for end in ends[f.kind]})
    value = lambda end, c, w: {**_AGG, "count": F.count}[end](c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    piece = Window.partitionBy(*keys, "_sub")
    # The last window sorts as the one that looks back, so the two share a sort.
    df = df.withColumns({f"_t_{end}_{c}": value(end, c, piece.orderBy(F.desc(POS))) for end, c in parts})
    df = df.withColumns({f"_h_{end}_{c}": value(end, c, piece.orderBy(POS)) for end, c in parts})
    along = Window.partitionBy(*keys).orderBy("_sub", POS)
    # A frame that fills its piece is the running value alone.
    split = F.pmod(F.col(POS), F.lit(rows)) != rows - 1
    df = df.withColumns({f"_t_{end}_{c}": F.when(split, F.lag(f"_t_{end}_{c}", rows - 1).over(along)) for end, c in parts})

    def both(end, c):
        tail, head = F.col(f"_t_{end}_{c}"), F.col(f"_h_{end}_{c}")
        if end in ("max", "min"):
            return _joined(head, tail, end)
        return F.coalesce(tail + head, tail, head)

    made = lambda f: both("sum", f.column) / both("count", f.column) if f.kind == "avg" else both(f.kind, f.column)
    df = df.withColumns({f.name: made(f) for f in frames})
    return df.drop(*[f"_{side}_{end}_{c}" for side in "th" for end, c in parts])


def roll(
    df: DataFrame,
    stages: dict[str, Roll] | list[dict[str, Roll]],
    step: int,
    keys=("symbol",),
    time: str = "open_time_ms",
    block_rows: int = 65_536,
) -> DataFrame:
    """Add rolling columns per key in time order; also adds ``pos``.

    Stages run one after the other, a later one may read the columns of an
    earlier one. Frames longer than ``SHORT`` rows are worked out by ``sliding``.
    """
    keys = list(keys)
    stages = [stages] if isinstance(stages, dict) else stages
    halo = sum(max(r.need for r in stage.values()) for stage in stages)
    block_rows = max(block_rows, halo, 1)
    numbered = df if POS in df.columns else with_position(
        df, keys, time, F.col(time) - F.pmod(F.col(time), F.lit(step * block_rows))
    )
    block = F.floor(F.col(POS) / block_rows)
    in_halo = F.pmod(F.col(POS), F.lit(block_rows)) >= block_rows - halo
    spread = numbered.withColumn(
        "_block",
        F.explode(F.when(in_halo, F.array(block, block + 1)).otherwise(F.array(block))),
    )
    if any(f.long for stage in stages for r in stage.values() for f in r.frames):
        # Windows over pieces of a block then find the block's rows together.
        spread = spread.repartition(*keys, "_block")
    for stage in stages:
        w = Window.partitionBy(*keys, "_block").orderBy(POS)
        long = {f.name: f for r in stage.values() for f in r.frames if f.long}
        for rows in sorted({f.rows for f in long.values()}):
            spread = sliding(spread, [*keys, "_block"], rows, [f for f in long.values() if f.rows == rows])
            w = Window.partitionBy(*keys, "_block").orderBy("_sub", POS)
        spread = spread.withColumns({name: r.build(w) for name, r in stage.items()}).drop("_sub", *long)
    return spread.filter(F.col("_block") == block).drop("_block")


def prefix(
    df: DataFrame,
    keys,
    order,
    chunk: Column,
    specs: dict[str, tuple[str, str]],
    few: bool = False,
) -> DataFrame:
    """Values over all earlier rows of the key: ``{out: (column, kind)}``.

    ``kind`` is ``max``, ``min``, ``sum`` (0 when nothing is before), ``last``
    (last non-null) or ``lag`` (the row just before). ``chunk`` must grow with
    ``order``; a window partition holds one chunk of one key. ``few`` says that chunks are bins of ``depth``.
    """
    keys = list(keys)
    order = [order] if isinstance(order, (str, Column)) else list(order)
    base = df.withColumn("_chunk", chunk)
    lags = {c for c, kind in specs.values() if kind == "lag"}
    for c in lags:
        base = base.withColumn(f"_box_{c}", F.struct(F.col(c).alias("v")))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    key_struct = F.struct(*order)

    def total(out, c, kind):
        if kind in _AGG:
            return _AGG[kind](c).alias(out)
        src = F.col(f"_box_{c}") if kind == "lag" else F.col(c)
        return F.max_by(src, F.when(src.isNotNull(), key_struct)).alias(out)

    carry = base.groupBy(*keys, "_chunk").agg(
        *[total(f"_c_{o}", c, kind) for o, (c, kind) in specs.items()]
    )
    carry = scan_chunks(carry, keys, {f"_c_{o}": kind for o, (c, kind) in specs.items()}, few)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumns(
        {
            f"_l_{o}": _over(F.col(f"_box_{c}") if kind == "lag" else F.col(c), kind, run)
            for o, (c, kind) in specs.items()
        }
    )
    joined = local.join(carry, [*keys, "_chunk"])

    def merged(o, kind):
        both = _joined(F.col(f"_l_{o}"), F.col(f"_c_{o}"), kind)
        return both["v"] if kind == "lag" else both

    out = joined.withColumns({o: merged(o, kind) for o, (c, kind) in specs.items()})
    helper = ["_chunk"] + [f"_box_{c}" for c in lags]
    helper += [f"_l_{o}" for o in specs] + [f"_c_{o}" for o in specs]
    return out.drop(*helper)


#: Natural logarithm up to which a weight may grow inside a block, and the one at which
#: what is left of an earlier block is below the smallest double.
GROWTH, VANISHED = 345.0, 1085.0


def fold_blocks(decay: float, block_rows: int | None = None) -> tuple[int, int]:
    """Rows of a block, and the number of later blocks on which a block still acts.

    Weights inside a block grow as ``decay ** -row``, so a block is short where values
    fade fast; where they fade slowly it is long enough that few blocks act.
    """
    fade = -math.log(decay)
    longest = max(int(GROWTH / fade), 1)
    rows = min(longest, block_rows or max(65_536, math.ceil(VANISHED / fade / 256)))
    return rows, math.ceil(VANISHED / fade / rows)


def fold_linear(
    df: DataFrame,
    keys,
    columns: dict[str, str],
    decay: float,
    gain: float,
    seed_rows: int,
    block_rows: int | None = None,
) -> DataFrame:
    """Recurrence ``y = decay * y_before + gain * x`` per key, over ``pos``.

    ``columns`` maps each output to its input. The first value, at row
    ``seed_rows - 1``, is the mean of the first ``seed_rows`` inputs; earlier
    rows give null. Inside a block ``y`` is ``decay ** row`` times a running sum of
    inputs weighted with ``decay ** -row``. A block's total is one small row, sent to
    the few later blocks where it is still above the smallest double. Work is
    linear, no window holds more than a block, and nothing is gathered by key.

    Returns the keys, ``pos`` and the outputs.
    """
    keys = list(keys)
    if decay == 0:
        if seed_rows > 1:
            raise ValueError("a mean without memory has a seed of one row")
        own = lambda c: F.when(F.col(POS) == 0, F.col(c)).otherwise(F.col(c) * gain)
        return df.select(*keys, POS, *[own(c).alias(o) for o, c in columns.items()])
    rows, reach = fold_blocks(decay, block_rows)
    step = F.greatest(F.col(POS) - (seed_rows - 1), F.lit(0))
    weight = F.when(F.col(POS) >= seed_rows, F.lit(gain)).otherwise(F.lit(1.0 / seed_rows))
    base = df.select(
        *keys, POS, F.floor(step / rows).alias("_block"), F.pmod(step, F.lit(rows)).alias("_row"),
        *[(weight * F.col(c) * F.pow(F.lit(decay), -F.pmod(step, F.lit(rows)))).alias(f"_b_{o}") for o, c in columns.items()],
    )
    ahead = F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_ahead")
    totals = base.groupBy(*keys, "_block").agg(*[F.sum(f"_b_{o}").alias(f"_b_{o}") for o in columns])
    carry = totals.select("*", ahead).select(
        *keys, (F.col("_block") + F.col("_ahead")).alias("_block"),
        *[(F.col(f"_b_{o}") * F.pow(F.lit(decay), F.col("_ahead") * float(rows))).alias(f"_c_{o}") for o in columns],
    ).groupBy(*keys, "_block").agg(*[F.sum(f"_c_{o}").alias(f"_c_{o}") for o in columns])
    inside = Window.partitionBy(*keys, "_block").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumns({f"_b_{o}": F.sum(f"_b_{o}").over(inside) for o in columns})
    value = lambda o: F.pow(F.lit(decay), F.col("_row")) * (F.col(f"_b_{o}") + F.coalesce(f"_c_{o}", F.lit(0.0)))
    return local.join(carry, [*keys, "_block"], "left").select(
        *keys, POS, *[F.when(F.col(POS) >= seed_rows - 1, value(o)).alias(o) for o in columns]
    )
