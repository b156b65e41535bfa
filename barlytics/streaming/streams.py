"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barlytics.session import prepare, shared_dir


#: Event name of a row that came after newer rows of its key had been worked on.
LATE = "LATE_INPUT"


class KeyedMachine(StatefulProcessor):
    """Runs a transition function over each key's rows of a micro-batch in order.

    The state of a key is one JSON value. Rows of a micro-batch are sorted by
    event order first. A row that is older than the last one its key has seen in
    an earlier micro-batch can no longer be worked on in order; it is given out as an
    event ``LATE_INPUT`` with what the row has of the output's columns.

    ``deadline(state)`` says until when the state may wait for a further row (null:
    for ever). When the watermark passes that time, ``expired(state, key, deadline)`` changes the
    state and returns the event. A row that comes before that is worked on first.
    """

    def __init__(self, step: Callable, order: list[str], names: list[str], keys: list[str], deadline: Callable | None = None, expired: Callable | None = None):
        self.step, self.order, self.names, self.keys = step, order, names, keys
        self.deadline, self.expired = deadline, expired

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "body string")

    def _held(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"machine": {}, "at": None, "timer": None}

    def _keep(self, held: dict) -> None:
        if self.deadline is not None:
            until = self.deadline(held["machine"])
            if until != held["timer"]:
                if held["timer"] is not None:
                    self.handle.deleteTimer(held["timer"])
                if until is not None:
                    self.handle.registerTimer(until)
                held["timer"] = until
        self.state.update((json.dumps(held, default=float),))

    def _late(self, row) -> tuple:
        own = {"event": LATE, "kind": LATE, "timestamp_ms": int(getattr(row, self.order[0]))}
        return tuple(own[n] if n in own else getattr(row, n, None) for n in self.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        out = []
        # A micro-batch holds the scans of one trigger, so few rows per key.
        for row in pd.concat(rows).sort_values(self.order, kind="stable").itertuples(index=False, name="Row"):
            at = int(getattr(row, self.order[0]))
            if held["at"] is not None and at < held["at"]:
                out.append(self._late(row))
                continue
            held["at"] = at
            made = self.step(held["machine"], row)
            out += made if isinstance(made, list) else [] if made is None else [made]
        self._keep(held)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        at = int(expiredTimerInfo.getExpiryTimeInMs())
        out = []
        if held["timer"] == at:
            held["timer"] = None
            made = self.expired(held["machine"], key, at)
            out = [] if made is None else [made]
            self._keep(held)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stateful(
    stream: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str,
    timers: tuple[Callable, Callable] | None = None, delay: str = "1 hour",
) -> DataFrame:
    """Attach a state machine to a stream of rows.

    With ``timers`` (deadline, expired) states that wait are ended by event time: the first order
    column, in milliseconds, drives a watermark that stays ``delay`` behind. Rows older than the
    watermark do not reach the machine, so ``delay`` is the lateness up to which late rows still show.
    """
    prepare(stream.sparkSession)
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    if timers is not None:
        stream = stream.withColumn("_event_time", F.timestamp_millis(F.col(order[0]))).withWatermark("_event_time", delay)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=KeyedMachine(step, order, names, list(keys), *(timers or ())), outputStructType=T._parse_datatype_string(schema),
        outputMode="append", timeMode="None" if timers is None else "EventTime",
    )


def first_per_bucket(stream: DataFrame, time: str, every: str = "15 minutes", delay: str = "10 minutes", values=()) -> DataFrame:
    """First row of every tumbling window, emitted once the window is closed."""
    w = F.window(time, every)
    order = F.struct(time, *values)
    return (
        stream.withWatermark(time, delay).groupBy(w.alias("w")).agg(F.min(order).alias("first"))
        .select(F.col("w.start").alias("bucket_start"), "first.*")
    )


def label_late(stream: DataFrame, event_ms: str, observed_ms: str, max_age_ms: int = 600_000) -> DataFrame:
    """Keep every row; say whether it came from the future or too late."""
    age = F.col(observed_ms) - F.col(event_ms)
    return stream.withColumn(
        "lateness", F.when(age < 0, "FUTURE_TIMESTAMP").when(age > max_age_ms, "STALE_AT_OBSERVATION").otherwise("ON_TIME")
    )


def once_per_id(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats of an id that arrive within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def table_dir(spark: SparkSession, name: str) -> str:
    """A new folder for a table in the shared folder of the cluster."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _run_available(writer, spark: SparkSession) -> None:
    """Run a stream over what is there, with one state partition per core.

    The number of state partitions is fixed when a stream first starts, so it
    follows the cluster, not the default of batch shuffles.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there into a table and read the table."""
    spark = stream.sparkSession
    out = table_dir(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{out}/data").outputMode("append")
    _run_available(writer.option("checkpointLocation", f"{out}/offsets"), spark)
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def arrive(
    df: DataFrame, name: str, time: str, attach: Callable[[DataFrame], DataFrame] = lambda s: s,
    job: Callable[[DataFrame, int, str], None] | None = None, parts: int = 2,
) -> DataFrame:
    """Let a table arrive as ``parts`` deliveries in time order; read the result.

    After each delivery the stream runs over what is new and stops, so a key
    never sees rows of a later delivery first, and every delivery but the first
    resumes from the checkpoint. With ``job`` each micro-batch goes to
    ``job(batch, batch_id, table)``, which names its folder by the batch id so
    that a repeated batch overwrites its own rows.
    """
    spark = df.sparkSession
    out = table_dir(spark, name)
    inner = df.agg(F.percentile_approx(time, [i / parts for i in range(1, parts)])).first()[0] or []
    edges = [None, *inner, None]
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        part = df if lo is None else df.filter(F.col(time) > lo)
        part = part if hi is None else part.filter(F.col(time) <= hi)
        part.write.parquet(f"{out}/landing/part={i}")
        events = attach(spark.readStream.schema(df.schema).parquet(f"{out}/landing/part=*"))
        if job is None:
            writer = events.writeStream.format("parquet").option("path", f"{out}/data").outputMode("append")
        else:
            writer = events.writeStream.foreachBatch(lambda batch, i: job(batch, i, f"{out}/data"))
        _run_available(writer.option("checkpointLocation", f"{out}/offsets"), spark)
    return spark.read.schema(events.schema).parquet(f"{out}/data") if job is None else spark.read.parquet(f"{out}/data")
