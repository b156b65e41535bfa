"""Streams over landing folders of scans: state machines, snapshots, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from barlytics.functions.gates import fresh
from barlytics.session import cut, remove
from barlytics.sources import files, sinks
from barlytics.streaming import machines as mc, streams

MACHINES = {
    "confirm": (mc.confirm_input, mc.confirm_and_monitor, mc.CONFIRM_EVENTS, None),
    "arm": (mc.arm_input, mc.arm_confirm_manage, mc.ARM_EVENTS, mc.arm_timers),
}


def scan_candidates(scans: DataFrame, now=None) -> DataFrame:
    """Candidates of scans that are fresh at ``now``."""
    now = F.unix_millis(F.current_timestamp()) if now is None else now
    ok = scans.filter(F.col("pair").isNotNull() & fresh("generated_at_ms", "cache_age_seconds", now))
    return ok.withColumn("scan_ms", F.col("generated_at_ms"))


def start_machine(spark: SparkSession, landing: str, out: str, name: str, now=None, trigger: dict | None = None) -> StreamingQuery:
    """Run one state machine over arriving scan documents into an event table.

    Late rows appear as ``LATE_INPUT`` events, armed setups end by event time also without a further scan.
    """
    prepare_input, machine, schema, timers = MACHINES[name]
    rows = prepare_input(scan_candidates(files.stream_scans(spark, landing), now))
    events = streams.stateful(rows, ["pair"], ["scan_ms"], machine(), schema, timers and timers())
    return (
        events.writeStream.format("json").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/_offsets/{name}")
        .outputMode("append").trigger(**(trigger or {"processingTime": "5 minutes"})).start()
    )


def start_state_table(spark: SparkSession, landing: str, out: str, now=None, trigger: dict | None = None) -> StreamingQuery:
    """Add each delivery's last row of every pair to a table of newest rows (``sinks.read_newest``)."""
    rows = scan_candidates(files.stream_scans(spark, landing), now)

    def merge(batch: DataFrame, batch_id: int) -> None:
        sinks.append_newest(batch.drop("section"), f"{out}/pairs", "pair", "scan_ms", batch_id)

    return (
        rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/_offsets/pairs")
        .trigger(**(trigger or {"processingTime": "5 minutes"})).start()
    )


def settle(batch: DataFrame, batch_id: int, out: str, waiting: str, horizons_ms: list[int], label: Callable[[DataFrame], DataFrame]) -> None:
    """Label the (trigger, horizon) pairs that a delivery makes ripe.

    The newest trigger of the delivery tells the time. Pairs that are not ripe wait in
    ``waiting``, in the folder of their batch, and are all that the next batch reads: no result is read
    again. A repeated batch overwrites its own folders; folders that no batch can
    need any more are removed. ``label`` maps the due pairs to result rows.
    """
    spark = batch.sparkSession
    now = batch.agg(F.max("asof_ms")).first()[0]
    pairs = batch.withColumn("horizon_ms", F.explode(F.array(*[F.lit(h).cast("bigint") for h in horizons_ms])))
    if batch_id > 0:
        pairs = pairs.unionByName(spark.read.schema(pairs.schema).parquet(f"{waiting}/batch={batch_id - 1}"))
    if now is None:
        now = pairs.agg(F.max("asof_ms")).first()[0] or 0
    ripe = F.lit(now) - F.col("asof_ms") >= F.col("horizon_ms")
    label(cut(pairs.filter(ripe))).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    pairs.filter(~ripe).write.mode("overwrite").parquet(f"{waiting}/batch={batch_id}")
    remove(spark, f"{waiting}/batch={batch_id - 2}")
