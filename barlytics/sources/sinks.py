"""Writers of event logs, daily snapshots, reports and state tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barlytics.session import folders, remove


def utc_day(ms: Column | str) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def append_events(events: DataFrame, path: str, time: str = "timestamp_ms") -> None:
    """Append to an event table kept by event type and day."""
    events.withColumn("day", utc_day(time)).write.mode("append").partitionBy("event", "day").json(path)


def write_daily_snapshots(snaps: DataFrame, path: str, day_from: str = "bucket_start_ms") -> None:
    """Snapshots by UTC day of ``day_from`` (bucket start or scan time).

    A day is spread over tasks by bucket, so one busy day is no single file.
    """
    out = snaps.withColumn("day", utc_day(day_from))
    out.repartition("day", day_from).write.mode("append").partitionBy("day").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A small nested report as one JSON document; refuses more than one row."""
    if len(report.limit(2).take(2)) != 1:
        raise ValueError("a report is exactly one row")
    report.coalesce(1).write.mode("overwrite").json(path)


def append_newest(rows: DataFrame, path: str, keys, order: str, batch_id: int) -> None:
    """Add the newest row of each key of a delivery to a table of newest rows.

    A delivery is a folder of its own, so nothing that is there is read or written again; the same
    delivery once more overwrites its folder, so it fits ``foreachBatch``.
    """
    _newest(rows, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_newest(spark: SparkSession, path: str, keys, order: str) -> DataFrame:
    """The newest row of each key over all deliveries."""
    return _newest(spark.read.parquet(f"{path}/batch=*"), keys, order)


def compact_newest(spark: SparkSession, path: str, keys, order: str) -> None:
    """Put the deliveries so far into one folder, as a job of its own between deliveries.

    The folder is written before the others are removed. If the job ends in between, rows are there twice, which
    does not change the newest ones.
    """
    parts = folders(spark, path, "batch=*")
    if len(parts) > 1:
        merged = f"{path}/batch=all-{uuid.uuid4().hex}"
        _newest(spark.read.parquet(*parts), keys, order).write.parquet(merged)
        for part in parts:
            remove(spark, part)


def _newest(rows: DataFrame, keys, order: str) -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("v")).select(*keys, "v.*")
