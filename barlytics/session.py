"""Session settings and lineage cuts shared by every plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("barlytics")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> None:
    """Runtime settings the library relies on, whatever session it is given.

    All times are UTC, and the streaming state machines need the RocksDB store.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, a folder
    inside the session's warehouse is set. On a cluster that names none, a warehouse in
    a local folder is refused, since other machines would not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not named and not sc.master.startswith("local") and warehouse.split(":")[0] in ("file", warehouse):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or f"{warehouse}/_work")
    return sc.getCheckpointDir()


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    place, system = _place(spark, path)
    system.delete(place, True)


def folders(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Paths under ``path`` whose names fit ``pattern``."""
    place, system = _place(spark, f"{path}/{pattern}")
    return [str(s.getPath()) for s in system.globStatus(place) or []]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and continue from the written table.

    Used where a plan reads the same expensive result several times. The table
    is columnar, so every reader takes only its columns, and it is in shared
    storage, so a lost executor costs only its own tasks.
    """
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
