"""Reading inputs, slicing Arrow batches, and tables written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlytics.session import shared_dir

#: Rows of a batch that are Python objects at the same time.
SLICE = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def release() -> None:
    """Gives back what earlier batches of this worker used; the pool keeps it otherwise."""
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            yield batch.slice(i, SLICE)
        del batch
        release()


def strings(column: pa.Array) -> list[str]:
    """Python strings, null as empty."""
    return [x or "" for x in column.to_pylist()]


_held: dict[str, Callable[[], None]] = {}


def holds(owner: str, clear: Callable[[], None]) -> None:
    """Says that ``owner`` now fills its tables in this worker; those of other operators are emptied.

    Workers live on from stage to stage, and each operator remembers words or models.
    """
    for other in [k for k in _held if k != owner]:
        _held.pop(other)()
        release()
    _held[owner] = clear


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Where the tables that ``stored`` gave out lie, and the lists that open ``collected`` blocks fill.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_collecting: list[list[str]] = []


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder; continues from the written table."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[out] = path
    for paths in _collecting:
        paths.append(path)
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage, if it is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(conf).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Deletes what ``stored`` wrote for these tables; nothing that is still to run may read them."""
    for table in tables:
        if path := _places.pop(table, None):
            remove(table.sparkSession, path)


@contextmanager
def collected() -> Iterator[list[str]]:
    """The folders that ``stored`` writes inside the block."""
    paths: list[str] = []
    _collecting.append(paths)
    try:
        yield paths
    finally:
        _collecting.remove(paths)


def free(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores in front as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drawn(hashed: Column, share: float) -> Column:
    """True for ``share`` of all values of a signed 64-bit hash."""
    return hashed <= min(int(share * 2**64) - 2**63, 2**63 - 1)


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``place``, the number of a row in its group, and ``total``, the group's size.

    Rows are dealt out by range, sorted and written with the number of their task; what
    earlier tasks hold of a group is added up over one row for each group and task.
    Equal rows are dealt out too, by where they came from.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    rows = rows.withColumn("_salt", spread).repartitionByRange(*by, "_salt").sortWithinPartitions(*by).drop("_salt")
    rows = stored(rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), name)
    sizes = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    each = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(*group, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(each).alias("total"))
    placed = rows.join(sizes, [*group, "_part"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_before"))
    return placed.drop("_part", "_at", "_first", "_before")
