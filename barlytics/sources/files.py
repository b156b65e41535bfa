"""Readers of candle files, manifests, event logs and scan documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from barlytics import schema as S

# <symbol>/<interval>_<days>d.jsonl.gz; partition-style folder names are fine too.
CANDLE_PATH = r"/(?:[^/=]+=)?([^/=]+)/(?:[^/=]+=)?([0-9]+[a-z]+)_([0-9]+)d\.jsonl(?:\.gz)?"


def _path_parts(path: Column) -> dict[str, Column]:
    return {
        "symbol": F.regexp_extract(path, CANDLE_PATH, 1),
        "interval": F.regexp_extract(path, CANDLE_PATH, 2),
        "days": F.regexp_extract(path, CANDLE_PATH, 3).cast("int"),
    }


def candle_files(spark: SparkSession, root: str) -> DataFrame:
    """Symbol, interval, days and path of every candle file below ``root``; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return listed.withColumns(_path_parts(F.col("path"))).filter("symbol <> ''").select("symbol", "interval", "days", "path")


def resolve_interval_file(files: DataFrame, want: Column | int) -> DataFrame:
    """Per symbol and interval the exact length, else the last name in order."""
    want = F.lit(want) if isinstance(want, int) else want
    name = F.concat(F.col("interval"), F.lit("_"), F.col("days").cast("string"), F.lit("d"))
    w = Window.partitionBy("symbol", "interval").orderBy(F.desc(F.col("days") == want), F.desc(name))
    lengths = files.select("symbol", "interval", "days").distinct()
    return lengths.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("symbol", "interval", "days")


def read_bars(spark: SparkSession, root: str, days: int | None = None) -> DataFrame:
    """Candles of all symbols and intervals from (gzipped) JSON lines.

    Symbol, interval and length come from the path. With ``days`` given, each
    symbol and interval is read from the one file that resolves to it. Gzipped
    files cannot be split: store them once with ``store_bars`` and read that.
    """
    read = spark.read.schema(S.BAR)
    if days is None:
        raw = read.option("recursiveFileLookup", "true").json(root)
    else:
        listed = candle_files(spark, root)
        chosen = listed.join(resolve_interval_file(listed, days), ["symbol", "interval", "days"])
        raw = read.json([r["path"] for r in chosen.select("path").collect()])  # file names, as the reader lists them itself
    return raw.withColumns(_path_parts(F.input_file_name()))


#: Bars of a symbol and interval that are written by one task, at most.
SLICE_BARS = 262_144


def store_bars(bars: DataFrame, path: str) -> None:
    """Columnar copy of candles, one folder per interval and symbol.

    Rows are spread by symbol and slices of ``SLICE_BARS`` bars' time, so a busy symbol is written by
    several tasks and a short series is one file or two, at any number of tasks.
    """
    length = F.greatest(F.col("close_time_ms") - F.col("open_time_ms") + 1, F.lit(1))
    part = F.floor(F.col("open_time_ms") / (length * SLICE_BARS))
    out = bars.repartition("interval", "symbol", part).sortWithinPartitions("interval", "symbol", "open_time_ms")
    out.write.mode("overwrite").partitionBy("interval", "symbol").parquet(path)


def read_stored_bars(spark: SparkSession, path: str) -> DataFrame:
    # Folder values are typed here: a guess would read the interval 1d as a number.
    fields = [*S.BAR.fields, T.StructField("days", T.IntegerType()), T.StructField("interval", T.StringType()), T.StructField("symbol", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file listed in the manifest document."""
    doc = spark.read.schema(S.MANIFEST).option("multiLine", "true").json(path)
    return doc.select("days", "status", F.explode("files").alias("f")).select("days", "status", "f.*")


KLINE = ["open_time_ms", "open", "high", "low", "close", "volume", "close_time_ms", "quote_volume", "trades", "taker_buy_base_volume", "taker_buy_quote_volume"]


def klines_to_bars(df: DataFrame, column: str = "kline") -> DataFrame:
    """Typed bars from positional JSON arrays (numbers may be strings)."""
    types = {f.name: f.dataType for f in S.BAR.fields}
    a = F.from_json(column, "array<string>")
    rest = [c for c in df.columns if c != column]
    return df.withColumn("_a", a).select(*rest, *[F.col("_a")[i].cast(types[c]).alias(c) for i, c in enumerate(KLINE)])


def read_events(spark: SparkSession, path: str, event: str, keep: str = "last") -> DataFrame:
    """Trigger events of one type from a JSON-lines log, one row per id.

    Lines that do not parse and rows without the needed fields are skipped.
    ``keep`` is ``last`` or ``first`` in log order, or ``newest`` by timestamp.
    """
    # Log order is the file's place and the line's place in it.
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    log = spark.read.schema(S.TRIGGER_EVENT).option("mode", "DROPMALFORMED").json(path).withColumn("_place", place)
    bias = F.upper(F.coalesce("bias", F.lit("")))
    ok = log.filter(F.col("event") == event).withColumn("bias", bias).filter(
        F.col("symbol").isNotNull() & F.col("bias").isin("LONG", "SHORT") & F.col("timestamp_ms").isNotNull() & F.col("trigger_price").isNotNull()
    )
    made = F.concat_ws("-", "symbol", F.col("timestamp_ms").cast("string"))
    ok = ok.withColumn("trigger_id", F.coalesce(F.nullif("trigger_id", F.lit("")), made))
    values = [c for c in ok.columns if c not in ("trigger_id", "_place")]
    pick = {"last": F.max_by, "first": F.min_by, "newest": F.max_by}[keep]
    order = F.struct("timestamp_ms", "_place") if keep == "newest" else F.col("_place")
    return ok.groupBy("trigger_id").agg(pick(F.struct(*values), order).alias("v")).select("trigger_id", "v.*")


def _explode_scan(docs: DataFrame, overlay: bool = False) -> DataFrame:
    """Candidates of scan documents; ``overlay`` keeps one row per pair.

    A pair in both sections then keeps its trade row.
    """
    head = ["generated_at_ms", "cache_age_seconds", F.coalesce("thresholds.minimum_candidate_score", F.lit(78.0)).alias("threshold")]
    # The later section wins when a pair is in both.
    both = F.concat(
        F.transform(F.coalesce("watchlist", F.array()), lambda c: F.struct(F.lit(0).alias("section"), c.alias("c"))),
        F.transform(F.coalesce("trade_candidates", F.array()), lambda c: F.struct(F.lit(1).alias("section"), c.alias("c"))),
    )
    if overlay:
        pairs = F.transform(F.filter(both, lambda x: x["section"] == 1), lambda x: x["c"]["pair"])
        both = F.filter(both, lambda x: (x["section"] == 1) | ~F.coalesce(F.array_contains(pairs, x["c"]["pair"]), F.lit(False)))
    return docs.select(*head, F.explode_outer(both).alias("x")).select("generated_at_ms", "cache_age_seconds", "threshold", "x.section", "x.c.*")


def read_scan(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of scan documents, one row per section entry."""
    return _explode_scan(spark.read.schema(S.SCAN).option("multiLine", "true").json(path))


def read_scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_scan`` for a log with one document per line."""
    return _explode_scan(spark.read.schema(S.SCAN).json(path))


def stream_scans(spark: SparkSession, path: str) -> DataFrame:
    """Scan documents arriving in a landing folder, one row per pair."""
    return _explode_scan(spark.readStream.schema(S.SCAN).option("multiLine", "true").json(path), overlay=True)


def read_swing_scan(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.read.schema(S.SWING_SCAN).option("multiLine", "true").json(path)
    return docs.select("generated_at_ms", "market_context", F.explode_outer("analysis_pool").alias("p")).select("generated_at_ms", "market_context", "p.*")
