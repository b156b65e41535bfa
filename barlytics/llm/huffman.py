"""Token ids as canonical length-limited Huffman codes, in files read by tables.

A file holds segments in ascending doc_id order. A segment is a row: the documents in it
with their numbers of ids, one bit stream of all their ids, and the bit offset at which
each block of ``BLOCK`` ids begins. Blocks are independent: decoding starts at any
checkpoint, and all blocks of a batch are decoded side by side, one table lookup for a
whole code. The code table (id, length) is stored beside the segments; canonical codes
follow from the lengths.

Files are Parquet, so that any store that Spark reaches can hold them; the payload is
binary and is not compressed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlytics.llm import bpe
from barlytics.llm.tables import new_path, slices, strings

#: Longest code, unless the ids in use need longer ones.
MAX_BITS = 16
#: Ids of a block, and of a segment at least (it ends with the document that reaches it).
BLOCK, SEGMENT = 1024, 1 << 16
#: Ids of a file, roughly.
FILE = 1 << 23

SEGMENTS = (
    "part int, number long, start long, n_ids long, doc_ids binary, null_ids binary, lengths binary, "
    "offsets binary, payload binary"
)


# ------------------------------------------------------------------ codes


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``max_bits`` (package-merge).

    An id that never occurs has length 0. The limit is raised where it is too small for
    the number of ids in use.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(max_bits, int(len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(weights)
    merged = weights
    single = [np.ones(n, dtype=bool)]  # by level: which items of the merged list are ids
    for _ in range(limit - 1):
        pairs = len(merged) // 2
        packages = merged[: 2 * pairs].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        merged = both[place]
        single.append(place < n)
    take = 2 * n - 2
    for is_id in reversed(single):
        ids = int(is_id[:take].sum())
        lengths[order[:ids]] += 1  # the cheapest ids are taken first
        take = 2 * (take - ids)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of the given lengths: by length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code = (code + len(ids)) << 1
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` and the bit offsets of its blocks."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    begins = ends - bits
    word, room = begins >> 5, 64 - (begins & 31) - bits
    value = codes[ids] << room.astype(np.uint64)
    out = np.zeros((int(ends[-1]) >> 5) + 3 if len(ids) else 2, dtype=np.uint32)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        value = np.bitwise_or.reduceat(value, first)
        at = word[first]
        out[at] |= (value >> np.uint64(32)).astype(np.uint32)
        out[at + 1] |= (value & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out.astype(">u4").tobytes(), begins[::BLOCK]


class Decoder:
    """One table over all bit patterns of the longest code: id and length."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(int(lengths.max(initial=1)), 1)
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        spans = np.int64(1) << (self.bits - lengths[order].astype(np.int64))
        self.ids = np.repeat(order, spans).astype(np.uint32)
        self.ids = np.concatenate([self.ids, np.zeros((1 << self.bits) - len(self.ids), dtype=np.uint32)])
        self.lengths = lengths[self.ids].astype(np.int64)

    def blocks(self, stream: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of blocks side by side: ``offsets`` are bits into ``stream`` (uint32 words)."""
        order = np.argsort(-sizes, kind="stable")  # lanes that end early stand last
        at, left = offsets[order].astype(np.int64), sizes[order]
        out = np.zeros((int(sizes.max(initial=0)), len(sizes)), dtype=np.uint32)
        wide = stream.astype(np.uint64)
        wide = (wide[:-1] << np.uint64(32)) | wide[1:]
        shift, mask = 64 - self.bits, np.uint64((1 << self.bits) - 1)
        alive = np.searchsorted(-left, -np.arange(1, len(out) + 1), side="right")
        for k, n in enumerate(alive.tolist()):
            here = at[:n]
            code = (wide[here >> 5] >> (shift - (here & 31)).astype(np.uint64)) & mask
            code = code.astype(np.int64)
            out[k, :n] = self.ids[code]
            here += self.lengths[code]
        columns = np.empty_like(out.T, order="C")
        columns[order] = out.T
        return columns[np.arange(columns.shape[1]) < sizes[:, None]]


def segment_ids(segments: list[dict], decoder: Decoder) -> list[np.ndarray]:
    """The ids of each segment, all their blocks decoded side by side."""
    streams, offsets, sizes, begin = [], [], [], 0
    for s in segments:
        words = np.frombuffer(s["payload"], dtype=">u4")
        own = np.frombuffer(s["offsets"], dtype="<u4").astype(np.int64)
        streams.append(words)
        offsets.append(own + 32 * begin)
        n = np.full(len(own), BLOCK, dtype=np.int64)
        if len(n):
            n[-1] = s["n_ids"] - BLOCK * (len(n) - 1)
        sizes.append(n)
        begin += len(words)
    if not segments:
        return []
    ids = decoder.blocks(np.concatenate(streams), np.concatenate(offsets), np.concatenate(sizes))
    return np.split(ids, np.cumsum([s["n_ids"] for s in segments])[:-1])


# ------------------------------------------------------------------ tables


def token_table(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Ids of all texts, compressed by row, and each task's counts of ids, written to ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(tokenizer)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        size, pack = coder.dtype.itemsize, zstandard.ZstdCompressor(level=1)
        counts = np.zeros(0, dtype=np.int64)
        names = ["doc_id", "n_tokens", "ids", "counts"]
        for part in slices(batches):
            ids = [coder.encode(t) + end for t in strings(part["text"])]
            seen = np.bincount(np.frombuffer(b"".join(ids), dtype=coder.dtype))
            if len(seen) > len(counts):
                counts, seen = seen, counts
            counts[: len(seen)] += seen
            packed = [pack.compress(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array([len(x) // size for x in ids], pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(ids), pa.binary())], names
            )
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.array([None], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary").write.option("compression", "none").parquet(path)


def global_counts(tokens: DataFrame) -> np.ndarray:
    """Counts of all ids: summed by id on the executors, then as many rows as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch["counts"].to_pylist():
                counts = np.frombuffer(x, dtype=np.int64)
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["id", "n"])

    rows = tokens.filter(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["id"] for r in rows), default=-1) + 1, dtype=np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, max_bits: int = MAX_BITS) -> None:
    """Writes the ids of all ``docs`` (doc_id, text), each with ``end_id`` after it, to ``path``.

    Null and empty texts are their end id. Rows of equal doc_id follow one another, null
    doc_ids come first. An empty table gives no segments.
    """
    spark = docs.sparkSession
    token_path = new_path(spark, "tokens")
    token_table(docs, tokenizer, token_path, end_id)
    tokens = spark.read.parquet(token_path)
    counts = global_counts(tokens)
    lengths = code_lengths(counts, max_bits)
    dtype = bpe.encoder(tokenizer).dtype
    codes = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, start = TaskContext.get().partitionId(), 0, 0
        unpack = zstandard.ZstdDecompressor()
        table, canon = codes.value
        doc_ids, ids, held = [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal number, start, held
            all_ids = np.concatenate(ids)
            payload, offsets = encode(all_ids, table, canon)
            row = {
                "part": part, "number": number, "start": start, "n_ids": len(all_ids),
                "doc_ids": np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
                "null_ids": np.packbits([d is None for d in doc_ids]).tobytes(),
                "lengths": np.array([len(x) for x in ids], dtype="<i8").tobytes(),
                "offsets": offsets.astype("<u4").tobytes() if offsets.max(initial=0) < 1 << 32 else _too_long(), "payload": payload,
            }
            number, start, held = number + 1, start + len(all_ids), 0
            doc_ids.clear(), ids.clear()
            return pa.RecordBatch.from_pylist([row], schema=_SEGMENT_TYPES)

        for batch in slices(batches):
            for doc_id, packed in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist()):
                x = np.frombuffer(unpack.decompress(packed), dtype=dtype)
                doc_ids.append(doc_id), ids.append(x)
                held += len(x)
                if held >= SEGMENT:
                    yield segment()
        if held:
            yield segment()

    rows = tokens.filter(F.col("ids").isNotNull()).select("doc_id", "ids")
    n_files = max(1, round(int(counts.sum()) / FILE), min(spark.sparkContext.defaultParallelism, round(int(counts.sum()) / SEGMENT)))
    ordered = rows.repartitionByRange(n_files, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    used = np.flatnonzero(lengths)
    table = spark.createDataFrame(pa.table({"id": used.astype(np.int64), "bits": lengths[used].astype(np.int32)}))
    table.coalesce(1).write.parquet(f"{path}/codes")


def _too_long():
    raise ValueError("a segment holds over 2**32 bits")


_SEGMENT_TYPES = pa.schema(
    [("part", pa.int32()), ("number", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64())]
    + [(n, pa.binary()) for n in ("doc_ids", "null_ids", "lengths", "offsets", "payload")]
)


def decoder_of(spark: SparkSession, path: str):
    """The decoder's code lengths, as a broadcast of at most one byte per id of the vocabulary."""
    rows = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=-1) + 1, dtype=np.uint8)
    for r in rows:
        lengths[r["id"]] = r["bits"]
    return spark.sparkContext.broadcast(lengths)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files at ``path``."""
    shared = decoder_of(spark, path)
    segments = spark.read.parquet(f"{path}/segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                rows = batch.slice(i, 32).to_pylist()
                out = []
                for row, ids in zip(rows, segment_ids(rows, decoder)):
                    n = np.frombuffer(row["lengths"], dtype="<i8")
                    begins = row["start"] + np.cumsum(n) - n
                    none = np.unpackbits(np.frombuffer(row["null_ids"], dtype=np.uint8))
                    words = ids.astype("<u4").tobytes()
                    at = 0
                    for doc_id, null, begin, size in zip(np.frombuffer(row["doc_ids"], dtype="<i8").tolist(), none.tolist(), begins.tolist(), n.tolist()):
                        out.append((row["part"], None if null else doc_id, begin, size, zlib.crc32(words[at : at + 4 * size])))
                        at += 4 * size
                columns = list(zip(*out)) if out else [[]] * 5
                types = [pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "doc_id", "begin", "n_tokens", "ids_crc32"])

    # One row for each file: the ids in all files before it.
    files = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = files.select(F.col("part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    digests = segments.mapInArrow(run, "part int, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return digests.join(before, "part").select("doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of each document, decoded from the files at ``path``."""
    shared = decoder_of(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                rows = batch.slice(i, 32).to_pylist()
                for row, ids in zip(rows, segment_ids(rows, decoder)):
                    n = np.frombuffer(row["lengths"], dtype="<i8")
                    none = np.unpackbits(np.frombuffer(row["null_ids"], dtype=np.uint8))[: len(n)].astype(bool)
                    offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                    doc_ids = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=none)
                    yield pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])

    return spark.read.parquet(f"{path}/segments").mapInArrow(run, "doc_id long, ids array<int>")
