"""Hard negatives by a vertical scan with bounds.

Vectors are stored in blocks, dimension by dimension, with the least and the largest value of
each dimension. For an anchor a block's dimensions are read in descending order of the
anchor's own magnitude, ``STEP`` at a time. What the unread dimensions can still add to a
product lies between two sums over the block's extremes; a row stays in the candidate bitmap
only while its product can still come into the window asked for, so what is left at the end
has exact products.

The first scan finds each anchor's positives: the window is what could still be among the
best of its label. The second scan finds the negatives of each positive: the window goes
from ``LEAST`` hundredths of the positive's product to that product, and its lower end rises
once enough rows of a task lie inside. Tasks give out their best rows only, Spark merges them.

Anchors are taken in passes of at most ``PASS_VALUES`` components, which is what a pass sends
to every task; all vectors are read in each pass.

Defined cases: rows with a null id, label or vector, or a null or non-finite component (also
once multiplied by 256), take no part; shorter vectors end in zeros; repeated rows are rows
of their own, but a row with the anchor's id is never its candidate, and an anchor that is
repeated is answered each time; products outside a long are cut to its ends. Further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlytics.llm.tables import numbered, slices, stored

#: Rows of a block, dimensions read between two looks at the bounds, components of a pass's anchors.
BLOCK_ROWS, STEP, PASS_VALUES = 4096, 8, 1 << 20
#: Positives of an anchor, negatives of a positive, hundredths of the positive's product that a negative reaches.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
ANCHOR_EVERY, MOVED_EVERY, LABELS, SCALE = 100, 7, 10, 256

_LONG = 2**63 - 1
_EXACT = 2.0**53
BLOCK_SCHEMA = "n int, width int, kind string, ids binary, labels binary, low binary, high binary, dims binary"
FOUND = "anchor long, which int, id long, score long"


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the usable rows, labels moved on where the id says so."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return rows.filter(usable).select(F.col("vec_id").cast("long"), moved.alias("label"), "embedding")


def matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole-numbered components of lists, as a matrix that ends in zeros, and which rows are finite."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(SCALE * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out, np.isfinite(out).all(axis=1)


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (vec_id, label, embedding): sorted by label, one stretch of bytes for each dimension after the other."""

    def block(held: list[tuple]) -> pa.RecordBatch:
        width = max(m.shape[1] for _, _, m in held)
        ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        values = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, _, m in held])
        order = np.argsort(labels, kind="stable")
        values = values[order].T
        largest = np.abs(values).max(initial=0)
        kind = "int16" if largest < 2**15 else "int32" if largest < 2**31 else "float64"
        low, high = values.min(axis=1, initial=np.inf), values.max(axis=1, initial=-np.inf)
        raw = [ids[order].tobytes(), labels[order].tobytes(), low.tobytes(), high.tobytes(), np.ascontiguousarray(values, dtype=kind).tobytes()]
        arrays = [pa.array([len(ids)], pa.int32()), pa.array([width], pa.int32()), pa.array([kind])] + [pa.array([x], pa.binary()) for x in raw]
        return pa.RecordBatch.from_arrays(arrays, ["n", "width", "kind", "ids", "labels", "low", "high", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in slices(batches):
            values, good = matrix(part["embedding"])
            held.append((part["vec_id"].to_numpy()[good], part["label"].to_numpy()[good], values[good]))
            n += int(good.sum())
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """A stored block: numbers by dimension, and where each label begins."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.low, self.high = np.frombuffer(row["low"]), np.frombuffer(row["high"])
        self.dims = np.frombuffer(row["dims"], row["kind"]).reshape(row["width"], row["n"]).astype(np.float64)
        self.largest = float(max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0)))

    def stretch(self, label: int) -> tuple[int, int]:
        begin, end = np.searchsorted(self.labels, [label, label + 1])
        return int(begin), int(end)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def survivors(block: Block, query: np.ndarray, begin: int, end: int, least, most) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows from ``begin`` to ``end`` whose product lies in [least, most], and the products."""
    width = min(len(query), len(block.dims))
    query, low, high, dims = query[:width], block.low[:width], block.high[:width], block.dims
    if width * float(np.abs(query).max(initial=0)) * block.largest >= _EXACT:
        query, low, high, dims = _whole(query), _whole(low), _whole(high), _whole(dims)
    order = np.argsort(-np.abs(query.astype(np.float64)), kind="stable")
    order = order[: int((query[order] != 0).sum())]
    q = query[order]
    ends = np.stack([q * low[order], q * high[order]])
    rest = np.zeros((2, len(order) + 1), dtype=ends.dtype)
    rest[0, :-1], rest[1, :-1] = (np.cumsum(side[::-1])[::-1] for side in (ends.min(axis=0), ends.max(axis=0)))
    at, sums = None, np.zeros(end - begin, dtype=dims.dtype)
    for i in range(0, max(len(order), 1), STEP):
        for k in range(i, min(i + STEP, len(order))):
            sums = sums + q[k] * (dims[order[k], begin:end] if at is None else dims[order[k], at])
        done = min(i + STEP, len(order))
        bitmap = (sums + rest[1, done] >= least) & (sums + rest[0, done] <= most)
        left = int(bitmap.sum())
        if left < len(bitmap):
            at = np.flatnonzero(bitmap) + begin if at is None else at[bitmap]
            sums = sums[bitmap]
        if not left:
            break
    return (np.arange(begin, end) if at is None else at), sums


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n``: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores))[:n] if scores.dtype != object else np.array(sorted(range(len(ids)), key=lambda k: (-scores[k], ids[k]))[:n], dtype=int)
    return ids[order], scores[order]


class Best:
    """The best rows of a window so far; ``least`` rises to the last of them once there are enough."""

    def __init__(self, n: int, least, most):
        self.n, self.least, self.most = n, least, most
        self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        inside = (scores >= self.least) & (scores <= self.most)
        if inside.any():
            ids, scores = np.concatenate([self.ids, ids[inside]]), np.concatenate([self.scores, scores[inside]])
            self.ids, self.scores = best(ids, scores, self.n)
            if len(self.ids) == self.n:
                self.least = self.scores[-1]


def _scan(stored_blocks: DataFrame, anchors: dict[str, np.ndarray], windows: list[list[tuple[float, float]]], same: bool, n: int) -> DataFrame:
    """Candidates for the windows of each anchor: the best ``n`` rows of a task, of its label or of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[Best(n, least, most) for least, most in each] for each in windows]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for k, mine in enumerate(held):
                    if not mine:
                        continue
                    begin, end = block.stretch(anchors["label"][k])
                    query, most = anchors["values"][k], max(b.most for b in mine)
                    for a, b in [(begin, end)] if same else [(0, begin), (end, len(block.ids))]:
                        if a < b:
                            at, scores = survivors(block, query, a, b, min(w.least for w in mine), most)
                            other = block.ids[at] != anchors["id"][k]
                            for w in mine if len(at) else ():
                                w.add(block.ids[at][other], scores[other])
        out = [(anchors["place"][k], which, w.ids, w.scores) for k, mine in enumerate(held) for which, w in enumerate(mine) if len(w.ids)]
        for i in range(0, len(out), 1024):
            part = out[i : i + 1024]
            place, which = (np.repeat([p[c] for p in part], [len(p[2]) for p in part]) for c in (0, 1))
            scores = [max(-_LONG - 1, min(_LONG, int(s))) for p in part for s in p[3]]
            arrays = [pa.array(place, pa.int64()), pa.array(which, pa.int32()), pa.array(np.concatenate([p[2] for p in part]), pa.int64()), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "which", "id", "score"])

    return stored_blocks.mapInArrow(run, FOUND)


def _merged(found: DataFrame, n: int, name: str) -> DataFrame:
    order = Window.partitionBy("anchor", "which").orderBy(F.col("score").desc(), "id")
    return stored(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n), name)


def _anchors(rows: DataFrame) -> dict[str, np.ndarray]:
    """The anchors of a pass, at most ``PASS_VALUES`` components."""
    table = rows.orderBy("place").toArrow().combine_chunks()
    values, good = matrix(table["embedding"].combine_chunks())
    return {"place": table["place"].to_numpy()[good], "id": table["vec_id"].to_numpy()[good], "label": table["label"].to_numpy()[good], "values": values[good]}


def mine(rows: DataFrame, is_anchor: Column | None = None) -> DataFrame:
    """The hard negatives of each anchor and positive among ``rows`` (vec_id, embedding, label).

    ``is_anchor`` picks the anchors, by default every ``ANCHOR_EVERY``-th id. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score.
    """
    usable = taking_part(rows)
    stored_blocks = stored(blocks(usable), "blocks", "zstd")
    chosen = F.col("vec_id") % ANCHOR_EVERY == 0 if is_anchor is None else is_anchor
    anchors = numbered(usable.filter(chosen), [], ["vec_id"], "anchors")
    size = anchors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    step = max(1, PASS_VALUES // max(size["width"] or 1, 1))
    out = None
    for i in range(0, max(size["n"], 1), step):
        held = _anchors(anchors.filter((F.col("place") >= i) & (F.col("place") < i + step)))
        nearest = [[(-np.inf, np.inf)] for _ in held["place"]]
        positives = _merged(_scan(stored_blocks, held, nearest, True, POSITIVES), POSITIVES, "positives")
        number = {p: k for k, p in enumerate(held["place"].tolist())}
        windows = [[] for _ in number]
        for r in positives.select("anchor", "score").orderBy("anchor", "rank").collect():  # at most POSITIVES for each anchor of the pass
            windows[number[r["anchor"]]].append((-(-LEAST * r["score"] // 100), r["score"]))
        negatives = _merged(_scan(stored_blocks, held, windows, False, NEGATIVES), NEGATIVES, "negatives")
        pair = positives.select("anchor", (F.col("rank") - 1).alias("which"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        named = anchors.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        found = negatives.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pair, ["anchor", "which"]).join(named, "anchor")
        found = found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = found if out is None else out.unionByName(found)
    return out
