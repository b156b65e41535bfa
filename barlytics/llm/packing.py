"""Packing documents into fixed windows by the online sum-of-squares rule.

A document is cut into whole windows and a rest. The rest goes to the fill level that
keeps the sum of squared counts of partly filled windows smallest; the counts are an
array indexed by level. When a partition ends, or when many windows are open, the open
windows are dealt anew: their pieces are cut to fill whole windows, and what remains
over forms windows whose length is a power of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlytics.llm import bpe
from barlytics.llm.tables import slices

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Open windows that a task holds before it deals them anew.
MAX_OPEN = 2048
#: Sequences that a partition can number.
NUMBERS = 33

_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])


class Packer:
    """Windows of one partition. A piece is (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, first: int, max_open: int = MAX_OPEN):
        self.window, self.next, self.max_open = window, first, max_open
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]  # windows by fill
        self.n_open = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.done.append((doc_id, start, len(ids), crc, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def level_for(self, size: int) -> int:
        """The fill whose window takes ``size`` at the least sum of squares; 0 opens a window."""
        w, n = self.window, self.levels
        change = np.zeros(w - size + 1, dtype=np.int64)
        change[:-1] = 2 * n[size:w] + 1  # one more at the new level; a full window counts no more
        change[1:] -= 2 * n[1 : w - size + 1] - 1  # one less at the old level
        change[1:][n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        return int(len(change) - 1 - change[::-1].argmin())  # ties: the fullest

    def add(self, doc_id, ids: np.ndarray) -> None:
        w, total, start = self.window, len(ids), 0
        while total - start >= w:
            self._close([(doc_id, start, ids[start : start + w], total)])
            start += w
        if start < total:
            self._place((doc_id, start, ids[start:].copy(), total))
        if self.n_open > self.max_open:
            self.deal()

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = self.level_for(size)
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self._close(pieces)
        else:
            self.open[level + size].append(pieces)
            self.levels[level + size] += 1
            self.n_open += 1

    def deal(self, last: bool = False) -> None:
        """Fills whole windows from the open ones; at the end also the last, short ones."""
        rest = [p for level in self.open for pieces in level for p in pieces]
        self.open = [[] for _ in range(self.window + 1)]
        self.levels[:] = 0
        self.n_open = 0
        left = sum(len(p[2]) for p in rest)
        row, room = [], self._size(left)
        for doc_id, start, ids, total in rest:
            while len(ids):
                if not last and not row and left < self.window:
                    self._place((doc_id, start, ids, total))
                    break
                part = ids[:room]
                row.append((doc_id, start, part, total))
                ids, start, left, room = ids[len(part) :], start + len(part), left - len(part), room - len(part)
                if not room:
                    self._close(row)
                    row, room = [], self._size(left)

    def _size(self, left: int) -> int:
        return self.window if left >= self.window else 1 << (left.bit_length() - 1) if left else 0


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents of ``docs`` (doc_id, text), packed within each partition.

    A null or empty text is its end id alone. Repeated rows are packed as often as they
    stand there; a null doc_id stays null. No rows are shuffled. The order of a partition's rows
    decides the windows, so a task that runs again gives the same numbers.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("the window must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(tokenizer)
        end = np.array([end_id], dtype=coder.dtype).tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << NUMBERS)
        for part in slices(batches):
            for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                packer.add(doc_id, np.frombuffer(coder.encode(text or "") + end, dtype=coder.dtype))
            yield _rows(packer)
        packer.deal(last=True)
        yield _rows(packer)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def _rows(packer: Packer) -> pa.RecordBatch:
    rows, packer.done = packer.done, []
    columns = list(zip(*rows)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)
