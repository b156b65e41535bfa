"""Token counts of a byte-pair model: heap and linked list, no identifiers.

The symbols of a word form a linked list. A heap holds the adjacent pairs that are
pieces of the vocabulary, lowest rank first and leftmost among equals; popping a pair
merges it and pushes its new neighbours. The count is the number of first symbols less
the merges, plus the extra bytes of characters that the vocabulary lacks.

No piece holds a space mark after another character, so no merge crosses the begin of
a word, and counts are remembered by word.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlytics.llm.tables import holds, slices, strings

#: Words that a worker remembers; a full table stays, and starts anew after so many misses.
REMEMBERED = 500_000
MISSES = 8_000_000
SPACE = "▁"

_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_ODD = re.compile(r"  |\A | \Z")
_loaded: dict[str, "Counter"] = {}


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Counter(dict):
    """Counts by word; a missing word is merged once."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        trainer = dict(fields(next(v for k, v in model if k == 2)))
        normal = dict(fields(next(v for k, v in model if k == 3)))
        # Fixed field numbers of the model format: 3 model type (2: pairs), 24 mark as suffix,
        # 35 bytes for unknown; normaliser: 2 character map, 3 mark first, 4 drop spaces, 5 space as mark.
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only byte-pair models without character map, with spaces kept as marks")
        self.bytes, self.first = bool(trainer.get(35, 0)), SPACE if normal.get(3, 1) else ""
        self.rank: dict[str, float] = {}
        self.kept: set[str] = set()
        for number, value in model:
            if number == 1:
                piece = dict(fields(value))
                kind = piece.get(3, 1)
                if kind in (4, 5):
                    raise ValueError("user-defined and unused pieces are not supported")
                if kind == 1:
                    text = piece[1].decode()
                    self.rank[text] = -struct.unpack("<f", piece.get(2, bytes(4)))[0]
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece holds a space mark after another character")
        self.missed = 0

    def __missing__(self, word: str) -> int:
        n = self.merge(SPACE + word)
        self.missed += 1
        if self.missed > MISSES:
            self.clear()
            self.missed = 0
        if len(self) < REMEMBERED:
            self[word] = n
        return n

    def merge(self, word: str) -> int:
        rank = self.rank.get
        symbols = list(word)
        last = len(symbols) - 1
        heap = [(r, i, p) for i in range(last) if (r := rank(p := symbols[i] + symbols[i + 1])) is not None]
        merges = 0
        if heap:
            heapify(heap)
            after, before = list(range(1, last + 2)), list(range(-1, last))
            while heap:
                _, i, pair = heappop(heap)
                j = after[i]
                if symbols[i] is None or j > last or len(symbols[i]) + len(symbols[j]) != len(pair) or symbols[i] + symbols[j] != pair:
                    continue  # one of the two has been merged meanwhile
                symbols[i], symbols[j] = pair, None
                merges += 1
                k = after[i] = after[j]
                if k <= last:
                    before[k] = i
                    if (r := rank(p := pair + symbols[k])) is not None:
                        heappush(heap, (r, i, p))
                h = before[i]
                if h >= 0 and (r := rank(p := symbols[h] + pair)) is not None:
                    heappush(heap, (r, h, p))
        n = last + 1 - merges
        known = self.rank
        if self.bytes:
            for s in symbols:
                if s is not None and s not in known:
                    n += len(s.encode()) - 1
        else:  # unknown neighbours become one token
            unknown = [s not in known for s in symbols if s is not None]
            n -= sum(a and b for a, b in zip(unknown, unknown[1:]))
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE not in text and self.first and self.bytes and not _ODD.search(text):
            return sum(map(self.__getitem__, text.split(" ")))
        marked = self.first + text.replace(" ", SPACE)
        if not self.bytes:
            return self.merge(marked)
        return sum(map(self.merge, _WORD.findall(marked)))


def counter(path: str) -> Counter:
    holds("token_counts", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text).

    Null and empty texts count 0. Repeated rows and null doc_ids stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model).count
        for part in slices(batches):
            n = [count(t) for t in strings(part["text"])]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["n_bytes"], pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.col("text").cast("string"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
