"""Benchmark passages in documents: pigeonhole pieces, verified by bit-parallel distance.

Texts become lower-case words with one space between. An item with an error budget of k
is cut into k + 1 pieces; a place in a text within k edits of the item holds at least one
piece unchanged. An automaton over all pieces finds these in one pass, each hit names the
only window where the item can lie, and the window is verified by Myers' algorithm.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlytics.llm.tables import holds, release, slices, strings

#: Characters of an item for each edit that is allowed.
PER_ERROR = 12
#: Normalised characters of the items that one pass over the documents looks for.
BLOCK = 2_000_000

HITS = "item_id long, distance long, budget long, begin long, end long, n_places long"

_WORD = re.compile(r"\w+")
_scanners: dict[tuple, "Scanner"] = {}


def normalised(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edits of ``pattern`` to a part of ``text``, and the first end of such a part (Myers)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    match: dict[str, int] = {}
    for i, c in enumerate(pattern):
        match[c] = match.get(c, 0) | 1 << i
    plus, minus, score, best, end = full, 0, m, m, 0
    for k, c in enumerate(text, 1):
        eq = match.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = up << 1 & full
        down = down << 1 & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
        if score < best:
            best, end = score, k
    return best, end


def _profile(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-32-le"), dtype="<u4") & 255, minlength=256)


class Scanner:
    """An automaton over the pieces of ``items`` (item_id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]], per_error: int):
        import ahocorasick

        self.items = [(i, t, len(t) // per_error, _profile(t)) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text, budget, _) in enumerate(self.items):
            cuts = [round(j * len(text) / (budget + 1)) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((k, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        self.automaton.make_automaton()

    def verify(self, text: str, k: int, low: int, high: int) -> tuple[int, int, int] | None:
        """(distance, begin, end) of item ``k`` where it begins between ``low`` and ``high``."""
        _, item, budget, profile = self.items[k]
        begin, stop = text.find(item, max(low, 0), high + len(item)), len(item)
        if budget:
            if begin >= 0:
                return 0, begin, begin + stop
        else:  # an item too short for an edit is found as whole words only
            while begin >= 0:
                if text[begin - 1 : begin] in ("", " ") and text[begin + stop : begin + stop + 1] in ("", " "):
                    return 0, begin, begin + stop
                begin = text.find(item, begin + 1, high + stop)
            return None
        at = max(low - budget, 0)
        window = text[at : high + len(item) + budget]
        if np.maximum(profile - _profile(window), 0).sum() > budget:
            return None  # an edit brings in one missing character at most
        edits, end = distance(item, window)
        if edits > budget:
            return None
        back, size = distance(item[::-1], window[:end][::-1])
        return edits, at + end - size, at + end

    def scan(self, text: str) -> list[tuple[int, int, int, int, int, int]]:
        """One tuple like ``HITS`` for each item that the text holds."""
        starts: dict[int, list[int]] = {}
        for end, places in self.automaton.iter(text):
            for k, cut in places:
                starts.setdefault(k, []).append(end + 1 - cut)
        found = []
        for k, begins in starts.items():
            budget, places = self.items[k][2], []
            begins.sort()
            first = 0
            for i in range(1, len(begins) + 1):
                # windows that overlap are one, up to the item's length
                if i == len(begins) or begins[i] - begins[i - 1] > 2 * budget or begins[i] - begins[first] > len(self.items[k][1]):
                    if (hit := self.verify(text, k, begins[first] - budget, begins[i - 1] + budget)) and hit not in places:
                        places.append(hit)
                    first = i
            if places:
                edits, begin, end = min(places)
                found.append((self.items[k][0], edits, budget, begin, end, len(places)))
        return sorted(found)


def find(docs: DataFrame, items: DataFrame, per_error: int = PER_ERROR, block: int = BLOCK) -> DataFrame:
    """doc_id and ``HITS`` for each row of ``docs`` (doc_id, text) and item that it holds.

    Items with the same text are all reported; null items and items without words are
    none, and neither are null ids of items. Null and empty texts hold nothing, repeated
    rows are reported each. Positions count code points of the normalised text. Items go
    through the documents in blocks of ``block`` characters, so a pass holds a bounded set.
    """
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    n = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // block + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"))
    found = [rows.mapInArrow(_hits(_items(items, k, n), per_error), f"doc_id {kind}, {HITS}") for k in range(n)]
    return reduce(DataFrame.unionByName, found)


def _items(items: DataFrame, k: int, n: int) -> list[tuple[int, str]]:
    """The ``k``-th of ``n`` blocks of items, in the order of their ids."""
    part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
    return sorted((r["item_id"], t) for r in part if (t := normalised(r["text"])))


def scanner(items: list[tuple[int, str]], per_error: int) -> Scanner:
    holds("decontamination", _scanners.clear)
    key = (per_error, len(items), hash(tuple(items)))
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(items, per_error)
    return _scanners[key]


def _hits(items: list[tuple[int, str]], per_error: int):
    names = ["doc_id", *(c.split()[0] for c in HITS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(items, per_error).scan if items else lambda text: []
        for part in slices(batches):
            rows, at = [], []
            for i, text in enumerate(strings(part["text"])):
                hits = scan(normalised(text))
                rows += hits
                at += [i] * len(hits)
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([part["doc_id"].take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in columns)], names)

    return run


def drop(docs: DataFrame, items: DataFrame, per_error: int = PER_ERROR, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    n = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // block + 1
    for k in range(n):
        part = _items(items, k, n)
        if part:
            docs = docs.filter(~_holds(part, per_error)(F.col("text").cast("string")))
    return docs


def _holds(items: list[tuple[int, str]], per_error: int):
    def run(texts: pa.Array) -> pa.Array:
        release()
        scan = scanner(items, per_error).scan
        return pa.array([bool(scan(normalised(t or ""))) for t in texts.to_pylist()], pa.bool_())

    return F.arrow_udf(run, "boolean").asNondeterministic()
