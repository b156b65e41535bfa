"""SimHash groups through a Gray-ordered hierarchical index.

Fingerprints that differ in at most ``d`` of 64 bits agree on one of ``d + 1`` pieces of
the bits. Rows are therefore dealt out by (piece, its bits), and a group with more than
``LIMIT`` fingerprints is dealt out again by the pieces of its other bits, until none is
larger; no pair is lost on the way, and no group of any size meets in one task.

A task sorts its groups by Gray rank, so that neighbours share most bits, and builds one
index over whole groups of some thousand fingerprints. Nodes over runs of them hold the
bits on which all members agree, less those that their parent holds already. Every
fingerprint walks down with the differences added up so far and leaves a whole node as
soon as they exceed ``d``. What is linked is united inside the task, so m fingerprints give
fewer than m links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlytics.llm import minhash
from barlytics.llm.components import components
from barlytics.llm.tables import drop, free, slices, stored, strings

BITS = 64
SEED = 42
#: Largest number of fingerprints compared in one group.
LIMIT = 4096
#: Members of a node.
FAN = 4
#: Queries that walk down the index at the same time.
QUERIES = 512
#: Rows of whole groups that a task gathers for one index.
GATHER = 1 << 12

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# ------------------------------------------------------------------ fingerprints


def majority(hashes: np.ndarray) -> int:
    """Bits set in more than half of ``hashes`` (uint64); 0 without any."""
    if not len(hashes):
        return 0
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included; one of all words if they are fewer."""
    words = text.encode().lower().split()  # A-Z only, ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and the fingerprint, as a signed long, of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [majority(shingle_hashes(t, shingle)) for t in strings(part["text"])]
            yield pa.RecordBatch.from_arrays([part["doc_id"], _signed(found)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


# ------------------------------------------------------------------ groups


def pieces(free: list[int], n: int) -> list[int]:
    """Masks of ``n`` nearly equal runs of the bit numbers ``free``."""
    cut = [round(k * len(free) / n) for k in range(n + 1)]
    return [sum(1 << b for b in free[i:j]) for i, j in zip(cut, cut[1:])]


def _signed_int(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def children(mask: int, max_diff: int) -> list[int]:
    """Masks that hold ``mask`` and one more piece of the other bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return sorted({mask | p for p in pieces(free, max_diff + 1)})


def gray_rank(fp):
    """The place of a fingerprint in Gray order, as a column that sorts as a signed long."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def grouped(words: DataFrame, max_diff: int = 3, limit: int = LIMIT) -> DataFrame:
    """(kind, mask, value, fp, node) rows whose groups have at most ``limit`` rows.

    ``words`` has distinct (kind, fp) with a node each. A round deals out the groups that
    are too large; a round adds bits, so there are few, and mostly none.
    """
    masks = [0]
    rows = words.select("kind", "fp", "node", F.lit(0).cast("long").alias("mask"))
    done = None
    while True:
        pairs = [(_signed_int(m), _signed_int(c)) for m in masks for c in children(m, max_diff)]
        masks = sorted({c % (1 << 64) for _, c in pairs})
        long = lambda x: F.lit(x).cast("long")
        table = F.create_map(*[x for m in {m for m, _ in pairs} for x in (long(m), F.array(*[long(c) for p, c in pairs if p == m]))])
        rows = rows.select("kind", "fp", "node", F.explode(table[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        key = ["kind", "mask", "value"]
        if all(m == (1 << 64) - 1 for m in masks):
            large = None
        else:
            large = stored(rows.groupBy(*key).count().filter(F.col("count") > limit).select(*key), "large-groups")
            if large.isEmpty():
                large = None
        small = rows if large is None else rows.join(large, key, "left_anti")
        small = small.select("kind", "mask", "value", "fp", "node")
        done = small if done is None else done.unionByName(small)
        if large is None:
            return done
        rows = stored(rows.join(large, key, "left_semi").select("kind", "fp", "node", "mask"), "large-rows")


class Index:
    """Nodes over Gray-sorted fingerprints, level by level from the top."""

    def __init__(self, fps: np.ndarray):
        self.levels = []
        ones = np.full(len(fps), ~np.uint64(0))
        mask, pattern = ones, fps
        levels = [(mask, pattern)]
        while len(pattern) > FAN:
            starts = np.arange(0, len(pattern), FAN)
            low, high = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~(low ^ high)
            pattern = low & mask
            levels.append((mask, pattern))
        above = None
        for mask, pattern in reversed(levels):
            own = mask if above is None else mask & ~np.repeat(above, FAN)[: len(mask)]
            self.levels.append((own, pattern))
            above = mask

    def pairs(self, queries: np.ndarray, max_diff: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, leaf number) of all fingerprints within ``max_diff``."""
        own, pattern = self.levels[0]
        q = np.repeat(np.arange(len(queries)), len(pattern))
        node = np.tile(np.arange(len(pattern)), len(queries))
        seen = np.zeros(len(q), dtype=np.uint8)
        for k, (own, pattern) in enumerate(self.levels):
            if k:
                q, seen = np.repeat(q, FAN), np.repeat(seen, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(pattern)
                q, node, seen = q[real], node[real], seen[real]
            seen = seen + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            near = seen <= max_diff
            q, node, seen = q[near], node[near], seen[near]
        return q, node


def united(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest member reachable from each of ``n`` members over the links a-b."""
    label = np.arange(n) if label is None else label
    while len(a):
        low = np.minimum(label[a], label[b])
        differ = label[a] != label[b]
        if not differ.any():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
    return label


def group_labels(fps: np.ndarray, max_diff: int) -> np.ndarray:
    """Labels of fingerprints in any order, best in Gray order, by one index that each of them walks."""
    index, label = Index(fps), np.arange(len(fps))
    for i in range(0, len(fps), QUERIES):
        q, leaf = index.pairs(fps[i : i + QUERIES], max_diff)
        q = q + i
        ahead = leaf > q
        label = united(len(fps), q[ahead], leaf[ahead], label)
    return label


def links(words: DataFrame, max_diff: int = 3, limit: int = LIMIT) -> DataFrame:
    """Links (u, v) between nodes whose fingerprints of one kind differ in at most ``max_diff`` bits.

    ``words`` (kind, fp, node) holds each (kind, fp) once. The links join exactly the
    nodes that all pairs would join; there are fewer of them than rows.
    """
    rows = grouped(words, max_diff, limit).withColumn("rank", gray_rank(F.col("fp")))
    rows = rows.repartition("kind", "mask", "value").sortWithinPartitions("kind", "mask", "value", "rank").drop("rank")

    def compare(kind, mask, value, fp, node) -> pa.RecordBatch:
        label = np.arange(len(fp))
        edges = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1], True])
        for begin, end in zip(edges, edges[1:]):
            label[begin:end] = begin + group_labels(fp[begin:end], max_diff)
        at = np.flatnonzero(label != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch["kind"].to_numpy(), batch["mask"].to_numpy(), batch["value"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy()]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= GATHER:
                k, m, v = held[:3]
                begin = np.flatnonzero((k != k[-1]) | (m != m[-1]) | (v != v[-1]))  # the last group may go on
                if len(begin):
                    end = begin[-1] + 1
                    yield compare(*(x[:end] for x in held))
                    held = [x[end:] for x in held]
        if held is not None and len(held[0]):
            yield compare(*held)

    return rows.mapInArrow(run, "u long, v long")


# ------------------------------------------------------------------ operators


def groups(docs: DataFrame, shingle: int = 3, max_diff: int = 3, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id that links reach. Null texts have no words;
    texts without words have fingerprint 0 and are linked like others. Repeated rows
    share their component; a null doc_id never names one, unless it has no other.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    words = classes.select(F.lit(0).alias("kind"), "fp", F.col("fp").alias("node"))
    roots = components(links(words, max_diff, limit))
    members = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = stored(members.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id"), "named")
    joined = rows.join(named, rows["fp"] == named["__fp"])
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near copies.

    Two documents are linked if the sets of their word shingles have a Jaccard similarity
    of at least ``percent`` hundredths, and groups are what links connect (see ``minhash``).
    The row with the smallest doc_id stays (nulls last); texts without words, null ones too, are one group.
    Rows are known by doc_id and two 64-bit hashes of the text; of rows that are equal in these, one stays.
    """
    hashes = partial(shingle_hashes, size=shingle)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = {"id": F.col("doc_id"), "k1": F.xxhash64(text), "k2": F.xxhash64(F.lit(1), text)}
    plain = docs.select(*[c.alias(k) for k, c in keys.items()], text.alias("text"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    rows = stored(plain.groupBy("id", "k1", "k2").agg(F.count("*").alias("n")), "rows")
    classes = minhash.signatures(plain, hashes, percent).groupBy("high", "low")
    classes = classes.agg(F.min(place).alias("place"), F.first(F.struct("size", "least", "bits")).alias("s"))
    windows = stored(classes.select(F.monotonically_increasing_id().alias("node"), "place", "s.size", "s.least", "s.bits"), "windows", "zstd")
    classes = stored(windows.drop("least"), "classes", "zstd")
    known = classes.select("node", "place.id", "place.k1", "place.k2")

    def same(a: DataFrame, b: DataFrame, names: dict[str, str]):
        return reduce(lambda x, y: x & y, [a[names[k]].eqNullSafe(b[k]) for k in keys])

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = known.join(nodes, "node")
        found = minhash.sets(plain.join(wanted, same(plain, wanted, {k: k for k in keys})).select("node", "text"), hashes)
        return found.groupBy("node").agg(F.first("hashes").alias("hashes"))  # repeated rows give the same set again

    roots = components(minhash.links(classes.select("node", "size", "bits"), windows, sets_of, percent))
    named = classes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "place")
    first = stored(named.groupBy("root").agg(F.min("place").alias("place")).select("place.id", "place.k1", "place.k2"), "first")
    drop(classes)
    gone = stored(rows.join(first, same(rows, first, {k: k for k in keys}), "left_anti").select(*keys), "gone")
    again = stored(rows.filter("n > 1").join(first, same(rows.filter("n > 1"), first, {k: k for k in keys}), "left_semi").select(*keys), "again")
    drop(rows, first)
    names = {k: free(f"__{k}", docs.columns) for k in keys}
    keyed = docs.withColumns({names[k]: c for k, c in keys.items()})
    left = gone if again.isEmpty() else gone.unionByName(again)
    out = keyed.join(left, same(keyed, left, names), "left_anti")
    if left is not gone:
        out = out.unionByName(keyed.join(again, same(keyed, again, names), "left_semi").dropDuplicates(list(names.values())))
    return out.drop(*names.values())
