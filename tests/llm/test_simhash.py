import random
import re

import numpy as np
import pytest
import xxhash

from barlytics.llm import simhash
from barlytics.llm.components import components


def brute_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows, size, max_diff):
    fps = [brute_fingerprint(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= max_diff:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, (d, f) in enumerate(zip([d for d, _ in rows], fps))), key=str)


def texts(n, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(40, 120))] for _ in range(n // 6)]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, "É é"), (906, "a\x1cb c"), (None, "one"), (907, "x y z " * 9000), (907, "x y z " * 9000)]


@pytest.mark.parametrize("limit", [4096, 8])
def test_groups_match_brute_force(spark, limit):
    rows = texts(240) + ODD
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted(map(tuple, simhash.groups(docs, limit=limit).collect()), key=str)
    assert got == brute_groups(rows, 3, 3)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_index_finds_all_pairs():
    r = np.random.default_rng(2)
    center = r.integers(0, 2**64, 30, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 64, (2000, 4)).astype(np.uint64)
    fps = np.unique(center[r.integers(0, 30, 2000)] ^ np.bitwise_or.reduce(flips, axis=1))
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    q, leaf = simhash.Index(fps).pairs(fps, 3)
    want = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    assert {*zip(q.tolist(), leaf.tolist())} == {*map(tuple, want.tolist())}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 2), (2, 3)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(100 + i, 100) for i in range(1, 30)}


def test_keep_one_leaves_one_of_each_group(spark):
    r = random.Random(5)
    base = [" ".join(f"b{i}w{r.randrange(10**6)}" for _ in range(150)) for i in range(20)]
    rows = [(i, t, "s") for i, t in enumerate(base)] + [(100 + i, t, "s") for i, t in enumerate(base)]  # exact copies
    for i, t in enumerate(base):  # near copies, one word changed
        words = t.split()
        words[r.randrange(150)] = "changed"
        rows.append((200 + i, " ".join(words), "s"))
    rows += [(None, base[0], "s"), (300, "", "s"), (301, None, "s"), (0, base[0], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [*range(20), 300]


def edited(seed, families, copies, words, most):
    """Families of edited texts: (doc_id, text), in random order."""
    r = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{r.randrange(10**6)}" for _ in range(r.choice(words))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randrange(most + 1)):
                text[r.randrange(len(text))] = f"e{r.randrange(10**6)}"
            rows.append(" ".join(text))
    r.shuffle(rows)
    return list(enumerate(rows))


def brute_kept(rows, size=5, percent=80):
    """Kept doc_ids, and the pairs that are alike, by comparing all pairs of shingle sets."""
    sets = {d: {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} for d, t in rows for w in [t.lower().split()]}
    root = {d: d for d in sets}
    alike = []

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in range(a):
            if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                alike.append((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}, alike


@pytest.mark.parametrize("block", [256, 8])
def test_keep_one_finds_all_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.minhash, "BLOCK", block)
    rows = edited(11, 30, 12, (40, 90, 150, 300), 5) + [(10_000, "a common line of seven words here")]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    want, alike = brute_kept(rows)
    assert len(alike) > 300 and 30 < len(want) < len(rows) - 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.keep_one(docs).collect()} == want


def test_keep_one_finds_pairs_that_no_band_of_values_shared(spark):
    """Jaccard similarity 8 / 10, for which 40 bands of 5 min-hash values with fixed seeds had none in common."""
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{words} x2682"), (2, f"{words} x27509"), (3, "other " + words[3:])], "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.keep_one(docs).collect()} == {1, 3}


@pytest.mark.parametrize("common", [2, 64])
def test_keep_one_finds_near_copies_among_common_passages(spark, monkeypatch, common):
    """Texts that are mostly passages of many others: alike ones may share no hash that few sets have."""
    import random

    monkeypatch.setattr(simhash.minhash, "COMMON", common)
    rng = random.Random(5)
    passages = [[f"p{k}_{i}" for i in range(45)] for k in range(4)]
    rows = []
    for i in range(150):
        own = [f"t{i % 90}_{j}" for j in range(rng.choice((0, 2, 4, 8)))]
        text = own + [w for k in rng.sample(range(4), 1 + i % 3) for w in passages[k]]
        for _ in range(i % 4):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    want, alike = brute_kept(rows)
    assert len(alike) > 50 and 30 < len(want) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.keep_one(docs).collect()} == want


def test_keep_one_keeps_same_words_in_another_order(spark):
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words), " ".join(words[::-1]), " ".join(words[::2] + words[1::2])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(docs).collect()) == [0, 1, 2]


def test_the_index_decides_on_thousands_in_one_group(monkeypatch):
    """Families around random words, all with the same top bits; far fewer nodes are looked at than there are pairs."""
    import numpy as np

    rng, seen = np.random.default_rng(3), []
    fps = []
    for base in rng.integers(0, 2**44, 900, dtype=np.uint64):
        for _ in range(6):
            x = int(base)
            for bit in rng.integers(0, 64, int(rng.integers(0, 4))):
                x ^= 1 << int(bit)
            fps.append(x)
    fps = np.unique(np.array(fps, dtype=np.uint64))
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    fps = fps[np.argsort(rank)]
    real = np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: (seen.append(np.size(x)), real(x))[1])
    label = simhash.group_labels(fps, 3)
    monkeypatch.undo()
    assert sum(seen) < len(fps) ** 2 / 3
    want = np.arange(len(fps))
    close = [np.flatnonzero(real(fps ^ x) <= 3) for x in fps]
    while True:
        new = np.array([want[c].min() for c in close])
        if (new == want).all():
            break
        want = new
    assert (label == want).all() and len(set(want)) < len(fps) / 2
