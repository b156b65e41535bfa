"""Hard negatives against brute force; the bounds of the vertical scan."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlytics.llm import hard_negatives as hn
from conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100):
    kept = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is not None and r["label"] is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in v]))
    out = []
    for a, label, v in kept:
        if a % every:
            continue
        order = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, other, w in kept if b != a)
        for p, pid, _ in [x for x in order if x[2] == label][:5]:
            fit = [x for x in order if x[2] != label and -80 * p <= -100 * x[0] <= -100 * p][:5]
            out += [(a, pid, k, x[1], -p, -x[0]) for k, x in enumerate(fit, 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_given_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = got(hn.mine(rows))
    assert found and found == plain(rows.collect())


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 12) / 4], i % 3) for i in range(400)]  # many ties
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(150)]  # copies of an anchor's vector
    rows += [(None, [1.0], 1), (2001, None, 1), (2002, [1.0], None), (2003, [1.0, None], 1), (2004, [math.nan], 1), (2005, [math.inf], 1), (2006, [], 2), (2007, [1.0], 2), (2100, [0.5] * 40, 0)]
    rows += [(200, rows[200][1], 2)] * 3
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("values, block", [(1 << 20, 4096), (50, 4096), (1 << 20, 64)])
def test_ties_copies_and_bad_rows(odd, monkeypatch, values, block):
    """Also with several passes of anchors and many small blocks."""
    monkeypatch.setattr(hn, "PASS_VALUES", values)
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    more = odd.withColumn("anchor", F.lit(1)).withColumn("place", F.lit("x")).withColumn("rank", F.lit(0))
    assert got(hn.mine(more)) == plain(odd.collect())


def test_none(odd):
    assert got(hn.mine(odd.filter("false"))) == []
    assert got(hn.mine(odd.filter("vec_id % 100 <> 0"))) == []


def test_values_beyond_exact_doubles(spark):
    rng = np.random.default_rng(6)
    rows = [(i * 10, [float(x) for x in rng.integers(-(2**20), 2**20, 6)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(hn.mine(df)) == plain(df.collect())


def test_bounds_stop_early_and_lose_nothing():
    rng = np.random.default_rng(7)
    values = np.floor(256 * rng.normal(size=(500, 64)) * np.r_[np.full(8, 1.0), np.full(56, 0.01)])

    class Counting(np.ndarray):
        reads = 0

        def __getitem__(self, key):
            out = super().__getitem__(key)
            Counting.reads += np.size(out)
            return np.asarray(out)

    block = hn.Block.__new__(hn.Block)
    block.ids, block.dims = np.arange(500), values.T.copy().view(Counting)
    block.low, block.high, block.largest = values.min(axis=0), values.max(axis=0), float(np.abs(values).max())
    query = values[0]
    products = values @ query
    least = np.sort(products)[-5]
    at, scores = hn.survivors(block, query, 0, 500, least, np.inf)
    assert sorted(at) == sorted(np.flatnonzero(products >= least)) and (scores == products[at]).all()
    assert Counting.reads < 500 * 64 / 3
