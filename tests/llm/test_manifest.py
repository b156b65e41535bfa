"""The manifest's tree, its proofs and the recursive climb against plain Python."""

import hashlib
import zlib

import pytest

from barlytics.llm import merkle
from conftest import SF

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    return sha("".join(framed(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree, i):
    out = []
    for level in tree[:-1]:
        begin = i // 8 * 8
        out.append(("".join(level[begin:i]), "".join(level[i + 1 : begin + 8])))
        i //= 8
    return out


def plain(rows):
    trees = {}
    for lang in sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        mine = [r for r in rows if r["lang"] == lang]
        mine.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[lang] = mine, levels([leaf(r, r["text"]) for r in mine])
    top = levels([tree[-1][0] for _, tree in trees.values()])
    out = []
    for k, (mine, tree) in enumerate(trees.values()):
        for i, r in enumerate(mine):
            path = steps(tree, i) + steps(top, k)
            fold = tree[0][i]
            if r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                fold = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"]))
            for a, b in path:
                fold = sha(a + fold + b)
            out.append((r["doc_id"], tree[0][i], tree[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(merkle.prove(docs)) == plain(docs.collect())


@pytest.mark.parametrize("block_levels", [1, 2])
def test_nulls_ties_repeats_and_many_languages(spark, monkeypatch, block_levels):
    """Nodes above the blocks are copies; with small blocks the tree has several levels of them."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block_levels)
    rows = [(i % 300, f"s{i % 3}", "en", i, "Some Text É" * (i % 4)) for i in range(700)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "s", None, 0, "")] * 9 + [(5, "a", "en", 1, "X")] * 20
    rows += [(9000 + i, "s", f"l{i}", 1, "Long " * (4000 if i == 3 else 1)) for i in range(12)] + [(1, "s", "é", 1, "A"), (2, "s", "", 1, "B")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(merkle.prove(docs)) == plain(docs.collect())


def test_one_row_other_columns_and_none(spark):
    docs = spark.createDataFrame([(3, "s", "en", 1, "Abc")], SCHEMA)
    more = docs.selectExpr("*", "1 AS rank", "2 AS place", "3 AS up", "'x' AS _lang", "4 AS _part")
    assert got(merkle.prove(more)) == plain(docs.collect())
    assert merkle.prove(docs).first()["proof_sha256"] == sha("")
    assert got(merkle.prove(docs.filter("false"))) == []


def test_a_large_run_limit_is_put_back(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", "5")
    docs = spark.createDataFrame([(i, "s", "en", 1, "Abc") for i in range(100)], SCHEMA)
    assert merkle.prove(docs).count() == 100
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == "5"
    spark.conf.unset("spark.sql.cteRecursionRowLimit")
