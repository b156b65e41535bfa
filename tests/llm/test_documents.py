"""Operators on single documents against brute-force versions and the libraries."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlytics.llm import bpe, decontamination, host_quality, licenses, packing, queries, token_counts, toxicity
from conftest import SF

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "a  b", " a", "a ", "\n\n a \n b", "x   y", "<s> z </s> <unk> <0x41> <|endoftext|>", "①é\x00 ﬁ ▁ ▁▁a b▁c", "日本 語abc123 １２",
    "it's  'll 're\t\t q   www   ", "ab \x1c c", "\x00\x7f\xad ÿ", "don't I'M 's", "a  b\x85 c", "a" * 500, "Long text, again. " * 5000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return ODD + [r["text"] for r in docs.select("text").collect()]


def table(spark, texts, **more):
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "null id", "s"), (7777, None, None), (3, "again", "s"), (3, "again", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


EMPTY = "doc_id long, text string, source string"


def test_word_encoder_equals_the_library(texts):
    coder = bpe.Encoder(BYTE)
    assert coder.by_word
    for t in texts:
        assert coder.encode(t) == coder.whole(t)


def test_word_encoder_with_full_tables(texts, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "MISSES", 300)
    coder = bpe.Encoder(BYTE)
    assert all(coder.encode(t) == coder.whole(t) for t in texts[:60])


def test_other_tokenizer_files_go_to_the_library(texts):
    coder = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not coder.by_word and coder.encode(texts[20]) == coder.whole(texts[20])


def test_token_counts_equal_the_library(texts):
    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), token_counts.Counter(PIECE)
    assert [own.count(t) for t in texts] == [len(x) for x in lib.encode(texts, num_threads=1)]


def test_token_count_rows(spark):
    got = token_counts.count_tokens(table(spark, ["", "Long text, again. " * 5000]), PIECE).collect()
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got)[1:3] == [(0, 0, 0, False), (1, 90000, got[1]["n_tokens"], True)]
    assert len(got) == 6
    assert token_counts.count_tokens(spark.createDataFrame([], EMPTY), PIECE).count() == 0


def check_pieces(rows, want, window=1024):
    by_doc, fill = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert max(fill.values(), default=0) <= window
    for doc_id, ids in want.items():
        at = 0
        for r in sorted(by_doc.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], dtype="<u4").tobytes())
        assert at == len(ids)
    assert not by_doc
    return sum(window - f for f in fill.values() if f & (f - 1))


def test_packing_holds_every_id_once(spark, texts):
    lib = Tokenizer.from_file(BYTE)
    texts = [t for t in texts if "again" not in t]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    want = {i: lib.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows}
    assert check_pieces(packing.pack(docs, BYTE).collect(), want) == 0
    assert packing.pack(spark.createDataFrame([], EMPTY), BYTE).count() == 0


def test_packing_deals_open_windows_anew():
    r = random.Random(4)
    packer, want = packing.Packer(64, 0, max_open=5), {}
    for i in range(500):
        want[i] = [r.randrange(1000) for _ in range(r.randrange(1, 150))]
        packer.add(i, np.array(want[i], dtype="<u2"))
    packer.deal(last=True)
    names = [c.split()[0] for c in packing.PIECE.split(", ")]
    assert check_pieces([dict(zip(names, row)) for row in packer.done], want, 64) == 0


def test_packing_takes_the_level_of_least_squares():
    r = np.random.default_rng(5)
    packer = packing.Packer(32, 0)
    packer.levels[1:32] = r.integers(0, 4, 31)
    for size in range(1, 32):
        def squares(level):
            n = packer.levels.copy()
            if level:
                n[level] -= 1
            if level + size < 32:
                n[level + size] += 1
            return (n[1:32] ** 2).sum()

        options = [0, *(h for h in range(1, 33 - size) if packer.levels[h])]
        assert squares(packer.level_for(size)) == min(map(squares, options))


def brute_measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows, covered, seen, dup = {}, set(), set(), 0
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            covered |= {j for i in at for j in range(i, i + 8)}
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_measures_equal_brute_force(texts):
    more = ["a b c d e f g h a b c d e f g h x", "x " * 9, "w " * 8, "l\nl\n\n \nl", " a\u00a0b c\x85d "]
    for t in texts + more:
        assert host_quality.measure_text(t) == brute_measures(t)


def test_host_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "fine") for i in range(60)] + [(100 + i, "short", "bad") for i in range(60)] + [(200, good, "bad"), (201, good, None), (202, None, "fine")]
    docs = spark.createDataFrame(rows, EMPTY)
    got = {r["doc_id"]: r for r in host_quality.judge(docs).collect()}
    assert len(got) == len(rows)
    assert got[200]["host_rejected"] and not got[200]["base_failed"] and not got[200]["kept"]
    assert got[201]["kept"] and got[0]["kept"] and not got[202]["kept"] and got[202]["n_words"] == 0
    kept = host_quality.keep(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["kept"]}
    assert host_quality.judge(docs.limit(0)).count() == 0 and host_quality.keep(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    good, bad = [r["score"] for r in rows if r["toxic"] == 1], [r["score"] for r in rows if r["toxic"] == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.95
    flagged = [r["toxic"] for r in rows if r["predicted"]]
    assert np.mean(flagged) > 0.95
    # labels of held-out rows have no influence
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_toxicity_without_labels_and_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = table(spark, ["", "some words", "x " * 50_000])
    model = toxicity.fit(docs, labels)
    assert model == {}
    scores = docs.select(toxicity.score(F.col("text"), model).alias("s")).collect()
    assert [r["s"] for r in scores] == [0.5] * 7
    labels = spark.createDataFrame([(0, 1), (1, None), (2, 1), (3, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert all(0 <= r["s"] <= 1 for r in docs.select(toxicity.score(F.col("text"), toxicity.fit(docs, labels)).alias("s")).collect())


def test_ftrl_is_sparse():
    model = toxicity.Ftrl()
    for _ in range(200):
        model.learn(toxicity.places("you idiot there"), 1)
        model.learn(toxicity.places("you friend there"), 0)
    w = model.weights(np.arange(toxicity.PLACES))
    assert 0 < np.count_nonzero(w) <= 12
    assert w[toxicity.places("idiot")[0]] > 0 > w[toxicity.places("friend")[0]]


def brute_base(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in licenses.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_equals_brute_force(texts):
    scan = licenses.Scanner().scan
    more = ["MIT-License mit license MIT\nLICENSE", "the general public license license", "Apache license, mit license", "mit licenses", "É MIT License É"]
    for t in texts + more:
        got = scan(t)
        assert got[:5] == brute_base(t)
        assert {x for x in got[4].split(",") if x} <= {x for x in got[5].split(",") if x}
        assert 0 <= got[6] <= 1 and (got[6] > 0) == bool(got[5])


def test_license_rules_and_suppression(spark):
    scan = licenses.Scanner().scan
    assert len(licenses.rules()) > 200
    assert scan("GNU Lesser General Public License v2.1")[5] == "gpl,lgpl"
    assert [d["label"] for d in scan("GNU Lesser General Public License v2.1")[7]] == ["lgpl"]
    assert scan("// SPDX-License-Identifier: GPL-2.0-or-later")[5] == "gpl"
    assert scan("# spdx-license-identifier: MIT")[5] == "mit"
    assert scan("Permission is hereby granted, free of charge, to any person obtaining a copy")[5] == "mit"
    assert scan("Licensed under CC BY-NC 4.0.")[5] == "cc-by-nc"
    assert scan("a licensed driver under the bridge")[5] == ""
    rows = licenses.scan(table(spark, ODD)).collect()
    assert len(rows) == len(ODD) + 4 and licenses.scan(spark.createDataFrame([], EMPTY)).count() == 0
    text = "all rights reserved " * 20_000
    assert len(scan(text)[7]) == 20_000


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(6)
    for _ in range(150):
        p, t = ("".join(r.choice("abc ") for _ in range(r.randrange(1, n))) for n in (90, 120))
        assert decontamination.distance(p, t)[0] == brute_distance(p, t)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("ban", "kor", "til", "mes", "o") for b in ("a", "ed", "ing", "ör", "x")]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(8, 30)))) for i in range(12)]
    docs = []
    for i in range(120):
        body = [r.choice(words) for _ in range(r.randrange(5, 80))]
        if i % 2:
            item = list(items[i % 12][1])
            for _ in range(r.randrange(0, 9)):
                k = r.randrange(len(item))
                item[k : k + 1] = r.choice(["", "q", item[k] + "z"])
            body.insert(r.randrange(len(body)), "".join(item).upper() + ",\n")
        docs.append((i, " ".join(body), "s"))
    docs += [(500, None, None), (501, "", "s"), (None, items[0][1], "s"), (3, docs[3][1], "s")]
    items += [(50, None), (None, "no id here"), (51, " ., "), (52, items[0][1])]
    got = decontamination.find(spark.createDataFrame(docs, EMPTY), spark.createDataFrame(items, "item_id long, text string"), block=200).collect()
    want = []
    for d, t, _ in docs:
        t = decontamination.normalised(t or "")
        for i, x in items:
            x = decontamination.normalised(x or "")
            if i is not None and x and (n := brute_distance(x, t)) <= len(x) // decontamination.PER_ERROR:
                want.append((d, i, n))
    assert sorted(((g["doc_id"], g["item_id"], g["distance"]) for g in got), key=str) == sorted(want, key=str)
    assert any(n for _, _, n in want) and any(n == 0 for _, _, n in want)
    left = decontamination.drop(spark.createDataFrame(docs, EMPTY), spark.createDataFrame(items, "item_id long, text string"), block=200)
    assert sorted((x["doc_id"] for x in left.collect()), key=str) == sorted((d for d, _, _ in docs if d not in {w[0] for w in want}), key=str)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find(spark.createDataFrame(docs, EMPTY), none).count() == 0
    assert decontamination.drop(spark.createDataFrame(docs, EMPTY), none).count() == len(docs)


def test_license_sentences_that_wrap():
    scan = licenses.Scanner().scan
    wrapped = {
        "Neither the name of the X nor the names of its\n   contributors may be used": "bsd", "to deal\n// in the Software without restriction": "mit",
        "Mozilla Public\nLicense, v. 2.0": "mpl", "redistribute it and/or modify\n * it under the terms of the GNU Lesser": "lgpl",
        "Licensed under the terms of the\n# Apache License, Version 2.0": "apache", "Permission is hereby granted, free of charge,\n to any person\nobtaining a copy": "mit",
    }
    for text, label in wrapped.items():
        assert scan(text)[5] == label, text
    assert scan("all kinds of rights that are reserved for the public")[5] == ""


def test_short_items_are_whole_words(spark):
    items = spark.createDataFrame([(1, "art"), (2, "Start")], "item_id long, text string")
    docs = table(spark, ["we start here", "the art", "art", "artist of parts", "x start", "Art, art"])
    got = {(r["doc_id"], r["item_id"], r["begin"], r["end"]) for r in decontamination.find(docs, items).collect()}
    assert got == {(0, 2, 3, 8), (1, 1, 4, 7), (2, 1, 0, 3), (4, 2, 2, 7), (5, 1, 0, 3)}


def test_repeated_rows_do_not_outweigh_others_in_training(spark):
    rows = [(i, "you vile fool" if i % 2 else "a fine day", "s") for i in range(300)]
    docs = spark.createDataFrame(rows + [(2, "a fine day", "s")] * 2000, EMPTY)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(rows, EMPTY), labels)
    assert toxicity.fit(docs, labels) == once and once
