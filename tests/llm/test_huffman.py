import heapq
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barlytics.llm import huffman, tables

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_lengths_are_optimal_within_the_limit():
    r = np.random.default_rng(1)
    for counts in (r.integers(0, 50, 40), np.array([1, 1, 2, 4, 8, 16, 32, 64, 128]), r.zipf(1.3, 500)):
        lengths = huffman.code_lengths(counts, 30)
        heap = [int(c) for c in counts if c]
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert (lengths.astype(int) * counts).sum() == cost
        assert (counts > 0).tolist() == (lengths > 0).tolist()
    limited = huffman.code_lengths(np.array([1, 1, 2, 4, 8, 16, 32, 64, 128]), 5)
    assert limited.max() == 5 and (0.5 ** limited.astype(float)).sum() <= 1


def test_limit_gives_way_to_the_number_of_ids():
    assert huffman.code_lengths(np.ones(100, dtype=np.int64), 3).max() == 7
    assert huffman.code_lengths(np.array([0, 9]), 3).tolist() == [0, 1]
    assert len(huffman.code_lengths(np.zeros(0, dtype=np.int64))) == 0


def test_blocks_decode_from_their_checkpoints():
    r = np.random.default_rng(3)
    ids = r.zipf(1.2, 10_000) % 3000
    lengths = huffman.code_lengths(np.bincount(ids))
    payload, offsets = huffman.encode(ids, lengths, huffman.canonical(lengths))
    stream = np.frombuffer(payload, dtype=">u4")
    decoder = huffman.Decoder(lengths)
    sizes = np.full(len(offsets), huffman.BLOCK)
    sizes[-1] = len(ids) - huffman.BLOCK * (len(offsets) - 1)
    assert (decoder.blocks(stream, offsets, sizes) == ids).all()
    assert (decoder.blocks(stream, offsets[3:5], sizes[3:5]) == ids[3 * 1024 : 5 * 1024]).all()


def test_round_trip(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["alpha", "béta", "gamma,", "δ", "\n", "x" * 30]) for _ in range(r.randrange(1, 60))), "z") for i in range(400)]
    rows += [(1000, "long text " * 40_000, "z"), (1001, "", "z"), (1002, None, "z"), (None, "no id", None), (5, rows[5][1], "z"), (1003, "a <|endoftext|> b  ", "z")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = tables.new_path(spark, "huffman")
    huffman.write(docs, PATH, path)
    lib = Tokenizer.from_file(PATH)
    want = sorted(((d is not None, d, lib.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, _ in rows), key=lambda x: (x[0], x[1] or 0))
    start, expected = 0, []
    for _, d, ids in want:
        expected.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = sorted(map(tuple, huffman.read_digests(spark, path).collect()), key=lambda x: x[1])
    assert got == expected
    back = huffman.read_ids(spark, path).collect()
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    assert sorted(((x["doc_id"], x["ids"]) for x in back), key=key) == sorted(((d, ids) for _, d, ids in want), key=key)


def test_empty_table(spark):
    path = tables.new_path(spark, "huffman")
    huffman.write(spark.createDataFrame([], "doc_id long, text string"), PATH, path)
    assert huffman.read_digests(spark, path).count() == 0
