"""Token ids of whole texts with a tokenizers file, remembered by word.

A byte-level tokenizer without normaliser merges inside the parts that its pattern
cuts, and every space before a non-space is such a cut. Words between spaces are
therefore looked up; an unknown word is cut by the pattern, and an unknown part goes
to the library's model. Any other kind of tokenizer file, and any text that holds an
added token, goes to the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

from barlytics.llm.tables import holds

#: Words and parts that a worker remembers. Full tables stay as they are, since the
#: first words seen hold the frequent ones; after so many misses they start anew.
REMEMBERED = 400_000
MISSES = 8_000_000
#: The pattern that byte-level pre-tokenizers cut by (a fixed value of the library).
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

#: Marks that end a word and are a part of their own after letters.
CLOSING = frozenset(",.;:!?)")

_ODD = re.compile(r" (?:\s|\Z)")
_loaded: dict[str, "Encoder"] = {}


def byte_letters() -> str:
    """The letter that stands for each byte: itself if printable, else the next from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


class _Words(dict):
    """Ids of a word that follows a space, and under ``parts`` of parts as they stand."""

    def __init__(self, model, dtype: np.dtype):
        super().__init__()
        self.model, self.code, self.letters = model, "H" if dtype.itemsize == 2 else "I", byte_letters()
        self.parts: dict[str, bytes] = {}
        self.missed = 0

    def part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            letters = text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(self.letters)
            ids = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.parts) < REMEMBERED:
                self.parts[text] = ids
        return ids

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.part, PARTS.findall(text)))

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            letters = "\u0120" + (word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
            ids = array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()
        elif word[-1:] in CLOSING and word[:-1].isalpha():
            ids = self[word[:-1]] + self.part(word[-1])
        else:
            ids = self.cut(" " + word)
        self.missed += 1
        if self.missed > MISSES:
            self.clear(), self.parts.clear()
            self.missed = 0
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts to little-endian ids of ``dtype``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.dtype = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        split, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.by_word = (
            spec.get("normalizer") is None and model["type"] == "BPE" and not model.get("dropout")
            and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        self.words = _Words(self.lib.model, self.dtype)

    def whole(self, text: str) -> bytes:
        """The library's own call."""
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(a in text for a in self.added):
            return self.whole(text)
        if _ODD.search(text):
            return self.words.cut(text)
        head, *rest = text.split(" ")
        return self.words.cut(head) + b"".join(map(self.words.__getitem__, rest))


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    holds("bpe", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
