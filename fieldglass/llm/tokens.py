"""Token ids of whole texts, encoded word by word with a bounded cache of words in each worker.

The word-level BPE used here drops white space and never merges across it, so the ids of a text are
the ids of its words in order, a word being a run of bytes other than space and 0x09-0x0D.  A word
is encoded once per worker if it is in the cache; the rest is numpy gathering.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import grams as g
from .staging import filled

#: Words and bytes of words that a worker keeps: the first it meets.  Later words that are not among
#: them are encoded anew in each part.
CACHED, CACHED_BYTES = 500_000, 16 << 20
PART_BYTES = 1 << 20
#: Words that the library encodes in one text.
TOGETHER = 1000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def largest_id(path: str) -> int:
    """The largest id that a tokenizer file can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


class Index(dict):
    """Numbers of words; a word that is looked up for the first time gets the next one."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = i = len(self)
        return i


class Words:
    """Ids of words.  encode(list of new words) -> their ids, one after the other, and how many each has."""

    def __init__(self, encode):
        self.encode = encode
        self.at = Index()
        self.passing: list[bytes] = []  # of the last call only
        self.kept = self.bytes = 0
        self.ids, self.start = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Index of each word, for start and ids; valid until the next call."""
        index = self.at
        for w in self.passing:
            del index[w]
        self.passing = []
        self.start = self.start[: self.kept + 1]
        self.ids = self.ids[: self.start[-1]]
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        if new := index.new:
            flat, sizes = self.encode([w.decode() for w in new])
            self.ids = np.concatenate([self.ids, flat])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])
            if self.kept + len(new) <= CACHED and self.bytes < CACHED_BYTES:
                self.kept += len(new)
                self.bytes += sum(map(len, new))
            else:
                self.passing = new
            index.new = []
        return at


def flattened(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))


class Library:
    """The tokenizers library over lists of words, TOGETHER of them in one text.

    A token of a byte-level vocabulary stands for as many bytes of the normalised text as it has
    characters, so the bytes of the words tell whose each id is.  Where the normalised text does not
    have the same words any more, or one could hold a special token, each word is encoded alone."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = self.tokenizer.model
        suffix = getattr(model, "end_of_word_suffix", None) or ""
        if hasattr(model, "_resize_cache"):  # no word comes twice, and its own cache costs more than merging
            model._resize_cache(0)
            self.tokenizer.model = model
        known = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(known.values(), default=0) + 1, np.int64)
        for token, i in known.items():
            self.bytes[i] = len(token.removesuffix(suffix))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.part(words[a : a + TOGETHER]) for a in range(0, len(words), TOGETHER)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def part(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = " ".join(words)
        said = np.frombuffer(self.tokenizer.normalizer.normalize_str(joined).encode(), np.uint8)
        space = np.flatnonzero(said == 32)
        if len(space) == len(words) - 1 and not any(s in joined for s in self.special):
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, np.int64)
            ends = np.r_[space, len(said)] - np.arange(len(words))  # without the spaces
            reach = np.cumsum(self.bytes[ids])
            if not len(ids) or reach[-1] == ends[-1]:
                sizes = np.diff(np.r_[0, np.searchsorted(reach, ends, "right")])
                return ids.astype(np.uint32), sizes
        return flattened([self.tokenizer.encode(w, add_special_tokens=False).ids for w in words])


_encoders: dict[tuple[str, str], Words] = {}


def library_words(path: str) -> Words:
    """The tokenizers library as encoder, one per worker and file."""
    if ("library", path) not in _encoders:
        _encoders["library", path] = Words(Library(path))
    return _encoders["library", path]


def encoded_flat(texts: pa.Array, words: Words, end: int | None = None):
    """(first text, ids of the texts from there one after the other, their n + 1 bounds, index and number
    of the words of each) in parts of bounded size; end is appended to each text."""
    data, offsets = g.bytes_of(filled(texts))
    for a, b in g.parts(offsets, PART_BYTES):
        raw = data[offsets[a] : offsets[b]].tobytes()
        own = [raw[x:y].split() for x, y in zip((offsets[a:b] - offsets[a]).tolist(), (offsets[a + 1 : b + 1] - offsets[a]).tolist())]
        at = words([w for x in own for w in x])
        size = words.start[at + 1] - words.start[at]
        run, place = g.expand(size)
        ids = words.ids[words.start[at][run] + place]
        bounds = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum([len(x) for x in own])]]
        if end is not None:
            ids = np.insert(ids, bounds[1:], np.uint32(end))
            bounds = bounds + np.arange(len(bounds))
        yield a, ids, bounds, at, [len(x) for x in own]


def encoded(texts: pa.Array, words: Words, end: int | None = None):
    """(first text, ids of each text from there, index and number of the words of each) in parts of bounded size."""
    for a, ids, bounds, at, sizes in encoded_flat(texts, words, end):
        yield a, [ids[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())], at, sizes
