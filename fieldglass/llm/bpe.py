"""Operator 7: BPE encoding with a pair occurrence index, and decoding.

The new words of a part are laid out as one array of symbols with links to both neighbours.  An
index maps the rank of each pair to all its places; the lowest active rank is taken, merged at all
its places from left to right, and only the lists of the pairs at its edges change.  Should a merge
make a pair of a lower rank, the places left wait until that one is done, as in a word taken alone.

Null and empty texts have no ids and decode to the empty text; repeated rows and doc_ids are
encoded each on its own; rows without a doc_id are left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .staging import by_id
from .tokens import CACHED, Words, default_tokenizer, encoded, flattened

#: A word that its normaliser only lower-cases and its splitter leaves whole.
PLAIN = re.compile("[A-Za-z]+").fullmatch
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairIndex:
    """A BPE model from a tokenizer file: its own normaliser and splitter, our merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, tokenizer = spec["model"], Tokenizer.from_file(path)
        self.normalise = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        self.sides: list[tuple[int, int]] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (self.vocab[a], self.vocab[b])
            self.rank[pair] = len(self.merged)
            self.sides.append(pair)
            self.merged.append(self.vocab[a + b])
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.known: dict[str, list[int]] = {}

    def pieces(self, word: str) -> list[str]:
        """The separately merged pieces of a word; specials stand alone, after a null character."""
        if PLAIN(word):
            return [word.lower()]
        out = []
        for k, part in enumerate(self.marks.split(word) if self.marks else [word]):
            out += ["\0" + part] if k % 2 else [piece for piece, _ in self.split(self.normalise(part))]
        return out

    def symbols(self, piece: str) -> list[int]:
        known = [self.vocab.get(c) for c in piece[:-1]] + [self.vocab.get(piece[-1] + self.suffix)]
        return [s for s in known if s is not None]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word.  Pieces that came before are not merged again."""
        cut = [self.pieces(w) for w in words]
        known = self.known
        new = [p for p in dict.fromkeys(p for x in cut for p in x) if p not in known]
        plain = [p for p in new if p[0] != "\0"]
        known.update((p, [self.special[p[1:]]]) for p in new if p[0] == "\0")
        known.update(zip(plain, self.merge(plain)))
        out = [known[x[0]] if len(x) == 1 else [i for p in x for i in known[p]] for x in cut]
        if len(known) > CACHED:
            for p in new:
                del known[p]
        return out

    def merge(self, pieces: list[str]) -> list[list[int]]:
        symbol: list[int] = []
        after: list[int] = []
        before: list[int] = []
        owner: list[int] = []
        places: dict[int, list[int]] = {}
        rank = self.rank
        for w, piece in enumerate(map(self.symbols, pieces)):
            start, n = len(symbol), len(piece)
            symbol += piece
            owner += [w] * n
            before += range(start - 1, start + n - 1)
            after += range(start + 1, start + n + 1)
            if n:
                before[start] = after[-1] = -1
            for i, pair in enumerate(zip(piece, piece[1:]), start):
                if (r := rank.get(pair)) is not None:
                    if r in places:
                        places[r].append(i)
                    else:
                        places[r] = [i]
        active = list(places)
        heapq.heapify(active)
        gone = -1
        while active:
            r = heapq.heappop(active)
            todo = sorted(places.pop(r, ()))
            (left, right), to = self.sides[r], self.merged[r]
            for k, i in enumerate(todo):
                j = after[i]
                if symbol[i] != left or j < 0 or symbol[j] != right:
                    continue
                symbol[i], symbol[j] = to, gone
                after[i] = n = after[j]
                if n >= 0:
                    before[n] = i
                lower = False
                p = before[i]
                for at, pair in ((p, (symbol[p], to) if p >= 0 else None), (i, (to, symbol[n]) if n >= 0 else None)):
                    if pair is not None and (q := rank.get(pair)) is not None:
                        if q not in places:
                            places[q] = []
                            heapq.heappush(active, q)
                        places[q].append(at)
                        lower |= q < r
                if lower and k + 1 < len(todo):
                    if r not in places:
                        places[r] = []
                        heapq.heappush(active, r)
                    places[r] += todo[k + 1 :]
                    break
        out: list[list[int]] = [[] for _ in pieces]
        for s, w in zip(symbol, owner):
            if s != gone:
                out[w].append(s)
        return out

    def decode(self, ids) -> str:
        """Tokens joined by spaces, as for a tokenizer file without a decoder."""
        return " ".join(map(self.token.__getitem__, ids))


class Decoded:
    """Decoded words, beside the cache of words they belong to."""

    def __init__(self, model: PairIndex, words: Words):
        self.model, self.words, self.kept, self.texts = model, words, 0, []

    def __call__(self, at) -> list[str]:
        del self.texts[self.kept :]
        self.kept = self.words.kept
        ids, start = self.words.ids, self.words.start[len(self.texts) :].tolist()
        self.texts += [self.model.decode(ids[a:b].tolist()) for a, b in zip(start, start[1:])]
        return list(map(self.texts.__getitem__, at.tolist()))


_models: dict[str, tuple[Words, Decoded]] = {}


def bpe_round_trip(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes its ids.  with_ids adds ids (array<int>) and decoded."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        if path not in _models:
            model = PairIndex(path)
            words = Words(lambda new: flattened(model.encode(new)))
            _models[path] = (words, Decoded(model, words))
        words, decoded = _models[path]
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for a, texts, at, sizes in encoded(batch["text"], words):
                said = decoded(at)
                plain, k = [], 0
                for n in sizes:
                    plain.append(" ".join([w for w in said[k : k + n] if w]))
                    k += n
                columns = [pa.array(ids[a : a + len(texts)], pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in texts]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in plain])]
                if with_ids:
                    columns += [pa.array([x.astype("int32").tolist() for x in texts], pa.list_(pa.int32())), pa.array(plain)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    return by_id(docs, id_col, text_col).mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if with_ids else ""))
