"""Operator 6: substring deduplication with suffix automata of reference shards.

A reference shard is all text around one shared anchor (see ``repeats``).  Its reducer streams the
regions in order of (doc_id, start): each is matched against the suffix automaton of those before
it, and where the matching statistic reaches the window length, the window starts earlier in the
corpus; then the region is added to the automaton.  Shards are routed by anchor instead of sent to
every task: a window can only be found in the shard of its own anchor, so broadcasting the rest
would multiply the corpus by the number of shards and find nothing more.

Null and empty texts have no words and come back empty; texts shorter than the window are kept as
they are; of rows that repeat a doc_id the one with the smallest text counts; rows without a doc_id
are left out; other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import grams as g
from .repeats import Plan, covered, find, ranges_by_doc
from .staging import documents

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


class Automaton:
    """Suffix automaton of several sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        last, following, link, length = 0, self.next, self.link, self.length
        for c in sequence:
            q = following[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, c, q)
                continue
            state, p = self._state(length[last] + 1, 0, {}), last
            while p >= 0 and c not in following[p]:
                following[p][c] = state
                p = link[p]
            if p >= 0:
                q = following[p][c]
                link[state] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = state

    def statistics(self, sequence) -> list[int]:
        """For each place, the length of the longest match that ends there."""
        out, state, matched = [], 0, 0
        following, link, length = self.next, self.link, self.length
        for c in sequence:
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            to = following[state].get(c)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            out.append(matched)
        return out


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", joined: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document without the words covered by a window of ``window`` words that also starts
    earlier in the corpus.  spans: removed ranges of words, end exclusive.  kept: the rest, joined
    by single spaces, or (joined=False) with the white space that stood between kept words.  The
    columns to carry come along as one more, the struct rest: no join has to move the texts again."""
    plan = Plan("word", window, max(1, min(8, window * 2 // 5)))

    def pack(part, which, doc, content):
        first, last = part.first[which], part.last[which]
        length = last - first + window
        run, place = g.expand(length)
        return {"key": part.key[which], "doc": part.ids[doc], "first": first - part.bounds[doc], "length": length, "content": content, "values": np.split(part.values[first[run] + place], np.cumsum(length)[:-1]) if len(which) else []}

    def choose(whole, x):
        out = {k: v[x] for k, v in whole.items() if k not in ("values", "multi")}
        return out | {"values": np.concatenate([whole["values"][i] for i in x])}

    def decide(items):
        key, doc, first, length, content, values = (np.concatenate([b[k] for _, b in items]) for k in ("key", "doc", "first", "length", "content", "values"))
        chunk = np.repeat([c for c, _ in items], [len(b["key"]) for _, b in items])
        start = np.cumsum(length) - length
        order = np.lexsort((first, doc, key))
        edge = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1], True])
        found: list[tuple[int, int, int]] = []  # item, first and last window
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            if b - a < 2:
                continue
            own, seen, automaton = order[a:b].tolist(), set(), None
            one = len(set(content[order[a:b]].tolist())) == 1
            for i in own:
                if (c := int(content[i])) in seen:
                    found.append((i, 0, int(length[i]) - window))
                    continue
                seen.add(c)
                if one:
                    continue
                sequence = values[start[i] : start[i] + length[i]].tolist()
                if automaton is None:
                    automaton = Automaton()
                else:
                    found += [(i, e - window + 1, e - window + 1) for e, m in enumerate(automaton.statistics(sequence)) if m >= window]
                automaton.add(sequence)
        f = np.array(found, np.int64).reshape(-1, 3)
        item = f[:, 0]
        return [(c, (doc[item[m]], first[item[m]] + f[m, 1], first[item[m]] + f[m, 2])) for c in np.unique(chunk[item]).tolist() for m in [chunk[item] == c]]

    def cut(table, ranges):
        ids, texts = documents(table)
        lo, hi = ranges_by_doc(ids, ranges)
        n_words, n_removed, spans, kept = [], [], [], []
        for k, text in enumerate(texts):
            data = text.as_py().encode()
            words = data.split()
            n_words.append(len(words))
            if lo[k] == hi[k]:
                n_removed.append(0)
                spans.append([])
                kept.append(b" ".join(words) if joined else data)
                continue
            gone = covered(len(words), ranges[1][lo[k] : hi[k]], ranges[2][lo[k] : hi[k]], window)
            edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8))).reshape(-1, 2).tolist()
            n_removed.append(int(gone.sum()))
            spans.append([{"start": a, "end": b} for a, b in edges])
            if joined:
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist()) if not x]))
            else:
                starts, ends, _ = g.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                cuts = [0, *(x for e in edges for x in e), len(words)]
                kept.append(b" ".join(data[starts[a] : ends[b - 1]] for a, b in zip(cuts[::2], cuts[1::2]) if a < b))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array([k.decode() for k in kept], pa.string())})

    return find(docs, plan, pack, choose, decide, cut, SCHEMA, id_col, text_col, carry)
