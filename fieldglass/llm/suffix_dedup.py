"""Operator 10: byte substrings found by a merge sort of suffixes that knows common prefixes.

The suffixes at shared anchors (see ``repeats``) are sorted in each chunk, with the length of the
prefix that each has in common with the one before it, and exchanged front-coded: only what follows
the common prefix travels.  A bucket combines the runs of all chunks with a loser tree that keeps
those lengths, so bytes known to be equal are never compared again, and yields the sorted order
with its common prefixes.  The texts before the anchors are sorted alike, read backwards.

A window that begins d bytes before its anchor repeats if another anchor has the same d bytes
before it and the same window - d bytes from it on: if both stand in the same class of the one
order cut at common prefixes below d and of the other cut at those below window - d.  That is
settled for all anchors of a bucket at once, for every d.

Null and empty texts have no bytes; texts shorter than the window are kept as they are; of rows
that repeat a doc_id the one with the smallest text counts; rows without a doc_id are left out;
other columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .repeats import Plan, covered, find, ranges_by_doc
from .staging import documents

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which known bytes need no look."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Sorted order, common prefixes, lengths, and what is new in each string."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared, tails, before = [], [], b""
    for i in order:
        h = common(before, strings[i], 0)
        shared.append(h)
        tails.append(strings[i][h:])
        before = strings[i]
    return np.array(order, np.int32), np.array(shared, np.int32), np.array([len(t) for t in tails], np.int32), b"".join(tails)


def decoded(run) -> tuple[list[int], list[bytes], list[int]]:
    order, shared, lengths, tails = run
    out, at, s = [], 0, b""
    for h, n in zip(shared.tolist(), lengths.tolist()):
        s = s[:h] + tails[at : at + n]
        at += n
        out.append(s)
    return order.tolist(), out, shared.tolist()


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over sorted runs with their common prefixes: (run, place) in order, and the
    common prefix of each string with the one before it."""
    k = 1
    while k < len(runs):
        k *= 2
    place, known = [0] * len(runs), [0] * len(runs)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; -1 has no string left.  known: with the string put out last."""
        if a < 0 or b < 0:
            return (b, a) if a < 0 else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a][0][place[a]], runs[b][0][place[b]]
        h = common(x, y, known[a])
        if x[h : h + 1] < y[h : h + 1] or (h == len(x) == len(y) and a < b):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    losers = [-1] * k
    level = [i if i < len(runs) and runs[i][0] else -1 for i in range(k)]
    at = k
    while len(level) > 1:
        at //= 2
        up = []
        for i in range(at):
            w, losers[at + i] = play(level[2 * i], level[2 * i + 1])
            up.append(w)
        level = up
    best, order, prefixes = level[0], [], []
    while best >= 0:
        order.append((best, place[best]))
        prefixes.append(known[best])
        place[best] += 1
        node, x = (best + k) // 2, best
        if place[best] < len(runs[best][0]):
            known[best] = runs[best][1][place[best]]
        else:
            x = -1
        while node:
            x, losers[node] = play(x, losers[node])
            node //= 2
        best = x
    return order, prefixes


def merged_order(items, side: str, base: list[int]) -> tuple[np.ndarray, np.ndarray]:
    runs = [decoded(body[side]) for _, body in items]
    order, prefixes = merge([(strings, shared) for _, strings, shared in runs])
    return np.array([base[r] + runs[r][0][p] for r, p in order], np.int64), np.array(prefixes, np.int64)


def dedup_byte_substrings(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the bytes covered by a window of ``window`` bytes of its UTF-8 text
    that also starts anywhere else.  n_spans: maximal removed runs; kept: the other bytes."""
    gram = max(1, min(64, window // 4))
    plan = Plan("byte", window, gram)

    def pack(part, which, doc, content):
        first, last, anchor, raw = part.first[which], part.last[which], part.anchor[which], part.data.tobytes()
        right = [raw[a:b] for a, b in zip(anchor.tolist(), (last + window).tolist())]
        left = [raw[a:b][::-1] for a, b in zip(first.tolist(), anchor.tolist())]
        return {"doc": part.ids[doc], "first": first - part.bounds[doc], "least": anchor - last, "most": anchor - first, "right": right, "left": left}

    def choose(whole, x):
        out = {k: whole[k][x] for k in ("doc", "first", "least", "most", "multi")}
        return out | {k: front_coded([whole[k][i] for i in x]) for k in ("right", "left")}

    def decide(items):
        doc, first, least, most, multi = (np.concatenate([b[k] for _, b in items]) for k in ("doc", "first", "least", "most", "multi"))
        sizes = [len(b["doc"]) for _, b in items]
        base, n = (np.cumsum(sizes) - sizes).tolist(), len(doc)
        by_right, right = merged_order(items, "right", base)
        by_left, left = merged_order(items, "left", base)
        after, before = np.empty(n, np.int64), np.empty(n, np.int64)
        repeats = np.zeros((n, window - gram + 3), bool)  # [item, d + 1]
        for d in range(window - gram + 1):
            own = np.flatnonzero((least <= d) & (d <= most))
            after[by_right] = np.cumsum(right < window - d)
            before[by_left] = np.cumsum(left < d)
            both = after[own] * (n + 1) + before[own]
            order = np.argsort(both, kind="stable")
            same = both[order][1:] == both[order][:-1]
            twice = np.empty(len(own), bool)
            twice[order] = np.r_[same, False][: len(own)] | np.r_[False, same][: len(own)]
            repeats[own, d + 1] = twice | multi[own]
        step = np.diff(repeats.astype(np.int8), axis=1)
        item, low = np.nonzero(step == 1)  # d from low ...
        _, high = np.nonzero(step == -1)  # ... to below high
        begin, end = first[item] + most[item] - high + 1, first[item] + most[item] - low
        chunk = np.repeat([c for c, _ in items], sizes)[item]
        return [(c, (doc[item[m]], begin[m], end[m])) for c in np.unique(chunk).tolist() for m in [chunk == c]]

    def cut(table, ranges):
        ids, texts = documents(table)
        lo, hi = ranges_by_doc(ids, ranges)
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for k, text in enumerate(texts):
            data = text.as_py().encode()
            n_bytes.append(len(data))
            if lo[k] == hi[k]:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(data)
                continue
            gone = covered(len(data), ranges[1][lo[k] : hi[k]], ranges[2][lo[k] : hi[k]], window)
            n_removed.append(int(gone.sum()))
            n_spans.append(int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum()))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        long = lambda x: pa.array(x, pa.int64())
        return pa.table({"doc_id": long(ids), "n_bytes": long(n_bytes), "n_removed": long(n_removed), "n_spans": long(n_spans), "kept": pa.array(kept, pa.binary())})

    return find(docs, plan, pack, choose, decide, cut, SCHEMA, id_col, text_col)
