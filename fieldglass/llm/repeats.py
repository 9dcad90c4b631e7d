"""What the two substring operators share: finding the windows that could repeat.

Every window of W consecutive values (words or bytes) has an anchor, a gram chosen by its content.
Pass 1 sends the anchors of each chunk to buckets; an anchor seen only once in the corpus cannot
belong to a repeated window.  Pass 2 sends the regions around the shared anchors, each distinct
content once per chunk; an operator's own reducer decides which of their windows repeat.  Pass 3
cuts those windows out of the texts.  Nothing is sampled: every window has exactly one region.

Ordering for "starts earlier": chunks are read in order of doc_id, and equal windows stand at the
same distance from equal anchors, so comparing regions by (doc_id, start) compares the windows.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

from . import grams as g
from .staging import MESSAGE, bodies, documents, message, messages, on_buckets, on_chunks, on_chunks_with, ordered, stage

U = np.uint64


@dataclass(frozen=True)
class Plan:
    unit: str  # "word" or "byte"
    window: int
    gram: int
    part_bytes: int = 1 << 20


class Part:
    """The values and regions of a part of a chunk."""

    def __init__(self, plan: Plan, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data = ids, data
        if plan.unit == "word":
            self.starts, self.ends, self.bounds = g.words(data, offsets)
            self.values = g.word_hashes(data, self.starts, self.ends)
        else:
            self.bounds = offsets
            self.values = g.BYTES[data]
        self.prefix = g.sums(self.values)
        self.anchor, self.first, self.last = g.anchors(g.run_hashes(self.prefix, plan.gram), self.bounds, plan.window, plan.gram)
        self.key = g.span_hash(self.prefix, self.anchor, self.anchor + plan.gram)

    def content(self, plan: Plan, which: np.ndarray) -> np.ndarray:
        """Digest of each region's bytes (words: joined by a space) and of the place of its anchor.
        Regions of equal digests are taken to be equal, so it is a cryptographic one."""
        first, end = self.first[which], self.last[which] + plan.window
        place = (self.anchor[which] - first).tolist()
        if plan.unit == "word":
            first, end = self.starts[first], self.ends[end - 1]
        whole, out = self.data.tobytes(), []
        for a, b, p in zip(first.tolist(), end.tolist(), place):
            own = b" ".join(whole[a:b].split()) if plan.unit == "word" else whole[a:b]
            out.append(blake2b(own, digest_size=8, person=p.to_bytes(16, "little")).digest())
        return np.frombuffer(b"".join(out), U)

    def doc(self, which: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, self.first[which], "right") - 1


def parts(plan: Plan, table: pa.Table):
    ids, texts = documents(table)
    data, offsets = g.bytes_of(texts)
    for a, b in g.parts(offsets, plan.part_bytes):
        yield Part(plan, ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U(32)) % U(buckets)).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, indexes) of the keys."""
    if len(keys):
        of = bucket_of(keys, buckets)
        order = np.argsort(of, kind="stable")
        for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            yield int(of[x[0]]), x


def shared_anchors(plan: Plan, buckets: int):
    """Pass 1 and its reducer."""

    def send(chunk, table):
        keys = [p.key for p in parts(plan, table)]
        keys, counts = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, U), np.zeros(0))
        return messages([message(chunk, b, (keys[x], counts[x] > 1)) for b, x in by_bucket(keys, buckets)])

    def decide(bucket, table):
        got = bodies(table)
        keys = np.concatenate([k for _, (k, _) in got])
        twice = np.concatenate([t for _, (_, t) in got])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.r_[k[1:] == k[:-1], False]
        yes = same | np.r_[False, same[:-1]] | twice[order]
        shared = np.zeros(len(keys), bool)
        shared[order] = yes
        out, at = [], 0
        for chunk, (k, _) in got:
            if (own := shared[at : at + len(k)]).any():
                out.append(message(chunk, bucket, k[own]))
            at += len(k)
        return messages(out)

    return send, decide


def find(docs, plan: Plan, pack, choose, decide_windows, cut, schema: str, id_col: str, text_col: str, carry: tuple[str, ...] = ()):
    """pack(part, which, doc, content) -> dict of arrays or lists, one entry a region;
    choose(such a dict, indexes) -> what goes to a bucket;
    decide_windows([(chunk, chosen)] of a bucket) -> [(chunk, (doc_id, first, last))], the windows that repeat;
    cut(chunk's table, ranges) -> the rows of the result, each with the columns to carry as rest."""
    staged, _, buckets = stage(docs, id_col, text_col, carry=carry)
    texts, out_schema = staged.select("chunk", "doc_id", "text"), StructType.fromDDL(schema)
    if carry:
        out_schema = out_schema.add("rest", staged.schema["rest"].dataType)
    send, decide = shared_anchors(plan, buckets)
    shared = on_buckets(on_chunks(texts, send, MESSAGE), decide)

    def regions(chunk, table, answers):
        known = [k for _, k in bodies(answers)]
        known = np.sort(np.concatenate(known)) if known else np.zeros(0, U)
        seen: dict[tuple[int, int], int] = {}
        packs, keys, multi, local = [], [], [], []
        for part in parts(plan, table):
            which = np.flatnonzero(g.member(part.key, known))
            if not len(which):
                continue
            key, doc = part.key[which], part.doc(which)
            content = part.content(plan, which)
            fresh = []
            for i, at in enumerate(zip(key.tolist(), content.tolist())):
                k = seen.setdefault(at, len(multi))
                if k == len(multi):
                    multi.append(False)
                    fresh.append(i)
                else:
                    multi[k] = True
                    local.append((part.ids[doc[i]], part.first[which[i]] - part.bounds[doc[i]], part.last[which[i]] - part.bounds[doc[i]]))
            fresh = np.array(fresh, np.int64)
            keys.append(key[fresh])
            packs.append(pack(part, which[fresh], doc[fresh], content[fresh]))
        out = []
        if local:
            own = np.array(local, np.int64)
            out.append(message(chunk, chunk % buckets, ("here", g.merged(own[:, 0], own[:, 1], own[:, 2]))))
        if packs:
            whole = {name: [x for p in packs for x in p[name]] if isinstance(packs[0][name], list) else np.concatenate([p[name] for p in packs]) for name in packs[0]}
            whole["multi"] = np.array(multi, bool)
            for b, x in by_bucket(np.concatenate(keys), buckets):
                out.append(message(chunk, b, ("items", choose(whole, x))))
        return messages(out)

    def windows(bucket, table):
        items, out = [], []
        for chunk, (kind, body) in bodies(table):
            if kind == "here":
                out.append(message(chunk, bucket, body))
            else:
                items.append((chunk, body))
        for chunk, ranges in decide_windows(items) if items else []:
            if len(ranges[0]):
                out.append(message(chunk, bucket, g.merged(*ranges)))
        return messages(out)

    def finish(chunk, table, answers):
        got = [x for _, x in bodies(answers)]
        doc, first, last = (np.concatenate([x[i] for x in got]) if got else np.zeros(0, np.int64) for i in range(3))
        table = ordered(table)
        out = cut(table, g.merged(doc, first, last))
        return out.append_column("rest", table["rest"]) if carry else out

    repeated = on_buckets(on_chunks_with(texts, shared.select("chunk", "body"), regions, MESSAGE), windows)
    return on_chunks_with(staged, repeated.select("chunk", "body"), finish, out_schema)


def covered(n: int, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Which of a document's n values the windows that start in these ranges cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + window, -1)
    return np.cumsum(edge[:-1]) > 0


def ranges_by_doc(ids: np.ndarray, ranges) -> tuple[np.ndarray, np.ndarray]:
    """For ascending ids: where each one's ranges begin and end."""
    return np.searchsorted(ranges[0], ids, "left"), np.searchsorted(ranges[0], ids, "right")
