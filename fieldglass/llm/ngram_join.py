"""Operator 3: set-similarity self join on word n-grams by rare-first prefix filtering.

1. Documents with the same set collapse to the smallest doc_id (one signature row a document).
2. n-grams are ordered rare first: the frequent ones by a count table of bounded size made from
   all documents, the rest by hash.  Any order gives the same links; this one gives short lists.
3. Extended prefixes: of two linked sets, the prefixes longer by l share l n-grams.  n-grams that
   only one document sends are told back to the chunks, and a document with fewer than l others
   cannot have a link.  This drops most documents before any list is formed.
4. The remaining documents meet on the n-grams of their prefixes.  Pairs are kept if they pass the
   length, the positional and the suffix filter (overlap of histograms over parts of the hash
   range; parts that are full in both sets pass).  Of long lists, pairs that stand in one group by
   other pairs already are left out, so lists of many copies cost little after the first.
5. Groups, the components of those pairs, are verified exactly: whole sets meet by group, and
   every pair of a group is counted once by matrix product.  A group larger than block is cut in
   blocks, and each block, and each pair of blocks, is counted for itself (of two blocks only the
   pairs across), so no task holds a large group.

Null and empty texts and texts without words have no n-grams, link with nothing and are their own
component; a text with fewer words than n has its whole sequence as its only n-gram; of rows that
repeat a doc_id the one with the smallest text counts; rows without a doc_id are left out; other
columns are ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams as g
from .components import components
from .repeats import by_bucket
from .staging import MESSAGE, bodies, chunk_of, documents, message, messages, new_table, on_buckets, on_chunks, on_chunks_with, saved, stage

U = np.uint64
#: n-grams in the table of frequent ones, and those that a chunk names for it.
FREQUENT, NAMED = 1 << 16, 1 << 12
PARTS = 32
#: Lists up to here are expanded many at once, longer ones one by one, with the same filters.
SHORT = 64
PART_BYTES = 1 << 20
#: A histogram counts to here; a part of the hash range where a set has as many or more n-grams is full.
FULL = 65535
#: Bytes of a posting of step 4 at most (the shared n-grams of extended prefixes are about twice those that are sent),
#: of an n-gram of step 5, and of the text that an n-gram stands for.
ENTRY, WHOLE, ROOM = 96, 8, 6


class Sets:
    """The n-gram sets of some documents: tokens ascending within each document."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, n: int):
        data = g.LOWER[data]
        starts, ends, bounds = g.words(data, offsets)
        prefix = g.sums(g.word_hashes(data, starts, ends))
        size = np.diff(bounds)
        run, place = g.expand(np.where(size >= n, size - n + 1, np.minimum(size, 1)))
        first = bounds[run] + place
        token = g.span_hash(prefix, first, first + np.minimum(n, size[run]))
        order = np.lexsort((token, run))
        token, run = token[order], run[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (run[1:] != run[:-1])
        self.ids, self.token, self.doc = ids, token[new], run[new]
        self.size = np.bincount(self.doc, minlength=len(ids)).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def total(self, values: np.ndarray) -> np.ndarray:
        sums = np.r_[np.zeros(1, U), np.cumsum(values, dtype=U)]
        return sums[self.start + self.size] - sums[self.start]


def sets_of(table: pa.Table, n: int, wanted: np.ndarray | None = None):
    ids, texts = documents(table)
    if wanted is not None:
        keep = np.isin(ids, wanted)
        ids, texts = ids[keep], texts.filter(pa.array(keep))
    data, offsets = g.bytes_of(texts)
    for a, b in g.parts(offsets, PART_BYTES):
        yield Sets(ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)


def pairs_below(rank: np.ndarray, start: np.ndarray, at: int, most: int):
    """Element and each of those before it in its list, most pairs or one element at a time."""
    ends = np.cumsum(rank)
    while at < len(rank):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        run, place = g.expand(rank[at:to])
        yield run + at, start[run + at] + place
        at = to


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Each vertex of these edges with the least of its component."""
    up: dict[int, int] = {}

    def root(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return list(up), [root(x) for x in list(up)]


def histograms(token: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """n-grams of each document in each of PARTS parts of the hash range, FULL at most."""
    parts = np.bincount(doc * PARTS + (token >> U(64 - 5)).astype(np.int64), minlength=docs * PARTS)
    return np.minimum(parts, FULL).astype(np.uint16).reshape(docs, PARTS)


def may_share(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which rows of histograms allow least n-grams in both sets; where both are full, any number may be."""
    both = np.minimum(a, b)
    return (both.sum(1, dtype=np.int64) >= least) | (both == FULL).any(1)


def linked(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which pairs of a set on the left and one on the right have intersection / union >= num / den, by
    matrix product.  A product of 2048 columns is exact in 32 bits, their sum is kept in 64."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    known, column = np.unique(np.concatenate(left + right), return_inverse=True)
    at, own = np.cumsum(sizes[0])[-1], np.zeros((2, len(known)), bool)
    own[0, column[:at]] = own[1, column[at:]] = True
    both = own.all(0)
    number = np.cumsum(both) - 1
    sides = []
    for side, c in zip(sizes, (column[:at], column[at:])):
        row, shared = np.repeat(np.arange(len(side)), side), both[c]
        row, c = row[shared], number[c[shared]]
        order = np.argsort(c, kind="stable")
        sides.append((row[order], c[order]))
    count = np.zeros((len(left), len(right)))
    for c in range(0, int(both.sum()), 2048):
        m = []
        for size, (row, column) in zip(sizes, sides):
            a, b = np.searchsorted(column, (c, c + 2048))
            m.append(np.zeros((len(size), 2048), np.float32))
            m[-1][row[a:b], column[a:b] - c] = 1
        count += m[0] @ m[1].T
    count = count.astype(np.int64)
    return den * count >= num * (sizes[0][:, None] + sizes[1][None, :] - count)


def least_labels(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least label that each on the left and on the right reaches over these links."""
    most = np.iinfo(np.int64).max
    while True:
        lower = np.minimum(right, np.where(link, left[:, None], most).min(0))
        other = np.minimum(left, np.where(link, lower[None, :], most).min(1))
        if (lower == right).all() and (other == left).all():
            return left, right
        left, right = other, lower


def joined(label: np.ndarray, own: np.ndarray, passes) -> None:
    """Puts together the groups (label) of the members (own, by size) of a list that pass(places, other
    places): each member in turn against those after it that are not in its group yet."""
    for x in range(len(own)):
        group = label[own]
        y = np.flatnonzero(group[x + 1 :] != group[x]) + x + 1
        if not len(y):
            if x == 0 or (group == group[0]).all():
                return
            continue
        y = y[passes(np.full(len(y), x), y)]
        if len(y):
            label[np.isin(label, group[y])] = group[x]


def ngram_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = 768) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable over links, where two
    documents link if den * |intersection| >= num * |union| of their sets of word n-grams."""
    spark = docs.sparkSession
    name = new_table(spark, "staged")
    staged, chunks, buckets = stage(docs, id_col, text_col, name)

    def need(size):  # n-grams that a partner must have
        return -(-num * size // den)

    def extra(size):  # n-grams that the extended prefixes must share; no more than a partner must have
        return np.minimum(1 + size * (den - num) // num, need(size))

    def facts(chunk, table):
        ids, sizes, one, two, tokens = [], [], [], [], []
        for s in sets_of(table, n):
            ids.append(s.ids)
            sizes.append(s.size)
            one.append(s.total(g.mix(s.token)))
            two.append(s.total(g.mix(s.token ^ U(0xA0761D6478BD642F))))
            tokens.append(s.token)
        ids, sizes, one, two, tokens = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, sizes, one, two, tokens))
        token, count = np.unique(tokens, return_counts=True)
        top = np.flatnonzero(count > 2)
        top = top[np.argsort(-count[top], kind="stable")[:NAMED]]
        none = [None] * len(top)
        return pa.table({
            "doc_id": pa.array([*ids.tolist(), *none], pa.int64()), "size": pa.array([*sizes.tolist(), *none], pa.int64()),
            "one": pa.array([*one.view(np.int64).tolist(), *none], pa.int64()), "two": pa.array([*two.view(np.int64).tolist(), *none], pa.int64()),
            "token": pa.array([*[None] * len(ids), *token[top].view(np.int64).tolist()], pa.int64()), "count": pa.array([*[None] * len(ids), *count[top].tolist()], pa.int64()),
        })

    known = saved(on_chunks(staged, facts, "doc_id long, size long, one long, two long, token long, count long"), "facts")
    rows = known.where("token IS NULL").select(chunk_of("doc_id", chunks).alias("chunk"), "doc_id", "size", "one", "two")
    often = known.where("token IS NOT NULL").groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT).toPandas()
    often = often.assign(token=often["token"].to_numpy(np.int64).view(U)).sort_values("token")
    frequent, counts = often["token"].to_numpy(U), often["count"].to_numpy(np.int64)

    # copies meet per chunk first: a set that a third of all documents share is a row per chunk
    own = rows.where("size > 0").groupBy("chunk", "one", "two", "size").agg(F.min("doc_id").alias("least"))
    first = own.groupBy("one", "two", "size").agg(F.min("least").alias("rep"))
    first = own.drop("least").join(first, ["one", "two", "size"])
    base = rows.join(first, ["chunk", "one", "two", "size"], "left").select("doc_id", "size", F.coalesce("rep", "doc_id").alias("rep"))
    base = saved(base, "sets")
    active = base.where("size > 0 AND doc_id = rep").select(chunk_of("doc_id", chunks).alias("chunk"), "doc_id", F.lit(None).cast("binary").alias("body"))

    def ordered(s: Sets):
        """Tokens of each document, rare first, and their places."""
        rank = np.zeros(len(s.token), np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, s.token), len(frequent) - 1)
            rank = np.where(frequent[at] == s.token, counts[at], 0)
        order = np.lexsort((s.token, rank, s.doc))
        return s.token[order], np.arange(len(order)) - s.start[s.doc]

    def wanted(answers):
        ids = answers["doc_id"].drop_null().to_numpy()
        return ids, answers.filter(answers["body"].is_valid())

    def prefixes(sets):
        """The distinct n-grams of the extended prefixes, ascending, and how many documents have each."""
        sent = [token[place < (s.size - need(s.size) + extra(s.size))[s.doc]] for s, token, place in sets]
        return np.unique(np.concatenate(sent), return_counts=True) if sent else (np.zeros(0, U), np.zeros(0, np.int64))

    def extended(chunk, table, answers):
        ids, _ = wanted(answers)
        token, count = prefixes((s, *ordered(s)) for s in sets_of(table, n, ids))
        # 32 bits of an n-gram: two that share them are taken to be sent twice, which only keeps a document more
        short, count = token.astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        return messages([message(chunk, b, (short[x], count[x])) for b, x in by_bucket(token, buckets)])

    def shared(bucket, table):
        """A bit for each n-gram of a chunk, in the order it sent them, and how many postings the set ones are."""
        got = bodies(table)
        token, count = np.concatenate([t for _, (t, _) in got]), np.concatenate([m for _, (_, m) in got])
        order = np.argsort(token, kind="stable")
        same = np.r_[token[order][1:] == token[order][:-1], False]
        yes = np.empty(len(token), bool)
        yes[order] = same | np.r_[False, same[:-1]] | (count[order] > 1)
        out, at = [], 0
        for chunk, (t, c) in got:
            if (own := yes[at : at + len(t)]).any():
                out.append((*message(chunk, bucket, (bucket, np.packbits(own))), int(c[own].sum(dtype=np.int64))))
            at += len(t)
        return messages([m[:3] for m in out]).append_column("postings", pa.array([m[3] for m in out], pa.int64()))

    def entries(chunk, table, answers, turn, turns):
        ids, told = wanted(answers)
        sets = [(s, *ordered(s)) for s in sets_of(table, n, ids)]
        token, _ = prefixes(sets)
        bits = dict(b for _, b in bodies(told))
        got = [x[np.unpackbits(bits[b], count=len(x)).astype(bool)] for b, x in by_bucket(token, buckets) if b in bits]
        both = np.sort(token[np.concatenate(got)]) if got else np.zeros(0, U)
        out = []
        for s, token, place in sets:
            hit = g.member(token, both)
            least = extra(need(s.size))  # a partner has need(size) n-grams at least
            tested = place < (s.size - need(s.size) + least)[s.doc]
            stays = np.bincount(s.doc[hit & tested], minlength=len(s.ids)) >= least
            use = hit & stays[s.doc] & (place < (s.size - need(s.size) + 1)[s.doc])
            if use.any():
                parts = histograms(s.token, s.doc, len(s.ids))
                out.append((token[use], s.ids[s.doc[use]], s.size[s.doc[use]], place[use], parts[s.doc[use]]))
        if not out:
            return messages([])
        token, doc, size, place, parts = (np.concatenate(x) for x in zip(*out))
        small = lambda p: p.astype(np.uint8) if p.max() < 256 else p
        return messages([message(chunk, b, (token[x], doc[x], size[x].astype(np.int32), place[x].astype(np.int32), small(parts[x]))) for b, x in by_bucket(token, buckets) if b % turns == turn])

    def candidates(bucket, table):
        token, doc, size, place, parts = (np.concatenate(x) for x in zip(*(b for _, b in bodies(table))))
        parts = parts.astype(np.uint16)
        order = np.lexsort((doc, size, token))
        token, doc, size, place, parts = token[order], doc[order], size[order].astype(np.int64), place[order].astype(np.int64), parts[order]
        edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
        length = np.diff(edge)
        start, of = np.repeat(edge[:-1], length), np.repeat(length, length)

        def passes(x, y):
            x, y = np.maximum(x, y), np.minimum(x, y)  # x is the larger set
            least = -(-num * (size[x] + size[y]) // (num + den))
            ok = need(size[x]) <= size[y]
            ok &= np.minimum(place[x], place[y]) + 1 + np.minimum(size[x] - place[x], size[y] - place[y]) - 1 >= least
            ok[ok] = may_share(parts[x[ok]], parts[y[ok]], least[ok])
            return ok

        rank = np.where(of <= SHORT, np.arange(len(token)) - start, 0)
        a, b = [], []
        for x, y in pairs_below(rank, start, 0, 1 << 18):
            ok = passes(x, y)
            a.append(doc[x[ok]])
            b.append(doc[y[ok]])
        ids, own = np.unique(doc, return_inverse=True)
        v, root = (np.array(x, np.int64) for x in forest(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))))
        label = np.arange(len(ids))
        label[np.searchsorted(ids, v)] = np.searchsorted(ids, root)
        for at, members in zip(edge[:-1][length > SHORT].tolist(), length[length > SHORT].tolist()):
            joined(label, own[at : at + members], lambda x, y, at=at: passes(x + at, y + at))
        apart = ids != ids[label]
        return pa.table({"a": pa.array(ids[apart], pa.int64()), "b": pa.array(ids[label][apart], pa.int64())})

    def in_turns(asked, send, decide, size):
        """The edges of all buckets, taken in as many turns as keep what is sent in one below what the texts take:
        where most documents have near copies, all of it at once would be several times that."""
        turns = min(buckets, max(1, -(-size // max(1, room))))
        edges = []
        for turn in range(turns):
            sent = on_chunks_with(staged, asked, lambda chunk, table, answers, turn=turn: send(chunk, table, answers, turn, turns), MESSAGE)
            edges.append(saved(on_buckets(sent, decide, "a long, b long"), "met"))
        return reduce(DataFrame.unionByName, edges)

    room = ROOM * (base.agg(F.sum("size")).first()[0] or 0)
    asked = saved(on_buckets(on_chunks_with(staged, active, extended, MESSAGE), shared, f"{MESSAGE}, postings long"), "shared")
    postings = asked.agg(F.sum("postings")).first()[0] or 0
    asked = asked.select("chunk", F.lit(None).cast("long").alias("doc_id"), "body")
    groups = components(in_turns(active.unionByName(asked), entries, candidates, postings * ENTRY // 2))

    sizes = groups.groupBy("label").agg(F.count("*").alias("members"))
    placed = groups.join(sizes, "label").select(chunk_of("v", chunks).alias("chunk"), F.col("v").alias("doc_id"), "label", F.ceil(F.col("members") / block).cast("int").alias("blocks"))

    def whole(chunk, table, answers, turn, turns):
        where = {d: (group, k) for d, group, k in zip(*(answers[c].to_pylist() for c in ("doc_id", "label", "blocks")))}
        sent: dict[tuple[int, int, int], list] = {}
        if where:
            for s in sets_of(table, n, np.array(list(where), np.int64)):
                for i, d in enumerate(s.ids.tolist()):
                    group, k = where[d]
                    own = int(g.mix(np.array([d], np.int64).view(U))[0] % U(k))
                    for other in range(k):
                        sent.setdefault((group, min(own, other), max(own, other)), []).append((own, d, s.token[s.start[i] : s.start[i] + s.size[i]]))
        if not sent:
            return messages([])
        keys = list(sent)
        mixed = g.mix(np.array([hash(k) & (1 << 63) - 1 for k in keys], np.int64).view(U))
        return messages([message(chunk, b, [(keys[i], sent[keys[i]]) for i in x]) for b, x in by_bucket(mixed, buckets) if b % turns == turn])

    def verified(bucket, table):
        groups: dict[tuple[int, int, int], dict[int, dict]] = {}
        for _, body in bodies(table):
            for key, members in body:
                for own, d, tokens in members:
                    groups.setdefault(key, {}).setdefault(own, {})[d] = tokens
        out = []
        for (_, i, j), blocks in sorted(groups.items()):
            left, right = (sorted(blocks.get(x, {})) for x in (i, j))
            if len(left) and len(right) and (i != j or len(left) > 1):
                link = linked([blocks[i][d] for d in left], [blocks[j][d] for d in right], num, den)
                labels = least_labels(link, np.array(left, np.int64), np.array(right, np.int64))
                out += [(a, b) for a, b in zip(left + right, np.concatenate(labels).tolist()) if a != b]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    placed = saved(placed, "placed")
    size = placed.join(base, "doc_id").agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    classes = components(in_turns(placed, whole, verified, size * WHOLE))
    spark.sql(f"DROP TABLE {name}")  # all that is left to do reads saved rows
    return base.join(classes, base.rep == classes.v, "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("label", "rep").alias("component_id"))
