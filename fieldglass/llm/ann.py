"""Operator 2: nearest neighbours by balanced posting lists.

Centroids come from balanced bisection of a bounded sample (SAMPLE_BYTES); every vector is indexed.
A vector goes to the lists of its nearest centroids, found by a beam search of a graph over the
centroids in memory: to the nearest, and as a boundary vector to further ones within REPLICATE of
its distance, unless a chosen centroid lies nearer to them than the vector does.  A query asks the
lists whose centroids lie within PRUNE of its nearest centroid's distance, however many that are (where
that are more than the beam, all centroids are compared instead).  Lists lie in blocks of BLOCK_BYTES, a
larger one in several, and the queries of a block in shares, so a task compares a bounded number of both
and gives k + 1 rows a query, however many lists it has.

What the lists do not hold is not found.  Recall of the 5 nearest, every fiftieth vector asked, is in
the README; on vectors without clusters a large part of the lists lies within the ratio, on clustered
ones a few hundredths.  A query that finds fewer than k others there, and with ``exact`` every query,
goes on to the lists that the bound found so far does not rule out: if by the triangle inequality of
angles, with the list's widest angle, nothing in it can be as near as the (k + 1)-th found.

Equal vectors are one vector with its k + 1 smallest ids: no other of them can be among the k
nearest of any query.  Ties go to the smaller id.  Vectors that are null, empty, zero, of another
length than most, or hold null or non-finite components take no part; rows without an id are left
out; repeated rows count once; other columns are ignored.  Without vectors the result is empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import saved

SAMPLE_BYTES, CENTROIDS, LIST = 16 << 20, 4096, 512
REPLICATE, COPIES, PRUNE, BEAM, DEGREE = 1.15, 4, 1.4, 128, 16
#: Queries that meet a block in one task.
QUERIES = 8192
#: Bytes of vectors that meet queries in one task; what angles and scores may be off by rounding.
BLOCK_BYTES, ROUNDING = 8 << 20, 1e-6


def matrix(blobs) -> np.ndarray:
    blobs = [b if isinstance(b, bytes) else bytes(b) for b in blobs]
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 0))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, the largest component between a half and one: no square overflows or
    vanishes, and as such a factor is exact, cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def bisected(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of lists equal parts: each cut is at the median along the line of two means."""
    if lists <= 1 or len(x) < 2:
        return x.mean(0, keepdims=True)
    a, b = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        side = x @ (a - b) > np.median(x @ (a - b))
        if side.all() or not side.any():
            break
        a, b = x[side].mean(0), x[~side].mean(0)
    order = np.argsort(x @ (a - b), kind="stable")
    left = lists // 2
    cut = len(x) * left // lists
    return np.vstack([bisected(x[order[:cut]], left, rng), bisected(x[order[cut:]], lists - left, rng)])


class Centroids:
    """Unit centroids and a graph of each one's nearest."""

    def __init__(self, points: np.ndarray):
        self.points = (points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        n = len(self.points)
        degree = min(DEGREE, max(1, n - 1))
        near = np.zeros((n, degree), np.int64)
        for a in range(0, n, 512):
            s = self.points[a : a + 512] @ self.points.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            near[a : a + 512] = np.argsort(-s, axis=1, kind="stable")[:, :degree] if n > 1 else 0
        # long links, so that the graph hangs together
        far = (np.arange(n)[:, None] + np.array([1, n // 7 + 1, n // 3 + 1])) % n
        self.graph = np.hstack([near, far])
        self.entries = np.arange(0, n, max(1, n // max(16, int(n**0.5))))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, similarities) of each row's nearest, best first, by beam search from the entries."""
        beam = min(beam, len(self.points))
        ids = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        sims = x @ self.points[self.entries].T
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(ids * 2 + ~done, axis=1, kind="stable")
            ids, sims, done = (np.take_along_axis(v, order, 1) for v in (ids, sims, done))
            sims = np.where(np.c_[np.zeros(len(x), bool), ids[:, 1:] == ids[:, :-1]], -np.inf, sims)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(v, order, 1) for v in (ids, sims, done))
            done = done | np.isinf(sims)
            if done.all():
                return ids, sims
            pick = np.argsort(done, axis=1, kind="stable")[:, :4]
            fresh = ~np.take_along_axis(done, pick, 1)
            np.put_along_axis(done, pick, True, 1)
            more = self.graph[np.take_along_axis(ids, pick, 1)].reshape(len(x), -1)
            found = np.einsum("nkd,nd->nk", self.points[more], x)
            found = np.where(np.repeat(fresh, self.graph.shape[1], axis=1), found, -np.inf)
            ids, sims, done = np.hstack([ids, more]), np.hstack([sims, found]), np.hstack([done, np.zeros(more.shape, bool)])


def distance(sims: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * sims))


def direction(x: np.ndarray) -> np.ndarray:
    """Unit rows in double precision."""
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def blocks_of(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of each list, and how many it takes: lists in a row share a block, one of over most vectors has several."""
    parts = np.maximum(-(-counts // most), 1)
    first, block, held = np.zeros(len(counts), np.int64), 0, 0
    for i, (c, p) in enumerate(zip(counts.tolist(), parts.tolist())):
        if held and held + c > most:
            block, held = block + 1, 0
        first[i] = block
        block, held = (block + p, 0) if p > 1 else (block, held + c)
    return first, parts


def within(centroids: Centroids, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, centroid) of the centroids within ratio of the distance of each row's nearest.  Rows for which
    the whole beam is as near are compared with all centroids."""
    ids, sims = centroids.search(x)
    d = distance(sims)
    hit = d <= ratio * d[:, :1] + 1e-6
    row, col = np.nonzero(hit)
    full = np.flatnonzero(hit.all(1)) if ids.shape[1] < len(centroids.points) else np.zeros(0, np.int64)
    some = ~np.isin(row, full)
    row, near = row[some], ids[row[some], col[some]]
    if len(full):
        d = distance(x[full] @ centroids.points.T)
        more, other = np.nonzero(d <= ratio * d.min(1, keepdims=True) + 1e-6)
        row, near = np.r_[row, full[more]], np.r_[near, other]
    return row, near


def lists_of(centroids: Centroids, x: np.ndarray) -> list[list[int]]:
    """The lists that each vector is put in."""
    ids, sims = centroids.search(x, 4 * COPIES)
    d, out = distance(sims), []
    for own, far in zip(ids, d):
        chosen = [int(own[0])]
        for c, r in zip(own[1:].tolist(), far[1:].tolist()):
            if len(chosen) == COPIES or r > REPLICATE * far[0]:
                break
            if (distance(centroids.points[chosen] @ centroids.points[c]) >= r).all():
                chosen.append(c)
        out.append(chosen)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", list_size: int = 128, prune: float = PRUNE, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id and score (cosine in double precision) of the k nearest vectors found for
    each query, itself not counted.  queries: rows of vectors, by id."""
    spark = vectors.sparkSession

    def valid(batches):
        """id and components as bytes."""
        for batch in batches:
            has = pc.greater(pc.list_value_length(batch["v"]), 0)
            ids, lists = batch["vec_id"].filter(has), batch["v"].filter(has)
            x = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
            end = np.cumsum(pc.list_value_length(lists).to_numpy())
            start = np.r_[0, end[:-1]].astype(np.int64)
            fine = np.zeros(len(end), bool)
            if len(end):
                fine = np.logical_and.reduceat(np.isfinite(x), start) & np.logical_or.reduceat(x != 0, start)
            data = x.tobytes()
            blobs = [data[8 * a : 8 * b] for a, b in zip(start[fine].tolist(), end[fine].tolist())]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fine)), pa.array(blobs, pa.binary())], ["vec_id", "v"])

    def combine(batches):
        """Within a task, the k + 1 smallest ids of each vector."""
        kept: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, v in zip(batch["vec_id"].to_pylist(), batch["v"].to_pylist()):
                own = kept.setdefault(v, [])
                if i not in own:
                    own.append(i)
                    if len(own) > 4 * k + 4:
                        own[:] = sorted(own)[: k + 1]
            if len(kept) > 20_000:
                yield told(kept)
                kept = {}
        yield told(kept)

    def told(kept):
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array([sorted(x)[: k + 1] for x in kept.values()], pa.list_(pa.int64()))], ["v", "ids"])

    def pick(df):
        return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where("vec_id IS NOT NULL")

    clean = pick(vectors).mapInArrow(valid, "vec_id long, v binary")
    width = clean.groupBy(F.length("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.length("v") == width.w)
    distinct = clean.mapInArrow(combine, "v binary, ids array<long>").groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    distinct = saved(distinct.withColumn("rep", F.col("ids")[0]), "vectors")
    n = distinct.count()
    most = max(256, SAMPLE_BYTES // width.w)
    sample = matrix([r.v for r in distinct.select("v").orderBy(F.xxhash64("v"), "rep").limit(most).collect()])
    lists = int(max(1, min(CENTROIDS, n // list_size, len(sample) // 4)))
    centroids = Centroids(bisected(unit(sample), lists, np.random.default_rng(7)))
    shared = spark.sparkContext.broadcast(centroids)  # CENTROIDS * (width + degree) at most

    def post(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.slice(a, 1024)
                x = matrix(own["v"].to_pylist())
                got = lists_of(shared.value, unit(x))
                row = np.repeat(np.arange(len(got)), [len(c) for c in got])
                home = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
                off = np.full(len(row), np.nan)
                off[home] = np.arccos(np.clip((direction(shared.value.points[[c[0] for c in got]]) * direction(x)).sum(1), -1, 1))
                out = own.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array([c for x in got for c in x], pa.int32()), out["rep"], out["v"], pa.array(off, mask=~home)], ["list", "rep", "v", "off"])

    posted = saved(distinct.mapInArrow(post, "list int, rep long, v binary, off double"), "postings")
    homes = posted.where("off IS NOT NULL")  # every vector once, with its angle to the list's centroid
    sizes = {r.list: r["count"] for r in posted.groupBy("list").count().collect()}  # CENTROIDS rows at most
    most_rows = max(LIST, BLOCK_BYTES // width.w)
    at_block, in_blocks = blocks_of(np.array([sizes.get(i, 0) for i in range(lists)], np.int64), most_rows)

    def ask(batches):
        """A row for each block that holds lists which the query asks, with those lists."""
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                own = batch.slice(a, 1024)
                row, near = within(shared.value, unit(matrix(own["v"].to_pylist())), prune)
                run, place = np.repeat(np.arange(len(near)), in_blocks[near]), np.concatenate([np.arange(c) for c in in_blocks[near]]) if len(near) else near
                row, near, block = row[run], near[run], at_block[near][run] + place
                order = np.lexsort((near, block, row))
                row, near, block = row[order], near[order], block[order]
                edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else np.zeros(0, np.int64)
                held = pa.ListArray.from_arrays(pa.array(np.r_[edge, len(row)], pa.int32()), pa.array(near, pa.int32()))
                out = own.take(pa.array(row[edge]))
                yield pa.RecordBatch.from_arrays([pa.array(block[edge], pa.int32()), out["rep"], out["v"], held], ["block", "rep", "v", "lists"])

    asked = pick(queries).mapInArrow(valid, "vec_id long, v binary").where(F.length("v") == width.w).select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = saved(asked.join(distinct.select("v", "rep"), "v"), "queries")
    wanted = saved(asked.groupBy("rep").agg(F.first("v").alias("v")).mapInArrow(ask, "block int, rep long, v binary, lists array<int>"), "wanted")
    shares = saved(wanted.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares")), "shares")
    to_ask = wanted.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int")).select("block", "share", "rep", "v", "lists")

    def place(batches):
        for batch in batches:
            at = batch["list"].to_numpy()
            mixed = (batch["rep"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = at_block[at] + (mixed % in_blocks[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch["list"], batch["rep"], batch["v"]], ["block", "list", "rep", "v"])

    listed = posted.drop("off").mapInArrow(place, "block int, list int, rep long, v binary").join(shares, "block")
    listed = listed.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select("block", "share", "list", "rep", "v")

    def firsts(query, rep, exact):
        """Of each query the k + 1 best, each rep once."""
        order = np.lexsort((rep, -exact, query))
        query, rep, exact = query[order], rep[order], exact[order]
        new = np.r_[True, (query[1:] != query[:-1]) | (rep[1:] != rep[:-1])] if len(query) else np.zeros(0, bool)
        query, rep, exact = query[new], rep[new], exact[new]
        begin = np.searchsorted(query, query, "left")
        keep = np.arange(len(query)) - begin <= k
        return query[keep], rep[keep], exact[keep]

    def score(key, q, v):
        """Queries of a share against the lists of a block that they ask."""
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(q) and len(v):
            reps, at, x = v["rep"].to_numpy(), v["list"].to_numpy(), scaled(matrix(v["v"].to_pylist()))
            length = np.sqrt((x * x).sum(1))
            y = scaled(matrix(q["v"].to_pylist()))
            size = np.sqrt((y * y).sum(1))
            lists = q["lists"].combine_chunks()
            asking = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            lists = lists.flatten().to_numpy()
            order, by = np.argsort(at, kind="stable"), np.argsort(lists, kind="stable")
            held, waiting = [best], 0
            for i in np.intersect1d(at, lists).tolist():
                cols = order[slice(*np.searchsorted(at[order], (i, i + 1)))]
                rows = asking[by[slice(*np.searchsorted(lists[by], (i, i + 1)))]]
                take = min(len(cols), k + 9)
                for a in range(0, len(rows), 1024):
                    some = rows[a : a + 1024]
                    near = (y[some] @ x[cols].T) / length[cols]
                    c = cols[np.argpartition(-near, take - 1, axis=1)[:, :take]]
                    exact = (x[c] * y[some][:, None, :]).sum(2) / (length[c] * size[some][:, None])
                    held.append((np.repeat(some, take), reps[c].ravel(), exact.ravel()))
                    waiting += c.size
                if waiting > 1 << 20:
                    held, waiting = [firsts(*(np.concatenate(z) for z in zip(*held)))], 0
            best = firsts(*(np.concatenate(z) for z in zip(*held)))
        query = q["rep"].to_numpy()[best[0]] if len(q) else best[0]
        return pa.table({"query": pa.array(query, pa.int64()), "rep": pa.array(best[1], pa.int64()), "score": pa.array(best[2], pa.float64())})

    scored = to_ask.groupBy("block", "share").cogroup(listed.groupBy("block", "share")).applyInArrow(score, "query long, rep long, score double")

    def top(found):
        found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
        return found.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1).drop("r")

    def ranked(best):
        found = best.join(distinct.select("rep", "ids"), "rep").groupBy("query").agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("i")))))).alias("near"))
        other = F.slice(F.filter("near", lambda c: c["i"] != F.col("query_id")), 1, k)
        rows = asked.join(found, asked.rep == found["query"]).select("query_id", F.posexplode(other).alias("p", "c"))
        return rows.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("c.i").alias("vec_id"), (-F.col("c.s")).alias("score"))

    seen = saved(top(scored), "seen")
    bound = seen.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).select("query", F.when(F.col("n") > k, F.col("least")).alias("least"))
    asking = asked.groupBy("rep").agg(F.first("v").alias("v"))
    asking = asking.join(bound, asking.rep == bound["query"], "left").select("rep", "v", "least")
    if not exact:
        asking = saved(asking.where("least IS NULL"), "unsettled")
        if asking.isEmpty():
            return ranked(seen)
    held = {r.list: (r.n, r.off) for r in homes.groupBy("list").agg(F.count("*").alias("n"), F.max("off").alias("off")).collect()}  # CENTROIDS rows at most
    widest = np.array([held[i][1] if i in held else -np.inf for i in range(lists)])
    first, parts = blocks_of(np.array([held[i][0] if i in held else 0 for i in range(lists)], np.int64), most_rows)
    shares = max(1, -(-asking.count() // most_rows))

    def rest(batches):
        """The blocks of the lists that may hold a vector as near as the bound."""
        points = direction(shared.value.points)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                own = batch.slice(a, 256)
                off = np.arccos(np.clip(direction(matrix(own["v"].to_pylist())) @ points.T, -1, 1))
                least = np.array([-1.0 if x is None else x for x in own["least"].to_pylist()])
                row, near = np.nonzero((off - widest <= np.arccos(np.clip(least, -1, 1))[:, None] + ROUNDING) & np.isfinite(widest))
                run, place = np.repeat(np.arange(len(near)), parts[near]), np.concatenate([np.arange(c) for c in parts[near]]) if len(near) else near
                hit = np.zeros((own.num_rows, int((first + parts).max())), bool)
                hit[row[run], first[near][run] + place] = True
                row, block = np.nonzero(hit)
                bounds = np.searchsorted(row, np.arange(own.num_rows + 1))
                blocks = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(block, pa.int32()))
                yield pa.RecordBatch.from_arrays([own["rep"], own["v"], pa.array(least), blocks], ["rep", "v", "least", "blocks"])

    open_ = saved(asking.mapInArrow(rest, "rep long, v binary, least double, blocks array<int>"), "open")
    share = F.pmod(F.xxhash64("rep"), F.lit(shares)).cast("int").alias("share")
    sent = open_.select(F.explode("blocks").alias("block"), share, "rep", "v", "least")

    def blocked(batches):
        for batch in batches:
            at = batch["list"].to_numpy()
            mixed = (batch["rep"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            block = first[at] + (mixed % parts[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), batch["rep"], batch["v"]], ["block", "rep", "v"])

    wide = homes.drop("off").mapInArrow(blocked, "block int, rep long, v binary")
    wide = wide.join(open_.select(F.explode("blocks").alias("block"), share).distinct(), "block").select("block", "share", "rep", "v")

    def nearer(key, q, v):
        """The vectors at the bound or above, k + 1 at most a query; ties by the exact score and the id."""
        query, rep, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q) and len(v):
            reps, x = v["rep"].to_numpy(), scaled(matrix(v["v"].to_pylist()))
            length = np.sqrt((x * x).sum(1))
            for a in range(0, len(q), 256):
                part = q.slice(a, 256)
                y = scaled(matrix(part["v"].to_pylist()))
                size = np.sqrt((y * y).sum(1))
                near = (y @ x.T) / length / size[:, None]
                least = part["least"].to_numpy() - ROUNDING
                for i in np.flatnonzero(near.max(1) >= least).tolist():
                    c = np.flatnonzero(near[i] >= least[i])
                    if len(c) > k + 1:
                        c = c[near[i, c] >= np.partition(near[i, c], len(c) - k - 1)[len(c) - k - 1] - ROUNDING]
                    exact = (x[c] * y[i]).sum(1) / (length[c] * size[i])
                    order = np.lexsort((reps[c], -exact))[: k + 1]
                    query.append(np.full(len(order), part["rep"][i].as_py()))
                    rep.append(reps[c[order]])
                    score.append(exact[order])
        return pa.table({"query": pa.array(np.concatenate(query), pa.int64()), "rep": pa.array(np.concatenate(rep), pa.int64()), "score": pa.array(np.concatenate(score))})

    more = sent.groupBy("block", "share").cogroup(wide.groupBy("block", "share")).applyInArrow(nearer, "query long, rep long, score double")
    return ranked(top(seen.unionByName(more)))
