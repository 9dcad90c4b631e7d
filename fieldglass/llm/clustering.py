"""Operator 13: centroid clustering of distinct quantised vectors with multiplicities.

Vectors are quantised to integers, so equal ones can be told exactly: they are grouped into one row
with its multiplicity, and Lloyd's rounds run over the distinct rows alone.  A round is one pass in
which every task adds up its rows, each times its multiplicity, in integers; only these sums, one
row a centroid and part, come to the driver (at most k * PARTS rows, whatever the input).  After the
last assignment the rows join back to every vec_id.

Vectors that are null, of another length, or hold null or non-finite components (or components that
are not finite times ``scale``) take no part; rows without an id are left out; every other row is a
vector, repeated rows as often as they come; other columns are ignored.  The first centroids are the
k with the smallest hash of their id (equal ids: by components); with fewer vectors there are fewer
centroids, equal ones among them stay as they are, and the smaller number takes the vectors.  Sums
and floors are exact at any size; distances beyond 2**63 - 1 are given as that.  An empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import saved

#: Parts in which the sums of a round meet, and the largest component for which doubles hold every step exactly.
PARTS, EXACT = 64, 1 << 22
MOST = (1 << 63) - 1
ROWS = 2048


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in doubles as bytes, the same for equal vectors: 32-bit where they fit."""
    return x.astype("<i4").tobytes() if np.abs(x).max(initial=0) < 2**31 else (x + 0.0).astype("<f8").tobytes()


def unpacked(blobs: list[bytes], dims: int) -> np.ndarray:
    """The vectors of these blobs: int64, or Python's integers where one needs them."""
    if all(len(b) == 4 * dims for b in blobs):
        return np.frombuffer(b"".join(blobs), "<i4").reshape(-1, dims).astype(np.int64)
    rows = [np.frombuffer(b, "<i4" if len(b) == 4 * dims else "<f8").tolist() for b in blobs]
    return np.array([[int(v) for v in r] for r in rows], object).reshape(-1, dims)


def quantised(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, q) of the vectors that take part."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            right = pc.and_(pc.is_valid(ids), pc.equal(pc.list_value_length(lists), dims))
            ids, lists = ids.filter(right), lists.filter(right)
            flat = lists.flatten()
            x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale)
            fine = np.isfinite(x).all(1)
            q = [packed(r) for r in x[fine]]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fine)), pa.array(q, pa.binary())], names=["vec_id", "q"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, q binary")


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, the smaller number of equals."""
    if x.dtype != object and centroids.dtype != object and max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)  # all values stay below 2**53 for 64 components
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        near = d.argmin(1)
        return near, d[np.arange(len(x)), near].astype(np.int64)
    a, b = x.astype(object), centroids.astype(object)
    d = np.array([[int(((r - c) ** 2).sum()) for c in b] for r in a], object).reshape(len(a), len(b))
    near = np.array([min(range(len(b)), key=r.__getitem__) for r in d], np.int64)
    return near, np.array([r[i] for r, i in zip(d, near)], object)


def matrix(rows: list[list[int]], dims: int) -> np.ndarray:
    big = any(abs(v) >= 2**62 for r in rows for v in r)
    return np.array(rows, object if big else np.int64).reshape(-1, dims)


def one_round(distinct: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round."""

    def add(batches):
        from pyspark import TaskContext

        c = matrix(centroids, dims)
        count, total = [0] * len(c), np.zeros((len(c), dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, weight = unpacked(part.column(0).to_pylist(), dims), part.column(1).to_pylist()
                near, _ = nearest_centroids(x, c)
                x = x if x.dtype == object or max(weight) * ROWS < 2**31 else x.astype(object)
                w = np.array(weight, x.dtype)
                for k in np.unique(near).tolist():
                    own = near == k
                    count[k] += int(w[own].sum())
                    total[k] += (x[own] * w[own, None]).sum(0).astype(object)
        used = [k for k, n in enumerate(count) if n]
        part = TaskContext.get().partitionId() % PARTS
        body = [pickle.dumps((count[k], total[k].tolist())) for k in used]
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(body, pa.binary())], names=["part", "cluster", "body"])

    def merge(key, table):
        count, total = 0, [0] * dims
        for body in table["body"].to_pylist():
            n, s = pickle.loads(body)
            count, total = count + n, [a + b for a, b in zip(total, s)]
        return pa.table({"cluster": pa.array([key[1].as_py()], pa.int32()), "body": pa.array([pickle.dumps((count, total))], pa.binary())})

    summed: dict[int, tuple[int, list[int]]] = {}
    got = distinct.mapInArrow(add, "part int, cluster int, body binary").groupBy("part", "cluster").applyInArrow(merge, "cluster int, body binary")
    for k, body in got.collect():
        n, s = pickle.loads(bytes(body))
        m, t = summed.get(k, (0, [0] * dims))
        summed[k] = m + n, [a + b for a, b in zip(t, s)]
    return [[v // summed[k][0] for v in summed[k][1]] if k in summed else c for k, c in enumerate(centroids)]


def weighted_lloyd(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the final
    centroid's components in decimal, joined by commas) and copies, the multiplicity of the vector."""
    spark = vectors.sparkSession
    rows = quantised(vectors, dims, scale, id_col, vector_col)
    distinct = saved(rows.groupBy("q").agg(F.count("*").alias("weight")), "distinct")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(hashed.alias("h"), "q").orderBy("h", "q").limit(k).collect()
    centroids = [[int(v) for v in unpacked([bytes(r["q"])], dims)[0]] for r in first]
    for _ in range(rounds if centroids else 0):
        centroids = one_round(distinct, centroids, dims)

    def assign(batches):
        c = matrix(centroids, dims)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                near, d = nearest_centroids(unpacked(part.column(0).to_pylist(), dims), c)
                d = pa.array([min(v, MOST) for v in d.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near, pa.int32()), d], names=["q", "copies", "cluster", "distance"])

    given = saved(distinct.mapInArrow(assign, "q binary, copies long, cluster int, distance long"), "assigned")
    inertias = {r["cluster"]: int(r["s"]) for r in given.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("copies").cast("decimal(18,0)")).alias("s")).collect()}
    of = [(i, min(s, MOST), min(sum(inertias.values()), MOST), hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, s in inertias.items()]
    told = F.broadcast(spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return rows.join(given, "q").join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "copies")
