"""Centroid clustering of integer vectors by partial-distance search.

Each round sends the centroids, a bounded table, to all tasks. A task compares its vectors with one
centroid after another over a few dimensions at a time, those of high variance first, and gives a
centroid up once its part of the distance is strictly above the best so far. What meets in the driver
is counts and sums by cluster and dimension.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import stored

DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 16, 3, 1, 64
#: Dimensions compared before the next look at what is still alive.
STEP = 8
#: Components end here, so that squared distances fit in a long.
BOUND = 1 << 26


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows with exactly 64 components, none of them null or not finite."""
    some = (F.size("embedding") == DIMS) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(some).select("vec_id", "embedding")


def integers(column: pa.Array) -> np.ndarray:
    """Vectors as rows of integers."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIMS)
    return np.clip(np.floor(SCALE * x), -BOUND, BOUND).astype(np.int64)


def nearest(V: np.ndarray, C: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row (ties: the smaller number) and the squared distance to it."""
    cluster, best = np.zeros(len(V), np.int32), np.full(len(V), np.iinfo(np.int64).max)
    blocks = [order[k : k + step] for k in range(0, len(order), step)]
    columns = [np.ascontiguousarray(V[:, b]) for b in blocks]
    for c in range(len(C)):
        alive, part = np.arange(len(V)), np.zeros(len(V), np.int64)
        for b, x in zip(blocks, columns):
            gap = (x if len(alive) == len(V) else x[alive]) - C[c, b]
            part = part + np.einsum("ij,ij->i", gap, gap)
            on = part <= best[alive]
            alive, part = alive[on], part[on]
        nearer = part < best[alive]
        best[alive[nearer]], cluster[alive[nearer]] = part[nearer], c
    return cluster, best


def start(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id, in that order; equal ids go by their vectors, a null id counts as an empty one."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("h"), "embedding").orderBy("h", "embedding").limit(clusters).collect()
    return integers(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))) if rows else np.zeros((0, DIMS), np.int64)


def by_variance(vectors: DataFrame) -> np.ndarray:
    """Dimensions by falling variance over all vectors; the order changes what is compared first, never a result."""

    def run(batches):
        n, one, two = 0, np.zeros(DIMS), np.zeros(DIMS)
        for b in batches:
            V = integers(b.column("embedding")).astype(np.float64)
            n, one, two = n + len(V), one + V.sum(0), two + (V * V).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMS), pa.int32()), pa.array([float(n)] * DIMS), pa.array(one), pa.array(two)], ["dim", "n", "one", "two"])

    rows = vectors.select("embedding").mapInArrow(run, "dim int, n double, one double, two double").groupBy("dim").agg(F.sum("n"), F.sum("one"), F.sum("two")).collect()
    var = {r[0]: r[3] / r[1] - (r[2] / r[1]) ** 2 if r[1] else 0.0 for r in rows}
    return np.array(sorted(range(DIMS), key=lambda d: (-var.get(d, 0.0), d)))


def moved(vectors: DataFrame, C: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of their vectors' means; those without vectors stay."""

    def run(batches):
        n, total = np.zeros(len(C), np.int64), np.zeros((len(C), DIMS), np.int64)
        for b in batches:
            V = integers(b.column("embedding"))
            c, _ = nearest(V, C, order)
            n += np.bincount(c, minlength=len(C))
            by = np.argsort(c, kind="stable")
            some, head = np.unique(c[by], return_index=True)
            if len(some):
                total[some] += np.add.reduceat(V[by], head)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    sums = vectors.select("embedding").mapInArrow(run, "cluster int, n bigint, total array<bigint>").select("cluster", "n", F.posexplode("total").alias("dim", "x"))
    out = C.copy()
    for r in sums.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        out[r["cluster"], r["dim"]] = r["x"] // r["n"]
    return out


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after ``rounds`` rounds over all of ``kept`` vectors, and the order of dimensions."""
    C, order = start(vectors, clusters, seed), np.arange(DIMS)
    if len(C):
        order = by_variance(vectors)
        for _ in range(rounds):
            C = moved(vectors, C, order)
    return C, order


def assign(vectors: DataFrame, C: np.ndarray, order: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every one of ``kept`` vectors."""
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            c, d = nearest(integers(b.column("embedding")), C, order)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(c), pa.array(d)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of 64 finite components.

    Rows with a null or shorter or longer vector, or with a null, NaN or infinite component, are left out.
    Fewer vectors than ``clusters`` start as many clusters as there are; an empty table gives no rows. Equal
    vectors share a cluster, of equally near centroids the smaller number's. Repeated and null ids keep a
    row each. Components beyond 2 ** 26 after scaling count as that. Other columns are not read.
    """
    some = kept(vectors)
    C, order = fit(some, clusters, rounds, seed)
    found = stored(assign(some, C, order))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [(c, s, hashlib.sha256(",".join(map(str, C[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    info = found.sparkSession.createDataFrame(about, "cluster int, cluster_inertia bigint, centroid_sha256 string")
    # One row for each cluster, so it may be broadcast.
    return found.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("long").alias("inertia"), "centroid_sha256")
