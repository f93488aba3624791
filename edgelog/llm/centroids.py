"""Centroid clustering (k-means on whole numbers) with Ptolemaic pivots.

Distances d of every vector to a few fixed pivots are computed once and stored with it.  For pivots p, q Ptolemy's
inequality gives  d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q),  so a round needs the pivots' distances of its
centroids only to bound a vector's distance to each.  The exact squared distance to the centroid of the least bound
excludes every centroid whose bound, rounded down, is above it; the survivors are computed exactly in whole numbers.

A round is one scan of the stored vectors that sends a count and sums per cluster and task; the driver holds the
centroids (``clusters`` times ``dims`` numbers), nothing else.

Defined cases: vectors that are null, of another length, or hold null or non-finite parts are left out; a null id is kept
but begins no cluster while others can; equal distances go to the smaller cluster number; repeated rows count each; fewer
vectors than clusters give fewer clusters; an empty table gives no rows; other columns are ignored.  Parts beyond
2**26 (|x| beyond 65,536 at scale 1,024) raise an error, since squared distances would leave a long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelog.llm.common import stored
from edgelog.llm.topk import _matrix

CLUSTERS, DIMS, ROUNDS, PIVOTS, SAMPLE = 8, 64, 10, 6, 1000
LARGEST = 1 << 26
DOWN, UP = 1 - 2.0 ** -48, 1 + 2.0 ** -48  # far wider than the few roundings (2**-53 each) behind a bound


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    return ((x - c) ** 2).sum(axis=-1)


def pivots_of(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first rows of the sample, all different."""
    picked, far = [0], squared(sample, sample[0])
    while len(picked) < count and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, squared(sample, sample[picked[-1]]))
    return sample[picked]


def lower_bounds(to_pivots: np.ndarray, centre_to_pivots: np.ndarray, between: np.ndarray) -> np.ndarray:
    """[vector, centroid] squared distances can't be below these: the best pivot pair, every rounding downwards."""
    out = np.zeros((len(to_pivots), len(centre_to_pivots)))
    for p in range(len(between)):
        for q in range(p + 1, len(between)):
            a = to_pivots[:, p, None] * centre_to_pivots[None, :, q]
            b = to_pivots[:, q, None] * centre_to_pivots[None, :, p]
            np.maximum(out, (np.abs(a - b) - (a + b) * (1 - DOWN)) / (between[p, q] * UP), out=out)
    return out * out * DOWN


def nearest(x: np.ndarray, to_pivots: np.ndarray, centres: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, exact distances computed) of every vector."""
    between = np.sqrt(squared(pivots[:, None], pivots[None]))
    low = lower_bounds(to_pivots, np.sqrt(squared(centres[:, None], pivots[None])), between)
    rows = np.arange(len(x))
    guess = low.argmin(axis=1)
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    exact[rows, guess] = squared(x, centres[guess])
    left = low <= (exact[rows, guess] * UP)[:, None]
    left[rows, guess] = False
    i, j = np.nonzero(left)
    exact[i, j] = squared(x[i], centres[j])
    cluster = exact.argmin(axis=1)  # the first of equal ones
    return cluster, exact[rows, cluster], len(x) + len(i)


def _cache(pivots: np.ndarray, dims: int):
    def run(batches):
        for b in batches:
            x = _matrix(b.column("v"), dims)
            if x.max(initial=0) > LARGEST or x.min(initial=0) < -LARGEST:
                raise ValueError(f"vector parts beyond {LARGEST} in absolute value")
            d = np.sqrt(squared(x[:, None], pivots[None]))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(list(x.astype(np.int32)), pa.list_(pa.int32())), pa.array(list(d))],
                                             ["vec_id", "v", "to_pivots"])

    return run


def _read(batch: pa.RecordBatch, dims: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column("to_pivots").flatten().to_numpy(zero_copy_only=False)
    return _matrix(batch.column("v"), dims), flat.reshape(batch.num_rows, pivots)


def _sums(centres: np.ndarray, pivots: np.ndarray):
    """One row per cluster and task: how many vectors, their sums, and how many exact distances were computed."""

    def run(batches):
        count, total, looked = np.zeros(len(centres), np.int64), np.zeros(centres.shape, np.int64), 0
        for b in batches:
            if b.num_rows:
                x, near = _read(b, centres.shape[1], len(pivots))
                cluster, _, checked = nearest(x, near, centres, pivots)
                np.add.at(total, cluster, x)
                count += np.bincount(cluster, minlength=len(centres))
                looked += checked
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[own]), pa.array(list(total[own]), pa.list_(pa.int64()))],
                                         ["cluster", "n", "sums"])

    return run


def _assign(centres: np.ndarray, pivots: np.ndarray):
    def run(batches):
        for b in batches:
            if b.num_rows:
                cluster, distance, _ = nearest(*_read(b, centres.shape[1], len(pivots)), centres, pivots)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                                 ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, scale: float = 1024.0,
            seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dims) & fine)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    started = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(F.asc_nulls_last(started), "v").limit(clusters).select("v").toArrow()["v"]
    if not len(first):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    sample = kept.orderBy(F.xxhash64("v"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"]
    centres, pivots = _matrix(first, dims), pivots_of(_matrix(sample, dims), PIVOTS)
    cached = stored(kept.mapInArrow(_cache(pivots, dims), "vec_id long, v array<int>, to_pivots array<double>"), "pivots")
    for _ in range(rounds):
        sums = cached.select("v", "to_pivots").mapInArrow(_sums(centres, pivots), "cluster int, n long, sums array<bigint>")
        parts = sums.select("cluster", "n", F.posexplode("sums").alias("at", "part"))
        means = parts.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        for r in means.collect():  # clusters * dims rows
            centres[r["cluster"], r["at"]] = int(r["total"]) // r["n"]
    placed = stored(cached.mapInArrow(_assign(centres, pivots), "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    facts = [(k, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[k].tolist())).encode()).hexdigest()) for k, d in inertia.items()]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
