"""Centroid clustering of integer vectors, screened by the norms of their blocks.

A vector stands compressed as the norms of its blocks of BLOCK components. By Cauchy-Schwarz its squared
distance from a centroid is at least the sum of the squared differences of their block norms; so one
small matrix product bounds all distances of a batch, the exact one is taken to the centroid with the
least bound, and then only to those whose bound is not above it. Distances and means are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessellum.llm.common import store

WIDTH, SCALE, CENTROIDS, ROUNDS, SEED = 64, 256, 40, 5, "2"
#: Components in a block.
BLOCK = 4
#: A squared distance of vectors of components below this size fits a long.
LARGEST = 1 << 27
#: Rows compared in one go.
STEP = 4096


def block_norms(vectors: np.ndarray) -> np.ndarray:
    """The norms of each row's blocks."""
    blocks = vectors.reshape(len(vectors), -1, BLOCK)
    return np.sqrt((blocks * blocks).sum(axis=2).astype(np.float64))


def nearest(vectors: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, ties to the smaller number, and how many exact distances were taken."""
    own = block_norms(centroids)
    least = (norms * norms).sum(axis=1)[:, None] + (own * own).sum(axis=1) - 2 * norms @ own.T
    # what rounding may have added is taken off
    least -= 1e-12 * ((norms * norms).sum(axis=1)[:, None] + (own * own).sum(axis=1)) * norms.shape[1]
    best = least.argmin(axis=1)
    gap = vectors - centroids[best]
    distance = (gap * gap).sum(axis=1)
    open_pairs = least <= distance[:, None]
    open_pairs[np.arange(len(best)), best] = False
    taken = len(best)
    for c in np.flatnonzero(open_pairs.any(axis=0)):
        rows = np.flatnonzero(open_pairs[:, c] & (least[:, c] <= distance))
        gap = vectors[rows] - centroids[c]
        d = (gap * gap).sum(axis=1)
        nearer = (d < distance[rows]) | (d == distance[rows]) & (c < best[rows])
        best[rows[nearer]], distance[rows[nearer]] = c, d[nearer]
        taken += len(rows)
    return best, distance, taken


def batch_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and block norms of a stored batch."""
    n = batch.num_rows
    flat = [np.frombuffer(b"".join(batch.column(name).to_pylist()), kind) for name, kind in (("vector", "<i4"), ("norms", "<f8"))]
    return flat[0].reshape(n, WIDTH).astype(np.int64), flat[1].reshape(n, WIDTH // BLOCK)


def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = np.asarray(batch.column("ints").flatten(), np.int64).reshape(batch.num_rows, WIDTH)
        norms = block_norms(vectors)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in vectors.astype("<i4")], pa.binary()), pa.array([v.tobytes() for v in norms.astype("<f8")], pa.binary())], ["vec_id", "vector", "norms"])


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector, norms) of the vectors that have WIDTH components, none null or non-finite: floor(SCALE * x) as 32-bit integers, and the norms of their blocks."""
    wide = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).where(F.size("x") == WIDTH)
    whole = wide.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    small = F.forall("x", lambda x: F.abs(x * SCALE) < LARGEST)
    ints = F.when(small, F.transform("x", lambda x: F.floor(x * SCALE))).otherwise(F.raise_error(F.lit(f"a component times {SCALE} is {LARGEST} or more: squared distances would not fit a long")))
    return store(whole.select("vec_id", ints.cast("array<long>").alias("ints")).mapInArrow(compress, "vec_id long, vector binary, norms binary"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of "seed:vec_id", in that order; equal ids by their components' bytes, null ids last."""
    rows = vectors.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return np.array([np.frombuffer(r[0], "<i4") for r in rows], np.int64).reshape(-1, WIDTH)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floor of the exact mean of the vectors nearest to it, or left where there are none.

    A task returns one row of counts and sums per centroid, the driver sees as many.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            rows, norms = batch_of(batch)
            for at in range(0, len(rows), STEP):
                own = nearest(rows[at : at + STEP], norms[at : at + STEP], centroids)[0]
                count += np.bincount(own, minlength=len(centroids))
                np.add.at(total, own, rows[at : at + STEP])
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held], pa.int64()), pa.array(list(total[held]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.select("vector", "norms").mapInArrow(sums, "cluster int, n long, total array<long>")
    means = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(WIDTH)))
    out = centroids.copy()
    for row in means.collect():
        out[row["cluster"]] = [int(row[f"t{i}"]) // row["n"] for i in range(WIDTH)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, taken): each vector's nearest centroid; taken, on a batch's first row, counts its exact distances."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, norms = batch_of(batch)
            own, distance, taken = nearest(rows, norms, centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), pa.array(distance, pa.int64()), pa.array([taken, *[0] * (len(rows) - 1)][: len(rows)], pa.int64())], ["vec_id", "cluster", "distance", "taken"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long, taken long")


RESULT = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])


def cluster(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), centroids) after `rounds` rounds and a last assignment.

    Vectors that are null, of another width, or hold null or non-finite components have no row; fewer kept
    vectors than k make fewer centroids, none an empty result. Rows that repeat an id are vectors of their
    own; a null id is kept, and chosen as a first centroid last. Other columns play no part. A component of
    2^27 / 256 in size or more raises an error, as the sums of squares would not fit a long.
    """
    vectors = integer_vectors(rows, id_col, vector_col)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], RESULT), centroids
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = store(assigned(vectors, centroids).select("vec_id", "cluster", "distance"))
    whole = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"))
    names = {c: hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest() for c, v in enumerate(centroids)}
    inertia = {r["cluster"]: int(r["d"]) for r in whole.collect()}
    table = [(c, d, sum(inertia.values()), names[c]) for c, d in inertia.items()]
    each = rows.sparkSession.createDataFrame(table, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(each), F.col("cluster") == F.col("c"))  # at most k rows
    return out.select(*RESULT.names), centroids
