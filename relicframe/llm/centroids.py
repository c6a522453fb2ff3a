"""Centroid clustering in exact integers, with an incremental distance matrix.

A component x becomes ``floor(scale * x)``. Every vector keeps its squared norm and
its dot product with each centroid in a table; when centroids move, a
dot product changes by the vector's components times the centroid's changes, and only
components that changed are read. Distances, sums and means are 64-bit integers, so
the result depends neither on the order of rows nor on partitions.

The table of a round (vectors, norms, dot products, cluster) is written to the shared
folder, where a lost executor costs the tasks it ran and no more. The driver sees
one row of sums for each cluster and round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, exact_columns, materialize

CLUSTERS = 8
ROUNDS = 10
DIMENSIONS = 64
SCALE = 1024
SEED = 3
#: Integer components beyond it could overflow a squared distance of 64 components.
LARGEST = 1 << 27

STATE = "vec_id long, v array<int>, norm long, dots array<long>, cluster int, distance long"


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<int>) of the vectors of just ``dimensions`` finite components.

    Components of ``LARGEST / scale`` and more raise an error, as squared distances would not fit 64 bits.
    """
    rows = exact_columns(vectors, "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))))
    small = F.forall("embedding", lambda x: F.abs(x) < LARGEST / scale)
    checked = F.when(small, scaled).otherwise(F.raise_error(F.lit(f"op13: a component is {LARGEST // scale} or more: its squared distance may not fit 64 bits")))
    return rows.where((F.size("embedding") == dimensions) & finite).select("vec_id", checked.cast("array<int>").alias("v"))


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest sha256 of ``seed:vec_id``, in that order; a null id hashes as no digits."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    return np.array([r["v"] for r in chosen], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def assigner(centroids: np.ndarray, changes: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task that brings dot products up to ``centroids`` and assigns each vector to the nearest.

    ``changes`` are the centroids less those of the stored dot products; without, these are computed whole.
    """
    squares = (centroids * centroids).sum(axis=1)
    moved = [] if changes is None else [(c, at, row[at]) for c, row in enumerate(changes) if (at := np.flatnonzero(row)).size]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), centroids.shape[1])
            if changes is None:
                norm, dots = (v * v).sum(axis=1), v @ centroids.T
            else:
                norm = batch.column("norm").to_numpy()
                dots = _matrix(batch.column("dots"), len(centroids))
                for c, at, by in moved:
                    dots[:, c] += v[:, at] @ by
            distances = norm[:, None] - 2 * dots + squares
            cluster = distances.argmin(axis=1)  # ties: the first
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(norm), _lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distances[np.arange(len(v)), cluster])],
                names=["vec_id", "v", "norm", "dots", "cluster", "distance"],
            )

    return assign


def cluster_means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors, by component; an empty cluster keeps its centroid."""
    sums = state.groupBy("cluster").agg(F.count("*"), *[F.sum(F.get("v", F.lit(i))) for i in range(centroids.shape[1])])
    out = centroids.copy()
    for cluster, n, *parts in sums.collect():
        out[cluster] = [s // n for s in parts]
    return out


def cluster_vectors(
    vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row for each vector that is kept.

    Kept are vectors of just ``dimensions`` components, none null, NaN or infinite; null
    vectors and all others give no row. Fewer vectors than clusters give as many
    clusters as there are vectors. Repeated rows are clustered and come out as often as they went in, and of equal
    centroids the smaller number takes the vectors. A null vec_id is kept, and hashes as no digits. Columns besides vec_id and embedding are not
    read, whatever their names; an empty table gives no rows. Components of 131,072 and more at the given scale raise an error. Once no centroid moves, further rounds
    would change nothing and are left out.
    """
    rows = integer_vectors(vectors, dimensions, scale)
    centroids = first_centroids(rows, clusters, seed)
    if not len(centroids):
        return rows.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")
        ).limit(0)
    state = materialize(rows.mapInArrow(assigner(centroids, None), STATE), "clusters")
    for _ in range(rounds):
        means = cluster_means(state, centroids)
        changes, centroids = means - centroids, means
        if not changes.any():
            break
        following = materialize(state.mapInArrow(assigner(centroids, changes), STATE), "clusters")
        discard(state)
        state = following
    inertia = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(centroids))])
    names = F.array(*[F.lit(d) for d in digests])
    return state.select(
        "vec_id", "cluster", "distance", F.get(own, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"),
    )
