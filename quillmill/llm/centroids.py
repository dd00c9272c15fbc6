"""Centroid clustering: Lloyd's rounds that compare and move only what changed.

Vectors are whole numbers, so distances and sums are exact and don't depend on the order of rows.
What a round needs of the one before is stored: for each vector its owner and the squared
distance to it, and for each centroid the sum and number of its vectors. A round then

- compares a vector whose owner stood still with the centroids that moved, and no others, since
  its stored distance still holds and all centroids that stood still lost to it before;
- compares a vector whose owner moved with all centroids;
- adds up signed transfers: a vector that changed its owner is taken from one sum and put to another.

Only the transfers, a row for each centroid, come to the driver, and centroids go to all tasks: their
number and that of components are parameters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Components are held within this, so that squared distances fit into 64 bits.
LIMIT = 1 << 27
_MOST = (1 << 63) - 1
_STATE = "vec_id long, v array<int>, was int, cluster int, distance long"


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id and v, the components floor(scale * x), of the rows with exactly dims components that are all finite numbers."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def whole(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))).cast("int")

    return vectors.filter((F.size(e) == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, whole).alias("v"))


def starts(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k least SHA-256 digests of seed:vec_id, in that order; a row without an id starts none, equal ids go by their components."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.v for r in kept.filter("vec_id IS NOT NULL").orderBy(drawn, "v").select("v").limit(k).collect()]


def nearest(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and squared distance of each vector once the marked centroids have moved; of equally near ones the smaller number. Owner -1: none yet."""
    stale = (owner < 0) | moved[owner]
    owner, distance = owner.copy(), np.where(stale, _MOST, distance)
    every, some = np.arange(len(v)), np.flatnonzero(stale)
    for c in range(len(centroids)):
        rows = every if moved[c] else some
        if not len(rows):
            continue
        apart = v[rows] - centroids[c]
        d = np.einsum("ij,ij->i", apart, apart)
        better = (d < distance[rows]) | ((d == distance[rows]) & (c < owner[rows]))
        owner[rows[better]], distance[rows[better]] = c, d[better]
    return owner, distance


def assign(state: DataFrame, centroids: list[list[int]], moved: list[bool]) -> DataFrame:
    """The state after a comparison: was is the former owner."""
    at, marks = np.array(centroids, np.int64), np.array(moved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, at.shape[1])
            owner = batch.column("cluster").to_numpy(zero_copy_only=False)
            new, distance = nearest(v, owner, batch.column("distance").to_numpy(zero_copy_only=False), at, marks)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(owner, pa.int32()), pa.array(new, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "v", "was", "cluster", "distance"])

    return state.mapInArrow(run, _STATE)


def transfers(state: DataFrame, dims: int) -> list[tuple[int, int, list[int]]]:
    """Centroid, signed number and signed sums of the vectors that came or went; combined before the shuffle, a row a centroid."""
    both = F.array(F.struct(F.col("was").alias("c"), F.lit(-1).alias("s")), F.struct(F.col("cluster").alias("c"), F.lit(1).alias("s")))
    signed = state.filter("was != cluster").select(F.explode(both).alias("m"), "v").filter("m.c >= 0")
    sums = [F.sum(F.col("m.s") * F.col("v")[i].cast("long")) for i in range(dims)]
    rows = signed.groupBy("m.c").agg(F.sum("m.s").alias("n"), F.array(*sums).alias("sums")).collect()
    return [(r.c, r.n, r.sums) for r in rows]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of vectors (vec_id, embedding).

    Kept are the rows with exactly dims components, none of them null, NaN or infinite; others give
    no row. Components scale * x beyond 2^27 either way count as that. A null vec_id is assigned but
    starts no centroid; repeated rows and ids are rows of their own. With fewer than k rows that may
    start one there are fewer centroids, with none no rows. A centroid without vectors stays where it
    is. Inertias beyond 64 bits count as the largest long. Other columns are left out, whatever their names.
    """
    spark = vectors.sparkSession
    state = materialize(whole_vectors(vectors, dims, scale).selectExpr("vec_id", "v", "-1 AS was", "-1 AS cluster", "0L AS distance"), "vectors")
    centroids = starts(state, k, seed)
    if not centroids:
        return state.filter("false").selectExpr("vec_id", "cluster", "distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    moved = [True] * len(centroids)
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    for last in [False] * rounds + [True]:
        before, state = state, materialize(assign(state, centroids, moved), "assigned")
        discard(before)
        if last:
            break
        for c, n, s in transfers(state, dims):
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], s, strict=True)]
        new = [[x // n for x in s] if n else old for s, n, old in zip(sums, counts, centroids, strict=True)]
        moved = [a != b for a, b in zip(new, centroids, strict=True)]
        centroids = new
    inertias = {r.cluster: int(r.d) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    total = min(_MOST, sum(inertias.values()))
    rows = [(c, min(_MOST, d), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sorted(inertias.items())]
    summary = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(summary), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
