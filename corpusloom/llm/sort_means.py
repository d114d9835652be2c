"""Clusters of integer vectors by sort-means.

Each round has, for every centroid, the other centroids in order of their distance from it. A vector starts at the centroid of its
last assignment and looks at the others in that order, until one is strictly further from that centroid than twice the vector's own
distance to it: by the triangle inequality no later one is nearer, nor as near.

Distances and sums are exact integers. A round is one pass without a shuffle of vectors: it reads the vectors with their last clusters, writes them with their new
ones, and beside them each task writes its own sums by cluster, which are a row a cluster and task. Only sums of whole clusters reach
the driver. The round before is deleted when the next is written, so a lost executor costs a reread and two copies are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import released
from .shared import fresh_path, removed

#: Components beyond this make distances that don't fit in 64 bits.
LARGEST = 1 << 27
ROWS = "kind int, vec_id long, point array<int>, cluster int, distance long, n long, sums array<long>"


def _kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, point): vectors with `dims` components, all of them finite numbers, as integers."""
    e = vectors["embedding"]
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    point = F.transform(e, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(e, lambda x: F.abs(x.cast("double")) * scale <= LARGEST)
    point = F.when(fits, point).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")))
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), e).filter((F.size(e) == dims) & F.forall(e, finite)).select("vec_id", point.cast("array<int>").alias("point"))


def assign(points: np.ndarray, before: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each point, the smaller number among equals. before: where each point's search starts."""
    nearest, least = before.astype(np.int64), np.empty(len(points), np.int64)
    apart = ((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2)
    for c in np.unique(before):
        rows = np.flatnonzero(before == c)
        own = ((points[rows] - centroids[c]) ** 2).sum(1)
        order = np.argsort(-own, kind="stable")  # those that look furthest come first
        rows, own = rows[order], own[order]
        best, who = own.copy(), np.full(len(rows), c)
        others = np.argsort(apart[c], kind="stable")
        reach = -(-apart[c] // 4)  # apart > 4 own, without a product that overflows
        for j in others[others != c]:
            far = int(np.searchsorted(-own, -reach[j], side="right"))  # vectors with own >= reach
            if far == 0:
                break
            d = ((points[rows[:far]] - centroids[j]) ** 2).sum(1)
            better = (d < best[:far]) | ((d == best[:far]) & (j < who[:far]))
            best[:far][better], who[:far][better] = d[better], j
        nearest[rows], least[rows] = who, best
    return nearest, least


def _round(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(size, dims)
            who, distance = assign(points, batch.column(2).to_numpy(zero_copy_only=False), centroids)
            for c in np.unique(who):
                rows = who == c
                n[c] += rows.sum()
                sums[c] += points[rows].sum(0)
                inertia[c] += sum(distance[rows].tolist())
            nothing = pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(size, np.int32)), batch.column(0), batch.column(1), pa.array(who.astype(np.int32)), pa.array(distance), nothing, pa.nulls(size, pa.list_(pa.int64()))], names=NAMES
            )
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_pylist([{"kind": 1, "vec_id": None, "point": None, "cluster": int(c), "distance": inertia[c], "n": int(n[c]), "sums": sums[c].tolist()} for c in full], schema=SCHEMA)

    return released(run)


NAMES = [x.split()[0] for x in ROWS.split(", ")]
SCHEMA = pa.schema(list(zip(NAMES, (pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)))


def _totals(sums: DataFrame) -> dict[int, tuple[int, int, list[int]]]:
    """cluster: (vectors, inertia, sum of each component), from the tasks' rows. One row a component of a cluster reaches the driver."""
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    heads = {r.cluster: (int(r.n), int(r.d)) for r in sums.groupBy("cluster").agg(whole("n").alias("n"), whole("distance").alias("d")).collect()}
    parts = sums.select("cluster", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(whole("s").alias("s")).collect()
    found: dict[int, dict[int, int]] = {}
    for r in parts:
        found.setdefault(r.cluster, {})[r.i] = int(r.s)
    return {c: (*heads[c], [v for _, v in sorted(found[c].items())]) for c in heads}


def seed_order(seed: int) -> Column:
    """Rows by the hash of seed and id; those without an id come last."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that takes part.

    Those take part that have `dims` components, none of them null or not finite; a component x becomes floor(scale * x). Vectors that don't take part
    have no row. Centroids start as the k vectors whose ids hash lowest (fewer vectors: as many centroids). Repeated ids are vectors each; of
    equal hashes the smaller vector comes first; vectors without an id start no centroid unless the others are too few. Equally near
    centroids: the smaller number. A cluster that has lost its vectors keeps its centroid. An empty table gives none. Other columns are ignored.
    A component beyond 2^27 / scale is an error, as its distances don't fit in a long. k and dims bound what is broadcast: k * dims integers.
    """
    spark = vectors.sparkSession
    path = fresh_path(spark, "sort-means-points")
    points = _kept(vectors, dims, scale).withColumn("cluster", F.lit(0))
    points.write.parquet(path)
    now = spark.read.schema(points.schema).parquet(path)
    first = now.orderBy(seed_order(seed), "point").limit(k).collect()
    centroids = np.array([r.point for r in first], np.int64).reshape(len(first), dims)
    if not len(first):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for step in range(rounds + 1):
        out = fresh_path(spark, "sort-means")
        now.select("vec_id", "point", "cluster").mapInArrow(_round(centroids), ROWS).write.partitionBy("kind").parquet(out)
        rows = spark.read.schema(ROWS).parquet(out)
        removed(spark, path)
        now, path = rows.filter("kind = 0"), out
        totals = _totals(rows.filter("kind = 1"))
        if step < rounds:
            for c, (n, _, sums) in totals.items():
                centroids[c] = [s // n for s in sums]
    whole = sum(inertia for _, inertia, _ in totals.values())
    sha = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    about = spark.createDataFrame([(c, inertia, whole, sha(c)) for c, (_, inertia, _) in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
