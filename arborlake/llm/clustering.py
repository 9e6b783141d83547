"""Centroid clustering of integer vectors with JVM expressions.

Every component ``x`` becomes ``floor(scale * x)``, so distances, sums and centroids are
exact and the same however the rows are dealt. Centroids are few and short (``clusters``
times ``dims`` numbers, a parameter), so they live on the driver and enter a plan as literal
arrays: ``zip_with`` and ``aggregate`` give the squared distance to each, ``array_min`` of
structs ``(distance, cluster)`` chooses, and one sum per component, combined on the map side,
moves the centroids. A round reads the integer vectors once and shuffles at most one row per
task and cluster, whatever share of the rows a cluster holds.

Defined results: rows whose vector is NULL, has another number of components than ``dims``,
or holds a NULL, NaN or infinite component are left out. Repeated rows are rows of their own
and are returned as often as they come. The seeds are the vectors with the smallest hashes;
of equal hashes the smaller vector comes first, and rows without an id are never seeds but
belong to a cluster. With fewer rows than clusters there are as many centroids as seeds; with
no seed the cluster, the distance and the sums are NULL. An empty table gives an empty result.
Integer components beyond 2 ** 27 end the job with an error, as squared distances would not
fit a long. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.llm.store import drop, keep
from arborlake.llm.vectors import finite

LARGEST = 1 << 27

Centroids = list[list[int]]


def integer_vectors(table: DataFrame, dims: int, scale: int, id_name: str = "vec_id", vec_name: str = "embedding") -> DataFrame:
    """``vec_id, v`` with integer components of every row that takes part."""
    vec = F.col(vec_name)
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    fits = F.forall(whole, lambda x: (x <= LARGEST) & (x >= -LARGEST))
    checked = F.when(fits, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<bigint>"))
    return table.where(finite(vec) & (F.size(vec) == dims)).select(F.col(id_name).alias("vec_id"), checked.alias("v"))


def seeds(vectors: DataFrame, clusters: int, seed: int) -> Centroids:
    """The vectors with the smallest hash of seed and id, in the order of the hashes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.where(F.col("vec_id").isNotNull()).select(digest.alias("digest"), "v").orderBy("digest", "v").limit(clusters)
    return [list(r["v"]) for r in first.collect()]


def _literal(numbers: list[int]) -> Column:
    return F.array(*(F.lit(x).cast("bigint") for x in numbers))


def distance(v: Column, centroid: list[int]) -> Column:
    """Squared Euclidean distance to a centroid, exact."""
    squares = F.zip_with(v, _literal(centroid), lambda a, b: (a - b) * (a - b))
    return F.aggregate(squares, F.lit(0).cast("bigint"), lambda s, x: s + x)


def nearest(v: Column, centroids: Centroids) -> Column:
    """Struct ``(distance, cluster)`` of the nearest centroid, the smaller number on a tie."""
    if not centroids:
        return F.lit(None).cast("struct<distance:bigint,cluster:int>")
    return F.array_min(
        F.array(*(F.struct(distance(v, c).alias("distance"), F.lit(k).alias("cluster")) for k, c in enumerate(centroids)))
    )


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid replaced by the floor of the mean of its vectors; empty ones stay."""
    if not centroids:
        return centroids
    dims = len(centroids[0])
    held = vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), *(F.col("v")[d].alias(f"x{d}") for d in range(dims)))
    sums = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"), *(F.sum(f"x{d}").alias(f"x{d}") for d in range(dims)))
    after = [list(c) for c in centroids]
    for r in sums.collect():
        after[r["cluster"]] = [r[f"x{d}"] // r["rows"] for d in range(dims)]
    return after


def _of_cluster(values: list, kind: str) -> Column:
    """The value of the row's cluster."""
    return F.get(F.array(*(F.lit(x).cast(kind) for x in values)) if values else F.array().cast(f"array<{kind}>"), F.col("cluster"))


def clustered(
    table: DataFrame, clusters: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: int = 1,
    id_name: str = "vec_id", vec_name: str = "embedding", told: Callable[[Centroids], None] | None = None,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector.

    ``told`` is called with the centroids of each round.
    """
    vectors = keep(integer_vectors(table, dims, scale, id_name, vec_name), "integers")
    centroids = seeds(vectors, clusters, seed)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
        if told:
            told(centroids)
    near = vectors.select("vec_id", nearest(F.col("v"), centroids).alias("near"))
    assigned = keep(near.select("vec_id", "near.cluster", "near.distance"), "assigned")
    drop(vectors)
    sums = {r["cluster"]: r["inertia"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    own = [sums.get(k, 0) for k in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = F.lit(sum(own) if centroids else None).cast("bigint")
    return assigned.select(
        "vec_id",
        "cluster",
        "distance",
        _of_cluster(own, "bigint").alias("cluster_inertia"),
        whole.alias("inertia"),
        _of_cluster(digests, "string").alias("centroid_sha256"),
    )
