"""Centroid clustering of integer vectors by JVM-native expressions.

Components are scaled and floored to integers, so sums and distances are exact
and the result doesn't depend on how rows are dealt.  The centroids are array
literals of the plan.  A row's squared distance to one of them is an
``aggregate`` over a ``zip_with`` of both arrays, its cluster the ``array_min``
of the structs (distance, number); the new centroids come from one row of
component sums a cluster, which every task adds up for itself before the
shuffle.  So a round reads the vectors' column once and shuffles ``k`` rows a
task, however many rows a cluster holds; the driver sees ``k`` rows a round.

The first centroids are the ``k`` vectors with the smallest SHA-256 of a seed
and their id.

Defined results: vectors that are null, have another number of components or
hold null or non-finite ones take no part; a row without an id can't be a
first centroid but is assigned; repeated rows count once each; equal
distances go to the smaller number; with fewer than ``k`` vectors each is a
centroid; an empty table gives an empty result; other columns are ignored.
Where sums of squares may pass 64 bits, distances are decimals of 38 digits;
components that pass those too raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

K, ROUNDS, SCALE, WIDTH, SEED = 40, 5, 256, 64, 2
WIDE = "decimal(38,0)"


@dataclass
class Clusters:
    """Vectors with their cluster and distance, and the final centroids."""
    assigned: DataFrame  # vec_id, q, cluster, distance
    centroids: list[list[int]]
    number: str  # type of the distances


def quantised(vectors: DataFrame, scale: int = SCALE, width: int = WIDTH) -> DataFrame:
    """(vec_id, q) of the rows that take part."""
    x = F.col("embedding")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # the check of the length comes first, so one never reads past an end
    return (vectors.where(x.isNotNull() & (F.size(x) == width)).where(usable)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("q")))


def _number(rows: DataFrame, width: int) -> str:
    """A type that holds every sum of squared differences."""
    size = F.aggregate("q", F.lit(0).cast(WIDE), lambda m, v: F.greatest(m, F.abs(v.cast(WIDE))))
    top = int(rows.agg(F.max(size)).first()[0] or 0)
    if width * (2 * top) ** 2 < 2 ** 63:
        return "long"
    if top >= 2 ** 63 - 1 or width * (2 * top) ** 2 >= 10 ** 38:
        raise ValueError("vector components too large for exact distances")
    return WIDE


def _literal(centroids: list[list[int]], number: str) -> Column:
    """The centroids as one array of arrays."""
    rows = ", ".join(f"array({', '.join(map(str, c))})" for c in centroids)
    return F.expr(f"array({rows})").cast(f"array<array<{number}>>")


def _apart(q: Column, centroid: Column, number: str) -> Column:
    """Squared distance of ``q`` to a centroid."""
    def square(x, y):
        d = x.cast(number) - y
        return (d * d).cast(number)

    return F.aggregate(F.zip_with(q, centroid, square), F.lit(0).cast(number), lambda total, s: (total + s).cast(number))


def nearest(q: Column, centroids: list[list[int]], number: str = "long") -> Column:
    """Struct (distance, cluster) of the nearest centroid."""
    return F.array_min(F.transform(_literal(centroids, number), lambda c, i: F.struct(
        _apart(q, c, number).alias("distance"), i.alias("cluster"))))


def first_centroids(rows: DataFrame, k: int = K, seed: int = SEED) -> list[list[int]]:
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("vec_id").isNotNull()).select(mark.alias("mark"), "q").orderBy("mark", "q").limit(k)
    return [list(r["q"]) for r in sorted(first.collect(), key=lambda r: (r["mark"], list(r["q"])))]


def moved(rows: DataFrame, centroids: list[list[int]], number: str = "long") -> list[list[int]]:
    """The centroids after one round; those without vectors stay."""
    width = len(centroids[0])
    near = rows.select("q", nearest(F.col("q"), centroids, number)["cluster"].alias("cluster"))
    sums = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"),
                                       *[F.expr(f"sum(CAST(q[{i}] AS {number}))").alias(f"s{i}") for i in range(width)])
    new = list(centroids)
    for r in sums.collect():  # one row a cluster
        new[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return new


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH,
        seed: int = SEED) -> Clusters | None:
    """``rounds`` rounds over all vectors, and their last assignment; None
    without any vector."""
    rows = quantised(vectors, scale, width)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return None
    number = _number(rows, width)
    for _ in range(rounds):
        centroids = moved(rows, centroids, number)
    best = rows.withColumn("near", nearest(F.col("q"), centroids, number))
    return Clusters(best.select("vec_id", "q", "near.cluster", "near.distance"), centroids, number)


def clustered(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)
    of every vector that takes part; ``options`` as for ``fit``."""
    spark = prepare(vectors.sparkSession)
    found = fit(vectors, **options)
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, "
                                         "inertia long, centroid_sha256 string")
    rows = stored(found.assigned.select("vec_id", "cluster", F.col("distance").cast("long").alias("distance")),
                  "clusters-assigned")
    own = [0] * len(found.centroids)
    for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast(WIDE)).alias("s")).collect():
        own[r["cluster"]] = int(r["s"])
    marks = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    at = F.col("cluster")
    return rows.select("vec_id", "cluster", "distance",
                       F.array(*[F.lit(str(v)).cast("long") for v in own])[at].alias("cluster_inertia"),
                       F.lit(str(sum(own))).cast("long").alias("inertia"),
                       F.array(*[F.lit(m) for m in marks])[at].alias("centroid_sha256"))
