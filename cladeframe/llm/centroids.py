"""Centroid clustering of integer vectors in exact arithmetic, with dot products kept from round to round.

Every vector's row holds its integer dot products with all centroids.  When centroids move, only the components that changed
are multiplied and added to the products that the last round wrote; squared distances then follow from the products and the
norms, and the nearest centroid is chosen anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cladeframe.llm.common import release, scratch

#: Components beyond this are cut to it: with it 64 squared differences still fit a long, as the distance has to.
REACH = 1 << 27
LONGEST = (1 << 63) - 1


def usable(vector: Column, size: int) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~odd, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(REACH))), F.lit(float(REACH)))).cast("int"))


def nearest(x: np.ndarray, dots: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Products after ``centroids`` have changed by ``moved``, the nearest centroid (the first of equals) and its squared distance."""
    dots = dots.copy()
    for c, change in enumerate(moved):
        at = np.flatnonzero(change)
        if len(at):
            dots[:, c] += x[:, at] @ change[at]
    squares = np.einsum("ij,ij->i", x, x)[:, None] - 2 * dots + np.einsum("ij,ij->i", centroids, centroids)
    cluster = squares.argmin(axis=1)
    return dots, cluster, squares[np.arange(len(x)), cluster]


def _assigned(table: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    k, size = centroids.shape

    def matrix(column: pa.Array, width: int) -> np.ndarray:
        return column.flatten().to_numpy().astype(np.int64).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dots, cluster, distance = nearest(matrix(b.column("x"), size), matrix(b.column("dots"), k), centroids, moved)
                rows = pa.ListArray.from_arrays(np.arange(0, dots.size + 1, k, dtype=np.int32), pa.array(dots.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("x"), rows, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["key", "x", "dots", "cluster", "distance"])

    return table.mapInArrow(run, f"key {table.schema['key'].dataType.simpleString()}, x array<int>, dots array<bigint>, cluster int, distance bigint")


def start(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows whose ``seed:key`` has the smallest sha256, in its order; repeated keys by their vectors, rows without key last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = rows.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in first], dtype=np.int64)


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row with exactly ``size`` finite components.

    Other rows and other columns aren't returned.  Repeated rows count each; with fewer than k rows there are fewer
    centroids, with none no row.  Sums are exact (decimals), and sums of distances beyond a long are cut to its largest value.  The
    driver holds the k centroids and one row of sums per centroid.  Each round writes its table, so a lost executor costs
    its tasks of one round; the table before is deleted.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector}`")
    at = scratch(spark, "vectors")
    vectors.where(usable(v, size)).select(F.col(f"`{key}`").alias("key"), integers(v, scale).alias("x")).write.parquet(at)
    table = spark.read.parquet(at)
    centroids = start(table, k, seed)
    if not len(centroids):
        return table.select(F.col("key").alias(key), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    moved, table = centroids, table.withColumn("dots", F.array_repeat(F.lit(0).cast("bigint"), len(centroids)))
    for r in range(rounds + 1):
        before, at = at, scratch(spark, "vectors")
        _assigned(table, centroids, moved).write.parquet(at)
        table = spark.read.parquet(at)
        release(spark, [before])
        total = lambda c: F.sum(c.cast("decimal(38,0)" if r == rounds else "bigint"))
        if r == rounds:
            inertia = {row["cluster"]: int(row["i"]) for row in table.groupBy("cluster").agg(total(F.col("distance")).alias("i")).collect()}
            break
        sums = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*[total(F.element_at("x", j + 1)) for j in range(size)]).alias("sums")).collect()
        after = centroids.copy()
        for row in sums:
            after[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]
        centroids, moved = after, after - centroids
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    cut = [min(inertia.get(c, 0), LONGEST) for c in range(len(centroids))]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster") + 1)
    return table.select(F.col("key").alias(key), "cluster", "distance", of(cut, "bigint").alias("cluster_inertia"),
                        F.lit(min(sum(inertia.values()), LONGEST)).cast("bigint").alias("inertia"), of(told, "string").alias("centroid_sha256"))
