"""Nearest neighbours by cosine with vantage-point trees, one per shard of the vectors.

Vectors are scaled to length one, where a larger cosine is a smaller Euclidean distance, so the triangle inequality holds.
A search goes down the trees with blocks of queries.  A side is left out if, by the inequality, all of it is farther than
the k-th nearest so far, with the bound multiplied by ``factor``: 1 restores exact search, a larger factor prunes more.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cladeframe.llm.common import stored

#: Vectors in a shard and queries in a block, on average.
SHARD, BLOCK, LEAF = 8192, 1024, 256
#: Distances are compared with this much slack, above the rounding of double precision.
SLACK = 1e-7


def usable(vector: str) -> Column:
    """Neither null nor zero nor with components that are null or not finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def build(x: np.ndarray, ids: np.ndarray, k: int) -> dict:
    """Tree over one shard.  Equal vectors are one point, with its k + 1 smallest different ids (a query leaves out its own).

    An id with several vectors is at several points, of which one is its main point.
    """
    order = np.lexsort([ids, *x.T])
    x, ids = x[order], ids[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]).any(1)]) if len(x) else np.zeros(0, bool)
    other = new.copy()
    other[1:] |= ids[1:] != ids[:-1]
    x, ids, new = x[other], ids[other], new[other]
    first = np.flatnonzero(new)
    main = np.zeros(len(first), bool)
    main[np.searchsorted(first, np.unique(ids, return_index=True)[1], "right") - 1] = True
    length = np.diff(np.append(first, len(x)))
    points = x[first]
    # scaling by the largest component first, so that no square overflows or vanishes
    scaled = points / np.abs(points).max(1, keepdims=True) if len(points) else points
    unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    held = np.minimum(length, k + 1)
    names = [ids[a : a + n] for a, n in zip(first, held)]
    rng = np.random.default_rng(len(points))
    nodes: list[tuple] = []

    def split(rows: np.ndarray) -> int:
        me = len(nodes)
        nodes.append(())
        if len(rows) > LEAF:
            at = rows[rng.integers(len(rows))]
            rest = rows[rows != at]
            d = np.linalg.norm(unit[rest] - unit[at], axis=1)
            middle = float(np.median(d))
            inner = d <= middle
            if inner.any() and not inner.all():
                near, far = rest[inner], rest[~inner]
                nodes[me] = ("split", int(at), float(d[inner].min()), float(d[inner].max()), float(d[~inner].min()), float(d[~inner].max()), split(near), split(far))
                return me
        nodes[me] = ("leaf", rows)
        return me

    if len(points):
        split(np.arange(len(points)))
    return {"points": points, "unit": unit, "names": names, "main": main, "nodes": nodes}


def search(tree: dict, q: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, cosine) of the k best ids of the tree for each query, each id by its best vector; ties to smaller ids."""
    scaled = q / np.abs(q).max(1, keepdims=True)
    norm = np.linalg.norm(scaled, axis=1)
    unit = scaled / norm[:, None]
    points, names = tree["points"], tree["names"]
    kth = np.full(len(q), np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = np.full((len(q), k + 1), np.inf)  # one more than k, as the query itself may be among them

    def meet(rows: np.ndarray, at: np.ndarray) -> None:
        d = np.sqrt(np.maximum(2 - 2 * (unit[rows] @ tree["unit"][at].T), 0))
        hit, point = np.nonzero(d <= kth[rows, None] + SLACK)
        found.append((rows[hit], at[point], d[hit, point]))
        # k + 1 main points are of as many ids, so at least k others are no farther than the last of them
        part = np.partition(np.concatenate([best[rows], d[:, tree["main"][at]]], axis=1), k, axis=1)[:, : k + 1]
        best[rows] = part
        kth[rows] = part.max(1)

    def go(n: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        node = tree["nodes"][n]
        if node[0] == "leaf":
            meet(rows, node[1])
            return
        _, at, near0, near1, far0, far1, near, far = node
        meet(rows, np.array([at]))
        d = np.linalg.norm(unit[rows] - tree["unit"][at], axis=1)
        nearer = np.abs(d - (near0 + near1) / 2) <= np.abs(d - (far0 + far1) / 2)

        def possible(rows_: np.ndarray, d_: np.ndarray, low: float, high: float) -> np.ndarray:
            bound = np.maximum(np.maximum(low - d_, d_ - high), 0)
            return rows_[bound * factor <= kth[rows_] + SLACK]
        go(near, possible(rows[nearer], d[nearer], near0, near1))
        go(far, possible(rows[~nearer], d[~nearer], far0, far1))
        go(far, possible(rows[nearer], d[nearer], far0, far1))
        go(near, possible(rows[~nearer], d[~nearer], near0, near1))

    if tree["nodes"]:
        go(0, np.arange(len(q)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    rows, at, d = map(np.concatenate, zip(*found))
    keep = d <= kth[rows] + SLACK
    rows, at = rows[keep], at[keep]
    size = np.array([len(n) for n in names])[at] if len(at) else np.zeros(0, int)
    rows, at = np.repeat(rows, size), np.repeat(at, size)
    which = np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)
    ids = np.array([names[a][w] for a, w in zip(at, which)], np.int64)
    other = ids != own[rows]
    rows, at, ids = rows[other], at[other], ids[other]
    p = points[at]
    p_scaled = p / np.abs(p).max(1, keepdims=True)
    cosine = np.clip(np.einsum("ij,ij->i", scaled[rows], p_scaled) / (norm[rows] * np.linalg.norm(p_scaled, axis=1)), -1, 1) if len(rows) else np.zeros(0)
    order = np.lexsort([-cosine, ids, rows])
    rows, ids, cosine = rows[order], ids[order], cosine[order]
    once = np.ones(len(rows), bool)
    once[1:] = (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])
    rows, ids, cosine = rows[once], ids[once], cosine[once]
    order = np.lexsort([ids, -cosine, rows])
    rows, ids, cosine = rows[order], ids[order], cosine[order]
    begin = np.searchsorted(rows, np.arange(len(q)))
    top = np.arange(len(rows)) - begin[rows] < k
    return rows[top], ids[top], cosine[top]


def index(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(shard, tree): every usable vector is in one tree, rows that repeat it under its id once; trees are stored in the shared folder."""
    v = vectors.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"), F.size(vector).alias("size"))
    shards = max(1, -(-v.count() // SHARD))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        trees = []
        for size, g in group.groupby("size"):  # vectors of another length are no neighbours
            trees.append((size, build(np.stack(g["x"].to_numpy()), g["id"].to_numpy(), k)))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "tree": [pickle.dumps(dict(trees), protocol=5)]})

    rows = v.distinct().withColumn("shard", F.pmod(F.xxhash64("id", "x"), F.lit(shards)).cast("int"))
    return stored(rows.groupBy("shard").applyInPandas(grow, "shard int, tree binary"), "trees")


def nearest(queries: DataFrame, trees: DataFrame, k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each usable query but itself, the nearest first, ties to smaller ids.

    Queries come in blocks and each block meets each tree once, so tasks hold one tree and one block.  Neighbours are
    different ids, never the query's own: rows that repeat an id with its vector count once, and an id with several vectors has the
    score of the nearest, whether it asks or is found.  No usable query or vector: no row.
    """
    q = queries.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x")).distinct()
    blocks, shards = max(1, -(-q.count() // BLOCK)), trees.agg(F.max("shard")).first()[0]
    every = F.sequence(F.lit(0), F.lit(0 if shards is None else shards))
    q = q.withColumn("block", F.pmod(F.xxhash64("id", "x", F.lit(3)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(every))
    t = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree in left["tree"]:
            by_size = pickle.loads(tree)
            sizes = right["x"].map(len)
            for size, own in by_size.items():
                some = right[sizes == size]
                if len(some):
                    ids = some["id"].to_numpy()
                    r, n, c = search(own, np.stack(some["x"].to_numpy()), ids, k, factor)
                    out.append(pd.DataFrame({"query_id": ids[r], "vec_id": n, "score": c}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    found = t.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))  # an id may be in several trees
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    top = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("p", "b"))
    return top.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score"))
