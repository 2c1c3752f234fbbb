"""Comparing sets of trees through their splits: distances, support, consensus, convergence.

Input is ``splits(tree_id, split)`` with unique rows.  Nothing here joins splits to splits
of the same group: sums over pairs of trees come from counts per split.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import newick as nw
from cladeframe.operators.trees import _id_type, _per_tree

#: Topologies that a chunk of trees may have, times as many trees, and tasks per core.
PAIR_BLOCK, PAIR_TREES, PAIR_TASKS = 512, 4, 16
#: Pairs made of one row: they are held at once.
PAIRS_AT_ONCE = 1 << 15
#: Topologies are counted in this many buckets, so that is what the driver sees of them at most.
PAIR_BUCKETS = 1 << 16
GREEDY_BATCH = 4096


def split_counts(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def all_splits(splits: DataFrame) -> DataFrame:
    return splits.select("split").dropDuplicates(["split"])


def relative(rf: Column, n_taxa: int) -> Column:
    """Distance over its maximum 2(n-3) for fully resolved trees."""
    return rf / float(2 * (n_taxa - 3))


def rf_average(trees: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean pairwise distance and number of distinct topologies, in linear work.

    Each split held by c of T trees is shared by c(c-1)/2 pairs, and every tree takes part
    in T-1 pairs, so the sum over pairs needs no pair.  A tree is parsed once: its splits and
    a digest of all of them (equal for trees without any) are counted in the same pass.
    """
    index = {x: i for i, x in enumerate(labels)}

    def rows(_, text):
        held = sorted({s for s, _ in nw.splits(nw.parse(text), index)})
        return [(False, s) for s in held] + [(True, hashlib.sha256(",".join(held).encode()).hexdigest())]

    n = _per_tree(trees, rows, "whole BOOLEAN, k STRING").groupBy("whole", "k").agg(F.count(F.lit(1)).cast("double").alias("n"))
    part = lambda v, whole: F.coalesce(F.sum(F.when(F.col("whole") == whole, v)), F.lit(0.0))
    c = n.agg(part(F.col("n"), False).alias("_all"), part(F.col("n") * (F.col("n") - 1), False).alias("_shared"),
              part(F.col("n"), True).alias("_t"), F.count_if("whole").alias("unique_trees"))
    avg = F.try_divide(F.col("_all") * (F.col("_t") - 1) - F.col("_shared"), F.col("_t") * (F.col("_t") - 1) / 2)
    avg = F.coalesce(avg, F.lit(0.0))  # a single tree
    return c.select(avg.alias("avg_rf"), relative(avg, len(labels)).alias("avg_rrf"), "unique_trees")


def topology_keys(splits: DataFrame) -> DataFrame:
    """One digest per tree over its sorted splits (at most n-3 of them)."""
    return splits.groupBy("tree_id").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("split")), ","), 256).alias("topology"))


def unique_topologies(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """Distinct topologies; trees without any split share the star topology."""
    keys = trees.select("tree_id").join(topology_keys(splits), "tree_id", "left")
    return keys.agg(F.countDistinct(F.coalesce("topology", F.lit("star"))).alias("unique_trees"))


def chunks(sizes: list[tuple[int, int, int]], trees: int, topologies: int) -> tuple[list[tuple[int, int, int]], int]:
    """(bucket, its first chunk, number of its chunks) of each (bucket, trees, topologies), and how many chunks there are.

    Buckets go to one chunk until it would have more than so many trees or topologies; one with more trees is cut.
    """
    out, at, n, held = [], 0, 0, 0
    for bucket, more, kinds in sizes:
        if n and (n + more > trees or held + kinds > topologies):
            at, n, held = at + 1, 0, 0
        parts = max(1, math.ceil(more / trees))
        out.append((bucket, at, parts))
        at, n, held = (at + parts, 0, 0) if parts > 1 else (at, n + more, held + kinds)
    return out, at + (n > 0)


def rf_pairwise(splits: DataFrame, trees: DataFrame, n_taxa: int, block: int = PAIR_BLOCK) -> DataFrame:
    """The full distance table (i < j): quadratic output, produced chunk pair by chunk pair.

    Trees are dealt to chunks by their topology, so a chunk has few topologies (about ``block`` at most) and up to
    ``PAIR_TREES`` times as many trees, and each travels once per chunk.  A task holds two chunks and one matrix of
    distances between their topologies whatever the number of trees is, and a split that all trees share adds to that
    matrix instead of blowing up a join.  Only its distances and the ids leave Python, in rows of ``PAIRS_AT_ONCE`` pairs;
    the pairs are made of them by generated code.
    """
    spark, kind = trees.sparkSession, _id_type(trees)
    per_tree = trees.select("tree_id").join(
        splits.groupBy("tree_id").agg(F.array_join(F.array_sort(F.collect_list("split")), ",").alias("s")), "tree_id", "left")
    per_tree = per_tree.withColumn("s", F.coalesce("s", F.lit(""))).withColumn(
        "bucket", F.pmod(F.xxhash64("s"), F.lit(PAIR_BUCKETS)).cast("int"))
    sizes = per_tree.groupBy("bucket", "s").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.sum("n"), F.count(F.lit(1)))
    dealt, nc = chunks(sorted(tuple(r) for r in sizes.collect()), PAIR_TREES * block, block)
    nc = max(1, nc)
    first = spark.createDataFrame(dealt, "bucket INT, first INT, parts INT")
    mine = F.col("first") + F.pmod(F.xxhash64("tree_id"), F.col("parts"))
    mine = F.coalesce(mine, F.pmod("bucket", F.lit(nc))).cast("int")  # a bucket is new if trees come out otherwise when made again
    held = per_tree.join(F.broadcast(first), "bucket", "left").groupBy(mine.alias("b"), "s").agg(F.collect_list(F.struct("tree_id")).alias("ids"))
    held = held.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    keyed = held.select("s", "ids", "b", F.least("b", "x").alias("b1"), F.greatest("b", "x").alias("b2"))
    # more tasks than their input asks for: what they make is far larger
    keyed = keyed.repartition(min(nc * (nc + 1) // 2, PAIR_TASKS * spark.sparkContext.defaultParallelism), "b1", "b2")

    def distances(key, table):
        both = [table.filter(pc.equal(table["b"], k)) for k in key]
        held = [[x.split(",") if x else [] for x in t["s"].to_pylist()] for t in both]
        where: dict[str, tuple[list, list]] = {}
        for k, topologies in enumerate(held):
            for pos, c in enumerate(topologies):
                for s in c:
                    where.setdefault(s, ([], []))[k].append(pos)
        shared = np.zeros([len(h) for h in held], dtype=np.int32)
        for a, b in where.values():
            if a and b:
                shared[np.ix_(a, b)] += 1
        here, there = (np.array([len(c) for c in h], dtype=np.int32) for h in held)
        rf = here[:, None] + there[None, :] - 2 * shared
        (left, n), (right, m) = ((t.flatten().flatten()[0], pc.list_value_length(t).to_numpy()) for t in (t["ids"].combine_chunks() for t in both))
        step, end = max(1, PAIRS_AT_ONCE // len(right)), np.cumsum(n)
        cut = [np.arange(e - k, e, step) for k, e in zip(n, end, strict=True)]  # a row has trees of one topology on the left
        of, cut = np.repeat(np.arange(len(n)), [len(x) for x in cut]), np.concatenate(cut)
        lists = lambda values, off: pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)
        every = np.arange(len(cut) + 1) * len(right)
        return pa.table({
            "first": pa.array(cut if key[0] == key[1] else cut - len(left), pa.int32()),
            "left": lists(left, [*cut, len(left)]),
            "right": lists(pa.concat_arrays([right] * len(cut)), every),
            "rf": lists(pa.array(np.repeat(rf, m, axis=1)[of].ravel()), every)})

    out = keyed.groupBy("b1", "b2").applyInArrow(distances, f"first INT, left ARRAY<{kind}>, right ARRAY<{kind}>, rf ARRAY<INT>")
    # off the diagonal positions of the left are below 0, so that all pairs count
    out = out.select("*", F.posexplode("left").alias("p", "i")).select("*", F.posexplode("right").alias("q", "j")).where("first + p < q")
    rf = F.get("rf", F.col("q")).cast("bigint")
    later = F.when(F.col("i").isNotNull() & F.col("j").isNotNull(), F.greatest("i", "j"))  # a missing id is the last
    return out.select(F.least("i", "j").alias("tree_i"), later.alias("tree_j"), rf.alias("rf")).withColumn("rrf", relative(F.col("rf"), n_taxa))


def support_fbp(reference: DataFrame, splits: DataFrame, n_trees: int | None = None,
                trees: DataFrame | None = None) -> DataFrame:
    """Share of replicate trees that hold each reference split.

    Replicate splits are cut down to the reference's n-3 before they are counted.
    """
    ref = reference.select("split").distinct()
    n = split_counts(splits.join(ref, "split", "left_semi"))
    total = trees.agg(F.count(F.lit(1))).scalar() if trees is not None else F.lit(n_trees)
    share = F.coalesce("n", F.lit(0)) / F.col("_t")
    return ref.join(n, "split", "left").withColumn("_t", total).select(
        "split", share.alias("support"), F.floor(share * 100 + 0.5).cast("bigint").alias("percent"))


def support_tbe(reference: Sequence[str], splits: DataFrame, trees: DataFrame) -> DataFrame:
    """Transfer support: 1 - mean over trees of the smallest transfer distance / (p - 1).

    A tree without splits has no rows in ``splits``; its distance is p - 1 everywhere.

    The reference tree's splits (n-3, a driver-side tree) go with the task; each tree's
    distances are one matrix product, and only per-task sums are shuffled.
    """
    ref = sorted(set(reference))
    b = np.array([nw.bits(s) for s in ref], dtype=np.float32)
    n = b.shape[1]
    size = b.sum(axis=1)
    light = np.minimum(size, n - size)
    per_tree = splits.groupBy("tree_id").agg(F.collect_list("split").alias("s"))

    def sums(it):
        total, k = np.zeros(len(ref)), 0
        for pdf in it:
            for held in pdf.s:
                c = np.array([nw.bits(s) for s in held], dtype=np.float32)
                d = size[:, None] + c.sum(axis=1)[None, :] - 2 * (b @ c.T)
                # a tip branch of the replicate is always within p - 1 transfers
                total += np.minimum(np.minimum(d, n - d).min(axis=1), light - 1)
                k += 1
        yield pd.DataFrame({"split": ref, "d": total, "k": k})

    part = per_tree.mapInPandas(sums, "split STRING, d DOUBLE, k BIGINT").groupBy("split").agg(F.sum("d").alias("d"), F.sum("k").alias("k"))
    p = F.least(F.length(F.translate("split", "1", "")), F.length(F.translate("split", "0", "")))
    found = splits.sparkSession.createDataFrame([(x,) for x in ref], "split STRING").join(part, "split", "left").withColumn(
        "_t", trees.agg(F.count(F.lit(1))).scalar())
    none = F.col("_t") - F.coalesce("k", F.lit(0))
    return found.select("split", (1 - (F.coalesce("d", F.lit(0.0)) / (p - 1) + none) / F.col("_t")).alias("support"))


def draw_support(tree: str, support: DataFrame, labels: Sequence[str], text: str = "percent") -> DataFrame:
    """Reference tree with support values at its inner nodes, as a one-row table.

    The support rows are one per reference split, the size of the tree itself.
    """
    index = {x: i for i, x in enumerate(labels)}
    one = support.agg(F.collect_list(F.struct("split", F.col(text).cast("string").alias("v"))).alias("l"))

    def run(it):
        for pdf in it:
            for lst in pdf.l:
                val = {x["split"]: x["v"] for x in lst}
                t = nw.parse(tree)
                names = {v: val.get(s, "") for s, v in nw.splits(t, index)}
                yield pd.DataFrame({"newick": [nw.write(t, inner=names)]})

    return one.mapInPandas(run, "newick STRING")


# -- consensus --------------------------------------------------------------------------

def consensus_cutoff(counts: DataFrame, n_trees: Column | int, cutoff: float) -> DataFrame:
    """Splits in more than ``cutoff`` of the trees; exactly all of them for cutoff 1."""
    f = F.col("n") / n_trees
    return counts.where(f >= 1.0 if cutoff >= 1 else f > cutoff)


def consensus_mre(counts: DataFrame, n_trees: int, n_taxa: int) -> DataFrame:
    """Extended majority rule: add compatible splits by falling support until resolved.

    Majority splits are mutually compatible and at most n-3.  The rest are filtered in
    parallel against everything accepted, and only a bounded best batch of the survivors is
    ranked centrally per round; an accepted batch prunes the pool for the next one, until
    the tree is full or the pool is empty, so no candidate is ever skipped.  The counts are
    kept for the rounds, which so don't parse the trees again.
    """
    spark = counts.sparkSession
    counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    rank = [F.col("n").desc(), F.col("split")]
    taken = [(r.split, r.n) for r in counts.where(F.col("n") / n_trees > 0.5).collect()]
    pool = counts.where(F.col("n") / n_trees <= 0.5)
    last: tuple | None = None
    while len(taken) < n_taxa - 3:
        held = np.array([nw.bits(s) for s, _ in taken], dtype=np.uint8).reshape(len(taken), n_taxa)

        def fits(it, held=held):
            for pdf in it:
                ok = [bool(nw.compatible(held, nw.bits(s)).all()) for s in pdf.split]
                yield pdf[ok]

        left = pool
        if last is not None:
            left = left.where((F.col("n") < last[1]) | ((F.col("n") == last[1]) & (F.col("split") > last[0])))
        batch = left.mapInPandas(fits, "split STRING, n BIGINT").orderBy(*rank).limit(GREEDY_BATCH).collect()
        for r in batch:
            m = np.array([nw.bits(s) for s, _ in taken], dtype=np.uint8).reshape(len(taken), n_taxa)
            if nw.compatible(m, nw.bits(r.split)).all():
                taken.append((r.split, r.n))
                if len(taken) == n_taxa - 3:
                    break
        if len(batch) < GREEDY_BATCH:
            break
        last = (batch[-1].split, batch[-1].n)
    counts.unpersist()
    return spark.createDataFrame(taken, "split STRING, n BIGINT")


def consensus_splits(splits: DataFrame, n_trees: int, n_taxa: int, kind: str = "MR") -> DataFrame:
    """``STRICT``, ``MR``, ``MR<50..100>`` or ``MRE`` -> (split, n, freq)."""
    counts = split_counts(splits)
    k = kind.upper()
    if k == "MRE":
        out = consensus_mre(counts, n_trees, n_taxa)
    elif k == "STRICT":
        out = consensus_cutoff(counts, n_trees, 1.0)
    elif k.startswith("MR"):
        pct = int(k[2:] or 50)
        if not 50 <= pct <= 100:
            raise ValueError(f"consensus cutoff must be within 50..100: {kind}")
        out = consensus_cutoff(counts, n_trees, pct / 100)
    else:
        raise ValueError(f"unknown consensus type: {kind}")
    return out.select("split", "n", (F.col("n") / n_trees).alias("freq"))


def consensus_tree(consensus: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Consensus splits (at most n-3 rows) -> one Newick row with percent labels."""
    names = list(labels)
    one = consensus.agg(F.collect_list(F.struct("split", F.floor(F.col("freq") * 100 + 0.5).cast("int").cast(
        "string").alias("v"))).alias("l"))

    def run(it):
        for pdf in it:
            yield pd.DataFrame({"newick": [nw.from_splits({x["split"]: x["v"] for x in lst}, names) for lst in pdf.l]})

    return one.mapInPandas(run, "newick STRING")


# -- bootstrap convergence (see halves) --------------------------------------------------

def check_metric(name: str) -> str:
    if name.lower() in ("automr", "autofc"):
        raise NotImplementedError(f"bootstopping criterion {name} is not supported; use autoMRE")
    return name
