"""Bootstrap convergence by running counts: every tree is added once, whatever the number of checks.

A permutation deals the trees into two halves pair by pair: of trees 2k and 2k + 1 a hash of (k, permutation) sends one to
either half.  So a tree's half never changes, halves of every even prefix are equal and those of an odd one differ by one.
Per permutation it is enough to keep how often each split came in half 1, and how often it came at all.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import newick as nw
from cladeframe.functions.rng import P, with_hash31

#: Permutations whose counts one task keeps; trees travel once for each such block.
BLOCK = 25
#: Compatibility of all pairs is kept for so many splits; beyond, it is told when asked.
PAIRS_KEPT = 1024


def halves(trees: DataFrame, permutations: int, seed: int = 1) -> DataFrame:
    """(tree_no, perm, half) of trees numbered from 0."""
    t = trees.select("tree_no", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))).alias("perm"))
    t = with_hash31(t, "_h", F.col("perm"), F.floor(F.col("tree_no") / 2), seed)
    return t.withColumn("half", ((F.col("_h") + F.col("tree_no")) % 2).cast("int")).drop("_h")


def half_of(tree_no: np.ndarray | int, perms: np.ndarray, seed: int) -> np.ndarray:
    """The same halves for one tree and several permutations."""
    return ((_hash31(tree_no // 2, perms, seed) + tree_no) % 2).astype(np.int32)


def _hash31(tree_no: np.ndarray, perms: np.ndarray, seed: int) -> np.ndarray:
    s = (tree_no % P * 48271 + perms * 69621 + seed) % P
    y = s * 48271 % P
    z = (y * y + s) % P
    return (z * z + y) % P


def _runs(at: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """((order by value, the values), where each value begins in that order, how often it comes)."""
    order = np.argsort(at, kind="stable")
    value, begin, n = np.unique(at[order], return_index=True, return_counts=True)
    return (order, value), begin, n


def greedy(names: Sequence[str], n: np.ndarray, sure: np.ndarray, room: int, fits) -> np.ndarray:
    """Whether each split is accepted in each column of counts ``n``; those of a negative count aren't there.

    Splits come by falling count, ties by name; counts above the column's ``sure`` need no test, others have to fit all accepted
    ones, by the matrix ``fits`` or, where it would be too large, by a function of a split and the accepted ones.
    """
    by_name = np.argsort(np.array(names))
    ranked = by_name[np.argsort(-n[by_name], axis=0, kind="stable")]
    columns = np.arange(n.shape[1])
    held = np.zeros(n.shape[::-1], bool)
    if callable(fits):
        for c in columns:
            taken: list[int] = []
            for i in ranked[:, c].tolist():
                if len(taken) == room or n[i, c] < 0:
                    break
                if n[i, c] > sure[c] or fits(i, taken):
                    taken.append(i)
            held[c, taken] = True
        return held.T
    apart, left = ~fits, np.full(len(columns), room)
    for row in ranked:
        v = n[row, columns]
        ok = (left > 0) & (v >= 0)
        if not ok.any():
            break
        ok &= (v > sure) | ~(held & apart[row]).any(axis=1)
        held[columns[ok], row[ok]] = True
        left -= ok
    return held.T


def _apart(n: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted distance and number of splits, of the columns of the first halves and those of the second."""
    kept = np.where(held, n, 0).astype(np.int64)
    m = n.shape[1] // 2
    return np.abs(kept[:, :m] - kept[:, m:]).sum(axis=0), held[:, :m].sum(axis=0) + held[:, m:].sum(axis=0)


class HalfCounts:
    """Counts of one block of permutations over the trees added so far."""

    def __init__(self, perms: Sequence[int], n_taxa: int, seed: int):
        self.perms, self.n_taxa, self.seed = np.asarray(perms, np.int64), n_taxa, seed
        self.place: dict[str, int] = {}
        self.total = np.zeros(16, np.int32)
        self.second = np.zeros((16, len(self.perms)), np.int32)
        self._fits = np.zeros((0, 0), bool)

    def add(self, tree_no: int, splits: Iterable[str]) -> None:
        self.add_all(tree_no, [splits])

    def add_all(self, first: int, trees: Sequence[Iterable[str]]) -> None:
        """Trees numbered from ``first``; a split comes once in a tree."""
        at, tree = [], []
        for i, splits in enumerate(trees):
            new = [self.place.setdefault(s, len(self.place)) for s in splits]
            at += new
            tree += [i] * len(new)
        if not at:
            return
        if len(self.place) > len(self.total):
            more = max(len(self.place), 2 * len(self.total)) - len(self.total)
            self.total = np.concatenate([self.total, np.zeros(more, np.int32)])
            self.second = np.concatenate([self.second, np.zeros((more, len(self.perms)), np.int32)])
        where, begin, n = _runs(np.array(at))
        half = half_of(first + np.arange(len(trees))[:, None], self.perms, self.seed)
        self.total[where[1]] += n
        self.second[where[1]] += np.add.reduceat(half[np.array(tree)[where[0]]], begin, axis=0)

    def counts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Splits, and how often each came in either half (split by permutation)."""
        k = len(self.place)
        return list(self.place), self.total[:k, None] - self.second[:k], self.second[:k]

    def _compatible(self, names: list[str], bits: np.ndarray):
        if len(names) > PAIRS_KEPT:
            return lambda i, held: bool(nw.compatible(bits[held], bits[i]).all())
        if len(self._fits) < len(names):
            self._fits = np.array([nw.compatible(bits, b) for b in bits], dtype=bool)
        return self._fits

    def _held(self, trees: int) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Splits, their counts and whether they are accepted; a column per permutation for the first halves, then for the second ones."""
        names, first, second = self.counts()
        n = np.concatenate([first, second], axis=1)
        if not names:
            return names, n, n > 0
        bits = np.array([nw.bits(s) for s in names], dtype=np.uint8)
        return names, n, greedy(names, n, np.full(n.shape[1], trees // 4), self.n_taxa - 3, self._compatible(names, bits))

    def consensus(self, trees: int) -> Iterator[tuple[int, int, list[tuple[str, int]]]]:
        """(permutation, half, accepted splits with their counts): greedy consensus of each half of the ``trees`` added.

        Splits come by falling count, ties by name; more than a quarter of all trees is a majority of the half.
        """
        names, n, held = self._held(trees)
        if not names:
            return
        for p, perm in enumerate(self.perms.tolist()):
            for half, c in enumerate((p, p + len(self.perms))):
                yield perm, half, [(names[i], int(n[i, c])) for i in np.flatnonzero(held[:, c])]

    def distances(self, trees: int) -> Iterator[tuple[int, int, int]]:
        """(permutation, distance of both consensus trees weighted by counts, number of their splits)."""
        names, n, held = self._held(trees)
        if names:
            yield from zip(self.perms.tolist(), *(x.tolist() for x in _apart(n, held)))

    def dump(self) -> bytes:
        names, _, second = self.counts()
        return pickle.dumps((self.perms, self.n_taxa, self.seed, names, self.total[: len(names)], second), protocol=5)

    @classmethod
    def load(cls, data: bytes) -> HalfCounts:
        perms, n_taxa, seed, names, total, second = pickle.loads(data)
        out = cls(perms, n_taxa, seed)
        out.place = {s: i for i, s in enumerate(names)}
        out.total, out.second = total.copy(), second.copy()
        return out


def in_blocks(splits: DataFrame, trees: DataFrame, permutations: int) -> DataFrame:
    """(block, tree_no, splits): every tree once for each block of permutations."""
    held = trees.select("tree_no").join(splits.groupBy("tree_no").agg(F.collect_list("split").alias("splits")), "tree_no", "left")
    return blocks_of(held, permutations)


def blocks_of(held: DataFrame, permutations: int) -> DataFrame:
    return held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // BLOCK))))


def perms_of(block: int, permutations: int) -> range:
    return range(block * BLOCK, min(permutations, (block + 1) * BLOCK))


def _checked(blocks: DataFrame, permutations: int, prefixes: Sequence[int], n_taxa: int, seed: int, schema: str, rows) -> DataFrame:
    """``rows(counts, prefix)`` of each block at each prefix, over trees that come in order: a task holds the counts of one block."""
    due = sorted(set(prefixes))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, counts, added, left = None, None, 0, []
        for frame in frames:
            out = []
            held = [() if x is None else x for x in frame["splits"]]
            of = frame["block"].to_numpy()
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))([0, *(np.flatnonzero(np.diff(of)) + 1), len(of)])):
                if a < b and of[a] != block:
                    block, counts, added, left = int(of[a]), HalfCounts(perms_of(int(of[a]), permutations), n_taxa, seed), 0, list(due)
                while a < b:
                    m = min(b - a, left[0] - added) if left else b - a
                    counts.add_all(added, held[a : a + m])
                    added, a = added + m, a + m
                    if left and added == left[0]:
                        out += rows(counts, left.pop(0))
            yield pd.DataFrame(out, columns=names)

    n = (permutations - 1) // BLOCK + 1
    ordered = blocks.where(F.col("tree_no") < due[-1]).repartition(n, "block").sortWithinPartitions("block", "tree_no")
    return ordered.mapInPandas(run, schema)


def half_support(splits: DataFrame, trees: DataFrame, n_taxa: int, prefixes: Sequence[int], permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(prefix, perm, split, n0, n1): how often a split came in either half of the first ``prefix`` trees."""
    def rows(c: HalfCounts, prefix: int):
        names, first, second = c.counts()
        return [(prefix, p, s, int(first[i, k]), int(second[i, k])) for i, s in enumerate(names) for k, p in enumerate(c.perms.tolist())]

    return _checked(in_blocks(splits, trees, permutations), permutations, prefixes, n_taxa, seed, "prefix INT, perm INT, split STRING, n0 BIGINT, n1 BIGINT", rows)


def half_consensus(splits: DataFrame, trees: DataFrame, n_taxa: int, prefixes: Sequence[int], permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(prefix, perm, half, split, n): greedy consensus of either half."""
    def rows(c: HalfCounts, prefix: int):
        return [(prefix, p, h, s, n) for p, h, kept in c.consensus(prefix) for s, n in kept]

    return _checked(in_blocks(splits, trees, permutations), permutations, prefixes, n_taxa, seed, "prefix INT, perm INT, half INT, split STRING, n BIGINT", rows)


WRF = "prefix INT, perm INT, wrf BIGINT, n_splits BIGINT"


def weighted_rf(blocks: DataFrame, n_taxa: int, prefixes: Sequence[int], permutations: int = 1000, seed: int = 1) -> DataFrame:
    """(prefix, perm, wrf, n_splits) of trees ``in_blocks``: sum of the differences of counts over the splits of both halves' consensus."""
    def rows(c: HalfCounts, prefix: int):
        return [(prefix, p, wrf, n) for p, wrf, n in c.distances(prefix)]

    return _checked(blocks, permutations, prefixes, n_taxa, seed, WRF, rows)


def convergence(wrf: DataFrame, permutations: int, cutoff: float = 0.03) -> DataFrame:
    """Verdict per prefix: enough permutations below their threshold, and the mean as well."""
    half_total = 0.5 * F.col("prefix") * F.col("n_splits")
    limit = cutoff * half_total
    agg = wrf.groupBy("prefix").agg(
        F.avg("wrf").alias("avg_wrf"), F.avg(F.try_divide(F.col("wrf"), half_total) * 100).alias("avg_pct"),
        F.count(F.when(F.col("wrf") <= limit, 1)).alias("better"), F.avg(limit).alias("_t"))
    ok: Column = (F.col("better") >= int(0.99 * permutations)) & (F.col("avg_wrf") <= F.col("_t"))
    return agg.select(F.col("prefix").alias("trees"), "avg_wrf", "avg_pct", "better", ok.alias("converged"))


def bootstop(splits: DataFrame, trees: DataFrame, n_taxa: int, prefixes: Sequence[int],
             permutations: int = 1000, cutoff: float = 0.03, seed: int = 1) -> DataFrame:
    """Convergence table over growing prefixes of the replicate trees; linear in trees, for all prefixes together."""
    return convergence(weighted_rf(in_blocks(splits, trees, permutations), n_taxa, prefixes, permutations, seed), permutations, cutoff)


# -- halves shuffled anew for every prefix ----------------------------------------------

#: Pairs of a permutation and a prefix whose counts one task keeps; trees travel once for each so many.
PAIRS = 100


def _pairs(prefixes: Sequence[int], permutations: int) -> list[list[tuple[int, int]]]:
    """(permutation, prefix) by task: neighbouring prefixes of one permutation together, as their order is made once."""
    every = [(p, b) for p in range(permutations) for b in sorted(set(prefixes))]
    return [every[i : i + PAIRS] for i in range(0, len(every), PAIRS)]


def _orders(pairs: Sequence[tuple[int, int]], seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(permutation, prefix, its trees by their place): the order needs tree numbers only, no trees."""
    perm, order = None, np.zeros(0, np.int64)
    for p, prefix in pairs:
        if p != perm:
            perm, most = p, max(b for q, b in pairs if q == p)
            order = np.argsort(_hash31(np.arange(most), np.int64(p), seed), kind="stable")
        yield p, prefix, order[order < prefix]


def shuffled_halves(trees: DataFrame, permutations: int, prefixes: Sequence[int], seed: int = 1) -> DataFrame:
    """(prefix, perm, tree_no, half) of each prefix of the trees, numbered from 0: the parity of a tree's place by a hash.

    The trees of a prefix are shuffled for each permutation, so a tree's half depends on the prefix, and there is a row per prefix,
    permutation and tree: its output is quadratic in the number of trees.  A task holds numbers of trees, 8 bytes each.
    """
    every = _pairs(prefixes, permutations)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for task in frame["id"]:
                for p, prefix, order in _orders(every[task], seed):
                    yield pd.DataFrame({"prefix": prefix, "perm": p, "tree_no": order, "half": np.arange(prefix) % 2})

    n = len(every)
    return trees.sparkSession.range(0, n, 1, n).mapInPandas(run, "prefix INT, perm INT, tree_no BIGINT, half INT")


def _shuffled(splits: DataFrame, trees: DataFrame, permutations: int, prefixes: Sequence[int], seed: int, schema: str, rows) -> DataFrame:
    """``rows(pairs, names, first, second, there)`` of each task's pairs; counts are (split by pair).

    Trees come in any order and pass by: a task keeps the half of each tree number for its pairs, and their counts.
    """
    every, names = _pairs(prefixes, permutations), [c.split()[0] for c in schema.split(", ")]
    held = splits.groupBy("tree_no").agg(F.collect_list("split").alias("splits"))
    keyed = held.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(len(every) - 1))))

    def told(task: int, place: dict[str, int], total: np.ndarray, second: np.ndarray) -> pd.DataFrame:
        k = len(place)
        return pd.DataFrame(rows(every[task], list(place), total[:k] - second[:k], second[:k], total[:k] > 0) if k else [], columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, place, half, within, total, second = None, {}, None, None, None, None
        for frame in frames:
            of = frame["task"].to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if of[a] != task:
                    if task is not None:
                        yield told(task, place, total, second)
                    task, place = int(of[a]), {}
                    pairs = every[task]
                    half = np.zeros((max(x for _, x in pairs), len(pairs)), np.int8)
                    for j, (_, _, order) in enumerate(_orders(pairs, seed)):
                        half[order[1::2], j] = 1
                    within = np.array([x for _, x in pairs])
                    total, second = (np.zeros((64, len(pairs)), np.int32) for _ in range(2))
                at, tree = [], []
                for no, s in zip(frame["tree_no"].to_numpy()[a:b].tolist(), frame["splits"].to_numpy()[a:b]):
                    if no < len(half):
                        at += [place.setdefault(x, len(place)) for x in s]
                        tree += [no] * len(s)
                if not at:
                    continue
                while len(place) > len(total):
                    total, second = (np.concatenate([x, np.zeros_like(x)]) for x in (total, second))
                (order, value), begin, _ = _runs(np.array(at))
                no = np.array(tree)[order]
                total[value] += np.add.reduceat(no[:, None] < within, begin, axis=0, dtype=np.int32)
                second[value] += np.add.reduceat(half[no] * (no[:, None] < within), begin, axis=0, dtype=np.int32)
        if task is not None:
            yield told(task, place, total, second)

    return keyed.repartition(len(every), "task").sortWithinPartitions("task").mapInPandas(run, schema)


def _consensus_of(pairs, names: list[str], first: np.ndarray, second: np.ndarray, there: np.ndarray, n_taxa: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and accepted splits, a column per pair for the first halves, then for the second ones."""
    bits = np.array([nw.bits(s) for s in names], dtype=np.uint8)
    if len(names) > PAIRS_KEPT:
        fits = lambda i, held: bool(nw.compatible(bits[held], bits[i]).all())
    else:
        fits = np.array([nw.compatible(bits, b) for b in bits], dtype=bool)
    n = np.concatenate([np.where(there, first, -1), np.where(there, second, -1)], axis=1)
    return n, greedy(names, n, np.tile([b // 4 for _, b in pairs], 2), n_taxa - 3, fits)


def shuffled_support(splits: DataFrame, trees: DataFrame, n_taxa: int, prefixes: Sequence[int], permutations: int = 1000, seed: int = 1) -> DataFrame:
    """``half_support`` with halves shuffled anew for every prefix."""
    def rows(pairs, names, first, second, there):
        return [(b, p, names[i], int(first[i, j]), int(second[i, j])) for j, (p, b) in enumerate(pairs) for i in np.flatnonzero(there[:, j])]

    return _shuffled(splits, trees, permutations, prefixes, seed, "prefix INT, perm INT, split STRING, n0 BIGINT, n1 BIGINT", rows)


def shuffled_consensus(splits: DataFrame, trees: DataFrame, n_taxa: int, prefixes: Sequence[int], permutations: int = 1000, seed: int = 1) -> DataFrame:
    """``half_consensus`` with halves shuffled anew for every prefix."""
    def rows(pairs, names, first, second, there):
        n, held = _consensus_of(pairs, names, first, second, there, n_taxa)
        m = len(pairs)
        return [(pairs[c % m][1], pairs[c % m][0], int(c >= m), names[i], int(n[i, c])) for c in range(2 * m) for i in np.flatnonzero(held[:, c])]

    return _shuffled(splits, trees, permutations, prefixes, seed, "prefix INT, perm INT, half INT, split STRING, n BIGINT", rows)


def shuffled_rf(splits: DataFrame, trees: DataFrame, n_taxa: int, prefixes: Sequence[int], permutations: int = 1000, seed: int = 1) -> DataFrame:
    """``weighted_rf`` with halves shuffled anew for every prefix."""
    def rows(pairs, names, first, second, there):
        wrf, k = _apart(*_consensus_of(pairs, names, first, second, there, n_taxa))
        return [(b, p, int(w), int(x)) for (p, b), w, x, any_ in zip(pairs, wrf, k, there.any(axis=0)) if any_]

    return _shuffled(splits, trees, permutations, prefixes, seed, WRF, rows)


def shuffled_bootstop(splits: DataFrame, trees: DataFrame, n_taxa: int, prefixes: Sequence[int],
                      permutations: int = 1000, cutoff: float = 0.03, seed: int = 1) -> DataFrame:
    """``bootstop`` with halves shuffled anew for every prefix: work is prefixes x permutations x trees."""
    return convergence(shuffled_rf(splits, trees, n_taxa, prefixes, permutations, seed), permutations, cutoff)


def until_converged(told: DataFrame) -> DataFrame:
    """Rows up to and including the first prefix that converged."""
    first = told.where("converged").agg(F.min("trees")).scalar()
    return told.withColumn("_stop", first).where(F.col("_stop").isNull() | (F.col("trees") <= F.col("_stop"))).drop("_stop")


REPORT = "trees INT, avg_wrf DOUBLE, avg_pct DOUBLE, better BIGINT, converged BOOLEAN"


def report(splits: DataFrame, trees: DataFrame, n_taxa: int, prefixes: Sequence[int],
           permutations: int = 1000, cutoff: float = 0.03, seed: int = 1) -> DataFrame:
    """``bootstop`` up to the first prefix that converges.

    Prefixes are checked in rounds, each twice as long as the last, so checks beyond the stop are bounded and trees
    are counted at most about twice.  A row per prefix comes to the driver.
    """
    held = trees.select("tree_no").join(splits.groupBy("tree_no").agg(F.collect_list("split").alias("splits")), "tree_no", "left").persist(StorageLevel.MEMORY_AND_DISK)
    told: list[tuple] = []
    left, size = sorted(set(prefixes)), 2
    while left and not any(r[4] for r in told):
        now, left, size = left[:size], left[size:], 2 * size
        found = convergence(weighted_rf(blocks_of(held, permutations), n_taxa, now, permutations, seed), permutations, cutoff)
        for r in sorted(tuple(x) for x in found.collect()):
            if not any(t[4] for t in told):
                told.append(r)
    held.unpersist()
    return splits.sparkSession.createDataFrame(told, REPORT)


def report_prefixes(n_trees: int, interval: int = 50) -> list[int]:
    """Every ``interval`` trees, and the last one."""
    p = list(range(interval, n_trees + 1, interval))
    return p if p and p[-1] == n_trees else p + [n_trees]
