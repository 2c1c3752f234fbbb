"""Operators on tables of Newick trees: one row per tree in, rows per node/edge/split out."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import newick as nw


def _per_tree(trees: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn(tree_id, text) -> list of rows`` to Arrow batches of trees; narrow."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(it):
        for pdf in it:
            rows = [r for i, s in zip(pdf.tree_id, pdf.newick) for r in fn(i, s)]
            yield pd.DataFrame(rows, columns=names)

    return trees.select("tree_id", "newick").mapInPandas(run, schema)


def _id_type(trees: DataFrame) -> str:
    return dict(trees.dtypes)["tree_id"].upper()


def tree_edges(trees: DataFrame) -> DataFrame:
    """(tree_id, node, parent, label, length, is_tip); the root row has parent -1."""
    def rows(i, s):
        t = nw.parse(s)
        tip = set(t.tips())
        return [(i, v, t.parent[v], t.label[v], None if np.isnan(t.length[v]) else t.length[v], v in tip)
                for v in range(len(t.parent))]

    return _per_tree(trees, rows, f"tree_id {_id_type(trees)}, node INT, parent INT, label STRING, length DOUBLE, is_tip BOOLEAN")


def tree_tips(trees: DataFrame) -> DataFrame:
    return tree_edges(trees).where("is_tip").select("tree_id", "label", "length")


def tree_splits(trees: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Nontrivial bipartitions of every tree, over the taxa in ``labels`` (in that order)."""
    index = {x: i for i, x in enumerate(labels)}

    def rows(i, s):
        t = nw.parse(s)
        return [(i, sp, None if np.isnan(t.length[v]) else t.length[v], t.label[v]) for sp, v in nw.splits(t, index)]

    return _per_tree(trees, rows, f"tree_id {_id_type(trees)}, split STRING, length DOUBLE, label STRING")


def tree_shape(trees: DataFrame) -> DataFrame:
    """Counts that follow from the tips, and whether the tree is fully resolved."""
    e = tree_edges(trees)
    deg = e.groupBy("tree_id", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("k")).where("node >= 0")
    worst = deg.groupBy("tree_id").agg(F.max(F.col("k") - F.when(F.col("node") == 0, 3).otherwise(2)).alias("_x"),
                                       F.min(F.col("k") - F.when(F.col("node") == 0, 3).otherwise(2)).alias("_y"))
    n = e.where("is_tip").groupBy("tree_id").agg(F.count(F.lit(1)).alias("tips"))
    return n.join(worst, "tree_id").select(
        "tree_id", "tips", (F.col("tips") - 2).alias("inner_nodes"), (2 * F.col("tips") - 3).alias("branches"),
        (F.col("tips") - 3).alias("splits"), ((F.col("_x") == 0) & (F.col("_y") == 0)).alias("is_binary"))


def fill_lengths(trees: DataFrame, length: float = nw.DEFAULT_LENGTH, everywhere: bool = False,
                 precision: int = 6) -> DataFrame:
    """Missing (or all) branch lengths set to a constant."""
    def rows(i, s):
        t = nw.parse(s)
        t.length = [length if everywhere or np.isnan(x) else x for x in t.length]
        return [(i, nw.write(t, precision))]

    return _per_tree(trees, rows, f"tree_id {_id_type(trees)}, newick STRING")


def topology_only(trees: DataFrame) -> DataFrame:
    return _per_tree(trees, lambda i, s: [(i, nw.write(nw.parse(s), lengths=False))],
                     f"tree_id {_id_type(trees)}, newick STRING")


def average_lengths(edge_lengths: DataFrame, shares: DataFrame) -> DataFrame:
    """(edge, part_id, length) and partition shares -> weighted mean length per edge."""
    j = edge_lengths.join(shares, "part_id")
    keys = [c for c in edge_lengths.columns if c not in ("part_id", "length")]
    return j.groupBy(*keys).agg((F.sum(F.col("length") * F.col("share")) / F.sum("share")).alias("length"))


def partition_lengths(edges: DataFrame, part: int) -> DataFrame:
    """Edges with ``brlens`` ARRAY<DOUBLE> (one per partition) -> those of one partition."""
    return edges.withColumn("length", F.element_at("brlens", part + 1)).drop("brlens")


def reroot(trees: DataFrame, outgroup: Sequence[str], root_node: bool = True, precision: int = 6) -> DataFrame:
    """Root on the branch that separates the outgroup; ``monophyletic`` tells if there is one.

    A scattered outgroup is rooted on its first taxon, as a drawing aid.
    """
    out = list(outgroup)

    def rows(i, s):
        t = nw.parse(s)
        labels = [t.label[v] for v in t.tips()]
        index = {x: k for k, x in enumerate(labels)}
        m = nw.clade_matrix(t, index)
        want = np.zeros(len(labels), dtype=np.uint8)
        want[[index[o] for o in out]] = 1
        hit = [v for v in range(1, len(t.parent)) if (m[v] == want).all() or (m[v] == 1 - want).all()]
        v = hit[0] if hit else next(u for u in t.tips() if t.label[u] == out[0])
        r = nw.rerooted(t, v, True) if root_node else nw.rerooted(t, t.parent[v])
        return [(i, bool(hit), nw.write(r, precision))]

    return _per_tree(trees, rows, f"tree_id {_id_type(trees)}, monophyletic BOOLEAN, newick STRING")


def random_trees(ids: DataFrame, labels: Sequence[str], seed: int = 1, constraint: str | None = None) -> DataFrame:
    """A uniformly grown random topology per row of ``ids(tree_id)``; seeded by (seed, row hash).

    With a constraint, its multifurcations are resolved at random first and the remaining
    taxa are then attached to random branches, so every constraint split survives.
    """
    names = list(labels)

    def run(it):
        for pdf in it:
            text = [grow(names, np.random.Generator(np.random.Philox(key=[seed, int(k) & (2**63 - 1)])), constraint)
                    for k in pdf._k]
            yield pd.DataFrame({"tree_id": pdf.tree_id, "newick": text})

    return ids.select("tree_id", F.xxhash64("tree_id").alias("_k")).mapInPandas(
        run, f"tree_id {_id_type(ids)}, newick STRING")


def grow(names: list[str], rng: np.random.Generator, constraint: str | None = None) -> str:
    """Edges of a growing tree as child -> parent; attaching a tip subdivides one edge."""
    up: dict[int, int] = {}
    label: dict[int, str] = {}
    fresh = iter(range(1, 10 * len(names) + 100))
    if constraint:
        t = nw.parse(constraint)
        kids = t.children()
        ids = [0] + [next(fresh) for _ in range(1, len(t.parent))]
        for v in range(1, len(t.parent)):
            up[ids[v]] = ids[t.parent[v]]
            if not kids[v]:
                label[ids[v]] = t.label[v]
        for v, ks in enumerate(kids):
            group = [ids[k] for k in ks]
            while len(group) > (3 if v == 0 else 2):
                a, b = rng.choice(len(group), size=2, replace=False)
                x, y, m = group[a], group[b], next(fresh)
                up[x] = up[y] = m
                up[m] = ids[v]
                group = [g for g in group if g not in (x, y)] + [m]
        rest = [n for n in names if n not in set(label.values())]
        rng.shuffle(rest)
    else:
        rest = list(names)
        rng.shuffle(rest)
        for n in rest[:3]:
            k = next(fresh)
            up[k], label[k] = 0, n
        rest = rest[3:]
    for n in rest:
        edges = list(up)
        e = edges[int(rng.integers(len(edges)))]
        m, k = next(fresh), next(fresh)
        up[m], up[e], up[k], label[k] = up[e], m, m, n
    return nw.write(from_parents(up, label), lengths=False)


def from_parents(up: dict[int, int], label: dict[int, str], length: dict[int, float] | None = None) -> nw.Tree:
    """child -> parent map (root 0) to a tree in preorder."""
    kids: dict[int, list[int]] = {}
    for v, p in up.items():
        kids.setdefault(p, []).append(v)
    t = nw.Tree()
    todo = [(0, -1)]
    while todo:
        v, p = todo.pop()
        me = t.add(p, label.get(v, ""), (length or {}).get(v, np.nan))
        todo.extend((k, me) for k in reversed(kids.get(v, [])))
    return t


def rename_tips(trees: DataFrame, names: dict[str, str]) -> DataFrame:
    def rows(i, s):
        t = nw.parse(s)
        t.label = [names.get(x, x) for x in t.label]
        return [(i, nw.write(t))]

    return _per_tree(trees, rows, f"tree_id {_id_type(trees)}, newick STRING")


def normalise_tips(tips: DataFrame, taxa: DataFrame) -> DataFrame:
    """Tip labels -> alignment ids (unknown tips get a null id)."""
    return tips.join(taxa.select("taxon_id", "label"), "label", "left")


def best_tree(scored: DataFrame) -> DataFrame:
    """The tree of highest log-likelihood (smallest id on ties): one map-side combined row."""
    key = F.struct(F.col("loglh"), (-F.col("tree_id")).alias("_neg"))
    return scored.agg(F.max_by("tree_id", key).alias("tree_id"), F.max("loglh").alias("loglh"),
                      F.max_by("newick", key).alias("newick"))


def remaining(todo: DataFrame, done: DataFrame, key: str = "tree_id") -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")
