"""Likelihood and parsimony of trees over a distributed alignment.

The pattern table is the large side and stays partitioned: it is packed once into blocks and
persisted; every evaluation ships the (small) trees and models to the blocks and adds up one
number per tree and partition.  Many trees or parameter settings share one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.functions import newick as nw
from cladeframe.functions.kernel import Block, Rates, VectorBlock, fitch, fitch_insertions, tip_vectors
from cladeframe.functions.models import Model
from cladeframe.operators import sites as S
from cladeframe.session import parallelism

BLOCK = 4096


class Topology:
    """Unrooted tree as neighbour maps; tips are 0..n-1 in taxon order."""

    def __init__(self, near: dict[int, dict[int, float]], tips: int):
        self.near, self.tips = near, tips

    @staticmethod
    def from_newick(text: str, labels: Sequence[str], default: float = nw.DEFAULT_LENGTH) -> Topology:
        t = nw.parse(text)
        index = {x: i for i, x in enumerate(labels)}
        kids = t.children()
        ids: list[int] = []
        fresh = len(labels)
        for v in range(len(t.parent)):
            if kids[v]:
                ids.append(fresh)
                fresh += 1
            else:
                ids.append(index[t.label[v]])
        if len(set(ids)) != len(ids):
            raise ValueError("duplicate tip in tree")
        near: dict[int, dict[int, float]] = {i: {} for i in ids}
        for v in range(1, len(t.parent)):
            a, b = ids[v], ids[t.parent[v]]
            near[a][b] = near[b][a] = default if np.isnan(t.length[v]) else t.length[v]
        return Topology(near, len(labels))

    def copy(self) -> Topology:
        return Topology({v: dict(m) for v, m in self.near.items()}, self.tips)

    def rooted(self):
        """(postorder list, length above each node), hung from the neighbour of the first tip."""
        first = min(v for v in self.near if v < self.tips)
        root = next(iter(self.near[first]))
        order, length, todo = [], {}, [(root, -1)]
        while todo:
            v, p = todo.pop()
            kids = sorted(w for w in self.near[v] if w != p)
            if kids:
                order.append((v, kids))
            for w in kids:
                length[w] = self.near[v][w]
                todo.append((w, v))
        return order[::-1], length

    def set_lengths(self, length: dict[int, float]) -> Topology:
        out = self.copy()
        order, _ = out.rooted()
        for v, kids in order:
            for w in kids:
                out.near[v][w] = out.near[w][v] = float(length[w])
        return out

    def edges(self) -> list[tuple[int, int]]:
        return [(a, b) for a in self.near for b in self.near[a] if a < b]

    def newick(self, labels: Sequence[str], precision: int = 6, names: dict[int, str] | None = None) -> str:
        order, length = self.rooted()
        kids = dict(order)
        t = nw.Tree()
        inner: dict[int, str] = {}
        todo = [(order[-1][0], -1)]
        while todo:
            v, p = todo.pop()
            me = t.add(p, labels[v] if v < self.tips else "", length.get(v, np.nan))
            inner[me] = (names or {}).get(v, "")
            todo.extend((w, me) for w in reversed(kids.get(v, [])))
        return nw.write(t, precision, inner=inner if names else None)


@dataclass
class Candidate:
    """One evaluation: a tree with lengths, a model per partition, a weight row."""

    tree: Topology
    models: dict[int, Model]
    weight_row: int = 0
    lengths: dict[int, dict[int, float]] = field(default_factory=dict)  # per partition if unlinked


class PackedAlignment:
    """Blocks of patterns plus what the driver must know about the alignment (sizes, taxa)."""

    def __init__(self, blocks: DataFrame, labels: list[str], stats: dict[int, dict], lanes: int, rows: int, held: DataFrame | None = None):
        self.blocks, self.labels, self.stats, self.lanes, self.rows, self.held = blocks, labels, stats, lanes, rows, held

    def close(self) -> None:
        self.blocks.unpersist()
        if self.held is not None:
            self.held.unpersist()


def statistics(patterns: DataFrame, model: Model | dict[int, Model]) -> dict[int, dict]:
    """Statistics per partition, each under the alphabet of its model (one row per partition)."""
    if isinstance(model, Model):
        return {r["part_id"]: r.asDict() for r in S.part_stats(patterns, model.alphabet).collect()}
    groups: dict[str, list[int]] = {}
    for p, m in model.items():
        groups.setdefault(m.datatype_name + m.custom[0], []).append(p)
    out = {}
    for ids in groups.values():
        rows = S.part_stats(patterns.where(F.col("part_id").isin(ids)), model[ids[0]].alphabet).collect()
        out.update({r["part_id"]: r.asDict() for r in rows})
    return out


def pack(patterns: DataFrame, labels: Sequence[str], model: Model | dict[int, Model], extra: DataFrame | None = None,
         replicates: int = 0, block: int = BLOCK, stats: dict[int, dict] | None = None) -> PackedAlignment:
    """Patterns -> persisted blocks.

    ``extra`` has replicate weights ``(replicate, part_id, pattern, weight)``; they become
    further weight rows of the same blocks, so all replicates share the decoded patterns.
    A pattern's replicate weights are at most ``replicates`` numbers.  Patterns whose statistics aren't
    told are held until the blocks are closed, so columns are compressed once.  When there are fewer
    blocks than cores the blocks are repeated as lanes that split the candidates instead.
    """
    spark = patterns.sparkSession
    n_taxa = len(labels)
    held = None
    if not stats and not (patterns.storageLevel.useMemory or patterns.storageLevel.useDisk):
        held = patterns = patterns.persist(StorageLevel.MEMORY_AND_DISK)
    st = stats or statistics(patterns, model)
    total = sum(r["pattern_count"] for r in st.values())
    cores = parallelism(spark)
    # whole waves of equal blocks: every core gets the same share of patterns
    waves = max(1, -(-total // (cores * block)))
    size = int(max(256, -(-total // (cores * waves))))
    n_blocks = sum(max(1, -(-r["pattern_count"] // size)) for r in st.values())
    lanes = max(1, cores // n_blocks)
    df = patterns.select("part_id", "pattern", "weight")
    if extra is not None:
        per = extra.groupBy("part_id", "pattern").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "weight"))).alias("m"))
        vec = F.transform(F.sequence(F.lit(0), F.lit(replicates - 1)), lambda r: F.coalesce(F.element_at("m", r), F.lit(0)))
        df = df.join(per, ["part_id", "pattern"], "left").select(
            "part_id", "pattern", "weight", F.coalesce(vec, F.array_repeat(F.lit(0).cast("bigint"), replicates)).alias("w"))
    rows = 1 + replicates

    # blocks are homogeneous in partition: rows of a block are brought together and the
    # tasks only cut what arrives in order
    first, blocks_of = 0, []
    for p, r in sorted(st.items()):
        k = max(1, -(-r["pattern_count"] // size))
        blocks_of.append((p, first, k))
        first += k
    layout = F.create_map(*[x for p, a, k in blocks_of for x in (F.lit(p), F.struct(F.lit(a).alias("a"), F.lit(k).alias("k")))])
    lay = F.element_at(layout, F.col("part_id"))
    df = df.withColumn("_block", (lay["a"] + F.pmod(F.xxhash64("pattern"), lay["k"])).cast("int"))

    def build(it):
        for pdf in it:
            for (part, _), g in pdf.groupby(["part_id", "_block"], sort=False):
                for i in range(0, len(g), 2 * size):
                    s = g.iloc[i:i + 2 * size]
                    w = np.empty((rows, len(s)))
                    w[0] = s.weight.to_numpy()
                    if rows > 1:
                        w[1:] = np.stack(list(s.w)).T
                    codes = "".join(s.pattern).encode("latin-1")
                    yield pd.DataFrame({"part_id": [part], "n": [len(s)], "codes": [codes], "weights": [w.tobytes()]})

    # one task per core unless that is too much for its memory; a pass is run many times and
    # every Python task costs a fixed start-up, so more and smaller tasks only add latency
    bytes_total = total * (n_taxa + 8 * rows)
    n_tasks = int(min(n_blocks, max(cores, bytes_total // (64 << 20))))
    task = F.pmod(F.col("_block"), F.lit(n_tasks)).cast("int")
    blocks = df.repartitionById(n_tasks, task).sortWithinPartitions("part_id", "_block").mapInPandas(
        build, "part_id INT, n INT, codes BINARY, weights BINARY")
    if lanes > 1:
        blocks = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(cores)
    else:
        blocks = blocks.withColumn("lane", F.lit(0))
    # several partitions may leave more blocks than planned; they only make tasks finer
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
    return PackedAlignment(blocks, list(labels), st, lanes, rows, held)


def pack_vectors(columns: DataFrame, labels: Sequence[str], stats: dict[int, dict], block: int = BLOCK) -> PackedAlignment:
    """Columns ``(vectors)`` of one probability vector per taxon -> persisted blocks, each column a pattern of weight 1.

    If any probability is above one, all vectors are divided by their sums.  Vectors of different length are an error.  Columns of
    a large table are cut where they lie, those of a small one are dealt to all cores first.
    """
    spark = columns.sparkSession
    (part, one), = stats.items()
    n_taxa, states = len(labels), len(one["base_freqs"])
    top = columns.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("vectors", lambda v: F.array_max(v)))).alias("top"),
                      F.count_if(F.exists("vectors", lambda v: F.size(v) != states) | (F.size("vectors") != n_taxa)).alias("odd")).first()
    if top["odd"]:
        raise ValueError(f"{top['odd']} columns don't have {n_taxa} vectors of {states} probabilities")
    normalise = (top["top"] or 0) > 1
    rows = max(1, min(block, (8 << 20) // (8 * n_taxa * states)))

    def build(it):
        for pdf in it:
            for i in range(0, len(pdf), rows):
                x = np.stack([np.concatenate(c) for c in pdf.vectors.iloc[i:i + rows]]).astype(np.float64)
                x = tip_vectors(x.reshape(-1, n_taxa, states), normalise)
                yield pd.DataFrame({"part_id": [part], "n": [len(x)], "codes": [x.tobytes()], "weights": [np.ones(len(x)).tobytes()]})

    cores = parallelism(spark)
    spread = columns.select("vectors")
    if top["n"] < 16 * cores * rows:  # may lie in fewer pieces than there are cores
        spread = spread.repartition(cores)
    blocks = spread.mapInPandas(build, "part_id INT, n INT, codes BINARY, weights BINARY").withColumn("lane", F.lit(0))
    return PackedAlignment(blocks.persist(StorageLevel.MEMORY_AND_DISK), list(labels), stats, 1, 1)


def _decode(codes: bytes, weights: bytes, n: int, n_taxa: int):
    """Symbols (columns, taxa) or vectors (columns, taxa, states) of a block, and its weight rows."""
    w = np.frombuffer(weights).reshape(-1, n)
    if len(codes) == n * n_taxa:
        return np.frombuffer(codes, dtype=np.uint8).reshape(n, n_taxa), w
    return np.frombuffer(codes).reshape(n, n_taxa, -1), w


def _block(x: np.ndarray, m: Model) -> Block:
    return Block(x, m.alphabet.table(), m.states) if x.ndim == 2 else VectorBlock(x)


def _payload(cands: Sequence[Candidate]):
    """Compact form for the tasks; equal subtrees get equal keys, exactly, by interning."""
    intern: dict = {}
    model_ids: dict[int, int] = {}
    models: list[Model] = []
    out = []
    for c in cands:
        order, length = c.tree.rooted()
        mids = {}
        for p, m in c.models.items():
            if id(m) not in model_ids:
                model_ids[id(m)] = len(models)
                models.append(m)
            mids[p] = model_ids[id(m)]
        keys: dict = {}
        for v, kids in order:
            sig = tuple(sorted((keys.get(k, -1 - k), length[k]) for k in kids))
            keys[v] = intern.setdefault(sig, len(intern))
        out.append((order, length, mids, keys, c.weight_row, c.lengths))
    return out, models


def _tasks(al: PackedAlignment, cands: Sequence[Candidate]):
    sc = al.blocks.sparkSession.sparkContext
    return sc.broadcast((_payload(cands), {p: r["site_count"] for p, r in al.stats.items()}, len(al.labels), al.lanes))


def _constant_columns(m: Model, n_taxa: int) -> Block:
    """One column per state in which all taxa have it: those that ascertainment leaves out."""
    probe = np.array([[ord(s)] * n_taxa for s in m.alphabet.states], dtype=np.uint8)
    return Block(probe, m.alphabet.table(), m.states)


def _asc_term(rates: Rates, m: Model, order, length, n_taxa: int, sites: float) -> float:
    """Correction for the columns that could not be observed: the constant ones."""
    return _asc_value(m, _constant_columns(m, n_taxa).loglh(rates, order, length), sites)


def _asc_value(m: Model, lnl: np.ndarray, sites: float) -> float:
    if m.asc == "LEWIS":
        return -sites * np.log(1 - np.exp(lnl).sum())
    w = np.array(m.asc_weights)
    return float(w[0] * np.log(np.exp(lnl).sum()) if m.asc == "FELS" else (w * lnl).sum())


def _asc_terms(rates: Rates, m: Model, order, length, n_taxa: int, sites: float):
    """The correction and, for every branch, its first and second derivative."""
    lnl, grad = _constant_columns(m, n_taxa).branch_terms(rates, order, length, np.eye(m.states))
    value = _asc_term(rates, m, order, length, n_taxa, sites)
    w = np.array(m.asc_weights) if m.asc != "LEWIS" else None
    if m.asc == "STAM":
        return value, {v: (float(w @ r), float(w @ c)) for v, (r, c) in grad.items()}
    lk = np.exp(lnl)
    rest, factor = (1 - lk.sum(), sites) if m.asc == "LEWIS" else (lk.sum(), w[0])
    sign = 1 if m.asc == "LEWIS" else -1
    out = {}
    for v, (r, c) in grad.items():
        # the sum of the constant columns' likelihoods changes by ``one`` and bends by ``two``
        one, two = (lk @ r) / rest, (lk @ (c + r * r)) / rest
        out[v] = (float(factor * one), float(factor * (two + sign * one * one)))
    return value, out


def score_table(al: PackedAlignment, cands: Sequence[Candidate]) -> DataFrame:
    """Log-likelihood of every candidate and partition, without ascertainment terms: (cand, part_id, lnl)."""
    bc = _tasks(al, cands)

    def run(it):
        (items, models), sizes, n_taxa, lanes = bc.value
        rates: dict = {}
        total: dict = {}
        for pdf in it:
            for part, n, codes, weights, lane in zip(pdf.part_id, pdf.n, pdf.codes, pdf.weights, pdf.lane):
                x, w = _decode(codes, weights, n, n_taxa)
                blocks: dict = {}
                for i in range(lane, len(items), lanes):
                    order, length, mids, keys, row, own = items[i]
                    mid = mids[part]
                    if mid not in rates:
                        rates[mid] = Rates(models[mid])
                    if mid not in blocks:
                        m = models[mid]
                        blocks = {mid: _block(x, m)}
                    use = w[row] > 0
                    if part in own:
                        lnl = blocks[mid].loglh(rates[mid], order, own[part])
                    else:
                        lnl = blocks[mid].loglh(rates[mid], order, length, keys)
                    total[i, part] = total.get((i, part), 0.0) + float(w[row][use] @ lnl[use])
        yield pd.DataFrame([(i, p, v) for (i, p), v in total.items()], columns=["cand", "part_id", "lnl"])

    return al.blocks.mapInPandas(run, "cand INT, part_id INT, lnl DOUBLE").groupBy("cand", "part_id").agg(
        F.sum("lnl").alias("lnl"))


def score(al: PackedAlignment, cands: Sequence[Candidate]) -> np.ndarray:
    """Log-likelihood of every candidate per partition: (candidates, partitions in id order)."""
    parts = sorted(al.stats)
    rows = score_table(al, cands).collect()
    out = np.zeros((len(cands), len(parts)))
    at = {p: k for k, p in enumerate(parts)}
    for r in rows:
        out[r["cand"], at[r["part_id"]]] = r["lnl"]
    # the ascertainment term depends on the tree and the column total only: once, not per block
    for i, c in enumerate(cands):
        for p, m in c.models.items():
            if m.asc and p in at:
                order, length = c.tree.rooted()
                out[i, at[p]] += _asc_term(Rates(m), m, order, c.lengths.get(p, length), len(al.labels), al.stats[p]["site_count"])
    return out


def derivatives(al: PackedAlignment, cands: Sequence[Candidate]):
    """Per candidate: total log-likelihood and {partition: {branch: (first, second)}}."""
    bc = _tasks(al, cands)

    def run(it):
        (items, models), _, n_taxa, lanes = bc.value
        rates: dict = {}
        total: dict = {}
        for pdf in it:
            for part, n, codes, weights, lane in zip(pdf.part_id, pdf.n, pdf.codes, pdf.weights, pdf.lane):
                x, w = _decode(codes, weights, n, n_taxa)
                for i in range(lane, len(items), lanes):
                    order, length, mids, _, row, own = items[i]
                    m = models[mids[part]]
                    if mids[part] not in rates:
                        rates[mids[part]] = Rates(m)
                    use = w[row] > 0
                    b = _block(x[use], m)
                    lnl, grad = b.branch_terms(rates[mids[part]], order, own.get(part, length), w[row][use])
                    vec = np.array([[lnl, 0.0], *[grad[v] for v in sorted(grad)]], dtype=float)
                    key = (i, part)
                    total[key] = total[key] + vec if key in total else vec
        rows = [(i, p, k - 1, a, b) for (i, p), vec in total.items() for k, (a, b) in enumerate(vec)]
        yield pd.DataFrame(rows, columns=["cand", "part_id", "branch", "d1", "d2"])

    got = al.blocks.mapInPandas(run, "cand INT, part_id INT, branch INT, d1 DOUBLE, d2 DOUBLE").groupBy(
        "cand", "part_id", "branch").agg(F.sum("d1").alias("d1"), F.sum("d2").alias("d2")).collect()
    lnl = np.zeros(len(cands))
    grads: list[dict] = [{} for _ in cands]
    names = [sorted(c.tree.rooted()[1]) for c in cands]
    for r in got:
        if r["branch"] < 0:
            lnl[r["cand"]] += r["d1"]
        else:
            grads[r["cand"]].setdefault(r["part_id"], {})[names[r["cand"]][r["branch"]]] = (r["d1"], r["d2"])
    for i, c in enumerate(cands):
        for p, m in c.models.items():
            if m.asc and p in al.stats:
                order, length = c.tree.rooted()
                term, slopes = _asc_terms(Rates(m), m, order, c.lengths.get(p, length), len(al.labels), al.stats[p]["site_count"])
                lnl[i] += term
                have = grads[i].setdefault(p, {})
                for v, (d1, d2) in slopes.items():
                    a, b = have.get(v, (0.0, 0.0))
                    have[v] = (a + d1, b + d2)
    return lnl, grads


def regrafts(near: dict, tips: int, lo: int, hi: int) -> list[tuple[int, int, tuple[int, int]]]:
    """Moves (attachment node, subtree root, target edge) at distance lo..hi of the pruning point."""
    out = []
    for a in near:
        if a < tips:
            continue
        for b in near[a]:
            todo = [(v, a, 1) for v in near[a] if v != b]
            while todo:
                v, came, dist = todo.pop()
                for w in near[v]:
                    if w == came:
                        continue
                    if lo <= dist <= hi:
                        out.append((a, b, (v, w)))
                    if dist < hi:
                        todo.append((w, v, dist + 1))
    return out


def _edge_lengths(near: dict, order, own: dict[int, float]) -> dict:
    """Neighbour maps with a partition's own lengths."""
    out = {v: dict(m) for v, m in near.items()}
    for v, kids in order:
        for c in kids:
            out[v][c] = out[c][v] = own[c]
    return out


def move_table(al: PackedAlignment, bases: Sequence[Candidate], lo: int, hi: int, limits: tuple[float, float] = (1e-6, 100.0)) -> DataFrame:
    """Log-likelihood of every subtree move of every base tree, without ascertainment terms: (cand, move, lnl).

    Moves are numbered as ``regrafts`` lists them.  Only base trees travel: tasks list the moves and score each by the partials
    around its new place, so a move costs a few products and not a tree.
    """
    sc = al.blocks.sparkSession.sparkContext
    bc = sc.broadcast((_payload(bases), [c.tree.near for c in bases], len(al.labels), al.lanes))

    def run(it):
        (items, models), nears, n_taxa, lanes = bc.value
        rates: dict = {}
        total: dict = {}
        numbers = [{m: k for k, m in enumerate(regrafts(near, n_taxa, lo, hi))} for near in nears]
        for pdf in it:
            for part, n, codes, weights, lane in zip(pdf.part_id, pdf.n, pdf.codes, pdf.weights, pdf.lane):
                x, w = _decode(codes, weights, n, n_taxa)
                for i in range(lane, len(items), lanes):
                    order, length, mids, _, row, own = items[i]
                    m = models[mids[part]]
                    if mids[part] not in rates:
                        rates[mids[part]] = Rates(m)
                    near = _edge_lengths(nears[i], order, own[part]) if part in own else nears[i]
                    use = w[row] > 0
                    block = _block(x[use], m)
                    sums = total.setdefault(i, np.zeros(len(numbers[i])))
                    for move, lnl in block.regrafts(rates[mids[part]], order, own.get(part, length), near, lo, hi, limits):
                        sums[numbers[i][move]] += w[row][use] @ lnl
        rows = [(i, k, v) for i, sums in total.items() for k, v in enumerate(sums.tolist())]
        yield pd.DataFrame(rows, columns=["cand", "move", "lnl"])

    return al.blocks.mapInPandas(run, "cand INT, move INT, lnl DOUBLE").groupBy("cand", "move").agg(F.sum("lnl").alias("lnl"))


def move_scores(al: PackedAlignment, bases: Sequence[Candidate], lo: int, hi: int,
                limits: tuple[float, float] = (1e-6, 100.0)) -> list[tuple[list, np.ndarray]]:
    """(moves, log-likelihood of each) of every base tree; a number per move comes to the driver."""
    got = move_table(al, bases, lo, hi, limits).toPandas()
    out = []
    for i, c in enumerate(bases):
        moves = regrafts(c.tree.near, c.tree.tips, lo, hi)
        own = got[got["cand"] == i]
        val = np.zeros(len(moves))
        val[own["move"].to_numpy()] = own["lnl"].to_numpy()
        for p, m in c.models.items():
            if m.asc and p in al.stats:
                order, length = c.tree.rooted()
                near = _edge_lengths(c.tree.near, order, c.lengths[p]) if p in c.lengths else c.tree.near
                block = _constant_columns(m, len(al.labels))
                terms = {mv: _asc_value(m, lnl, al.stats[p]["site_count"]) for mv, lnl in block.regrafts(Rates(m), order, c.lengths.get(p, length), near, lo, hi, limits)}
                val += [terms[mv] for mv in moves]
        out.append((moves, val))
    return out


def pattern_loglh(patterns: DataFrame, labels: Sequence[str], tree: str, model: Model | dict[int, Model]) -> DataFrame:
    """Log-likelihood of every pattern under one tree: (part_id, pattern, weight, loglh); narrow."""
    topo = Topology.from_newick(tree, labels)
    order, length = topo.rooted()
    bc = patterns.sparkSession.sparkContext.broadcast((order, length, model))

    def run(it):
        order, length, model = bc.value
        for pdf in it:
            for part, g in pdf.groupby("part_id"):
                m = model if isinstance(model, Model) else model[part]
                x = np.frombuffer("".join(g.pattern).encode("latin-1"), dtype=np.uint8).reshape(len(g), -1)
                yield g.assign(loglh=Block(x, m.alphabet.table(), m.states).loglh(Rates(m), order, length))

    return patterns.select("part_id", "pattern", "weight").mapInPandas(
        run, "part_id INT, pattern STRING, weight BIGINT, loglh DOUBLE")


def ancestral_probs(patterns: DataFrame, labels: Sequence[str], tree: str | Topology, model: Model | dict[int, Model]) -> DataFrame:
    """Marginal posteriors of the inner nodes per pattern: (part_id, pattern, node, probs).

    Inner nodes are numbered in the order they first appear in the text; columns get their
    rows by joining their pattern, so repeated columns are never computed twice.
    """
    topo = tree if isinstance(tree, Topology) else Topology.from_newick(tree, labels)
    order, length = topo.rooted()
    inner = sorted(v for v, _ in order)
    bc = patterns.sparkSession.sparkContext.broadcast((order, length, model, inner))

    def run(it):
        order, length, model, inner = bc.value
        for pdf in it:
            for part, g in pdf.groupby("part_id"):
                m = model if isinstance(model, Model) else model[part]
                x = np.frombuffer("".join(g.pattern).encode("latin-1"), dtype=np.uint8).reshape(len(g), -1)
                post = Block(x, m.alphabet.table(), m.states).posteriors(Rates(m), order, length)
                yield pd.concat([pd.DataFrame({"part_id": part, "pattern": g.pattern.to_numpy(), "node": k,
                                               "probs": list(post[v])}) for k, v in enumerate(inner)])

    return patterns.select("part_id", "pattern").mapInPandas(
        run, "part_id INT, pattern STRING, node INT, probs ARRAY<DOUBLE>")


def ancestral_states(probs: DataFrame, alphabet) -> DataFrame:
    """Most likely state, or the ambiguity code of all states within 0.5/s of the best one."""
    s = alphabet.size
    codes = {m: alphabet.code_of(m) for m in {m for m in alphabet.masks.values()}}
    pairs = [F.lit(x) for m, c in sorted(codes.items()) if c is not None for x in (int(m), c)]
    table = F.map_from_arrays(F.array(*[p.cast("bigint") for p in pairs[0::2]]), F.array(*pairs[1::2]))
    best = F.array_max("probs")
    bit = F.transform("probs", lambda p, i: F.when(p + 0.5 / s > best, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    mask = F.aggregate(bit, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    top = F.substring(F.lit(alphabet.states), F.array_position("probs", best).cast("int"), F.lit(1))
    return probs.withColumn("state", F.coalesce(F.element_at(table, mask), top))


def ancestral_sequences(states: DataFrame, chunk: int = 1000) -> DataFrame:
    """(node, part_id, site, state) -> state strings per run of ``chunk`` columns."""
    c = F.floor(F.col("site") / chunk).alias("chunk")
    return states.groupBy("node", "part_id", c).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("site", "state"))), lambda x: x["state"]), "").alias("segment"))


def transition_table(edges: DataFrame, model: Model, length: str = "length") -> DataFrame:
    """Edges with their transition matrices, flattened row by row per rate category (``p``)."""
    schema = ", ".join(f"`{n}` {t}" for n, t in edges.dtypes) + ", p ARRAY<DOUBLE>"

    def run(it):
        r = Rates(model)
        for pdf in it:
            yield pdf.assign(p=[r.p(t).ravel() for t in pdf[length]])

    return edges.mapInPandas(run, schema)


# -- parsimony --------------------------------------------------------------------------

def parsimony_table(al: PackedAlignment, trees: Sequence[Topology], alphabets: dict[int, object], row: int | Sequence[int] = 0) -> DataFrame:
    """Weighted Fitch changes of every tree over the whole alignment: (cand, score); ``row`` is the weight row of all or of each."""
    tables = {p: a.table() for p, a in alphabets.items()}
    rows = [row] * len(trees) if isinstance(row, int) else list(row)
    bc = al.blocks.sparkSession.sparkContext.broadcast(([t.rooted()[0] for t in trees], rows, tables, len(al.labels), al.lanes))

    def run(it):
        orders, rows, tables, n_taxa, lanes = bc.value
        total = np.zeros(len(orders))
        for pdf in it:
            for part, n, codes, weights, lane in zip(pdf.part_id, pdf.n, pdf.codes, pdf.weights, pdf.lane):
                x, w = _decode(codes, weights, n, n_taxa)
                masks = tables[part][x]
                for i in range(lane, len(orders), lanes):
                    total[i] += fitch(masks, orders[i], w[rows[i]])[1]
        yield pd.DataFrame({"cand": np.arange(len(orders)), "score": total.round().astype(np.int64)})

    return al.blocks.mapInPandas(run, "cand INT, score BIGINT").groupBy("cand").agg(F.sum("score").alias("score"))


def parsimony_scores(al: PackedAlignment, trees: Sequence[Topology], alphabets: dict[int, object], row: int | Sequence[int] = 0) -> np.ndarray:
    out = np.zeros(len(trees), dtype=np.int64)
    for r in parsimony_table(al, trees, alphabets, row).collect():
        out[r["cand"]] = r["score"]
    return out


def insertion_costs(al: PackedAlignment, jobs: Sequence[tuple[Topology, int, int]], alphabets: dict[int, object]) -> list[dict[int, int]]:
    """For each (tree, tip, weight row): extra changes per branch the tip could join."""
    tables = {p: a.table() for p, a in alphabets.items()}
    bc = al.blocks.sparkSession.sparkContext.broadcast(
        ([(t.rooted()[0], tip, row) for t, tip, row in jobs], tables, len(al.labels), al.lanes))

    def run(it):
        items, tables, n_taxa, lanes = bc.value
        total: dict = {}
        for pdf in it:
            for part, n, codes, weights, lane in zip(pdf.part_id, pdf.n, pdf.codes, pdf.weights, pdf.lane):
                x, w = _decode(codes, weights, n, n_taxa)
                masks = tables[part][x]
                for i in range(lane, len(items), lanes):
                    order, tip, row = items[i]
                    for b, c in fitch_insertions(masks, order, tip, w[row]).items():
                        total[i, b] = total.get((i, b), 0.0) + float(c)
        yield pd.DataFrame([(i, b, int(round(c))) for (i, b), c in total.items()], columns=["job", "branch", "cost"])

    got = al.blocks.mapInPandas(run, "job INT, branch INT, cost BIGINT").groupBy("job", "branch").agg(F.sum("cost").alias("c")).collect()
    out: list[dict[int, int]] = [{} for _ in jobs]
    for r in got:
        out[r["job"]][r["branch"]] = r["c"]
    return out
