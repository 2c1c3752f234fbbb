"""Iterative fitting on top of the distributed scores: branch lengths, models, topologies.

The driver holds only trees and parameters and decides what to try next; all data-sized work
is a Spark job over the packed alignment.  Every step proposes many settings for many
searches at once (start trees, replicates, step sizes, rearrangements), so the number of
jobs follows the number of rounds and not the number of trees.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np

from cladeframe.functions import newick as nw
from cladeframe.functions.models import FREE_RATE_BOUNDS, Model
from cladeframe.operators import likelihood as L
from cladeframe.operators.likelihood import Candidate, PackedAlignment, Topology

# Limits and defaults of the reference programme.
MIN_LENGTH, MAX_LENGTH = 1e-6, 100.0
SMOOTH_ROUNDS = 32
ALPHA_BOUNDS = (0.02, 1000.0)
PINV_BOUNDS = (1e-6, 0.99)
RATE_BOUNDS = (1e-3, 1000.0)
FREQ_RATIO_BOUNDS = (1e-3, 1000.0)
SCALER_BOUNDS = (0.01, 100.0)
LH_EPSILON = 0.1
SPR_CUTOFF = 1.0
KEEP_TOPOLOGIES = 20
AUTO_RADIUS_STEP, AUTO_RADIUS_MAX = 5, 22


@dataclass
class Search:
    """State of one start tree or replicate."""

    search_id: int
    tree: Topology
    models: dict[int, Model]
    weight_row: int = 0
    lengths: dict[int, dict[int, float]] = field(default_factory=dict)
    loglh: float = -np.inf
    radius: int = 0
    active: bool = True
    limits: tuple[float, float] = (MIN_LENGTH, MAX_LENGTH)
    #: Cost from which on a way is not followed, and the costs met so far.
    cut: float = np.inf
    cost_sum: float = 0.0
    cost_n: int = 0

    def candidate(self, tree: Topology | None = None, models=None, lengths=None) -> Candidate:
        return Candidate(tree or self.tree, models or self.models, self.weight_row,
                         self.lengths if lengths is None else lengths)


def totals(al: PackedAlignment, cands: Sequence[Candidate]) -> np.ndarray:
    return L.score(al, cands).sum(axis=1) if cands else np.zeros(0)


# -- branch lengths ---------------------------------------------------------------------

def optimise_lengths(al: PackedAlignment, searches: list[Search], eps: float = 0.1, rounds: int = SMOOTH_ROUNDS) -> None:
    """Newton steps on all branches together; each job also yields the next derivatives.

    A step that does not gain is taken back and retried shorter, so the likelihood never
    drops; all searches take their step in the same pass.
    """
    live = list(searches)
    lnl, grads = L.derivatives(al, [s.candidate() for s in live])
    state, step = {}, {}
    for s, v, g in zip(live, lnl, grads):
        s.loglh = float(v)
        state[id(s)], step[id(s)] = g, 1.0
    for _ in range(rounds):
        cands = [_stepped(s, state[id(s)], step[id(s)]) for s in live]
        lnl, grads = L.derivatives(al, cands)
        still = []
        for s, c, v, g in zip(live, cands, lnl, grads):
            gain = float(v) - s.loglh
            if gain > 0:
                s.tree, s.lengths, s.loglh = c.tree, c.lengths, float(v)
                state[id(s)], step[id(s)] = g, min(1.0, 2 * step[id(s)])
                keep = gain > eps
            else:
                step[id(s)] *= 0.3
                keep = step[id(s)] > 0.02
            if keep:
                still.append(s)
        live = still
        if not live:
            break


def _newton(t: float, d1: float, d2: float, step: float, limits: tuple[float, float]) -> float:
    move = -d1 / d2 if d2 < 0 else np.sign(d1) * max(t, 0.05)
    move = np.clip(move, -0.9 * t, max(2 * t, 0.2))
    return float(np.clip(t + step * move, *limits))


def _stepped(s: Search, grads: dict, step: float) -> Candidate:
    order, length = s.tree.rooted()
    if s.lengths:  # unlinked: every partition has its own set
        own = {p: {v: _newton(s.lengths[p][v], *g[v], step, s.limits) for v in g} for p, g in grads.items()}
        return s.candidate(lengths=own)
    both = {v: (sum(g[v][0] for g in grads.values()), sum(g[v][1] for g in grads.values())) for v in length}
    return s.candidate(tree=s.tree.set_lengths({v: _newton(length[v], *both[v], step, s.limits) for v in length}))


def unlink(al: PackedAlignment, s: Search) -> None:
    _, length = s.tree.rooted()
    s.lengths = {p: dict(length) for p in al.stats}


# -- model parameters -------------------------------------------------------------------

def _params(m: Model, scalers: bool):
    """Free parameters in log space as (vector, bounds, write-back)."""
    x: list[float] = []
    lo: list[float] = []
    hi: list[float] = []
    put: list[tuple[str, int]] = []

    def add(values, bounds, name):
        for i, v in enumerate(values):
            x.append(np.log(np.clip(v, *bounds)))
            lo.append(np.log(bounds[0]))
            hi.append(np.log(bounds[1]))
            put.append((name, i))

    if m.mode["rates"] == "ml" and len(m.rates) > 1:
        fixed = m.symmetry[-1]
        add([m.rates[i] / m.rates[fixed] for i in range(len(m.rates)) if i != fixed], RATE_BOUNDS, "rates")
    if m.mode["freqs"] == "ml":
        add(m.freqs[:-1] / m.freqs[-1], FREQ_RATIO_BOUNDS, "freqs")
    if m.ratehet == "GAMMA" and m.mode["alpha"] == "ml" and m.ncat > 1:
        add([m.alpha], ALPHA_BOUNDS, "alpha")
    if m.mode["pinv"] == "ml":
        add([max(m.pinv, 1e-3)], PINV_BOUNDS, "pinv")
    if m.ratehet == "FREE" and m.ncat > 1:
        if m.mode["free_rates"] == "ml":
            add(m.cat_rates[:-1] / m.cat_rates[-1], FREE_RATE_BOUNDS, "free_rates")
        if m.mode["weights"] == "ml":
            add(m.cat_weights[:-1] / m.cat_weights[-1], FREE_RATE_BOUNDS, "weights")
    if scalers or m.mode["scaler"] == "ml":
        add([m.scaler], SCALER_BOUNDS, "scaler")
    return np.array(x), np.array(lo), np.array(hi), put


def _with(m: Model, x: np.ndarray, put) -> Model:
    m = replace(m)
    vals = np.exp(x)
    by: dict[str, list[float]] = {}
    for (name, _), v in zip(put, vals):
        by.setdefault(name, []).append(v)
    if "rates" in by:
        fixed = m.symmetry[-1]
        r = np.ones(len(m.rates))
        r[[i for i in range(len(r)) if i != fixed]] = by["rates"]
        m.rates = r
    if "freqs" in by:
        f = np.array([*by["freqs"], 1.0])
        m.freqs = f / f.sum()
    if "free_rates" in by:
        m.cat_rates = np.array([*by["free_rates"], 1.0])
    if "weights" in by:
        w = np.array([*by["weights"], 1.0])
        m.cat_weights = w / w.sum()
    for name in ("alpha", "pinv", "scaler"):
        if name in by:
            setattr(m, name, float(min(by[name][0], PINV_BOUNDS[1]) if name == "pinv" else by[name][0]))
    return m.with_categories()


class _Quasi:
    """One (search, partition): a bounded quasi-Newton state in log space."""

    def __init__(self, m: Model, scalers: bool):
        self.x, self.lo, self.hi, self.put = _params(m, scalers)
        self.h = np.eye(len(self.x))
        self.g: np.ndarray | None = None
        self.model = m
        self.f = -np.inf
        self.done = not len(self.x)

    def at(self, x) -> Model:
        return _with(self.model, np.clip(x, self.lo, self.hi), self.put)

    def learn(self, g: np.ndarray, moved: np.ndarray | None) -> None:
        if moved is not None and self.g is not None:
            y = self.g - g  # of the negated objective
            sy = moved @ y
            if sy > 1e-10:
                a = np.eye(len(y)) - np.outer(moved, y) / sy
                self.h = a @ self.h @ a.T + np.outer(moved, moved) / sy
        self.g = g

    def direction(self) -> np.ndarray:
        d = self.h @ self.g
        stuck = ((self.x <= self.lo) & (d < 0)) | ((self.x >= self.hi) & (d > 0))
        d = np.where(stuck, 0, d)
        if d @ self.g <= 0:
            self.h, d = np.eye(len(self.x)), np.where(stuck, 0, self.g)
        big = np.abs(d).max()
        return d if big <= 2 else d * (2 / big)


STEPS = (1.0, 0.5, 0.25, 0.1, 0.02, 2.0)


def optimise_models(al: PackedAlignment, searches: list[Search], eps: float = 0.1,
                    scaled: bool = False) -> None:
    """All free parameters of all partitions of all searches, in lockstep, until a round gains no more than ``eps`` / 2.

    Partitions are independent given the tree, so one pass perturbs parameter i of every
    partition at once: a gradient costs two passes' worth of settings per parameter of the
    largest model, whatever the number of partitions.
    """
    parts = sorted(al.stats)
    base = L.score(al, [s.candidate() for s in searches])
    fits: dict[tuple[int, int], _Quasi] = {}
    for k, s in enumerate(searches):
        s.loglh = float(base[k].sum())
        for j, p in enumerate(parts):
            q = fits[k, p] = _Quasi(s.models[p], scaled and len(parts) > 1)
            q.f = base[k, j]
    moved: dict = {}
    live = {k for k in range(len(searches)) if any(not fits[k, p].done for p in parts)}
    delta = 1e-4
    while live:
        cands, tags = [], []
        for k in sorted(live):
            for i in range(max(len(fits[k, p].x) for p in parts)):
                for sign in (1, -1):
                    ms = {}
                    for p in parts:
                        q = fits[k, p]
                        e = np.zeros(len(q.x))
                        if i < len(e) and not q.done:
                            e[i] = sign * delta
                        ms[p] = q.at(q.x + e) if e.any() else searches[k].models[p]
                    cands.append(searches[k].candidate(models=ms))
                    tags.append((k, i, sign))
        val = L.score(al, cands)
        grads = {(k, p): np.zeros(len(fits[k, p].x)) for k in live for p in parts}
        for (k, i, sign), row in zip(tags, val):
            for j, p in enumerate(parts):
                if i < len(grads[k, p]):
                    grads[k, p][i] += sign * row[j] / (2 * delta)
        for (k, p), g in grads.items():
            if len(g) and not fits[k, p].done:
                fits[k, p].learn(g, moved.get((k, p)))
        cands, tags = [], []
        for k in sorted(live):
            for step in STEPS:
                ms = {p: (fits[k, p].at(fits[k, p].x + step * fits[k, p].direction()) if not fits[k, p].done
                          else searches[k].models[p]) for p in parts}
                cands.append(searches[k].candidate(models=ms))
                tags.append((k, step))
        val = L.score(al, cands)
        for k in list(live):
            gain = 0.0
            rows = [i for i, t in enumerate(tags) if t[0] == k]
            models = dict(searches[k].models)
            for j, p in enumerate(parts):
                q = fits[k, p]
                if q.done:
                    continue
                b = max(rows, key=lambda i: val[i, j])
                better = val[b, j] - q.f
                if better > 0:
                    new = np.clip(q.x + tags[b][1] * q.direction(), q.lo, q.hi)
                    moved[k, p] = new - q.x
                    q.x, q.f = new, val[b, j]
                    models[p] = q.at(new)
                    gain += better
                else:
                    q.h = np.eye(len(q.x)) * 0.01
                    moved[k, p] = None
                if better <= eps / (2 * len(parts)):
                    q.done = True
            searches[k].models = models
            searches[k].loglh += gain
            if gain <= eps / 2 or all(fits[k, p].done for p in parts):
                live.discard(k)


def optimise_all(al: PackedAlignment, searches: list[Search], eps: float, linkage: str = "scaled",
                 lengths: bool = True, models: bool = True) -> None:
    """Alternate models and branch lengths until a round gains no more than ``eps``."""
    live = list(searches)
    while live:
        before = [s.loglh for s in live]
        if models:
            optimise_models(al, live, eps, scaled=linkage == "scaled")
        if lengths:
            optimise_lengths(al, live, eps)
        live = [s for s, b in zip(live, before) if s.loglh - b > eps]
        if not (lengths and models):
            break
    if linkage == "scaled":
        for s in searches:
            normalise_scalers(al, s)


def normalise_scalers(al: PackedAlignment, s: Search) -> None:
    """Column-weighted mean scaler of one; branch lengths absorb the rest."""
    if len(s.models) < 2 or s.lengths:
        return
    w = np.array([al.stats[p]["site_count"] for p in sorted(s.models)], dtype=float)
    c = np.array([s.models[p].scaler for p in sorted(s.models)])
    mean = float((w * c).sum() / w.sum())
    s.models = {p: replace(m, scaler=m.scaler / mean) for p, m in s.models.items()}
    _, length = s.tree.rooted()
    s.tree = s.tree.set_lengths({v: t * mean for v, t in length.items()})


def evaluate(al: PackedAlignment, searches: list[Search], eps: float = LH_EPSILON, linkage: str = "scaled",
             opt_models: bool = True, opt_lengths: bool = True) -> None:
    """Fixed topology: branch lengths first, then everything to convergence."""
    if linkage == "unlinked" and len(al.stats) > 1:
        for s in searches:
            unlink(al, s)
    for s, v in zip(searches, totals(al, [s.candidate() for s in searches])):
        s.loglh = float(v)
    if opt_lengths:
        optimise_lengths(al, searches, max(eps, 10.0))
    if opt_models or opt_lengths:
        optimise_all(al, searches, eps, linkage, lengths=opt_lengths, models=opt_models)


# -- topology moves ---------------------------------------------------------------------

def regrafts(t: Topology, lo: int, hi: int) -> list[tuple[int, int, tuple[int, int]]]:
    """Moves (attachment node, subtree root, target edge) at distance lo..hi of the pruning point."""
    return L.regrafts(t.near, t.tips, lo, hi)


def apply_move(t: Topology, move) -> Topology:
    a, b, (u, w) = move
    n = t.copy()
    near = n.near
    x, y = [v for v in near[a] if v != b]
    joined = near[a][x] + near[a][y]
    for v in (x, y):
        del near[v][a], near[a][v]
    near[x][y] = near[y][x] = min(joined, MAX_LENGTH)
    if w not in near[u]:
        raise KeyError("target branch is gone")
    half = near[u].pop(w) / 2
    near[w].pop(u)
    for v in (u, w):
        near[a][v] = near[v][a] = max(half, MIN_LENGTH)
    return n


def clusters(t: Topology) -> list[int]:
    """Tip sets below every branch as integer bit masks."""
    order, _ = t.rooted()
    mask: dict[int, int] = {}
    out = []
    for v, kids in order:
        m = 0
        for c in kids:
            x = mask.get(c, 1 << c if c < t.tips else 0)
            out.append(x)
            m |= x
        mask[v] = m
    return out


def topology_key(t: Topology) -> frozenset:
    first = 1 << min(v for v in t.near if v < t.tips)
    full = sum(1 << v for v in t.near if v < t.tips)
    return frozenset(full & ~m if m & first else m for m in clusters(t))


class Constraint:
    """Splits over (a subset of) the taxa that every tree must display."""

    def __init__(self, text: str, labels: Sequence[str]):
        index = {x: i for i, x in enumerate(labels)}
        t = nw.parse(text)
        tips = [index[t.label[v]] for v in t.tips()]
        self.scope = sum(1 << i for i in tips)
        below: dict[int, int] = {}
        kids = t.children()
        for v in range(len(t.parent) - 1, -1, -1):
            below[v] = sum(below[k] for k in kids[v]) if kids[v] else 1 << index[t.label[v]]
        self.want = {below[v] for v in range(1, len(t.parent)) if kids[v]}

    def allows(self, t: Topology) -> bool:
        have = {m & self.scope for m in clusters(t)}
        return all(w in have or (self.scope & ~w) in have for w in self.want)


def within_cutoff(moves, val: np.ndarray, s: Search) -> np.ndarray:
    """Which moves are reached if a way ends behind a place that costs ``s.cut`` or more; counts the costs of those reached."""
    ok = np.zeros(len(moves), bool)
    open_: set = set()  # (subtree, node that may be left, node it was entered from)
    for i, (a, b, (v, w)) in enumerate(moves):  # a way's places come in order
        start = v in s.tree.near[a]
        if not start and (a, b, v) not in open_:
            continue
        ok[i] = True
        cost = s.loglh - val[i]
        if cost > 0:
            s.cost_sum, s.cost_n = s.cost_sum + cost, s.cost_n + 1
        if cost < s.cut:
            open_.add((a, b, w))
    return ok


def spr_round(al: PackedAlignment, searches: list[Search], lo: int, hi: int, thorough: bool, eps: float,
              constraint: Constraint | None = None, keep: int = KEEP_TOPOLOGIES, cutoff: float = 0.0) -> None:
    """One round of subtree moves for every search.

    Moves of all searches are scored in one job, in the tasks; trees are made only of moves that are taken up: the best
    ``keep`` different ones of each search (a beam of the algorithm, not of the data: the same in fast and thorough rounds,
    0 while the radius is sought), which go to branch-length fitting, together with a tree that takes all improvements that
    don't overlap at once.  With ``cutoff`` a way along the tree ends where a move costs more than that many times the mean cost
    of the last round.
    """
    first = 1 if cutoff and lo > 1 else lo  # the way there decides
    scored = L.move_scores(al, [s.candidate() for s in searches], first, hi, searches[0].limits if searches else (MIN_LENGTH, MAX_LENGTH))
    trial: list[Search] = []
    owner: list[int] = []
    for k, (s, (moves, val)) in enumerate(zip(searches, scored)):
        ok = within_cutoff(moves, val, s) if cutoff else np.ones(len(moves), bool)
        if cutoff and s.cost_n:
            s.cut = cutoff * s.cost_sum / s.cost_n
        if first < lo:
            near_ones = set(regrafts(s.tree, first, lo - 1))
            ok &= [m not in near_ones for m in moves]
        order = [i for i in np.argsort(-val, kind="stable") if ok[i]]
        seen = {topology_key(s.tree)}
        for i in order:
            if len(seen) > keep:
                break
            t = apply_move(s.tree, moves[i])
            key = topology_key(t)
            if key not in seen and (constraint is None or constraint.allows(t)):
                seen.add(key)
                trial.append(replace(s, tree=t, lengths=_inherit(s, t), search_id=len(trial), loglh=val[i]))
                owner.append(k)
        merged = _merge(s, [moves[i] for i in order if val[i] > s.loglh], constraint, 2 if keep else 1)
        if merged is not None and (not keep or topology_key(merged) not in seen):
            trial.append(replace(s, tree=merged, lengths=_inherit(s, merged), search_id=len(trial)))
            owner.append(k)
    if not trial:
        return
    optimise_lengths(al, trial, eps=1.0 if not thorough else 0.1)
    for t, k in zip(trial, owner):
        if t.loglh > searches[k].loglh:
            searches[k].tree, searches[k].lengths, searches[k].loglh = t.tree, t.lengths, t.loglh


def _inherit(s: Search, t: Topology) -> dict[int, dict[int, float]]:
    """Unlinked lengths after a move: branches keep their node's value, new ones the tree's."""
    if not s.lengths:
        return {}
    _, length = t.rooted()
    return {p: {v: own.get(v, x) for v, x in length.items()} for p, own in s.lengths.items()}


def _merge(s: Search, moves, constraint, least: int) -> Topology | None:
    """Apply improving moves one after the other where their surroundings are untouched; at least ``least`` of them."""
    t, used, n = s.tree, set(), 0
    for a, b, (u, w) in moves:
        x = {a, b, u, w, *s.tree.near[a]}
        if x & used:
            continue
        try:
            new = apply_move(t, (a, b, (u, w)))
        except KeyError:
            continue
        if not _connected(new) or (constraint and not constraint.allows(new)):
            continue
        t, n = new, n + 1
        used |= x
    return t if n >= least else None


def _connected(t: Topology) -> bool:
    start = next(iter(t.near))
    seen, todo = {start}, [start]
    while todo:
        for w in t.near[todo.pop()]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return len(seen) == len(t.near)


#: Steps of a search in order; "radius", "fast" and "slow" are repeated.
SEARCH_STEPS = ("lengths", "model", "radius", "refit", "fast", "between", "slow", "final")


def search(al: PackedAlignment, searches: list[Search], eps: float = LH_EPSILON, linkage: str = "scaled",
           radius: int = 0, constraint: Constraint | None = None, on_step: Callable | None = None,
           fit_models: bool = True, cutoff: float = 0.0, checkpoint=None) -> None:
    """Maximum-likelihood search from every start tree, all in step.

    Rough lengths and models, radius detection by growing windows, fast rounds while they
    gain, then thorough rounds with a growing radius, and final fitting to ``eps``.
    ``cutoff`` (0: none) bounds how far fast and thorough rounds follow a way that costs likelihood.
    With a ``checkpoint`` the state is written before every step and every round, and a search that finds one goes on from there.
    """
    place: dict = {"step": SEARCH_STEPS[0], "round": 0, "windows": {}}
    known = checkpoint.load() if checkpoint else None
    if known and len(known["searches"]) == len(searches):
        from cladeframe.plans.checkpoint import restore
        for s, state in zip(searches, known["searches"]):
            restore(s, state)
        place.update({k: known[k] for k in place if k in known})
    first = place["step"]

    def begin(step: str) -> bool:
        """Whether the step is still to be done; a step that is begun anew starts at round 0."""
        if SEARCH_STEPS.index(step) < SEARCH_STEPS.index(first):
            return False
        if step != place["step"]:
            place.update(step=step, round=0, windows={})
        write()
        return True

    def write() -> None:
        if checkpoint:
            checkpoint.save(place, searches)

    def note(step):
        if on_step:
            on_step(step, searches)

    def fit(e):
        if fit_models:
            optimise_all(al, searches, e, linkage)
        else:
            optimise_lengths(al, searches, e)

    n = len(al.labels)
    top = max(1, min(AUTO_RADIUS_MAX, n - 3))
    if begin("lengths"):
        if linkage == "unlinked" and len(al.stats) > 1:
            for s in searches:
                unlink(al, s)
        optimise_lengths(al, searches, 10.0)
        note("lengths")
    if begin("model"):
        fit(10.0)
        note("model")
    if radius:
        for s in searches:
            s.radius = radius
    elif begin("radius"):
        _detect_radius(al, searches, top, constraint, place, write)
        note("radius")
    if begin("refit"):
        fit(3.0)
    for thorough in (False, True):
        if begin("slow" if thorough else "fast"):
            _rounds(al, searches, top, thorough, eps, constraint, cutoff, place, write)
            note("slow" if thorough else "fast")
        if not thorough and begin("between"):
            fit(1.0)
    if begin("final"):
        fit(eps)
    note("done")


def _rounds(al, searches, top, thorough, eps, constraint, cutoff, place, write) -> None:
    """Fast rounds at the radius while they gain; thorough ones in windows that go out until one gains, then again from the first."""
    if not place["round"]:
        for s in searches:
            s.active = True
            if not thorough:
                s.cut, s.cost_sum, s.cost_n = -s.loglh / 1000, 0.0, 0
        place["windows"] = {str(s.search_id): [1, AUTO_RADIUS_STEP if thorough else max(1, s.radius)] for s in searches}
    window = place["windows"]
    while True:
        groups: dict[tuple[int, int], list[Search]] = {}
        for s in searches:
            if s.active:
                groups.setdefault(tuple(window[str(s.search_id)]), []).append(s)
        if not groups:
            break
        for (a, b), ss in groups.items():
            before = [s.loglh for s in ss]
            spr_round(al, ss, a, b, thorough, eps, constraint, cutoff=cutoff)
            for s, x in zip(ss, before):
                if s.loglh - x > eps:
                    window[str(s.search_id)] = [1, AUTO_RADIUS_STEP if thorough else b]
                elif thorough and b + 1 < top:
                    window[str(s.search_id)] = [b + 1, b + AUTO_RADIUS_STEP]
                else:
                    s.active = False
        place["round"] += 1
        write()


def _detect_radius(al, searches, top, constraint, place=None, write=lambda: None):
    """The widest window that still gains, beginning with the first; each is tried before it is taken."""
    place = {"round": 0} if place is None else place
    if not place["round"]:
        for s in searches:
            s.radius, s.active = AUTO_RADIUS_STEP, True
    live = [s for s in searches if s.active]
    while live and 1 + place["round"] * AUTO_RADIUS_STEP < top:
        lo = 1 + place["round"] * AUTO_RADIUS_STEP
        hi = lo + AUTO_RADIUS_STEP - 1
        before = [s.loglh for s in live]
        spr_round(al, live, lo, hi, False, 1.0, constraint, keep=0)
        for s, x in zip(live, before):
            s.active = s.loglh - x > 0.1
            if s.active:
                s.radius = hi
        live = [s for s in live if s.active]
        place["round"] += 1
        write()


# -- starting trees ---------------------------------------------------------------------

def parsimony_trees(al: PackedAlignment, alphabets: dict[int, object], seeds: Sequence[int], rows: Sequence[int] | None = None) -> list[tuple[Topology, int]]:
    """Randomised stepwise addition, one job per added taxon for all trees together.

    Each seed fixes the order of taxa and breaks ties among equally good branches.
    """
    n = len(al.labels)
    rows = list(rows) if rows is not None else [0] * len(seeds)
    rngs = [np.random.Generator(np.random.Philox(key=[int(s) & (2**63 - 1), 17])) for s in seeds]
    orders = [list(r.permutation(n)) for r in rngs]
    trees = []
    for o in orders:
        c = n
        near: dict[int, dict[int, float]] = {c: {}}
        for tip in o[:3]:
            near[int(tip)] = {c: nw.DEFAULT_LENGTH}
            near[c][int(tip)] = nw.DEFAULT_LENGTH
        trees.append(Topology(near, n))
    for k in range(3, n):
        costs = L.insertion_costs(al, [(t, int(o[k]), r) for t, o, r in zip(trees, orders, rows)], alphabets)
        for i, (t, o, cost) in enumerate(zip(trees, orders, costs)):
            low = min(cost.values())
            ties = sorted(b for b, c in cost.items() if c == low)
            b = ties[int(rngs[i].integers(len(ties)))]
            order, _ = t.rooted()
            p = next(v for v, kids in order if b in kids)
            near = t.near
            m, tip = n + k - 2, int(o[k])
            del near[p][b], near[b][p]
            near[m] = {}
            near[tip] = {}
            for v in (p, b, tip):
                near[m][v] = near[v][m] = nw.DEFAULT_LENGTH
    scores = L.parsimony_scores(al, trees, alphabets, rows)
    return [(t, int(s)) for t, s in zip(trees, scores)]
