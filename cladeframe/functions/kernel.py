"""Per-block numerics: Felsenstein pruning, its branch derivatives, posteriors, Fitch sets.

A block is a few thousand patterns of one partition as a byte matrix (patterns x taxa).
Everything here is a vectorised step inside a Spark task; sums over blocks belong to Spark.

A tree is a list of (node, children) in postorder with the root last; tips are numbered as
the taxa.  ``length[v]`` is the branch above v.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np

from cladeframe.functions.models import Model, eigen

TINY = 1e-100


class Rates:
    """Decomposed model: transition matrices for any branch length in two products."""

    def __init__(self, m: Model):
        self.values, self.left, self.right = eigen(m)
        self.speed = m.cat_rates * m.scaler / (1 - m.pinv)
        self.pi = m.freqs / m.freqs.sum()
        self.weights, self.pinv = m.cat_weights, m.pinv

    def p(self, t: float, derivative: int = 0) -> np.ndarray:
        lam = self.values[None, :] * self.speed[:, None]
        e = np.exp(lam * t) * lam**derivative
        return np.maximum((self.left[None] * e[:, None, :]) @ self.right, 0 if not derivative else -np.inf)


    def terms(self, t: float) -> np.ndarray:
        """Weighted exponentials and their first two derivatives: (categories, states, 3)."""
        lam = self.values[None, :] * self.speed[:, None]
        e = np.exp(lam * t) * self.weights[:, None]
        return np.stack([e, e * lam, e * lam * lam], axis=2)


def tip_table(masks: np.ndarray, states: int) -> np.ndarray:
    """Byte -> 0/1 vector over the states."""
    return ((masks[:, None] >> np.arange(states, dtype=np.uint64)) & np.uint64(1)).astype(float)


class Block:
    """Partial likelihoods over one block, with a bounded memo of shared subtrees."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray, states: int, budget: int = 128 << 20):
        self.codes, self.states = codes, states
        self.tips = tip_table(masks, states)
        self.masks = masks
        self.memo: OrderedDict = OrderedDict()
        self.budget, self.held = budget, 0

    def invariant(self) -> np.ndarray:
        """(patterns, states): 1 where all taxa are compatible with the state."""
        common = np.bitwise_and.reduce(self.masks[self.codes], axis=1)
        return ((common[:, None] >> np.arange(self.states, dtype=np.uint64)) & np.uint64(1)).astype(float)

    def _along(self, rates: Rates, v: int, clv, t: float, derivative: int = 0) -> np.ndarray:
        """Partial of node v seen from the other end of its branch: (categories, patterns, states)."""
        pt = rates.p(t, derivative).transpose(0, 2, 1)
        return self._tip(v, pt) if clv is None else clv @ pt

    def _tip(self, v: int, matrices: np.ndarray) -> np.ndarray:
        """Tip vectors of taxon v times one matrix or several: (..., patterns, states)."""
        return (self.tips @ matrices).take(self.codes[:, v], axis=-2)

    def down(self, rates: Rates, order, length, keys=None):
        """Partials below every node: {node: (clv or None for tips, log scale or 0)}."""
        out: dict = {}
        for v, kids in order:
            key = keys[v] if keys is not None and v in keys else None
            if key is not None and key in self.memo:
                self.memo.move_to_end(key)
                out[v] = self.memo[key]
                continue
            clv, scale = None, 0.0
            for c in kids:
                below, s = out.get(c, (None, 0.0))
                x = self._along(rates, c, below, length[c])
                clv = x if clv is None else clv * x
                scale = scale + s
            if clv.min() < TINY:
                top = np.maximum(clv.max(axis=(0, 2)), 1e-300)
                clv = clv / top[None, :, None]
                scale = scale + np.log(top)
            out[v] = (clv, scale)
            if key is not None:
                self.memo[key] = out[v]
                self.held += clv.nbytes
                while self.held > self.budget:
                    _, (old, _) = self.memo.popitem(last=False)
                    self.held -= old.nbytes
        return out

    def combine(self, rates: Rates, per_cat: np.ndarray, scale) -> np.ndarray:
        """Category likelihoods (categories, patterns) -> log-likelihood per pattern."""
        lk = np.einsum("c,cp->p", rates.weights, per_cat)
        if rates.pinv > 0:
            const = rates.pinv * (self.invariant() @ rates.pi)
            with np.errstate(divide="ignore", over="ignore"):
                # add the invariant term on the scaled side where it can be represented
                lk = (1 - rates.pinv) * lk + const * np.exp(np.minimum(-np.asarray(scale), 700.0))
        with np.errstate(divide="ignore"):
            return np.log(lk) + scale

    def loglh(self, rates: Rates, order, length, keys=None) -> np.ndarray:
        out = self.down(rates, order, length, keys)
        clv, scale = out[order[-1][0]]
        return self.combine(rates, clv @ rates.pi, scale)

    def branch_terms(self, rates: Rates, order, length, weights: np.ndarray):
        """Log-likelihood and, for every branch, its first and second derivative sums.

        One sweep down and one up give both partials of every branch; ``weights`` may hold
        several weight vectors (rows), one result column each.
        """
        below = self.down(rates, order, length)
        root, kids = order[-1]
        above: dict = {}
        const = rates.pinv * (self.invariant() @ rates.pi) if rates.pinv > 0 else None
        into, back = rates.pi[:, None] * rates.left, np.ascontiguousarray(rates.right.T)
        grad: dict = {}
        lnl = None
        for v, kids in reversed(order):
            seen = {c: self._along(rates, c, below.get(c, (None, 0))[0], length[c]) for c in kids}
            from_up = None if v == root else self._along(rates, v, above[v][0], length[v])
            for c in kids:
                x, s = None, 0.0
                for o in kids:
                    if o != c:
                        x = seen[o] if x is None else x * seen[o]
                        s = s + below.get(o, (None, 0.0))[1]
                if from_up is not None:
                    x = x * from_up
                    s = s + above[v][1]
                if x.min() < TINY:
                    top = np.maximum(x.max(axis=(0, 2)), 1e-300)
                    x = x / top[None, :, None]
                    s = s + np.log(top)
                above[c] = (x, s)
                d, sd = below.get(c, (None, 0.0))
                # in the eigenbasis all derivatives share one product of the two partials
                z = (x.reshape(-1, self.states) @ into).reshape(x.shape)
                z *= self._tip(c, back) if d is None else (d.reshape(-1, self.states) @ back).reshape(d.shape)
                f0, f1, f2 = (rates.terms(length[c]).transpose(0, 2, 1) @ z.transpose(0, 2, 1)).sum(axis=0)
                scale = np.asarray(s + sd)
                if const is not None:
                    f0 = f0 + const / (1 - rates.pinv) * np.exp(np.minimum(-scale, 700.0))
                r1 = f1 / f0
                grad[c] = (weights @ r1, weights @ (f2 / f0 - r1 * r1))
                if lnl is None:
                    lnl = weights @ (np.log(f0 * (1 - rates.pinv)) + scale)
        return lnl, grad

    def directed(self, rates: Rates, order, length) -> tuple[dict, dict]:
        """Partials in both directions of every branch: at its lower end without what is above, at its upper end without what is below."""
        below = self.down(rates, order, length)
        root = order[-1][0]
        above: dict = {}
        for v, kids in reversed(order):
            seen = {c: (self._along(rates, c, below.get(c, (None, 0.0))[0], length[c]), below.get(c, (None, 0.0))[1]) for c in kids}
            if v != root:
                seen[None] = self._along(rates, v, above[v][0], length[v]), above[v][1]
            for c in kids:
                above[c] = self._product([x for o, x in seen.items() if o != c])
        return below, above

    def _product(self, parts) -> tuple[np.ndarray, np.ndarray | float]:
        clv, scale = parts[0]
        for x, s in parts[1:]:
            clv, scale = clv * x, scale + s
        if clv.min() < TINY:
            top = np.maximum(clv.max(axis=(0, 2)), 1e-300)
            clv, scale = clv / top[None, :, None], scale + np.log(top)
        return clv, scale

    def regrafts(self, rates: Rates, order, length, near, lo: int, hi: int, limits: tuple[float, float]):
        """(move, log-likelihood per pattern) of every subtree move at distance ``lo`` to ``hi``, lengths as they are after it.

        Nothing is computed again but what the subtree's absence changes: going away from where it was cut, each step
        combines what lies behind with one branch, and a move joins three partials at its new place.
        """
        below, above = self.directed(rates, order, length)
        parent = {c: v for v, kids in order for c in kids}

        def side(u, w):  # at u, without what is beyond w
            return below.get(u, (None, 0.0)) if parent.get(u) == w else above[w]

        def along(part, u, t):
            return self._along(rates, u, part[0], t), part[1]

        for a in near:
            if len(near[a]) != 3:
                continue
            for b in near[a]:
                cut = along(side(b, a), b, near[a][b])
                ends = [v for v in near[a] if v != b]
                joined = min(near[a][ends[0]] + near[a][ends[1]], limits[1])
                todo = [(v, a, along(side(u, a), u, joined), 1) for v, u in (ends, ends[::-1])]
                while todo:
                    v, came, back, dist = todo.pop()
                    ways = [w for w in near[v] if w != came]
                    seen = {w: along(side(w, v), w, near[v][w]) for w in ways} if len(ways) > 1 else {}
                    for w in ways:
                        here = self._product([back, *[seen[o] for o in ways if o != w]])
                        if lo <= dist <= hi:
                            half = max(near[v][w] / 2, limits[0])
                            clv, scale = self._product([along(here, v, half), along(side(w, v), w, half), cut])
                            yield (a, b, (v, w)), self.combine(rates, clv @ rates.pi, scale)
                        if dist < hi:
                            todo.append((w, v, along(here, v, near[v][w]), dist + 1))

    def posteriors(self, rates: Rates, order, length):
        """Marginal state probabilities at every inner node: {node: (patterns, states)}."""
        below = self.down(rates, order, length)
        root = order[-1][0]
        above: dict = {}
        out: dict = {}
        for v, kids in reversed(order):
            here = below[v][0]
            if v != root:
                here = here * self._along(rates, v, above[v], length[v])
            post = np.einsum("c,cps,s->ps", rates.weights, here, rates.pi)
            out[v] = post / post.sum(axis=1, keepdims=True)
            seen = {c: self._along(rates, c, below.get(c, (None, 0))[0], length[c]) for c in kids}
            for c in kids:
                x = None if v == root else self._along(rates, v, above[v], length[v])
                for o in kids:
                    if o != c:
                        x = seen[o] if x is None else x * seen[o]
                above[c] = x / np.maximum(x.max(axis=(0, 2)), 1e-300)[None, :, None]
        return out


class VectorBlock(Block):
    """A block whose tips have a likelihood vector of their own in every column: (columns, taxa, states)."""

    def __init__(self, vectors: np.ndarray, budget: int = 128 << 20):
        self.vectors, self.states = vectors, vectors.shape[2]
        self.memo: OrderedDict = OrderedDict()
        self.budget, self.held = budget, 0

    def invariant(self) -> np.ndarray:
        """1 where every taxon may have the state."""
        return (self.vectors > 0).all(axis=1).astype(float)

    def _tip(self, v: int, matrices: np.ndarray) -> np.ndarray:
        return self.vectors[:, v, :] @ matrices


def tip_vectors(probs: np.ndarray, normalise: bool) -> np.ndarray:
    """Tip likelihoods of probability vectors: shares of their sum if asked, ones where nothing is probable."""
    total = probs.sum(axis=-1, keepdims=True)
    return np.where(total > 0, probs / np.where(total > 0, total, 1) if normalise else probs, 1.0)


# -- parsimony --------------------------------------------------------------------------

def _meet(a: np.ndarray, b: np.ndarray):
    both = a & b
    empty = both == 0
    return np.where(empty, a | b, both), empty


def fitch(masks: np.ndarray, order, weights: np.ndarray):
    """State sets below every node and the weighted number of changes (Fitch 1971)."""
    sets = {}
    score = np.zeros(weights.shape[:-1])
    for v, kids in order:
        acc = None
        for c in kids:
            s = sets[c] if c in sets else masks[:, c]
            if acc is None:
                acc = s
            else:
                acc, cost = _meet(acc, s)
                score = score + weights @ cost
        sets[v] = acc
    return sets, score


def fitch_insertions(masks: np.ndarray, order, tip: int, weights: np.ndarray) -> dict:
    """Extra changes from attaching ``tip`` to each branch: two sweeps for all branches."""
    sets, _ = fitch(masks, order, weights)
    root = order[-1][0]
    up: dict = {}
    cost: dict = {}
    new = masks[:, tip]
    for v, kids in reversed(order):
        for c in kids:
            acc = None if v == root else up[v]
            for o in kids:
                if o != c:
                    s = sets[o] if o in sets else masks[:, o]
                    acc = s if acc is None else _meet(acc, s)[0]
            up[c] = acc
            on_edge, _ = _meet(acc, sets[c] if c in sets else masks[:, c])
            cost[c] = weights @ ((on_edge & new) == 0)
    return cost
