import itertools

import numpy as np
import pandas as pd
import pytest

from cladeframe.functions import models as M
from cladeframe.functions.kernel import Block, Rates, VectorBlock, fitch, fitch_insertions, tip_vectors
from cladeframe.operators import likelihood as L
from cladeframe.plans import inference as I

LABELS = ["a", "b", "c", "d", "e"]
TREE = "((a:0.1,b:0.2):0.05,(c:0.3,d:0.15):0.1,e:0.4);"


def columns(n=60, taxa=5, seed=3, alphabet="ACGT-R"):
    rng = np.random.default_rng(seed)
    base = rng.choice(list("ACGT"), size=n)
    out = []
    for i in range(n):
        out.append("".join(base[i] if rng.random() < 0.6 else rng.choice(list(alphabet)) for _ in range(taxa)))
    return out


def frame(spark, cols, part=0):
    g = pd.Series(cols).value_counts()
    first = {c: i for i, c in reversed(list(enumerate(cols)))}
    return spark.createDataFrame([(part, p, int(w), first[p]) for p, w in g.items()],
                                 "part_id INT, pattern STRING, weight BIGINT, first_site BIGINT")


def brute(m, tree, labels, col):
    """Sum over all inner states; an independent check of the pruning kernel."""
    t = L.Topology.from_newick(tree, labels)
    order, length = t.rooted()
    inner = [v for v, _ in order]
    root = inner[-1]
    up = {c: v for v, kids in order for c in kids}
    masks = m.alphabet.table()
    total = 0.0
    for k in range(m.ncat):
        p = {v: M.transition(m, length[v])[k] for v in length}
        s = 0.0
        for st in itertools.product(range(m.states), repeat=len(inner)):
            at = dict(zip(inner, st))
            x = m.freqs[at[root]]
            for v in up:
                if v in at:
                    x *= p[v][at[up[v]], at[v]]
                else:
                    mask = int(masks[ord(col[v])])
                    x *= sum(p[v][at[up[v]], j] for j in range(m.states) if mask >> j & 1)
            s += x
        total += m.cat_weights[k] * s
    inv = int(np.bitwise_and.reduce([masks[ord(c)] for c in col]))
    const = sum(m.freqs[j] for j in range(m.states) if inv >> j & 1)
    return np.log((1 - m.pinv) * total + m.pinv * const)


@pytest.mark.parametrize("text", ["JC", "GTR{1/2/3/4/5/1}+FU{0.1/0.2/0.3/0.4}+G4{0.5}+IU{0.2}", "HKY{1/3}+FE+R2{0.5/2}{0.6/0.4}"])
def test_kernel_matches_enumeration(text):
    m = M.parse_model(text)
    cols = columns(12)
    x = np.frombuffer("".join(cols).encode(), dtype=np.uint8).reshape(len(cols), -1)
    order, length = L.Topology.from_newick(TREE, LABELS).rooted()
    got = Block(x, m.alphabet.table(), 4).loglh(Rates(m), order, length)
    assert np.allclose(got, [brute(m, TREE, LABELS, c) for c in cols])


def test_derivatives_match_differences():
    m = M.parse_model("GTR{1/2/3/4/5/1}+FU{0.1/0.2/0.3/0.4}+G4{0.5}+IU{0.2}")
    cols = columns(40)
    x = np.frombuffer("".join(cols).encode(), dtype=np.uint8).reshape(len(cols), -1)
    b = Block(x, m.alphabet.table(), 4)
    order, length = L.Topology.from_newick(TREE, LABELS).rooted()
    w = np.arange(1.0, 41.0)
    lnl, grad = b.branch_terms(Rates(m), order, length, w)
    f = lambda ln: w @ b.loglh(Rates(m), order, ln)
    assert np.isclose(lnl, f(length))
    for v in length:
        h = 1e-4
        up, dn = f({**length, v: length[v] + h}), f({**length, v: length[v] - h})
        assert np.isclose(grad[v][0], (up - dn) / (2 * h), rtol=1e-4, atol=1e-3)
        assert np.isclose(grad[v][1], (up - 2 * f(length) + dn) / h**2, rtol=1e-2, atol=0.05)


def test_score_is_rooting_and_compression_invariant(spark):
    m = M.parse_model("GTR{1/2/3/4/5/1}+FU{0.1/0.2/0.3/0.4}+G4{0.5}")
    cols = columns(80)
    al = L.pack(frame(spark, cols), LABELS, m)
    same = "(a:0.1,(((c:0.3,d:0.15):0.1,e:0.4):0.05):0.0,b:0.2);"
    t1 = L.Topology.from_newick(TREE, LABELS)
    got = L.score(al, [I.Search(0, t1, {0: m}).candidate()])[0, 0]
    want = sum(brute(m, TREE, LABELS, c) for c in cols)
    assert np.isclose(got, want)
    rows = L.pattern_loglh(frame(spark, cols), LABELS, TREE, m).toPandas()
    assert np.isclose((rows.weight * rows.loglh).sum(), want)
    assert same  # rooted text variants are unrooted by the parser
    al.close()


def test_scaling_survives_many_taxa():
    m = M.parse_model("JC")
    n = 400
    names = [f"t{i}" for i in range(n)]
    text = "(t0:1,t1:1)"
    for x in names[2:-1]:
        text = f"({text}:1,{x}:1)"
    t = L.Topology.from_newick(f"({text}:1,{names[-1]}:1);", names)
    codes = np.frombuffer(("ACGT" * (n // 4)).encode(), dtype=np.uint8).reshape(1, -1)
    order, length = t.rooted()
    b = Block(codes, m.alphabet.table(), 4)
    v = b.loglh(Rates(m), order, length)
    assert np.isfinite(v).all() and v[0] < -500
    lnl, grad = b.branch_terms(Rates(m), order, length, np.ones(1))
    assert np.isclose(lnl, v[0]) and np.isfinite(list(grad.values())).all()


@pytest.mark.parametrize("asc", ["+ASC_LEWIS", "+ASC_FELS{30}", "+ASC_STAM{5/6/7/8}"])
def test_ascertainment(spark, asc):
    m = M.parse_model("JC" + asc)
    plain = M.parse_model("JC")
    cols = [c for c in columns(60, alphabet="ACGT") if len(set(c)) > 1]
    const = np.exp([brute(plain, TREE, LABELS, s * 5) for s in "ACGT"])
    base = sum(brute(plain, TREE, LABELS, c) for c in cols)
    want = base + {"+ASC_L": -len(cols) * np.log(1 - const.sum()), "+ASC_F": 30 * np.log(const.sum()),
                   "+ASC_S": (np.array([5, 6, 7, 8]) * np.log(const)).sum()}[asc[:6]]
    al = L.pack(frame(spark, cols), LABELS, m)
    t = L.Topology.from_newick(TREE, LABELS)
    assert np.isclose(L.score(al, [I.Search(0, t, {0: m}).candidate()])[0, 0], want)
    al.close()


def all_trees(n):
    """Every unrooted binary topology over n tips."""
    def grow(near, k, nxt):
        if k == n:
            yield L.Topology({v: dict(x) for v, x in near.items()}, n)
            return
        for a, b in [(a, b) for a in near for b in near[a] if a < b]:
            new = {v: dict(x) for v, x in near.items()}
            del new[a][b], new[b][a]
            new[nxt] = {a: 0.1, b: 0.1, k: 0.1}
            new[a][nxt] = new[b][nxt] = 0.1
            new[k] = {nxt: 0.1}
            yield from grow(new, k + 1, nxt + 1)
    yield from grow({0: {n: 0.1}, 1: {n: 0.1}, 2: {n: 0.1}, n: {0: 0.1, 1: 0.1, 2: 0.1}}, 3, n + 1)


def test_search_finds_the_best_of_all_topologies(spark):
    m = M.parse_model("JC")
    cols = columns(150, seed=9)
    al = L.pack(frame(spark, cols), LABELS, m)
    trees = list(all_trees(5))
    assert len(trees) == 15
    every = [I.Search(i, t, {0: m}) for i, t in enumerate(trees)]
    I.optimise_lengths(al, every, eps=1e-4)
    best = max(s.loglh for s in every)
    start = [I.Search(i, trees[i], {0: m}) for i in (0, 7, 14)]
    I.search(al, start, eps=0.01)
    assert np.isclose(max(s.loglh for s in start), best, atol=0.05)
    al.close()


def test_optimisers_improve_and_recover(spark):
    m = M.parse_model("HKY+FE+G4")
    cols = columns(300, seed=5, alphabet="ACGT")
    al = L.pack(frame(spark, cols), LABELS, m)
    s = I.Search(0, L.Topology.from_newick(TREE, LABELS), {0: m})
    first = I.totals(al, [s.candidate()])[0]
    I.evaluate(al, [s], eps=0.01)
    assert s.loglh > first
    assert np.isclose(I.totals(al, [s.candidate()])[0], s.loglh, atol=1e-6)
    # a stationary point: no single parameter change improves noticeably
    q = I._Quasi(s.models[0], False)
    for i in range(len(q.x)):
        for d in (0.05, -0.05):
            e = q.x.copy()
            e[i] += d
            assert I.totals(al, [s.candidate(models={0: q.at(e)})])[0] < s.loglh + 0.05
    al.close()


def test_unlinked_and_scaled_partitions(spark):
    m = M.parse_model("JC")
    df = frame(spark, columns(60, seed=1), 0).unionByName(frame(spark, columns(60, seed=2), 1))
    al = L.pack(df, LABELS, m)
    got = {}
    for link in ("linked", "scaled", "unlinked"):
        s = I.Search(0, L.Topology.from_newick(TREE, LABELS), {0: m, 1: m})
        I.evaluate(al, [s], 0.01, link)
        got[link] = s.loglh
    assert got["linked"] <= got["scaled"] + 0.05 <= got["unlinked"] + 0.1
    al.close()


def test_constraint_is_kept(spark):
    m = M.parse_model("JC")
    al = L.pack(frame(spark, columns(100, seed=4)), LABELS, m)
    c = I.Constraint("((a,e),b,c,d);", LABELS)
    s = I.Search(0, L.Topology.from_newick("((a:0.1,e:0.1):0.1,b:0.1,(c:0.1,d:0.1):0.1);", LABELS), {0: m})
    I.search(al, [s], constraint=c)
    assert c.allows(s.tree)
    al.close()


def test_fitch_and_insertions():
    m = M.parse_model("JC")
    cols = columns(50)
    x = m.alphabet.table()[np.frombuffer("".join(cols).encode(), dtype=np.uint8).reshape(50, 5)]
    w = np.ones(50)
    for t in all_trees(4):
        order, _ = t.rooted()
        cost = fitch_insertions(x, order, 4, w)
        base = fitch(x, order, w)[1]
        for b in cost:
            near = {v: dict(k) for v, k in t.near.items()}
            p = next(v for v, kids in order if b in kids)
            near = {v + (v >= 4): {u + (u >= 4): z for u, z in k.items()} for v, k in near.items()}
            p, b2 = p + (p >= 4), b + (b >= 4)
            del near[p][b2], near[b2][p]
            near[99] = {p: 1, b2: 1, 4: 1}
            near[p][99] = near[b2][99] = 1
            near[4] = {99: 1}
            assert fitch(x, L.Topology(near, 5).rooted()[0], w)[1] == base + cost[b]


def test_parsimony_trees_and_replicate_weights(spark):
    m = M.parse_model("JC")
    cols = columns(80, seed=6)
    df = frame(spark, cols)
    extra = df.selectExpr("0 AS replicate", "part_id", "pattern", "weight * 2 AS weight")
    al = L.pack(df, LABELS, m, extra, 1)
    got = I.parsimony_trees(al, {0: m.alphabet}, [1, 2], [0, 1])
    best = min(L.parsimony_scores(al, list(all_trees(5)), {0: m.alphabet}))
    assert got[0][1] >= best and got[1][1] % 2 == 0
    t = L.Topology.from_newick(TREE, LABELS)
    a, b = L.score(al, [I.Search(0, t, {0: m}).candidate(), I.Search(1, t, {0: m}, weight_row=1).candidate()])
    assert np.isclose(2 * a[0], b[0])
    al.close()


def test_ancestral_states(spark):
    m = M.parse_model("JC")
    df = frame(spark, ["AAAAA", "ACACA", "-----"])
    probs = L.ancestral_probs(df, LABELS, TREE, m)
    rows = L.ancestral_states(probs, m.alphabet).toPandas()
    assert np.allclose(rows.probs.map(sum), 1)
    assert set(rows[rows.pattern == "AAAAA"].state) == {"A"}
    assert set(rows[rows.pattern == "-----"].state) <= set("-N?OX.")
    # the posterior of one node by enumeration
    t = L.Topology.from_newick(TREE, LABELS)
    order, length = t.rooted()
    inner = sorted(v for v, _ in order)
    p = {v: M.transition(m, length[v])[0] for v in length}
    up = {c: v for v, kids in order for c in kids}
    post = np.zeros((len(inner), 4))
    for st in itertools.product(range(4), repeat=len(inner)):
        at = dict(zip(inner, st))
        x = 0.25
        for v in up:
            x *= p[v][at[up[v]], at[v]] if v in at else p[v][at[up[v]], "ACGT".index("ACACA"[v])]
        for k, v in enumerate(inner):
            post[k, at[v]] += x
    post /= post.sum(axis=1, keepdims=True)
    mine = rows[rows.pattern == "ACACA"].sort_values("node").probs.to_list()
    assert np.allclose(mine, post)


@pytest.mark.parametrize("asc", ["+ASC_LEWIS", "+ASC_FELS{30}", "+ASC_STAM{5/6/7/8}"])
def test_ascertainment_in_branch_fitting(spark, asc):
    """Slopes match differences of the scored value, and fitting reports what scoring reports."""
    m = M.parse_model("JC+G4{0.7}" + asc)
    al = L.pack(frame(spark, [c for c in columns(80, seed=6, alphabet="ACGT") if len(set(c)) > 1]), LABELS, m)
    tree = L.Topology.from_newick(TREE, LABELS)
    lnl, grads = L.derivatives(al, [L.Candidate(tree, {0: m})])
    assert lnl[0] == pytest.approx(L.score(al, [L.Candidate(tree, {0: m})]).sum(), abs=1e-8)
    _, length = tree.rooted()
    h, names = 1e-4, sorted(length)
    moved = [tree.set_lengths({**length, v: length[v] + d}) for v in names for d in (h, -h)]
    f = L.score(al, [L.Candidate(t, {0: m}) for t in moved]).sum(axis=1)
    for k, v in enumerate(names):
        up, down = f[2 * k], f[2 * k + 1]
        assert grads[0][0][v][0] == pytest.approx((up - down) / (2 * h), abs=1e-3)
        assert grads[0][0][v][1] == pytest.approx((up + down - 2 * lnl[0]) / h**2, rel=1e-3, abs=1e-2)
    s = I.Search(0, tree, {0: m})
    I.optimise_lengths(al, [s], 1e-6)
    assert s.loglh > lnl[0] + 0.5
    assert s.loglh == pytest.approx(L.score(al, [s.candidate()]).sum(), abs=1e-8)
    al.close()


@pytest.mark.parametrize("model", ["JC", "GTR{1/2/3/1/4/1}+FU{0.1/0.2/0.3/0.4}+G4{0.6}+IU{0.1}", "JC+ASC_LEWIS"])
def test_moves_score_as_their_whole_trees(spark, model):
    """Partials around a move give what pruning the rearranged tree gives, for all columns, linked and unlinked."""
    labels = list("abcdefg")
    text = "((a:0.1,b:0.2):0.05,(c:0.15,d:0.1):0.2,(e:0.3,(f:0.1,g:0.12):0.08):0.1);"
    m = M.parse_model(model)
    al = L.pack(frame(spark, [c for c in columns(90, 7, 8, "ACGT-R") if len(set(c)) > 1]), labels, m)
    t = L.Topology.from_newick(text, labels)
    (moves, val), (_, own) = L.move_scores(al, [L.Candidate(t, {0: m}), L.Candidate(t.set_lengths({v: 0.3 for v in t.rooted()[1]}), {0: m}, 0, {0: dict(t.rooted()[1])})], 1, 9)
    assert moves == I.regrafts(t, 1, 9) and np.allclose(val, own)
    want = I.totals(al, [L.Candidate(I.apply_move(t, mv), {0: m}) for mv in moves])
    assert np.allclose(val, want, rtol=0, atol=1e-7)
    best = lambda v: {I.topology_key(I.apply_move(t, moves[i])) for i in np.argsort(-np.round(v, 6), kind="stable")[:20]}
    assert best(val) == best(want)
    (near, some), = L.move_scores(al, [L.Candidate(t, {0: m})], 2, 3)
    at = {mv: v for mv, v in zip(moves, val)}
    assert near == I.regrafts(t, 2, 3) and np.allclose(some, [at[mv] for mv in near])
    al.close()


def test_cutoff_ends_ways():
    t = L.Topology.from_newick("((a,b),(c,d),(e,(f,g)));", list("abcdefg"))
    moves = I.regrafts(t, 1, 9)
    s = I.Search(0, t, {}, loglh=-100.0)
    assert I.within_cutoff(moves, np.full(len(moves), -150.0), s).all() and s.cost_n == len(moves)  # no limit yet
    s = I.Search(0, t, {}, loglh=-100.0, cut=50.0)
    first = I.within_cutoff(moves, np.full(len(moves), -150.0), s)
    ends = [i for i, (a, b, (v, w)) in enumerate(moves) if v in t.near[a]]
    assert np.flatnonzero(first).tolist() == ends and s.cost_sum == 50.0 * len(ends)
    gains = np.where([i == ends[0] for i in range(len(moves))], -99.0, -150.0)
    a, b, (v, w) = moves[ends[0]]
    more = I.within_cutoff(moves, gains, I.Search(0, t, {}, loglh=-100.0, cut=50.0))
    beyond = [i for i, (x, y, (p, q)) in enumerate(moves) if (x, y, p) == (a, b, w)]
    assert set(np.flatnonzero(more)) == set(ends) | set(beyond)


def test_radius_is_the_widest_window_that_gained(spark, monkeypatch):
    """Windows 1-5, 6-10 and so on; the last that gains is kept, not the one after it."""
    seen = []

    def gains(until):
        def round_(al, searches, lo, hi, *args, **kw):
            seen.append((lo, hi))
            for s in searches:
                s.loglh += 1.0 if hi <= until else 0.0
        return round_
    for until, top, want, windows in ((0, 22, 5, [(1, 5)]), (5, 22, 5, [(1, 5), (6, 10)]), (15, 22, 15, [(1, 5), (6, 10), (11, 15), (16, 20)]), (99, 22, 25, [(1, 5), (6, 10), (11, 15), (16, 20), (21, 25)]), (99, 4, 5, [(1, 5)]), (99, 1, 5, [])):
        seen.clear()
        monkeypatch.setattr(I, "spr_round", gains(until))
        s = I.Search(0, None, {}, loglh=0.0)
        I._detect_radius(None, [s], top, None)
        assert (s.radius, seen) == (want, windows)


@pytest.mark.parametrize("model", ["JC", "GTR{1/2/3/1/4/1}+FU{0.1/0.2/0.3/0.4}+G4{0.6}+IU{0.1}"])
def test_one_hot_vectors_score_as_symbols(spark, model):
    """Vectors of zeros and ones give likelihood, derivatives and moves of the symbols they stand for."""
    m = M.parse_model(model)
    cols = columns(80)
    masks = m.alphabet.table()
    hot = lambda c: [[float(int(masks[ord(x)]) >> k & 1) for k in range(4)] for x in c]
    table = spark.createDataFrame([(hot(c),) for c in cols], "vectors ARRAY<ARRAY<DOUBLE>>")
    al, av = L.pack(frame(spark, cols), LABELS, m), L.pack_vectors(table, LABELS, {0: {"base_freqs": [0.25] * 4, "site_count": 80}})
    c = L.Candidate(L.Topology.from_newick(TREE, LABELS), {0: m})
    assert np.allclose(I.totals(al, [c]), I.totals(av, [c]))
    (a, ga), (b, gb) = L.derivatives(al, [c]), L.derivatives(av, [c])
    assert np.allclose(a, b) and all(np.allclose(ga[0][0][v], gb[0][0][v], atol=1e-6) for v in ga[0][0])
    assert np.allclose(L.move_scores(al, [c], 1, 5)[0][1], L.move_scores(av, [c], 1, 5)[0][1])
    al.close()
    av.close()


def test_vectors_against_enumeration():
    """Pruning of probability vectors against the sum over all states of tips and inner nodes."""
    m = M.parse_model("GTR{1/2/3/1/4/1}+FU{0.1/0.2/0.3/0.4}")
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 1, (3, 5, 4))
    x[1, 2] = 0
    v = tip_vectors(x, True)
    assert np.allclose(v[1, 2], 1) and np.allclose(np.delete(v.reshape(15, 4), 7, 0).sum(axis=1), 1)
    assert np.allclose(tip_vectors(x, False)[0], x[0])
    t = L.Topology.from_newick(TREE, LABELS)
    order, length = t.rooted()
    got = VectorBlock(v).loglh(Rates(m), order, length)
    up = {c: p for p, kids in order for c in kids}
    inner = [p for p, _ in order]
    for i in range(3):
        total = 0.0
        for states in itertools.product(range(4), repeat=len(inner)):
            at = dict(zip(inner, states))
            w = m.freqs[at[inner[-1]]]
            for c, p in up.items():
                row = M.transition(m, length[c])[0][at[p]]
                w *= row[at[c]] if c in at else row @ v[i, c]
            total += w
        assert np.isclose(got[i], np.log(total))


def test_odd_vectors_are_refused(spark):
    short = spark.createDataFrame([([[1.0, 0.0]] * 5,)], "vectors ARRAY<ARRAY<DOUBLE>>")
    with pytest.raises(ValueError, match="5 vectors of 4"):
        L.pack_vectors(short, LABELS, {0: {"base_freqs": [0.25] * 4, "site_count": 1}})


class Stopped(Exception):
    pass


def test_a_stopped_search_ends_as_an_uninterrupted_one(spark, tmp_path, monkeypatch):
    """Stopped before each step and round in turn, and started again with new objects, it reaches the same trees and numbers."""
    from cladeframe.plans.checkpoint import Checkpoint

    labels = list("abcdefg")
    m = M.parse_model("HKY+G")
    al = L.pack(frame(spark, columns(70, 7, 4, "ACGT-")), labels, m)
    starts = ["((a,c),(b,d),(e,(f,g)));", "((g,c),(b,a),(e,(f,d)));"]

    def fresh():
        return [I.Search(k, L.Topology.from_newick(t, labels), {0: m}) for k, t in enumerate(starts)]

    def ends(ss):
        return [(s.loglh, s.tree.newick(labels, 12), s.models[0].text(True, 12), s.radius) for s in ss]
    whole = fresh()
    I.search(al, whole, cutoff=1.0)
    seen: list = []
    steps: list = []
    save = Checkpoint.save

    def stop_at(number):
        def saved(self, place, searches):
            save(self, place, searches)
            steps.append((place["step"], place["round"]))
            if len(steps) == number:
                raise Stopped
        return saved
    # every third place, so that the test stays short; the store is the same from stop to stop
    path, ss = str(tmp_path / "run"), None
    for _ in range(40):
        steps.clear()
        monkeypatch.setattr(Checkpoint, "save", stop_at(3))
        ss = fresh()
        try:
            I.search(al, ss, cutoff=1.0, checkpoint=Checkpoint(spark, path))
            break
        except Stopped:
            seen += steps
    assert {s for s, _ in seen} >= {"lengths", "radius", "fast", "slow"} and ends(ss) == ends(whole)
    al.close()


def test_state_is_read_tolerantly(spark, tmp_path):
    from cladeframe.plans import checkpoint as K

    m = M.parse_model("GTR+R3+B")
    s = I.Search(4, L.Topology.from_newick(TREE, LABELS), {0: m, 2: m}, 1, {0: {0: 0.1}}, -12.5, 6, False, (1e-5, 9.0), 3.0, 1.5, 2)
    c = K.Checkpoint(spark, str(tmp_path / "s"))
    for step in ("lengths", "model", "fast"):
        c.save({"step": step, "round": 1, "windows": {"4": [1, 5]}}, [s])
    again = K.Checkpoint(spark, str(tmp_path / "s"))
    record = again.load()
    assert record["step"] == "fast" and again.number == 3
    assert sorted(r.number for r in again.store.load("state").collect()) == [2, 3]
    t = I.Search(0, s.tree, {0: m, 2: m})
    K.restore(t, record["searches"][0])
    assert K.search_state(t) == K.search_state(s) and list(t.tree.near) == list(s.tree.near)
    old = dict(record["searches"][0])
    for k in ("cut", "cost_n", "models", "lengths"):
        old.pop(k)
    u = I.Search(0, s.tree, {0: m})
    K.restore(u, old)
    assert (u.search_id, u.cut, u.lengths) == (4, np.inf, {})
    rows = [(8, '{"version": 99, "searches": []}'), (9, "{broken"), (10, '{"version": 1, "searches": [{}]}')]
    for n, text in rows:
        again.store.save("state", n, spark.createDataFrame([(n, text)], "number INT, record STRING"))
    newest = K.Checkpoint(spark, str(tmp_path / "s"))
    assert newest.load()["step"] == "fast" and newest.number == 10
    assert K.Checkpoint(spark, str(tmp_path / "none")).load() is None
