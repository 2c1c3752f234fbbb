"""Registered queries on likelihood, parsimony, fitting, search and ancestral states."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from cladeframe.functions import registered
from cladeframe.functions.models import parse_model
from cladeframe.functions.ratehet import gamma_rates
from cladeframe.operators import bootstrap, likelihood as L, sites, trees as T
from cladeframe.plans import inference as I, recipes as R
from cladeframe.plans.catalog import sql as S
from cladeframe.plans.catalog.trees import NATIONS, newick_of, segment_trees
from cladeframe.session import shared_dir

Q: dict = {}
O: dict = {}


def query(oracle: str | None = None):
    def add(fn):
        Q[fn.__name__] = fn
        if oracle:
            O[fn.__name__] = oracle
        return fn
    return add


LABELS = R.LINE_TAXA
TREE = "((L1:0.1,L2:0.2):0.05,(L3:0.15,L4:0.1):0.2,(L5:0.3,(L6:0.1,L7:0.12):0.08):0.1);"
EVENT_TREE = "((click:0.1,error:0.2):0.15,purchase:0.3,(signup:0.1,view:0.25):0.2);"

# The same trees for the SQL side: node -> list of (child, branch length); root first.
LINE_NODES = {"r": [("x", 0.05), ("y", 0.2), ("z", 0.1)], "x": [("m1", 0.1), ("m2", 0.2)],
              "y": [("m3", 0.15), ("m4", 0.1)], "z": [("m5", 0.3), ("w", 0.08)], "w": [("m6", 0.1), ("m7", 0.12)]}
EVENT_NODES = {"r": [("x", 0.15), ("m3", 0.3), ("y", 0.2)], "x": [("m1", 0.1), ("m2", 0.2)], "y": [("m4", 0.1), ("m5", 0.25)]}


def pruning(nodes: dict, k: int, source: str, rates=(1.0,), root: str = "r", out: str = "f") -> str:
    """Equal-rates pruning as nested SQL: state likelihoods at ``root`` per rate category.

    Along a branch every state i becomes diff * sum(L) + (same - diff) * L_i.
    """
    near: dict = {}
    for v, kids in nodes.items():
        for c, t in kids:
            near.setdefault(v, {})[c] = t
            near.setdefault(c, {})[v] = t
    order, todo = [], [(root, None)]
    while todo:
        v, p = todo.pop()
        kids = [w for w in near[v] if w != p]
        if kids:
            order.append((v, kids))
        todo.extend((w, v) for w in kids)
    ctes, prev = [], source
    for n, (v, kids) in enumerate(reversed(order)):
        cols = []
        for c, rate in enumerate(rates):
            for i in range(k):
                terms = []
                for w in kids:
                    e = math.exp(-k * near[v][w] * rate / (k - 1))
                    same, diff = 1 / k + (k - 1) / k * e, 1 / k - e / k
                    if w.startswith("p"):
                        x = [f"{w}_{j}" for j in range(k)]
                    elif w.startswith("m"):
                        x = [f"(({w} >> {j}) & 1)" for j in range(k)]
                    else:
                        x = [f"{w}_{c}_{j}" for j in range(k)]
                    terms.append(f"({diff!r}::DOUBLE * ({' + '.join(x)}) + {same - diff!r}::DOUBLE * {x[i]})")
                cols.append(" * ".join(terms) + f" AS {v}_{c}_{i}")
        ctes.append(f"{out}{n} AS (SELECT *, {', '.join(cols)} FROM {prev})")
        prev = f"{out}{n}"
    return ", ".join(ctes) + f", {out} AS (SELECT * FROM {prev})"


# one row per order: masks with gaps as full sets
_LM = ", ".join(f"CASE WHEN m{k}=0 THEN 15 ELSE m{k} END AS m{k}" for k in range(1, 8))
LINE_MASKS = S.LINE_PATTERNS + f", lp AS (SELECT CAST(site % 3 AS INTEGER) AS part_id, site, {S._P} AS pattern, * EXCLUDE (site) FROM lm), " \
    f"u AS (SELECT part_id, pattern, count(*)::BIGINT AS weight, {', '.join(f'any_value(CASE WHEN m{k}=0 THEN 15 ELSE m{k} END) AS m{k}' for k in range(1, 8))} FROM lp GROUP BY 1,2)"
_JC = pruning(LINE_NODES, 4, "u")
_SITE = "ln(0.25 * (r_0_0 + r_0_1 + r_0_2 + r_0_3))"


def _patterns(spark, d):
    return sites.compress_patterns(R.line_sites(spark, d))


def _topo():
    return L.Topology.from_newick(TREE, LABELS)


@query(f"WITH {LINE_MASKS}, {_JC} SELECT part_id, round(sum(weight * {_SITE}), 4) AS loglh FROM f GROUP BY 1")
def loglh(spark, d):
    m = parse_model("JC")
    al = L.pack(_patterns(spark, d), LABELS, m)
    t = L.score_table(al, [L.Candidate(_topo(), {p: m for p in al.stats})])
    return _released(al, t.select("part_id", F.round("lnl", 4).alias("loglh")))


@query(f"WITH {LINE_MASKS}, {_JC} SELECT part_id, pattern, weight, round({_SITE}, 6) AS loglh FROM f")
def pattern_loglh(spark, d):
    p = L.pattern_loglh(_patterns(spark, d), LABELS, TREE, parse_model("JC"))
    return p.withColumn("loglh", F.round("loglh", 6))


@query(f"WITH {LINE_MASKS}, {_JC} SELECT round(sum(weight * {_SITE}), 4) AS loglh FROM f")
def loglh_sum(spark, d):
    p = L.pattern_loglh(_patterns(spark, d), LABELS, TREE, parse_model("JC"))
    return p.agg(F.round(F.sum(F.col("weight") * F.col("loglh")), 4).alias("loglh"))


# sixteen taxa with a vector of four numbers each from the 64 components of a vector
PROB_TAXA = [f"P{i}" for i in range(1, 17)]
PROB_TREE = "(" + ",".join(f"((P{i}:0.1,P{i + 1}:0.{i}):0.2,(P{i + 2}:0.05,P{i + 3}:0.3):0.1):0.15" for i in (1, 5, 9)) + ",((P13:0.1,P14:0.2):0.1,(P15:0.2,P16:0.1):0.05):0.3);"


def _sql_nodes(t: L.Topology, tip) -> tuple[dict, str]:
    """Nodes of a tree for ``pruning``, root first, and the root's name."""
    order, length = t.rooted()
    name = lambda v: tip(v) if v < t.tips else f"n{v}"
    return {name(v): [(name(c), length[c]) for c in kids] for v, kids in order[::-1]}, name(order[-1][0])


def _prob_sql() -> str:
    nodes, root = _sql_nodes(L.Topology.from_newick(PROB_TREE, PROB_TAXA), lambda v: f"p{v + 1}")
    cols = ", ".join(f"abs(e[{4 * t + j + 1}]) AS p{t + 1}_{j}" for t in range(16) for j in range(4))
    return (f"WITH e AS (SELECT embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT {cols} FROM e), {pruning(nodes, 4, 'u', root=root)} "
            f"SELECT round(sum(ln(0.25 * ({' + '.join(f'{root}_0_{k}' for k in range(4))}))), 4) AS loglh FROM f")


@query(_prob_sql())
def loglh_prob(spark, d):
    """Likelihood from probability vectors: every vector is a column of 16 taxa with four probabilities each."""
    v = R.table(spark, d, "embeddings")
    cell = lambda i: F.transform(F.slice("embedding", i * 4 + 1, F.lit(4)), lambda x: F.abs(x.cast("double")))
    columns = v.select(F.transform(F.sequence(F.lit(0), F.lit(15)), cell).alias("vectors"))
    m = parse_model("JC")
    al = L.pack_vectors(columns, PROB_TAXA, {0: {"base_freqs": [0.25] * 4, "site_count": None}})
    t = L.score_table(al, [L.Candidate(L.Topology.from_newick(PROB_TREE, PROB_TAXA), {0: m})])
    return _released(al, t.select(F.round("lnl", 4).alias("loglh")))


_G = [float(x) for x in gamma_rates(0.5, 4)]
_PINV = 0.2
_JCG = pruning(LINE_NODES, 4, "u", [g / (1 - _PINV) for g in _G])
_CAT = " + ".join(f"0.25 * 0.25 * (r_{c}_0 + r_{c}_1 + r_{c}_2 + r_{c}_3)" for c in range(4))
_INV = "0.25 * bit_count(m1 & m2 & m3 & m4 & m5 & m6 & m7)"


@query(f"WITH {LINE_MASKS}, {_JCG} SELECT part_id, round(sum(weight * ln({1 - _PINV} * ({_CAT}) + {_PINV} * {_INV})), 4) AS loglh FROM f GROUP BY 1")
def loglh_gamma_inv(spark, d):
    m = parse_model("JC+IU{0.2}+G4{0.5}")
    p = L.pattern_loglh(_patterns(spark, d), LABELS, TREE, m)
    return p.groupBy("part_id").agg(F.round(F.sum(F.col("weight") * F.col("loglh")), 4).alias("loglh"))


_EM = ", ".join(f"CASE WHEN substr(pattern, {i}, 1)='1' THEN 2 ELSE 1 END AS m{i}" for i in range(1, 6))
_BIN = f"{S.EVENT_SITES}, u AS (SELECT pattern, count(*)::BIGINT AS weight, {_EM} FROM event_sites GROUP BY pattern), {pruning(EVENT_NODES, 2, 'u')}"


@query(f"WITH {_BIN} SELECT pattern, weight, round(ln(0.5 * (r_0_0 + r_0_1)), 6) AS loglh FROM f")
def loglh_binary(spark, d):
    p = sites.compress_patterns(R.event_sites(spark, d))
    r = L.pattern_loglh(p, R.EVENT_TAXA, EVENT_TREE, parse_model("BIN+FE"))
    return r.select("pattern", "weight", F.round("loglh", 6).alias("loglh"))


_CONST = f"""cst AS (SELECT 1 AS m1, 1 AS m2, 1 AS m3, 1 AS m4, 1 AS m5), {pruning(EVENT_NODES, 2, 'cst', out='g')}"""


@query(f"""WITH {_BIN}, {_CONST}, v AS (SELECT weight, ln(0.5 * (r_0_0 + r_0_1)) AS l FROM f WHERE pattern NOT IN ('00000','11111'))
SELECT round(sum(weight * l) - sum(weight) * ln(1 - 2 * (SELECT 0.5 * (r_0_0 + r_0_1) FROM g)), 4) AS loglh FROM v""")
def asc_bias(spark, d):
    """Lewis correction on the variable columns only."""
    p = sites.compress_patterns(R.event_sites(spark, d)).where("pattern NOT IN ('00000', '11111')")
    m = parse_model("BIN+FE+ASC_LEWIS")
    al = L.pack(p, R.EVENT_TAXA, m)
    t = L.Topology.from_newick(EVENT_TREE, R.EVENT_TAXA)
    v = float(L.score(al, [L.Candidate(t, {0: m})]).sum())
    al.close()
    return spark.range(1).select(F.round(F.lit(v), 4).alias("loglh"))


@query(f"""WITH {S.SEG_COUNTS}, e AS (SELECT tree_id, taxon_id, n / 100.0::DOUBLE AS t FROM counts)
SELECT tree_id, 'N' || taxon_id AS label, round(0.25 + 0.75 * exp(-4 * t / 3), 6) AS p_same, round(0.25 - 0.25 * exp(-4 * t / 3), 6) AS p_diff FROM e""")
def pmatrix(spark, d):
    """Transition probabilities of every tip branch of the segment trees (length: orders / 100)."""
    e = R.segment_year_counts(spark, d).select("tree_id", F.concat(F.lit("N"), F.col("taxon_id").cast("string")).alias("label"),
                                               (F.col("n") / 100.0).alias("length"))
    p = L.transition_table(e, parse_model("JC"))
    return p.select("tree_id", "label", F.round(F.col("p")[0], 6).alias("p_same"), F.round(F.col("p")[1], 6).alias("p_diff"))


# -- parsimony --------------------------------------------------------------------------

def _fitch_sql(nodes: dict, source: str) -> str:
    order, todo = [], ["r"]
    while todo:
        v = todo.pop()
        order.append(v)
        todo.extend(c for c, _ in nodes[v] if c in nodes)
    ctes, prev, changes, n = [], source, [], 0
    for v in reversed(order):
        kids = [c for c, _ in nodes[v]]
        acc = kids[0]
        for j, c in enumerate(kids[1:]):
            name = v if j == len(kids) - 2 else f"{v}{j}"
            ctes.append(f"p{n} AS (SELECT *, CASE WHEN {acc} & {c} <> 0 THEN {acc} & {c} ELSE {acc} | {c} END AS {name}, "
                        f"CASE WHEN {acc} & {c} <> 0 THEN 0 ELSE 1 END AS c{n} FROM {prev})")
            changes.append(f"c{n}")
            prev, acc = f"p{n}", name
            n += 1
    return ", ".join(ctes) + f", fit AS (SELECT *, {' + '.join(changes)} AS changes FROM {prev})"


@query(f"WITH {LINE_MASKS}, {_fitch_sql(LINE_NODES, 'u')} SELECT 0::INTEGER AS cand, sum(weight * changes)::BIGINT AS score FROM fit")
def parsimony_score(spark, d):
    m = parse_model("JC")
    al = L.pack(_patterns(spark, d), LABELS, m)
    return L.parsimony_table(al, [_topo()], {p: m.alphabet for p in al.stats})


_LADDER64 = "(" * 62 + "V0,V1)" + "".join(f",V{i})" for i in range(2, 62)) + ",V62,V63);"


@query(f"""WITH {S.VECTOR_CELLS}, l AS (SELECT site, list(CASE state WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 ELSE 8 END::BIGINT ORDER BY taxon_id) AS m FROM vcells GROUP BY 1),
z AS (SELECT list_reduce(m, lambda a, x: CASE WHEN a & 15 & x <> 0 THEN a - (a & 15) + (a & 15 & x) ELSE a - (a & 15) + 16 + ((a & 15) | x) END) AS v FROM l)
SELECT 0::INTEGER AS cand, sum(v >> 4)::BIGINT AS score FROM z""")
def parsimony_score_wide(spark, d):
    m = parse_model("JC")
    names = [f"V{i}" for i in range(64)]
    al = L.pack(sites.compress_patterns(R.vector_sites(spark, d)), names, m)
    return L.parsimony_table(al, [L.Topology.from_newick(_LADDER64, names)], {p: m.alphabet for p in al.stats})


@query()
def tree_parsimony(spark, d):
    """Five randomised stepwise-addition trees with their scores."""
    m = parse_model("JC")
    al = L.pack(_patterns(spark, d), LABELS, m)
    got = I.parsimony_trees(al, {p: m.alphabet for p in al.stats}, range(5))
    al.close()
    return spark.createDataFrame([(i, s, t.newick(LABELS)) for i, (t, s) in enumerate(got)], "tree_id INT, score BIGINT, newick STRING")


# -- ancestral states -------------------------------------------------------------------

# node numbers follow the text: root first, then the inner nodes in order of appearance
_POST = [pruning(LINE_NODES, 4, "u", root=v, out=f"q{i}_") for i, v in enumerate(("r", "x", "y", "z", "w"))]
_ANC = f"WITH {LINE_MASKS}, " + ", ".join(_POST) + ", post AS (" + " UNION ALL ".join(
    f"SELECT {i}::INTEGER AS node, part_id, pattern, [{', '.join(f'{v}_0_{j}' for j in range(4))}] AS l FROM q{i}_" for i, v in enumerate(("r", "x", "y", "z", "w"))) + \
    "), pr AS (SELECT node, part_id, pattern, list_transform(l, lambda x: x / list_sum(l)) AS p FROM post)"


def _ancestral(spark, d):
    return L.ancestral_probs(_patterns(spark, d), LABELS, TREE, parse_model("JC"))


@query(_ANC + ", s AS (SELECT node, part_id, pattern, unnest(range(0, 4)) AS k, unnest(p) AS p FROM pr) "
       "SELECT node, part_id, pattern, k::INTEGER AS state_no, round(p, 5) AS prob FROM s")
def ancestral_marginal(spark, d):
    a = _ancestral(spark, d)
    return a.select("node", "part_id", "pattern", F.posexplode("probs").alias("state_no", "p")).select(
        "node", "part_id", "pattern", "state_no", F.round("p", 5).alias("prob"))


_MASK = "list_sum(list_transform(range(1,5), lambda i: CASE WHEN p[i] + 0.125 > list_max(p) THEN 1 << (i - 1)::INTEGER ELSE 0 END))::INTEGER"


@query(_ANC + f"SELECT node, part_id, pattern, substr('-ACMGRSVTWYHKDB-', {_MASK} + 1, 1) AS state FROM pr")
def ancestral_ml_state(spark, d):
    return L.ancestral_states(_ancestral(spark, d), parse_model("JC").alphabet).select("node", "part_id", "pattern", "state")


@query(_ANC + f""", st AS (SELECT node, part_id, pattern, substr('-ACMGRSVTWYHKDB-', {_MASK} + 1, 1) AS state FROM pr)
SELECT node, part_id, site // 1000 AS chunk, string_agg(state, '' ORDER BY site) AS segment FROM st JOIN line_sites USING (part_id, pattern) GROUP BY 1,2,3""")
def ancestral_seq(spark, d):
    s = L.ancestral_states(_ancestral(spark, d), parse_model("JC").alphabet)
    return L.ancestral_sequences(s.join(R.line_sites(spark, d), ["part_id", "pattern"]))


# -- fitting ----------------------------------------------------------------------------

def _fit(spark, d, model: str, fn, patterns=None, labels=LABELS, tree=TREE):
    m = parse_model(model)
    al = L.pack(patterns if patterns is not None else _patterns(spark, d), labels, m)
    models = {p: m.with_stats(st["base_freqs"], st["inv_prop"]) for p, st in al.stats.items()}
    s = I.Search(0, L.Topology.from_newick(tree, labels), models)
    s.loglh = start = float(I.totals(al, [s.candidate()])[0])
    fn(al, s)
    rows = [(p, s.models[p].text(True, 4), s.tree.newick(labels), start, float(s.loglh), bool(s.loglh >= start - 1e-6)) for p in sorted(s.models)]
    al.close()
    return spark.createDataFrame(rows, "part_id INT, model STRING, newick STRING, start_loglh DOUBLE, loglh DOUBLE, improved BOOLEAN")


@query()
def opt_brlen(spark, d):
    return _fit(spark, d, "JC", lambda al, s: I.optimise_lengths(al, [s], 0.1))


@query()
def opt_brlen_scalers(spark, d):
    return _fit(spark, d, "JC", lambda al, s: I.optimise_models(al, [s], 0.1, scaled=True))


@query()
def opt_subst_rates(spark, d):
    return _fit(spark, d, "GTR+FE", lambda al, s: I.optimise_models(al, [s], 0.1))


@query()
def opt_freqs(spark, d):
    return _fit(spark, d, "F81+FO", lambda al, s: I.optimise_models(al, [s], 0.1))


@query()
def opt_alpha_pinv(spark, d):
    return _fit(spark, d, "JC+G+I", lambda al, s: I.optimise_models(al, [s], 0.1))


@query()
def opt_free_rates(spark, d):
    return _fit(spark, d, "JC+R3", lambda al, s: I.optimise_models(al, [s], 0.1))


@query()
def cmd_evaluate(spark, d):
    return _fit(spark, d, "HKY+FC+G", lambda al, s: I.evaluate(al, [s], 0.1, "linked"))


@query()
def brlen_unlinked(spark, d):
    return _fit(spark, d, "JC", lambda al, s: I.evaluate(al, [s], 0.1, "unlinked"))


def _event_search(spark, d, randoms: int, parsimony: int = 0, constraint=None, replicates: int = 0):
    """Searches with the model fitted, from random and parsimony trees; with replicates, one from a parsimony tree of each."""
    st = R.event_sites(spark, d)
    p = sites.compress_patterns(st)
    m = parse_model("BIN+FE")
    extra = bootstrap.draw_weights(st, replicates) if replicates else None
    al = L.pack(p, R.EVENT_TAXA, m, extra, replicates)
    ids = spark.range(randoms).select(F.col("id").alias("tree_id"))
    starts = [L.Topology.from_newick(r.newick, R.EVENT_TAXA) for r in T.random_trees(ids, R.EVENT_TAXA, seed=5, constraint=constraint).orderBy("tree_id").collect()]
    if parsimony or replicates:
        rows = range(1, replicates + 1) if replicates else None
        starts += [t for t, _ in I.parsimony_trees(al, {0: m.alphabet}, range(5, 5 + (replicates or parsimony)), rows)]
    ss = [I.Search(k, t, {0: m}, k + 1 if replicates else 0) for k, t in enumerate(starts)]
    I.search(al, ss, constraint=I.Constraint(constraint, R.EVENT_TAXA) if constraint else None)
    al.close()
    return spark.createDataFrame([(s.search_id, float(s.loglh), s.tree.newick(R.EVENT_TAXA)) for s in ss], "tree_id BIGINT, loglh DOUBLE, newick STRING")


@query()
def cmd_search(spark, d):
    """Best tree of searches from the default 10 random and 10 parsimony trees over the event alignment."""
    return T.best_tree(_event_search(spark, d, 10, 10))


@query()
def cmd_search1(spark, d):
    """One search, from a random tree, as the command does."""
    return _event_search(spark, d, 1)


@query()
def search_pipeline(spark, d):
    """Search over the seven-taxon line alignment from one parsimony tree, model fitted."""
    m = parse_model("JC+G")
    al = L.pack(_patterns(spark, d), LABELS, m)
    start = I.parsimony_trees(al, {p: m.alphabet for p in al.stats}, [1])[0][0]
    s = I.Search(0, start, {p: m for p in al.stats})
    I.search(al, [s], linkage="linked")
    al.close()
    return spark.createDataFrame([(0, float(s.loglh), s.tree.newick(LABELS))], "tree_id BIGINT, loglh DOUBLE, newick STRING")


@query()
def constraint_search(spark, d):
    """Best tree under a constraint, from the default 20 random trees."""
    return T.best_tree(_event_search(spark, d, 20, constraint="((click,view),error,purchase,signup);"))


@query()
def cmd_bootstrap(spark, d):
    """One search from a parsimony tree for each of the default 100 replicates, all in the same jobs."""
    return _event_search(spark, d, 0, replicates=100)


def _released(al, df):
    """The rows of a result of bounded size, after which the packed blocks can go."""
    rows = df.collect()
    al.close()
    return al.blocks.sparkSession.createDataFrame(rows, df.schema)


def _new_topologies() -> dict[int, L.Topology]:
    """Trees within radius 5 of the fixed one, each by the first move that makes it."""
    t, out = _topo(), {}
    seen = {I.topology_key(t)}
    for i, move in enumerate(I.regrafts(t, 1, 5)):
        new = I.apply_move(t, move)
        if (key := I.topology_key(new)) not in seen:
            seen.add(key)
            out[i] = new
    return out


def _moves_sql() -> str:
    """Pruning of every rearranged tree over all columns."""
    ctes, rows = [], []
    for i, t in _new_topologies().items():
        nodes, root = _sql_nodes(t, lambda v: f"m{v + 1}")
        ctes.append(pruning(nodes, 4, "every", root=root, out=f"q{i}_"))
        rows.append(f"SELECT {i}::INTEGER AS move, round(sum(weight * ln(0.25 * ({' + '.join(f'{root}_0_{k}' for k in range(4))}))), 4) AS loglh FROM q{i}_")
    masks = ", ".join(f"m{k}" for k in range(1, 8))
    return (f"WITH {LINE_MASKS}, every AS MATERIALIZED (SELECT {masks}, sum(weight)::BIGINT AS weight FROM u GROUP BY {masks}), {', '.join(ctes)}, "
            f"moves AS ({' UNION ALL '.join(rows)}) ")


_MOVES = _moves_sql()


@query(_MOVES + "SELECT move, loglh FROM moves")
def spr_round(spark, d):
    """Every topology within radius 5 of the fixed tree, scored in one pass by the partials around the move."""
    m = parse_model("JC")
    al = L.pack(_patterns(spark, d), LABELS, m)
    s = L.move_table(al, [L.Candidate(_topo(), {p: m for p in al.stats})], 1, 5)
    return _released(al, s.where(F.col("move").isin(list(_new_topologies()))).select("move", F.round("lnl", 4).alias("loglh")))


@query(_MOVES + "SELECT move, loglh FROM moves ORDER BY loglh DESC, move LIMIT 20")
def kbest_topologies(spark, d):
    """The 20 best moves: the beam of the search as a top-k query."""
    return spr_round(spark, d).orderBy(F.col("loglh").desc(), "move").limit(I.KEEP_TOPOLOGIES)


# -- registered functions ---------------------------------------------------------------

@query(f"WITH {LINE_MASKS}, {_JC} SELECT part_id, round(sum(weight * {_SITE}), 4) AS loglh FROM f GROUP BY 1")
def sql_pattern_loglh(spark, d):
    """The likelihood as a function in SQL."""
    registered.register(spark)
    return spark.sql("SELECT part_id, round(sum(weight * pattern_loglh(pattern, {taxa}, {tree}, 'JC')), 4) AS loglh FROM {patterns} GROUP BY part_id",
                     patterns=_patterns(spark, d), taxa=",".join(LABELS), tree=TREE)


@query("SELECT DISTINCT label, label + 2 AS categories, 2 * (label + 2) - 2 AS free_params, 'JC+R' || (label + 2) AS canonical FROM embeddings WHERE label >= 0")
def sql_parse_model(spark, d):
    """Models named by rows of a table, parsed by a lateral join."""
    registered.register(spark)
    return spark.sql("SELECT l.label, m.categories, CAST(m.free_params AS INT) AS free_params, m.canonical FROM (SELECT DISTINCT label FROM {v} WHERE label >= 0) l, LATERAL parse_model(concat('JC+R', label + 2)) m",
                     v=R.table(spark, d, "embeddings"))


# -- state of a run ---------------------------------------------------------------------

@query(f"WITH {_BIN} SELECT 2::INTEGER AS number, round(sum(weight * ln(0.5 * (r_0_0 + r_0_1))), 4) AS loglh FROM f")
def checkpoint_rw(spark, d):
    """Two states are written, and a newer one that can't be read; a new search takes up the second and scores its tree."""
    from cladeframe.plans.checkpoint import Checkpoint, restore
    m = parse_model("BIN+FE")
    al = L.pack(sites.compress_patterns(R.event_sites(spark, d)), R.EVENT_TAXA, m)
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    other = "((view:0.3,error:0.3):0.3,purchase:0.3,(signup:0.3,click:0.3):0.3);"
    c = Checkpoint(spark, path)
    for text in (other, EVENT_TREE):
        c.save({"step": "fast", "round": 1, "windows": {}}, [I.Search(0, L.Topology.from_newick(text, R.EVENT_TAXA), {0: m})])
    c.store.save("state", 3, spark.createDataFrame([(3, "{")], "number INT, record STRING"))
    s = I.Search(0, L.Topology.from_newick(other, R.EVENT_TAXA), {0: m})
    again = Checkpoint(spark, path)
    restore(s, again.load()["searches"][0])
    t = L.score_table(al, [s.candidate()]).select(F.lit(again.number - 1).alias("number"), F.round("lnl", 4).alias("loglh"))
    out = _released(al, t)
    again.store.clear()
    return out
