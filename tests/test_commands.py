import re
import numpy as np
import itertools

import pytest

from cladeframe.functions import newick as nw
from cladeframe.operators import terraces as TR
from cladeframe.plans import commands as C
from cladeframe.plans.options import OptionError, Options, parse

SEQS = {"t1": "ACGTACGTACGGTTAACCGA", "t2": "ACGTTCGTACGGTTAACCGT", "t3": "ACTTACGTAGGGTTATCCGA",
        "t4": "GCTTACGTAGGATTATCCGA", "t5": "GCTTACGAAGCATTATCCGG"}


@pytest.fixture()
def msa(tmp_path):
    p = tmp_path / "a.phy"
    p.write_text("5 20\n" + "".join(f"{n} {s}\n" for n, s in SEQS.items()))
    return str(p)


def go(spark, line):
    return C.run(spark, parse(line.split()))


# -- options ----------------------------------------------------------------------------

def test_defaults_and_errors():
    assert parse([]).command == "help"
    for bad in ("--threads 2", "--evaluate --msa d.fa", "--msa d.fa --unknown", "--start --msa d.fa --tree x.nw",
                "--support --tree x", "--bsmsa --msa d.fa", "--search --msa d.fa --bs-trees 10",
                "--msa d.fa --tree pars --tree-constraint c.nw", "--all --msa d.fa --bs-trees autoMR", "--check --parse --msa d.fa"):
        with pytest.raises(OptionError):
            parse(bad.split())


def test_searches():
    def of(line):
        return parse(f"--msa birds.phy --model HKY {line}".split())

    assert of("").command == "search" and of("").start_trees == {"random": 10, "parsimony": 10} and of("").num_searches == 20
    own = of("--tree mine.nwk --threads 3 --seed 17")
    assert own.start_trees == {"user": 1} and own.tree == "mine.nwk" and (own.threads, own.seed) == (3, 17)
    some = of("--search --tree pars --brlen unlinked --spr-radius 7 --spr-cutoff 0.25 --prob-msa ON")
    assert list(some.start_trees) == ["parsimony"] and (some.brlen, some.spr_radius, some.spr_cutoff, some.prob_msa) == ("unlinked", 7, 0.25, True)
    every = of("--all")
    assert (every.bootstraps, every.bootstop, every.brlen, every.num_searches) == (1000, "autoMRE", "scaled", 20)
    mixed = of("--all --tree rand{3},pars{4},mine.nwk --bs-trees 70")
    assert (mixed.tree, mixed.num_searches, mixed.bootstraps, mixed.bootstop) == ("mine.nwk", 8, 70, "")
    fixed = of("--evaluate --tree mine.nwk --opt-model OFF --opt-branches OFF --lh-epsilon 0.5")
    assert not fixed.opt_model and not fixed.opt_branches and fixed.lh_epsilon == 0.5
    for o in (own, some, mixed, fixed, of("--all --bs-metric tbe --outgroup owl")):
        assert Options.from_json(o.to_json()) == o
    assert "model_overfit" not in of("--force model").checks()


# -- commands ---------------------------------------------------------------------------

def test_check_reports(spark, tmp_path):
    p = tmp_path / "x.fa"
    p.write_text(">a\nAC-GT\n>b\nAC-GT\n>c\n-----\n>d\nTC-GA\n>e\nTC-GG\n")
    out = go(spark, f"--check --msa {p} --model GTR --prefix {tmp_path}/r")
    assert out["gap_columns"] == 1 and out["gap_taxa"] == ["c"] and out["duplicates"] == [("a", "b")]
    back = C.read_alignment(spark, f"{tmp_path}/r.cladeframe.reduced.phy", "iphylip")
    assert back.labels == ["a", "d", "e"] and back.sites.count() == 4
    p.write_text(">a\nACZ\n>b\nACG\n>c\nACT\n>d\nTCG\n")
    with pytest.raises(ValueError, match="invalid character 'Z' in sequence 1 at position 3"):
        go(spark, f"--check --msa {p} --model GTR --nofiles")
    # every bad symbol is reported, not the first ones
    p.write_text(">a\n" + "ACZ" * 8 + "\n>b\n" + "ACG" * 8 + "\n>c\n" + "AJT" * 8 + "\n>d\n" + "TCG" * 8 + "\n")
    with pytest.raises(ValueError, match="16 in total") as e:
        go(spark, f"--check --msa {p} --model GTR --prefix {tmp_path}/bad")
    assert e.value.cells.count() == 16
    lines = [x for f in sorted(tmp_path.glob("bad*invalidCells*/part-*")) for x in f.read_text().splitlines() if not x.startswith("sequence")]
    assert len(lines) == 16 and lines[0] == "3\t2\tJ"
    p.write_text(">a b\nACG\n>b\nACC\n>c\nACT\n>d\nTCG\n")
    with pytest.raises(ValueError, match="reserved"):
        go(spark, f"--check --msa {p} --model GTR --nofiles")


def test_parse_evaluate_and_store(spark, msa, tmp_path):
    out = go(spark, f"--parse --msa {msa} --model GTR+G --prefix {tmp_path}/p")
    assert out["estimate"].first()["response"] >= 1
    tree = tmp_path / "t.nw"
    tree.write_text("((t1:0.1,t2:0.1):0.1,t3:0.1,(t4:0.1,t5:0.1):0.1);")
    a = go(spark, f"--loglh --msa {msa} --model JC --tree {tree}")
    b = go(spark, f"--loglh --msa {tmp_path}/p.cladeframe.rba --model JC --tree {tree}")
    assert abs(a["loglh"] - b["loglh"]) < 1e-9
    e = go(spark, f"--evaluate --msa {msa} --model JC --tree {tree} --prefix {tmp_path}/e --outgroup t1,t2")
    assert e["loglh"] > a["loglh"] and e["best_tree"].first()["monophyletic"]
    short = go(spark, f"--evaluate --msa {msa} --model JC --tree {tree} --blmax 0.12 --nofiles")
    t = nw.parse(short["newick"])
    assert max(t.length[1:]) <= 0.12 + 1e-9 and short["loglh"] <= e["loglh"] + 1e-6
    s = e["scores"].first()
    assert s["free_params"] == 7 and abs(s["aic"] - (14 - 2 * e["loglh"])) < 1e-6
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        go(spark, f"--evaluate --msa {msa} --model JC --tree {tree} --prefix {tmp_path}/e")


def test_partitioned_search(spark, msa, tmp_path):
    scheme = tmp_path / "s.part"
    scheme.write_text("JC, a = 1-20\\2\nHKY+FE, b = 2-20\\2\n")
    out = go(spark, f"--search --msa {msa} --model {scheme} --tree rand{{2}},pars{{1}} --prefix {tmp_path}/s --seed 3")
    assert out["ml_trees"].count() == 3 and set(out["models"]) == {0, 1}
    best = {s for s, _ in nw.splits(nw.parse(out["newick"]), {x: i for i, x in enumerate(SEQS)})}
    assert best == {"00111", "00011"}


def test_bootstrap_support_all(spark, msa, tmp_path):
    out = go(spark, f"--all --msa {msa} --model JC --tree pars{{1}} --bs-trees 6 --prefix {tmp_path}/b --seed 1 --bs-metric fbp,tbe")
    assert out["bs_trees"].count() == 6
    drawn = out["support"]["fbp"].first()["newick"]
    t = nw.parse(drawn)
    inner = [int(t.label[v]) for v in range(1, len(t.parent)) if t.label[v] and not t.label[v].startswith("t")]
    assert len(inner) == 2 and all(0 <= x <= 100 for x in inner)


def test_tree_set_commands(spark, tmp_path):
    ts = tmp_path / "all.nw"
    ts.write_text("((a,b),c,(d,e));\n((a,b),d,(c,e));\n((a,b),c,(e,d));\n")
    out = go(spark, f"--rfdist --tree {ts} --prefix {tmp_path}/rf")
    s = out["summary"].first()
    assert abs(s["avg_rf"] - 4 / 3) < 1e-9 and s["unique_trees"] == 2
    lines = sorted(r[0] for r in spark.read.text(f"{tmp_path}/rf.cladeframe.rfDistances").collect())
    assert lines == ["0\t1\t2\t0.500000", "0\t2\t0\t0.000000", "1\t2\t2\t0.500000"]
    c = go(spark, f"--consense MRE --tree {ts} --nofiles")
    assert {(r["split"], r["n"]) for r in c["splits"].collect()} == {("00111", 3), ("00011", 2)}
    ref = tmp_path / "ref.nw"
    ref.write_text("((a,b),c,(d,e));")
    sup = go(spark, f"--support --tree {ref} --bs-trees {ts} --nofiles")["support"]["fbp"].first()["newick"]
    assert ")67" in sup and ")100" in sup
    conv = go(spark, f"--bsconverge --bs-trees {ts} --nofiles")["bootstop"].collect()
    assert len(conv) == 1 and conv[0]["trees"] == 3
    ts.write_text("((a,b),c,d,e);((a,b),c,(d,e));")
    with pytest.raises(ValueError, match="multifurcating"):
        go(spark, f"--rf --tree {ts}")


def test_bsmsa_and_ancestral(spark, msa, tmp_path):
    out = go(spark, f"--bsmsa --msa {msa} --model JC --bs-trees 3 --prefix {tmp_path}/m --seed 5")
    per = {r["replicate"]: r["n"] for r in out["weights"].groupBy("replicate").agg({"weight": "sum"}).toDF("replicate", "n").collect()}
    assert per == {0: 20, 1: 20, 2: 20}
    back = C.read_alignment(spark, f"{tmp_path}/m.cladeframe.bootstrapMSA/replicate=1", "iphylip")
    assert back.labels == list(SEQS) and back.sites.count() == 20
    tree = tmp_path / "t.nw"
    tree.write_text("((t1:0.1,t2:0.1):0.1,t3:0.1,(t4:0.1,t5:0.1):0.1);")
    a = go(spark, f"--ancestral --msa {msa} --model JC --tree {tree} --prefix {tmp_path}/anc")
    seq = {r["node"]: r["segment"] for r in a["sequences"].collect()}
    assert len(seq) == 3 and all(len(s) == 20 for s in seq.values())
    head = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/anc.cladeframe.ancestralProbs")
    assert head.columns == ["Node", "Site", "State", "p_A", "p_C", "p_G", "p_T"] and head.count() == 60


def test_constraint_command(spark, msa, tmp_path):
    c = tmp_path / "c.nw"
    c.write_text("((t1,t5),t2,t3,t4);")
    out = go(spark, f"--search --msa {msa} --model JC --tree rand{{2}} --tree-constraint {c} --nofiles --seed 2")
    assert "01110" in {s for s, _ in nw.splits(nw.parse(out["newick"]), {x: i for i, x in enumerate(SEQS)})}


# -- terraces ---------------------------------------------------------------------------

def unrooted(labels):
    """Every unrooted topology as nested text, grown tip by tip."""
    trees = [nw.parse(f"({labels[0]},{labels[1]},{labels[2]});")]
    for x in labels[3:]:
        out = []
        for t in trees:
            for v in range(1, len(t.parent)):
                n = nw.Tree(list(t.parent), list(t.label), list(t.length))
                m = len(n.parent)
                n.parent += [n.parent[v], m]
                n.label += ["", x]
                n.length += [float("nan")] * 2
                n.parent[v] = m
                out.append(_ordered(n))
        trees = out
    return trees


def _ordered(t):
    kids = t.children()
    n, todo = nw.Tree(), [(0, -1)]
    while todo:
        v, p = todo.pop()
        me = n.add(p, t.label[v])
        todo += [(k, me) for k in kids[v]]
    return n


def induced(t, keep):
    labels = sorted(keep)
    m = nw.clade_matrix(t, {x: i for i, x in enumerate(sorted(t.label[v] for v in t.tips()))})
    cols = [i for i, x in enumerate(sorted(t.label[v] for v in t.tips())) if x in keep]
    out = set()
    for r in m[1:, cols]:
        r = r ^ r[0]
        if 2 <= r.sum() <= len(labels) - 2:
            out.add(r.tobytes())
    return out


@pytest.mark.parametrize("pattern", list(itertools.product(["11", "10", "01"], repeat=3)))
def test_terrace_size_against_enumeration(spark, pattern):
    labels = list("abcdef")
    presence = dict(zip(labels, ["11", "11", "11", *pattern]))
    text = "((a,d),(b,(e,c)),f);"
    t = nw.parse(text)
    sets = [{x for x in labels if presence[x][p] == "1"} for p in range(2)]
    want = sum(all(induced(u, s) == induced(t, s) for s in sets) for u in unrooted(labels))
    assert TR.terrace_size(spark, text, presence) == want
    assert want < 2 or TR.enumerate_terrace(text, presence, want - 1) is None
    got = TR.enumerate_terrace(text, presence, 1000)
    assert len(set(got)) == want
    for g in got:
        assert all(induced(nw.parse(g), s) == induced(t, s) for s in sets)


def test_registered_searches_run_at_the_defaults(spark, sf, monkeypatch):
    from cladeframe.plans.catalog import files, likelihoods, trees
    seen = []

    def search(al, searches, **options):
        seen.append((len(searches), len({s.tree.newick(al.labels) for s in searches}) > 1, options.get("fit_models", True)))
        for s in searches:
            s.loglh = 0.0
    monkeypatch.setattr(likelihoods.I, "search", search)
    for name in ("cmd_search", "cmd_search1", "constraint_search", "cmd_bootstrap"):
        likelihoods.Q[name](spark, sf)
    assert [n for n, _, _ in seen] == [20, 1, 20, 100] and all(fit for _, _, fit in seen)
    lines = []
    monkeypatch.setattr(files, "command", lambda spark, line: lines.append(line) or {"support": {"fbp": None}})
    files.Q["cmd_all"](spark, sf)
    assert "--tree" not in lines[0] and "--bs-trees" not in lines[0]
    assert {r.perm for r in trees.Q["bootstop_halves"](spark, sf).select("perm").distinct().collect()} == set(range(1000))


def test_probabilities_change_the_likelihood(spark, tmp_path):
    """By default, as with --prob-msa on, a file of probabilities is scored by them; off, by its symbols."""
    rows = ["5 6", "a b c d e"]
    rng = np.random.default_rng(3)
    for i in range(6):
        p = rng.dirichlet(np.ones(4), 5)
        # fixed order of the file format: C, A, T, G
        rows.append("".join("CATG"[k] for k in p.argmax(axis=1)) + " " + " ".join(",".join(f"{x:.4f}" for x in v) for v in p))
    f, t = tmp_path / "p.catg", tmp_path / "t.nwk"
    f.write_text("\n".join(rows) + "\n")
    t.write_text("((a:0.1,b:0.2):0.05,(c:0.3,d:0.15):0.1,e:0.4);\n")
    score = lambda more: go(spark, f"--loglh --msa {f} --model JC --tree {t} --nofiles{more}")["ml_trees"].first()["loglh"]
    soft, on, off = score(""), score(" --prob-msa on"), score(" --prob-msa off")
    assert soft == on != off
    fitted = go(spark, f"--evaluate --msa {f} --model JC --tree {t} --nofiles")["ml_trees"].first()["loglh"]
    assert fitted >= soft
    found = go(spark, f"--search --msa {f} --model GTR+FC --tree pars{{1}} --nofiles")["ml_trees"].first()
    assert np.isfinite(found["loglh"])


def rooted_by_trial(taxa, rules):
    """All rooted trees that obey the rules, by trying every way to part the taxa in two; no sharing, no short cuts."""
    if len(taxa) == 1:
        return [next(iter(taxa))]
    out, names = [], sorted(taxa)
    for choice in range(1 << (len(names) - 1)):
        right = frozenset(x for i, x in enumerate(names[1:]) if choice >> i & 1)
        left = frozenset(names) - right
        cuts = {x: x in right for x in names}
        if right and all(cuts[a] == cuts[b] for a, b, c in rules if {a, b, c} <= taxa):
            out += [f"({x},{y})" for x in rooted_by_trial(left, rules) for y in rooted_by_trial(right, rules)]
    return out


def shape(text):
    """Clades of a rooted tree."""
    out, open_ = set(), []
    for token in re.findall(r"[()]|\w+", text):
        if token == "(":
            open_.append(set())
            continue
        clade = frozenset(open_.pop()) if token == ")" else frozenset([token])
        out.add(clade)
        if open_:
            open_[-1] |= clade
    return frozenset(out)


@pytest.mark.parametrize("seed", range(8))
def test_terrace_graph_against_trial(seed):
    rng = np.random.default_rng(seed)
    taxa = frozenset("abcdef"[: 4 + seed % 3])
    start = rooted_by_trial(taxa, [])[int(rng.integers(15))]
    has = shape(start)
    every = [(a, b, c) for a in taxa for b in taxa for c in taxa if a < b and c not in (a, b) and any({a, b} <= s and c not in s for s in has)]
    rules = [sorted(every)[i] for i in rng.choice(len(every), size=min(len(every), int(rng.integers(1, 5))), replace=False)]
    t = TR.Terrace(taxa, rules)
    want = [shape(x) for x in rooted_by_trial(taxa, rules)]
    got = [shape(x) for x in t.trees()]
    assert t.size() == len(got) == len(set(got)) == len(want) and set(got) == set(want) and has in got
    assert all(x in t.text() for x in taxa)


def test_terrace_without_trial_of_free_taxa():
    """Forty taxa no rule has are not tried one by one; equal sets are solved once and named once in the text."""
    free = [f"f{i}" for i in range(40)]
    t = TR.Terrace(frozenset(["a", "b", "c", *free]), [("a", "b", "c")])
    n = 1
    for k in range(3, 43):
        n *= 2 * k - 1
    assert t.size() == n and len(t.nodes) <= 6
    pairs = [(f"x{i}", f"y{i}", f"x{(i + 1) % 5}") for i in range(5)]
    u = TR.Terrace(frozenset(x for p in pairs for x in p), pairs)
    assert len(u.nodes) < 80 and "#1=" in u.text() and u.size() > 100
    assert TR.compressed("((a,b),(c,d),e);", {x: "11" for x in "abcde"}) is not None
    assert TR.compressed("((a,b),(c,d),e);", {x: "10" if x < "c" else "01" for x in "abcde"}) is None


def test_terrace_command_writes_its_files(spark, msa, tmp_path):
    (tmp_path / "scheme").write_text("JC, a = 1-10\nJC, b = 11-20\n")
    (tmp_path / "tree").write_text("((t1,t2),t3,(t4,t5));\n")
    out = go(spark, f"--terrace --msa {msa} --model {tmp_path}/scheme --brlen unlinked --tree {tmp_path}/tree --prefix {tmp_path}/out")
    assert out["size"] == 1 and out["listed"]
    for kind in ("terraceCompressed", "terrace"):
        assert spark.read.text(f"{tmp_path}/out.cladeframe.{kind}").count() == 1
